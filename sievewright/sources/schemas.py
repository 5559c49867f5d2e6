"""Explicit schemas of the JSON files that stages exchange; keys that are data are maps."""

TABLE_METADATA = (
    "struct<original_rows int, extraction_method string, has_title boolean, page int, contains_dosage boolean, contains_pricing boolean,"
    " contains_medication boolean, table_title string, narrative_length int,"
    " extraction_hints struct<key_numbers array<string>, key_terms array<string>, relationships array<string>>>"
)
QUALITY_SCORES = (
    "struct<overall double, chunk_count int,"
    " linguistic struct<fluency double, accuracy double, consistency double, completeness double, linguistic_composite double>,"
    " domain_specific struct<medical_terminology double, numerical_integrity double, statistical_terms double, unit_preservation double, domain_composite double>,"
    " structural struct<format_preservation double, document_integrity double, information_architecture double, structural_composite double>,"
    " empty_translations int, missing_content_ratio double>"
)
TRANSLATION = (
    "struct<detected_language string, was_translation_needed boolean, translation_decision string, model_used string,"
    f" quality_scores {QUALITY_SCORES}, translation_metadata struct<processing_time_seconds double>, total_processing_time_seconds double>"
)
CLEANED = (
    "doc_id string, created_date string, country string, source_type string,"
    f" chunks array<struct<heading string, text string, start_page int, end_page int, table_type string, table_metadata {TABLE_METADATA}>>,"
    f" _translation_metadata {TRANSLATION}, _corrupt_record string"
)
CHUNKED = (
    "doc_id string, chunks array<struct<text string, metadata struct<doc_id string, heading string, start_page int, end_page int,"
    " created_date string, country string, source_type string, original_file_path string, split_index string, oversized_split boolean, merged boolean>>>,"
    " _corrupt_record string"
)
PICOS = (
    "extraction_metadata struct<timestamp string, source_type string, indication string, total_countries int, total_picos int, temperature double>,"
    " picos_by_country map<string, struct<Indication string, Country string,"
    " PICOs array<struct<Population string, Intervention string, Comparator string, Outcomes string>>, ChunksUsed int, ContextTokens int, Error string, RawResponse string>>"
)
OUTCOMES = (
    "extraction_metadata struct<timestamp string, source_type string, indication string, total_countries int, temperature double>,"
    " outcomes_by_country map<string, struct<Indication string, Country string, Outcomes string, ChunksUsed int, ContextTokens int, Error string, RawResponse string>>"
)
CONSOLIDATED_OUTCOMES = (
    "outcomes_metadata struct<timestamp string, indication string, consolidation_type string, data_split string, total_unique_outcomes int,"
    " source_countries array<string>, source_types array<string>>, consolidated_outcomes map<string, map<string, array<string>>>"
)
SCORES = "case string, file_kind string, scenario string, element string, item_no int, score double"
