"""Readers and sinks of files: chunks written and read, scores of translations, the latest file."""

import datetime
import json

from pyspark.sql import functions as F

from sievewright.operators import documents as D
from sievewright.sources import readers, sinks


def test_chunks_are_written_and_read(spark, tmp_path):
    rows = [("d1", "f1", "10", "b", "DE"), ("d1", "f1", "02", "a", "DE"), ("d2", "f2", "01", " ", "FR")]
    chunks = spark.createDataFrame(rows, "doc_id string, original_file_path string, split_index string, text string, country string")
    sinks.write_chunks(chunks, str(tmp_path / "out"))
    got = [json.loads(line) for f in (tmp_path / "out").glob("*.json") for line in f.read_text().splitlines()]
    one = next(r for r in got if r["doc_id"] == "d1")
    assert [c["text"] for c in one["chunks"]] == ["a", "b"] and one["chunks"][0]["metadata"]["country"] == "DE" and len(got) == 2
    for i, r in enumerate(got):
        folder = tmp_path / "in" / "nsclc"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.json").write_text(json.dumps(r, indent=1))
    back = readers.chunks(spark, str(tmp_path / "in")).select("text", "country", "split_index", "merged").collect()
    assert sorted(map(tuple, back)) == [("a", "DE", "02", False), ("b", "DE", "10", False)]


def test_scores_of_translations(spark, tmp_path):
    scores = {"overall": 0.8, "linguistic": {"fluency": 0.7}, "domain_specific": {"unit_preservation": 1.0}, "structural": {"document_integrity": 0.9}}
    meta = {"translation_decision": "model_processing", "quality_scores": scores, "translation_metadata": {"processing_time_seconds": 3.5}}
    folder = tmp_path / "nsclc" / "HTA submissions" / "DE"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(json.dumps({"doc_id": "a", "country": "DE", "chunks": [], "_translation_metadata": meta}, indent=1))
    (folder / "b.json").write_text(json.dumps({"doc_id": "b", "chunks": []}))
    (row,) = readers.translations(spark, str(tmp_path)).collect()
    assert (row.doc_id, row.overall, row.fluency, row.unit_preservation, row.document_integrity, row.accuracy, row.seconds) == ("a", 0.8, 0.7, 1.0, 0.9, None, 3.5)


def test_the_latest_file_and_merged_rules(spark):
    day = datetime.datetime(2024, 1, 1)
    files = spark.createDataFrame([("a", day), ("c", day), ("b", day), ("z", day - datetime.timedelta(1))], "path string, modified timestamp")
    assert readers.latest_file(files).first().path == "c" and readers.latest_file(files.limit(0)).first().path is None
    rules = spark.range(1).select(D.merged_rules(F.array(*map(F.lit, [9.0, 1.0, 5.0, 6.5, 12.0])), 5).alias("r")).first().r
    assert rules == [1.0, 6.5, 12.0]
