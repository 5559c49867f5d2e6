"""Operators that SQL cannot express, against small hand-made cases and plain Python models."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from sievewright.functions import quality as Q
from sievewright.functions import tables as B
from sievewright.functions import text as T
from sievewright.operators import evidence as E
from sievewright.operators import retrieval as R
from sievewright.operators import sections as S
from sievewright.operators import statistics as ST
from sievewright.plans import scenarios
from sievewright.sources import providers, readers, sinks
from sievewright.streaming import incremental


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (T.remove_links, "see (https://a.b/c) and www.x.y () end", "see  and   end"),
        (T.line_key, "Página 12 / Ω", "páginaω"),
        (T.first_year, "Published 2019, in 1998", "2019"),
        (T.clean_symbols, "a$$$$$b ###### *******", "a$b ## **"),
        (T.clean_repetition, "no, no, no, no and very very very very big", "no, no and very very big"),
        (T.clean_repetition, "a b c a b c a b c d", "a b c d"),
        (T.clean_repetition, "été été été été", "été été"),
        (T.clean_punctuation, "what???? ok.... a,,,b", "what? ok. a,,,b"),
        (T.clean_whitespace, " a  b \n\n\n\nc ", "a b\n\nc"),
        (lambda c: T.clean_text(c, True), "<Row 1: Title>", "Title"),
        (T.clean_table_text, "Low 1: a\nRow 2: Row 2: b\nRow 3:", "a\nb"),
        (T.repair_json, '```json\n{"a": {"b": 1}}\n``` done', '{"a": {"b": 1}}'),
        (T.repair_json, "none", None),
        (T.file_name, "HCC: first-line (2L) x", "hcc_first-line_2l_x"),
        (T.country, "a/b/DE/x.json", "DE"),
        (T.source_type, "x/HTA%20submissions/DE/a.json", "hta_submission"),
    ],
)
def test_text_functions(spark, f, given, wanted):
    assert one(spark, given, f) == wanted


def test_comparator_terms(spark):
    got = one(spark, "Patients had (Sorafenib) 400 mg daily. Lenvatinib was used. The rest got atezolizumab", T.comparator_terms)
    assert got == ["400 mg", "Lenvatinib", "Patients", "atezolizumab"] or "Lenvatinib" in got and "atezolizumab" in got and "The" not in got


def test_sentences_and_tokens(spark):
    assert one(spark, "One. Two! three? Four\n\nFive", T.sentences) == ["One.", "Two! three?", "Four", "Five"]
    assert one(spark, "abc", T.token_count) == 1 and one(spark, "a" * 41, T.token_count) == 10


def hyphen_model(lines):
    out, i = [], 0
    while i < len(lines):
        if i + 1 < len(lines) and lines[i].endswith("-") and lines[i + 1][:1].islower():
            out.append(lines[i][:-1] + lines[i + 1].lstrip())
            i += 2
        else:
            out.append(lines[i])
            i += 1
    return out


def test_line_folds(spark):
    r = random.Random(1)
    for _ in range(5):
        lines = [r.choice(["abc-", "def", "Ghi", "jk-", "x y"]) for _ in range(12)]
        assert one(spark, lines, S.merge_hyphens, "array<string>") == hyphen_model(lines)
    assert one(spark, ["no end", "goes on here", "stop."], S.join_paragraphs, "array<string>") == ["no end goes on here", "stop."]
    assert one(spark, [], S.merge_hyphens, "array<string>") == []


def merge_model(ts, least, most):
    out, i = [], 0
    while i < len(ts):
        t = ts[i]
        if len(t) < least and out and len(out[-1]) + len(t) <= most:
            out[-1] += "\n\n" + t
        elif len(t) < least and i + 1 < len(ts):
            out.append(t + "\n\n" + ts[i + 1])
            i += 1
        else:
            out.append(t)
        i += 1
    return out


def test_merge_small(spark):
    r = random.Random(2)
    rows = [(d, i, "x" * r.choice([1, 5, 30, 60, 95])) for d in range(8) for i in range(9)]
    df = spark.createDataFrame(rows, "d int, i int, text string")
    got = {}
    for row in S.merge_small(df, ["d"], ["i"], "text", 20, 100).orderBy("d", "chunk").collect():
        got.setdefault(row.d, []).append(row.text)
    assert got == {d: merge_model([t for e, _, t in rows if e == d], 20, 100) for d in range(8)}


def test_oversize_parts_keep_all_words(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = S.split_oversize(spark.createDataFrame([("7", text), ("8", "short")], "i string, text string"), "text", 400, "i").collect()
    parts = sorted((r for r in rows if r.oversized_split), key=lambda r: r.split_index)
    assert [p.split_index for p in parts] == ["7_0_0", "7_0_1", "7_1_0", "7_1_1"] and " ".join(p.text for p in parts) == text


def test_sentence_pieces_and_overlaps(spark):
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(60))
    df = spark.createDataFrame([(text,)], "t string")
    row = S.pack_sentences(df, "t", 100, 130, 20, 10).select("pieces", S.merge_overlaps(F.col("pieces"), 20).alias("m")).first()
    assert len(row.pieces) > 4 and all(len(p) // 4 <= 130 for p in row.pieces)
    assert set(text.split()) <= set(" ".join(row.pieces).split())
    assert one(spark, ["a b c", "b c d", "x"], S.merge_overlaps, "array<string>") == "a b c d x"


def greedy_model(rows):
    kept, out = [], {}
    for key, text, same in rows:
        ws = set(text.lower().split())
        reason = None
        for t, k, s in kept:
            if t == text:
                reason = "duplicate"
                break
        if reason is None:
            for _, k, s in kept:
                if s == same and k | ws and (len(k & ws) / len(k | ws) > 0.7 or k and len(k & ws) / len(k) > 0.9 or ws and len(k & ws) / len(ws) > 0.9):
                    reason = "similar"
                    break
        if reason is None:
            kept.append((text, ws, same))
        out[key] = reason
    return out


def test_greedy_unique(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices("abcdefgh", k=r.randrange(1, 7))), r.choice("xy")) for i in range(80)]
    df = spark.createDataFrame([(1, *x) for x in rows], "g int, key int, text string, same string")
    got = {x.key: x.reason for x in R.greedy_unique(df, ["g"], ["key"], "key", 80, "same").collect()}
    assert got == greedy_model(rows)


def coverage_model(rows, k):
    left, covered, out = list(rows), set(), []
    while left and len(out) < k:
        best = max(range(len(left)), key=lambda i: (len(set(left[i][1]) - covered), -i))
        key, items = left.pop(best)
        out.append((key, len(set(items) - covered)))
        covered |= set(items)
    return out


def test_coverage(spark):
    r = random.Random(4)
    rows = [(i, [r.choice("abcdefghij") for _ in range(r.randrange(5))]) for i in range(25)]
    df = spark.createDataFrame([(1, *x) for x in rows], "g int, key int, items array<string>")
    got = R.coverage_select(df, ["g"], ["key"], "key", "items", 30, 25).orderBy("pick").collect()
    assert [(x.key, x.n_new) for x in got] == coverage_model(rows, 30)


def test_similar_pairs_equal_brute_force(spark):
    r = random.Random(5)
    sets = {i: sorted({r.choice("abcdefghijkl") for _ in range(r.randrange(1, 9))}) for i in range(60)}
    df = spark.createDataFrame(list(sets.items()), "i int, w array<string>")
    got = {(x.a, x.b) for x in R.similar_pairs(df.withColumnRenamed("i", "a"), df.withColumnRenamed("i", "b"), "a", "b", "w", 0.6).collect()}
    want = {(a, b) for a in sets for b in sets if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.6}
    assert got == want


def test_boilerplate_needs_two_pages_and_keeps_numbers(spark):
    rows = [(1, p, line) for p in (1, 2, 3) for line in ("Header 1", "12.5", f"body {'abc'[p - 1]}")] + [(2, 1, "only")]
    df = spark.createDataFrame(rows, "doc int, page int, line string")
    kept = S.drop_boilerplate(df, S.boilerplate_keys(df, "doc", "page"), "doc").collect()
    assert sorted(x.line for x in kept) == ["12.5", "12.5", "12.5", "body a", "body b", "body c", "only"]


def test_line_filters_in_order(spark):
    lines = ["INTRO", "text one", "1. Smith et al. 2019", "more note", "NEXT", "text www.x.y", "www.only.link", "Table of contents", "a ...... 12"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc int, n int, line string")
    got = S.keep_lines(df, "doc", ["n"], "line", F.col("line").isin("INTRO", "NEXT")).orderBy("n").collect()
    assert [x.line for x in got] == ["INTRO", "text one", "text"]


TABLE = [["Drug", "Dose", None], ["  Sora  fenib ", "400 mg", "€ 10"], [None, "", " "], ["Placebo", "0", "5"], ["x", "1-2", "< 3"]]


def test_tables(spark):
    kind = "array<array<string>>"
    cleaned = one(spark, TABLE, B.clean, kind)
    assert cleaned[1] == ["Sora fenib", "400 mg", "€ 10"] and len(cleaned) == 4
    assert one(spark, cleaned, B.structure_score, kind) == 1.0 and one(spark, cleaned[:2], B.structure_score, kind) == 0.0
    assert abs(one(spark, cleaned, B.domain_score, kind) - 1.0) < 1e-9
    assert one(spark, cleaned, B.headers, kind) == ["Drug", "Dose", "Column_3"]
    text = one(spark, TABLE, lambda c: B.narrative(c, F.lit("T")), kind)
    assert text.split("\n") == [
        "Table Title: T", "", "Table contains the following columns: Drug, Dose, Column_3",
        "Row 1: Drug: Sora fenib, Dose: 400 mg, and Column_3: € 10", "Row 2: Drug: Placebo, Dose: 0, and Column_3: 5", "Row 3: Drug: x, Dose: 1-2, and Column_3: < 3",
    ]
    bare = [["a b c d e", "f g h i j k"], ["only words here and there", ""]]
    assert one(spark, bare, lambda c: B.narrative(c, F.lit(None).cast("string")), kind) == "Row 1 contains: 'a b c d e', 'f g h i j k'\nRow 2: only words here and there"
    assert one(spark, [], lambda c: B.narrative(c, F.lit("T")), kind) == ""


@pytest.mark.parametrize(("text", "wanted"), [("1,234.5", True), ("12%", True), ("< 0.001", True), ("1.2-3.4", True), ("x1", False), ("", False), ("-3e5", True)])
def test_numbers(spark, text, wanted):
    assert one(spark, text, B.is_numeric) is wanted


def test_quality_metrics(spark):
    a, b = "Dose 10 mg for 5 days, p-value 0,05. The trial ended.", "Dose 10 mg for 6 days. The trial ended."
    row = spark.createDataFrame([(a, b)], "a string, b string").select(
        *(f(F.col("a"), F.col("b")).alias(n) for n, f in vars(Q).items() if n in ("numerical_integrity", "unit_preservation", "medical_terms", "statistical_terms", "consistency", "accuracy")),
        Q.fluency(F.col("b"), F.lit(True)).alias("fluency"), Q.fluency(F.lit(" "), F.lit(True)).alias("none"),
    ).first()
    assert abs(row.numerical_integrity - 1 / 3) < 1e-9 and row.unit_preservation == 0.5 and row.statistical_terms == 0.0
    assert row.medical_terms == 1.0 and 0 < row.accuracy <= 1 and 0 < row.consistency < 1 and row.fluency == 1.0 and row.none == 0.0


def test_quantiles_and_correlation(spark):
    t = ST.t_quantiles()
    assert [round(t[i], 3) for i in (0, 1, 9, 29)] == [12.706, 4.303, 2.228, 2.042]
    assert round(ST.f_quantile(0.95, 5, 10), 3) == 3.326
    ratings = [(i, r, x) for i, xs in enumerate([(9, 2, 5, 8), (6, 1, 3, 2), (8, 4, 6, 8), (7, 1, 2, 6), (10, 5, 6, 9), (6, 2, 4, 7)]) for r, x in enumerate(xs)]
    row = ST.icc_agreement(spark.createDataFrame(ratings, "i int, r int, x int"), "i", "r", "x").first()
    assert round(row.icc_agreement_single, 2) == 0.29  # a published example
    low, high = ST.icc_interval(row.asDict())
    assert 0 <= low <= row.icc_agreement_single <= high <= 1


def test_splits(spark):
    rows = spark.createDataFrame([("DE",), ("FR",), (None,)], "c string")
    split = lambda *v: spark.createDataFrame([(x,) for x in v], "c string")
    assert [E.in_split(rows, s, "c").count() for s in (split("DE"), split("ALL"), split(), split("XX"))] == [1, 3, 3, 0]


def test_lines_of_words(spark):
    words = [(1, "b", 50.0, 10.0), (1, "a", 10.0, 11.0), (1, "c", 5.0, 12.9), (1, "d", 1.0, 13.5)]
    got = E.words_to_lines(spark.createDataFrame(words, "page int, text string, x0 double, top double"), ["page"]).orderBy("line_no").collect()
    assert [x.text for x in got] == ["c a b", "d"]


# --- sources, sinks, providers, streams -------------------------------------------------------------------------------


def write_json(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, indent=1))


def chunk_file(doc, texts):
    meta = lambda i: {"doc_id": doc, "heading": "h", "country": "DE", "source_type": "hta_submission", "original_file_path": f"{doc}.json", "split_index": i}
    return {"doc_id": doc, "chunks": [{"text": t, "metadata": meta(i if i else "0_1_0")} for i, t in enumerate(texts)]}


def test_readers(spark, tmp_path):
    write_json(tmp_path / "hcc/HTA submissions/DE/a.json", {"doc_id": "a", "created_date": "2020", "chunks": [{"heading": "h", "text": "t", "start_page": 1, "end_page": 2}, {"heading": "x"}]})
    write_json(tmp_path / "hcc/HTA submissions/DE/b.json", {"chunks": []})
    (tmp_path / "hcc/HTA submissions/DE/c.json").write_text("{not json")
    (row,) = readers.documents(spark, str(tmp_path)).collect()
    assert (row.doc_id, row.country, row.source_type, row.case, row.text) == ("a", "DE", "hta_submission", "hcc", "t")
    write_json(tmp_path / "c/nsclc/x_chunked.json", chunk_file("a", ["one", " ", "two"]))
    rows = readers.chunks(spark, str(tmp_path / "c"), "nsclc").orderBy("text").collect()
    assert [(r.text, r.split_index, r.merged) for r in rows] == [("one", "0_1_0", False), ("two", "2", False)]
    assert [r.case for r in readers.available_cases(readers.chunks(spark, str(tmp_path / "c"))).collect()] == ["nsclc"]
    record = {"Indication": "i", "Country": "DE", "PICOs": [{"Population": "p", "Intervention": "x", "Comparator": ""}], "ChunksUsed": 1}
    write_json(tmp_path / "p/a.json", {"extraction_metadata": {"source_type": "s"}, "picos_by_country": {"DE": record, "FR": {"Error": "429"}}})
    got = {r.country: (r.Population, r.error) for r in readers.picos(spark, str(tmp_path / "p")).collect()}
    assert got == {"DE": ("p", None), "FR": (None, "429")}
    write_json(tmp_path / "o/a.json", {"outcomes_metadata": {"total_unique_outcomes": 9}, "consolidated_outcomes": {"c": {"s": ["x", "y"]}}})
    assert readers.consolidated_outcomes(spark, str(tmp_path / "o")).count() == 2


def test_score_sheets(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = [("", "Population", "Comparator"), ("a_score", "1", "n/a"), ("note", "7", "7"), ("b_score", "0.5", "1")]
    body = "".join(f"<row>{''.join(cell('ABC'[j] + str(i + 1), v) for j, v in enumerate(r))}</row>" for i, r in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="HCC_PC_base" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
    (tmp_path / "HCC_hpo.xlsx").write_bytes(out.getvalue())
    got = {(r.case, r.file_kind, r.scenario, r.element, r.item_no, r.score) for r in readers.scores(spark, str(tmp_path)).collect()}
    assert got == {("HCC", "hpo", "base", e, n, s) for e, n, s in (("Population", 1, 1.0), ("Comparator", 1, 0.0), ("Population", 2, 0.5), ("Comparator", 2, 1.0))}


def test_pages_of_files_that_cannot_be_read_are_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"ok")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def parse(content):
        if content == b"bad":
            raise ValueError("damaged")
        return [(100.0, [("w", 1.0, 2.0, 3.0, 9.0, "Bold")])]

    got = {r.path.rsplit("/", 1)[1]: (r.page, len(r.words), r.error) for r in readers.pdf_words(spark, str(tmp_path), parse).collect()}
    assert got == {"a.pdf": (1, 1, None), "b.pdf": (0, 0, "ValueError: damaged")}


def test_stream_replaces_changed_files(spark, tmp_path):
    src, store, mark = tmp_path / "src", str(tmp_path / "store"), str(tmp_path / "mark")
    write_json(src / "hcc/a.json", chunk_file("a", ["one", "two"]))
    incremental.follow(spark, str(src), store, mark)
    write_json(src / "hcc/b.json", chunk_file("b", ["three"]))
    incremental.follow(spark, str(src), store, mark)
    incremental.follow(spark, str(src), store, mark)  # nothing new
    assert sorted(r.text for r in spark.read.parquet(store).collect()) == ["one", "three", "two"]
    rows = spark.read.parquet(store).where("doc_id = 'a' and text = 'one'").withColumn("text", F.lit("changed"))
    sinks.upsert_store(rows, store, "file_path")
    spark.catalog.refreshByPath(store)
    assert sorted(r.text for r in spark.read.parquet(store).collect()) == ["changed", "three"]


def test_windowed_counts(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "ts string, k string")
    got = incremental.windowed_counts(rows.withColumn("ts", F.to_timestamp("ts")), "ts", "k").collect()
    assert sorted((r.k, r.n) for r in got) == [("a", 2), ("b", 1)]


def test_providers(spark):
    texts = ["The quick fox of the wood and the hill is here", "Le chat et le chien dans une maison pour la nuit", "kurz", "12345 67890 12345 67890"]
    df = spark.createDataFrame([("h", t) for t in texts], "heading string, text string")
    assert [r.l for r in df.select(providers.detect_language(F.col("text")).alias("l")).collect()] == ["en", "fr", None, None]

    def translator(t, lang):
        if t == "h":
            return "H"
        raise RuntimeError(lang)

    out = providers.translate(df, translator, ("fr",)).collect()
    assert [r.decision for r in out] == ["no_translation_needed_english", "model_processing", "no_translation_needed_english", "no_translation_needed_english"]
    assert out[1].error == "RuntimeError: fr" and out[1].text == texts[1]
    v = providers.embed(df).first().embedding
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-5
    contexts = spark.createDataFrame([("DE", "i", "ctx"), ("FR", "i", " "), ("IT", "i", "bad")], "country string, indication string, context string")
    model = lambda p: "no json" if "bad" in p else '```{"PICOs": [{"Population": "x"}]}```'
    got = {r.country: (r.record.PICOs if r.record else None, r.error) for r in providers.extract(contexts, "Q {indication}: {context_block}", "PICOs array<struct<Population string>>", model).collect()}
    assert got["DE"][0][0].Population == "x" and got["FR"] == (None, None) and got["IT"][1] == "the answer is no JSON"
    prompts = providers.batched_prompts(spark.range(101).repartition(7).withColumn("t", F.lit("x")), "id", ("t",), 10).orderBy("batch").collect()
    assert [[int(x.split("\n")[0][4:]) for x in p.prompt.split("\n---\n")] for p in prompts] == [list(range(i, min(i + 10, 101))) for i in range(0, 101, 10)]


def test_pipeline_from_store_to_records(spark):
    r = random.Random(6)
    ws = ["patients", "placebo", "survival", "versus", "dose", "cost", "Sorafenib", "alpha", "beta"]
    rows = [(i, r.choice(["DE", "FR"]), "hta_submission", r.choice(["Population", "Other"]), f"Text {i}. " + " ".join(r.choices(ws, k=30))) for i in range(60)]
    store = providers.embed(spark.createDataFrame(rows, "chunk_id long, country string, source_type string, heading string, text string"))
    found = scenarios.retrieve(store, "patients on placebo", "hta_submission", R.submission_population(), 20, 5)
    counts = {x.country: x["count"] for x in found.groupBy("country").count().collect()}
    assert set(counts) == {"DE", "FR"} and max(counts.values()) <= 5
    ctx = scenarios.contexts(found, "i", 100).collect()
    assert {c.country for c in ctx} == {"DE", "FR"} and all(c.context for c in ctx)
    records = spark.createDataFrame([("p ", "i", "", "DE", "a"), ("p", "i", "", "FR", "b")], "Population string, Intervention string, Comparator string, country string, source_type string")
    (row,) = scenarios.consolidate(records).collect()
    assert (row.Countries, row.occurrence_count) == (["DE", "FR"], 2)
    base = scenarios.SCENARIOS["base"]
    assert [scenarios.needs(scenarios.SCENARIOS[s], base) for s in ("base_b", "sim1", "sim3", "sim5")] == [
        {"vectorstore": a, "retrieval": b, "extraction": c} for a, b, c in ((False, False, False), (False, False, True), (False, True, True), (True, True, True))
    ]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("DE", 1, "t", "d", "h", "s")], "country string, place int, text string, doc_id string, heading string, source_type string")
    sinks.write_retrieval(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().chunk_count == 1
    sinks.write_records(rows, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).first().total == 1
    sinks.write_report(rows.agg(F.count("*").alias("rows")), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first().value == "rows: 1"
    assert spark.range(1).select(sinks.result_name("NSCLC 1L", "picos", "test", "x").alias("n")).first().n == "nsclc_1l_picos_test_x"
