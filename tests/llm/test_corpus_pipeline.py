"""Each stage on its own input against a brute-force version, and the whole run."""

import pytest

import corpus_pipeline as P
from sievewright.llm import decontamination, probminhash, secret_scan

from .test_llm_operators import SF, brute_classes, check_packing

COLUMNS = list(P.COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_are_named_in_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]


def test_toxic_documents_go_and_clean_ones_stay(spark, docs):
    kept = P.drop_toxic(spark, docs, SF)
    assert kept.columns == COLUMNS
    ids = {r.doc_id for r in kept.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    toxic, clean = ([r.doc_id for r in labels if r.toxic == y] for y in (1, 0))
    assert sum(i in ids for i in clean) >= 0.9 * len(clean) and sum(i in ids for i in toxic) <= 0.5 * len(toxic)


def test_one_document_of_each_class_stays(spark, docs):
    kept = P.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == COLUMNS
    classes = brute_classes({r.doc_id: r.text for r in docs.collect()}, probminhash.SIMILARITY)
    assert {r.doc_id for r in kept.collect()} == {d for d, c in classes.items() if d == c}


def test_contaminated_documents_go(spark, docs):
    kept = P.drop_contaminated(spark, docs, SF)
    assert kept.columns == COLUMNS
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    clean = {r.doc_id for r in docs.collect() if not decontamination.brute_force(r.text, items)[1]}
    assert {r.doc_id for r in kept.collect()} == clean


def test_secrets_are_masked(spark, docs):
    masked = P.mask_secrets(spark, docs, SF)
    assert masked.dtypes == docs.select(*COLUMNS).dtypes
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in masked.collect():
        assert not secret_scan.base_spans(r.text) and r.n_chars == len(r.text)
        if not secret_scan.base_spans(before[r.doc_id]) and "[SECRET]" not in r.text:
            assert r.text == before[r.doc_id]


def test_run_packs_what_the_stages_keep(spark, docs):
    rows = P.run(spark, SF).collect()
    left = P.drop_contaminated(spark, P.drop_near_duplicates(spark, P.drop_toxic(spark, docs, SF), SF), SF)
    left = P.mask_secrets(spark, left, SF)
    check_packing(left.collect(), rows)
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
