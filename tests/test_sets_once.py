"""Word sets of documents are made once, whatever reads them afterwards."""

import pytest

from sievewright.operators import retrieval as R
from sievewright.plans import search

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", ["near_dup_pairs", "near_dup_members"])
def test_documents_are_read_once(spark, monkeypatch, query):
    reads, write = [], R.written

    def counted(df, name, *by, **options):
        reads.append(any("documents" in f for f in df.inputFiles()))
        return write(df, name, *by, **options)

    monkeypatch.setattr(R, "written", counted)
    found = getattr(search, query)(spark, SF)
    reads.append(any("documents" in f for f in found.inputFiles()))
    assert found.count() > 0 and sum(reads) == 1
