"""Queries without SQL run over all rows of their tables."""

from __future__ import annotations

from prefforge.operators import evaluate as ev
from prefforge.plans import catalog
from tests.oracle import SMALL


def test_report_of_all_documents(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    got = {r["place"]: r["block"] for r in catalog.queries()["snk_layer3_md"](spark, SMALL).collect()}
    assert sorted(got) == [-1000, *range(-100, -100 + len(ev.FLAGS)), *range(n)]
    assert all(got[i].startswith(f"## Example {i + 1}\n") for i in range(n))
