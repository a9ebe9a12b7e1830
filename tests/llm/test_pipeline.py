"""The stages of the corpus pipeline, each against a plain version on its own input."""

from __future__ import annotations

import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from prefforge.functions.tables import shared_table
from prefforge.llm.bpe import read_ranks
from tests.llm.data import documents, frame
from tests.llm.test_dedup import UPPER
from tests.llm.test_models import plain_targets
from tests.llm.test_near_copies import plain_groups

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, made = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        made[name] = (docs, stage(spark, docs, FOLDER).persist())
        docs = made[name][1]
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    before, after = made["quality classifier"]
    bad = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 0").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 1").collect()}
    kept = {r["doc_id"] for r in after.collect()}
    ids = {r["doc_id"] for r in before.collect()}
    assert len(kept & good) >= 0.9 * len(good & ids) and len(kept & bad) <= 0.5 * len(bad & ids)

    before, after = made["exact dedup"]
    best: dict = {}
    for r in before.collect():
        key = r["text"].translate(UPPER)
        best[key] = max(best.get(key, -1), r["doc_id"])
    assert {r["doc_id"] for r in after.collect()} == set(best.values())

    before, after = made["SimHash near-dedup"]
    # the stage's rule is a similarity of 0.8 of five-word shingles, not op2's three bits
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    root = plain_groups([t for _, t in rows])
    assert {r["doc_id"] for r in after.collect()} == {rows[k][0] for k in set(root)}

    before, after = made["mixing sources"]
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken = {}, {}
    for r in before.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + count(r["text"])
    for r in after.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + count(r["text"])
    wanted = plain_targets(sizes)
    assert taken == {s: int(wanted[s] + 0.5) for s in sizes}

    before, after = made["byte-level BPE"]
    tik = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert sorted((r["doc_id"], len(tik.encode_ordinary(r["text"]))) for r in before.collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in after.collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_on_odd_tables(spark):
    """Nulls in every column, repeated rows and clashing names, and an empty table, go through all stages."""
    odd = [*documents(21, 50), (None, None, None, None, None), (None, None, None, None, None), (5, "five words are here now", None, None, None)]
    for rows in (odd, []):
        docs = frame(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, shared_table(stage(spark, docs, FOLDER), "odd")
            assert (docs.count() > 0) == bool(rows), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == before.columns
