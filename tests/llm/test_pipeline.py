"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from boxlens.llm.queries import QUERIES
from tests.llm.test_text_operators import check_shards, groups, words

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert {"pipeline", *QUERIES} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["language"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in rows.items() if any(map(str.isalpha, t or ""))}

    single = stages["near_duplicates"](spark, kept, SF)
    want = {i for i, n, c in groups(list(rows.items())) if i == c}
    assert {r["doc_id"] for r in single.collect()} == want and single.columns == docs.columns

    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i for i in want if any(" ".join(w) in " ".join(words(rows[i])) for w in items)}
    clean = stages["decontamination"](spark, single, SF)
    left = {r["doc_id"] for r in clean.collect()}
    # exact passages go; a near copy of an item may go as well
    assert left <= want - held and len(want - held - left) <= 2 and clean.columns == docs.columns

    mix = stages["mixing"](spark, clean, SF)
    reads = [(r["doc_id"], r["text"]) for r in mix.collect()]
    assert {i for i, _ in reads} == left and mix.columns == docs.columns
    check_shards(reads, stages["sharding"](spark, mix, SF).collect(), 8, max(len(t.encode()) for _, t in reads) + 1)


def test_pipeline_runs_and_empty_tables_pass(spark, tmp_path):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and out.count() > 100
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(entry.oracle_sql())))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
