"""Registered queries against DuckDB, and the pipeline against its stages' brute-force forms."""

import collections
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tabforge.llm.oracle import queries_sql
from tests.llm.data import documents, near_groups, prose

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        if name != "packing":
            assert after.columns == docs.columns
        kept[name] = after.collect()
        docs = spark.createDataFrame(kept[name], after.schema) if name != "packing" else docs
    whole = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first = {r["doc_id"]: r["text"] for r in kept["language"]}
    assert set(first) == {i for i, t in whole.items() if t and any(map(str.isalpha, t))}  # all are of a language
    last = collections.defaultdict(int)
    for i, t in first.items():
        last[t] = max(last[t], i)
    exact = {i: t for i, t in first.items() if last[t] == i}
    assert {r["doc_id"]: r["text"] for r in kept["exact_copies"]} == exact
    groups = near_groups(list(exact.items()))
    near = {i for i in exact if groups[i] == i}
    assert {r["doc_id"] for r in kept["near_copies"]} == near == {r["doc_id"] for r in kept["secrets"]}
    for r in kept["secrets"]:
        assert r["n_chars"] == len(r["text"]) and ("[secret]" in r["text"] or r["text"] == exact[r["doc_id"]])
    assert {r["doc_id"] for r in kept["packing"]} == near
    got = corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()
    assert sorted(got) == sorted(r[:5] for r in kept["packing"])


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == []


def test_stages_with_odd_rows_and_clashing_names(spark):
    """NULL ids, repeated rows, NULL and empty texts, and columns named like the operators' own."""
    words = " ".join(prose(1, 200))
    texts = [words, words, words + " end", "token=abcdefghijklmnop " + " ".join(prose(2, 60)), None, "", "12 34", words, words]
    ids = [1, 2, 3, 4, 5, 6, 7, None, 2]
    clash = ("score", "lang_pred", "held_out", "keep_id", "text_sha256", "n_live", "spans", "sequence_id", "offset", "__n", "group_size", "n_shingles")
    docs = documents(spark, texts, ids)
    for c in clash:
        docs = docs.withColumn(c, F.lit("clash"))
    want = {"language": [1, 2, 2, 3, 4, None], "exact_copies": None, "near_copies": None}
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name == "packing":
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
            break
        assert out.columns == docs.columns and len(rows) <= before
        if want.get(name):
            assert sorted((r["doc_id"] for r in rows), key=repr) == sorted(want[name], key=repr)
        assert all(r[c] == "clash" for r in rows for c in clash)
        docs, before = spark.createDataFrame(rows, out.schema), len(rows)
    texts = [r["text"] for r in docs.collect()]
    assert any("[secret]" in t for t in texts) and sum(t.startswith(words) for t in texts) <= 2  # the row without an id stays, and one group


@pytest.mark.parametrize("n", [50, 600])
def test_languages_of_many_signs_stay_at_any_size(spark, n):
    rnd = random.Random(1)
    signs, odds = [chr(0x4E00 + k) for k in range(3000)], [1 / (k + 1) for k in range(3000)]
    zh = ["".join(rnd.choices(signs, odds, k=300)) for _ in range(n)] + ["".join(rnd.choices(signs, odds, k=4)) for _ in range(n // 10)]
    en, none = ["the house and the sea " * 5] * 100, ["12 + 34", "", None]
    docs = documents(spark, en + none).unionByName(documents(spark, zh, range(1000, 1000 + len(zh)), "zh"))
    docs = docs.unionByName(documents(spark, ["жщфъ ыэюя"], [9999], None))  # of no learnt language
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()}
    assert kept == {*range(100), *range(1000, 1000 + len(zh))}
