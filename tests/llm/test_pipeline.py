"""The pipeline's run() against brute force, over the smallest test tables."""

import os
from collections import Counter

import pytest
import tiktoken

from graphloom.llm import bpe, stages
from test_operators import passages_by_force

SF = "/root/testdata/sf0.001"


def holds(text, items):
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    w = text.lower().split()
    mine = set(bag(w))
    for x in items:
        x = x.lower().split()
        his = bag(x)
        if len(mine & set(his)) < 0.75 * len(his) or not his:
            continue
        for s in range(1 - len(x), len(w)):
            part = bag(w[max(s, 0) : s + len(x)])
            if (his & part).total() >= 0.75 * (his | part).total():
                return True
    return False


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (stages.quality, stages.near):
        docs = stage(spark, docs, SF)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    path, pattern = bpe.default_vocabulary()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ByteBPE(path, pattern).rank, special_tokens={})
    cut = passages_by_force(rows)
    lined = {d: cut[k][0] for k, (d, _) in enumerate(rows)}
    want = {d: len(known.encode_ordinary(t)) for d, t in lined.items() if not holds(t, items)}
    out = stages.run(spark, SF)
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == want
    assert 0 < len(want) < len(lined) and lined != dict(rows)


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """The smallest tables, their documents with columns whose names the stages could use themselves."""
    from pyspark.sql import functions as F

    folder = f"file://{tmp_path_factory.mktemp('odd')}"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    more = {c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in ("__gone", "__leak", "__kept", "__Rule", "__stats")}
    spark.read.parquet(f"{SF}/documents.parquet").withColumns(more).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_keep_columns_of_clashing_names(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    names = docs.columns
    for _, stage in stages.STAGES[:-1]:
        docs = stage(spark, docs, odd_folder)
        assert docs.columns == names
    rows = docs.collect()
    assert rows and all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in names if c.startswith("__"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_on_empty_tables(spark, tmp_path_factory):
    from graphloom.llm import queries

    folder = f"file://{tmp_path_factory.mktemp('empty')}"
    for name in ("documents", "labels", "benchmark", "pages", "conversations", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, folder).collect() == [], name
