"""What plans move and read: the same results from fewer rows."""

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import collection, retrieval
from lexigrid.operators import index as ix_
from lexigrid.plans.queries import QUERIES


def moved(df):
    """The keys by which a plan's rows move."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [x for x in plan.split("\n") if x.startswith("Arguments: hashpartitioning(")]


@pytest.fixture(scope="module")
def ix(spark):
    docs = [(i, f"d{i}", [t for t in "abcdefgh" if i % (ord(t) - 95) == 0] + ["a"] * (i % 3)) for i in range(60)]
    return ix_.build_index(spark.createDataFrame(docs, "doc_id long, title string, terms array<string>"))


@pytest.fixture
def no_auto(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([(k, p, t) for k in range(3) for p, t in enumerate("abd"[k:] + "ag")], "qid long, pos int, term string")


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_whole_index_is_scored_in_place(ix, no_auto, monkeypatch):
    """statistics of the most frequent terms go to the postings; what is left joins by term."""
    ix._cut = None
    scored = ix.scored("bm25")
    assert not moved(scored)
    want = rows(scored)
    for wide in (0, 3):
        monkeypatch.setattr(ix_, "WIDE", wide)
        ix._cut = None
        assert rows(ix.scored("bm25")) == want and moved(ix.scored("bm25"))
    ix._cut = None


def test_moments_of_a_collection_are_its_shards(spark, ix, log):
    """postings are scored and read once for the shards and the whole; documents without a shard count in the whole."""
    shards = spark.createDataFrame([(i, i % 3) for i in range(60) if i % 7], "doc_id long, shard_id int")
    got = collection.taily_shard_moments(ix, shards, log)
    assert any("shard-moments" in x for x in got.inputFiles()) and not any("/postings-" in x for x in got.inputFiles())
    scored = ix.scored_hits("ql", log)
    plain = retrieval.bag(log).join(scored.groupBy("term").agg(F.avg("score").alias("mean"), F.var_pop("score").alias("var")), "term")
    plain = plain.groupBy("qid").agg(F.sum(F.col("weight") * F.col("mean")).alias("mean"), F.sum(F.col("weight") * F.col("weight") * F.col("var")).alias("var"))
    assert rows(got.where("shard_id = -1").select("qid", "mean", "var")) == rows(plain.select("qid", "mean", "var"))


def test_shards_answer_without_moving_pairs(spark, ix, log):
    """each shard's sums are made where its documents are; only candidates' postings are scored again."""
    shards = spark.createDataFrame([(i, i % 3) for i in range(60)], "doc_id long, shard_id int")
    found = collection.shard_results(ix, shards, log, 4)
    assert moved(found) and not any("qid" in x and "doc_id" in x for x in moved(found))
    hits = retrieval.bag(log).join(collection.shard_scored(ix, shards, log), "term")
    plain = retrieval.top_k(hits.groupBy("qid", "shard_id", "doc_id").agg(F.sum(F.col("weight") * F.col("score")).alias("score")), 4, by=("qid", "shard_id"))
    assert rows(found) == rows(plain)
    again = retrieval.rescore(ix, found, log)
    assert any("/candidates-" in x for x in again.inputFiles())
    every = retrieval.accumulate(log, ix.scored_hits("bm25", log)).join(found.select("qid", "doc_id").distinct(), ["qid", "doc_id"])
    assert rows(again) == rows(every.select("qid", "doc_id", "score"))


def test_postings_take_their_ranks_before_queries_meet_them(spark):
    """F22"""
    df = QUERIES["taat_mapped"](spark, "/root/testdata/sf0.001")
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert "MapInArrow" in plan and "Join" not in plan[: plan.index("MapInArrow")]
