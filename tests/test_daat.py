"""Scores document by document against plain joins, and what such a plan moves."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.operators import daat, evaluation, retrieval
from lexigrid.operators import index as ix_


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(5)
    scored = [(f"t{t:02d}", d, r.choice([0.0, 1e-6, 2e-6, 3e-6, -0.25, r.random(), round(r.random(), 1)])) for t in range(30) for d in r.sample(range(-50, 20_000, 7), 60)]
    q = [(k * 3, p, t) for k in range(12) for p, t in enumerate(f"t{r.randrange(32):02d}" for _ in range(9))]
    return spark.createDataFrame(scored, "term string, doc_id long, score double"), spark.createDataFrame(q, "qid long, pos int, term string")


def got(df):
    return sorted((r.qid, r.doc_id, round(r.score, 6)) for r in df.collect())


def joined(monkeypatch, f):
    with monkeypatch.context() as m:
        m.setattr(daat, "SMALL_BAG", 0)
        return f()


def moved(df):
    """The keys by which a plan's rows move."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [x for x in plan.split("\n") if x.startswith("Arguments: hashpartitioning(")]


def test_rounds_as_spark(spark):
    r = random.Random(1)
    x = [r.uniform(-50, 50) for _ in range(2000)] + [r.randrange(-(10**7), 10**7) / 2e6 for _ in range(2000)] + [5e-7, -5e-7, 1.0000005, 1.0000015, 2.5e-6, 0.0, 1e12 + 0.1, 3.0]
    want = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6).alias("y")).collect()]
    assert daat.half_up(np.array(x), 6).tolist() == want


@pytest.mark.parametrize("hits, cells", [(1 << 21, 1 << 22), (7, 30), (1, 1)])
def test_sums_as_joined(spark, data, monkeypatch, hits, cells):
    scored, q = data
    # workers import the module anew, so sizes are set where the pieces are cut
    log = daat.Log.of(retrieval.bag(q))
    rows = daat.placed(log.numbered(scored, "score")).coalesce(1).toArrow().to_batches(max_chunksize=17)
    monkeypatch.setattr(daat, "_HITS", hits)
    monkeypatch.setattr(daat, "_CELLS", cells)
    sums = {}
    for a in daat._pieces(iter(rows), log, "doc"):
        for query, place, s in zip(*daat._sums(a, log)):
            key = log.qids[query], int(a["doc"][a["begin"]][place])
            assert key not in sums
            sums[key] = round(float(s), 6)
    assert sums == pytest.approx({(a, b): s for a, b, s in joined(monkeypatch, lambda: got(retrieval.accumulate(q, scored)))}, abs=2e-6)
    assert len(sums) == retrieval.accumulate(q, scored).count()


def test_best_as_joined(spark, data, monkeypatch):
    scored, q = data
    for k in (1, 4, 1000):
        assert got(retrieval.best(q, scored, k)) == joined(monkeypatch, lambda: got(retrieval.best(q, scored, k)))  # noqa: B023


def test_prefixes_hold_their_best(spark, data):
    """Every top-k of a prefix of the order is among the rows."""
    scored, q = data
    order = scored.select("doc_id").distinct().withColumn("rank", F.pmod(F.col("doc_id") * 7919, F.lit(20011)))
    log = daat.Log.of(retrieval.bag(q))
    few = {(a, b) for a, b, _ in got(daat.prefix_best(log, scored, "score", order, 3))}
    rank = {r.doc_id: r["rank"] for r in order.collect()}
    every = [(a, b, s) for a, b, s in got(retrieval.accumulate(q, scored)) if s]
    for cut in range(0, 20011, 500):
        for qid in {a for a, _, _ in every}:
            best = sorted((-s, b) for a, b, s in every if a == qid and rank[b] <= cut)[:3]
            assert {(qid, b) for _, b in best} <= few
    assert len(few) < len(every)


def test_early_termination_of_prefixes(spark, data):
    """the few rows of prefix_best() give the checkpoints of all."""
    scored, q = data
    order = scored.select("doc_id").distinct().withColumn("rank", F.row_number().over(Window.orderBy(F.hash("doc_id"), "doc_id")) - 1)
    judged = order.select("doc_id", F.pmod("doc_id", F.lit(3)).alias("relevance"))
    some, every = retrieval.prefix_best(q, scored, order, 4), retrieval.accumulate(q, scored)
    of = lambda df: sorted(tuple(r) for r in evaluation.early_termination(df, order, judged, 4, 20).collect())
    assert of(some) == of(every) and some.count() < every.count()


@pytest.mark.parametrize("share", [0.0, 0.01, 0.3, 0.5, 1.0])
def test_score_at_a_time_as_joined(spark, data, monkeypatch, share):
    scored, q = data
    run = lambda: got(retrieval.score_at_a_time(q, scored, 5, share))
    assert run() == joined(monkeypatch, run)


def test_ties_over_spans(spark):
    """One score everywhere: the cut falls within documents of one value, and within one by term."""
    scored = spark.createDataFrame([(t, d, 1.0) for t in "abc" for d in range(0, 40_000, 13)], "term string, doc_id long, score double")
    q = spark.createDataFrame([(0, i, t) for i, t in enumerate("abc")] + [(1, 0, "b"), (1, 1, "a")], "qid long, pos int, term string")
    n = len(range(0, 40_000, 13))
    share = 0.4
    found = retrieval.score_at_a_time(q, scored, 10**6, share).collect()
    for qid, terms in ((0, 3), (1, 2)):
        take = math.ceil(n * terms * share)
        mine = sorted((r.doc_id, r.score) for r in found if r.qid == qid)
        assert sum(s for _, s in mine) == take
        assert mine == [(13 * i, float(min(terms, take - terms * i))) for i in range(-(-take // terms))]


def test_empty_logs(spark, data):
    scored, q = data
    none = q.where("qid < 0")
    assert retrieval.accumulate(none, scored).count() == retrieval.best(none, scored, 3).count() == retrieval.score_at_a_time(none, scored, 3, 0.5).count() == 0
    odd = spark.createDataFrame([(1, 0, None), (2, 0, "t01"), (2, 1, "no such term")], "qid int, pos int, term string")
    assert {r.qid for r in retrieval.accumulate(odd, scored).collect()} == {2} and retrieval.best(odd, scored, 3).schema["qid"].dataType.typeName() == "integer"


def test_no_row_moves_for_a_query(spark):
    """postings are dealt by document; pairs of query and document don't move, however many queries have a term."""
    docs = [(i, f"d{i}", ["a", "b"] if i % 2 else ["b", "c", "c"]) for i in range(6)]
    ix = ix_.build_index(spark.createDataFrame(docs, "doc_id long, title string, terms array<string>"))
    q = spark.createDataFrame([(k, 0, "b") for k in range(4)], "qid long, pos int, term string")
    scored = ix.scored_hits("bm25", q)
    for df in (retrieval.accumulate(q, scored), retrieval.search(ix, q, 2), retrieval.score_at_a_time(q, scored, 2, 0.5)):
        assert moved(df) and not any("qid" in x and "doc_id" in x for x in moved(df))
