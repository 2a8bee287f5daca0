"""Evaluation of result lists."""

from __future__ import annotations

import math
from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.sources.store import ship, written


def document_hits(documents: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """doc_id, hits: how often each document is among the first k of results(qid, rank, doc_id); zeros too."""
    hits = results.where(F.col("rank") < k).groupBy("doc_id").agg(F.count("*").alias("hits"))
    return documents.select("doc_id").join(hits, "doc_id", "left").select("doc_id", F.coalesce("hits", F.lit(0)).alias("hits"))


def precision_at(results: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """qid, precision of the first k of results(qid, rank, doc_id); qrels(doc_id[, qid], relevance), unjudged is not relevant."""
    on = ["qid", "doc_id"] if "qid" in qrels.columns else ["doc_id"]
    judged = results.where(F.col("rank") < k).join(qrels, on, "left")
    return judged.groupBy("qid").agg((F.sum(F.when(F.col("relevance") > 0, 1).otherwise(0)) / F.lit(float(k))).alias("precision"))


def early_termination(scores: DataFrame, docmap: DataFrame, qrels: DataFrame, k: int, step: int, slack: float = 1e-4, span: int | None = None) -> DataFrame:
    """qid, documents, share: the shortest prefix of the static order, in steps of `step`, whose top-k is as precise as the whole's.

    scores(qid, doc_id, score) of all hits, or at least those of retrieval.prefix_best(); docmap(doc_id, rank) over all documents. Checkpoints are scanned once, in blocks of
    `span` steps (about four times the root of all) that begin with the top-k of the blocks before; only checkpoints at which
    a query's top-k changes have a row.
    """
    n = docmap.agg(F.count("*").alias("n"))
    if span is None:
        span = max(1, 4 * math.isqrt(-(-n.first().n // step)))
    hits = scores.where("score <> 0").join(docmap, "doc_id").select("qid", "doc_id", F.round("score", 6).alias("score"), F.floor(F.col("rank") / step).alias("at"))
    # a prefix's top-k lies within the top-k of its steps
    best = F.row_number().over(Window.partitionBy("qid", "at").orderBy(F.desc("score"), "doc_id"))
    hits = hits.withColumn("r", best).where(F.col("r") <= k).drop("r")
    hits = hits.join(qrels.select("doc_id", "relevance"), "doc_id", "left").select("qid", "doc_id", "score", "at", F.when(F.col("relevance") > 0, 1).otherwise(0).alias("rel"), F.floor(F.col("at") / span).alias("block"))
    hits = written(hits, "checkpoints")
    best = F.row_number().over(Window.partitionBy("qid", "block").orderBy(F.desc("score"), "doc_id"))
    tops = hits.withColumn("r", best).where(F.col("r") <= k).drop("r")
    ship(scores.sparkSession)
    kinds = "qid long, block long, at long, doc_id long, score double, rel int"

    def in_order(pdf: pd.DataFrame, first: str):
        """(first column, at, rel, (-score, doc_id)) of the rows, each step's best before its others."""
        c = {n: pdf[n].to_numpy() for n in (first, "at", "doc_id", "score", "rel")}
        o = np.lexsort((c["doc_id"], -c["score"], c["at"]))
        return zip(c[first][o].tolist(), c["at"][o].tolist(), c["rel"][o].tolist(), zip((-c["score"][o]).tolist(), c["doc_id"][o].tolist()))

    def entered(top: list, row: tuple) -> bool:
        """Whether the row (key, ...) is among the k best; top is sorted."""
        if len(top) == k and row >= top[-1]:
            return False
        insort(top, row)
        del top[k:]
        return True

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        """The top-k of the blocks before each block but the first; k rows a block."""
        top, out, last = [], [], None
        for block, at, rel, key in in_order(pdf, "block"):
            if block != last:
                out.extend((block, *x) for x in top)
                last = block
            entered(top, (key, at, rel))
        rows = [(block, at, key[1], -key[0], rel) for block, key, at, rel in out]
        return pd.DataFrame(rows, columns=["block", "at", "doc_id", "score", "rel"]).assign(qid=pdf["qid"].iloc[0])[["qid", "block", "at", "doc_id", "score", "rel"]]

    starts = tops.groupBy("qid").applyInPandas(before, kinds).withColumn("at", F.lit(-1).cast("long"))

    def changes(pdf: pd.DataFrame) -> pd.DataFrame:
        """qid, point, p at the block's checkpoints whose top-k isn't that of the one before."""
        top, out = [], []
        for _, at, rel, key in in_order(pdf, "block"):
            if entered(top, (key, rel)) and at >= 0:
                if out and out[-1][0] == at:
                    out.pop()
                out.append((at, sum(x[1] for x in top) / float(k)))
        return pd.DataFrame(out, columns=["point", "p"]).assign(qid=pdf["qid"].iloc[0])[["qid", "point", "p"]]

    precision = hits.select("qid", "block", "at", "doc_id", "score", "rel").unionByName(starts).groupBy("qid", "block").applyInPandas(changes, "qid long, point long, p double")
    final = precision.groupBy("qid").agg(F.max_by("p", "point").alias("final"))
    first = precision.join(final, "qid").where(F.col("p") >= F.col("final") - slack).groupBy("qid").agg(F.min("point").alias("point")).crossJoin(F.broadcast(n))
    documents = F.least((F.col("point") + 1) * step, F.col("n"))
    return first.select("qid", documents.cast("long").alias("documents"), (documents / F.col("n")).alias("share"))
