"""Ranked retrieval: whole query logs in one plan."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions.analysis import stem_column
from lexigrid.operators import daat
from lexigrid.operators.index import SMALL_LOG, Index
from lexigrid.sources.store import ship, written


def bag(queries: DataFrame) -> DataFrame:
    """queries(qid, pos, term[, weight]) -> qid, term, weight: a term counts as often as it stands in the query."""
    weight = F.sum("weight") if "weight" in queries.columns else F.count("*").cast("double")
    return queries.groupBy("qid", "term").agg(weight.alias("weight"))


def accumulate(queries: DataFrame, scored: DataFrame, value: str = "score") -> DataFrame:
    """qid, doc_id, score: the sum over the query's terms of weight times value; documents without a hit have no row.

    Postings are dealt by document (daat); only for a log of over daat.SMALL_BAG rows each pair of a posting and a query is one.
    """
    weights = bag(queries)
    if (log := _small(weights, scored)) is not None:
        return daat.sums(log, scored, value)
    hits = weights.join(scored, "term")
    return hits.groupBy("qid", "doc_id").agg(F.sum(F.col("weight") * F.col(value)).alias("score"))


def _small(weights: DataFrame, scored: DataFrame) -> daat.Log | None:
    return daat.Log.of(weights) if daat.integral(scored, "doc_id") else None


def best(queries: DataFrame, scored: DataFrame, k: int, value: str = "score") -> DataFrame:
    """The top-k of accumulate(): each task gives its own k best of a query, and these alone meet."""
    log = _small(bag(queries), scored)
    return top_k(accumulate(queries, scored, value) if log is None else daat.best(log, scored, value, k), k)


def prefix_best(queries: DataFrame, scored: DataFrame, docmap: DataFrame, k: int, value: str = "score") -> DataFrame:
    """Rows of accumulate() (scores rounded), among them each that is one of its query's k best of the documents up to its rank in docmap(doc_id, rank)."""
    log = _small(bag(queries), scored)
    return accumulate(queries, scored, value) if log is None else daat.prefix_best(log, scored, value, docmap, k)


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ("qid",), places: int | None = 6) -> DataFrame:
    """The k best per query with rank from 0: score falling, then doc_id; scores of 0 never. places: digits that count in the comparison."""
    s = scores.withColumn("score", F.round("score", places)) if places is not None else scores
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
    ranked = s.where("score <> 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumn("rank", (F.col("rank") - 1).cast("long")).select(*by, "rank", "doc_id", "score")


def stemmed(queries: DataFrame) -> DataFrame:
    """queries with their terms' stems."""
    terms = queries.select("term").distinct().withColumn("stem", stem_column("term"))
    return queries.join(terms, "term").withColumn("term", F.col("stem")).drop("stem")


def search(index: Index, queries: DataFrame, k: int = 10, score: str = "bm25", stem: bool = False) -> DataFrame:
    """qid, rank, doc_id, score. A score name with a dash is a precomputed, quantised one."""
    if stem:
        queries = stemmed(queries)
    if "-" in score:
        if score not in index.scores:
            raise ValueError(f"scores {score!r} aren't loaded; there are {sorted(index.scores)}")
        return best(queries, index.hits(queries, index.scores[score]), k, "q")
    return best(queries, index.scored_hits(score, queries), k)


@dataclass
class QueryEngine:
    """Searches of one index with fixed choices: score function or stored scores, traversal, stemming.

    Traversals give the same result. Term-at-a-time and document-at-a-time are one aggregation here;
    "wand" and "maxscore" skip documents that no essential term has, by stored statistics.
    """

    index: Index
    score: str = "bm25"
    traversal: str = "daat"
    stem: bool = False
    TRAVERSALS = ("taat", "daat", "wand", "maxscore")

    def __post_init__(self):
        if self.traversal not in self.TRAVERSALS:
            raise ValueError(f"unknown traversal {self.traversal!r}; known: {self.TRAVERSALS}")
        if self.quantized and self.score not in self.index.scores:
            raise ValueError(f"scores {self.score!r} aren't loaded; there are {sorted(self.index.scores)}")

    @property
    def quantized(self) -> bool:
        return "-" in self.score

    def run(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """qid, rank, doc_id, score of queries(qid, pos, term[, weight])."""
        if self.traversal in ("wand", "maxscore") and self.score in self.index.stats:
            if self.stem:
                queries = stemmed(queries)
            return pruned_search(self.index, queries, self.index.stats[self.score], k, self.score)
        return search(self.index, queries, k, self.score, self.stem)

    def titled(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The results with the documents' titles."""
        return self.run(queries, k).join(self.index.documents.select("doc_id", "title"), "doc_id").select("qid", "rank", "doc_id", "title", "score")


def term_bounds(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """qid, term, weight, bound: the most that the term adds to a document."""
    return bag(queries).join(stats.select("term", "max"), "term").select("qid", "term", "weight", (F.col("weight") * F.col("max").cast("double")).alias("bound"))


def essential_terms(queries: DataFrame, stats: DataFrame, thresholds: DataFrame) -> DataFrame:
    """qid, term, bound, essential: in order of bounds, terms whose running sum stays under the query's threshold can't lift a document over it alone."""
    w = Window.partitionBy("qid").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    bounds = term_bounds(queries, stats).join(thresholds.select("qid", "threshold"), "qid", "left")
    reach = F.round(F.sum("bound").over(w), 6)
    return bounds.select("qid", "term", F.round("bound", 6).alias("bound"), (F.col("threshold").isNull() | (reach >= F.col("threshold"))).alias("essential"))


def pruned_search(index: Index, queries: DataFrame, stats: DataFrame, k: int, score: str = "bm25", slack: float = 1e-5) -> DataFrame:
    """The same result as search(): only documents with a term that is essential for a lower bound of the k-th score go to the top-k.

    stats: those of add_stats(), or of score_stats(), by which every term is essential. The lower bound is the greatest,
    over the query's terms, of the term's own k-th score, which the statistics hold (none if they hold fewer). One pass over the postings: whether a document has an
    essential term is summed up beside its score.
    """
    asked = stats.join(queries.select("term").distinct(), "term", "left_semi")
    kth = asked.select("term", (F.try_element_at("top", F.lit(k)) if "top" in stats.columns else F.lit(None).cast("double")).alias("kth"))
    low = bag(queries).join(kth, "term").groupBy("qid").agg(F.max(F.col("weight") * F.col("kth")).alias("threshold")).withColumn("threshold", F.col("threshold") - slack)
    needed = essential_terms(queries, asked, low).select("qid", "term", "essential")
    weights, scored = bag(queries).join(needed, ["qid", "term"]), index.scored_hits(score, queries)
    if (log := _small(weights, scored)) is not None:
        return top_k(daat.best(log, scored, "score", k), k)
    hits = weights.join(scored, "term")
    sums = hits.groupBy("qid", "doc_id").agg(F.sum(F.col("weight") * F.col("score")).alias("score"), F.max("essential").alias("essential"))
    return top_k(sums.where("essential").drop("essential"), k)


def thresholds(results: DataFrame, k: int) -> DataFrame:
    """qid, threshold of top-k results: the k-th score, null where fewer match."""
    return results.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("threshold"))


def count_above(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """qid, documents whose score reaches the query's threshold; limits(qid, threshold)."""
    limits = written(limits, "limits")  # read twice
    # rounding is dear, and moves a score by one unit at most
    s = scores.join(F.broadcast(limits), "qid").where(F.col("score") >= F.col("threshold") - 2e-6).where(F.round("score", 6) >= F.col("threshold"))
    return limits.select("qid").join(s.groupBy("qid").agg(F.count("*").alias("documents")), "qid", "left").select("qid", F.coalesce("documents", F.lit(0)).alias("documents"))


def score_at_a_time(queries: DataFrame, scored: DataFrame, k: int, share: float, places: int = 6, width: float = 1e-3) -> DataFrame:
    """Top-k from the query's best ceil(share n) postings alone (score falling, then doc_id and term).

    A histogram of scores in steps of `width` tells the step in which the query's last posting lies; those above
    are taken whole. Within it daat.best_postings() counts on; only for a large log that step's postings are ranked.
    """
    if (log := _small(bag(queries), scored)) is not None:
        return top_k(daat.best_postings(log, scored, "score", k, share, places, width), k, places=places)
    hits = bag(queries).join(scored, "term").select("qid", "term", "doc_id", F.round(F.col("weight") * F.col("score"), places).alias("score"))
    hits = hits.withColumn("bin", F.floor(F.col("score") / width))
    bins = hits.groupBy("qid", "bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("qid").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(down), F.lit(0))).withColumn("take", F.ceil(F.sum("n").over(Window.partitionBy("qid")) * share))
    marked = hits.join(bins.where("before < take").select("qid", "bin", (F.col("take") - F.col("before")).alias("room"), (F.col("before") + F.col("n") > F.col("take")).alias("last")), ["qid", "bin"])
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id", "term"))
    taken = marked.where("not last").select("qid", "doc_id", "score").unionByName(marked.where("last").withColumn("r", r).where("r <= room").select("qid", "doc_id", "score"))
    return top_k(taken.groupBy("qid", "doc_id").agg(F.sum("score").alias("score")), k, places=places)


def rescore(index: Index, candidates: DataFrame, queries: DataFrame, score: str = "bm25") -> DataFrame:
    """qid, doc_id, score of candidates(qid, doc_id), exact; postings of other documents are left out before queries meet them."""
    candidates = written(candidates.select("qid", "doc_id").distinct(), "candidates")  # read twice, and dear
    docs = candidates.select("doc_id").distinct()
    few = docs.limit(SMALL_LOG + 1).count() <= SMALL_LOG
    scored = index.scored_hits(score, queries).join(F.broadcast(docs) if few else docs, "doc_id", "left_semi")
    wanted = bag(queries).join(scored, "term").join(candidates, ["qid", "doc_id"], "left_semi")
    return wanted.groupBy("qid", "doc_id").agg(F.sum(F.col("weight") * F.col("score")).alias("score"))


# Gamma distribution, for Taily


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        for _ in range(2000):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-15:
                break
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny = 1e-300
    b, c, d = x + 1 - a, 1 / tiny, 1 / (x + 1 - a)
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def gamma_quantile(a: float, p: float) -> float:
    """x with gamma_p(a, x) = p, by bisection."""
    if p <= 0:
        return 0.0
    low, high = 0.0, max(1.0, a)
    while gamma_p(a, high) < p and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(a, mid) < p else (low, mid)
        if high - low < 1e-12 * max(1.0, high):
            break
    return (low + high) / 2


def _expected_any(dfs: list[float], n: float) -> float:
    """Documents expected to hold any of the terms, and so to score above zero."""
    none = 1.0
    for x in dfs:
        none *= 1 - min(1.0, x / n) if n else 1.0
    return n * (1 - none)


def taily_moments(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """qid, dfs, mean, var: what a query's gamma distribution is fitted to, from stats(term, df, mean, var)."""
    return bag(queries).join(stats, "term").groupBy("qid").agg(F.collect_list("df").alias("dfs"), F.sum(F.col("weight") * F.col("mean")).alias("mean"), F.sum(F.col("weight") * F.col("weight") * F.col("var")).alias("var"))


def taily_threshold(queries: DataFrame, stats: DataFrame, n_documents: int, k: int) -> DataFrame:
    """qid, estimate: the score that k documents are expected to pass, from a gamma distribution fitted to the sum of the terms' scores.

    stats(term, df, mean, var). Of the documents, sum over terms of weight * mean * df / n is the mean score.
    """
    moments = taily_moments(queries, stats)

    ship(queries.sparkSession)

    def run(batches):
        for pdf in batches:
            out = []
            for q, dfs, mean, var in pdf[["qid", "dfs", "mean", "var"]].itertuples(index=False):
                live = _expected_any(list(dfs), n_documents)
                p = min(1.0, k / live) if live > 0 else 1.0
                out.append((q, float(mean) if not var or var <= 0 else var / mean * gamma_quantile(mean * mean / var, 1 - p)))
            yield pd.DataFrame(out, columns=["qid", "estimate"])

    return moments.mapInPandas(run, "qid long, estimate double")
