"""The inverted index as tables, and look-ups in it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions.scoring import quantize, scorer
from lexigrid.operators.ranks import dense_ids
from lexigrid.sources.store import written


def with_size(docs: DataFrame) -> DataFrame:
    """docs(doc_id, title, terms) -> doc_id, title, size; a document without terms has size 0."""
    return docs.select("doc_id", "title", F.coalesce(F.size("terms"), F.lit(0)).alias("size"))


def build_postings(docs: DataFrame) -> DataFrame:
    """term, doc_id, tf, len: the document's size goes with its postings, so scoring needs no join for it."""
    tokens = docs.select("doc_id", F.size("terms").alias("len"), F.explode("terms").alias("term"))
    return tokens.groupBy("term", "doc_id", "len").agg(F.count("*").cast("int").alias("tf")).select("term", "doc_id", "tf", "len")


def term_statistics(postings: DataFrame) -> DataFrame:
    """term, df, cf"""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def collection_properties(sizes: DataFrame) -> DataFrame:
    """One row: documents, occurrences, avg_document_size, max_document_size (0 for an empty collection)."""
    return sizes.agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0)).cast("long").alias("occurrences"),
        F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_document_size"),
        F.coalesce(F.max("size"), F.lit(0)).cast("int").alias("max_document_size"),
    )


#: Terms up to which a query log's statistics are broadcast: some megabytes.
SMALL_LOG = 100_000
#: Terms by falling number of documents whose statistics are broadcast when the whole index is scored: some tens of megabytes.
WIDE = 200_000


def few(terms: DataFrame) -> DataFrame:
    """terms to be broadcast if they are at most SMALL_LOG."""
    return F.broadcast(terms) if terms.limit(SMALL_LOG + 1).count() <= SMALL_LOG else terms


def bucket_of(term: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def bucketed(df: DataFrame, buckets: int, name: str) -> DataFrame:
    """df(term, doc_id, ...) written by bucket of the term, sorted by term and doc_id: a list of terms reads its buckets alone."""
    df = df.withColumn("bucket", bucket_of("term", buckets))
    columns = [c for c in df.columns if c != "bucket"]
    placed = df.repartitionByRange("bucket", "term", "doc_id").sortWithinPartitions("bucket", "term", "doc_id")
    return written(placed, name, ["bucket"]).select(*columns, "bucket")


@dataclass
class Index:
    """postings(term, doc_id, tf, len), lexicon(term_id, term, df, cf), documents(doc_id, title, size), properties (one row).

    scores: quantised scores by name; stats: score statistics by function. With buckets > 0 postings and
    scores have a column `bucket`, by which their files lie apart.
    """

    postings: DataFrame
    lexicon: DataFrame
    documents: DataFrame
    properties: DataFrame
    scores: dict[str, DataFrame] = field(default_factory=dict)
    stats: dict[str, DataFrame] = field(default_factory=dict)
    buckets: int = 0
    _cut: int | None = field(default=None, init=False, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    def constants(self) -> DataFrame:
        """The collection's constants under the scorers' names; one row."""
        return self.properties.select(F.col("documents").alias("n"), F.col("occurrences").alias("c"), F.col("avg_document_size").alias("avgdl"), F.col("max_document_size").alias("maxlen"))

    def pruned(self, terms: DataFrame, table: DataFrame | None = None) -> DataFrame:
        """The postings (or scores) in the buckets of terms(term): other files aren't read. At most `buckets` rows come to the driver."""
        table = self.postings if table is None else table
        if not self.buckets:
            return table
        wanted = [r.b for r in terms.select(bucket_of("term", self.buckets).alias("b")).distinct().collect()]
        return table.where(F.col("bucket").isin(wanted)) if len(wanted) < self.buckets else table

    def hits(self, terms: DataFrame, table: DataFrame | None = None) -> DataFrame:
        """The rows of terms(term), whatever else they have; the terms are broadcast if they are few, so no posting is moved."""
        return self.pruned(terms, table).join(few(terms.select("term").distinct()), "term", "left_semi")

    def scorable(self, postings: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
        """Postings with all that a scorer reads. The one-row constants meet the lexicon, not the postings.

        Of the whole index, the WIDE most frequent terms' statistics are broadcast, so their postings stay where they
        are and no task has all of a term's; only the others' postings, few of all, are moved and joined by term.
        """
        terms = (self.lexicon if lexicon is None else lexicon).select("term", "df", "cf").crossJoin(F.broadcast(self.constants()))
        if postings is not None:
            return postings.join(terms, "term")
        often = F.col("df") > self.cut()
        frequent = F.broadcast(terms.where(often))
        if not self.cut():
            return self.postings.join(frequent, "term")
        rest = self.postings.join(F.broadcast(terms.where(often).select("term")), "term", "left_anti")
        return self.postings.join(frequent, "term").unionByName(rest.join(terms.where(~often), "term"))

    def cut(self) -> int:
        """The least number of documents that at most WIDE terms exceed; a row for each number of documents is counted."""
        if self._cut is None:
            sizes = self.lexicon.groupBy("df").agg(F.count("*").alias("terms"))
            above = F.coalesce(F.sum("terms").over(Window.orderBy(F.desc("df")).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
            over = sizes.withColumn("above", above).where(F.col("above") > WIDE).agg(F.max("df").alias("df")).first().df
            self._cut = over or 0
        return self._cut

    def scored(self, name: str = "bm25", postings: DataFrame | None = None) -> DataFrame:
        """term, doc_id, score"""
        return self.scorable(postings).select("term", "doc_id", scorer(name).alias("score"))

    def scored_hits(self, name: str, terms: DataFrame) -> DataFrame:
        """term, doc_id, score of the terms of terms(term) alone; their statistics are broadcast if they are few."""
        asked = terms.select("term").distinct()
        small = asked.count() <= SMALL_LOG
        known = self.lexicon.join(F.broadcast(asked) if small else asked, "term", "left_semi")
        if small:
            known = F.broadcast(known.select("term", "df", "cf").crossJoin(F.broadcast(self.constants())))
            return self.pruned(asked).join(known, "term").select("term", "doc_id", scorer(name).alias("score"))
        return self.scorable(self.hits(asked), known).select("term", "doc_id", scorer(name).alias("score"))

    def term(self, terms: DataFrame) -> DataFrame:
        """terms(term_id) with their terms, null for unknown ids."""
        return terms.join(self.lexicon.select("term_id", "term"), "term_id", "left").select("term_id", "term")

    def title(self, docs: DataFrame) -> DataFrame:
        """docs(doc_id) with their titles, null for unknown ids."""
        return docs.join(self.documents.select("doc_id", "title"), "doc_id", "left").select("doc_id", "title")

    def in_memory(self) -> "Index":
        """The same index with its tables kept by the executors (on disk what doesn't fit)."""
        keep = lambda df: df.persist(StorageLevel.MEMORY_AND_DISK)
        every = lambda tables: {n: keep(t) for n, t in tables.items()}
        return Index(keep(self.postings), keep(self.lexicon), keep(self.documents), keep(self.properties), every(self.scores), every(self.stats), self.buckets)

    def save(self, path: str) -> None:
        def write(df: DataFrame, name: str) -> None:
            w = df.write.option("compression", "zstd").mode("overwrite")
            (w.partitionBy("bucket") if self.buckets and "bucket" in df.columns else w).parquet(f"{path}/{name}")

        for name in ("postings", "lexicon", "documents", "properties"):
            write(getattr(self, name), name)
        for kind in ("scores", "stats"):
            for name, df in getattr(self, kind).items():
                write(df, f"{kind}/{name}")
        self.spark.createDataFrame([(self.buckets, sorted(self.scores), sorted(self.stats))], "buckets int, scores array<string>, stats array<string>").write.mode("overwrite").parquet(f"{path}/layout")

    @staticmethod
    def load(spark: SparkSession, path: str, scores: tuple[str, ...] = ()) -> "Index":
        read = {n: spark.read.parquet(f"{path}/{n}") for n in ("postings", "lexicon", "documents", "properties")}
        layout = spark.read.parquet(f"{path}/layout").first()
        if missing := sorted(set(scores) - set(layout.scores)):
            raise ValueError(f"not all of the scores {list(scores)} are in {path}: no {missing}; there are {layout.scores}")
        return Index(**read, scores={s: spark.read.parquet(f"{path}/scores/{s}") for s in scores}, stats={s: spark.read.parquet(f"{path}/stats/{s}") for s in layout.stats}, buckets=layout.buckets)


def build_index(docs: DataFrame) -> Index:
    """Index of docs(doc_id, title, terms); its tables are written to the shared folder.

    Postings lie in buckets by term (one for some millions of occurrences), within these range-partitioned by
    (term, doc_id) and sorted: a list of terms reads its buckets alone, a filter on terms prunes row groups, and
    a term that a third of all documents have spans several partitions.
    """
    documents = written(with_size(docs), "documents")
    properties = written(collection_properties(documents), "properties")
    buckets = min(4096, max(16, properties.first().occurrences >> 22))
    postings = bucketed(build_postings(docs), buckets, "postings")
    lexicon = dense_ids(term_statistics(postings), ["term"], "term_id").select("term_id", "term", "df", "cf")
    lexicon = written(lexicon.sortWithinPartitions("term"), "lexicon")
    return Index(postings, lexicon, documents, properties, buckets=buckets)


def lookup_terms(lexicon: DataFrame, terms: DataFrame) -> DataFrame:
    """terms(term) with term_id, df, cf: unknown terms get -1, 0, 0."""
    found = terms.join(lexicon.select("term", "term_id", "df", "cf"), "term", "left")
    return found.select("term", F.coalesce("term_id", F.lit(-1)).alias("term_id"), F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("cf", F.lit(0)).alias("cf"))


def lookup_titles(documents: DataFrame, titles: DataFrame) -> DataFrame:
    """titles(title) with doc_id, null where unknown."""
    return titles.join(documents.select("title", "doc_id"), "title", "left").select("title", "doc_id")


def postings_of(index: Index, terms: list[str]) -> DataFrame:
    """The terms' postings: the list reaches the Parquet scan as a filter."""
    return _of_terms(index, index.postings, terms).select("term", "doc_id", "tf")


def _of_terms(index: Index, table: DataFrame, terms: list[str]) -> DataFrame:
    if index.buckets and terms:
        table = index.pruned(index.spark.createDataFrame([(t,) for t in terms], "term string"), table)
    return table.where(F.col("term").isin(terms))


def scores_of(index: Index, name: str, terms: list[str]) -> DataFrame:
    """The terms' stored scores: term, doc_id, q."""
    return _of_terms(index, index.scores[name], terms).select("term", "doc_id", "q")


def posting_of(index: Index, asked: DataFrame, scores: str | None = None) -> DataFrame:
    """asked(term, doc_id, ...) that have a posting, with tf, or with q of stored scores."""
    table, value = (index.postings, "tf") if scores is None else (index.scores[scores], "q")
    return asked.join(index.pruned(asked, table).select("term", "doc_id", value), ["term", "doc_id"])


def query_postings(index: Index, queries: DataFrame) -> DataFrame:
    """qid, pos, term, doc_id, tf for queries(qid, pos, term): one list for each place of a query."""
    return queries.join(index.pruned(queries), "term").select("qid", "pos", "term", "doc_id", "tf")


def next_posting(index: Index, terms: DataFrame, low: int) -> DataFrame:
    """Of each term of terms(term): the first posting with doc_id >= low."""
    found = index.hits(terms).where(F.col("doc_id") >= low)
    first = found.groupBy("term").agg(F.min(F.struct("doc_id", "tf")).alias("p"))
    return first.select("term", "p.doc_id", "p.tf")


def id_range(lexicon: DataFrame, low: float, high: float) -> DataFrame:
    """Terms whose id lies in the share [low, high) of all ids, bounds truncated: count, sum of df and of cf."""
    n = lexicon.agg(F.count("*").alias("n"))
    picked = lexicon.crossJoin(F.broadcast(n)).where((F.col("term_id") >= (F.col("n") * low).cast("long")) & (F.col("term_id") < (F.col("n") * high).cast("long")))
    return picked.agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).cast("long").alias("df"), F.coalesce(F.sum("cf"), F.lit(0)).cast("long").alias("cf"))


def seek_le(lexicon: DataFrame, keys: DataFrame, prefix: int = 2) -> DataFrame:
    """keys(key) with the greatest lexicon term <= key (null if there's none).

    An as-of join: keys and terms that share a prefix are read in order together; where a prefix has no
    such term, the last term of the prefixes before it is taken from a table of one row a prefix.
    """
    cut = lambda c: F.substring(c, 1, prefix)
    asked = keys.select("key").distinct().select(cut("key").alias("p"), F.col("key").alias("x"), F.lit(1).alias("ask"))
    both = lexicon.select(cut("term").alias("p"), F.col("term").alias("x"), F.lit(0).alias("ask")).unionByName(asked)
    within = F.max(F.when(F.col("ask") == 0, F.col("x"))).over(Window.partitionBy("p").orderBy("x", "ask").rowsBetween(Window.unboundedPreceding, 0))
    here = both.withColumn("t", within).where("ask = 1").select("p", F.col("x").alias("key"), "t")
    tops = lexicon.groupBy(cut("term").alias("p")).agg(F.max("term").alias("top"))
    marks = tops.select("p", "top", F.lit(0).alias("ask")).unionByName(asked.select("p").distinct().select("p", F.lit(None).cast("string").alias("top"), F.lit(1).alias("ask")))
    earlier = marks.withColumn("before", F.max("top").over(Window.orderBy("p", F.desc("ask")).rowsBetween(Window.unboundedPreceding, -1)))
    return here.join(earlier.where("ask = 1").select("p", "before"), "p", "left").select("key", F.coalesce("t", "before").alias("term"))


def score_stats(scored: DataFrame) -> DataFrame:
    """term, max, mean, var (of the population) as 32-bit floats."""
    return scored.groupBy("term").agg(F.max("score").cast("float").alias("max"), F.avg("score").cast("float").alias("mean"), F.var_pop("score").cast("float").alias("var"))


def score_range(scored: DataFrame) -> DataFrame:
    """One row: least and greatest score, both taken to include 0."""
    return scored.agg(F.least(F.coalesce(F.min("score"), F.lit(0.0)), F.lit(0.0)).alias("min"), F.greatest(F.coalesce(F.max("score"), F.lit(0.0)), F.lit(0.0)).alias("max"))


def quantized(scored: DataFrame, bits: int) -> DataFrame:
    """term, doc_id, q: scores, which count to 6 places, as integers of `bits` bits, from 1."""
    scored = scored.withColumn("score", F.round("score", 6))
    ends = score_range(scored)
    q: Column = quantize(F.col("score"), F.col("min"), F.col("max"), 1, (1 << bits) - 1)
    return scored.crossJoin(F.broadcast(ends)).select("term", "doc_id", q.alias("q"))


def add_quantized(index: Index, function: str, bits: int) -> str:
    """Quantised scores of a function as `<function>-<bits>` among the index's scores, written; their name."""
    name = f"{function}-{bits}"
    q = quantized(index.scored(function), bits)
    index.scores[name] = bucketed(q, index.buckets, f"scores-{name}") if index.buckets else written(q.sortWithinPartitions("term", "doc_id"), f"scores-{name}")
    return name


def add_stats(index: Index, function: str, depth: int = 10) -> None:
    """A function's score statistics among the index's, written: term, max, mean, var, df and top, the term's `depth` greatest scores, falling."""
    scored = index.scored(function)
    best = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score")))
    top = scored.withColumn("r", best).where(F.col("r") <= depth).groupBy("term").agg(F.reverse(F.array_sort(F.collect_list("score"))).alias("top"))
    stats = score_stats(scored).join(top, "term").join(index.lexicon.select("term", "df"), "term")
    index.stats[function] = written(stats.select("term", "max", "mean", "var", "df", "top"), f"stats-{function}")


def max_scores(scores: DataFrame) -> DataFrame:
    """term, max_q: of each term the greatest quantised score."""
    return scores.groupBy("term").agg(F.max("q").alias("max_q"))
