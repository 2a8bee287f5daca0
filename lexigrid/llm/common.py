"""Shared pieces of the training-data operators: shared folder, written tables, Arrow helpers, components."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexigrid.sources.store import shared_dir, ship

#: A word of the contracts: a run of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexigrid_path = path  # for drop_written
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table of written() once no plan reads it any more."""
    spark, path = df.sparkSession, getattr(df, "_lexigrid_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def col(name: str) -> Column:
    """A column by its whole name, whatever marks that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """name, with marks put after it until df has no such column (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """map_arrow() over whole rows, whatever their columns are called: fn takes columns by their places."""
    names = schema.names

    def run(batches):
        for b in fn(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=names)

    return map_arrow(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), run, schema)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def disjoint(spans: Iterable[tuple]) -> list[tuple]:
    """Of (start, end, ...) in order of preference those that overlap no earlier one, in order of place."""
    kept: list[tuple] = []
    for x in spans:
        i = bisect_left(kept, x)
        if (i == 0 or kept[i - 1][1] <= x[0]) and (i == len(kept) or kept[i][0] >= x[1]):
            kept.insert(i, x)
    return kept


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges(u, v): node, root = smallest node that can be reached.

    Alternating large-star and small-star rounds, each an aggregation (with map-side combine) and a
    join, written to the shared folder, until the edge set is a set of stars. Rows never multiply:
    each round maps every edge to one edge. Nulls, self-loops and repeated edges are dropped.
    """
    spark = edges.sparkSession
    cur = written(
        edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges"
    )
    while True:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small-star over edges that point down (u > v)
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(joined.select("u", F.col("m").alias("v")))
            .distinct()
        )
        nxt = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges")
        # stars: no root is also a leaf, each leaf has one root
        bad = nxt.join(nxt.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        many = nxt.groupBy("u").count().where("count > 1").limit(1).count() if not bad else 1
        drop_written(cur)
        cur = nxt
        if not bad and not many:
            break
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
