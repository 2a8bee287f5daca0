"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints within `RADIUS` bits differ in at most four of six segments, so they agree on two: each
of the fifteen pairs of segments is a shared masked bit pattern, the uppermost nodes of the index.
Below it, fingerprints in order of Gray rank are grouped by eights, level on level; a node keeps the
bits that its whole group shares (mask and value), and a search drops the group once its differences
under the mask exceed the radius. A pair counts only in the first node pair that it shares.

Equal fingerprints are folded into one row first. A node with more than `BLOCK` fingerprints is dealt
to blocks that are compared pairwise in separate tasks. Only a spanning forest of links leaves a task,
so rows never grow with the number of pairs, while link counts stay exact.

Nulls: a null text is empty (fingerprint zero, linked like any other); a row with a null doc_id counts
as a document but names no component, unless all of its members are such (then null); repeated rows
each count; an empty table gives no rows. Texts of any length are read whole, in time linear in them. Ties: a
bit set in just half of the hashes is 0, and of equal fingerprints every row counts. Other columns, whatever
their names, are not read, and keep_one() returns them all.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

RADIUS = 4
SEGMENTS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
TABLES = list(combinations(range(len(SEGMENTS)), 2))
BLOCK = 20_000
FAN = 8
_MASKS = [np.uint64(((1 << w) - 1) << s) for s, w in SEGMENTS]


def fingerprint(raw: bytes, width: int = 4, seed: int = 42) -> int:
    """Bits set in over half of the XXH64 hashes of the text's word shingles; 0 without a word."""
    words = raw.lower().split()
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    text = b" ".join(words)
    if len(words) < width:
        return hash_of(text, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = len(words) - width + 1
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        hashes = np.array([hash_of(text[a:b], seed) for a, b in zip(starts[lo:hi].tolist(), (ends[lo + width - 1 : hi + width - 1] - 1).tolist())], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), for each row of docs(doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                s = b.slice(lo, 2000)
                fp = np.array([fingerprint(x) for x in common.raw_texts(s.column("text"))], dtype=np.uint64)
                yield common.batch_of(schema, [s.column("doc_id"), fp.view(np.int64)])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


def levels(fp: np.ndarray, starts: np.ndarray) -> list[tuple]:
    """From the leaves' groups up: (first child, end child, mask of shared bits, their value, last row's end), with one node for each run at the top.

    starts: where each run of rows begins; groups never cross runs.
    """
    out = []
    begin, end = starts, np.append(starts[1:], len(fp))
    ands = ors = fp
    row_end = np.arange(1, len(fp) + 1)
    while True:
        sizes = end - begin
        groups = -(-sizes // FAN)
        run = np.repeat(np.arange(len(begin)), groups)
        first = np.concatenate(([0], np.cumsum(groups)[:-1]))
        k = np.arange(len(run)) - first[run]
        lo = begin[run] + k * FAN
        hi = np.minimum(lo + FAN, end[run])
        ands, ors = np.bitwise_and.reduceat(ands, lo), np.bitwise_or.reduceat(ors, lo)
        row_end = row_end[hi - 1]
        out.append((lo, hi, ands | ~ors, ands, row_end))
        begin, end = first, first + groups
        if groups.max() == 1:
            return out


def _expand(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = hi - lo
    at = np.repeat(np.cumsum(n) - n, n)
    return np.repeat(owner, n), np.arange(int(n.sum())) - at + np.repeat(lo, n)


def close_pairs(fp: np.ndarray, starts: np.ndarray, radius: int = RADIUS, room: int = 2_000_000):
    """Pairs i < j of the same run within the radius, found down the hierarchy; yields arrays (i, j)."""
    tree = levels(fp, starts)
    sizes = np.diff(np.append(starts, len(fp)))
    run_of = np.repeat(np.arange(len(starts)), sizes)
    load = np.cumsum(sizes[run_of])
    lo = 0
    while lo < len(fp):
        hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + room, side="right")))
        q, node = np.arange(lo, hi), run_of[lo:hi]
        for first, last, mask, value, row_end in reversed(tree):
            near = (np.bitwise_count((fp[q] ^ value[node]) & mask[node]) <= radius) & (row_end[node] > q + 1)
            q, node = _expand(q[near], first[node[near]], last[node[near]])
        near = (node > q) & (np.bitwise_count(fp[q] ^ fp[node]) <= radius)
        yield q[near], node[near]
        lo = hi


def first_table(x: np.ndarray) -> np.ndarray:
    """Of differences x: the first pair of segments without any."""
    same = np.stack([(x & m) == 0 for m in _MASKS])
    out = np.full(len(x), -1)
    for t in range(len(TABLES) - 1, -1, -1):
        a, b = TABLES[t]
        out[same[a] & same[b]] = t
    return out


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; label[x] is a smaller row of x's set, or x."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        np.minimum.at(label, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


_OUT = pa.schema([("fp", pa.int64()), ("near", pa.int64()), ("root", pa.int64())])


def _links(cell: np.ndarray, table: np.ndarray, block: np.ndarray, across: np.ndarray, fp: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Link counts and a spanning forest of whole cells."""
    starts = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1))
    near, label = np.zeros(len(fp), dtype=np.int64), np.arange(len(fp))
    for i, j in close_pairs(fp, starts):
        keep = (first_table(fp[i] ^ fp[j]) == table[i]) & (~across[i] | (block[i] != block[j]))
        i, j = i[keep], j[keep]
        near += np.bincount(i, n[j], len(fp)).astype(np.int64) + np.bincount(j, n[i], len(fp)).astype(np.int64)
        merge(label, i, j)
    hit = near > 0
    return common.batch_of(_OUT, [fp[hit].view(np.int64), near[hit], fp[label[hit]].view(np.int64)])


def fingerprint_links(folded: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of folded(fp, n): fp, near (rows of other fingerprints that link), root (a linked or equal fingerprint); partial rows to be summed by fp."""
    if radius > RADIUS:
        raise ValueError(f"the index finds differences up to {RADIUS} bits")
    rank = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))

    def part(k: int):
        s, w = SEGMENTS[k]
        return F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1))

    keys = F.array(*[F.lit(t << 32).cast("long") + F.shiftleft(part(a), 11) + part(b) for t, (a, b) in enumerate(TABLES)])
    rows = folded.select("fp", "n", rank.alias("gray"), F.explode(keys).alias("key"))
    hot = rows.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("s"))
    rows = rows.join(hot, "key", "left").withColumn("s", F.coalesce("s", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
    # of s blocks, cell (i, j) with i <= j compares block i with block j
    cells = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda k: F.least("block", k) * F.col("s") + F.greatest("block", k))
    rows = rows.withColumn("cell", F.explode(cells)).withColumn("across", F.col("cell") % (F.col("s") + 1) != 0)
    rows = rows.select("key", "cell", "block", "across", "gray", "fp", "n").repartition("key", "cell").sortWithinPartitions("key", "cell", "gray")

    def run(batches):
        held: list[np.ndarray] = []

        def columns(b):
            return [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "cell", "block", "across", "fp", "n")]

        def flush(parts):
            key, cell, block, across, fp, n = (np.concatenate(c) for c in zip(*parts))
            cell_id = np.cumsum(np.concatenate(([0], (np.diff(key) != 0) | (np.diff(cell) != 0))))
            return _links(cell_id, key >> 32, block, across.astype(bool), fp.view(np.uint64), n)

        rows_held = 0
        for b in batches:
            if not b.num_rows:
                continue
            c = columns(b)
            # cells end where the key or cell changes; the last one of a batch may go on
            change = np.flatnonzero((np.diff(c[0]) != 0) | (np.diff(c[1]) != 0)) + 1
            if held and (held[-1][0][-1] != c[0][0] or held[-1][1][-1] != c[1][0]) and rows_held >= 100_000:
                yield flush(held)
                held, rows_held = [], 0
            if len(change) and rows_held + len(c[0]) >= 100_000:
                cut = int(change[-1])
                yield flush([*held, [x[:cut] for x in c]])
                c = [x[cut:] for x in c]
                held, rows_held = [], 0
            held.append(c)
            rows_held += len(c[0])
        if held:
            yield flush(held)

    return common.map_arrow(rows, run, "fp long, near long, root long")


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fp, n_near, component_id, root (a fingerprint that names the component) for each row of docs."""
    each = common.written(fingerprints(docs), "fingerprints")
    folded = each.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
    links = common.written(fingerprint_links(folded.select("fp", "n")), "links")
    near = links.groupBy("fp").agg(F.sum("near").alias("near"))
    comp = common.components(links.select(F.col("fp").alias("u"), F.col("root").alias("v")), "simhash")
    known = folded.join(near, "fp", "left").join(comp.withColumnRenamed("node", "fp"), "fp", "left")
    linked = known.where("root is not null")
    lows = linked.groupBy("root").agg(F.min("low").alias("component"))
    linked = linked.join(lows, "root").select("fp", "n", "near", "component", "root")
    alone = known.where("root is null").select("fp", "n", "near", F.col("low").alias("component"), F.col("fp").alias("root"))
    n_near = (F.col("n") - 1 + F.coalesce("near", F.lit(0))).cast("long")
    return each.join(alone.unionByName(linked), "fp").select("doc_id", "fp", n_near.alias("n_near"), F.col("component").alias("component_id"), "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, n_near, component_id for each row of docs(doc_id, text)."""
    return _grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each component: that with the smallest doc_id; rows without one stay only where all of the component are such.

    Rows whose doc_id others have too (or none) are told apart by their fingerprints, and of several such
    rows of a component the one with the least text hash stays.
    """
    found = common.written(_grouped(docs), "groups")
    # null ids count as repeated, so the joins below are by plain equality
    ident, mark = common.free_name(docs, "kept_id"), common.free_name(docs, "fingerprint")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(ident))
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias(ident)).join(repeated, ident, "left_anti")
    same = common.col("doc_id").cast("long") == F.col(ident)
    plain = docs.join(keep, same, "left_semi")
    doubtful = docs.join(repeated, same, "left_semi").unionByName(docs.where("doc_id is null"))
    at, schema = docs.columns.index("text"), StructType([*docs.schema.fields, StructField(mark, LongType())])

    def add(batches):
        for b in batches:
            fp = np.array([fingerprint(x) for x in common.raw_texts(b.column(at))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], names=schema.names)

    marked = common.map_rows(doubtful, add, schema)
    marked = marked.select(F.struct(*map(common.col, docs.columns)).alias("row"), F.col(mark).alias("fp"), F.col("doc_id").cast("long").alias("id"))
    roots = found.select("fp", "root", "component_id").distinct()
    chosen = marked.join(roots, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    chosen = chosen.groupBy("root").agg(F.min_by("row", F.xxhash64("row.text")).alias("row"))
    return plain.unionByName(chosen.select("row.*"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
