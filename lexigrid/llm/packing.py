"""Packing into fixed-length sequences by cutting-stock column generation.

Each document's ids are cut every `size` ids; full pieces are sequences of their own. Of the rests,
a histogram by length (at most size - 1 bins) goes to a linear program that chooses how often to use
each pattern of rests that fills a sequence exactly. Columns are priced by a knapsack dynamic program;
patterns are rounded down, the knapsack program packs the residual (the longest rest first, filled up
exactly), and the rests of each length, ranked, are dealt to the patterns' places. What no pattern takes
is laid end to end and cut at sequence ends; the very last sequence is cut into powers of two. So no
sequence has any padding, and every id lies in exactly one piece.

Nulls: a null text is empty (its only id is the end id); a null doc_id and repeated rows are each a
document of their own; an empty table gives no rows. Long texts are cut like others, into as many pieces as
it takes. Ties: rests of one length are ranked by task and row, so which of them shares a sequence may change
with the partitioning, but not how many do. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .encode import encoder


def knapsack(values: np.ndarray, weights: np.ndarray, size: int, columns: int = 1) -> list[tuple[float, dict[int, int]]]:
    """The cheapest multisets of items (ascending weights) that weigh size exactly: one for each of `columns` last items."""
    best, choice = np.full(size + 1, np.inf), np.full(size + 1, -1)
    best[0] = 0.0
    tops = np.searchsorted(weights, np.arange(size + 1), side="right")
    for c in range(int(weights[0]) if len(weights) else size + 1, size + 1):
        k = tops[c]
        cost = best[c - weights[:k]] + values[:k]
        i = cost.argmin()
        best[c], choice[c] = cost[i], i
    if not np.isfinite(best[size]):
        return []
    k = tops[size]
    cost = best[size - weights[:k]] + values[:k]
    out = []
    for last in np.argsort(cost, kind="stable")[:columns]:
        if not np.isfinite(cost[last]):
            break
        pattern, c, i = {}, size, int(last)
        while True:
            pattern[i] = pattern.get(i, 0) + 1
            c -= int(weights[i])
            if not c:
                break
            i = int(choice[c])
        out.append((float(cost[last]), pattern))
    return out


def plan_patterns(counts: np.ndarray, size: int, gap: float = 0.02, rounds: int = 300) -> list[tuple[dict[int, int], int]]:
    """Exactly full patterns {length: copies} and how often to use each, for counts[length] rests.

    The program maximises the number of full sequences within the counts. It starts from the patterns
    of two lengths and stops when no column improves it or when a bound shows it within `gap` of the best,
    or after `rounds` pricing rounds; residual_patterns() packs what the plan leaves.
    """
    lengths = np.flatnonzero(counts)
    n = counts[lengths].astype(np.float64)
    m = len(lengths)
    if not m:
        return []
    place = {int(x): i for i, x in enumerate(lengths)}
    inverse, basis, x = np.eye(m), [None] * m, n.copy()
    cost = np.zeros(m)  # of the basic columns: 1 for a pattern, 0 for slack
    total_bound = float((n * lengths).sum() / size)

    def enter(pattern: dict[int, int]) -> None:
        nonlocal inverse
        d = np.zeros(m)
        for i, a in pattern.items():
            d += a * inverse[:, i]
        up = np.flatnonzero(d > 1e-9)
        if not len(up):
            return
        ratio = x[up] / d[up]
        r = int(up[np.argmin(ratio)])
        step = max(0.0, x[r] / d[r])
        x[:] = np.maximum(x - step * d, 0)
        x[r] = step
        row = inverse[r] / d[r]
        rows = np.flatnonzero(np.abs(d) > 1e-12)
        rows = rows[rows != r]
        inverse[rows] -= np.outer(d[rows], row)
        inverse[r] = row
        basis[r], cost[r] = pattern, 1.0

    for a in lengths:
        b = size - int(a)
        if b in place and a <= b:
            enter({place[int(a)]: 2} if a == b else {place[int(a)]: 1, place[b]: 1})
    for _ in range(rounds):
        dual = cost @ inverse
        found = float((cost * x).sum())
        if found >= (1 - gap) * total_bound:
            break
        priced = knapsack(dual, lengths, size, 64)
        # a pattern gains at most its reduced cost, in each of at most total_bound sequences
        if not priced or (1 - priced[0][0]) * total_bound <= gap * max(found, 1e-9):
            break
        for _, pattern in priced:
            if sum(a * dual[i] for i, a in pattern.items()) < 1 - 1e-7:
                enter(pattern)
                dual = cost @ inverse
    left, plan = counts.copy(), []
    for p, v in sorted(((p, v) for p, v, c in zip(basis, x, cost) if c), key=lambda t: -t[1]):
        items = {int(lengths[i]): a for i, a in p.items()}
        k = min([int(v + 1e-6), *(int(left[i]) // a for i, a in items.items())])
        if k > 0:
            plan.append((items, k))
            for i, a in items.items():
                left[i] -= a * k
    return plan


def fill(left: dict[int, int], room: int) -> dict[int, int] | None:
    """Some of the lengths left (length: copies) that add up to room exactly, long ones first; None if none do.

    A dynamic program over the sums that can be reached, as bits of one number for each length.
    """
    if not room:
        return {}
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for a in sorted((a for a, n in left.items() if n > 0 and a <= room), reverse=True):
        before, n, k = reach, min(left[a], room // a), 1
        while n:  # copies in powers of two, so any number of them can be taken
            k = min(k, n)
            reach |= reach << a * k & mask
            n, k = n - k, k * 2
        steps.append((a, before))
        if reach >> room & 1:
            break
    if not reach >> room & 1:
        return None
    out: dict[int, int] = {}
    for a, before in reversed(steps):
        while not before >> room & 1:
            out[a] = out.get(a, 0) + 1
            room -= a
    return out


def residual_patterns(counts: np.ndarray, size: int) -> list[tuple[dict[int, int], int]]:
    """Exactly full patterns for what rounding left: each of the longest rest and rests that fill it up, as often as these last.

    Every pattern uses up one of its lengths or halves it, so their number doesn't grow with the rests.
    """
    left, out = {int(k): int(counts[k]) for k in np.flatnonzero(counts)}, []
    for a in sorted(left, reverse=True):
        while left[a] > 0:
            left[a] -= 1
            got = fill(left, size - a)
            left[a] += 1
            if got is None:
                break  # no rest of this length can be completed; shorter ones still may
            items = dict(got)
            items[a] = items.get(a, 0) + 1
            k = min(left[x] // n for x, n in items.items())
            out.append((items, k))
            for x, n in items.items():
                left[x] -= n * k
    return out


def full_plan(counts: np.ndarray, size: int) -> list[tuple[dict[int, int], int]]:
    """The patterns of the linear program, rounded down, then those of its residual."""
    plan, left = plan_patterns(counts, size), counts.copy()
    for items, k in plan:
        for a, n in items.items():
            left[a] -= n * k
    return plan + residual_patterns(left, size)


def powers(total: int) -> list[int]:
    """total as a sum of powers of two, falling."""
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocab: str, end_id: int, size: int = 2048) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    end = struct.pack("<I", end_id)
    cut_schema = pa.schema(
        [("pid", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("full_at", pa.int64()), ("rest", pa.int32()), ("rank", pa.int64()), ("crcs", pa.list_(pa.int64())), ("rest_crc", pa.int64()), ("ids", pa.binary())]
    )

    def cut(batches):
        e, pid, row, full, ranks = encoder(vocab), TaskContext.get().partitionId(), 0, 0, {}
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                s = b.slice(lo, 1000)
                rows = []
                for doc_id, ids in zip(s.column("doc_id").to_pylist(), e.encode(common.texts_of(s.column("text")))):
                    ids += end
                    n = len(ids) // 4
                    whole, rest = divmod(n, size)
                    crcs = [zlib.crc32(ids[4 * size * k : 4 * size * (k + 1)]) for k in range(whole)]
                    tail = ids[4 * size * whole :]
                    rank = ranks.get(rest, 0)
                    ranks[rest] = rank + 1
                    small = np.frombuffer(tail, "<u4")
                    kept = (b"\2" + small.astype("<u2").tobytes()) if not rest or int(small.max()) < 1 << 16 else b"\4" + tail
                    rows.append((pid, row, doc_id, n, full, rest, rank, crcs, zlib.crc32(tail), kept))
                    row, full = row + 1, full + whole
                yield common.batch_of(cut_schema, list(zip(*rows)))

    cuts = common.written(common.map_arrow(docs, cut, "pid int, row long, doc_id long, doc_tokens long, full_at long, rest int, rank long, crcs array<long>, rest_crc long, ids binary"), "cuts")
    # per task and length, how many rests came before: ranks over the whole table without sorting it
    by_task = cuts.groupBy("pid", "rest").agg(F.count("*").alias("n"))
    before = Window.partitionBy("rest").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    rest_base = by_task.select("pid", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rest_base"))
    # histogram: at most `size` rows
    hist = np.zeros(size, dtype=np.int64)
    for r in by_task.groupBy("rest").agg(F.sum("n").alias("n")).collect():
        hist[r.rest] = r.n
    hist[0] = 0
    plan = full_plan(hist, size)
    fulls = cuts.groupBy("pid").agg(F.sum(F.size("crcs")).alias("fulls")).select("pid", F.coalesce(F.sum("fulls").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_base"), "fulls")
    total_full = fulls.agg(F.coalesce(F.sum("fulls"), F.lit(0))).first()[0]

    # for each length: ranks from lo on go to a pattern's places
    deals: dict[int, list[tuple[int, int, int, int]]] = {}
    used, seq = np.zeros(size, dtype=np.int64), int(total_full)
    for items, k in plan:
        at = 0
        for length, a in sorted(items.items(), reverse=True):
            deals.setdefault(length, []).append((int(used[length]), a, seq, at))
            used[length] += a * k
            at += a * length
        seq += k
    tail_seq = seq
    left_tokens = int(((hist - used) * np.arange(size)).sum())
    tables = {k: np.array(v, dtype=np.int64) for k, v in deals.items()}
    schema = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])
    light = cuts.drop("ids").join(rest_base, ["pid", "rest"]).withColumn("r", F.col("rank") + F.col("rest_base"))

    whole = (
        cuts.where(F.size("crcs") > 0)
        .select("pid", "doc_id", "doc_tokens", "full_at", F.posexplode("crcs").alias("k", "crc"))
        .join(fulls, "pid")
        .select("doc_id", (F.col("k") * size).cast("long").alias("start"), F.lit(size).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("full_base") + F.col("full_at") + F.col("k")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )
    limits = F.create_map(*[F.lit(int(x)) for k in range(size) if used[k] for x in (k, used[k])]) if plan else None
    used_of = F.coalesce(F.try_element_at(limits, F.col("rest")), F.lit(0)) if plan else F.lit(0)
    rests = light.where("rest > 0").withColumn("used", used_of)

    def deal(batches):
        for b in batches:
            col = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("rest", "r", "doc_tokens", "rest_crc")}
            ids, out_seq, out_at = b.column("doc_id"), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for length in np.unique(col["rest"]):
                t, at = tables[int(length)], np.flatnonzero(col["rest"] == length)
                j = np.searchsorted(t[:, 0], col["r"][at], side="right") - 1
                k, slot = np.divmod(col["r"][at] - t[j, 0], t[j, 1])
                out_seq[at], out_at[at] = t[j, 2] + k, t[j, 3] + slot * int(length)
            yield common.batch_of(schema, [ids, col["doc_tokens"] - col["rest"], col["rest"].astype(np.int64), col["rest_crc"], col["doc_tokens"], out_seq, out_at])

    dealt = common.map_arrow(rests.where("r < used").select("doc_id", "doc_tokens", "rest", "r", "rest_crc"), deal, PIECES)

    # what is left: end to end, in order of task and row
    left = rests.where("r >= used").select("pid", "row", "doc_id", "doc_tokens", "rest")
    sums = left.groupBy("pid").agg(F.sum("rest").alias("s"))
    sums = sums.select("pid", F.coalesce(F.sum("s").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("rest").over(Window.partitionBy("pid").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = left.join(sums, "pid").select("pid", "row", "doc_id", "doc_tokens", "rest", (F.col("base") + within).cast("long").alias("at"))
    left = left.join(cuts.select("pid", "row", "ids"), ["pid", "row"])
    last = left_tokens // size * size
    bounds = np.cumsum([0, *powers(left_tokens - last)]) + last
    last_seq = tail_seq + last // size

    def lay(batches):
        for b in batches:
            rows = []
            for doc_id, n, rest, at, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "rest", "at", "ids"))):
                ids = np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype("<u4")
                done = 0
                while done < rest:
                    p = at + done
                    if p < last:
                        s, o = divmod(p, size)
                        s, room = tail_seq + s, size - o
                    else:
                        k = int(np.searchsorted(bounds, p, side="right")) - 1
                        s, o, room = last_seq + k, p - int(bounds[k]), int(bounds[k + 1]) - p
                    k = min(room, rest - done)
                    rows.append((doc_id, n - rest + done, k, zlib.crc32(ids[done : done + k].tobytes()), n, s, o))
                    done += k
            if rows:
                yield common.batch_of(schema, list(zip(*rows)))

    laid = common.map_arrow(left.select("doc_id", "doc_tokens", "rest", "at", "ids"), lay, PIECES)
    return whole.unionByName(dealt).unionByName(laid)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .encode import vocabulary

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"), 1)
