"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and their white space runs become one blank. An item of m characters
may differ by k = m * BUDGET errors (insertions, deletions, substitutions): of its k + 1 pieces one is
then found unchanged. An automaton finds all pieces in one pass over each whole text, and Myers'
bit-parallel distance verifies the window around each hit. Items are told apart by their normal forms (the
smallest item_id stands for equal ones) and go to the tasks in blocks of about `BLOCK` items and
`BLOCK_CHARS` characters, each against all documents, so what a task or the driver holds is bounded and
the result is the same for any block size.

Items of fewer than `MIN_WORDS` words and `MIN_CHARS` characters are sought exactly, at the bounds of words;
remove() doesn't take them as evidence unless it is told to (min_words). Nulls: a null text or item is
empty, and an empty item isn't sought; null and repeated doc_ids are rows like any other, a null item_id
is reported as null where no equal item has an id; empty tables give no rows. Long texts: time grows with
the text and the hits in it. Ties: of overlapping matches of an item the nearest stays, of equals the first.
Other columns, whatever their names, are not read, and remove() returns them all.
"""

from __future__ import annotations

import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUDGET, MIN_WORDS, MIN_CHARS = 0.06, 5, 25
BLOCK, BLOCK_CHARS = 20_000, 20_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def myers(pattern: str, text: str, limit: int) -> tuple[int, int]:
    """The least edit distance of pattern to any substring of text, and the first end of such a substring; (limit + 1, -1) beyond the limit."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << max(0, m - 1)
    up, down, score, best, end = full, 0, m, *((m, 0) if m <= limit else (limit + 1, -1))
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        h_up, h_down = down | ~(xh | up) & full, up & xh
        if h_up & top:
            score += 1
        elif h_down & top:
            score -= 1
        h_up, h_down = h_up << 1 & full, h_down << 1 & full
        up, down = h_down | ~(xv | h_up) & full, h_up & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def short(item: str) -> bool:
    """Few words and few characters: texts in scripts without blanks aren't short for having one word."""
    return item.count(" ") + 1 < MIN_WORDS and len(item) < MIN_CHARS


def _inside(a: str, z: str) -> bool:
    """Whether a word may go on from character a to z (letters with case and digits)."""
    return all(c.isdigit() or c.lower() != c.upper() for c in (a, z))


class Finder:
    """All matches of a block of items in normal form, within each item's error budget."""

    def __init__(self, items: list[tuple[int | None, str]], budget: float = BUDGET):
        self.items = [(i, t, 0 if short(t) else int(len(t) * budget)) for i, t in items if t]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            cuts = [len(t) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(t[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for p, places in pieces.items():
            self.automaton.add_word(p, (len(p), places))
        if pieces:
            self.automaton.make_automaton()

    def _verify(self, text: str, n: int, at: int) -> tuple[int, int, int] | None:
        """start, end, distance of item n near `at`."""
        _, t, k = self.items[n]
        if at >= 0 and text.startswith(t, at):
            z = at + len(t)
            if short(t) and (at and _inside(text[at - 1], t[0]) or z < len(text) and _inside(t[-1], text[z])):
                return None
            return at, z, 0
        # the window of a slot of k + 1 diagonals, each with k errors either way
        slot = at // (k + 1) * (k + 1)
        lo = max(0, slot - k)
        window = text[lo : slot + len(t) + 2 * k]
        best, end = myers(t, window, k)
        if best > k:
            return None
        back, size = myers(t[::-1], window[:end][::-1], k)
        return lo + end - size, lo + end, best

    def find(self, text: str, first: bool = False) -> list[tuple[int | None, int, int, int]]:
        """(item_id, start, end, distance) in the normal form of the text, in the order of items and places; with first, one match is enough."""
        if not self.items or not text:
            return []
        text = normal(text)
        tried: set[tuple[int, int, bool]] = set()
        found: dict[int, dict[tuple[int, int], int]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for n, a in places:
                at = last + 1 - size - a
                k = self.items[n][2]
                exact = at >= 0 and text.startswith(self.items[n][1], at)
                # hits on nearly the same diagonal share a window, verified once
                slot = at if exact else at // (k + 1)
                if (n, slot, exact) in tried:
                    continue
                tried.add((n, slot, exact))
                if hit := self._verify(text, n, at):
                    s, e, d = hit
                    if first:
                        return [(self.items[n][0], s, e, d)]
                    found.setdefault(n, {})[s, e] = d
        return [(self.items[n][0], s, e, d) for n in sorted(found) for s, e, d in common.disjoint((s, e, d) for d, s, e in sorted((d, s, e) for (s, e), d in found[n].items()))]


def blocks(benchmark: DataFrame, block: int | None = None) -> tuple[DataFrame, int]:
    """The distinct items in normal form (item_id, item, block), written, and the number of blocks."""
    schema = pa.schema([("item_id", pa.int64()), ("item", pa.string())])

    def run(batches):
        for b in batches:
            yield common.batch_of(schema, [b.column("item_id"), list(map(normal, common.texts_of(b.column("text"))))])

    each = common.map_arrow(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), run, "item_id long, item string")
    items = common.written(each.where("item <> ''").groupBy("item").agg(F.min("item_id").alias("item_id")), "items")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("item")), F.lit(0))).first()
    count = max(1, -(-n // (block or BLOCK)), -(-chars // BLOCK_CHARS))
    return items.select("item_id", "item", F.pmod(F.xxhash64("item"), F.lit(count)).alias("block")), count


def sent(items: DataFrame, k: int):
    """Block k under a name of its own, as a broadcast of bounded size; the driver holds one block at a time."""
    rows = sorted(((r.item_id, r.item) for r in items.where(F.col("block") == k).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    return uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast(rows)


_finders: dict[tuple, Finder] = {}


def _finder(block, budget: float, least: int = 1) -> Finder:
    """This process's automaton for a block; one is kept."""
    name, rows = block
    key = (name, budget, least)
    if key not in _finders:
        _finders.clear()
        _finders[key] = Finder([x for x in rows.value if least <= 1 or not (short(x[1]) and x[1].count(" ") + 1 < least)], budget)
    return _finders[key]


FOUND = "doc_id long, item_id long, start long, end long, distance long"


def contamination(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block: int | None = None) -> DataFrame:
    """FOUND: each match of an item in a row of docs(doc_id, text); start and end in the text's normal form."""
    schema = pa.schema([(x.split()[0], pa.int64()) for x in FOUND.split(", ")])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items, n = blocks(benchmark, block)
    out = None
    for k in range(n):

        def run(batches, block=sent(items, k)):
            finder = _finder(block, budget)
            for b in batches:
                rows = [(d, *hit) for d, t in zip(b.column("doc_id").to_pylist(), common.texts_of(b.column("text"))) for hit in finder.find(t)]
                if rows:
                    yield common.batch_of(schema, list(zip(*rows)))

        part = common.map_arrow(docs, run, FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def remove(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block: int | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs, all columns, in which no item is found; short items of fewer than min_words words are no evidence."""
    at, schema = docs.columns.index("text"), docs.schema
    items, n = blocks(benchmark, block)
    for k in range(n):

        def run(batches, block=sent(items, k)):
            finder = _finder(block, budget, min_words)
            for b in batches:
                yield b.filter(pa.array([not finder.find(t, True) for t in common.texts_of(b.column(at))], type=pa.bool_()))

        docs = common.map_rows(docs, run, schema)
        if k + 1 < n:
            docs = common.written(docs, "decontaminated")  # so no task holds the automata of several blocks
    return docs


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
