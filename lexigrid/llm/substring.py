"""Substring near-duplicates by compact windows.

A token is a shingle of `SHINGLE` words. For a hash function, the Cartesian tree over a text's hashed
tokens gives compact windows (l, c, r): every passage within [l, r] that holds c has its minimum at c.
Windows of at least `MIN_WORDS` words are kept; they are the tree's nodes that are the minimum of some
passage of that length, so about 2 / (MIN_WORDS - SHINGLE + 2) of a text. Windows of different documents
that have the same minimum (the signature) are grouped for each of `HASHES` functions. In a group, windows of
one context are one, linked to the smallest document's, and all distinct contexts are compared word by word in
pairs, outward from the shared token, through single changed words, to the ends of both windows' contexts. In a
group of over `KEPT` distinct contexts only pairs that can agree over MIN_WORDS words are compared: of any
AGREE + 1 words that a link runs over at most one is changed, so one half of them agrees, and pairs that agree in
no half of some such run, for each way in which MIN_WORDS words can lie around the token, are left out: runs are
keys while groups are large, and the pairs of small ones are sifted by the halves of all further runs. That
loses no pair. Groups of over `BLOCK` windows are first reduced to their distinct contexts; where these are over
`BLOCK` as well they are dealt to parts, and each two parts meet in a task. So a further document takes no link
away between two others.

Links are joined by their intervals: overlapping passages of a document become one, and a passage of two
documents is reported once per document. Result: doc_id, start_word, end_word (exclusive), class_id (the
smallest doc_id that can be reached through shared passages), n_links (signature groups' links of different
contexts, and of copies to their context's first, that verified it). Documents without a repeated passage have no row.

Nulls: a null text is empty; rows with a null doc_id aren't compared; repeated doc_ids with different
texts are one document, of which repeats within don't count; an empty table gives no rows. Long texts are cut
into windows in time n log n. Ties between equal minima go to the first place. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MIN_WORDS, SHINGLE, HASHES, REACH = 50, 6, 2, 48
#: Words that must agree after a changed word for it to be passed over.
AGREE = 5
#: Windows of a key that one task compares, and distinct contexts of a key of which all pairs are compared outright.
BLOCK, KEPT = 20_000, 32
#: Ways in which a link's missing words may lie before and after the token that are looked up one by one.
CASES = 11
#: Words on either side of a token that one number has marks for, and pairs that are compared, and sifted before that, at once.
SIDE, PAIRS, SIFTED = 64, 1 << 12, 1 << 14
#: Words of all documents of a batch whose windows are found at once.
BATCH_WORDS = 1_000_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 7)
        if len(self) > 600_000:
            self.clear()
        self[word] = h
        return h


_hashes = _Hashes()


def word_hashes(raw: bytes) -> np.ndarray:
    words = raw.lower().split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words, by doubling."""
    out, have = np.zeros(max(0, len(words) - width + 1), np.uint64), 0
    if not len(out):
        return out
    block, size, left = words, 1, width
    while left:
        if left & 1:
            out = _mix(out * np.uint64(0x100000001B3) + block[have : have + len(out)], 1)
            have += size
        left >>= 1
        if left:
            block = _mix(block[: len(block) - size] * np.uint64(0x9E3779B1) + block[size:], 2)
            size *= 2
    return out


def compact_windows(values: np.ndarray, length: int, span: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the nodes of the Cartesian tree over values whose windows hold at least `length` tokens; the first of equal values is the upper node.

    With span, bounds farther than that from c aren't sought (l and r then lie at least span away).
    """
    n = len(values)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none
    # a value's low bits give way to its place, so values differ and a minimum tells where it is
    low = np.uint64(max(1, (n - 1).bit_length()))
    shift = np.uint64(max(0, int(values.max()).bit_length() - (64 - int(low))))
    rank = ((values >> shift) << low) | np.arange(n, dtype=np.uint64)
    if length > 1:
        # the nodes sought are the minima of the passages of that length: block-wise prefix and suffix minima
        a = np.concatenate((rank, np.full(-n % length, np.iinfo(np.uint64).max))).reshape(-1, length)
        forward = np.minimum.accumulate(a, axis=1).ravel()
        backward = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(backward[: n - length + 1], forward[length - 1 : n])
        keep = np.ones(len(least), dtype=bool)
        keep[1:] = least[1:] != least[:-1]
        mine = least[keep]
        centre = (mine & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    else:
        mine, centre = rank, np.arange(n)
    # the last token to each side that isn't smaller, by doubling steps over runs' minima
    tables = [rank]
    while 2 << (len(tables) - 1) <= n and (span is None or 1 << (len(tables) - 1) < span):
        t, s = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(t[: len(t) - s], t[s:]))
    right, left = centre.copy(), centre.copy()
    for k in range(len(tables) - 1, -1, -1):
        t, s = tables[k], 1 << k
        ok = np.flatnonzero(right + s < n)
        ok = ok[t[right[ok] + 1] > mine[ok]]
        right[ok] += s
        ok = np.flatnonzero(left >= s)
        ok = ok[t[left[ok] - s] > mine[ok]]
        left[ok] -= s
    return left, centre, right


def _windows_of(words: list[np.ndarray], min_words: int, shingle: int, functions: int, reach: int):
    """For the documents of a batch: (document, function, key, l, c, r)."""
    length = min_words - shingle + 1
    for lo_hi in _batches(words):
        part = [(i, shingles(words[i], shingle)) for i in range(*lo_hi) if len(words[i]) >= min_words]
        if not part:
            continue
        sizes = np.array([len(x) for _, x in part])
        for f in range(functions):
            for i, x in part if len(part) == 1 else []:
                v = _mix(x, 10 + f)
                left, c, r = compact_windows(v, length, reach)
                yield np.full(len(c), i), f, v[c], left, c, r
            if len(part) > 1:
                # all texts in one array, a least value between them: windows never cross it
                starts = np.cumsum(sizes + 1) - sizes - 1
                joined = np.zeros(int((sizes + 1).sum()), np.uint64)
                at = np.concatenate([np.arange(s, s + k) for s, k in zip(starts, sizes)])
                v = np.maximum(_mix(np.concatenate([x for _, x in part]), 10 + f), np.uint64(1))
                joined[at] = v
                left, c, r = compact_windows(joined, length, reach)
                real = joined[c] != 0
                left, c, r = left[real], c[real], r[real]
                d = np.searchsorted(starts, c, side="right") - 1
                yield np.array([i for i, _ in part])[d], f, joined[c], left - starts[d], c - starts[d], r - starts[d]


def _batches(words: list[np.ndarray]):
    lo, total = 0, 0
    for i, w in enumerate(words):
        if total and total + len(w) > BATCH_WORDS:
            yield lo, i
            lo, total = i, 0
        total += len(w)
    if words:
        yield lo, len(words)


def windows(docs: DataFrame, min_words: int, shingle: int, functions: int, reach: int) -> DataFrame:
    """key, doc_id, l, c, r (in tokens) of all compact windows."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("l", pa.int32()), ("c", pa.int32()), ("r", pa.int32())])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                s = b.slice(lo, 1000)
                ids = s.column("doc_id").to_numpy(zero_copy_only=False)
                for d, f, key, left, c, r in _windows_of([word_hashes(x) for x in common.raw_texts(s.column("text"))], min_words, shingle, functions, reach):
                    yield common.batch_of(schema, [_mix(key, 100 + f).view(np.int64), ids[d], left.astype(np.int32), c.astype(np.int32), r.astype(np.int32)])

    return common.map_arrow(docs, run, "key long, doc_id long, l int, c int, r int")


def _contexts(repeated: DataFrame, docs: DataFrame, shingle: int, reach: int) -> DataFrame:
    """key, doc_id, c, lead (words of context before c), words (16 bits of the hashes of the words around c, within the window)."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("c", pa.int32()), ("lead", pa.int32()), ("words", pa.binary())])
    places = repeated.groupBy("doc_id").agg(F.collect_list(F.struct("key", "l", "c", "r")).alias("w"))
    joined = docs.join(places, "doc_id")

    def run(batches):
        for b in batches:
            every = b.column("w").values  # offsets of slices point into it
            key, left, centre, right = (every.field(n).to_pylist() for n in ("key", "l", "c", "r"))
            for lo in range(0, b.num_rows, 500):
                s = b.slice(lo, 500)
                offsets = s.column("w").offsets.to_pylist()
                out: tuple[list, ...] = ([], [], [], [], [])
                for d, raw, first, end in zip(s.column("doc_id").to_pylist(), common.raw_texts(s.column("text")), offsets, offsets[1:]):
                    small = (word_hashes(raw) >> np.uint64(20)).astype("<u2")
                    n, small = len(small), small.tobytes()
                    for k in range(first, end):
                        c = centre[k]
                        if c + shingle > n:
                            continue  # another text of the same doc_id has this window
                        a, z = max(left[k], c - reach), min(right[k] + shingle, c + shingle + reach)
                        out[0].append(key[k])
                        out[1].append(d)
                        out[2].append(c)
                        out[3].append(c - a)
                        out[4].append(small[2 * a : 2 * z])
                if out[0]:
                    yield common.batch_of(schema, list(out))

    return common.map_arrow(joined, run, "key long, doc_id long, c int, lead int, words binary")


def extent(a: np.ndarray, b: np.ndarray, ca: int, cb: int, shingle: int) -> tuple[int, int]:
    """Words that agree before and from the shared token on: single changed words are passed over while over AGREE agree after them."""

    def grow(x: np.ndarray, y: np.ndarray) -> int:
        n = min(len(x), len(y))
        if not n:
            return 0
        bad = [*np.flatnonzero(x[:n] != y[:n]).tolist(), n]
        good = bad[0]
        for p, q in zip(bad, bad[1:]):
            if q - p <= AGREE:
                break
            good = q
        return good

    return grow(a[:ca][::-1], b[:cb][::-1]), grow(a[ca:], b[cb:])


def _marks(bad: np.ndarray) -> np.ndarray:
    """Marks of words that differ, SIDE in a row, as bits of one number each, the nearest word's the lowest."""
    return np.packbits(bad, axis=-1, bitorder="little").view("<u8")[..., 0]


def _stop(marks: np.ndarray) -> np.ndarray:
    """extent()'s rule: the first word that differs and has another such among the AGREE after it. All words from an end on must be marked, and an end lies before SIDE - 1."""
    near = marks >> np.uint64(1)
    for k in range(2, AGREE + 1):
        near |= marks >> np.uint64(k)
    near &= marks
    return np.bitwise_count((near & (~near + np.uint64(1))) - np.uint64(1)).astype(np.int32)


class Group:
    """Contexts around one token, and the extents of a further window against each."""

    def __init__(self, reach: int, shingle: int):
        self.reach, self.width = reach, 2 * reach + shingle
        self.rows: list[tuple[int, int, int, bytes]] = []  # doc_id, c, lead, words
        self.table = np.full((KEPT, self.width), -1, dtype=np.int32)  # words around c, nothing where the context ends

    def extents(self, words: bytes, lead: int) -> tuple[np.ndarray, np.ndarray]:
        """For each context: words that agree before and from the shared token on, by the rule of extent()."""
        row = np.full(self.width, -2, dtype=np.int32)
        row[self.reach - lead : self.reach - lead + len(words) // 2] = np.frombuffer(words, "<u2")
        bad = np.ones((2, len(self.rows), SIDE), dtype=bool)
        differs = self.table[: len(self.rows)] != row
        bad[0, :, : self.reach] = differs[:, : self.reach][:, ::-1]
        bad[1, :, : self.width - self.reach] = differs[:, self.reach :]
        before, after = _stop(_marks(bad))
        return before, after


class Contexts:
    """Distinct contexts of many keys, those of a key together, and the pairs of a key that agree over min_words words.

    group: sizes of the keys' runs. mine: where given, a key's pairs are of one context that is mine and one that isn't.
    """

    def __init__(self, words: pa.Array, lead: np.ndarray, group: np.ndarray, min_words: int, shingle: int, mine: np.ndarray | None = None):
        self.min_words, self.shingle, self.group, self.mine = min_words, shingle, group, mine
        at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] // 2
        flat = np.frombuffer(words.buffers()[2], np.uint8)
        flat = flat[: len(flat) // 2 * 2].view("<u2")
        steps = np.concatenate((-1 - np.arange(SIDE), np.arange(SIDE)))
        #: words from the token outward, first those before it, then those from it on; beyond an end anything
        self.words = flat.take(np.clip((at[:-1] + lead)[:, None] + steps, 0, len(flat) - 1))
        self.ends = np.stack((lead, np.diff(at) - lead))
        self.values: dict[tuple[int, int, int], np.ndarray] = {}

    def extents(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marks of words that differ (before, after) and how far i and j agree."""
        bad = self.words.take(i, axis=0) != self.words.take(j, axis=0)
        marks = _marks(bad.reshape(len(i), 2, SIDE)).T
        marks = marks | ~np.uint64(0) << np.minimum(self.ends[:, i], self.ends[:, j]).astype(np.uint64)
        return marks, _stop(marks)

    def links(self, kept: int):
        """Batches of (i, j, words before the token, words from it on)."""
        first = np.cumsum(self.group) - self.group
        for i, j in _pairs(*_runs(first, self.group, self.group <= kept)):
            marks, (before, after) = self.extents(i, j)
            yield self._those(i, j, before, after, before + after >= self.min_words)
        rows, sizes = _runs(first, self.group, self.group > kept)
        if len(rows):
            for case in range(CASES + 1):
                yield from self._case(rows, sizes, case, kept)

    def _those(self, i, j, before, after, ok):
        if self.mine is not None:
            ok &= self.mine[i] != self.mine[j]
        ok = np.flatnonzero(ok)
        return i[ok], j[ok], before[ok], after[ok]

    def _case(self, rows: np.ndarray, sizes: np.ndarray, case: int, kept: int):
        """Links that have from case / CASES of the missing words on before the token, and fewer than the next case."""
        need = self.min_words - self.shingle
        least, beyond = need * case // CASES, need * (case + 1) // CASES if case < CASES else 1 << 30
        after = max(0, need - beyond + 1)
        # runs of AGREE + 1 words that such a link must run over, farthest from the token first: (side, first, middle, end)
        runs = [(0, a, min(a + AGREE + 1, least)) for a in range(0, least, AGREE + 1)]
        runs += [(1, a, min(a + AGREE + 1, self.shingle + after)) for a in range(self.shingle, self.shingle + after, AGREE + 1)]
        runs = [(side, a, (a + z) // 2, z) for side, a, z in sorted(runs, key=lambda x: -x[1]) if z - a > 1]
        enough = (self.ends[0, rows] >= least) & (self.ends[1, rows] >= self.shingle + after)
        group = np.repeat(np.arange(len(sizes)), sizes)[enough]
        rows = rows[enough]
        halves = [(self._value(side, lo, mid), self._value(side, mid, hi)) for side, lo, mid, hi in runs]
        choice = np.zeros(len(rows), dtype=np.int64)  # bit d: in run d the second half agrees and the first doesn't
        for depth in range(len(runs) + 1):
            # rows come by group; small groups, and all after the last run, are compared
            first, sizes = _starts(group)
            small = sizes <= kept if depth < len(runs) else sizes > 0
            at, n = _runs(first, sizes, small & (sizes > 1))
            for i, j in self._sifted(rows, choice, at, n, halves, depth):
                marks, (b, a) = self.extents(i, j)
                yield self._those(i, j, b, a, (b >= least) & (b < beyond) & (b + a >= self.min_words))
            at, n = _runs(first, sizes, ~small)
            if not len(at):
                return
            parts, r, g = [], rows[at], group[at]
            values = [x[r] for x in halves[depth]]
            for half, value in enumerate(values):
                order = np.lexsort((value, g))
                new = np.ones(len(r), dtype=bool)
                new[1:] = (g[order][1:] != g[order][:-1]) | (value[order][1:] != value[order][:-1])
                a, n = _starts(np.cumsum(new))
                go = n > 1
                if half:  # where all agree in the first half as well, that has them
                    other = values[0][order]
                    go &= np.minimum.reduceat(other, a) != np.maximum.reduceat(other, a)
                p, n = _runs(a, n, go)
                order = order[p]
                parts.append((r[order], 2 * np.repeat(np.arange(len(n)), n) + half, choice[at][order] | half << depth))
            rows, group, choice = (np.concatenate(x) for x in zip(*parts))

    def _value(self, side: int, lo: int, hi: int) -> np.ndarray:
        """Of all contexts, the words lo to hi (four at most) of a side as one number."""
        if (side, lo, hi) not in self.values:
            value = np.zeros(len(self.words), dtype=np.uint64)
            for k in range(lo, hi):
                value = value << np.uint64(16) | self.words[:, SIDE * side + k]
            self.values[side, lo, hi] = value
        return self.values[side, lo, hi]

    def _sifted(self, rows: np.ndarray, choice: np.ndarray, at: np.ndarray, sizes: np.ndarray, halves: list, depth: int):
        """Batches of the pairs within runs of rows that agree in a half of each further run, and in no first half where the second was chosen."""
        left, right, n = [], [], 0
        for p, q in _pairs(at, sizes, SIFTED):
            i, j = rows[p], rows[q]
            chosen = choice[p]
            for d in [*range(depth, len(halves)), *range(depth)]:
                x, y = halves[d]
                same = x[i] == x[j]
                ok = np.flatnonzero(same | (y[i] == y[j]) if d >= depth else ~(same & (chosen >> d & 1 == 1)))
                if len(ok) < len(i):
                    i, j, chosen = i[ok], j[ok], chosen[ok]
            left.append(i)
            right.append(j)
            n += len(i)
            if n >= PAIRS:
                yield from _parts(np.concatenate(left), np.concatenate(right))
                left, right, n = [], [], 0
        if n:
            yield from _parts(np.concatenate(left), np.concatenate(right))


def _parts(i: np.ndarray, j: np.ndarray):
    for lo in range(0, len(i), PAIRS):
        yield i[lo : lo + PAIRS], j[lo : lo + PAIRS]


def _starts(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and sizes of the runs of equal values."""
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, dtype=np.int64)
    return first, np.diff(np.append(first, len(group)))


def _runs(first: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in the runs asked for, and these runs' sizes."""
    first, sizes = first[which], sizes[which]
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum())), sizes


def _pairs(rows: np.ndarray, sizes: np.ndarray, most: int = PAIRS):
    """All pairs within runs of rows, in batches of about `most`."""
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(rows)) - 1  # rows after each in its run
    total = np.cumsum(left)
    lo = 0
    while lo < len(rows):
        done = int(total[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + most, side="right")))
        n = left[lo:hi]
        p = np.repeat(np.arange(lo, hi), n)
        if len(p):
            yield rows[p], rows[p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)]
        lo = hi


class _Found:
    """What links come to: of each place its number of links, and of the documents a forest that joins those linked."""

    SCHEMA = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("doc_id", pa.int64()), ("other", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("n", pa.int64()), ("lead", pa.int32()), ("words", pa.binary())])
    KINDS = "kind byte, key long, doc_id long, other long, s int, e int, n long, lead int, words binary"

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *link: np.ndarray) -> None:
        """doc_id, other, s, e, os, oe of links."""
        if len(link[0]):
            self.parts.append(link)
            self.size += len(link[0])
            if self.size > 1 << 20:
                self._reduce()

    def _reduce(self) -> None:
        full = [x if len(x) == 7 else (*x, np.ones(len(x[0]), np.int64)) for x in self.parts if len(x) != 5]
        d, o, s, e, os, oe, n = (np.concatenate(x) for x in zip(*full))
        places = [(np.concatenate((d, o)), np.concatenate((s, os)).astype(np.int64) << 32 | np.concatenate((e, oe)).astype(np.int64), np.concatenate((n, n)))] if len(d) else []
        old = [x for x in self.parts if len(x) == 5]
        places += [x[:3] for x in old]
        doc, place, n = (np.concatenate(x) for x in zip(*places))
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1]))))
        u, v = _forest(np.concatenate((d, *(x[3] for x in old))), np.concatenate((o, *(x[4] for x in old))))
        self.parts = [(doc[first], place[first], np.add.reduceat(n[order], first), u, v)]
        self.size = 0

    def rows(self):
        """Record batches, kind 0: doc_id, s, e, n of a place; 1: doc_id and other of an edge."""
        if not self.parts:
            return
        if len(self.parts) > 1 or len(self.parts[0]) != 5:
            self._reduce()
        doc, place, n, u, v = self.parts.pop()
        yield _rows(0, len(doc), doc_id=doc, s=(place >> 32).astype(np.int32), e=(place & 0xFFFFFFFF).astype(np.int32), n=n)
        yield _rows(1, len(u), doc_id=u, other=v)


def _rows(kind: int, size: int, /, **columns) -> pa.RecordBatch:
    return common.batch_of(_Found.SCHEMA, [np.full(size, kind, np.int8), *(columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in _Found.SCHEMA if f.name != "kind")])


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least that it is joined to."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, low[a], low[b])
        np.minimum.at(new, low[b], low[a])
        new = new[new]
        if (new == low).all():
            break
        low = new
    inner = np.flatnonzero(low != np.arange(len(low)))
    return nodes[inner], nodes[low[inner]]


def _compared(ctx: DataFrame, min_words: int, shingle: int) -> DataFrame:
    """Of ctx(key, doc_id, c, lead, words): rows of _Found, and with kind 2 the distinct contexts of each BLOCK windows of keys with more (doc_id and s, other and e: the first and last document's place)."""
    block, kept = BLOCK, KEPT
    rows = ctx.select("key", "doc_id", "c", "lead", "words").repartition("key").sortWithinPartitions("key", "doc_id", "c")

    def run(batches):
        held, hot = [], None

        def settled(t: pa.RecordBatch, whole: bool):
            """What of t is done with, and how many rows; unless whole, the last key goes on."""
            nonlocal hot
            key = t.column("key").to_numpy()
            first, sizes = _starts(key)
            many = (sizes > block) | (key[first] == hot if hot is not None else False)
            ends = len(first) if whole else len(first) - 1
            found = _Found()
            cold, _ = _runs(first[:ends], sizes[:ends], ~many[:ends])
            if len(cold):
                _cold(t if len(cold) == t.num_rows else t.take(pa.array(cold)), found)
            out, done = [], int(first[ends]) if ends < len(first) else t.num_rows
            for k in np.flatnonzero(many).tolist():
                a, z = int(first[k]), int(first[k] + sizes[k])
                while a < z and (k < ends or z - a > block):
                    out.append(_heads(t.slice(a, min(block, z - a)), found))
                    a = min(a + block, z)
                if k == ends:
                    done = a
                    hot = int(key[a - 1])
            out.extend(found.rows())
            return out, done

        def distinct(t, found):
            """The rows in the order of their keys and contexts, and where a context begins; links of the others to these."""
            key, doc, c, lead = (t.column(k).to_numpy() for k in ("key", "doc_id", "c", "lead"))
            words = t.column("words").to_pylist()
            mark = np.fromiter(map(xxhash.xxh3_64_intdigest, words, lead.tolist()), np.uint64, len(words))
            order = np.lexsort((c, doc, mark, key))
            k, m = key[order], mark[order]
            first, sizes = _starts((np.concatenate(([0], np.cumsum((k[1:] != k[:-1]) | (m[1:] != m[:-1]))))))
            r, f = order, np.repeat(order[first], sizes)
            width = np.fromiter(map(len, words), np.int32, len(words)) // 2
            linked = np.flatnonzero((doc[r] != doc[f]) & (width[r] >= min_words))
            r, f = r[linked], f[linked]
            s, o = c[r] - lead[r], c[f] - lead[f]
            found.add(doc[r], doc[f], s, s + width[r], o, o + width[f])
            return key, doc, c, lead, order[first], order[first + sizes - 1]

        def _cold(t, found):
            key, doc, c, lead, head, last = distinct(t, found)
            first, sizes = _starts(key[head])
            at, sizes = _runs(first, sizes, sizes > 1)
            if len(at):
                head, last = head[at], last[at]
                _linked(Contexts(t.column("words").take(pa.array(head)), lead[head], sizes, min_words, shingle), kept, doc[head], c[head], doc[last], c[last], found)

        def _heads(t, found):
            key, doc, c, lead, head, last = distinct(t, found)
            return _rows(2, len(head), key=key[head], doc_id=doc[head], other=doc[last], s=c[head], e=c[last], lead=lead[head], words=t.column("words").take(pa.array(head)))

        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n > 20_000:
                t = _joined(held)
                out, done = settled(t, False)
                yield from out
                held, n = [t.slice(done)] if done < t.num_rows else [], t.num_rows - done
        if n:
            yield from settled(_joined(held), True)[0]

    return common.map_arrow(rows, run, _Found.KINDS)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _linked(x: Contexts, kept: int, doc: np.ndarray, c: np.ndarray, last: np.ndarray, last_c: np.ndarray, found: _Found) -> None:
    """The links of contexts whose first and last documents are given: between their first ones, or, where that is one document, with another's last."""
    for i, j, before, after in x.links(kept):
        d, o, p, q = doc[i], doc[j], c[i], c[j]
        same = d == o
        if same.any():
            theirs = same & (last[j] != d)
            ours = same & ~theirs
            d, p, o, q = np.where(ours, last[i], d), np.where(ours, last_c[i], p), np.where(theirs, last[j], o), np.where(theirs, last_c[j], q)
            ok = d != o
            d, o, p, q, before, after = d[ok], o[ok], p[ok], q[ok], before[ok], after[ok]
        found.add(d, o, p - before, p + after, q - before, q + after)


def _heads_compared(heads: DataFrame, min_words: int, shingle: int) -> DataFrame:
    """Rows of _Found of the kind 2 rows of _compared(): a key's distinct contexts in one task, or dealt to parts, each two of which meet in a task."""
    block, kept = BLOCK, KEPT
    every = heads.select("key", "lead", "words", F.struct("doc_id", F.col("s").alias("c")).alias("f"), F.struct(F.col("other").alias("doc_id"), F.col("e").alias("c")).alias("z"))
    one = common.written(every.groupBy("key", "lead", "words").agg(F.min("f").alias("f"), F.max("z").alias("z")), "heads")
    # of one context in several blocks, the others' first ones are linked to the first
    long = every.where(F.length("words") >= 2 * min_words).select("key", "lead", "words", F.col("f").alias("g"))
    again = long.join(one, ["key", "lead", "words"]).where("g.doc_id <> f.doc_id")
    size = (F.length("words") / 2).cast("int")
    ends = [again.select(F.lit(0).cast("byte").alias("kind"), F.col(f"{x}.doc_id").alias("doc_id"), F.lit(None).cast("long").alias("other"), (F.col(f"{x}.c") - F.col("lead")).alias("s"), (F.col(f"{x}.c") - F.col("lead") + size).alias("e"), F.lit(1).cast("long").alias("n")) for x in "gf"]
    edges = again.select(F.lit(1).cast("byte").alias("kind"), F.col("g.doc_id").alias("doc_id"), F.col("f.doc_id").alias("other"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"), F.lit(None).cast("long").alias("n")).distinct()
    parts = one.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("lead", "words"), F.col("parts")).cast("int")
    dealt = one.join(parts, "key").withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "with"), F.greatest("part", "with")
    rows = dealt.select(F.xxhash64("key", low, high).alias("key"), "lead", "words", F.col("f.doc_id").alias("doc_id"), F.col("f.c").alias("c"), F.col("z.doc_id").alias("other"), F.col("z.c").alias("oc"), (low == high).alias("within"), (F.col("part") == low).alias("mine"))
    rows = rows.repartition("key").sortWithinPartitions("key", "doc_id", "c")

    def settled(t: pa.RecordBatch):
        key, lead, doc, c, other, oc = (t.column(k).to_numpy() for k in ("key", "lead", "doc_id", "c", "other", "oc"))
        within, mine = (t.column(k).to_numpy(zero_copy_only=False) for k in ("within", "mine"))
        first, sizes = _starts(key)
        found = _Found()
        for whole in (True, False):
            at, n = _runs(first, sizes, (sizes > 1) & (within[first] == whole))
            if len(at):
                x = Contexts(t.column("words").take(pa.array(at)), lead[at], n, min_words, shingle, None if whole else mine[at])
                _linked(x, kept, doc[at], c[at], other[at], oc[at], found)
        return found.rows()

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n > 20_000:
                t = _joined(held)
                key = t.column("key").to_numpy()
                done = int(np.searchsorted(key, key[-1]))
                if done:
                    yield from settled(t.slice(0, done))
                held, n = [t.slice(done)], t.num_rows - done
        if n:
            yield from settled(_joined(held))

    columns = ("kind", "doc_id", "other", "s", "e", "n")
    return common.map_arrow(rows, run, _Found.KINDS).select(*columns).unionByName(ends[0]).unionByName(ends[1]).unionByName(edges)


def _repeated(every: DataFrame) -> DataFrame:
    """The windows of keys that several documents have."""

    def run(batches):
        # rows come by key; those of the last key wait until another document has it
        wait, seen = None, None
        for b in batches:
            if not b.num_rows:
                continue
            t = b if wait is None else _joined([wait, b])
            key, doc = t.column("key").to_numpy(), t.column("doc_id").to_numpy()
            first, sizes = _starts(key)
            several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            if seen is not None and seen == key[0]:
                several[0] = True
            wait = None if several[-1] else t.slice(int(first[-1]))
            seen = int(key[-1]) if several[-1] else None
            at, _ = _runs(first, sizes, several)
            if len(at):
                yield t.take(pa.array(at))

    return common.map_arrow(every.repartition("key").sortWithinPartitions("key"), run, "key long, doc_id long, l int, c int, r int")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, shingle: int = SHINGLE, functions: int = HASHES, reach: int = REACH) -> DataFrame:
    """doc_id, start_word, end_word, class_id, n_links of each repeated passage of docs(doc_id, text)."""
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if reach + shingle > SIDE - 2:
        raise ValueError(f"reach and shingle may be {SIDE - 2} words together")
    every = common.written(windows(docs, min_words, shingle, functions, reach), "windows")
    ctx = common.written(_contexts(_repeated(every), docs, shingle, reach), "contexts")
    common.drop_written(every)
    once = common.written(_compared(ctx, min_words, shingle), "passage-links")
    common.drop_written(ctx)
    twice = common.written(_heads_compared(once.where("kind = 2"), min_words, shingle), "passage-links")
    links = once.select(*twice.columns).unionByName(twice)
    comp = common.components(links.where("kind = 1").select(F.col("doc_id").alias("u"), F.col("other").alias("v")), "passages").withColumnRenamed("node", "doc_id").withColumnRenamed("root", "class_id")
    ends = links.where("kind = 0").select("doc_id", "s", "e", "n")
    # equal places are counted before they are gathered; then overlapping intervals of a document become one
    places = ends.groupBy("doc_id", "s", "e").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("doc_id").orderBy("s", "e")
    opens = F.col("s") > F.coalesce(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    runs = places.withColumn("open", opens.cast("int")).withColumn("run", F.sum("open").over(w))
    merged = runs.groupBy("doc_id", "run").agg(F.min("s").cast("long").alias("start_word"), F.max("e").cast("long").alias("end_word"), F.sum("n").alias("n_links"))
    return merged.join(comp, "doc_id").select("doc_id", "start_word", "end_word", "class_id", "n_links")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
