"""Scoring with a log-bilinear language model trained in numpy by noise-contrastive estimation.

The model predicts a token from the `CONTEXT` before it: the context's vector is a sum of word vectors,
each scaled for its place, and a unit's score is that vector's product with the unit's own vector plus a
bias. Units are the leaves of a tree, about as wide as the cube root of their number: half of its classes are
the most frequent units themselves, the others are classes of like frequency with groups of like endings and
units in these. Each level is normalised, so batches of matrix products give proper log-probabilities. The `HEAD` most frequent tokens are a unit and a context each. All
others are predicted as one of the tail units, whose number grows with the root of the training types and which
gather words of one ending; within its unit such a word has its add-one share of the unit's training tokens.

Noise-contrastive estimation needs no normaliser: drawn noise (of classes, shared by a batch; of groups and
units, from the target's own class and group, for each target) is told from the data by logistic regression.
The model starts from `WARM` whole documents (those with the least hashes) on the driver; then each shard, a part
of all training tokens set by the hash of the rows, is trained on in the order of the hashes, and the shards'
parameters are averaged by their tokens, in pieces of a fixed size, so no task holds many shards' models. Shards
hold about `SHARD` tokens, or more where that would make over `SHARDS` of them; so they follow from the data alone, and
scores don't depend on how the input is partitioned (but for rounding in the sums).

Counts cover the whole corpus. Up to `HEAD` most frequent tokens' counts are sent to the tasks (a bounded
table); the other tokens meet their counts in a join.

Nulls: a null text is empty (one token, the end); a null doc_id counts as the empty text for the split;
repeated rows are rows like any other (if they fill a shard they are dealt to several); long texts are read
whole, in slices of documents; of equally frequent tokens the one first in byte order comes first; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Classes and places of the least vocabulary; noise draws of classes are counted for so many.
CLASSES, CONTEXT, DIM = 32, 3, 16
WORDS = CLASSES * CLASSES - 1
HEAD, WARM = 150_000, 300
#: Bytes of texts whose tokens are looked up, or counted, at once.
LOOKED_UP, COUNTED = 1 << 23, 1 << 25
SHARD, SHARDS = 4_000_000, 4096
#: Last bytes of a word that choose its tail unit.
ENDING = 4
#: Parameters in one piece of the sums.
PIECE = 1 << 14
BATCH, NOISE, WORD_NOISE = 2048, 16, 4
END = b""


def bucket(token: bytes, buckets: int) -> int:
    """The tail unit of a word."""
    return zlib.crc32(token[-ENDING:]) % buckets


def split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as bytes.lower().split() has them, and the number of each text's."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, type=pa.large_binary()).view(pa.large_string())))
    words, at = lists.flatten().view(pa.large_binary()), lists.offsets.to_numpy()
    sizes = np.diff(at)
    empty = np.flatnonzero(pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False))
    if len(empty):  # where a text is empty, or begins or ends with a blank
        sizes -= np.bincount(np.searchsorted(at, empty, side="right") - 1, minlength=len(sizes)).astype(sizes.dtype)
        keep = np.ones(len(words), dtype=bool)
        keep[empty] = False
        words = words.filter(pa.array(keep))
    return words, sizes.astype(np.int64)


def _parts(column: pa.Array, rows: int, most: int):
    """Parts of a multiple of `rows` texts, of which all but the last `rows` have under `most` bytes."""
    size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
    lo = 0
    while lo < len(column):
        hi = min(len(column), lo + rows)
        while hi < len(column) and size[hi] - size[lo] < most:
            hi = min(len(column), hi + rows)
        yield column.slice(lo, hi - lo)
        lo = hi


class Vocabulary:
    """The most frequent tokens and the tail: unit (what is predicted, and what a context is), leaf and training count of each.

    tail: training tokens and types of each tail unit beyond the head; without it there is one tail unit.
    """

    def __init__(self, tokens: list[bytes], counts: list[int], n_tokens: int, n_types: int, tail: list[tuple[int, int]] | None = None):
        self.index = {t: i for i, t in enumerate(tokens)}
        self.head = pa.array(tokens, type=pa.large_binary())
        self.count = np.append(np.array(counts, dtype=np.int64), 0)
        n = len(tokens)
        self.other = n  # the first tail unit
        tail = np.array(tail if tail else [(n_tokens - int(self.count.sum()), n_types - n)], dtype=np.int64)
        self.tails = len(tail)
        self.n_units = n + self.tails
        self.unit = np.arange(n + 1, dtype=np.int32)
        self.bos = self.n_units
        self.n_contexts = self.n_units + 1
        self.n_tokens, self.n_types = n_tokens, n_types
        #: log10 of what a word's count is divided by: of units of one word nothing
        self.share_log = np.concatenate((np.zeros(n), np.log10(tail.sum(axis=1) + 1.0)))
        self.base_log = float(np.log10(n_tokens + n_types + 1))
        units = np.concatenate((self.count[:n], np.maximum(1, tail[:, 0]))).astype(np.float64)
        self.width = 11  # 11 ** 3 leaves are more than CLASSES ** 2
        while self.width // 2 + (self.width - self.width // 2) * self.width**2 < self.n_units:
            self.width += 1
        r = self.width
        self.single = r // 2  # so many classes are one unit each
        self.leaves = r**3
        self.n_classes = math.isqrt(self.leaves - 1) + 1
        # classes by frequency; in a class by the words' ends, so that a group's words are alike
        order, size = np.argsort(-units, kind="stable"), r**2
        alone, order = order[: self.single], order[self.single :]
        ends = [t[::-1] for t in tokens] + [b"\xff"] * self.tails
        order = np.concatenate([order[:0], *(np.array(sorted(order[i : i + size].tolist(), key=ends.__getitem__), dtype=np.int64) for i in range(0, len(order), size))])
        self.place = np.empty(self.n_units, dtype=np.int64)
        self.place[alone] = np.arange(len(alone)) * size
        self.place[order] = self.single * size + np.arange(len(order))
        share = units / units.sum()
        p = np.zeros((r - self.single) * size)
        p[: len(order)] = share[order]
        #: shares of the classes, of the groups in their classes, of the units in their groups
        inside = p.reshape(-1, r, r)
        groups = inside.sum(axis=2)
        classes = groups.sum(axis=1)
        self.shares = (
            np.concatenate((share[alone], np.zeros(self.single - len(alone)), classes)),
            groups / np.maximum(classes[:, None], 1e-300),
            (inside / np.maximum(groups[:, :, None], 1e-300)).reshape(-1, r),
        )

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Indexes of all tokens of the texts, each with its end; where each text begins; the words, without ends."""
        words, sizes = split(texts)
        miss = len(self.count) - 1
        at = np.concatenate(([0], np.cumsum(sizes + 1)))
        out = np.full(int(at[-1]), self.index.get(END, miss), dtype=np.int64)
        inner = np.ones(len(out), dtype=bool)
        inner[at[1:] - 1] = False
        out[inner] = pc.fill_null(pc.index_in(words, value_set=self.head), miss).to_numpy(zero_copy_only=False)
        return out, at, words

    def slices(self, column: pa.Array, rows: int):
        """tokens() of so many texts at a time; looked up in larger parts, as each look-up first reads all of the head."""
        for part in _parts(column, rows, LOOKED_UP):
            ids, at, words = self.tokens(common.raw_texts(part))
            for lo in range(0, len(part), rows):
                hi = min(len(part), lo + rows)
                yield ids[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], words.slice(at[lo] - lo, at[hi] - hi - (at[lo] - lo))

    def missing(self, ids: np.ndarray, at: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of the words beyond the head: their places, texts and the words."""
        gone = ids == len(self.count) - 1
        gone[at[1:] - 1] = False
        miss = np.flatnonzero(gone)
        doc = np.searchsorted(at, miss, side="right") - 1
        return miss, doc, words.take(pa.array(miss - doc)).to_pylist()

    def units(self, ids: np.ndarray, at: np.ndarray, words: pa.Array, missing: tuple | None = None) -> np.ndarray:
        """The unit of each token, those beyond the head in their tail units (an end in the first)."""
        u = self.unit.take(ids)
        if self.tails > 1:
            miss, _, gone = missing or self.missing(ids, at, words)
            crc = zlib.crc32
            # bucket(), without a call for each word
            u[miss] = self.other + np.array([crc(w[-ENDING:]) for w in gone], dtype=np.int64) % self.tails
        return u

    def contexts(self, ids: np.ndarray, at: np.ndarray, words: pa.Array, units: np.ndarray | None = None) -> np.ndarray:
        """The context ids before each token, nearest first; each text begins anew."""
        c = self.units(ids, at, words) if units is None else units
        out = np.full((CONTEXT, len(ids)), self.bos, dtype=np.int32)
        for k in range(CONTEXT):
            out[k, k + 1 :] = c[: len(c) - k - 1]
            for j in range(k + 1):  # a text's first tokens have no k-th token before them
                first = at[:-1] + j
                out[k, first[first < at[1:]]] = self.bos
        return out


class Model:
    NAMES = ("context", "scale", "top", "top_bias", "mid", "mid_bias", "word", "word_bias")

    def __init__(self, vocabulary: Vocabulary, seed: int = 1, flat: np.ndarray | None = None):
        v = vocabulary
        r = self.width = v.width
        self.single, m = v.single, r - v.single  # m classes have groups
        self.shapes = dict(zip(self.NAMES, ((v.n_contexts, DIM), (CONTEXT, DIM), (r, DIM), (r,), (m * r, DIM), (m * r,), (m * r * r, DIM), (m * r * r,))))
        if flat is not None:
            self.load(flat)
            return
        rng = np.random.default_rng(seed)
        self.context = (rng.standard_normal((v.n_contexts, DIM)) * 0.1).astype(np.float32)
        self.context[WORDS : v.other] = 0  # a word seldom or never met in training says nothing
        self.scale = np.full((CONTEXT, DIM), 1.0, dtype=np.float32)
        self.top = (rng.standard_normal((r, DIM)) * 0.1).astype(np.float32)
        self.mid = (rng.standard_normal((m * r, DIM)) * 0.1).astype(np.float32)
        self.word = np.zeros((m * r * r, DIM), dtype=np.float32)  # and keeps its share of its group
        for name, p in zip(("top_bias", "mid_bias", "word_bias"), v.shares):
            with np.errstate(divide="ignore"):
                setattr(self, name, np.maximum(np.log(p), -30).astype(np.float32).ravel())

    def parameters(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for n, shape in self.shapes.items():
            size = math.prod(shape)
            setattr(self, n, flat[at : at + size].reshape(shape).astype(np.float32))
            at += size

    def hidden(self, contexts: np.ndarray) -> np.ndarray:
        out = np.empty((contexts.shape[1], DIM), dtype=np.float32)
        for lo in range(0, len(out), 1 << 12):  # a text's tokens are each other's contexts, so their vectors stay in the cache
            c, h = contexts[:, lo : lo + (1 << 12)], out[lo : lo + (1 << 12)]
            np.multiply(self.context.take(c[0], axis=0), self.scale[0], out=h)
            for k in range(1, CONTEXT):
                h += self.context.take(c[k], axis=0) * self.scale[k]
        return out

    def log10(self, contexts: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of the units at the leaves `place` (beyond the tree: none), from batched matrix products."""
        out, r, size = np.full(len(place), -np.inf), self.width, self.width**2
        base = self.single * size  # where the classes with groups begin
        for lo in range(0, len(place), 1 << 19):
            y = place[lo : lo + (1 << 19)]
            inside = np.flatnonzero((y < r**3) & ((y >= base) | (y % size == 0)))
            # tokens in the order of their leaves, so that those of a node lie together
            order = inside[_sorted(y[inside])]
            y = y[order]
            h = self.hidden(contexts[:, lo : lo + (1 << 19)]).take(order, axis=0)
            got, bias = np.empty(len(y), dtype=np.float64), self.top_bias
            for i in range(0, len(y), 1 << 11):  # scores of some thousand tokens stay in the cache
                got[i : i + (1 << 11)] = _log_share(h[i : i + (1 << 11)], self.top, bias, y[i : i + (1 << 11)] // size)
            deep = int(np.searchsorted(y, base))
            leaf = y[deep:] - base
            for weights, bias, node, child in ((self.mid, self.mid_bias, leaf // size, leaf // r % r), (self.word, self.word_bias, leaf // r, leaf % r)):
                starts = np.concatenate((np.flatnonzero(np.diff(node, prepend=-1)), [len(leaf)])).tolist()
                for a, z in zip(starts, starts[1:]):
                    k = int(node[a]) * r
                    for i in range(a, z, 1 << 11):
                        j = min(z, i + (1 << 11))
                        got[deep + i : deep + j] += _log_share(h[deep + i : deep + j], weights[k : k + r], bias[k : k + r], child[i:j])
            out[lo + order] = got
        return out / np.log(10.0)


def _log_share(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, child: np.ndarray) -> np.ndarray:
    """Log-probabilities of one child each among all of a node."""
    s = h @ weights.T
    s += bias
    own = s[_COUNT[: len(s)], child].astype(np.float64)
    total = (np.exp(s, out=s) @ np.ones(s.shape[1], dtype=np.float32)).astype(np.float64)
    if 1e-30 < total.min() and total.max() < np.inf:
        return own - np.log(total)
    s = h @ weights.T + bias
    top = s.max(axis=1)  # scores too large or too small for exp()
    return own - top - np.log(np.exp(s - top[:, None]).sum(axis=1))


_COUNT = np.arange(1 << 11)


def _sorted(y: np.ndarray) -> np.ndarray:
    """A stable order of y (below 2 ** 32) by radix sorts of 16 bits."""
    order = np.argsort((y & 0xFFFF).astype(np.uint16), kind="stable")
    high = (y >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In x's own place."""
    np.negative(x, out=x)
    np.minimum(x, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def _sums(at: np.ndarray, n: int, coefficients: np.ndarray | None, vectors) -> np.ndarray:
    """Sums of coefficients times vectors to the rows `at` of n.

    vectors: two dimensions at a time as the parts of complex numbers, which add.at() sums faster than bincount() does each by itself.
    """
    sums = np.zeros((DIM // 2, n), dtype=np.complex128)
    for total, x in zip(sums, vectors):
        np.add.at(total, at, (x if coefficients is None else coefficients * x).ravel())
    out = np.empty((n, DIM), dtype=np.float32)
    out[:, ::2], out[:, 1::2] = sums.real.T, sums.imag.T
    return out


def _products(scale: np.ndarray, dh: np.ndarray):
    """Two dimensions at a time, as the parts of complex numbers: what each context's vector takes of dh. The next ones take the place of the last."""
    scale, back = scale.T[:, :, None], dh.T.astype(np.float64, order="C")
    out = np.empty((CONTEXT, len(dh)), dtype=np.complex128)
    for d in range(0, DIM, 2):
        np.multiply(scale[d], back[d], out=out.real)
        np.multiply(scale[d + 1], back[d + 1], out=out.imag)
        yield out


def alias_table(shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of shares (nodes x children) the alias method's tables: how much of each child's slot is its own, and whose the rest is."""
    left = shares / np.maximum(shares.sum(axis=1, keepdims=True), 1e-300) * shares.shape[1]
    nodes, own, other = np.arange(len(left)), np.ones(left.shape), np.tile(np.arange(left.shape[1]), (len(left), 1))
    low = left.copy()  # infinite once a child's slot is settled
    for _ in range(left.shape[1] - 1):
        i = low.argmin(axis=1)
        low[nodes, i] = np.inf
        high = np.where(np.isinf(low), -1.0, low)
        j = high.argmax(axis=1)
        own[nodes, i] = np.minimum(1.0, left[nodes, i])
        other[nodes, i] = j
        left[nodes, j] -= 1.0 - own[nodes, i]
        low[nodes, j] = left[nodes, j]
    return own.ravel(), (other + nodes[:, None] * left.shape[1]).ravel()


class Trainer:
    """Noise-contrastive steps with AdaGrad."""

    def __init__(self, model: Model, vocabulary: Vocabulary, seed: int, rate: float = 0.1):
        self.m, self.rate, self.rng, self.width, self.single = model, rate, np.random.default_rng(seed), vocabulary.width, vocabulary.single
        self.q, *inside = vocabulary.shares
        self.q = self.q / self.q.sum()
        self.log_q = [np.log(np.maximum(p, 1e-12)).astype(np.float32).ravel() for p in vocabulary.shares]
        self.draw = [alias_table(p) for p in inside]
        self.squares = {n: np.ones(getattr(model, n).shape[:1] if n in ("context", "top", "mid", "word") else getattr(model, n).shape, dtype=np.float32) for n in Model.NAMES}
        self.slot = {n: np.zeros(getattr(model, n).shape[0], dtype=np.int64) for n in ("context", "word")}

    def _apply(self, name: str, rows: np.ndarray | None, grad: np.ndarray, values: np.ndarray | None = None) -> None:
        """An AdaGrad step of distinct rows (None: of all), whose values may be given; a row of vectors shares one rate."""
        target, sq = getattr(self.m, name), self.squares[name]
        shared = grad.ndim == 2 and sq.ndim == 1
        new = sq if rows is None else sq.take(rows, axis=0)
        new += np.einsum("nd,nd->n", grad, grad) / DIM if shared else grad * grad
        step = self.rate / np.sqrt(new)
        grad *= step[:, None] if shared else step
        if rows is None:
            target += grad
        else:
            grad += target.take(rows, axis=0) if values is None else values
            target[rows] = grad
            sq[rows] = new

    def _distinct(self, name: str, rows: np.ndarray) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """Each row once (None: all rows of a small table), where `rows` are among these, and the vectors of these."""
        if name not in self.slot:
            return None, rows, getattr(self.m, name)
        slot, count = self.slot[name], np.arange(len(rows))
        slot[rows] = count
        distinct = rows[slot.take(rows) == count]  # where each row was set last
        slot[distinct] = count[: len(distinct)]
        return distinct, slot.take(rows), getattr(self.m, name).take(distinct, axis=0)

    def _scatter(self, name: str, distinct: np.ndarray | None, at: np.ndarray, values: np.ndarray, coefficients: np.ndarray | None, vectors) -> None:
        """Sum, for equal rows, coefficients times vectors and step; with coefficients the biases as well."""
        n = len(values)
        grad = _sums(at, n, coefficients, vectors)
        self._apply(name, distinct, grad, values)
        if coefficients is not None:
            self._apply(f"{name}_bias", distinct, np.bincount(at, coefficients.ravel(), n).astype(np.float32))

    def _inside(self, name: str, level: int, node: np.ndarray, target: np.ndarray, u: np.ndarray, h: np.ndarray, columns: np.ndarray, dh: np.ndarray) -> None:
        """Targets against noise children of their own nodes; u[k, i] draws the k-th noise of target i."""
        m, log_q, lk = self.m, self.log_q[level], np.float32(np.log(WORD_NOISE))
        own, other = self.draw[level - 1]
        u = u * self.width
        slot = u.astype(np.int64)
        u -= slot
        slot += node * self.width
        rows = np.empty((WORD_NOISE + 1, len(target)), dtype=np.int64)
        rows[0] = target
        rows[1:] = np.where(u < own.take(slot), slot, other.take(slot))
        distinct, at, values = self._distinct(name, rows.ravel())
        rows = at.reshape(rows.shape)
        bias = getattr(m, f"{name}_bias")
        w = values.take(rows, axis=0)
        s = np.einsum("nd,knd->kn", h, w)
        s += (bias - log_q - lk if distinct is None else bias.take(distinct) - log_q.take(distinct) - lk).take(rows)
        g = -_sigmoid(s)
        g[0] += 1
        dh += np.einsum("kn,knd->nd", g, w)
        self._scatter(name, distinct, at, values, g.astype(np.float64), columns)

    def step(self, contexts: np.ndarray, place: np.ndarray) -> None:
        m, n, r = self.m, len(place), self.width
        distinct, at, values = self._distinct("context", contexts.ravel().astype(np.int64))
        parts = values.take(at.reshape(contexts.shape), axis=0)
        h = parts[0] * m.scale[0]
        for k in range(1, CONTEXT):
            h += parts[k] * m.scale[k]
        y = place // r**2
        # classes: noise shared by the batch
        k = NOISE * max(CLASSES, r) // CLASSES  # as many a class as for the least number
        z = self.rng.choice(r, k, p=self.q)
        noise = np.bincount(z, minlength=r)
        drawn = np.flatnonzero(noise)  # the other classes have a gradient by their own targets alone
        top, bias = m.top.take(drawn, axis=0), m.top_bias - self.log_q[0] - np.float32(np.log(k))
        g = h @ top.T
        g += bias.take(drawn)
        g = _sigmoid(g)
        g *= -noise.take(drawn).astype(np.float32)
        own = m.top.take(y, axis=0)
        s = np.einsum("nd,nd->n", h, own)
        s += bias.take(y)
        mine = 1 - _sigmoid(s)
        dh = g @ top
        own *= mine[:, None]
        dh += own
        # groups and units: noise from the target's own class and group, for each target; high and low bits of one draw
        u = self.rng.random((WORD_NOISE, n))
        u *= 1 << 24
        high = np.floor(u)
        u -= high
        high /= 1 << 24
        columns = h.view(np.complex64).T.astype(np.complex128, order="C")
        deep = np.flatnonzero(y >= self.single)
        if len(deep):
            leaf = place.take(deep) - self.single * r**2
            group, inner, back = leaf // r, h.take(deep, axis=0), np.zeros((len(deep), DIM), dtype=np.float32)
            theirs = columns.take(deep, axis=1)
            self._inside("mid", 1, group // r, group, high.take(deep, axis=1), inner, theirs, back)
            self._inside("word", 2, group, leaf, u.take(deep, axis=1), inner, theirs, back)
            dh[deep] += back
        grad, bias = _sums(y, r, mine, columns), np.bincount(y, mine, r).astype(np.float32)
        grad[drawn] += g.T @ h
        bias[drawn] += g.sum(axis=0)
        self._apply("top", None, grad)
        self._apply("top_bias", None, bias)
        self._scatter("context", distinct, at, values, None, _products(m.scale, dh))
        self._apply("scale", None, np.stack([np.einsum("nd,nd->d", dh, parts[k]) for k in range(CONTEXT)]))


def train_on(model: Model, vocabulary: Vocabulary, batches, seed: int) -> int:
    """One pass over (ids, at, words) batches; the number of tokens."""
    t, total = Trainer(model, vocabulary, seed), 0
    for ids, at, words in batches:
        u = vocabulary.units(ids, at, words)
        c, y = vocabulary.contexts(ids, at, words, u), vocabulary.place.take(u)
        for lo in range(0, len(y), BATCH):
            t.step(c[:, lo : lo + BATCH], y[lo : lo + BATCH])
        total += len(y)
    return total


def _docs(docs: DataFrame) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.crc32(F.encode(key, "UTF-8")) % 7 == 2).alias("held_out"))
    return docs.withColumn("key", F.xxhash64("doc_id", "text"))


def token_counts(train: DataFrame) -> DataFrame:
    """token, c over all rows; the empty token is the end of a text. Written."""
    schema = pa.schema([("token", pa.binary()), ("c", pa.int64())])

    def run(batches):
        for b in batches:
            for part in _parts(b.column("text"), 100, COUNTED):
                n = split(common.raw_texts(part))[0].value_counts()
                yield common.batch_of(schema, [n.field("values").cast(pa.binary()), n.field("counts")])
            if b.num_rows:
                yield common.batch_of(schema, [[END], [b.num_rows]])

    return common.written(common.map_arrow(train.select("text"), run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")), "token-counts")


def sharded(train: DataFrame, shards: int) -> DataFrame:
    """The texts by shard (a partition each), in the order of their hashes. A row that is repeated so often that it fills a shard is dealt to several."""
    if shards > 1:
        # as many keys as shards at most
        hot = {r.key: r.n for r in train.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * shards > train.count()).collect()}
    else:
        hot = {}
    shard = F.pmod(F.col("key"), F.lit(shards))
    if hot:
        shard = F.when(F.col("key").isin(list(hot)), F.floor(F.rand(1) * shards)).otherwise(shard)
    return train.select("text", "key", shard.cast("int").alias("shard")).repartitionById(shards, "shard").sortWithinPartitions("key")


def averaged(train: DataFrame, vocabulary, start: np.ndarray, n_tokens: int) -> np.ndarray:
    """Parameters after every shard's pass from `start` over all its tokens, averaged by tokens."""
    spark = train.sparkSession
    sent = spark.sparkContext.broadcast((vocabulary, start))  # bounded by HEAD and the model's size
    schema = pa.schema([("piece", pa.int64()), ("tokens", pa.int64()), ("mean", pa.binary())])
    kinds = "piece long, tokens long, mean binary"

    def run(batches):
        v, flat = sent.value
        model = Model(v, flat=flat)
        n = train_on(model, v, (t for b in batches for t in v.slices(b.column("text"), 500)), TaskContext.get().partitionId() + 1)
        if n:
            flat = model.parameters()
            for k, lo in enumerate(range(0, len(flat), PIECE)):
                yield common.batch_of(schema, [[k], [n], [flat[lo : lo + PIECE].tobytes()]])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        total: Counter = Counter()
        for b in batches:
            for k, n, raw in zip(*(b.column(c).to_pylist() for c in ("piece", "tokens", "mean"))):
                x = np.frombuffer(raw, "<f4") * float(n)
                sums[k] = sums[k] + x if k in sums else x
                total[k] += n
        for k, x in sums.items():
            yield common.batch_of(schema, [[k], [total[k]], [(x / total[k]).astype("<f4").tobytes()]])

    each = common.map_arrow(sharded(train, min(SHARDS, max(1, -(-n_tokens // SHARD)))).select("text"), run, kinds)
    rows = common.map_arrow(each.repartition("piece"), add, kinds).collect()
    return np.concatenate([np.frombuffer(r["mean"], "<f4") for r in sorted(rows, key=lambda r: r.piece)]) if rows else start


def tail_units(counts: DataFrame, head: list, n_types: int) -> list[tuple[int, int]]:
    """Training tokens and types of each tail unit; as many units as the root of the types, and that many rows come to the driver."""
    n = max(1, math.isqrt(n_types))
    out = np.zeros((n, 2), dtype=np.int64)
    unit = F.pmod(F.crc32(F.substring("token", -ENDING, ENDING)), F.lit(n))
    for r in counts.groupBy(unit.alias("u")).agg(F.sum("c").alias("c"), F.count("*").alias("k")).collect():
        out[r.u] = r.c, r.k
    for r in head:
        out[bucket(bytes(r.token), n)] -= (r.c, 1)
    return [tuple(x) for x in out.tolist()]


def most_frequent(counts: DataFrame, most: int) -> list:
    """The tokens of the highest counts, at most `most`, by falling count.

    A histogram of counts in steps of two per cent (at most some thousand rows) gives the least count
    to take, so no task sends more than rows of the result.
    """
    step = F.floor(F.ln("c") * 50)
    total, least = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.s):
        total += r.n
        if total > most:
            break
        least = r.s
    if least is None:
        return []
    return sorted(counts.where(step >= least).collect(), key=lambda r: (-r.c, bytes(r.token)))


def score(docs: DataFrame, fit: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text); without fit no model is trained and score is left out."""
    spark = docs.sparkSession
    docs = _docs(docs)
    train = docs.where(~F.col("held_out"))
    counts = token_counts(train)
    n_types, n_tokens = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    head = most_frequent(counts, HEAD)
    v = Vocabulary([bytes(r.token) for r in head], [r.c for r in head], int(n_tokens), int(n_types), tail_units(counts, head, int(n_types)))
    parameters = None
    if fit:
        model = Model(v)
        warm = [(r.text or "").encode() for r in train.orderBy("key", "doc_id").limit(WARM).select("text").collect()]
        if warm:
            train_on(model, v, [v.tokens(warm)], 0)
        parameters = averaged(train, v, model.parameters(), int(n_tokens))
    sent = spark.sparkContext.broadcast((v, parameters))
    tail_t = pa.struct([("token", pa.binary()), ("tf", pa.int64())])
    schema = pa.schema([("pid", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("tail", pa.list_(tail_t))])

    def run(batches):
        v, flat = sent.value
        m, pid, row = None if flat is None else Model(v, flat=flat), TaskContext.get().partitionId(), 0
        logs = np.log10(v.count + 1.0)
        for b in batches:
            lo = 0
            for ids, at, words in v.slices(b.column("text"), 1000):
                missing = v.missing(ids, at, words)
                log_c, p = logs.take(ids), np.zeros(len(ids))
                if m is not None:
                    unit = v.units(ids, at, words, missing)
                    p = m.log10(v.contexts(ids, at, words, unit), v.place.take(unit))
                    p -= v.share_log.take(unit)  # a tail word's count, the other part of its share, comes by the join below
                first = at[:-1]
                n = np.diff(at)
                s = b.slice(lo, len(n))
                lo += len(n)
                known = np.add.reduceat((v.count[ids] > 0).astype(np.int64), first)
                _, doc, gone = missing
                ends = np.searchsorted(doc, np.arange(len(n) + 1)).tolist()
                token, tf, sizes = [], [], [0]
                for a, z in zip(ends, ends[1:]):
                    t = Counter(gone[a:z])
                    token.extend(t)
                    tf.extend(t.values())
                    sizes.append(len(token))
                tails = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(token, pa.binary()), pa.array(tf, pa.int64())], fields=list(tail_t)))
                yield common.batch_of(
                    schema,
                    [np.full(len(n), pid, np.int32), np.arange(row, row + len(n)), s.column("doc_id"), s.column("held_out"), n, known, np.add.reduceat(log_c, first) - n * v.base_log, np.add.reduceat(p, first), tails],
                )
                row += len(n)

    scored = common.written(common.map_arrow(docs, run, "pid int, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<token:binary,tf:long>>"), "lm-scores")
    # tokens beyond the head meet their counts here; those that the training lacks add log10(0 + 1) = 0
    tail = scored.where(F.size("tail") > 0).select("pid", "row", F.explode("tail").alias("x")).select("pid", "row", "x.token", "x.tf")
    found = tail.join(counts, "token").groupBy("pid", "row").agg(F.sum("tf").alias("known"), F.sum(F.col("tf") * F.log10(F.col("c") + F.lit(1.0))).alias("logs"))
    logs = F.coalesce("logs", F.lit(0.0))
    out = scored.drop("tail").join(found, ["pid", "row"], "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(int(n_tokens)).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score")
    )
    return out if fit else out.drop("score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
