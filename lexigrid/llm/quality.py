"""Quality rules by line labelling: a linear-chain conditional random field marks lines as content or boilerplate.

Lines with a word are the chain; Viterbi decoding labels them, and a document is kept when at least
`SHARE` of its words stand in content lines and the base rules don't fail it. The field is trained here
by gradient ascent on the exact likelihood (forward-backward) over whole texts of at most `SAMPLE` labelled
documents. Line labels are latent: they begin as the document's, with lines that many documents repeat as
boilerplate, and are set anew in rounds as far as they give each document its own label. Without labels
all lines are content. Counting, decoding and the verdict cover every document whole.

Nulls: a null text has no words and fails the base rule; null or repeated doc_ids are rows like any other;
labels without a doc_id or a quality aren't used, of several labels of a document the greatest is; an empty
table gives no rows. Long texts take time linear in them (decoding) or n log n (repeated windows). Ties between
labels go to content, and a share of just `SHARE` is kept. Other columns, whatever their names, are not read,
and keep_good() returns them all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE, SHARE, SEEN = 800, 0.5, 3
_SYMBOLS = b"#*$%&|<>"
_MARKS = b"#*$%&|<>!{}[]=_~^\\/@+"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SPACE = b" \t\n\x0b\x0c\r"
N_FEATURES = 10


def line_features(line: bytes, n_words: int, again: bool, stock: bool) -> tuple[float, ...]:
    size = len(line)
    return (
        1.0,
        min(1.0, 4.0 * (size - len(line.translate(None, _MARKS))) / size),
        min(1.0, 2.0 * (size - len(line.translate(None, _UPPER))) / size),
        min(1.0, 4.0 * (size - len(line.translate(None, _DIGITS))) / size),
        1.0 if again else 0.0,
        1.0 if line.rstrip(_SPACE)[-1] in b".?!" else 0.0,
        1.0 if n_words < 4 else 0.0,
        min(1.0, math.log1p(n_words) / 6.0),
        min(1.0, size / n_words / 20.0),
        1.0 if stock else 0.0,
    )


def chain(raw: bytes, stock: frozenset[bytes] = frozenset()) -> tuple[list[tuple[float, ...]], list[int], int]:
    """Features and word counts of the lines with a word, and how many of these equal an earlier line; stock: lines known as boilerplate."""
    seen, rows, sizes, again_n = set(), [], [], 0
    for line in raw.split(b"\n"):
        n = len(line.split())
        if n:
            again = line in seen
            again_n += again
            seen.add(line)
            rows.append(line_features(line, n, again, line in stock))
            sizes.append(n)
    return rows, sizes, again_n


def products(m: np.ndarray) -> np.ndarray:
    """m[0], m[0] m[1], m[0] m[1] m[2], ... of 2 x 2 matrices, each scaled so that its greatest entry is 1; in blocks that run side by side."""
    n = len(m)
    width = math.isqrt(max(0, n - 1)) + 1
    a = np.concatenate((m, np.broadcast_to(np.eye(2), (-n % width, 2, 2)))).reshape(-1, width, 2, 2)
    for k in range(1, width):
        x = a[:, k - 1] @ a[:, k]
        a[:, k] = x / x.max(axis=(1, 2), keepdims=True)
    before = np.empty((len(a), 2, 2))
    before[0] = np.eye(2)
    for i in range(1, len(a)):
        x = before[i - 1] @ a[i - 1, -1]
        before[i] = x / x.max()
    out = (before[:, None] @ a).reshape(-1, 2, 2)[:n]
    return out / out.max(axis=(1, 2), keepdims=True)


def posteriors(emit: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label 1) of each line, and P(labels of the line before and of this) - of first lines zero. Chains lie end to end, first marks where they begin."""
    step = np.exp(trans)[None] * np.exp(emit - emit.max(axis=1, keepdims=True))[:, None, :]
    step[first] = np.exp(emit[first] - emit[first].max(axis=1, keepdims=True))[:, None, :]  # what came before doesn't matter
    alpha = products(step)[:, 0]
    # the products from the end are those of the transposed matrices in reverse
    after = products(step[::-1].transpose(0, 2, 1))[::-1].transpose(0, 2, 1)
    beta = np.ones_like(alpha)
    beta[:-1] = after[1:].sum(axis=2)
    beta /= beta.max(axis=1, keepdims=True)
    p = alpha * beta
    p1 = p[:, 1] / p.sum(axis=1)
    joint = np.zeros((len(emit), 2, 2))
    joint[1:] = alpha[:-1, :, None] * step[1:] * beta[1:, None, :]
    joint[first] = 0
    joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
    return p1, joint


def ascend(x: np.ndarray, y: np.ndarray, first: np.ndarray, scale: np.ndarray, w: np.ndarray, trans: np.ndarray, steps: int, most: float | None, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Gradient steps (AdaGrad) on the exact likelihood of the line labels y; most bounds the transitions."""
    g2w, g2t = np.full(N_FEATURES, 1e-8), np.full((2, 2), 1e-8)
    seen, within = np.zeros((2, 2)), np.flatnonzero(~first)
    np.add.at(seen, (y[within - 1], y[within]), scale[within])
    for _ in range(steps):
        s = x @ w
        p1, joint = posteriors(np.stack([np.zeros_like(s), s], axis=-1), trans, first)
        gw = (scale * (y - p1)) @ x - decay * w
        gt = seen - np.einsum("t,tab->ab", scale, joint) - decay * trans
        g2w += gw * gw
        g2t += gt * gt
        w, trans = w + rate * gw / np.sqrt(g2w), trans + rate * gt / np.sqrt(g2t)
        if most is not None:
            trans = np.clip(trans, -most, most)
    return w, trans


def stock_lines(texts: list[str]) -> frozenset[bytes]:
    """Lines that stand between at least `SEEN` different pairs of neighbours: copies of whole texts repeat the neighbours too."""
    between: dict[bytes, set] = {}
    for t in texts:
        lines = [b"", *[x for x in t.encode().split(b"\n") if x.split()], b""]
        for a, x, z in zip(lines, lines[1:], lines[2:]):
            if len(s := between.setdefault(x, set())) < SEEN:
                s.add((a, z))
    return frozenset(x for x, s in between.items() if len(s) >= SEEN)


def train(texts: list[str], labels: list[int], rounds: int = 3) -> tuple[np.ndarray, np.ndarray, frozenset[bytes]]:
    """Weights (of label 1, content, against 0), transitions (2 x 2) and stock lines of the field.

    Line labels are latent: at first a document's label is that of its lines, but stock_lines() are
    boilerplate. Then, in each round, lines are relabelled by their own scores wherever these labels give the
    document its own, so that labels change within documents and the transitions are learnt from that.
    """
    w, trans = np.zeros(N_FEATURES), np.zeros((2, 2))
    stock = stock_lines(texts)
    chains, ys, sizes, fixed = [], [], [], []
    for t, y in zip(texts, labels):
        rows, n, _ = chain(t.encode(), stock)
        if rows:
            chains.append(np.array(rows))
            ys.append(y)
            sizes.append(np.array(n))
            fixed.append(np.array([x in stock for x in t.encode().split(b"\n") if x.split()]))
    if len(set(ys)) < 2:
        w[0] = 1.0
        return w, trans, frozenset()
    x, longs, doc_y = np.concatenate(chains), np.array(list(map(len, chains))), np.array(ys)
    first = np.zeros(len(x), dtype=bool)
    first[np.cumsum(longs) - longs] = True
    # classes count alike, documents of a class as well, and the lines of a document by their words
    weight = np.where(doc_y == 1, 0.5 / (doc_y == 1).sum(), 0.5 / (doc_y == 0).sum())
    scale, seeded = np.concatenate([v * n / n.sum() for v, n in zip(weight, sizes)]), np.concatenate(fixed)
    y = np.repeat(doc_y, longs) * ~seeded
    w, trans = ascend(x, y, first, scale, w, trans, 200, 2.0)  # labels of whole documents say too little about changes within them
    for _ in range(rounds):
        s, at = x @ w, 0  # without the transitions, which as yet hold a document's lines together
        y = y.copy()
        for n, label, words in zip(longs.tolist(), ys, sizes):
            got = (s[at : at + n] >= 0) * ~seeded[at : at + n]
            if (int(words[got == 1].sum()) >= SHARE * int(words.sum())) == (label == 1):
                y[at : at + n] = got
            at += n
        w, trans = ascend(x, y, first, scale, w, trans, 60, None)
    return w, trans, stock


def viterbi(scores: list[float], trans: np.ndarray) -> list[int]:
    """The best labels; scores are those of label 1 against 0. Ties go to content."""
    (t00, t01), (t10, t11) = trans.tolist()
    a, b, back = 0.0, scores[0], []
    for s in scores[1:]:
        x0, x1 = a + t00, b + t10
        y0, y1 = a + t01, b + t11
        back.append((x1 >= x0, y1 >= y0))
        a, b = max(x0, x1), max(y0, y1) + s
    k = int(b >= a)
    out = [k]
    for p in reversed(back):
        k = int(p[k])
        out.append(k)
    return out[::-1]


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words that stand in a window of `width` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    a = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    key = a[:n]
    for k in range(1, width):
        if len(ids) * (int(key.max()) + 1) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(ids) + a[k : n + k]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.isin(key, twice)
    covered = np.zeros(len(words), dtype=bool)
    for k in range(width):
        covered[k : n + k] |= at
    return int(covered.sum())


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[int]]:
    """Whole texts and labels of at most `sample` labelled documents, those with the smallest hashes."""
    some = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    some = some.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` ids: bounded by the parameter
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()  # of repeated ids one text
    rows.sort(key=lambda r: r.doc_id)
    return [r.text for r in rows], [int(r.quality) for r in rows]


class Verdict:
    """Applies a trained field to one text."""

    def __init__(self, w: np.ndarray, trans: np.ndarray, stock: frozenset[bytes] = frozenset(), share: float = SHARE):
        self.w, self.trans, self.stock, self.share = w, trans, stock, share

    def lines(self, text: str) -> list[int]:
        """Of each line with a word: 1 for content, 0 for boilerplate."""
        rows = chain(text.encode(), self.stock)[0]
        return viterbi((np.array(rows) @ self.w).tolist(), self.trans) if rows else []

    def __call__(self, text: str) -> tuple:
        raw = text.encode()
        words = raw.split()
        n = len(words)
        chars = len(text) - sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
        symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
        repeated = repeat_words(words)
        rows, sizes, dup = chain(raw, self.stock)
        failed = n < 50 or 100 * repeated > 50 * n
        content = 0
        if rows:
            content = sum(k for k, y in zip(sizes, viterbi((np.array(rows) @ self.w).tolist(), self.trans)) if y)
        kept = not failed and content >= self.share * n
        return n, chars, symbols, dup, repeated, failed, kept, content


FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long"


def field(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Verdict:
    return Verdict(*train(*sampled(docs, labels, sample)))


def line_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """FIELDS for each row of docs(doc_id, text); labels(doc_id, quality)."""
    verdict = field(docs, labels, sample)
    kinds = {"long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in FIELDS.split(", ")])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                s = b.slice(lo, 2000)
                rows = list(zip(*map(verdict, common.texts_of(s.column("text")))))
                if rows:
                    yield common.batch_of(schema, [s.column("doc_id"), *rows])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, FIELDS)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whose verdict is kept."""
    verdict = field(docs, labels, sample)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([verdict(x)[6] for x in common.texts_of(b.column(at))], type=pa.bool_()))

    return common.map_rows(docs, run, docs.schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
