"""Token counts by section: offset-mapped attribution.

Each document is encoded once, whole. Its tokens' character spans are joined, as intervals, to the spans
of its sections (by default lines, each with its line end; or the fields of a document that field_tokens()
puts together). A token that crosses a boundary goes to one section by the rule:
"most" - the section with most of its characters, of equals the first (the default);
"start" - the section of its first character; "end" - of its last.
A token without characters (a later part of one character) goes where the character's first token goes.

Nulls: a null text is empty and has no section, so no row; null or repeated doc_ids are rows like any
other; an empty table gives no rows. Long texts are encoded whole, in time linear in them. Ties: a token that
two sections share alike goes to the first. Other columns are not read.
"""

from __future__ import annotations

from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encode import Encoder, encoder

RULES = ("most", "start", "end")
CACHE = 250_000


class _Ends(dict):
    """Piece -> where its tokens start and end, in characters from the piece's start (packed arrays)."""

    def __init__(self, e: Encoder):
        self.e = e

    def __missing__(self, piece: str) -> tuple[int, bytes, bytes]:
        body = piece[1:] if piece[0] == " " else piece
        if body.isascii() and body.isalpha():
            # one pre-token of one-byte characters: the library's model alone tells where its tokens end
            ends, at = [], 0
            for t in self.e.tokenizer.model.tokenize("Ġ" + body if len(body) < len(piece) else body):
                at += len(t.value)
                ends.append(at)
            n = len(ends)
            out = (n, pack(f"<{n}q", 0, *ends[:-1]), pack(f"<{n}q", *ends))
        else:
            offsets = self.e.tokenizer.encode(piece, add_special_tokens=False).offsets
            n = len(offsets)
            out = (n, pack(f"<{n}q", *[a for a, _ in offsets]), pack(f"<{n}q", *[z for _, z in offsets]))
        if len(self) >= CACHE:
            self.clear()
        if len(piece) <= 40:
            self[piece] = out
        return out


_ends: dict[int, _Ends] = {}


def token_spans(e: Encoder, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the tokens of a whole text, blanks that a token holds included."""
    pieces = e.pieces(text)
    if pieces is None:
        a = np.array(e.tokenizer.encode(text, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
        return a[:, 0], a[:, 1]
    table = _ends.setdefault(id(e), _Ends(e))
    got = list(map(table.__getitem__, pieces))
    n = np.fromiter((g[0] for g in got), np.int64, len(got))
    at = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    base = np.repeat(np.concatenate(([0], at[:-1])), n)
    return np.frombuffer(b"".join([g[1] for g in got]), np.int64) + base, np.frombuffer(b"".join([g[2] for g in got]), np.int64) + base


def allocate(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str = "most") -> np.ndarray:
    """Of tokens [start, end), the section of each; section k is [bounds[k], bounds[k + 1])."""
    last = len(bounds) - 2
    a = np.clip(np.searchsorted(bounds, start, side="right") - 1, 0, last)
    z = np.maximum(a, np.clip(np.searchsorted(bounds, end - 1, side="right") - 1, 0, last))
    if rule == "start":
        return a
    if rule == "end":
        return z
    out = a.copy()
    for i in np.flatnonzero(a != z).tolist():
        k = np.arange(a[i], z[i] + 1)
        shared = np.minimum(end[i], bounds[k + 1]) - np.maximum(start[i], bounds[k])
        out[i] = k[int(np.argmax(shared))]
    return out


def line_bounds(text: str) -> np.ndarray:
    """Where the lines begin, and the text's end; each line holds its line end."""
    out, at = [0], text.find("\n")
    while at >= 0:
        if at + 1 < len(text):
            out.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array([*out, len(text)])


COUNTS = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long"


def section_tokens(docs: DataFrame, vocab: str, rule: str = "most", bounds_of=line_bounds) -> DataFrame:
    """COUNTS: for each section of each row of docs(doc_id, text) its span, tokens and how many of them cross its bounds."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    schema = pa.schema([(x.split()[0], pa.int64()) for x in COUNTS.split(", ")])

    def run(batches):
        e = encoder(vocab)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                s = b.slice(lo, 500)
                ids, sections, starts, ends, counts, crossing = [], [], [], [], [], []
                for d, text in zip(s.column("doc_id").to_pylist(), common.texts_of(s.column("text"))):
                    if not text:
                        continue
                    a, z = token_spans(e, text)
                    bounds = bounds_of(text)
                    k = allocate(a, z, bounds, rule)
                    n = len(bounds) - 1
                    ids += [d] * n
                    sections.append(np.arange(n))
                    starts.append(bounds[:-1])
                    ends.append(bounds[1:])
                    counts.append(np.bincount(k, minlength=n))
                    crossing.append(np.bincount(k[(a < bounds[k]) | (z > bounds[k + 1])], minlength=n))
                if ids:
                    yield common.batch_of(schema, [ids, *(np.concatenate(x).astype(np.int64) for x in (sections, starts, ends, counts, crossing))])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, COUNTS)


def field_tokens(rows: DataFrame, fields: list[str], vocab: str, id_column: str = "doc_id", separator: str = "\n", rule: str = "most") -> DataFrame:
    """Tokens of each field of a row, of the fields joined by a separator that belongs to the field before it: id, field, n_tokens. Null fields are empty."""
    schema = pa.schema([("id", pa.int64()), ("field", pa.string()), ("n_tokens", pa.int64())])
    picked = rows.select(F.col(id_column).cast("long").alias("id"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)])

    def run(batches):
        e = encoder(vocab)
        for b in batches:
            out = []
            for d, *parts in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                whole = separator.join(parts)
                sizes = [len(p) + len(separator) for p in parts]
                sizes[-1] -= len(separator)
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                n = np.bincount(allocate(*token_spans(e, whole), bounds, rule), minlength=len(parts)) if whole else np.zeros(len(parts), int)
                out += [(d, f, int(k)) for f, k in zip(fields, n)]
            if out:
                yield common.batch_of(schema, list(zip(*out)))

    return common.map_arrow(picked, run, "id long, field string, n_tokens long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .encode import vocabulary

    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))
