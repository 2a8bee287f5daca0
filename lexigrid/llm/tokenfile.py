"""Token-ID files: ids of each document compressed on its own with one shared zstandard dictionary.

A file holds the dictionary's SHA-256, the documents' frames in ascending doc_id order (nulls first),
then an index (doc_id, null flag, byte offset, number of ids), so a short document can be read alone.
Ids take two bytes while they fit, else four. Each file is one task's, and a doc_id (or null) that many
rows have is dealt to several files by the hash of the text.

Nulls: a null text is empty (its ids are the end id), a null doc_id is kept and comes first. Ties: repeated
doc_ids are each kept, in the order of their texts' hashes. Long texts are one frame each. An empty table
gives no files and no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .encode import encoder

MAGIC = b"LXGRTOK1"
TAIL = struct.Struct("<QQ8s")
#: Bytes of frames that a reader takes at a time.
CHUNK = 8 << 20


def pack_ids(ids: bytes) -> bytes:
    """A width byte, then the ids in that many bytes each, little-endian."""
    a = np.frombuffer(ids, dtype="<u4")
    width = 2 if not len(a) or int(a.max()) < 1 << 16 else 4
    return bytes([width]) + a.astype(f"<u{width}").tobytes()


def unpack_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype("<u4")


def train_dictionary(samples: list[bytes], size: int = 64 * 1024) -> bytes:
    """A dictionary from serialized id arrays; too few samples to train on become its raw content."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class Writer:
    """One file under a name that no other task has; it counts only once a manifest names it, which is after close()."""

    def __init__(self, uri: str, dictionary_hash: bytes):
        self.uri, self.index, self.at = uri, [], len(MAGIC) + 32
        place, path = _place(uri)
        self.out = place.open_output_stream(path)
        self.out.write(MAGIC + dictionary_hash)

    def add(self, doc_id: int | None, n_tokens: int, frame: bytes) -> None:
        self.index.append((doc_id or 0, doc_id is None, self.at, n_tokens))
        self.out.write(frame)
        self.at += len(frame)

    def close(self) -> None:
        cols = list(zip(*self.index)) or [(), (), (), ()]
        for c, t in zip(cols, ("<i8", "u1", "<u8", "<u8")):
            self.out.write(np.array(c, dtype=t).tobytes())
        self.out.write(TAIL.pack(self.at, len(self.index), MAGIC))
        self.out.close()


class Reader:
    """Reads whole files or single documents by their place in the index."""

    def __init__(self, uri: str, dictionary: bytes):
        f, path = _place(uri)
        self.f = f.open_input_file(path)
        size = self.f.size()
        self.f.seek(size - TAIL.size)
        at, n, magic = TAIL.unpack(self.f.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.f.seek(at)
        raw = io.BytesIO(self.f.read(size - TAIL.size - at))
        self.doc_id = np.frombuffer(raw.read(8 * n), "<i8")
        self.is_null = np.frombuffer(raw.read(n), "u1")
        self.offset = np.append(np.frombuffer(raw.read(8 * n), "<u8"), at).astype(np.int64)
        self.n_tokens = np.frombuffer(raw.read(8 * n), "<u8").astype(np.int64)
        self.f.seek(len(MAGIC))
        if self.f.read(32) != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.z = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, i: int) -> np.ndarray:
        self.f.seek(int(self.offset[i]))
        return unpack_ids(self.z.decompress(self.f.read(int(self.offset[i + 1] - self.offset[i]))))

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order; the frames are read some megabytes at a time, not one by one."""
        lo, n = 0, len(self.doc_id)
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.offset, self.offset[lo] + CHUNK, side="right")) - 1)
            self.f.seek(int(self.offset[lo]))
            raw, base = memoryview(self.f.read(int(self.offset[hi] - self.offset[lo]))), int(self.offset[lo])
            for i in range(lo, hi):
                frame = raw[int(self.offset[i]) - base : int(self.offset[i + 1]) - base]
                yield None if self.is_null[i] else int(self.doc_id[i]), unpack_ids(self.z.decompress(frame))
            lo = hi


class Deal:
    """The part of each row, rising with (doc_id, tie): cuts at quantiles of doc_id, and values that fill several quantiles, and nulls, spread over as many parts by tie."""

    def __init__(self, quantiles: list[float], null_parts: int):
        self.cuts, times = np.unique(np.array(quantiles, dtype=np.float64), return_counts=True)
        # beyond 2 ** 53 several ids are one double: those aren't spread
        times = np.where(np.abs(self.cuts) < 2.0**53, times, 1)
        self.spread = np.concatenate(([1], times))  # of class k its first value, cuts[k - 1], fills so many parts
        self.base = null_parts + np.concatenate(([0], np.cumsum(np.where(self.spread > 1, self.spread + 1, 1))[:-1]))
        self.null_parts = null_parts
        self.parts = int(self.base[-1] + self.spread[-1] + 1)

    def __call__(self, keys: list[int | None], tie: np.ndarray) -> np.ndarray:
        null = np.array([k is None for k in keys], dtype=bool)
        x = np.array([k or 0 for k in keys], dtype=np.float64)
        share = (tie.astype(np.float64) + 2.0**63) / 2.0**64  # ties are signed, and rise in their own order
        k = np.searchsorted(self.cuts, x, side="right")
        out = self.base[k].copy()
        hot = self.spread[k] > 1
        first = np.zeros(len(x), dtype=bool)
        first[k > 0] = x[k > 0] == self.cuts[k[k > 0] - 1]
        at = np.minimum((share * self.spread[k]).astype(np.int64), self.spread[k] - 1)
        out[hot] += np.where(first[hot], at[hot], self.spread[k[hot]])
        out[null] = np.minimum((share[null] * self.null_parts).astype(np.int64), self.null_parts - 1)
        return out


def read_dictionary(folder: str) -> bytes:
    f, path = _place(f"{folder}/dictionary.zdict")
    with f.open_input_file(path) as h:
        return h.read()


def write_token_files(docs: DataFrame, vocab: str, end_id: int, folder: str | None = None, samples: int = 400, level: int = 3) -> tuple[DataFrame, str]:
    """Encode docs(doc_id, text), write the files; the manifest (part, path, n_docs, n_tokens) and the folder.

    The dictionary is trained on the ids of at most `samples` documents, of each at most the first
    20,000 characters; it bears on compression alone. Every document is written whole.
    """
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = folder or common.new_path(spark, "tokens")
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // (2 * samples)))) == 0).select(F.left("text", F.lit(20_000)).alias("t")).limit(samples)
    enc = encoder(vocab)
    raw = train_dictionary([pack_ids(x) for x in enc.encode([r.t or "" for r in some.collect()])]) if n else b""
    where, path = _place(folder)
    where.create_dir(path, recursive=True)
    with where.open_output_stream(f"{path}/dictionary.zdict") as h:
        h.write(raw)
    digest, end = hashlib.sha256(raw).digest(), struct.pack("<I", end_id)
    parts = max(1, docs.rdd.getNumPartitions())
    known = docs.where("doc_id is not null")
    cuts = known.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 and n else []
    nulls = n - known.count() if n else 0
    deal = Deal(cuts, -(-nulls * parts // max(1, n)) or 1)
    frames_schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("n_tokens", pa.int64()), ("frame", pa.binary())])

    def encode(batches):
        e, z = encoder(vocab), zstandard.ZstdCompressor(level=level, dict_data=_dictionary(raw), write_content_size=True)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                s = b.slice(lo, 1000)
                ids = [x + end for x in e.encode(common.texts_of(s.column("text")))]
                part = deal(s.column("doc_id").to_pylist(), s.column("tie").to_numpy(zero_copy_only=False))
                yield common.batch_of(frames_schema, [part.astype(np.int32), s.column("doc_id"), s.column("tie"), [len(x) // 4 for x in ids], [z.compress(pack_ids(x)) for x in ids]])

    frames = common.map_arrow(docs.withColumn("tie", F.xxhash64("text")), encode, "part int, doc_id long, tie long, n_tokens long, frame binary")
    placed = frames.repartitionById(deal.parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie")
    manifest_schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches):
        part, w, tokens = None, None, 0

        def done():
            w.close()
            return common.batch_of(manifest_schema, [[part], [w.uri], [len(w.index)], [tokens]])

        for b in batches:
            for p, d, k, frame in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "frame"))):
                if p != part:
                    if w is not None:
                        yield done()
                    part, tokens = p, 0
                    w = Writer(f"{folder}/part-{p:06d}-{uuid.uuid4().hex[:8]}.tok", digest)
                w.add(d, k, frame)
                tokens += k
        if w is not None:
            yield done()

    # A retried task writes another file; only files in the written manifest count.
    return common.written(common.map_arrow(placed, write, "part int, path string, n_docs long, n_tokens long"), "manifest"), folder


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    # one row per file: this window is over the manifest alone
    starts = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    raw = read_dictionary(folder)

    def read(batches):
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                r = Reader(path, raw)
                rows = []
                for doc_id, ids in r:
                    rows.append((doc_id, base, len(ids), zlib.crc32(ids.tobytes())))
                    base += len(ids)
                if rows:
                    yield common.batch_of(schema, list(zip(*rows)))

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2)
    spread = starts.repartitionById(n, F.pmod(F.col("part"), F.lit(n)).cast("int"))
    return common.map_arrow(spread, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .encode import vocabulary

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(*write_token_files(docs, vocabulary("byte_bpe_50k.json"), 2))
