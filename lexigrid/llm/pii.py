"""Personal data by information-theoretic sanitisation.

Protected entities are the values that four patterns find (the base spans). All terms of the documents that
an entity stands in, however far from it, are weighed by what they reveal of it over the whole corpus:
PMI(e; t) = ln(df(e, t) N / (df(e) df(t))) against the entity's own information IC(e) = ln(N / df(e)).
A term that stands beside the entity in at least `SUPPORT` documents, or in all of the entity's where these
are fewer, with PMI >= `ALPHA` IC and PMI >= `FLOOR`, discloses the entity; its places in the entity's documents become spans of kind "term".
As df(e, t) is at most df(e), PMI is at most ln(N / df(t)): pairs of terms too frequent to reach the thresholds
are left out before they are counted, which takes no disclosing pair away.
Base spans always stay. sanitise() generalises base spans and terms with digits to their kind's name and removes the other terms.

Terms of any length count. The searches are linear in the text, long ones included. Nulls: a null text has no spans; null and repeated doc_ids are
rows like any other (every row counts as a document); an empty table gives no rows; columns other than
doc_id and text, whatever their names, aren't read, but sanitise() returns all. Ties: spans that begin at
one place go by kind as listed, and a PMI that equals a threshold discloses.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT, ALPHA, FLOOR = 2, 0.9, 3.0
#: Bytes from which on a term stands in the statistics by its digest.
LONG = 200
#: Distinct terms that a task holds before it passes them on.
HELD = 400_000
#: Bits of the filter of terms whose counts are asked for: one megabyte.
FILTER_BITS = 1 << 23

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")
#: Lower-cases A-Z and blanks the marks that cling to words, so bytes.split() gives terms.
_TERMS = bytes(32 if chr(b) in ".,;:!?()[]\"'|" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_TERM = re.compile(r"[^\x20\x09-\x0D.,;:!?()\[\]\"'|]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
            at = text.find("@", last)
        else:
            # the run before this sign can't belong to a later match: the sign is no local character
            last, at = at + 1, text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, in the order of the digest; kinds as in KINDS."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_small, m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = _NOT_DIGIT.sub("", m.group())
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def entity(kind: int, value: str) -> str:
    """An entity's name in the statistics: a digest, so no table between holds the value."""
    plain = value.translate(_LOWER) if kind == 0 else value if kind == 1 else _NOT_DIGIT.sub("", value)
    return hashlib.sha256(f"{kind}:{plain}".encode()).hexdigest()[:32]


def free_terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of all terms that touch no base span."""
    # the spans' union as disjoint intervals: whether a term touches one is a binary search
    starts: list[int] = []
    ends: list[int] = []
    for s, _, e in spans:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out = []
    for m in _TERM.finditer(text):
        a, b = m.span()
        i = bisect_left(starts, b) - 1  # the last interval that begins before the term's end
        if i < 0 or ends[i] <= a:
            out.append((named(m.group().translate(_LOWER).encode()), a, b))
    return out


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the terms beside each base span."""
    terms = free_terms(text, spans)
    return [(name, *x) for s, k, e in spans for name in [entity(k, text[s:e])] for x in terms]


def named(term: bytes) -> str:
    """A term as it stands in the statistics; of very long ones (over `LONG` bytes) a digest, so no row grows with them."""
    return term.decode("utf-8", "replace") if len(term) <= LONG else "sha256 " + hashlib.sha256(term).hexdigest()


_SCAN = "pid int, row long, doc_id long, text_key binary, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<s:int,k:int,e:int>>, entities array<string>, near array<struct<term:string,s:int,e:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """The base spans, their distinct entities and the terms beside them, a row for each row of docs(doc_id, text); written."""
    base_t = pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())])
    near_t = pa.struct([("term", pa.string()), ("s", pa.int32()), ("e", pa.int32())])
    schema = pa.schema([("pid", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.binary()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("base", pa.list_(base_t)), ("entities", pa.list_(pa.string())), ("near", pa.list_(near_t))])

    def run(batches):
        pid, row = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                s = b.slice(lo, 2000)
                rows = []
                for doc_id, text in zip(s.column("doc_id").to_pylist(), common.texts_of(s.column("text"))):
                    spans = base_spans(text)
                    n = Counter(k for _, k, _ in spans)
                    near = free_terms(text, spans) if spans else []
                    rows.append(
                        (pid, row, doc_id, hashlib.sha256(text.encode()).digest()[:16] if spans else None, n[0], n[1], n[2], n[3], hashlib.sha256(digest(spans).encode()).hexdigest(),
                         [{"s": a, "k": k, "e": z} for a, k, z in spans], sorted({entity(k, text[a:z]) for a, k, z in spans}), [{"term": t, "s": a, "e": z} for t, a, z in near])
                    )
                    row += 1
                if rows:
                    yield common.batch_of(schema, list(zip(*rows)))

    return common.written(common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, _SCAN), "pii-scan")


def _slot(term: str) -> int:
    return zlib.crc32(term.encode()) & (FILTER_BITS - 1)


def term_filter(terms: DataFrame) -> bytes:
    """A bit for each hash of terms(term), FILTER_BITS in all whatever the number of terms: tasks' bits are joined in two levels."""
    schema = pa.schema([("pid", pa.int64()), ("bits", pa.binary())])

    def fill(batches):
        bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for b in batches:
            at = np.array([_slot(t) for t in b.column("term").to_pylist()], dtype=np.int64)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield common.batch_of(schema, [[TaskContext.get().partitionId()], [bits.tobytes()]])

    def join(batches):
        bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for b in batches:
            for raw in b.column("bits").to_pylist():
                bits |= np.frombuffer(raw, dtype=np.uint8)
        yield common.batch_of(schema, [[TaskContext.get().partitionId()], [bits.tobytes()]])

    level = common.map_arrow(common.map_arrow(terms.select("term"), fill, "pid long, bits binary").repartition(16, "pid"), join, "pid long, bits binary")
    return common.map_arrow(level.repartition(1), join, "pid long, bits binary").first().bits


def document_frequencies(docs: DataFrame, bits: bytes | None = None) -> DataFrame:
    """term, df: in how many rows of docs each term stands; partial counts leave the tasks.

    With a filter of term_filter() only terms that it may hold leave them (all that it was made of are among these).
    """
    schema = pa.schema([("term", pa.string()), ("df", pa.int64())])
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(bits)  # None or FILTER_BITS / 8 bytes

    def run(batches):
        counts: Counter = Counter()
        mask = None if sent.value is None else np.frombuffer(sent.value, dtype=np.uint8)

        def flush():
            keys, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            if mask is not None:
                at = np.array([zlib.crc32(k) & (FILTER_BITS - 1) if len(k) <= LONG else _slot(named(k)) for k in keys], dtype=np.int64)
                kept = np.flatnonzero(mask[at >> 3] >> (at & 7) & 1)
                keys, n = [keys[i] for i in kept.tolist()], n[kept]
            keys = list(map(named, keys))
            counts.clear()
            return common.batch_of(schema, [keys, n])

        for b in batches:
            for raw in common.raw_texts(b.column("text")):
                counts.update(set(raw.translate(_TERMS).split()))
                if len(counts) > HELD:
                    yield flush()
        if counts:
            yield flush()

    return common.map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def disclosing(scanned: DataFrame, docs: DataFrame, support: int = SUPPORT, alpha: float = ALPHA, floor: float = FLOOR) -> DataFrame:
    """pid, row, term: the terms of each row that are over the disclosure threshold with one of its entities. Written."""
    n = F.lit(float(max(scanned.count(), 1)))
    entities = scanned.where(F.size("near") > 0).select("pid", "row", F.explode("entities").alias("entity"))
    entities = entities.join(entities.groupBy("entity").agg(F.count("*").alias("df_e")), "entity")
    terms = scanned.where(F.size("near") > 0).select("pid", "row", F.explode(F.array_distinct(F.transform("near", lambda x: x["term"]))).alias("term"))
    df_t = document_frequencies(docs, term_filter(terms))
    # PMI is at most `most`: a term that can't reach the floor, or an entity's threshold, pairs with nothing
    most, ic = F.ln(n / F.col("df")), F.ln(n / F.col("df_e"))
    slack = F.lit(1e-9)
    terms = terms.join(df_t.where(most + slack >= F.lit(floor)), "term")
    beside = common.written(entities.join(terms, ["pid", "row"]).where(most + slack >= F.lit(alpha) * ic), "pii-pairs")
    pairs = beside.groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("df_e").alias("df_e"), F.first("df").alias("df"))
    pmi = F.ln(F.col("both") * n / (F.col("df_e") * F.col("df")))
    over = pairs.where((F.col("both") >= F.least(F.lit(support), "df_e")) & (pmi >= F.lit(alpha) * ic) & (pmi >= F.lit(floor))).select("entity", "term")
    out = common.written(beside.join(over, ["entity", "term"], "left_semi").select("pid", "row", "term").distinct(), "pii-disclosing")
    common.drop_written(beside)
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, text_key for each row of docs."""
    scanned = scan(docs)
    flagged = disclosing(scanned, docs)
    # only rows with a disclosing term give their terms' places
    near = scanned.where(F.size("near") > 0).join(flagged.select("pid", "row").distinct(), ["pid", "row"], "left_semi").select("pid", "row", F.explode("near").alias("x")).select("pid", "row", "x.*")
    terms = near.join(flagged, ["pid", "row", "term"], "left_semi").groupBy("pid", "row").agg(F.collect_set(F.struct("s", F.lit(4).alias("k"), "e")).alias("terms"))
    bare = scanned.drop("near", "entities")
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    # rows without base spans have no terms: they don't go through the join
    with_terms = bare.where(F.size("base") > 0).join(terms, ["pid", "row"], "left").withColumn("terms", F.coalesce("terms", none))
    rows = with_terms.unionByName(bare.where(F.size("base") == 0).withColumn("terms", none))
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform(F.array_sort(F.concat("base", "terms")), lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), F.size("terms").cast("long").alias("n_term"), "text_key")


def apply_spans(text: str, spans: str) -> str:
    """text with its spans generalised or removed; of spans that overlap, the later is cut to what the earlier leaves."""
    out, done = [], 0
    for x in spans.split(","):
        kind, s, e = x.split(":")
        s, e = max(int(s), done), int(e)
        if s >= e:
            continue
        out.append(text[done:s])
        if kind != "term":
            out.append(f"<{kind.upper()}>")
        elif _DIGIT.search(text, s, e):
            out.append("<NUMBER>")
        done = e
    out.append(text[done:])
    return "".join(out)


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with all columns, their texts sanitised; n_chars, where there is one, follows the new text."""
    found = personal_data(docs).where("spans <> ''").select("text_key", "spans").dropDuplicates(["text_key"])
    key = F.unhex(F.substring(F.sha2(F.encode("text", "UTF-8"), 256), 1, 32))
    # equal texts have equal spans, so spans are joined by the text's key; docs may have any keys of its own
    marked = docs.select(F.struct(*map(common.col, docs.columns)).alias("doc"), key.alias("text_key"))
    joined = marked.join(found, "text_key", "left").select("doc.*", F.col("spans").alias(common.free_name(docs, "spans")))
    at = docs.columns.index("text")
    types = docs.schema
    sized = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            spans = b.column(b.num_columns - 1).to_pylist()
            if any(spans):
                texts = [apply_spans(t, s) if s else t for t, s in zip(cols[at].to_pylist(), spans)]
                if sized is not None:
                    sizes = [len(t) if s else n for t, s, n in zip(texts, spans, cols[sized].to_pylist())]
                    cols[sized] = pa.array(sizes, type=cols[sized].type)
                cols[at] = pa.array(texts, type=cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=types.names)

    return common.map_rows(joined, run, types)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")
