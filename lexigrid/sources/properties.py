"""Collection properties as a JSON document and as a one-row table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "documents long, occurrences long, avg_document_size double, max_document_size int, skip_block_size int, quantized_scores map<string, struct<type:string, bits:int, min:double, max:double>>, shard_count int"
REQUIRED = ("documents", "occurrences", "avg_document_size", "max_document_size")
SCORE_TYPES = ("bm25", "ql")


def from_json(raw: str) -> dict:
    """Checked properties; a missing required key is an error, scores of an unknown type are left out, shard_count may be missing."""
    got = json.loads(raw)
    if missing := [k for k in REQUIRED if k not in got]:
        raise ValueError(f"properties lack {', '.join(missing)}")
    scores = {n: s for n, s in (got.get("quantized_scores") or {}).items() if s.get("type") in SCORE_TYPES}
    return {k: got.get(k) for k in (*REQUIRED, "skip_block_size")} | {"quantized_scores": scores, "shard_count": got.get("shard_count")}


def to_json(properties: dict) -> str:
    return json.dumps({k: v for k, v in properties.items() if v is not None}, sort_keys=True)


def to_table(spark: SparkSession, properties: dict) -> DataFrame:
    row = {k: properties.get(k) for k in (*REQUIRED, "skip_block_size", "shard_count")}
    scores = {n: (s["type"], s["bits"], float(s["min"]), float(s["max"])) for n, s in (properties.get("quantized_scores") or {}).items()}
    return spark.createDataFrame([(*(row[k] for k in (*REQUIRED, "skip_block_size")), scores, row["shard_count"])], SCHEMA)
