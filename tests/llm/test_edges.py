"""Repeated rows, very long texts, columns of clashing names, and base columns against SQL."""

import random

import duckdb
import pytest

from lexigrid.llm import attribution, common, decontaminate, licenses, lm, packing, pii, quality, queries, simhash, substring, tokenfile
from lexigrid.llm.encode import vocabulary

D = "/root/testdata/sf0.001"
NAMES = ["__fp", "__spans", "spans", "kept_id", "Fingerprint", "fingerprint_", "shard", "root", "a.b", "c0", "text_key"]


@pytest.fixture(scope="module")
def clashing(spark):
    r = random.Random(11)
    long = " ".join(f"w{r.randrange(3000)}" for _ in range(60_000))
    body = "\n".join(" ".join(f"v{r.randrange(400)}" for _ in range(20)) for _ in range(8)) + " mail me@some.example.com now"
    rows = [(1, long), (2, long + " tail"), (3, body), (3, body), (3, "other text " * 40), (4, body), (None, body), (None, None), (5, ""), (5, None), (6, body.replace("v1 ", "z "))]
    schema = ", ".join(["doc_id long", "text string", *(f"`{n}` int" for n in NAMES)])
    return spark.createDataFrame([(*x, *range(len(NAMES))) for x in rows], schema).repartition(3)


def test_row_wise_operators_keep_every_row(spark, clashing):
    n = clashing.count()
    labels = spark.read.parquet(f"{D}/labels.parquet")
    assert quality.line_quality(clashing, labels).count() == n
    assert pii.personal_data(clashing).count() == n and simhash.near_duplicates(clashing).count() == n and lm.score(clashing).count() == n
    assert tokenfile.read_token_files(*tokenfile.write_token_files(clashing, vocabulary("byte_bpe_50k.json"), 2)).count() == n
    pieces = packing.pack(clashing, vocabulary("word_bpe_49k.json"), 1).collect()
    assert sum(p.start == 0 for p in pieces) == n
    assert {r.doc_id for r in attribution.section_tokens(clashing, vocabulary("byte_bpe_50k.json")).collect()} == {1, 2, 3, 4, None, 6}
    assert licenses.scan_licenses(clashing).count() == 0
    got = {(r.doc_id, r.class_id) for r in substring.repeated_passages(clashing).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (6, 3)} == got


def test_stages_return_all_columns(spark, clashing):
    labels, bench = spark.read.parquet(f"{D}/labels.parquet"), spark.read.parquet(f"{D}/benchmark.parquet")
    for out in (quality.keep_good(clashing, labels), simhash.keep_one(clashing), decontaminate.remove(clashing, bench), pii.sanitise(clashing)):
        rows = out.collect()
        assert out.columns == clashing.columns and rows and all(tuple(r)[2:] == tuple(range(len(NAMES))) for r in rows)
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in simhash.keep_one(clashing.where("doc_id in (3, 4, 5)")).collect()) == [(3, "other"), (3, rows_of(clashing, 4)[:5]), (5, "")]
    assert pii.sanitise(clashing).where("text like '%@%'").count() == 0


def rows_of(df, doc_id):
    return df.where(f"doc_id = {doc_id}").first().text


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, clashing):
    pipeline = pytest.importorskip("corpus_pipeline")
    for docs in (odd, empty, clashing):
        out = docs
        for _, stage in pipeline.STAGES[:4]:
            out = common.written(stage(spark, out.select("doc_id", "text"), D), "t")
            assert out.columns == ["doc_id", "text"]
        pipeline.STAGES[4][1](spark, out, D).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_base_columns_equal_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    want, got = c.sql(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, D).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda df: sorted(tuple(round(float(x), 6) for x in r) for r in df[columns].itertuples(index=False, name=None))
    assert plain(got) == plain(want)
