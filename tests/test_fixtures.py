"""Golden values: a mini collection and the operators' primitives."""

import gzip
import io
import math
import random

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import analysis, scoring
from lexigrid.operators import collection, evaluation, retrieval
from lexigrid.operators import index as ix_
from lexigrid.sources import properties, text
from lexigrid.streaming import incremental


@pytest.fixture(scope="module")
def small(spark):
    docs = [(0, "d0", ["a", "b", "a"]), (1, "d1", ["c", "b", "b"]), (2, "d2", [])]
    return ix_.build_index(spark.createDataFrame(docs, "doc_id long, title string, terms array<string>"))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_builder(small):
    assert rows(small.postings, "term", "doc_id", "tf") == [("a", 0, 2), ("b", 0, 1), ("b", 1, 2), ("c", 1, 1)]
    assert rows(small.lexicon, "term_id", "term", "df", "cf") == [(0, "a", 1, 2), (1, "b", 2, 3), (2, "c", 1, 1)]
    assert rows(small.documents, "doc_id", "size") == [(0, 3), (1, 3), (2, 0)]
    p = small.properties.first()
    assert (p.documents, p.occurrences, p.avg_document_size, p.max_document_size) == (3, 6, 2.0, 3)


def test_empty_collection(spark):
    ix = ix_.build_index(spark.createDataFrame([], "doc_id long, title string, terms array<string>"))
    p = ix.properties.first()
    assert (p.documents, p.occurrences, p.avg_document_size, p.max_document_size) == (0, 0, 0.0, 0)
    q = spark.createDataFrame([(0, 0, "a")], "qid long, pos int, term string")
    assert retrieval.search(ix, q).count() == 0 and ix.lexicon.count() == 0


def test_read_collection(spark, tmp_path):
    (tmp_path / "c.txt").write_text("Doc0 Lorem  ipsum\tdolor.\nDoc1\nSpam x y\nDoc2 ipsum\n")
    spam = spark.createDataFrame([("Spam",)], "title string")
    got = text.read_collection(spark, str(tmp_path / "c.txt"), spam)
    assert [(r.doc_id, r.title, r.terms) for r in got.orderBy("doc_id").collect()] == [(0, "Doc0", ["Lorem", "ipsum", "dolor."]), (1, "Doc1", []), (2, "Doc2", ["ipsum"])]


def test_scorers(spark):
    df = spark.createDataFrame([(2, 8, 4, 4, 10, 88, 8.8, 11)], "tf int, len int, df long, cf long, n long, c long, avgdl double, maxlen int")
    r = df.select(*[scoring.scorer(s).alias(s) for s in scoring.SCORERS]).first()
    idf = max(1e-6, math.log(6.5 / 4.5))
    assert r.bm25 == pytest.approx(2 * idf * 2.2 / (2 + 0.6 + 0.6 / 8.8 * 8))
    g = 2500 * 4 / 88
    assert r.ql == pytest.approx(math.log(2 + g) - math.log(2508) - (math.log(1 + g) - math.log(2511)))
    assert r.tfidf == pytest.approx(2 * math.log(10 / 5)) and r["count"] == 2
    with pytest.raises(ValueError):
        scoring.scorer("*unknown")


def test_top_k_of_lists(spark):
    lists = [(0, 3, 7.0), (1, 0, 3.0), (1, 2, 11.0), (1, 6, 12.0), (2, 2, 3.5), (2, 3, 4.5), (2, 6, 7.5), (2, 12, 18.0)]
    scored = spark.createDataFrame([(f"t{a}", b, c) for a, b, c in lists], "term string, doc_id long, score double")
    q = spark.createDataFrame([(0, i, f"t{i}") for i in range(3)], "qid long, pos int, term string")
    got = retrieval.top_k(retrieval.accumulate(q, scored), 3).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(6, 19.5), (12, 18.0), (2, 14.5)]
    twice = retrieval.accumulate(q.unionByName(q), scored)
    assert {r.doc_id: r.score for r in twice.collect()}[6] == 39.0


def test_thresholds(spark):
    lists = [(0, [0, 3, 6]), (1, [0, 1, 3])]
    scored = spark.createDataFrame([(f"t{t}", x, float(s)) for t, ds in lists for x, s in zip(ds, (3, 1, 2))], "term string, doc_id long, score double")
    q = spark.createDataFrame([(0, i, f"t{i}") for i in range(2)], "qid long, pos int, term string")
    acc = retrieval.accumulate(q, scored)
    t = retrieval.thresholds(retrieval.top_k(acc, 3), 3)
    assert t.first().threshold == 2 and retrieval.count_above(acc, t).first().documents == 3
    assert retrieval.thresholds(retrieval.top_k(acc, 9), 9).first().threshold is None


def test_score_at_a_time(spark):
    scored = spark.createDataFrame([("a", 0, 3.0), ("a", 1, 3.0), ("a", 2, 3.0), ("b", 1, 3.0)], "term string, doc_id long, score double")
    q = spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "qid long, pos int, term string")
    got = lambda share: [(r.doc_id, r.score) for r in retrieval.score_at_a_time(q, scored, 2, share).orderBy("rank").collect()]
    assert got(1.0) == [(1, 6.0), (0, 3.0)]
    assert sum(s for _, s in got(0.5)) == 6.0


@pytest.mark.parametrize("ends, bounds, cases", [((0, 100), (0, 10), {0: 0, 10: 1, 70: 7, 100: 10}), ((-10, 90), (0, 10), {-10: 0, 0: 1, 60: 7, 90: 10}), ((-10, 90), (1, 11), {-10: 1, 0: 2, 60: 8, 90: 11}), ((-10, 90), (2, 12), {-10: 2, 0: 3, 60: 9, 90: 12, 100: 13, -20: 1})])
def test_quantiser(spark, ends, bounds, cases):
    df = spark.createDataFrame([(float(x),) for x in cases], "x double")
    got = {r.x: r.q for r in df.select("x", scoring.quantize(F.col("x"), F.lit(float(ends[0])), F.lit(float(ends[1])), *bounds).alias("q")).collect()}
    assert got == cases


def test_score_stats(spark):
    scored = spark.createDataFrame([(f"t{t}", i, 12.0 * (i + 1)) for t in range(3) for i in range(t + 1)], "term string, doc_id long, score double")
    assert rows(ix_.score_stats(scored), "term", "max", "mean", "var") == [("t0", 12, 12, 0), ("t1", 24, 18, 36), ("t2", 36, 24, 96)]


def test_sizes_need_64_bits(spark):
    a = spark.createDataFrame([(12,), (500,), (2147483646,)], "size int")
    p = ix_.collection_properties(a.unionByName(spark.createDataFrame([(4,), (1,), (2,)], "size int"))).first()
    assert (p.documents, p.avg_document_size, p.max_document_size) == (6, 357914027.5, 2147483646)


def test_shards(spark):
    mapping = [0, 1, 2, 2, 1, 0, 1, 1, 2, 0]
    s = spark.createDataFrame(list(enumerate(mapping)), "doc_id long, shard_id int")
    assert [r.local_doc_id for r in collection.local_ids(s).orderBy("doc_id").collect()] == [0, 0, 0, 1, 1, 1, 2, 3, 2, 2]


def test_reorder(spark, small):
    order = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, rank long")
    moved = collection.reorder(small, order)
    assert rows(moved.postings, "term", "doc_id", "tf") == [("b", 0, 2), ("c", 0, 1)]
    assert rows(moved.lexicon, "term_id", "term", "df", "cf") == [(0, "a", 0, 0), (1, "b", 1, 2), (2, "c", 1, 1)]
    assert moved.properties.first().documents == 2 and collection.reorder(small, order, recompute=False).properties.first().documents == 3


def test_merge_equals_whole(spark):
    r = random.Random(17)
    docs = [(i, f"d{i}", [r.choice("abcdefgh") for _ in range(r.randrange(9))]) for i in range(30)]
    build = lambda some: ix_.build_index(spark.createDataFrame([(i, t, x) for i, (_, t, x) in enumerate(some)], "doc_id long, title string, terms array<string>"))
    whole, merged = build(docs), collection.merge([build(docs[:11]), build(docs[11:12]), build(docs[12:])])
    for table in ("postings", "lexicon", "documents", "properties"):
        a, b = getattr(whole, table), getattr(merged, table)
        assert rows(a, *a.columns) == rows(b, *a.columns)


def test_save_and_load(spark, small, tmp_path):
    assert ix_.add_quantized(small, "bm25", 8) == "bm25-8" and ix_.max_scores(small.scores["bm25-8"]).count() == 3
    small.save(str(tmp_path / "ix"))
    again = ix_.Index.load(spark, str(tmp_path / "ix"), ("bm25-8",))
    q = spark.createDataFrame([(0, 0, "b")], "qid long, pos int, term string")
    assert retrieval.search(again, q, 2, "bm25-8").count() == 2
    with pytest.raises(ValueError):
        ix_.Index.load(spark, str(tmp_path / "ix"), ("ql-8",))
    with pytest.raises(ValueError):
        retrieval.search(again, q, 2, "ql-8")


def test_cluster_on_disk(spark, small, tmp_path):
    shards = small.documents.select("doc_id", F.pmod("doc_id", F.lit(2)).cast("int").alias("shard_id"))
    collection.write_cluster(small, shards, str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c/postings"))
    assert rows(back, "term", "doc_id", "tf") == rows(small.postings, "term", "doc_id", "tf")
    assert back.where("shard_id = 1").count() == 2
    opened = collection.open_cluster(spark, str(tmp_path / "c"), [1])
    assert opened["postings"].count() == 2 and opened["documents"].first().local_doc_id == 0 and opened["lexicon"].count() == 3
    assert "PartitionFilters: [isnotnull(shard_id" in opened["postings"]._jdf.queryExecution().toString()


def test_line_filter_and_parts(spark):
    lines = spark.createDataFrame([(i, f"l{i}") for i in range(7)], "line_no long, value string")
    for wanted in ([], list(range(7)), [0, 6], [3], [0, 2, 4, 6]):
        assert rows(text.filter_lines(lines, spark.createDataFrame([(x,) for x in wanted], "line_no long")), "line_no") == [(x,) for x in wanted]
    parts = text.part_lines(lines, 3, ["line_no"]).collect()
    assert sorted((r.part, r.line_in_part, r.value) for r in parts)[3] == ("part-0001", 0, "l3")


RECORD = "WARC/0.18\r\nWARC-Type: {kind}\r\nWARC-TREC-ID: id\r\nno colon here\r\n\r\n{status}Content-Length: {n}\r\n\r\n{body}\r\n\r\n"


def test_warc(spark, tmp_path):
    raw = (RECORD.format(kind="warcinfo", status="", n=10, body="Content...") + RECORD.format(kind="response", status="HTTP/1.1 200 OK\r\n", n=10, body="Content...")).encode()
    got = list(text.warc_records(io.BytesIO(raw)))
    assert [(v, h["Content-Length"], c) for v, _, h, c in got] == [("0.18", "10", b"Content...")] * 2 and "no colon here" not in got[0][1]
    assert list(text.warc_records(io.BytesIO(b""))) == []
    with pytest.raises(text.WarcError):
        list(text.warc_records(io.BytesIO(b"WRAC/1\r\n\r\n")))
    with pytest.raises(text.WarcError):
        list(text.warc_records(io.BytesIO(RECORD.format(kind="response", status="HTTP/1.1 200 OK\r\n", n="x", body="").encode())))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "b.warc").write_bytes(raw)
    records = text.read_warc(spark, str(tmp_path / "*"))
    assert records.count() == 4 and text.warc_extract(records).first().trec_id == "id"


def test_html():
    page = "<html><script>var x='<p>';</script><style>p{}</style><p>Hello &amp; <b>you</b></p><!-- no --><p>two</p>"
    assert text.clean_html(page) == "Hello & you two" and text.clean_html(None) is None and text.clean_html("") == ""


STEMS = {
    "getting": "get", "consign": "consign", "consigned": "consign", "consistency": "consist", "knackeries": "knackeri", "knightly": "knight", "caresses": "caress", "ponies": "poni", "ties": "tie",
    "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "luxuriated": "luxuri", "hopping": "hop", "hoping": "hope", "hope": "hope", "by": "by", "say": "say", "cry": "cri",
    "relational": "relat", "rational": "ration", "generalization": "general", "communication": "communic", "sky": "sky", "dying": "die", "succeeding": "succeed", "herring": "herring", "falling": "fall", "bed": "bed", "beautiful": "beauti",
    "skies": "sky", "agreed": "agre", "feed": "feed", "adoption": "adopt", "rate": "rate", "controll": "control", "youth": "youth", "boy": "boy", "o'clock's": "o'clock", "be": "be",
}


def test_porter2():
    assert {w: analysis.stem(w) for w in STEMS} == STEMS


def test_bits_and_clock(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (4,), (8,)], "n long")
    assert [r.b for r in df.select(analysis.nbits(F.col("n")).alias("b")).collect()] == [0, 0, 1, 2, 3]
    assert spark.range(1).select(analysis.clock(F.lit(3_723_004)).alias("t")).first().t == "01:02:03.004"


def test_seek(spark):
    lex = spark.createDataFrame([(x,) for x in ("aab", "abc", "b", "bca", "é")], "term string")
    keys = spark.createDataFrame([(x,) for x in ("a", "aab", "aac", "abb", "b", "bb", "c", "z", "éa")], "key string")
    got = {r.key: r.term for r in ix_.seek_le(lex, keys).collect()}
    assert got == {"a": None, "aab": "aab", "aac": "aab", "abb": "aab", "b": "b", "bb": "b", "c": "bca", "z": "bca", "éa": "é"}


def test_gamma():
    assert retrieval.gamma_p(1.0, 2.0) == pytest.approx(1 - math.exp(-2)) and retrieval.gamma_p(3.0, 0.0) == 0
    for a, p in ((0.5, 0.3), (4.0, 0.99), (30.0, 0.5)):
        assert retrieval.gamma_p(a, retrieval.gamma_quantile(a, p)) == pytest.approx(p)


def test_pruned_search_is_exact(spark):
    r = random.Random(3)
    docs = [(i, f"d{i}", [r.choice("abcdefghijklmnop"[: r.randrange(2, 17)]) for _ in range(r.randrange(1, 20))]) for i in range(200)]
    ix = ix_.build_index(spark.createDataFrame(docs, "doc_id long, title string, terms array<string>"))
    q = spark.createDataFrame([(k, p, t) for k in range(6) for p, t in enumerate(r.choices("abcdefghijklmnop", k=4))], "qid long, pos int, term string")
    a, b = retrieval.search(ix, q, 5), retrieval.pruned_search(ix, q, ix_.score_stats(ix.scored("bm25")), 5)
    assert rows(a, *a.columns) == rows(b, *a.columns)


#: Ten short documents, the words of each in the order of their ends (scores don't depend on places).
BAGS = [
    "amet, elit. adipiscing Lorem ipsum dolor consectetur sit",
    "suscipit, vestibulum. nunc Proin odio ullamcorper metus placerat et eu",
    "feugiat, eget, dolor. gravida ipsum non libero Mauris aliquet",
    "sed, hendrerit, ante. malesuada Nullam ipsum non tellus placerat",
    "bibendum. Donec aliquam sapien libero semper imperdiet",
    "tincidunt, fermentum. lacinia nunc Nam ipsum in libero ullamcorper at",
    "leo. vehicula id ante vel Aliquam dignissim in dolor at",
    "ultricies. vitae enim pretium Maecenas mollis mauris",
    "scelerisque, gravida. ligula urna dignissim bibendum felis Vivamus eget amet sit",
    "tempor. massa euismod ante in pulvinar Cras",
]


@pytest.fixture(scope="module")
def lorem(spark):
    docs = spark.createDataFrame([(i, f"Doc{i:02}", b.split()) for i, b in enumerate(BAGS)], "doc_id long, title string, terms array<string>")
    ix = ix_.build_index(docs)
    ix_.add_quantized(ix, "bm25", 8)
    ix_.add_stats(ix, "bm25")
    return ix


@pytest.mark.parametrize("score", ["bm25", "bm25-8", "ql"])
@pytest.mark.parametrize("traversal", retrieval.QueryEngine.TRAVERSALS)
def test_query_engine(spark, lorem, score, traversal):
    q = spark.createDataFrame([(0, 0, "ipsum")], "qid long, pos int, term string")
    engine = retrieval.QueryEngine(lorem, score, traversal)
    assert engine.quantized == (score == "bm25-8")
    assert [r.doc_id for r in engine.run(q, 2).orderBy("rank").collect()] == [0, 2]
    assert [r.title for r in engine.titled(q, 2).orderBy("rank").collect()] == ["Doc00", "Doc02"]


def test_query_engine_choices(spark, lorem):
    for bad in ({"traversal": "none"}, {"score": "ql-8"}):
        with pytest.raises(ValueError):
            retrieval.QueryEngine(lorem, **bad)
    ix = ix_.build_index(spark.createDataFrame([(0, "a", ["get"]), (1, "b", ["got", "x"])], "doc_id long, title string, terms array<string>"))
    q = spark.createDataFrame([(0, 0, "getting")], "qid long, pos int, term string")
    assert retrieval.QueryEngine(ix, "count").run(q).count() == 0
    assert rows(retrieval.QueryEngine(ix, "count", stem=True).run(q), "doc_id") == [(0,)]


def test_mini_collection(spark, lorem):
    assert [r.size for r in lorem.documents.orderBy("doc_id").collect()] == [8, 10, 9, 9, 7, 10, 10, 7, 11, 7]
    p = lorem.properties.first()
    assert (p.documents, p.occurrences, p.max_document_size) == (10, 88, 11) and p.avg_document_size == pytest.approx(8.8)
    terms = [r.term for r in lorem.lexicon.orderBy("term_id").collect()]
    assert len(terms) == 72 and lorem.postings.count() == 88 and terms[:3] == ["Aliquam", "Cras", "Donec"] and terms[-2:] == ["vestibulum.", "vitae"]
    assert rows(lorem.lexicon.where("df >= 3"), "term", "df", "cf") == [("in", 3, 3), ("ipsum", 4, 4), ("libero", 3, 3)]
    assert rows(ix_.scores_of(lorem, "bm25-8", ["ipsum"]), "doc_id", "q") == [(0, 49), (2, 48), (3, 48), (5, 47)]
    stats = lorem.stats["bm25"].where("term = 'ipsum'").first()
    assert (stats.max, stats.mean) == pytest.approx((0.377074, 0.365633), abs=1e-6) and stats["var"] == pytest.approx(6.3504e-05, rel=1e-3)
    assert list(stats.top) == pytest.approx([0.377074, 0.365460, 0.365460, 0.354539], abs=1e-6)
    ends = ix_.score_range(lorem.scored("bm25")).first()
    assert (ends.min, ends.max) == pytest.approx((0, 1.95488), abs=1e-5)
    ids = spark.createDataFrame([(0,), (71,), (72,)], "term_id long")
    assert sorted(((r.term_id, r.term) for r in lorem.term(ids).collect())) == [(0, "Aliquam"), (71, "vitae"), (72, None)]
    assert lorem.title(spark.createDataFrame([(3,)], "doc_id long")).first().title == "Doc03"
    q = spark.createDataFrame([(0, 0, "ipsum")], "qid long, pos int, term string")
    assert rows(retrieval.search(lorem.in_memory(), q, 2), "doc_id") == [(0,), (2,)]


def test_mini_collection_in_shards(spark, lorem, tmp_path):
    shards = spark.createDataFrame(list(enumerate([0, 1, 2, 2, 1, 0, 1, 1, 2, 0])), "doc_id long, shard_id int")
    collection.write_cluster(lorem, shards, str(tmp_path / "c"))
    c = collection.open_cluster(spark, str(tmp_path / "c"), scores=("bm25-8",))
    assert [r.size for r in c["documents"].orderBy("shard_id", "local_doc_id").collect()] == [8, 10, 7, 10, 7, 10, 7, 9, 9, 11]
    assert rows(collection.reverse_map(c["documents"]).where("shard_id = 1"), "local_doc_id", "doc_id") == [(0, 1), (1, 4), (2, 6), (3, 7)]
    assert rows(c["scores/bm25-8"], "term", "doc_id", "q") == rows(lorem.scores["bm25-8"], "term", "doc_id", "q")
    only = collection.open_cluster(spark, str(tmp_path / "c"), [2], ("bm25-8",))["scores/bm25-8"]
    assert {r.doc_id for r in only.collect()} == {2, 3, 8}


def test_only_buckets_of_the_terms_are_read(spark, lorem):
    q = spark.createDataFrame([(0, 0, "ipsum")], "qid long, pos int, term string")
    for df in (lorem.hits(q), lorem.scored_hits("bm25", q), lorem.hits(q, lorem.scores["bm25-8"])):
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        assert any("bucket" in x for x in plan.split("\n") if x.startswith("PartitionFilters"))


def test_bag_union(spark):
    lists = [[0, 1, 4], [0, 2, 4], [1, 2, 4]]
    df = spark.createDataFrame([(k, d) for k, x in enumerate(lists) for d in x], "term int, doc_id int")
    assert [r.doc_id for r in df.orderBy("doc_id").collect()] == [0, 0, 1, 1, 2, 2, 4, 4, 4]


def test_next_posting(spark):
    docs = [(i, f"d{i}", ["x"] if i in (0, 1, 4, 6, 9, 11, 30) else []) for i in range(31)]
    ix = ix_.build_index(spark.createDataFrame(docs, "doc_id long, title string, terms array<string>"))
    t = spark.createDataFrame([("x",)], "term string")
    got = {low: [r.doc_id for r in ix_.next_posting(ix, t, low).collect()] for low in (1, 2, 3, 4, 5, 7, 15, 30, 31)}
    assert got == {1: [1], 2: [4], 3: [4], 4: [4], 5: [6], 7: [9], 15: [30], 30: [30], 31: []}


def test_sinks_and_columns(spark, tmp_path):
    res = spark.createDataFrame([(3, 1, 0, 7, "Doc07", 1.5)], "qid long, shard_id int, rank long, doc_id long, title string, score double")
    assert text.plain_lines(res).first().line == "Doc07\t1.500000"
    assert text.csv_lines(res).first().line == "3,1,0,7,1.500000" and text.CSV_HEADER.count(",") == 4
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx \"y\n2\t\n")
    assert rows(text.read_columns(spark, str(tmp_path / "t.tsv")), "a") == [("1",), ("2",)]
    assert text.read_columns(spark, str(tmp_path / "t.tsv"), header=False).columns == ["c0", "c1"]
    lines = spark.createDataFrame([(i, f"l{i}") for i in range(5)], "n long, value string")
    text.write_parts(lines, 2, ["n"], str(tmp_path / "parts"), header="head")
    got = {p.name: [x for f in sorted(p.glob("part-*.txt")) for x in f.read_text().split()] for p in (tmp_path / "parts").glob("part=*")}
    assert got == {"part=part-0000": ["head", "l0", "l1"], "part=part-0001": ["head", "l2", "l3"], "part=part-0002": ["head", "l4"]}
    assert rows(text.symbol_frequencies(F.col("value"), lines.where("n < 2")), "symbol", "n") == [(48, 1), (49, 1), (108, 2)]


def test_taily_against_a_known_distribution(spark):
    """Scores of one term drawn from a gamma distribution: the estimate is its quantile, and about k documents pass it."""
    import numpy as np

    x = np.random.default_rng(1).gamma(3.0, 2.0, 20_000)
    stats = spark.createDataFrame([("t", float(len(x)), float(x.mean()), float(x.var()))], "term string, df double, mean double, var double")
    q = spark.createDataFrame([(0, 0, "t")], "qid long, pos int, term string")
    for k in (100, 1000):
        estimate = retrieval.taily_threshold(q, stats, len(x), k).first().estimate
        assert estimate == pytest.approx(2.0 * retrieval.gamma_quantile(3.0, 1 - k / len(x)), rel=0.05)
        assert (x >= estimate).sum() == pytest.approx(k, rel=0.2)


def test_early_termination_in_blocks(spark):
    """The same prefixes whatever the blocks, and those of plain search."""
    r = random.Random(8)
    scores = [(q, d, round(r.random(), 3)) for q in range(5) for d in range(60) if r.random() < 0.6]
    rel = {d: int(r.random() < 0.4) for d in range(60)}
    want = []
    for q in range(5):
        mine = sorted((-s, d) for k, d, s in scores if k == q)
        p = {e: sum(rel[d] for _, d in [x for x in mine if x[1] < e][:3]) for e in range(5, 61, 5) if any(d < e for _, d in mine)}
        want.append((q, min(e for e in p if p[e] >= p[60])))
    df, order = spark.createDataFrame(scores, "qid long, doc_id long, score double"), spark.createDataFrame([(d, d) for d in range(60)], "doc_id long, rank long")
    qrels = spark.createDataFrame(list(rel.items()), "doc_id long, relevance int")
    for span in (1, 3, 100, None):
        assert rows(evaluation.early_termination(df, order, qrels, 3, 5, span=span), "qid", "documents") == want


def test_precision_and_hits(spark):
    results = spark.createDataFrame([(0, 0, 5), (0, 1, 6), (1, 0, 5)], "qid long, rank long, doc_id long")
    qrels = spark.createDataFrame([(5, 1), (6, 0)], "doc_id long, relevance int")
    assert rows(evaluation.precision_at(results, qrels, 2), "qid", "precision") == [(0, 0.5), (1, 0.5)]
    docs = spark.createDataFrame([(5,), (6,), (7,)], "doc_id long")
    assert rows(evaluation.document_hits(docs, results, 1), "doc_id", "hits") == [(5, 2), (6, 0), (7, 0)]


def test_stream(spark, tmp_path):
    docs = [(i, f"d{i}", ["a", "b"] if i % 2 else ["b", "c", "c"]) for i in range(6)]
    schema = "doc_id long, title string, terms array<string>"
    for k in range(3):
        spark.createDataFrame(docs[2 * k : 2 * k + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.index_stream(stream, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    got, want = incremental.compact(incremental.open_generations(spark, str(tmp_path / "ix"))), ix_.build_index(spark.createDataFrame(docs, schema))
    for table in ("postings", "lexicon", "documents", "properties"):
        a, b = getattr(want, table), getattr(got, table)
        assert rows(a, *a.columns) == rows(b, *a.columns)


def test_pushdown(spark, small):
    plan = ix_.postings_of(small, ["a", "b"])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [a,b])]" in plan


def test_properties_json(spark):
    p = {"documents": 10000, "occurrences": 654321, "skip_block_size": 64, "avg_document_size": 55.5, "max_document_size": 20123, "quantized_scores": {"bm25-8": {"type": "bm25", "bits": 8, "min": 0, "max": 25.1}, "bm25-24": {"type": "bm25", "bits": 24, "min": 0, "max": 25.1}}}
    got = properties.from_json(properties.to_json(p))
    assert got == p | {"shard_count": None}
    row = properties.to_table(spark, got).first()
    assert row.documents == 10000 and row.quantized_scores["bm25-24"].bits == 24 and row.shard_count is None
    with pytest.raises(ValueError):
        properties.from_json("{}")
    p["quantized_scores"]["x"] = {"type": "unknown", "bits": 1, "min": 0, "max": 1}
    assert "x" not in properties.from_json(properties.to_json(p | {"shard_count": 3}))["quantized_scores"]
