"""Operators over the whole corpus, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from test_each_row import check_packed

from lexigrid.llm import common, decontaminate, lm, pii, quality, simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_fingerprint(text):
    w = WORD.findall(lower(text))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    f = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    label = np.arange(len(f))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(f))])
        if (new == label).all():
            return near.sum(axis=1) - 1, label
        label = new


@pytest.mark.parametrize("which", ["odd", "sf", "empty"])
def test_simhash(which, spark, sf, odd, empty):
    docs = {"odd": odd.where("doc_id is null or doc_id not in (9, 10)"), "empty": empty}.get(which) if which != "sf" else spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    if not rows:
        return
    prints = [brute_fingerprint(r.text) for r in rows]
    near, label = brute_groups(prints)
    for r, p, n, k in zip(rows, prints, near, label):
        assert (got[r.doc_id].fingerprint, got[r.doc_id].n_near, got[r.doc_id].component_id) == (f"{p:016x}", n, rows[k].doc_id)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({rows[k].doc_id for k in label} - {None})


def test_simhash_planted(spark, monkeypatch):
    """Chains of links, folded copies and split nodes, against brute force."""
    rng = random.Random(3)
    prints = [0, 0, 1, 3, 2**64 - 1]
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            for b in rng.sample(range(64), rng.randrange(0, 4)):
                x ^= 1 << b
            prints.append(x)
    monkeypatch.setattr(simhash, "BLOCK", 40)
    near, label = brute_groups(prints)
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    monkeypatch.setattr(simhash, "fingerprints", lambda d: spark.createDataFrame(rows, "doc_id long, fp long"))
    got = {r.doc_id: (r.n_near, r.component_id) for r in simhash.near_duplicates(None).collect()}
    assert got == {i: (int(near[i]), int(label[i])) for i in range(len(prints))}


def test_keep_one_with_repeated_and_missing_ids(spark):
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, body(1)), (1, body(1)), (1, body(2)), (2, body(3)), (2, body(3)), (3, body(3)), (None, body(4)), (None, body(4)), (None, body(5)), (None, body(2)), (4, body(5)), (5, body(6))]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, root int")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=repr)
    assert got == sorted([(1, body(1)), (1, body(2)), (2, body(3)), (None, body(4)), (4, body(5)), (5, body(6))], key=repr)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3), (3, None)]
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(500):
        for u, v in edges:
            if u in label and v in label:
                label[u] = label[v] = min(label[u], label[v])
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == label


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "9", "@", ".", "-", " ", "+", "(", "é", "25", "256", "4111", "b.c", "%_"]), max_size=40).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_pii(spark, sf, odd, empty):
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet"), empty):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        got = pii.personal_data(docs).collect()
        assert len(got) == len(texts)
        for g in got:
            t = texts[g.doc_id]
            base = brute_spans(t) if len(t) < 200_000 else pii.base_spans(t)
            n = Counter(k for _, k, _ in base)
            assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == (n[0], n[1], n[2], n[3])
            assert g.base_sha256 == hashlib.sha256(pii.digest(base).encode()).hexdigest()
            spans = g.spans.split(",") if g.spans else []
            assert [s for s in spans if not s.startswith("term")] == [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        clean = pii.sanitise(docs)
        assert clean.columns == docs.columns and clean.count() == len(texts)
        for r in clean.collect():
            if not brute_spans(texts[r.doc_id]):
                assert (r.text or "") == texts[r.doc_id]
            else:
                assert "<" in r.text


def test_pii_disclosure(spark):
    """A term that stands by one entity only is flagged near it, common words aren't; against a brute-force count."""
    r = random.Random(6)
    common_words = [f"w{i}" for i in range(40)]
    fill = lambda n: " ".join(r.choice(common_words) for _ in range(n))
    texts = [fill(40) for _ in range(300)]
    for i in range(6):
        texts.append(f"{fill(10)} Zorblax of {fill(2)} writes from zor{i % 2}@mail.example.com {fill(10)}")
    got = {x.doc_id: x for x in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    terms = lambda i: {texts[i][int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[i].spans.split(",") if s.startswith("term")}
    df, both, df_e = Counter(), Counter(), Counter()
    near: dict = {}
    for i, t in enumerate(texts):
        df.update({w.lower() for w in re.findall(r"[^\s.,]+", t.replace("@", "@"))})
        for s, k, e in pii.base_spans(t):
            near[i] = {(t[s:e], w) for _, w, _, _ in pii.contexts(t, [(s, k, e)])}
            both.update(near[i])
            df_e[t[s:e]] += 1
    n = len(texts)
    for i, pairs in near.items():
        want = {w for x, w in pairs if both[x, w] >= 2 and df_e[x] >= 2 and math.log(both[x, w] * n / (df_e[x] * df[w])) >= max(pii.FLOOR, pii.ALPHA * math.log(n / df_e[x]))}
        assert {w.lower() for w in terms(i)} == want
    assert all(not got[i].spans for i in range(300))


def test_pii_disclosure_by_one_document(spark):
    """A name beside an address that stands in one document only is flagged, common words beside it aren't."""
    texts = [" ".join(f"w{(i + k) % 40}" for k in range(30)) for i in range(100)] + ["w1 w2 w3 Quixolotl w4 only@mail.example.com w5 w6 w7"]
    got = {x.doc_id: x.spans for x in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    spans = [x.split(":") for x in got[100].split(",")]
    assert [texts[100][int(s) : int(e)] for k, s, e in spans if k == "term"] == ["Quixolotl"] and not any(got[i] for i in range(100))


def test_pii_disclosure_far_from_the_entity(spark):
    """A name is flagged wherever it stands in the documents of an address, long before and long after it too, common words aren't."""
    common_words = [" ".join(f"w{(i + k) % 40}" for k in range(60)) for i in range(100)]
    texts = [*common_words, *(f"Quixolotl {x} one@mail.example.com {x} Brankovar w1" for x in common_words[:3])]
    got = {x.doc_id: x for x in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    names = lambda i: [texts[i][int(s) : int(e)] for k, s, e in (x.split(":") for x in got[i].spans.split(",")) if k == "term"]
    assert all(names(k) == ["Quixolotl", "Brankovar"] for k in (100, 101, 102)) and not any(got[i].spans for i in range(100))


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(2)
    for n, t in ((1, 1), (30, 1), (60, 7), (61, 20), (9, 10)):
        v = rng.integers(0, 12, n).astype(np.uint64)
        want = set()

        def walk(a, z):
            if z - a + 1 >= t:  # noqa: B023
                c = a + int(np.argmin(v[a : z + 1]))  # noqa: B023
                want.add((a, c, z))  # noqa: B023
                walk(a, c - 1)
                walk(c + 1, z)

        walk(0, n - 1)
        assert set(zip(*(x.tolist() for x in substring.compact_windows(v, t)))) == want


def test_substring(spark, odd, empty):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    fill = lambda n: " ".join(word() for _ in range(n))
    passage, short, line = fill(70), fill(30), fill(20)
    changed = passage.split()
    changed[35] = "zzzzz"
    texts = [
        f"{fill(100)} {passage} {fill(80)}", f"{passage} {fill(60)}", f"{fill(10)} {passage.upper()}", f"{fill(50)} {' '.join(changed)} {fill(5)}",
        fill(300), f"{fill(100)} {short} {fill(100)}", f"{fill(90)} {short} {fill(100)}", None, fill(20),
    ]
    texts += [f"{fill(60)} {line} {fill(60)}" for _ in range(12)]
    # the same line before a passage that two share, both after a smaller document with the line alone
    other = fill(60)
    texts += [f"{fill(60)} {line} {other}", f"{line} {other} {fill(60)}"]
    texts += [fill(120)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for x in substring.repeated_passages(docs).collect():
        got.setdefault(x.doc_id, []).append(x)
    n = len(texts)
    assert set(got) == {0, 1, 2, 3, n - 4, n - 3, n - 2, n - 1}
    assert {x.class_id for d in (0, 1, 2, 3) for x in got[d]} == {0} and {x.class_id for d in (n - 4, n - 3) for x in got[d]} == {n - 4} and got[n - 1][0].class_id == n - 2
    for d, start in ((0, 100), (1, 0), (2, 10)):
        (x,) = got[d]
        assert x.start_word <= start + 1 and x.end_word >= start + 69 and x.end_word - x.start_word <= 75
    assert substring.repeated_passages(empty).count() == 0
    assert {x.doc_id for x in substring.repeated_passages(odd).collect()} >= {9, 10, 11, 12, 13, 14}


def test_substring_extents_agree():
    """The vectorised rule and the plain one."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        g = substring.Group(20, 4)
        base = rng.integers(0, 9, 60).astype("<u2")
        rows = []
        for _ in range(6):
            w = base.copy()
            w[rng.integers(0, 60, rng.integers(0, 5))] = 99
            w[22:26] = base[22:26]
            a, z = int(rng.integers(2, 22)), int(rng.integers(27, 46))
            rows.append((w[a:z].tobytes(), 22 - a))
        for k, (w, lead) in enumerate(rows[:-1]):
            g.table[k, 20 - lead : 20 - lead + len(w) // 2] = np.frombuffer(w, "<u2")
            g.rows.append((k, 0, lead, w))
        w, lead = rows[-1]
        got = list(zip(*(x.tolist() for x in g.extents(w, lead))))
        assert got == [substring.extent(np.frombuffer(v, "<u2"), np.frombuffer(w, "<u2"), m, lead, 4) for v, m in rows[:-1]]


def near_pairs(r, pairs, third, edit):
    """Documents of pairs of near copies of a passage, each alone or after a third text with pieces of it, with 300 words around."""
    word = lambda r=r: "".join(r.choice("abcdefghij") for _ in range(6))
    fill = lambda n, r=r: [word(r) for _ in range(n)]
    texts, s = [], random.Random(1)
    for _ in range(pairs):
        a = fill(80)
        b = edit(a, word)
        if third:
            texts.append([*fill(60, s), *a[:39], *fill(60, s), *a[42:], *fill(60, s)])
        texts += [[*fill(60), *a, *fill(60)], [*fill(90), *b, *fill(30)]]
    return [" ".join(t) for t in texts]


def one_changed(a, word):
    return [*a[:40], word(), *a[41:]]


def test_substring_keeps_links_beside_a_third_text(spark):
    """40 pairs that share 80 words but for one: linked alone, and the same ones after a third text that holds pieces below the limit."""
    linked = []
    for third in (False, True):
        texts = near_pairs(random.Random(9), 40, third, one_changed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {x.doc_id: x.class_id for x in substring.repeated_passages(docs).collect()}
        step, first = (3, 1) if third else (2, 0)
        linked.append([k for k, i in enumerate(range(0, len(texts), step)) if got.get(i + first) is not None and got.get(i + first) == got.get(i + first + 1)])
    assert set(linked[1]) >= set(linked[0]) and len(linked[0]) >= 36


def edited(a, word, r=random.Random(4)):
    """A word in eight to thirty changed."""
    b, p = list(a), r.randrange(8, 31)
    while p < len(b):
        b[p] = word()
        p += r.randrange(8, 31)
    return b


def test_substring_recall_of_edited_passages(spark):
    texts = near_pairs(random.Random(10), 60, False, edited)
    got = {x.doc_id: x.class_id for x in substring.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    linked = sum(got.get(i) is not None and got.get(i) == got.get(i + 1) for i in range(0, len(texts), 2))
    assert linked >= 0.85 * 60 and {got.get(i, i) // 2 for i in range(len(texts))} == set(range(60))


def test_substring_many_contexts(spark, monkeypatch):
    """More distinct contexts of one line than are kept: exact passages among them are still found, in parts as well."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    fill = lambda n: " ".join(word() for _ in range(n))
    line, shared = fill(20), fill(45)
    texts = [f"{fill(50)} {line} {fill(50)}" for _ in range(60)]
    for i in (20, 55):
        texts[i] = f"{fill(40)} {line} {shared} {fill(40)}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(substring, "KEPT", 4)
    for block in (20_000, 15):
        monkeypatch.setattr(substring, "BLOCK", block)
        assert {(x.doc_id, x.class_id) for x in substring.repeated_passages(docs).collect()} == {(20, 20), (55, 20)}


def test_substring_many_contexts_of_near_copies(spark, monkeypatch):
    """Among more distinct contexts of one line than are kept: two documents with changed words on both sides of it are linked as they are alone."""
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    fill = lambda n: " ".join(word() for _ in range(n))
    line, before, after = fill(20), fill(28), fill(28)
    texts = [f"{fill(50)} {line} {fill(50)}" for _ in range(60)]
    for i in (20, 55):
        x, y = before.split(), after.split()
        x[18], x[9], y[9], y[18] = fill(4).split()
        texts[i] = f"{fill(30)} {' '.join(x)} {line} {' '.join(y)} {fill(30)}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(20, 30, 106, 20), (55, 30, 106, 20)]
    spans = lambda docs: sorted((x.doc_id, x.start_word, x.end_word, x.class_id) for x in substring.repeated_passages(docs).collect())
    assert spans(docs.where("doc_id in (20, 55)")) == want
    monkeypatch.setattr(substring, "KEPT", 4)
    for block in (20_000, 15):
        monkeypatch.setattr(substring, "BLOCK", block)
        assert spans(docs) == want


def test_substring_index_loses_no_pair():
    """Pairs of a large group found by halves of runs of words are those of comparing all pairs, each once, with the extents of the plain rule."""
    rng = np.random.default_rng(15)
    rows = []
    for k in range(300):
        w = rng.integers(0, 1 << 16, 102)
        if k:
            like = rows[rng.integers(0, min(k, 4))][0]
            a, z = int(rng.integers(0, 30)), int(rng.integers(72, 103))
            w[a:z] = like[a:z]
            w[rng.integers(0, 102, rng.integers(0, 7))] = rng.integers(0, 1 << 16)
        w[48:54] = 1
        rows.append((w, int(rng.integers(0, 30)), int(rng.integers(72, 103))))
    words, lead = [w[a:z].astype("<u2") for w, a, z in rows], np.array([48 - a for _, a, _ in rows], np.int32)
    x = substring.Contexts(pa.array([w.tobytes() for w in words]), lead, np.array([300]), 50, 6)
    want = {(i, j): e for i in range(300) for j in range(i + 1, 300) if sum(e := substring.extent(words[i], words[j], lead[i], lead[j], 6)) >= 50}
    for kept in (300, 40, 3):
        got = [((min(i, j), max(i, j)), (b, a)) for part in x.links(kept) for i, j, b, a in zip(*(y.tolist() for y in part))]
        assert len(got) == len(want) > 1000 and dict(got) == want


def test_substring_index_compares_few_pairs(monkeypatch):
    """In a large group of contexts that are alike on one side of the token alone, few pairs that aren't links are compared word by word."""
    rng = np.random.default_rng(16)
    rows = []
    for k in range(400):
        w = rng.integers(0, 1 << 16, 102)
        if k % 20:
            w[:30] = rows[-1][:30]
            w[24 + rng.integers(0, 6)] = rng.integers(0, 1 << 16)
        w[30:54] = 1
        rows.append(w)
    x = substring.Contexts(pa.array([w.astype("<u2").tobytes() for w in rows]), np.full(400, 48, np.int32), np.array([400]), 50, 6)
    seen, plain = [], substring.Contexts.extents
    monkeypatch.setattr(substring.Contexts, "extents", lambda self, i, j: seen.append(len(i)) or plain(self, i, j))
    links = sum(len(part[0]) for part in x.links(32))
    assert links > 100 and sum(seen) < 4 * links


def test_substring_finds_exact_repeats(spark, sf):
    """Every pair of documents that share 50 words in a row: both are reported, in one class."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    where: dict = {}
    for r in docs.collect():
        w = lower(r.text).split()
        for i in range(len(w) - 49):
            where.setdefault(tuple(w[i : i + 50]), set()).add(r.doc_id)
    got: dict = {}
    for x in substring.repeated_passages(docs).collect():
        got[x.doc_id] = x.class_id
    sets = {frozenset(v) for v in where.values() if len(v) > 1}
    assert sets
    for s in sets:
        assert len({got[d] for d in s}) == 1


def test_lm(spark, sf, odd, empty):
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet"), empty):
        rows = docs.select("doc_id", "text").collect()
        got = {r.doc_id: r for r in lm.score(docs).collect()}
        assert len(got) == len(rows)
        held = {r.doc_id: zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2 for r in rows}
        tokens = {r.doc_id: [*WORD.findall(lower(r.text)), ""] for r in rows}
        c = Counter(t for d, ts in tokens.items() if not held[d] for t in ts)
        n, v = sum(c.values()), len(c)
        for d, ts in tokens.items():
            g = got[d]
            base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)
            assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[d], len(ts), sum(c[t] > 0 for t in ts), n)
            assert math.isclose(g.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and g.score <= 0


def test_lm_tail_join_changes_nothing(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    full = {r.doc_id: r for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "HEAD", lm.WORDS + 50)
    for r in lm.score(docs).collect():
        assert math.isclose(r.base_score, full[r.doc_id].base_score, rel_tol=1e-9) and r.n_known == full[r.doc_id].n_known


def test_lm_is_normalised_and_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm.score(docs).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.01 * sum(r.n_tokens for r in rows)
    v = lm.Vocabulary([b"", b"a", b"b", b"c"], [5, 4, 2, 1], 20, 9)
    m = lm.Model(v)
    contexts = np.zeros((lm.CONTEXT, lm.CLASSES**2), dtype=np.int64)
    # over all places that classes and words span, probabilities add up to one
    assert abs((10 ** m.log10(contexts, np.arange(lm.CLASSES**2))).sum() - 1) < 1e-3


def test_lm_units_grow_with_the_types():
    """Each word of a vocabulary of 5000 is predicted and is a context by itself, and all their probabilities add up to one."""
    v = lm.Vocabulary([b"w%d" % i for i in range(5000)], list(range(6000, 1000, -1)), 18_000_000, 20_000)
    ids, at, words = v.tokens([b" ".join(b"w%d" % i for i in range(5000))])
    assert len(set(v.unit[ids[:5000]].tolist())) == 5000 and v.other not in v.unit[ids[:5000]]
    assert len(set(v.contexts(ids, at, words)[0].tolist())) == 5001
    m, n = lm.Model(v), v.n_classes
    t = lm.Trainer(m, v, 0)
    t.step(v.contexts(ids, at, words)[:, : lm.BATCH], v.place[v.unit[ids]][: lm.BATCH])
    assert abs((10 ** m.log10(np.zeros((lm.CONTEXT, n * n), dtype=np.int64), np.arange(n * n))).sum() - 1) < 1e-3


def test_lm_draws_noise_for_each_target():
    """As many noise draws as targets ask for, at the batch size and rate that the model was set up with."""
    v = lm.Vocabulary([b"%d" % i for i in range(500)], list(range(1000, 500, -1)), 400_000, 500)
    t, sizes = lm.Trainer(lm.Model(v), v, 0), []
    draw = t.rng

    class Counted:
        def random(self, size):
            sizes.append(int(np.prod(size)))
            return draw.random(size)

        choice = staticmethod(draw.choice)

    t.rng = Counted()
    t.step(np.zeros((lm.CONTEXT, lm.BATCH), dtype=np.int32), v.place[np.arange(lm.BATCH) % 500])
    assert sizes == [lm.BATCH * lm.WORD_NOISE] and (lm.BATCH, lm.NOISE, lm.WORD_NOISE, t.rate) == (2048, 16, 4, 0.1)


def test_lm_sums_of_equal_rows(monkeypatch):
    """Gradients of equal rows are summed in few passes (once a pair of dimensions), to the sums of the plain loop."""
    v = lm.Vocabulary([b"%d" % i for i in range(500)], list(range(1000, 500, -1)), 400_000, 500)
    m = lm.Model(v)
    t, rng, calls, plain = lm.Trainer(m, v, 0), np.random.default_rng(5), [], np.bincount
    rows, old = rng.integers(0, 90, (lm.CONTEXT, 200)), m.context.copy()
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or plain(*a, **k))
    seen = []
    scatter = t._scatter
    monkeypatch.setattr(t, "_scatter", lambda name, *a: seen.append(name) or scatter(name, *a))
    apply, grads = t._apply, {}
    monkeypatch.setattr(t, "_apply", lambda name, at, grad, *a: grads.setdefault(name, (at, grad.copy())) and apply(name, at, grad, *a))
    t.step(rows.astype(np.int32), v.place[rng.integers(0, 500, 200)])
    assert seen == ["mid", "word", "context"] and len(calls) <= 4
    at, grad = grads["context"]
    assert sorted(at.tolist()) == sorted(set(rows.ravel().tolist()))
    # the step of a row with squares of one before it: rate * sum / sqrt(1 + mean square of the sum)
    want = old.copy()
    want[at] += 0.1 * grad / np.sqrt(1 + (grad * grad).sum(axis=1, keepdims=True) / lm.DIM)
    assert np.allclose(m.context, want, atol=1e-6) and not np.allclose(m.context, old, atol=1e-4)
    # sums themselves, with vectors known
    x = rng.standard_normal((lm.CONTEXT, 200, lm.DIM))
    t.slot["context"][:] = 7  # whatever it held
    grads.clear()
    t._scatter("context", *t._distinct("context", rows.ravel()), None, [x[:, :, d] + 1j * x[:, :, d + 1] for d in range(0, lm.DIM, 2)])
    at, grad = grads["context"]
    sums = np.zeros((v.n_contexts, lm.DIM))
    np.add.at(sums, rows.ravel(), x.reshape(-1, lm.DIM))
    assert np.allclose(grad, sums[at], atol=1e-5)


def test_lm_words_are_those_of_bytes_split(monkeypatch):
    """Words cut by Arrow are those of bytes.lower().split(), and texts looked up together have the tokens that each has alone."""
    rng = random.Random(3)
    pieces = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\x00", "\u00a0".encode(), "É".encode(), b"A", b"z"]
    texts = [b"".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(400)]
    words, sizes = lm.split(texts)
    plain = [t.lower().split() for t in texts]
    assert words.to_pylist() == [w for x in plain for w in x] and sizes.tolist() == [len(x) for x in plain]
    v = lm.Vocabulary([b"", b"a", b"z"], [400, 9, 8], 1000, 50, [(300, 20), (283, 27)])
    monkeypatch.setattr(lm, "LOOKED_UP", 900)
    got = [v.units(ids, at, w).tolist() for ids, at, w in v.slices(pa.array([t.decode() or None for t in texts]), 1)]
    assert got == [[v.index[w] if w in v.index else v.other + lm.bucket(w, 2) for w in x] + [0] for x in plain]


def test_pipeline(spark, sf):
    """run() against its stages' brute-force versions."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), [decontaminate.normal(b.text) for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    verdict = quality.field(docs, labels)
    rows = [r for r in sorted(docs.collect(), key=lambda r: r.doc_id) if verdict(r.text)[6]]
    _, label = brute_groups([brute_fingerprint(r.text) for r in rows])
    rows = [r for i, r in enumerate(rows) if label[i] == i]
    rows = [r for r in rows if not any(b in decontaminate.normal(r.text) for b in bench)]
    stages = docs
    for _, stage in pipeline.STAGES[:4]:
        stages = common.written(stage(spark, stages, sf), "t")
        assert stages.columns == docs.columns
    kept = {r.doc_id: r for r in stages.collect()}
    assert set(kept) == {r.doc_id for r in rows}
    for r in rows:
        assert (kept[r.doc_id].text == r.text) == (not brute_spans(r.text)) and not brute_spans(kept[r.doc_id].text)
    check_packed(stages.select("doc_id", "text").collect(), pipeline.run(spark, sf).collect())


def test_lm_does_not_depend_on_partitions(spark, sf, monkeypatch):
    """The same scores from two partitions and from eight, with shards of their own."""
    monkeypatch.setattr(lm, "SHARD", 20_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = ({r.doc_id: r.score for r in lm.score(docs.repartition(n)).collect()} for n in (2, 8))
    assert all(math.isclose(a[d], b[d], rel_tol=1e-4) for d in a)


def test_lm_alias_tables_draw_by_the_shares():
    rng = np.random.default_rng(4)
    shares = rng.random((5, 7)) ** 4
    shares[2] = 0
    own, other = lm.alias_table(shares)
    p = np.zeros(35)
    np.add.at(p, np.arange(35), own / 7)
    np.add.at(p, other, (1 - own) / 7)
    want = shares / np.maximum(shares.sum(axis=1, keepdims=True), 1e-300)
    assert np.allclose(np.delete(p.reshape(5, 7), 2, 0), np.delete(want, 2, 0))
    assert all(own[i] == 1 or shares.ravel()[other[i]] > 0 for i in range(35) if i // 7 != 2)


def test_lm_tail_words_share_their_units():
    """Words beyond the head: the probabilities of a tail unit's words and of one unseen word of it add up to the unit's own."""
    words = [b"%dabcd" % i for i in range(40)]
    tail = np.zeros((3, 2), dtype=int)
    for i, w in enumerate(words):
        tail[lm.bucket(w, 3)] += (i + 1, 1)
    v = lm.Vocabulary([b"", b"the"], [900, 100], 1000 + tail[:, 0].sum(), 42, tail.tolist())
    ids, at, texts = v.tokens(words)
    units = v.units(ids, at, texts)[:-1:2]
    assert [u - v.other for u in units.tolist()] == [lm.bucket(w, 3) for w in words]
    for k in range(3):
        mine = [i + 1 for i, w in enumerate(words) if lm.bucket(w, 3) == k]
        assert abs(sum((c + 1) / 10 ** v.share_log[v.other + k] for c in mine) + 1 / 10 ** v.share_log[v.other + k] - 1) < 1e-9
