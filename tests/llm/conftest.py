import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, key long, rest int"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, ties, marks and blanks of all sorts; columns whose names clash with the operators' own."""
    r = random.Random(4)
    words = ["the", "of", "and", "Zug", "été", "naïve", "x1", "Word,", "end.", "ß", "foo-bar", "a@b.co", "10.0.0.1"]
    long = " ".join(r.choice(words) for _ in range(25_000))
    body = " ".join(f"w{r.randrange(5000)}" for _ in range(120))
    texts = [
        None, "", " ", "\n\n", "one", "two words", "a b c", "a b c d", "A B C D", long, long + " tail", body, body, body + " x", "head " + body,
        "tab\tand\x0bvertical\x0cfeed\rreturn\x1cfile nbsp em", "﻿bom​zero", "it's don't we're", "#*$%&|<> ###", "1.2.3.4 999.1.1.1 1.2.3.4.5",
        "x@y.z me@site.example.com. a@b@c.de _@-.-", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (736) 555-2678 +49 30 123456 +1", "<|endoftext|> mid <|startoftext|>",
        "😀 emoji 漢字 İstanbul ǅ", "line\nline\nline\n\nline two\nline two", "q" * 5000, "7" * 3000, "́combining á é",
    ]
    rows = [(i, t, "en", "s", None if t is None else len(t), f"t{i}", i % 3, i) for i, t in enumerate(texts)]
    rows.append((None, "no id here but words enough " * 12, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
