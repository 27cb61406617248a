"""Spelling variants against all pairs of words, on the table and on made texts."""

import re
import zlib
from collections import Counter

import pytest

from duoscope.llm import variants
from duoscope.llm.queries import op13_variants

DOCS = "doc_id long, text string"


def is_near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs, shortest=5, least=3):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            cut = h % len(run)
            n[run[:cut] + run[cut + 1 :] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= least}


def truth(words):
    """word to (form, root, n, n_near, form_n), by comparing words whose lengths differ by one at most."""
    lengths = {}
    for w in words:
        lengths.setdefault(len(w), []).append(w)
    form, count = {}, {}
    for w, n in words.items():
        near = [x for k in (-1, 0, 1) for x in lengths.get(len(w) + k, ()) if is_near(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w], count[w] = best if best is not None and words[best] >= 2 * n else None, len(near)

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, count[w], words.get(form[w])) for w, n in words.items()}


def rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    words = counted(docs)
    some = dict(sorted(words.items())[:1500])  # the plain version takes all pairs
    got, near = rows(op13_variants(spark, sf)), truth(words) if len(words) < 4000 else None
    assert {w: v[2] for w, v in got.items()} == words
    if near:
        assert got == near
    else:
        letters = sorted({c for w in words for c in w})
        for w in some:
            every = {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) if j <= len(w) for c in [*letters, ""]} - {w}
            assert got[w][3] == len(every & words.keys())


def repeated(words):
    return [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items(), 1)]


@pytest.mark.parametrize("words", [
    {"letter": 40, "leter": 10, "lettter": 4, "lettr": 3, "latter": 20, "better": 80, "bitter": 80},
    {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "aaaaaaaaa": 48},  # equal letters in a row, and a chain of forms
    {"zebras": 5, "zebra": 10, "zebrb": 10, "zebrc": 10},  # ties by code points
    {"motörhead": 9, "motorhead": 18, "motÖrhead": 3, "MOTORHEAD": 3, "mot×rhead": 3},
    {"x" * 300 + "y" * 300: 3, "x" * 300 + "y" * 299: 6, "x" * 299 + "z" + "y" * 300: 4, "abcdefgh" * 20: 3, "abcdefgh" * 20 + "i": 7},
])
def test_made_words(spark, words):
    docs = repeated(words)
    got = rows(variants.variants(spark.createDataFrame(docs, DOCS)))
    assert got == truth(counted(docs))


def test_all_letters_at_one_place(spark):
    docs = repeated({f"pre{chr(c)}fix": 3 + c % 7 for c in [*range(97, 123), *range(0xC0, 0x100)]} | {"prefix": 40})
    got = rows(variants.variants(spark.createDataFrame(docs, DOCS)))
    assert got == truth(counted(docs))
    assert max(v[3] for v in got.values()) >= 80


def test_nulls_and_empty_tables(spark):
    docs = [(None, "words words words"), (3, None), (4, ""), (5, "a b 中文 12345 --"), (6, "Words4words wordsö")] * 2
    df = spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", word int")
    assert rows(variants.variants(df)) == truth(counted(docs))
    assert rows(variants.variants(df.filter("doc_id < 0"))) == {}


def test_beginnings_have_linear_keys():
    keys = variants.keys("a" * 20_000)
    assert len(keys) == 20_000 - variants.PACKED and max(map(len, keys)) <= 33 and len(set(keys)) == len(keys)
