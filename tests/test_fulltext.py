"""The full-text index of the documents against a plain count."""

import re
from collections import Counter

import numpy as np
from quillstone.operators import search
from quillstone.queries import QUERIES


def plain(spark, sf_dir):
    found = Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        found.update((w, r.doc_id) for w in re.split(r"[ \t\n\x0b\f\r]+", (r.text or "").lower()) if w)
    return found


def test_all_terms_and_postings(spark, sf_dir):
    want = plain(spark, sf_dir)
    assert {(r.term, r.id): r.tf for r in QUERIES["fulltext_postings"](spark, sf_dir).collect()} == want
    got = {r.term: r.df for r in QUERIES["fulltext_terms"](spark, sf_dir).collect()}
    assert got == Counter(w for w, _ in want) and min(got.values()) == 1


def grams(text, n=3, stop_words=("the", "der")):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w and w not in stop_words]
    return Counter(g for w in words for g in ([w[i : i + n] for i in range(len(w) - n + 1)] if len(w) >= n else [w]))


def test_only_texts_are_shuffled(spark, sf_dir, capsys):
    """Terms are counted where the texts of an id are; their counts aren't dealt out again."""
    for name in ("fulltext_ngram", "fulltext_postings"):
        QUERIES[name](spark, sf_dir).explain()
        plan = capsys.readouterr().out
        assert plan.count("hashpartitioning(") == 1 and "hashpartitioning(term" not in plan


def test_grams_of_odd_texts(spark):
    """Rows with one id and rows without one are counted together; a text beyond one piece, one word without an end, no words at all."""
    long = "der Hund \t" + "ab\x00 😀é日本 the THE x " * 30_000
    data = [(1, "The cat"), (2, None), (3, ""), (1, "cat\nthe der"), (None, "A bc def"), (4, long), (None, "bc"), (5, "xyz" * 250_000), (6, " the \r\n"), (1, long[:1000])]
    df = spark.createDataFrame(data, "id long, text string").repartition(5)
    want = {}
    for i, text in data:
        want.setdefault(i, Counter()).update(grams(text or ""))
    got = search.inverted(df, "id", "text", ngram=3, stop_words=("the", "der")).collect()
    assert {(r.id, r.term): r.tf for r in got} == {(i, g): n for i, found in want.items() for g, n in found.items()}
    assert len(got) == sum(map(len, want.values()))


def test_grams_with_too_many_letters_for_a_number():
    texts = ["the cat der x", "日本語 ab\x00 ca", "cat cat"]
    for n in (1, 2, 3, 5):
        for most in (0, 1 << 62):
            of, term, tf, terms = search._grams(texts, np.array([0, 1, 1]), n, ("the", "der"), most)
            want = [grams(texts[0], n), grams(texts[1], n) + grams(texts[2], n)]
            assert {(g, terms[t]): m for g, t, m in zip(of.tolist(), term.tolist(), tf.tolist(), strict=True)} == {(g, w): m for g, found in enumerate(want) for w, m in found.items()}
