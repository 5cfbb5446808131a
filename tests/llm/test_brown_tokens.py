"""The Brown model's passes over tokens."""

import sys
from collections import Counter

from pyspark.sql import functions as F
from quillstone.llm import brown


def test_known_words_are_looked_up_without_a_call_each():
    groups = brown.clusters([(b"a", 5), (b"b", 3)], [b"ing"])
    lookup = brown.Lookup(groups, [b"a", b"b"])
    words = [b"a", b"b", brown.END] * 3000 + [b"going", b"zzz"]
    frames = Counter()
    sys.setprofile(lambda frame, event, arg: frames.update([event]))
    try:
        got = lookup.ids(words)
    finally:
        sys.setprofile(None)
    assert got.tolist() == [groups.of(w) for w in words]
    assert frames["call"] < 6100  # only what the table lacks: END here, and two words


def test_bigrams_across_chunks(spark, monkeypatch):
    """Texts of every length, empty ones too, cut into chunks: the same bigrams as text by text."""
    monkeypatch.setattr(brown, "HELD_TOKENS", 3)
    texts = ["a b a", "", None, "b", "a a b c going c", "c"]
    groups = brown.clusters([(b"a", 5), (b"b", 3)], [b"ing"])
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = brown.bigram_counts(df, F.lit(True), groups, [(b"a", 5), (b"b", 3)])
    want = Counter()
    for t in texts:
        path = [0, *[groups.of(w) for w in brown.tokens((t or "").encode())], 0]
        want.update(zip(path, path[1:]))
    assert {(i, j): n for i, row in enumerate(got.tolist()) for j, n in enumerate(row) if n} == want
