"""The pipeline against its stages done plainly, one document at a time."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import corpus  # noqa: E402
import corpus_pipeline  # noqa: E402
from quillstone.llm import language, rules, secrets  # noqa: E402
from quillstone.llm.common import remainder  # noqa: E402
from test_nearcopies import plain_set  # noqa: E402
from test_operators import plain_counts  # noqa: E402


def plain_groups(pairs):
    """(id, text) -> the smallest id of the near copies that a row is connected with."""
    sets, root = [plain_set(t) for _, t in pairs], list(range(len(pairs)))
    for a in range(len(pairs)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    least = {}
    for (i, _), r in zip(pairs, root):
        least[r] = min(i, least.get(r, i))
    return {i: least[r] for (i, _), r in zip(pairs, root)}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    return corpus.directory(spark, tmp_path_factory.mktemp("pipeline"))


def plain_verdict(text):
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = plain_counts(text)
    if n_words < 10 or 100 * n_repeat > 20 * n_words:
        return False
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    stop = {w + mark for s in rules.STOP_WORDS for w in (s, s.capitalize()) for mark in ("", ".", ",", ";", ":", "!", "?")}
    counts = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_lines": len(lines), "n_marks": text.count("!"), "n_stop_words": sum(w in stop for w in text.split())}
    return all(t.low * counts[t.denominator] <= counts[t.numerator] <= t.high * counts[t.denominator] for t in rules.THRESHOLDS)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    model = language.train(docs, remainder("doc_id", 3) != 1)
    tools = language.Compressors(model)
    want = [r.asDict() for r in docs.collect()]
    want = [r for r in want if not tools.identify(r["text"])[2]]
    want = [r for r in want if plain_verdict(r["text"])]
    smallest = plain_groups([(r["doc_id"], r["text"]) for r in want if r["doc_id"] is not None])
    want = {r["doc_id"]: r for r in want if r["doc_id"] is None or smallest[r["doc_id"]] == r["doc_id"]}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        if name == "secrets":
            got = {r.doc_id: r.text for r in docs.collect()}
            assert got == {i: secrets.redacted(r["text"], secrets.scan(r["text"])) for i, r in want.items()}
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == want.keys()
    whole = corpus_pipeline.run(spark, sf)
    assert whole.agg(F.sum("length")).first() == docs.agg(F.sum("length")).first()


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    assert corpus_pipeline.run(spark, corpus.directory(spark, tmp_path, [])).collect() == []
    docs = corpus.frame(spark, clashing=True)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, "")
        if name != "packing":
            assert after.columns == docs.columns
            after.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert after.where("doc_id = 0").count() > 0


def test_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    assert {n for n in entry.queries() if n.startswith("op")} >= {f"op{k}_" + n for k, n in enumerate("packing brown language order_minhash simhash bpe quality rules toxicity secrets".split(), 1)}
    assert entry.oracle_sql().keys() <= entry.queries().keys()
