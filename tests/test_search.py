"""Searches with many queries against each query alone."""

import contextlib
import threading

import numpy as np
import psutil
import pyarrow as pa
import pytest
from quillstone.operators import search
from quillstone.queries import QUERIES


def test_batch_has_every_query(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = [r.vec_id for r in df.where("vec_id % 20 = 0").select("vec_id").collect()]
    got = QUERIES["vector_batch_knn"](spark, sf_dir).collect()
    assert len(asked) > 3 and len(got) == 10 * len(asked) and {r.query_id for r in got} == set(asked)


def test_batch_metrics_and_ties(spark):
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.6, 0.8]), (5, None), (6, [2.0, 0.1])]
    df = spark.createDataFrame(data, "id long, v array<float>").repartition(3)
    for metric in ("cosine", "dotProduct", "euclidean"):
        got = search.nearest_each(df, df.where("id < 4"), "id", "v", 3, metric).collect()
        for q, v in data[:3]:
            want = [r.id for r in search.nearest(df.where("v is not null"), "id", "v", v, 3, metric).collect()]
            assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: (-r.score, r.id))] == want


@pytest.mark.parametrize("metric", ["cosine", "dotProduct", "euclidean"])
def test_batch_holds_no_more_for_more_queries(spark, metric):
    """2,000 queries against 40,000 rows, a fifth of them copies: a worker stays small, and the rows are those of a plain search."""
    rng = np.random.default_rng(7)
    m = rng.normal(size=(40_000, 8))
    m[::5] = m[0]
    df = spark.createDataFrame(pa.table({"id": np.arange(len(m)), "v": list(m)})).repartition(4)
    most, done = [0], threading.Event()

    def watch():
        while not done.wait(0.05):
            for p in psutil.Process().children(recursive=True):
                with contextlib.suppress(psutil.Error):
                    if "python" in p.name():
                        most[0] = max(most[0], p.memory_info().rss)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = search.nearest_each(df, df.where("id % 20 = 0"), "id", "v", 10, metric).toPandas()
    finally:
        done.set()
        watcher.join()
    assert most[0] < 500e6
    assert len(got) == 20_000
    found = {q: list(g.sort_values(["score", "id"], ascending=[False, True]).id) for q, g in got.groupby("query_id")}
    for q in range(0, 40_000, 2_000):
        s = -np.sqrt(((m - m[q]) ** 2).sum(axis=1)) if metric == "euclidean" else (m * m[q]).sum(axis=1)
        s = s / np.linalg.norm(m, axis=1) if metric == "cosine" else s
        assert found[q] == list(np.lexsort((np.arange(len(m)), -np.round(s, 10)))[:10])


def test_batch_blocks_meet_once(spark, monkeypatch):
    """Several blocks of queries and of rows; vectors without direction, huge ones, fewer rows than asked for."""
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    monkeypatch.setattr(search, "ROW_BLOCK", 3, raising=False)
    data = [(n, [float(n % 3), float(n % 2)]) for n in range(11)] + [(11, [1e200, 0.0]), (12, None), (13, [0.0, 0.0])]
    df = spark.createDataFrame(data, "id long, v array<double>")
    got = search.nearest_each(df, df.where("id < 5"), "id", "v", 20, "euclidean").collect()
    assert sorted((r.query_id, r.id) for r in got) == [(q, i) for q in range(5) for i in range(14) if i != 12]
    got = search.nearest_each(df, df.where("id in (1, 4)"), "id", "v", 3, "dotProduct").collect()
    for q in (1, 4):
        want = [r.id for r in search.nearest(df.where("v is not null"), "id", "v", data[q][1], 3, "dotProduct").collect()]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: (-r.score, r.id))] == want
