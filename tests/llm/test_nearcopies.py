"""Near copies against all pairs compared plainly."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import corpus  # noqa: E402
import numpy as np  # noqa: E402
import corpus_pipeline  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from quillstone.llm import nearcopies, simhash  # noqa: E402


def plain_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def plain_groups(data):
    """The smallest id that each id is connected with; the number of alike pairs of different texts."""
    sets = {i: plain_set(t) for i, t in data}
    label, pairs = {i: i for i in sets}, []
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                pairs.append((i, j))
                a, b = label[i], label[j]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    return label, pairs


def edited(rng, words, share):
    out = list(words)
    for k in rng.sample(range(len(out)), max(1, round(share * len(out)))):
        out[k] = f"edit{rng.randint(0, 10**6)}"
    return out


def documents():
    """Bases with variants about the threshold, of which many are alike to their base only."""
    rng = random.Random(5)
    out = []
    for _ in range(40):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([30, 80, 200, 600]))]
        out.append(base)
        out += [edited(rng, base, rng.choice([0.005, 0.01, 0.015, 0.02, 0.03, 0.06])) for _ in range(5)]
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_groups_beyond_one_task(spark, monkeypatch):
    """Groups that are compared in blocks come out as those that one task compares."""
    for name, value in (("GROUP_ROWS", 3), ("PIVOTS", 2), ("QUERY_ROWS", 7)):
        monkeypatch.setattr(nearcopies, name, value)
    data = documents()
    want, _ = plain_groups(data)
    got = nearcopies.near_copy_groups(corpus.frame(spark, [(i, t, "en", "a", len(t)) for i, t in data])).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_rows_that_share_an_id_are_not_lost(spark):
    """One id with two unrelated texts: both stay, and the same rows on every run."""
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    data = [(1, a, "en", "s", 1), (1, b, "de", "s", 2), (1, b, "de", "t", 3), (1, b, "aa", "s", 4), (2, a + " more", "en", "s", 5)]
    for n in (1, 3, 5):
        got = nearcopies.one_of_each_group(spark.createDataFrame(data, corpus.SCHEMA).repartition(n)).collect()
        assert sorted((r.doc_id, r.text, r.n_chars) for r in got) == [(1, a, 1), (1, b, 4)]


def test_stage_drops_near_copies(spark):
    data = documents()
    want, pairs = plain_groups(data)
    assert len(pairs) > 150
    df = corpus.frame(spark, [(i, t, "en", "a", len(t)) for i, t in data])
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = sorted(r.doc_id for r in stage(spark, df, "").collect())
    assert kept == sorted(set(want.values()))


def test_one_large_group(monkeypatch):
    """A base with variants that are alike to it only: more exact comparisons than members are not needed when it comes first."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(400)]
    sets = [nearcopies.shingles(" ".join(x).encode())[1] for x in [base, *(edited(rng, base, 0.018) for _ in range(300))]]
    calls = []
    plain = nearcopies.alike
    monkeypatch.setattr(nearcopies, "alike", lambda a, b: calls.append(1) or plain(a, b))
    assert set(nearcopies.components(sets, np.array([nearcopies.wide(s) for s in sets]))) == {0}
    assert len(calls) < 3 * len(sets)


def test_ids_and_empty_texts(spark):
    long = " ".join(f"w{k}" for k in range(50))
    data = [(1, long), (2, long.upper()), (3, ""), (4, None), (4, long + " more"), (None, long), (5, "a b"), (6, "a  B"), (7, "a b c")]
    df = corpus.frame(spark, [(i, t, "en", "a", 0) for i, t in data], clashing=True)
    got = nearcopies.one_of_each_group(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [1, 3, 5, 7]
    assert sum(r.doc_id is None for r in got.collect()) == 1


def test_pairs_of_tiles_are_dealt_evenly(spark, monkeypatch, tmp_path):
    """No task compares more pairs of tiles than its even share; the links connect what all pairs connect."""
    rng = np.random.default_rng(3)
    bases = rng.integers(0, 2**64, (60, 4), np.uint64)
    prints = np.concatenate([bases, bases ^ np.uint64(5), bases[:20] ^ np.uint64(1 << 40)])
    plain, log = simhash.tile_links, str(tmp_path / "pairs")

    def logged(*args):
        with open(log, "a") as out:
            out.write(f"{TaskContext.get().partitionId()}\n")
        return plain(*args)

    monkeypatch.setattr(simhash, "tile_links", logged)
    monkeypatch.setattr(simhash, "TILE_ROWS", 12)
    df = spark.createDataFrame([(i, row.view(np.int64).tolist()) for i, row in enumerate(prints)], "content long, words array<long>")
    got = simhash.links(df, 57, "content", "words", 4, 20).collect()
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    u, v = np.nonzero(apart <= 57)
    want = simhash.spanning_labels(len(prints), u, v)
    assert (simhash.spanning_labels(len(prints), *np.array([(r.u, r.v) for r in got]).T) == want).all()
    tasks = [int(line) for line in open(log)]
    counts = np.bincount(tasks, minlength=4)
    assert len(tasks) > 40 and counts.max() <= -(-len(tasks) // 4) + 1
