"""Saves that append, limits, clearing, options, history, scrubbing, autosave, streams, key values."""

import random
import threading
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from quillstone import migrate
from quillstone.catalog import Catalog, IndexConfiguration
from quillstone.errors import ConcurrentSaveError, ConfigurationError, DuplicateIndexName, MigrationError, ScrubError, SizeLimitError, TypeValidationError
from quillstone.functions import keys, rangeset, sketch
from quillstone.model import EntitySpec, IndexSpec, Version, entity, fields_of
from quillstone.operators import kinds, scrub
from quillstone.plans.query import Query
from quillstone.session import Engine, Metrics, Settings
from quillstone.sources import storage
from quillstone.sources.storage import Changes, MemoryBackend, ParquetBackend
from quillstone.streaming import maintain

ITEM = entity("Item", "id long, name string, size double", IndexSpec(kinds.Count(), ("name",)))


def rows(spark, *data):
    return spark.createDataFrame(list(data), ITEM.schema)


def stored(backend, spec=ITEM):
    return sorted(tuple(r) for r in backend.read(spec).collect())


def test_changes_lie_beside_the_snapshot(spark, tmp_path, monkeypatch):
    """Random saves against a dictionary; a snapshot is written only when changes have gathered."""
    monkeypatch.setattr(storage, "COMPACT_AFTER", 3)
    backend, rng, want = ParquetBackend(spark, str(tmp_path / "s")), random.Random(1), {}
    for n in range(6):
        new = {i: (i, f"n{n}", float(n)) for i in rng.sample(range(8), 3)}
        gone = rng.sample(range(8), 2)
        backend.append({"Item": (ITEM, Changes(rows(spark, *new.values()), spark.createDataFrame([(i,) for i in gone], "id long")))}, {})
        want |= new
        for i in gone:
            want.pop(i, None)
        assert stored(backend) == sorted(want.values())
    assert len(backend.folder.names("tables/Item")) == 1
    assert stored(ParquetBackend(spark, str(tmp_path / "s"))) == sorted(want.values())
    backend.compact(ITEM)
    backend.collect_garbage(keep=1)
    assert stored(backend) == sorted(want.values()) and backend.folder.names("deltas/Item") == []
    backend.append({"Item": (ITEM, Changes(cleared=True))}, {})
    assert stored(backend) == []


def test_one_of_two_savers_fails_and_nothing_is_half_written(spark, tmp_path):
    a, b = (ParquetBackend(spark, str(tmp_path / "s")) for _ in range(2))
    a.append({"Item": (ITEM, Changes(rows(spark, (1, "a", 1.0))))}, {})
    with pytest.raises(ConcurrentSaveError):
        b.append({"Item": (ITEM, Changes(rows(spark, (2, "b", 2.0))))}, {})
    assert a.folder.names("manifests") == [f"{0:012d}.json"]
    b.refresh()
    assert stored(b) == [(1, "a", 1.0)]
    with pytest.raises(Exception, match="exist"):
        a.folder.write_new(f"manifests/{0:012d}.json", "{}")
    assert stored(ParquetBackend(spark, str(tmp_path / "s"))) == [(1, "a", 1.0)]


@pytest.mark.parametrize("kind", ["memory", "parquet"])
def test_limits_clearing_and_transactions(spark, tmp_path, kind):
    backend = MemoryBackend(spark) if kind == "memory" else ParquetBackend(spark, str(tmp_path / "s"))
    metrics = Metrics()
    engine = Engine(spark, Catalog(Version(1), (ITEM,)), backend, delegate=metrics)
    s = engine.session()
    s.insert("Item", id=1, name="x" * 10_001, size=1.0)
    with pytest.raises(SizeLimitError, match="Item_name"):
        s.save()
    s.rollback()
    big = entity("Big", "id string, text string")
    other = Engine(spark, Catalog(Version(1), (big,)), MemoryBackend(spark)).session()
    for values in ({"id": "k" * 10_001, "text": ""}, {"id": "k", "text": "y" * 100_001}):
        other.insert("Big", **values)
        with pytest.raises(SizeLimitError):
            other.save()
        other.rollback()

    assert engine.transaction(lambda t: [t.insert("Item", id=i, name="ab"[i % 2], size=1.0) for i in range(4)] and "done") == "done"
    with pytest.raises(ValueError):
        engine.transaction(lambda t: (t.insert("Item", id=9, name="z", size=1.0), int("no")))
    assert len(engine.session().rows("Item", Query())) == 4
    engine.build_index("Item_name")
    s = engine.session()
    s.insert("Item", id=5, name="pending", size=1.0)
    s.delete_all("Item")
    s.insert("Item", id=7, name="new", size=2.0)
    assert [r.id for r in s.rows("Item")] == [7] and engine.session().count("Item") == 4
    s.save()
    assert stored(backend) == [(7, "new", 2.0)] and [tuple(r) for r in engine.index("Item_name").collect()] == [("new", 1)]
    s.delete("Item", 7)
    s.save()
    engine.clear("Item")
    assert stored(backend) == [] and engine.index("Item_name").isEmpty()
    assert metrics.counts["delete"] == 1 and metrics.counts["fetched.rows"] == 5 and metrics.counts["batch.inserts"] == 5 and metrics.counts["build"] == 1
    metrics.reset()
    assert metrics.counts == {}
    assert engine.version is None
    engine.set_version(Version(2, 1))
    assert engine.version == Version(2, 1)


def test_options_reach_their_kind(spark):
    doc = entity("Doc", "id long, text string, v array<double>, x double, y double", IndexSpec(kinds.FullText(), ("text",)), IndexSpec(kinds.Vector(), ("v",)), IndexSpec(kinds.Spatial(), ("x", "y")))
    data = spark.createDataFrame([(1, "The red fox", [1.0, 0.0], 10.0, 50.0), (2, "the dog", [5.0, 5.0], 10.001, 50.001), (3, None, None, -120.0, -33.0)], doc.schema)
    options = [IndexConfiguration("Doc", "Doc_text", "fulltext", {"stop_words": ("the",)}), IndexConfiguration("Doc", "Doc_v", "vector", {"metric": "dotProduct"}), IndexConfiguration("Doc", "Doc_v", "vector", {"dimensions": 2}), IndexConfiguration("Doc", "Doc_x_y", "spatial", {"level": 8})]
    engine = Engine(spark, Catalog(Version(1), (doc,)), MemoryBackend(spark, {"Doc": data}), settings=Settings(tuple(options)))
    for i in ("Doc_text", "Doc_v", "Doc_x_y"):
        engine.build_index(i)
    _, text = engine.catalog.owner("Doc_text")
    _, vector = engine.catalog.owner("Doc_v")
    assert {r.term for r in engine.index("Doc_text").collect()} == {"red", "fox", "dog"}
    assert [r.id for r in text.kind.matches(engine.index("Doc_text"), "Fox", "red").collect()] == [1]
    assert [r.id for r in vector.kind.nearest(engine.index("Doc_v"), [1.0, 0.0], 2).collect()] == [2, 1]
    cells = {r.id: r.cell for r in engine.index("Doc_x_y").collect()}
    assert cells[1] == cells[2] != cells[3]
    for wrong in ({"metric": "other"}, {"unknown": 1}):
        with pytest.raises(ConfigurationError):
            Engine(spark, Catalog(Version(1), (doc,)), MemoryBackend(spark), [IndexConfiguration("Doc", "Doc_v", "vector", wrong)])
    with pytest.raises(ConfigurationError):
        kinds.Spatial(level=99)
    with pytest.raises(ConfigurationError):
        kinds.FullText(tokenizer="morphological")


def test_registry():
    catalog = Catalog(Version(1), (ITEM,))
    more = catalog.registered("Item", IndexSpec(kinds.Scalar(), ("size",)))
    assert [i.name for i in more.indexes_of("Item")] == ["Item_name", "Item_size"]
    with pytest.raises(DuplicateIndexName):
        more.registered("Item", IndexSpec(kinds.Scalar(), ("size",)))
    assert more.unregistered("Item_size").index_names == {"Item_name"}


def test_history_and_roll_back(spark):
    spec = entity("Page", "id long, title string", IndexSpec(kinds.History(keep_last=2), ("id",)))
    engine = Engine(spark, Catalog(Version(1), (spec,)), MemoryBackend(spark))
    engine.build_index("Page_id")
    s = engine.session()
    times = []
    for title in ("one", "two", "three"):
        s.insert("Page", id=1, title=title)
        s.save()
        times.append(time.time())
        time.sleep(0.02)
    assert [r.row.title for r in s.versions("Page_id", 1).collect()] == ["two", "three"]
    assert s.roll_back("Page_id", 1, times[1])
    s.save()
    assert s.get("Page", 1).title == "two"
    assert not s.roll_back("Page_id", 1, 1.0)
    s.save()
    assert s.get("Page", 1) is None


def test_custom_strategy(spark):
    class Sorted(kinds.Scalar):
        def strategy(self, df, entity, spec):
            return self.build(df, entity, spec).orderBy("name").coalesce(1)

    spec = entity("Item", "id long, name string, size double", IndexSpec(Sorted(), ("name",)))
    engine = Engine(spark, Catalog(Version(1), (spec,)), MemoryBackend(spark, {"Item": rows(spark, (1, "b", 1.0), (2, "a", 1.0))}))
    engine.build_index("Item_name")
    assert [r.name for r in engine.index("Item_name").collect()] == ["a", "b"]


def test_scrubbing(spark):
    metrics = Metrics()
    spec = entity("Item", "id long, name string, size double", IndexSpec(kinds.Scalar(), ("name",)))
    engine = Engine(spark, Catalog(Version(1), (spec,)), MemoryBackend(spark, {"Item": rows(spark, (1, "a", 1.0), (2, "b", 1.0))}), delegate=metrics)
    engine.build_index("Item_name")
    engine.backend.commit({"Item": rows(spark, (2, "b", 1.0), (3, "c", 1.0))}, {})
    found = scrub.scrub(engine, "Item_name", scrub.Scrubbing.conservative())
    assert not found.healthy and (found.report.dangling, found.report.missing, found.repaired) == (1, 1, 0)
    fixed = scrub.scrub(engine, "Item_name", scrub.Scrubbing.aggressive())
    assert fixed.healthy and fixed.repaired == 2
    assert scrub.scrub(engine, "Item_name").report.healthy
    assert metrics.counts["scrub"] == 3 and metrics.counts["scrub.repaired"] == 2
    calls = []
    plain = engine.backend.read_index
    engine.backend.read_index = lambda name: (calls.append(1), plain(name) if len(calls) > 2 else None)[1]
    assert scrub.scrub(engine, "Item_name", scrub.Scrubbing(retry_delay=0.0)).attempts == 3
    engine.backend.read_index = lambda name: None
    with pytest.raises(ScrubError):
        scrub.scrub(engine, "Item_name", scrub.Scrubbing(max_retries=1, retry_delay=0.0))
    assert scrub.Scrubbing.default() == scrub.Scrubbing()


def test_autosave_waits_for_the_last_change(spark):
    engine = Engine(spark, Catalog(Version(1), (ITEM,)), MemoryBackend(spark), delegate=(metrics := Metrics()), settings=Settings(autosave_delay=0.3))
    s = engine.session()
    for n in range(5):
        s.insert("Item", id=n, name="a", size=1.0)
        time.sleep(0.02)
    assert s.has_changes and metrics.counts.get("save", 0) == 0
    until = time.time() + 20
    while s.has_changes and time.time() < until:
        time.sleep(0.05)
    s._timer.join(20)
    assert metrics.counts["save"] == 1 and engine.session().count("Item") == 5
    s.insert("Item", id=9, name="x" * 20_000, size=1.0)
    s._timer.join(20)
    assert s.has_changes and metrics.counts["failed.save"] == 1  # the error stays with the delegate
    assert threading.active_count() > 0


def test_streams_of_changes(spark, tmp_path):
    backend = ParquetBackend(spark, str(tmp_path / "s"))
    spark.createDataFrame([(1, "a", 1.0, False, 1), (1, "b", 2.0, False, 2), (2, "c", 1.0, False, 1), (2, "c", 1.0, True, 2), (3, "d", 1.0, None, 1)], "id long, name string, size double, gone boolean, at int").write.parquet(f"{tmp_path}/in")
    stream = maintain.read_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    maintain.upsert(stream, backend, ITEM, f"{tmp_path}/c", deleted="gone", order="at").awaitTermination()
    assert stored(backend) == [(1, "b", 2.0), (3, "d", 1.0)]
    assert backend.metadata()["stream.Item"] == 0
    kind = "struct<id:bigint,name:string,size:double>"
    spark.createDataFrame([(None, (1, "a", 1.0)), (None, (2, "a", 1.0)), ((1, "a", 1.0), (1, "b", 1.0)), ((2, "a", 1.0), None)], f"before {kind}, after {kind}").coalesce(1).write.parquet(f"{tmp_path}/changes")
    held = {}
    maintain.maintain_changes(maintain.read_stream(spark, f"{tmp_path}/changes", spark.read.parquet(f"{tmp_path}/changes").schema), lambda: held.get("index"), lambda df, n: held.update(index=spark.createDataFrame(df.collect(), df.schema)), ITEM, ITEM.indexes[0], f"{tmp_path}/c2").awaitTermination()
    assert [tuple(r) for r in held["index"].collect()] == [("b", 1)]


def test_sums_do_not_drift(spark):
    spec = IndexSpec(kinds.Sum(), ("name", "size"))
    owner = EntitySpec("Item", ITEM.schema, "id", (spec,))
    first, second = rows(spark, (1, "a", 0.1), (2, "a", 0.2)), rows(spark, (1, "a", 0.1))
    index = spec.kind.build(first, owner, spec)
    for _ in range(3):
        index = spec.kind.merged(spec.kind.merged(index, second, second.limit(0), owner, spec), second.limit(0), second, owner, spec)
    assert [(r.name, r.total, r.n) for r in index.collect()] == [("a", 0.3, 2)]


def test_key_values(spark):
    schema = fields_of("id long, small int, f float, t string, flag boolean")
    df = spark.createDataFrame([(1, 2, 0.5, "x", True)], schema)
    assert dict(df.select(*[keys.key_column(schema, c).alias(c) for c in schema.names]).dtypes) == {"id": "bigint", "small": "bigint", "f": "double", "t": "string", "flag": "boolean"}
    wide = spark.createDataFrame([(Decimal(2**63 - 1),), (Decimal(2**63),)], "n decimal(20,0)")
    assert wide.where("n < 9223372036854775808").select(keys.key_column(wide.schema, "n").alias("n")).first().n == 2**63 - 1
    with pytest.raises(Exception, match="too large for a key"):
        wide.select(keys.key_column(wide.schema, "n")).collect()
    nested = spark.createDataFrame([(1, [1.0], {"a": 1})], "id long, v array<double>, m map<string,int>")
    for path in ("v", "m"):
        with pytest.raises(TypeValidationError):
            keys.key_column(nested.schema, path)
    assert [tuple(r) for r in keys.elements(nested, "id", "v").collect()] == [(1, 0, 1.0)]
    assert df.select(*keys.id_columns(keys.from_paths(["id", "t"]), schema)).columns == ["id_0", "id_1"]


def test_double_hash_and_sketch_parts(spark):
    import struct

    for x in (0.0, -1.5, 3.14159, 1e300):
        want = sketch.fnv1a(struct.pack("<d", x), sketch.fnv1a((sketch.TAGS["double"]).to_bytes(8, "little")))
        assert spark.range(1).select(sketch.hash_hex(sketch.hash_double(F.lit(x))).alias("h")).first().h == f"{want:016x}"
    some = sketch.registers(spark.range(5), sketch.hash_int(F.col("id")))
    assert not sketch.is_empty(some) and sketch.is_empty(sketch.reset(some)) and sketch.size_in_bytes() == 16384


@pytest.mark.parametrize("group", [None, ["g"]])
def test_ranges_over_stretches(spark, monkeypatch, group):
    """Joined ranges are the same however the lower ends are cut."""
    monkeypatch.setattr(rangeset, "CUTS", 7)
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), lo := rng.randint(0, 400), lo + rng.choice([0, 1, 2, 3, 60])) for _ in range(150)] + [("a", 10, 300)]
    want = []
    for g in ({d[0] for d in data} if group else {None}):
        mine = [(lo, hi) for x, lo, hi in data if not group or x == g]
        want += [((g,) if group else ()) + r for r in rangeset.RangeSet(mine).todo]
    got = [tuple(r) for r in rangeset.normalized(spark.createDataFrame(data, "g string, lo long, hi long"), group).collect()]
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    assert sorted(got, key=lambda r: str(key(r))) == sorted(want, key=lambda r: str(key(r)))


def test_migrate_to(spark):
    old = Catalog(Version(1), (entity("Item", "id long, name string", IndexSpec(kinds.Count(), ("name",))),))
    new = Catalog(Version(2), (entity("Item", "id long, name string, size double", IndexSpec(kinds.Scalar(), ("name",), name="byName"), defaults={"size": 1.5}),))
    backend = MemoryBackend(spark, {"Item": spark.createDataFrame([(1, "a")], "id long, name string")})
    engine = Engine(spark, old, backend)
    engine.set_version(Version(1))
    engine.build_index("Item_name")
    seen = []
    assert migrate.migrate_to(engine, new, [(Version(1, 5), lambda c: seen.append(c.count("Item")))]) == [Version(1, 5), Version(2)]
    assert seen == [1] and engine.version == Version(2) and engine.session().get("Item", 1).size == 1.5
    assert [tuple(r) for r in engine.index("byName").collect()] == [("a", 1)]
    assert migrate.migrate_to(engine, new) == []
    with pytest.raises(MigrationError):
        migrate.migrate_to(engine, old)
    with pytest.raises(MigrationError):
        migrate.migrate_to(engine, Catalog(Version(3), (entity("Item", "id long"),)))
