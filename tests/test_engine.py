"""Declarations, sessions, stores, index upkeep, migration."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quillstone import migrate
from quillstone.catalog import Catalog, IndexConfiguration, IndexState, IndexStates
from quillstone.errors import ConcurrentSaveError, ConfigurationError, DuplicateIndexName, EngineError, IndexStateError, MigrationError, SchemaError, TypeValidationError, UniqueViolation
from quillstone.model import EntitySpec, IndexSpec, VectorOptions, Version, entity
from quillstone.operators import kinds, overlay, scrub
from quillstone.plans.predicate import field
from quillstone.plans.query import Query
from quillstone.session import Engine, Metrics
from quillstone.sources.layout import directory_path
from quillstone.sources.storage import Folder, MemoryBackend, ParquetBackend

USER = entity("User", "id long, email string, name string, age long", IndexSpec(kinds.Scalar(), ("email",), unique=True), IndexSpec(kinds.Count(), ("name",)), IndexSpec(kinds.Sum(), ("name", "age")), defaults={"age": 0})


def engine_of(spark, backend=None, **more):
    return Engine(spark, Catalog(Version(1), (USER,)), backend or MemoryBackend(spark), **more)


def test_declarations():
    assert [i.name for i in USER.indexes] == ["User_email", "User_name", "User_name_age"]
    assert entity("T", "name string").fields == ["id", "name"]
    assert EntitySpec("T", USER.schema, transient=("age",)).fields == ["id", "email", "name"]
    assert USER.field_number("name") == 3
    with pytest.raises(SchemaError):
        USER.field_number("none")
    with pytest.raises(DuplicateIndexName):
        Catalog(Version(1), (entity("A", "c string", IndexSpec(kinds.Scalar(), ("c",)), IndexSpec(kinds.Count(), ("c",))),))
    with pytest.raises(TypeValidationError):
        Catalog(Version(1), (entity("A", "c string", IndexSpec(kinds.Sum(), ("c", "c"))),))
    with pytest.raises(TypeValidationError):
        Catalog(Version(1), (entity("A", "c long", IndexSpec(kinds.Sum(), ("c",))),))
    with pytest.raises(SchemaError):
        Catalog(Version(1), (entity("A", "id date, c long"),))
    assert Version.parse("1.2") < Version(1, 10) and str(Version.parse("3")) == "3.0.0"
    with pytest.raises(SchemaError):
        directory_path(["a", "b"])
    assert directory_path(["app", ("tenant", 7)]) == "app/tenant=7"


def test_configuration():
    catalog = Catalog(Version(1), (USER,))
    assert len(catalog.configured([IndexConfiguration("User", "User_email", "scalar")] * 2)["User_email"]) == 2
    for wrong in (IndexConfiguration("User", "none", "scalar"), IndexConfiguration("Else", "User_email", "scalar"), IndexConfiguration("User", "User_email", "count")):
        with pytest.raises(ConfigurationError):
            catalog.configured([wrong])
    with pytest.raises(ConfigurationError):
        VectorOptions("flat", parameters={"m": 3})


def test_states():
    s = IndexStates()
    assert s.of("a") is IndexState.DISABLED and not s.of("a").is_maintained
    with pytest.raises(IndexStateError):
        s.move("a", IndexState.READABLE)
    s.move("a", IndexState.WRITE_ONLY)
    with pytest.raises(IndexStateError):
        s.require_readable("a")
    s.move("a", IndexState.READABLE)
    assert IndexStates(s.as_dict()).of("a") is IndexState.READABLE


@pytest.mark.parametrize("kind", ["memory", "parquet"])
def test_session(spark, tmp_path, kind):
    backend = MemoryBackend(spark) if kind == "memory" else ParquetBackend(spark, str(tmp_path / "store"))
    metrics = Metrics()
    engine = engine_of(spark, backend, delegate=metrics)
    s = engine.main
    for n in (1, 2, 3):
        s.insert("User", id=n, email=f"e{n}", name="ab"[n % 2])
    assert s.has_changes and s.count("User") == 3 and s.get("User", 2).age == 0
    s.save()
    assert not s.has_changes and engine.session().count("User") == 3
    for i in USER.indexes:
        engine.build_index(i.name)
    s.insert("User", id=2, email="e2", name="b", age=7)
    s.delete("User", 1)
    assert [r.id for r in s.fetch("User", Query().order_by("id")).collect()] == [2, 3]
    assert engine.session().count("User") == 3
    s.save()
    assert [tuple(r) for r in engine.index("User_name").collect()] == [("b", 2)]
    assert scrub.check(engine.index("User_email"), s.view("User"), USER, USER.indexes[0]).healthy
    s.insert("User", id=9, email="e2", name="c")
    with pytest.raises(UniqueViolation):
        s.save()
    assert s.has_changes
    s.rollback()
    assert not s.has_changes
    with pytest.raises(RuntimeError), s.saving():
        s.insert("User", id=10, email="x", name="x")
        raise RuntimeError
    assert s.get("User", 10) is None
    seen = []
    s.enumerate("User", seen.append)
    assert len(seen) == 2 and metrics.counts["save"] == 2 and metrics.counts["failed.save"] == 1
    assert s.delete_where("User", field("name") == "b") >= 1


def test_pending_rules(spark):
    s = engine_of(spark, MemoryBackend(spark, {"User": spark.createDataFrame([(1, "e", "n", 1)], USER.schema)})).session()
    s.delete("User", 1)
    s.insert("User", id=1, email="new", name="n")
    assert s.get("User", 1).email == "new"
    s.delete("User", 1)
    assert s.get("User", 1) is None
    s._saving = True
    with pytest.raises(ConcurrentSaveError):
        s.save()


def test_parquet_store(spark, tmp_path):
    root = str(tmp_path / "s")
    a, b = ParquetBackend(spark, root, {"User": ("name",)}), ParquetBackend(spark, root, {"User": ("name",)})
    rows = spark.createDataFrame([(1, "e", "n", 1)], USER.schema)
    a.commit({"User": rows}, {})
    with pytest.raises(ConcurrentSaveError):
        b.commit({"User": rows}, {})
    b.refresh()
    assert b.read(USER).collect() == rows.collect()
    for _ in range(3):
        b.commit({"User": rows}, {})
    assert b.collect_garbage(1) == 4 and b.read(USER).count() == 1
    plan = b.read(USER).where("name = 'n'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(name" in plan


def test_folder(spark, tmp_path):
    f = Folder(spark, str(tmp_path))
    f.create("a/b")
    with pytest.raises(SchemaError):
        f.create("a/b")
    f.move("a/b", "a/c")
    assert f.names("a") == ["c"] and f.open("a/c").endswith("a/c") and not f.exists("a/b")
    f.write_new("x.json", "{}")
    with pytest.raises(Exception):
        f.write_new("x.json", "{}")
    assert f.read_text("x.json") == "{}" and f.remove("a") and not f.exists("a")


rows_of = st.lists(st.tuples(st.integers(1, 6), st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-5, 5))), unique_by=lambda r: r[0], max_size=6)


@given(rows_of, rows_of, st.sets(st.integers(1, 8), max_size=3))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_incremental_is_recomputed(spark, base, changed, gone):
    schema = "id long, g string, v long"
    base, changed = (spark.createDataFrame(r, schema) for r in (base, changed))
    ids = spark.createDataFrame([(i,) for i in gone], "id long")
    after = overlay.applied(base, changed, ids, "id")
    touched = changed.select("id").union(ids).distinct()
    old, new = (df.join(touched, "id", "left_semi") for df in (base, after))
    for kind, paths in ((kinds.Count(), ("g",)), (kinds.Sum(), ("g", "v")), (kinds.Average(), ("g", "v")), (kinds.Min(), ("g", "v")), (kinds.Scalar(), ("g", "v"))):
        spec = IndexSpec(kind, paths)
        e = entity("E", schema, spec)
        merged = kind.merged(kind.build(base, e, spec), old, new, e, spec)
        assert sorted(merged.collect()) == sorted(kind.build(after, e, spec).select(*merged.columns).collect())


def test_extremes_and_history(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", 1), (4, "b", None)], "id long, g string, v long")
    spec = IndexSpec(kinds.Max(), ("g", "v"))
    e = entity("E", df.schema, spec)
    index = kinds.Max().build(df, e, spec)
    assert [tuple(r) for r in kinds.Max().of_groups(index, spec).collect()] == [("a", 5, 1)]
    assert [r.id for r in kinds.Max().listed(index, spec, 2).orderBy("place").collect()] == [1, 2]
    h = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k long, t long")
    assert h.count() == kinds.History().retained(h, "k", ["t"]).count()
    assert sorted(map(tuple, kinds.History(keep_last=1).retained(h, "k", ["t"]).collect())) == [(1, 2), (2, 1)]
    assert sorted(map(tuple, kinds.as_of(h, "k", ["t"], F.lit(1)).collect())) == [(1, 1), (2, 1)]


def catalogs():
    v1 = entity("User", "id long, name string, email string", IndexSpec(kinds.Scalar(), ("email",), unique=True))
    v2 = entity("User", "id long, name string, email string, age long", IndexSpec(kinds.Scalar(), ("email",), unique=True), IndexSpec(kinds.Scalar(), ("age",)), defaults={"age": 0})
    v3 = entity("User", "id long, name string, email string, age long, created double", IndexSpec(kinds.Scalar(), ("email",), unique=True), IndexSpec(kinds.Count(), ("created",)), defaults={"age": 0, "created": 0.0})
    return tuple(Catalog(Version(n), (e,)) for n, e in ((1, v1), (2, v2), (3, v3)))


def test_migration(spark):
    c1, c2, c3 = catalogs()
    said = []
    plan = migrate.Plan((c1, c2, c3), (migrate.Stage(Version(1), Version(2)), migrate.Stage(Version(2), Version(3), will=lambda c: c.update("User", field("name") == "a", age=F.lit(5)), did=lambda c: said.append(c.count("User")))))
    backend = MemoryBackend(spark, {"User": spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], c1.entity("User").schema)})
    engine = Engine(spark, c1, backend)
    engine.backend.commit({}, {}, {"version": "1.0.0"})
    assert plan.migrate(engine) == [Version(2), Version(3)]
    assert sorted(map(tuple, backend.read(c3.entity("User")).collect())) == [(1, "a", "x", 5, 0.0), (2, "b", "y", 0, 0.0)]
    assert said == [2] and engine.index("User_created").first().n == 2
    with pytest.raises(IndexStateError):
        engine.states().require_readable("User_age")
    assert plan.migrate(engine) == [] and backend.metadata()["former"][0][0] == "User_age"
    fresh = Engine(spark, c1, MemoryBackend(spark))
    assert plan.migrate(fresh) == [Version(3)]


def test_plan_errors():
    c1, c2, c3 = catalogs()
    s12, s23 = migrate.Stage(Version(1), Version(2)), migrate.Stage(Version(2), Version(3))
    for wrong in (migrate.Plan((), ()), migrate.Plan((c1, c1), (s12,)), migrate.Plan((c2, c1), (s12,)), migrate.Plan((c1, c2, c3), (s12,)), migrate.Plan((c1, c2), (s23,))):
        with pytest.raises(MigrationError):
            wrong.validate()
    plan = migrate.Plan((c1, c2, c3), (s12, s23))
    assert plan.path(Version(1), Version(3)) == [s12, s23] and plan.path(Version(2), Version(2)) == []
    for a, b in ((Version(3), Version(1)), (Version(1), Version(9))):
        with pytest.raises(MigrationError):
            plan.path(a, b)
    assert c1.is_lightweight(c2) and not c2.is_lightweight(c1) and c1.is_lightweight(c2, per_entity=True)
    assert issubclass(MigrationError, EngineError)
