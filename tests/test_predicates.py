"""Two-valued predicates: compiled conditions against plain evaluation, and what reaches the scan."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from quillstone.errors import PredicateError, SchemaError
from quillstone.plans.predicate import FALSE, TRUE, And, Not, Or, as_value, compile, evaluate, field
from quillstone.plans.query import Query, best_index

ROWS = [(1, None, 1.5), (2, "a", None), (3, "b", 2.5), (4, "ab", -1.0), (5, "", 0.0), (6, None, None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, s string, x double").cache()


leaves = st.one_of(
    st.sampled_from([TRUE, FALSE, field("s").is_nil(), field("s").is_not_nil(), field("x").is_nil()]),
    st.builds(lambda op, v: getattr(field("s"), op)(v), st.sampled_from(["__eq__", "__ne__", "__lt__", "__ge__", "contains", "has_prefix", "has_suffix"]), st.sampled_from(["a", "b", "", "ab"])),
    st.builds(lambda op, v: getattr(field("x"), op)(v), st.sampled_from(["__eq__", "__ne__", "__lt__", "__le__", "__gt__", "__ge__"]), st.sampled_from([-1.0, 0.0, 1.5, 9.0])),
    st.builds(lambda vs: field("s").is_in(vs), st.lists(st.sampled_from(["a", "b", "c"]), max_size=3)),
)
trees = st.recursive(leaves, lambda p: st.one_of(st.builds(Not, p), st.builds(lambda a: And(tuple(a)), st.lists(p, max_size=3)), st.builds(lambda a: Or(tuple(a)), st.lists(p, max_size=3))), max_leaves=6)


@given(trees)
@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_compiled_is_evaluated(rows, tree):
    want = {i for i, s, x in ROWS if evaluate(tree, {"s": s, "x": x})}
    assert {r.id for r in rows.where(compile(tree, rows.schema)).collect()} == want
    assert {r.id for r in rows.where(compile(tree, rows.schema, wanted=False)).collect()} == {r[0] for r in ROWS} - want
    assert {r.id for r in rows.select("id", as_value(tree, rows.schema).alias("v")).collect() if r.v} == want


def test_errors(rows):
    with pytest.raises(PredicateError):
        field("s") == None  # noqa: E711
    with pytest.raises(PredicateError):
        compile(field("x").contains("a"), rows.schema)
    with pytest.raises(SchemaError):
        compile(field("none") == 1, rows.schema)


def test_arrays(spark):
    df = spark.createDataFrame([(1, [3, 1]), (2, []), (3, None)], "id long, a array<long>")
    ids = lambda p: {r.id for r in df.where(compile(p, df.schema)).collect()}
    assert ids(field("a") == 3) == {1}
    assert ids(field("a").is_nil()) == {2, 3}
    assert ids(~(field("a") == 3)) == {2, 3}


def test_pushdown_and_single_topk(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    q = Query().where((field("o_orderstatus") == "O") & ~(field("o_totalprice") > 5.0)).order_by("o_orderkey").offset(5).limit(10)
    plan = q.plan(df)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(o_orderstatus,O)" in plan and "LessThanOrEqual" in plan
    assert "TakeOrderedAndProject" in plan


def test_query_semantics(rows):
    q = Query().order_by("s").order_by("id")
    assert [r.id for r in q.plan(rows).collect()] == [1, 6, 5, 2, 4, 3]
    assert q.offset(-3).limit(1).first(rows).id == 1
    assert q.limit(1).offset(2).count(rows) == 6
    assert Query().where(FALSE).first(rows) is None


def test_best_index():
    from quillstone.model import IndexSpec, entity
    from quillstone.operators.kinds import Count, Scalar

    e = entity("E", "id long, a long, b long, c long", IndexSpec(Scalar(), ("a",)), IndexSpec(Scalar(), ("a", "b")), IndexSpec(Count(), ("c",)))
    assert best_index(e, Query().where((field("a") == 1) & (field("b") == 2))).name == "E_a_b"
    assert best_index(e, Query().where(field("a") > 1)).name == "E_a"
    assert best_index(e, Query().where(field("c") == 1)) is None
