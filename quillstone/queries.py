"""Demonstration queries of every operator over the given tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import migrate
from .catalog import Catalog, IndexState
from .functions import keys as K
from .functions import rangeset, sketch, values
from .model import EntitySpec, EnumSpec, IndexSpec, Version, type_at
from .operators import kinds, overlay, scrub, search
from .plans.predicate import FALSE, TRUE, Predicate, as_value, field
from .plans.query import Query
from .sources.storage import MemoryBackend
from .streaming import maintain

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Run], Run]:
    """Registers a function, with its SQL, under its name."""

    def register(run: Run) -> Run:
        QUERIES[name or run.__name__] = run
        if sql:
            ORACLES[name or run.__name__] = sql
        return run

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plain(name: str, table: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """Registers a query over one table."""
    query(sql, name)(lambda spark, sf_dir: build(read(spark, sf_dir, table)))


def entity_of(df: DataFrame, name: str, id_col: str, *indexes: IndexSpec, **more) -> EntitySpec:
    return EntitySpec(name, df.schema, id_col, indexes, **more)


# scans -------------------------------------------------------------------------------

plain("scan_all", "customer", lambda df: df, "select * from customer")
plain("point_get", "orders", lambda df: Query().where(field("o_orderkey") == 7).limit(1).plan(df), "select * from orders where o_orderkey = 7 limit 1")


@query("select o.*, i.place from orders o join (values (7, 0), (3, 1), (1, 2), (99999999, 3), (5, 4)) i(id, place) on o.o_orderkey = i.id")
def multi_get(spark, sf_dir):
    ids = spark.createDataFrame([(7, 0), (3, 1), (1, 2), (99999999, 3), (5, 4)], "o_orderkey long, place int")
    return overlay.multi_get(read(spark, sf_dir, "orders"), F.broadcast(ids), "o_orderkey", "place")


for _name, _p, _sql in (
    ("index_scan_eq", field("p_size") == 15, "p_size = 15"),
    ("index_scan_gt", field("p_size") > 40, "p_size > 40"),
    ("index_scan_ge", field("p_size") >= 40, "p_size >= 40"),
    ("index_scan_lt", field("p_size") < 10, "p_size < 10"),
    ("index_scan_le", field("p_size") <= 10, "p_size <= 10"),
):
    plain(_name, "part", lambda df, p=_p: Query().where(p).plan(df), f"select * from part where {_sql}")

plain("count_all", "lineitem", lambda df: Query().counted(df), "select count(*) as n from lineitem")
plain("count_where_eq", "lineitem", lambda df: Query().where(field("l_returnflag") == "R").counted(df), "select count(*) as n from lineitem where l_returnflag = 'R'")
plain("count_where_range", "lineitem", lambda df: Query().where(field("l_quantity") > 30.0).where(field("l_quantity") <= 40.0).counted(df), "select count(*) as n from lineitem where l_quantity > 30 and l_quantity <= 40")
plain("keyset_page", "orders", lambda df: overlay.keyset_page(df, "o_orderkey", 500, 100), "select * from orders where o_orderkey > 500 order by o_orderkey limit 100")


@query("select * from orders where o_orderstatus = 'O' and o_totalprice > 100000")
def partition_pruned_scan(spark, sf_dir):
    """Orders laid out by status; the scan opens one partition only."""
    from .sources.layout import partitioned_table

    laid = partitioned_table(read(spark, sf_dir, "orders"), ("o_orderstatus",))
    return Query().where(field("o_orderstatus") == "O").where(field("o_totalprice") > 100000.0).plan(laid)


# projections -------------------------------------------------------------------------

def keyed(key, *as_names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(*[c.alias(n) for c, n in zip(K.columns(key, df.schema), as_names)])


plain("project_field", "customer", keyed(K.FieldKey("c_name"), "c_name"), "select c_name from customer")
plain("project_multi", "customer", keyed(K.from_paths(["c_custkey", "c_mktsegment"]), "c_custkey", "c_mktsegment"), "select c_custkey, c_mktsegment from customer")
plain("keyexpr_field", "part", keyed(K.from_path("p_brand"), "p_brand"), "select p_brand from part")
plain("keyexpr_concat", "part", keyed(K.Concat((K.FieldKey("p_brand"), K.FieldKey("p_size"))), "p_brand", "p_size"), "select p_brand, p_size from part")
plain("keyexpr_literal", "part", keyed(K.Concat((K.Literal("part"), K.FieldKey("p_partkey"))), "kind", "p_partkey"), "select 'part' as kind, p_partkey from part")
plain("keyexpr_empty", "part", lambda df: df.groupBy(*K.columns(K.from_path(""), df.schema)).agg(F.count("*").alias("n")), "select count(*) as n from part")


def nested(df: DataFrame) -> DataFrame:
    return df.withColumn("props", F.from_json("props", "k int"))


plain("project_nested", "events", lambda df: keyed(K.from_paths(["event_id", "props.k"]), "event_id", "k")(nested(df)), "select event_id, (props->>'k')::int as k from events")
plain("keyexpr_nest", "events", lambda df: keyed(K.Nest("props", K.FieldKey("k")), "k")(nested(df)), "select (props->>'k')::int as k from events")


def ranged(df: DataFrame) -> DataFrame:
    return df.withColumn("open", F.struct(F.col("l_shipdate").alias("lower"), (F.col("l_shipdate") + F.expr("interval 30 days")).alias("upper")))


plain(
    "range_boundary", "lineitem",
    lambda df: keyed(K.Concat((K.RangeBound("open", "lower"), K.RangeBound("open", "upper"))), "lower", "upper")(ranged(df)),
    "select l_shipdate as lower, l_shipdate + interval 30 day as upper from lineitem",
)
plain(
    "array_flatten", "embeddings", lambda df: K.elements(df, "vec_id", "embedding").select(F.col("id").alias("vec_id"), "place", F.col("value").cast("double").alias("value")),
    "select vec_id, unnest(range(len(embedding)))::int as place, unnest(embedding)::double as value from embeddings",
)
plain(
    "key_widening", "orders", lambda df: df.select("o_orderkey", *[K.key_column(df.schema, c).alias(f"k_{c}") for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate")]),
    "select o_orderkey, o_orderkey::bigint as k_o_orderkey, o_custkey::bigint as k_o_custkey, o_totalprice::double as k_o_totalprice, o_orderstatus as k_o_orderstatus, o_orderdate as k_o_orderdate from orders",
)

# predicates --------------------------------------------------------------------------

#: Orders whose priority is missing where it was '5-LOW': the tables hold no nulls of their own.
GAPS = "(select o_orderkey, nullif(o_orderpriority, '5-LOW') as priority, o_totalprice, o_orderstatus from orders)"


def gaps(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), "o_totalprice", "o_orderstatus")


def filtered(name: str, predicate: Predicate, condition: str) -> None:
    plain(name, "orders", lambda df: Query().where(predicate).plan(gaps(df)), f"select * from {GAPS} where {condition}")


_priority, _price, _status = field("priority"), field("o_totalprice"), field("o_orderstatus")
filtered("filter_eq", _status == "F", "o_orderstatus = 'F'")
filtered("filter_ne", _status != "F", "o_orderstatus <> 'F'")
filtered("filter_ne_null", _priority != "1-URGENT", "priority <> '1-URGENT'")
filtered("filter_lt", _price < 50000.0, "o_totalprice < 50000")
filtered("filter_le", _price <= 50000.0, "o_totalprice <= 50000")
filtered("filter_gt", _price > 150000.0, "o_totalprice > 150000")
filtered("filter_ge", _price >= 150000.0, "o_totalprice >= 150000")
filtered("filter_contains", _priority.contains("IU"), "contains(priority, 'IU')")
filtered("filter_has_prefix", _priority.has_prefix("2"), "starts_with(priority, '2')")
filtered("filter_has_suffix", _priority.has_suffix("H"), "ends_with(priority, 'H')")
filtered("filter_in", _priority.is_in(["1-URGENT", "2-HIGH"]), "priority in ('1-URGENT', '2-HIGH')")
filtered("filter_is_nil", _priority.is_nil(), "priority is null")
filtered("filter_is_not_nil", _priority.is_not_nil(), "priority is not null")
filtered("filter_and", (_status == "O") & (_price > 100000.0) & (_priority == "2-HIGH"), "o_orderstatus = 'O' and o_totalprice > 100000 and priority = '2-HIGH'")
filtered("filter_or", (_status == "P") | (_price < 20000.0), "o_orderstatus = 'P' or o_totalprice < 20000")
filtered("filter_not", ~(_status == "O"), "o_orderstatus is distinct from 'O'")
filtered("filter_not_null", ~((_priority == "1-URGENT") | (_priority == "2-HIGH")), "coalesce(priority, '') not in ('1-URGENT', '2-HIGH')")
filtered("filter_true", TRUE, "true")
filtered("filter_false", FALSE, "false")
filtered("filter_mixed_numeric", field("o_orderkey") < 99.5, "o_orderkey < 99.5")
plain("filter_chained", "orders", lambda df: Query().where(_status == "O").where(_price > 100000.0).plan(gaps(df)), f"select * from {GAPS} where o_orderstatus = 'O' and o_totalprice > 100000")
plain(
    "predicate_value", "orders",
    lambda df: gaps(df).select("o_orderkey", as_value(_priority != "1-URGENT", gaps(df).schema).alias("holds")),
    f"select o_orderkey, coalesce(priority <> '1-URGENT', false) as holds from {GAPS}",
)

# sort and limit ----------------------------------------------------------------------

def ordered(name: str, q: Query, rest: str) -> None:
    plain(name, "orders", lambda df: q.plan(gaps(df)), f"select * from {GAPS} {rest}")


ordered("sort_asc_topk", Query().order_by("priority").order_by("o_orderkey").limit(50), "order by priority nulls first, o_orderkey limit 50")
ordered("sort_desc_topk", Query().order_by("o_totalprice", True).order_by("o_orderkey").limit(50), "order by o_totalprice desc nulls last, o_orderkey limit 50")
ordered("sort_multi_topk", Query().order_by("o_orderstatus").order_by("priority", True).order_by("o_orderkey").limit(50), "order by o_orderstatus nulls first, priority desc nulls last, o_orderkey limit 50")
ordered("limit_n", Query().order_by("o_orderkey").limit(10), "order by o_orderkey limit 10")
ordered("offset_n", Query().order_by("o_orderkey").offset(40).limit(10), "order by o_orderkey limit 10 offset 40")
ordered("page_sorted", Query().order_by("o_totalprice", True).order_by("o_orderkey").offset(5).limit(20), "order by o_totalprice desc nulls last, o_orderkey limit 20 offset 5")
ordered("first_row", Query().order_by("o_totalprice").order_by("o_orderkey").limit(1), "order by o_totalprice nulls first, o_orderkey limit 1")
plain("count_where", "orders", lambda df: Query().where(~(_priority == "2-HIGH")).limit(3).offset(2).counted(gaps(df)), f"select count(*) as n from {GAPS} where priority is distinct from '2-HIGH'")

FLAGSHIP = Query().where((field("o_orderstatus") == "O") & (field("o_totalprice") > 50000.0)).where(field("o_orderpriority").is_in(["1-URGENT", "2-HIGH"])).order_by("o_totalprice", True).order_by("o_orderkey").offset(5).limit(20)
plain(
    "query_full", "orders", FLAGSHIP.plan,
    "select * from orders where o_orderstatus = 'O' and o_totalprice > 50000 and o_orderpriority in ('1-URGENT', '2-HIGH') order by o_totalprice desc nulls last, o_orderkey limit 20 offset 5",
)

# changes -----------------------------------------------------------------------------
# Updates: customers of one segment gain 100. New: every supplier as a customer. Deletions: negative balances.

UPDATES = "(select c_custkey, c_name, c_nationkey, c_acctbal + 100 as c_acctbal, c_mktsegment from customer where c_mktsegment = 'BUILDING')"
NEW = "(select s_suppkey + 100000000 as c_custkey, s_name as c_name, s_nationkey as c_nationkey, s_acctbal as c_acctbal, 'SUPPLIER' as c_mktsegment from supplier)"
UPSERTED = f"(select * from customer where c_mktsegment <> 'BUILDING' union all select * from {UPDATES} union all select * from {NEW})"


def changes(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The customers, the upserts, and the ids to delete."""
    base = read(spark, sf_dir, "customer")
    changed = base.where("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.col("c_acctbal") + 100)
    new = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100000000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit("SUPPLIER").alias("c_mktsegment"))
    return base, changed.unionByName(new), base.where("c_acctbal < 0").select("c_custkey")


@query(f"select * from {UPSERTED}")
def upsert_overlay(spark, sf_dir):
    base, rows, _ = changes(spark, sf_dir)
    return overlay.upserted(base, rows, "c_custkey")


@query("select * from customer where not c_acctbal < 0")
def delete_rows(spark, sf_dir):
    base, _, ids = changes(spark, sf_dir)
    return overlay.deleted(base, ids, "c_custkey")


plain("delete_by_id", "customer", lambda df: overlay.deleted_where(df, field("c_custkey") == 5), "select * from customer where c_custkey <> 5")
plain(
    "delete_where", "orders", lambda df: overlay.deleted_where(gaps(df), (_priority != "1-URGENT") & (_price < 100000.0)),
    f"select * from {GAPS} where coalesce(not (priority <> '1-URGENT' and o_totalprice < 100000), true)",
)


@query(f"select * from {UPSERTED} where c_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def batch_apply(spark, sf_dir):
    return overlay.applied(*changes(spark, sf_dir), "c_custkey")


def stored_customers(spark, sf_dir):
    """A Parquet store of the customers, opened at a folder of its own, and their entity."""
    from .sources.layout import scratch_folder
    from .sources.storage import ParquetBackend

    df = read(spark, sf_dir, "customer")
    customer = entity_of(df, "Customer", "c_custkey")
    backend = ParquetBackend(spark, f"{scratch_folder(spark)}/store-{uuid.uuid4().hex}")
    backend.commit({"Customer": df}, {})
    return backend, customer


@query(f"select * from {UPSERTED} where c_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def store_append(spark, sf_dir):
    """Two saves appended beside a stored table, read back with it."""
    from .sources.storage import Changes

    backend, customer = stored_customers(spark, sf_dir)
    _, rows, gone = changes(spark, sf_dir)
    backend.append({"Customer": (customer, Changes(rows))}, {})
    backend.append({"Customer": (customer, Changes(None, gone))}, {})
    return backend.read(customer)


@query(f"select * from {UPSERTED} where c_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def store_compact(spark, sf_dir):
    """The same, written as one snapshot again."""
    from .sources.storage import Changes

    backend, customer = stored_customers(spark, sf_dir)
    _, rows, gone = changes(spark, sf_dir)
    backend.append({"Customer": (customer, Changes(rows, gone))}, {})
    backend.compact(customer)
    return backend.read(customer)


@query("select c_mktsegment, count(*) as n from customer where c_acctbal < 0 group by 1")
def store_clear(spark, sf_dir):
    """A cleared entity with its index, filled again: nothing of before is left."""
    from .session import Engine
    from .sources.storage import Changes

    backend, customer = stored_customers(spark, sf_dir)
    spec = IndexSpec(kinds.Count(), ("c_mktsegment",)).named("Customer")
    customer = EntitySpec("Customer", customer.schema, "c_custkey", (spec,))
    engine = Engine(spark, Catalog(Version(1), (customer,)), backend)
    engine.build_index(spec.name)
    engine.clear("Customer")
    backend.append({"Customer": (customer, Changes(read(spark, sf_dir, "customer").where("c_acctbal < 0")))}, {})
    engine.set_state(spec.name, IndexState.DISABLED)
    engine.build_index(spec.name)
    return engine.index(spec.name)


@query(f"select * from {UPSERTED} where c_custkey not in (select c_custkey from customer where c_acctbal < 0) and c_acctbal > 5000 order by c_acctbal desc nulls last, c_custkey limit 30")
def pending_overlay_query(spark, sf_dir):
    q = Query().where(field("c_acctbal") > 5000.0).order_by("c_acctbal", True).order_by("c_custkey").limit(30)
    return q.plan(overlay.applied(*changes(spark, sf_dir), "c_custkey"))


@query("select c_custkey, c_name, c_nationkey, case when c_mktsegment = 'BUILDING' then 0 else c_acctbal end as c_acctbal, c_mktsegment from customer")
def migrate_batch_update(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    spec = entity_of(df, "Customer", "c_custkey")
    catalog = Catalog(Version(1), (spec,))
    from .session import Engine

    engine = Engine(spark, catalog, MemoryBackend(spark, {"Customer": df}))
    migrate.Context(engine, catalog, catalog).update("Customer", field("c_mktsegment") == "BUILDING", c_acctbal=F.lit(0.0))
    return engine.backend.read(spec)


@query("select c_nationkey, count(distinct c_custkey) as n from customer group by 1 having n > 1")
def unique_violations(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    spec = IndexSpec(kinds.Scalar(), ("c_nationkey",), unique=True)
    return kinds.find_unique_violations(df, entity_of(df, "Customer", "c_custkey", spec), spec)


plain(
    "oversize_values", "documents", lambda df: overlay.oversized(df, "doc_id", "text", value_limit=5000).select("doc_id", F.col("value_bytes").cast("long").alias("value_bytes")),
    "select doc_id, octet_length(encode(text))::bigint as value_bytes from documents where octet_length(encode(text)) > 5000",
)

# aggregate indexes -------------------------------------------------------------------

def indexed(kind: kinds.IndexKind, *paths: str, table: str, id_col: str) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark, sf_dir, prepare=lambda df: df):
        df = prepare(read(spark, sf_dir, table))
        spec = IndexSpec(kind, paths)
        spec.kind.validate([type_at(df.schema, p) for p in paths], spec)
        return kind.build(df, entity_of(df, table, id_col, spec), spec)

    return build


query("select l_returnflag, count(*) as n from lineitem group by 1", "agg_count")(indexed(kinds.Count(), "l_returnflag", table="lineitem", id_col="l_orderkey"))
query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2", "agg_count_composite")(indexed(kinds.Count(), "l_returnflag", "l_linestatus", table="lineitem", id_col="l_orderkey"))
plain(
    "agg_count_nullkey", "orders", lambda df: kinds.Count().build(gaps(df), entity_of(gaps(df), "Order", "o_orderkey"), IndexSpec(kinds.Count(), ("priority",))),
    f"select priority, count(*) as n from {GAPS} where priority is not null group by 1",
)


def cents(df: DataFrame, money: str) -> DataFrame:
    return df.withColumn(money, F.col(money).cast("decimal(18,2)"))


@query("select l_returnflag, sum(l_extendedprice::decimal(18,2))::double as total, count(*) as n from lineitem group by 1")
def agg_sum(spark, sf_dir):
    """Money is summed as decimals, so the order of rows does not show."""
    df = cents(read(spark, sf_dir, "lineitem"), "l_extendedprice")
    spec = IndexSpec(kinds.Sum(), ("l_returnflag", "l_extendedprice"))
    return spec.kind.build(df, entity_of(df, "Line", "l_orderkey", spec), spec).drop("sum")


@query("select l_linestatus, sum(l_quantity) as total, count(*) as n from lineitem group by 1")
def agg_sum_kind(spark, sf_dir):
    return indexed(kinds.Sum(), "l_linestatus", "l_quantity", table="lineitem", id_col="l_orderkey")(spark, sf_dir).drop("sum")


def extreme(name: str, kind, group: str, value: str, table: str, id_col: str, sql: str) -> None:
    def run(spark, sf_dir):
        df = read(spark, sf_dir, table)
        spec = IndexSpec(kind, (group, value))
        return kind.of_groups(kind.build(df, entity_of(df, table, id_col, spec), spec), spec)

    query(sql, name)(run)


extreme("agg_min", kinds.Min(), "o_orderstatus", "o_totalprice", "orders", "o_orderkey", "select o_orderstatus, o_totalprice as value, o_orderkey as id from orders qualify row_number() over (partition by o_orderstatus order by o_totalprice, o_orderkey) = 1")
extreme("agg_max", kinds.Max(), "o_orderstatus", "o_totalprice", "orders", "o_orderkey", "select o_orderstatus, o_totalprice as value, o_orderkey as id from orders qualify row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) = 1")
extreme("agg_min_string", kinds.Min(), "p_brand", "p_name", "part", "p_partkey", "select p_brand, p_name as value, p_partkey as id from part qualify row_number() over (partition by p_brand order by p_name, p_partkey) = 1")


@query("select c_nationkey, sum(c_acctbal::decimal(18,2))::double as total, count(*) as n, sum(c_acctbal::decimal(18,2))::double / count(*) as average from customer group by 1")
def agg_avg(spark, sf_dir):
    df = cents(read(spark, sf_dir, "customer"), "c_acctbal")
    spec = IndexSpec(kinds.Average(), ("c_nationkey", "c_acctbal"))
    return spec.kind.build(df, entity_of(df, "Customer", "c_custkey", spec), spec).withColumn("total", F.col("total").cast("double"))


@query("select p_brand, sum(p_size)::bigint as total, count(*) as n, sum(p_size)::double / count(*) as average from part group by 1")
def agg_avg_int(spark, sf_dir):
    return indexed(kinds.Average(), "p_brand", "p_size", table="part", id_col="p_partkey")(spark, sf_dir)


@query("select o_orderstatus, o_totalprice as value, o_orderkey as id, row_number() over (partition by o_orderstatus order by o_totalprice, o_orderkey)::int as place from orders qualify place <= 5")
def agg_bottom_k(spark, sf_dir):
    df, kind = read(spark, sf_dir, "orders"), kinds.Min()
    spec = IndexSpec(kind, ("o_orderstatus", "o_totalprice"))
    return kind.listed(kind.build(df, entity_of(df, "Order", "o_orderkey", spec), spec), spec, 5)


@query("select l_returnflag, count(*) as n from lineitem where l_returnflag = 'A' group by 1")
def agg_lookup_group(spark, sf_dir):
    return kinds.lookup(QUERIES["agg_count"](spark, sf_dir), {"l_returnflag": "A"})


def incremental(kind, *paths: str) -> Run:
    """The index of the customers, brought up to date from the changed rows alone."""

    def run(spark, sf_dir):
        base, rows, gone = changes(spark, sf_dir)
        base, rows = (cents(df, "c_acctbal") for df in (base, rows))
        after = overlay.applied(base, rows, gone, "c_custkey")
        spec = IndexSpec(kind, paths)
        customer = entity_of(base, "Customer", "c_custkey", spec)
        ids = rows.select("c_custkey").union(gone).distinct()
        old, new = (df.join(ids, "c_custkey", "left_semi") for df in (base, after))
        return kind.merged(kind.build(base, customer, spec), old, new, customer, spec)

    return run


AFTER = f"(select * from {UPSERTED} where c_custkey not in (select c_custkey from customer where c_acctbal < 0))"
query(f"select c_mktsegment, count(*) as n from {AFTER} group by 1", "agg_incremental_count")(incremental(kinds.Count(), "c_mktsegment"))
query(f"select c_nationkey, count(*) as n, round(sum(c_acctbal::decimal(18,2))::double, 2) as total from {AFTER} group by 1", "agg_incremental_sum")(
    lambda spark, sf_dir: incremental(kinds.Sum(), "c_nationkey", "c_acctbal")(spark, sf_dir).select("c_nationkey", "n", F.round("total", 2).alias("total"))
)
query(f"select c_nationkey, min(c_acctbal::decimal(18,2)) as value from {AFTER} group by 1", "agg_incremental_min")(
    lambda spark, sf_dir: incremental(kinds.Min(), "c_nationkey", "c_acctbal")(spark, sf_dir).groupBy("c_nationkey").agg(F.min("value").alias("value"))
)

# hashes and sketches -----------------------------------------------------------------

_SEED = {kind: f"{sketch.fnv1a(tag.to_bytes(8, 'little'))}::uhugeint" for kind, tag in sketch.TAGS.items()}
_FOLD = "list_reduce(list_prepend({seed}, {bytes}), lambda a, b: (xor(a, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)"
_INT_HASH = _FOLD.format(seed=_SEED["int"], bytes="[((v >> (8 * i)::bigint) & 255)::uhugeint for i in range(8)]")
_TEXT_HASH = _FOLD.format(seed=_SEED["string"], bytes="[('0x' || hex(encode(v))[2 * i + 1:2 * i + 2])::int::uhugeint for i in range(octet_length(encode(v)))]")
_HEX = "lpad(lower(to_hex(h::ubigint)), 16, '0')"

plain(
    "stable_hash_int", "orders", lambda df: df.select("o_custkey").distinct().select("o_custkey", sketch.hash_hex(sketch.hash_int(F.col("o_custkey"))).alias("h")),
    f"select v as o_custkey, {_HEX} as h from (select v, {_INT_HASH} as h from (select distinct o_custkey as v from orders))",
)
plain(
    "stable_hash_string", "customer", lambda df: df.select("c_name", sketch.hash_hex(sketch.hash_string(F.col("c_name"))).alias("h")),
    f"select v as c_name, {_HEX} as h from (select v, {_TEXT_HASH} as h from (select c_name as v from customer))",
)


def _registers_sql(source: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return (
        f"(select {g}(h % 16384)::int as reg, max(51 - case when h // 16384 = 0 then 0 else length(bin((h // 16384)::bigint)) end)::int as rho "
        f"from (select {g}{_INT_HASH} as h from {source}) group by all)"
    )


def _estimate_sql(registers: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return (
        f"select {g}round(case when raw <= 40960 and zeros > 0 then 16384 * ln(16384 / zeros) else raw end)::bigint as estimate from "
        f"(select {g}(16384 - count(*))::double as zeros, {0.7213 / (1 + 1.079 / 16384) * 16384.0 * 16384.0} / (sum(pow(2.0, -rho)) + 16384 - count(*)) as raw from {registers} group by all)"
    )


_CUSTKEYS = _registers_sql("(select o_custkey as v from orders)")
plain("hll_registers", "orders", lambda df: sketch.registers(df, sketch.hash_int(F.col("o_custkey"))), f"select * from {_CUSTKEYS}")
plain("hll_cardinality", "orders", lambda df: sketch.cardinality(sketch.registers(df, sketch.hash_int(F.col("o_custkey")))), _estimate_sql(_CUSTKEYS))
plain(
    "hll_cardinality_grouped", "events", lambda df: sketch.cardinality(sketch.registers(df, sketch.hash_int(F.col("user_id")), ["event_type"]), ["event_type"]),
    _estimate_sql(_registers_sql("(select event_type, user_id as v from events)", "event_type"), "event_type"),
)


@query(_estimate_sql(_registers_sql("(select l_partkey as v from lineitem union all select p_partkey from part)")))
def hll_merge(spark, sf_dir):
    sold = sketch.registers(read(spark, sf_dir, "lineitem"), sketch.hash_int(F.col("l_partkey")))
    listed = sketch.registers(read(spark, sf_dir, "part"), sketch.hash_int(F.col("p_partkey")))
    return sketch.cardinality(sketch.merge(sold, listed))


QUERIES["approx_distinct"] = lambda spark, sf_dir: sketch.approx_distinct(read(spark, sf_dir, "orders"), "o_custkey")

# version history ---------------------------------------------------------------------

plain(
    "version_keep_last", "events", lambda df: kinds.History(keep_last=3).retained(df, "user_id", ["ts", "event_id"]),
    "select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 3",
)
plain(
    "version_keep_duration", "events", lambda df: kinds.History(keep_seconds=7 * 86400).retained(df, "user_id", ["ts", "event_id"], F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))),
    "select * from events where ts >= timestamp '2024-01-20' - interval 7 day",
)
plain(
    "version_as_of", "events", lambda df: kinds.as_of(df, "user_id", ["ts", "event_id"], F.to_timestamp_ntz(F.lit("2024-01-15 12:00:00"))),
    "select * from events where ts <= timestamp '2024-01-15 12:00:00' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
)

# index build and scrub ---------------------------------------------------------------

query("select o_orderstatus, o_orderkey as id from orders", "index_scalar")(indexed(kinds.Scalar(), "o_orderstatus", table="orders", id_col="o_orderkey"))
query("select c_mktsegment, c_nationkey, c_custkey as id from customer", "index_compound")(indexed(kinds.Scalar(), "c_mktsegment", "c_nationkey", table="customer", id_col="c_custkey"))


@query("select c_mktsegment, count(*) as n from customer group by 1")
def index_build(spark, sf_dir):
    """An index taken through its states by the engine and read back."""
    from .session import Engine

    df = read(spark, sf_dir, "customer")
    spec = entity_of(df, "Customer", "c_custkey", IndexSpec(kinds.Count(), ("c_mktsegment",)))
    engine = Engine(spark, Catalog(Version(1), (spec,)), MemoryBackend(spark, {"Customer": df}))
    engine.build_index("Customer_c_mktsegment")
    return engine.index("Customer_c_mktsegment")


def damaged(spark, sf_dir):
    """An index of the orders by status that lacks the pending orders and has entries of orders that are not there."""
    orders = read(spark, sf_dir, "orders")
    spec = IndexSpec(kinds.Scalar(), ("o_orderstatus",))
    order = entity_of(orders, "Order", "o_orderkey", spec)
    whole = spec.kind.build(orders, order, spec)
    wrong = orders.where("o_orderpriority = '1-URGENT'").select("o_orderstatus", (F.col("o_orderkey") + 100000000).alias("id"))
    return orders, order, spec, whole.where("o_orderstatus <> 'P'").unionByName(wrong)


@query("select o_orderstatus, o_orderkey + 100000000 as id from orders where o_orderpriority = '1-URGENT'")
def scrub_dangling(spark, sf_dir):
    orders, order, _, index = damaged(spark, sf_dir)
    return scrub.dangling(index, orders, order.id)


@query("select o_orderstatus, o_orderkey as id from orders where o_orderstatus = 'P'")
def scrub_missing(spark, sf_dir):
    orders, order, spec, index = damaged(spark, sf_dir)
    return scrub.missing(index, spec.kind.expected(orders, order, spec))


@query("select count(*) filter (o_orderpriority = '1-URGENT') as n_dangling, count(*) filter (o_orderpriority = '1-URGENT') as n_stale, count(*) filter (o_orderstatus = 'P') as n_missing from orders")
def scrub_summary(spark, sf_dir):
    orders, order, spec, index = damaged(spark, sf_dir)
    return scrub.summary(index, orders, order, spec)


@query("select o_orderstatus, o_orderkey as id from orders")
def scrub_repair(spark, sf_dir):
    orders, order, spec, index = damaged(spark, sf_dir)
    return scrub.repaired(index, orders, order, spec)


_STAYS = "(select user_id, epoch_us(ts) // 1000000 as lo, epoch_us(ts) // 1000000 + 7200 as hi from events)"
plain(
    "rangeset_normalize", "events",
    lambda df: rangeset.normalized(df.select("user_id", F.expr("unix_timestamp(ts)").alias("lo"), F.expr("unix_timestamp(ts) + 7200").alias("hi")), ["user_id"]),
    f"""with m as (select *, case when lo > max(hi) over (partition by user_id order by lo, hi rows between unbounded preceding and 1 preceding) then 1 else 0 end as b from {_STAYS}),
    g as (select *, sum(b) over (partition by user_id order by lo, hi rows unbounded preceding) as g from m)
    select user_id, min(lo)::bigint as lo, max(hi)::bigint as hi from g group by user_id, g""",
)

# values ------------------------------------------------------------------------------

def mixed(df: DataFrame) -> DataFrame:
    """Values of several types, told apart by the event's type."""
    t = F.col("event_type")
    v = values.value(
        bool=F.when(t == "click", F.col("value") > 50), int=F.when(t == "view", F.floor("value").cast("bigint")), num=F.when(t == "purchase", F.col("value")),
        str=F.when(t == "login", F.col("value").cast("decimal(12,2)").cast("string")),
    )
    return df.select("event_id", v.alias("v"))


_MIXED = """(select event_id, case when event_type = 'click' then value > 50 end as b, case when event_type = 'view' then floor(value)::bigint end as i,
  case when event_type = 'purchase' then value end as d, case when event_type = 'login' then value::decimal(12,2)::varchar end as s from events)"""
plain("fieldvalue_as_double", "events", lambda df: mixed(df).select("event_id", values.as_double(F.col("v")).alias("d")), f"select event_id, coalesce(d, i::double, try_cast(s as double)) as d from {_MIXED}")
plain(
    "fieldvalue_order", "events", lambda df: mixed(df).select("event_id", "v").orderBy(values.order_key(F.col("v")), "event_id").limit(500).select("event_id"),
    f"""select event_id from {_MIXED} order by case when b is not null then 1 when i is not null or d is not null then 2 when s is not null then 4 else 0 end,
    b nulls first, coalesce(d, i::double) nulls first, i nulls first, s nulls first, event_id limit 500""",
)



def mixed_all(df: DataFrame) -> DataFrame:
    """mixed() with text, of users' numbers, in a type of event that occurs."""
    t = F.col("event_type")
    v = values.value(
        bool=F.when(t == "click", F.col("value") > 50), int=F.when(t == "view", F.floor("value").cast("bigint")), num=F.when(t == "purchase", F.col("value")),
        str=F.when(t == "signup", F.col("user_id").cast("string")),
    )
    return df.select("event_id", v.alias("v"))


@query("""select event_id, row_number() over (order by case when b is not null then 1 when i is not null or d is not null then 2 when s is not null then 4 else 0 end,
    b nulls first, coalesce(d, i::double) nulls first, i nulls first, s nulls first, event_id) - 1 as place
    from (select event_id, case when event_type = 'click' then value > 50 end as b, case when event_type = 'view' then floor(value)::bigint end as i,
    case when event_type = 'purchase' then value end as d, case when event_type = 'signup' then user_id::varchar end as s from events)""")
def fieldvalue_places(spark, sf_dir):
    """The place of every event in the total order: places in ranges of the order, and the rows in the ranges before."""
    from .sources.layout import scratch_folder

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = mixed_all(read(spark, sf_dir, "events")).select("event_id", values.order_key(F.col("v")).alias("key"))
    ranged = keyed.repartitionByRange(n, "key", "event_id").sortWithinPartitions("key", "event_id")
    path = f"{scratch_folder(spark)}/places-{uuid.uuid4().hex}"
    # the upper bits are the range, the lower 33 the row in it
    ranged.select("event_id", F.monotonically_increasing_id().alias("at")).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("range", F.shiftright("at", 33))
    before, offsets = 0, []
    for part, rows in sorted(tuple(r) for r in placed.groupBy("range").count().collect()):  # one row for each range
        offsets.append((part, before))
        before += rows
    of = spark.createDataFrame(offsets, "range long, offset long")
    return placed.join(F.broadcast(of), "range").select("event_id", (F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


@query("select event_id, (epoch_us(ts) // 1000)::bigint as millis from events")
def ulid_timestamp(spark, sf_dir):
    """Ids made from the events' times, decoded again."""
    df = read(spark, sf_dir, "events").select("event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("millis"))
    text = values.ulid_text(F.col("millis"), F.lpad(F.hex("event_id"), 20, "0"))
    return df.select("event_id", values.ulid_millis(text).alias("millis"))


plain(
    "enum_valid", "orders", lambda df: df.select("o_orderkey", values.valid_enum(F.col("o_orderstatus"), EnumSpec("Status", ("O", "F"))).alias("valid")),
    "select o_orderkey, o_orderstatus in ('O', 'F') as valid from orders",
)
plain(
    "range_contains", "orders", lambda df: df.where(values.in_range(F.col("o_orderkey"), 100, 200)), "select * from orders where o_orderkey >= 100 and o_orderkey < 200"
)

# search ------------------------------------------------------------------------------

@query("select vec_id from embeddings order by list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) desc, vec_id limit 10")
def vector_flat_knn(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings")
    q = df.where("vec_id = 0").select("embedding").first()[0]
    return search.nearest(df, "vec_id", "embedding", q, 10).select("vec_id")


@query("""select query_id, id from (select q.vec_id as query_id, e.vec_id as id, row_number() over (partition by q.vec_id
    order by list_cosine_similarity(e.embedding::double[], q.embedding::double[]) desc, e.vec_id) as n from embeddings e, embeddings q where q.vec_id % 20 = 0) where n <= 10""")
def vector_batch_knn(spark, sf_dir):
    """Every row whose id is divisible by 20 as a query against all rows."""
    df = read(spark, sf_dir, "embeddings")
    return search.nearest_each(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", 10).select("query_id", "id")


def batch_knn(metric: str):
    def run(spark, sf_dir):
        df = read(spark, sf_dir, "embeddings")
        return search.nearest_each(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, metric).select("query_id", "id")

    return run


#: Products and distances are rounded as the operator rounds them, so that equal ones tie alike.
_KNN = """select query_id, id from (select q.vec_id as query_id, e.vec_id as id, row_number() over (partition by q.vec_id
    order by round({score}, 12) desc, e.vec_id) as n from embeddings e, embeddings q where q.vec_id % 20 = 0) where n <= 10"""
query(_KNN.format(score="list_inner_product(e.embedding::double[], q.embedding::double[])"), "vector_batch_dot")(batch_knn("dotProduct"))
query(_KNN.format(score="-list_distance(e.embedding::double[], q.embedding::double[])"), "vector_batch_euclidean")(batch_knn("euclidean"))


@query(r"""select term, doc_id as id, count(*) as tf from (select doc_id, unnest(case when length(w) < 3 then [w] else list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3)) end) as term
    from (select doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) as w from documents) where w <> '' and w not in ('the', 'der')) group by all""")
def fulltext_ngram(spark, sf_dir):
    """The full-text index by triples of letters, without two stop words, as its configuration asks."""
    df = read(spark, sf_dir, "documents")
    kind = kinds.FullText().configured([{"tokenizer": "ngram"}, {"ngram": 3, "stop_words": ("the", "der")}])
    spec = IndexSpec(kind, ("text",))
    return kind.build(df, entity_of(df, "Document", "doc_id", spec), spec)


plain(
    "fulltext_standard", "documents", lambda df: search.document_frequencies(df, "doc_id", "text", 50),
    r"select term, count(*) as df from (select distinct doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) as term from documents) where term <> '' group by 1 having count(*) >= 50",
)
plain(
    "fulltext_inverted", "benchmark", lambda df: search.inverted(df, "item_id", "text"),
    r"select term, item_id as id, count(*) as tf from (select item_id, unnest(regexp_split_to_array(lower(text), '\s+')) as term from benchmark) where term <> '' group by all",
)

plain(
    "fulltext_terms", "documents", lambda df: search.document_frequencies(df, "doc_id", "text"),
    r"select term, count(*) as df from (select distinct doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) as term from documents) where term <> '' group by 1",
)
plain(
    "fulltext_postings", "documents", lambda df: search.inverted(df, "doc_id", "text"),
    r"select term, doc_id as id, count(*) as tf from (select doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) as term from documents) where term <> '' group by all",
)

# schema and migration ----------------------------------------------------------------

TABLES = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "events": "event_id"}


def schema_catalog(spark, sf_dir):
    entities = tuple(entity_of(read(spark, sf_dir, t), t, i) for t, i in TABLES.items())
    return spark.createDataFrame(Catalog(Version(1), entities).rows(), "entity string, field string, position int, type string, is_id boolean")


def versions(df: DataFrame) -> tuple[Catalog, Catalog]:
    old = entity_of(df, "Customer", "c_custkey", IndexSpec(kinds.Scalar(), ("c_name",), unique=True), IndexSpec(kinds.Scalar(), ("c_nationkey",)))
    grown = T.StructType([*df.schema.fields, T.StructField("age", T.LongType()), T.StructField("created", T.DoubleType())])
    new = EntitySpec("Customer", grown, "c_custkey", (IndexSpec(kinds.Scalar(), ("c_name",), unique=True), IndexSpec(kinds.Count(), ("age",))), defaults={"age": 0, "created": 0.0})
    return Catalog(Version(1), (old,)), Catalog(Version(2), (new,))


def schema_index_diff(spark, sf_dir):
    old, new = versions(read(spark, sf_dir, "customer"))
    added, removed = old.changes_to(new)
    return spark.createDataFrame([*((n, "added") for n in sorted(added)), *((n, "removed") for n in sorted(removed))], "index string, change string")


_IDS = ", ".join(f"('{t}', '{i}')" for t, i in TABLES.items())
query(f"""select table_name as entity, column_name as field, column_index::int as position,
    case data_type when 'INTEGER' then 'int' when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz' when 'TIMESTAMP WITH TIME ZONE' then 'timestamp' else lower(data_type) end as type,
    column_name = id as is_id from duckdb_columns() join (values {_IDS}) t(name, id) on name = table_name""")(schema_catalog)
query("""select * from (values ('Customer_age', 'added'), ('Customer_c_nationkey', 'removed')) t("index", change)""")(schema_index_diff)


def migrated(spark, sf_dir, change: Callable[[migrate.Context], None]) -> DataFrame:
    from .session import Engine

    df = read(spark, sf_dir, "customer")
    catalog = Catalog(Version(1), (entity_of(df, "Customer", "c_custkey"),))
    backend = MemoryBackend(spark, {"Customer": df})
    change(migrate.Context(Engine(spark, catalog, backend), catalog, catalog))
    return backend.tables["Customer"]


@query("select * from customer where not c_acctbal < 0")
def migrate_batch_delete(spark, sf_dir):
    return migrated(spark, sf_dir, lambda context: context.delete("Customer", field("c_acctbal") < 0.0))


@query("select *, 0::bigint as age, 0::double as created from customer")
def migrate_to_catalog(spark, sf_dir):
    """A store brought to a catalog at once, without a plan of the versions between."""
    from .session import Engine

    df = read(spark, sf_dir, "customer")
    old, new = versions(df)
    backend = MemoryBackend(spark, {"Customer": df})
    engine = Engine(spark, old, backend)
    engine.set_version(Version(1))
    migrate.migrate_to(engine, new)
    return backend.read(new.entity("Customer"))



@query("select *, 0::bigint as age, 0::double as created from customer")
def migrate_add_field(spark, sf_dir):
    """A store of version 1 brought to version 2, whose new fields have defaults."""
    from .session import Engine

    df = read(spark, sf_dir, "customer")
    old, new = versions(df)
    backend = MemoryBackend(spark, {"Customer": df})
    backend.commit({}, {}, {"version": "1.0.0"})
    engine = Engine(spark, old, backend)
    migrate.Plan((old, new), (migrate.Stage(Version(1), Version(2)),)).migrate(engine)
    return backend.read(new.entity("Customer"))


# streams -----------------------------------------------------------------------------

@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def stream_maintained_sum(spark, sf_dir):
    """A sum index that a stream of the events keeps up to date, batch by batch."""
    from .sources.layout import scratch_folder

    path = f"{sf_dir}/events.parquet"
    df = spark.read.parquet(path)
    spec = IndexSpec(kinds.Sum(), ("event_type", "value"))
    event = entity_of(df, "Event", "event_id", spec)
    folder = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    done: dict[int, str] = {}

    def write(index: DataFrame, number: int) -> None:
        index.write.mode("overwrite").parquet(f"{folder}/index/{number}")
        done[number] = f"{folder}/index/{number}"

    stored = lambda: spark.read.parquet(done[max(done)]) if done else None
    maintain.maintain(maintain.read_stream(spark, path, df.schema, 4), stored, write, event, spec, f"{folder}/checkpoint").awaitTermination()
    return stored().select("event_type", "n", F.round("total", 4).alias("total"))



@query("select * from events")
def stream_upsert(spark, sf_dir):
    """A stream of events saved by id into a store, twice over: the second time changes nothing."""
    from .sources.layout import scratch_folder
    from .sources.storage import ParquetBackend

    path = f"{sf_dir}/events.parquet"
    df = spark.read.parquet(path)
    event = entity_of(df, "Event", "event_id")
    folder = f"{scratch_folder(spark)}/upsert-{uuid.uuid4().hex}"
    backend = ParquetBackend(spark, f"{folder}/store")
    for n in range(2):
        maintain.upsert(maintain.read_stream(spark, path, df.schema), backend, event, f"{folder}/checkpoint-{n}").awaitTermination()
    return backend.read(event)
