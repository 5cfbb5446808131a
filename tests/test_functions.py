"""Stable hash, sketches, sortable ids, values, range sets, key expressions."""

import pytest
from pyspark.sql import functions as F
from quillstone.errors import SchemaError
from quillstone.functions import keys as K
from quillstone.functions import rangeset, sketch, values
from quillstone.operators import search


def test_hash_vectors(spark):
    row = spark.range(1).select(
        *[sketch.hash_hex(sketch.hash_int(F.lit(n))).alias(f"i{n}") for n in (0, 1, 42)],
        *[sketch.hash_hex(sketch.hash_string(F.lit(s))).alias(f"s{s}") for s in ("test", "hello", "")],
        sketch.hash_hex(sketch.hash_bool(F.lit(True))).alias("b"),
    ).first()
    assert row.asDict() == {"i0": "88201fb960ff6465", "i1": "692558b056101a44", "i42": "9d44c7352c418dcf", "stest": "96183a9d68330cd3", "shello": "3ed657cb9dedc2fd", "s": "e6bd86443df8ce07", "b": "f618fc8a7f03c6c7"}


@pytest.mark.parametrize("text", ["ñandú 🙂", "x" * 300])
def test_hash_is_fnv(spark, text):
    want = sketch.fnv1a((2).to_bytes(8, "little") + text.encode())
    assert spark.range(1).select(sketch.hash_hex(sketch.hash_string(F.lit(text)))).first()[0] == f"{want:016x}"


def test_sketch(spark):
    df = spark.range(10000).select(F.format_string("user_%d_email@example.com", "id").alias("s"))
    whole = sketch.registers(df, sketch.hash_string(F.col("s")))
    assert abs(sketch.cardinality(whole).first()[0] - 10000) < 2000
    a, b = (sketch.registers(df.where(c), sketch.hash_string(F.col("s"))) for c in ("length(s) % 2 = 0", "length(s) % 2 = 1"))
    assert sorted(sketch.merge(a, b).collect()) == sorted(whole.collect())
    assert sorted(sketch.unpacked(sketch.packed(whole)).collect()) == sorted(whole.collect())
    assert sketch.cardinality(sketch.registers(df.limit(0), sketch.hash_string(F.col("s")))).first()[0] == 0
    assert 0.008 < sketch.relative_error() < 0.0082


def test_sortable_ids(spark):
    a, b = values.ulid(5, bytes(10)), values.ulid(6, bytes(10))
    assert a < b and len(a) == 26 and values.ulid_bytes(b)[:6] == (6).to_bytes(6, "big")
    assert values.ulid(2**48 - 1, b"\xff" * 10) == "7" + "Z" * 25
    df = spark.createDataFrame([(a,), (values.ulid(1700000000123),)], "t string")
    assert [r[0] for r in df.select(values.ulid_millis(F.col("t"))).collect()] == [5, 1700000000123]
    assert spark.range(1).select(values.ulid_text(F.lit(5).cast("long"), F.lit("0" * 20))).first()[0] == a
    with pytest.raises(ValueError):
        values.ulid_bytes("I" * 26)


def test_values(spark):
    df = spark.createDataFrame([(1, None, None, None, "2.5"), (2, True, None, None, None), (3, None, 7, None, None), (4, None, None, 6.5, None), (5, None, None, None, None)], "id long, b boolean, i long, d double, s string")
    v = df.select("id", values.value(bool=F.col("b"), int=F.col("i"), num=F.col("d"), str=F.col("s")).alias("v"))
    assert [r.id for r in v.orderBy(values.order_key(F.col("v"))).collect()] == [5, 2, 4, 3, 1]
    assert [r[0] for r in v.orderBy("id").select(values.as_double(F.col("v"))).collect()] == [2.5, None, 7.0, 6.5, None]
    assert [r[0] for r in v.orderBy("id").select(values.display(F.col("v"))).collect()] == ['"2.5"', "true", "7", "6.5", "null"]


def test_range_sets(spark):
    df = spark.createDataFrame([(1, 3), (3, 5), (7, 9), (8, 8), (2, 4), (20, 10)], "lo long, hi long")
    assert sorted(map(tuple, rangeset.normalized(df).collect())) == [(1, 5), (7, 9)]
    s = rangeset.RangeSet([(0, 10), (10, 20)])
    s.mark_completed(5, 7)
    assert s.todo == [(0, 5), (7, 20)] and s.contains(4) and not s.contains(5)
    s.mark_completed(-1, 100)
    assert s.is_empty and s.next_batch() is None


def test_key_expressions(spark):
    df = spark.createDataFrame([(1, ("x", ("y",)))], "a long, b struct<c:string,d:struct<e:string>>")
    key = K.from_paths(["a", "b.d.e"])
    assert K.column_count(key) == 2 and tuple(df.select(*K.columns(key, df.schema)).first()) == (1, "y")
    assert K.from_path("") == K.Empty() and K.columns(K.from_paths([]), df.schema) == []
    with pytest.raises(SchemaError, match="b.x"):
        K.columns(K.from_path("b.x.e"), df.schema)


def test_search(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0])], "id long, v array<float>")
    order = lambda m: [r.id for r in search.nearest(df, "id", "v", [1.0, 0.1], 3, m).collect()]
    assert order("cosine") == [1, 3, 2] and order("dotProduct") == [3, 1, 2] and order("euclidean") == [1, 2, 3]
    words = spark.createDataFrame([("The  Quick fox",)], "t string")
    assert words.select(search.tokenized(F.col("t"), stop_words=["the"])).first()[0] == ["quick", "fox"]
    assert words.select(search.tokenized(F.col("t"), ngram=4)).first()[0] == ["the", "quic", "uick", "fox"]
