import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import serde

ADDRESS = T.StructType([T.StructField(n, T.StringType()) for n in ("address", "city")])


def one(spark, text, kind="string"):
    return spark.createDataFrame([(text,)], f"w {kind}")


def test_int64_text(spark):
    s = serde.Int64Text()
    assert one(spark, b"-1", "binary").select(s.decode(F.col("w")).alias("n")).first().n == -1
    for bad in ("x", "4.0", "99999999999999999999", ""):
        with pytest.raises(Exception, match="not a 64-bit number"):
            one(spark, bad).select(s.decode(F.col("w")).alias("n")).collect()


def test_string_must_be_utf8(spark):
    s = serde.String()
    assert one(spark, "ñ".encode(), "binary").select(s.decode(F.col("w")).alias("t")).first().t == "ñ"
    with pytest.raises(Exception):
        one(spark, b"\xff", "binary").select(s.decode(F.col("w")).alias("t")).collect()


@pytest.mark.parametrize("text", ['{"address":"2 Mf St","city":"B"}', '{"Address":"2 Mf St","City":"B","more":1}'])
def test_json_aliases_and_unknown_fields(spark, text):
    s = serde.Json(ADDRESS, {"address": ("Address",), "city": ("City",)})
    row = one(spark, text).select(s.decode(F.col("w")).alias("v")).select("v.*", s.encode(F.col("v")).alias("json")).first()
    assert (row.address, row.city) == ("2 Mf St", "B")
    assert row.json == '{"address":"2 Mf St","city":"B"}'


@pytest.mark.parametrize("text", ["{", '{"city":"B"}'])
def test_bad_json_fails_unless_lenient(spark, text):
    with pytest.raises(Exception):
        one(spark, text).select(serde.Json(ADDRESS).decode(F.col("w")).alias("v")).select("v.address").collect()
    assert one(spark, text).select(serde.Json(ADDRESS, lenient=True).decode(F.col("w")).alias("v")).first().v.address is None


def test_nested_maps(spark):
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.MapType(T.StringType(), T.BooleanType())))
    s = serde.Json(T.StructType([T.StructField("map", kind)]))
    got = one(spark, '{"map":{"A":{"B":{"c":true}}}}').select(s.decode(F.col("w")).alias("v")).first()
    assert got.v.map["A"]["B"]["c"] is True
