import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.sources import docstore

LEAVES = T.StructType().add("k", "string").add("v", T.ArrayType(T.IntegerType()))
DEEP = T.StructType().add("l", T.ArrayType(LEAVES)).add("s", T.StructType().add("t", "string"))
SCHEMA = T.StructType().add("a", "string").add("n", "long").add("x", "double").add("b", "boolean").add("at", "timestamp").add("deep", DEEP)


def store(spark, tmp_path, docs):
    folder = tmp_path / "docs" / "bucket=0"
    folder.mkdir(parents=True)
    (folder / "part.json").write_text("\n".join(json.dumps(d) for d in docs), "utf-8")
    return f"file://{tmp_path / 'docs'}"


def test_values_at_any_depth(spark, tmp_path):
    deep = {"mapValue": {"fields": {
        "l": {"arrayValue": {"values": [{"mapValue": {"fields": {"k": {"stringValue": "y"}, "v": {"arrayValue": {"values": [{"integerValue": "3"}, {"nullValue": None}, {"integerValue": "4"}]}}}}}]}},
        "s": {"mapValue": {"fields": {"t": {"stringValue": ""}}}},
    }}}
    path = store(spark, tmp_path, [
        {"name": "p/q/k1", "fields": {"a": {"stringValue": "\u0905"}, "n": {"integerValue": "9007199254740993"}, "x": {"integerValue": "2"}, "b": {"booleanValue": False}, "at": {"timestampValue": "2024-02-29T01:02:03.5Z"}, "deep": deep, "other": {"stringValue": "z"}}},
        {"name": "p/q/k2", "fields": {"a": {"nullValue": None}, "n": {"stringValue": "7"}, "x": {"doubleValue": 0.1}, "deep": {"mapValue": {"fields": {"l": {"arrayValue": {}}}}}}},
        {"name": "p/q/k3"},
    ])
    got = {r["id"]: r for r in docstore.read(spark, path, SCHEMA).withColumn("at", F.col("at").cast("string")).collect()}
    one = got["k1"]
    assert (one["a"], one["n"], one["x"], one["b"], one["at"]) == ("\u0905", 9007199254740993, 2.0, False, "2024-02-29 01:02:03.5")
    assert one["deep"].asDict(True) == {"l": [{"k": "y", "v": [3, None, 4]}], "s": {"t": ""}}
    assert got["k2"]["a"] is None and got["k2"]["n"] is None and got["k2"]["x"] == 0.1 and got["k2"]["deep"]["l"] == [] and got["k2"]["deep"]["s"] is None
    assert all(v is None for k, v in got["k3"].asDict().items() if k != "id")
    assert [r["id"] for r in docstore.read(spark, path, SCHEMA, a="\u0905", b=False, x=None).collect()] == ["k1"]
    assert docstore.read(spark, path, SCHEMA, a="\u0905", b=True).count() == 0


def test_round_trip_and_lookup(spark, tmp_path):
    rows = [(f"k{i}", i * 10**15, i / 7, i % 2 == 0, None if i % 3 else {"l": [{"k": "a/b", "v": [i, None]}] * (i % 4), "s": None}) for i in range(40)] + [(None, 1, 1.0, True, None)]
    kind = T.StructType([f for f in SCHEMA.fields if f.name != "at"])
    df, path = spark.createDataFrame(rows, kind), f"file://{tmp_path / 'store'}"
    docstore.write(df, "a", path, "things", 4)
    back = docstore.read(spark, path, kind)
    assert sorted(map(str, back.drop("id").collect())) == sorted(map(str, df.where("a IS NOT NULL").collect()))
    keys = spark.createDataFrame([("k3",), ("k3",), ("zz",), (None,), ("k39",)], "key string")
    got = sorted((str(r["key"]), r["doc"] and r["doc"]["n"]) for r in docstore.of_keys(spark, path, kind, keys, "key", 4).collect())
    assert got == [("None", None), ("k3", 3 * 10**15), ("k3", 3 * 10**15), ("k39", 39 * 10**15), ("zz", None)]
    single = docstore.one(spark, path, kind, "things", "k5", 4)
    assert [r["n"] for r in single.collect()] == [5 * 10**15]
    plan = single._jdf.queryExecution().toString()
    assert "EqualTo(name,things/k5)" in plan and "PartitionFilters: [isnotnull(bucket" in plan
