"""A collection of type-tagged JSON documents: written by Spark in key buckets, read back with equality filters or by many keys.

A document is {"name": "<collection>/<key>", "fields": {...}}, and every value names its type: {"stringValue": "x"}, {"integerValue": "7"},
{"mapValue": {"fields": {...}}}, {"arrayValue": {"values": [...]}}, {"nullValue": null}. Both directions follow a schema, at any depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tags of scalar types, and the type that JSON holds (whole numbers are text, as they may exceed a double).
TAGS = {
    T.StringType: ("stringValue", "string"), T.LongType: ("integerValue", "string"), T.IntegerType: ("integerValue", "string"),
    T.DoubleType: ("doubleValue", "double"), T.BooleanType: ("booleanValue", "boolean"), T.TimestampType: ("timestampValue", "string"),
}
SECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def tagged(kind: T.DataType) -> T.DataType:
    """The schema of a tagged value of type ``kind``. A whole number may stand where a double is meant."""
    if isinstance(kind, T.StructType):
        return T.StructType().add("mapValue", T.StructType().add("fields", fields_of(kind)))
    if isinstance(kind, T.ArrayType):
        return T.StructType().add("arrayValue", T.StructType().add("values", T.ArrayType(tagged(kind.elementType))))
    tag, held = TAGS[type(kind)]
    out = T.StructType().add(tag, held)
    return out.add("integerValue", "string") if isinstance(kind, T.DoubleType) else out


def fields_of(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, tagged(f.dataType)) for f in schema.fields])


def decode(value: Column, kind: T.DataType) -> Column:
    """The plain value of a tagged one; a missing field, a nullValue and a value of another type are null."""
    if isinstance(kind, T.StructType):
        fields = value["mapValue"]["fields"]
        return F.when(fields.isNotNull(), F.struct(*[decode(fields[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        # an empty list may come without "values"
        values = F.coalesce(value["arrayValue"]["values"], F.when(value["arrayValue"].isNotNull(), F.array().cast(T.ArrayType(tagged(kind.elementType)))))
        return F.transform(values, lambda v: decode(v, kind.elementType))
    held = value[TAGS[type(kind)][0]]
    if isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(held)
    if isinstance(kind, T.DoubleType):
        return F.coalesce(held, value["integerValue"].try_cast("double"))
    return held if isinstance(kind, (T.StringType, T.BooleanType)) else held.try_cast(kind)


def encode(value: Column, kind: T.DataType) -> Column:
    """The tagged value of a plain one, null (no field) for null."""
    if isinstance(kind, T.StructType):
        inner = F.struct(F.struct(*[encode(value[f.name], f.dataType).alias(f.name) for f in kind.fields]).alias("fields"))
        return F.when(value.isNotNull(), F.struct(inner.alias("mapValue")))
    if isinstance(kind, T.ArrayType):
        inner = F.struct(F.transform(value, lambda v: encode(v, kind.elementType)).alias("values"))
        return F.when(value.isNotNull(), F.struct(inner.alias("arrayValue")))
    tag, held = TAGS[type(kind)]
    text = F.date_format(F.to_utc_timestamp(value, F.current_timezone()), SECONDS) if isinstance(kind, T.TimestampType) else value.cast(held)
    return F.when(value.isNotNull(), F.struct(text.alias(tag)))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(buckets)).cast("int")


def write(df: DataFrame, key: str, path: str, collection: str, buckets: int = 16) -> None:
    """Every row with a key as a document, in folders by a hash of its key; rows are spread inside a bucket, so no task writes one bucket alone."""
    name = F.concat(F.lit(f"{collection}/"), F.col(key).cast("string"))
    fields = F.struct(*[encode(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    df.where(F.col(key).isNotNull()).select(name.alias("name"), fields.alias("fields"), _bucket(F.col(key).cast("string"), buckets).alias("bucket")).write.partitionBy("bucket").json(path)


def read(spark: SparkSession, path: str, schema: T.StructType, **equal) -> DataFrame:
    """id and the fields of ``schema`` of all documents whose fields equal the given values, joined by AND; None is no filter.

    Filters are on the tagged values, before decoding, and only the fields of ``schema`` and of the filters are parsed.
    """
    wanted = {f.name: f.dataType for f in schema.fields}
    inner = T.StructType([T.StructField(n, tagged(k)) for n, k in wanted.items()])
    docs = spark.read.schema(T.StructType().add("name", "string").add("fields", inner).add("bucket", "integer")).json(path)
    tests = [decode(F.col(f"fields.{n}"), wanted[n]) == F.lit(v) for n, v in equal.items() if v is not None]
    kept = reduce(DataFrame.where, tests, docs)
    return kept.select(F.element_at(F.split("name", "/"), -1).alias("id"), *[decode(F.col(f"fields.{n}"), k).alias(n) for n, k in wanted.items()])


def one(spark: SparkSession, path: str, schema: T.StructType, collection: str, key: str, buckets: int = 16) -> DataFrame:
    """The document of one key: one bucket is read, and the name goes to the JSON reader as a filter."""
    inner = T.StructType().add("name", "string").add("fields", fields_of(schema)).add("bucket", "integer")
    docs = spark.read.schema(inner).json(path).where(_bucket(F.lit(key), buckets) == F.col("bucket")).where(F.col("name") == f"{collection}/{key}")
    return docs.select(F.lit(key).alias("id"), *[decode(F.col(f"fields.{f.name}"), f.dataType).alias(f.name) for f in schema.fields])


def of_keys(spark: SparkSession, path: str, schema: T.StructType, keys: DataFrame, key: str, buckets: int = 16) -> DataFrame:
    """Rows of ``keys`` with the document of their ``key`` as a struct ``doc``, null where there is none. Keys of few buckets prune the rest at
    run time; many rows of one key cost one document, since documents are looked up for distinct keys."""
    inner = T.StructType().add("name", "string").add("fields", fields_of(schema)).add("bucket", "integer")
    docs = spark.read.schema(inner).json(path).withColumn("__id", F.element_at(F.split("name", "/"), -1))
    asked = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("__id")).distinct().withColumn("bucket", _bucket(F.col("__id"), buckets))
    found = docs.join(asked, ["bucket", "__id"]).select("__id", F.struct(*[decode(F.col(f"fields.{f.name}"), f.dataType).alias(f.name) for f in schema.fields]).alias("doc"))
    return keys.join(found, F.col(key).cast("string") == F.col("__id"), "left").drop("__id")
