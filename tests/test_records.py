from pyspark.sql import functions as F

from ledgerlark.functions import records as R


def test_parse_record(spark):
    texts = ["12 नाम : राम कुमार\nपति का नाम : मोहन\nमकान संख्या : ०४\nआयु : 34 लिंग : पुरुष\nABC1234567", "short", "DELETED", "Name: x y\nFather's Name: z\nGender: Female\nAge: 40"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(R.parse_record(F.col("t"), F.col("i") + 100).alias("r")).collect()
    one, none, gone, four = (r["r"] for r in rows)
    assert (one["serial_no"], one["name"], one["relation_type"], one["relation_name"], one["house_no"], one["age"], one["gender"], one["code"]) == (12, "राम कुमार", "पति", "मोहन", "4", 34, "महिला", "ABC1234567")
    assert none is None and gone["is_deleted"] and gone["name"] == "विलोपित" and gone["serial_no"] == 102
    assert (four["name"], four["relation_name"], four["gender"], four["age"]) == ("x y", "z", "महिला", 40)


def test_same_identity(spark):
    kind = "name string, relation string, house string, code string, n_name string, n_relation string, n_house string, n_code string"
    rows = [("-", None, None, None, "x", None, None, None), ("a", None, None, "ABC1234567", "b", None, None, "abc1234567"), ("उमा", None, None, None, "उमा देवी", None, None, None),
            ("राम", None, None, None, "मोहन", None, None, None), ("suresh", None, "12", None, "sures", None, "12", None), ("suresh", None, "0", None, "soorez", None, "0", None)]
    c = F.col
    test = R.same_identity({k: c(k) for k in ("name", "relation", "house", "code")}, {k: c(f"n_{k}") for k in ("name", "relation", "house", "code")})
    assert [r[0] for r in spark.createDataFrame(rows, kind).select(test).collect()] == [True, True, True, False, True, False]


def test_household_names(spark):
    kind = "ms array<struct<name:string,relationship:string,memberId:string,isOwner:boolean,fatherHusbandName:string>>, id string"
    ms = [("H", "Self", "1", None, "F"), ("S", "Son", "2", None, None), ("D", "daughter-in-law", "3", True, None), ("X", "uncle", "4", None, "own")]
    df = spark.createDataFrame([(ms, "2"), (ms, "9")], kind)
    assert [r[0] for r in df.select(R.owner_name(F.col("ms"), F.col("id"))).collect()] == ["S", "D"]
    names = [R.relative_name(F.col("ms"), F.lit(k), F.lit("H"), F.lit("F")) for k in (1, 2, 3, 4)]
    assert list(df.select(*names).first()) == ["F", "H", "S", "own"]
    tagged = spark.createDataFrame([('{"integerValue": "5"}',), ('{"arrayValue": {"values": [1]}}',), ("{}",)], "j string")
    assert [r[0] for r in tagged.select(R.tagged_value(F.col("j"))).collect()] == ["5", "[1]", None]
