"""Cases of invented registry records: operators whose semantics hang on names, ids, houses and ages.

Each makes its few records itself, and its SQL states the rows they must give, worked out by hand from the rules (a wrong operator
gives others). They are tests, not registered queries: those read the driver's tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import matchers, records as R, textkeys as T
from ledgerlark.operators import aggregates as A
from ledgerlark.operators import dml, joins, predicates as P, quality, resolve, sequences as S
from ledgerlark.sources import readers


QUERIES, ORACLE_SQL = {}, {}


def register(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, sql
        return fn

    return add


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def stated(columns: str, *rows: tuple) -> str:
    """SQL for these rows; a row of one column may be given as its value."""
    own = [r if isinstance(r, tuple) else (r,) for r in rows]
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in own)}) AS t({columns})"


def forms(spark, function, texts: list) -> DataFrame:
    """i (from 1), v: what a function of one text gives for each."""
    return spark.createDataFrame(list(enumerate(texts, 1)), "i int, t string").select("i", function(F.col("t")).alias("v"))


def numbered(*values) -> str:
    return stated("i, v", *enumerate(values, 1))


# ------------------------------------------------------------------ scalar functions
@register(numbered("ARN", "ARN", "ARN", "SRS", "SRS", "DBK", "DBK", "", "SNH", "RN KNR"))
def devanagari_phonetic(spark, folder):
    return forms(spark, T.phonetic_key, ["अरुण", "अरूण", "arun", "सुरेश", "suresh", "दीपक", "deepak", "", "singh", "ram kumar"])


@register(numbered("अरुन", "अरुन", "कीरन", "a b", None, "ग्यान"))
def folded_spelling(spark, folder):
    return forms(spark, T.fold_devanagari, ["अरुण", "अरूण", "किरण", " a   b ", None, "ज्ञान"])


@register(numbered("महिला", "महिला", "अन्य", "पुरुष", "पुरुष"))
def gender_labels(spark, folder):
    return forms(spark, T.gender_label, ["Female", "महिला", "other", "पुरुष", None])


@register(numbered("पति", "माता", "अन्य", "पिता", "पिता"))
def relation_labels(spark, folder):
    return forms(spark, T.relation_label, ["Husband", "माता", "guardian", "", None])


@register(numbered("ABC1234567", "UP/9/42/123456", "UP/9/42/123456", "UP/9/04/0324386", "JKT0104406", "ABC1234507", "", ""))
def ids_from_noise(spark, folder):
    return forms(spark, T.clean_id, ["id: abc 1234567 x", "UP/9/42/123456.", "UP|9|42|123456", "1/9/04/0324386", "JKTO104406", "ABC12345O7", None, "nothing"])


@register(numbered(True, False, False, False, False))
def real_ids(spark, folder):
    return forms(spark, T.has_real_id, ["ABC1234567", "DELETED", "ABC", "1234567", None])


@register(numbered("4", "12-A", "14", "", "67", "61", "--", "", "", "204/2", "7", "12/3"))
def house_numbers(spark, folder):
    return forms(spark, T.clean_house, ["०४", "12 - A", "॥4", "S/O someone", "67 00", "मकान नं 61", "--", None, "plain", "204 2", "7 मोहल्ला 3", "012 / 03"])


@register(numbered("4A", "12क", ""))
def house_keys(spark, folder):
    return forms(spark, T.house_key, ["04-a", " 12-क ", None])


@register(numbered(True, True, True, True, False, True))
def generic_houses(spark, folder):
    return forms(spark, T.is_generic_house, ["0", "00000", " - ", "NA", "12", None])


@register(numbered(34, 19, 31, 41, 31, 41, None, None))
def stated_ages(spark, folder):
    return forms(spark, T.age_in, ["आयु : 34 लिंग", "Age: 9", "Age: 3", "Age 4l", "31 fer:", "Age: 411", "none", None])


@register(numbered(True, True, False, False, True, False))
def deletion_marks(spark, folder):
    return forms(spark, T.is_marked_deleted, ["D E L E T E D", "विलोपित", "kept", None, "x CANCEL y", "cancellation"])


@register(numbered("123", None, None))
def digits_of_serials(spark, folder):
    return forms(spark, lambda t: T.serial_number(t).cast("string"), ["1२-3", "x", None])


@register(numbered("a2", "a10", "B1", "b9", "b10"))
def natural_order(spark, folder):
    from pyspark.sql import Window

    names = spark.createDataFrame([("b10",), ("b9",), ("a2",), ("a10",), ("B1",)], "v string").withColumn("one", F.lit(1))
    return names.select(F.row_number().over(Window.partitionBy("one").orderBy(T.natural_key(F.col("v")))).alias("i"), "v")


@register(numbered("5 s", "5.3 s", "1 min", "2 min 5 s", "0 s", "0 s", "2 min"))
def duration_labels(spark, folder):
    return forms(spark, lambda t: T.duration_label(t.cast("double")), ["5.0", "5.25", "60.0", "125.4", None, "-1.0", "119.9"])


@register(numbered("राम", "राम", "", ""))
def first_names(spark, folder):
    return forms(spark, T.core_first_name, ["श्री राम", "राम", "", None])


@register(stated("i, v", (1, True), (2, True), (3, False), (4, True), (5, False), (6, False)))
def same_names(spark, folder):
    rows = [(1, "श्री राम कुमार", "राम कुमार"), (2, "राम सेवक", "रामसेवक"), (3, "राजेश", "राजीव"), (4, "a b c", "a b"), (5, "", "a"), (6, None, "a")]
    return spark.createDataFrame(rows, "i int, a string, b string").select("i", T.same_person_name(F.col("a"), F.col("b")).alias("v"))


@register(stated("i, v", (1, True), (2, True), (3, True), (4, False)))
def kin_pairs(spark, folder):
    rows = [(1, "x", "y", "पति", "y", "z", "पिता"), (2, "x", "f", "पिता", "w", "f", "पिता"), (3, "x", "f", "पति", "w", "f", "पिता"), (4, "x", "f", "माता", "w", "f", "पिता")]
    return spark.createDataFrame(rows, "i int, a string, b string, c string, d string, e string, f string").select("i", T.are_kin(*[F.col(c) for c in "abcdef"]).alias("v"))


@register(stated("i, v, w", (1, "a", "c"), (2, "a", None), (3, "राम", "कुमार")))
def given_and_family(spark, folder):
    parts = T.name_parts(F.col("t"))
    return spark.createDataFrame([(1, " a b  c "), (2, "a"), (3, "राम कुमार")], "i int, t string").select("i", parts["given"].alias("v"), parts["family"].alias("w"))


@register(stated("i, v", (1, True), (2, False), (3, True), (4, False)))
def first_name_matches(spark, folder):
    rows = [(1, "rajesh", "rajesh", "", ""), (2, "rajesh", "sunil", "RJS", "SNL"), (3, "abc", "xyz", "KB", "KB"), (4, "abc", "xyz", "K", "K")]
    return spark.createDataFrame(rows, "i int, a string, b string, ka string, kb string").select("i", matchers.first_names_match_udf("a", "b", "ka", "kb").alias("v"))


@register(stated("i, v", (1, True), (2, False), (3, True)))
def relation_matches(spark, folder):
    rows = [(1, "ram kumar", "ram", "", ""), (2, "ram", "shyam lal", "RN", "SN LL"), (3, "mohan", "mohan", "", "")]
    return spark.createDataFrame(rows, "i int, a string, b string, ka string, kb string").select("i", matchers.relations_match_udf("a", "b", "ka", "kb").alias("v"))


@register(stated("i, v", (1, True), (2, True), (3, False)))
def full_name_matches(spark, folder):
    rows = [(1, "ram kumar", "ramkumar", "", ""), (2, "suresh", "suresh", "S", "T"), (3, "ram", "shyam lal", "RN", "SN LL")]
    return spark.createDataFrame(rows, "i int, a string, b string, ka string, kb string").select("i", matchers.names_match_udf("a", "b", "ka", "kb").alias("v"))


@register(stated("i, v", (1, True), (2, True), (3, True), (4, False), (5, True), (6, False)))
def compatible_identities(spark, folder):
    kind = "i int, name string, relation string, house string, code string, n_name string, n_relation string, n_house string, n_code string"
    rows = [
        (1, "-", None, None, None, "x", None, None, None), (2, "a", None, None, "ABC1234567", "b", None, None, "abc1234567"), (3, "उमा", None, None, None, "उमा देवी", None, None, None),
        (4, "राम", None, None, None, "मोहन", None, None, None), (5, "suresh", None, "12", None, "sures", None, "12", None), (6, "suresh", None, "0", None, "soorez", None, "0", None),
    ]
    old, new = ({k: F.col(p + k) for k in ("name", "relation", "house", "code")} for p in ("", "n_"))
    return spark.createDataFrame(rows, kind).select("i", R.same_identity(old, new).alias("v"))


@register(stated(
    "i, serial_no, name, relation_type, relation_name, house_no, age, gender, code, is_deleted",
    (1, 12, "राम कुमार", "पति", "मोहन", "4", 34, "महिला", "ABC1234567", False), (3, 103, "विलोपित", None, None, "", None, "पुरुष", "", True),
    (4, 104, "x y", "पिता", "z", "", 40, "महिला", "", False),
))
def parsed_records(spark, folder):
    texts = [
        "12 नाम : राम कुमार\nपति का नाम : मोहन\nमकान संख्या : ०४\nआयु : 34 लिंग : पुरुष\nABC1234567", "short", "DELETED", "Name: x y\nFather's Name: z\nGender: Female\nAge: 40",
    ]
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "i int, t string").select("i", R.parse_record(F.col("t"), F.col("i") + 100).alias("r"))
    return rows.where("r IS NOT NULL").select("i", "r.*")


@register(stated("id, owner, father, spouse, parent, own", ("2", "S", "F", "H", "S", "own"), ("9", "D", "F", "H", "S", "own")))
def household_relations(spark, folder):
    kind = "ms array<struct<name:string,relationship:string,memberId:string,isOwner:boolean,fatherHusbandName:string>>, id string"
    ms = [("H", "Self", "1", None, "F"), ("S", "Son", "2", None, None), ("D", "daughter-in-law", "3", True, None), ("X", "uncle", "4", None, "own")]
    names = [R.relative_name(F.col("ms"), F.lit(k), F.lit("H"), F.lit("F")).alias(n) for k, n in ((1, "father"), (2, "spouse"), (3, "parent"), (4, "own"))]
    return spark.createDataFrame([(ms, "2"), (ms, "9")], kind).select("id", R.owner_name(F.col("ms"), F.col("id")).alias("owner"), *names)


@register(numbered("5", "[1]", None))
def tagged_values(spark, folder):
    return forms(spark, R.tagged_value, ['{"integerValue": "5"}', '{"arrayValue": {"values": [1]}}', "{}"])


SPELT = {"arun": "अरुन|अरुण", "suresh": "सुरेश", "ram kumaar": "रम कुमार", "gyaan singh": "ज्ञन सिनघ|ज्ञण सिनघ", "eesha9": "eesha9", "अरुण": "", "arun devan": "अरूण देवन|अरूण देवण|अरुन देवन|अरुन देवण"}


@register(stated("term, forms", *SPELT.items()))
def latin_in_devanagari(spark, folder):
    forms_of = lambda term: T.in_devanagari(term, {"arun": ["अरूण"]} if " " in term else None)
    return spark.createDataFrame([(term, "|".join(forms_of(term))) for term in SPELT], "term string, forms string")


@register(stated("id", 1, 2, 3))
def candidates_in_devanagari(spark, folder):
    """A term without phonetic equality is found by its Devanagari form."""
    rows = [(1, "मोहन लाल", None), (2, "राम मोहन", None), (3, None, "मोहण"), (4, "सोहन", None)]
    df = dml.with_search_keys(spark.createDataFrame(rows, "id int, name string, relation string"), "name", "relation")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("code", "house", "station", "part")}).withColumns({"serial": F.lit(1), "deleted": F.lit(False)})
    return P.candidate_search(df, "mohan").select("id")


# ------------------------------------------------------------------ search
PEOPLE = [
    (1, "अरूण शर्मा", "मोहन", "ABC1234567", 12, None), (2, "अरुण वर्मा", "सोहन", "ABD7654321", 112, False), (3, "मोहन", "अरुण", "XYZ1112223", 7, None),
    (4, "सुरेश", "दीपक", None, 3, True), (5, "arun", "x", "abc0000012", 40, None),
]


def people(spark) -> DataFrame:
    df = spark.createDataFrame(PEOPLE, "id int, name string, relation string, code string, serial int, gone boolean")
    return df.withColumns({"folded": T.fold_devanagari(F.col("name")), "sound": T.phonetic_key(F.split("name", " ")[0])})


@register(stated("id, rank", (1, 2), (2, 2), (3, 3), (5, 1)))
def search_by_sound(spark, folder):
    """Rank 1: the name itself; 2: the folded name; 3: found in another field."""
    df = people(spark)
    found = df.where(P.tolerant("arun", [F.col("name")], [F.col("folded")], [F.col("sound")]) | P.tolerant("अरुण", [F.col("relation")], [T.fold_devanagari(F.col("relation"))]))
    rank = P.relevance([F.lower("name") == "arun", F.col("sound") == "ARN"])
    return found.select("id", rank.alias("rank"))


CANDIDATES = [
    (1, "अरूण शर्मा", "मोहन", "ABC1234567", "12", "Hall", "2", 12, None), (2, "अरुण वर्मा", "सोहन", "XABC12345671", "7", "Hall", "1", 9, False),
    (3, "मोहन", "अरुण", "XYZ1112223", "88", "School", "10", 7, None), (4, "अरुण", "दीपक", "DEL0000001", "1", "Hall", "1", 3, True),
    (5, "arun", None, None, None, None, "x", 40, None), (6, "ABC1234567", "सुरेश", "PQR0000009", "12", "School", "3", 1, None),
]


def candidates(spark) -> DataFrame:
    df = spark.createDataFrame(CANDIDATES, "id int, name string, relation string, code string, house string, station string, part string, serial int, deleted boolean")
    return dml.with_search_keys(df, "name", "relation")


def ranked(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("rank").cast("int").alias("rank"), "match_tag", "is_mapped")


@register(stated("id, rank, match_tag, is_mapped", (1, 1, "code", True), (6, 2, "sound", False), (2, 5, "code", False)))
def candidates_by_code(spark, folder):
    return ranked(P.candidate_search(candidates(spark), "abc1234567", mapped=spark.createDataFrame([(1,), (1,), (None,)], "id int")))


@register(stated("id, rank, match_tag, is_mapped", (2, 2, "name", False), (1, 3, "folded", False), (5, 4, "sound", False), (3, 6, "broad", False)))
def candidates_by_name(spark, folder):
    return ranked(P.candidate_search(candidates(spark), "अरुण"))


@register(stated("id, rank, match_tag, is_mapped", (6, 2, "name", False), (2, 5, "code", False), (1, 5, "code", False), (3, 6, "broad", False), (3, 6, "house", False)))
def candidates_by_number(spark, folder):
    """A number is looked for in serials, houses, parts and codes too."""
    df = candidates(spark)
    return ranked(P.candidate_search(df, "7")).unionByName(ranked(P.candidate_search(df, "88")))


@register(stated("asked, ids", ("nothing", ""), ("relation", "3"), ("house", "1,6"), ("two at most", "2,1")))
def candidates_by_field(spark, folder):
    df = candidates(spark)
    runs = {
        "nothing": P.candidate_search(df), "relation": P.candidate_search(df, relation="arun"), "house": P.candidate_search(df, spec=P.SearchSpec(equals={"house": "12"})),
        "two at most": P.candidate_search(df, "अरुण", most=2),
    }
    ids = lambda asked, found: found.agg(F.lit(asked).alias("asked"), F.array_join(F.sort_array(F.collect_list(F.struct("rank", "id")))["id"], ",").alias("ids"))
    return reduce(DataFrame.unionByName, [ids(*x) for x in runs.items()])


@register(stated("id", 1, 2))
def search_folded_spelling(spark, folder):
    df = people(spark)
    return df.where(P.tolerant("अरूण", [F.col("name")], [F.col("folded")])).select("id")


@register(stated("id", 1, 5))
def search_codes_any_case(spark, folder):
    return people(spark).where(P.tolerant("abc", [F.col("name")], codes=[F.col("code")])).select("id")


@register(stated("id", 1, 2, 3, 5))
def active_people(spark, folder):
    return P.SearchSpec(flag=("gone", "active")).apply(people(spark)).select("id")


@register(stated("asked, n", ("none", 0), ("all", 5)))
def criteria_needed(spark, folder):
    blank = P.SearchSpec(equals={"name": "", "id": "all"})
    count = lambda asked, need: blank.apply(people(spark), need_criteria=need).agg(F.lit(asked).alias("asked"), F.count(F.lit(1)).cast("int").alias("n"))
    return count("none", True).unionByName(count("all", False))


@register(stated("id, name", (1, None), (2, None), (3, None), (4, None), (5, None)))
def redacted_names(spark, folder):
    return P.redact(people(spark), ["name"], False).select("id", "name")


@register(stated("i, v", (1, True), (2, False), (3, False), (4, True)))
def genuine_records(spark, folder):
    rows = [(1, "राम", None, None, 40, None, None), (2, "राम", None, None, 4, "--", None), (3, "ab", "ABCDE", None, 40, "1", None), (4, None, None, None, None, None, True)]
    return spark.createDataFrame(rows, "i int, n string, c string, r string, a int, h string, d boolean").select("i", P.is_genuine(*[F.col(c) for c in "ncrahd"]).alias("v"))


@register(stated("id", 2, 3))
def needs_review(spark, folder):
    return P.review_filter(spark.createDataFrame([(1, False, 0.95), (2, True, 0.99), (3, None, 0.5), (4, None, 0.9)], "id int, w boolean, c double"), "w", "c").select("id")


@register(stated("id", 1, 4))
def purged_after_reload(spark, folder):
    df = spark.createDataFrame([(1, "a", 1, "p"), (2, " -- ", 2, "p"), (3, "b", 3, "p"), (4, "c", 9, "q")], "id int, name string, serial int, part string")
    return P.purge_reloaded(df, "name", "serial", ["part"], spark.createDataFrame([("p", 2)], "part string, n int")).select("id")


# ------------------------------------------------------------------ sequences
@register(stated("g, o, n", ("a", 1, 5), ("a", 2, 6), ("a", 3, 9), ("a", 4, 10), ("b", 1, 1), ("b", 2, 2)))
def monotone_numbers(spark, folder):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 9), ("a", 4, None), ("b", 1, 1), ("b", 2, 2)], "g string, o int, n long")
    return S.map_sequence(df, ["g"], ["o"], "n", S.repair_monotone).select("g", "o", F.col("n").cast("int").alias("n"))


@register(stated("g, o, n", ("a", 1, 112), ("a", 2, 113), ("a", 3, 114), ("a", 4, 115), ("b", 1, 51), ("b", 2, 52), ("b", 3, 53), ("b", 4, 54), ("c", 1, 1), ("c", 2, 2), ("c", 3, 3)))
def healed_numbers(spark, folder):
    rows = [(g, o, n) for g, numbers in (("a", [112, 113, 14, 115]), ("b", [51, 52, 0, 54]), ("c", [3, 1, 2])) for o, n in enumerate(numbers, 1)]
    df = spark.createDataFrame(rows, "g string, o int, n long")
    return S.map_sequence(df, ["g"], ["o"], "n", S.heal_serials).select("g", "o", F.col("n").cast("int").alias("n"))


@register(stated("y, text_row", (10, 0), (12, 0), (17, 1), (30, 2)))
def rows_of_words(spark, folder):
    words = spark.createDataFrame([(1, 0.0, 10.0), (1, 5.0, 12.0), (1, 0.0, 17.0), (1, 1.0, 30.0)], "page int, x0 double, y0 double")
    return S.text_rows(words, ["page"], "x0", "y0").select(F.col("y0").cast("int").alias("y"), F.col("text_row").cast("int").alias("text_row"))


@register(stated("serial, household", (1, 1), (2, 1), (26, 1), (29, 2), (30, None), (52, 2)))
def households_by_gap(spark, folder):
    df = spark.createDataFrame([("p", "12", 1), ("p", "7", 2), ("p", "12", 26), ("p", "7", 29), ("p", "0", 30), ("p", "12", 52)], "part string, house string, serial int")
    return S.household_groups(df, ["part"], "house", "serial", 25, F.col("house") == "0").select("serial", F.col("household").cast("int").alias("household"))


@register(stated("page, way", (1, 2), (2, 2)))
def best_reading(spark, folder):
    tries = spark.createDataFrame([(1, 1, 4), (1, 2, 6), (2, 1, 2), (2, 2, 3)], "page int, way int, n int")
    return S.best_strategy(tries, ["page"], "way", "n", 5).select("page", "way")


# ------------------------------------------------------------------ resolution
REGISTRY = [
    (1, "ABC1234567", "राम कुमार", "श्याम लाल", "12", 40, "M", "p"), (2, "abc1234567 ", "अन्य नाम", "क", "1", 20, "F", "q"), (3, None, "राम कुमार", "श्याम लाल", "12", 44, "M", "p"),
    (4, None, "राम कुमार", "श्याम लाल", "12", 49, "M", "p"), (5, None, "सुरेश", "मोहन", "9", 30, None, "p"), (6, None, "सुरेस", "मोहन", "8", 30, None, "p"), (7, None, "गीता", "मोहन", "9", 30, None, "p"),
]


def registry(spark) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "id long, code string, name string, relation string, house string, age int, gender string, place string")


@register(stated("id, cluster, confidence", (1, 1, 100), (2, 1, 100), (3, 1, 100), (5, 5, 95), (6, 5, 95)))
def duplicate_clusters(spark, folder):
    """1 and 2 by id; 1 and 3 by house and name with ages 4 apart (4 is 9 apart); 5 and 6 by spelling; 7 by nothing."""
    found = resolve.clusters(resolve.duplicate_links(registry(spark)))
    return found.where("id <> 4").select(*[F.col(c).cast("int").alias(c) for c in ("id", "cluster", "confidence")])


@register(stated("tier, clusters", (1, 1), (3, 1)))
def duplicate_tier_counts(spark, folder):
    counts = resolve.tier_counts(resolve.clusters(resolve.duplicate_links(registry(spark))))[1]
    return counts.select(F.col("tier").cast("int").alias("tier"), F.col("clusters").cast("int").alias("clusters"))


@register(stated("p_id, v_id, score", (1, 10, 100), (2, 11, 95), (3, 12, 85)))
def lists_compared(spark, folder):
    kind = "{0}id long, {0}code string, {0}name string, {0}relation string, {0}age int"
    left = spark.createDataFrame([(1, "ABC1234567", "क", "ख", 1), (2, None, "राम", "मोहन", 30), (3, None, "सुरेश", "दीपक", 30), (4, None, "गीता", "x", 5)], kind.format("p_"))
    right = spark.createDataFrame([(10, "abc1234567", "z", "z", 1), (11, None, "राम", "मोहन", 90), (12, None, "suresh", "dipak", 33), (13, None, "suresh", "dipak", 39)], kind.format("v_"))
    return resolve.compare_lists(left, right).select(*[F.col(c).cast("int").alias(c) for c in ("p_id", "v_id", "score")])


@register(stated("m_id, v_id", (1, 10), (2, 11)))
def household_anchors(spark, folder):
    """2 is weak alone; near the serial of 1, who is certain, and with 1 as relation, it is the nearer of two equal rows."""
    m = spark.createDataFrame([(1, "h", "राम कुमार", "मोहन लाल", "M", 40, "12", "p"), (2, "h", "सीता", "राम कुमार", "F", 38, "99", "p")], "m_id long, m_home string, m_name string, m_relation string, m_gender string, m_age int, m_house string, m_part string")
    v = spark.createDataFrame([(10, 5, "राम कुमार", "मोहन लाल", "M", 41, "12", "p"), (11, 6, "सीता", "राम", "F", 50, "3", "p"), (12, 900, "सीता", "राम", "F", 50, "3", "p")], "v_id long, v_serial long, v_name string, v_relation string, v_gender string, v_age int, v_house string, v_part string")
    return resolve.household_matches(m, v).select(F.col("m_id").cast("int").alias("m_id"), F.col("v_id").cast("int").alias("v_id"))


@register(stated("id, label, hops", *[(k, "x", k) for k in range(50)], (90, None, None), (91, "y", 0)))
def label_chain(spark, folder):
    """A chain of 50 nodes with the label at its end: one hop a node."""
    nodes = spark.createDataFrame([(0, "x"), *[(k, None) for k in range(1, 50)], (90, None), (91, "y")], "id long, label string")
    links = spark.createDataFrame([(k, k + 1) for k in range(49)], "a long, b long")
    return resolve.propagate_labels(nodes, links).select(F.col("id").cast("int").alias("id"), "label", F.col("hops").cast("int").alias("hops"))


# ------------------------------------------------------------------ quality
RECORD = "id int, name string, relation_name string, relation_type string, gender string, code string, age int, house string"
RECORDS = [
    (1, "राम", "मोहन", "पिता", "पुरुष", "ABC1234567", 40, "12"), (2, "रा|म", "मोहन", "पति", "पुरुष", "abc 1234567", 134, "12 उपलब्ध"), (3, None, None, None, None, None, None, None),
    (4, "नाम सीता", "पिता मोहन", "पिता", "महिला", "UP/9/42/123456", 17, "3"), (5, "सीता 0", "Mohan", "माता", "महिला", "ABC12345", 115, "0"),
]


@register(stated(
    "id, score, defects",
    (1, 100, ""), (2, 0, "name_symbols,gender_relation,code_format,age_range,house_noise"), (3, 0, "name_missing,relation_missing,code_format,age_range"),
    (4, 45, "name_label,relation_label,age_range"), (5, 45, "name_zero,relation_latin,code_format"),
))
def registry_scores(spark, folder):
    scored = quality.with_quality(spark.createDataFrame(RECORDS, RECORD), quality.registry_rules())
    return scored.select("id", F.col("score").cast("int").alias("score"), F.array_join("defects", ",").alias("defects"))


@register(stated("id, name, gender, code, age, house, accepted", (1, "राम", "पुरुष", "ABC1234567", 40, "12", False), (2, "राम", "महिला", "ABC1234567", 34, "12", True), (3, None, None, None, None, None, False),
                 (4, "सीता", "महिला", "UP/9/42/123456", 17, "3", True), (5, "सीता", "महिला", "ABC12345", 115, "0", True)))
def registry_repairs(spark, folder):
    fixed = quality.accept_repairs(spark.createDataFrame(RECORDS, RECORD), quality.repairs(), quality.registry_rules())
    return fixed.select("id", "name", "gender", "code", "age", "house", "accepted")


@register(stated("i, v", (1, 18), (2, 23), (3, 18), (4, 65), (5, 40), (6, None)))
def enforced_ages(spark, folder):
    return spark.createDataFrame([(1, 8), (2, 3), (3, 15), (4, 130), (5, 40), (6, None)], "i int, a int").select("i", quality.enforce_age(F.col("a")).alias("v"))


@register(stated("id, warnings, confidence", (1, "", 1.0), (3, "name,code,age", 0.4), (4, "age", 0.8)))
def warned_records(spark, folder):
    warned = quality.record_warnings(spark.createDataFrame([r for r in RECORDS if r[0] in (1, 3, 4)], RECORD))
    return warned.select("id", F.array_join("warnings", ",").alias("warnings"), F.round("confidence", 9).alias("confidence"))


@register(stated("id, confidence", (1, 0.975), (2, 0.3125)))
def spot_checks(spark, folder):
    """2: one of four characters in common (.25), ages 10 apart (.5): .25 * .75 + .5 * .25."""
    one = spark.createDataFrame([(1, "राम", 30), (2, "abcd", 30)], "id int, name string, age int")
    two = spark.createDataFrame([(1, "राम", 31), (2, "axyz", 40)], "id int, name string, age int")
    return quality.spot_check(one, two, "id", {"name": 0.75}, {"age": 0.25}).select("id", F.round("confidence", 9).alias("confidence"))


# ------------------------------------------------------------------ writes
@register(stated("b_id, id, rule", (1, 1, 1), (2, 2, 2), (3, 3, 3)))
def identity_rules_in_turn(spark, folder):
    """2 has the code of 1, which is taken, so it is matched by serial; 3 by name; 4 by nothing."""
    now = spark.createDataFrame([(1, "K", 10, "a"), (2, "Z", 20, "b"), (3, "Y", 30, "c")], "id int, code string, serial int, name string")
    batch = spark.createDataFrame([(1, "K", 10, "q"), (2, "K", 20, "r"), (3, "N", 99, "c"), (4, "M", 98, "z")], "b_id int, b_code string, b_serial int, b_name string")
    rules = [([(F.col(f"b_{c}"), F.col(c))], None) for c in ("code", "serial", "name")]
    return dml.identity_matches(now, batch, "id", "b_id", rules).select("b_id", "id", "rule")


@register(stated("id, name, gone", (1, "a", False), (2, "b", True), (5, "b", None), (6, "new", True)))
def merged_by_policy(spark, folder):
    now = spark.createDataFrame([(1, "a", None), (2, "b", True)], "id long, name string, gone boolean")
    batch = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "b", None), (4, "new", True)], "b_id long, b_name string, b_gone boolean")
    matches = dml.identity_matches(now, batch, "id", "b_id", [([(F.col("b_name"), F.col("name"))], None)])
    fresh = batch.select("b_id", F.col("b_name").alias("name"), F.col("b_gone").alias("gone"))
    return dml.apply_matches(now, fresh, matches, "id", "b_id", {"name": "keep", "gone": "sticky"}).select(F.col("id").cast("int").alias("id"), "name", "gone")


@register(stated("id, name, age", (1, "a", 9), (3, "c", 7), (8, "n", None)))
def edits_of_a_registry(spark, folder):
    """The last approved edit of a field wins over the row; a later edit of another field keeps that of the first to itself."""
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", 7)], "id long, name string, age int")
    kind = "edit_id long, action string, target_id long, status string, proposed map<string,string>"
    rows = [(1, "UPDATE", 1, "approved", {"name": "x"}), (2, "UPDATE", 1, "approved", {"age": "9"}), (3, "DELETE", 2, "approved", {}), (4, "ADD", None, "approved", {"id": "8", "name": "n"}), (5, "DELETE", 3, "pending", {})]
    return dml.apply_pending(df, spark.createDataFrame(rows, kind), "id", ["name", "age"]).select(F.col("id").cast("int").alias("id"), "name", "age")


@register(stated("id, gone", (1, True), (2, True), (3, None)))
def marked_by_file(spark, folder):
    now = spark.createDataFrame([(1, "a", None), (2, "b", True), (3, "c", None)], "id int, name string, gone boolean")
    return dml.update_by_file(now, "name", "a", F.lit(True), {"gone": F.lit(True)}).select("id", "gone")


# ------------------------------------------------------------------ sources and aggregates
@register(stated("position, col", (1, 0), (2, 1), (3, 2), (4, 0)))
def blocks_in_columns(spark, folder):
    blocks = spark.createDataFrame([(1, 0.0, 0.0), (1, 40.0, 0.0), (1, 70.0, 0.0), (1, 0.0, 9.0)], "page int, x0 double, y0 double")
    return readers.column_blocks(blocks, F.lit(100.0), ["page"]).select(F.col("position").cast("int").alias("position"), F.col("column").cast("int").alias("col"))


@register(stated("db_id", "a", "b"))
def catalog_in_order(spark, folder):
    return readers.Catalog(spark).create("a", "Zeta").create("b", "alpha").set_default("b").frame().select("db_id")


@register(stated("k, n", (1, 1)))
def first_source_that_works(spark, folder):
    one = spark.createDataFrame([(1, 1)], "k int, n int")
    return readers.first_available(lambda: spark.read.parquet(f"{folder}/no-such-table.parquet"), lambda: one)


@register(stated("g, m", ("a", 2.0), ("b", None)))
def mean_of_valid(spark, folder):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", None)], "g string, v int")
    return df.groupBy("g").agg(A.valid_mean(F.col("v"), F.col("v") > 1).alias("m"))


@register(stated("k, a, b", (1, "x", 5)))
def first_input_wins(spark, folder):
    base = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k int, a string, b int")
    return joins.with_fallback(base.where("k = 1"), base)
