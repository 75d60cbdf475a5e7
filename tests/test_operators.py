from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlark.operators import aggregates as A
from ledgerlark.operators import dml, joins, predicates as P, quality, resolve, sequences as S
from ledgerlark.sources import readers
from ledgerlark.streaming import sessions

PEOPLE = "id long, code string, name string, relation string, house string, age int, gender string, place string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_search_spec_and_complement(spark):
    df = spark.createDataFrame([(1, "Red", True, 5), (2, "blue", None, 0), (3, None, False, 9)], "id int, name string, gone boolean, age int")
    spec = P.SearchSpec(contains={"name": "RE%"}, ranges={"age": (0, 0)}, equals={"id": "all"})
    assert rows(spec.apply(df), "id") == [(1,)] and rows(spec.complement(df), "id") == [(2,), (3,)]
    assert rows(P.SearchSpec(flag=("gone", "active")).apply(df), "id") == [(2,), (3,)]
    assert P.SearchSpec(equals={"name": ""}).apply(df, need_criteria=True).count() == 0
    assert P.page(df, [F.col("id")], 2, 2).collect()[0]["id"] == 3 and P.page_count(0, 5) == 1 and P.page_count(11, 5) == 3
    assert P.redact(df, ["name"], False).where("name IS NOT NULL").count() == 0


def test_tolerant_search_by_sound(spark):
    from ledgerlark.functions import textkeys as T

    df = spark.createDataFrame([("अरूण",), ("मोहन",)], "n string").withColumns({"f": T.fold_devanagari(F.col("n")), "k": T.phonetic_key(F.col("n"))})
    assert df.where(P.tolerant("arun", [F.col("n")], [F.col("f")], [F.col("k")])).count() == 1
    assert df.where(P.tolerant("अरुण", [F.col("n")], [F.col("f")], [F.col("k")])).count() == 1


def test_genuine_records(spark):
    df = spark.createDataFrame([("राम", None, None, 40, None, None), ("राम", None, None, 4, "--", None), ("ab", "ABCDE", None, 40, "1", None), (None, None, None, None, None, True)], "n string, c string, r string, a int, h string, d boolean")
    got = [r[0] for r in df.select(P.is_genuine(*[F.col(c) for c in "ncrahd"])).collect()]
    assert got == [True, False, False, True]


def test_household_groups_split_at_the_gap(spark):
    df = spark.createDataFrame([("p", "12", 1), ("p", "7", 2), ("p", "12", 26), ("p", "7", 29), ("p", "0", 30), ("p", "12", 52)], "part string, house string, serial int")
    got = rows(S.household_groups(df, ["part"], "house", "serial", 25, F.col("house") == "0"), "serial", "household")
    assert got == sorted([(1, 1), (2, 1), (26, 1), (29, 2), (30, None), (52, 2)], key=str)


def mirror_monotone(numbers):
    out, seen, last = [], set(), 0
    for k, n in enumerate(numbers):
        if not n or n <= 0 or n in seen or n < last:
            n = max(last + 1, k + 1)
        seen.add(n)
        last = n
        out.append(n)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-3, 15)), max_size=12))
def test_monotone_repair(numbers):
    out = S.repair_monotone(numbers)
    assert out == mirror_monotone(numbers) and out == sorted(set(out))


@pytest.mark.parametrize(
    ("numbers", "start", "want"),
    [([112, 113, 14, 115], None, [112, 113, 114, 115]), ([51, 52, 0, 54], None, [51, 52, 53, 54]), ([3, 1, 2], None, [1, 2, 3]), ([10, 11, 99], 10, [10, 11, 12]), ([], None, [])],
)
def test_heal_serials(numbers, start, want):
    assert S.heal_serials(numbers, start) == want


def test_sequence_operators(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 9), ("b", 1, 1), ("b", 2, 2)], "g string, o int, n long")
    assert rows(S.map_sequence(df, ["g"], ["o"], "n", S.repair_monotone), "g", "o", "n") == [("a", 1, 5), ("a", 2, 6), ("a", 3, 9), ("b", 1, 1), ("b", 2, 2)]
    assert rows(S.renumber_broken(df, ["g"], ["o"], "n"), "g", "o", "n") == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 1), ("b", 2, 2)]
    assert rows(S.missing_numbers(df, ["g"], "n"), "g", "missing") == [("a", 6), ("a", 7), ("a", 8)]
    words = spark.createDataFrame([(1, 0.0, 10.0), (1, 5.0, 12.0), (1, 0.0, 17.0), (1, 1.0, 30.0)], "page int, x0 double, y0 double")
    assert rows(S.text_rows(words, ["page"], "x0", "y0"), "y0", "text_row") == [(10.0, 0), (12.0, 0), (17.0, 1), (30.0, 2)]
    lines = spark.createDataFrame([(1, 1, True, "a"), (1, 2, False, "b"), (1, 3, True, "c")], "p int, o int, s boolean, t string")
    assert rows(S.fold_continuations(lines, ["p"], ["o"], F.col("s"), "t"), "t") == [("a b",), ("c",)]
    votes = spark.createDataFrame([(1, 0, 7), (1, 1, 11), (1, 2, 12), (2, 0, 50), (2, 1, 3)], "page int, c int, printed int")
    assert rows(S.start_consensus(votes, ["page"], "c", "printed", F.lit(20)), "page", "start") == [(1, 10), (2, 20)]
    tries = spark.createDataFrame([(1, 1, 4), (1, 2, 6), (2, 1, 2), (2, 2, 3)], "page int, way int, n int")
    assert rows(S.best_strategy(tries, ["page"], "way", "n", 5), "page", "way") == [(1, 2), (2, 2)]


def test_cascade_prefers_the_first_pass_and_least_match(spark):
    x = spark.createDataFrame([(1, "a", "k"), (2, "b", "k"), (3, "z", "q")], "p_id int, p_a string, p_b string")
    y = spark.createDataFrame([(10, "a", "z"), (11, "a", "k"), (12, "c", "k")], "v_id int, v_a string, v_b string")
    got = joins.cascade(x, y, "p_id", "v_id", [(100, [(F.col("p_a"), F.col("v_a"))], None), (90, [(F.col("p_b"), F.col("v_b"))], F.col("v_id") > 10)])
    assert rows(got, "p_id", "pass", "v_id", "score") == [(1, 1, 10, 100), (2, 2, 11, 90)]


def test_overlay_fallback_and_bands(spark):
    base = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k int, a string, b int")
    edits = spark.createDataFrame([(1, 1, "old", 1), (1, 2, "new", None)], "k int, at int, a string, b int")
    assert rows(joins.overlay(base, edits, "k", "at", ["a", "b"]), "k", "a", "b") == [(1, "new", 5), (2, "y", 6)]
    assert joins.with_fallback(base.where("k = 9"), base).count() == 2 and joins.with_fallback(base.where("k = 1"), base).count() == 1
    pts = spark.createDataFrame([("p", v) for v in range(0, 40, 3)], "g string, v int")
    got = joins.band_join(pts.withColumnRenamed("v", "a"), pts.withColumnRenamed("v", "b"), ["g"], "a", "b", 7)
    assert rows(got, "a", "b") == sorted([(a, b) for a in range(0, 40, 3) for b in range(0, 40, 3) if abs(a - b) <= 7], key=str)
    ranges = base.select(F.col("k").alias("lo"), F.col("b").alias("hi"), F.col("k").alias("n"))
    few, many = (joins.range_lookup(base.where("b IS NOT NULL"), "b", ranges, "lo", "hi", "n", "k", most=m) for m in (100, 1))  # more than ``most`` ranges: no error any more
    assert rows(few, "k", "n") == rows(many, "k", "n")


def test_duplicates_by_tier(spark):
    people = [
        (1, "ABC1234567", "राम कुमार", "श्याम लाल", "12", 40, "M", "p"), (2, "abc1234567 ", "अन्य नाम", "क", "1", 20, "F", "q"), (3, None, "राम कुमार", "श्याम लाल", "12", 44, "M", "p"),
        (4, None, "राम कुमार", "श्याम लाल", "12", 49, "M", "p"), (5, None, "सुरेश", "मोहन", "9", 30, None, "p"), (6, None, "सुरेस", "मोहन", "8", 30, None, "p"), (7, None, "गीता", "मोहन", "9", 30, None, "p"),
    ]
    links = resolve.duplicate_links(spark.createDataFrame(people, PEOPLE)).cache()
    found = {(r["a"], r["b"], r["tier"]) for r in links.collect()}
    assert (1, 2, 1) in found and (1, 3, 2) in found and (1, 4, 2) not in found and any((a, b) == (5, 6) for a, b, _ in found) and not any(7 in (a, b) for a, b, _ in found)
    strong = {r["id"]: (r["cluster"], r["tier"], r["confidence"]) for r in resolve.clusters(links).collect()}
    assert strong[2] == strong[3] == (1, 1, 100) and strong[5][0] == strong[6][0] == 5
    part, counts = resolve.tier_counts(resolve.clusters(links), 1)
    assert part.count() == 3
    assert sum(r["clusters"] for r in counts.collect()) == 2


def test_compare_lists(spark):
    kind = "{0}id long, {0}code string, {0}name string, {0}relation string, {0}age int"
    left = spark.createDataFrame([(1, "ABC1234567", "क", "ख", 1), (2, None, "राम", "मोहन", 30), (3, None, "सुरेश", "दीपक", 30), (4, None, "गीता", "x", 5)], kind.format("p_"))
    right = spark.createDataFrame([(10, "abc1234567", "z", "z", 1), (11, None, "राम", "मोहन", 90), (12, None, "suresh", "dipak", 33), (13, None, "suresh", "dipak", 39)], kind.format("v_"))
    got = resolve.compare_lists(left, right)
    assert rows(got, "p_id", "v_id", "score") == [(1, 10, 100), (2, 11, 95), (3, 12, 85)]
    assert resolve.match_share(got, left).collect()[0]["percent"] == 75.0


def test_household_matcher_uses_anchors(spark):
    m = spark.createDataFrame([(1, "h", "राम कुमार", "मोहन लाल", "M", 40, "12", "p"), (2, "h", "सीता", "राम कुमार", "F", 38, "99", "p")], "m_id long, m_home string, m_name string, m_relation string, m_gender string, m_age int, m_house string, m_part string")
    v = spark.createDataFrame([(10, 5, "राम कुमार", "मोहन लाल", "M", 41, "12", "p"), (11, 6, "सीता", "राम", "F", 50, "3", "p"), (12, 900, "सीता", "राम", "F", 50, "3", "p")], "v_id long, v_serial long, v_name string, v_relation string, v_gender string, v_age int, v_house string, v_part string")
    got = {r["m_id"]: (r["v_id"], r["kind"]) for r in resolve.household_matches(m, v).collect()}
    assert got[1] == (10, "exact") and got[2][0] == 11


def test_components_and_labels(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9)], "a long, b long")
    assert rows(resolve.components(links), "node", "label") == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    nodes = spark.createDataFrame([(1, "x"), (2, None), (3, None), (7, None), (8, "y"), (5, None)], "id long, label string")
    assert rows(resolve.propagate_labels(nodes, links), "id", "label", "hops") == sorted([(1, "x", 0), (2, "x", 1), (3, "x", 2), (7, "y", 1), (8, "y", 0), (5, None, None)], key=str)


def test_registry_quality_and_repairs(spark):
    kind = "id int, name string, relation_name string, relation_type string, gender string, code string, age int, house string"
    df = spark.createDataFrame([(1, "राम", "मोहन", "पिता", "पुरुष", "ABC1234567", 40, "12"), (2, "रा|म", "मोहन", "पति", "पुरुष", "abc 1234567", 134, "12 उपलब्ध"), (3, None, None, None, None, None, None, None)], kind)
    scored = {r["id"]: r for r in quality.with_quality(df, quality.registry_rules()).collect()}
    assert scored[1]["perfect"] and scored[1]["score"] == 100 and scored[2]["score"] == max(0, 100 - 15 - 30 - 25 - 20 - 15)
    assert set(scored[3]["defects"]) == {"name_missing", "relation_missing", "code_format", "age_range"}
    fixed = {r["id"]: r for r in quality.accept_repairs(df, quality.repairs(), quality.registry_rules()).collect()}
    two = fixed[2]
    assert (two["name"], two["gender"], two["code"], two["age"], two["house"], two["accepted"]) == ("राम", "महिला", "ABC1234567", 34, "12", True)
    assert not fixed[1]["accepted"] and {c["field"] for c in two["changes"]} == {"name", "gender", "code", "age", "house"}
    ages = spark.createDataFrame([(8,), (3,), (15,), (130,), (40,), (None,)], "a int")
    assert [r[0] for r in ages.select(quality.enforce_age(F.col("a"))).collect()] == [18, 23, 18, 65, 40, None]
    warned = quality.record_warnings(df.withColumn("x", F.lit(1))).where("id = 3").collect()[0]
    assert warned["warnings"] == ["name", "code", "age"] and warned["confidence"] == pytest.approx(0.4)


def test_audit_and_spot_check(spark):
    df = spark.createDataFrame([("a", 1, 0.95, False), ("a", 4, 0.5, True), ("b", 0, None, None)], "g string, n int, c double, w boolean")
    got = {r["g"]: r for r in quality.audit(df, ["g"], "n", "c", "w").collect()}
    assert (got["a"]["missing"], got["a"]["missing_count"], got["a"]["low_confidence"], got["a"]["warned"]) == ([2, 3], 2, 1, 1) and got["b"]["least"] == 0
    one = spark.createDataFrame([(1, "राम", 30)], "id int, name string, age int")
    two = spark.createDataFrame([(1, "राम", 31)], "id int, name string, age int")
    assert quality.spot_check(one, two, "id", {"name": 0.75}, {"age": 0.25}).collect()[0]["confidence"] == pytest.approx(0.975)


def test_upserts(spark):
    now = spark.createDataFrame([(1, "a", None), (2, "b", True)], "id long, name string, gone boolean")
    delta = spark.createDataFrame([(2, "x", None, 1), (2, "y", None, 2), (3, "z", None, 1)], "id long, name string, gone boolean, at int")
    assert rows(dml.upsert(now, delta, ["id"], "at"), "id", "name") == [(1, "a"), (2, "y"), (3, "z")]
    batch = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "b", None), (4, "new", True)], "b_id long, b_name string, b_gone boolean")
    matches = dml.identity_matches(now, batch, "id", "b_id", [([(F.col("b_name"), F.col("name"))], None)])
    assert rows(matches, "b_id", "id") == [(1, 1), (2, 2)]
    fresh = batch.select("b_id", F.col("b_name").alias("name"), F.col("b_gone").alias("gone"))
    after = dml.apply_matches(now, fresh, matches, "id", "b_id", {"name": "keep", "gone": "sticky"})
    assert rows(after, "id", "name", "gone") == sorted([(1, "a", False), (2, "b", True), (5, "b", None), (6, "new", True)], key=str)
    with pytest.raises(ValueError, match="condition"):
        dml.bulk_update(now, None, {"name": F.lit("x")}, {"name"})
    assert dml.update_by_file(now, "name", "a", F.lit(True), {"gone": F.lit(True)}).where("gone").count() == 2


def test_pending_edits(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", 7)], "id long, name string, age int")
    kind = "edit_id long, action string, target_id long, status string, proposed map<string,string>"
    edits = spark.createDataFrame([(1, "UPDATE", 1, "approved", {"name": "x"}), (2, "UPDATE", 1, "approved", {"age": "9"}), (3, "DELETE", 2, "approved", {}), (4, "ADD", None, "approved", {"id": "8", "name": "n"}), (5, "DELETE", 3, "pending", {})], kind)
    assert rows(dml.apply_pending(df, edits, "id", ["name", "age"]), "id", "name", "age") == [(1, "a", 9), (3, "c", 7), (8, "n", None)]
    assert dml.pending_counts(edits).collect()[0]["approved"] == 4
    assert dml.with_pending_adds(df, df.where("id = 1").select("id", "name"), "id").where("id = 'pending_1'").count() == 1
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1", "b": "3", "c": "4"})], "o map<string,string>, n map<string,string>")
    diff = maps.select(dml.field_diff(F.col("o"), F.col("n")).alias("d")).collect()[0]["d"]
    assert {k: (v["old"], v["new"]) for k, v in diff.items()} == {"b": ("2", "3"), "c": (None, "4")}


def test_sources(spark, tmp_path):
    pages = spark.createDataFrame([("d", p, 100 if p % 2 else 5) for p in range(1, 5)], "doc string, page int, n int")
    assert readers.is_digital(pages, ["doc"], "n").collect()[0]["digital"] is True
    words = spark.createDataFrame([(0.0, 0.0), (99.0, 0.0), (50.0, 95.0)], "x0 double, y0 double")
    assert [r["cell"] for r in readers.grid_cells(words, 3, 10, F.lit(100.0), F.lit(100.0)).collect()] == [0, 2, 28]
    blocks = spark.createDataFrame([(1, 0.0, 0.0), (1, 40.0, 0.0), (1, 70.0, 0.0), (1, 0.0, 9.0)], "page int, x0 double, y0 double")
    assert rows(readers.column_blocks(blocks, F.lit(100.0), ["page"]), "position", "column") == [(1, 0), (2, 1), (3, 2), (4, 0)]
    df = spark.createDataFrame([(1, "f1"), (2, "f2")], "id int, source_file string")
    readers.write_snapshot(df, str(tmp_path / "snap"), ["source_file"])
    readers.write_snapshot(spark.createDataFrame([(9, "f2")], "id int, source_file string"), str(tmp_path / "snap"), ["source_file"])
    assert rows(spark.read.parquet(str(tmp_path / "snap")), "id") == [(1,), (9,)]
    df.write.parquet(str(tmp_path / "now"))
    with pytest.raises(ValueError, match="lacks"):
        readers.restore(spark, str(tmp_path / "now"), str(tmp_path / "now"), ["missing"], str(tmp_path / "r"))
    for name in ("p10.pdf", "p9.pdf", "x.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r["name"] for r in readers.files(spark, str(tmp_path)).select("name").collect()] == ["p9.pdf", "p10.pdf"]
    assert readers.first_available(lambda: spark.read.parquet(str(tmp_path / "none")), lambda: df).count() == 2
    catalog = readers.Catalog(spark).create("a", "Zeta").create("b", "alpha").set_default("b")
    assert [r["db_id"] for r in catalog.frame().collect()] == ["a", "b"] and catalog.set_active("b").delete("a").rows == [("b", "alpha", "", True, True)]


def test_streaming_sessions_equal_batch(spark, tmp_path):
    rows_ = [(1, datetime(2024, 1, 1)), (1, datetime(2024, 1, 1, 1)), (1, datetime(2024, 1, 1, 20)), (2, datetime(2024, 1, 9))]
    events = spark.createDataFrame(rows_, "user long, ts timestamp")
    events.write.parquet(str(tmp_path / "events"))
    batch = rows(sessions.session_counts(events, "ts", "user"), "user", "n")
    assert batch == [(1, 1), (1, 2), (2, 1)]
    stream = sessions.session_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), "ts", "user")
    query = stream.writeStream.outputMode("append").format("memory").queryName("sessions_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows(spark.table("sessions_out"), "user", "n") == [(1, 1), (1, 2)]


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", None)], "g string, v int")
    assert rows(A.mode_by(df, ["g"], "v"), "g", "v", "n") == sorted([("a", 2, 2), ("b", None, 1)], key=str)
    assert rows(df.groupBy("g").agg(A.valid_mean(F.col("v"), F.col("v") > 1).alias("m")), "g", "m") == [("a", 2.0), ("b", None)]
    new = A.next_numbers(df.select("g", F.lit(None).cast("long").alias("n"), "v"), spark.createDataFrame([("a", 7)], "g string, n long"), ["g"], "n", ["v"])
    assert rows(new, "g", "n") == [("a", 10), ("a", 8), ("a", 9), ("b", 1)]


def test_shared_keys_are_counted_without_broadcasts(spark, tmp_path):
    """Subsets of keys are many more rows than the table that the planner knows, so none of them may be sent whole."""
    own = [["a"], ["a"], ["a", "b"], ["b", "c", "b"], ["c", None], [], [None], None, ["d"], ["a", "b", "c", "d"]]
    spark.createDataFrame(list(enumerate(own)), "id long, k array<string>").write.parquet(str(tmp_path / "own"))
    df = spark.read.parquet(str(tmp_path / "own"))
    got = joins.multi_key_counts(df, "id", F.col("k"))
    sets = [{w for w in k or [] if w} for k in own]
    assert rows(got, "id", "candidates") == sorted(((i, sum(i != j and bool(x & y) for j, y in enumerate(sets))) for i, x in enumerate(sets)), key=str)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_candidate_pairs_are_made_once(spark):
    """Pairs that share several keys, frequent keys in blocks: no pair is shuffled to be told apart."""
    left = [(k, ["all", f"m{k % 3}", f"n{k % 5}", None][: k % 5]) for k in range(90)] + [(7, ["n1", "odd"]), (200, None), (201, []), (None, ["odd"])]
    right = [(k, [f"n{k % 7}", "all", f"m{k % 2}", "all"][: k % 5]) for k in range(60)] + [(300, ["odd", "n1"]), (301, [None])]
    schema = "i long, k array<string>"
    x, y = spark.createDataFrame(left, schema).toDF("a", "x"), spark.createDataFrame(right, schema).toDF("b", "y")
    got = joins.multi_key_candidates(x, y, "a", "b", F.col("x"), F.col("y"), block=8)
    want = {(a, b) for a, x in left for b, y in right if set(x or []) & set(y) - {None}}
    assert rows(got, "a", "b") == sorted(want, key=str) and (7, 300) in want
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
