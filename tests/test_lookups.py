"""Indexed search, ranges, as-of rows, assignment, edit replay, paging and page numbers against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import dml, joins, lexicon, predicates as P, resolve, sequences as S, textindex
from ledgerlark.sources import readers


def test_index_finds_what_a_scan_finds(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc ä😀") for _ in range(rng.randrange(0, 15))) for _ in range(300)] + [None, "", "a", "ab", "Straße 12", "x" * 5000 + "needle"]
    df = spark.createDataFrame([(5000 * k, x) for k, x in enumerate(texts)], "k long, t string")
    index = textindex.build(df, "k", {"low": F.lower("t")}, resolve.new_folder(spark, "test-index"))
    for needle in ("ab", "c", "abca", "😀a", "needle", "zzz", "a%c", "a_c%b", "straße", "%", "ä b"):
        want = {r[0] for r in df.where(P.like_folded(F.lower("t"), needle)).select("k").collect()}
        got = index.search([("low", needle)], P.like_folded(F.col("low"), needle))
        assert sorted(r["k"] for r in got.collect()) == sorted(want), needle
    terms = ["ab", "c", "abca", "😀a", "needle", "zzz", None, "", "ab", "a😀ä", "bc a"]
    asked = spark.createDataFrame(list(enumerate(terms)), "i int, term string")
    got = sorted((r["i"], r["k"]) for r in index.search_many("low", asked, "term", ["i"]).collect())
    assert got == sorted((i, 5000 * k) for i, m in enumerate(terms) for k, x in enumerate(texts) if m and x and m in x.lower())
    none = textindex.build(df.limit(0), "k", {"low": F.lower("t")}, resolve.new_folder(spark, "test-index"))
    assert none.search([("low", "abc"), ("low", "a"), ("low", "%")], F.lit(True)).collect() == []


@pytest.mark.parametrize("kind", ["long", "double"])
def test_ranges_by_blocks(spark, kind):
    rng = random.Random(1)
    number = (lambda a, b: rng.randrange(a, b)) if kind == "long" else (lambda a, b: rng.choice((rng.uniform(a, b), float(rng.randrange(a, b)))))
    ranges = [(k, lo := number(-300, 300), lo + number(-3, rng.choice((3, 40, 500)))) for k in range(200)] + [(900, None, 5), (901, -10, None)]
    ranges = [(k, *(None if x is None else float(x) if kind == "double" else x for x in r)) for k, *r in ranges]
    values = [number(-400, 900) for _ in range(400)] + [None, ranges[0][1], ranges[0][2]]
    df, by = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}"), spark.createDataFrame(ranges, f"n int, lo {kind}, hi {kind}")
    got = {r["i"]: r["n"] for r in joins.range_first(df, "v", by, "lo", "hi", "n").collect()}
    holds = lambda v, lo, hi: None not in (v, lo, hi) and lo <= v <= hi
    assert got == {i: min((n for n, lo, hi in ranges if holds(v, lo, hi)), default=None) for i, v in enumerate(values)} and None in got.values()
    assert {r["n"] for r in joins.range_first(df, "v", by.limit(0), "lo", "hi", "n").collect()} == {None}


def test_blocks_are_the_fewest(spark):
    cases = [(0, 0), (1, 6), (-5, 7), (3, 2), (0, 1023), (1, 1022), (-1, -1)]
    rows = spark.createDataFrame(cases, "a long, b long").select("a", "b", joins.dyadic_blocks(F.col("a"), F.col("b")).alias("d")).collect()
    for a, b, blocks in rows:
        assert sorted(x for level, p in blocks for x in range(p << level, (p + 1) << level)) == list(range(a, b + 1)) and len(blocks) <= 2 * max(1, (b - a + 1).bit_length())
    assert [len(r["d"]) for r in rows] == [1, 4, 3, 0, 1, 18, 1]


def test_nearest_on_either_side(spark):
    rng = random.Random(2)
    left = [(k, rng.choice("aab"), rng.choice((None, rng.randrange(-200, 200)))) for k in range(150)]
    right = [(rng.choice("ab"), rng.choice((None, rng.randrange(-200, 200))), rng.choice("xyz")) for _ in range(60)] + [("a", 5, "z"), ("a", 5, "x"), ("b", 5, None)]
    got = joins.nearest_within(spark.createDataFrame(left, "k int, g string, at long"), spark.createDataFrame(right, "g string, at long, v string"), ["g"], "at", 4, ["v"])

    def near(g, at):
        found = sorted((abs(a - at), a, v is not None, v or "") for h, a, v in right if h == g and a is not None and at is not None and abs(a - at) <= 4)
        return (found[0][1], found[0][3] or None) if found else (None, None)

    assert {r["k"]: (r["near_at"], r["v"]) for r in got.collect()} == {k: near(g, at) for k, g, at in left}


def test_assignment_is_greedy(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(30), rng.randrange(30), rng.choice((None, *range(6)))) for _ in range(250)] + [(None, 1, 9), (1, None, 9)]
    got = sorted((r["a"], r["b"], r["s"]) for r in joins.assign_best(spark.createDataFrame(pairs, "a int, b int, s int"), "a", "b", "s").collect())
    best, used = {}, set()
    for a, b, s in pairs:
        if None not in (a, b, s):
            best[a, b] = max(s, best.get((a, b), s))
    want = []
    for (a, b), s in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if not {("a", a), ("b", b)} & used:
            used |= {("a", a), ("b", b)}
            want.append((a, b, s))
    assert got == sorted(want)


def replayed(rows, edits, columns):
    state = {r[0]: dict(zip(columns, r, strict=True)) for r in rows}
    for number, (_, action, target, match, proposed, status) in enumerate(sorted(edits)):
        if status != "approved":
            continue
        if action == "UPDATE" and target in state:
            state[target].update({k: v for k, v in proposed.items() if k in columns[1:]})
        elif action == "DELETE":
            state.pop(target, None)
        elif action == "ADD":
            state["added", number] = {c: proposed.get(c) for c in columns}
        elif action == "BULK":
            for r in state.values():
                if r["part"] is not None and r["part"] == match:
                    r.update({k: v for k, v in proposed.items() if k in columns[1:] and (v or "").strip()})
    return sorted((tuple(str(r[c]) for c in columns) for r in state.values()))


@pytest.mark.parametrize("seed", range(3))
def test_replay_of_random_logs(spark, seed):
    rng = random.Random(seed)
    columns = ["id", "part", "name", "age"]
    rows = [(k, rng.choice(("A", "B", "C", None)), f"n{k}", str(k)) for k in range(40)]
    edits = []
    for n in rng.sample(range(1, 1000), 70):
        action = rng.choice(("UPDATE", "UPDATE", "DELETE", "ADD", "BULK", "BULK", "BULK"))
        fields = {k: v for k, v in (("part", rng.choice("ABCD")), ("name", rng.choice(("x", f"e{n}", " ", None))), ("age", str(n)), ("other", "o")) if rng.random() < 0.5}
        fields |= {"id": str(1000 + n), "part": rng.choice("ABC")} if action == "ADD" else {}
        target = rng.randrange(45) if action in ("UPDATE", "DELETE") and (action == "UPDATE" or rng.random() < 0.3) else None
        edits.append((n, action, target, rng.choice("ABCD") if action == "BULK" else None, fields, rng.choice(("approved",) * 5 + ("pending", "rejected"))))
    df = spark.createDataFrame(rows, "id long, part string, name string, age string")
    log = spark.createDataFrame(edits, "edit_id long, action string, target_id long, match string, proposed map<string,string>, status string")
    got = dml.replay_edits(df, log, "id", "part", ["part", "name", "age"]).collect()
    assert sorted(tuple(str(r[c]) for c in columns) for r in got) == replayed(rows, edits, columns)
    assert dml.replay_edits(df, log.limit(0), "id", "part", ["part", "name"]).count() == 40


@pytest.mark.parametrize("seed", [5, 6])
def test_replay_where_edits_share_numbers(spark, seed):
    """A BULK edit and the edits of single rows of its number: the BULK edit comes first, and none is lost."""
    rng = random.Random(seed)
    rows = [(k, rng.choice("ABC"), f"n{k}", str(k)) for k in range(30)]
    edits = []
    for n in range(1, 60, 2):
        fields = lambda: {k: v for k, v in (("part", rng.choice("ABCD")), ("name", f"e{rng.random()}"), ("age", str(rng.randrange(99)))) if rng.random() < 0.4}
        edits.append((n, "BULK", None, rng.choice("ABCD"), fields(), "approved"))
        edits += [(n, "UPDATE", k, None, fields(), "approved") for k in rng.sample(range(30), 4)]
    df = spark.createDataFrame(rows, "id long, part string, name string, age string")
    log = spark.createDataFrame(edits, "edit_id long, action string, target_id long, match string, proposed map<string,string>, status string")
    got = dml.replay_edits(df, log, "id", "part", ["part", "name", "age"]).collect()
    assert sorted(tuple(str(r[c]) for c in ("id", "part", "name", "age")) for r in got) == replayed(rows, edits, ["id", "part", "name", "age"])


def test_deep_pages(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice((None, 1.0, 7.5, rng.random() * 100))) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, v double")
    for number, size, down in ((1, 7, False), (12, 20, True), (13, 20, False), (26, 20, True), (30, 20, False), (99, 9, False)):
        order = [F.col("v").desc_nulls_last() if down else F.col("v").asc_nulls_last(), F.col("k")]
        assert P.deep_page(df, "v", "k", number, size, down).collect() == P.page(df, order, number, size).collect()
    assert P.deep_page(df.limit(0), "v", "k", 1, 5).collect() == []


def test_running_starts(spark):
    rng = random.Random(6)
    pages, want = [], {}
    for f in "ab":
        running = 0
        for p in range(1, 90):
            formula, n = (p - 1) * 30 + 1, rng.randrange(20, 33)
            votes = [(c, formula + rng.choice((0, 0, 3, 25, -40, running - formula + 4))) for c in range(3) if rng.random() < 0.6]
            pages.append((f, p, votes, n, formula))
            starts, start = [s for _, s in votes], None
            twice = [s for s in starts if s >= 1 and starts.count(s) >= 2]
            first = votes[0][1] if votes and votes[0][0] == 0 else None
            if twice:
                start = twice[0]
            elif first is not None and first >= 1 and ((running > 1 and abs(first - running) <= 6) or first <= formula + 10 or running <= 1):
                start = first
            elif running > 1:
                start = next((s for s in starts if abs(s - running) <= 5), running)
            else:
                start = max(1, formula)
            want[f, p], running = start, start + n
    df = spark.createDataFrame(pages, "f string, p int, votes array<struct<column:int,start:long>>, n int, formula long")
    got = S.running_starts(df, "f", "p", "votes", "n", "formula").collect()
    assert {(r["f"], r["p"]): r["start"] for r in got} == want and {r["way"] for r in got} >= {"agreed", "first", "running"}


def test_compounds_and_typos(spark):
    words = ["haustür", "haus", "tür", "hau", "stür", "türhaushau", "xyzxyz", "haushaus", "a", "hasu", "huas", "hausx", "hus", "üaus", "abcd"]
    lex = spark.createDataFrame([("haus", 5), ("tür", 9), ("hau", 2), ("stür", 1), ("aus", 5)], "word string, n long")
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["word"]: r["pieces"] for r in lexicon.split_compounds(df, lex, 3, 6).collect()}
    assert got == {"haustür": ["hau", "stür"], "türhaushau": ["tür", "haus", "hau"], "haushaus": ["haus", "haus"]}
    fixed = {r["word"]: r["correction"] for r in lexicon.correct(df, lex).collect()}
    assert fixed == {"hasu": "haus", "huas": "haus", "hausx": "haus", "hus": "aus", "üaus": "aus"}
    assert lexicon.word_counts(spark.createDataFrame([("Haus, HAUS tür-1",), (None,)], "t string"), "t").collect()[0]["n"] >= 1


def test_statistics_come_with_the_write(spark):
    df = spark.createDataFrame([(1, "b"), (3, None), (None, "a")], "k int, s string")
    path = resolve.new_folder(spark, "test-observed")
    got = {r["column"]: tuple(r)[1:] for r in readers.write_observed(df, path, ["k", "s"]).collect()}
    assert got == {"k": (3, 1, "1", "3"), "s": (3, 1, "a", "b")} and spark.read.parquet(path).count() == 3
