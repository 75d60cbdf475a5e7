import hashlib
import random

import numpy as np
import pytest

from ledgerlark.llm import components, exact_dedup, jaccard_join, passages, suffix_dedup
from tests.llm.helpers import DOCS, corpus, frame, jaccard_components, prose, repeated_bytes


@pytest.mark.parametrize("extra", [False, True])
def test_exact_groups_match_brute_force(spark, extra):
    rows = corpus()
    out = exact_dedup.exact_groups(frame(spark, rows, extra)).collect()
    got = {r["doc_id"]: r for r in out}
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r[1] or "", []).append(r[0])
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in rows)  # rows that repeat count one by one
    for text, ids in by.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert bytes(got[i]["digest"]) == hashlib.sha256(text.encode()).digest()


def test_exact_dedup_keeps_one_of_each_text_and_all_columns(spark):
    df = frame(spark, corpus(), True)
    out = exact_dedup.drop_exact_copies(df)
    texts = [r["text"] or "" for r in out.collect()]
    assert out.columns == df.columns and len(texts) == len(set(texts)) == len({r[1] or "" for r in corpus()})


def test_exact_dedup_of_history_and_null_ids(spark):
    rows = [(None, "a", None, None, 1), (1, "a", None, None, 1), (2, "b", None, None, 1), (None, "c", None, None, 1)]
    for history in (None, "true", "false", "doc_id = 1"):
        from pyspark.sql import functions as F

        got = exact_dedup.exact_groups(frame(spark, rows), None if history is None else F.expr(history)).collect()
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in got) == [
            ("1", "1", 2, True), ("2", "2", 1, True), ("None", "1", 2, False), ("None", "None", 1, True),
        ]
    assert exact_dedup.exact_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = np.random.default_rng(3).integers(0, 2**63, (5000, 2)).astype(np.uint64)
    levels, slots = exact_dedup.perfect_hash(keys)
    assert sorted(slots) == list(range(5000)) and (exact_dedup.slot_of(keys, levels) == slots).all()


@pytest.mark.parametrize(("size", "num"), [(4, 85), (5, 80), (1, 100)])
def test_jaccard_groups_match_brute_force(spark, size, num):
    rows = corpus(size)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(frame(spark, rows, size == 5), size, num).collect()}
    assert got == jaccard_components(rows, size, num, 100)


def test_jaccard_with_many_frequent_shingles(spark):
    rng = random.Random(8)
    shared = prose(rng, 120)
    rows = [(k, shared + " " + prose(rng, 8 + k % 9), "en", "a", 1) for k in range(90)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(frame(spark, rows), 4, 85).collect()}
    assert got == jaccard_components(rows, 4, 85, 100)


def test_jaccard_edges(spark):
    assert jaccard_join.jaccard_groups(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c d e f", None, None, 1), (1, "a b c d e f", None, None, 1)]
    assert sorted(str(r["component_id"]) for r in jaccard_join.jaccard_groups(frame(spark, rows)).collect()) == ["1", "None"]
    with pytest.raises(ValueError, match="threshold"):
        jaccard_join.jaccard_groups(frame(spark, rows), 5, 50)
    df = frame(spark, corpus(), True)
    out = jaccard_join.drop_near_copies(df)
    groups = jaccard_components(corpus(), 5, 80, 100)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {i for i, (_, c) in groups.items() if i == c}


def test_prefix_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(5)
    for n in (1, 5, 31, 32, 64, 300, 2000):
        for _ in range(5):
            x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            lose = (len(x) * 15) // 100
            y = np.unique(np.concatenate([x[lose:], rng.integers(0, 2**64, 0, dtype=np.uint64)]))
            sides = []
            for s in (x, y):
                t = jaccard_join.index_tokens(s, 85, 100)
                classes = np.where(jaccard_join.is_first(t), 2 + (t >> np.uint32(8)) % 80, 255).astype(np.uint8)
                sides.append(set(jaccard_join.signatures(t, classes, len(s), 85, 100).tolist()))
            if 100 * len(y) >= 85 * len(x):
                assert sides[0] & sides[1], n


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(200, 260)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(70)] + [(5, 5)]
    forest = components.Forest()
    for a, b in links:
        forest.union(a, b)
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: forest.find(x) for a, b in links if a != b for x in (a, b)}


@pytest.mark.parametrize("hot", [0, 512])
def test_suffix_dedup_matches_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "GRAM", 16)
    rng = random.Random(2)
    passage = prose(rng, 30)
    rows = [(k, prose(rng, 20) + passage[k % 3 :] + prose(rng, 10), "en", "a", 1) for k in range(12)]
    rows += [(50, "ab" * 300, "en", "a", 1), (51, "x" * 700 + "y", "en", "a", 1), (52, "z" + "x" * 500, "en", "a", 1), (53, None, "en", "a", 1), (54, "", "en", "a", 1), (None, "é" * 90, "en", "a", 1)]
    rows += [rows[3], (55, rows[4][1], "en", "a", 1), (56, "\0" * 150, "en", "a", 1)]
    want = repeated_bytes(rows, 100)
    out = suffix_dedup.remove_repeats(frame(spark, rows, True), 100).collect()
    assert len(out) == len(rows)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], None if r["kept"] is None else bytes(r["kept"])) for r in out)
    expect = []
    for r, gone in zip(rows, want, strict=True):
        data = (r[1] or "").encode()
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        expect.append((str(r[0]), len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone, strict=True) if not g) if sum(gone) else None))
    assert got == sorted(expect)
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS), 100).count() == 0


def test_two_stage_sorts_all_suffixes():
    rng = random.Random(6)
    for alphabet in (b"a", b"ab", b"abc\0\xff"):
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(8)]
        text, at = suffix_dedup.two_stage(texts, [len(t) for t in texts], 1000)
        got = [texts[k][i:] for k, i in zip(text, at, strict=True)]
        assert got == sorted(t[i:] for t in texts for i in range(len(t)))
        share = suffix_dedup.neighbours_share(texts, text, at, 5)
        assert share[1:].tolist() == [x[:5] == y[:5] for x, y in zip(got, got[1:], strict=False)]


def test_passages_found_and_clean_documents_left_alone(spark):
    rng = random.Random(9)
    passage = prose(rng, 70).split()
    rows = []
    for k in range(8):
        own = list(passage)
        own[10 + k] = "typo"
        del own[40]
        rows.append((k, prose(rng, 40 + k) + " " + " ".join(own) + " " + prose(rng, 30), "en", "a", 1))
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows += [(50 + k, " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(200)), "en", "a", 1) for k in range(5)]
    rows += [(70, None, "en", "a", 1), (71, "", "en", "a", 1), (72, "short text", "en", "a", 1), (73, rows[9][1], "en", "a", 1), (74, "short text", "en", "a", 1), rows[2]]
    out = passages.shared_passages(frame(spark, rows, True)).collect()
    assert {r["doc_id"] for r in out} == {*range(8), 51, 73}
    for r in out:
        assert r["matched"] >= 40 and r["identity"] >= 0.8 and r["doc_id"] != r["partner_id"]
        if r["doc_id"] < 8:
            assert r["start"] <= 40 + r["doc_id"] + 12 and r["end"] >= 40 + r["doc_id"] + 55
    assert passages.shared_passages(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("every, n", [(8, 60), (10, 50), (12, 60)])
def test_fuzzy_passages_are_found(spark, every, n):
    """Documents in pairs; a passage of n words in both, every so many words replaced in one."""
    rng = random.Random(every)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for k in range(60):
        one = [word() for _ in range(n)]
        two = [word() if i % every == every - 1 else w for i, w in enumerate(one)]
        rows += [(2 * k + i, " ".join([word() for _ in range(50)] + own + [word() for _ in range(50)]), "en", "a", 1) for i, own in enumerate((one, two))]
    out = passages.shared_passages(frame(spark, rows)).collect()
    found = {r["doc_id"] for r in out}
    assert found == set(range(120))
    assert all(r["partner_id"] == r["doc_id"] ^ 1 for r in out)


def test_chains_left_out_are_no_passages():
    rng = np.random.default_rng(4)
    for share in (0.5, 0.7, 0.85, 0.95):
        for _ in range(300):
            x = rng.integers(0, 6, 140)
            y = np.where(rng.random(140) < share, x, rng.integers(0, 6, 140))
            at = np.array([int(rng.integers(0, 137))])
            y[at[0] : at[0] + 4] = x[at[0] : at[0] + 4]
            hashes = rng.integers(0, 1 << 62, 6).astype(np.uint64)
            near = [passages.surroundings(hashes[z], at) for z in (x, y)]
            zero, known = np.array([0]), np.array([True])
            matched = passages.align([*map(str, x)], [*map(str, y)], at.tolist(), at.tolist())[4]
            assert matched < passages.LEAST_WORDS or passages.may_be_passages(at, at, *near, known, zero, zero).all()


def test_passages_in_hubs_that_repeat_their_lines(spark):
    """The lowest and highest documents hold all pieces of the passage, in another order, before and after it; runs of one word or phrase."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passage = fresh(60)
    words = passage.split()
    pieces = [" ".join(words[k : k + 20]) for k in (40, 30, 20, 10, 0)]  # every seed is in one of them
    apart = " ".join(f"{fresh(40)} {x}" for x in pieces)
    hubs = [f"{apart} {fresh(50)} {passage} {fresh(50)} {apart}" for _ in range(2)]
    texts = {0: hubs[0], 1: f"{fresh(20)} {passage} {fresh(20)}", 2: f"{fresh(30)} {passage}", 9: hubs[1]}
    texts |= {20: f"{fresh(20)} " + "same " * 300, 21: "same " * 50 + fresh(20), 30: "over and again " * 100 + fresh(9), 31: fresh(9) + " over and again" * 20}
    out = passages.shared_passages(frame(spark, [(k, x, "en", "a", 1) for k, x in texts.items()])).collect()
    assert {r["doc_id"] for r in out} == set(texts)
    assert {(1, 0), (1, 9), (2, 0), (2, 9), (21, 20), (31, 30)} <= {(r["doc_id"], r["partner_id"]) for r in out}


def test_passages_of_frequent_lines(spark):
    """A passage of two lines, and a fuzzy one, in documents whose hubs hold less than a passage of each seed."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    fresh = lambda n: " ".join(word() for _ in range(n))
    words = fresh(60).split()
    pieces = [" ".join(words[k : k + 30]) for k in range(0, 31, 10)]
    fuzzy = [w if k % 15 != 14 else word() for k, w in enumerate(words)]
    held = [f"{fresh(20)} {' '.join(x)} {fresh(20)}" for x in (words, words, fuzzy)]
    rows = [(k, f"{fresh(30)} {x} {fresh(30)}", "en", "a", 1) for k, x in enumerate(pieces)] + [(10 + k, x, "en", "a", 1) for k, x in enumerate(held)]
    rows += [(20 + k, f"{fresh(30)} {x} {fresh(30)}", "en", "a", 1) for k, x in enumerate(pieces)]
    out = passages.shared_passages(frame(spark, rows)).collect()
    assert {(r["doc_id"], r["partner_id"]) for r in out} == {(x, y) for x in (10, 11, 12) for y in (10, 11, 12) if x != y}


def test_chain_prefers_collinear_matches():
    pa, pb = np.array([0, 6, 12, 18, 6]), np.array([100, 106, 112, 118, 5])
    assert passages.chains(pa, pb)[0] == [0, 1, 2, 3]
    assert passages.common_words("a b c d".split(), "a x c d".split()) == 3


def test_a_line_of_a_third_of_all_documents_is_not_compared_in_pairs(spark, monkeypatch):
    """2,000 documents; 700 hold one line of 16 words, of these two a passage around it that neither the lowest nor the highest has."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    fresh = lambda n: " ".join(word() for _ in range(n))
    line, before, after = fresh(16), fresh(20), fresh(20)
    texts = [f"{fresh(30)} {line} {fresh(30)}" if k % 3 == 0 else fresh(60) for k in range(2000)]
    for k in (300, 600):
        texts[k] = f"{fresh(20)} {before} {line} {after} {fresh(20)}"
    seen = []
    made = passages.compared
    monkeypatch.setattr(passages, "compared", lambda marked: seen.append(marked.groupBy("seed").count().selectExpr("sum(count * (count - 1) / 2)").first()[0] or 0) or made(marked))
    out = passages.shared_passages(frame(spark, [(k, x, "en", "a", 1) for k, x in enumerate(texts)])).collect()
    assert {(r["doc_id"], r["partner_id"]) for r in out} == {(300, 600), (600, 300)}
    assert sum(seen) <= 2000 * passages.EASY


def test_stretches_of_one_word_in_many_documents(spark):
    """The lowest and highest documents hold a short stretch; long ones are linked with hubs of their own, short ones stay alone."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    fresh = lambda n: " ".join(word() for _ in range(n))
    long = {*range(20, 60)}
    rows = [(k, f"{fresh(10)} {'same ' * (60 + k if k in long else 20)}{fresh(10)}", "en", "a", 1) for k in range(150)]
    out = passages.shared_passages(frame(spark, rows)).collect()
    assert {r["doc_id"] for r in out} == long
    forest = components.Forest()
    for r in out:
        forest.union(r["doc_id"], r["partner_id"])
    assert {forest.find(x) for x in long} == {20}
