"""Tests of the findings of round 3: what a worker holds at once."""

import random
import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from ledgerlark.llm import jaccard_join, packing, passages, queries
from tests.llm.helpers import corpus, frame, prose


def test_placing_sends_no_ids_to_python(spark):
    out = packing.pack(frame(spark, corpus(), True), queries.make_encoder, 256)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "placed(length" in plan
    assert out.columns == ["length", "doc_id", "piece", "start", "ids", "sequence_id", "offset"]


def test_kept_words_are_bounded_and_change_no_ids(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(300)) for _ in range(5)]
    encode = queries.make_encoder()
    monkeypatch.setattr(encode, "words", {})
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    assert [encode(t) for t in texts] == [encode.exact(t) for t in texts]
    assert len(encode.words) <= 50
    assert jaccard_join.CACHE_WORDS <= 100_000


def test_scan_holds_the_words_of_one_text_only():
    text = prose(random.Random(3), 400)
    batch = pd.DataFrame({"doc_id": range(3000), "text": [text] * 3000})
    tracemalloc.start()
    out = next(passages._scan(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["n_words"].tolist() == [400] * 3000 and out["digest"].nunique() == 1
    assert peak < 5e6  # all words at once: over 50 MB


@pytest.mark.parametrize("holders", [60, 400])
def test_a_passage_of_one_line_is_found_however_many_hold_the_line(spark, holders):
    """All seeds that the passage's two documents share lie in the line: beyond it three words in four are the same."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    fresh = lambda n: [word() for _ in range(n)]
    line, before, after = fresh(12), fresh(20), fresh(20)
    texts = [fresh(30) + line + fresh(30) for _ in range(holders)]
    for k in (holders // 3, holders // 2):
        own = [[w if i % 4 else word() for i, w in enumerate(x)] for x in (before[::-1], after)]
        texts[k] = fresh(20) + own[0][::-1] + line + own[1] + fresh(20)
    out = passages.shared_passages(frame(spark, [(k, " ".join(x), "en", "a", 1) for k, x in enumerate(texts)])).collect()
    assert {(r["doc_id"], r["partner_id"]) for r in out} == {(holders // 3, holders // 2), (holders // 2, holders // 3)}
    assert all(r["matched"] == 42 for r in out)


def test_words_around_find_the_passages_that_alignment_finds(monkeypatch):
    """Places of one seed in blocks of any size, against aligning all pairs."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for k in range(40):
        p = rng.choice((0.05, 0.15, 0.25, 0.6))
        texts.append([w if 40 <= i < 46 or rng.random() > p else f"x{k}-{i}" for i, w in enumerate(base)][rng.randrange(0, 40) :])
    at = [x.index("w41") for x in texts]
    want = {(i, j) for j in range(40) for i in range(j) if passages.align(texts[i], texts[j], [at[i]], [at[j]])[4] >= passages.LEAST_WORDS}
    around = [passages.words_around(" ".join(x), [p])[0] for x, p in zip(texts, at, strict=True)]
    for size, blocks in ((7, 1), (2048, 3)):
        monkeypatch.setattr(passages, "BLOCK", size)
        rows = [(1, min(k % blocks, o), max(k % blocks, o), k % blocks, k, at[k], k, 0, 0, around[k]) for k in range(40) for o in range(blocks)]
        pdf = pd.DataFrame(rows, columns=["seed", "c1", "c2", "block", "doc", "pos", "near", "run", "hubs", "words"]).sort_values(["seed", "c1", "c2"], ignore_index=True)
        found = [(a, b) for x in passages.compare_words(pdf) for a, b in zip(x["a"], x["b"], strict=True)]
        assert len(found) == len(set(found)) and want <= set(found)
    assert len(want) > 20 and len(found) < 2 * len(want)


def test_stages_send_batches_of_bounded_bytes(spark):
    import corpus_pipeline
    from ledgerlark.llm.common import BATCH_BYTES

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [int(pdf["text"].str.len().sum())]})

    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(name, "64m")
            stage(spark, frame(spark, corpus(n=8), True), "")
            rows = spark.range(0, 6000, 1, 1).selectExpr("repeat('ab', 1000) AS text").mapInPandas(sizes, "n long").collect()
            assert sum(r["n"] for r in rows) == 12_000_000 and max(r["n"] for r in rows) <= BATCH_BYTES
        spark.conf.set(name, "1m")  # a smaller bound stays
        corpus_pipeline.STAGES[-1][1](spark, frame(spark, corpus(), True), "")
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_pairs_of_large_entries_meet_once_and_by_one_hub(spark):
    from pyspark.sql import functions as F

    rows = [(sig, k, 100, 100, -1000, k, 0.5 if k % 2 else 0.9, k % 2, 30) for sig in (7, 8, 9) for k in range(30)]
    active = spark.createDataFrame(rows, "sig long, doc long, n long, m long, e long, label long, far double, by long, members long")
    part = active.withColumn("part", F.col("doc") % 29)  # 0 and 29 share a part, so 29 is no hub
    hubs = part.groupBy("sig", "part", "members").agg(F.min(F.struct("e", "doc", "n", "m", "label", "far", "by")).alias("hub"))
    found = [(r["a"], r["b"]) for r in jaccard_join._meetings(active, part, hubs, 512, 80, 100).collect()]
    # distances to different first hubs tell nothing, so no pair is left out
    assert sorted(found) == [(a, b) for a in range(30) for b in range(a + 1, 30)]
    apart = active.withColumn("by", F.lit(0).cast("long"))
    part = apart.withColumn("part", F.col("doc") % 29)
    hubs = part.groupBy("sig", "part", "members").agg(F.min(F.struct("e", "doc", "n", "m", "label", "far", "by")).alias("hub"))
    found = [(r["a"], r["b"]) for r in jaccard_join._meetings(apart, part, hubs, 512, 80, 100).collect()]
    assert sorted(found) == [(a, b) for a in range(30) for b in range(a + 1, 30) if (b - a) % 2 == 0]


def test_places_of_a_frequent_line_meet_only_where_they_share_more():
    """1,500 places of one line of 13 words: the pairs that meet hold all that agree in enough words, and are few; in one block and in two."""
    rng = np.random.default_rng(4)
    n, far = 1500, passages.AROUND
    words = rng.integers(2, 3000, (n, 2 * far)).astype(np.uint16)
    words[:, far - 4 : far + 5] = 7  # the line, its seed in the middle
    for k in range(0, 300, 2):  # passages around it with a third of the words replaced at most, some at a text's end
        same = rng.random(2 * far) > rng.choice([0.05, 0.2, 0.33])
        words[k] = np.where(same, words[k + 1], words[k])
    words[100:200, : far - 30] = 0
    second = np.arange(n) % 3 == 0
    for other in (None, second):
        looked = [np.stack(x) for x in passages.light_pairs(words, other)]
        i, j = np.concatenate(looked, axis=1)
        met = set(zip(i.tolist(), j.tolist(), strict=True))
        assert len(met) == len(i) < n * (n - 1) / 2 / 20
        want = set()
        for i, j in passages.all_pairs(words, other):
            same = (words[i] == words[j]) & (words[i] > 0)
            enough = passages.most_in_common(same[:, far - 1 :: -1]) + passages.most_in_common(same[:, far:]) + passages.SEED >= passages.LEAST_WORDS
            want |= set(zip(i[enough].tolist(), j[enough].tolist(), strict=True))
        assert len(want) > 40 and want <= met
    assert passages.light_pairs(np.full((50, 2 * far), 9, dtype=np.uint16), None) is None


def test_what_bits_reach_is_no_less_than_what_words_reach():
    rng = np.random.default_rng(5)
    fewer = 0
    for _ in range(2000):
        n = int(rng.integers(1, passages.NEAR + 1))
        x = rng.integers(0, 2**32, n, dtype=np.uint64)
        y = np.where(rng.random(n) < rng.random(), x, rng.integers(0, 2**32, n, dtype=np.uint64))
        near = [passages.bits_after(v)[:1].view(np.int64) for v in (x, y)]
        most = passages.most_reached(*near)[0]
        assert most >= min(passages.LEAST_WORDS, passages.reach(x.tolist(), y.tolist())[1])
        fewer += most < passages.most_reached_of(near[0] ^ near[1], passages.NEAR)[0]
    assert fewer > 200


def test_shuffle_files_of_finished_queries_are_freed(spark):
    from ledgerlark.llm import common

    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    common.free_shuffles(spark)
    time.sleep(2)
    before = files()
    made = common.materialise(spark.range(1000).repartition("id"), "freed")
    assert files() > before
    common.free_shuffles(spark)
    for _ in range(100):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and made.count() == 1000


def test_chains_are_aligned_in_portions_and_texts_cut_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    line = prose(rng, 45)
    rows = [(k, f"{prose(rng, 30)} {line} {prose(rng, 10)}", "en", "a", 1) for k in range(9)]
    found = []
    for most, at_once in ((passages.CUTS, passages.CHAINS_AT_ONCE), (2, 6)):
        monkeypatch.setattr(passages, "CUTS", most)
        monkeypatch.setattr(passages, "CHAINS_AT_ONCE", at_once)
        found.append(sorted(map(tuple, passages.shared_passages(frame(spark, rows)).collect())))
    assert found[0] == found[1] and len(found[0]) >= 16


def test_words_of_chains_leave_a_worker_in_frames_of_bounded_length(monkeypatch):
    monkeypatch.setattr(passages, "CUTS", 10)
    n = 35
    at = np.arange(n, dtype=np.int32)
    row = {f: [at] * 3 for f in ("a", "b", "chain", "side", "o")} | {"p": [np.array([b"x"] * n, dtype=object)] * 3, "n": [np.full(n, 2, dtype=np.int32)] * 3, "text": [" ".join(f"W{k}" for k in range(40))] * 3}
    out = list(passages._cut(iter([pd.DataFrame(row)])))
    assert max(map(len, out)) <= 20 and sum(map(len, out)) == 3 * n
    assert pd.concat(out)["words"].tolist() == [f"w{k} w{k + 1}".encode() for k in range(n)] * 3


@pytest.mark.parametrize("easy", [64, 0])
def test_passages_with_insertions_that_no_hub_holds(spark, monkeypatch, easy):
    """Each stretch of a passage is in other documents too, alone, so only the matches of the two documents together tell the passage."""
    monkeypatch.setattr(passages, "EASY", easy)
    fresh = iter(f"w{k}" for k in range(100_000))
    some = lambda n: [next(fresh) for _ in range(n)]
    parts = [some(12) for _ in range(6)]
    texts = {k: some(30) + part + some(30) for k, part in enumerate(parts)} | {100 + k: some(30) + part + some(30) for k, part in enumerate(parts)}
    texts[50] = some(40) + [w for part in parts for w in part] + some(40)
    texts[51] = some(50) + [w for part in parts for w in (*part, *some(1))] + some(20)
    out = passages.shared_passages(frame(spark, [(k, " ".join(x), "en", "a", 1) for k, x in texts.items()])).collect()
    assert sorted((r["doc_id"], r["partner_id"], r["matched"]) for r in out) == [(50, 51, 72), (51, 50, 72)]
