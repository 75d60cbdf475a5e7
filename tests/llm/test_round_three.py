"""Importance resampling, the prefix trie and posting lists against brute force, with the awkward cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import ann, prefix_trie, queries, resampling

from .helpers import corpus, frame, prose

FOLDER = Path("/root/testdata/sf0.001")


# ------------------------------------------------------------------ resampling
def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def grams(text):
    w = words_of(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def resampled(rows, target, percent, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for text in texts for f in grams(text)) for texts in ([r[1] for r in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for r in rows:
        f = grams(r[1])
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(r[1]))])
    able = sorted((o for o in out if o[4] >= 20), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    ranks = {id(o): n for n, o in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*o[:4], ranks.get(id(o))) for o in out), key=repr)


def test_resampling_by_brute_force(spark):
    rng = random.Random(5)
    rows = corpus() + [(None, prose(rng, 40), "en", "a", 1), (9, prose(rng, 25), "en", "a", 1), (400, "Ünï0 A\x00b " * 30, "de", "a", 1)]
    target = [prose(rng, 50), None, "", "ÜNÏ0 ab"]
    docs, wanted = frame(spark, rows, extra=True), spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = sorted((tuple(r) for r in resampling.resample(docs, wanted).collect()), key=repr)
    assert got == resampled(rows, target, 25, 7) and sum(r[4] is not None for r in got) > 10
    every = resampling.resample(docs, wanted.limit(0), percent=100, seed=3).collect()
    assert sorted((tuple(r) for r in every), key=repr) == resampled(rows, [], 100, 3)


def test_resampling_of_nothing(spark):
    none = frame(spark, [])
    assert resampling.resample(none, none.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_slices_carry_the_last_word_on(monkeypatch):
    text = ("Eins zwei-drei  " * 50 + "x" * 90).encode()
    want = sorted(zlib.crc32(f.encode()) % 10000 for f in grams(text.decode()))
    for size in (1, 7, 64, 5000):
        monkeypatch.setattr(resampling, "SLICE", size)
        got = [*resampling.bucket_slices(text)]
        assert sorted(b for buckets, _ in got for b in buckets.tolist()) == want and sum(n for _, n in got) == 151


# ------------------------------------------------------------------ prefix trie
def conversations(rng, n=260):
    rows = []
    for c in range(n):
        if c % 13 == 5:
            continue
        kind = rng.randrange(4)
        turns = [("user", f"t{rng.randrange(2)}"), ("assistant", None), (None, "ä😀" * rng.randrange(1, 4)), ("user", f"u{rng.randrange(3)}")]
        for k, (role, text) in enumerate((turns * 3)[: kind * 2 + rng.randrange(3)]):
            rows.append((c, None if k == 0 and c % 7 == 0 else k, role, text))
    rows += [(700 + c, k, "user", f"same {k}") for c in range(40) for k in range(3)]  # copies
    rows += [(801, 0, "user", "x" * 100_000), (None, 0, "user", "nobody's"), (-250, 0, "user", "below zero"), (-200, 0, "user", "base"), (900, 0, "u", "a"), (900, 0, "u", "a")]
    rng.shuffle(rows)
    return rows


def token(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16] + len(text).to_bytes(4, "big")


def tries(paths):
    """Nodes of the trie by their prefixes; paths: conv_id -> list of (token, code points)."""
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * int.from_bytes(p[-1][16:], "big") if p else 0
        below[p] = (sum(below[c][0] for c in children[p]) or 1, own + sum(below[c][1] for c in children[p]))
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuild(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, token(role, text)))
    own = {c: [x[2] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


@pytest.mark.parametrize("ranges", [None, 7, 70])
def test_trie_by_brute_force(spark, ranges):
    rows = conversations(random.Random(2))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("key", "depth", "part", "ends", "path", "base")})
    got = sorted((tuple(r) for r in prefix_trie.trie(df, ranges).collect()), key=repr)
    assert got == tries(rebuild(rows)) and any(r[3] >= 40 for r in got)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


@pytest.mark.parametrize("seed", range(40))
def test_stitching_any_cuts(seed, monkeypatch):
    """Sweeps of random ranges and rounds of stitching, without Spark: the same nodes as in one piece."""
    rng = random.Random(seed)
    monkeypatch.setattr(prefix_trie, "FAN", rng.choice((2, 3, 64)))
    monkeypatch.setattr(prefix_trie, "PIECE", rng.choice((1, 3, 1000)))
    paths = {c: [token("u", "abcd"[rng.randrange(rng.choice((1, 2, 4)))]) for _ in range(rng.randrange(6))] for c in rng.sample(range(1000), 60)}
    order = sorted((b"".join(p), c) for c, p in paths.items())
    cuts = sorted(rng.choices(range(len(order) + 1), k=rng.randrange(12)))
    swept = []
    for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(order)], strict=True)):
        sweep = prefix_trie.Sweep(part)
        for path, c in order[a:b]:
            sweep.take(c, path)
        sweep.end()
        swept.append(sweep.flush())
    rows = pd.concat(swept, ignore_index=True)
    open_, parts, closed = rows[rows["kind"] == "open"], len(cuts) + 1, []
    while True:
        final = parts <= prefix_trie.FAN
        made = pd.concat([prefix_trie.stitch(g, final) for _, g in open_.groupby(open_["part"].astype(int) // (parts if final else prefix_trie.FAN))])
        closed.append(made[made["kind"] == "closed"])
        if final:
            break
        open_, parts = made[made["kind"] == "open"], -(-parts // prefix_trie.FAN)
    border = pd.concat(closed)
    conv = dict(zip(border["key"], border["conv_id"], strict=True))
    assert len(conv) == len(border)
    pieces = rows[rows["kind"] == "piece"].sort_values(["key", "part", "seq"])
    sha = {k: hashlib.sha256(",".join(g["ends"]).encode()).hexdigest() for k, g in pieces.groupby("key")}
    out = []
    for r in pd.concat([rows[rows["kind"].isin(["node", "child"])], border]).itertuples():
        parent = r.parent_conv_id if r.kind == "node" else None if r.parent_key is None else conv[r.parent_key]
        out.append((r.conv_id, r.depth, parent, r.n_convs, r.n_children, r.n_leaves, r.saved, sha[r.key] if r.ends == prefix_trie.PIECES else r.ends))
    assert sorted(out, key=repr) == tries(paths)


# ------------------------------------------------------------------ posting lists
def brute(rows, k, every):
    """(query, rank, id, distance) of rows (id, vector) that take part."""
    ok = [(n, i, np.array(v, dtype=float)) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, i, v in ok:
        if i % every == 0:
            found = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for m, j, w in ok if m != n and len(w) == len(v))[:k]
            out += [(i, r, j, round(d, 12)) for r, (d, j) in enumerate(found, 1)]
    return sorted(out)


def test_neighbours_by_brute_force(spark):
    rng = random.Random(4)
    vec = lambda n=6: [rng.uniform(-1, 1) for _ in range(n)]
    hot = vec()
    rows = [(i, hot if i % 3 == 0 else vec()) for i in range(420)]  # a third of all rows are one vector
    rows += [(100, vec()), (200, rows[200][1]), (300, hot), (None, vec()), (500, None), (600, []), (700, [0.0] * 6), (800, [1.0, None, 0.0, 0.0, 0.0, 1.0])]
    rows += [(900, [math.nan] * 6), (1000, [math.inf] * 6), (1100, vec(3)), (1101, vec(3)), (1200, vec(2)), (1300, [1e200, -1e200, 1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("x", "h", "rn", "cell", "list", "part", "score", "first")})
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in ann.nearest(df).collect())
    assert got == brute(rows, 10, 100)
    assert ann.nearest(df.limit(0)).collect() == []
    assert ann.nearest(df.where("vec_id = 100").limit(1)).collect() == []


def test_lists_are_balanced_and_the_graph_reaches_all():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (700, 8)) for c in rng.normal(0, 5, (5, 8))])
    lists = ann.fit(x, 40, 10)
    assert len(lists.centroids) >= 3500 / 40 and lists.members.max() < 40 * ann.REPLICAS
    for v in x[::70]:
        found, d = lists.near(v, 4, 1.0)
        true = np.sqrt(((lists.centroids - v) ** 2).sum(1))
        assert set(found[:4].tolist()) & set(np.argsort(true)[:4].tolist()) and np.allclose(d, true[found])
    every, _ = lists.near(x[0], len(lists.centroids), 1.0)
    assert len(every) == len(lists.centroids)


def test_recall_in_several_cells(spark, monkeypatch):
    for name, value in (("CELL_ROWS", 400), ("CELL_QUERIES", 7), ("LIST_ROWS", 64), ("SAMPLE", 1500)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.4, (600, 12)) for c in rng.normal(0, 1, (5, 12))]).tolist()
    rows = list(enumerate(x))
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = brute(rows, 10, 100)
    have = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    assert len(got) == len(want) and sum((q, i) in have for q, _, i, _ in want) >= 0.9 * len(want)
    assert all(abs(s - np.linalg.norm(np.array(x[q]) - np.array(x[i]))) < 1e-12 for (q, i), s in have.items())


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the driver's tables")
def test_recall_of_the_query(spark):
    table = pd.read_parquet(FOLDER / "embeddings.parquet")
    want = brute([(i, v.tolist()) for i, v in zip(table["vec_id"].tolist(), table["embedding"], strict=True)], 10, 100)
    got = {(r["query_id"], r["vec_id"]) for r in queries.op13_posting_lists(spark, str(FOLDER)).collect()}
    assert len(got) == len(want) and sum((q, i) in got for q, _, i, _ in want) >= 0.9 * len(want)


def test_scores_of_tiny_components(spark):
    from ledgerlark.llm import topk

    rows = [(0, [-1e-20, 1.0]), (50, [1.0, 1.0]), (7, [-1.0, 1.0]), (8, [1e300, 0.0]), (9, [-0.5 / 256, 2.0**-9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r)[0]: r["x"] for r in df.select("vec_id", topk.scaled(F.col("embedding"), 256).alias("x")).collect()}
    assert got == {i: [float(math.floor(256 * x)) for x in v] for i, v in rows} and got[0][0] == -1.0
    best = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df.where("vec_id IN (0, 50, 7)"), k=5).where("query_id = 50").orderBy("rank").collect()]
    assert best == [(1, 0, 65280), (2, 7, 0)]


def test_an_id_that_repeats_with_another_text_is_kept(spark):
    from ledgerlark.llm import exact_dedup

    rows = [(1, "a"), (1, "b"), (2, "a"), (3, None), (4, ""), (5, "c"), (5, "c")]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({"digest": F.lit("x"), "__digest": F.lit("y")})
    kept = exact_dedup.drop_exact_copies(docs)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, "b"), (2, "a"), (4, ""), (5, "c")] and kept.columns == docs.columns


def test_near_copies_of_an_id_that_repeats_with_another_text(spark):
    from ledgerlark.llm import jaccard_join

    words = [f"w{i}" for i in range(60)]
    near, other = " ".join(words[:-1]), " ".join(f"x{i}" for i in range(40))
    rows = [(1, " ".join(words)), (2, near), (2, other), (3, other + " y"), (4, None), (4, ""), (None, near)]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({"__digest": F.lit("y"), "__doc": F.lit(2)})
    kept = jaccard_join.drop_near_copies(docs)
    texts = sorted((str(r["doc_id"]), r["text"]) for r in kept.where("text <> ''").collect())
    assert kept.columns == docs.columns and kept.where("doc_id = 4").count() == 2
    for text in (" ".join(words), other):  # every text, or a near copy of it, is still there
        assert any(text in t or t in text for _, t in texts)
    assert ("1", " ".join(words)) in texts and ("None", near) in texts and len([t for t in texts if t[0] == "2"]) <= 2
