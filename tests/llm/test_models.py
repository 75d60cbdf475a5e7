import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import language_id, mixing, packing, queries, topk, toxicity, url_filter
from tests.llm.helpers import DOCS, corpus, frame, prose, word_list

SYLLABLES = {"en": ["th", "ing", "was", "he"], "de": ["sch", "ung", "der", "ei"], "es": ["ción", "ado", "los", "que"], "fr": ["eau", "elle", "ou", "tre"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_mix_hits_targets_and_caps(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, rng.randrange(0, 60)), None, rng.choice("aabbbbbbc"), 1) for k in range(600)] + [(601, None, None, None, 0), (602, "one two", None, None, 0)]
    df = frame(spark, rows, True)
    out = mixing.mix_sources(df).collect()
    assert len(out) == len(rows)
    size = {r[0]: len(word_list(r[1])) for r in rows}
    source = {r[0]: r[3] for r in rows}
    totals = Counter()
    for i, n in size.items():
        totals[source[i]] += n
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.share_out([totals[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
    taken = Counter()
    for r in out:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == totals[s] and r["target"] == float(want[s]) and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 3 for s in names)
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mix_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rng = random.Random(3)
    rows = [(k, prose(rng, 5 + k % 9), None, "ab"[k % 7 == 0], 1) for k in range(700)]
    out = mixing.mix_sources(frame(spark, rows)).groupBy("target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r["t"] - r["target"]) <= 15 for r in out)


def test_share_out_and_flight():
    assert mixing.share_out([10, 100], [5, 2]) == [30, 80] and mixing.share_out([], []) == [] and mixing.share_out([0, 0], [5, 2]) == [0, 0]
    assert sum(mixing.share_out([3, 50, 20, 9], [5, 2, 1, 5])) == 82 and mixing.share_out([7], [5]) == [Fraction(7)]
    rng = np.random.default_rng(1)
    size, pi = rng.integers(0, 50, 300), rng.random(300)
    out = mixing.fly(size, pi, rng.random(700))
    assert ((out > 0) & (out < 1)).sum() <= 2 and abs((size * (out - pi)).sum()) < 1e-6 and abs((out - pi).sum()) < 1e-6
    draws = np.mean([mixing.fly(size[:6], pi[:6], np.random.default_rng(s).random(20)) for s in range(4000)], axis=0)
    assert np.abs(draws - pi[:6]).max() < 0.04


def test_apply_mix_repeats_rows(spark):
    df = frame(spark, [r for r in corpus() if r[0] != 0], True)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(df).collect()}
    out = mixing.apply_mix(df)
    assert out.columns == df.columns and Counter(r["doc_id"] for r in out.collect()) == Counter({i: c for i, c in copies.items() if c})
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix_sources(empty).count() == 0 and mixing.apply_mix(empty).count() == 0


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus()
    out = packing.pack(frame(spark, rows, True), queries.make_encoder, 256).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= 256
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 256
    texts = {r[0]: r[1] for r in rows}
    for i, parts in pieces.items():
        ids = [*whole.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        copies = sum(r[0] == i for r in rows)
        parts = sorted(parts, key=lambda r: r["piece"])[::copies]
        assert np.concatenate([np.frombuffer(p["ids"], "<u4") for p in parts]).tolist() == ids
        assert [p["start"] for p in parts] == np.cumsum([0, *(p["length"] for p in parts)])[:-1].tolist() and all(p["length"] == 256 for p in parts[1:])
    total = sum(r["length"] for r in out)
    assert len(bins) <= max(-(-total // 256), sum(r["length"] > 128 for r in out)) + 2
    assert packing.pack(spark.createDataFrame([], DOCS), queries.make_encoder).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a  b", " a", "a ", "a\n b", "a \nb", "a\n \nb", "don't stop, 12 345.", "é<|endoftext|>z", "x\u00a0y \u00a0z", "日本 語", "a\tb \t c"])
def test_encoder_is_exact(text):
    e = queries.make_encoder()
    assert e(text) == e.exact(text)


def test_bin_completion_beats_best_fit_and_keeps_all():
    rng = random.Random(5)
    for n, cap in ((8, 20), (40, 100), (300, 1000)):
        for _ in range(6):
            counts = Counter(rng.randrange(1, cap + 1) for _ in range(n))
            solution = packing.complete_bins(counts, cap)
            back = Counter()
            for pattern, times in solution:
                assert sum(pattern) <= cap
                for s in pattern:
                    back[s] += times
            assert back == counts and sum(k for _, k in solution) <= sum(k for _, k in packing.best_fit(counts, cap))
    assert sum(k for _, k in packing.complete_bins(Counter({6: 3, 4: 2, 5: 2, 3: 2}), 12)) == 4
    assert packing.complete_bins({}, 10) == []


def brute_top(vectors, k):
    out = {}
    sound = {i: [np.floor(256 * np.float64(x)) for x in v] for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v)}
    for q, v in sound.items():
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in sound.items() if i != q and len(w) == len(v))
            out[q] = [(i, int(-s)) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("rows_a_shard", [40, 10_000])
def test_top_k_matches_brute_force(spark, rows_a_shard, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", rows_a_shard)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=6).astype(np.float32).tolist() for i in range(300)}
    vectors |= {300 + i: vectors[7] for i in range(20)} | {400: None, 401: [], 402: [1.0, None, 0.0, 0.0, 0.0, 0.0], 450: [float("nan")] * 6, 403: [float("inf")] + [0.0] * 5, 404: [1.0, 2.0], 500: [3.0, 4.0], 550: [1e30] * 6}
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in vectors.items()] + [(7, vectors[7], "x", "y")], "vec_id long, embedding array<float>, score string, rank string")
    got = defaultdict(list)
    for r in topk.top_k(df).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_top({i: v for i, v in vectors.items() if i != 550}, 5)
    assert {q: v for q, v in got.items() if q != 550 and 550 not in dict(v)} == {q: v for q, v in want.items() if 550 not in dict(got[q])}
    assert topk.top_k(df.limit(0)).count() == 0


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(k, speech(rng, lang, rng.randrange(5, 60)), lang, "s", 1) for k, lang in enumerate(list(SYLLABLES) * 40)]
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "12 3!", "de", "s", 0), (903, speech(rng, "fr", 9000), None, None, 0), rows[0]]
    df = frame(spark, rows, True)
    usable = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    model = language_id.learn(df, usable)
    out = {r["doc_id"]: r for r in language_id.predict(df, model, ["doc_id"]).collect()}
    held = [r for r in rows[:160] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(out[r[0]]["lang_pred"] == r[2] for r in held) >= 0.97 * len(held) > 20
    assert [out[k]["lang_pred"] for k in (900, 901, 902, 903)] == ["und", "und", "und", "fr"] and all(0 <= r["score"] <= 1 for r in out.values())
    kept = language_id.drop_unidentified(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {r[0] for r in rows} - {900, 901, 902}
    none = language_id.learn(df.where("lang IS NULL"), F.lit(True))
    assert language_id.predict(df, none, ["doc_id"]).where("lang_pred <> 'und' OR score <> 0").count() == 0
    assert language_id.predict(df.limit(0), model, ["doc_id"]).count() == 0 and language_id.drop_unidentified(df.limit(0)).count() == 0


def test_batched_margins_equal_single_ones():
    w = np.random.default_rng(1).normal(size=(3, language_id.DIM)).astype(np.float32)
    texts = ["a", "Hello World", "x" * (language_id.SEGMENT // 3), "über 12"]
    single = np.array([w @ language_id.shares(t) for t in texts])
    assert np.allclose(language_id.batch_margins(texts, w), single, atol=1e-4)


def test_three_hundred_languages():
    rng, rows = np.random.default_rng(3), []
    texts = {f"x{k:03d}": " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)) for k in range(300)}
    for lang, text in texts.items():
        x = language_id.shares(text)
        at = np.flatnonzero(x)
        rows += [(lang, (at.astype(np.uint16), x[at].astype(np.float32)))] * 2
    model = language_id.fit(rows)
    got, score = model.predict([*texts.values(), None, "123"])
    assert got == [*texts, "und", "und"] and (score[:300] > 0).all() and score[300:].sum() == 0
    assert len(model.pairs) < 3000


def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["moronic", "scumbag", "vileness"]
    rows, labels = [], []
    for k in range(400):
        words = prose(rng, 60).split()
        toxic = k % 4 == 0
        if toxic:
            for at in range(0, 60, 9):
                words[at] = rng.choice(bad)
            if k % 8 == 0:
                words[0], words[9], words[18] = "m0r0nic", "sсumbag", "V1LENESS"
        elif k % 5 == 0:
            words[3:5] = ["anti", "moronic"]
        rows.append((k, " ".join(words), "en", "s", 1))
        labels.append((k, 1, int(toxic)))
    rows += [(900, None, None, None, 0), (901, "", None, None, 0), (902, "moronic scumbag vileness", None, None, 0), (903, "m0r0n1c $cumbag vilene55", None, None, 0), (904, prose(rng, 9000), None, None, 0), rows[1]]
    labels += [(900, 0, 0), (1, 1, 0), (2, None, None)]
    df, marks = frame(spark, rows, True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(df, marks, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    assert {"=moronic", "=scumbag"} & set(lexicon.weights) or {"moronic*", "scumbag*"} & set(lexicon.weights)
    out = {r["doc_id"]: r for r in toxicity.score(df, lexicon, ["doc_id"]).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(out[k]["predicted"] == (k % 4 == 0) for k in held) >= 0.97 * len(held) > 40
    assert out[902]["predicted"] == out[903]["predicted"] == 1 and out[900]["predicted"] == out[901]["predicted"] == out[904]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in out.values())
    empty = toxicity.learn(df, marks.limit(0), F.lit(True))
    assert toxicity.score(df, empty, ["doc_id"]).where("predicted = 1").count() == 0 and toxicity.score(df.limit(0), lexicon, ["doc_id"]).count() == 0


def test_exception_phrases_cancel_hits():
    lexicon = toxicity.Lexicon({"=scum": 3.0, "trol*": 2.0}, {"pond scum"}, np.zeros(4))
    assert lexicon.total("pond scum here") == 0 and lexicon.total("scum, trolling scums") == 5 and lexicon.total("control") == 0


def brute_rule(url, block, allow):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut : min([k for k in (rest.find(c, cut) for c in "?#") if k >= 0] or [len(rest)])]
    found = [(len(h + p), h + p, v) for rules, v in ((block, "block"), (allow, "allow")) for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(found, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("shard_keys", [3, 1_000_000])
def test_url_rules_match_brute_force(spark, shard_keys, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(url_filter, "FILTER_MB", 0 if shard_keys == 3 else 64)
    hosts = ["a.net", "NET", "x.Example.net", "example.com", "b.example.com", "fr.org", "xnet", "a.org", "", "net.", "ex.net:80"]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/de/a?b", "/fr/#x", "/fr/a/b://c", "?q=/en/", "#/de/"]
    urls = [f"{s}://{h}{p}" for s in ("http", "") for h in hosts for p in paths] + [None, "", "example.net/en/", "mailto:x", "http://a.net/\n/x"]
    pages = spark.createDataFrame([(k, u, "k", "v") for k, u in enumerate([*urls, urls[0]])], "page_id long, url string, rule string, key string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, queries.BLOCKED, queries.ALLOWED).collect()}
    assert out == {k: brute_rule(u, queries.BLOCKED, queries.ALLOWED) for k, u in enumerate([*urls, urls[0]])}
    assert url_filter.filter_urls(pages.limit(0), queries.BLOCKED, queries.ALLOWED).count() == 0


def test_cascade_is_exact():
    keys = [f"host{k}.net/" for k in range(20_000)]
    levels = url_filter.build_cascade(set(keys[::97]), set(keys) - set(keys[::97]))
    assert len(levels) > 1 and [k for k in keys if url_filter.is_listed(k, levels)] == keys[::97]
    assert url_filter.build_cascade(set(), set(keys)) == [] and not url_filter.is_listed("x", [])


def test_top_k_of_large_components_and_repeated_rows(spark):
    rows = [(50, [1e7, 0.0]), (1, [1e7, 1.0]), (2, [1e6, 0.0]), (2, [1e6, 0.0]), (50, [0.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    first = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 50 and r["score"] > 10**9)
    assert first == [(1, 1, 2560000000 * 2560000000), (2, 2, 2560000000 * 256000000), (3, 2, 2560000000 * 256000000)]
    assert len(got) == 8  # each of the two rows with id 50 meets the four others


def test_mix_meets_targets_beside_a_giant(spark):
    rng = np.random.default_rng(4)
    sizes = [(20000, "a")] + [(int(n), s) for s in "ab" for n in rng.integers(20, 600, 300)]
    df = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate(sizes)], "doc_id long, text string, source string")
    for seed in (1, 2, 3):
        out = mixing.mix_sources(df, seed=seed).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
        assert all(abs(r["t"] - r["g"]) <= 300 for r in out)


def test_exception_with_a_long_word_before():
    lexicon = toxicity.Lexicon({"=bad": 1.0}, {"x" * 60 + " bad"}, np.zeros(toxicity.N_MEASURES + 1))
    assert lexicon.total("x" * 60 + " bad") == 0 and lexicon.total("bad") == 1.0
