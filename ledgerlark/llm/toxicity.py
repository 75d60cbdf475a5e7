"""Toxicity from a weighted lexicon matched by Aho-Corasick, after folding, normalised by length, with exception phrases.

Method. Texts are folded: compatibility forms and case, zero-width characters dropped, letters of other scripts that look like
Latin ones replaced by these, digits and signs that stand for letters too. The lexicon is learned from labelled documents:
whole words and word beginnings whose share of the words of toxic documents is far above that in clean ones; its weight is
the logarithm of that ratio. Phrases (the word before and an entry's word) that several clean documents have and no toxic one
are exceptions: a hit inside one doesn't count. An Aho-Corasick automaton finds all of them in one pass; of entries that
start at one word the longest counts. The weights found, over the text's length in words and in total, go through a
logistic curve fitted on the same labelled documents.

Fitting. At most MAX_TOXIC toxic and MAX_CLEAN clean labelled documents are used, those with the smallest hash of doc_id;
equal texts count once. Entries and exceptions are all that LEAST_DOCS (EXCEPTION_DOCS) documents of this sample have. Scoring reads every whole text.

Scale. Scoring is one pass over the texts without a shuffle; the lexicon is bounded by the sample.

Defined cases. Null and empty text scores as a text without hits. Without labels of both kinds every score is the share of
toxic labels (0 without labels). Null labels don't count; of several labels of a document the largest holds. Rows that repeat
are scored one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOXIC, MAX_CLEAN = 2500, 6000
LEAST_DOCS = 5
LEAST_RATIO = 1.5
PREFIXES = range(4, 9)
EXCEPTION_DOCS = 5

# Characters that look like a Latin letter, the letter after them.
LOOKALIKES = "аaвbсcеeнhіiјjкkмmоoрpѕsтtуyхxαaβbεeιiκkνvοoρpτtυuχxωwıiɑaɡgℓl"
# Digits and signs written for a letter.
DIGITS = "0o1i3e4a5s7t@a$s!i"
# Characters without width.
NO_WIDTH = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

FOLD = str.maketrans(LOOKALIKES[::2] + DIGITS[::2], LOOKALIKES[1::2] + DIGITS[1::2], NO_WIDTH)
WORDS = re.compile(r"[^\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")


def fold(text: str) -> str:
    text = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()
    return text.translate(FOLD)


def entries_of(word: str) -> Iterator[str]:
    """What a word can be listed as: itself (=word), and its beginnings (word*)."""
    yield "=" + word
    for n in PREFIXES:
        if len(word) >= n:
            yield word[:n] + "*"


def word_before(text: str, start: int) -> str:
    """The last whole word before ``start``; empty if there is none."""
    end = start
    while end and not LETTER.match(text, end - 1):
        end -= 1
    begin = end
    while begin and LETTER.match(text, begin - 1):
        begin -= 1
    return text[begin:end]


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: set[str], curve: np.ndarray):
        """weights: by entry, as entries_of() names them. exceptions: phrases of two words. curve: of the logistic."""
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self.automaton = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "automaton": None}

    def _build(self):
        self.automaton = ahocorasick.Automaton()
        listed: dict[str, list[str]] = {}
        for e in self.weights:
            listed.setdefault(e.strip("=*"), []).append(e)
        for stem, own in listed.items():
            self.automaton.add_word(stem, (len(stem), own))
        self.automaton.make_automaton()

    def total(self, text: str) -> float:
        """Sum of the weights that a folded text hits."""
        if self.automaton is None:
            self._build()
        if not self.weights:
            return 0.0
        best: dict[int, tuple[int, float]] = {}
        for end, (size, own) in self.automaton.iter(text):
            start = end - size + 1
            if start and text[start - 1].isalpha():
                continue
            whole = end + 1 == len(text) or not text[end + 1].isalpha()
            for e in own:
                rank = 2 * size + (e[0] == "=")
                if (whole or e[0] != "=") and rank > best.get(start, (0, 0.0))[0]:
                    best[start] = (rank, self.weights[e])
        if self.exceptions:
            for start in list(best):
                word = WORDS.match(text, start).group()
                if f"{word_before(text, start)} {word}" in self.exceptions:
                    del best[start]
        return sum(w for _, w in best.values())

    def score(self, texts: list[str | None]) -> np.ndarray:
        found = [measures(self.total(f), f) for f in (fold(t or "") for t in texts)]
        z = np.array(found).reshape(-1, N_MEASURES) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


N_MEASURES = 3


def measures(total: float, text: str) -> tuple[float, float, float]:
    """What the logistic sees: weight found, and weight by length in words."""
    words = text.count(" ") + text.count("\n") + 1
    return math.log1p(total), 10 * total / (words + 20), total / math.sqrt(words + 20)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton's method; the last number is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * len(x) * np.append(w[:-1], 0)
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * len(x) * np.diag([*[1.0] * (len(w) - 1), 1e-6])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def choose(stats: dict[str, tuple[int, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights of the entries kept. stats: of an entry, toxic documents that have it, times in toxic, times in clean ones."""
    ratio = {e: math.log((t + 0.5) / n_toxic) - math.log((c + 0.5) / n_clean) for e, (_, t, c) in stats.items()}
    good = [e for e, (d, _, _) in stats.items() if d >= LEAST_DOCS and ratio[e] >= LEAST_RATIO]
    good.sort(key=lambda e: (-stats[e][0] * ratio[e], -len(e), e))
    kept: dict[str, float] = {}
    same: set[tuple] = set()
    for e in good:
        stem, key = e.strip("=*"), (e.strip("=*")[:4], *stats[e])
        over = [kept[p] for p in (stem[:n] + "*" for n in range(PREFIXES[0], len(stem) + (e[0] == "="))) if p in kept]
        if key in same or (over and abs(over[-1] - ratio[e]) < 0.7):
            continue
        same.add(key)
        kept[e] = ratio[e]
    return kept


def learn(docs: DataFrame, labels: DataFrame, usable: Column) -> Lexicon:
    """A lexicon from ``labels`` (doc_id, toxic) of the rows of ``docs`` (doc_id, text) that are ``usable``."""
    spark = docs.sparkSession
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    taken: list = []
    for value, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        taken += marks.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    ids = spark.createDataFrame(taken, "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = rows.join(F.broadcast(ids), "doc_id")
    first = sample.select("doc_id", "toxic", F.xxhash64("text").alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    once = spark.createDataFrame(first.select("doc_id", "toxic").collect(), "doc_id long, toxic int")
    sample = rows.join(F.broadcast(once), "doc_id").dropDuplicates(["doc_id"]).cache()  # at most MAX_TOXIC + MAX_CLEAN texts
    try:
        return _learn(sample)
    finally:
        sample.unpersist()


def _counted(sample: DataFrame, wanted: set[str] | None) -> DataFrame:
    sent = sample.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times, docs, words, only = Counter(), Counter(), 0, sent.value
        for pdf in batches:
            for text in pdf["text"]:
                own = Counter(e for w in WORDS.findall(fold(text)) for e in entries_of(w))
                words += sum(n for e, n in own.items() if e[0] == "=")
                if only is not None:
                    own = {e: n for e, n in own.items() if e in only}
                times.update(own)
                docs.update(own.keys())
        yield pd.DataFrame({"entry": [*times, ""], "docs": [*(docs[e] for e in times), 0], "times": [*times.values(), words]})

    return sample.mapInPandas(run, "entry string, docs long, times long").groupBy("entry").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times"))


def _learn(sample: DataFrame) -> Lexicon:
    kinds = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = kinds.get(1, 0), kinds.get(0, 0)
    if not n1 or not n0:
        share = min(max(n1 / max(1, n1 + n0), 1e-6), 1 - 1e-6)
        return Lexicon({}, set(), np.array([0.0] * N_MEASURES + [math.log(share / (1 - share))]))
    toxic = _counted(sample.where("toxic = 1"), None).where(f"entry = '' OR docs >= {LEAST_DOCS}")
    got = {r["entry"]: (r["docs"], r["times"]) for r in toxic.collect()}
    words1 = toxic.where("entry = ''").collect()[0]["times"]
    got.pop("", None)
    clean = {r["entry"]: r["times"] for r in _counted(sample.where("toxic = 0"), set(got)).collect()}
    words0 = clean.pop("", 1)
    lexicon = Lexicon(choose({e: (d, t, clean.get(e, 0)) for e, (d, t) in got.items()}, max(1, words1), max(1, words0)), set(), np.zeros(N_MEASURES + 1))
    lexicon.exceptions = _exceptions(sample, lexicon.weights)
    sent = sample.sparkSession.sparkContext.broadcast(lexicon)

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([measures(sent.value.total(f), f) for f in map(fold, pdf["text"])]).reshape(-1, N_MEASURES)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})

    seen = sample.mapInPandas(totals, "doc_id long, toxic int, a double, b double, c double").toPandas().sort_values("doc_id")
    lexicon.curve = fit_curve(seen[["a", "b", "c"]].to_numpy(), seen["toxic"].to_numpy(float))
    return lexicon


def _exceptions(sample: DataFrame, weights: dict[str, float]) -> set[str]:
    """Phrases with an entry's word that at least EXCEPTION_DOCS clean documents of the sample have, and no toxic one."""
    sent = sample.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                words = WORDS.findall(fold(text))
                found = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if any(e in sent.value for e in entries_of(b))}
                rows += [(p, int(toxic)) for p in found]
            yield pd.DataFrame(rows, columns=["phrase", "toxic"])

    phrases = sample.mapInPandas(run, "phrase string, toxic int").groupBy("phrase")
    counted = phrases.agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("bad"))
    rows = counted.where(f"clean >= {EXCEPTION_DOCS} AND bad = 0").collect()
    return {r["phrase"] for r in rows}


def score(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``docs`` with score and predicted; one pass over the whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = sent.value.score([None if t is None else t for t in pdf["__text"]])
            yield pdf.drop(columns="__text").assign(score=s, predicted=(s >= 0.5).astype("int32"))

    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    return rows.mapInPandas(run, f"{fields}, score double, predicted int")
