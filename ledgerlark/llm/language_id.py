"""Language identification by hierarchical discrimination.

Method. A text is lower-cased, everything in ASCII that is no letter becomes a space, and the trigrams of its UTF-8 bytes are
hashed into DIM counts, taken as shares of the text. One-versus-one linear support vector machines (hinge loss, dual
coordinate descent) first tell language families apart; within the family chosen, others tell its languages apart. Votes
decide, the sum of margins breaks ties. A language without a known family is a family of its own. More than GROUP classes at
one level are first told apart as GROUP groups, neighbours along the main direction of their mean shares, so the number of
classifiers grows with the number of languages and not with its square.

Fitting. At most PER_LANGUAGE labelled documents of each language are used, and FIT_DOCS in all (but one of each language at
least), those with the smallest hash of doc_id, so the sample is the same at every run and its size is bounded; prediction
reads every whole text.

Scale. Prediction is one pass over the texts without a shuffle; the model is DIM numbers a classifier. The sample is chosen in
one pass and goes to the driver as sparse rows.

Defined cases. Null text and text without any letter is ``und`` with score 0, and so is everything if there is no label to
learn from; :func:`drop_unidentified` keeps texts with letters then. Very long texts are read in segments. Rows that repeat are predicted one by one; an empty table gives an empty
result; extra columns are ignored by :func:`predict` and kept by :func:`drop_unidentified`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIM_BITS = 13
DIM = 1 << DIM_BITS
PER_LANGUAGE = 600
FIT_DOCS = 20_000
GROUP = 12
SEGMENT = 1 << 21

# Families of closely related languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": ("da", "de", "en", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sr", "uk"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

BLANK = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def framed(text: str) -> bytes:
    return b"  " + text.lower().encode("utf-8", "replace").translate(BLANK) + b"  "


def trigrams(data: np.ndarray) -> np.ndarray:
    """Hashed trigram numbers of framed bytes."""
    x = data.astype(np.uint32)
    x = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    x *= np.uint32(2654435761)
    return x >> np.uint32(32 - DIM_BITS)


def shares(text: str) -> np.ndarray:
    """Trigram shares of a text."""
    data = np.frombuffer(framed(text), dtype=np.uint8)
    counts = np.zeros(DIM)
    for at in range(0, len(data) - 2, SEGMENT):
        counts += np.bincount(trigrams(data[at : at + SEGMENT + 2]), minlength=DIM)
    return counts / counts.sum()


def batch_margins(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """(texts, classifiers) of mean weight a trigram, many texts at once. Trigrams across two texts are taken off."""
    out = np.zeros((len(texts), len(weights)))
    held: list[int] = []
    parts: list[bytes] = []
    size = 0

    def flush() -> None:
        if not held:
            return
        lengths = np.array([len(p) for p in parts])
        grams = trigrams(np.frombuffer(b"".join(parts) + b"  ", dtype=np.uint8))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        seam = int(trigrams(np.frombuffer(b"   ", dtype=np.uint8))[0])
        for c, w in enumerate(weights):
            out[held, c] = (np.add.reduceat(w[grams], starts, dtype=np.float64) - 2 * float(w[seam])) / (lengths - 2)

    for i, text in enumerate(texts):
        if len(text) > SEGMENT // 4:
            x = shares(text)
            out[i] = weights @ x
            continue
        parts.append(framed(text))
        held.append(i)
        size += len(parts[-1])
        if size > SEGMENT:
            flush()
            held, parts, size = [], [], 0
    flush()
    return out


Row = tuple[np.ndarray, np.ndarray]


def fit_svm(rows: list[Row], y: np.ndarray, cost: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear SVM with hinge loss by dual coordinate descent on sparse rows (places, values); y is -1 or 1. Weights and bias
    (the weight of a constant 1)."""
    w, bias, alpha = np.zeros(DIM), 0.0, [0.0] * len(rows)
    norm = [float(v @ v) + 1 for _, v in rows]
    sign = y.tolist()
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            at, v = rows[i]
            own = w[at]
            new = min(max(alpha[i] - (sign[i] * (float(own @ v) + bias) - 1) / norm[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[at] = own + step * v
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w.astype(np.float32), float(bias)


class Model:
    """Classifiers of the levels of a tree; a level is a tuple, the root (), and its classes are levels or languages (strings)."""

    def __init__(self, classes: dict[tuple, list], pairs: list[tuple], weights: np.ndarray, bias: np.ndarray):
        """pairs: of each classifier its level and two of the level's classes."""
        self.classes, self.pairs, self.weights, self.bias = classes, pairs, weights, bias

    def vote(self, level: tuple, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row: the class number that wins at a level, and how sure (0 to 1)."""
        names = self.classes[level]
        votes, sums, least = (np.zeros((len(margins), len(names))) for _ in range(3))
        least += 1.0
        for k, (lv, a, b) in enumerate(self.pairs):
            if lv == level:
                i, j = names.index(a), names.index(b)
                m = margins[:, k]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                sums[:, i] += m
                sums[:, j] -= m
                p = 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
                least[:, i] = np.minimum(least[:, i], p)
                least[:, j] = np.minimum(least[:, j], 1 - p)
        best = (votes + np.tanh(sums / 1e3) / 4).argmax(axis=1)
        return best, least[np.arange(len(best)), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        at = np.array([i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))], dtype=np.int64)
        if not len(at) or not self.classes:
            return lang, score
        margins = batch_margins([texts[i] for i in at], self.weights) + self.bias
        score[at] = 1.0
        todo: list[tuple[tuple, np.ndarray]] = [((), np.arange(len(at)))]
        while todo:
            level, rows = todo.pop()
            best, sure = self.vote(level, margins[rows])
            score[at[rows]] *= sure
            for c, name in enumerate(self.classes[level]):
                mine = rows[best == c]
                if len(mine) and isinstance(name, tuple):
                    todo.append((name, mine))
                for k in mine if isinstance(name, str) else ():
                    lang[at[k]] = name
        return lang, score


def grouped(level: tuple, names: list, means: dict, classes: dict[tuple, list]) -> None:
    """Enter ``names`` as the classes of ``level``, in groups of neighbours if they are many."""
    if len(names) <= GROUP:
        classes[level] = names
        return
    x = np.array([means[n] for n in names])
    x -= x.mean(axis=0)
    along = x @ np.linalg.svd(x, full_matrices=False)[2][0]
    parts = np.array_split(np.argsort(along, kind="stable"), GROUP)
    classes[level] = [(*level, f"group {k}") for k in range(GROUP)]
    for own, part in zip(classes[level], parts, strict=True):
        grouped(own, [names[i] for i in part], means, classes)


def fit(rows: list[tuple[str, Row]]) -> Model:
    """A model from (lang, trigram shares as places and values)."""
    by: dict[str, list[Row]] = {}
    for lang, row in rows:
        by.setdefault(lang, []).append(row)
    if not by:
        return Model({}, [], np.zeros((0, DIM), np.float32), np.zeros(0))
    scale = 1 / np.sqrt(np.mean([float(v.astype(float) @ v) for _, (_, v) in rows]))
    by = {lang: [(at, v.astype(np.float64) * scale) for at, v in own] for lang, own in sorted(by.items())}
    families: dict[tuple, list[str]] = {}
    for lang in by:
        families.setdefault(("family", FAMILY_OF.get(lang, f"={lang}")), []).append(lang)

    def mean(langs: list[str]) -> np.ndarray:
        out = np.zeros(DIM)
        for lang in langs:
            for at, v in by[lang]:
                out[at] += v
        return out / sum(len(by[lang]) for lang in langs)

    classes: dict[tuple, list] = {}
    grouped((), sorted(families), {f: mean(langs) for f, langs in families.items()} if len(families) > GROUP else {}, classes)
    for f, langs in families.items():
        grouped(f, langs, {lang: mean([lang]) for lang in langs} if len(langs) > GROUP else {}, classes)

    def rows_of(name) -> list[Row]:
        return by[name] if isinstance(name, str) else [x for part in classes[name] for x in rows_of(part)]

    pairs, weights, bias = [], [], []
    for level, names in classes.items():
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                xa, xb = rows_of(a), rows_of(b)
                w, c = fit_svm(xa + xb, np.repeat([1.0, -1.0], [len(xa), len(xb)]), cost=10.0)
                pairs.append((level, a, b))
                weights.append(w * np.float32(scale))
                bias.append(c)
    return Model(classes, pairs, np.array(weights, np.float32).reshape(-1, DIM), np.array(bias))


def learn(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE, fit_docs: int = FIT_DOCS) -> Model:
    """A model from the labelled rows of ``docs`` (doc_id, text, lang) that are ``usable``; the sample is described above."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    taken = rows.select("lang", "doc_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).orderBy("n", "lang")
    found = taken.limit(fit_docs).collect()  # the first of each language come first
    if len(found) == fit_docs:
        found = taken.where(F.col("n") <= max(1, max(r["n"] for r in found) - 1)).collect()
    if not found:
        return fit([])
    ids = docs.sparkSession.createDataFrame(sorted({(r["doc_id"], r["lang"]) for r in found}), "doc_id long, lang string")
    sample = rows.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [shares(t) for t in pdf["text"]]
            at = [np.flatnonzero(x) for x in found]
            yield pd.DataFrame({
                "lang": pdf["lang"], "doc_id": pdf["doc_id"], "at": [a.astype(np.uint16).tobytes() for a in at],
                "share": [x[a].astype(np.float32).tobytes() for x, a in zip(found, at, strict=True)],
            })

    got = sample.mapInPandas(features, "lang string, doc_id long, at binary, share binary").toPandas()
    got = got.sort_values(["lang", "doc_id", "share"], kind="stable")
    return fit([(lang, (np.frombuffer(at, np.uint16), np.frombuffer(share, np.float32))) for lang, at, share in zip(got["lang"], got["at"], got["share"], strict=True)])


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``docs`` with lang_pred and score; one pass over the whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lang, score = sent.value.predict([None if t is None else t for t in pdf["__text"]])
            yield pdf.drop(columns="__text").assign(lang_pred=lang, score=score)

    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    return rows.mapInPandas(run, f"{fields}, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, usable: Column | None = None, least: float = 0.0) -> DataFrame:
    """``docs`` without those whose language can't be told: ``und``, or a score below ``least``; columns as they were. Without labels to
    learn from, texts with letters stay."""
    model = learn(docs, usable if usable is not None else F.lit(True))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def identified(texts: pd.Series) -> pd.Series:
        if not sent.value.classes:
            return pd.Series([t is not None and any(map(str.isalpha, t)) for t in texts])
        lang, score = sent.value.predict([None if t is None else t for t in texts])
        return pd.Series([x != "und" and s >= least for x, s in zip(lang, score, strict=True)])

    return docs.where(identified(F.col("text").cast("string")))
