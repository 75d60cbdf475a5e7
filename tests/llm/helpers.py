"""Fixtures of documents with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ke", "mi", "to", "su", "ra") for b in ("na", "lo", "vi", "der", "st", "ung")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with exact and near copies, nulls, empty texts, a repeated row, ties and one very long text."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice((3, 30, 90))), rng.choice(("en", "de", None)), rng.choice(("a", "b", "b", None)), 1) for i in range(n)]
    base = rows[5][1] + " " + prose(rng, 80)
    rows += [(100 + k, base, "en", "b", 1) for k in range(6)]
    for k in range(12):
        words = base.split()
        words[7 * k % len(words)] = "changed" + "x" * (k % 3)
        rows.append((200 + k, " ".join(words), "en", "b", 1))
    rows += [(300, None, "en", "a", 0), (301, "", None, "a", 0), (302, " \n\t", "de", None, 3), (303, "one", "de", "a", 3), (304, "Älter größer", "de", "a", 9), (305, "1234 !!", "en", "c", 7)]
    rows += [rows[0], (306, prose(rng, 6000), "en", "c", 1), (307, "ONE", "de", "a", 3)]
    return rows


def frame(spark, rows, extra: bool = False):
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # names that operators use inside
        from pyspark.sql import functions as F

        clash = ["n", "digest", "keep_id", "group_size", "kept", "size", "copies", "sig", "label", "score", "h", "rank", "tokens", "length", "target", "component_id", "__copies"]
        df = df.withColumns({c: F.lit("x") for c in clash})
    return df


def word_list(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingle_set(text: str | None, size: int) -> set[tuple]:
    w = word_list(text)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def jaccard_components(rows, size: int, num: int, den: int) -> dict:
    sets = {r[0]: shingle_set(r[1], size) for r in rows}
    label = {i: i for i in sets}
    changed = True
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def repeated_bytes(rows, length: int) -> list[list[bool]]:
    seen: dict[bytes, int] = {}
    data = [(r[1] or "").encode() for r in rows]
    for b in data:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for b in data:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        out.append(gone)
    return out
