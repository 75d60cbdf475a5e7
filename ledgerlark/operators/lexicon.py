"""A word lexicon learned from texts, splitting of compound words over it, and typo look-up by a deletes index.

Pieces of words and variants of words meet the lexicon in equi-joins, on distinct words only. A lexicon of up to MOST_SENT words is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_SENT = 500_000
#: What a word is: letters a to z and all characters beyond ASCII, in lower case.
WORD = r"[^\x00-\x60\x7B-\x7F]+"


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """word, n: how often each distinct lower-cased word occurs; counted before anything is shuffled."""
    return texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def split_compounds(words: DataFrame, lexicon: DataFrame, shortest: int, longest: int) -> DataFrame:
    """word, pieces: the words that lexicon words of ``shortest`` to ``longest`` characters make up, split into as few as can be (two at least).

    Of several such splits the first in alphabetical order of its pieces counts. Both frames have a column ``word``, distinct. All
    substrings meet the lexicon in one join; what is found of a word are the edges of its word-break graph, in which the best path
    to each place follows from the best paths to the places before.
    """
    sized = words.select("word").where(F.length("word") >= 2 * shortest)
    starts = F.explode(F.sequence(F.lit(0), F.length("word") - shortest))
    size = F.explode(F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length("word") - F.col("at"))))
    parts = sized.withColumn("at", starts).withColumn("size", size).select("word", "at", F.col("word").substr(F.col("at") + 1, F.col("size")).alias("piece"))
    known = lexicon.select(F.col("word").alias("piece"))
    known = F.broadcast(known) if lexicon.limit(MOST_SENT + 1).count() <= MOST_SENT else known
    edges = parts.join(known, "piece").where(F.col("piece") != F.col("word"))
    found = edges.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("edges"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for word, own in zip(pdf["word"], pdf["edges"], strict=True):
                paths: dict[int, tuple[int, list[str]]] = {0: (0, [])}
                for e in own:  # by place, so paths to it are final
                    if e["at"] in paths:
                        n, pieces = paths[e["at"]]
                        step, end = (n + 1, [*pieces, e["piece"]]), e["at"] + len(e["piece"])
                        paths[end] = min(paths.get(end, step), step)
                if len(word) in paths:
                    out.append((word, paths[len(word)][1]))
            yield pd.DataFrame(out, columns=["word", "pieces"])

    return found.mapInPandas(best, "word string, pieces array<string>")


def deletes(word: Column) -> Column:
    """The word and the word without any one of its characters."""
    without = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), without))


def correct(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, correction, n: of the lexicon words (word, n) one edit or one swap of neighbours away, the most frequent, then the first by spelling.

    Two such words share a string that each gives with at most one character removed, so they meet in an equi-join of these; what meets is checked.
    Words (distinct, not empty) that are in the lexicon or have no neighbour there are missing.
    """
    outside = words.select("word").where(F.col("word") != "").join(lexicon.select("word"), "word", "left_anti")
    keyed = lexicon.where(F.col("word") != "").select(F.col("word").alias("correction"), "n", F.explode(deletes(F.col("word"))).alias("k"))
    met = outside.select("word", F.explode(deletes(F.col("word"))).alias("k")).join(keyed, "k").select("word", "correction", "n").distinct()
    w, c = F.col("word"), F.col("correction")
    at = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(w, i, F.lit(1)) != F.substring(c, i, F.lit(1)))
    first = F.get(at, F.lit(0))
    swapped = F.concat(F.substring(w, F.lit(1), first - 1), F.substring(w, first + 1, F.lit(1)), F.substring(w, first, F.lit(1)), F.substring(w, first + 2, F.length("word")))
    near = met.where((F.levenshtein("word", "correction", 1) >= 0) | ((F.length("word") == F.length("correction")) & (swapped == c)))
    order = Window.partitionBy("word").orderBy(F.desc("n"), "correction")
    return near.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")
