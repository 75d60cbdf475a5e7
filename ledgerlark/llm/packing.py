"""Best-fit packing of tokenised documents by bin completion.

Method. A document's token ids end with id 0. Documents longer than a sequence are cut into pieces of the full length, the
rest being their first piece. Pieces are then packed by length only, so the problem that is solved is the histogram of
lengths: at most ``capacity`` numbers, whatever the size of the corpus. Bin completion takes the largest piece left,
enumerates the undominated fillings of the room beside it, takes them in order of waste (best fit first) and searches on
depth first; a branch ends when the waste so far exceeds what a solution better than the incumbent may waste. Best-fit
decreasing gives the first incumbent. A filling is used as often as the counts allow at once, so the depth doesn't grow with
the corpus. NODES and STEPS bound the search for better solutions, never the completeness of the result.

Placement. A piece's rank among the pieces of its length names its place in the solution: ranks come from counters each
task keeps while it tokenises and a running total over (task, length), so no length is gathered in one task.

Scale. Texts are read and tokenised once; ids are written as a table in the shared folder, and only lengths and ranks go to
Python again. What is sent to every task is the
solution by length (some thousand rows at most, one pattern exhausts a length).

Defined cases. Null and empty text is the single id 0. Very long texts are cut, never dropped. Repeated rows are packed
each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

CAPACITY = 2048
#: Nodes of the search, and fillings looked at in all.
NODES, STEPS = 20_000, 400_000
#: Fillings kept and looked at for one node.
WIDTH, LOOK = 6, 1500
#: Words of which a worker keeps the ids; a corpus has millions, most of them seen once.
CACHE_WORDS = 200_000
PIECES = "doc_id long, piece int, start long, length int, ids binary, task int, place long"

Pattern = tuple[int, ...]


class Encoder:
    """Token ids of a text as bytes (little-endian uint32), the same as the tokenizers library's.

    Cutting before a single space between other characters never cuts a pre-token of this kind of pattern, so words with
    their leading space are encoded once and kept. Texts that hold white space next to a space are encoded whole.
    """

    def __init__(self, tokenizer_file: str, tiktoken_file: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.odd = re.compile(r" \s")
        self.fast = None
        self.stops = {w: self.exact(w) for w in ",."}
        if tiktoken_file:
            import base64

            import tiktoken

            with open(tiktoken_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.fast, self.one = encoding.encode_ordinary, encoding._core_bpe.encode_single_piece

    def exact(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, text: str) -> bytes:
        return array("I", self.fast(text)).tobytes() if self.fast else self.exact(text)

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.exact(text)
        if self.odd.search(text):
            return self.word(text)
        first, *rest = text.split(" ")
        known, out = self.words, [self.word(first) if first else b""]
        out += map(known.get, rest)
        if None in out:
            for at, (ids, w) in enumerate(zip(out[1:], rest, strict=True), 1):
                if ids is None:
                    ids = known.get(w)
                    if ids is None:
                        ids = self.new_word(w)
                        if len(known) < CACHE_WORDS:  # the first words seen are the frequent ones, mostly
                            known[w] = ids
                    out[at] = ids
        return b"".join(out)

    def new_word(self, w: str) -> bytes:
        """Ids of a word and the space before it. Letters, then a stop or comma, need no pattern to be told apart."""
        if self.fast:
            if w.isalpha():
                return array("I", self.one((" " + w).encode())).tobytes()
            if w[-1:] in (",", ".") and w[:-1].isalpha():
                stem = self.words.get(w[:-1])
                if stem is None:
                    stem = array("I", self.one((" " + w[:-1]).encode())).tobytes()
                return stem + self.stops[w[-1]]
        return self.word(" " + w)


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """piece, start, length of each piece of a document of len(ids) / 4 ids; the first may be shorter."""
    n = len(ids) // 4
    first = n % capacity or capacity
    start, length, piece = 0, min(first, n), 0
    while start < n:
        yield piece, start, length
        start, length, piece = start + length, capacity, piece + 1


def tokenise(docs: DataFrame, make_encoder, capacity: int) -> DataFrame:
    """The table of pieces: PIECES. task and place: the task that made the piece, and its rank there among those as long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, seen, task = make_encoder(), Counter(), TaskContext.get().partitionId()
        end = (0).to_bytes(4, "little")
        for pdf in batches:
            rows, size = [], 0
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                ids = encode(text or "") + end
                for piece, start, length in cut(ids, capacity):
                    rows.append((doc_id, piece, start, length, ids[4 * start : 4 * (start + length)], task, seen[length]))
                    seen[length] += 1
                size += len(ids)
                if size > 8 << 20:
                    yield frame(rows)
                    rows, size = [], 0
            yield frame(rows)

    def frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids", "task", "place"])
        return out.assign(doc_id=out["doc_id"].astype("Int64"))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over a histogram of lengths: patterns and how often each is used."""
    bins: dict[int, dict[Pattern, int]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        fits = sorted(r for r in bins if r >= size)
        while left:
            while fits and not bins.get(fits[0]):
                fits.pop(0)
            if fits:
                room = fits[0]
                pattern, n = next(iter(bins[room].items()))
                each = room // size
                if left >= each:  # fill whole bins
                    take, used = min(n, left // each), each
                else:
                    take, used = 1, left
                bins[room][pattern] -= take
                if not bins[room][pattern]:
                    del bins[room][pattern]
            else:
                used = min(capacity // size, left)
                take, pattern, room = (left // used if used == capacity // size else 1), (), capacity
            made, rest = pattern + (size,) * used, room - used * size
            slot = bins.setdefault(rest, {})
            slot[made] = slot.get(made, 0) + take
            left -= take * used
            if rest >= size and rest not in fits:
                fits = sorted([*fits, rest])
    return [(p, n) for group in bins.values() for p, n in group.items()]


def fillings(room: int, counts: dict[int, int], sizes: list[int]) -> list[Pattern]:
    """Undominated fillings of ``room`` in order of waste, at most WIDTH. sizes: those with counts, falling.

    A filling to which another piece could be added, or one of as many pieces none of which is longer than its counterpart
    in another, is dominated and left out. A single piece that fits exactly dominates every other filling.
    """
    if room in counts:
        return [(room,)]
    found: dict[Pattern, int] = {}
    looks, smallest = 0, sizes[-1] if sizes else room + 1
    stack: list[tuple[int, int, Pattern]] = [(0, room, ())]
    while stack and looks < LOOK:
        at, left, chosen = stack.pop()
        looks += 1
        if left < smallest:
            found[chosen] = left
            if not left and len(found) >= WIDTH:
                break
            continue
        k = next_fitting(sizes, at, left, counts, chosen)
        if k is None:
            if not any(s <= left and chosen.count(s) < counts[s] for s in sizes[:at][-64:]):
                found[chosen] = left
            continue
        stack.append((k + 1, left, chosen))  # without this size
        stack.append((k, left - sizes[k], (*chosen, sizes[k])))  # with one more of it, looked at first
    best = sorted(found.items(), key=lambda x: (x[1], len(x[0]), [-s for s in x[0]]))[: 4 * WIDTH]
    kept: list[Pattern] = []
    for pattern, _ in best:
        if not any(len(p) == len(pattern) and all(a >= b for a, b in zip(p, pattern, strict=True)) for p in kept):
            kept.append(pattern)
    return kept[:WIDTH]


def next_fitting(sizes: list[int], at: int, left: int, counts: dict[int, int], chosen: Pattern) -> int | None:
    """The first place from ``at`` whose size fits ``left`` and isn't used up by ``chosen``."""
    lo, hi = at, len(sizes)
    while lo < hi:  # sizes fall
        mid = (lo + hi) // 2
        if sizes[mid] > left:
            lo = mid + 1
        else:
            hi = mid
    while lo < len(sizes) and chosen.count(sizes[lo]) >= counts[sizes[lo]]:
        lo += 1
    return lo if lo < len(sizes) else None


def complete_bins(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used, so that every length is packed ``counts`` times in as few bins as were found."""
    counts = {s: n for s, n in counts.items() if n}
    total = sum(s * n for s, n in counts.items())
    best = best_fit(counts, capacity)
    bins = sum(n for _, n in best)
    bound = max(-(-total // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))
    if not counts or bins == bound:
        return best
    nodes, steps = 0, 0
    done: list[tuple[Pattern, int]] = []
    stack: list[tuple[int, dict[int, int], int, Pattern | None, int]] = [(0, counts, 0, None, 0)]
    while stack and nodes < NODES and steps < STEPS and bins > bound:
        depth, left, waste, pattern, times = stack.pop()
        nodes += 1
        done = done[: max(0, depth - 1)]
        if pattern is not None:
            done.append((pattern, times))
        if waste > (bins - 1) * capacity - total:
            continue
        if not left:
            best, bins = list(done), sum(n for _, n in done)
            continue
        largest = max(left)
        rest = dict(left)
        take(rest, (largest,), 1)
        sizes = sorted((s for s in rest if s <= capacity - largest), reverse=True)
        steps += LOOK // 4
        branches = []
        for filling in fillings(capacity - largest, {s: rest[s] for s in sizes}, sizes):
            whole = (largest, *filling)
            many = min(left[s] // n for s, n in Counter(whole).items())
            after = dict(left)
            take(after, whole, many)
            branches.append((depth + 1, after, waste + many * (capacity - sum(whole)), whole, many))
        stack += branches[::-1]
    return best


def take(counts: dict[int, int], pattern: Pattern, times: int) -> None:
    for s, n in Counter(pattern).items():
        counts[s] -= n * times
        if not counts[s]:
            del counts[s]


def places(solution: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, copies a bin, first sequence and offsets of each pattern that has it, in order of rank."""
    rows: dict[int, list] = {}
    sequence, used = 0, Counter()
    for pattern, times in solution:
        offset, at = 0, {}
        for s in pattern:
            at.setdefault(s, []).append(offset)
            offset += s
        for s, offsets in at.items():
            rows.setdefault(s, []).append((used[s], len(offsets), sequence, offsets))
            used[s] += len(offsets) * times
        sequence += times
    return {s: (np.array([r[0] for r in x]), np.array([r[1] for r in x]), np.array([r[2] for r in x]), [r[3] for r in x]) for s, x in rows.items()}


def pack(docs: DataFrame, make_encoder, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian uint32), sequence_id, offset: one row for each piece."""
    pieces = materialise(tokenise(docs, make_encoder, capacity), "pieces", "zstd")
    return place_pieces(pieces, capacity)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (length, task, place and what else they carry) with sequence_id and offset."""
    spark = pieces.sparkSession
    counted = materialise(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    sent = spark.sparkContext.broadcast(places(complete_bins(histogram, capacity)))
    counted.createOrReplaceTempView("__piece_counts")
    before = spark.sql(
        "SELECT task, length, coalesce(sum(n) OVER (PARTITION BY length ORDER BY task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before"
        " FROM __piece_counts"
    )
    spark.catalog.dropTempView("__piece_counts")
    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    ranked = ranked.drop("before", "task", "place")

    # only lengths and ranks go to Python: ids of a batch would fill a worker
    @F.pandas_udf("sequence_id long, offset long")
    def placed(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        table = sent.value
        sequence, offset = np.empty(len(ranks), dtype=np.int64), np.empty(len(ranks), dtype=np.int64)
        for length, part in lengths.groupby(lengths).indices.items():
            first, each, base, offsets = table[int(length)]
            rank = ranks.to_numpy()[part]
            k = np.searchsorted(first, rank, side="right") - 1
            nth = rank - first[k]
            sequence[part] = base[k] + nth // each[k]
            offset[part] = [offsets[i][j] for i, j in zip(k, nth % each[k], strict=True)]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    at = ranked.withColumn("placed", placed("length", "rank"))
    return at.select(*(c for c in ranked.columns if c != "rank"), "placed.sequence_id", "placed.offset")
