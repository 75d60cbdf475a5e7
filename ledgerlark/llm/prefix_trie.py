"""Prefix trie of conversations from their globally sorted turn arrays.

Method. A turn becomes a token of TOKEN bytes, a digest of role and text and the number of the text's code points; a conversation is the concatenation of
its tokens. Conversations are sorted by ranges of (tokens, conv_id) over all partitions, so those that start alike are
neighbours. A sweep over a partition takes the common prefix of each conversation with the one before and keeps a stack of the
open nodes, one for each depth: what is deeper than the common prefix closes, its totals go to its parent. Nodes on the path of
a partition's first or last conversation may go on in its neighbours; they leave the sweep as open stacks. These are stitched:
FAN neighbouring stacks become one, by the same stack machine, round after round until one is left.

Scale. Texts are hashed where they are read; TOKEN bytes a turn are shuffled. Partitions hold about PART_TURNS turns. A stack has
at most two nodes a depth, so a stitch handles FAN times that. A closed node takes its parent's id from the stack; where the parent is on an open stack, by a join on
(partition, parent), so the root's children don't meet in one task. Ids of a group of equal conversations within a partition are hashed as
they are swept; those of a group that spans partitions leave in pieces of PIECE ids and are hashed in order, in a stream.

Defined cases. Turns are ordered by turn, null first, then by token. Null role or text is empty; rows that repeat are turns of their
own. A null conv_id takes no part. An empty table has no node. Two turns are equal when 128 bits of SHA-256 over the length of the role, role and text are.
A conversation is one row of TOKEN bytes a turn, however long its texts are. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

DIGEST, TOKEN = 16, 20
#: Turns of a partition of the sorted conversations, and at least if there are several; stacks stitched in one group; ids of a group in one piece.
PART_TURNS, LEAST_TURNS, FAN, PIECE = 200_000, 5_000, 64, 5_000
#: The first turns of every STRIDE-th conversation start those after it; how many, at most MOST_SHARED, a checksum tells.
STRIDE, MOST_SHARED = 100, 5
NODE = "part long, kind string, side string, seq long, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, chars long, ends string"
NAMES = [c.split()[0] for c in NODE.split(", ")]
#: The smallest member of a node that has none yet.
NOBODY = 2**63 - 1
#: In place of a hash: the ids are in pieces.
PIECES = "pieces"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def tokens(turns: DataFrame) -> DataFrame:
    """conv_id, turns: the hex tokens of each conversation in their order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    token = F.concat(digest, F.lower(F.lpad(F.hex(F.length(text).cast("long")), 2 * (TOKEN - DIGEST), "0")))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), token.alias("token")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["token"]).alias("turns"))


def rebuilt(arrays: DataFrame) -> DataFrame:
    """conv_id, path: each conversation with its first h turns taken from the conversation its hundred starts with; h: crc32(conv_id) % 6."""
    first = arrays.where(F.col("conv_id") % STRIDE == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_SHARED).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)).cast("int")
    joined = arrays.withColumn("base", F.col("conv_id") - F.col("conv_id") % STRIDE).join(first, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.size("turns"))
    return joined.select("conv_id", F.unhex(F.array_join(F.concat(head, rest), "")).alias("path"))


class Node:
    """An open node. Totals leave out children that are still open."""

    __slots__ = ("key", "depth", "chars", "conv", "n", "children", "leaves", "saved", "ends", "waiting", "left")

    def __init__(self, depth: int, chars: int, left: bool, key: bytes | None = None):
        self.depth, self.chars, self.left, self.key = depth, chars, left, key
        self.conv, self.n, self.children, self.leaves, self.saved = NOBODY, 0, 0, 0, 0
        self.ends, self.waiting = None, []

    def add(self, conv: int, n: int, children: int, leaves: int, saved: int) -> None:
        self.conv, self.n, self.children, self.leaves, self.saved = min(self.conv, conv), self.n + n, self.children + children, self.leaves + leaves, self.saved + saved

    def close(self) -> None:
        """All children are closed: the totals of the whole subtree."""
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.chars

    def row(self, part: int, kind: str, side: str = "", seq: int = 0, parent_key: bytes | None = None, parent: int | None = None) -> tuple:
        ends = NO_ENDS if self.ends is None else self.ends if isinstance(self.ends, str) else self.ends.hexdigest()
        return (part, kind, side, seq, self.key, parent_key, self.depth, self.conv, parent, self.n, self.children, self.leaves, self.saved, self.chars, ends)


class Sweep:
    """The stack machine over the sorted conversations of one partition."""

    def __init__(self, part: int):
        self.part, self.out = part, []
        self.stack: list[Node] = []
        self.left: list[Node] = []  # of the first conversation's path, what is closed on the right
        self.first = self.last = b""
        self.ids: list[int] = []  # of the conversations equal to the last one
        self.run = self.seq = 0

    def keys(self, path: bytes) -> list[bytes]:
        h, out = hashlib.sha256(), [hashlib.sha256(b"").digest()[:DIGEST]]
        for at in range(0, len(path), TOKEN):
            h.update(path[at : at + TOKEN])
            out.append(h.copy().digest()[:DIGEST])
        return out

    def flush_ids(self, over: bool) -> None:
        """Hand on the ids gathered of a group: into its node's hash, unless the group is the partition's first, and as a piece, where
        it may go on in another partition; ``over``: it ends within this one. Pieces of groups that turn out not to span are left unread."""
        if not self.ids:
            return
        top, text, spans = self.stack[-1], ",".join(map(str, self.ids)), self.last == self.first
        if spans or not over:
            self.out.append((self.part, "piece", "", self.seq, self.keys(self.last)[-1], *[None] * (len(NAMES) - 6), text))
            self.seq += 1
        if spans:
            top.ends = PIECES
        elif top.ends is None:
            top.ends = hashlib.sha256(text.encode())
        else:
            top.ends.update(b"," + text.encode())
        self.ids = []

    def pop(self) -> None:
        node = self.stack.pop()
        if node.left:
            self.left.append(node)
            return
        node.close()
        above = self.stack[-1]
        above.add(node.conv, node.n, 1, node.leaves, node.saved)
        self.out += [c.row(self.part, "node", parent=node.conv) for c in node.waiting]
        if above.left:  # its smallest member isn't known here
            self.out.append(node.row(self.part, "child", parent_key=above.key))
        else:
            node.waiting = []
            above.waiting.append(node)

    def take(self, conv: int, path: bytes) -> None:
        depth = len(path) // TOKEN
        if not self.run:
            self.first = path
            chars = [0, *(int.from_bytes(path[d * TOKEN + DIGEST : (d + 1) * TOKEN], "big") for d in range(depth))]
            self.stack = [Node(d, c, True, k) for d, (c, k) in enumerate(zip(chars, self.keys(path), strict=True))]
        elif path != self.last:
            self.flush_ids(True)
            common = shared(self.last, path)
            while len(self.stack) > common + 1:
                self.pop()
            for d in range(common + 1, depth + 1):
                self.stack.append(Node(d, int.from_bytes(path[(d - 1) * TOKEN + DIGEST : d * TOKEN], "big"), False))
        self.run, self.last = self.run + 1, path
        self.stack[-1].add(conv, 1, 0, 0, 0)
        self.ids.append(conv)
        if len(self.ids) == PIECE:
            self.flush_ids(False)

    def end(self) -> None:
        if not self.run:
            return
        self.flush_ids(False)
        if self.stack[-1].ends is not None:
            self.stack[-1].ends = PIECES
        for node, key in zip(self.stack, self.keys(self.last), strict=True):
            node.key = key
            self.out += [c.row(self.part, "child", parent_key=key) for c in node.waiting]
        self.out += stack_rows(self.part, self.stack, self.left)

    def flush(self) -> pd.DataFrame:
        rows, self.out = self.out, []
        return pd.DataFrame(rows, columns=NAMES, dtype=object)


def shared(a: bytes, b: bytes) -> int:
    """How many tokens two paths have in common at their start."""
    low, high = 0, min(len(a), len(b)) // TOKEN
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * TOKEN] == b[: mid * TOKEN] else (low, mid - 1)
    return low


def stack_rows(part: int, stack: list[Node], left: list[Node]) -> list[tuple]:
    """Both paths of a range: "both" for nodes on the first and the last conversation's path, else "left" or "right"; by depth."""
    rows = [n.row(part, "open", "both" if n.left else "right") for n in stack]
    return rows + [n.row(part, "open", "left") for n in sorted(left, key=lambda n: n.depth)]


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sweep = Sweep(TaskContext.get().partitionId())
    for pdf in batches:
        for conv, path in zip(pdf["conv_id"].tolist(), pdf["path"].tolist(), strict=True):
            sweep.take(conv, bytes(path))
            if len(sweep.out) >= 20_000:
                yield sweep.flush()
        yield sweep.flush()
    sweep.end()
    yield sweep.flush()


def stitch(pdf: pd.DataFrame, final: bool) -> pd.DataFrame:
    """The open stacks of neighbouring ranges as one; nodes that no neighbour can share any more close (all, if ``final``)."""
    out: list[tuple] = []
    stack: list[Node] = []
    left: list[Node] = []
    group = int(pdf["part"].min()) // FAN

    def done(node: Node, above: Node | None) -> None:
        node.close()
        if above:
            above.add(node.conv, node.n, 1, node.leaves, node.saved)
        out.append(node.row(group, "closed", parent_key=above.key if above else None))

    def pop() -> None:
        node = stack.pop()
        if node.left and not final:
            left.append(node)
        else:
            done(node, stack[-1] if stack else None)

    pdf = pdf.sort_values(["part", "depth"])
    for n, (_, part) in enumerate(pdf.groupby("part", sort=True)):
        paths: dict[str, list[Node]] = {"both": [], "left": [], "right": []}
        for r in part.itertuples(index=False):
            node = Node(int(r.depth), int(r.chars), not n and r.side != "right", bytes(r.key))
            node.add(int(r.conv_id), int(r.n_convs), int(r.n_children), int(r.n_leaves), int(r.saved))
            node.ends = None if r.ends == NO_ENDS else r.ends
            paths[r.side].append(node)
        trunk, side, right = paths["both"], paths["left"], paths["right"]
        if not n:
            stack, left = trunk + right, side[::-1]
            if final:
                for above, node in reversed([*zip([trunk[-1], *side], side)]):
                    done(node, above)
                left = []
            continue
        path = trunk + side
        common = 0
        while common + 1 < min(len(stack), len(path)) and stack[common + 1].key == path[common + 1].key:
            common += 1
        while len(stack) > common + 1:
            pop()
        for own, more in zip(stack, path, strict=False):
            own.add(more.conv, more.n, more.children, more.leaves, more.saved)
            own.ends = own.ends or more.ends
        path[: common + 1] = stack
        for d in range(len(path) - 1, max(common, len(trunk) - 1), -1):  # the first path's end, closed on both sides
            done(path[d], path[d - 1])
        while len(stack) > len(trunk):  # shared with the stack, but closed on the right
            pop()
        stack += trunk[len(stack) :] + right
    if final:
        while stack:
            pop()
    else:
        out += stack_rows(group, stack, left)
    return pd.DataFrame(out, columns=NAMES, dtype=object)


def _stitcher(final: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return stitch(pdf, final)

    return run


def _join_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash the pieces of each key in their order; rows come sorted by key, part and seq."""
    key, h = None, None
    for pdf in batches:
        out = []
        for k, text in zip(pdf["key"].tolist(), pdf["ends"].tolist(), strict=True):
            if key is not None and bytes(k) == key:
                h.update(b",")
            else:
                if key is not None:
                    out.append((key, h.hexdigest()))
                key, h = bytes(k), hashlib.sha256()
            h.update(text.encode())
        yield pd.DataFrame(out, columns=["key", "sha"])
    if key is not None:
        yield pd.DataFrame([(key, h.hexdigest())], columns=["key", "sha"])


def trie(conversations: DataFrame, ranges: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node; ranges: sorted partitions."""
    paths = materialise(rebuilt(tokens(conversations)), "trie-paths")
    turns = (paths.agg(F.sum(F.length("path"))).collect()[0][0] or 0) // TOKEN
    ranges = ranges or max(1, -(-turns // PART_TURNS), min(paths.sparkSession.sparkContext.defaultParallelism, turns // LEAST_TURNS))
    ordered = paths.repartitionByRange(ranges, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    swept = materialise(ordered.mapInPandas(_sweep, NODE), "trie-swept")
    first_open = swept.where("kind = 'open'")
    parts, closed, open_ = ranges, None, first_open
    while True:
        final = parts <= FAN
        group = F.lit(0) if final else F.floor(F.col("part") / FAN)
        step = materialise(open_.groupBy(group.alias("g")).applyInPandas(_stitcher(final), NODE), "trie-stitched")
        done = step.where("kind = 'closed'")
        closed = done if closed is None else closed.unionByName(done)
        if final:
            break
        open_, parts = step.where("kind = 'open'"), -(-parts // FAN)
    pieces = swept.where("kind = 'piece'").select("key", "part", "seq", "ends").repartition("key").sortWithinPartitions("key", "part", "seq")
    hashed = pieces.mapInPandas(_join_pieces, "key binary, sha string")
    known = closed.select("key", F.col("conv_id").alias("found"))
    border = closed.join(known.withColumnRenamed("key", "parent_key"), "parent_key", "left").withColumn("parent_conv_id", F.col("found")).drop("found")
    border = border.join(hashed, "key", "left").withColumn("ends", F.when(F.col("ends") == PIECES, F.col("sha")).otherwise(F.col("ends"))).drop("sha")
    # a parent on an open stack is looked up a partition at a time, so its children are spread as they were swept
    of_part = first_open.select("part", "key").join(known, "key").select("part", F.col("key").alias("parent_key"), "found")
    child = swept.where("kind = 'child'").join(of_part, ["part", "parent_key"]).withColumn("parent_conv_id", F.col("found"))
    own = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    return swept.where("kind = 'node'").select(*own).unionByName(child.select(*own)).unionByName(border.select(*own))
