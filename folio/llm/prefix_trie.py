"""The prefix trie of conversations as balanced parentheses, shard by shard, with the spines that shards share merged.

A conversation is a path of turns, and a turn is a digest of 16 bytes of its role and text. Paths are sorted by range, so a run
of neighbours is a shard: a subtree forest of its own but for the nodes on its first and its last path, which other
shards may hold too. Each shard of about `shard_nodes` turns is written as balanced parentheses with a range min-max tree of
excesses; findclose delimits each node's subtree, the rank of leaf pairs counts its leaves, and cumulative arrays in
preorder give its members and savings. Nodes inside a shard are final. The two spines carry what hangs on them as weights,
and are the paths of the next level, whose shards merge them; levels shrink until one shard holds all.

A hot first turn, or a conversation with very many copies, is thus split over shards like any other range. Only one
conversation's digests are one value (16 bytes a turn, and 8 for its length). The ids of the conversations that end at a
node shared by shards go through one sorted stream of ids, since a hash has to read them in order; it holds no list.

Defined cases: null role or text counts as empty; turns are ordered by turn (null first), then role, then digest; rows without a
conv_id take no part; conversations without turns end at the root; repeated rows are repeated turns; conv_id - conv_id % 5
is rounded down for negative ids; an empty table gives an empty result. Only the four columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.frames import cut, for_workers

DIGEST = 16
BLOCK = 64
SHARD_NODES = 1 << 16
NO_END = hashlib.sha256(b"").digest()
ROOT = bytes(DIGEST)
FAR = np.iinfo(np.int64).max


# -- paths


def turn_paths(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: an array of (key: the digest in hex, size: the text's bytes) in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    turn = F.struct("turn", role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    each = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return each.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"], t["size"])).alias("turns"))


def rebuilt(paths: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % family, where h = crc32(c) % most."""
    heads = paths.where(F.pmod("conv_id", F.lit(family)) == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    own = paths.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(family))).join(heads, "base", "left")
    first = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.select("conv_id", F.concat(first, rest).alias("turns"))


# -- one shard


class Parentheses:
    """A tree as balanced parentheses (1 opens), with the least excess of each block and of each pair of blocks above."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK):
        self.bits, self.block = bits, block
        self.excess = np.cumsum(np.where(bits, 1, -1))
        far = np.full(-len(bits) % block, len(bits) + 1, self.excess.dtype)
        self.blocks = np.concatenate([self.excess, far]).reshape(-1, block)
        self.least = [self.blocks.min(1)]
        while len(self.least[-1]) > 1:
            row = self.least[-1]
            row = np.append(row, len(bits) + 1) if len(row) % 2 else row
            self.least[-1] = row
            self.least.append(row.reshape(-1, 2).min(1))

    def findclose(self, opens: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        return np.concatenate([self._findclose(opens[i : i + at_once]) for i in range(0, len(opens), at_once)] or [opens])

    def _findclose(self, opens: np.ndarray) -> np.ndarray:
        target, node = self.excess[opens] - 1, opens // self.block
        here = (self.blocks[node] <= target[:, None]) & (np.arange(self.block) > (opens % self.block)[:, None])
        out, rest = node * self.block + here.argmax(1), np.flatnonzero(~here.any(1))
        target, node = target[rest], node[rest]
        turned = np.full(len(rest), -1)
        for level, least in enumerate(self.least[:-1]):  # up, to the first block on the right that goes as low
            beside = np.minimum(node + 1, len(least) - 1)
            turn = (turned < 0) & (node % 2 == 0) & (least[beside] <= target)
            turned[turn] = level
            node = np.where(turn, node + 1, np.where(turned < 0, node // 2, node))
        for level in range(len(self.least) - 1, 0, -1):  # and down
            low = turned >= level
            left = 2 * node[low]
            node[low] = left + (self.least[level - 1][left] > target[low])
        out[rest] = node * self.block + (self.blocks[node] <= target[:, None]).argmax(1)
        return out

    def leaf_pairs(self) -> np.ndarray:
        """Of each opening parenthesis in order whether it is closed at once."""
        return np.flatnonzero(self.bits)[self.bits[np.flatnonzero(self.bits) + 1] == 0]


class Paths(NamedTuple):
    """Sorted paths: the digests of all, where each begins, and its cells' sizes."""

    digests: np.ndarray  # cells x 2
    offsets: np.ndarray
    sizes: np.ndarray


class Tree(NamedTuple):
    """Nodes in preorder, the root first."""

    depth: np.ndarray
    parent: np.ndarray
    size: np.ndarray  # bytes of the last text
    node: np.ndarray  # of each cell
    end: np.ndarray  # of each path
    pairs: Parentheses
    opens: np.ndarray
    past: np.ndarray  # the node after each one's subtree


def tree_of(p: Paths) -> Tree:
    lengths = np.diff(p.offsets)
    cells, rows = int(p.offsets[-1]), len(lengths)
    row = np.repeat(np.arange(rows), lengths)
    place = np.arange(cells) - p.offsets[row]
    can = np.flatnonzero((row > 0) & (place < lengths[row - 1]))
    same = np.zeros(cells, bool)
    same[can] = (p.digests[can] == p.digests[p.offsets[row[can] - 1] + place[can]]).all(1)
    differ = np.append(np.flatnonzero(~same), cells)
    shared = np.minimum(differ[np.searchsorted(differ, p.offsets[:-1])], p.offsets[1:]) - p.offsets[:-1]
    new = place >= shared[row]
    n = int(new.sum()) + 1
    # a cell that isn't new is the last new node of its depth so far
    order = np.argsort(place, kind="stable")
    base = place[order] * (n + 1)
    node = np.empty(cells, np.int64)
    node[order] = np.maximum.accumulate(base + np.where(new, np.cumsum(new), 0)[order]) - base
    parent = np.where(place > 0, node[np.maximum(np.arange(cells) - 1, 0)] if cells else 0, 0)[new]
    end = np.where(lengths > 0, node[np.maximum(p.offsets[1:] - 1, 0)] if cells else 0, 0)
    closes = np.concatenate([[0], lengths[:-1] - shared[1:], [lengths[-1] + 1]])
    counts = np.ravel(np.column_stack([closes, np.append(lengths - shared, 0)]))
    bits = np.concatenate([[1], np.repeat(np.tile([0, 1], rows + 1), counts)]).astype(np.int8)
    pairs = Parentheses(bits)
    opens = np.flatnonzero(bits)
    past = np.arange(n) + (pairs.findclose(opens) - opens + 1) // 2
    at_root = lambda first, rest: np.concatenate([[first], rest])
    return Tree(at_root(0, place[new] + 1), at_root(-1, parent), at_root(0, p.sizes[new]), node, end, pairs, opens, past)


def subtree_sum(values: np.ndarray, past: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[past] - total[np.arange(len(past))]


def subtree_least(values: np.ndarray, past: np.ndarray) -> np.ndarray:
    """The least value from each node to the end of its subtree, by runs of doubled length."""
    first, out = np.arange(len(past)), np.empty_like(values)
    step = np.frexp((past - first).astype(float))[1] - 1
    runs = values
    for k in range(int(step.max()) + 1):
        own = np.flatnonzero(step == k)
        out[own] = np.minimum(runs[own], runs[past[own] - (1 << k)])
        if len(runs) > 1 << k:
            runs = np.minimum(runs[: len(runs) - (1 << k)], runs[1 << k :])
    return out


WEIGHTS = ("n", "least", "kids", "leaves", "saved")
KEPT = "level int, shard long, kind int, depth long, conv_id long, parent_conv_id long, parent_id binary, node_id binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, "
SPINE = "path binary, ids binary, sizes array<long>, " + ", ".join(f"{w} array<long>" for w in WEIGHTS)
NODE, END, PATH = range(3)


class Held(NamedTuple):
    """A shard's result: final nodes, the spines as paths, and conversations that end on a spine."""

    nodes: dict[str, list | np.ndarray]
    spines: list[dict]
    ends: list[tuple[bytes, int]]


def reduce_shard(p: Paths, own: dict[str, np.ndarray], t: Tree, ids: list[bytes] | None, ends: np.ndarray | None, last: bool) -> Held:
    """own: weights of nodes; ids: of nodes, at levels of spines; ends: the conversation of each path, at the first level; last: no other shard shares anything."""
    n = len(t.depth)
    spine = np.zeros(n, bool)
    first_path, last_path = np.arange(p.offsets[1] + 1), np.concatenate([[0], t.node[p.offsets[-2] :]])
    if not last:
        spine[first_path] = spine[last_path] = True
    members = subtree_sum(own["n"], t.past)
    least = subtree_least(own["least"], t.past)
    kids = np.bincount(t.parent[1:], minlength=n) + own["kids"]
    pairs = np.zeros(n, np.int64)
    pairs[np.searchsorted(t.opens, t.pairs.leaf_pairs())] = 1
    leaf = own["leaves"] + np.where(spine | (own["kids"] > 0), 0, pairs)
    leaves = subtree_sum(leaf, t.past)
    saved = subtree_sum(own["saved"] + np.where(spine, 0, (members - 1) * t.size), t.past)

    if ids is None:  # spines need names that other shards give them too
        ids = [b""] * n
        for path, of in ((first_path, 0), (last_path, len(p.offsets) - 2)):
            name, at = ROOT, p.offsets[of]
            for k, v in enumerate(path.tolist()):
                if k:
                    name = hashlib.sha256(name + p.digests[at + k - 1].tobytes()).digest()[:DIGEST]
                ids[v] = name
    inner = np.flatnonzero(~spine)
    above = np.where(t.parent[inner] >= 0, t.parent[inner], 0)
    open_above = spine[above] & (t.parent[inner] >= 0)
    digest, on_spine = {}, []
    if ends is not None:
        starts = np.flatnonzero(np.append(True, t.end[1:] != t.end[:-1]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ends)], strict=True):
            v = int(t.end[a])
            if spine[v]:
                on_spine += [(ids[v], c) for c in ends[a:b].tolist()]
            else:
                digest[v] = hashlib.sha256(",".join(map(str, ends[a:b].tolist())).encode()).digest()
    nodes = {
        "depth": t.depth[inner], "conv_id": least[inner], "parent_conv_id": pa.array(least[above], mask=open_above | (t.parent[inner] < 0)), "parent_id": [ids[a] if o else None for a, o in zip(above.tolist(), open_above.tolist(), strict=True)],
        "node_id": [ids[v] or None for v in inner.tolist()], "n_convs": members[inner], "n_children": kids[inner], "n_leaves": leaves[inner], "saved_tokens": saved[inner], "ends": [digest.get(v, NO_END) for v in inner.tolist()],
    }
    if last:
        return Held(nodes, [], on_spine)
    # what hangs on the spines: sums of subtrees without those of the spines' own children
    below = np.flatnonzero(spine & (t.parent >= 0))
    hung = {"n": members, "leaves": leaves, "saved": saved}
    for name, total in hung.items():
        rest = total.copy()
        np.subtract.at(rest, t.parent[below], total[below])
        hung[name] = rest
    hung["least"], hung["kids"] = own["least"].copy(), own["kids"].copy()
    hanging = inner[open_above]
    np.minimum.at(hung["least"], t.parent[hanging], least[hanging])
    np.add.at(hung["kids"], t.parent[hanging], 1)

    spines, given = [], 0
    for path, of in ((first_path, 0), (last_path, len(p.offsets) - 2)):
        if of and len(path) == len(first_path) and path[-1] == first_path[-1]:
            break
        while given and given < min(len(path), len(first_path)) and path[given] == first_path[given]:
            given += 1
        parts = {w: np.concatenate([np.full(given, FAR if w == "least" else 0), hung[w][path[given:]]]) for w in WEIGHTS}
        a, b = p.offsets[of], p.offsets[of + 1]
        spines.append({"path": p.digests[a:b].tobytes(), "ids": b"".join(ids[v] for v in path.tolist()), "sizes": p.sizes[a:b]} | parts)
        given = 1
    return Held(nodes, spines, on_spine)


# -- shards on Spark


def _shards(batches: Iterator[pa.RecordBatch], most: int, least_rows: int) -> Iterator[pa.Table]:
    """Runs of sorted rows of about `most` turns, but at least `least_rows` paths."""
    held: list[pa.RecordBatch] = []
    nodes = rows = 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(0)).to_numpy().astype(np.int64) // DIGEST + 1
        start = 0
        for k, length in enumerate(lengths.tolist()):
            nodes, rows = nodes + length, rows + 1
            if nodes >= most and rows >= least_rows:
                yield pa.Table.from_batches([*held, batch.slice(start, k + 1 - start)])
                held, start, nodes, rows = [], k + 1, 0, 0
        if start < len(batch):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _lists(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _paths(table: pa.Table) -> Paths:
    joined = table.column("path").to_pylist()
    offsets = np.concatenate([[0], np.cumsum([len(v) // DIGEST for v in joined])]).astype(np.int64)
    return Paths(np.frombuffer(b"".join(joined), np.uint64).reshape(-1, 2), offsets, _lists(table.column("sizes")))


def _first_level(table: pa.Table, last: bool) -> Held:
    p = _paths(table)
    t = tree_of(p)
    convs, n = table.column("conv_id").to_numpy(), len(t.depth)
    own = {w: np.full(n, FAR) if w == "least" else np.zeros(n, np.int64) for w in WEIGHTS}
    np.add.at(own["n"], t.end, 1)
    np.minimum.at(own["least"], t.end, convs)
    return reduce_shard(p, own, t, None, convs, last)


def _next_level(table: pa.Table, last: bool) -> Held:
    p = _paths(table)
    t = tree_of(p)
    lengths = np.diff(p.offsets)
    at = p.offsets[:-1] + np.arange(len(lengths))  # a path has one more node than cells: the root
    node = np.zeros(len(t.node) + len(lengths), np.int64)
    node[np.setdiff1d(np.arange(len(node)), at, assume_unique=True)] = t.node
    own = {w: np.full(len(t.depth), FAR) if w == "least" else np.zeros(len(t.depth), np.int64) for w in WEIGHTS}
    for w in WEIGHTS:
        (np.minimum if w == "least" else np.add).at(own[w], node, _lists(table.column(w)))
    names = b"".join(table.column("ids").to_pylist())
    ids = [b""] * len(t.depth)
    for v, k in zip(*(a.tolist() for a in np.unique(node, return_index=True)), strict=True):
        ids[v] = names[k * DIGEST : (k + 1) * DIGEST]
    return reduce_shard(p, own, t, ids, None, last)


def _reduce(paths: DataFrame, level: int, shard_nodes: int, last: bool) -> DataFrame:
    names = [f.split()[0] for f in (KEPT + SPINE).split(", ")]
    lists = {name: pa.list_(pa.int64()) for name in ("sizes", *WEIGHTS)}
    kinds = {f.split()[0]: lists.get(f.split()[0]) or {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in (KEPT + SPINE).split(", ")}

    def rows(kind: int, shard: int, columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        columns |= {"level": np.full(n, level), "shard": np.full(n, shard), "kind": np.full(n, kind)}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) if c in columns else pa.nulls(n, kinds[c]) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        most, least_rows = (1 << 62, 1) if last else (shard_nodes, 8)
        for number, table in enumerate(_shards(batches, most, least_rows)):
            found = (_next_level if level else _first_level)(table, last)
            made = rows(NODE, first + number, found.nodes)
            yield from (made.slice(i, 20_000) for i in range(0, len(made), 20_000))
            if found.ends:
                yield rows(END, first + number, {"node_id": [e[0] for e in found.ends], "conv_id": [e[1] for e in found.ends]})
            for spine in found.spines:
                yield rows(PATH, first + number, {k: [v] for k, v in spine.items()})

    return paths.mapInArrow(run, KEPT + SPINE)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node_id and conv_id: the hash of each node's ids, as a stream."""
    name, hashed = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([hashed.digest()], pa.binary())], names=["node_id", "ends"])
    for batch in batches:
        for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != name:
                if hashed:
                    yield row()
                name, hashed = node, hashlib.sha256(str(conv).encode())
            else:
                hashed.update(f",{conv}".encode())
    if hashed:
        yield row()


def trie(paths: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """paths(conv_id, turns) -> a row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends (the hash of the ids of the conversations that end there)."""
    path: Column = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    rows = for_workers(cut(paths.select(path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"), "conv_id")))
    level, made = 0, []
    while True:
        held = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("path") / DIGEST + 1), F.lit(0.0)).alias("nodes")).first()
        last = held.nodes <= shard_nodes or held.rows <= 8
        ranged = rows.repartition(1) if last else rows.repartitionByRange("path", *["conv_id"] * (level == 0))
        ranged = ranged.sortWithinPartitions("path", *(["conv_id"] if level == 0 else ["ids"]))
        done = cut(_reduce(ranged, level, shard_nodes, last))
        made.append(done.where(F.col("kind") != PATH).select(*[f.split()[0] for f in KEPT.rstrip(", ").split(", ")]))
        if last:
            break
        rows, level = done.where(F.col("kind") == PATH).select(*[f.split()[0] for f in SPINE.split(", ")]), level + 1
    every = made[0]
    for more in made[1:]:
        every = every.union(more)
    nodes, names = every.where(F.col("kind") == NODE), ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    if level == 0:
        return nodes.select(*names, "ends")
    # conversations that end on a spine, and the parents that are spine nodes, met by shard
    ends = every.where(F.col("kind") == END).select("node_id", "conv_id").repartition("node_id").sortWithinPartitions("node_id", "conv_id").mapInArrow(_hash_ends, "node_id binary, ends binary")
    upper = nodes.where(F.col("level") > 0)
    asked = nodes.where(F.col("parent_id").isNotNull()).select("level", "shard", "parent_id").distinct()
    answers = asked.join(upper.select(F.col("node_id").alias("parent_id"), F.col("conv_id").alias("found")), "parent_id")
    inner = nodes.where("level = 0").select(*names, "ends", "level", "shard", "parent_id")
    outer = upper.drop("ends").join(ends, "node_id", "left").select(*names, F.coalesce("ends", F.lit(NO_END)).alias("ends"), "level", "shard", "parent_id")
    placed = inner.union(outer).join(answers, ["level", "shard", "parent_id"], "left")
    return placed.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "found")).select(*names, "ends")


def conversation_trie(conversations: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """The trie of the rebuilt conversations, with ends_sha256 in hex."""
    found = trie(rebuilt(turn_paths(conversations)), shard_nodes)
    return found.withColumn("ends_sha256", F.lower(F.hex("ends"))).drop("ends")
