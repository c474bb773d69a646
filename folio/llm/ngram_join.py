"""N-gram Jaccard join with count-vector R-trees: documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

Equal sets are one node. A node's shingles are hashed into groups, and the counts of each group are its point. Two
nodes share at most the sum of the coordinate minima of their points, so a search in an R-tree of points, whose inner
entries hold coordinate maxima, finds all nodes that may share enough; exact set intersections decide.

One tree over all nodes would be one task, and its boxes would overlap too much to prune. Trees are therefore built
for blocks: all nodes that have one rare shingle in common. Shingles are ordered from rare to frequent by an exact
count over all documents; of n shingles, two sets that are similar enough share one of the first n - ceil(0.75 n) + 1 in
this order, and only shingles found in two nodes or more matter. So every link lies in some block, without a cap
on the blocks or their sizes. The steps:

1. Each task hashes its documents' shingles and sends them, packed, to hash buckets, which count them; the shared ones
   go back to the batch they came from, where each node's block shingles are chosen. No text is shuffled.
2. Each block is led by its most central node, that with the least share of shingles of its own. Blocks of one leader
   are one group, so that a node goes to few groups, with its set, however many blocks it is in. Each node is compared
   with the leaders of its groups; the links found join most of a large group of near copies.
3. In groups that are still in several parts, nodes outside the largest part are searched for in R-trees, by tiles of
   bounded size. Pairs found are verified in the tile, and those that are joined already are passed over, so that a tile
   gives fewer links than it has nodes.
4. Components of all links, in DataFrame operations.

Batches keep the order of their input, so `docs` should come from a file scan or another plan with a fixed row order.

Defined cases: null, empty and all-space texts have an empty set and are linked with nothing; with fewer than five
words the whole sequence is the one shingle; repeated rows are copies; rows with a null doc_id count as copies or
links but give no component_id (null if a component has no other); an empty table gives an empty result. Only doc_id
and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import textkit as tk
from folio.llm.components import components
from folio.llm.frames import cut, for_workers, release, stored

WORDS = 5
GROUPS = 128
#: Text bytes of a batch, and its most nodes (local numbers are 16 bits).
BATCH_BYTES, BATCH_NODES = 1 << 23, 60_000
LEAF, TILE = 16, 2_048
#: A coordinate's largest stored value; it stands for that or more, and two of them bound nothing.
MANY = 65_535
#: Bits of a shingle's hash that travel beside its bucket's number.
REST = 40


def needed(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of n with any set that is similar enough: ceil(0.75 n)."""
    return (3 * n + 3) // 4


def similar(overlap, a, b):
    return 100 * overlap >= 75 * (a + b - overlap)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def measure(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, node (a digest of the set; null if it is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in tk.slices(batch.column(1)):
                sets = tk.shingle_sets(batch.column(1).slice(start, end - start), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "node"],
                )
        release()

    return for_workers(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, node binary")


# -- step 1: packed shingles to buckets, shared ones back to their batch


def _pack(rest: np.ndarray, owner: np.ndarray, rank: np.ndarray | None = None) -> bytes:
    """Shingles of a bucket and a batch, in order of their nodes: 5 bytes of each, its rank from rare to frequent, and the step to its node's number."""
    steps = np.diff(owner.astype(np.int64), prepend=0)
    wide = len(steps) > 0 and steps.max() > 255
    parts = [(rest & np.uint64(0xFFFFFFFF)).astype(np.uint32), (rest >> np.uint64(32)).astype(np.uint8)]
    parts += [] if rank is None else [rank.astype(np.uint8)]
    return bytes([bool(wide)]) + b"".join(p.tobytes() for p in [*parts, steps.astype(np.uint16 if wide else np.uint8)])


def _unpack(body: bytes, m: int, ranked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    rest = np.frombuffer(body, np.uint32, m, 1).astype(np.uint64) | np.frombuffer(body, np.uint8, m, 1 + 4 * m).astype(np.uint64) << np.uint64(32)
    rank = np.frombuffer(body, np.uint8, m, 1 + 5 * m) if ranked else None
    return rest, np.cumsum(np.frombuffer(body, np.uint16 if body[0] else np.uint8, m, 1 + (6 if ranked else 5) * m), dtype=np.int64), rank


def frequency_rank(df: np.ndarray) -> np.ndarray:
    """A byte that grows with the number of nodes: the number itself up to 64, then eighths of its logarithm to base 2."""
    return np.minimum(np.where(df < 64, df, 64 + (8 * np.log2(np.maximum(df, 64) / 64)).astype(np.int64)), 255)


def _scatter(buckets: int, k: int):
    shift = np.uint64(buckets.bit_length() - 1)

    def rows(number: int, nodes: list[bytes], sets: list[np.ndarray]) -> Iterator[tuple]:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        group = (flat >> np.uint64(65 - GROUPS.bit_length())).astype(np.int64)
        points = np.minimum(np.bincount(owner * GROUPS + group, minlength=len(sets) * GROUPS), MANY).astype(np.uint16)
        head = b"".join(nodes) + np.array([len(s) for s in sets], np.uint32).tobytes() + points.tobytes()
        yield -1 - int(tk.mix(np.array([number], np.uint64))[0] % np.uint64(buckets)), number, 0, len(sets), head
        bucket = (flat & np.uint64(buckets - 1)).astype(np.int64)
        rest = (flat >> shift) & np.uint64((1 << REST) - 1)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            at = order[edges[b] : edges[b + 1]]
            yield int(b), number, 1, len(at), _pack(rest[at], owner[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 20, {}, 0

        def flush():
            found = list(zip(*rows(number, list(held), list(held.values())), strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds, strict=True)], names=["bucket", "batch", "kind", "m", "body"])

        for batch in batches:
            for start, end in tk.slices(batch.column(0)):
                part = batch.column(0).slice(start, end - start)
                for s in tk.shingle_sets(part, k):
                    if len(s):
                        held[_digest(s)] = s
                size += int(tk.utf8(part)[1][-1])
                if held and (size >= BATCH_BYTES or len(held) >= BATCH_NODES // 2):
                    yield flush()
                    number, held, size = number + 1, {}, 0
        if held:
            yield flush()
        held.clear()
        release()

    return run


_PACKED = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("kind", pa.int32()), ("m", pa.int64()), ("body", pa.binary())])
PACKED = "bucket long, batch long, kind int, m long, body binary"


def _count(table: pa.Table) -> pa.Table:
    """A bucket's shingles found in two nodes or more, with their counts, for each batch; batch heads pass through."""
    if table["bucket"][0].as_py() < 0:
        return table.select(_PACKED.names)
    b = table["bucket"][0].as_py()
    sizes = table["m"].to_numpy()
    parts = [_unpack(body, m, False) for m, body in zip(sizes, table["body"].to_pylist(), strict=True)]
    flat = np.concatenate([p[0] for p in parts])
    order = np.argsort(flat)
    run = np.cumsum(np.concatenate([[True], flat[order[1:]] != flat[order[:-1]]])) - 1
    df = np.zeros(len(flat), np.int64)
    df[order] = np.bincount(run)[run]
    out, at = {"bucket": [], "batch": [], "kind": [], "m": [], "body": []}, 0
    for batch, m, (rest, owner, _) in zip(table["batch"].to_pylist(), sizes, parts, strict=True):
        own = df[at : at + m]
        at += m
        keep = own > 1
        if keep.any():
            for name, value in (("bucket", b), ("batch", batch), ("kind", 1), ("m", int(keep.sum())), ("body", _pack(rest[keep], owner[keep], frequency_rank(own[keep])))):
                out[name].append(value)
    return pa.table(out, _PACKED)


NODES = "node binary, n int, lone double, point binary, blocks array<long>, shared binary"
_NODES = pa.schema([("node", pa.binary()), ("n", pa.int32()), ("lone", pa.float64()), ("point", pa.binary()), ("blocks", pa.list_(pa.int64())), ("shared", pa.binary())])


def _choose(table: pa.Table) -> pa.Table:
    """Of each node of a batch that has any: the shared shingles among its first ones from rare to frequent."""
    kinds, sizes, bodies = table["kind"].to_numpy(), table["m"].to_numpy(), table["body"].to_pylist()
    keys, counts, owners, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], 0
    for kind, m, bucket, body in zip(kinds, sizes, table["bucket"].to_pylist(), bodies, strict=True):
        if kind == 0:
            nodes, names = m, body[: 16 * m]
            n = np.frombuffer(body, np.uint32, m, 16 * m).astype(np.int64)
            points = np.frombuffer(body, np.uint16, m * GROUPS, 20 * m).reshape(m, GROUPS)
        else:
            rest, owner, rank = _unpack(body, m, True)
            keys.append(rest << np.uint64(16) | np.uint64(bucket))
            counts.append(rank)
            owners.append(owner)
    key, count, owner = np.concatenate(keys), np.concatenate(counts), np.concatenate(owners)
    order = np.lexsort((key, count, owner))
    key, edges = key[order], np.searchsorted(owner[order], np.arange(nodes + 1))
    shared = np.diff(edges)
    take = np.clip(n - needed(n) + 1 - (n - shared), 0, shared)
    out = {f.name: [] for f in _NODES}
    for i in np.flatnonzero(take):
        own = key[edges[i] : edges[i + 1]]
        for name, value in (("node", names[16 * i : 16 * i + 16]), ("n", int(n[i])), ("lone", float(1 - shared[i] / n[i])), ("point", points[i].tobytes()), ("blocks", own[: take[i]].view(np.int64)), ("shared", np.unique(own).tobytes())):
            out[name].append(value)
    return pa.table(out, _NODES)


def candidates(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """A row for each node that may have a link: node, n, lone (share of shingles that no other node has), point, blocks, shared."""
    wanted = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(1 << 16, 1 << max(4, (wanted - 1).bit_length()))
    packed = for_workers(docs).select("text").mapInArrow(_scatter(buckets, k), PACKED)
    counted = packed.groupBy("bucket").applyInArrow(_count, PACKED)
    return counted.groupBy("batch").applyInArrow(_choose, NODES).dropDuplicates(["node"])


# -- steps 2 and 3: pairs that may be similar


class CountTree:
    """An R-tree of count vectors, packed from nodes in order of size: each entry holds coordinate maxima and the sizes' range."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points.argmax(1), sizes))
        tops, least, most = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(tops, least, most)]
        while len(tops) > LEAF:
            at = np.arange(0, len(tops), LEAF)
            tops, least, most = np.maximum.reduceat(tops, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((tops, least, most))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the points whose overlap bound with this one is enough."""
        at = np.arange(len(self.levels[-1][0]))
        for depth, (tops, least, most) in enumerate(reversed(self.levels)):
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(tops)]
            at = at[may_link(np.minimum(tops[at], point).sum(1), size, least[at], most[at])]
        return self.order[at]


def may_link(bound, size, least, most):
    """Whether an overlap of at most `bound` can be enough between a set of `size` and one of `least` to `most`."""
    return (7 * bound >= 3 * (size + least)) & (4 * size >= 3 * least) & (4 * most >= 3 * size)


def coordinates(stored: np.ndarray) -> np.ndarray:
    return np.where(stored == MANY, 1 << 40, stored.astype(np.int64))


LINKS = "a binary, b binary"
_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _links(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in range(2)], schema=_LINKS)


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of nodes to their group's leader; rows come in order of groups, each led by its leader."""
    name, size, point, own = None, 0, None, None
    for batch in batches:
        found = []
        for leader, node, n, stored, shared in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("leader", "node", "n", "point", "shared")), strict=True):
            at, held = coordinates(np.frombuffer(stored, np.uint16)), np.frombuffer(shared, np.uint64)
            if leader == node:
                name, size, point, own = node, n, at, held
            elif name != leader:
                raise ValueError("a group without its leader")
            elif may_link(int(np.minimum(at, point).sum()), n, size, size) and similar(len(np.intersect1d(held, own, assume_unique=True)), n, size):
                found.append((leader, node))
        yield _links(found)


def tile_links(nodes: list[bytes], roots: list[bytes], n: np.ndarray, points: np.ndarray, sets: list[np.ndarray], probe: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Links between roots that, with what is joined already, join all similar pairs of a probe and a held node."""
    index = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    names, part = list(index), np.array([index[r] for r in roots])
    seekers, held = np.flatnonzero(probe), np.flatnonzero(~probe)
    if not len(seekers) or not len(held):
        return []
    lengths = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    tree, marked, found = CountTree(points[held], n[held]), np.zeros(len(codes) + 1, bool), []
    for s in seekers:
        hits = held[tree.search(points[s], n[s])]
        hits = hits[part[hits] != part[s]]
        if not len(hits):
            continue
        own = codes[edges[s] : edges[s + 1]]
        marked[own] = True
        first = np.cumsum(lengths[hits]) - lengths[hits]
        flat = np.arange(lengths[hits].sum()) + np.repeat(edges[hits] - first, lengths[hits])
        overlap = np.add.reduceat(marked[codes[flat]].astype(np.int64), first)
        marked[own] = False
        for h in hits[similar(overlap, n[hits], n[s])]:
            if part[h] != part[s]:
                found.append((names[part[s]], names[part[h]]))
                part[part == part[h]] = part[s]
    return found


def _search_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links found in each tile; rows come in order of tiles, and one tile is held at a time."""
    held: list[pa.RecordBatch] = []

    def search() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        nodes, roots, points, shared = (t[c].to_pylist() for c in ("node", "root", "point", "shared"))
        at = coordinates(np.frombuffer(b"".join(points), np.uint16)).reshape(-1, GROUPS)
        return _links(tile_links(nodes, roots, t["n"].to_numpy().astype(np.int64), at, [np.frombuffer(x, np.uint64) for x in shared], t["probe"].to_numpy(zero_copy_only=False)))

    now = None
    for batch in batches:
        keys = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("leader", "tile", "probe_tile")), strict=True))
        start = 0
        for i, key in enumerate(keys):
            if key != now:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield search()
                held, now, start = [], key, i
        held.append(batch.slice(start))
    if held:
        yield search()


def groups_of(blocks: DataFrame) -> DataFrame:
    """leader, node: each node beside the leaders of its blocks; a leader is beside itself too."""
    led = blocks.groupBy("block").agg(F.min(F.struct("lone", "node")).alias("c"), F.count("*").alias("held")).where("held > 1").select("block", F.col("c.node").alias("leader"))
    return blocks.select("block", "node").join(led, "block").select("leader", "node").distinct()


def star_links(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links of each node with the leaders of its groups; groups are dealt out in tiles, each with the leader."""
    tiles = groups.groupBy("leader").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    members = groups.where("node <> leader").join(tiles, "leader").select("leader", "node", F.expr("pmod(xxhash64(node), tiles)").cast("int").alias("tile"))
    leaders = tiles.select("leader", F.col("leader").alias("node"), F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"))
    rows = members.union(leaders).join(nodes.select("node", "n", "point", "shared"), "node")
    return rows.repartition("leader", "tile").sortWithinPartitions("leader", "tile", F.col("node") != F.col("leader")).select("leader", "node", "n", "point", "shared").mapInArrow(_star, LINKS)


def tree_links(groups: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between roots that join all similar pairs of a group that `roots` doesn't.

    Of each group, all nodes are held, and those outside its largest part are searched for; any pair of different
    parts has such a node. Tiles of both keep each tree and each list of probes bounded.
    """
    known = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    each = known.groupBy("leader", "root").agg(F.count("*").alias("c"))
    sizes = each.groupBy("leader").agg(F.sum("c").alias("held"), F.max(F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    sizes = sizes.select("leader", F.ceil(F.col("held") / TILE).cast("int").alias("tiles"), F.ceil((F.col("held") - F.col("main.c")) / TILE).cast("int").alias("probe_tiles"), F.col("main.root").alias("main"))
    open_ = known.join(sizes, "leader")
    held = open_.select("leader", "node", "root", F.lit(False).alias("probe"), F.expr("pmod(xxhash64(node, 1), tiles)").cast("int").alias("tile"), F.explode(F.expr("sequence(0, probe_tiles - 1)")).alias("probe_tile"))
    probes = open_.where("root <> main").select("leader", "node", "root", F.lit(True).alias("probe"), F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"), F.expr("pmod(xxhash64(node, 2), probe_tiles)").cast("int").alias("probe_tile"))
    rows = held.unionByName(probes).join(nodes.select("node", "n", "point", "shared"), "node")
    tile = ["leader", "tile", "probe_tile"]
    return rows.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(_search_tiles, LINKS)


def node_components(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """node, root: the least node of each component, for the nodes that have a link."""
    nodes, drop = stored(candidates(docs, k))
    groups, drop_groups = stored(groups_of(nodes.select("node", "lone", F.explode("blocks").alias("block"))))
    roots = components(star_links(groups, nodes))
    later = components(tree_links(groups, roots, nodes))
    drop()
    drop_groups()
    moved = later.select(F.col("node").alias("root"), F.col("root").alias("new"))
    joined = roots.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return joined.union(later.join(roots.select("node"), "node", "left_anti"))


def near_duplicates(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links, itself included), a row for each document."""
    measured = cut(measure(docs, k))
    roots = node_components(docs, k)
    least = measured.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = rooted.join(by_root, "root").select("node", "component_id")
    alone = measured.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return measured.where("node is not null").join(by_node, "node").select("doc_id", "n_shingles", "component_id").union(alone)


def kept_documents(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """The rows of `docs`, less those that are linked, over any number of links, with a lesser doc_id. Rows without a doc_id stay."""
    gone = near_duplicates(docs, k).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
