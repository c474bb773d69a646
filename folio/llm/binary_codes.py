"""Nearest neighbours by randomly rotated one-bit codes.

A vector is taken relative to the nearest of a few centres, its direction is turned by a random rotation, and a bit of each
coordinate's sign is kept. Two scalars correct for what the signs lose: how well the signs point along the direction, and their product
with the centre. A query is rotated once and cut into eight bit planes, so that its inner product with a direction is estimated from
counts of common bits. An estimate's error is about the code's missing part times 1 / sqrt(bits) times the query's distance
from the centre; with `width` of these (and the whole rounding of the planes) each estimate is an interval of squared distances. Vectors whose
lower end isn't above the k-th least upper end, or the k-th best distance found so far, are compared exactly, in double precision.

Every vector is in the index; only the centres come from a bounded sample (`sample` rows, fewer of very long vectors). The index
is a table of packed chunks of vectors with their codes. Queries are packed into blocks, and blocks meet chunks of the same number of
dimensions by a broadcast of at most `broadcast_bytes` of blocks at a time; more blocks are further passes over the index. A task keeps
the k best of each of its queries, so what is shuffled is k rows a query and task. No candidate list has a cap.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part;
vectors of different lengths aren't compared; of rows with equal ids the one of the least vector counts; ties go to the
smaller id; with fewer than k candidates all are given; an empty table gives an empty result. Only id and vector are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.frames import for_workers, hashed_sample, stored

CENTRES = 16
SAMPLE, SAMPLE_BYTES = 8_192, 32 << 20
#: Codes are at least this long, since errors shrink with the root of their length: a short vector is turned into more dimensions.
LEAST_BITS = 256
PLANES = 8
#: Of one row of the index, and of one block of queries.
CHUNK, CHUNK_BYTES = 4_096, 4 << 20
BLOCK, BLOCK_BYTES = 1_024, 1 << 20
BROADCAST_BYTES = 64 << 20
WIDTH = 2.5


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components, and one that isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@lru_cache(maxsize=4)
def rotation(bits: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, bits]).standard_normal((bits, bits)))
    return q * np.sign(np.diag(r))


def code_bits(dim: int) -> int:
    return max(LEAST_BITS, -(-dim // 64) * 64)


def turned(rows: np.ndarray, seed: int) -> np.ndarray:
    """Rows filled up with zeros to whole words, and rotated."""
    bits = code_bits(rows.shape[1])
    return rows @ rotation(bits, seed)[: rows.shape[1]]


def words_of(signs: np.ndarray) -> np.ndarray:
    return np.packbits(signs, axis=-1, bitorder="little").view(np.uint64)


@np.errstate(over="ignore", invalid="ignore")
def fit_centres(rows: np.ndarray, most: int = CENTRES, rounds: int = 12) -> np.ndarray:
    """Centres by k-means, the first of them the means of equal shares of rows."""
    count = max(1, min(most, len(rows) // 64))
    centres = np.stack([part.mean(0) for part in np.array_split(rows, count)])
    for _ in range(rounds if count > 1 else 0):
        near = squared(rows, centres).argmin(1)
        centres = np.stack([rows[near == c].mean(0) if (near == c).any() else centres[c] for c in range(count)])
    return centres


@np.errstate(over="ignore", invalid="ignore")
def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of few dimensions' worth of error, for choosing only."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


class Codes(NamedTuple):
    """Of each vector the bits, its centre, and scalars: its distance from the centre, the signs' inner product with its direction and with its centre."""

    words: np.ndarray
    centre: np.ndarray
    scalars: np.ndarray


@np.errstate(over="ignore", invalid="ignore")
def encode(rows: np.ndarray, centres: np.ndarray, seed: int) -> Codes:
    middle = centres.mean(0)
    centre = squared(rows - middle, centres - middle).argmin(1)
    rest = rows - centres[centre]
    norm = np.sqrt((rest * rest).sum(1))
    direction = turned(rest / np.where(norm > 0, norm, 1)[:, None], seed)
    signs = direction > 0
    root = math.sqrt(direction.shape[1])
    along = np.where(norm > 0, np.abs(direction).sum(1) / root, 1.0)
    inward = turned(centres - middle, seed)
    offset = np.empty(len(rows))
    for c in np.unique(centre):
        own = centre == c
        offset[own] = (2 * (signs[own] @ inward[c]) - inward[c].sum()) / root
    return Codes(words_of(signs), centre.astype(np.int16), np.column_stack([norm, along, offset]))


class Asked(NamedTuple):
    """A block of queries, rotated and cut into bit planes."""

    ids: np.ndarray
    rows: np.ndarray
    planes: np.ndarray  # queries x planes x words
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray
    far: np.ndarray  # squared distances from the centres


@np.errstate(over="ignore", invalid="ignore")
def ask(ids: np.ndarray, rows: np.ndarray, centres: np.ndarray, seed: int) -> Asked:
    middle = centres.mean(0)
    flat = turned(rows - middle, seed)
    low = flat.min(1)
    step = np.maximum((flat.max(1) - low) / (2**PLANES - 1), np.finfo(float).tiny)
    parts = np.rint((flat - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = np.stack([words_of(parts >> j & 1) for j in range(PLANES)], 1)
    far = np.stack([((rows - c) ** 2).sum(1) for c in centres], 1)
    return Asked(ids, rows, planes, low, step, low * flat.shape[1] + step * parts.sum(1, dtype=np.int64), far)


def bounds(a: Asked, of: slice, codes: Codes, width: float) -> tuple[np.ndarray, np.ndarray]:
    """The lower and upper ends of the squared distances between some queries and all coded vectors."""
    bits = codes.words.shape[1] * 64
    root = math.sqrt(bits)
    common = np.zeros((len(a.ids[of]), len(codes.words)), np.int64)
    for j in range(PLANES):
        for w in range(codes.words.shape[1]):
            common += np.bitwise_count(a.planes[of, j, w][:, None] & codes.words[:, w]).astype(np.int64) << j
    held = np.bitwise_count(codes.words).sum(1, dtype=np.int64)
    with np.errstate(all="ignore"):
        product = (2 * (a.low[of, None] * held + a.step[of, None] * common) - a.total[of, None]) / root
        norm, along, offset = codes.scalars.T
        far = a.far[of][:, codes.centre]
        estimate = norm * norm + far - 2 * norm * (product - offset) / along
        missing = np.sqrt(np.maximum(1 - along * along, 0)) / along
        error = 2 * norm * (np.sqrt(far) * missing * width / math.sqrt(bits - 1) + root * a.step[of, None] / 2 / along)
        error += 1e-9 * (norm * norm + far)  # of rounding
        low, high = estimate - error, estimate + error
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    apart = rows - query
    with np.errstate(over="ignore"):
        found = np.sqrt(np.einsum("ij,ij->i", apart, apart))
    if not np.isfinite(found).all():  # beyond the squares that doubles hold
        scale = np.abs(apart).max(1)
        found = np.where(np.isfinite(found), found, scale * np.sqrt(((apart / np.where(scale > 0, scale, 1)[:, None]) ** 2).sum(1)))
    return found


class Best(NamedTuple):
    """The k nearest so far of a block's queries, nearest first; places without one hold an infinite score."""

    score: np.ndarray
    id: np.ndarray


@np.errstate(over="ignore", invalid="ignore")
def search_chunk(a: Asked, best: Best, ids: np.ndarray, rows: np.ndarray, codes: Codes, width: float, at_once: int = 128) -> int:
    """Brings a chunk's vectors into `best`; how many were compared exactly."""
    k, compared = best.score.shape[1], 0
    for start in range(0, len(a.ids), at_once):
        of = slice(start, start + at_once)
        low, high = bounds(a, of, codes, width)
        own = a.ids[of, None] == ids
        low[own] = high[own] = np.inf
        limit = np.square(best.score[of, -1]) * (1 + 1e-9)
        if len(ids) > k:
            limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
        chosen = (low <= limit[:, None]) & ~own
        for q in np.flatnonzero(chosen.any(1)).tolist():
            some = np.flatnonzero(chosen[q])
            compared += len(some)
            score, id_ = np.append(best.score[start + q], distances(rows[some], a.rows[start + q])), np.append(best.id[start + q], ids[some])
            order = np.lexsort((id_, score))[:k]
            best.score[start + q], best.id[start + q] = score[order], id_[order]
    return compared


# -- on Spark


class Index(NamedTuple):
    """A table of chunks of vectors with their codes, what they are relative to, and what deletes the table."""

    chunks: DataFrame
    centres: dict[int, np.ndarray]
    kind: str
    seed: int
    drop: Callable[[], None]


CHUNKS = "dim int, ids binary, vectors binary, centre binary, words binary, scalars binary"
BLOCKS = "dim int, block long, ids binary, vectors binary"


def _by_length(batch: pa.RecordBatch, kind: str, most: int, most_bytes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dim, ids, vectors of rows of equal lengths, in parts."""
    ids, lengths = batch.column(0).to_numpy(), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
    flat, starts = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind), np.concatenate([[0], np.cumsum(lengths)])
    for dim in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == dim)
        size = max(1, min(most, most_bytes // (dim * np.dtype(kind).itemsize)))
        for i in range(0, len(own), size):
            part = own[i : i + size]
            yield dim, ids[part], flat[starts[part][:, None] + np.arange(dim)]


def ready(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """key, column: the rows that take part, each id once."""
    rows = vectors.select(F.col(key).cast("long").alias(key), column).where(F.col(key).isNotNull() & usable(F.col(column)))
    repeated = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return rows.groupBy(key).agg(F.min(column).alias(column)) if repeated else rows


def build_index(rows: DataFrame, key: str, column: str, centres: int = CENTRES, sample: int = SAMPLE, seed: int = 31) -> Index:
    """An index of all `rows` (as from `ready`)."""
    kind = "f4" if "float" in rows.schema[column].dataType.simpleString() else "f8"
    held = rows.agg(F.count("*"), F.coalesce(F.max(F.size(column)), F.lit(1))).first()
    few = hashed_sample(rows, key, max(1, min(sample, SAMPLE_BYTES // (8 * held[1]))), held[0], seed).collect()
    by_length: dict[int, list] = {}
    for row in few:
        by_length.setdefault(len(row[column]), []).append(row[column])
    fitted = {dim: fit_centres(np.array(some, float), centres) for dim, some in by_length.items()}
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, part in _by_length(batch, kind, CHUNK, CHUNK_BYTES):
                codes = encode(part.astype(float), shared.value.get(dim, np.zeros((1, dim))), seed)
                made = (ids, part, codes.centre, codes.words, codes.scalars)
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([np.ascontiguousarray(m).tobytes()], pa.binary()) for m in made)], names=[f.split()[0] for f in CHUNKS.split(", ")])

    chunks, drop = stored(for_workers(rows.select(key, column)).mapInArrow(run, CHUNKS))
    return Index(chunks, fitted, kind, seed, drop)


def nearest(index: Index, queries: DataFrame, key: str, column: str, k: int = 10, width: float = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of the index to each query (as from `ready`) but those of its own id."""
    spark, kind, seed = queries.sparkSession, index.kind, index.seed
    shared = spark.sparkContext.broadcast(index.centres)
    names = [f.split()[0] for f in BLOCKS.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for dim, ids, part in _by_length(batch, kind, BLOCK, BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([number], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([part.tobytes()], pa.binary())], names=names)
                number += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[Asked, Best]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                dim, block = row["dim"], row["block"]
                centres = shared.value.get(dim, np.zeros((1, dim)))
                if block not in state:
                    ids = np.frombuffer(row["query_ids"], np.int64)
                    asked = ask(ids, np.frombuffer(row["query_vectors"], kind).reshape(-1, dim).astype(float), centres, seed)
                    state[block] = asked, Best(np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max))
                ids = np.frombuffer(row["ids"], np.int64)
                codes = Codes(np.frombuffer(row["words"], np.uint64).reshape(len(ids), -1), np.frombuffer(row["centre"], np.int16), np.frombuffer(row["scalars"]).reshape(-1, 3))
                search_chunk(*state[block], ids, np.frombuffer(row["vectors"], kind).reshape(-1, dim).astype(float), codes, width)
        for asked, best in state.values():
            found = np.isfinite(best.score)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(asked.ids[:, None], found.shape)[found]), pa.array(best.id[found]), pa.array(best.score[found])], names=["query_id", "vec_id", "score"])

    asked = queries.select(key, column)
    parts = max(1, math.ceil(asked.count() / (4 * BLOCK)))
    blocks, drop = stored(for_workers(asked.repartition(parts, key)).mapInArrow(pack, BLOCKS))
    held = blocks.agg(F.coalesce(F.sum(F.octet_length("vectors") + F.octet_length("ids")), F.lit(0))).first()[0]
    passes = max(1, math.ceil(held / broadcast_bytes))
    named = blocks.select("dim", "block", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"), F.pmod(F.xxhash64("block"), F.lit(passes)).alias("pass"))
    found = None
    for i in range(passes):
        met = index.chunks.join(F.broadcast(named.where(F.col("pass") == i).drop("pass")), "dim")
        own = met.select("dim", "block", "query_ids", "query_vectors", "ids", "vectors", "centre", "words", "scalars").mapInArrow(run, "query_id long, vec_id long, score double")
        found = own if found is None else found.union(own)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    made, _ = stored(found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k))
    drop()
    return made


def nearest_to_some(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """The nearest of all vectors to those whose id is divisible by `every`."""
    rows = ready(vectors, key, column)
    index = build_index(rows, key, column)
    found = nearest(index, rows.where(F.col(key) % every == 0), key, column, k)
    index.drop()
    return found
