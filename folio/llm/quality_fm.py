"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), so that all pairwise interactions
cost one pass over a document's features. Words are hashed into `WORDS` buckets and weighted by their share of the
text's length in words (Euclidean norm 1); structure statistics and the metadata n_chars follow as dense features.

The model is fitted on a bounded sample: of the labelled rows whose crc32(doc_id as text) mod 4 is not 2, the
`per_class` rows of each label with the least hashes, weighted back to the labels' true shares. Only their feature
vectors reach the driver. Scoring covers every row, with a model of about a megabyte, whatever the data's size.

Defined cases: null text counts as empty and is scored from its statistics; a null or missing n_chars counts as 0;
labels that are null, or of rows not in `docs`, are ignored, and of several labels of a doc_id the least counts; without
labels of both kinds every score is 0.5; an empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import textkit as tk
from folio.llm.frames import hashed_sample
from folio.llm.quality_rules import NOT_NEWLINE, SYMBOLS, _owners, _per_text, counts

WORDS = 1 << 15
STATISTICS = 16
RANK = 8
PER_CLASS = 2_000


def _flag(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, LOWER, DIGIT = _flag(bytes(range(65, 91))), _flag(bytes(range(97, 123))), _flag(b"0123456789")
STOPS, SHOUTS, BARS = _flag(b".,;:?"), _flag(b"!"), _flag(b"|")


class Features(NamedTuple):
    """Sparse rows: of row i, entries edges[i] to edges[i+1] of index and value."""

    edges: np.ndarray
    index: np.ndarray
    value: np.ndarray


def features(column: pa.Array, n_chars: np.ndarray) -> Features:
    data, offsets = tk.utf8(column)
    low = tk.lower_ascii(data)
    starts, ends, of = tk.spans(low, offsets)
    hashes = tk.hash_spans(low, starts, ends)
    found = counts(column)
    n, n_words = len(column), np.maximum(np.diff(of), 1)
    letters = np.maximum(_per_text(UPPER[data] | LOWER[data], offsets), 1)
    solid = np.maximum(found["word_chars"], 1)
    owner = _owners(of)
    repeated = np.zeros(len(hashes), bool)
    repeated[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    keys, tf = np.unique(owner * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), return_counts=True)
    row, distinct = keys // WORDS, np.bincount(keys // WORDS, minlength=n)
    lines = np.diff(tk.spans(data, offsets, NOT_NEWLINE)[2])
    share = lambda flags, of_what: _per_text(flags[data], offsets) / of_what
    dense = np.stack(
        [
            np.ones(n),
            np.log1p(np.diff(of)) / 8,
            found["word_chars"] / n_words / 10,
            share(UPPER, letters),
            share(DIGIT, solid) * 3,
            share(SYMBOLS, solid) * 3,
            share(STOPS, solid) * 3,
            share(SHOUTS, solid) * 3,
            share(BARS, n_words),
            found["n_dup_lines"] / np.maximum(lines, 1),
            found["n_repeat_words"] / n_words,
            np.bincount(owner[repeated], minlength=n) / n_words,
            distinct / n_words,
            lines / n_words * 3,
            (np.diff(offsets) - _per_text((data & 0xC0) != 0x80, offsets)) / solid,
            np.log1p(np.maximum(n_chars, 0)) / 12,
        ],
        1,
    )
    value = tf / np.sqrt(np.bincount(row, tf.astype(float) ** 2, minlength=n))[row]
    edges = np.concatenate([[0], np.cumsum(distinct + STATISTICS)])
    index, values = np.empty(edges[-1], np.int32), np.empty(edges[-1], np.float32)
    place = np.arange(len(row)) + row * STATISTICS
    index[place], values[place] = keys % WORDS, value
    dense_at = (edges[1:] - STATISTICS)[:, None] + np.arange(STATISTICS)
    index[dense_at], values[dense_at] = WORDS + np.arange(STATISTICS), dense
    return Features(edges, index, values)


class Model(NamedTuple):
    w: np.ndarray
    v: np.ndarray

    def logit(self, x: Features) -> tuple[np.ndarray, np.ndarray]:
        """The rows' values before the sigmoid, and their sums of v_if x_i."""
        if len(x.edges) == 1:
            return np.zeros(0), np.zeros((0, self.v.shape[1]))
        at = x.edges[:-1]
        each = self.v[x.index] * x.value[:, None]
        sums = np.add.reduceat(each, at)
        own = np.add.reduceat((each**2).sum(1), at)
        return np.add.reduceat(self.w[x.index] * x.value, at) + 0.5 * ((sums**2).sum(1) - own), sums

    def score(self, x: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x)[0], -30, 30)))


def fit(x: Features, y: np.ndarray, weight: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 3) -> Model:
    """Logistic loss, Adam steps over shuffled batches."""
    rng = np.random.default_rng(seed)
    size = WORDS + STATISTICS
    model = Model(np.zeros(size, np.float32), rng.normal(0, 0.01, (size, RANK)).astype(np.float32))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            rows = order[i : i + batch]
            lengths = x.edges[rows + 1] - x.edges[rows]
            edges = np.concatenate([[0], np.cumsum(lengths)])
            at = np.arange(edges[-1]) + np.repeat(x.edges[rows] - edges[:-1], lengths)
            part = Features(edges, x.index[at], x.value[at])
            logit, sums = model.logit(part)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            per = np.repeat(error, lengths) * part.value
            grad_v = per[:, None] * (np.repeat(sums, lengths, 0) - model.v[part.index] * part.value[:, None])
            touched, where = np.unique(part.index, return_inverse=True)
            grads = [np.bincount(where, per, len(touched)), np.stack([np.bincount(where, grad_v[:, f], len(touched)) for f in range(RANK)], 1)]
            step += 1
            for p, (m, s), g in zip(model, moments, grads, strict=True):
                g = g + decay * p[touched]
                m[touched] = 0.9 * m[touched] + 0.1 * g
                s[touched] = 0.999 * s[touched] + 0.001 * g * g
                p[touched] -= rate * (m[touched] / (1 - 0.9**step)) / (np.sqrt(s[touched] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(key) -> F.Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2


def _texts(docs: DataFrame) -> DataFrame:
    chars = F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)) if "n_chars" in docs.columns else F.lit(0.0)
    return docs.select("doc_id", "text", chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    share = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(share) < 2:
        return None
    few = [hashed_sample(known.where(f"quality = {c}"), "doc_id", per_class, share[c]) for c in (0, 1)]
    sample = _texts(docs).join(F.broadcast(few[0].union(few[1])), "doc_id").select("text", "n_chars", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end in tk.slices(b.column(0)):
                part = b.slice(start, end - start)
                x = features(part.column(0), part.column(1).to_numpy())
                cut = [slice(a, z) for a, z in zip(x.edges[:-1], x.edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x.index[s].tobytes() for s in cut], pa.binary()), pa.array([x.value[s].tobytes() for s in cut], pa.binary()), part.column(2)], names=["i", "v", "y"])

    rows = sorted((bytes(r.i), bytes(r.v), r.y) for r in sample.mapInArrow(run, "i binary, v binary, y int").collect())
    y = np.array([r[2] for r in rows], float)
    if len(set(y)) < 2:
        return None
    index, value = (np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in ((0, np.int32), (1, np.float32)))
    x = Features(np.concatenate([[0], np.cumsum([len(r[0]) // 4 for r in rows])]), index, value)
    weight = np.array([share[int(c)] / (y == c).sum() for c in y])
    return fit(x, y, weight * len(y) / weight.sum())


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, a row for each document."""
    model = train(docs, labels, per_class)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for start, end in tk.slices(b.column(1)):
                part = b.slice(start, end - start)
                scores = np.full(len(part), 0.5) if own is None else own.score(features(part.column(1), part.column(2).to_numpy()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores.astype(float))], names=["doc_id", "score"])

    scored = _texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
