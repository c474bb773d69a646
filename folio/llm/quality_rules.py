"""Quality rules: counts over whole texts, and bands of zstandard compression ratios.

Repetitive text compresses too well, noise too badly. The ratio is compressed bytes over bytes, of the whole text and
of fixed chunks of it; the limits depend on the length in bytes, since short texts compress badly whatever they hold.
A text goes when its whole ratio is outside its band, or when chunks of more than `bad_share` of its bytes are.

The limits come from the table: a histogram of the ratios of all texts and chunks by length class (half a power of two)
and script (a third of the bytes outside ASCII, or not). A class's band is its median and `REACH` times the lesser
distance to a quartile on both sides, so neither junk of up to a quarter of a class nor its kind moves it far. A class
of fewer than LEAST_PIECES pieces takes its upper limit from the next shorter class that has them, its lower one from
the next longer (the ratio falls with the length), and fixed bands where there is none. Where most of a class is junk,
its band is junk's.

Defined cases: null and empty texts have no words and fail the base rule; very long texts are handled whole, in one
pass; repeated rows give repeated results; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from folio.llm import textkit as tk
from folio.llm.frames import for_workers, release

#: (bytes from, lowest ratio, highest ratio) of whole texts without limits from the table, by length; below the first length nothing is judged.
WHOLE_BANDS = ((120, 0.42, 1.20), (300, 0.33, 0.95), (1_000, 0.28, 0.80), (4_000, 0.22, 0.72), (16_000, 0.16, 0.68))
CHUNK_BYTES = 4_096
CHUNK_BAND = (0.14, 0.75)
LEAST_CHUNK = 1_024
BAD_SHARE = 0.5
LEVEL = 3
BINS, REACH, LEAST_SPREAD, LEAST_PIECES = 1_000, 8, 0.004, 40
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
NOT_NEWLINE = np.zeros(256, bool)
NOT_NEWLINE[10] = True
NUMPY = {"double": float, "boolean": bool}
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, ratio double, fits boolean, bad_chunk_share double"


def _per_text(flags_or_values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags_or_values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _owners(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _seen_again(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: there is an equal hash in the same text; there is one earlier in it."""
    keys = tk.mix(hashes ^ tk.mix(owners.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return twice, again


def counts(column: pa.Array, window: int = 8) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, offsets = tk.utf8(column)
    starts, ends, of = tk.spans(data, offsets)
    letters = _per_text(((data & 0xC0) != 0x80) & ~tk.SPACE[data], offsets)
    lines, line_ends, line_of = tk.spans(data, offsets, NOT_NEWLINE)
    solid = np.concatenate([[0], np.cumsum(~tk.SPACE[data])])
    filled = solid[line_ends] > solid[lines]
    owners = _owners(line_of)[filled]
    _, again = _seen_again(tk.hash_spans(data, lines[filled], line_ends[filled]), owners)
    runs, at = tk.windows(tk.hash_spans(data, starts, ends), of, window)
    run_owner = _owners(at)
    twice, _ = _seen_again(runs, run_owner)
    cover = np.zeros(len(starts) + 1, np.int64)
    first = (np.arange(len(runs)) - at[run_owner] + of[run_owner])[twice] if len(runs) else np.zeros(0, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + window, -1)
    return {
        "n_words": np.diff(of),
        "word_chars": letters,
        "n_symbols": _per_text(SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(owners[again], minlength=len(column)),
        "n_repeat_words": _per_text(np.cumsum(cover)[:-1] > 0, of),
        "n_bytes": np.diff(offsets),
    }


def piece_class(piece: np.ndarray) -> tuple[int, int]:
    """A text's or chunk's script and length class."""
    return int(3 * np.count_nonzero(piece & 0x80) > len(piece)), int(2 * math.log2(len(piece)))


def pieces(text: np.ndarray, squeeze: zstandard.ZstdCompressor, chunk: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, float]]:
    """A text that isn't empty and its ratio, then those of its chunks if it has several; shorter last chunks than LEAST_CHUNK aren't judged."""
    yield text, len(squeeze.compress(text.tobytes())) / len(text)
    if len(text) > chunk:
        for i in range(0, len(text), chunk):
            part = text[i : i + chunk]
            if len(part) >= LEAST_CHUNK:
                yield part, len(squeeze.compress(part.tobytes())) / len(part)


Limits = dict[tuple[int, int], tuple[float | None, float | None]]


def ratios(text: np.ndarray, squeeze: zstandard.ZstdCompressor, limits: Limits, bands=WHOLE_BANDS, band: tuple[float, float] = CHUNK_BAND) -> tuple[float, bool, float]:
    """The whole text's ratio (NaN if empty), whether it's in its band, and the share of its bytes in chunks outside theirs."""
    if not len(text):
        return math.nan, True, 0.0
    ratio, fits, bad = math.nan, True, 0
    for i, (piece, r) in enumerate(pieces(text, squeeze)):
        low, high = limits.get(piece_class(piece), (None, None))
        fixed = band if i else next((b[1:] for b in reversed(bands) if len(piece) >= b[0]), None)
        fit = fixed is None or (fixed[0] if low is None else low) <= r <= (fixed[1] if high is None else high)
        if i:
            bad += 0 if fit else len(piece)
        else:
            ratio, fits = r, fit
    return ratio, fits, bad / len(text)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        seen: Counter = Counter()
        for start, end in tk.slices(batch.column(0)):
            data, offsets = tk.utf8(batch.column(0).slice(start, end - start))
            for a, z in zip(offsets[:-1], offsets[1:], strict=True):
                if z > a:
                    seen.update((*piece_class(piece), int(BINS * r)) for piece, r in pieces(data[a:z], squeeze))
        yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in seen], pa.int32()) for i in range(3)], pa.array(seen.values(), pa.int64())], names=["script", "length", "bin", "n"])
    release()


def ratio_limits(docs: DataFrame) -> Limits:
    """Lowest and highest ratio by script and length class, None where no class gives one; from all texts of `docs` and their chunks."""
    rows = for_workers(docs.select("text")).mapInArrow(_histogram, "script int, length int, bin int, n long").groupBy("script", "length", "bin").agg(F.sum("n").alias("n")).collect()
    counted: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in rows:
        counted.setdefault((r["script"], r["length"]), []).append((r["bin"], r["n"]))
    own = {}
    for key, bins in counted.items():
        values, n = np.array(sorted(bins)).T
        if n.sum() >= LEAST_PIECES:
            q25, q50, q75 = ((values[np.searchsorted(np.cumsum(n), n.sum() * q)] + 0.5) / BINS for q in (0.25, 0.5, 0.75))
            reach = REACH * max(min(q50 - q25, q75 - q50), LEAST_SPREAD)
            own[key] = (float(q50 - reach), float(q50 + reach))
    limits: Limits = {}
    for script, length in counted:
        shorter = max((k for k in own if k[0] == script and k[1] <= length), default=None)
        longer = min((k for k in own if k[0] == script and k[1] >= length), default=None)
        limits[script, length] = (own[longer][0] if longer else None, own[shorter][1] if shorter else None)
    return limits


def measure(docs: DataFrame, text: int, keep_text: bool, limits: Limits, bands=WHOLE_BANDS) -> DataFrame:
    """The rows of `docs`, whose column number `text` is the text, with its measures; the text itself only if it is to be kept."""
    kept = [i for i in range(len(docs.columns)) if keep_text or i != text]
    fields = [docs.schema[i] for i in kept]
    measures = DataType.fromDDL(FIELDS).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for start, end in tk.slices(batch.column(text)):
                part = batch.slice(start, end - start)
                data, offsets = tk.utf8(part.column(text))
                judged = zip(*(ratios(data[a:z], squeeze, limits, bands) for a, z in zip(offsets[:-1], offsets[1:], strict=True)), strict=True)
                found = counts(part.column(text)) | dict(zip(("ratio", "fits", "bad_chunk_share"), map(np.array, judged), strict=True))
                columns = [part.column(i) for i in kept]
                columns += [pa.array(found[f.name].astype(NUMPY.get(f.dataType.typeName(), np.int64)), from_pandas=True) for f in measures]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in [*fields, *measures]])
        release()

    return for_workers(docs).mapInArrow(run, StructType([*fields, *measures]))


def quality_rules(docs: DataFrame, bands=WHOLE_BANDS, bad_share: float = BAD_SHARE, least_words: int = 20, most_repeat_percent: int = 30, keep_rows: bool = False) -> DataFrame:
    """doc_id, the counts, ratio, bad_chunk_share, base_failed, in_band and kept, a row for each document; with `keep_rows` instead of doc_id all input columns, as row_0, row_1, ..."""
    limits = ratio_limits(docs)
    if keep_rows:
        named = docs.toDF(*[f"row_{i}" for i in range(len(docs.columns))])
        measured = measure(named, docs.columns.index("text"), True, limits, bands)
    else:
        measured = measure(docs.select("doc_id", "text"), 1, False, limits, bands)
    in_band = F.col("fits") & (F.col("bad_chunk_share") <= bad_share)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    return measured.withColumns({"base_failed": failed, "in_band": in_band}).drop("fits").withColumn("kept", ~F.col("base_failed") & F.col("in_band"))


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns."""
    return quality_rules(docs, keep_rows=True, **options).where("kept").select(*[F.col(f"row_{i}").alias(c) for i, c in enumerate(docs.columns)])
