"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton of the vocabulary finds, in one pass over a piece, the longest token at each position. The
encoder takes it if the pair of it and the token before is compatible (merging the two tokens' joined bytes gives just
these two), else the next shorter one, and steps back over the token before when none is left. Positions from which no
encoding leads on are marked, so no position is tried twice. The result is exactly what merging pairs in rank
order gives, since all neighbours of a true encoding are compatible and no other tiling has that property.

Most pieces need no step back: their leftmost longest matches, which the automaton gives in one pass, all fit together.
Pieces come from the pre-tokenising pattern of byte-level vocabularies; encodings of recent pieces, and of the parts
between spaces, are kept in two tables of two generations of at most `PIECES` entries for each Python worker: when the
newer one is full, the older one goes, so that frequent pieces stay. Known pairs are kept likewise, `PAIRS` at most.

The vocabulary is a file of the tokenizers library (JSON, byte-level BPE), found by name or path on the executors; it
is never trained or copied here. Special tokens standing in a text become their ids, as in the library's default.

Defined cases: null text counts as empty and has no ids; very long texts and pieces are encoded whole; repeated rows
give repeated results; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folio.llm.frames import for_workers, release

VOCABULARY = "byte_bpe_50k.json"
PIECES = 100_000
PAIRS = 120_000
#: A pair's key is one number, the left token's above so many bits.
BITS = 24
#: Rows handled at once.
ROWS = 500
#: Fixed value: how byte-level vocabularies of this kind part a text into pieces; white space is Unicode's property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def vocabulary_path(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in such files: itself where printable in Latin-1, else from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(0x100 + extra), extra + 1
    return out


class Recent:
    """A table of recent values: two generations of at most `most` entries; what is asked for moves to the newer one."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def keep(self, key, value):
        if len(self.new) >= self.most:
            self.new, self.old = {}, self.new
        self.new[key] = value
        return value

    def older(self, key):
        """The value of a key that the newer generation doesn't have; None if the older one hasn't either."""
        value = self.old.get(key)
        return value if value is None else self.keep(key, value)

    def clear(self) -> None:
        self.new, self.old = {}, {}


class Encoder:
    """One vocabulary, ready to encode pieces; each worker makes its own from the file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab: dict[str, int] = model["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"] if t["special"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for word, i in vocab.items():
            if word not in self.special:
                self.tokens[i] = bytes(byte_of[c] for c in word)
        # a merge's rank orders pairs; single letters rank below all merges
        self.made: dict[tuple[int, int], int] = {}
        self.rank = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        for r, (a, b) in enumerate(merges):
            whole = vocab[a + b]
            self.made[vocab[a], vocab[b]] = r
            if self.parts[whole] is None:
                self.rank[whole], self.parts[whole] = r, (vocab[a], vocab[b])
        self.automaton = ahocorasick.Automaton()
        for word, i in vocab.items():
            if word not in self.special:
                self.automaton.add_word(self.tokens[i].decode("latin-1"), (i, len(self.tokens[i]) - 1))
        self.automaton.make_automaton()
        self.size = [len(t) for t in self.tokens]
        self.longest_size = max(self.size)
        self.shorter = [self._next_shorter(t.decode("latin-1")) for t in self.tokens]
        self.compatible, self.seen, self.after_space = Recent(PAIRS), Recent(PIECES // 4), Recent(PIECES)
        self.alone: dict[int, bool] = {}
        self.mixed_space = regex.compile(r"^ | $| \p{White_Space}|\p{White_Space} ")
        self.pieces = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        self.marks = {c: self.encode_piece(c) for c in ".,;:!?\n"}
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in self.tokens])])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def _next_shorter(self, word: str) -> int:
        for end in range(len(word) - 1, 0, -1):
            if (found := self.automaton.get(word[:end], None)) is not None:
                return found[0]
        return -1

    def pair_fits(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives these two again.

        Both tokens are unmade from the last merge backwards along the edges that touch. If at some stage the two
        edge tokens would merge, earlier than the merge that replaced one of them, the boundary would have been lost.
        """
        pair = left << BITS | right
        known = self.compatible.new.get(pair)
        if known is None:
            known = self.compatible.older(pair)
        return self.compatible.keep(pair, self._pair_fits(left, right)) if known is None else known

    def _pair_fits(self, left: int, right: int, until: int | None = None) -> bool:
        a, b = left, right
        until = len(self.made) if until is None else until  # the merge that ends this stage, or the end
        replaced_right = False
        while True:
            joins = self.made.get((a, b))
            # of equal rank, the same merge at an earlier place goes first
            if joins is not None and (joins < until or joins == until and replaced_right):
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                until, a, replaced_right = ra, self.parts[a][1], False
            else:
                until, b, replaced_right = rb, self.parts[b][0], True

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        text = piece if piece.isascii() else piece.encode().decode("latin-1")  # a letter for each byte
        out, last, at, known, size = [], -1, 0, self.compatible.new, self.size
        for _, (token, _) in self.automaton.iter_long(text):
            if last >= 0:
                fits = known.get(last << BITS | token)
                if fits is None:
                    fits = self.pair_fits(last, token)
                if not fits:
                    return self._search(text, out, at, self.shorter[token])
            elif self.rank[token] >= 0 and not self._stands_alone(token):
                return self._search(text, out, 0, self.shorter[token])
            out.append(token)
            at += size[token]
            last = token
        if at < len(text):
            raise ValueError("a byte isn't in the vocabulary")
        return tuple(out)

    def _longest(self, text: str, at: int) -> int:
        """The longest token that starts at a position: the automaton's longest path there, less letters that end no token."""
        part = text[at : at + self.longest_size]
        for end in range(self.automaton.longest_prefix(part), 0, -1):
            if (found := self.automaton.get(part[:end], None)) is not None:
                return found[0]
        raise ValueError("a byte isn't in the vocabulary")

    def _stands_alone(self, token: int) -> bool:
        """Whether merging a token's bytes gives the token: its two parts fit together until their own merge, and each stands alone."""
        known = self.alone.get(token)
        if known is None:
            a, b = self.parts[token]
            known = self.alone[token] = self._pair_fits(a, b, self.rank[token]) and all(self.rank[x] < 0 or self._stands_alone(x) for x in (a, b))
        return known

    def _search(self, text: str, out: list[int], at: int, token: int) -> tuple[int, ...]:
        """Goes on at position `at` with `token`, then shorter ones; from a position that no encoding leads on from, back over the token before."""
        n, size, shorter, rank, known = len(text), self.size, self.shorter, self.rank, self.compatible.new
        alive = bytearray(b"\1") * (n + 1)
        last = out[-1] if out else -1
        while True:
            while token >= 0:
                end = at + size[token]
                if alive[end]:
                    if last < 0:
                        fits = rank[token] < 0 or self._stands_alone(token)
                    else:
                        fits = known.get(last << BITS | token)
                        if fits is None:
                            fits = self.pair_fits(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == n:
                    return tuple(out)
                last, at, token = token, end, self._longest(text, end)
            else:
                alive[at] = 0
                token = out.pop()
                at -= size[token]
                token, last = shorter[token], out[-1] if out else -1

    def encode(self, text: str) -> list[int]:
        if self.specials is not None and any(s in text for s in self.special):
            parts = self.specials.split(text)
            return [i for p in parts for i in ([self.special[p]] if p in self.special else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[int]:
        """Where no space stands at an edge or beside other white space, each space begins a piece, so that the parts between spaces are encoded, and kept, each by itself."""
        if not text:
            return []
        if self.mixed_space.search(text):
            return list(self._by_pieces(text))
        first, *rest = text.split(" ")
        found = [*map(self.after_space.new.get, rest)]
        if None in found:
            found = [self._after_space(word) if ids is None else ids for ids, word in zip(found, rest, strict=True)]
        return list(chain(self._by_pieces(first), chain.from_iterable(found)))

    def _after_space(self, word: str) -> tuple[int, ...]:
        """The ids of a space and a part between spaces. Letters alone are one piece with the space; a mark after them is one of its own, and isn't kept with them."""
        if not word.isalpha():
            mark = self.marks.get(word[-1:])
            if mark is not None and word[:-1].isalpha():
                stem = word[:-1]
                return (self.after_space.new.get(stem) or self._after_space(stem)) + mark
            left, line_feed, right = word.partition("\n")
            if left and right and not right[0].isspace() and not left[-1].isspace():  # a line feed by itself is a piece
                return (self.after_space.new.get(left) or self._after_space(left)) + self.marks[line_feed] + self._by_pieces(right)
            return self.after_space.older(word) or self.after_space.keep(word, self._by_pieces(" " + word))
        return self.after_space.older(word) or self.after_space.keep(word, self.encode_piece(" " + word))

    def _by_pieces(self, text: str) -> tuple[int, ...]:
        known = self.seen.new
        found = [known.get(p) or self.seen.older(p) or self.seen.keep(p, self.encode_piece(p)) for p in self.pieces.findall(text)]
        return found[0] if len(found) == 1 else tuple(chain.from_iterable(found))

    def forget(self) -> None:
        """Free the tables of recent pieces; workers outlive the stage that filled them."""
        for table in (self.seen, self.after_space, self.compatible):
            table.clear()

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        first, size = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(first - ends + size, size)
        return self.bytes[at].tobytes().decode("utf-8", "replace")


@functools.cache
def encoder(name: str) -> Encoder:
    return Encoder(vocabulary_path(name))


def _encoded(own: Encoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' ids in a row, and the offsets of each text in them."""
    ids = [np.array(own.encode(t or ""), np.int32) for t in texts.to_pylist()]
    return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)


def _decoded(own: Encoder, flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.array([own.decode(flat[a:b].astype(np.int64)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """key and ids (array of int), a row for each row of `docs`; with `decode` also decoded, the text that the ids stand for, made in the same workers."""
    names = [key, "ids", *(["decoded"] if decode else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part = batch.slice(start, ROWS)
                flat, offsets = _encoded(own, part.column(1))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, *([_decoded(own, flat, offsets)] if decode else [])], names=names)
        own.forget()
        release()

    fields = f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>" + (", decoded string" if decode else "")
    return for_workers(docs).select(key, text).mapInArrow(run, fields)


def decode_ids(encoded: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """key, ids and the decoded text of each row of `encoded`; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part = batch.slice(start, ROWS)
                column = part.column(1)
                flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                yield pa.RecordBatch.from_arrays([part.column(0), column, _decoded(own, flat, offsets)], names=[key, "ids", "decoded"])

    return for_workers(encoded).select(key, "ids").mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, ids array<int>, decoded string")
