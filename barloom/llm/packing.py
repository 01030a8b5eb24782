"""Operator 2: best-fit packing of documents into token sequences by linear grouping.

Tokens are counted on the executors (Arrow batches; ids never leave the task, only lengths and checksums do). Pieces are
then dealt by hash into groups of about ``GROUP_ROWS`` rows, whatever the input's size, and each group is packed on
its own; a group of that size wastes a fraction of one sequence at most, which is under a thousandth.

In a group: pieces over a quarter of the capacity are large. Their lengths are cut, in order, into classes of equal
cardinality and rounded up to the class's longest. Configurations of the few rounded sizes are then optimised: the
longest class left is completed by the best filling combination of classes (a subset-sum table over bits), used as often
as the classes last. Actual pieces take the places of their class, and the small ones go, longest first, where
they fit best into the room that is really left.

Defined cases: a null or empty text is one piece holding the end id; only documents over the capacity are cut; repeated
rows are packed as often as they come, also those without an id; columns other than doc_id and text are not read; an empty table gives an
empty result. A very long text is encoded in its task: its ids, four bytes each, are what it needs besides itself.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import documents, ship, staged

CAPACITY = 4096
END_ID = 1
GROUP_ROWS = 8192
CLASSES = 16
#: Words of a generation of a worker's memory. Two generations are held, so words that keep coming stay known.
GENERATION = 300_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal int"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

#: str.split() takes these for white space, the tokenizer doesn't.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Lower-casing a whole string treats these otherwise than letter by letter.
_CASE = re.compile("[ΣİK]")
#: Latin letters and printable ASCII but the apostrophe. The tokenizer cuts such words, once lower-cased, into runs of letters, single digits and
#: runs of marks; its normal forms leave them alone.
_LATIN = re.compile("[!-&(-~À-ÖØ-öø-ɏ]+")
_PARTS = re.compile("[a-zÀ-ÖØ-öø-ɏ]+|[0-9]|[^a-z0-9À-ÖØ-öø-ɏ]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others numbered on from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Words(dict):
    """Ids of words: little-endian unsigned 32-bit, as bytes. Unknown words are worked out when they are asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, byte_letters()
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word) or self.learn(word)
        if len(self) >= GENERATION:
            self.older = dict(self)
            self.clear()
            self.parts.clear()
        self[word] = ids
        return ids

    def learn(self, word: str) -> bytes:
        if not _LATIN.fullmatch(word) or not _LATIN.fullmatch(lower := word.lower()):
            return self.whole(word)
        return b"".join([self.parts.get(part) or self.part(part) for part in _PARTS.findall(lower)])

    def part(self, part: str) -> bytes:
        seen = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        tokens = self.model.tokenize(seen)
        ids = self.parts[part] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class WordIds:
    """Ids of texts by a tokenizer that never joins over white space: each word is looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.words = Words(Tokenizer.from_file(path))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if "<|" in text or any(c in text for c in _SEPARATORS):  # special tokens are cut out before lower-casing
            return self.words.whole(text)
        lower = text.lower()
        if not (text.isascii() or (not _CASE.search(text) and is_normalized("NFC", text) and is_normalized("NFC", lower))):
            lower = text  # the tokenizer composes letters before it lower-cases them, so it gets these words as they stand
        return b"".join(map(self.words.__getitem__, lower.split()))


class Encoder:
    """A tokenizer's ids, read where they are first asked for. It is broadcast: what a Python worker has learned serves its later tasks too, and goes when
    Spark takes the broadcast back, which is before the worker's first task without it."""

    def __init__(self, path: str):
        self.path = path

    @cached_property
    def ids(self) -> WordIds:
        return WordIds(self.path)


def piece_rows(handed: Broadcast, capacity: int = CAPACITY):
    """A function for ``mapInArrow`` over (doc_id, text): one row per piece. ``deal`` tells equal rows of a task apart. ``handed`` is an encoder."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = handed.value.ids.encode
        end, deal = np.array([END_ID], dtype="<u4").tobytes(), 0
        for batch in batches:
            out: list[tuple] = []
            texts = batch.column(1)
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = ids_of(texts[k].as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), deal))
                    deal = (deal + 1) % 65536
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i in (1, 5) else pa.int64()) for i, c in enumerate(cols)], ["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    return rows


class Bins:
    """Open sequences by the room left in them; the best fit is the least room that is enough."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.mask = capacity, [[] for _ in range(capacity + 1)], 0
        self.count = 0

    def open(self) -> int:
        self.count += 1
        return self.count - 1

    def offer(self, number: int, room: int) -> None:
        self.rooms[room].append(number)
        self.mask |= 1 << room

    def best(self, length: int) -> tuple[int, int]:
        fitting = self.mask >> length
        if not fitting:
            return self.open(), self.capacity
        room = length + (fitting & -fitting).bit_length() - 1
        number = self.rooms[room].pop()
        if not self.rooms[room]:
            self.mask &= ~(1 << room)
        return number, room


def configuration(sizes: list[int], left: list[int], room: int) -> list[int]:
    """How many of each size (at most as many as are left) fill ``room`` best."""
    steps, reach = [], 1
    within = (1 << (room + 1)) - 1
    for k, size in enumerate(sizes):
        for _ in range(min(left[k], room // size)):
            steps.append((k, reach))
            reach |= (reach << size) & within
    used, at = [0] * len(sizes), reach.bit_length() - 1
    for k, before in reversed(steps):
        if not before >> at & 1:
            used[k] += 1
            at -= sizes[k]
    return used


def pack(lengths: np.ndarray, capacity: int = CAPACITY, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length (1 to ``capacity``)."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    large = order[lengths[order] > capacity // 4]
    groups = [g for g in np.array_split(large, min(classes, len(large))) if len(g)] if len(large) else []
    sizes = [int(lengths[g[0]]) for g in groups]
    waiting = [g.tolist() for g in groups]
    left = [len(g) for g in waiting]
    bins = Bins(capacity)
    length_of = lengths.tolist()
    for k, size in enumerate(sizes):
        while left[k]:
            left[k] -= 1
            used = configuration(sizes[k:], left[k:], capacity - size)
            used[0] += 1
            left[k] += 1
            times = min(left[k + j] // n for j, n in enumerate(used) if n)
            for j, n in enumerate(used):
                left[k + j] -= n * times
            for _ in range(times):
                number, at = bins.open(), 0
                for j, n in enumerate(used):
                    for _ in range(n):
                        row = waiting[k + j].pop()
                        sequence[row], offset[row] = number, at
                        at += length_of[row]
                bins.offer(number, capacity - at)
    for row in order[len(large) :].tolist():
        length = length_of[row]
        number, room = bins.best(length)
        sequence[row], offset[row] = number, capacity - room
        bins.offer(number, room - length)
    return sequence, offset


def pack_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32", "deal"], kind="stable")
    sequence, offset = pack(rows["length"].to_numpy())
    return rows.drop(columns=["_group", "deal"]).assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)


def pack_documents(docs: DataFrame, tokenizer_path: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with the sequence and offset each of them gets."""
    ship(docs.sparkSession)
    handed = docs.sparkSession.sparkContext.broadcast(Encoder(tokenizer_path))
    pieces = staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(piece_rows(handed), PIECES), "pack-pieces")
    groups = max(1, -(-pieces.count() // group_rows))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "deal"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(pack_group, PACKED)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
