"""Operator 12: two tokenizers' tokens aligned by bytes, and how often each pair of ids stands together, by external spill counting.

A text's tokens are cut into groups where tokens of both sides end; the A and B tokens that end at one byte are a link. Each document's links
are weighed by how often their id pair is linked in the whole corpus, and by whether that is the B id's most frequent pair.

1. Tasks tokenize, and gather records (pair, document, times). After ``RECORDS`` of them a chunk is closed: its records are sorted by radix (the B id's low
   bits), B id, A id and document, and leave as one zstd run for each radix. A run has a head (each pair's total) and a body (its documents).
2. The heads of ``FAN_IN`` chunks of one radix are merged by a heap, which adds up each pair; a pair's sums from all of them are one small aggregation. In the
   order of B ids the largest count of each is found.
3. Each merged group of runs gets its pairs' corpus-wide counts back and streams them, run by run and B id by B id, to the documents of its chunks.

What is sorted, merged or held is bounded by ``RECORDS`` and ``FAN_IN``; a pair that all documents hold is one record a document and spread over all groups, and
one row for each group where counts meet. What the corpus gives (the records) grows with the texts.

Defined cases: texts that are null, empty, or whose tokens on either side don't give back the text after a space have no tokens: zeros and an empty
digest; repeated rows count as often as they come, also those without an id; columns other than doc_id and text aren't read; an empty
table gives an empty result; a very long text is one task's work and may make a chunk larger by its own different pairs.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import documents, ship, staged
from barloom.llm.packing import byte_letters

#: Records of a chunk, its documents (20 bits), runs that a merge reads, and radixes (3 bits).
RECORDS, CHUNK_DOCS, FAN_IN, RADIXES = 500_000, 1 << 20, 16, 8
#: Bits of an id in a pair: B id << 20 | A id.
ID_BITS = 20
GIVEN = "chunk long, ordinal int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, radix int, head binary, body binary"

#: Fixed value: how tokenizer A cuts texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_BYTE = re.compile("<0x([0-9A-F]{2})>")
_SPACE = "▁"


@dataclass
class Alignment:
    """Ids of both sides, and how many of them stand before the end of each group."""

    a: np.ndarray
    b: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray

    def links(self) -> np.ndarray:
        """Pairs of ids that end together. No token is empty, so these are the last ones of each group."""
        return self.b[self.b_cuts - 1] << ID_BITS | self.a[self.a_cuts - 1]

    def groups(self) -> list[tuple[list[int], list[int]]]:
        a, b = np.split(self.a, self.a_cuts[:-1]), np.split(self.b, self.b_cuts[:-1])
        return [(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]


class Aligner:
    """Aligns texts by a byte-level tokenizer A over space and text, and a sentence-piece tokenizer B that adds the space itself."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        read = Tokenizer.from_file(a_path)
        of_letter = {letter: byte for byte, letter in byte_letters().items()}
        specials = {t.content for t in read.get_added_tokens_decoder().values()}
        ranks = {bytes(of_letter[c] for c in token): k for token, k in read.get_vocab(with_added_tokens=True).items() if token not in specials}
        # ids stand in the order of the merges, so they are ranks; special tokens' strings are then ordinary text
        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.a_bytes[k] = token
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(_SPACE, " ").encode() for p in pieces]
        if b"" in ranks or b"" in self.b_bytes:
            raise ValueError("a token is empty")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        #: How ids are written within a group and at its end, A ids before B ids.
        self.names = [f"{k}{sign}" for side, signs in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for sign in signs for k in range(len(side))]

    def align(self, text: str | None) -> Alignment | None:
        """None for a text without tokens."""
        if not text:
            return None
        raw, a, b = f" {text}".encode(), self.a.encode_ordinary(f" {text}"), self.b.encode(text)
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        at = np.searchsorted(b_ends, a_ends)
        both = b_ends[at] == a_ends
        return Alignment(a, b, np.flatnonzero(both) + 1, at[both] + 1)

    def written(self, x: Alignment) -> str:
        """``a1,a2|b1;a3|b2,b3``"""
        n, m = len(self.a_bytes), len(self.b_bytes)
        a_end, b_end = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
        a_end[x.a_cuts - 1] = b_end[x.b_cuts - 1] = 1
        out = np.empty(len(x.a) + len(x.b), np.int64)
        # before an A token stand the B tokens of earlier groups; before a B token also the A tokens of its own
        out[np.arange(len(x.a)) + np.append(0, x.b_cuts)[np.cumsum(a_end) - a_end]] = x.a + a_end * n
        out[np.arange(len(x.b)) + x.a_cuts[np.cumsum(b_end) - b_end]] = x.b + b_end * m + 2 * n
        return "".join(map(self.names.__getitem__, out.tolist()))[:-1]


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker."""
    return Aligner(a_path, b_path)


def narrowed(x: np.ndarray) -> np.ndarray:
    """The same numbers (none is negative) in the fewest bytes."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def packed(*arrays: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    for x in arrays:
        np.save(buffer, narrowed(x))
    return zstandard.compress(buffer.getvalue(), 3)


def unpacked(blob: bytes, n: int) -> list[np.ndarray]:
    buffer = io.BytesIO(zstandard.decompress(blob))
    return [np.load(buffer).astype(np.int64) for _ in range(n)]


class Chunk:
    """Records of documents until they leave as sorted runs."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = self.docs = 0

    def add(self, links: np.ndarray | None) -> int:
        """Take a document's links; its number in the chunk."""
        if links is not None:
            keys, times = np.unique(links, return_counts=True)
            self.keys.append(keys << ID_BITS | self.docs)
            self.times.append(times)
            self.size += len(keys)
        self.docs += 1
        return self.docs - 1

    def runs(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(radix, head, body), each sorted by B id, A id and document."""
        if not self.size:
            return
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        radix = (keys >> 2 * ID_BITS) & (RADIXES - 1)
        order = np.argsort(radix << 3 * ID_BITS | keys)
        keys, times, radix = keys[order], times[order], radix[order]
        cuts = np.searchsorted(radix, np.arange(RADIXES + 1))
        for r in range(RADIXES):
            k, t = keys[cuts[r] : cuts[r + 1]], times[cuts[r] : cuts[r + 1]]
            if len(k):
                pairs = k >> ID_BITS
                starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
                yield r, packed(pairs[starts], np.diff(np.append(starts, len(k))), np.add.reduceat(t, starts)), packed(k & ((1 << ID_BITS) - 1), t)


def gather(a_path: str, b_path: str, records: int):
    """(doc_id, text) to a row per document and the runs of the task's chunks."""
    names = [x.split()[0] for x in GIVEN.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in GIVEN.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, number, chunk = aligner(a_path, b_path), TaskContext.get().partitionId() << 24, Chunk()

        def closed() -> list[tuple]:
            return [(number, None, None, None, None, None, None, None, *run) for run in chunk.runs()]

        for batch in batches:
            out, texts = [], batch.column(1)
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                got, told = tool.align(texts[k].as_py()), (0, 0, 0, 0, "")
                if got:
                    told = (len(got.a), len(got.b), len(got.a_cuts), len(got.a_cuts), hashlib.sha256(tool.written(got).encode()).hexdigest())
                out.append((number, chunk.add(got.links() if got else None), doc_id, *told, None, None, None))
                if chunk.size >= records or chunk.docs >= CHUNK_DOCS:
                    out += closed()
                    number, chunk = number + 1, Chunk()
            yield table(out)
        yield table(closed())

    return rows


def merged(heads: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """(pair, total) in side-major order from runs of (pairs, totals), by a heap of the runs' next pairs."""
    runs = [(keys.tolist(), sums.tolist()) for keys, sums in heads]
    heap = [(keys[0], r, 0) for r, (keys, _) in enumerate(runs) if keys]
    heapq.heapify(heap)
    pair, total = None, 0
    while heap:
        key, r, k = heap[0]
        if key != pair:
            if pair is not None:
                yield pair, total
            pair, total = key, 0
        keys, sums = runs[r]
        total += sums[k]
        if k + 1 < len(keys):
            heapq.heapreplace(heap, (keys[k + 1], r, k + 1))
        else:
            heapq.heappop(heap)
    if pair is not None:
        yield pair, total


def count_runs(key: tuple, runs: pd.DataFrame) -> pd.DataFrame:
    heads = [(pairs, sums) for pairs, _, sums in (unpacked(h, 3) for h in runs["head"])]
    rows = np.array(list(merged(heads)), np.int64).reshape(-1, 2)
    return pd.DataFrame({"radix": np.full(len(rows), key[0], np.int32), "fan": np.full(len(rows), key[1], np.int64), "pair": rows[:, 0], "n": rows[:, 1]})


def give_back(runs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Each run's documents with what their links of this radix count."""
    answers = answers.sort_values("pair")
    pairs, count, best = (answers[c].to_numpy(np.int64) for c in ("pair", "n", "best"))
    out = []
    for chunk, head, body in zip(runs["chunk"], runs["head"], runs["body"], strict=True):
        keys, lengths, _ = unpacked(head, 3)
        docs, times = unpacked(body, 2)
        at = np.searchsorted(pairs, keys)  # both stand in side-major order
        seen, sums = np.unique(docs, return_inverse=True)
        n_best, count_sum = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
        np.add.at(n_best, sums, times * np.repeat(best[at], lengths))
        np.add.at(count_sum, sums, times * np.repeat(count[at], lengths))
        out.append(pd.DataFrame({"chunk": chunk, "ordinal": seen.astype(np.int32), "n_best": n_best, "count_sum": count_sum}))
    return pd.concat(out) if out else pd.DataFrame({"chunk": [], "ordinal": [], "n_best": [], "count_sum": []})


def pair_counts(counted: DataFrame) -> DataFrame:
    """(pair, n, best) over the corpus from the merged groups' (pair, n); ``best`` is 1 for the most frequent pairs of a B id."""
    totals = staged(counted.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.shiftright("pair", ID_BITS)), "align-totals")
    most = totals.groupBy("b").agg(F.max("n").alias("most"))
    return totals.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, records: int = RECORDS, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    given = staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(gather(a_path, b_path, records), GIVEN), "align-runs")
    texts = given.where("radix IS NULL").select("chunk", "ordinal", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    runs = given.where("radix IS NOT NULL")
    fans = max(1, math.ceil(runs.count() / RADIXES / fan_in))
    runs = runs.withColumn("fan", F.pmod(F.xxhash64("chunk"), F.lit(fans)))
    counted = staged(runs.select("radix", "fan", "head").groupBy("radix", "fan").applyInPandas(count_runs, "radix int, fan long, pair long, n long"), "align-counted")
    answers = counted.select("radix", "fan", "pair").join(pair_counts(counted.select("pair", "n")), "pair")
    back = runs.select("radix", "fan", "chunk", "head", "body").groupBy("radix", "fan").cogroup(answers.groupBy("radix", "fan"))
    weighed = back.applyInPandas(give_back, "chunk long, ordinal int, n_best long, count_sum long")
    sums = weighed.groupBy("chunk", "ordinal").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return texts.join(sums, ["chunk", "ordinal"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
