"""Operator 5: n-gram Jaccard self-join with set-relation skipping.

A document's set holds the hashes of its five-word shingles; two documents link where the sets' Jaccard likeness is at least
``PERCENT``. The result is exact (up to 64-bit hashes):

1. Equal sets are one set: only its first document, the representative, is compared.
2. Tokens are ordered: those that are frequent in the corpus last, the rest by hash. Linked sets share a token among the first
   ``n - ceil(t n) + 1`` of each, so only these go to the index lists, and an entry carries its set's size and position.
3. A list is held in the order of sizes and positions. Blocks of sizes that can't link are skipped, positions tell which entries can be a
   pair's first common token (:data:`WITHIN`), and a pair is dropped if the tokens it shares in all lists can't make up the likeness.
4. Lists of frequent tokens are not paired. Each of their sets is compared with the list's first set alone, and the answers of the
   others are derived: two sets of one component need no comparison, nor do sets whose distances from the first differ by more than
   a link allows (the Jaccard distance is a metric). What is left is cut into blocks of one size, position and likeness to the first, and only
   entries of two blocks that pass all these tests are compared; other pairs are never made.
5. Links are joined to components.

Frequent tokens come from counts over all documents: each task reports the tokens that repeat among its documents. Only those whose
sum reaches ``max(FREQUENT, rows / 8192)`` are broadcast; as the sum over all tokens is at most all shingles, there
are no more than 8192 times the shingles of an average set. The order only needs to be the same everywhere, so a token that
escapes this count costs time and no result.

Entries of frequent tokens aren't shuffled by token, so a token that a third of all documents hold is no task's burden; the first document of each is
an aggregation, broadcast like the tokens themselves.

Defined cases: null and empty texts have no shingles and link with nothing; fewer than five words are one shingle; a null id
has no component; repeated rows link with each other; columns other than doc_id and text are not read; an empty table gives an empty result;
a very long text is one task's set, eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import documents, ship, staged
from barloom.llm.graph import components

SHINGLE = 5
PERCENT = 80
FREQUENT = 32
FREQUENT_SHARE = 8192
#: Lists of other tokens are paired up to this length; longer ones are treated like those of frequent tokens.
PAIRED = 1024
#: Tokens that a task counts at once.
COUNTED = 2_000_000
#: Up to so many ids are broadcast to pick their documents; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted different 64-bit hashes of the text's shingles, as signed numbers."""
    from xxhash import xxh3_64_intdigest

    # bytes.lower() and bytes.split() know A-Z and the six ASCII gaps only, as asked for
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < SHINGLE:
        return np.array([xxh3_64_intdigest(b"\0".join(words))], np.uint64).view(np.int64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    mixed = hashes[:n] * _MIX[0]
    for k in range(1, SHINGLE):
        mixed += hashes[k : n + k] * _MIX[k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX[4]
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def batch_of(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if not isinstance(c, pa.Array) else c for c in columns], names.split())


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to rows of documents (doc_id, n, key) and of tokens that repeat among a task's sets (token, seen)."""
    from xxhash import xxh3_128_digest

    names = "is_token doc_id n key token seen"

    def repeated(sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens, seen = np.unique(np.concatenate(sets), return_counts=True)
        tokens, seen = tokens[seen > 1], seen[seen > 1]
        return batch_of(names, np.ones(len(tokens), np.int64), pa.nulls(len(tokens), pa.int64()), pa.nulls(len(tokens), pa.int64()), pa.nulls(len(tokens), pa.binary()), tokens, seen)

    held, size, keys = [], 0, set()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        n, digests = [], []
        for k in range(len(ids)):
            tokens = shingle_set(texts[k].as_py())
            key = xxh3_128_digest(tokens.tobytes())
            n.append(len(tokens))
            digests.append(key)
            if len(tokens) and key not in keys:
                keys.add(key)
                held.append(tokens)
                size += len(tokens)
        yield batch_of(names, np.zeros(len(n), np.int64), ids, n, pa.array(digests, pa.binary()), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64()))
        if size >= COUNTED:
            yield repeated(held)
            held, size, keys = [], 0, set()
    if held:
        yield repeated(held)


def prefixes(frequent, percent: int):
    """(doc_id, text) to (doc_id, n, late, prefix): the set's first tokens, the ``late`` last of which are frequent."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequent.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes, late, starts, found = [], [], [0], []
            for k in range(len(ids)):
                tokens = shingle_set(texts[k].as_py())
                n = len(tokens)
                take = prefix_length(n, percent) if n else 0
                if n and len(common):
                    at = np.searchsorted(common, tokens)
                    is_common = common[np.minimum(at, len(common) - 1)] == tokens
                    rare = tokens[~is_common][:take]
                    tokens = np.concatenate([rare, tokens[is_common]])
                    late.append(max(0, take - len(rare)))
                else:
                    late.append(0)
                sizes.append(n)
                found.append(tokens[:take])
                starts.append(starts[-1] + take)
            values = np.concatenate(found) if found else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(late, pa.int64()), lists], ["doc_id", "n", "late", "prefix"])

    return rows


#: Whether a token at these positions (before it: ``at``) of sets of these sizes can be a linked pair's first common token.
WITHIN = "least(a.n - a.at, b.n - b.at) * (100 + {p}) >= {p} * (a.n + b.n)"
LISTED = "kind long, a long, b long, c long, d long"


def read_lists(percent: int, paired: int):
    """Index entries sorted by token and document to candidate pairs and to the entries of lists that are not paired.

    Entries are (token, doc, n * 2**32 + position, late * 2 + frequent). Rows out, by ``kind``:
    0: pair a, b; sizes c = n_a * 2**32 + n_b; d = the fewer of their frequent prefix tokens
    3: the same, but the token comes too late to be the first that a linked pair shares: it only counts as shared
    1: the first document a of an unpaired list and another one b
    2: entry of an unpaired list: token a, document b, c = n * 2**32 + position, d = 1 if the token isn't frequent
    A list that isn't paired is read as a stream; of others at most ``paired`` entries are held.
    """

    def pairs(group: np.ndarray) -> np.ndarray:
        group = group[:, np.argsort(group[2], kind="stable")]  # by size, then position
        n, at, late = group[2] >> 32, group[2] & 0xFFFFFFFF, group[3] >> 1
        # each entry meets those after it, up to the largest size that can link with its own
        counts = np.searchsorted(n, n * 100 // percent, side="right") - np.arange(len(n)) - 1
        i = np.repeat(np.arange(len(n)), counts)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
        room = np.minimum(n[i] - at[i], n[j] - at[j])
        kind = np.where(room * (100 + percent) >= percent * (n[i] + n[j]), 0, 3)
        a, b = np.where(group[1][i] < group[1][j], (i, j), (j, i))
        return np.stack([kind, group[1][a], group[1][b], n[a] << 32 | n[b], np.minimum(late[i], late[j])])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        streamed: tuple[int, int] | None = None  # token and first document of the unpaired list being read

        def unpaired(group: np.ndarray, out: list[np.ndarray]) -> None:
            nonlocal streamed
            if streamed is None or streamed[0] != group[0, 0]:
                streamed = (int(group[0, 0]), int(group[1, 0]))
            rest = group[1][group[1] != streamed[1]]
            out.append(np.stack([np.ones(len(rest), np.int64), np.full(len(rest), streamed[1]), rest, np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)]))
            out.append(np.stack([np.full(group.shape[1], 2), group[0], group[1], group[2], 1 - (group[3] & 1)]))

        def read(entries: np.ndarray, ended: bool) -> tuple[list[np.ndarray], np.ndarray | None]:
            out: list[np.ndarray] = []
            starts = np.flatnonzero(np.concatenate([[True], entries[0, 1:] != entries[0, :-1]]))
            sizes = np.diff(np.append(starts, entries.shape[1]))
            left = None
            if not ended:
                left = entries[:, starts[-1] :]
                starts, sizes = starts[:-1], sizes[:-1]
            goes_on = streamed is not None and len(starts) > 0 and entries[0, starts[0]] == streamed[0]
            frequent = entries[3, starts] & 1
            two = starts[(sizes == 2) & (frequent == 0) & ~(goes_on & (np.arange(len(starts)) == 0))]
            if len(two):
                x, y = entries[:, two], entries[:, two + 1]
                n_x, n_y = x[2] >> 32, y[2] >> 32
                room = np.minimum(n_x - (x[2] & 0xFFFFFFFF), n_y - (y[2] & 0xFFFFFFFF))
                kind = np.where(room * (100 + percent) >= percent * (n_x + n_y), 0, 3)
                keep = np.maximum(n_x, n_y) * percent <= np.minimum(n_x, n_y) * 100
                out.append(np.stack([kind, x[1], y[1], n_x << 32 | n_y, np.minimum(x[3], y[3]) >> 1])[:, keep])
            for k in np.flatnonzero((sizes > 2) | ((sizes == 2) & (frequent == 1)) | (goes_on & (np.arange(len(starts)) == 0))):
                group = entries[:, starts[k] : starts[k] + sizes[k]]
                if frequent[k] or sizes[k] > paired or (goes_on and k == 0):
                    unpaired(group, out)
                else:
                    out.append(pairs(group))
            if left is not None and (left[3, 0] & 1 or left.shape[1] > paired or (streamed is not None and streamed[0] == left[0, 0])):
                unpaired(left, out)
                left = None
            return out, left

        def given(out: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if out:
                table = np.concatenate(out, axis=1)
                for at in range(0, table.shape[1], 500_000):
                    yield batch_of("kind a b c d", *table[:, at : at + 500_000])

        for batch in batches:
            if batch.num_rows:
                entries = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                out, held = read(entries if held is None else np.concatenate([held, entries], axis=1), False)
                yield from given(out)
        if held is not None:
            yield from given(read(held, True)[0])

    return rows


def common_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both, either = [], []
        for k in range(batch.num_rows):  # one pair of sets at a time
            p, q = (np.frombuffer(batch.column(c)[k].as_py(), np.int64) for c in (2, 3))
            both.append(len(np.intersect1d(p, q, assume_unique=True)))
            either.append(len(p) + len(q) - both[-1])
        yield batch_of("a b both either", batch.column(0), batch.column(1), both, either)


def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        yield batch_of("doc_id tokens", batch.column(0), pa.array([shingle_set(texts[k].as_py()).tobytes() for k in range(batch.num_rows)], pa.binary()))


def compared(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b; a stored table) with the sizes of both sets' intersection and union."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = staged(ids, "join-ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    # pairs grow with the input, so they are never broadcast
    sets = docs.join(ids, "doc_id", "left_semi").mapInArrow(whole_sets, "doc_id long, tokens binary").hint("merge")
    first = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a")
    both = first.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
    return staged(both.select("a", "b", "x", "y").mapInArrow(common_tokens, "a long, b long, both long, either long"), "join-compared")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, frequent_least: int = FREQUENT, paired: int = PAIRED) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``docs`` (doc_id, text), a stored table: it is read up to four times."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    described = staged(docs.mapInArrow(describe, "is_token long, doc_id long, n long, key binary, token long, seen long"), "join-described")
    rows = described.where("is_token = 0").select("doc_id", "n", "key")
    least = max(frequent_least, rows.count() // FREQUENT_SHARE)
    counted = described.where("is_token = 1").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= least)
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in counted.select("token").collect()], np.int64)))

    firsts = staged(rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep")), "join-firsts")
    index = docs.where("doc_id IS NOT NULL").mapInArrow(prefixes(frequent, percent), "doc_id long, n long, late long, prefix array<long>")
    entries = index.join(firsts.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").select(
        F.posexplode("prefix").alias("at", "token"), "doc_id", "n", "late"
    )
    packed = entries.select(
        "token",
        "doc_id",
        (F.col("n") * (1 << 32) + F.col("at")).alias("placed"),
        (F.col("late") * 2 + (F.col("at") >= F.expr(prefix_sql("n", percent)) - F.col("late")).cast("long")).alias("late"),
    )
    packed = staged(packed, "join-entries")
    often = packed.where("late % 2 = 1")
    heads = F.broadcast(often.groupBy("token").agg(F.min("doc_id").alias("head")))
    zero = F.lit(0).cast("long")
    with_head = often.join(heads, "token").where("doc_id <> head").select(zero + 1, "head", "doc_id", zero, zero)
    of_often = often.select(zero + 2, "token", "doc_id", "placed", zero)
    lists = packed.where("late % 2 = 0").repartition("token").sortWithinPartitions("token", "doc_id").mapInArrow(read_lists(percent, paired), LISTED)
    listed = staged(lists.union(with_head).union(of_often), "join-listed")

    plain = listed.where("kind IN (0, 3)").groupBy("a", "b", "c", "d").agg(F.count("*").alias("shared"), F.min("kind").alias("kind")).where("kind = 0")
    late = listed.where("kind = 2 AND d = 1").groupBy("b").agg(F.count("*").alias("more"))
    plain = plain.select("a", "b", F.shiftright("c", 32).alias("n"), F.col("c").bitwiseAND(F.lit(0xFFFFFFFF)).alias("m"), (F.col("shared") + F.col("d")).alias("shared"))
    if not late.isEmpty():  # tokens of long lists that aren't frequent were not counted in pairs: allow for all of them
        plain = (
            plain.join(late.select(F.col("b").alias("a"), F.col("more").alias("more_a")), "a", "left")
            .join(late.select("b", F.col("more").alias("more_b")), "b", "left")
            .withColumn("shared", F.col("shared") + F.coalesce(F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0))), F.lit(0)))
        )
    after = f"greatest(n - ({prefix_sql('n', percent)}), m - ({prefix_sql('m', percent)}))"
    able = f"(shared + {after}) * {100 + percent} >= {percent} * (n + m)"
    pairs = plain.where(able).select("a", "b").unionByName(listed.where("kind = 1").select("a", "b")).distinct()
    pairs = staged(pairs, "join-pairs")
    results = compared(docs, pairs)
    links = results.where(F.col("both") * 100 >= F.col("either") * percent).select("a", "b")
    parts = staged(components(links), "join-parts")

    open_pairs = undecided(listed.where("kind = 2"), parts, results, percent).join(pairs, ["a", "b"], "left_anti")
    open_pairs = staged(open_pairs, "join-undecided")
    if not open_pairs.isEmpty():
        more = compared(docs, open_pairs).where(F.col("both") * 100 >= F.col("either") * percent).select("a", "b")
        parts = staged(components(links.unionByName(more)), "join-parts")

    placed = rows.where("n > 0").join(firsts, "key").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id")).unionByName(
        rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    )


def prefix_sql(n: str, percent: int) -> str:
    return f"{n} - ({percent} * {n} + 99) DIV 100 + 1"


def undecided(entries: DataFrame, parts: DataFrame, results: DataFrame, percent: int) -> DataFrame:
    """Pairs of unpaired lists that neither components nor distances from the list's first document decide.

    Entries are cut into blocks of one token, size, position and likeness (in twentieths); the blocks of a token are matched within a band of
    sizes, and only entries of matching blocks are paired.
    """
    placed = entries.select(F.col("a").alias("token"), F.col("b").alias("doc"), F.shiftright("c", 32).alias("n"), F.col("c").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at"))
    placed = placed.join(parts.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    several = placed.groupBy("token").agg(F.min("doc").alias("first"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    likeness = results.select(F.col("a").alias("first"), F.col("b").alias("doc"), (F.col("both") / F.col("either")).alias("likeness"))
    judged = placed.join(several.select("token", "first"), "token").join(likeness, ["first", "doc"], "left")
    judged = judged.withColumn("likeness", F.when(F.col("doc") == F.col("first"), 1.0).otherwise(F.col("likeness")))
    judged = staged(judged.withColumn("step", F.floor(F.col("likeness") * 20)), "join-judged")

    key = ["token", "n", "at", "step"]
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)
    blocks = judged.groupBy(*key).agg(*[f(c).alias(f"{name}_{c}") for c in ("component", "likeness") for name, f in (("low", F.min), ("high", F.max))])
    blocks = staged(blocks.withColumn("band", band), "join-blocks")
    a, b = blocks.alias("a"), blocks.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1))).alias("b")
    far = (100 - percent) / 100 + 1e-9
    # the larger one is a; of blocks of one size the later, or the same
    matching = f"""a.token = b.token AND a.band = b.band AND b.n * 100 >= {percent} * a.n AND {WITHIN.format(p=percent)}
        AND (a.n > b.n OR (a.n = b.n AND (a.at > b.at OR (a.at = b.at AND a.step >= b.step))))
        AND a.low_likeness - b.high_likeness <= {far} AND b.low_likeness - a.high_likeness <= {far}
        AND NOT (a.low_component = a.high_component AND b.low_component = b.high_component AND a.low_component = b.low_component)"""
    met = a.join(b, F.expr(matching)).select("a.token", *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "ab" for c in key[1:]])
    one, other = (judged.select("token", *[F.col(c).alias(f"{side}_{c}") for c in ("n", "at", "step", "doc", "component", "likeness")]) for side in "ab")
    both = met.join(one, ["token", "a_n", "a_at", "a_step"]).join(other, ["token", "b_n", "b_at", "b_step"])
    same = "a_n = b_n AND a_at = b_at AND a_step = b_step"
    kept = both.where(f"a_component <> b_component AND abs(a_likeness - b_likeness) <= {far} AND a_doc <> b_doc AND (NOT ({same}) OR a_doc < b_doc)")
    return kept.select(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b")).distinct()


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
