"""Operator 4: toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the letters of words (five letters, the first four of them context) are estimated, one from
toxic and one from ordinary training documents. A document's score compares its log-likelihoods under both, per word, with
``NEUTRAL`` neutral words added so that short texts need more than one odd word; a logistic curve maps this to 0..1. The curve is
fitted on training documents that each were scored by models of the other ``PARTS`` - 1 parts of the training documents.

Backoff follows Kneser and Ney (lower orders count the different expressions that continue them). The two lowest orders are counted
over both classes together. Every expression of the training documents is evidence, and one that wasn't seen gets its likelihoods from the
longest ending that was.

Counts, contexts and likelihoods of all orders are tables (:func:`fitted`), worked out by joins and aggregations. To score, the tables of a model
are sent to the tasks as sorted arrays where they have at most ``MOST_ENTRIES`` rows, 24 bytes each; larger ones stay tables, and the
documents' words are joined to them (:func:`by_joins`). Both give the same scores.

Labels are only learned from rows for which ``crc32(doc_id) mod 3`` isn't 1; no other column than the text is scored.

Defined cases: a null text and one without letters are scored as neutral; a label row without a document, a null label and a null id are
not learned from; of several labels of an id the highest counts; without both classes in training every score is the share of toxic
labels (0 if there are none); repeated rows get equal scores; columns other than doc_id and text are not read; an empty table gives an empty
result; the time for a very long text grows with its length only.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import documents, ship, staged

ORDER = 5
#: Orders up to this one are shared by both classes.
SHARED = 2
DISCOUNT = 0.75
NEUTRAL = 20
PARTS = 4
THRESHOLD = 0.7
#: Word types that a task holds before it hands on its counts, and of a generation of those whose values a worker remembers.
HELD_WORDS = 200_000
KNOWN_WORDS = 120_000
#: A model of up to so many rows is sent to the tasks.
MOST_ENTRIES = 8_000_000
#: Up to so many labels are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000

_WORD = re.compile(r"[^\W\d_]+")
START, END = "^", "$"


def expressions(word: str) -> list[str]:
    """The five-letter windows of a word, one for each letter and one for its end."""
    padded = START * (ORDER - 1) + word + END
    return [padded[k : k + ORDER] for k in range(len(word) + 1)]


def count_expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, part, toxic) to (gram, part, toxic, n), summed by task."""
    words: dict[tuple[int, int], Counter] = defaultdict(Counter)

    def counted() -> Iterator[pa.RecordBatch]:
        for (part, toxic), types in words.items():
            sums: Counter = Counter()
            for word, n in types.items():
                for e in expressions(word):
                    sums[e] += n
            k = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([part] * k, pa.int32()), pa.array([toxic] * k, pa.int32()), pa.array(list(sums.values()), pa.int64())],
                ["gram", "part", "toxic", "n"],
            )
        words.clear()

    for batch in batches:
        texts = batch.column(0)
        for k, group in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            words[group].update(_WORD.findall((texts[k].as_py() or "").lower()))
        if sum(map(len, words.values())) > HELD_WORDS:
            yield from counted()
    yield from counted()


def by_class(value: Callable[[Column], Column]) -> list[Column]:
    """``value`` of the toxic, the ordinary and the common count, under their names."""
    return [value(F.col(c)).alias(c) for c in ("t", "o", "e")]


def grams(counts: DataFrame) -> DataFrame:
    """Counts of (model, gram) by class. Model -1 learns from all parts, the others from all but their own; ``e`` is the common count."""
    models = F.filter(F.array(*[F.lit(m) for m in range(-1, PARTS)]), lambda m: m != F.col("part"))
    each = counts.select("gram", "toxic", "n", F.explode(models).alias("model"))
    of = {k: F.sum(F.when(F.col("toxic") == v, F.col("n")).otherwise(0)).alias(k) for k, v in (("t", 1), ("o", 0))}
    return each.groupBy("model", "gram").agg(*of.values()).withColumn("e", F.col("t") + F.col("o"))


def contexts(rows: DataFrame, order: int) -> DataFrame:
    """(model, context, totals, what the context leaves to the lower order by class): null where a class hasn't seen it."""
    sums = rows.groupBy("model", F.substring("gram", 1, order - 1).alias("context")).agg(
        *[F.nullif(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in "to"], *[F.count(F.when(F.col(c) > 0, 1)).alias(f"kinds_{c}") for c in "to"]
    )
    return sums.select("model", "context", "total_t", "total_o", *[(DISCOUNT * F.col(f"kinds_{c}") / F.col(f"total_{c}")).alias(f"left_{c}") for c in "to"])


def fitted(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables of all models: likelihoods of all grams of one to five letters (model, gram, p_t, p_o), what contexts leave (model,
    context, left_t, left_o), and the likelihood of a letter that wasn't seen (model, least), a row per model."""
    rows = {ORDER: staged(grams(counts), "toxic-grams")}
    for order in range(ORDER - 1, 0, -1):
        ends = rows[order + 1].groupBy("model", F.substring("gram", 2, ORDER).alias("gram"))
        rows[order] = staged(ends.agg(*by_class(lambda c: F.count(F.when(c > 0, 1)))), "toxic-grams")
    least = staged(rows[1].groupBy("model").agg((1 / (F.greatest(F.lit(2), F.count("*")) + 1)).alias("least")), "toxic-least")
    before = least.select("model", F.lit("").alias("end"), F.col("least").alias("q_t"), F.col("least").alias("q_o"))
    likelihoods, lefts = [], []
    for order in range(1, ORDER + 1):
        own = rows[order] if order > SHARED else rows[order].select("model", "gram", F.col("e").alias("t"), F.col("e").alias("o"))
        left = staged(contexts(own, order), "toxic-contexts")
        keyed = own.withColumns({"context": F.substring("gram", 1, order - 1), "end": F.substring("gram", 2, order)})
        joined = keyed.join(left, ["model", "context"]).join(before, ["model", "end"])
        p = {f"p_{c}": F.when(F.col(f"total_{c}").isNull(), F.col(f"q_{c}")).otherwise(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"total_{c}") + F.col(f"left_{c}") * F.col(f"q_{c}")) for c in "to"}
        done = staged(joined.select("model", "gram", *[e.alias(c) for c, e in p.items()]), "toxic-likelihoods")
        before = done.select("model", F.col("gram").alias("end"), F.col("p_t").alias("q_t"), F.col("p_o").alias("q_o"))
        likelihoods.append(done)
        lefts.append(left.select("model", "context", "left_t", "left_o"))
    return reduce(DataFrame.unionByName, likelihoods), reduce(DataFrame.unionByName, lefts), least


class Lookup:
    """Values (two per key) by the 64-bit hashes of strings, as sorted arrays."""

    def __init__(self, table: DataFrame, key: str, values: list[str]):
        rows = table.select(F.xxhash64(key).alias("h"), *values).toArrow()
        keys = rows.column("h").to_numpy()
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = np.stack([rows.column(v).fill_null(1.0).to_numpy()[order] for v in values])

    def find(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which strings are there, and the values of those that are."""
        from xxhash import xxh64_intdigest

        if not len(self.keys):
            return np.zeros(len(strings), bool), np.zeros((2, 0))
        # Spark's xxhash64 of a string: the standard function with the seed 42 over its UTF-8 bytes
        hashes = np.array([xxh64_intdigest(x.encode(), 42) for x in strings], np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        there = self.keys[at] == hashes
        return there, self.values[:, at[there]]


class Model:
    """Log-likelihood ratios of expressions, seen or not."""

    def __init__(self, likelihoods: Lookup, lefts: Lookup, least: float):
        self.likelihoods, self.lefts, self.least = likelihoods, lefts, least

    def ratios(self, expressions: list[str]) -> np.ndarray:
        """The longest seen end, times what the contexts above it leave."""
        p, left = np.full((2, len(expressions)), self.least), np.ones((2, len(expressions)))
        waiting = np.arange(len(expressions))
        for order in range(ORDER, 0, -1):
            ends = [expressions[k][ORDER - order :] for k in waiting]
            there, values = self.likelihoods.find(ends)
            p[:, waiting[there]] = values
            waiting = waiting[~there]
            if not len(waiting):
                break
            known, values = self.lefts.find([end[:-1] for end, seen in zip(ends, there, strict=True) if not seen])
            left[:, waiting[known]] *= values
        p *= left
        return np.log(p[0] / p[1])


class Scorer:
    """Texts' log-likelihood ratios. It is broadcast: a Python worker keeps it, with the words it has seen, from task to task, and lets it go when Spark
    takes the broadcast back, which is before the worker's first task without it. Held by a module it would stay beside what later stages need."""

    def __init__(self, model: Model):
        self.model, self.words, self.older = model, {}, {}

    def learn(self, new: list[str]) -> None:
        found = [expressions(w) for w in new]
        kinds = {e: k for k, e in enumerate(dict.fromkeys(e for es in found for e in es))}
        ratios = self.model.ratios(list(kinds)).tolist()
        self.words.update((w, sum([ratios[kinds[e]] for e in es])) for w, es in zip(new, found, strict=True))

    def score(self, texts: list[str]) -> list[float]:
        """Mean ratios of a batch of texts; the words that it adds are looked up together."""
        if len(self.words) > KNOWN_WORDS:
            self.older, self.words = self.words, {}
        known, older, new, words = self.words, self.older, {}, []
        for text in texts:
            words.append(found := _WORD.findall(text.lower()))
            for w in found:
                if w not in known:
                    if (value := older.get(w)) is None:
                        new[w] = None
                    else:
                        known[w] = value
        if new:
            self.learn(list(new))
        return [sum(map(known.__getitem__, found)) / (len(found) + NEUTRAL) for found in words]


def scores(handed: Broadcast):
    """(id columns..., text) to (id columns..., x): the text's ratio. ``handed`` is a scorer."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = handed.value
        for batch in batches:
            last, k = batch.num_columns - 1, 0
            out: list[float] = []
            while k < batch.num_rows:  # some texts at a time, by size
                part, size = [], 0
                while k < batch.num_rows and size < 1 << 20:
                    part.append(batch.column(last)[k].as_py() or "")
                    k, size = k + 1, size + len(part[-1])
                out += scorer.score(part)
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(out, pa.float64())], [*batch.schema.names[:last], "x"])

    return rows


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text) to (k1, k2, word, n)."""
    for batch in batches:
        keys: list[list] = [[], [], [], []]
        for a, b, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            for word, n in Counter(_WORD.findall((text or "").lower())).items():
                for out, value in zip(keys, (a, b, word, n), strict=True):
                    out.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(keys, kinds, strict=True)], ["k1", "k2", "word", "n"])


def by_joins(docs: DataFrame, likelihoods: DataFrame, lefts: DataFrame, least: float) -> DataFrame:
    """``docs`` (id columns..., text) with x, where the model is too large to be sent: texts' words are joined to the words' values. A text
    is known by two hashes. A word of very many texts is split by Spark's adaptive skew join, its one value repeated."""
    keyed = docs.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    counted = staged(keyed.select("k1", "k2", "text").mapInArrow(word_counts, "k1 long, k2 long, word string, n long").groupBy("k1", "k2", "word").agg(F.max("n").alias("n")), "toxic-words")
    windows = F.transform(F.sequence(F.lit(1), F.char_length("word") + 1), lambda i: F.concat(F.lit(START * (ORDER - 1)), F.col("word"), F.lit(END)).substr(i, F.lit(ORDER)))
    of_words = staged(counted.select("word").distinct().select("word", F.explode(windows).alias("expression")), "toxic-windows")
    found = of_words.select("expression").distinct().withColumns({f"{k}_{c}": F.lit(v).cast("double") for k, v in (("p", None), ("l", 1.0)) for c in "to"})
    for order in range(ORDER, 0, -1):
        gram = F.substring("expression", ORDER - order + 1, order)
        seen = likelihoods.where(F.char_length("gram") == order).select(F.col("gram").alias("_gram"), F.col("p_t").alias("_t"), F.col("p_o").alias("_o"))
        found = found.join(seen, gram == F.col("_gram"), "left").withColumns({f"p_{c}": F.coalesce(f"p_{c}", F.col(f"l_{c}") * F.col(f"_{c}")) for c in "to"}).drop("_gram", "_t", "_o")
        left = lefts.where(F.char_length("context") == order - 1).select(F.col("context").alias("_gram"), F.col("left_t").alias("_t"), F.col("left_o").alias("_o"))
        found = found.join(left, F.substring("expression", ORDER - order + 1, order - 1) == F.col("_gram"), "left")
        found = found.withColumns({f"l_{c}": F.col(f"l_{c}") * F.coalesce(F.col(f"_{c}"), F.lit(1.0)) for c in "to"}).drop("_gram", "_t", "_o")
    p = {c: F.coalesce(F.col(f"p_{c}"), F.col(f"l_{c}") * least) for c in "to"}
    ratios = found.select("expression", F.log(p["t"] / p["o"]).alias("ratio"))
    values = of_words.join(ratios, "expression").groupBy("word").agg(F.sum("ratio").alias("value"))
    sums = counted.join(values.hint("merge"), "word").groupBy("k1", "k2").agg((F.sum(F.col("n") * F.col("value")) / (F.sum("n") + NEUTRAL)).alias("x"))
    return keyed.drop("text").join(sums, ["k1", "k2"], "left").drop("k1", "k2").withColumn("x", F.coalesce("x", F.lit(0.0)))


def rated(docs: DataFrame, tables: tuple[DataFrame, DataFrame, DataFrame], model: int, most: int, schema: str) -> DataFrame:
    """``docs`` (id columns..., text) to (id columns..., x) of ``schema``."""
    likelihoods, lefts, least = (t.where(F.col("model") == model) for t in tables)
    rest = least.first()["least"]
    if likelihoods.count() + lefts.count() > most:
        return by_joins(docs, likelihoods, lefts, rest).select(*[part.split()[0] for part in schema.split(", ")])
    held = Model(Lookup(likelihoods, "gram", ["p_t", "p_o"]), Lookup(lefts, "context", ["left_t", "left_o"]), rest)
    return docs.mapInArrow(scores(docs.sparkSession.sparkContext.broadcast(Scorer(held))), schema)


def remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, part, toxic) of the labelled documents that may be learned from, dealt into ``PARTS`` parts by their id."""
    usable = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .where(remainder() != 1)
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    )
    usable = staged(usable, "toxic-labels")
    if usable.count() <= BROADCAST_LABELS:
        usable = F.broadcast(usable)
    return docs.select("doc_id", "text").join(usable, "doc_id").select("text", "part", "toxic")


def curve(labelled: DataFrame) -> tuple[float, float]:
    """Intercept and slope of the logistic curve from x to the label; ``labelled`` is a stored table. Newton's steps, one aggregation each."""
    a, b = 0.0, 0.0
    for _ in range(25):
        p = 1 / (1 + F.exp(-(F.lit(a) + b * F.col("x"))))
        w, r = p * (1 - p), F.col("toxic") - p
        s = labelled.agg(*[F.sum(e) for e in (r, r * F.col("x"), w, w * F.col("x"), w * F.col("x") ** 2)]).first()
        # a slight pull towards a flat curve keeps the steps finite where the classes are apart
        g0, g1, h00, h01, h11 = s[0], s[1] - 1e-3 * b, s[2] + 1e-6, s[3], s[4] + 1e-3
        d = h00 * h11 - h01 * h01
        step_a, step_b = (h11 * g0 - h01 * g1) / d, (h00 * g1 - h01 * g0) / d
        size = max(abs(step_a) / 5, abs(step_b) / 50, 1)
        a, b = a + step_a / size, b + step_b / size
        if abs(step_a) + abs(step_b) < 1e-6:
            break
    return a, b


def toxicity(docs: DataFrame, labels: DataFrame, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """``docs`` (doc_id and text are read) to (doc_id, held_out, score, predicted). ``docs`` should be a stored table: it is read twice."""
    ship(docs.sparkSession)
    learned = staged(training(docs, labels), "toxic-learned")
    counts = staged(learned.mapInArrow(count_expressions, "gram string, part int, toxic int, n long").groupBy("gram", "part", "toxic").agg(F.sum("n").alias("n")), "toxic-counts")
    sizes = {(r.part, r.toxic): r.n for r in learned.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect()}
    toxic, ordinary = (sum(n for (_, kind), n in sizes.items() if kind == side) for side in (1, 0))
    held_out = F.coalesce(remainder() == 1, F.lit(False)).alias("held_out")
    if not toxic or not ordinary:
        share = F.lit(toxic / max(1, toxic + ordinary))
        return docs.select(F.col("doc_id").cast("long"), held_out, share.alias("score"), (share >= THRESHOLD).cast("int").alias("predicted"))
    tables = fitted(counts)
    # a part's documents are judged by the model of all other parts; one without other parts to learn from has no such model
    modelled = {r.model for r in tables[2].collect()}
    judged = [
        staged(rated(learned.where(F.col("part") == part).select("toxic", "text"), tables, part, most_entries, "toxic int, x double"), "toxic-judged")
        for part in range(PARTS)
        if part in modelled
    ]
    a, b = curve(reduce(DataFrame.unionByName, judged)) if judged else (0.0, 0.0)
    out = rated(docs.select(F.col("doc_id").cast("long"), held_out, "text"), tables, -1, most_entries, "doc_id long, held_out boolean, x double")
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
    return out.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
