"""What Python workers keep after an operator's tasks."""

import gc
import time

import pyarrow as pa
import pytest

from barloom.llm import packing, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")


def kept_by_workers(spark):
    """Names of the operators' own objects that any of the session's workers still holds in a task of another kind."""

    def look(batches):
        names = {type(o).__name__ for o in gc.get_objects()} & {"Scorer", "Model", "WordIds", "Words"}
        time.sleep(0.5)  # so that all workers get a task
        yield from (pa.RecordBatch.from_arrays([pa.array(sorted(names), pa.string())], ["name"]) for _ in batches)

    return {r.name for r in spark.range(0, 8, 1, 8).mapInArrow(look, "name string").collect()}


def test_workers_let_words_and_models_go_with_the_next_task(spark):
    """An operator's memory would else stay beside what later stages of the pipeline need, in every worker."""
    docs = spark.createDataFrame([(k, f"ba ko w{k}") for k in range(40)], "doc_id long, text string").repartition(8)
    likelihoods = spark.createDataFrame([(-1, "a", 0.5, 0.25)], "model int, gram string, p_t double, p_o double")
    lefts = spark.createDataFrame([(-1, "", 0.5, 0.5)], "model int, context string, left_t double, left_o double")
    least = spark.createDataFrame([(-1, 0.1)], "model int, least double")
    scored = toxicity.rated(docs, (likelihoods, lefts, least), -1, 100, "doc_id long, x double").collect()
    assert len(scored) == 40 and all(r.x > 0 for r in scored)
    assert kept_by_workers(spark) == set()
    assert len(packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()) == 40
    assert kept_by_workers(spark) == set()
