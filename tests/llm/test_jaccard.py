"""The Jaccard join against brute force, with small bounds so that every path is taken."""

import random

import pytest

from barloom.llm.jaccard import jaccard_components


def brute(texts):
    def shingles(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in words.translate(dict.fromkeys(map(ord, "\t\n\r\x0b\x0c"), " ")).split(" ") if w]
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()

    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passages = [[rng.choice(words) for _ in range(rng.randint(6, 40))] for _ in range(6)]
    bases = [[rng.choice(words) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    texts = {}
    for k in range(n):
        kind = rng.random()
        if kind < 0.55:
            text = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
        elif kind < 0.8:
            text = rng.choice(passages) + rng.choice(passages) + [rng.choice(words) for _ in range(rng.choice([0, 0, 1, 3]))]
        else:
            text = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        text = rng.choice([" ", "\n", "  "]).join(text)
        texts[k * 3 + 1] = text.upper() if rng.random() < 0.1 else text
    texts |= {1000: None, 1001: "", 1002: " \n ", 1003: "one two", 1004: "ONE  two", 1005: " ", 1006: "É é", 1007: "é é"}
    return texts


@pytest.mark.parametrize(("seed", "least", "paired"), [(1, 2, 3), (2, 6, 1000), (3, 10**9, 2), (4, 10**9, 1000), (5, 3, 2)])
def test_components_equal_brute_force(spark, seed, least, paired):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, frequent_least=least, paired=paired).collect()}
    assert got == brute(texts)


def test_empty_table_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(none).collect() == []
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"), (9, None)]
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(d, n) for d, n, _ in got] == [(-1, 2), (3, 2), (5, 2), (5, 2), (9, 0)]
    assert [c for d, _, c in got] == [None, 3, 3, 3, 9]


def test_boilerplate_that_does_not_link_makes_no_pairs(spark, monkeypatch):
    """Many sets that share 31 of 35 shingles, next to the limit: blocks are skipped by position, so no pair of them is compared."""
    from barloom.llm import jaccard

    words = [f"c{k}" for k in range(35)]
    docs = spark.createDataFrame([(k, " ".join([*words, *(f"own{k}x{j}" for j in range(4))])) for k in range(3000)], "doc_id long, text string").repartition(4)
    seen = []
    compared = jaccard.compared

    def counting(docs, pairs):
        seen.append(pairs.count())
        return compared(docs, pairs)

    monkeypatch.setattr(jaccard, "compared", counting)
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == 3000 and all(r.component_id == r.doc_id and r.n_shingles == 35 for r in got)
    assert sum(seen) < 5 * 3000


def test_blocks_keep_every_link_of_a_frequent_list(spark):
    """Sets around a common core, of many sizes: what a list's first set can't decide is compared."""
    rng = random.Random(21)
    core = [f"c{k}" for k in range(40)]
    texts = {}
    for k in range(220):
        own = [f"o{rng.randint(0, 9)}y{j}" for j in range(rng.randint(0, 9))]
        texts[k] = " ".join(core[rng.randint(0, 3) : 40 - rng.randint(0, 3)] + own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, frequent_least=5, paired=8).collect()}
    assert got == brute(texts)


def test_query_with_very_long_text_and_clashing_columns(spark, tmp_path):
    from barloom.llm.jaccard import op5_jaccard

    rng = random.Random(22)
    long = [f"w{rng.randint(0, 10**6)}" for _ in range(120_000)]
    texts = {1: " ".join(long), 2: " ".join(long[:100_000]), 3: " ".join(long[:80_000]), 4: None, 5: "a b", 6: "A  b"}
    rows = [(k, t, 1, 2) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, n int, token int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_jaccard(spark, str(tmp_path)).collect()}
    assert got == brute(texts)
