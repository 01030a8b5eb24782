"""The containment join by rarest grams against plain searching, its plan, and headlines by words."""

import os
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import joins, news

DATA = "/root/testdata/sf0.001"
SYLLABLES = ["ab", "ra", "tion", "é", "o", " ", "- ", "TCS", "ing", "日本", "\n"]


def corpus(seed):
    rng = random.Random(seed)

    def some(n):
        return "".join(rng.choice(SYLLABLES) for _ in range(n))

    names = [(k, some(rng.randint(1, 3)), some(2) + " x", rng.choice(["ration", "tion", None, "in", "  ing"])) for k in range(60)]
    texts = [(k, some(rng.randint(0, 12))) for k in range(300)] + [(900, None), (901, ""), (902, "ab"), (903, "abra"), (903, "abra")]
    return texts, names


def words_of(name):
    """The words of a name as they count: ticker from 3 characters, first word from 4, sector from 3."""
    _, symbol, title, sector = name
    held = [(symbol.lower(), 3), (title.lower().split(" ")[0], 4), ((sector or "").lower(), 3)]
    return [w if len(w) >= n else None for w, n in held]


@pytest.mark.parametrize("at_once", [100_000, 7], ids=["one part", "parts"])
def test_containing_equals_plain_searching(spark, monkeypatch, at_once):
    monkeypatch.setattr(joins, "NAMES", at_once)
    texts, names = corpus(3)
    df = spark.createDataFrame(texts, "id long, title string").repartition(3)
    universe = spark.createDataFrame(names, "rank int, symbol string, name string, sector string")
    words = [(F.lower("symbol"), 3), (F.lower(F.split("name", " ")[0]), 4), (F.lower("sector"), 3)]
    got = sorted((r.id, r.rank, r._kind) for r in joins.containing(df, universe, "rank", words).collect())
    want = []
    for i, title in texts:
        for name in names:
            kinds = [k for k, w in enumerate(words_of(name)) if w is not None and title is not None and w in title.lower()]
            want += [(i, name[0], kinds[0])] if kinds else []
    assert got == sorted(want) and len({k for *_, k in got}) == 3


def test_tags_and_sentiment_equal_plain_loops(spark):
    texts, names = corpus(5)
    texts = [t for t in texts if t[0] != 903]
    universe = spark.createDataFrame([(k, f"{s}{k}", n, c) for k, s, n, c in names], "rank int, symbol string, name string, sector string")
    df = spark.createDataFrame([(k, t, "s", f"u{k}") for k, t in texts], "id long, title string, source string, url string")
    held = {k: words_of((k, f"{s}{k}", n, c)) for k, s, n, c in names}
    tags = {r.id: r.affected for r in joins.tag_headlines(df, universe).collect()}
    for k, t in texts:
        first = next((n for n in sorted(held) if any(w and t and w in t.lower() for w in held[n][:2])), None)
        assert tags[k] == (None if first is None else f"{names[first][1]}{first}")
    marked = df.select("id", "title", F.when(F.col("id") % 3 == 0, "HIGH").otherwise("LOW").alias("impact"), F.when(F.col("id") % 2 == 0, "POSITIVE").otherwise("NEGATIVE").alias("sentiment"))
    got = {r.symbol: (r.score, r.news, r.headline) for r in news.symbol_sentiment(marked, universe).collect()}
    for n, own in held.items():
        points, met = 0, []
        for k, t in texts:
            direct, sector = (any(w and t and w in t.lower() for w in part) for part in (own[:2], own[2:]))
            if direct or sector:
                met.append((k, t))
                points += ((8 if k % 3 == 0 else 3) if direct else (3 if k % 3 == 0 else 2)) * (1 if k % 2 == 0 else -1)
        assert got[f"{names[n][1]}{n}"] == (max(-20, min(20, points)), len(met), min(met)[1] if met else None)


def test_words_of_a_text_are_counted_once_each(spark):
    rows = [(1, "Surge and SURGE: profit falls - Wire"), (2, "Probe, loss, fraud"), (3, None), (4, "fed - A - B")]
    df = spark.createDataFrame([(k, t, "feed", f"u{k}") for k, t in rows], "id long, title string, source string, url string")
    got = {r.id: (r.category, r.sentiment, r.impact, r.source, r.title) for r in news.classify(df).collect()}
    assert got[1] == ("Results", "POSITIVE", "LOW", "Wire", "Surge and SURGE: profit falls")
    assert got[2][:3] == ("Corporate", "NEGATIVE", "LOW") and got[3][:3] == ("Corporate", "NEUTRAL", "LOW") and got[4] == ("Macro", "NEUTRAL", "LOW", "B", "fed - A")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
@pytest.mark.parametrize("name", ["tag_headlines", "symbol_sentiment", "news_for_symbol"])
def test_plans_have_no_nested_loop(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
