"""The manifest against plain hashing: trees of several depths, ties, nulls, proofs and tampering."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from barloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, leaf int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, text):
    values = [doc[0], doc[3], doc[2], doc[4], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Levels of digests up to the one that is left."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, at):
    """(left, right) of the path from leaf ``at``."""
    out = []
    for nodes in levels[:-1]:
        low = at // 16 * 16
        out.append(("".join(nodes[low:at]), "".join(nodes[at + 1 : low + 16])))
        at //= 16
    return out


def by_hand(rows):
    lowered = str.maketrans(merkle.UPPER, merkle.LOWER)
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        own = sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        built[s] = (own, climb([leaf(r, r[1]) for r in own]))
    top = climb([built[s][1][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        own, levels = built[s]
        for at, r in enumerate(own):
            path = siblings(levels, at) + siblings(top, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            fold = leaf(r, r[1].translate(lowered)) if tampered else leaf(r, r[1])
            for left, right in path:
                fold = h(left, fold, right)
            out.append((r[0], leaf(r, r[1]), levels[-1][0], top[-1][0], h(*(x for p in path for x in p)), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def checked(spark, tmp_path, rows, name):
    path = str(tmp_path / name)
    spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    got = merkle.op13_merkle(spark, path)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(rows)


def corpus(sizes, seed=1):
    rng = random.Random(seed)
    rows = [(k * 3, f"Text {k} " + "Äß x" * rng.randint(0, 9), rng.choice(["en", None]), s, rng.choice([k, None])) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1},
        {"a": 2},
        {"a": 16},
        {"a": 17, "é": 1, None: 2},
        {"b": 300, "a": 33, None: 1},
        {f"s{k}": 1 + k % 3 for k in range(40)},
    ],
    ids=str,
)
def test_manifest_equals_plain_hashing(spark, tmp_path, sizes):
    checked(spark, tmp_path, corpus(sizes), "t")


def test_one_source_of_several_runs(spark, tmp_path):
    for n in (17, 300):
        checked(spark, tmp_path, corpus({"a": n}), f"one{n}")


def test_deep_trees_need_rounds_with_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES", 3)
    checked(spark, tmp_path, corpus({"x": 4500, "y": 20} | {f"z{k}": 1 for k in range(290)}), "deep")


def test_tables_with_paths_are_not_broadcast(spark, tmp_path, monkeypatch):
    plans, stage = [], merkle.staged

    def seen(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return stage(df, label)

    monkeypatch.setattr(merkle, "staged", seen)
    path = str(tmp_path / "p")
    rows = corpus({"x": 4500, "y": 20} | {f"z{k}": 1 for k in range(290)})
    spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    plans.append(("merkle-proved", merkle.op13_merkle(spark, path)._jdf.queryExecution().executedPlan().toString()))
    joined = [p for label, p in plans if label in ("merkle-jumped", "merkle-proved")]
    assert len(joined) == 4 and all("SortMergeJoin" in p and not re.search("BroadcastHashJoin.*LeftOuter", p) for p in joined)


def test_only_nodes_that_are_pointed_to_are_copied(spark):
    # a tree of six levels, three of two levels and the root's children: (tree, level, place, up_tree, up_level, up_place), four steps on
    deep = [("=a", 1, k, "=a", 5, 0) for k in range(32)] + [("=a", 2, k, merkle.TOP, 1, 0) for k in range(2)] + [("=a", n, 0, merkle.TOP, 2, 0) for n in (3, 4, 5, 6)]
    flat = [(f"={s}", n, 0, merkle.TOP, 2, 0) for s in "bcd" for n in (1, 2)]
    top = [(merkle.TOP, 1, k, merkle.TOP, 2, 0) for k in range(5)]
    nodes = spark.createDataFrame([(*n, "s" if n[1] > 1 else None) for n in deep + flat + top], "tree string, level int, place long, up_tree string, up_level int, up_place long, subroot string")
    at_root = (F.col("up_tree") == merkle.TOP) & (F.col("up_level") == 2)
    assert sorted(tuple(r)[:3] for r in merkle.pointed_to(nodes, at_root, 4).collect()) == [(merkle.TOP, 1, 0), ("=a", 5, 0)]


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "A", "en", "s", 1), (5, "", "en", "s", 0), (5, "Two", "en", "s", 3), (5, "Two", "en", "s", 3), (8, "x" * 200_000 + "Y", "de", "", 200_001), (-4, "Neg", None, "s", 3)]
    checked(spark, tmp_path, rows, "odd")


def test_empty_table(spark, tmp_path):
    checked(spark, tmp_path, [], "none")


def test_a_changed_row_is_not_verified(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = [(k, f"Doc {k}", "en", "s", 5) for k in range(200)]
    spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: r.verified for r in merkle.op13_merkle(spark, path).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 5 != 0 for k in range(200)} and 20 < sum(not v for v in got.values()) < 60
