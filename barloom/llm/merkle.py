"""Operator 13: a Merkle manifest of a dataset, with a proof for every row, by pointer jumping (built-in functions only).

Rows are leaves of one tree per group; a node is the digest of up to ``FAN`` consecutive nodes' digests. The trees' roots, in the order of
the groups, are the leaves of the top tree. Digests are SHA-256 over the parts' lowercase hex texts.

1. Leaves are hashed where they lie; only digests and keys are shuffled from then on. They are numbered within their group by a range partitioning and one
   row per (group, partition), so a group of a third of all rows is spread over as many tasks.
2. Levels are built one by one: a sixteenth of the rows each time.
3. Every inner node starts with the segment of its siblings (the digests left and right of it) and a pointer to its parent. The table of nodes is joined with
   itself: a node appends the segment of the node that it points to and takes over its pointer, so each round doubles the distance. After
   ``ceil(log2(levels))`` rounds all point to the root.
4. A run of sibling leaves takes its parent's segments by one more join; each leaf prepends its own siblings.

Many nodes come to point to the same few ancestors, so from the third round on these are copied under salts. Only nodes that some node points to
are copied: about a 16**4th of all in trees that deep, none in shallower ones. Tables with paths are joined by sorting: stored segments are shared by
siblings and so compress to a small part of what they take in memory, and Spark would broadcast them by the stored size, even with their copies.

Defined cases: null columns are written as ``-``; rows without a group form a group of their own, which is the first; rows without a key come first; rows of
one key stand by their digest (equal rows are leaves of their own); one row alone is leaf, subroot and root, and its proof is empty; an
empty table gives an empty result; extra columns aren't read; a very long text is hashed in its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import documents, staged

FAN = 16
#: Copies of an ancestor from the third round on.
COPIES = 64
#: The top tree's name; those of groups begin with a sign or are empty.
TOP = "/"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value that can't run into its neighbours: its length in bytes, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def shown(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` (a stored table) with ``place``, counted from 0 within ``group``, and the group's ``total``."""
    sorted_rows = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = staged(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftrightunsigned("_at", 33).alias("_part")
    counts = placed.groupBy(group, part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy(group)
    starts = counts.select(
        group,
        "_part",
        (F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_start"),
        F.sum("_n").over(own).alias("total"),
    )
    joined = placed.withColumn("_part", F.shiftrightunsigned("_at", 33)).join(starts, [group, "_part"])
    return joined.withColumn("place", F.col("_at") + F.col("_start")).drop("_at", "_part", "_start")


def gathered(nodes: DataFrame, member: Column) -> DataFrame:
    """Runs of up to ``FAN`` consecutive nodes (tree, place, total): (tree, total, run, members in order, hexes of their digests)."""
    runs = nodes.groupBy("tree", "total", F.expr(f"place DIV {FAN}").alias("run")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    return runs.withColumn("hexes", F.transform("members", lambda m: shown(m["digest"])))


def segment(k: Column) -> Column:
    """What stands left and right of the ``k``-th (from 1) of a run's digests."""
    left = F.array_join(F.slice("hexes", F.lit(1), k - 1), "")
    right = F.array_join(F.slice("hexes", k + 1, F.lit(FAN)), "")
    return F.struct(left.alias("left"), right.alias("right"))


def levels(total: int) -> int:
    """How often a tree of so many leaves is gathered until one node is left."""
    n = 0
    while total > 1:
        total, n = -(-total // FAN), n + 1
    return n


def pointers(runs: DataFrame, tree: Column, level: int) -> DataFrame:
    """Nodes of one level with the segment of their siblings and a pointer to their parent."""
    k = F.col("k") + 1
    raw = F.struct(F.unhex(segment(k)["left"]).alias("left"), F.unhex(segment(k)["right"]).alias("right"))
    return runs.select("tree", "run", "hexes", F.posexplode("members").alias("k", "m")).select(
        F.coalesce(F.col("m.tree"), "tree").alias("tree"),
        F.coalesce(F.col("m.level"), F.lit(level)).alias("level"),
        F.when(F.col("m.tree").isNull(), F.col("m.place")).otherwise(F.lit(0)).cast("long").alias("place"),
        tree.alias("up_tree"),
        F.lit(level + 1).alias("up_level"),
        F.col("run").alias("up_place"),
        F.array(raw).alias("path"),
        F.when(F.col("m.tree").isNotNull(), F.col("m.digest")).alias("subroot"),
    )


def grow(nodes: DataFrame, first: int, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level from ``first`` on, and the nodes that are left alone in their tree (tree, level, digest).

    ``nodes``: (tree, place, total, digest, of_tree, of_level); the last two name nodes that are also another tree's root.
    """
    member = F.struct("place", "digest", F.col("of_tree").alias("tree"), F.col("of_level").alias("level"))
    made, alone = [], nodes.where("total = 1").select("tree", F.lit(first).alias("level"), "digest", "of_tree")
    for level in range(first, depth):
        runs = staged(gathered(nodes.where("total > 1"), member), "merkle-runs")
        made.append(runs)
        none = F.lit(None)
        nodes = runs.select(
            "tree", F.col("run").alias("place"), F.expr(f"(total + {FAN - 1}) DIV {FAN}").alias("total"), F.unhex(F.sha2(F.array_join("hexes", ""), 256)).alias("digest"), none.cast("string").alias("of_tree"), none.cast("int").alias("of_level")
        )
        alone = alone.unionByName(nodes.where("total = 1").select("tree", F.lit(level + 1).alias("level"), "digest", "of_tree"))
    return made, alone


KEY = ["tree", "level", "place"]


def pointed_to(nodes: DataFrame, at_root: Column, distance: int) -> DataFrame:
    """Those of ``nodes`` that a node ``distance`` below may point to; in later rounds exactly those.

    Pointers start at level 1 of a tree, so within it they lead above that distance.
    """
    above = nodes.where((F.col("tree") == TOP) | (F.col("level") > distance))
    if distance < 4:
        return above
    named = nodes.where(~at_root).select(*[F.col(f"up_{c}").alias(c) for c in KEY]).distinct()
    return above.join(named, KEY, "left_semi")


def jumped(nodes: DataFrame, steps: int, at_root: Column) -> DataFrame:
    """``nodes`` (stored) with pointers to the root and all segments on the way. The root itself has no row."""
    key, distance = KEY, 1
    rounds = max(0, steps - 1).bit_length()
    for k in range(rounds):
        copies = 1 if k < 2 else COPIES
        further = pointed_to(nodes, at_root, distance).select(
            *[F.col(c).alias(f"up_{c}") for c in key],
            F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("salt"),
            F.struct(*[F.col(f"up_{c}").alias(c) for c in key], "path", "subroot").alias("b"),
        )
        open_nodes = nodes.where(~at_root).withColumn("salt", F.pmod(F.col("place"), F.lit(copies)).cast("int"))
        met = open_nodes.join(further.hint("merge"), [f"up_{c}" for c in key] + ["salt"], "left").select(
            *key,
            *[F.coalesce(f"b.{c}", f"up_{c}").alias(f"up_{c}") for c in key],
            F.concat("path", F.coalesce("b.path", F.expr("slice(path, 1, 0)"))).alias("path"),
            F.coalesce("subroot", "b.subroot").alias("subroot"),
        )
        nodes = staged(met.unionByName(nodes.where(at_root)), "merkle-jumped")
        distance *= 2
    return nodes


def manifest(rows: DataFrame) -> DataFrame:
    """Every row of ``rows`` (tree, key, leaf as raw digest, and others that are carried along) with ``path`` (segments from its siblings to the root's
    children: hex texts ``left`` and ``right``), and ``subroot`` and ``root`` as hex texts. ``rows`` should be cheap to read twice.

    ``tree`` must not be null; trees stand in its order.
    """
    placed = numbered(rows, "tree", ["key", "leaf"])
    carried = F.struct("place", F.col("leaf").alias("digest"), F.struct(*[c for c in rows.columns if c not in ("tree", "leaf")]).alias("row"))
    leaf_runs = staged(gathered(placed, carried).withColumn("node", F.when(F.col("total") == 1, F.col("members")[0]["digest"]).otherwise(F.unhex(F.sha2(F.array_join("hexes", ""), 256)))), "merkle-leaves")
    largest = leaf_runs.agg(F.max("total")).first()[0] or 0
    depth = levels(largest)

    none = F.lit(None)
    first = leaf_runs.where("total > 1").select(
        "tree", F.col("run").alias("place"), F.expr(f"(total + {FAN - 1}) DIV {FAN}").alias("total"), F.col("node").alias("digest"), none.cast("string").alias("of_tree"), none.cast("int").alias("of_level")
    )
    inner, alone = grow(first, 1, depth)
    lone = leaf_runs.where("total = 1").select("tree", F.lit(0).alias("level"), F.col("node").alias("digest"), none.cast("string").alias("of_tree"))
    subroots = staged(alone.unionByName(lone).select(F.lit(TOP).alias("top"), F.col("tree").alias("of_tree"), F.col("level").alias("of_level"), "digest"), "merkle-subroots")

    tops = numbered(subroots, "top", ["of_tree"]).withColumnRenamed("top", "tree")
    top_depth = levels(subroots.count())
    outer, last = grow(tops, 0, top_depth)
    root = last.select(shown(F.col("digest"))).first()
    nodes = [pointers(r, F.col("tree"), k + 1) for k, r in enumerate(inner)] + [pointers(r, F.lit(TOP), k) for k, r in enumerate(outer)]
    own = ["tree", F.when(F.col("total") == 1, 0).otherwise(1).alias("level"), F.col("run").alias("place"), "members", "hexes", "node", "total"]
    runs = leaf_runs.select(*own)
    if nodes:
        linked = nodes[0]
        for more in nodes[1:]:
            linked = linked.unionByName(more)
        at_root = (F.col("up_tree") == TOP) & (F.col("up_level") == top_depth) if outer else F.col("up_level") == depth
        linked = jumped(staged(linked, "merkle-pointers"), max(0, depth - 1) + top_depth, at_root)
        if not outer:  # the only tree's root stands in no run
            linked = linked.withColumn("subroot", F.unhex(F.lit(root[0])))
        runs = runs.join(linked.select(*KEY, "path", "subroot").hint("merge"), KEY, "left")
    else:  # one run is all there is
        runs = runs.withColumns({"path": F.expr("CAST(array() AS array<struct<left:binary,right:binary>>)"), "subroot": none.cast("binary")})
    upper = F.transform(F.coalesce("path", F.expr("CAST(array() AS array<struct<left:binary,right:binary>>)")), lambda s: F.struct(shown(s["left"]).alias("left"), shown(s["right"]).alias("right")))
    runs = runs.select("tree", "total", "members", "hexes", upper.alias("upper"), shown(F.coalesce("subroot", "node")).alias("subroot"))
    leaves = runs.select("tree", "total", "hexes", "upper", "subroot", F.posexplode("members").alias("k", "m"))
    path = F.when(F.col("total") == 1, F.col("upper")).otherwise(F.concat(F.array(segment(F.col("k") + 1)), "upper"))
    return leaves.select("m.row.*", F.get("hexes", F.col("k")).alias("leaf"), path.alias("path"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    before = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    tampered = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
    claimed = F.when(tampered, F.unhex(digest(*map(field, before), field(F.translate(text, UPPER, LOWER)))))
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"), F.col("doc_id").alias("key"), F.unhex(digest(*map(field, before), field(text))).alias("leaf"), claimed.alias("claimed")
    )
    proved = manifest(staged(rows, "merkle-hashed"))
    root = folded(F.coalesce(shown(F.col("claimed")), "leaf"), F.col("path"))
    told = proved.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(inner: int = 7, outer: int = 5) -> str:
    """SQL by another way: levels are laid out one after the other, and each row looks its siblings up level by level. ``inner`` levels hold 16**7 rows of a group."""
    leaf = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{t}")) + ")"
    bits = "list_reduce([4294967295] || flatten(list_transform(range(1, strlen(d) + 1), lambda i: [ascii(d[i]), -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)"
    parts = [
        f"""told AS MATERIALIZED (SELECT doc_id, source AS g, {leaf.format(t='text')} AS leaf,
          CASE WHEN xor({bits}, 4294967295) % 5 = 0 THEN {leaf.format(t=f"translate(text, '{UPPER}', '{LOWER}')")} END AS claimed FROM (SELECT *, doc_id::VARCHAR AS d FROM documents))""",
        "leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM told)",
        "n0 AS MATERIALIZED (SELECT g, place, leaf AS h FROM leaves)",
    ]

    def level(name: str, k: int, group: str, by: str) -> list[str]:
        # a group that has come down to one node is carried on as it is
        return [
            f"{name}r{k} AS MATERIALIZED (SELECT {group}place // {FAN} AS run, list(h ORDER BY place) AS hs, sum(count(*)) OVER ({by}) AS total FROM {name}{k} GROUP BY {group}place // {FAN})",
            f"{name}{k + 1} AS MATERIALIZED (SELECT {group}run AS place, CASE WHEN total = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}r{k})",
        ]

    for k in range(inner):
        parts += level("n", k, "g, ", "PARTITION BY g")
    parts.append(f"t0 AS MATERIALIZED (SELECT g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS place, h FROM n{inner})")
    for k in range(outer):
        parts += level("t", k, "", "")

    paths = []
    for k in range(inner):
        paths.append(f"a{k + 1} AS MATERIALIZED (SELECT x.* EXCLUDE (proof, fold), " + _beside("x.place", FAN**k) + f" FROM a{k} x JOIN nr{k} r ON r.g IS NOT DISTINCT FROM x.g AND r.run = x.place // {FAN ** (k + 1)})")
    parts.append("a0 AS MATERIALIZED (SELECT *, '' AS proof, coalesce(claimed, leaf) AS fold FROM leaves)")
    parts += paths
    parts.append(f"b0 AS MATERIALIZED (SELECT x.*, t0.place AS rank, t0.h AS subroot FROM a{inner} x JOIN t0 ON t0.g IS NOT DISTINCT FROM x.g)")
    for k in range(outer):
        parts.append(f"b{k + 1} AS MATERIALIZED (SELECT x.* EXCLUDE (proof, fold), " + _beside("x.rank", FAN**k) + f" FROM b{k} x JOIN tr{k} r ON r.run = x.rank // {FAN ** (k + 1)})")
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, (SELECT h FROM t{outer}) AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = (SELECT h FROM t{outer}) AS verified FROM b{outer}"
    )


def _beside(place: str, width: int) -> str:
    at = f"({place} // {width}) % {FAN}"
    left, right = f"array_to_string(r.hs[1:{at}], '')", f"array_to_string(r.hs[{at} + 2:], '')"
    return f"CASE WHEN r.total > 1 THEN proof || {left} || {right} ELSE proof END AS proof, CASE WHEN r.total > 1 THEN sha256({left} || fold || {right}) ELSE fold END AS fold"
