"""A Merkle manifest of a table with a proof for every row, by pointer jumping.

Rows are leaves, hashed field by field. Per group (language) leaves ascend by id and every eight consecutive nodes become one, until one is left, the group's subroot; subroots
make the tree over groups in the same way. Places in a group come from one range partitioning and the counts of (group, task) before each. A level is
one grouping by (tree, place div 8), of eight rows at most. Then every node but the root holds a pointer to its parent and the siblings' digests of that
step; each round joins the nodes with themselves at the pointer, so the distance to the ancestor doubles and the segments are put end to end, until all point to the
root: the binary logarithm of the height in rounds. Nodes far up have many below them, so from a distance on their rows are repeated under
a few salts, at most one copy per ``FAN`` rows that ask. Each round is a written table.

Defined results: null fields count as ``-``; ids ascend with null first, rows of one id by leaf digest, so equal rows stand side by side and have proofs of their own;
a null group is a group of its own, first in order; a group of one row has its leaf as subroot, a single group its subroot as root, and a proof without siblings is the
digest of nothing; a null id is never tampered with; an empty table gives an empty result; columns besides the named ones are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm._common import partitions, remainder, stage, unstage

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FAN = 1024  # rows that may ask for one copy of an ancestor
TOP = -1  # number of the tree over groups; a group's number is its place in it


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n``: octal digits of n - 1."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.conv((n - 1).cast("string"), 10, 8)))


def numbered(rows: DataFrame, group: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Staged rows with ``at`` and ``part``, and per (group, part) ``shift``: a row's place in its group is at + shift. No task counts a whole group."""
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), F.col(group), *order).sortWithinPartitions(group, *order)
    table = stage(dealt.select("*", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part")), "numbered")
    runs = table.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("own"))
    before = F.sum("own").over(W.partitionBy(group).orderBy("part")) - F.col("own")
    return table, runs.select(group, "part", "own", (before - F.col("first")).alias("shift"))


def level_runs(nodes: DataFrame, name: str) -> DataFrame:
    """tree, height, up, parent, run: every eight consecutive nodes (tree, height, idx, digest and what a leaf carries) and their digest."""
    one = F.struct("idx", "digest", "doc_id", "tampered")
    runs = nodes.groupBy("tree", "height", F.shiftright("idx", 3).alias("up")).agg(F.array_sort(F.collect_list(one)).alias("run"))
    joined = F.array_join(F.transform("run", lambda x: hex_of(x["digest"])), "")
    return stage(runs.withColumn("parent", F.unhex(F.sha2(joined.cast("binary"), 256))), name)


def links_of(runs: DataFrame, level: int, is_top: bool) -> DataFrame:
    """A row per node of a level: its key, that of its ancestor (its parent), and as ``path`` the siblings' digests of this one step."""
    last = F.col("height") == level + 1
    rows = runs.select("*", F.explode("run").alias("x"))
    others = F.array_join(F.transform(F.filter("run", lambda y: y["idx"] != F.col("x.idx")), lambda y: F.hex(y["digest"])), "")
    none = F.lit(None).cast("binary")
    top = F.lit(is_top)
    return rows.select(
        "tree", F.lit(level).alias("level"), F.col("x.idx").alias("idx"),
        F.when(last & ~top, F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("a_tree"),
        F.when(last & ~top, 0).otherwise(level + 1).alias("a_level"),
        F.when(last & ~top, F.col("tree")).otherwise(F.col("up")).alias("a_idx"),
        F.array(F.unhex(others)).alias("path"),
        F.when(last & ~top, F.col("parent")).otherwise(none).alias("subroot"),
        F.when(last & top, F.col("parent")).otherwise(none).alias("root"),
        F.col("x.doc_id").alias("doc_id"), F.col("x.digest").alias("digest"), F.col("x.tampered").alias("tampered"),
    )


def climb(nodes: DataFrame, levels: int, is_top: bool, name: str) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Staged levels, links of all nodes below the tops, and the tops (tree, digest) of trees whose nodes are given with their height."""
    staged, links = [], []
    tops = nodes.where("height = 0").select("tree", "digest")
    for level in range(levels):
        runs = level_runs(nodes.where(F.col("height") > level), f"{name}-{level}")
        staged.append(runs)
        links.append(links_of(runs, level, is_top))
        nodes = runs.select("tree", "height", F.col("up").alias("idx"), F.col("parent").alias("digest"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("tampered"))
        tops = tops.unionByName(nodes.where(F.col("height") == level + 1).select("tree", "digest"))
    return staged, links, tops


def jump(links: DataFrame, root: tuple[int, int], distance: int, widest: int, leaves_only: bool) -> DataFrame:
    """One round: nodes that do not point to the root yet take over their ancestor's pointer and path."""
    there = (F.col("a_tree") == TOP) & (F.col("a_level") == root[0]) & (F.col("a_idx") == root[1])
    asking = links.where("tree >= 0 and level = 0") if leaves_only else links
    done, far = asking.where(there), asking.where(~there)
    salts = max(1, min(8**distance, widest) // FAN)
    far = far.withColumn("salt", F.pmod("idx", F.lit(salts)))
    up = links.where((F.col("tree") == TOP) | (F.col("level") >= distance))
    up = up.select(
        F.col("tree").alias("a_tree"), F.col("level").alias("a_level"), F.col("idx").alias("a_idx"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"),
        F.struct("a_tree", "a_level", "a_idx", "path", "subroot", "root").alias("u"),
    )
    moved = far.join(up, ["a_tree", "a_level", "a_idx", "salt"])
    take = {"a_tree": F.col("u.a_tree"), "a_level": F.col("u.a_level"), "a_idx": F.col("u.a_idx"), "path": F.concat("path", "u.path")}
    take |= {c: F.coalesce(c, f"u.{c}") for c in ("subroot", "root")}
    return done.unionByName(moved.withColumns(take).select(*links.columns))


def proofs(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: list[str] | None = None, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, ``tree`` and ``idx`` (its group's and its own place), ``digest``, ``tampered`` (the digest over
    fields changed by ``tampered``, a value of the last field, or null), ``path`` (per level the siblings' digests, left to right, from the leaf to the root),
    ``top`` (levels of the tree over groups), ``subroot`` and ``root``, digests as bytes.
    """
    fields = [F.col(c) for c in (fields or FIELDS)]
    changed = F.lit(None).cast("string") if tampered is None else leaf_digest([*fields[:-1], tampered])
    changed = changed if tampered is None else F.when(tampered.isNotNull(), changed)
    key = F.coalesce(F.concat(F.lit("x"), F.col(group).cast("string")), F.lit(""))  # null first, then bytewise
    leaves = stage(docs.select(F.col(order).cast("long").alias("doc_id"), key.alias("k"), F.unhex(leaf_digest(fields)).alias("digest"), F.unhex(changed).alias("tampered")), "leaves")
    table, runs = numbered(leaves, "k", [F.asc_nulls_first("doc_id"), F.col("digest")])
    unstage(leaves)
    groups, g_runs = numbered(runs.groupBy("k").agg(F.sum("own").alias("n")).withColumn("one", F.lit(0)), "one", [F.col("k")])
    groups = groups.join(g_runs.drop("own"), ["one", "part"]).select("k", "n", (F.col("at") + F.col("shift")).alias("tree"))
    groups = stage(groups.withColumn("height", height(F.col("n"))), "groups")
    size = groups.agg(F.count(F.lit(1)).alias("trees"), F.coalesce(F.max("height"), F.lit(0)).alias("height"), F.coalesce(F.max("n"), F.lit(0)).alias("widest")).first()
    top = len(f"{size['trees'] - 1:o}") if size["trees"] > 1 else 0

    places = runs.join(groups, "k").select("k", "part", "shift", "tree", "height")
    nodes = table.join(places, ["k", "part"]).select("tree", "height", (F.col("at") + F.col("shift")).alias("idx"), "digest", "doc_id", "tampered")
    staged, links, subroots = climb(nodes, size["height"], False, "level")
    empty = F.lit(None)
    subroots = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(top).alias("height"), F.col("tree").alias("idx"), "digest", empty.cast("long").alias("doc_id"), empty.cast("binary").alias("tampered"))
    above, top_links, _ = climb(subroots, top, True, "top")
    single = nodes.where("height = 0").select(
        "tree", F.lit(0).alias("level"), "idx", F.lit(TOP).cast("long").alias("a_tree"), F.lit(0).alias("a_level"), F.col("tree").alias("a_idx"), F.array().cast("array<binary>").alias("path"),
        F.col("digest").alias("subroot"), empty.cast("binary").alias("root"), "doc_id", "digest", "tampered",
    )
    all_links = single
    for part in links + top_links:
        all_links = all_links.unionByName(part)
    rounds, held = max(0, (size["height"] + top - 1).bit_length()) if size["height"] + top else 0, []
    for r in range(rounds):
        last = r == rounds - 1
        all_links = jump(all_links, (top, 0), 1 << r, max(size["widest"], size["trees"]), last)
        if not last:
            all_links = stage(all_links, f"jump-{r}")
            unstage(*held)
            held = [all_links]
            if r == 0:
                unstage(*staged, *above)
    out = all_links.where("tree >= 0 and level = 0")
    root = F.coalesce("root", "subroot")
    return out.select("doc_id", "tree", "idx", "digest", "tampered", "path", F.lit(top).alias("top"), "subroot", root.alias("root"))


#: The root that a leaf's digest and its path lead to: the place among the siblings is an octal digit of the place in the tree.
FOLDED = """aggregate(
    transform(path, (p, j) -> struct(CAST((CASE WHEN j < size(path) - top THEN shiftright(idx, 3 * j) ELSE shiftright(tree, 3 * (j - size(path) + top)) END) & 7 AS INT) AS at, lower(hex(p)) AS s)),
    lower(hex(coalesce(tampered, digest))),
    (h, x) -> sha2(concat(substring(x.s, 1, 64 * x.at), h, substring(x.s, 64 * x.at + 1)), 256))"""


def verified_rows(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; a third of the rows has its text's letters lowered before the root is worked out again."""
    lowered = F.when(remainder(F.col("doc_id"), 3) == 0, F.coalesce(F.translate("text", UPPER, LOWER), F.lit(None)))
    rows = proofs(docs, tampered=lowered)
    proof = F.sha2(F.array_join(F.transform("path", hex_of), "").cast("binary"), 256)
    rows = rows.select("doc_id", hex_of(F.col("digest")).alias("leaf"), hex_of(F.col("subroot")).alias("subroot"), hex_of(F.col("root")).alias("root"), proof.alias("proof_sha256"), F.expr(FOLDED).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
