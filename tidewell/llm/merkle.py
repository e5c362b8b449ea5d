"""A Merkle manifest of a table, and proofs looked up by coordinates.

Leaves of a group (a language) stand in the order of their ids; every two neighbours make a parent, and an odd last one makes a parent alone,
up to the group's subroot. The subroots, ordered by group, make a tree of the same kind, up to the root. A node is named by (group, level, index), level 0
being the leaves, and all nodes are one written table.

What a leaf's proof needs follows from its index and the size of its group: at each level the index xor 1, if there is such a node. A leaf explodes these
coordinates, joins them with the node table, and puts what it finds in order; concatenated, the siblings are the proof, and folded with the leaf they give the root.

A high node is a sibling of half of all leaves, so coordinates are exploded in tiers of TIER levels: a leaf asks for the lowest tier only, the root of its block of 2 ** TIER
leaves for the next one, and so on; a path is handed down from a block to what lies in it. So nothing is asked for by more than 2 ** TIER rows, whatever a group's size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, spool, table

#: Levels of a tier: blocks of 2 ** TIER nodes.
TIER = 6
#: The fields of a leaf, in order, and the one that ordering and tampering go by.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Where a sibling stands. A node without one makes its parent alone: it then looks itself up.
LEFT, RIGHT, ALONE = 0, 1, 2


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """How a field enters a leaf: "-" for null, else its length in bytes, a colon, and itself."""
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def parent(a: Column, b: Column) -> Column:
    """Of two digests; b null: of one."""
    return F.unhex(F.sha2(F.concat(text_of(a), F.coalesce(text_of(b), F.lit(""))), 256))


def ordered(rows: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows written in ascending (group, order), nulls first, with `_at`; and a written table (group..., part, first, before, n) that gives their places.

    The parts are ranges, so no task holds a group. Rows of a group in a part have `_at` from `first` on, `before` rows of the group stand in the parts before, and n are all of it.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *group, *order).sortWithinPartitions(*group, *order)
    written = spool(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    counts = written.groupBy(*group, F.shiftright("_at", 33).alias("part")).agg(F.min("_at").alias("first"), F.count("*").alias("_n"))
    own = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return written, spool(counts.select(*group, "part", "first", before.alias("before"), F.sum("_n").over(own).alias("n")), f"{name}-parts", small=True)


def numbered(rows: DataFrame, parts: DataFrame, group: str | None = None) -> DataFrame:
    """What ordered() gave, with idx and n (and what else parts has) in place of `_at`; the group's column is that of parts."""
    key = F.shiftright("_at", 33) == F.col("part")
    if group:
        parts = parts.withColumnRenamed(group, "_group")
        key = key & F.col(group).eqNullSafe(F.col("_group"))
    met = rows.join(parts, key).withColumn("idx", F.col("before") + F.col("_at") - F.col("first"))
    return met.drop("_at", "part", "first", "before", "_group")


def depth(n: Column) -> Column:
    """Levels above the leaves of a group of n: the bits of n - 1."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(0))


def tiers(most: int) -> range:
    """The first levels of the tiers, the largest group having `most` leaves."""
    return range(0, max(1, (most - 1).bit_length()), TIER)


def grow(leaves: DataFrame, most: int, name: str) -> DataFrame:
    """The written node table (g, n, level, idx, hash) over leaves (g, n, idx, hash); n is the group's size, most the largest one. A job a tier."""
    base, tables, n = leaves.select("g", "n", "idx", "hash"), [], F.col("n")
    for first in tiers(most):
        blocks = base.groupBy("g", "n", F.shiftright("idx", TIER).alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("nodes"))
        steps = F.least(F.lit(TIER), depth(n) - first)
        start = F.array(F.transform("nodes", lambda x: x["hash"]))
        levels = F.aggregate(F.sequence(F.lit(1), steps), start, lambda made, _: F.concat(made, F.array(_parents(F.element_at(made, -1)))))
        rows = blocks.select("g", "n", "block", F.posexplode(F.when(steps > 0, levels).otherwise(start)).alias("step", "hashes"))
        rows = rows.select("g", "n", "block", "step", F.posexplode("hashes").alias("i", "hash"))
        idx = F.col("block") * F.call_function("shiftleft", F.lit(1), TIER - F.col("step")) + F.col("i")
        made = spool(rows.select("g", "n", (F.col("step") + first).alias("level"), idx.cast("long").alias("idx"), "hash"), f"{name}-{first}")
        goes_on = (F.col("level") == first + TIER) & (depth(n) > first + TIER)  # the next tier writes it
        tables.append(made.where(~goes_on))
        base = made.where(goes_on).select("g", "n", "idx", "hash")
    return reduce(DataFrame.unionByName, tables)


def _parents(nodes: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), lambda i: parent(F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1)))


def tops(nodes: DataFrame) -> DataFrame:
    """(g, hash): the last node of each group."""
    return nodes.where(F.col("level") == depth(F.col("n"))).select("g", "hash")


def segments(walkers: DataFrame, nodes: DataFrame, first: int) -> DataFrame:
    """(g, idx, path) of walkers (g, n, idx), nodes of level `first`: their siblings in the tier from there, (level, side, hash) in order."""
    n, level, own = F.col("n"), F.col("level"), F.col("own")
    asked = walkers.where(depth(n) > first).select("g", "n", F.col("idx").alias("walker"), F.explode(F.sequence(F.lit(first), F.least(F.lit(first + TIER), depth(n)) - 1)).alias("level"))
    asked = asked.select("g", "walker", "level", F.call_function("shiftright", F.col("walker"), level - first).alias("own"), F.call_function("shiftright", n - 1, level).alias("last"))
    side = F.when(own % 2 == 1, LEFT).when(own == F.col("last"), ALONE).otherwise(RIGHT)
    asked = asked.select("g", "walker", "level", side.alias("side"), (own + F.when(side == LEFT, -1).when(side == RIGHT, 1).otherwise(0)).alias("idx"))
    found = asked.join(nodes.select("g", "level", "idx", "hash"), ["g", "level", "idx"])
    return found.groupBy("g", F.col("walker").alias("idx")).agg(F.sort_array(F.collect_list(F.struct("level", "side", "hash"))).alias("path"))


def paths(leaves: DataFrame, nodes: DataFrame, most: int, above: DataFrame) -> DataFrame:
    """leaves (g, n, idx, ...) with `path`: their siblings up to the top of the group, then the path that `above` (g, n, path, ...) has for it, whose other columns come along.

    From the highest tier down: a tier's nodes look their own siblings up and append what was handed to their block. What a tier hands down, a row a block, is written: so no
    plan holds more than one tier, however many there are, and the driver's memory does not grow with them.
    """
    n, handed = F.col("n"), None
    for first in reversed(tiers(most)):
        rows = leaves if first == 0 else nodes.where((F.col("level") == first) & (depth(n) > first)).select("g", "n", "idx")
        ends = depth(n) <= first + TIER if first == 0 else (depth(n) <= first + TIER) & (depth(n) > first)
        begin = above.where(ends).drop("n").withColumnRenamed("path", "_above").withColumn("block", F.lit(0).cast("long"))
        handed = begin if handed is None else begin.unionByName(handed.drop("n").withColumnRenamed("idx", "block").withColumnRenamed("path", "_above"))
        own = rows.join(segments(rows, nodes, first), ["g", "idx"], "left").withColumn("block", F.shiftright("idx", TIER))
        handed = own.join(handed, ["g", "block"]).withColumn("path", F.concat(F.coalesce("path", NO_PATH()), "_above")).drop("block", "_above")
        if first:
            handed = spool(handed, f"paths-{first}", small=True)
    return handed


def NO_PATH() -> Column:
    return F.array().cast("array<struct<level:int,side:int,hash:binary>>")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda at, x: F.when(x["side"] == LEFT, parent(x["hash"], at)).when(x["side"] == RIGHT, parent(at, x["hash"])).otherwise(parent(at, F.lit(None).cast("binary"))))


def proof(path: Column) -> Column:
    """The siblings of a path, concatenated as text."""
    return F.concat_ws("", F.transform(F.filter(path, lambda x: x["side"] != ALONE), lambda x: text_of(x["hash"])))


@dataclass
class Manifest:
    """leaves (g, n, idx, group, id, hash, and what was carried), their nodes (g, n, level, idx, hash), the groups (g, n, group, subroot), the nodes above them, and the root (None of an empty table)."""

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    upper: DataFrame
    root: bytes | None
    most: int

    def proofs(self) -> DataFrame:
        """The leaves with path and subroot."""
        top = self.groups.select(F.lit(0).cast("long").alias("g"), F.count("*").over(Window.partitionBy()).alias("n"), F.col("g").alias("idx"), F.col("n").alias("_size"), "subroot")
        n = self.groups.count()
        begin = self.groups.sparkSession.range(1).select(F.lit(0).cast("long").alias("g"), F.lit(n).cast("long").alias("n"), NO_PATH().alias("path"))
        above = spool(paths(top, self.upper, n, begin).select(F.col("idx").alias("g"), F.col("_size").alias("n"), "path", "subroot"), "above", small=True)
        return paths(self.leaves, self.nodes, self.most, above)


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS, carry: Mapping[str, Column] | None = None) -> Manifest:
    """A manifest of docs, whose leaves are digests of `fields`, in groups, in ascending order; carry: further columns of the leaves, from those of docs.

    A null field, id or group is a value of its own and comes first; fields of other kinds enter as Spark casts them to text. Rows with the same id stand by
    their digests, and wholly equal rows are leaves each. A group of one has its leaf as its subroot, and one group has its subroot as the root. Other columns are not looked at.
    """
    given = docs.select(F.col(group).cast("string").alias("group"), F.col(order).alias("id"), leaf(*(F.col(c).cast("string") for c in fields)).alias("hash"), *((c.alias(k)) for k, c in (carry or {}).items()))
    rows, parts = ordered(given, ["group"], ["id", "hash"], "leaves")
    kinds, kind_parts = ordered(parts.select("group", "n").distinct(), [], ["group"], "groups")
    groups = spool(numbered(kinds.withColumnRenamed("n", "size"), kind_parts).select(F.col("idx").alias("g"), F.col("size").alias("n"), "group"), "kinds", small=True)
    spread = spool(parts.drop("n").join(groups.withColumnRenamed("group", "_of"), F.col("group").eqNullSafe(F.col("_of"))).drop("_of"), "spread", small=True)
    leaves = numbered(rows, spread, "group")
    most = groups.agg(F.max("n")).first()[0] or 0
    nodes = grow(leaves, most, "nodes")
    subroots = spool(groups.join(tops(nodes).withColumnRenamed("hash", "subroot"), "g"), "subroots", small=True)
    n = subroots.count()
    upper = grow(subroots.select(F.lit(0).cast("long").alias("g"), F.lit(n).cast("long").alias("n"), F.col("g").alias("idx"), F.col("subroot").alias("hash")), n, "upper")
    root = tops(upper).first()
    return Manifest(leaves, nodes, subroots, upper, bytes(root["hash"]) if root else None, most)


def op13(spark, sf_dir: str) -> DataFrame:
    """Where 7 divides the CRC-32 of the id, the row's n_chars is one more when it is verified."""
    more = {"n_chars": (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")}
    changed = leaf(*(more.get(c, F.col(c).cast("string")) for c in FIELDS))
    made = manifest(table(spark, sf_dir, "documents"), carry={"changed": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, changed)})
    root = F.lit(made.root.hex() if made.root else None).cast("string")
    folded = text_of(fold(F.coalesce("changed", "hash"), F.col("path")))
    rows = made.proofs().select(F.col("id").alias("doc_id"), text_of(F.col("hash")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), root.alias("root"), F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(c: str) -> str:
    return f"coalesce(strlen({c}) || ':' || {c}, '-')"


_LEAF = "sha256(" + " || ".join(_field(f"CAST({c} AS VARCHAR)") for c in FIELDS) + ")"
_CHANGED = "sha256(" + " || ".join(_field(f"CAST({c} AS VARCHAR)") if c != "n_chars" else _field("CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR)") for c in FIELDS) + ")"
#: CRC-32 of the id's digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, _i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_LEAF} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_CHANGED} ELSE {_LEAF} END AS shown FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM d),
tree AS (
  SELECT lang, 0 AS level, idx, n, leaf AS hash FROM l
  UNION ALL
  SELECT lang, level + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(hash, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY lang, level, idx // 2),
g AS (SELECT lang, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS level, idx, n, subroot AS hash FROM g
  UNION ALL
  SELECT level + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(hash, '' ORDER BY idx)) FROM upper_tree WHERE n > 1 GROUP BY level, idx // 2),
s AS (
  SELECT l.lang, l.idx, t.level, CASE WHEN (l.idx >> t.level) % 2 = 1 THEN 'L' WHEN t.idx = l.idx >> t.level THEN 'A' ELSE 'R' END || t.hash AS step
  FROM l JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND t.n > 1 AND t.idx = CASE WHEN (l.idx >> t.level) % 2 = 1 THEN (l.idx >> t.level) - 1 ELSE least((l.idx >> t.level) + 1, t.n - 1) END),
u AS (
  SELECT g.lang, list(CASE WHEN (g.idx >> t.level) % 2 = 1 THEN 'L' WHEN t.idx = g.idx >> t.level THEN 'A' ELSE 'R' END || t.hash ORDER BY t.level) AS steps
  FROM g JOIN upper_tree t ON t.n > 1 AND t.idx = CASE WHEN (g.idx >> t.level) % 2 = 1 THEN (g.idx >> t.level) - 1 ELSE least((g.idx >> t.level) + 1, t.n - 1) END GROUP BY g.lang),
p AS (
  SELECT l.doc_id, l.leaf, l.shown, g.subroot, list_concat(coalesce(o.steps, []), coalesce(u.steps, [])) AS steps
  FROM l JOIN g ON g.lang IS NOT DISTINCT FROM l.lang LEFT JOIN u ON u.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN (SELECT lang, idx, list(step ORDER BY level) AS steps FROM s GROUP BY lang, idx) o ON o.lang IS NOT DISTINCT FROM l.lang AND o.idx = l.idx),
f AS (
  SELECT doc_id, leaf, subroot, (SELECT hash FROM upper_tree WHERE n = 1) AS root,
         sha256(array_to_string(list_transform(list_filter(steps, lambda x: x[1] <> 'A'), lambda x: x[2:]), '')) AS proof_sha256,
         list_reduce(list_prepend(shown, steps), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END)) AS folded_root
  FROM p)
SELECT *, folded_root = root AS verified FROM f
"""
