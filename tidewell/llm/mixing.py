"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Documents are leaves of a tree, by default domain, language, source. A budget of tokens flows down by the weights of the children. A child
takes no more than what lies under it (its tokens times max_epochs), and what it can't take goes to its siblings by their
weights; only what all of them can't take shows at their parent's siblings, since a node is never given more than it holds.

A leaf's quota is so many whole epochs and a prefix of one more. The order of an epoch is that of md5(seed:epoch:doc_id), so any subset of
documents keeps its relative order. The prefix ends at the document where the running tokens pass the rest of the quota (rounded to the
nearest document). It is found from sums over stretches of the order and one stretch a leaf, and applied as a
threshold on the order. What is known of a leaf is one row, which goes to the documents (see beside()); they are not moved, and a hot leaf is only summed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import spool, table

WORDS = r"[^\x20\x09-\x0D]+"
#: Documents in a stretch of a leaf's order, about.
STRETCH = 2_000
#: Most leaves whose rows are broadcast (some 300 bytes each); beyond, rows meet them in SALTS pieces a leaf.
MOST_SENT, SALTS = 100_000, 64


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def domain_of(source: str) -> Column:
    """A source's domain: its number modulo 4; sources without one belong to d0."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.coalesce(number.try_cast("int"), F.lit(0)) % 4)


def _weight(level: int, column: Column, weights: Mapping[int, Mapping[str, float]]) -> Column:
    given = weights.get(level) or {}
    pairs = [F.lit(x) for name, w in given.items() for x in (name, float(w))]
    return F.coalesce(F.create_map(*pairs)[column], F.lit(1.0)) if pairs else F.lit(1.0)


def quotas(leaves: DataFrame, levels: Sequence[str], budget: float, weights: Mapping[int, Mapping[str, float]], max_epochs: int) -> DataFrame:
    """leaves (levels..., supply) with `quota`: the budget poured down the tree."""
    nodes = leaves.withColumn("_room", F.col("supply").cast("double") * max_epochs).withColumn("_given", F.lit(float(budget)))
    for depth, name in enumerate(levels):
        above = list(levels[:depth])
        kids = nodes.groupBy(*above, name).agg(F.sum("_room").alias("_room"), F.first("_given").alias("_given"))
        kids = kids.withColumn("_w", _weight(depth, F.col(name), weights)).withColumn("_full_at", F.when(F.col("_w") > 0, F.col("_room") / F.col("_w")))
        # From the child that fills first: what those before it took, the weight still to be served, and the level at which the rest would stand.
        order = Window.partitionBy(*above).orderBy(F.col("_full_at").asc_nulls_last(), name)
        whole = Window.partitionBy(*above)
        before = F.coalesce(F.sum(F.when(F.col("_w") > 0, F.col("_room"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        weight = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
        kids = kids.withColumn("_level", F.when(F.col("_w") > 0, (F.col("_given") - before) / weight))
        level = F.max(F.when(F.col("_full_at") >= F.col("_level"), F.col("_level"))).over(whole)  # at the first child that does not fill
        taken = F.when(F.col("_w") > 0, F.least(F.col("_room"), F.greatest(F.coalesce(level * F.col("_w"), F.col("_room")), F.lit(0.0)))).otherwise(F.lit(0.0))
        given = kids.withColumn("_take", taken).select(*above, name, "_take")
        nodes = nodes.drop("_given").join(given, [*above, name]).withColumnRenamed("_take", "_given")
    return nodes.withColumnRenamed("_given", "quota").drop("_room")


def beside(rows: DataFrame, leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows (with doc_id) joined with their leaf's row. leaves: a written table, so its rows are counted first, and sent to the rows if they are few."""
    if leaves.count() <= MOST_SENT:
        return rows.join(F.broadcast(leaves), list(keys))
    dealt = leaves.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(dealt, [*keys, "_salt"]).drop("_salt")


def order_of(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string")).cast("binary"))


def choose(sizes: DataFrame, levels: Sequence[str], share: float, weights: Mapping[int, Mapping[str, float]], max_epochs: int, seed: int) -> DataFrame:
    """A row a leaf: levels..., full (whole epochs), and the last (order, doc_id) of the prefix of the next one, null where it is empty. sizes: (doc_id, levels..., n)."""
    leaves = sizes.groupBy(*levels).agg(F.sum("n").alias("supply"), F.count("*").alias("docs"))
    total = leaves.agg(F.sum("supply")).first()[0] or 0
    cut = quotas(leaves, levels, float(int(total * share)), weights, max_epochs)
    cut = cut.withColumn("full", F.when(F.col("supply") > 0, F.floor(F.col("quota") / F.col("supply"))).otherwise(F.lit(max_epochs)).cast("int"))
    cut = cut.withColumn("rest", F.col("quota") - F.col("full") * F.col("supply")).withColumn("stretches", F.ceil(F.col("docs") / STRETCH).cast("long"))
    cut = spool(cut.select(*levels, "supply", "quota", "full", "rest", "stretches"), "quotas")

    ordered = beside(sizes, cut.select(*levels, "full", "rest", "stretches"), levels).withColumn("order", order_of(seed, F.col("full"), F.col("doc_id")))
    at = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / 2**32 * F.col("stretches")).cast("long")
    ordered = ordered.withColumn("at", at)
    sums = ordered.groupBy(*levels, "at").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*levels).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = sums.withColumn("before", before).where("before < rest").withColumn("_last", F.max("at").over(Window.partitionBy(*levels))).where("at = _last").select(*levels, F.col("at").alias("_at"), "before")
    # In the last stretch that begins within the rest; documents of the stretches before it are in.
    near = beside(ordered, spool(edge, "edges"), levels).where("at = _at")
    run = F.coalesce(F.sum("n").over(Window.partitionBy(*levels).orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.col("before") + run + F.col("n") / 2 < F.col("rest")
    last = near.withColumn("_in", inside).groupBy(*levels).agg(F.max(F.when(F.col("_in"), F.struct("order", "doc_id"))).alias("last"), F.first("at").alias("at"))
    return spool(cut.join(last, list(levels), "left").select(*levels, "supply", "quota", "full", "stretches", "last", "at"), "chosen")


def copies(seed: int) -> Column:
    """How often a document is taken, given its leaf's row from choose()."""
    order = order_of(seed, F.col("full"), F.col("doc_id"))
    at = F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / 2**32 * F.col("stretches")).cast("long")
    inside = (at < F.col("at")) | ((at == F.col("at")) & F.col("last").isNotNull() & (F.struct(order.alias("order"), F.col("doc_id").alias("doc_id")) <= F.col("last")))
    return F.col("full") + F.when(F.coalesce(inside, F.lit(False)), 1).otherwise(0)


LEVELS = ("domain", "lang", "source")
#: Production weights by level: domains, languages; sources alike.
WEIGHTS: Mapping[int, Mapping[str, float]] = {0: {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, 1: {"en": 5, "de": 2, "fr": 2, "es": 1}}
SHARE, MAX_EPOCHS, SEED = 0.5, 2, 17


def sizes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, lang, source, n): null names count as empty ones, a null text has no tokens, rows with a null id are left out."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), domain_of("source").alias("domain"), name("lang").alias("lang"), name("source").alias("source"), n_words("text").alias("n"))


def mixture(docs: DataFrame, share: float = SHARE, weights: Mapping[int, Mapping[str, float]] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, epoch, domain, lang, source, n_tokens): a row for every time a document is taken, epochs from 1.

    Empty texts of a leaf are taken as often as epochs allow where the leaf has no tokens, else by their place in the order. Rows that
    repeat an id stand or fall together. An empty table gives no rows.
    """
    sizes = spool(sizes_of(docs), "sizes")
    chosen = choose(sizes, LEVELS, share, weights, max_epochs, seed)
    taken = beside(sizes, chosen, LEVELS).withColumn("copies", copies(seed)).where("copies > 0")
    return taken.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("epoch"), *LEVELS, F.col("n").alias("n_tokens"))


def keep_mixture(docs: DataFrame, share: float, weights: Mapping[int, Mapping[str, float]] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """docs that a mixture of one epoch at most takes, with the same columns. Rows with a null id go, having no place in an order."""
    sizes = spool(sizes_of(docs), "sizes")
    chosen = choose(sizes, LEVELS, share, weights, 1, seed)
    chosen = chosen.select(*(F.col(c).alias(f"_{c}") for c in LEVELS), "full", "stretches", "last", "at")
    row = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), domain_of("source").alias("_domain"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in LEVELS[1:]))
    return beside(row, chosen, [f"_{c}" for c in LEVELS]).where(copies(seed) > 0).select("row.*")


def op6(spark, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def _pour(depth: int) -> str:
    above = ", ".join(LEVELS[:depth])
    name, part = LEVELS[depth], f"PARTITION BY {above}" if depth else ""
    key = ", ".join(LEVELS[: depth + 1])
    weight = "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {float(w)}" for k, w in WEIGHTS[depth].items()) + " ELSE 1.0 END" if depth in WEIGHTS else "1.0"
    return f"""
k{depth} AS (SELECT {key}, sum(room) AS room, first(given) AS given, CAST({weight} AS DOUBLE) AS w FROM n{depth} GROUP BY {key}),
l{depth} AS (SELECT *, room / w AS full_at, (given - coalesce(sum(room) OVER ({part} ORDER BY room / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER ({part} ORDER BY room / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM k{depth}),
t{depth} AS (SELECT *, least(room, greatest(coalesce(w * max(CASE WHEN full_at >= level THEN level END) OVER ({part}), room), 0)) AS take FROM l{depth}),
n{depth + 1} AS (SELECT n.* EXCLUDE (given), t.take AS given FROM n{depth} n JOIN t{depth} t USING ({key})),"""


ORACLE = f"""
WITH d AS (
  SELECT doc_id, 'd' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT), 0) % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n
  FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT CAST(floor(sum(n) * {SHARE}) AS DOUBLE) AS budget FROM d),
n0 AS (SELECT domain, lang, source, sum(n) AS supply, CAST(sum(n) AS DOUBLE) * {MAX_EPOCHS} AS room, any_value(budget) AS given FROM d, b GROUP BY ALL),
{"".join(_pour(i) for i in range(3))}
q AS (SELECT *, CAST(CASE WHEN supply > 0 THEN floor(given / supply) ELSE {MAX_EPOCHS} END AS INT) AS whole, given AS quota FROM n3),
o AS (SELECT d.*, whole, quota - whole * supply AS rest, md5('{SEED}:' || whole || ':' || doc_id) AS place FROM d JOIN q USING (domain, lang, source)),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
c AS (SELECT *, whole + CASE WHEN before + n / 2.0 < rest THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, CAST(unnest(range(1, copies + 1)) AS INT) AS epoch, domain, lang, source, n AS n_tokens FROM c
"""
