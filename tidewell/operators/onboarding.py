"""Scores of data-set configurations: found hierarchies against known ones on their transitive closures, flags, issue lists, and how far repeated runs agree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import hash_of
from ..sources.written import written
from .profile import columns_profile


def closure(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, child, parent: every pair that a path of edges leads to, however long, within its keys.

    Rounds join paths with paths, so their length doubles, until one adds nothing; each is a written table. A cycle reaches itself. Null names are on no path.
    """
    columns = [*keys, "child", "parent"]
    paths = written(edges.select(*columns).where("child is not null and parent is not null").distinct(), "paths", few=False)
    n = paths.count()
    while n:
        onwards = paths.select(*keys, F.col("child").alias("parent"), F.col("parent").alias("_far"))
        longer = paths.join(onwards, [*keys, "parent"]).select(*keys, "child", F.col("_far").alias("parent"))
        paths = written(paths.unionByName(longer).distinct(), "paths", few=False)
        before, n = n, paths.count()
        if n == before:
            break
    return paths


def edge_scores_by_run(runs: DataFrame, found: DataFrame, truth: DataFrame, nodes: Sequence[str] | None = None) -> DataFrame:
    """run, tp, n_found, n_true, precision, recall, f1, invented, missed: each run's closure against that of the truth (child, parent). found: run, child, parent; runs: all runs, those without edges included.

    nodes: the columns that are scored, others are left out of what was found. invented and missed are sorted lists of child->parent. Precision without edges is 0, as is f1 without any hit.
    """
    mine = closure(found, ("run",))
    if nodes is not None:
        mine = mine.where(F.col("child").isin(*nodes) & F.col("parent").isin(*nodes))
    known = closure(truth)
    wanted = runs.select("run").distinct().crossJoin(F.broadcast(known))  # a few edges
    both = wanted.withColumn("_t", F.lit(True)).join(mine.withColumn("_f", F.lit(True)), ["run", "child", "parent"], "full")
    t, f = F.col("_t").isNotNull(), F.col("_f").isNotNull()
    name = F.concat_ws("->", "child", "parent")
    names = lambda test: F.array_join(F.sort_array(F.collect_list(F.when(test, name))), "; ")
    g = both.groupBy("run").agg(F.count_if(t & f).alias("tp"), F.count_if(f).alias("n_found"), F.count_if(t).alias("n_true"), names(f & ~t).alias("invented"), names(t & ~f).alias("missed"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.try_divide("tp", "n_found")), zero(F.try_divide("tp", "n_true"))
    g = runs.select("run").distinct().join(g, "run", "left").fillna(0, ["tp", "n_found", "n_true"]).fillna("", ["invented", "missed"])
    return g.select("run", "tp", "n_found", "n_true", p.alias("precision"), r.alias("recall"), zero(F.try_divide(2 * p * r, p + r)).alias("f1"), "invented", "missed")


def flag_accuracy(runs: DataFrame, flags: DataFrame, truth: DataFrame) -> DataFrame:
    """run, n_flags, n_right, accuracy: flags (run, name, value) against truth (name, value). A flag that a run doesn't name is wrong; of one named twice the first value counts."""
    said = flags.groupBy("run", "name").agg(F.min("value").alias("_said"))
    rows = runs.select("run").distinct().crossJoin(F.broadcast(truth)).join(said, ["run", "name"], "left")  # a few flags
    right = F.coalesce(F.col("_said") == F.col("value"), F.lit(False))
    return rows.groupBy("run").agg(F.count("*").alias("n_flags"), F.count_if(right).alias("n_right"), F.avg(right.cast("int")).alias("accuracy"))


def issue_list(fact: DataFrame, date: str, keys: Sequence[str], target: str) -> DataFrame:
    """issue, column, evidence (a number), handling: what is wrong with a fact table, a row a finding.

    Negative targets (their share), days missing within series of keys (mean share), days on which nothing at all was recorded (how many), nulls (share, a row a column), and whether no other column looks like a price (fractional numbers).
    """
    profile = written(columns_profile(fact), "profile")  # a row a column
    x = F.col("column")
    day = F.to_date(date)
    days = fact.select(*keys, day.alias("_d")).where("_d is not null").groupBy(*keys, "_d").agg(F.count("*").alias("_n"))
    days = written(days, "days", few=False)
    series = days.groupBy(*keys).agg(F.min("_d").alias("a"), F.max("_d").alias("b"), F.count("*").alias("n")).select((1 - F.col("n") / (F.datediff("b", "a") + 1)).alias("m"))
    whole = days.agg(F.min("_d").alias("a"), F.max("_d").alias("b"), F.count_distinct("_d").alias("n")).select((F.datediff("b", "a") + 1 - F.col("n")).cast("double").alias("m"))
    row = lambda df, issue, column, evidence, handling: df.select(F.lit(issue).alias("issue"), column.alias("column"), evidence.alias("evidence"), F.lit(handling).alias("handling"))
    none = F.lit(None).cast("string")
    priced = profile.where((x != target) & (x != date) & ~x.isin(*keys)).agg(F.count_if(F.coalesce(F.col("fractional") > 0, F.lit(False))).alias("n"))
    parts = [
        row(profile.where((x == target) & (F.col("negative") > 0)), "negative values of the target", x, F.col("negative"), "count them as 0, or as returns"),
        row(series.agg(F.avg("m").alias("m")).where("m > 0"), "days without a row within a series", none, F.col("m"), "put the series on a grid of all days, 0 where there is no row"),
        row(whole.where("m > 0"), "days missing for every series", none, F.col("m"), "decide whether these days count"),
        row(profile.where("n_null > 0"), "nulls in a column", x, F.col("n_null") / F.col("n"), "fill or leave out"),
        row(priced.where("n = 0"), "no column that looks like a price", none, F.lit(0.0), "take a constant price"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def issue_recall(runs: DataFrame, issues: DataFrame, categories: Mapping[str, str]) -> DataFrame:
    """run, n_issues, n_unmatched (issues of no category), hit_<category>, recall: which categories (names and patterns over lower-cased text) a run's issues (run, text) speak of."""
    text = F.lower("text")
    hit = {c: F.coalesce(text.rlike(p), F.lit(False)) for c, p in categories.items()}
    any_hit = F.greatest(*hit.values(), F.lit(False), F.lit(False))
    g = issues.groupBy("run").agg(F.count("*").alias("n_issues"), F.count_if(~any_hit).alias("n_unmatched"), *(F.bool_or(h).alias(f"hit_{c}") for c, h in hit.items()))
    g = runs.select("run").distinct().join(g, "run", "left").fillna(0, ["n_issues", "n_unmatched"]).fillna(False, [f"hit_{c}" for c in categories])
    return g.withColumn("recall", sum((F.col(f"hit_{c}").cast("int") for c in categories), F.lit(0)) / len(categories))


def edge_agreement(runs: DataFrame, found: DataFrame) -> DataFrame:
    """n_runs, n_pairs, mean_jaccard, identical_share over all pairs of runs, from one aggregation of edges: an edge adds to a pair what the runs that have it say. Two runs without edges agree in nothing (0), as nothing is shared."""
    every = written(runs.select("run").distinct(), "runs")
    edges = found.select("run", "child", "parent").distinct()
    size = every.join(edges.groupBy("run").agg(F.count("*").alias("n")), "run", "left").fillna(0, ["n"])
    pairs = size.select(F.col("run").alias("a"), F.col("n").alias("na")).join(size.select(F.col("run").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))  # a few runs
    shared = edges.withColumnRenamed("run", "a").join(edges.withColumnRenamed("run", "b"), ["child", "parent"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    j = F.coalesce(F.col("both"), F.lit(0)) / F.greatest(F.col("na") + F.col("nb") - F.coalesce(F.col("both"), F.lit(0)), F.lit(1))
    scored = pairs.join(shared, ["a", "b"], "left").select(j.alias("j"))
    return scored.agg(F.count("*").alias("n_pairs"), F.avg("j").alias("mean_jaccard"), F.avg((F.col("j") == 1).cast("int")).alias("identical_share")).crossJoin(every.agg(F.count("*").alias("n_runs")))  # one row each


def modal_shares(values: DataFrame) -> DataFrame:
    """name, n_runs, mode, share: how many of the runs (run, name, value) give the commonest value of each name; of equally common ones the smallest. A null is a value."""
    n = values.groupBy("name", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("name")
    first = n.select("name", "value", "n", F.sum("n").over(w).alias("n_runs"), F.row_number().over(w.orderBy(F.desc("n"), "value")).alias("k"))
    return first.where("k = 1").select("name", "n_runs", F.col("value").alias("mode"), (F.col("n") / F.col("n_runs")).alias("share"))


def choose(configs: DataFrame, name: str, order: Sequence[str], seed: int = 0) -> DataFrame:
    """The rows of configs that are taken, with chosen_by: the best, by the columns of `order`, larger ones first and nulls last, then by name; and one at random, that whose hash of seed and name is smallest."""
    best = configs.orderBy(*(F.desc_nulls_last(c) for c in order), name).limit(1).withColumn("chosen_by", F.lit("best"))
    drawn = configs.orderBy(hash_of(F.lit(seed), F.col(name)), name).limit(1).withColumn("chosen_by", F.lit("random"))
    return best.unionByName(drawn)
