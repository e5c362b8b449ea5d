"""Boosted trees with a Poisson loss, grown from histograms, and their exact contributions.

Rows with the same binned features are one row with a count and a sum of the target: the loss of such a row is that of its members, so trees are fitted on what is often
a small part of the rows. A level of a tree is one aggregation of gradient and Hessian sums by (node, feature, bin or category), from which windows choose the best split of each
node; only those splits, at most a row a node, come to the driver. Trees are scored as column expressions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binning import DECIMALS
from ..functions.quantiles import quantiles
from ..sources.panel import Windows, within
from ..sources.written import written

#: The demand model's features; month follows from the date.
NUMERIC = ("sell_price", "wday", "is_weekend", "snap", "event_flag", "month")
CATEGORICAL = ("cat_id", "dept_id", "store_id", "state_id", "item_id")


@dataclass(frozen=True)
class Params:
    """trees of `depth` levels, shrunk by rate. A child has min_rows rows at least. bins: of a numeric feature. A set of categories has most_in_set members at most (its
    complement may have any number), and categories are put in order by gradient over Hessian plus cat_smooth. step: Hessians are exp(step) times the exact ones, which bounds steps. together: trees between two written tables of margins.
    """

    trees: int = 150
    depth: int = 5
    rate: float = 0.08
    min_rows: int = 30
    l2: float = 0.0
    cat_l2: float = 10.0
    cat_smooth: float = 10.0
    most_in_set: int = 32
    bins: int = 64
    step: float = 0.7
    together: int = 8


@dataclass(frozen=True)
class Split:
    """Left goes what is at most `edge`, or null; or one of `members` (for `others`: none of them)."""

    feature: str
    edge: float | None = None
    members: tuple[str, ...] = ()
    others: bool = False
    gain: float = 0.0


@dataclass(frozen=True)
class Tree:
    """Node 1 is the root, and 2 i and 2 i + 1 are the left and right child of i. values: of the leaves; rows: of training rows at every node."""

    splits: dict[int, Split]
    values: dict[int, float]
    rows: dict[int, int]


@dataclass(frozen=True)
class Model:
    """The margin is base plus the trees' values; the prediction is its exponential."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    base: float
    trees: list[Tree] = field(default_factory=list)

    @property
    def features(self) -> tuple[str, ...]:
        return (*self.numeric, *self.categorical)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        number = lambda x, make=lambda v: v: {int(k): make(v) for k, v in x.items()}
        split = lambda s: Split(**{**s, "members": tuple(s["members"])})
        return Model(tuple(d["numeric"]), tuple(d["categorical"]), d["base"], [Tree(number(t["splits"], split), number(t["values"]), number(t["rows"])) for t in d["trees"]])

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON line in a folder of any file system that Spark writes to."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        lines = spark.read.text(path).take(2)
        if len(lines) != 1:
            raise ValueError(f"{path} holds no model")
        return Model.from_json(lines[0]["value"])


def with_features(panel: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """panel, with month if it is asked for; numeric features as doubles (what is not finite is null), categories as strings (null is the empty one)."""
    rows = panel.withColumn("month", F.month("date")) if "month" in numeric and "month" not in panel.columns else panel
    number = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))  # noqa: E731  NaN is the largest
    return rows.withColumns({**{f"_{c}": number(c) for c in numeric}, **{f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in categorical}})


def numeric_edges(rows: DataFrame, numeric: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Of each numeric feature, ascending: where it can be split. At most `bins` numbers each."""
    if not numeric:
        return {}
    each = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"_{c}").alias("x")) for c in numeric))
    q = quantiles(rows.select(F.explode(each).alias("f")).select("f.*"), "x", [i / bins for i in range(bins + 1)], ["feature"]).collect()  # a row a feature
    return {r["feature"]: sorted({round(x, DECIMALS) for x in r["q"] or [] if x is not None}) for r in q}


def condition(split: Split, prefix: str = "_") -> Column:
    """Whether a row goes left: never null."""
    c = F.col(prefix + split.feature)
    if split.edge is not None:
        return c.isNull() | (c <= split.edge)
    return ~c.isin(*split.members) if split.others else c.isin(*split.members)


def walk(tree: Tree, at_leaf, node: int = 1, test=condition) -> Column:
    """The tree as one expression, with at_leaf(node) where it ends."""
    if node not in tree.splits:
        return at_leaf(node)
    return F.when(test(tree.splits[node]), walk(tree, at_leaf, 2 * node, test)).otherwise(walk(tree, at_leaf, 2 * node + 1, test))


def margin_of(trees: Sequence[Tree]) -> Column:
    return reduce(lambda a, b: a + b, (walk(t, lambda n, t=t: F.lit(t.values[n])) for t in trees), F.lit(0.0))


def histogram(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """node, feature, bin, cat, g, h, n: sums of rows (node, g, h, n, b_<numeric>, _<category>) by each feature's value. A null number is bin -1."""
    none = lambda kind: F.lit(None).cast(kind)
    each = [F.struct(F.lit(i).alias("feature"), F.col(f"b_{c}").alias("bin"), none("string").alias("cat")) for i, c in enumerate(numeric)]
    each += [F.struct(F.lit(len(numeric) + i).alias("feature"), none("int").alias("bin"), F.col(f"_{c}").alias("cat")) for i, c in enumerate(categorical)]
    long = rows.select("node", "g", "h", "n", F.explode(F.array(*each)).alias("f"))
    return long.groupBy("node", "f.feature", "f.bin", "f.cat").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def best_splits(hist: DataFrame, n_numeric: int, p: Params) -> DataFrame:
    """node, feature, bin, cats, others, gain, g_left, h_left, n_left, g, h, n: the split of each node that lowers the loss most, where one is allowed.

    Numbers are cut between neighbouring bins; categories are put in order by gradient over Hessian and cut there, if one side has few. Gains are compared to 6 decimals, then
    the earlier feature and the earlier cut win.
    """
    is_cat = F.col("feature") >= n_numeric
    place = F.when(is_cat, F.col("g") / (F.col("h") + p.cat_smooth)).otherwise(F.col("bin").cast("double"))
    group = Window.partitionBy("node", "feature")
    upto = group.orderBy("place", "cat").rowsBetween(Window.unboundedPreceding, 0)
    # Of a set the smaller side is named, from the cut backwards or onwards: it has most_in_set members at most.
    beside = lambda a, b: F.collect_list("cat").over(group.orderBy("place", "cat").rowsBetween(a, b))
    cut = hist.withColumn("place", F.round(place, 9)).select(
        "node", "feature", "bin", is_cat.alias("is_cat"), beside(1 - p.most_in_set, 0).alias("before"), beside(1, p.most_in_set).alias("after"), F.row_number().over(group.orderBy("place", "cat")).alias("k"), F.count("*").over(group).alias("k_all"), *(F.sum(x).over(upto).alias(f"{x}_left") for x in "ghn"), *(F.sum(x).over(group).alias(x) for x in "ghn")
    )
    l2 = F.lit(p.l2) + F.when(F.col("is_cat"), F.lit(p.cat_l2)).otherwise(F.lit(0.0))
    part = lambda g, h, reg: F.try_divide(g * g, h + reg)
    g, h, gl, hl = (F.col(c) for c in ("g", "h", "g_left", "h_left"))
    gain = part(gl, hl, l2) + part(g - gl, h - hl, l2) - part(g, h, F.lit(p.l2))
    few = ~F.col("is_cat") | (F.col("k") <= p.most_in_set) | (F.col("k_all") - F.col("k") <= p.most_in_set)
    low = F.col("k") <= p.most_in_set
    allowed = cut.withColumns({"gain": F.round(gain, 6), "low": low, "cats": F.when(low, F.col("before")).otherwise(F.col("after"))}).where(few & (F.col("n_left") >= p.min_rows) & (F.col("n") - F.col("n_left") >= p.min_rows) & (F.col("gain") > 0))
    order = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("k")).alias("k"))
    best = allowed.groupBy("node").agg(F.max_by(F.struct("feature", "bin", "gain", "g_left", "h_left", "n_left", "g", "h", "n", "is_cat", "low", "cats"), order).alias("b"))
    return best.select("node", "b.feature", "b.bin", F.when(F.col("b.is_cat"), F.sort_array("b.cats")).alias("cats"), (~F.col("b.low")).alias("others"), *(f"b.{c}" for c in ("gain", "g_left", "h_left", "n_left", "g", "h", "n")))


def fit(panel: DataFrame, w: Windows | None = None, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL, target: str = "sales", p: Params = Params()) -> Model:
    """A model of the reference window's rows (of all rows without w) with a target of 0 or more.

    A null number goes left at every split, and a null category is the empty one; a category not seen in training is in no set. Rows with a null target are left out; repeated
    rows count as often as they occur; without rows, or where all targets are 0, the model is the smallest constant. Clashing names: features are read by name, other columns not at all.
    """
    rows = panel if w is None else panel.where(within(w.ref_start, w.ref_end))
    names = [*dict.fromkeys([*(c for c in (*numeric, *categorical) if c != "month" or "month" in panel.columns), *(["date"] if "month" in numeric and "month" not in panel.columns else [])])]
    rows = with_features(rows.where(F.col(target) >= 0).select(*names, F.col(target).cast("double").alias("_y")), numeric, categorical)
    edges = numeric_edges(rows, numeric, p.bins)
    bins = [_bin(F.col(f"_{c}"), edges.get(c) or [0.0]).alias(f"b_{c}") for c in numeric]
    keys = [*(f"b_{c}" for c in numeric), *(f"_{c}" for c in categorical)]
    data = rows.select("_y", *bins, *(f"_{c}" for c in categorical)).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("_y").alias("y"))
    data = written(data.withColumn("margin", F.lit(0.0)), "boosting", few=False)
    n, y = data.agg(F.sum("n"), F.sum("y")).first()
    model = Model(tuple(numeric), tuple(categorical), math.log(max((y or 0.0) / n if n else 0.0, 1e-9)))
    if not n or not y:
        return model
    of_bin = {c: {e: i for i, e in enumerate(edges.get(c, []))} for c in numeric}

    def binned(s: Split) -> Column:
        return F.col(f"b_{s.feature}") <= of_bin[s.feature].get(s.edge, -1) if s.edge is not None else condition(s)

    pending: list[Tree] = []
    for _ in range(p.trees):
        if len(pending) == p.together:
            data, pending = written(data.withColumn("margin", F.col("margin") + _sum(pending, binned)), "boosting", few=False), []
        rate = F.exp(F.lit(model.base) + F.col("margin") + _sum(pending, binned)) * F.col("n")
        tree = _grow(data.withColumns({"h": rate}).withColumns({"g": F.col("h") - F.col("y"), "h": F.col("h") * math.exp(p.step)}), model, edges, binned, p)
        if not tree.splits:
            break
        pending.append(tree)
        model.trees.append(tree)
    return model


def _bin(x: Column, edges: Sequence[float]) -> Column:
    """The edges below x; null: -1."""
    return F.when(x.isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < x)))


def _sum(trees: Sequence[Tree], test) -> Column:
    return reduce(lambda a, b: a + b, (walk(t, lambda n, t=t: F.lit(t.values[n]), 1, test) for t in trees), F.lit(0.0))


def _grow(data: DataFrame, model: Model, edges: Mapping[str, list[float]], test, p: Params) -> Tree:
    """One tree, a level at a time."""
    tree, sums = Tree({}, {}, {}), {}
    open_nodes = [1]
    for _ in range(p.depth):
        rows = data.withColumn("node", walk(tree, F.lit, 1, test)).where(F.col("node").isin(*open_nodes))
        found = best_splits(histogram(rows, model.numeric, model.categorical), len(model.numeric), p).collect()  # a row a node: 2 ** depth at most
        for r in found:
            name, i = model.features[r["feature"]], r["node"]
            edge = edges[name][min(r["bin"], len(edges[name]) - 1)] if r["bin"] is not None and r["bin"] >= 0 else None
            if r["cats"] is None and edge is None:
                edge = -math.inf  # nulls alone go left
            tree.splits[i] = Split(name, edge, tuple(r["cats"] or ()), bool(r["cats"]) and r["others"], r["gain"])
            sums[i] = (r["g"], r["h"], r["n"])
            sums[2 * i], sums[2 * i + 1] = (r["g_left"], r["h_left"], r["n_left"]), (r["g"] - r["g_left"], r["h"] - r["h_left"], r["n"] - r["n_left"])
        open_nodes = [c for r in found for c in (2 * r["node"], 2 * r["node"] + 1)]
        if not open_nodes:
            break
    for i, (g, h, n) in sums.items():
        tree.rows[i] = int(n)
        if i not in tree.splits:
            cat = bool(tree.splits[i // 2].members)
            tree.values[i] = -p.rate * g / (h + p.l2 + (p.cat_l2 if cat else 0.0))
    return tree


def score(model: Model, panel: DataFrame, target: str = "sales", at_once: int = 10) -> DataFrame:
    """panel with y_pred, residual, abs_error. Trees are column expressions, at_once in a projection of their own."""
    rows = with_features(panel, model.numeric, model.categorical).withColumn("_margin", F.lit(model.base))
    for i in range(0, len(model.trees), at_once):
        rows = rows.withColumn("_margin", F.col("_margin") + margin_of(model.trees[i : i + at_once]))
    pred = F.exp("_margin")
    return rows.withColumn("y_pred", pred).select(*panel.columns, "y_pred", (F.col(target) - F.col("y_pred")).alias("residual"), F.abs(F.col(target) - F.col("y_pred")).alias("abs_error"))


# ---- contributions


def shapley_table(ratios: Sequence[float], value: float) -> np.ndarray:
    """(2 ** u, u): the contributions of u features to one leaf, by which of them lead there.

    The game of a leaf: its value times the product over features of 1 or 0 (known and leading there or not), or of the share of training rows that go there (unknown). Bit i of the row number: feature i leads there.
    """
    u = len(ratios)
    out = np.zeros((1 << u, u))
    weight = [math.factorial(s) * math.factorial(u - s - 1) / math.factorial(u) for s in range(u)]
    for code in range(1 << u):
        leads = [(code >> i) & 1 for i in range(u)]
        for i in range(u):
            total = [1.0]  # by how many of the others are known
            for j in range(u):
                if j != i:
                    total = [a * ratios[j] + b * leads[j] for a, b in zip([*total, 0.0], [0.0, *total], strict=True)]
            out[code, i] = value * (leads[i] - ratios[i]) * sum(a * b for a, b in zip(weight, total, strict=True))
    return out


@dataclass(frozen=True)
class _Leaf:
    steps: tuple[tuple[int, tuple[tuple[int, bool], ...]], ...]  # of each feature on the path: the nodes that test it, and whether the leaf lies left of them
    table: np.ndarray


def _leaves(tree: Tree, features: Sequence[str]) -> Iterator[tuple[_Leaf, float]]:
    for leaf, value in tree.values.items():
        steps: dict[int, list[tuple[int, bool]]] = {}
        ratio: dict[int, float] = {}
        node = leaf
        while node > 1:
            up = node // 2
            f = features.index(tree.splits[up].feature)
            steps.setdefault(f, []).append((up, node % 2 == 0))
            ratio[f] = ratio.get(f, 1.0) * tree.rows[node] / tree.rows[up]
            node = up
        order = list(steps)
        yield _Leaf(tuple((f, tuple(steps[f])) for f in order), shapley_table([ratio[f] for f in order], value)), value * math.prod(ratio.values())


def contributions(model: Model, panel: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns `keep` of panel (by default all), phi_<feature> of every feature, and `expected`; together they add up to the margin, log of the prediction.

    Path-dependent tree Shapley values, exact: a leaf's contributions depend only on which of its path's features (as many as the depth, at most) lead there, so they are read
    from a table of 2 ** features rows made once a leaf. Arrow batches; what is kept passes through untouched.
    """
    keep = list(panel.columns if keep is None else keep)
    plan, expected = [], model.base
    for tree in model.trees:
        own = list(_leaves(tree, model.features))
        expected += sum(e for _, e in own)
        plan.append((tree.splits, [leaf for leaf, _ in own]))
    features, n_numeric = model.features, len(model.numeric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = {c: batch.column(1 + i).to_numpy(zero_copy_only=False) for i, c in enumerate(model.numeric)}  # null: NaN
            coded = {c: pc.dictionary_encode(batch.column(1 + n_numeric + i)) for i, c in enumerate(model.categorical)}
            phi = np.zeros((len(features), batch.num_rows))
            for splits, leaves in plan:
                left = {i: _goes_left(s, numbers, coded) for i, s in splits.items()}
                for leaf in leaves:
                    code = np.zeros(batch.num_rows, dtype=np.int64)
                    for bit, (_, nodes) in enumerate(leaf.steps):
                        leads = np.logical_and.reduce([left[n] if goes else ~left[n] for n, goes in nodes])
                        code |= leads.astype(np.int64) << bit
                    for k, (f, _) in enumerate(leaf.steps):
                        phi[f] += leaf.table[code, k]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, phi)], names=["row", *(f"phi_{c}" for c in features)])

    rows = with_features(panel, model.numeric, model.categorical).select(F.struct(F.lit(True).alias("_"), *keep).alias("row"), *(f"_{c}" for c in features))
    kind = rows.select("row").schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kind}, " + ", ".join(f"`phi_{c}` double" for c in features))
    return out.select(*(F.col("row")[c].alias(c) for c in keep), *(f"phi_{c}" for c in features), F.lit(expected).alias("expected"))


def _goes_left(s: Split, numbers: Mapping[str, np.ndarray], coded: Mapping[str, pa.DictionaryArray]) -> np.ndarray:
    if s.edge is not None:
        x = numbers[s.feature]
        return np.isnan(x) | (x <= s.edge)
    held = coded[s.feature]
    inside = pc.is_in(held.dictionary, value_set=pa.array(s.members, type=held.dictionary.type)).to_numpy(zero_copy_only=False)
    return (inside ^ s.others)[held.indices.to_numpy(zero_copy_only=False)]
