"""Exact duplicates and the Merkle manifest against brute force and SQL, and their edges."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.held import connection, same
from tidewell.llm import exact, merkle, registry

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op12_binomial_runs", "op13_coordinate_proofs"])
def test_sql(spark, name):
    same(registry.queries()[name](spark, SF), connection(SF), registry.oracle_sql()[name])


# ---- exact duplicates


def brute_groups(rows):
    """Sorted (doc_id, keep_id, group_size, kept, sha) of (doc_id, text)."""
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        t = t or ""
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest()].append((-len(t), i is None, i or 0, k, i))
    out = []
    for sha, members in groups.items():
        first = min(members)
        out += [(i, first[4], len(members), m == first, sha) for m in members for i in [m[4]]]
    return sorted(out, key=str)


@pytest.mark.parametrize(("fan", "runs"), [(2, 8), (3, 20), (8, 1)])
def test_groups_of_many_runs(spark, fan, runs):
    rng = random.Random(runs)
    rows = [(i, rng.choice(["a b c", "ab c", " abc\t", "a  b\nc", "abcd", "", None, "  ", "é x", "éx", f"own {i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    got = exact.exact_duplicates(df, fan=fan, runs=runs).collect()
    assert sorted(map(tuple, got), key=str) == brute_groups(rows)


def test_a_place_never_has_many_rows_of_a_digest(spark):
    """A hot text in every run: at most fan rows of it meet at a place in any round."""
    df = spark.createDataFrame([(i, "hot") for i in range(3000)], "doc_id long, text string").repartition(27)
    rows = exact.digests(df, 27)
    level = rows.groupBy(F.col("run").alias("at"), "digest", "check").count()
    assert level.count() == 27
    for r in (1, 2, 3):
        met = level.withColumn("at", exact.after_round(27, 3**r))
        assert {x["count"] for x in met.groupBy("at", "digest").count().collect()} == {3}
        level = met.groupBy(*exact.KEYS).count()
    assert level.count() == 1


def test_runs_are_merged_by_sorting(spark):
    """min of a struct makes Spark merge sorted neighbours; no Python anywhere."""
    df = exact.digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 8).select(F.col("run").alias("at"), "digest", "check", "best")
    plan = df.repartitionById(8, F.col("at")).groupBy(*exact.KEYS).agg(F.min("best"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "HashAggregate" not in plan and plan.count("Exchange") == 1


def test_exact_edges(spark):
    rows = [(None, "x y"), (5, "xy"), (5, "xy"), (7, None), (8, ""), (9, " \x0b"), (None, "only"), (None, "only"), (3, "z" * 200_000), (2, " ".join("z" * 200_000))]
    clash = spark.createDataFrame([(*r, 1, "a", 2, 3) for r in rows], "doc_id long, text string, run int, digest string, at int, keep_id int")
    got = exact.exact_duplicates(clash, fan=2, runs=4).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert [(r["keep_id"], r["group_size"]) for r in by[5]] == [(None, 3)] * 2  # "x y" has more code points, though no id
    assert [(r["keep_id"], r["group_size"], r["kept"]) for i in (7, 8, 9) for r in by[i]] == [(9, 3, False), (9, 3, False), (9, 3, True)]
    assert (by[3][0]["keep_id"], by[3][0]["kept"]) == (2, False)
    assert sorted((r["group_size"], r["kept"]) for r in by[None]) == [(2, False), (2, True), (3, True)]
    assert exact.exact_duplicates(spark.createDataFrame([], DOC)).collect() == []


# ---- Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(hashes):
    """The root, and for each leaf its path: (side, hash)."""
    level, paths, at = list(hashes), [[] for _ in hashes], list(range(len(hashes)))
    while len(level) > 1:
        for k, i in enumerate(at):
            if i % 2:
                paths[k].append(("L", level[i - 1]))
            elif i + 1 < len(level):
                paths[k].append(("R", level[i + 1]))
            else:
                paths[k].append(("A", ""))
        level = [H(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], paths


def brute_leaf(row, more=0):
    doc_id, text, lang, source, n = row
    values = [doc_id, source, lang, n if n is None else n + more, text]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        trees.append((own, *brute_tree([brute_leaf(r) for r in own])))
    root, above = brute_tree([t[1] for t in trees])
    out = []
    for (own, sub, paths), up in zip(trees, above, strict=True):
        for r, path in zip(own, paths, strict=True):
            shown = brute_leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for side, h in path + up:
                shown = H(h, shown) if side == "L" else H(shown, h)
            out.append((r[0], brute_leaf(r), sub, root, H(*(h for _, h in path + up)), shown, shown == root))
    return sorted(out, key=str)


def op13_of(spark, monkeypatch, df):
    monkeypatch.setattr(merkle, "table", lambda *_: df)
    return sorted((tuple(r) for r in merkle.op13(spark, "").collect()), key=str)


@pytest.mark.parametrize("tier", [1, 2, 6])
def test_manifest_in_tiers(spark, monkeypatch, tier):
    """Groups of 1 to 70 leaves, a null group, several tiers: roots, proofs and folds as in a plain tree."""
    monkeypatch.setattr(merkle, "TIER", tier)
    rng = random.Random(tier)
    sizes = {None: 5, "": 1, "de": 33, "en": 70, "zß": 2, "é": 8}
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += rng.randint(1, 9)
            rows.append((i, rng.choice(["text", "", None, "ü" * 9]), lang, rng.choice(["s1", None]), rng.choice([4, None, 2**62])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOC).repartition(5)
    got = op13_of(spark, monkeypatch, df)
    assert got == brute_manifest(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_edges(spark, monkeypatch):
    rows = [(None, None, None, None, None), (4, "a", "en", "s", 1), (4, "a", "en", "s", 1), (4, "b", "en", "s", 1), (7, "x" * 300_000, "en", None, 2**63 - 1)]
    df = spark.createDataFrame([(*r, 1, "h", "p") for r in rows], DOC + ", idx int, hash string, path string")
    assert op13_of(spark, monkeypatch, df) == brute_manifest(rows)
    assert op13_of(spark, monkeypatch, spark.createDataFrame([rows[1]], DOC)) == brute_manifest([rows[1]])
    assert op13_of(spark, monkeypatch, spark.createDataFrame([], DOC)) == []


def test_no_node_is_asked_for_by_many(spark):
    """The coordinates of 3,000 leaves of one group: none is looked up by more than a block's leaves."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    made = merkle.manifest(df)
    assert made.most == 3000 and made.nodes.where("level = 0").count() == 3000
    for first in merkle.tiers(made.most):
        rows = made.nodes.where(F.col("level") == first).select("g", "n", "idx")
        asked = merkle.segments(rows, made.nodes, first).select(F.explode("path").alias("x")).groupBy("x.level", "x.hash").count()
        assert asked.agg(F.max("count")).first()[0] <= 2**merkle.TIER
    whole = made.proofs()
    good = whole.where(merkle.fold(F.col("hash"), F.col("path")) == F.lit(made.root)).count()
    assert good == 3000


def test_a_forged_sibling_or_leaf_fails(spark):
    df = spark.createDataFrame([(i, f"t{i}", "en" if i % 3 else "de", "s", i) for i in range(40)], DOC)
    made = merkle.manifest(df)
    rows = made.proofs()
    forged = F.transform("path", lambda x, k: F.struct(x["level"].alias("level"), x["side"].alias("side"), F.when(k == 1, F.unhex(F.lit("00" * 32))).otherwise(x["hash"]).alias("hash")))
    assert rows.where((merkle.fold(F.col("hash"), forged) == F.lit(made.root)) & (F.get(F.col("path"), F.lit(1))["side"] != merkle.ALONE)).count() == 0
    assert rows.where(merkle.fold(F.unhex(F.lit("11" * 32)), F.col("path")) == F.lit(made.root)).count() == 0


def test_proofs_of_more_tiers_are_no_larger_plan(spark):
    """What a tier hands down is written, so the plan of the proofs does not grow with the tiers: the driver holds it in memory."""

    def joins(n):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
        return merkle.manifest(docs).proofs()._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    assert joins(2 << merkle.TIER) == joins(2 << 2 * merkle.TIER)
