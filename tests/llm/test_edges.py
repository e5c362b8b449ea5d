"""The pipeline and operators on empty tables, null texts, repeated rows and clashing names."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import content_store, nbsvm, shared, toxicity, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def through(spark, docs):
    """Every stage's rows, each on what the one before kept."""
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = shared.spool(stage(spark, docs, SF), "edge")
        out.append(docs)
    return out


def test_pipeline_of_nothing(spark):
    stages = through(spark, spark.createDataFrame([], DOC))
    assert [s.count() for s in stages] == [0] * 5
    assert all(s.columns == DOC.replace(" long", "").replace(" string", "").split(", ") for s in stages[:-1])


def test_pipeline_of_odd_rows(spark):
    """Null and empty texts, repeated rows, a null id, a very long text, and columns named like the stages' own."""
    own = "row string, _id int, score double, key string, at long, n long, _h string"
    plain = " ".join(f"word{i}" for i in range(90))
    rows = [(1, None), (2, ""), (3, plain), (3, plain), (4, plain + " more"), (None, "without an id"), (5, " ".join(f"long{i % 977} {i}" for i in range(60_000))), (6, "a few words"), (7, " \t\n"), (8, None)]
    df = spark.createDataFrame([(i, t, None if (i or 0) % 2 else "en", "src1", None, "r", 1, 0.5, "k", 2, 3, "h") for i, t in rows], f"{DOC}, {own}")
    stages = through(spark, df)
    assert all(s.columns == df.columns for s in stages[:-1])
    kept = [sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in s.select("doc_id").collect()) for s in stages]
    assert kept[0] == sorted((i is None, i or 0) for i, _ in rows)  # none of these is toxic
    assert (False, 3) in kept[1] and (False, 4) not in kept[1] and (True, 0) in kept[1] and sum(x == (False, 3) for x in kept[1]) == 2
    assert (False, 5) in kept[2] and set(kept[3]) <= set(kept[2]) - {(True, 0)}
    assert set(kept[4]) == set(kept[3])


@pytest.mark.parametrize(("query", "score"), [(nbsvm, "op3"), (toxicity, "op7")])
def test_classifiers_on_repeats_and_clashing_names(spark, tmp_path, query, score):
    """Rows that repeat a document get its score each; other columns change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, twice in (("once", docs), ("twice", docs.unionByName(docs.where("doc_id % 5 = 0")).withColumns({"score": F.lit(9.0), "held_out": F.lit("h"), "row": F.lit(1)}))):
        (tmp_path / name).mkdir()
        twice.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    got = {n: getattr(query, score)(spark, str(tmp_path / n)).collect() for n in ("once", "twice")}
    assert len(got["twice"]) == len(got["once"]) + docs.where("doc_id % 5 = 0").count()
    by = {}
    for r in got["twice"]:
        by.setdefault(r["doc_id"], set()).add((r["held_out"], r["score"], r["predicted"]))
    assert all(len(v) == 1 for v in by.values()) and by.keys() == {r["doc_id"] for r in got["once"]}


def test_store_with_clashing_names(spark):
    import public_tokenizers

    df = spark.createDataFrame([(2, "some text here", 1, "r", b"x"), (1, None, 2, "s", b"y"), (2, "some text here", 3, "t", b"z")], "doc_id long, text string, row int, recipe string, address binary")
    got = sorted(map(tuple, content_store.checksums(content_store.write_store(df, public_tokenizers.path("word_bpe_49k.json"))).collect()))
    assert [g[0] for g in got] == [1, 2, 2] and got[0][1:] == (0, 1, zlib.crc32((1).to_bytes(4, "little"))) and got[1][2] == got[2][2] and got[1][3] == got[2][3]


def test_very_long_payloads(spark):
    long = "<p>" + "x y é " * 400_000 + "</p>"
    df = spark.createDataFrame([(1, "u", long), (2, "v", long), (3, "w", long + "!")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.read_records(warc.write_archives(df)).collect()}
    assert (got[1]["record_type"], got[1]["refers_to"], got[2]["record_type"], got[3]["record_type"]) == ("revisit", 2, "response", "response")
    assert bytes(got[2]["payload"]) == long.encode() and got[1]["payload_bytes"] == len(long.encode())
