
from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_llm import BYTES, WORDS, best_of, brute_groups, documents
from tidewell.llm import near_texts, packing, toxicity, vptree
from tidewell.llm.tokens import Encoder

# ---- pipeline: near copies


def edited(words, n, r):
    words = list(words)
    for i in r.sample(range(len(words)), n):
        words[i] = f"new{r.getrandbits(40)}"
    return words


def test_near_copies_go(spark):
    r = random.Random(8)
    texts = []
    for length, changed in ((100, 1), (200, 2), (200, 3), (500, 5), (500, 8), (200, 9)):  # the last stay: below 0.8
        for _ in range(12):
            words = [f"w{r.getrandbits(40)}" for _ in range(length)]
            texts += [" ".join(words), " ".join(edited(words, changed, r)).upper()]
    words = [f"w{r.getrandbits(40)}" for _ in range(200)]
    for _ in range(12):  # many that share bands: a chain, and texts near one another that are not near enough
        texts.append(" ".join(words := edited(words, 2, r)))
    texts += [" ".join(edited(words, 6, r)) for _ in range(12)] + ["", " \n", "few words", "Few  words"]
    groups = brute_groups(texts)
    docs = documents(spark, texts)
    assert {x["doc_id"]: x["component_id"] for x in near_texts.similar_groups(docs).collect()} == groups
    assert {x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {d for d, g in groups.items() if d == g}
    again = documents(spark, [texts[0], texts[1], texts[24]], [3, 9, 9])  # an id stays where one of its texts does
    assert sorted(x["doc_id"] for x in near_texts.keep_first(again.withColumn("w0", F.lit(1)).withColumn("node", F.lit(2))).collect()) == [3, 9, 9]
    odd = documents(spark, [None, "a b", "a b", ""], [4, None, None, 2])
    assert sorted(str(x["doc_id"]) for x in near_texts.keep_first(odd).collect()) == ["2", "None", "None"]
    assert near_texts.similar_groups(odd.where("false")).count() == 0


# ---- op1: a few long vectors among unit ones


@pytest.mark.parametrize("longest", [6.0, 9.0, 12.0, 20.0, 1000.0])
@pytest.mark.parametrize("many", [1, 5])
def test_long_vectors_leave_the_search_on(longest, many):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1536, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100 : 100 + many] *= longest
    ids, q = np.arange(1536), np.arange(0, 1536, 20)
    for relax, least in ((vptree.RELAX, 0.9), (1.0, 1.0)):
        found, _ = vptree.Tree(ids, x, relax).search(ids[q], x[q], 20)
        assert np.mean([len(set(f) & set(best_of(x, ids.tolist(), i, 20))) / 20 for f, i in zip(found.tolist(), q, strict=True)]) >= least


# ---- op7: spaced and look-alike at once


def test_mixed_disguises_are_read():
    text = "the idiot is a moron and a loser with trash and scum and scorn so stupid and pathetic, an idiot of a clown, a worthless clown " * 50
    c = toxicity.codes("\n" + text + "\n\n")
    d = toxicity.Decoder(toxicity.character_costs(np.bincount((c[:-2] * 64 + c[1:-1]) * 64 + c[2:], minlength=64**3).astype(float).reshape(64, 64, 64)))
    said = {"m 0 r 0 n": "moron", "s c 0 r n": "scorn", "i d 1 0 t": "idiot", "m.0.r.0.n": "moron", "l 0 s e r": "loser", "1 d 1 0 t": "idiot", "t r @ s h": "trash", "$-c-u-m": "scum", "stu" + "u" * 60 + "pid": "stupid", "i  d  i  o  t": "idiot", "i . d . 1 . 0 . t": "idiot", "m--0--r--0--n": "moron"}
    assert {s: d.restore(s) for s in said} == said
    assert d.restore("so m 0 r 0 n!") == "so moron!"
    plain = "1 2 3 4 and 1.2.3, 5 - 6 - 7, a 1"
    assert d.restore(plain) == plain


@given(st.text(st.sampled_from("ab01$!(.  -_*~²é€中\n"), max_size=24))
def test_suspects_are_a_superset(text):
    starts = set(toxicity.suspects(text).tolist())
    begin = [i for i in range(len(text)) if not text[i].isspace() and (i == 0 or text[i - 1].isspace())]
    for b in begin:
        found = toxicity.DISGUISED.match(text, b)
        if found and toxicity._spaced(found.group()) and any(c.isalpha() for c in found.group()):
            assert b in starts


# ---- pipeline: the packed corpus holds its ids


def test_pipeline_ends_in_token_ids(spark):
    docs = documents(spark, ["some words here", "word " * 3000])
    tokenizer = Tokenizer.from_file(BYTES)
    whole = {}
    for r in sorted(corpus_pipeline.pack(spark, docs, "").collect(), key=lambda r: (r["doc_id"], r["piece"])):
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        whole[r["doc_id"]] = whole.get(r["doc_id"], b"") + bytes(r["ids"])
    assert {d: np.frombuffer(b, dtype="<u4").tolist() for d, b in whole.items()} == {r["doc_id"]: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, packing.END_ID] for r in docs.collect()}


# ---- op5, op10: added tokens in texts


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_added_tokens_in_texts_are_the_librarys(path):
    own, tokenizer = Encoder(path), Tokenizer.from_file(path)
    texts = [t for a in ("<|endoftext|>", "<|startoftext|>") for t in (a, f"x{a}y", f"x {a} y", f"{a}{a}", a.upper(), f"a\n{a}\nb", a[:-1], a[1:], f"É {a} 中")] + ["<| x", "plain words"]
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in own.encode(texts)] == expected
    assert any(len(e) == 1 for e in expected)
