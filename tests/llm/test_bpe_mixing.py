"""Problem 7 against the public library and by round trip; problem 8 by its promises."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import bpe, mixing

PATH = bpe.default_tokenizer()
TEXTS = ["", None, " ", "Hello  world\n\n", "aaaaaaaaaaa", "über Straße — “quoted” 12345", "<|endoftext|> is text", "汉字和kana かな", "\u0000​�", "x" * 20_000, "don't we'll THEY'RE", "\t\r\n mixed     space ", "👩‍👩‍👧 emoji"]


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def ids(texts):
    flat, n = bpe.MergeReplay(PATH).encode(texts)
    at, out = 0, []
    for k in n:
        out.append(flat[at : at + k].tolist())
        at += k
    return out


def test_ids_are_the_librarys(public):
    assert ids(TEXTS) == [public(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab thein\n'1é漢"), max_size=30), max_size=5))
def test_any_block_gives_the_same_ids(public, texts):
    assert ids(texts) == [public(t) for t in texts]


def test_round_trip():
    import json

    with open(PATH, encoding="utf-8") as f:
        back = {i: s for s, i in json.load(f)["model"]["vocab"].items()}
    byte = {s: b for b, s in bpe._byte_symbols().items()}
    for t, i in zip(TEXTS, ids(TEXTS)):
        assert bytes(byte[c] for x in i for c in back[x]).decode("utf-8", "surrogatepass") == (t or "")


def test_table_form(spark, public):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(1, None), (None, "x")], "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(0))
    got = bpe.token_ids(df).collect()
    assert len(got) == len(TEXTS) + 2 and {r.doc_id: r.ids for r in got if r.doc_id is not None and r.doc_id > 1} == {i: public(t) for i, t in enumerate(TEXTS) if i > 1}
    assert [r.ids for r in got if r.doc_id == 1] == [[], []]
    n = {r.doc_id: r.n_tokens for r in bpe.token_counts(df, ["doc_id"]).collect()}
    assert n[9] == len(public(TEXTS[9])) and n[0] == 0
    assert bpe.token_ids(df.limit(0)).count() == 0


def corpus(spark):
    rows = [(i, "big", f"word{i} and some more words here " * 3) for i in range(60)] + [(100 + i, "small", "tiny text of its own") for i in range(2)] + [(200, "hot", "q r s t " * 400), (300, None, "x"), (301, "big", None), (302, "big", ""), (303, "other", "y")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("weight", F.lit("clash")).withColumn("n", F.lit(1))


def test_mixture_keeps_its_promises(spark):
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.2, 3), ("hot", 0.2, 1), ("absent", 0.1, 5), ("zero", 0.0, 1), (None, 0.3, 1)], "source string, weight double, max_repeat int")
    m = mixing.mix(corpus(spark), targets, block_tokens=4)
    blocks = m.blocks.collect()
    assert blocks and {r.source for r in blocks} == {"big", "small", "hot"}
    seen = {}
    for r in blocks:
        seen.setdefault((r.doc_id, r.repeat), []).append((r.token_from, r.token_to))
        assert 0 <= r.repeat < {"big": 2, "small": 3, "hot": 1}[r.source]
    for spans in seen.values():  # no token of a document twice in one repeat
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    shares = {r.source: r for r in m.shares.collect()}
    for s, w in (("big", 0.5 / 0.9), ("small", 0.2 / 0.9), ("hot", 0.2 / 0.9)):
        assert shares[s].share == pytest.approx(w, abs=0.12) and shares[s].target_share == pytest.approx(w)
    assert shares["absent"].tokens == 0 and shares["absent"].share == 0
    assert shares["small"].tokens == sum(r.token_to - r.token_from for r in blocks if r.source == "small")
    assert sorted(map(tuple, mixing.mix(corpus(spark), targets, block_tokens=4).blocks.collect())) == sorted(map(tuple, blocks))


def test_nothing_to_mix(spark):
    targets = spark.createDataFrame([("absent", 1.0, 1)], "source string, weight double, max_repeat int")
    m = mixing.mix(corpus(spark), targets)
    assert m.blocks.count() == 0 and m.shares.first().share == 0
    assert mixing.mix(corpus(spark).limit(0), targets.limit(0)).blocks.count() == 0


def test_shares_close_in_on_the_weights(spark):
    rows = [(i, "abc"[i % 3], "many words in this one " * 20) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 1), ("c", 0.1, 1)], "source string, weight double, max_repeat int")
    for r in mixing.mix(docs, targets).shares.collect():
        assert r.share == pytest.approx(r.weight, abs=0.003)
    limited = mixing.mix(docs, targets, total_tokens=1600).shares.agg(F.sum("tokens")).first()[0]
    assert limited == 1600
