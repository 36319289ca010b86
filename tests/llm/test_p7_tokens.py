from __future__ import annotations

import random

import numpy as np
import pytest

from prufspark.llm import tokens

P = pytest.importorskip("public_tokenizers")
ALPHABET = "ab '\n\t  .,!sdtmrevl0123é中　 ’<|endoftext|>́٣²"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda xs: [e.ids for e in t.encode_batch(xs, add_special_tokens=False)]


def test_ids_equal_the_public_encoder(spark, reference):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 5000 + " " * 3000 + "z" * 777, "'s's've''re don't", "<|endoftext|>", "", " ", "\n"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "y")], "doc_id bigint, text string, ids string").repartition(3)
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(df).collect()}
    assert got.pop(-1) == [] and [got[i] for i in range(len(texts))] == reference(texts)


def test_round_trip_and_counts(spark):
    df = spark.createDataFrame([(1, "Größe 中 \n 's"), (2, None)], "doc_id bigint, text string")
    ids = tokens.encode_corpus(df)
    assert ids.select(tokens.decode_ids(ids["ids"]).alias("t")).where("t <> ''").first()["t"] == "Größe 中 \n 's"
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df, ["doc_id"]).collect()}[2] == 0
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_block_scan_equals_a_plain_run():
    nxt, _ = tokens.automaton()
    rng = np.random.default_rng(0)
    for n in (1, 511, 512, 513, 5000):
        c = rng.integers(0, 8, n).astype(np.uint8)
        s, want = tokens.S_OPEN, []
        for x in c:
            want.append(s)
            s = nxt[s, x]
        assert tokens.scan_states(c).tolist() == want


def test_long_merge_equals_short_merge():
    m = tokens.merger(tokens.default_vocabulary_path())
    rng = random.Random(2)
    for _ in range(200):
        raw = bytes(rng.choice(b"abcdeinrst\xc3\xa4") for _ in range(rng.randint(2, 24)))
        if raw not in m.ranks:
            assert m._merge_long(raw) == m.merge(raw)


def test_offsets_decode_parts(spark):
    from pyspark.sql import functions as F

    texts = ["Der Bus hielt.  Dann 123 Leute's Ende\n\n", "", None, "日本語 und ß", "  x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    rows = {r["doc_id"]: r for r in tokens.encode_with_offsets(df).collect()}
    plain = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert r["ids"] == plain[i] and len(r["piece_chars"]) == len(r["piece_ids"])
        for a, b in zip(r["piece_chars"], [*r["piece_chars"][1:], len(t or "")]):
            part = spark.range(1).select(tokens.decode_ids(tokens.ids_between(*(F.array(*[F.lit(x) for x in r[c]]) for c in ("ids", "piece_chars", "piece_ids")), F.lit(a), F.lit(b)))).first()[0] if i == 0 else None
            assert part is None or part == t[a:b]
