"""Token counts against the library on whole texts."""

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm.queries import QUERIES
from quarry.llm.tokens import counts, load, pieces, token_counts

SF01 = "/root/testdata/sf0.01"


def whole(name, texts):
    if name.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        return [len(sp.encode(t)) for t in texts]
    t = Tokenizer.from_file(P.path(name))
    t.no_truncation()
    t.no_padding()
    return [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_query_equals_the_library(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").toPandas()
    texts = [t or "" for t in docs["text"]]
    want = {i: (len(t.encode()), n, n > 1024) for i, t, n in zip(docs["doc_id"], texts, whole("byte_bpe_50k.json", texts))}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op13_token_counts"](spark, SF01).collect()}
    assert got == want


alphabet = st.sampled_from(list("ab'sre019 \n\t 　é漢🙂.,-<|>") + ["<|endoftext|>", "'re", "  ", " 1a", "\x1c", "́"])


@settings(max_examples=300, deadline=None)
@given(st.lists(alphabet, max_size=60).map("".join), st.integers(1, 9))
def test_pieces_add_up(text, size):
    encode, safe = load(P.path("byte_bpe_50k.json"))
    assert safe and "".join(pieces(text, size)) == text
    assert counts([text], encode, safe, size, 16).tolist() == whole("byte_bpe_50k.json", [text])


def test_long_texts_are_cut():
    assert max(map(len, pieces("some words here " * 5000, 1000))) < 1100
    assert pieces("x" * 5000, 1000) == ["x" * 5000]  # no boundary: whole


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_odd_rows(spark, odd_docs, no_docs, name):
    rows = odd_docs.select("doc_id", "text").collect()
    texts = [r["text"] or "" for r in rows]
    want = sorted((str(r["doc_id"]), len(t.encode()), n) for r, t, n in zip(rows, texts, whole(name, texts)))
    got = token_counts(odd_docs, tokenizer=P.path(name), piece_chars=64, batch_bytes=1024).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_counts(no_docs, name=name).count() == 0


def test_only_safe_tokenizers_are_cut():
    assert not load(P.path("word_bpe_49k.json"))[1] and not load(P.path("piece_bpe_32k.model"))[1]


def test_clashing_names_and_limit(spark):
    docs = spark.createDataFrame([("a", "one two three", 5, 6)], "key string, body string, id int, n_tokens int")
    r = token_counts(docs, id_col="key", text="body", limit=2).first()
    assert (r["key"], r["n_bytes"], r["n_tokens"], r["over_limit"]) == ("a", 13, 3, True)
    assert not np.isnan(r["n_tokens"])
    assert token_counts(docs, id_col="key", text="body", limit=3).where(F.col("over_limit")).isEmpty()
