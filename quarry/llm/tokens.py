"""Token counts of whole texts, as a public tokenizer gives them.

Arrow functions encode texts in batches and return lengths only: no token ever reaches Spark.  A task cuts its Arrow batches
into slices of ``SLICE_BYTES`` of text, splits long texts into pieces at safe boundaries (places where the tokenizer's
own word splitting always cuts, so that the pieces' counts add up to the whole text's), and fills encoding batches with
pieces of about ``BATCH_BYTES`` together, so a batch costs the same whatever the texts' lengths are.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_chunks, string_buffers

SLICE_BYTES = 8 << 20
BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 16

#: safe boundaries of byte-level BPE: before a blank or line feed that follows anything but white space, and between ASCII
#: letters and digits; no match of its word pattern spans them, and none looks beyond them
CUT = re.compile(r"(?<=\S)(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")

_LOADED: dict[str, tuple[Callable, bool]] = {}


def _splits_safely(spec: dict) -> bool:
    """Whether texts may be cut at ``CUT`` for this tokenizer: plain byte-level splitting without a normaliser, and no added
    token that holds a boundary or reaches over its own ends."""
    pre = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) \
        and not pre.get("add_prefix_space")
    added = spec.get("added_tokens") or []
    return plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or CUT.search(t["content"]) for t in added)


def load(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """A function from texts to numbers of tokens, and whether texts may be cut at ``CUT``; loaded once per worker process."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), False
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
            from tokenizers import Tokenizer
            with open(path, encoding="utf-8") as f:
                spec = f.read()
            model = Tokenizer.from_str(spec)
            model.no_truncation()
            model.no_padding()
            _LOADED[path] = (lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]), \
                _splits_safely(json.loads(spec))
    return _LOADED[path]


def pieces(text: str, size: int) -> list[str]:
    """The text cut at the first safe boundary after every ``size`` characters; whole where there is none."""
    out, start = [], 0
    while len(text) - start > size:
        m = CUT.search(text, start + size)
        if not m:
            break
        out.append(text[start:m.start()])
        start = m.start()
    out.append(text[start:])
    return out


def counts(texts: list[str], encode: Callable, safe: bool, piece_chars: int = PIECE_CHARS, batch_bytes: int = BATCH_BYTES) -> np.ndarray:
    """Number of tokens of every text."""
    out = np.zeros(len(texts), np.int64)
    batch, owner, used = [], [], 0

    def flush():
        np.add.at(out, owner, encode(batch))
    for i, text in enumerate(texts):
        for piece in pieces(text, piece_chars) if safe else [text]:
            if batch and used + len(piece) > batch_bytes:
                flush()
                batch, owner, used = [], [], 0
            batch.append(piece)
            owner.append(i)
            used += len(piece)
    if batch:
        flush()
    return out


def _counter(tokenizer: str | None, name: str, piece_chars: int, batch_bytes: int):
    def count(batches):
        path = tokenizer
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path(name)
        encode, safe = load(path)
        for b in batches:
            for i, j in row_chunks(string_buffers(b.column("text"))[0], SLICE_BYTES):
                part = b.slice(i, j - i)
                n = counts(part.column("text").to_pylist(), encode, safe, piece_chars, batch_bytes)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(n)], names=["id", "n_bytes", "n_tokens"])
    return count


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None,
                 name: str = "byte_bpe_50k.json", limit: int = 1024, piece_chars: int = PIECE_CHARS,
                 batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row: UTF-8 bytes, tokens of the whole text, and whether these are more
    than ``limit``.

    ``tokenizer`` is the path of a vocabulary file that every executor can read: ``.json`` for the tokenizers library, ``.model``
    for sentencepiece; without it the installed public file ``name`` is looked up by each worker.  Counts are what the library
    gives for the whole text without begin, end or added special tokens, truncation or padding; strings of special tokens
    inside a text are handled as its default.  Texts are cut only where the tokenizer is known to be cut safely (``load``); others
    are encoded whole.

    A NULL or empty text has no bytes and no tokens.  NULL ids, ties and repeated rows are rows like any others, each counted.
    An empty table gives an empty result.  Other columns are not read, whatever their names.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), whole.alias("text"), F.octet_length(whole).cast("long").alias("n_bytes"))
    kind = plain.schema["id"].dataType.simpleString()
    out = plain.mapInArrow(_counter(tokenizer, name, piece_chars, batch_bytes), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
