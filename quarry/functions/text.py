"""Scalar text functions (F1-F9, T1-T5) as Column expressions.

They are built from ``pyspark.sql.functions`` so they stay inside whole-stage codegen (the higher-order ones run as
interpreted lambdas, still JVM-side).  The JSON functions (F5, F6) alone run in Python, on Arrow batches: each text is
parsed once, by the parser whose rules they promise.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed import CHATML_CLOSE, CHATML_OPEN, FENCE, PLACEHOLDER, WS_CLASS_JAVA


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


#: the characters of ``str.isspace``
PY_WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


# F1 -------------------------------------------------------------------------------------------
def py_strip(col) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace (Python's definition).

    ``trim`` alone only removes spaces.  Named characters are looked for at both ends only, so a text costs no search.
    """
    return F.btrim(_c(col), F.lit(PY_WHITESPACE))


def remove_whitespace(col) -> Column:
    """Drop every whitespace character (``''.join(s.split())``)."""
    return F.regexp_replace(_c(col), f"{WS_CLASS_JAVA}+", "")


def split_whitespace(col) -> Column:
    """``s.split()``: tokens between whitespace runs, no empty tokens."""
    return F.filter(F.split(_c(col), f"{WS_CLASS_JAVA}+"), lambda t: F.length(t) > 0)


# F2 / F3 --------------------------------------------------------------------------------------
def first_piece(col, delimiter: str) -> Column:
    """``s.split(d)[0]`` — the whole string when the delimiter is absent."""
    return F.substring_index(_c(col), delimiter, 1)


def last_segment(col, delimiter: str = "/") -> Column:
    """``s.split('/')[-1]``."""
    return F.substring_index(_c(col), delimiter, -1)


# F4 -------------------------------------------------------------------------------------------
def contains_any(col, needles: Iterable[str]) -> Column:
    """``any(n in s for n in needles)``."""
    arr = F.array(*[F.lit(n) for n in needles])
    return F.exists(arr, lambda n: F.instr(_c(col), n) > 0)


# F5 / F6 / F7 ---------------------------------------------------------------------------------
def _read_json(text):
    """What ``json.loads`` gives, or Ellipsis for anything it refuses."""
    try:
        return json.loads(text) if text is not None else ...
    except (ValueError, RecursionError):
        return ...


def _as_text(value) -> str | None:
    """A JSON value as text; half a surrogate pair, which no column can hold, becomes ``?``."""
    if value is None or isinstance(value, str):
        return value if value is None else value.encode("utf-8", "replace").decode()
    return json.dumps(value, separators=(",", ":"))


def json_truthy_field(col, field: str) -> Column:
    """``json.loads(s).get(field)`` in a try, as text: bad JSON (anything after the value included), non-objects and
    falsy values (``null``, ``false``, 0, ``""``, ``[]``, ``{}``) give NULL.  The last of repeated keys counts."""
    @F.pandas_udf(T.StringType())
    def truthy(texts: pd.Series) -> pd.Series:
        out = []
        for x in texts:
            value = _read_json(x)
            got = value.get(field) if isinstance(value, dict) else None
            out.append(_as_text(got) if got else None)
        return pd.Series(out, dtype="object")

    return truthy(_c(col))


_FIRST = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("text", T.StringType())])


def json_first_element(col, strict: bool = False) -> Column:
    """First element of a JSON array; unparsable input, trailing characters included, gives ``''`` (K5).

    A valid empty array is an error in ``strict`` mode, NULL otherwise; so is a first element ``null``.
    """
    @F.pandas_udf(_FIRST)
    def first_of(texts: pd.Series) -> pd.DataFrame:
        values = [_read_json(x) for x in texts]
        lists = [v if isinstance(v, list) else None for v in values]
        return pd.DataFrame({"n": pd.Series([-1 if v is None else len(v) for v in lists], dtype="int32"),
                             "text": pd.Series([_as_text(v[0]) if v else None for v in lists], dtype="object")})

    whole = first_of(_c(col))
    first = whole["text"]
    if strict:
        first = F.when(whole["n"] == 0, F.raise_error(F.lit("solutions is an empty JSON array"))).otherwise(
            F.coalesce(first, F.raise_error(F.lit("solutions has no text as first element"))))
    return F.when(whole["n"] < 0, F.lit("")).otherwise(first)


def empty_to_null(col) -> Column:
    return F.nullif(_c(col), F.lit(""))


# F8 -------------------------------------------------------------------------------------------
def strict_lookup(mapping: dict, key) -> Column:
    """``mapping[key]``: a missing key raises instead of producing NULL."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    k = _c(key)
    return F.coalesce(F.try_element_at(m, k),
                      F.raise_error(F.concat(F.lit("no entry for key: "), F.coalesce(k, F.lit("NULL")))))


# F9 -------------------------------------------------------------------------------------------
def concat_messages(*cols) -> Column:
    """``list + list`` for message arrays; a NULL side counts as an empty list."""
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return F.concat(*[F.coalesce(_c(c), empty) for c in cols])


def message(role, content) -> Column:
    return F.struct(_lit(role).alias("role"), _c(content).alias("content"))


# T2 -------------------------------------------------------------------------------------------
def fence_cut(col) -> Column:
    """``response.split('```')[0].strip()``."""
    return py_strip(first_piece(col, FENCE))


# T3 -------------------------------------------------------------------------------------------
def earliest_stop(col, stops: list[str]) -> Column:
    """Struct(pos, idx, stop) of the earliest stop string found (first listed wins a tie), or NULL."""
    arr = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(s).alias("stop")) for i, s in enumerate(stops)])
    hits = F.transform(arr, lambda s: F.struct(F.instr(_c(col), s["stop"]).alias("pos"),
                                               s["idx"].alias("idx"), s["stop"].alias("stop")))
    return F.array_min(F.filter(hits, lambda h: h["pos"] > 0))


def stop_truncate(col, stops: list[str]) -> Column:
    """Cut the text before the earliest stop string; unchanged when none occurs."""
    hit = earliest_stop(col, stops)
    return F.when(hit.isNull(), _c(col)).otherwise(F.substring(_c(col), F.lit(1), hit["pos"] - 1))


# T4 / T1 --------------------------------------------------------------------------------------
def render_messages(col, open_marker: str = CHATML_OPEN, close_marker: str = CHATML_CLOSE,
                    role_suffix: str = "\n") -> Column:
    """Render a message array to one string: ``open + role + suffix + content + close`` per turn."""
    return F.array_join(
        F.transform(_c(col), lambda m: F.concat(
            F.lit(open_marker), m["role"], F.lit(role_suffix),
            # a turn without content must not vanish from the prompt
            F.coalesce(m["content"], F.raise_error(F.lit("a turn has no content")).cast("string")), F.lit(close_marker))), "")


def render_cut(col, **markers) -> Column:
    """Render, then cut at the placeholder so generation continues inside the open fence."""
    return first_piece(render_messages(col, **markers), PLACEHOLDER)


# T5 -------------------------------------------------------------------------------------------
def completion_span(rendered, response_template: str) -> Column:
    """Character span that carries loss: everything after the *last* response template.

    Returns struct(loss_start, loss_chars); a text without the template is fully masked
    (loss_start = length, loss_chars = 0).
    """
    r = _c(rendered)
    tail = F.substring_index(r, response_template, -1)
    found = F.instr(r, F.lit(response_template)) > 0
    n = F.length(r)
    return F.struct(
        F.when(found, n - F.length(tail)).otherwise(n).alias("loss_start"),
        F.when(found, F.length(tail)).otherwise(F.lit(0)).alias("loss_chars"),
    )
