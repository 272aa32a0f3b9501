"""Best-fit packing of documents into training sequences under conflicts.

Documents longer than a sequence are cut into full sequences and a remainder.  Remainders, largest first, go to the
bin with the least room that still takes them: bins are ordered by residual capacity, a bit per residual tells which
are taken, and the successor search goes on until the tightest compatible bin is found.  A bin carries a bitmap of
its sources and one of its duplicate clusters: it takes no two documents of one cluster, and of one source no more
than twice that source's fair share of a bin (at least one).

Documents are dealt by hash to cells of about ``CELL_ROWS``; each cell is packed on its own, so a hot source
or cluster is spread evenly and only one partly filled set of bins per cell is lost.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, materialise

CAPACITY = 2048
CELL_ROWS = 20_000

_OUT = "rid long, segment int, start_word long, words int, bin_id long, bin_offset int"


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for every item; items must come largest first."""
    n = len(sizes)
    per_bin = capacity * n / max(1, sum(sizes))
    bits, masks = 0, {}
    for s, c in sorted(Counter(sources).items(), key=lambda x: (-x[1], str(x[0]))):
        slots = max(1, math.ceil(2 * per_bin * c / n))
        masks[s] = ((1 << slots) - 1) << bits
        bits += slots
    twice = [c for c, m in Counter(clusters).items() if m > 1]
    cluster_bit = {c: 1 << i for i, c in enumerate(twice)}
    bins: list[tuple[int, int]] = []  # source bitmap, cluster bitmap
    room: dict[int, dict[int, list[int]]] = defaultdict(dict)  # residual -> source bitmap -> bins
    used = 0  # bit r: a bin has residual r
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        mask, own = masks[source], cluster_bit.get(cluster, 0)
        found = None
        above = used >> size
        r = size - 1
        while above and found is None:
            step = (above & -above).bit_length()
            r += step
            above >>= step
            for have, members in room[r].items():
                if have & mask != mask:
                    i = next((i for i, b in enumerate(members) if not bins[b][1] & own), None) if own else 0
                    if i is not None:
                        found = members.pop(i)
                        if not members:
                            del room[r][have]
                        break
        if found is None:
            found, r, have, dup = len(bins), capacity, 0, 0
            bins.append((0, 0))
        else:
            have, dup = bins[found]
            if not room[r]:
                used &= ~(1 << r)
        free = mask & ~have
        bins[found] = (have | (free & -free), dup | own)
        left = r - size
        out.append((found, capacity - r))
        if left:
            room[left].setdefault(bins[found][0], []).append(found)
            used |= 1 << left
    return out


def _packer(capacity: int):
    def pack_cell(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[0]) << 32
        pdf = pdf.assign(left=pdf["n"] % capacity).sort_values(["left", "h", "rid"], ascending=[False, True, True])
        rows, bins = [], 0
        for rid, n in zip(pdf["rid"], pdf["n"]):
            for k in range(n // capacity):
                rows.append((rid, k, k * capacity, capacity, first + bins, 0))
                bins += 1
        part = pdf[pdf["left"] > 0]
        sources = [None if s is None or s != s else s for s in part["source"]]
        placed = best_fit(part["left"].tolist(), sources, part["cluster"].tolist(), capacity)
        for rid, n, left, (b, at) in zip(part["rid"], part["n"], part["left"], placed):
            rows.append((rid, n // capacity, n - left, left, first + bins + b, at))
        return pd.DataFrame(rows, columns=["rid", "segment", "start_word", "words", "bin_id", "bin_offset"])
    return pack_cell


def pack(docs: DataFrame, *, id_col: str = "doc_id", source: str = "source", size: str = "__size", cluster: str = "__cluster",
         capacity: int = CAPACITY, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Spans ``(id, n_words, segment, start_word, words, bin_id, bin_offset)``: every word of every document lies in one span,
    a bin's spans fill it from offset 0 without overlap up to ``capacity``.

    ``size`` is the number of words (long; NULL: 0), ``cluster`` a long (NULL: a cluster like any other).  A document
    without words gets one row whose span columns are NULL (``words`` 0).  A NULL source is a source like any other.  Repeated rows are
    documents of one cluster.  An empty table gives an empty result.  Other columns are not read, whatever their
    names.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    rows = materialise(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), n.alias("n"),
                                   F.coalesce(F.col(cluster), F.lit(0)).cast("long").alias("cluster")).withColumn(
        "rid", F.monotonically_increasing_id()), "items")
    full = rows.where("n > 0")
    cells = max(1, -(-full.count() // cell_rows))
    items = full.select("rid", "source", "n", "cluster", F.xxhash64("id", "cluster").alias("h"), bucket(cells, "id", "cluster", "rid").alias("cell"))
    spans = items.groupBy("cell").applyInPandas(_packer(capacity), _OUT)
    out = rows.join(spans, "rid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), "segment", "start_word",
                      F.coalesce("words", F.lit(0)).alias("words"), "bin_id", "bin_offset")
