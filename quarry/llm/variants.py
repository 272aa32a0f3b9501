"""Spelling variants of the corpus' own words: words one edit apart, by a variable-length gram index.

Words are padded and cut into grams of ``QMIN`` to ``QMAX`` letters.  The gram dictionary is pruned by frequency: a gram is
extended by one letter only while it is frequent (more than 1 / ``FREQUENT`` of all grams of its length), so what a
task needs to decompose words is the bounded list of frequent grams.  A word keeps, from left to right, the longest gram
starting at each letter unless an earlier one covers it.

One edit spoils only the grams that read the edited place and those that a changed gram may cover; the largest number over all
places is the word's affected-gram bound.  Near words thus share all but that many of the grams of either, at places that
differ by at most one.  The lists of a word's rarest grams, one more than its bound, are merged (rarer grams come first for all
words alike); those of its commoner grams need not be read.  Pairs that meet in a list are verified on the whole words.

Words whose bound spares no gram, and the words of lists longer than ``LONG_LIST``, are joined through what is left of them when
one letter is deleted: at most (length + 1) times the alphabet words share one such rest, whatever the vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, mix64

RUN = "[a-zÀ-ÿ]+"
QMIN, QMAX = 2, 4
FREQUENT = 4096
#: grams down to this share have their own place in the order of rarity, rarer ones are ordered by hash
ORDERED = 1 << 16
LONG_LIST = 512

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_P = np.uint64(0x9E3779B97F4A7C15 | 1)


def words(docs: DataFrame, id_col: str, text: str, delete_every: int | None = 97) -> DataFrame:
    """``(word, n)``: runs of letters (A-Z lower-cased) of whole texts, and how often each occurs.  Where ``delete_every`` divides
    the crc32 of ``<id>:<run>``, the run loses one letter (number crc32 % length); a NULL id is the empty string here."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    word: Column = F.col("run")
    if delete_every:
        runs = runs.withColumn("h", F.crc32(F.concat("i", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.char_length("run")).cast("int")
        cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
        word = F.when(F.col("h") % delete_every == 0, cut).otherwise(word)
    return runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------------------------------
# Words are Latin-1 bytes; a batch of them is one flat array with offsets.  A gram of up to seven letters is one number with its
# length on top.
# ------------------------------------------------------------------------------------------------
def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, from 0) and letters of a column of words."""
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return o - o[0], b[o[0]:o[-1]]


def padded(offsets: np.ndarray, letters: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with ``pad`` marks before and after each."""
    n = len(offsets) - 1
    out = np.full(len(letters) + 2 * pad * n, 2, np.uint8)
    o = offsets + 2 * pad * np.arange(n + 1)
    word = np.repeat(np.arange(n), np.diff(offsets))
    out[np.arange(len(letters)) + pad * (2 * word + 1)] = letters
    out[(o[:-1, None] + np.arange(pad)).ravel()] = 1
    return o, out


def grams_at(s: np.ndarray, q: int) -> np.ndarray:
    """The grams of ``q`` letters starting at each place (0 where too few letters follow)."""
    n = max(0, len(s) - q + 1)
    out = np.zeros(len(s), np.int64)
    out[:n] = q
    for d in range(q):
        out[:n] = (out[:n] << 8) | s[d:d + n]
    return out


def _count_grams(qmin: int, qmax: int):
    def count(batches):
        for b in batches:
            o, s = padded(*flat(b.column("word")), qmax - 1)
            room = np.repeat(o[1:], np.diff(o)) - np.arange(len(s))
            for q in range(qmin, qmax):
                gram, c = np.unique(grams_at(s, q)[room >= q], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.full(len(gram), q)), pa.array(c)], names=["gram", "q", "c"])
    return count


def gram_counts(vocabulary: DataFrame, qmin: int, qmax: int) -> tuple[dict[int, int], set[int]]:
    """Counts of the grams that have their own place in the order, and the frequent grams; both are bounded: at most ``ORDERED``
    (``FREQUENT``) grams of a length can hold more than that share of all."""
    c = vocabulary.mapInArrow(_count_grams(qmin, qmax), "gram long, q long, c long").groupBy("q", "gram").agg(F.sum("c").alias("c"))
    c = materialise(c, "grams")
    total = {r["q"]: r["s"] for r in c.groupBy("q").agg(F.sum("c").alias("s")).collect()}  # a row per length
    known: dict[int, int] = {}
    frequent: set[int] = set()
    for q, s in total.items():
        some = c.where((F.col("q") == q) & (F.col("c") > s // ORDERED)).select("gram", "c").collect()
        known |= {r["gram"]: r["c"] for r in some}
        frequent |= {r["gram"] for r in some if r["c"] > s // FREQUENT}
    return known, frequent


def _in(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``x`` in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def decompose(o: np.ndarray, s: np.ndarray, frequent: np.ndarray, qmin: int, qmax: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of padded words: the places (in ``s``) where a gram is kept, the grams, the word of each, and every word's affected-gram bound."""
    place = np.arange(len(s))
    word = np.repeat(np.arange(len(o) - 1), np.diff(o))
    stop = o[1:][word]
    gram = grams_at(s, qmin)
    size = np.full(len(s), qmin)
    longer = open_ = place + qmin <= stop
    for q in range(qmin, qmax):
        longer = longer & _in(frequent, gram)[1]
        more = longer & (place + q < stop)
        gram = np.where(more, grams_at(s, q + 1), gram)
        size[more] += 1
        # a frequent gram at the end of a word would have been extended by another letter
        hungry = longer & ~more
        size = np.where(hungry, -q, size)
        longer = more
    hungry, size = size < 0, np.abs(size)
    last = np.where(open_, place + size - 1, -1)
    reach = np.where(hungry, stop, last)
    covered = np.maximum.accumulate(last) if len(last) else last
    kept = open_ & (last > np.r_[-1, covered[:-1]])
    # an edit at place i spoils what is kept from the first gram that depends on i, and what lies within a new gram's reach
    before = np.r_[0, np.cumsum(kept)]
    first = place.copy()
    for d in range(1, qmax + 1):
        p = place - d
        ok = (p >= 0) & (word[p] == word)
        first = np.where(ok & (reach[p] >= place), p, first)
    spoilt = before[place + 1] - before[first]
    for d in range(1, qmax):
        p = np.minimum(place + d, len(s) - 1)
        spoilt += (place + d < stop) & kept[p] & (last[p] <= place + qmax - 1)
    pad = qmax - 1
    spoilt[(place < o[:-1][word] + pad) | (place > stop - pad)] = 0
    most = np.maximum.reduceat(spoilt, o[:-1]) if len(s) else np.zeros(0, np.int64)
    at = np.flatnonzero(kept)
    return at, gram[at], word[at], most


def _key(gram: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    x = mix64(gram.view(np.uint64)) + place.astype(np.uint64) * _P
    return mix64(mix64(x) + length.astype(np.uint64)).view(np.int64)


_ENTRY = "key long, word binary, n long, guest boolean"


def _entries(b: pa.RecordBatch, key: pa.Array, at: np.ndarray, guest: np.ndarray) -> pa.RecordBatch:
    pick = pa.array(at)
    return pa.RecordBatch.from_arrays([key, b.column("word").take(pick), b.column("n").take(pick), pa.array(guest)], names=["key", "word", "n", "guest"])


def _postings(known: dict[int, int], frequent: set[int], qmin: int, qmax: int):
    """``(key, word, n, guest)``: entries of the lists a word is merged in; ``key`` stands for a gram, its place and a word length.
    Words meet words of their own length at home and one letter longer as guests.  ``key`` is NULL where the bound spares no gram."""
    grams = np.array(sorted(known), np.int64)
    count = np.r_[np.array([known[g] for g in grams.tolist()], np.int64), 0]
    often = np.array(sorted(frequent), np.int64)

    def post(batches):
        for b in batches:
            offsets, letters = flat(b.column("word"))
            o, s = padded(offsets, letters, qmax - 1)
            at, gram, word, most = decompose(o, s, often, qmin, qmax)
            slot, there = _in(grams, gram)
            order = np.lexsort((at, mix64(gram.view(np.uint64)), count[np.where(there, slot, -1)], word))
            at, gram, word = at[order], gram[order], word[order]
            n = np.bincount(word, minlength=len(b))
            rank = np.arange(len(word)) - (np.cumsum(n) - n)[word]
            rare = rank <= most[word]
            at, gram, word = at[rare], gram[rare], word[rare]
            place, length = at - o[:-1][word], np.diff(offsets)[word]
            key = np.concatenate([_key(gram, place, length), _key(gram, place, length + 1), _key(gram, place + 1, length + 1)])
            yield _entries(b, pa.array(key), np.tile(word, 3), np.arange(3 * len(word)) >= len(word))
            bare = np.flatnonzero(most >= n)
            if len(bare):
                yield _entries(b, pa.nulls(len(bare), pa.int64()), bare, np.zeros(len(bare), bool))
    return post


def _rests(batches):
    """``(key, word, n, guest)``: a hash of the word, and of it without each of its letters."""
    for b in batches:
        o, s = flat(b.column("word"))
        if not len(s):
            continue
        size = np.diff(o)
        word = np.repeat(np.arange(len(b)), size)
        k = np.arange(len(s)) - o[:-1][word]
        power = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max()), _P)], dtype=np.uint64)
        value = mix64(s.astype(np.uint64) + np.uint64(1))
        left = np.r_[np.uint64(0), np.cumsum(value * power[k], dtype=np.uint64)]
        right = np.r_[np.uint64(0), np.cumsum(np.where(k > 0, value * power[k - 1], np.uint64(0)), dtype=np.uint64)]
        whole = left[o[1:]] - left[o[:-1]]
        i = np.flatnonzero((k == 0) | (s != np.r_[s[:1], s[:-1]]))  # of a run of equal letters one is enough
        rest = left[i] - left[o[:-1][word[i]]] + right[o[1:][word[i]]] - right[i + 1]
        at = np.concatenate([np.arange(len(b)), word[i]])
        yield _entries(b, pa.array(mix64(np.concatenate([whole, rest])).view(np.int64)), at, np.zeros(len(at), bool))


#: words of more letters are compared one pair after the other
_WIDE = 64
#: candidate pairs compared together
_TOGETHER = 1 << 18


def _one_apart(wide: np.ndarray, next_: np.ndarray, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Which pairs of rows are one edit apart: of the ``same`` length, else ``b`` one letter longer; ``next_`` is ``wide`` without
    first letters."""
    differ = wide[a] != wide[b]
    out = np.zeros(len(a), bool)
    out[same] = differ[same].sum(axis=1) == 1
    x = np.flatnonzero(~same)
    if len(x):
        head = differ[x].argmax(axis=1)  # they do differ: the longer has a letter where the other has none
        tail = wide[a[x]] != next_[b[x]]
        out[x] = ~(tail & (np.arange(wide.shape[1]) >= head[:, None])).any(axis=1)
    return out


def _slow_apart(a: bytes, b: bytes) -> bool:
    n = len(a)
    i = next((i for i in range(n) if a[i] != b[i]), n)
    return a[i + 1:] == b[i + 1:] and i < n if n == len(b) else a[i:] == b[i + 1:]


def near_pairs(o: np.ndarray, s: np.ndarray, guest: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of near words that stand in one list; the lists are the row ranges ``first`` .. ``last`` (excluded).  Guests are compared
    with the others only."""
    size = np.diff(o)
    width = int(min(size.max(initial=0), _WIDE)) + 1
    wide = np.zeros((len(size), width), np.uint8)
    word = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(s)) - o[:-1][word]
    fits = k < width - 1
    wide[word[fits], k[fits]] = s[fits]
    next_ = np.concatenate([wide[:, 1:], np.zeros((len(size), 1), np.uint8)], axis=1)
    # row i meets the rows behind it in its list
    row = np.repeat(first, last - first) + np.arange((last - first).sum()) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
    more = np.repeat(last, last - first) - row - 1
    done = np.cumsum(more)
    found = []
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + _TOGETHER, "right")))
        m = more[lo:hi]
        a = np.repeat(row[lo:hi], m)
        b = a + 1 + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        lo = hi
        a, b = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
        ok = (size[b] - size[a] <= 1) & ~(guest[a] & guest[b])
        a, b = a[ok], b[ok]
        big = size[b] > _WIDE
        hit = np.zeros(len(a), bool)
        hit[~big] = _one_apart(wide, next_, a[~big], b[~big], size[a[~big]] == size[b[~big]])
        for x in np.flatnonzero(big).tolist():
            hit[x] = _slow_apart(s[o[a[x]]:o[a[x] + 1]].tobytes(), s[o[b[x]]:o[b[x] + 1]].tobytes())
        found.append(np.stack([a[hit], b[hit]]))
    a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return np.r_[a, b], np.r_[b, a]


_PAIRS = "word binary, n long, near binary, near_n long, long boolean"


def _merge(limit: int | None):
    """Near pairs of every run of equal ``key`` (rows are sorted by it).  A list of more than ``limit`` entries is not compared: its
    words are returned, marked ``long``.  No more than the limit and a batch is held of such a list."""
    def pairs(b, x, y):
        x, y = pa.array(x), pa.array(y)
        return pa.RecordBatch.from_arrays([b.column("word").take(x), b.column("n").take(x), b.column("word").take(y), b.column("n").take(y),
                                           pa.array(np.zeros(len(x), bool))], names=["word", "n", "near", "near_n", "long"])

    def long(b):
        n = len(b)
        return pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()),
                                           pa.array(np.ones(n, bool))], names=["word", "n", "near", "near_n", "long"])

    def work(b, over_first: bool):
        key = b.column("key").to_numpy()
        cut = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
        size = np.diff(cut)
        too_long = size > limit if limit else np.zeros(len(size), bool)
        too_long[0] |= over_first
        if too_long.any():
            yield long(b.take(pa.array(np.flatnonzero(np.repeat(too_long, size)))))
        some = ~too_long & (size > 1)
        if some.any():
            o, s = flat(b.column("word"))
            x, y = near_pairs(o, s, b.column("guest").to_numpy(zero_copy_only=False), cut[:-1][some], cut[1:][some])
            if len(x):
                yield pairs(b, x, y)

    def run(batches):
        kept, over = None, None  # the last list so far; the key of a long one of which nothing is kept
        for b in batches:
            if kept is not None:
                b = pa.concat_batches([kept, b])
                kept = None
            if not len(b):
                continue
            key = b.column("key").to_numpy()
            cut = int(np.searchsorted(key == key[-1], True))
            if limit and len(b) - cut > limit:
                yield from work(b, over is not None and key[0] == over)
                over = key[-1]
                continue
            if over is not None and key[-1] == over:
                yield from work(b, key[0] == over)
                continue
            kept = b.slice(cut)
            if cut:
                yield from work(b.slice(0, cut), over is not None and key[0] == over)
        if kept is not None and len(kept):
            yield from work(kept, over is not None and kept.column("key")[0].as_py() == over)
    return run


def near_words(vocabulary: DataFrame, qmin: int = QMIN, qmax: int = QMAX, long_list: int = LONG_LIST) -> DataFrame:
    """``(word, n, near, near_n)``: every pair of words of ``vocabulary`` (word as Latin-1 bytes, n; written) that are exactly one
    inserted, deleted or replaced letter apart, in both directions, once each."""
    known, frequent = gram_counts(vocabulary, qmin, qmax)
    posted = materialise(vocabulary.mapInArrow(_postings(known, frequent, qmin, qmax), _ENTRY), "postings")
    lists = posted.where("key is not null").repartition("key").sortWithinPartitions("key")
    merged = materialise(lists.mapInArrow(_merge(long_list), _PAIRS), "merged")
    left = posted.where("key is null").select("word", "n").unionByName(merged.where("long").select("word", "n")).distinct()
    rests = left.mapInArrow(_rests, _ENTRY).repartition("key").sortWithinPartitions("key")
    rest = rests.mapInArrow(_merge(None), _PAIRS)
    return merged.where("not long").unionByName(rest).select("word", "n", "near", "near_n").distinct()


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", min_length: int = 5, min_count: int = 3,
                      ratio: int = 2, delete_every: int | None = 97, qmin: int = QMIN, qmax: int = QMAX,
                      long_list: int = LONG_LIST) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every distinct word of at least ``min_length`` letters that occurs at least
    ``min_count`` times in the whole texts: its near words' number, its form (the near word of largest n, ties to the smallest in
    code-point order, if that n is at least ``ratio`` times the word's, else NULL) and its root (where the forms lead to; the word
    itself without a form).  ``ratio`` is at least 2, so that forms never lead in a circle.

    A NULL or empty text has no words; a NULL id counts as an empty string where it is hashed (see ``words``).  Repeated rows
    count each.  Words of any length take part.  An empty table gives an empty result.  Other columns are not read, whatever
    their names.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    counted = words(docs, id_col, text, delete_every)
    counted = counted.where((F.char_length("word") >= min_length) & (F.col("n") >= min_count))
    vocabulary = materialise(counted.select(F.encode("word", "ISO-8859-1").alias("word"), "n"), "vocabulary")
    pairs = near_words(vocabulary, qmin, qmax, long_list)
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    form_n = -F.col("best.less")
    formed = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(form_n >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), form_n.alias("form_n"))).alias("f"))
    formed = materialise(formed.select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.form_n").alias("form_n")), "forms")
    # every step doubles the way; n doubles from form to form, so a word's way has at most 63 forms
    to = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = materialise(to.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if to.where("moved").isEmpty():
            break
        to = to.drop("moved")
    spelt = lambda c: F.decode(c, "ISO-8859-1")
    return formed.join(to.select("word", "root"), "word", "left").select(
        spelt(F.col("word")).alias("word"), spelt(F.col("form")).alias("form"), spelt(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n")
