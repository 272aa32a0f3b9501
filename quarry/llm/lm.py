"""Scoring texts with a weighted backoff automaton learnt from the corpus.

Tokens are words (A-Z lower-cased) and one end token per text.  Every token and every n-gram of up to three tokens (the
start of a text counts as one) is counted, at any size of the corpus.  Histories are states: every word, the pairs
seen at least ``MIN_COUNT`` times, and the start of a text; these are absolute counts, so more text only adds states.  From
a state there is an arc for every word seen at least ``MIN_COUNT`` times after it, weighted by absolute discounting,

    p(w | h) = (c(h w) - DISCOUNT) / c(h) + rest(h) * p(w | shorter h),

and a failure arc of weight ``rest(h)`` (what the discounts leave) to the state of the longest shorter history.  At the root,
p(w) = (c(w) + 1) / (N + V + 1).  The probabilities after any history sum to one.

No task holds the model.  Texts are read once: blocks hold their tokens as numbers of the block's distinct words.  A block sends its distinct pairs and triples once, as packed pieces: the first
words, under each the pairs (40 bits of their hash), under each pair its triples (40 bits again), all with the block's own counts.
Pieces go by the hash of the first word (of the pair, if that word holds more than a bucket's share) to buckets, in ``ROUNDS``
rounds, where a pair meets all its triples; there whole counts and what a pair's arcs keep
are known, and every block is told, by place in its piece, those that differ from its own.  What the arcs of words keep is summed over the
buckets; with the words' counts it reaches the blocks in packed pieces too, which ask for their words by bucket and are answered by place.  A pair of two words that each hold more than a bucket's
share has its triples spread over the buckets by their own hash, and what its arcs keep is summed like a word's; so a bucket is
bounded whatever the texts.  A block then builds the part of the automaton that its texts can reach and follows every text through it from
left to right, all texts a token at a time.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise, mix64, string_buffers, word_chunks

MIN_COUNT = 2
DISCOUNT = 0.75
BLOCK_BYTES = 3 << 20
BUCKET_BYTES = 5 << 20
ROUNDS = 2
#: bytes of a part of a hash
RAW = 5
#: a finished query, and so its shuffle files, is held until its events are handled and the next query has run
SETTLE_S = 1.0
#: tokens that a state knows, and tokens of a text that are followed at once
HISTORY, PART = 2, 128
END, START = (int(mix64(np.array([x], np.uint64)).view(np.int64)[0]) for x in (0x454E44, 0x5354415254))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts of a column, text after text, and the number of tokens of each."""
    parts, count = [], np.zeros(len(col), np.int64)
    for i, j, row, word in word_chunks(col):
        n = np.bincount(row, minlength=j - i) + 1
        out = np.full(n.sum(), END, np.int64)
        out[np.arange(len(word)) + row] = word.view(np.int64)
        parts.append(out)
        count[i:j] = n
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), count


def _rows(**arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays.values()], names=list(arrays))


def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of ``x`` in a sorted table, -1 where it isn't there."""
    if not len(table):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def _before(x: np.ndarray, first) -> np.ndarray:
    """What stands at the token before."""
    return np.concatenate([np.array([first], x.dtype), x[:-1]])[:len(x)]


def _hash(history: np.ndarray, x: np.ndarray) -> np.ndarray:
    return mix64(history.view(np.uint64) * _STEP + x.view(np.uint64)).view(np.int64)


def _docs(batches):
    """The blocks of a table of blocks, one by one: number, ids, held out, distinct words, which of them each token is, tokens of each
    text, which are trained on."""
    for b in batches:
        for block, rows, words in zip(b.column("block").to_pylist(), b.column("rows"), b.column("words")):
            docs = pa.ipc.open_stream(rows.as_buffer()).read_all().combine_chunks()
            step, word_at = _unpack(words.as_py(), (8, 4))
            held_out, n = docs.column("held_out").to_numpy(), docs.column("n").to_numpy()
            yield block, docs.column("id"), held_out, np.cumsum(step), word_at, n, np.repeat(~held_out.astype(bool), n)


def _count(batches):
    """Distinct tokens that are trained on, and their counts."""
    for _, _, _, word, word_at, _, trained in _docs(batches):
        c = np.bincount(word_at[trained], minlength=len(word))
        yield _rows(key=word[c > 0], c=c[c > 0])


def _blocks(size: int):
    """Consecutive rows of a task as blocks of about ``size`` bytes of text, a block a row: ids and lengths, and the tokens as numbers
    of the block's distinct words, so that texts are read once."""
    def block(rows: list[pa.RecordBatch], at: int, used: int) -> pa.RecordBatch:
        docs = pa.Table.from_batches(rows).combine_chunks()
        t, n = tokens(docs.column("text").chunk(0))
        word, _, word_at = _unique(t)
        docs = docs.drop_columns("text").append_column("n", pa.array(n))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(docs)
        return _rows(at=[at], bytes=[used], rows=[sink.getvalue().to_pybytes()], words=[_pack([(np.diff(word, prepend=0), 8), (word_at, 4)])])

    def number(batches):
        rows, at, used = [], 0, 0
        for b in batches:
            first = 0
            for i, n in enumerate(np.diff(string_buffers(b.column("text"))[0]).tolist()):
                if used and used + n > size:
                    rows.append(b.slice(first, i - first))
                    yield block(rows, at, used)
                    rows, first, at, used = [], i, at + 1, 0
                used += n + 1
            if first < b.num_rows:
                rows.append(b.slice(first))
        if rows:
            yield block(rows, at, used)
    return number


def _unique(key: np.ndarray):
    """Distinct keys in order, a place of each, and which of them each place holds."""
    order = np.argsort(key)
    rep, inverse = _runs(order, _changes(key[order]))
    return key[rep], rep, inverse


def _changes(x: np.ndarray) -> np.ndarray:
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return new


def _sorted(x: np.ndarray) -> np.ndarray:
    """The distinct numbers of an array, in order."""
    x = np.sort(x)
    return x[_changes(x)]


class Grams:
    """The distinct words, pairs and triples of a block's texts, and which of them ends at each token (-1: none).

    ``pair`` and ``triple`` are ordered as their pieces are sent: by bucket, first word, pair and triple.  ``words`` (sorted) are the only
    ones in pairs and triples, where given; ``hot`` (sorted) are those whose pairs are spread.  With ``only``, what goes to buckets of
    that round alone is looked at.
    """

    def __init__(self, word: np.ndarray, word_at: np.ndarray, n: np.ndarray, trained: np.ndarray, words: np.ndarray | None, hot: np.ndarray,
                 buckets: int, only: int | None = None):
        self.word, self.word_at, self.first, m = word, word_at, np.zeros(len(word_at), bool), len(word)
        self.first[np.cumsum(n) - n] = True
        known = np.ones(len(word_at), bool) if words is None else (_find(words, word) >= 0)[word_at]
        often = (_find(hot, word) >= 0)[word_at]
        left = _before(word_at, m)
        left[self.first] = m
        two = known & (_before(known, False) | self.first)
        three = known & _before(two, False) & ~self.first
        table = np.r_[word, START]
        rank = _inverse(np.argsort(table.view(np.uint64), kind="stable"))
        # pairs, by bucket, first word and 40 bits of their hash
        at = np.flatnonzero(two)
        key = _hash(table[left[at]], word[word_at[at]])
        wide = self.first[at] | _before(often, False)[at]  # pairs of a hot first word go by their own hash, others by that word's
        word_home = _modulo(table, buckets)
        home = word_home[left[at]]
        home[wide] = _modulo(key[wide], buckets)
        spread = wide & often[at]
        self.round = only
        if only is not None:
            here = (home % ROUNDS == only) | spread
            at, key, home, wide, spread = at[here], key[here], home[here], wide[here], spread[here]
        first_word = left[at]
        group = home[wide] * (m + 1) + rank[first_word[wide]]
        word_group = word_home * (m + 1) + rank
        groups = _sorted(np.r_[word_group, _sorted(group)])
        major = np.searchsorted(groups, word_group)[first_word]
        major[wide] = np.searchsorted(groups, group)
        part = key.view(np.uint64) >> np.uint64(24)
        rep, inverse, self.pair_own = _distinct(major, part, len(groups), trained[at])
        self.pair, self.pair_rep, self.spread, self.pair_part, self.pair_bucket = key[rep], at[rep], spread[rep], part[rep], home[rep]
        first_word = first_word[rep]
        self.pair_u = table[first_word]
        self.pair_at = np.full(len(word_at), -1, np.int64)
        self.pair_at[at] = inverse
        del at, key, wide, home, spread, major, part, rep, inverse, left, known, often, two
        # triples, by the place of their pair
        parent = _before(self.pair_at, -1)
        at = np.flatnonzero(three & (parent >= 0))
        parent = parent[at]
        key = _hash(self.pair[parent], word[word_at[at]])
        wide = self.spread[parent]
        if only is not None and wide.any():
            here = ~wide
            here[wide] = _modulo(key[wide], buckets) % ROUNDS == only
            at, parent, key, wide = at[here], parent[here], key[here], wide[here]
        # a spread pair has a node of its own in every bucket where triples of it lie
        pairs = len(self.pair)
        apart = _modulo(key[wide], buckets) * pairs + parent[wide]
        extra = _sorted(apart)
        extra_bucket, extra_pair = np.divmod(extra, max(pairs, 1))
        node_bucket, node_pair = np.r_[self.pair_bucket, extra_bucket], np.r_[np.arange(pairs), extra_pair]
        node_kind = np.r_[self.spread.astype(np.int64), np.full(len(extra), 2)]  # 0 plain, 1 spread: its count, 2 spread: some triples
        by = np.argsort(node_bucket * (m + 1) + rank[first_word[node_pair]], kind="stable")
        place = _inverse(by)
        node = place[parent]
        node[wide] = place[pairs + np.searchsorted(extra, apart)]
        part = key.view(np.uint64) >> np.uint64(24)
        rep, inverse, self.triple_own = _distinct(node, part, len(by), trained[at])
        self.node_pair, self.node_kind, self.node_bucket = node_pair[by], node_kind[by], node_bucket[by]
        self.triple_rep, self.parent, self.triple_part = at[rep], parent[rep], part[rep]
        self.arcs = np.bincount(node[rep], minlength=len(by))
        self.buckets, self.node_from = np.unique(self.node_bucket, return_index=True)
        self.node_from = np.r_[self.node_from, len(by)]
        self.triple_from = np.r_[0, np.cumsum(self.arcs)][self.node_from]

    def spread_pairs(self) -> np.ndarray:
        """Identities of the spread pairs, by which the buckets name them."""
        return _identity(self.pair_u, self.pair_part)

    def pieces(self):
        """``(bucket, packed piece)`` of every bucket that holds something of the block."""
        for i, bucket in enumerate(self.buckets.tolist()):
            if self.round is not None and bucket % ROUNDS != self.round:
                continue
            nodes = slice(self.node_from[i], self.node_from[i + 1])
            triples = slice(self.triple_from[i], self.triple_from[i + 1])
            pair = self.node_pair[nodes]
            u, start, of = np.unique(self.pair_u[pair].view(np.uint64), return_index=True, return_counts=True)
            own = np.where(self.node_kind[nodes] == 2, 0, self.pair_own[pair])
            yield bucket, _pack([(np.diff(u, prepend=np.uint64(0)), 8), (of, 4), (self.pair_part[pair], 5), (own, 4), (self.node_kind[nodes], 1),
                                 (self.arcs[nodes], 4), (self.triple_part[triples], 5), (self.triple_own[triples], 4)])


def _runs(order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each run of equals in ``order``, and the run of each place."""
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def _distinct(major: np.ndarray, part: np.ndarray, size: int, trained: np.ndarray):
    """Distinct pairs of a number under ``size`` and 40 bits, ordered by both: a place of each, which of them each place holds, and how
    often each stands in texts that are trained on."""
    if size < 1 << 23:
        code = (major << 40) | part.view(np.int64)
        order = np.argsort(code)
        new = _changes(code[order])
    else:
        order = np.lexsort((part, major))
        new = _changes(major[order]) | _changes(part[order])
    rep, inverse = _runs(order, new)
    return rep, inverse, np.bincount(inverse[trained], minlength=len(rep))


def _modulo(key: np.ndarray, n: int) -> np.ndarray:
    return (key.view(np.uint64) % np.uint64(n)).astype(np.int64)


def _inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _identity(u: np.ndarray, part: np.ndarray) -> np.ndarray:
    return _hash(u.view(np.int64), part.view(np.int64))


def _pack(columns) -> bytes:
    """Arrays of unsigned numbers of so many bytes each, byte by byte and compressed; parts of hashes (``RAW`` bytes) are as they are."""
    raw, plain = [], []
    for x, width in columns:
        (plain if width == RAW else raw).append(np.ascontiguousarray(np.asarray(x).astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    sizes = np.array([len(x) for x, _ in columns], np.int64).tobytes()
    whole = b"".join(raw)
    z = pa.compress(whole, "zstd", asbytes=True)
    return b"".join([sizes, len(z).to_bytes(8, "little"), z, *plain])


def _unpack(blob: bytes, widths) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(widths)).tolist()
    at = 8 * len(widths)
    z = int.from_bytes(blob[at:at + 8], "little")
    packed = sum(n * w for n, w in zip(sizes, widths) if w != RAW)
    raw = np.frombuffer(pa.decompress(blob[at + 8:at + 8 + z], packed, "zstd", asbytes=True), np.uint8)
    plain = np.frombuffer(blob, np.uint8, offset=at + 8 + z)
    out, ends = [], [0, 0]
    for n, width in zip(sizes, widths):
        of, source = (0, plain) if width == RAW else (1, raw)
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = source[ends[of]:ends[of] + n * width].reshape(width, n).T
        ends[of] += n * width
        out.append(x.reshape(-1).view(np.int64))
    return out


class _Table:
    """Places of distinct keys, found by a part of their hash."""

    def __init__(self, key: np.ndarray):
        self.shift = np.uint64(64 - max(1, (2 * len(key)).bit_length()))
        slot = self._slot(key)
        order = np.argsort(slot)
        self.key, self.place = np.r_[key[order], -1], np.r_[order, -1]
        self.begin = np.r_[0, np.cumsum(np.bincount(slot, minlength=1 << (64 - int(self.shift))))]

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return ((x.view(np.uint64) * _STEP) >> self.shift).view(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places of ``x``, none of them negative, -1 where it isn't there."""
        slot = self._slot(x)
        at, until = self.begin[slot], self.begin[slot + 1]
        out = np.where(self.key[at] == x, self.place[at], -1)
        left, at = np.flatnonzero((out < 0) & (at + 1 < until)), at + 1
        while len(left):
            here = self.key[at[left]] == x[left]
            out[left[here]] = self.place[at[left[here]]]
            at[left] += 1
            left = left[~here & (at[left] < until[left])]
        return out


_PIECE, _REPLY = (8, 4, 5, 4, 1, 4, 5, 4), (8, 8, 8, 8, 8, 8)
_REPLIES = "block long, bucket long, key long, c long, arcs long, piece binary"


def _send(words: np.ndarray | None, hot: np.ndarray, buckets: int, only: int):
    def send(batches):
        for block, _, _, word, word_at, n, trained in _docs(batches):
            for bucket, piece in Grams(word, word_at, n, trained, words, hot, buckets, only).pieces():
                yield _rows(block=[block], bucket=[bucket], piece=[piece])
    return send


def _tally(min_count: int):
    """A bucket's pieces are added up; replies name those pairs and triples, by place in the piece, whose count is not the block's own
    (counts under ``min_count`` make no arc, so they need none).  Rows without a block say what arcs of words and of spread pairs keep."""
    def tally(pieces: pa.Table) -> pa.Table:
        read, us, pair_of, triple_of = [], [], [], []
        for x in pieces.column("piece"):
            step, of, part, own, kind, arcs, part3, own3 = _unpack(x.as_py(), _PIECE)
            us.append(np.repeat(np.cumsum(step), of))
            pair_of.append(_identity(us[-1], part))
            triple_of.append(_hash(np.repeat(pair_of[-1], arcs), part3))
            read.append((own.astype(np.uint32), kind.astype(np.uint8), arcs.astype(np.uint32), own3.astype(np.uint32)))
        pair, first, of = _unique(np.concatenate(pair_of))
        c2 = np.bincount(of, weights=np.concatenate([r[0] for r in read]), minlength=len(pair)).astype(np.int64)
        wide = np.zeros(len(pair), bool)
        wide[of[np.concatenate([r[1] for r in read]) > 0]] = True
        del pair_of
        triple_of = np.concatenate(triple_of)
        _, rep, of3 = _unique(triple_of)
        del triple_of
        c3 = np.bincount(of3, weights=np.concatenate([r[3] for r in read]), minlength=len(rep)).astype(np.int64)
        parent = of[np.repeat(np.arange(len(of)), np.concatenate([r[2] for r in read]))[rep]] if len(rep) else rep
        arc = c3 >= min_count
        kept_c = np.bincount(parent[arc], weights=c3[arc], minlength=len(pair)).astype(np.int64)
        kept_n = np.bincount(parent[arc], minlength=len(pair))
        out = {"block": [], "bucket": [], "piece": []}
        at2 = at3 = 0
        for r, block, bucket in zip(read, pieces.column("block").to_pylist(), pieces.column("bucket").to_pylist()):
            mine, mine3 = of[at2:at2 + len(r[1])], of3[at3:at3 + len(r[3])]
            at2, at3 = at2 + len(r[1]), at3 + len(r[3])
            told = np.flatnonzero((c2[mine] >= min_count) & (r[1] < 2))
            told3 = np.flatnonzero((c3[mine3] >= min_count) & (c3[mine3] != r[3]))
            if len(told) or len(told3):
                out["block"].append(block)
                out["bucket"].append(bucket)
                out["piece"].append(_pack([(np.diff(told, prepend=0), 8), (c2[mine[told]], 8), (kept_c[mine[told]], 8), (kept_n[mine[told]], 8),
                                           (np.diff(told3, prepend=0), 8), (c3[mine3[told3]], 8)]))
        u = np.concatenate(us)[first]
        arc = c2 >= min_count
        words, w = np.unique(u[arc], return_inverse=True)
        some = wide & (kept_n > 0)
        key = np.r_[words, pair[some]]
        c = np.r_[np.bincount(w, weights=c2[arc], minlength=len(words)).astype(np.int64), kept_c[some]]
        arcs = np.r_[np.bincount(w, minlength=len(words)), kept_n[some]]
        m, k = len(out["block"]), len(key)
        return pa.table({"block": pa.array(out["block"] + [None] * k, pa.int64()), "bucket": pa.array(out["bucket"] + [None] * k, pa.int64()),
                         "key": pa.array([None] * m + key.tolist(), pa.int64()), "c": pa.array([None] * m + c.tolist(), pa.int64()),
                         "arcs": pa.array([None] * m + arcs.tolist(), pa.int64()), "piece": pa.array(out["piece"] + [None] * k, pa.binary())})
    return tally


def _asked(word: np.ndarray, word_at: np.ndarray, n: np.ndarray, hot: np.ndarray, buckets: int):
    """Distinct words and spread pairs of a block, and START, by bucket: keys, and where each bucket's begin."""
    first = np.zeros(len(word_at), bool)
    first[np.cumsum(n) - n] = True
    often = (_find(hot, word) >= 0)[word_at]
    wide = np.flatnonzero(often & (first | _before(often, False)))
    left = np.where(first, START, word[_before(word_at, 0)])[wide]
    pairs = _identity(left, _hash(left, word[word_at[wide]]).view(np.uint64) >> np.uint64(24))
    key = _sorted(np.r_[word, pairs, np.int64(START)])
    home = key % buckets
    order = np.argsort(home, kind="stable")
    return key[order], np.searchsorted(home[order], np.arange(buckets + 1))


def _ask(hot: np.ndarray, buckets: int):
    """What ``_asked`` gives as packed pieces, one for each bucket."""
    def ask(batches):
        for block, _, _, word, word_at, n, _ in _docs(batches):
            key, cut = _asked(word, word_at, n, hot, buckets)
            pieces = [(i, _pack([(np.diff(key[cut[i]:cut[i + 1]], prepend=0), 8)])) for i in range(buckets) if cut[i] < cut[i + 1]]
            yield _rows(block=[block] * len(pieces), bucket=[i for i, _ in pieces], piece=[p for _, p in pieces])
    return ask


_ANSWERS = "block long, bucket long, piece binary"


def _answer(asked: pa.Table, model: pa.Table) -> pa.Table:
    """Counts of the keys asked for, and the counts and number of the arcs that they keep, added up over ``model``; buckets count from -1 down."""
    key, _, of = _unique(model.column("key").to_numpy())
    total = [np.r_[np.bincount(of, weights=model.column(x).to_numpy(), minlength=len(key)).astype(np.int64), 0] for x in ("c", "kept", "arcs")]
    out = []
    for piece in asked.column("piece"):
        at = _find(key, np.cumsum(_unpack(piece.as_py(), (8,))[0]))
        out.append(_pack([(x[at], 8) for x in total]))
    return pa.table({"block": asked.column("block"), "bucket": pa.array(-1 - asked.column("bucket").to_numpy(), pa.int64()),
                     "piece": pa.array(out, pa.binary())})


_SCORES = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def walk(texts, word: Sequence[int], start: int, arcs: dict[int, int] | np.ndarray, weight: Sequence[float], target: Sequence[int],
         fail: Sequence[int], fail_weight: Sequence[float], kinds: int, part: int = PART) -> list[float]:
    """The sum of weights along the path of every text (``(first token, one past the last)``): an arc of the state by the token's word or,
    where there is none, the failure arc and the same word again.  The root, state 0, has an arc for every word.  ``arcs`` are the
    arcs' keys, state * kinds + word, in order, or arcs by their key.

    All texts advance together, a token a step, each with its state.  A state knows ``HISTORY`` tokens at most, so texts of more than
    ``part`` tokens advance in parts, each of which starts at the root that many tokens early.
    """
    key = np.fromiter(arcs, np.int64, len(arcs)) if isinstance(arcs, dict) else arcs
    arc = np.fromiter(arcs.values(), np.int64, len(arcs)) if isinstance(arcs, dict) else None
    word, weight, target, fail, fail_weight = (np.asarray(x) for x in (word, weight, target, fail, fail_weight))
    root = np.zeros(kinds, np.int64)
    at_root = np.flatnonzero(key < kinds)
    root[key[at_root]] = at_root if arc is None else arc[at_root]
    others = np.flatnonzero(key >= kinds)
    table = _Table(key[others])
    arc = np.r_[others if arc is None else arc[others], -1]

    def find(state: np.ndarray, word: np.ndarray) -> np.ndarray:
        return np.where(state == 0, root[word], arc[table.find(state * kinds + word)])

    begin, end = np.array(list(texts), np.int64).reshape(-1, 2).T
    size = end - begin
    parts = -(-size // part)
    text = np.repeat(np.arange(len(size)), parts)
    later = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    own = begin[text] + later * part
    at, until = np.where(later > 0, own - HISTORY, own), np.minimum(own + part, end[text])
    longest = np.argsort(at - until, kind="stable")
    own, at, until, state = own[longest], at[longest], until[longest], np.where(later > 0, 0, start)[longest]
    taken, failed = np.zeros(len(word)), []  # weights by token: the arc's, and those of the failure arcs before it
    for step in range(int((until - at).max(initial=0))):
        live = int(np.searchsorted(at - until, -step))
        i, s = at[:live] + step, state[:live]
        w, counted = word[i], at[:live] + step >= own[:live]
        found = find(s, w)
        none, depth = np.flatnonzero(found < 0), 0
        while len(none):
            if depth == len(failed):
                failed.append(np.zeros(len(word)))
            here = none[counted[none]]
            failed[depth][i[here]] = fail_weight[s[here]]
            s[none] = fail[s[none]]
            found[none] = find(s[none], w[none])
            none, depth = none[found[none] < 0], depth + 1
        taken[i[counted]] = weight[found[counted]]
        state[:live] = target[found]
    place = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
    path = np.stack([*failed, taken], axis=1)[place]
    return np.bincount(np.repeat(np.arange(len(size)), size * path.shape[1]), weights=path.ravel(), minlength=len(size)).tolist()


def _score(words: np.ndarray | None, hot: np.ndarray, buckets: int, total: int, kinds: int, texts: int, least: float, min_count: int,
           discount: float):
    """Scores of a block's texts by the part of the automaton that they can reach."""
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        (_, ids, held_out, word, word_at, n, trained), = _docs(docs.combine_chunks().to_batches())
        g = Grams(word, word_at, n, trained, words, hot, buckets)
        # a pair without an answer is seen less than min_count times; a triple without one too, or in no other block
        c2, k2, c3 = np.zeros(len(g.pair), np.int64), np.zeros(len(g.pair)), g.triple_own.copy()
        key, cut = _asked(word, word_at, n, hot, buckets)
        c, kept = np.zeros(len(key), np.int64), np.zeros(len(key))
        for bucket, piece in zip(answers.column("bucket").to_pylist(), answers.column("piece")):
            if bucket < 0:
                here = slice(cut[-1 - bucket], cut[-bucket])
                c[here], kept_c, kept_n = _unpack(piece.as_py(), (8, 8, 8))
                kept[here] = kept_c - discount * kept_n
                continue
            i = int(np.searchsorted(g.buckets, bucket))
            at, often, kept_c, kept_n, at3, triple = _unpack(piece.as_py(), _REPLY)
            pair = g.node_pair[g.node_from[i] + np.cumsum(at)]
            c2[pair], k2[pair] = often, kept_c - discount * kept_n
            c3[g.triple_from[i] + np.cumsum(at3)] = triple
        order = np.argsort(key)
        key, c, kept = key[order], np.r_[c[order], 0], np.r_[kept[order], 0.0]
        at = _find(key, g.word)
        c1, k1 = c[at].astype(np.float64), kept[at]
        k2[g.spread] = kept[_find(key, g.spread_pairs()[g.spread])]
        start_kept = kept[_find(key, np.array([START]))][0]
        # states: the root, the start, words, pairs; what a history has no state for is the next shorter one's
        base = np.log10((c1 + 1) / (total + kinds + 1))
        m = len(g.word)
        is_word = (c1 >= least) & (c1 > 0) & (g.word != END) & (True if words is None else _find(words, g.word) >= 0)
        last = g.word_at[g.pair_rep]
        is_pair = (c2 >= max(min_count, least)) & (g.word[last] != END)
        of_word = np.where(is_word, 2 + np.cumsum(is_word) - 1, 0)
        pairs_from = 2 + int(is_word.sum())
        of_pair = np.where(is_pair, pairs_from + np.cumsum(is_pair) - 1, of_word[last])
        rest = np.ones(pairs_from + int(is_pair.sum()))
        count = np.ones(len(rest))
        rest[1], count[1] = (1 - start_kept / texts if texts else 1.0), max(texts, 1)
        rest[of_word[is_word]], count[of_word[is_word]] = 1 - k1[is_word] / c1[is_word], c1[is_word]
        rest[of_pair[is_pair]], count[of_pair[is_pair]] = 1 - k2[is_pair] / c2[is_pair], c2[is_pair]
        fail = np.zeros(len(rest), np.int64)
        fail[of_pair[is_pair]] = of_word[last[is_pair]]
        # arcs of words and the start
        left = np.where(g.first[g.pair_rep], 1, of_word[_before(g.word_at, 0)[g.pair_rep]])
        lower = (c1[last] + 1) / (total + kinds + 1)
        arc = (c2 >= min_count) & (left > 0)
        p2 = np.where(arc, c2 - discount, 0.0) / count[left] + rest[left] * lower
        p2[left == 0] = lower[left == 0]
        # arcs of pairs: the shorter history's probability is that of the pair that ends at the same token
        under = g.pair_at[g.triple_rep]
        state = of_pair[g.parent]
        arc3 = (c3 >= min_count) & is_pair[g.parent]
        p3 = (c3[arc3] - discount) / count[state[arc3]] + rest[state[arc3]] * p2[under[arc3]]
        source = np.r_[np.zeros(m, np.int64), left[arc], state[arc3]]
        by = np.r_[np.arange(m), last[arc], g.word_at[g.triple_rep[arc3]]]
        weight = np.r_[base, np.log10(p2[arc]), np.log10(p3)]
        target = np.r_[of_word, of_pair[arc], of_pair[under[arc3]]]
        ends = np.cumsum(n)
        fail_weight = np.log10(rest)
        text = np.repeat(np.arange(len(n)), n)
        per_text = lambda x: np.bincount(text, weights=x[word_at], minlength=len(n))
        arcs = source * m + by
        del g, answers, source, by, under, state, arc3, p3, p2, left, lower, arc, of_pair, is_pair, last, c2, c3, k2
        found = walk(zip((ends - n).tolist(), ends.tolist()), word_at, 1, arcs, weight, target, fail, fail_weight, m)
        return pa.table({"id": ids, "held_out": held_out, "n_tokens": n,
                         "n_known": per_text((c1 > 0).astype(np.float64)).astype(np.int64), "base_score": per_text(base),
                         "score": np.array(found, np.float64)})
    return score


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", held_out=None,
                state_share: float = 0.0, min_count: int = MIN_COUNT, discount: float = DISCOUNT,
                block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row: whether it was kept from training
    (``held_out``, a boolean column; NULL: not), its tokens, those seen in training, the training tokens, and the log10
    probability under the unigrams alone and under the automaton.

    Words are identified by 64-bit hashes, pairs by 40 further bits and triples by 40 more.  A NULL, empty or blank text is one end token; texts are scored whole,
    whatever their length.  Repeated rows count and are scored each.  Where nothing is trained on, every token has probability 1.  An empty
    table gives an empty result.  Other columns are not read, whatever their names.

    A caller who wants a smaller model may ask with ``state_share`` for n-grams of only the words, and longer histories, that
    make up that share of all training tokens; without it there is no such bound.
    """
    out_ = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), out_.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    corpus = plain.mapInArrow(_blocks(block_bytes), "at long, bytes long, rows binary, words binary")
    corpus = corpus.select((F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("at")).alias("block"), "bytes", "rows", "words")
    corpus = materialise(corpus, "corpus")
    blocks = corpus.drop("bytes")
    single = blocks.mapInArrow(_count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    single = materialise(single, "words", "zstd")
    total, kinds, texts = single.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)),
                                     F.coalesce(F.sum(F.when(F.col("key") == END, F.col("c"))), F.lit(0))).first()
    size = corpus.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = int(size // bucket_bytes) + 1

    def at_least(c: float) -> np.ndarray:
        return single.where(F.col("c") >= c).select("key").orderBy("key").toPandas()["key"].to_numpy(np.int64)

    words = None
    least = 1.0
    if state_share > 0:  # at most 1 / state_share words
        least = max(least, state_share * total)
        words = at_least(least)
    hot = at_least(max(2.0, total / buckets))  # at most as many words as there are buckets
    replies = None
    for only in range(ROUNDS):  # one after the other, so that only a part of the pieces is on disk at once
        pieces = blocks.mapInArrow(_send(words, hot, buckets, only), "block long, bucket long, piece binary")
        told = materialise(pieces.groupBy("bucket").applyInArrow(_tally(min_count), _REPLIES), "replies", "zstd")
        replies = told if replies is None else replies.unionByName(told)
        del pieces
        time.sleep(SETTLE_S)
        replies.limit(1).count()
        drop(corpus.sparkSession, ())  # the shuffled pieces
    none = F.lit(0).cast("long")
    model = single.select("key", "c", none.alias("kept"), none.alias("arcs")).unionByName(
        replies.where("block IS NULL").select("key", none.alias("c"), F.col("c").alias("kept"), "arcs"))
    model = model.withColumn("bucket", F.pmod("key", F.lit(buckets).cast("long")))
    asked = blocks.mapInArrow(_ask(hot, buckets), _ANSWERS)
    found = asked.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(_answer, _ANSWERS)
    told = replies.where("block IS NOT NULL").select("block", "bucket", "piece")
    score = _score(words, hot, buckets, total, kinds, texts, least, min_count, discount)
    scored = blocks.groupBy("block").cogroup(found.unionByName(told).groupBy("block")).applyInArrow(score, _SCORES)
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                         "base_score", "score")
