"""Near-duplicate documents by a chosen-path set similarity join on minwise tokens.

Each distinct shingle set gets a sketch of ``SKETCH`` minwise tokens.  The root of each of ``TREES``
independent trees sends a set to ``BRANCH`` children, each named by a chosen token position and the
set's token there; a node that is still large sends its sets on in the same way, by positions chosen by
the node's own hash.  Small nodes are compared exhaustively: sketches first (a pair is a candidate from
``CANDIDATE`` equal tokens, four standard deviations below the threshold), then the full shingle sets of
the members that have a candidate, exactly.  A node returns a spanning forest of its links, never its pairs.

Groups of copies cost no pairs either: equal sets collapse before the join; a first round compares the
pieces of a few root children, so most groups are one known component when the trees begin, and these
drop every node that lies in one component, compare across components only, and examine a pair in
the first small root child that it shares.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket, drop, materialise, mix64, shingles, word_chunks, written

SKETCH = 64
TREES, BRANCH = 10, 2
#: two sets of similarity 0.8 share 51 of 64 tokens on average, standard deviation 3.2
CANDIDATE = 38
#: members of a small node; a set of more than HEAVY shingles counts as several
SMALL_NODE, HEAVY = 1024, 4096
EDGES_PER_TASK = 100_000
MAX_DEPTH = 8
#: the first rounds take this many root children per set; rounds after the first deal only children that are too large to be
#: compared at once, around the member that had most links
SEED_TOKENS, SEED_ROUNDS = 2, 2
#: a larger node is compared in blocks of half a small node if its largest component holds at least half of it and the others fill
#: at most this many blocks; else its sets are mostly unlike and part on the next level
REST_BLOCKS = 8

_RNG = np.random.default_rng(4)
_MUL = _RNG.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 1 << 63, SKETCH, dtype=np.uint64)


def _sketches(r: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have shingles, their set sizes, 16-byte set keys and sketches."""
    at = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    size = np.diff(np.r_[at, len(r)])
    key = np.stack([np.add.reduceat(mix64(h ^ g), at) for g in (_ADD[0], _ADD[1])], axis=1)
    key = mix64(key + size.astype(np.uint64)[:, None])
    sketch = np.empty((len(at), SKETCH), np.int32)
    for t in range(SKETCH):
        sketch[:, t] = np.minimum.reduceat(((h * _MUL[t] + _ADD[t]) >> np.uint64(32)).astype(np.uint32), at).view(np.int32)
    return r[at], size, key, sketch


def _signer(k: int, text: str):
    def sign(batches):
        for b in batches:
            n = b.num_rows
            size, key, sketch = np.zeros(n, np.int64), [None] * n, [None] * n
            for i, j, row, word in word_chunks(b.column(text)):
                r, h = shingles(row, word, j - i, k)
                if not len(r):
                    continue
                rows, sizes, keys, sk = _sketches(r, h)
                size[i + rows] = sizes
                for x, q, s in zip(i + rows, keys, sk):
                    key[x], sketch[x] = q.tobytes(), s
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(size), pa.array(key, pa.binary()), pa.array(sketch, pa.list_(pa.int32()))],
                names=[*b.schema.names, "__n", "__key", "__sketch"])
    return sign


def _grouped(df: DataFrame, fn: Callable, schema: str, prepare: Callable | None = None) -> DataFrame:
    """``fn(columns, first, last)`` on every run of equal ``g``: rows are dealt and sorted by ``g``, so groups are cut out of whole
    Arrow batches (small groups are many; a call per group through pandas would cost more than their work)."""
    def run(batches):
        kept = None
        for b in batches:
            if kept is not None:
                b = pa.concat_batches([kept, b])
            if not b.num_rows:
                continue
            g = b.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))
            kept = b.slice(cut)
            if cut:
                yield from work(b.slice(0, cut))
        if kept is not None and kept.num_rows:
            yield from work(kept)

    def work(b):
        g = b.column("g").to_numpy()
        cols = _arrays(b) | (prepare(b) if prepare else {})
        at = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
        out = [fn(cols, i, j) for i, j in zip(at[:-1].tolist(), at[1:].tolist()) if j - i > 1]
        out = [x for x in out if len(x[0])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)
    names = [x.split()[0] for x in schema.split(", ")]
    return df.repartition("g").sortWithinPartitions("g").mapInArrow(run, schema)


def _arrays(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    cols = {n: b.column(n).to_numpy() for n in ("g", "kid", "comp", "place", "done", "side")}
    return cols | {"sketch": b.column("sketch").flatten().to_numpy().reshape(-1, SKETCH)}


def _partners(cols: dict, x: int, lo: int, hi: int) -> np.ndarray:
    """Members between ``lo`` and ``hi`` of another component with enough tokens of ``x``'s, unless an earlier node has both
    (``done`` has a bit for each root child that is compared exhaustively, ``place`` is this node's bit) or both are on the same
    ``side`` of a piece of a larger node (0: no sides)."""
    other = cols["comp"][lo:hi] != cols["comp"][x]
    if cols["side"][x]:
        other &= cols["side"][lo:hi] != cols["side"][x]
    y = np.flatnonzero(other) + lo
    if not len(y):
        return y
    same = cols["sketch"][y] == cols["sketch"][x]
    ok = same.sum(axis=1) >= CANDIDATE
    y, same = y[ok], same[ok]
    done = int(cols["done"][x]) & ((1 << int(cols["place"][x])) - 1)
    if done and len(y):
        y = y[~same[:, [i for i in range(SKETCH - 1) if done >> i & 1]].any(axis=1)]
    return y


def _with_partner(cols: dict, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of a node that have a candidate partner in it."""
    found = np.zeros(j - i, bool)
    for x in range(i, j - 1):
        y = _partners(cols, x, x + 1, j)
        if len(y):
            found[x - i] = True
            found[y - i] = True
    return cols["g"][i:j][found], cols["kid"][i:j][found]


def _set_columns(k: int, percent: int):
    def prepare(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        r, h = [], []
        for i, j, row, word in word_chunks(b.column("text")):
            x, y = shingles(row, word, j - i, k)
            r.append(x + i)
            h.append(y)
        r, h = np.concatenate(r), np.concatenate(h)
        return {"shingle": h, "start": np.searchsorted(r, np.arange(b.num_rows + 1)), "percent": percent}
    return prepare


def _links(cols: dict, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of a node's links: candidates are compared on full sets, those with most partners first, until all that
    are linked are known to be."""
    kid, start, shingle, percent = cols["kid"], cols["start"], cols["shingle"], cols["percent"]
    cols = cols | {"comp": cols["comp"].copy()}
    comp = cols["comp"]
    a, b = [], []
    degree = np.zeros(j - i, np.int64)
    if j - i > 2:
        for x in range(i, j):
            degree[x - i] = (np.count_nonzero(cols["sketch"][i:j] == cols["sketch"][x], axis=1) >= CANDIDATE).sum()
    rank = np.argsort(-degree, kind="stable") + i
    seen = np.zeros(j - i, bool)
    for x in rank.tolist():
        seen[x - i] = True
        y = _partners(cols, x, i, j)
        y = y[~seen[y - i]]
        n, m = start[x + 1] - start[x], start[y + 1] - start[y]
        y = y[100 * np.minimum(n, m) >= percent * np.maximum(n, m)]
        if not len(y):
            continue
        own = shingle[start[x]:start[x + 1]]
        size = start[y + 1] - start[y]
        other = np.concatenate([shingle[start[v]:start[v + 1]] for v in y])
        hit = own[np.minimum(np.searchsorted(own, other), n - 1)] == other
        both = np.add.reduceat(hit, np.cumsum(size) - size)
        for v in y[100 * both >= percent * (n + size - both)].tolist():
            if comp[v] != comp[x]:
                a.append(kid[x])
                b.append(kid[v])
                comp[i:j][comp[i:j] == comp[v]] = comp[x]
    return np.array(a, np.int64), np.array(b, np.int64)


def _contract(batches):
    """A task's edges as one edge from every end to the smallest id it is connected with in this task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != x:
            parent[x], x = top, parent[x]
        return top
    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    ends = [(x, root(x)) for x in list(parent)]
    if ends:
        u, v = np.array(ends, np.int64).T
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """``(kid, comp)`` for every end of an edge ``(a, b)``: the smallest id reachable.  The edges are mostly few, so tasks of about
    ``EDGES_PER_TASK`` of them contract their own first; where that takes more than one task, alternating large and small stars
    join what the tasks found; every round is a written table, and hot hubs are minima with map-side combine."""
    spark, before = edges.sparkSession, written()
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    tasks = 1 + e.count() // EDGES_PER_TASK
    e = materialise(e.coalesce(tasks).mapInArrow(_contract, "u long, v long"), "cc")
    state = None
    while tasks > 1:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or not now[0]:
            break
        state, tasks = now, max(2, 1 + now[0] // EDGES_PER_TASK)
        e = e.coalesce(tasks)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = written(before)
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks), "cc")
        drop(spark, old)
    return e.select(F.col("u").alias("kid"), F.col("v").alias("comp")).unionByName(
        e.select(F.col("v").alias("kid"), F.col("v").alias("comp")).distinct())


class _Join:
    """What the rounds share: the signed rows, the distinct sets and the similarity asked for."""

    def __init__(self, base: DataFrame, reps: DataFrame, text: str, k: int, percent: int):
        self.base, self.reps, self.text, self.k, self.percent = base, reps, text, k, percent

    def links(self, members: DataFrame) -> DataFrame:
        """Links within the nodes of ``(g, kid, comp, place, done, side)``: sketches narrow the members down, then texts are fetched
        once per set and compared in the node.  Which texts is a narrow table, so where it is small no text is shuffled for it."""
        before = written()
        members = materialise(members, "members")
        some = materialise(_grouped(members.join(self.reps.select("kid", "sketch"), "kid"), _with_partner, "g long, kid long"), "candidates")
        rids = materialise(self.reps.select("kid", "rid").join(some.select("kid").distinct(), "kid", "left_semi"), "wanted")
        texts = self.base.select(F.col("__rid").alias("rid"), F.col(self.text).alias("text"), F.col("__sketch").alias("sketch"))
        texts = texts.join(rids, "rid").select("kid", "text", "sketch")
        full = members.join(some.distinct(), ["g", "kid"]).join(texts, "kid")
        out = materialise(_grouped(full, _links, "a long, b long", _set_columns(self.k, self.percent)), "links")
        drop(members.sparkSession, written(before), keep=("links",))
        return out


def _weight() -> Column:
    """What a set counts towards a node's size."""
    return (F.lit(1) + F.floor(F.col("n") / HEAVY)).cast("long")


def _seed_nodes(rows: DataFrame, small: int, salt: int) -> DataFrame:
    """Of members ``(node, kid, comp, w, links)``, per node that lies in several components, how many pieces of about ``small``
    it has and its leader: the member with most links so far."""
    s = rows.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("w").alias("w"),
                                 F.max(F.struct("links", "kid")).alias("t")).where("lo <> hi")
    s = s.select("node", F.col("t.kid").alias("lead"), F.ceil(F.col("w") / small).alias("m"))
    return s if not salt else s.where("m > 1")


def _seed_members(rows: DataFrame, nodes: DataFrame, salt: int) -> DataFrame:
    """The pieces of the nodes as ``(g, kid, comp, place, done, side)``; the leader comes with every piece."""
    at = rows.join(nodes, "node")
    own = at.where("m = 1 or kid <> lead").select("node", bucket(F.col("m"), F.lit(salt), "kid", "node").alias("piece"), "kid", "comp")
    lead = at.where("m > 1 and kid = lead").select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("piece"), "kid", "comp")
    zero = F.lit(0).cast("long")
    return own.unionByName(lead).select(F.xxhash64("node", "piece").alias("g"), "kid", "comp", zero.alias("place"), zero.alias("done"),
                                         zero.alias("side"))


def _tree_members(sets: DataFrame, small: int, trees: int, branch: int, depth: int) -> DataFrame:
    """Members ``(g, kid, comp, place, done, side)`` of the nodes of all trees that lie in several components and are to be compared
    exhaustively; ``sets`` is (kid, comp, w, sketch), written."""
    sketch = sets.select("kid", "sketch")
    zero = F.lit(0).cast("long")
    rows = sets.select("kid", "comp", "w", F.posexplode(F.slice("sketch", 1, trees * branch)).alias("i", "token")) \
        .select(F.xxhash64(F.lit(0), "i", "token").alias("node"), F.col("i").cast("long").alias("place"), "kid", "comp", "w")
    found, done = [], None
    for level in range(1, depth + 1):
        mixed = rows.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("w").alias("n")) \
            .where("lo <> hi").select("node", "n")
        rows = materialise(rows.join(mixed, "node"), "nodes")
        leaf = rows.where(F.col("n") <= small)
        large = rows.where(F.col("n") > small)
        any_large = not large.isEmpty()
        whole = leaf.select("kid", "place")
        if any_large:
            # one large component and fewer others: blocks of the others meet each block of the large one and each other
            per = large.groupBy("node", "comp").agg(F.sum("w").alias("c"))
            top = materialise(per.groupBy("node").agg(F.sum("c").alias("n"), F.max(F.struct("c", "comp")).alias("t")).select(
                "node", F.col("t.comp").alias("top"), F.col("t.c").alias("c"), (F.col("n") - F.col("t.c")).alias("rest")), "tops")
            half, last = max(1, small // 2), level == depth
            fits = F.lit(last) | ((F.col("rest") <= REST_BLOCKS * half) & (F.col("rest") <= F.col("c")))
            easy = top.where(fits).select("node", "top", F.ceil(F.col("c") / half).cast("long").alias("m"),
                                          F.ceil(F.col("rest") / half).cast("long").alias("r"))
            at = large.select("node", "place", "kid", "comp").join(easy, "node")
            whole = whole.unionByName(at.select("kid", "place"))
            # blocks 0 .. m-1 of the largest component, m .. m+r-1 of the rest; pieces are pairs of blocks, at least one of the rest
            block = F.when(F.col("comp") == F.col("top"), bucket(F.col("m"), "kid")).otherwise(F.col("m") + bucket(F.col("r"), "kid"))
            at = at.select("node", "place", "kid", "comp", "m", (F.col("m") + F.col("r")).alias("all"), block.alias("x"))
            other = F.sequence(F.when(F.col("x") < F.col("m"), F.col("m")).otherwise(zero), F.col("all") - 1)
            at = at.select("node", "place", "kid", "comp", "x", "all", F.explode(other).alias("y"))
            piece = F.least("x", "y") * F.col("all") + F.greatest("x", "y")
            side = F.when(F.col("x") == F.col("y"), zero).otherwise(F.lit(1) + (F.col("x") < F.col("y")).cast("long"))
            found.append(at.select(F.xxhash64("node", piece).alias("g"), "kid", "comp", "place", side.alias("side")))
        if level == 1:
            done = whole.groupBy("kid").agg(F.bit_or(F.expr("shiftleft(1L, cast(place as int))")).alias("done"))
            # the first children were compared exhaustively in the first round, if small
            leaf = leaf.where(F.col("place") >= SEED_TOKENS)
        found.append(leaf.select(F.xxhash64("node").alias("g"), "kid", "comp", "place", zero.alias("side")))
        if not any_large or last:
            break
        deeper = large.join(top.where(~fits).select("node"), "node", "left_semi").join(sketch, "kid")
        at = lambda i: F.pmod(F.xxhash64("node", F.lit(i)), F.lit(SKETCH))
        child = F.explode(F.array(*[F.struct(at(i).alias("i"), F.element_at("sketch", (at(i) + 1).cast("int")).alias("token"))
                                    for i in range(branch)])).alias("t")
        rows = materialise(deeper.select("node", "kid", "comp", "w", child).select(
            F.xxhash64("node", "t.i", "t.token").alias("node"), F.lit(SKETCH - 1).cast("long").alias("place"), "kid", "comp", "w").distinct(), "rows")
        if rows.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.join(done, "kid", "left").select("g", "kid", "comp", "place", F.coalesce("done", zero).alias("done"), "side")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80,
                    trees: int = TREES, branch: int = BRANCH, small_node: int = SMALL_NODE,
                    max_depth: int = MAX_DEPTH) -> DataFrame:
    """All columns of ``docs`` and ``__n`` (shingle-set size), ``__component`` (smallest id reachable over links of
    at least ``percent`` per cent Jaccard similarity, its own included) and ``__winner`` (exactly one row of each
    component).

    A NULL, empty or blank text has no shingles, links with nothing and wins its own component.  Texts are
    compared whole, whatever their length; repeated rows are copies like any others (one of them wins).  A NULL
    id is larger than every id: a component of NULL ids only has a NULL ``__component``.  An empty table gives
    an empty result.  Further columns pass through, whatever their names.
    """
    before = written()
    cols = docs.columns
    plain = [f"c{i}" for i in range(len(cols))]
    id_col, text = (plain[cols.index(x)] for x in (id_col, text))
    numbered = docs.toDF(*plain).withColumn("__rid", F.monotonically_increasing_id())
    signed = T.StructType(numbered.schema.fields + [T.StructField("__n", T.LongType()), T.StructField("__key", T.BinaryType()),
                                                    T.StructField("__sketch", T.ArrayType(T.IntegerType()))])
    base = materialise(numbered.mapInArrow(_signer(shingle, text), signed), "signed", "zstd")
    per = base.where("__n > 0").groupBy(F.col("__key").alias("key")).agg(
        F.min(F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"), F.col("__rid").alias("rid"))).alias("rep"),
        F.first("__n").alias("n"), F.first("__sketch").alias("sketch"))
    reps = materialise(per.select(F.monotonically_increasing_id().alias("kid"), "key", F.col("rep.i").alias("id"),
                                  F.col("rep.rid").alias("rid"), _weight().alias("w"), "sketch"), "reps")
    join = _Join(base, reps, text, shingle, percent)
    zero = F.lit(0).cast("long")
    # members of the first root children, written once; rounds after the first read those of children that were too large
    rows = materialise(reps.select("kid", "w", F.posexplode(F.slice("sketch", 1, SEED_TOKENS)).alias("i", "token")).select(
        F.xxhash64(F.lit(0), "i", "token").alias("node"), "kid", "w"), "first-nodes")
    sets, links = reps.select("kid", F.col("kid").alias("comp"), "w"), None
    for salt in range(SEED_ROUNDS):
        if salt:
            at = rows.join(nodes.where("m > 1").select("node"), "node").join(sets.select("kid", "comp", "links"), "kid")
        else:
            at = rows.withColumn("comp", F.col("kid")).withColumn("links", zero)
        nodes = materialise(_seed_nodes(at, small_node, salt), "seeds")
        if salt and nodes.isEmpty():
            break
        new = join.links(_seed_members(at.select("node", "kid", "comp"), nodes, salt))
        links = new if links is None else materialise(links.unionByName(new), "links")
        comp = materialise(components(links), "comp")
        ends = links.select(F.col("a").alias("kid")).unionByName(links.select(F.col("b").alias("kid")))
        ends = comp.join(ends.groupBy("kid").agg(F.count(F.lit(1)).alias("links")), "kid", "left")
        sets = materialise(reps.select("kid", "w").join(ends, "kid", "left").select(
            "kid", F.coalesce("comp", "kid").alias("comp"), "w", F.coalesce("links", zero).alias("links")), "sets")
    sets = materialise(sets.select("kid", "comp", "w").join(reps.select("kid", "sketch"), "kid"), "tree-sets")
    links = join.links(_tree_members(sets, small_node, trees, branch, max_depth))
    comp = components(comp.select(F.col("kid").alias("a"), F.col("comp").alias("b")).unionByName(links))
    # labels: the smallest id (and its row) of each component
    member = materialise(reps.select("key", "id", "rid", "kid").join(comp, "kid", "left").withColumn("comp", F.coalesce("comp", "kid")), "labels")
    drop(docs.sparkSession, written(before), keep=("signed", "labels"))
    best = member.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("i"), "rid")).alias("w"))
    labels = member.select("key", "comp").join(best, "comp").select(
        F.col("key").alias("__key"), F.col("w.i").alias("__component"), F.col("w.rid").alias("__first"))
    out = base.join(labels, "__key", "left")
    alone = F.col("__key").isNull()
    return out.select(*[F.col(p).alias(c) for p, c in zip(plain, cols)], F.col("__n"),
                      F.when(alone, F.col(id_col)).otherwise(F.col("__component")).alias("__component"),
                      F.when(alone, F.lit(True)).otherwise(F.col("__first") == F.col("__rid")).alias("__winner"))
