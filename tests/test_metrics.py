"""Metric self-checks and an independent plain-Python chrF / chrF++ / BLEU on the sf0.01 pairs."""

import math
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paths import SF01
from plan_util import plan_text
from quarry.operators import metrics as M
from quarry.plans import fixtures as fx

PUNCT = set(string.punctuation)


def _words(s):
    out = []
    for w in s.split():
        if len(w) == 1:
            out.append(w)
        elif w[-1] in PUNCT:
            out += [w[:-1], w[-1]]
        elif w[0] in PUNCT:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def _grams(units, n, sep):
    return Counter(sep.join(units[i:i + n]) for i in range(len(units) - n + 1))


def py_chrf(pairs, word_order=0, beta=2.0):
    tot = [[0, 0, 0] for _ in range(6 + word_order)]
    for hyp, ref in pairs:
        hc, rc = list("".join(hyp.split())), list("".join(ref.split()))
        hw, rw = _words(hyp), _words(ref)
        sides = [(hc, rc, n, "") for n in range(1, 7)] + [(hw, rw, n, " ") for n in range(1, word_order + 1)]
        for k, (a, b, n, sep) in enumerate(sides):
            ga, gb = _grams(a, n, sep), _grams(b, n, sep)
            h, r = sum(ga.values()), sum(gb.values())
            m = sum(min(c, gb[g]) for g, c in ga.items() if g in gb)
            tot[k][0] += h if r > 0 else 0
            tot[k][1] += r
            tot[k][2] += m
    ps, rs = [], []
    for h, r, m in tot:
        if h > 0 and r > 0:
            ps.append(m / h)
            rs.append(m / r)
    if not ps:
        return 0.0
    p, r = sum(ps) / len(ps), sum(rs) / len(rs)
    b2 = beta * beta
    return 100 * (1 + b2) * p * r / (b2 * p + r) if p + r > 0 else 0.0


def py_bleu(pairs, max_n=4):
    m = [0] * max_n
    h = [0] * max_n
    hl = rl = 0
    for hyp, ref in pairs:
        a, b = hyp.split(), ref.split()
        hl += len(a)
        rl += len(b)
        for n in range(1, max_n + 1):
            ga, gb = _grams(a, n, " "), _grams(b, n, " ")
            h[n - 1] += sum(ga.values())
            m[n - 1] += sum(min(c, gb[g]) for g, c in ga.items() if g in gb)
    if hl == 0 or min(m) == 0:
        return 0.0
    bp = 1.0 if hl >= rl else math.exp(1 - rl / hl)
    return bp * math.exp(sum(math.log(m[i] / h[i]) for i in range(max_n)) / max_n)


@pytest.fixture(scope="module")
def pairs(spark):
    return fx.pairs(spark, SF01)


@pytest.fixture(scope="module")
def local_pairs(pairs):
    return [(r.prediction, r.reference) for r in pairs.select("prediction", "reference").collect()]


def test_chrf_known_values(pairs, local_pairs):
    got = M.chrf(pairs, "prediction", "reference").first().chrf
    assert got == pytest.approx(56.852247, abs=1e-6)
    assert got == pytest.approx(py_chrf(local_pairs), abs=1e-9)


def test_chrf_pp_matches_python(pairs, local_pairs):
    got = M.chrf(pairs, "prediction", "reference", word_order=2).first().chrf
    assert got == pytest.approx(56.219806, abs=1e-6)
    assert got == pytest.approx(py_chrf(local_pairs, word_order=2), abs=1e-9)


def test_exact_match_known_value(pairs):
    assert M.exact_match(pairs, "prediction", "reference").first().exact_match == pytest.approx(0.356223, abs=1e-6)


def test_bleu_matches_python(pairs, local_pairs):
    got = M.ngram_overlap(pairs, "prediction", "reference").first().bleu
    assert got == pytest.approx(0.395159, abs=1e-6)
    assert got == pytest.approx(py_bleu(local_pairs), abs=1e-9)


def _df(spark, rows):
    return spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(rows)], "example_id long, h string, r string")


def test_identical_and_disjoint(spark):
    same = _df(spark, [("def f(x): return x", "def f(x): return x"), ("abc", "abc")])
    assert M.chrf(same, "h", "r").first().chrf == pytest.approx(100.0)
    assert M.exact_match(same, "h", "r").first().exact_match == 1.0
    assert M.ngram_overlap(same, "h", "r", max_order=1).first().bleu == pytest.approx(1.0)
    disjoint = _df(spark, [("aaaa", "bbbb")])
    assert M.chrf(disjoint, "h", "r").first().chrf == 0.0
    assert M.ngram_overlap(disjoint, "h", "r").first().bleu == 0.0


def test_short_texts_and_nulls(spark):
    rows = [("a", "abcdefgh"), ("", "xyz"), ("x y", "x"), ("é😀b", "é😀c"), ("(hi) there.", "(hi) there!")]
    df = _df(spark, rows)
    assert M.chrf(df, "h", "r").first().chrf == pytest.approx(py_chrf(rows), abs=1e-9)
    assert M.chrf(df, "h", "r", word_order=2).first().chrf == pytest.approx(py_chrf(rows, 2), abs=1e-9)
    per = {r.example_id: r.chrf for r in M.chrf_per_example(df, "h", "r").collect()}
    for i, pr in enumerate(rows):
        assert per[i] == pytest.approx(py_chrf([pr]), abs=1e-9)
    nulls = spark.createDataFrame([(1, None, "a"), (2, "a", "a")], "example_id long, h string, r string")
    assert M.exact_match(nulls, "h", "r").first().exact_match == 0.5


def test_em_at_k_monotone(spark):
    c = fx.candidates(spark, SF01)
    r = M.em_at_k(c, ks=(1, 2, 5, 10)).first()
    vals = [r.em_at_1, r.em_at_2, r.em_at_5, r.em_at_10]
    assert vals == sorted(vals)
    assert 0.0 <= vals[0] and vals[-1] <= 1.0


def test_ngram_stats_plan_shuffles_nothing(pairs):
    """Statistics are computed where the row is: above the input's own join there is no exchange, and chrF exchanges sums only."""
    stats = plan_text(M.ngram_match_stats(pairs, ["example_id"], "prediction", "reference"))
    assert "Exchange" not in stats.split("MapInArrow")[0]
    chrf = plan_text(M.chrf(pairs, "prediction", "reference")).split("MapInArrow")[0]
    assert "prediction" not in chrf and chrf.count("Exchange") == 2


def test_copies_count_like_separate_rows(spark):
    rows = [("the cat sat", "the cat sat down"), ("a b", "a c")]
    base = _df(spark, rows)
    copies = base.unionByName(base.where("example_id = 0")).unionByName(base.where("example_id = 0"))
    stats = M.ngram_match_stats(copies, ["example_id"], "h", "r").groupBy("example_id").agg(F.sum("h").alias("h"))
    single = M.ngram_match_stats(base, ["example_id"], "h", "r").groupBy("example_id").agg(F.sum("h").alias("h"))
    a = {r.example_id: r.h for r in stats.collect()}
    b = {r.example_id: r.h for r in single.collect()}
    assert a[0] == 3 * b[0] and a[1] == b[1]
    expected = py_chrf([rows[0], rows[0], rows[0], rows[1]])
    assert M.chrf(copies, "h", "r").first().chrf == pytest.approx(expected, abs=1e-9)


def test_null_sides_do_not_collide(spark):
    df = spark.createDataFrame([(1, None, "abc"), (1, "abc", None)], "example_id long, h string, r string")
    st = M.ngram_match_stats(df, ["example_id"], "h", "r", char_order=3).agg(F.sum("r").alias("r"), F.sum("h").alias("h")).first()
    assert st.r == 6 and st.h == 6


def test_pair_statistics_hold_a_slice_at_once():
    """A large Arrow batch is handled in small slices: memory beyond the batch doesn't grow with it, results are those of single rows."""
    import tracemalloc

    import pyarrow as pa

    words = [f"w{i * 7919 % 4001}" for i in range(4001)]
    text = [" ".join(words[(i * 37 + j * j) % 4001] for j in range(70)) for i in range(2500)] + [None, ""]
    b = pa.RecordBatch.from_arrays([pa.array(range(2502)), pa.array(text), pa.array(text[1:] + text[:1])], names=["_k0", "_h", "_r"])

    def stats(batches):
        return [tuple(r.values()) for o in M._pair_stats(["id"], 6, 2, "chrf", None, True)(iter(batches)) if o.num_rows for r in o.to_pylist()]

    tracemalloc.start()
    for _ in M._pair_stats(["id"], 6, 2, "chrf", None, True)(iter([b])):
        pass
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 40, peak
    some = b.slice(2450)
    assert sorted(stats([some])) == sorted(stats([some.slice(i, 1) for i in range(some.num_rows)]))
