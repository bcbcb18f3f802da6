import cmath
import math

import pytest
from pyspark.sql import functions as F

from lamina.functions import hashing, numeric, scalars
from lamina.operators import grouping
from tests.conftest import rows

c = F.col


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_cramer(spark):
    df = spark.createDataFrame([(2, 4, 10, 7, 1, 9), (1, 2, 3, 2, 4, 6), (2, 0, 5, 0, 2, -3)], "a int, b int, c int, d int, e int, f int")
    got = df.select(*[v.alias(n) for n, v in scalars.cramer(*[c(k) for k in "abcdef"]).items()]).collect()
    assert tuple(got[0]) == (True, 1.0, 2.0, 1, 2)
    assert tuple(got[1]) == (False, None, None, None, None)
    assert tuple(got[2]) == (True, 2.5, -1.5, 2, -1)


# Coefficients and integrals over [1, 2], known to printed precision.
INTEGRALS = [("8 7 9 6 5 8 3 10 2 0", 663.734), ("4 2 6 0 4 8 1 6 6 5", 1191.36), ("10 0 8 0 1 2 5 6 4 4", 974.142), ("4 1 5 6 2 4 0 4 0 4", 630.767)]


@pytest.mark.parametrize("text,value", INTEGRALS)
def test_polynomials(spark, text, value):
    k = [float(v) for v in text.split()]
    lits = [F.lit(v) for v in k]
    got = one(spark, scalars.polynomial_integral(lits, F.lit(1.0), F.lit(2.0)), scalars.horner(lits, F.lit(1.5)), scalars.power_form(lits, F.lit(1.5)),
              scalars.horner_array(F.array(*lits), F.lit(1.5)))
    assert got[0] == pytest.approx(value, rel=1e-5)
    want = sum(v * 1.5**i for i, v in enumerate(k))
    assert got[1:] == pytest.approx((want, want, want))


def test_fibonacci_and_factorial(spark):
    assert one(spark, scalars.fibonacci(10))[0] == [1, 1, 2, 3, 5, 8, 13, 21, 34, 55]
    assert one(spark, scalars.fibonacci(92))[0][-1] == 7540113804746346429
    assert one(spark, *[scalars.fibonacci_number(F.lit(n)) for n in (0, 1, 2, 10, 92)]) == (0, 1, 1, 55, 7540113804746346429)
    assert one(spark, *[scalars.fibonacci_number(F.lit(n)) for n in (93, 94, 95)]) == (None, None, None)
    assert [r[0] for r in spark.range(6).select(scalars.factorial(c("id").cast("int"))).collect()] == [math.factorial(n) for n in range(6)]


def test_complex(spark):
    z = lambda v: F.struct(F.lit(v.real).alias("re"), F.lit(v.imag).alias("im"))
    total = scalars.complex_add(scalars.complex_add(z(1 + 2j), z(2 + 1j)), scalars.lift(F.lit(2)))
    got = one(spark, total, scalars.zero_to_null(scalars.complex_add(z(1 + 1j), z(-1 - 1j))))
    assert tuple(got[0]) == (5.0, 3.0) and got[1] is None and cmath.isfinite(complex(*got[0]))


def test_operations(spark):
    names = [*scalars.OPERATIONS, "POW"]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string")
    got = rows(df, "k", scalars.operation_code(c("n")), scalars.operation_name(scalars.operation_code(c("n"))), scalars.gate_count(c("n"), F.lit(8)), scalars.has_hardware(c("n")))
    gates = {"ADD": 128, "SUB": 144, "MUL": 512, "LSH": 16, "RSH": 16}
    want = [(k, k if k < 10 else -1, n if k < 10 else "NONE", gates.get(n, 0), n in gates) for k, n in enumerate(names)]
    assert got == want


def test_share_equation_in_double_arithmetic(spark):
    triples = [(11.0, 4.0, -1.0), (1.0, 1.0, 1.0), (1.0, -1.0, 5.0), (-1.0, 4.0, 11.0), (-1.0, 11.0, 4.0), (4.0, -1.0, 11.0)]

    def holds(a, b, d):
        s = a + b + d
        return 0 not in (s - a, s - b, s - d) and a / (s - a) + b / (s - b) + d / (s - d) == 4

    df = spark.createDataFrame(triples, "a double, b double, c double")
    got = [r[0] for r in df.select(scalars.share_sum_is_four(c("a"), c("b"), c("c"))).collect()]
    assert got == [holds(*t) for t in triples] and any(got)


def test_text_and_units(spark):
    values = [0.0, 16100.0, -690.0, 0.5, 1.25e-3, 123456.789, 0.1 + 0.2, 15100.123456789012, 1e-7, 1e15]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r[0]: r[1] for r in df.select("v", scalars.general_text(c("v"))).collect()}
    assert all(float(got[v]) == pytest.approx(v, rel=1e-11) for v in values)
    assert [got[v] for v in values[:8]] == [format(v, ".12g") for v in values[:8]]
    assert one(spark, scalars.thousands(F.lit(21239393))) == ("21,239,393",)
    assert one(spark, scalars.kilograms(F.lit(1.2), "g") + scalars.kilograms(F.lit(1.2), "kg"), scalars.kilograms(F.lit(2.25), "pounds")) == pytest.approx((1.2012, 1.0))


def test_vectors_and_maps(spark):
    got = one(spark, scalars.linear_blend(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(10.0), F.lit(20.0))), scalars.sines(F.array(F.lit(0.0))))
    assert got == ([32.0, 64.0], [0.0])
    pairs = F.create_map(*[F.lit(v) for kv in ((1, 1), (2, 1), (3, 2), (8, 21)) for v in kv])
    df = spark.range(1).select(F.explode(scalars.transform_map(pairs, lambda k, v: k + v)))
    assert rows(df) == [(1, 2), (2, 3), (3, 5), (8, 29)]


def fnv(x, y):
    h = hashing.FNV_BASIS
    for b in x.to_bytes(8, "little", signed=True) + y.to_bytes(8, "little", signed=True):
        h = ((h ^ b) * hashing.FNV_PRIME) % 2**64
    return h


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def test_hashes(spark):
    points = [(10, 20), (30, 40), (-1, 2**62), (0, 0)]
    df = spark.createDataFrame(points + [(None, 1)], "x bigint, y bigint")
    got = {(r[0], r[1]): (r[2], r[3]) for r in df.select("x", "y", hashing.point_hash(c("x"), c("y")), hashing.rectangle_hash(
        hashing.point_hash(c("x"), c("y")), hashing.point_hash(c("y"), c("x")))).collect()}
    for x, y in points:
        assert got[x, y] == (signed(fnv(x, y)), signed(fnv(x, y) ^ (fnv(y, x) << 1) % 2**64))
    assert got[None, 1] == (None, None)
    assert one(spark, hashing.simple_hash(F.lit(10), F.lit(20))) == (330,)


def collatz(n):
    k = 1
    while n != 1:
        n, k = (3 * n + 1 if n % 2 else n // 2), k + 1
    return k


def test_collatz(spark):
    numbers = [*range(1, 300), 837799, 2**62 - 1, 2**62 + 1, 6148914691236517205]
    df = spark.createDataFrame([(n,) for n in numbers + [0, -4, None]], "n bigint")
    got = {r[0]: r[1] for r in df.select("n", numeric.collatz_length(c("n"))).collect()}
    assert got == {**{n: collatz(n) for n in numbers}, 0: None, -4: None, None: None}
    counts = df.where("n between 1 and 299").select("n", numeric.collatz_length(c("n")).alias("cnt"))
    best = max(range(1, 300), key=lambda n: (collatz(n), -n))
    assert tuple(grouping.argmax(counts, "n", "cnt").first()) == (best, collatz(best))


def test_primes(spark, monkeypatch):
    want = [n for n in range(2, 1000) if all(n % d for d in range(2, math.isqrt(n) + 1))]
    for limit in (0, 2, 3, 11, 121, 1000):
        assert [r[0] for r in numeric.primes_below(spark, limit).orderBy("n").collect()] == [p for p in want if p < limit]
    for count in (1, 5, 6, 100):
        assert [r[0] for r in numeric.first_primes(spark, count).orderBy("n").collect()] == want[:count]
    assert numeric.primes_below(spark, 3_000_000).count() == 216816


def test_histogram_keeps_empty_bins_and_clamps(spark):
    df = spark.createDataFrame([(0.05,), (0.95,), (1.0,), (0.31,)], "x double")
    hist = grouping.histogram(df, c("x"), 4)
    assert rows(hist, "bin", "n") == [(1, 1), (2, 1), (3, 0), (4, 2)]
    assert grouping.max_deviation(hist, 4).first()[0] == pytest.approx(0.25)


def test_histogram_counts_every_row(spark):
    df = spark.createDataFrame([(-3.0,), (None,), (0.1,), (7.0,)], "x double")
    got = {r["bin"]: (r["n"], r["freq"]) for r in grouping.histogram(df, c("x"), 2).collect()}
    assert got == {None: (1, 0.25), 0: (1, 0.25), 1: (1, 0.25), 2: (1, 0.25)}


def test_areas_and_midpoints(spark):
    shapes = spark.createDataFrame([(1, 1, 2.0, 3.0, None), (2, 2, None, None, 5.0), (1, 1, 4.0, 4.0, None), (3, 1, 9.0, 9.0, 9.0)], "kind int, color int, w double, h double, r double")
    area = grouping.shape_area(c("kind"), c("w"), c("h"), c("r"))
    got = shapes.agg(grouping.active_area(area, c("color"), 1), grouping.active_area(area, c("color"), 2)).first()
    assert tuple(got) == pytest.approx((22.0, 25 * math.pi))
    square = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 1.0, 1.0), (1.0, 1.0, 0.0, 1.0), (0.0, 1.0, 0.0, 0.0)], "a double, b double, c double, d double")
    ends = [c(k) for k in "abcd"]
    assert square.agg(grouping.midpoint_sum(lambda x, y: x, *ends)).first()[0] == pytest.approx(2.0, abs=1e-9)
    long = square.select(*[(c(k) * 3).alias(k) for k in "abcd"])
    assert long.agg(grouping.midpoint_sum(lambda x, y: x, *ends, weighted=True)).first()[0] == pytest.approx(18.0)


def test_trial_integral_converges(spark):
    k = [F.lit(float(v)) for v in (8, 7, 9, 6)]
    a, b = F.lit(1.15), F.lit(2.23)
    top = F.greatest(scalars.horner(k, a), scalars.horner(k, b))
    x, y = numeric.trial_point(c("id"), a, b, top)
    got = spark.range(200_000).agg(numeric.trial_integral(F.count_if(y < scalars.horner(k, x)), F.count("*"), a, b, F.max(top)).alias("mc"),
                                   F.max(scalars.polynomial_integral(k, a, b)).alias("exact")).first()
    assert got["mc"] == pytest.approx(got["exact"], rel=1e-3)


def test_grid_norm_and_words(spark):
    grid = numeric.grid_points(spark.range(100), "id", 10)
    want = math.sqrt(sum((i / 10 * j / 10) ** 2 for i in range(10) for j in range(10)))
    assert grid.agg(grouping.l2_norm(c("x") * c("y"))).first()[0] == pytest.approx(want)
    assert one(spark, grouping.array_norm(F.array(F.lit(3.0), F.lit(4.0)))) == (5.0,)
    assert grid.agg(grouping.norm(c("x"), "LINF")).first()[0] == 0.0
    text = spark.createDataFrame([("  to be or\tnot to be \n be",), ("",)], "t string")
    assert rows(grouping.word_count(text, "t")) == [("be", 3), ("not", 1), ("or", 1), ("to", 2)]
