"""Queries: scalar kernels, primes, integration, histograms, norms, matrices, graphs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lamina.functions import hashing, numeric, scalars
from lamina.operators import graph, grouping, krylov, lowrank, sparse
from lamina.plans import standins as s
from lamina.plans.registry import query, table

c = F.col
PI = repr(math.pi)
D = "CAST({} AS DOUBLE)".format


# ---- scalar kernels -------------------------------------------------------------------------

@query("s2_parse_numbers", """SELECT event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, CAST(event_id % 100 AS BIGINT) AS a, value AS b FROM events""")
def parse_numbers(spark, folder):
    line = F.concat(F.lit("  "), c("event_id") % 100, F.lit(","), c("value"), F.lit(" "))
    rows = table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.split(F.trim(line), ",").alias("f"))
    return rows.select("event_id", "k", c("f")[0].try_cast("bigint").alias("a"), c("f")[1].try_cast("double").alias("b"))


@query("s6_angles", """SELECT l_orderkey, round(radians(l_quantity), 6) AS rad, round(degrees(l_discount), 6) AS deg, round(sin(radians(l_quantity)), 6) AS s, round(cos(radians(l_quantity)), 6) AS co FROM lineitem""")
def angles(spark, folder):
    rad = F.radians("l_quantity")
    return table(spark, folder, "lineitem").select("l_orderkey", F.round(rad, 6).alias("rad"), F.round(F.degrees("l_discount"), 6).alias("deg"),
                                                   F.round(F.sin(rad), 6).alias("s"), F.round(F.cos(rad), 6).alias("co"))


FNV = """fnv(x, y) AS (SELECT l_orderkey, l_partkey FROM lineitem)"""
FNV_OF = ("CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(generate_series(0, 15), lambda k: "
          "CAST((CASE WHEN k < 8 THEN {x} >> CAST(8 * k AS INTEGER) ELSE {y} >> CAST(8 * (k - 8) AS INTEGER) END) & 255 AS HUGEINT))), "
          "lambda h, b: (xor(h, b) * CAST(1099511628211 AS HUGEINT)) % CAST(18446744073709551616 AS HUGEINT)) AS HUGEINT)")
SIGNED = "CAST(CASE WHEN {h} >= 9223372036854775808 THEN {h} - CAST(18446744073709551616 AS HUGEINT) ELSE {h} END AS BIGINT)"


@query("s7_point_hash", f"""WITH h AS (SELECT l_orderkey, l_partkey, {FNV_OF.format(x="l_orderkey", y="l_partkey")} AS h FROM lineitem)
SELECT l_orderkey, l_partkey, {SIGNED.format(h="h")} AS fnv, l_orderkey * 31 + l_partkey AS simple FROM h""")
def point_hash(spark, folder):
    x, y = c("l_orderkey"), c("l_partkey")
    return table(spark, folder, "lineitem").select(x, y, hashing.point_hash(x, y).alias("fnv"), hashing.simple_hash(x, y).alias("simple"))


@query("s7_rectangle_hash", f"""WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS z FROM part),
h AS (SELECT p_partkey, {FNV_OF.format(x="p_partkey", y="z")} AS a, {FNV_OF.format(x="z", y="p_partkey")} AS b FROM p),
r AS (SELECT p_partkey, xor(a, (b * 2) % CAST(18446744073709551616 AS HUGEINT)) AS h FROM h)
SELECT p_partkey, {SIGNED.format(h="h")} AS hash FROM r""")
def rectangle_hash(spark, folder):
    x, y = c("p_partkey"), c("p_size").cast("bigint")
    return table(spark, folder, "part").select(x, hashing.rectangle_hash(hashing.point_hash(x, y), hashing.point_hash(y, x)).alias("hash"))


@query("s9_units", """SELECT p_partkey, round(p_size * 0.001 + p_size + p_size / 2.25, 6) AS kg FROM part""")
def units(spark, folder):
    size = c("p_size").cast("double")
    total = scalars.kilograms(size, "g") + scalars.kilograms(size, "kg") + scalars.kilograms(size, "pounds")
    return table(spark, folder, "part").select("p_partkey", F.round(total, 6).alias("kg"))


OP_NAME = f"CASE o_orderkey % 11 {' '.join(f'WHEN {i} THEN {chr(39)}{n}{chr(39)}' for i, n in enumerate(scalars.OPERATIONS))} ELSE 'POW' END"


def _operations(spark, folder):
    names = F.array(*map(F.lit, [*scalars.OPERATIONS, "POW"]))
    return table(spark, folder, "orders").select("o_orderkey", F.element_at(names, (c("o_orderkey") % 11 + 1).cast("int")).alias("op"), (c("o_custkey") % 64).alias("width"))


@query("s10_gate_cost", f"""WITH o AS (SELECT o_orderkey, {OP_NAME} AS op, o_custkey % 64 AS width FROM orders)
SELECT op, count(*) AS n, CAST(sum(width * CASE op WHEN 'ADD' THEN 16 WHEN 'SUB' THEN 18 WHEN 'MUL' THEN 64 WHEN 'LSH' THEN 2 WHEN 'RSH' THEN 2 ELSE 0 END) AS BIGINT) AS gates,
       bool_and(op IN ('ADD', 'SUB', 'MUL', 'LSH', 'RSH')) AS supported FROM o GROUP BY op""")
def gate_cost(spark, folder):
    ops = _operations(spark, folder)
    return ops.groupBy("op").agg(F.count("*").alias("n"), F.sum(scalars.gate_count(c("op"), c("width"))).alias("gates"), F.bool_and(scalars.has_hardware(c("op"))).alias("supported"))


@query("s11_operation_codes", f"""WITH o AS (SELECT o_orderkey, {OP_NAME} AS op FROM orders)
SELECT o_orderkey, CAST(CASE WHEN op = 'POW' THEN -1 ELSE o_orderkey % 11 END AS INTEGER) AS code, CASE WHEN op = 'POW' THEN 'NONE' ELSE op END AS back FROM o""")
def operation_codes(spark, folder):
    ops = _operations(spark, folder).select("o_orderkey", scalars.operation_code(c("op")).alias("code"))
    return ops.select("o_orderkey", "code", scalars.operation_name(c("code")).alias("back"))


@query("s12_factorial", """SELECT p_partkey, CAST(factorial(p_size % 21) AS BIGINT) AS f FROM part""")
def factorial(spark, folder):
    return table(spark, folder, "part").select("p_partkey", scalars.factorial(c("p_size") % 21).alias("f"))


def _coefficients(key):
    """Ten integer coefficients 0..10 from a key."""
    return [((key * (2 * k + 3) + k * k) % 11).cast("double") for k in range(10)]


def _coefficients_sql(key):
    return [f"CAST(({key} * {2 * k + 3} + {k * k}) % 11 AS DOUBLE)" for k in range(10)]


def _horner_sql(coefficients, x):
    text = coefficients[-1]
    for k in reversed(coefficients[:-1]):
        text = f"({k} + {text} * {x})"
    return text


def _integral_sql(key, a, b):
    anti = ["CAST(0.0 AS DOUBLE)"] + [f"({k} / {n})" for n, k in enumerate(_coefficients_sql(key), 1)]
    return f"({_horner_sql(anti, b)} - {_horner_sql(anti, a)})"


@query("s13_horner", f"""SELECT l_orderkey, l_partkey, round({_horner_sql(_coefficients_sql("l_partkey"), "l_discount")}, 6) AS nested,
round({_horner_sql(_coefficients_sql("l_partkey"), "l_tax")}, 6) AS powers FROM lineitem""")
def horner(spark, folder):
    k = _coefficients(c("l_partkey"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", F.round(scalars.horner(k, c("l_discount")), 6).alias("nested"),
                                                   F.round(scalars.power_form(k, c("l_tax")), 6).alias("powers"))


@query("s14_polynomial_integral", f"""SELECT p_partkey, round({_integral_sql("p_partkey", D(1.0), D(2.0))}, 6) AS integral FROM part""")
def polynomial_integral(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.round(scalars.polynomial_integral(_coefficients(c("p_partkey")), F.lit(1.0), F.lit(2.0)), 6).alias("integral"))


@query("s15_vectors", """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT vec_id, CAST(k AS INTEGER) AS k, round(2 * x + 3 * (x * x), 6) AS blend, round(sin(x), 6) AS s FROM e""")
def vectors(spark, folder):
    x = c("embedding").cast("array<double>")
    blend = scalars.linear_blend(x, F.transform(x, lambda v: v * v))
    zipped = F.arrays_zip(blend.alias("b"), scalars.sines(x).alias("s"))
    rows = table(spark, folder, "embeddings").select("vec_id", F.posexplode(zipped).alias("k", "v"))
    return rows.select("vec_id", (c("k") + 1).alias("k"), F.round("v.b", 6).alias("blend"), F.round("v.s", 6).alias("s"))


@query("s16_complex", """WITH z AS (SELECT l_orderkey, l_quantity + l_linenumber - 8 AS re, CAST(l_linenumber - 4 AS DOUBLE) AS im FROM lineitem)
SELECT l_orderkey, CASE WHEN re <> 0 OR im <> 0 THEN re END AS re, CASE WHEN re <> 0 OR im <> 0 THEN im END AS im FROM z""")
def complex_numbers(spark, folder):
    z = F.struct((c("l_linenumber") - 8).cast("double").alias("re"), (c("l_linenumber") - 4).cast("double").alias("im"))
    total = scalars.zero_to_null(scalars.complex_add(scalars.lift(c("l_quantity")), z))
    return table(spark, folder, "lineitem").select("l_orderkey", total.alias("z")).select("l_orderkey", "z.re", "z.im")


@query("s17_share_equation", """WITH t AS (SELECT CAST(l_quantity - 25 AS DOUBLE) AS a, CAST(l_linenumber AS DOUBLE) AS b, CAST(l_suppkey % 23 - 11 AS DOUBLE) AS c FROM lineitem)
SELECT a, b, c, count(*) AS n FROM t WHERE b + c <> 0 AND a + c <> 0 AND a + b <> 0 AND
  a / (a + b + c - a) + b / (a + b + c - b) + c / (a + b + c - c) = 4 GROUP BY 1, 2, 3""")
def share_equation(spark, folder):
    t = table(spark, folder, "lineitem").select((c("l_quantity") - 25).alias("a"), c("l_linenumber").cast("double").alias("b"), (c("l_suppkey") % 23 - 11).cast("double").alias("c"))
    return t.where(scalars.share_sum_is_four(c("a"), c("b"), c("c"))).groupBy("a", "b", "c").agg(F.count("*").alias("n"))


@query("s19_cramer", """WITH e AS (SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS a1, l_partkey % 5 AS b1, CAST(l_quantity AS BIGINT) AS c1,
  l_suppkey % 7 AS a2, l_orderkey % 3 AS b2, CAST(l_linenumber * 2 AS BIGINT) AS c2 FROM lineitem),
d AS (SELECT *, a1 * b2 - a2 * b1 AS det FROM e), q AS (SELECT *, CASE WHEN det <> 0 THEN CAST(c1 * b2 - c2 * b1 AS DOUBLE) / det END AS x, CASE WHEN det <> 0 THEN CAST(a1 * c2 - a2 * c1 AS DOUBLE) / det END AS y FROM d)
SELECT l_orderkey, l_partkey, det <> 0 AS solved, x, y, CAST(trunc(x) AS BIGINT) AS x_int, CAST(trunc(y) AS BIGINT) AS y_int FROM q""")
def cramer(spark, folder):
    out = scalars.cramer(c("l_linenumber").cast("bigint"), c("l_partkey") % 5, c("l_quantity").cast("bigint"),
                         c("l_suppkey") % 7, c("l_orderkey") % 3, (c("l_linenumber") * 2).cast("bigint"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", *[v.alias(n) for n, v in out.items()])


@query("u1_map_transform", """WITH m AS (SELECT o_orderkey, 1 AS k, o_custkey AS v FROM orders UNION ALL SELECT o_orderkey, 2, o_orderkey FROM orders UNION ALL SELECT o_orderkey, 8, o_custkey + 1 FROM orders)
SELECT o_orderkey, k, k * 100 + v AS v FROM m""")
def map_transform(spark, folder):
    values = F.create_map(F.lit(1), c("o_custkey"), F.lit(2), c("o_orderkey"), F.lit(8), c("o_custkey") + 1)
    changed = scalars.transform_map(values, lambda k, v: k * 100 + v)
    return table(spark, folder, "orders").select("o_orderkey", F.explode(changed).alias("k", "v"))


@query("n3_fibonacci", """WITH RECURSIVE f(n, a, b) AS (SELECT 0, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 60)
SELECT p_partkey, a AS fib FROM part JOIN f ON n = p_size""")
def fibonacci(spark, folder):
    return table(spark, folder, "part").select("p_partkey", scalars.fibonacci_number(c("p_size")).alias("fib"))


# ---- areas, histograms, norms, diagnostics --------------------------------------------------

@query("a10_cond_area", f"""WITH t AS (SELECT l_linenumber % 4 + 1 AS kind, l_suppkey % 3 AS color, l_quantity AS w, l_discount AS h, l_tax AS r FROM lineitem)
SELECT color, round(sum(CASE WHEN color <> 1 THEN 0 WHEN kind = 1 THEN w * h WHEN kind = 2 THEN {PI} * r * r ELSE 0 END), 4) AS area FROM t GROUP BY color""")
def conditional_area(spark, folder):
    """Active area by colour, where colour 1 is active: the others have none."""
    area = grouping.shape_area(c("l_linenumber") % 4 + 1, c("l_quantity"), c("l_discount"), c("l_tax"))
    color = c("l_suppkey") % 3
    return table(spark, folder, "lineitem").groupBy(color.alias("color")).agg(F.round(grouping.active_area(area, color, F.lit(1)), 4).alias("area"))


def _pi_histogram(spark, folder, bins=10):
    return grouping.histogram(table(spark, folder, "orders").select(numeric.pi_fraction(c("o_orderkey") + 1).alias("x")), c("x"), bins)


PI_HIST = f"""h AS (SELECT CAST(least(floor((((o_orderkey + 1) * {D(PI)}) % 1.0) / CAST(0.1 AS DOUBLE)) + 1, 10) AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1),
f AS (SELECT g.bin, coalesce(n, 0) AS n, CAST(coalesce(n, 0) AS DOUBLE) / (SELECT count(*) FROM orders) AS freq FROM generate_series(1, 10) g(bin) LEFT JOIN h ON h.bin = g.bin)"""


@query("a11_histogram", f"WITH {PI_HIST} SELECT bin, n, round(freq, 8) AS freq FROM f")
def histogram(spark, folder):
    return _pi_histogram(spark, folder).select("bin", "n", F.round("freq", 8).alias("freq"))


@query("a11_max_deviation", f"WITH {PI_HIST} SELECT round(max(abs(freq - 0.1)), 8) AS max_deviation FROM f")
def max_deviation(spark, folder):
    return grouping.max_deviation(_pi_histogram(spark, folder), 10).select(F.round("max_deviation", 8).alias("max_deviation"))


@query("n8_pi_fractions", f"SELECT o_orderkey, round(((o_orderkey + 1) * {D(PI)}) % 1.0, 8) AS x FROM orders")
def pi_fractions(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", F.round(numeric.pi_fraction(c("o_orderkey") + 1), 8).alias("x"))


COLLATZ = """walk(n, v, len) AS (SELECT DISTINCT p_partkey + 1, p_partkey + 1, CAST(1 AS BIGINT) FROM part
  UNION ALL SELECT n, CASE WHEN v % 2 = 0 THEN v // 2 ELSE 3 * v + 1 END, len + 1 FROM walk WHERE v <> 1),
lengths AS (SELECT n, max(len) AS cnt FROM walk GROUP BY n)"""


@query("n4_collatz", f"WITH RECURSIVE {COLLATZ} SELECT n, cnt FROM lengths")
def collatz(spark, folder):
    numbers = table(spark, folder, "part").select((c("p_partkey") + 1).alias("n"))
    return numbers.select("n", numeric.collatz_length(c("n")).alias("cnt"))


@query("a12_argmax", f"WITH RECURSIVE {COLLATZ} SELECT n, cnt FROM lengths ORDER BY cnt DESC, n LIMIT 1")
def argmax(spark, folder):
    return grouping.argmax(collatz(spark, folder), "n", "cnt")


@query("a13_max_reduction", "SELECT max(l_extendedprice * (1 - l_discount)) AS top FROM lineitem")
def max_reduction(spark, folder):
    return table(spark, folder, "lineitem").agg(F.max(c("l_extendedprice") * (1 - c("l_discount"))).alias("top"))


@query("a15_row_norm", """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS l2 FROM embeddings""")
def row_norm(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.round(grouping.array_norm(c("embedding")), 6).alias("l2"))


@query("a15_l2_norm", """WITH v AS (SELECT l_suppkey, l_quantity AS x FROM lineitem) SELECT l_suppkey, round(sqrt(sum(x * x)), 6) AS l2, CAST(0.0 AS DOUBLE) AS l1 FROM v GROUP BY 1""")
def l2_norm(spark, folder):
    rows = table(spark, folder, "lineitem").groupBy("l_suppkey")
    return rows.agg(F.round(grouping.norm(c("l_quantity")), 6).alias("l2"), grouping.norm(c("l_quantity"), "L1").alias("l1"))


@query("a16_midpoint_sum", """WITH l AS (SELECT l_suppkey, l_quantity AS ux, CAST(l_linenumber AS DOUBLE) AS uy, l_quantity + l_linenumber AS vx, CAST(l_linenumber * 2 AS DOUBLE) AS vy FROM lineitem)
SELECT l_suppkey, round(sum((ux + vx) * 0.5), 4) AS plain, round(sum(((ux + vx) * 0.5) * ((uy + vy) * 0.5) * sqrt((vx - ux) * (vx - ux) + (vy - uy) * (vy - uy))), 3) AS weighted FROM l GROUP BY 1""")
def midpoint_sum(spark, folder):
    line = (c("l_quantity"), c("l_linenumber").cast("double"), c("l_quantity") + c("l_linenumber"), (c("l_linenumber") * 2).cast("double"))
    return table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.round(grouping.midpoint_sum(lambda x, y: x, *line), 4).alias("plain"),
        F.round(grouping.midpoint_sum(lambda x, y: x * y, *line, weighted=True), 3).alias("weighted"))


@query("a19_mean_ratio", """SELECT p_brand, round(avg(p_retailprice), 6) AS mean, round(exp(avg(ln(p_retailprice))), 6) AS geometric_mean, round(avg(p_retailprice) / exp(avg(ln(p_retailprice))), 6) AS ratio FROM part GROUP BY 1""")
def mean_ratio(spark, folder):
    return table(spark, folder, "part").groupBy("p_brand").agg(*[F.round(v, 6).alias(n) for n, v in grouping.mean_ratio(c("p_retailprice")).items()])


@query("a20_effective_rank", """WITH w AS (SELECT l_suppkey, l_quantity + 2.220446049250313e-16 AS w FROM lineitem), p AS (SELECT l_suppkey, w / sum(w) OVER (PARTITION BY l_suppkey) AS p FROM w)
SELECT l_suppkey, round(exp(-sum(p * ln(p))), 4) AS effective_rank FROM p GROUP BY 1""")
def effective_rank(spark, folder):
    ranks = grouping.effective_rank(table(spark, folder, "lineitem"), "l_quantity", ["l_suppkey"])
    return ranks.select("l_suppkey", F.round("effective_rank", 4).alias("effective_rank"))


@query("a21_squared_error", """SELECT l_suppkey, round(sum((l_discount - l_tax) * (l_discount - l_tax)) / 32, 6) AS mse FROM lineitem GROUP BY 1""")
def squared_error(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.round(grouping.squared_error(c("l_discount"), c("l_tax"), 32), 6).alias("mse"))


# ---- primes and integration -----------------------------------------------------------------

PRIMES = """lim AS (SELECT max(o_orderkey) AS m FROM orders), num AS (SELECT unnest(generate_series(2, (SELECT m - 1 FROM lim))) AS n),
comp AS (SELECT DISTINCT p.n * k AS n FROM num p, generate_series(2, (SELECT m // 2 + 1 FROM lim)) g(k) WHERE p.n * p.n < (SELECT m FROM lim) AND p.n * k < (SELECT m FROM lim)),
primes AS (SELECT n FROM num WHERE n NOT IN (SELECT n FROM comp))"""


def _primes(spark, folder):
    return numeric.primes_below(spark, table(spark, folder, "orders").agg(F.max("o_orderkey")).first()[0])


@query("n1_primes", f"WITH {PRIMES} SELECT count(*) AS primes FROM primes")
def primes(spark, folder):
    return _primes(spark, folder).agg(F.count("*").alias("primes"))


@query("n2_first_primes", f"WITH {PRIMES} SELECT n FROM primes ORDER BY n LIMIT (SELECT count(*) FROM supplier)")
def first_primes(spark, folder):
    return numeric.first_primes(spark, table(spark, folder, "supplier").count())


@query("n1_prime_orders", f"WITH {PRIMES} SELECT o_orderkey, o_totalprice FROM orders JOIN primes ON o_orderkey = n")
def prime_orders(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return orders.join(_primes(spark, folder), c("o_orderkey") == c("n"), "left_semi")


A, B = 1.15, 2.23
TRIALS_SQL = f"""p AS (SELECT s_suppkey, greatest({_horner_sql(_coefficients_sql("s_suppkey"), D(A))}, {_horner_sql(_coefficients_sql("s_suppkey"), D(B))}) AS top FROM supplier),
t AS (SELECT l_suppkey, top, {D(A)} + {D(B - A)} * (n * {D("0.7548776662466927")} - floor(n * {D("0.7548776662466927")})) AS x,
      top * (n * {D("0.5698402909980532")} - floor(n * {D("0.5698402909980532")})) AS y
      FROM (SELECT l_suppkey, CAST(l_orderkey * 7 + l_linenumber AS DOUBLE) AS n FROM lineitem) JOIN p ON l_suppkey = s_suppkey),
m AS (SELECT l_suppkey, count(*) AS trials, count(*) FILTER (WHERE y < {_horner_sql(_coefficients_sql("l_suppkey"), "x")}) AS hits, max(top) AS top FROM t GROUP BY 1)"""


def _trials(spark, folder):
    """Trial points from line items against the polynomial of their supplier."""
    k = _coefficients(c("l_suppkey"))
    ends = [scalars.horner(k, F.lit(v)) for v in (A, B)]
    n = c("l_orderkey") * 7 + c("l_linenumber")
    points = table(spark, folder, "lineitem").select("l_suppkey", F.greatest(*ends).alias("top"), n.alias("n"))
    # the interval width is a literal, so that both ends of the comparison round alike
    x = F.lit(A) + F.lit(B - A) * numeric.golden_point(c("n"), 0.7548776662466927)
    y = c("top") * numeric.golden_point(c("n"), 0.5698402909980532)
    return points.groupBy("l_suppkey").agg(
        F.count("*").alias("trials"), F.count_if(y < scalars.horner(_coefficients(c("l_suppkey")), x)).alias("hits"), F.max("top").alias("top"))


@query("n5_trial_integral", f"WITH {TRIALS_SQL} SELECT l_suppkey, trials, hits, round({D(B - A)} * (top * hits / trials), 6) AS integral FROM m")
def trial_integral(spark, folder):
    m = _trials(spark, folder)
    return m.select("l_suppkey", "trials", "hits", F.round(numeric.trial_integral(c("hits"), c("trials"), F.lit(0.0), F.lit(B - A), c("top")), 6).alias("integral"))


@query("n6_max_relative_error", f"""WITH {TRIALS_SQL}, e AS (SELECT {D(B - A)} * (top * hits / trials) AS mc, {_integral_sql("l_suppkey", D(A), D(B))} AS exact FROM m)
SELECT round(max(100.0 * abs(exact - mc) / exact), 6) AS max_rel_error FROM e""")
def max_relative_error(spark, folder):
    mc = numeric.trial_integral(c("hits"), c("trials"), F.lit(0.0), F.lit(B - A), c("top"))
    exact = scalars.polynomial_integral(_coefficients(c("l_suppkey")), F.lit(A), F.lit(B))
    return _trials(spark, folder).agg(F.round(F.max(100.0 * F.abs(exact - mc) / exact), 6).alias("max_rel_error"))


@query("n7_grid_norm", """WITH g AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS n FROM part),
v AS (SELECT (p_partkey // n) * (1.0::DOUBLE / n) AS y, (p_partkey % n) * (1.0::DOUBLE / n) AS x FROM part, g)
SELECT count(*) AS cells, round(sqrt(sum((x * y) * (x * y))), 6) AS l2 FROM v""")
def grid_norm(spark, folder):
    parts = table(spark, folder, "part")
    n = math.ceil(math.sqrt(parts.count()))
    cells = numeric.grid_points(parts.select("p_partkey"), "p_partkey", n)
    return cells.agg(F.count("*").alias("cells"), F.round(grouping.l2_norm(c("x") * c("y")), 6).alias("l2"))


# ---- matrices -------------------------------------------------------------------------------

@query("l1_banded", """WITH n AS (SELECT count(*) AS n FROM part), b(k, v) AS (VALUES (0, 6.0), (-1, -4.0), (1, -4.0), (-2, 1.0), (2, 1.0))
SELECT p_partkey + 1 AS i, p_partkey + 1 + k AS j, CAST(v AS DOUBLE) AS v FROM part, b, n WHERE p_partkey + 1 + k BETWEEN 1 AND n""")
def banded(spark, folder):
    parts = table(spark, folder, "part")
    return sparse.banded(parts.select((c("p_partkey") + 1).alias("i")), parts.count())


GRID = """g AS (SELECT CAST(ceil(count(*) / 10.0) AS BIGINT) AS n FROM part), cells AS (SELECT p_partkey // 10 AS r, p_partkey % 10 AS k, n FROM part, g),
b(o, v) AS (VALUES (0, 6), (-1, -4), (1, -4), (-2, 1), (2, 1)),
e AS (SELECT r * 10 + k + 1 AS i, (r + o) * 10 + k + 1 AS j, v FROM cells, b WHERE r + o BETWEEN 0 AND n - 1
      UNION ALL SELECT r * 10 + k + 1, r * 10 + k + o + 1, v FROM cells, b WHERE k + o BETWEEN 0 AND 9)"""


@query("l2_grid_operator", f"WITH {GRID} SELECT i, j, CAST(sum(v) AS DOUBLE) AS v FROM e GROUP BY 1, 2")
def grid_operator(spark, folder):
    """Grid of ten columns over the parts, one part per cell."""
    cells = table(spark, folder, "part").select((c("p_partkey") + 1).alias("cell"))
    return sparse.grid_operator(cells, (math.ceil(cells.count() / 10), 10))


@query("l2_kron_identity", """WITH n AS (SELECT count(*) AS n FROM supplier), b(k, v) AS (VALUES (0, 6.0), (-1, -4.0), (1, -4.0), (-2, 1.0), (2, 1.0)),
d AS (SELECT s_suppkey + 1 AS i, s_suppkey + 1 + k AS j, CAST(v AS DOUBLE) AS v FROM supplier, b, n WHERE s_suppkey + 1 + k BETWEEN 1 AND n),
x AS (SELECT (i - 1) * 8 + c + 1 AS i, (j - 1) * 8 + c + 1 AS j, v FROM d, generate_series(0, 7) g(c) UNION ALL SELECT c * n + i, c * n + j, v FROM d, n, generate_series(0, 7) g(c))
SELECT i, j, sum(v) AS v FROM x GROUP BY 1, 2""")
def kron_identity(spark, folder):
    suppliers = table(spark, folder, "supplier")
    n = suppliers.count()
    band = sparse.banded(suppliers.select((c("s_suppkey") + 1).alias("i")), n)
    return sparse.add(sparse.kron_with_identity(band, 8), sparse.kron_with_identity(band, 8, identity_first=True, times=n))


@query("l3_spmv", f"""WITH {s.COO} SELECT i, round(sum(v * p_retailprice), 2) AS y FROM coo JOIN part ON j = p_partkey + 1 GROUP BY 1""")
def spmv(spark, folder):
    x = table(spark, folder, "part").select((c("p_partkey") + 1).alias("i"), c("p_retailprice").alias("x"))
    return sparse.multiply(s.coo(spark, folder), x).select("i", F.round("y", 2).alias("y"))


@query("l3_factor_residual", """WITH x AS (SELECT p_partkey + 1 AS i, p_retailprice AS x FROM part),
nb AS (SELECT i, x, coalesce(lag(x) OVER (ORDER BY i), 0) AS xl, coalesce(lead(x) OVER (ORDER BY i), 0) AS xr FROM x),
h AS (SELECT i, CASE WHEN i = 1 THEN 4.0 ELSE 5.0 END * x + 2 * xl + 2 * xr AS y1, CAST(2.01 AS DOUBLE) * x + xr AS h FROM nb),
y AS (SELECT y1, CAST(2.01 AS DOUBLE) * h + coalesce(lag(h) OVER (ORDER BY i), 0) AS y2 FROM h)
SELECT round(sqrt(sum((y1 - y2) * (y1 - y2))) / sqrt(sum(y1 * y1)), 9) AS residual FROM y""")
def factor_residual(spark, folder):
    """A slightly wrong bidiagonal factor of a tridiagonal matrix."""
    parts = table(spark, folder, "part")
    rows = parts.select((c("p_partkey") + 1).alias("i"))
    n = parts.count()
    lower = sparse.banded(rows, n, {0: 2.01, -1: 1.0})
    matrix = sparse.banded(rows, n, {0: 5.0, -1: 2.0, 1: 2.0}).withColumn("v", F.when((c("i") == 1) & (c("j") == 1), 4.0).otherwise(c("v")))
    x = parts.select((c("p_partkey") + 1).alias("i"), c("p_retailprice").alias("x"))
    return sparse.factor_residual(matrix, lower, x).select(F.round("residual", 9).alias("residual"))


@query("a17_matrix_stats", f"WITH {s.COO} SELECT count(*) AS entries, max(i) AS rows, max(j) AS cols FROM coo")
def matrix_stats(spark, folder):
    return sparse.matrix_stats(s.coo(spark, folder))


@query("l4_solve", """SELECT p_partkey + 1 AS i, CAST(p_size AS DOUBLE) AS x FROM part""")
def solve(spark, folder):
    """Right-hand side made from a known vector, then solved back."""
    parts = table(spark, folder, "part")
    matrix = sparse.banded(parts.select((c("p_partkey") + 1).alias("i")), parts.count(), {0: 40.0, -1: -4.0, 1: -4.0, -2: 1.0, 2: 1.0})
    known = parts.select((c("p_partkey") + 1).alias("i"), c("p_size").cast("double").alias("x"))
    rhs = sparse.multiply(matrix, known, "x")
    return sparse.solve_spd(matrix, rhs).select("i", F.round("x", 6).alias("x"))


@query("l4_solve_general", """SELECT p_partkey + 1 AS i, CAST(p_size AS DOUBLE) AS x FROM part""")
def solve_general(spark, folder):
    """A band that is not symmetric, with a far coupling to the row a third of the table away."""
    parts = table(spark, folder, "part")
    n = parts.count()
    rows = parts.select((c("p_partkey") + 1).alias("i"))
    band = sparse.banded(rows, n, {0: 10.0, -1: -5.0, 1: 2.0, -2: 1.0, 2: -1.5})
    far = rows.select("i", ((c("i") + n // 3 - 1) % n + 1).alias("j"), F.lit(0.5).alias("v"))
    matrix = sparse.add(band, far)
    known = parts.select((c("p_partkey") + 1).alias("i"), c("p_size").cast("double").alias("x"))
    return krylov.solve(matrix, sparse.multiply(matrix, known, "x")).select("i", F.round("x", 6).alias("x"))


GRAM = """e AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
gram AS (SELECT a.k AS i, b.k AS j, sum(a.x * b.x) + CASE WHEN a.k = b.k THEN CAST(1e-4 AS DOUBLE) ELSE 0 END AS v FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY 1, 2)"""


@query("l6_gram", f"WITH {GRAM} SELECT i, j, round(v, 6) AS v FROM gram")
def gram(spark, folder):
    return lowrank.gram(table(spark, folder, "embeddings"), "embedding", 1e-4).select("i", "j", F.round("v", 6).alias("v"))


# ---- graphs ---------------------------------------------------------------------------------

WALK = f"""{s.SUPPLY_GRAPH},
walk(node, dist) USING KEY (node) AS (SELECT 'S0', CAST(0.0 AS DOUBLE)
  UNION SELECT e.dst, min(w.dist + e.w) FROM walk w JOIN supply e ON e.src = w.node LEFT JOIN recurring.walk k ON k.node = e.dst
  GROUP BY e.dst HAVING min(w.dist + e.w) < coalesce(min(k.dist), 1e300))"""


@query("r3_shortest_distances", f"WITH RECURSIVE {WALK} SELECT node, dist FROM walk")
def shortest_distances(spark, folder):
    edges, source = s.supply_graph(spark, folder)
    return graph.shortest_distances(edges, source)


@query("r3_unreachable", f"""WITH RECURSIVE {WALK}, apart AS (SELECT 'N' || n_nationkey AS a, 'R' || n_regionkey AS b FROM nation), nodes AS (SELECT src AS node FROM supply UNION SELECT a FROM apart UNION SELECT b FROM apart)
SELECT count(*) AS unreachable FROM nodes WHERE node NOT IN (SELECT node FROM walk)""")
def unreachable(spark, folder):
    """The supply graph beside the nations and their regions, which no supplier is linked with."""
    edges, source = s.supply_graph(spark, folder)
    nations = table(spark, folder, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("a"), F.concat(F.lit("R"), "n_regionkey").alias("b"), F.lit(1.0).alias("w"))
    return graph.unreachable_count(graph.all_distances(edges.unionByName(graph.undirected(nations, "a", "b", "w")), source))


@query("r4_neighbours", f"WITH {s.SUPPLY_GRAPH} SELECT src, dst, w FROM supply WHERE src = 'S0'")
def neighbours(spark, folder):
    edges, source = s.supply_graph(spark, folder)
    return graph.neighbours_of(edges, source)


@query("r6_elimination_tree", """WITH RECURSIVE
low AS (SELECT p_partkey + 1 - d AS j, p_partkey + 1 AS i FROM part, LATERAL (SELECT unnest([1 + p_size % 4, 5]) AS d) WHERE p_partkey + 1 - d >= 1),
cols(j, parent, held) USING KEY (j) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION
  SELECT t.j, coalesce(min(x.i), 0), coalesce(list(DISTINCT x.i) FILTER (x.i IS NOT NULL), [])
  FROM (SELECT j + 1 AS j FROM cols WHERE j < (SELECT count(*) FROM part)) t
  LEFT JOIN (SELECT j, i FROM low UNION ALL SELECT parent, unnest(held) FROM recurring.cols WHERE parent > 0) x ON x.j = t.j AND x.i > t.j GROUP BY t.j)
SELECT j AS node, parent FROM cols WHERE j > 0""")
def elimination_tree(spark, folder):
    """Symmetric band pattern over the parts: row i meets columns i - 1 - size % 4 and i - 5."""
    i = c("p_partkey") + 1
    rows = table(spark, folder, "part").select(i.alias("i"), F.explode(F.array(i, i - 1 - c("p_size") % 4, i - 5)).alias("j"))
    return graph.elimination_tree(rows.where("j >= 1"))
