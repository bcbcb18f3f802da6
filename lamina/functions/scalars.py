"""Scalar expressions: polynomials, 2x2 systems, complex numbers, gate costs, units, text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Operation codes 0..9 in order, and gates per bit of the operations with hardware.
OPERATIONS = ("NONE", "ADD", "SUB", "MUL", "DIV", "MOD", "EXP", "LOG", "LSH", "RSH")
GATES_PER_BIT = {"ADD": 16, "SUB": 18, "MUL": 64, "LSH": 2, "RSH": 2}

# One kilogram expressed in each weight unit's factor.
KILOGRAMS = {"g": 0.001, "kg": 1.0, "pounds": 1 / 2.25}


def operation_code(name: Column) -> Column:
    """Code of an operation name, -1 when unknown."""
    return F.array_position(F.array(*map(F.lit, OPERATIONS)), name).cast("int") - 1


def operation_name(code: Column) -> Column:
    """Name of an operation code, NONE when unknown."""
    known = F.try_element_at(F.array(*map(F.lit, OPERATIONS)), F.when((code >= 0) & (code < len(OPERATIONS)), code + 1).otherwise(1).cast("int"))
    return F.coalesce(known, F.lit("NONE"))


def has_hardware(name: Column) -> Column:
    return name.isin(*GATES_PER_BIT)


def gate_count(name: Column, width: Column) -> Column:
    cost = F.lit(0).cast("bigint")
    for op, gates in GATES_PER_BIT.items():
        cost = F.when(name == op, width.cast("bigint") * gates).otherwise(cost)
    return cost


def kilograms(amount: Column, unit: str) -> Column:
    return amount * F.lit(KILOGRAMS[unit])


def thousands(n: Column) -> Column:
    """Integer text with separators, as in 21,239,393."""
    return F.format_number(n, 0)


def horner(coefficients: Sequence[Column], x: Column) -> Column:
    """Polynomial value, coefficients from the constant term up, by nested multiplication."""
    value = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        value = c + value * x
    return value


def horner_array(coefficients: Column, x: Column) -> Column:
    """The same for a coefficient array of any length."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, c: acc * x + c)


def power_form(coefficients: Sequence[Column], x: Column) -> Column:
    """Polynomial value as a sum of coefficient times power."""
    total, power = F.lit(0.0), F.lit(1.0)
    for c in coefficients:
        total, power = total + power * c, power * x
    return total


def polynomial_integral(coefficients: Sequence[Column], a: Column, b: Column) -> Column:
    """Exact integral over [a, b]."""
    anti = [F.lit(0.0)] + [c / F.lit(float(k)) for k, c in enumerate(coefficients, 1)]
    return horner(anti, b) - horner(anti, a)


def cramer(a1: Column, b1: Column, c1: Column, a2: Column, b2: Column, c2: Column) -> dict[str, Column]:
    """Solution of ``a x + b y = c`` twice; nulls when the determinant is 0.

    ``x, y`` are exact quotients, ``x_int, y_int`` their integer parts.
    """
    d = F.nullif(a1 * b2 - a2 * b1, F.lit(0))
    x, y = (c1 * b2 - c2 * b1) / d, (a1 * c2 - a2 * c1) / d
    return {"solved": d.isNotNull(), "x": x, "y": y, "x_int": x.cast("bigint"), "y_int": y.cast("bigint")}


def lift(value: Column) -> Column:
    """Real number as a complex one."""
    return F.struct(value.cast("double").alias("re"), F.lit(0.0).alias("im"))


def complex_add(a: Column, b: Column) -> Column:
    return F.struct((a["re"] + b["re"]).alias("re"), (a["im"] + b["im"]).alias("im"))


def zero_to_null(z: Column) -> Column:
    return F.when((z["re"] != 0) | (z["im"] != 0), z)


def share_sum_is_four(a: Column, b: Column, c: Column) -> Column:
    """Whether a/(b+c) + b/(a+c) + c/(a+b) equals 4; false where a denominator is 0."""
    s = a + b + c
    total = F.try_divide(a, s - a) + F.try_divide(b, s - b) + F.try_divide(c, s - c)
    return F.coalesce(total == F.lit(4.0), F.lit(False))


def linear_blend(xs: Column, ys: Column) -> Column:
    """``2 x + 3 y`` per element."""
    return F.zip_with(xs, ys, lambda x, y: 2.0 * x + 3.0 * y)


def sines(xs: Column) -> Column:
    return F.transform(xs, F.sin)


def factorial(n: Column) -> Column:
    """n! for 0..20, null outside."""
    return F.factorial(n)


def fibonacci(n: int) -> Column:
    """Array of the first ``n`` Fibonacci numbers, starting 1, 1 (n up to 92)."""
    if not 0 <= n <= 92:
        raise ValueError("n is between 0 and 92")
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b"))
    steps = F.array_repeat(F.lit(0), n)
    return F.aggregate(steps, start, lambda s, _: F.struct(
        F.concat(s["out"], F.array(s["b"])).alias("out"), s["b"].alias("a"),
        F.coalesce(F.try_add(s["a"], s["b"]), F.lit(0)).alias("b")), lambda s: s["out"])


def fibonacci_number(n: Column) -> Column:
    """fib(n) with fib(0) = 0 and fib(1) = 1, by running the pair (a, b) forward; null above 92, beyond bigint."""
    start = F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b"))
    steps = F.array_repeat(F.lit(0), n.cast("int"))
    return F.aggregate(steps, start, lambda s, _: F.struct(s["b"].alias("a"), F.try_add(s["a"], s["b"]).alias("b")), lambda s: s["a"])


def general_text(value: Column, digits: int = 12) -> Column:
    """Shortest decimal text at ``digits`` significant digits, for sizes from 1e-4 to below 10**digits.

    Numbers outside that range are written in scientific form.
    """
    size = F.abs(value)
    whole = F.when(size == 0, F.lit(0)).otherwise(F.floor(F.log10(size))).cast("int")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - whole)
    rounded = (F.rint(value * scale) / scale).cast(f"decimal(38,{digits + 4})").cast("string")
    plain = F.regexp_replace(F.regexp_replace(rounded, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    fits = (size == 0) | ((size >= 1e-4) & (size < 10.0**digits))
    return F.when(fits, plain).otherwise(F.regexp_replace(F.format_string(f"%.{digits - 1}e", value), r"\.?0+e", "e"))


def transform_map(values: Column, function) -> Column:
    """Apply ``function(key, value)`` to every entry of a map."""
    return F.transform_values(values, function)
