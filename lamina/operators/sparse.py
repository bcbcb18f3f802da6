"""Sparse matrices as coordinate tables ``(i, j, v)`` and vectors as ``(i, x)``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from lamina.checks import StrictModeError
from lamina.durable import materialise

# Diagonals of the fourth-order difference operator and of its all-positive variant.
FOURTH_ORDER = {0: 6.0, -1: -4.0, 1: -4.0, -2: 1.0, 2: 1.0}
RESISTIVE = {0: 6.0, -1: 4.0, 1: 4.0, -2: 1.0, 2: 1.0}


def banded(rows: DataFrame, size: Column | int, diagonals: Mapping[int, float] = FOURTH_ORDER) -> DataFrame:
    """Entries of a banded operator for the rows ``i`` (1-based) of a matrix of the given size."""
    bands = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(v).alias("v")) for k, v in sorted(diagonals.items())])
    size = F.lit(size).cast("bigint") if isinstance(size, int) else size
    return (
        rows.select("i", size.alias("_n"), F.explode(bands).alias("b"))
        .select("i", (F.col("i") + F.col("b.k")).alias("j"), F.col("b.v").alias("v"), "_n")
        .where((F.col("j") >= 1) & (F.col("j") <= F.col("_n")))
        .drop("_n")
    )


def kron_with_identity(entries: DataFrame, size: int, identity_first: bool = False, times: int = 1) -> DataFrame:
    """Kronecker product of a matrix with the identity of order ``size``.

    ``identity_first`` puts the identity on the left, repeating the ``times`` x ``times`` matrix
    along the diagonal.
    """
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))).alias("c")
    wide = entries.select("i", "j", "v", copies)
    if identity_first:
        return wide.select((F.col("c") * times + F.col("i")).alias("i"), (F.col("c") * times + F.col("j")).alias("j"), "v")
    return wide.select(((F.col("i") - 1) * size + F.col("c") + 1).alias("i"), ((F.col("j") - 1) * size + F.col("c") + 1).alias("j"), "v")


def add(*matrices: DataFrame) -> DataFrame:
    """Sum of matrices; entries at the same place add up."""
    total = matrices[0]
    for m in matrices[1:]:
        total = total.unionByName(m)
    return total.groupBy("i", "j").agg(F.sum("v").alias("v"))


def grid_operator(cells: DataFrame, shape: tuple[int, ...], diagonals: Mapping[int, float] = FOURTH_ORDER) -> DataFrame:
    """Sum over the axes of ``I x .. D .. x I`` on a grid, built from the cells present.

    ``cells`` holds the 1-based ``cell`` numbers (last axis fastest). Each cell emits its own row
    of the operator by index arithmetic, so nothing is multiplied out or shuffled.
    """
    strides = [1] * len(shape)
    for axis in range(len(shape) - 2, -1, -1):
        strides[axis] = strides[axis + 1] * shape[axis + 1]
    zero = F.col("cell") - 1
    places = [F.pmod(F.floor(zero / s), F.lit(n)) for s, n in zip(strides, shape)]
    centre = sum(diagonals.get(0, 0.0) for _ in shape)
    terms = [F.struct(F.col("cell").alias("j"), F.lit(centre).alias("v"), F.lit(True).alias("ok"))]
    for place, stride, n in zip(places, strides, shape):
        for k, v in sorted(diagonals.items()):
            if k:
                inside = (place + k >= 0) & (place + k < n)
                terms.append(F.struct((F.col("cell") + k * stride).alias("j"), F.lit(v).alias("v"), inside.alias("ok")))
    return cells.select(F.col("cell").alias("i"), F.explode(F.array(*terms)).alias("t")).where("t.ok").select("i", "t.j", "t.v")


def multiply(matrix: DataFrame, vector: DataFrame, name: str = "y") -> DataFrame:
    """``A x``: rows without a matching entry do not appear."""
    x = vector.select(F.col("i").alias("j"), F.col("x"))
    return matrix.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias(name))


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matrix_stats(matrix: DataFrame) -> DataFrame:
    """Entry count and largest row and column index."""
    return matrix.agg(F.count("*").alias("entries"), F.max("i").alias("rows"), F.max("j").alias("cols"))


def factor_residual(matrix: DataFrame, lower: DataFrame, vector: DataFrame, permutation: DataFrame | None = None) -> DataFrame:
    """Relative error ``|A x - P' L L' P x| / |A x|`` of a Cholesky factor, probed with one vector.

    ``permutation`` maps position ``k`` to original index ``p``; omitted, it is the identity.
    """
    y1 = multiply(matrix, vector, "y1")
    x = vector
    if permutation is not None:
        x = permutation.join(vector, permutation["p"] == vector["i"]).select(F.col("k").alias("i"), "x")
    half = multiply(transpose(lower), x, "x")
    full = multiply(lower, half, "y2")
    if permutation is not None:
        full = full.join(permutation, full["i"] == permutation["k"]).select(F.col("p").alias("i"), "y2")
    both = y1.join(full, "i", "full").select(F.coalesce("y1", F.lit(0.0)).alias("a"), F.coalesce("y2", F.lit(0.0)).alias("b"))
    gap = F.col("a") - F.col("b")
    return both.agg((F.sqrt(F.sum(gap * gap)) / F.sqrt(F.sum(F.col("a") * F.col("a")))).alias("residual"))


def solve_spd(matrix: DataFrame, rhs: DataFrame, tolerance: float = 1e-10, patience: int = 200) -> DataFrame:
    """Solve ``A x = b`` for a symmetric positive definite matrix by conjugate gradients.

    One written table holds x, r and p side by side; a round joins it once with the matrix. The
    driver sees only the two step lengths. Rounds go on for as long as the residual has fallen within
    the last ``patience`` of them. Returns ``(i, x)``.
    """
    matrix = materialise(matrix)
    state = materialise(rhs.select("i", F.lit(0.0).alias("x"), F.col("x").alias("r"), F.col("x").alias("p")))
    rr = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    limit = rr * tolerance * tolerance
    best, since = rr, 0
    while since <= patience:
        if rr <= limit or rr == 0.0:
            return state.select("i", "x")
        ap = multiply(matrix, state.select("i", F.col("p").alias("x")), "ap")
        step = materialise(state.join(ap, "i", "left").withColumn("ap", F.coalesce("ap", F.lit(0.0))))
        sums = step.agg(F.sum(F.col("p") * F.col("ap")).alias("pap")).first()
        if sums["pap"] <= 0:
            raise StrictModeError("matrix is not positive definite")
        alpha = rr / sums["pap"]
        moved = step.select("i", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p")
        new_rr = moved.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        beta = new_rr / rr
        state = moved.withColumn("p", F.col("r") + beta * F.col("p"))
        rr = new_rr
        best, since = (rr, 0) if rr < best else (best, since + 1)
    raise StrictModeError(f"the residual has not fallen for {patience} rounds")
