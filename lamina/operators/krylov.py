"""Linear systems with any square matrix: stabilised bi-conjugate gradients with incomplete factors by block.

The unknowns are cut into blocks of consecutive ones. The entries inside a block get an incomplete factor without
fill, computed by one task from that block alone; it is applied by levels: all rows that only wait for
rows of earlier levels are solved together. Products with the matrix are joins over all entries, so couplings
between blocks count in full and only slow convergence down.

A round writes two tables, each after one factor application and one product. The sums that steer
the method are collected while the tables are written.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from lamina.checks import StrictModeError
from lamina.durable import materialise
from lamina.operators.sparse import multiply

BLOCK_ROWS = 2048
_FACTOR = {"rows": np.int64, "starts": np.int64, "cols": np.int64, "values": np.float64, "pivots": np.float64, "down": np.int64, "up": np.int64}


def incomplete_factor(starts: np.ndarray, cols: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the unit lower and the upper factor on the pattern of the rows, and the pivots.

    A pivot that vanishes beside its row is replaced by a small one, which keeps the factor usable.
    """
    values, n = values.copy(), len(starts) - 1
    place = [dict(zip(cols[starts[i]:starts[i + 1]].tolist(), range(starts[i], starts[i + 1]))) for i in range(n)]
    pivots = np.ones(n)
    for i in range(n):
        own = place[i]
        for k in sorted(c for c in own if c < i):
            factor = values[own[k]] = values[own[k]] / pivots[k]
            for j, at in place[k].items():
                if j > k and j in own:
                    values[own[j]] -= factor * values[at]
        size = np.abs(values[starts[i]:starts[i + 1]]).max(initial=0.0) or 1.0
        pivot = values[own[i]] if i in own else 0.0
        pivots[i] = pivot if abs(pivot) > 1e-8 * size else math.copysign(1e-2 * size, pivot or 1.0)
    return values, pivots


def levels(starts: np.ndarray, cols: np.ndarray, lower: bool) -> np.ndarray:
    """Level of each row: one above the highest row that it waits for."""
    n = len(starts) - 1
    level = np.zeros(n, np.int64)
    for i in range(n) if lower else range(n - 1, -1, -1):
        own = cols[starts[i]:starts[i + 1]]
        waits = own[own < i] if lower else own[own > i]
        level[i] = level[waits].max() + 1 if len(waits) else 0
    return level


def triangular(starts: np.ndarray, cols: np.ndarray, values: np.ndarray, pivots: np.ndarray | None, level: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve with the unit lower factor (no ``pivots``) or the upper one, level by level."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    part = cols < row if pivots is None else cols > row
    row, cols, values = row[part], cols[part], values[part]
    order = np.argsort(level[row], kind="stable")
    row, cols, values = row[order], cols[order], values[order]
    cuts = np.searchsorted(level[row], np.arange(level.max(initial=0) + 2))
    members = np.argsort(level, kind="stable")
    ends = np.searchsorted(level[members], np.arange(level.max(initial=0) + 2))
    x = right.copy()
    for k in range(len(cuts) - 1):
        s, e = cuts[k], cuts[k + 1]
        if e > s:
            np.subtract.at(x, row[s:e], values[s:e] * x[cols[s:e]])
        if pivots is not None:
            own = members[ends[k]:ends[k + 1]]
            x[own] /= pivots[own]
    return x


def _factor_block(table: pa.Table) -> pa.Table:
    i, j, v = (table.column(n).to_numpy() for n in ("i", "j", "v"))
    rows = np.unique(np.concatenate([i, j]))
    order = np.lexsort((j, i))
    i, j, v = np.searchsorted(rows, i[order]), np.searchsorted(rows, j[order]), v[order]
    starts = np.searchsorted(i, np.arange(len(rows) + 1))
    values, pivots = incomplete_factor(starts, j, v)
    parts = (rows, starts, j, values, pivots, levels(starts, j, True), levels(starts, j, False))
    return pa.table({"block": table.column("block").slice(0, 1), **{n: pa.array([p.astype(t).tobytes()], pa.binary()) for (n, t), p in zip(_FACTOR.items(), parts)}})


def _apply_block(vector: pa.Table, factor: pa.Table) -> pa.Table:
    """``z`` of one block; rows outside the factor's pattern stay as they are."""
    names, right = vector.column("i").to_numpy(), vector.column("y").to_numpy()
    if not factor.num_rows:
        return pa.table({"i": names, "z": right})
    rows, starts, cols, values, pivots, down, up = (np.frombuffer(factor.column(n)[0].as_py(), t) for n, t in _FACTOR.items())
    y = np.zeros(len(rows))
    at = np.searchsorted(rows, names)
    known = (at < len(rows)) & (rows[np.minimum(at, len(rows) - 1)] == names)
    y[at[known]] = right[known]
    z = triangular(starts, cols, values, pivots, up, triangular(starts, cols, values, None, down, y))
    result = right.copy()
    result[known] = z[at[known]]
    return pa.table({"i": names, "z": result})


def _observed(df: DataFrame, **sums) -> tuple[DataFrame, dict[str, float]]:
    seen = Observation()
    stored = materialise(df.observe(seen, *[F.coalesce(F.sum(v), F.lit(0.0)).alias(n) for n, v in sums.items()]))
    return stored, seen.get


def solve(matrix: DataFrame, rhs: DataFrame, tolerance: float = 1e-10, block_rows: int = BLOCK_ROWS, patience: int = 100) -> DataFrame:
    """Solve ``A x = b`` for a square matrix ``(i, j, v)`` and ``b`` as ``(i, x)`` with a row for every unknown.

    Ends when the residual is below ``tolerance`` times the length of b, measured on the residual itself, and
    raises when it has not fallen for ``patience`` rounds or the method breaks down twice in a row, as it does for a
    singular matrix. Repeated entries add up.
    """
    c = F.col
    block = F.floor(c("i") / block_rows).cast("bigint")
    matrix = materialise(matrix.groupBy("i", "j").agg(F.sum("v").alias("v")))
    inside = matrix.where(block == F.floor(c("j") / block_rows)).withColumn("block", block)
    kinds = ", ".join(f"{n} binary" for n in _FACTOR)
    factors = materialise(inside.groupBy("block").applyInArrow(_factor_block, f"block bigint, {kinds}"))

    def through(state: DataFrame, y: str, z: str, product: str) -> DataFrame:
        """``state`` with ``z = M^-1 y`` and ``product = A z``."""
        vector = state.select(block.alias("block"), "i", c(y).alias("y"))
        solved = vector.groupBy("block").cogroup(factors.groupBy("block")).applyInArrow(_apply_block, "i bigint, z double")
        solved = materialise(solved)  # used twice
        times = multiply(matrix, solved.select("i", c("z").alias("x")), product)
        joined = state.join(solved.withColumnRenamed("z", z), "i").join(times, "i", "left")
        return joined.withColumn(product, F.coalesce(product, F.lit(0.0)))

    zero = F.lit(0.0)
    state, sums = _observed(rhs.select("i", zero.alias("x"), c("x").alias("b"), c("x").alias("r"), c("x").alias("h"), zero.alias("p"), zero.alias("v")), rr=c("b") * c("b"))
    size = sums["rr"]
    rho_old = alpha = omega = 1.0
    rho, rr, best, since, broken = size, size, size, 0, 0
    while True:
        if rr <= size * tolerance ** 2 or not rr:
            left = rhs.select("i", c("x").alias("b")).join(multiply(matrix, state.select("i", "x"), "ax"), "i", "left")
            true = left.withColumn("r", c("b") - F.coalesce("ax", zero))
            fresh, sums = _observed(state.select("i", "x", "b").join(true.select("i", "r"), "i"), rr=c("r") * c("r"))
            if sums["rr"] <= size * max(tolerance, 1e-13) ** 2 or not sums["rr"]:
                return fresh.select("i", "x")
            state, rho = fresh.select("i", "x", "b", "r", c("r").alias("h"), zero.alias("p"), zero.alias("v")), sums["rr"]  # go on from the true residual
            rr, rho_old, alpha, omega = rho, 1.0, 1.0, 1.0
        beta = rho / rho_old * alpha / omega
        turned = state.withColumn("p", c("r") + beta * (c("p") - omega * c("v"))).drop("v")
        half, sums = _observed(through(turned, "p", "ph", "v"), hv=c("h") * c("v"))
        if not sums["hv"] or not math.isfinite(sums["hv"]):
            raise StrictModeError("the method broke down: the matrix may be singular")
        alpha = rho / sums["hv"]
        stepped = half.withColumn("s", c("r") - alpha * c("v"))
        done, sums = _observed(through(stepped, "s", "sh", "t"), ts=c("t") * c("s"), tt=c("t") * c("t"), ss=c("s") * c("s"), hs=c("h") * c("s"), ht=c("h") * c("t"))
        omega = sums["ts"] / sums["tt"] if sums["tt"] else 0.0
        state = done.select("i", (c("x") + alpha * c("ph") + omega * c("sh")).alias("x"), "b", (c("s") - omega * c("t")).alias("r"), "h", "p", "v")
        rho_old, rho = rho, sums["hs"] - omega * sums["ht"]
        rr = max(0.0, sums["ss"] - 2 * omega * sums["ts"] + omega ** 2 * sums["tt"])
        best, since = (rr, 0) if rr < best else (best, since + 1)
        if since > patience:
            raise StrictModeError(f"the residual has not fallen for {patience} rounds")
        if rr > size * tolerance ** 2 and (not omega or abs(rho) < 1e-30 * size):  # start again with another shadow
            broken += 1
            if broken > 1:
                raise StrictModeError("the method broke down: the matrix may be singular")
            state, sums = _observed(state.select("i", "x", "b", "r", c("r").alias("h"), zero.alias("p"), zero.alias("v")), rr=c("r") * c("r"))
            rho, rho_old, alpha, omega = sums["rr"], 1.0, 1.0, 1.0
        else:
            broken = 0
