"""A keyed bijection of row numbers: the permutation of a replicate, computed instead of sorted.

A number x below n is a cell of a grid of a x b cells with a = ceil(sqrt(n)) and b = ceil(n / a), so fewer than a cells
are beyond n. Rounds of a Feistel network shift the row by a keyed hash of the column and the column by one of the
row, modulo a and b: each is undone by a subtraction, so all are a bijection of the grid. A cell that lands
beyond n walks on until it is below (cycle walking), which is a bijection of the numbers below n.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modulus and factors of the round hash; its products stay below 2^63.
P, A, B, C, D = 2147483647, 48271, 69621, 16807, 39373
ROUNDS = 8
#: Steps of a walk that SQL writes out; sixty-four cells beyond n in a row are less likely than 2^-380.
STEPS = 64


def partners(number: np.ndarray, size: np.ndarray, replicate: np.ndarray, seed: int = 0) -> np.ndarray:
    """The number (1 to ``size``) that a replicate puts in a number's place."""
    n, r = size.astype(np.int64), replicate.astype(np.int64)
    a = np.ceil(np.sqrt(n.astype(np.float64))).astype(np.int64)
    b = (n + a - 1) // a

    def hashed(v: np.ndarray, k: int, at: np.ndarray | slice) -> np.ndarray:
        t = (v * A + r[at] * B + (k * C + seed * 7919)) % P
        u = (t * t + D) % P
        return (u * u + t) % P

    x = number.astype(np.int64) - 1
    at: np.ndarray | slice = slice(None)
    while True:
        row, col = x[at] // b[at], x[at] % b[at]
        for k in range(ROUNDS):
            if k % 2:
                col = (col + hashed(row, k, at)) % b[at]
            else:
                row = (row + hashed(col, k, at)) % a[at]
        x[at] = row * b[at] + col
        at = np.flatnonzero(x >= n)
        if not len(at):
            return x + 1


def partner(number: Column, size: Column, replicate: Column, seed: int = 0) -> Column:
    """``partners`` as a column: over all numbers of a replicate each comes once. (As built-in functions, the rounds make a tree that grows with powers.)"""

    @F.pandas_udf("long")
    def run(i: pd.Series, n: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(partners(i.to_numpy(), n.to_numpy(), r.to_numpy(), seed))

    return run(number.cast("long"), size.cast("long"), replicate.cast("long"))


def with_partner(df: DataFrame, number: str, size: str, replicate: str, name: str, seed: int = 0) -> DataFrame:
    """``df`` with the partner of each row's number in ``name``."""
    return df.withColumn(name, partner(F.col(number), F.col(size), F.col(replicate), seed))


def partner_sql(number: str, size: str, replicate: str, seed: int = 0) -> str:
    """``partners`` in DuckDB's SQL."""
    n, a = f"CAST({size} AS BIGINT)", f"CAST(ceil(sqrt({size})) AS BIGINT)"
    b = f"(({n} + {a} - 1) // {a})"
    t = lambda v: f"(({v} * {A} + CAST({replicate} AS BIGINT) * {B} + (k * {C} + {seed * 7919})) % {P})"
    u = lambda v: f"(({t(v)} * {t(v)} + {D}) % {P})"
    h = lambda v: f"(({u(v)} * {u(v)} + {t(v)}) % {P})"
    row, col = f"(c // {b})", f"(c % {b})"
    step = f"CASE WHEN k % 2 = 1 THEN {row} * {b} + ({col} + {h(row)}) % {b} ELSE (({row} + {h(col)}) % {a}) * {b} + {col} END"
    rounds = ", ".join(map(str, range(ROUNDS)))
    once = f"list_reduce([x, {rounds}], lambda c, k: {step})"
    return f"(list_reduce([CAST({number} AS BIGINT) - 1, {', '.join(map(str, range(STEPS + 1)))}], lambda x, w: CASE WHEN w > 0 AND x < {n} THEN x ELSE {once} END) + 1)"
