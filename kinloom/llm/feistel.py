"""A keyed permutation of 0..n-1 in column expressions: a Feistel network on Z_a x Z_b with cycle walking.

b is about the square root of n and a * b < n + b, so a walk, which leaves 0..n-1 only over the fewer than b points
above it, needs one step for nearly every row and ends after at most b steps for any.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647
ROUNDS = 6


def round_keys(seed: int) -> list[tuple[int, int]]:
    """(addend, factor) of each round, by the minimal standard generator from the seed."""
    out, x = [], seed % (PRIME - 1) + 1
    for _ in range(ROUNDS):
        x = x * 48271 % PRIME
        y = x * 48271 % PRIME
        out.append((x, y))
        x = y
    return out


def halves(n: Column) -> tuple[Column, Column]:
    b = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    return F.ceil(n / b).cast("long"), b


def _mix(x: Column, k: Column, m: Column) -> Column:
    t = (x + k["add"]) % PRIME
    return ((t * t % PRIME) * k["mul"] + x) % PRIME % m


def _keys(seed: int, back: bool) -> Column:
    keys = [F.struct(F.lit(i % 2 == 0).alias("even"), F.lit(x).cast("long").alias("add"), F.lit(y).cast("long").alias("mul")) for i, (x, y) in enumerate(round_keys(seed))]
    return F.array(*(keys[::-1] if back else keys))


def _step(x: Column, a: Column, b: Column, seed: int, back: bool) -> Column:
    def turn(s: Column, k: Column) -> Column:
        left, right = (_mix(s["r"], k, a), _mix(s["l"], k, b))
        if back:
            left, right = a - left, b - right
        return F.struct(F.when(k["even"], (s["l"] + left) % a).otherwise(s["l"]).alias("l"), F.when(k["even"], s["r"]).otherwise((s["r"] + right) % b).alias("r"))

    start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))
    return F.aggregate(_keys(seed, back), start, turn, lambda s: s["l"] * b + s["r"])


def permute(x: Column, n: Column, seed: int = 0, back: bool = False) -> Column:
    """The place of x (long, 0..n-1) under the permutation of 0..n-1 that the seed names; back: its inverse."""
    a, b = halves(n)
    once = lambda v: _step(v, a, b, seed, back)
    walk = lambda v: F.when(v < n, v).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), b), v, lambda y, _: F.when(y < n, y).otherwise(once(y))))
    return F.element_at(F.transform(F.array(once(x)), walk), 1)


def permute_int(x: int, n: int, seed: int = 0) -> int:
    """The same in plain Python, for readers that look one row up."""
    b = math.isqrt(max(n - 1, 0)) + 1
    a = -(-n // b)
    keys = round_keys(seed)
    while True:
        left, right = divmod(x, b)
        for i, (add, mul) in enumerate(keys):
            v, m = (right, a) if i % 2 == 0 else (left, b)
            t = (v + add) % PRIME
            f = ((t * t % PRIME) * mul + v) % PRIME % m
            if i % 2 == 0:
                left = (left + f) % a
            else:
                right = (right + f) % b
        x = left * b + right
        if x < n:
            return x


def permute_array(x, n: int, seed: int = 0):
    """The same for an array of numbers."""
    import numpy as np

    b = math.isqrt(max(n - 1, 0)) + 1
    a = -(-n // b)
    keys, out = round_keys(seed), np.array(x, np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = np.divmod(out[todo], b)
        for i, (add, mul) in enumerate(keys):
            v, m = (right, a) if i % 2 == 0 else (left, b)
            t = (v + add) % PRIME
            f = ((t * t % PRIME) * mul + v) % PRIME % m
            if i % 2 == 0:
                left = (left + f) % a
            else:
                right = (right + f) % b
        out[todo] = left * b + right
        todo = todo[out[todo] >= n]
    return out
