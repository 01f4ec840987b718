"""A keyed permutation of 0..n-1 as a column expression: additive Feistel rounds and cycle walking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
#: Steps of the walk. At most a = ceil(sqrt(n)) points lie outside 0..n-1, so a walk that is
#: longer than a + 1 can't be, and one longer than WALK happens with chance under a**-WALK.
WALK = 64


def feistel(x: Column, n: Column, key: Column) -> Column:
    """Where x goes. n >= 1 and 0 <= x < n; the same (n, key) always gives the same bijection.

    x is split into (x div b, x mod b) with a = ceil(sqrt(n)) and b = ceil(n / a); each round adds
    a keyed hash of one half to the other, which any hash makes a bijection of 0..a*b-1. A value
    of n or more is sent through the rounds again until it falls below n.
    """
    n = n.cast("long")
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    b = F.greatest(F.ceil(n / a), F.lit(1)).cast("long")

    def rounds(v: Column) -> Column:
        def one(acc: Column, i: Column) -> Column:
            left, right = acc["l"], acc["r"]
            even = F.pmod(i, F.lit(2)) == 0
            return F.struct(
                F.when(even, F.pmod(left + F.pmod(F.xxhash64(key, i, right), a), a)).otherwise(left).alias("l"),
                F.when(even, right).otherwise(F.pmod(right + F.pmod(F.xxhash64(key, i, left), b), b)).alias("r"),
            )

        return F.aggregate(
            F.array(*[F.lit(i) for i in range(ROUNDS)]),
            F.struct(((v - F.pmod(v, b)) / b).cast("long").alias("l"), F.pmod(v, b).alias("r")),
            one,
            lambda acc: acc["l"] * b + acc["r"],
        )

    first = rounds(x.cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda v, _: F.when(v < n, v).otherwise(rounds(v)))
