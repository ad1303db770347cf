"""Random numbers derived from row keys.

``rand(seed)`` changes with the partitioning; these do not: the same key gives the
same number on any cluster, after any retry, and in any SQL engine with md5.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(2**52)  # 13 hex digits


def hash_uniform(seed: int, stream: str, key: Column) -> Column:
    """Uniform double in [0, 1) for (seed, stream, key)."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), key.cast("string"))
    digits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10)
    return digits.cast("bigint").cast("double") / F.lit(_SCALE)


def hash_normal(seed: int, stream: str, key: Column) -> Column:
    """Standard normal double by Box-Muller from two uniform streams."""
    u = hash_uniform(seed, stream + ".r", key)
    v = hash_uniform(seed, stream + ".a", key)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2.0 * math.pi) * v)


def hash_index(seed: int, stream: str, key: Column, n: int) -> Column:
    """Uniform integer in [0, n)."""
    return F.floor(hash_uniform(seed, stream, key) * F.lit(float(n))).cast("bigint")


def hash_order(seed: int, stream: str, key: Column) -> Column:
    """A column to order by for a reproducible shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), key.cast("string")))


def uniform_value(seed: int, stream: str, key: int) -> float:
    """``hash_uniform`` of one key, on the driver."""
    return int(hashlib.md5(f"{seed}|{stream}|{key}".encode()).hexdigest()[:13], 16) / _SCALE


def normal_value(seed: int, stream: str, key: int) -> float:
    """``hash_normal`` of one key, on the driver."""
    u, v = uniform_value(seed, stream + ".r", key), uniform_value(seed, stream + ".a", key)
    return math.sqrt(-2.0 * math.log(1.0 - u)) * math.cos(2.0 * math.pi * v)
