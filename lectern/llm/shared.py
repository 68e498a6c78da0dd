"""What the operators share: tables between jobs, word splitting, word hashes."""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.stored import drop, shared_folder, table  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def with_fields(rows: DataFrame, column: str, extra: str) -> T.StructType:
    """The schema of ``column`` of ``rows`` followed by the fields ``extra`` (as DDL)."""
    return T.StructType([rows.schema[column], *T.StructType.fromDDL(extra).fields])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


class WordHashes:
    """64-bit hashes of words; ``seed`` gives an independent function."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens, repeat(self.seed)), np.uint64, len(tokens))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` values of ``h`` (empty if there are fewer)."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x5851F42D4C957F2D) + h[i : i + m]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def matrix(a, dim: int) -> np.ndarray:
    """An Arrow array of lists of ``dim`` numbers as rows of doubles."""
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
