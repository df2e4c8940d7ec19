"""Bloom filters: sizes by target rate, murmur3 bits, membership as an expression."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

RATE = 0.001


def murmur3(keys: list[bytes], seeds: int) -> np.ndarray:
    """The 32-bit x86 variant, by key and seed, for all keys of a length at a time; as signed numbers, which matters for
    a remainder unless the divisor is a power of two."""
    out = np.empty((len(keys), seeds), np.int64)
    by: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        by.setdefault(len(k), []).append(i)
    turned = lambda x, n: x << np.uint32(n) | x >> np.uint32(32 - n)
    # Fixed values of the hash.
    first, second, add, last, final = (np.uint32(v) for v in (0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35))
    mixed = lambda x: turned(x * first, 15) * second
    for n, at in by.items():
        data = np.zeros((len(at), -(-n // 4) * 4), np.uint8)
        data[:, :n] = np.frombuffer(b"".join(keys[i] for i in at), np.uint8).reshape(len(at), n)
        words = data.view("<u4").astype(np.uint32)
        h = np.broadcast_to(np.arange(seeds, dtype=np.uint32), (len(at), seeds)).copy()
        for j in range(n // 4):
            h = turned(h ^ mixed(words[:, j : j + 1]), 13) * np.uint32(5) + add
        if n % 4:
            h ^= mixed(words[:, -1:])
        h ^= np.uint32(n)
        h = (h ^ h >> np.uint32(16)) * last
        h = (h ^ h >> np.uint32(13)) * final
        out[at] = (h ^ h >> np.uint32(16)).view(np.int32)
    return out


def parameters(n: int, rate: float = RATE) -> tuple[int, int]:
    """Bytes and hash functions for n keys; half a function rounds to even."""
    if n < 1:
        raise ValueError("a filter needs keys")
    bits = -n * math.log(rate) / math.log(2) ** 2
    return math.ceil(bits / 8), round(bits / n * math.log(2))


def parameter_columns(n: Column, rate: float = RATE) -> tuple[Column, Column]:
    bits = -n * F.log(F.lit(rate)) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0)))
    return F.ceil(bits / 8).cast("long"), F.bround(bits / n * F.log(F.lit(2.0)), 0).cast("long")


def places(keys: list[str], size: int, hashes: int) -> np.ndarray:
    """Bits of each key."""
    return murmur3([k.encode() for k in keys], hashes) % (8 * size)


def build(keys: list[str], size: int, hashes: int) -> bytes:
    """The filter's bits, little-endian, then the number of hash functions."""
    bits = np.zeros(8 * size, np.uint8)
    bits[places(keys, size, hashes).ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes() + bytes([hashes])


def may_contain_all(data: bytes, keys: list[str]) -> np.ndarray:
    at = places(keys, len(data) - 1, data[-1])
    return (np.frombuffer(data, np.uint8)[at >> 3] >> (at & 7) & 1).all(1)


def may_contain(data: bytes, key: str) -> bool:
    return bool(may_contain_all(data, [key])[0])


@F.pandas_udf(BooleanType())
def might_contain(data: pd.Series, key: pd.Series) -> pd.Series:
    """Whether filters may hold keys: never false for a key that was added.  A filter is asked for all its keys at once."""
    out = pd.Series(False, index=key.index)
    for _, at in key.groupby(data.map(bytes)).groups.items():
        out[at] = may_contain_all(bytes(data[at[0]]), key[at].tolist())
    return out


def filters(df: DataFrame, group: str, key: str = "key", rate: float = RATE) -> DataFrame:
    """(group, keys, bloom) of each group, whose size the caller bounds (a table's)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(set(pdf[key]))
        return pd.DataFrame({group: [pdf[group].iloc[0]], "keys": [len(keys)], "bloom": [build(keys, *parameters(len(keys), rate))]})

    kind = df.schema[group].dataType.simpleString()
    return df.select(group, key).groupBy(group).applyInPandas(one, f"{group} {kind}, keys long, bloom binary")
