"""Checksums and hashes that Spark has no function for, as pandas UDFs, and the ones it has."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType

# fixed value: the reflected Castagnoli polynomial
_POLY = 0x82F63B78


def _tables(width: int) -> np.ndarray:
    """What a byte does to the register when 0, 1, ... bytes come after it."""
    out = np.zeros((width, 256), np.uint32)
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(_POLY), np.uint32(0))
    out[0] = c
    for i in range(1, width):
        out[i] = (out[i - 1] >> np.uint32(8)) ^ out[0][out[i - 1] & np.uint32(0xFF)]
    return out


#: Bytes taken at once.
_WIDE = 512
_CASTAGNOLI = _tables(_WIDE)
_FIRST = _CASTAGNOLI[0].tolist()


def crc32c_of(data: bytes) -> int:
    """CRC-32C (Castagnoli), as index, journal and intent records carry it: whole stretches by table over all their bytes, the rest byte by byte."""
    c, at = 0xFFFFFFFF, 0
    if len(data) >= _WIDE:
        whole = len(data) // _WIDE
        rows = np.frombuffer(data, np.uint8, whole * _WIDE).reshape(whole, _WIDE)
        # the register only meets a stretch's first four bytes; what the others do is known beforehand
        rest = np.bitwise_xor.reduce(_CASTAGNOLI[np.arange(_WIDE - 5, -1, -1), rows[:, 4:]], axis=1).tolist()
        heads = rows[:, :4].copy().view("<u4").ravel().tolist()
        t0, t1, t2, t3 = (_CASTAGNOLI[_WIDE - 1 - i].tolist() for i in range(4))
        for head, after in zip(heads, rest):
            x = c ^ head
            c = t0[x & 0xFF] ^ t1[x >> 8 & 0xFF] ^ t2[x >> 16 & 0xFF] ^ t3[x >> 24] ^ after
        at = whole * _WIDE
    for b in data[at:]:
        c = _FIRST[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def name_hash_of(name: str | bytes) -> int:
    """XXH3-64 of an entry name, unsigned."""
    return xxhash.xxh3_64_intdigest(name)


def cd_hash_of(block: bytes) -> bytes:
    """XXH3-128 of a central directory, 16 bytes little-endian."""
    return xxhash.xxh3_128_intdigest(block).to_bytes(16, "little")


def new_generation_id() -> bytes:
    return uuid.uuid4().bytes


def crc32(data) -> Column:
    """CRC-32 of ZIP entries."""
    return F.crc32(data)


@F.pandas_udf(LongType())
def crc32c(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else crc32c_of(b)).astype("Int64")


@F.pandas_udf(StringType())
def name_hash(name: pd.Series) -> pd.Series:
    """XXH3-64 as 16 hex digits, whose order is the unsigned order of the hash."""
    return name.map(lambda s: None if s is None else f"{name_hash_of(s):016x}")


@F.pandas_udf(BinaryType())
def cd_hash(block: pd.Series) -> pd.Series:
    return block.map(lambda b: None if b is None else cd_hash_of(b))
