"""Integer codes of the byte formats, as column expressions and as plain mappings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: ZIP methods, provider and operation codes of the formats
METHOD_PROVIDER = {0: "Store", 8: "Deflate", 93: "Zstd"}
PROVIDER_CODE = {"Store": 0, "Deflate": 1, "DeflateVmm": 2, "Zstd": 3, "Unsupported": 255}
OP_CODE = {"CREATE": 1, "REMOVE": 2, "RESIZE": 3, "RENAME": 4}
RECORD_SIZE = {"Deflate": 8 + 8 + 1 + 32768, "DeflateVmm": 24, "Zstd": 16}
CHUNK_HEADER, CHUNK_CRC, BLOCK_STATE = 32, 4, 24
MAX_32 = 0xFFFFFFFF


def _case(column, mapping: dict, default) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    out = None
    for k, v in mapping.items():
        out = F.when(column == k, F.lit(v)) if out is None else out.when(column == k, F.lit(v))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def provider_of_method(method) -> Column:
    """STORE and DEFLATE are served; Zstd is recognised; any other method is unsupported."""
    return _case(method, METHOD_PROVIDER, "Unsupported")


def provider_code(provider) -> Column:
    return _case(provider, PROVIDER_CODE, 255)


def provider_of_code(code) -> Column:
    return _case(code, {v: k for k, v in PROVIDER_CODE.items()}, "Unsupported")


def op_code(op) -> Column:
    return _case(op, OP_CODE, F.lit(None).cast("int"))


def op_of_code(code) -> Column:
    return _case(code, {v: k for k, v in OP_CODE.items()}, F.lit(None).cast("string"))


def record_size(provider) -> Column:
    """Bytes of one checkpoint record; null where a provider keeps none."""
    return _case(provider, RECORD_SIZE, F.lit(None).cast("int"))


def chunk_length(provider, n) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.lit(CHUNK_HEADER + CHUNK_CRC) + n * record_size(provider)


def advisory_size(entries, block_states) -> Column:
    entries, block_states = (F.col(x) if isinstance(x, str) else x for x in (entries, block_states))
    return entries * 8 + 8 + block_states * BLOCK_STATE


def fits_32(x) -> Column:
    """Whether an offset or size can be written without Zip64."""
    return (F.col(x) if isinstance(x, str) else x).between(0, MAX_32)
