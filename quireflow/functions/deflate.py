"""STORE and DEFLATE entry codecs: whole, ranged, and with checkpoints at which decoding resumes.

The standard library can neither stop a decoder at a block's end nor hand it
single bits. Both are had another way. A block's start is found by what its
header must look like, and taken only if a decoder that starts there gives the
very bytes that the whole stream gives. A decoder starts within a byte behind
empty blocks whose bits fill that byte up to the place.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quireflow.functions.codecs import Checkpoint, window_of

INTERVAL = 1 << 20


class CorruptData(ValueError):
    """Compressed data that ends early or doesn't decode to its stated size."""


class OutOfRange(ValueError):
    """A read past the end of an entry."""


class UnsupportedMethod(ValueError):
    """An entry whose codec is not built in."""


def deflate_of(data: bytes, interval: int | None = None) -> tuple[bytes, list[Checkpoint]]:
    """Raw DEFLATE at level 6 and its checkpoints.

    With an interval, a full flush ends each stretch of so many bytes, so that
    a fresh decoder can start there without a window.
    """
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    if not interval:
        return c.compress(data) + c.flush(), []
    out, points = bytearray(), []
    for at in range(0, len(data), interval):
        if at:
            out += c.flush(zlib.Z_FULL_FLUSH)
            points.append(Checkpoint(at, len(out), window=window_of(data[max(0, at - 32768) : at])))
        out += c.compress(data[at : at + interval])
    return bytes(out + c.flush()), points


def _packed(bits: str) -> bytes:
    return bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


# empty blocks, their bits in the order they are read: 10 of fixed codes, 93 of codes of its own (for odd places)
_FIXED = "010" + "0000000"
_OWN = "001" + "00000" + "00000" + "0111" + "000000" + "010" + "100" + "000" * 13 + "010" + "11" + "1111111" + "11" + "1101011" + "10" + "0" + "0"
_LEAD = {(10 * n + 93 * odd) % 8: _FIXED * n + _OWN * odd for odd in (0, 1) for n in range(4)}
#: Bytes fed to a decoder, or taken from it, at a time.
STEP = 1 << 16


def _resumed(data, point: Checkpoint) -> tuple[zlib._Decompress, int]:
    """A decoder that goes on at ``point``, and the offset of the first byte it still has to be fed."""
    d = zlib.decompressobj(-15, zdict=bytes(point.window)) if point.window else zlib.decompressobj(-15)
    if point.bits:
        lead = _packed(_LEAD[8 - point.bits])
        mask = 0xFF << (8 - point.bits) & 0xFF
        d.decompress(lead[:-1] + bytes([lead[-1] | data[point.compressed_offset - 1] & mask]))
    return d, point.compressed_offset


def _pump(d: zlib._Decompress, data, at: int) -> Iterator[bytes]:
    """What a decoder makes of ``data`` from ``at`` on, in pieces of at most STEP bytes."""
    view, tail = memoryview(data), b""
    while not d.eof:
        if not tail:
            tail, at = view[at : at + STEP], at + STEP
        last = not len(tail)
        out = d.decompress(tail, STEP)
        tail = d.unconsumed_tail
        if out:
            yield out
        elif last:
            return


def nearest_point(points: list[Checkpoint], target: int) -> Checkpoint | None:
    """The last checkpoint at or before ``target``, None if there is none; of equal offsets the later."""
    best = None
    for p in points:
        if p.uncompressed_offset <= target and (best is None or p.uncompressed_offset >= best.uncompressed_offset):
            best = p
    return best


def inflate_range(data, offset: int, length: int, size: int, points: list[Checkpoint] = ()) -> bytes:
    """Bytes [offset, offset + length) of the stream, decoded from the nearest checkpoint; no more than they and one piece are held."""
    if offset < 0 or length < 0 or offset + length > size:
        raise OutOfRange(f"{offset} + {length} > {size}")
    if not length:
        return b""
    point = nearest_point(points, offset) or Checkpoint(0)
    at, out = point.uncompressed_offset, []
    try:
        d, start = _resumed(data, point)
        for piece in _pump(d, data, start):
            lo, hi = max(offset - at, 0), offset + length - at
            if lo < len(piece):
                out.append(piece[lo:hi])
            at += len(piece)
            if at >= offset + length:
                return b"".join(out)
    except zlib.error as e:
        raise CorruptData(str(e)) from e
    raise CorruptData("the stream ends early")


def _headers(data, lo: int, hi: int) -> np.ndarray:
    """Bit positions in bytes [lo, hi) at which a block with codes of its own, or a stored one, may start."""
    raw = np.frombuffer(bytes(data[lo : hi + 16]).ljust(hi - lo + 16, b"\0"), np.uint8)
    bits = np.unpackbits(raw, bitorder="little").astype(np.int32)
    n = 8 * (hi - lo)

    def field(at, width: int):
        return sum(bits[at + j] << j for j in range(width))

    at = np.flatnonzero((bits[1 : n + 1] == 0) & (bits[2 : n + 2] == 1))
    at = at[(field(at + 3, 5) <= 29) & (field(at + 8, 5) <= 29)]
    used, kraft = field(at + 13, 4) + 4, np.zeros(len(at), np.int32)
    for j in range(19):  # the code of the code lengths must be complete
        size = field(at + 17 + 3 * j, 3)
        kraft += np.where((j < used) & (size > 0), 128 >> size, 0)
    own = at[kraft == 128]
    word = raw[:-1].astype(np.int32) | raw[1:].astype(np.int32) << 8
    whole = np.flatnonzero(word[:-2] ^ word[2:] == 0xFFFF)  # a stored block's length and its complement
    stored = (8 * whole[:, None] - np.arange(3, 11)[None, :]).ravel()
    stored = stored[(stored >= 0) & (stored < n)]
    stored = stored[(bits[stored + 1] == 0) & (bits[stored + 2] == 0)]
    return 8 * lo + np.unique(np.concatenate((own, stored)))


#: Compressed bytes searched at a time, and those over which a found start must give the stream's bytes.
_SEARCH, _TRIAL = 1 << 14, 1 << 18


def build_checkpoints(data, size: int, interval: int = INTERVAL) -> list[Checkpoint]:
    """Checkpoints of any DEFLATE stream: at the first block past its start, and at the first one ``interval`` bytes of output after the last.

    Blocks of fixed codes, which are small and rare, are passed over: nothing
    in them tells where they start. Raises CorruptData for a stream that does
    not decode or gives more than ``size`` bytes.
    """
    out: list[Checkpoint] = []
    d, made, window, at = zlib.decompressobj(-15), 0, b"", 0
    try:
        while size and at < len(data) and not d.eof:
            before, upto = d.copy(), min(len(data), at + _SEARCH)
            got = d.decompress(data[at:upto])
            if made + len(got) > size:
                raise CorruptData("the stream gives more than its size")
            due = max(1, interval) + out[-1].uncompressed_offset if out else 1
            if made + len(got) >= due:
                point = _block_start(before, data, at, upto, made, window, due)
                out += [point] if point else []
            made, window, at = made + len(got), (window + got)[-32768:], upto
    except zlib.error as e:
        raise CorruptData(str(e)) from e
    return out


def _block_start(d: zlib._Decompress, data, lo: int, hi: int, made: int, window: bytes, due: int) -> Checkpoint | None:
    """The first block start in compressed bytes [lo, hi) whose output offset is ``due`` or more; ``d`` stands at ``lo``."""
    fed = lo
    for bit in _headers(data, lo, hi).tolist():
        upto = bit // 8 + 1
        if upto > fed:  # all that comes before the block is out once the byte it starts in is in
            got = d.decompress(data[fed:upto])
            made, window, fed = made + len(got), (window + got)[-32768:], upto
        if d.eof:
            return None
        if made < due:
            continue
        point = Checkpoint(made, -(-bit // 8), -bit % 8, window_of(window))
        end = min(len(data), upto + _TRIAL)
        try:
            trial, at = _resumed(data, point)
            true = d.copy()
            if trial.decompress(data[at:end]) == true.decompress(data[fed:end]) and trial.eof == true.eof:
                return point
        except zlib.error:
            continue
    return None


def store_range(data, offset: int, length: int, size: int, points: list[Checkpoint] = ()) -> bytes:
    if offset < 0 or length < 0 or offset + length > size:
        raise OutOfRange(f"{offset} + {length} > {size}")
    if points:
        raise ValueError("stored entries have no checkpoints")
    if offset + length > len(data):
        raise CorruptData("the stored data is short")
    return bytes(data[offset : offset + length])


class Codec(NamedTuple):
    """How a ZIP method is read: (data, offset, length, size, points) -> bytes, and (data, size, interval) -> checkpoints."""

    read: Callable[..., bytes]
    checkpoints: Callable[..., list[Checkpoint]] = lambda data, size, interval=INTERVAL: []


#: Codecs by ZIP method. Add an entry to serve another method.
CODECS = {0: Codec(store_range), 8: Codec(inflate_range, build_checkpoints)}


def register_codec(method: int, read: Callable[..., bytes], checkpoints: Callable[..., list[Checkpoint]] | None = None) -> None:
    """Serves another ZIP method; decoder() and range_decoder() carry what is registered to the executors."""
    CODECS[method] = Codec(read, checkpoints) if checkpoints else Codec(read)


def read_range(method: int, data, offset: int, length: int, size: int, points: list[Checkpoint] = (), codecs: dict[int, Codec] | None = None) -> bytes:
    codecs = CODECS if codecs is None else codecs
    if method not in codecs:
        raise UnsupportedMethod(f"method {method}")
    return codecs[method].read(data, offset, length, size, points)


@F.pandas_udf(BinaryType())
def deflate(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else deflate_of(b)[0])


def decoder():
    """A function of columns (method, data, size): an entry's whole content; null where the codec is unknown or the data is corrupt."""
    codecs = dict(CODECS)

    @F.pandas_udf(BinaryType())
    def decode(method: pd.Series, data: pd.Series, size: pd.Series) -> pd.Series:
        def one(m, b, n):
            try:
                return None if b is None else read_range(int(m), b, 0, int(n), int(n), (), codecs)
            except ValueError:
                return None

        return pd.Series([one(m, b, n) for m, b, n in zip(method, data, size)], dtype=object)

    return decode


def range_decoder():
    """A function of columns (method, data, size, offset, length): a byte range of an entry; null where it can't be read."""
    codecs = dict(CODECS)

    @F.pandas_udf(BinaryType())
    def decode_range(method: pd.Series, data: pd.Series, size: pd.Series, offset: pd.Series, length: pd.Series) -> pd.Series:
        def one(m, b, n, o, k):
            try:
                return None if b is None else read_range(int(m), b, int(o), int(k), int(n), (), codecs)
            except ValueError:
                return None

        return pd.Series([one(*row) for row in zip(method, data, size, offset, length)], dtype=object)

    return decode_range


_CHECKPOINTS = "array<struct<uncompressed_offset:bigint,compressed_offset:bigint,bits:smallint,window:binary>>"


def checkpointer(interval: int = INTERVAL):
    """A function of columns (method, data, size): the entry's checkpoints; null where the codec is unknown or the data is corrupt."""
    codecs = dict(CODECS)

    @F.pandas_udf(_CHECKPOINTS)
    def checkpoints(method: pd.Series, data: pd.Series, size: pd.Series) -> pd.Series:
        def one(m, b, n):
            try:
                found = codecs[int(m)].checkpoints(b, int(n), interval)
            except (KeyError, TypeError, ValueError):
                return None
            return [{"uncompressed_offset": p.uncompressed_offset, "compressed_offset": p.compressed_offset, "bits": p.bits, "window": p.window} for p in found]

        return pd.Series([one(m, b, n) for m, b, n in zip(method, data, size)], dtype=object)

    return checkpoints


def resumer():
    """A function of columns (data, size, offset, length, uncompressed_offset, compressed_offset, bits, window): a range of a DEFLATE entry, decoded from the checkpoint given (from the start if its offset is null)."""

    @F.pandas_udf(BinaryType())
    def resume(data: pd.Series, size: pd.Series, offset: pd.Series, length: pd.Series, uncompressed: pd.Series, compressed: pd.Series, bits: pd.Series, window: pd.Series) -> pd.Series:
        def one(b, n, o, k, u, c, t, w):
            try:
                points = [] if u is None or u != u else [Checkpoint(int(u), int(c), int(t), w)]
                return None if b is None else inflate_range(b, int(o), int(k), int(n), points)
            except ValueError:
                return None

        return pd.Series([one(*row) for row in zip(data, size, offset, length, uncompressed, compressed, bits, window)], dtype=object)

    return resume
