"""Binary arrays: base64, zlib, plain numbers, and the three numpress codecs.

Column functions run as Arrow UDFs; everything below them is plain Python and
numpy.  Numpress is dispatched by accession, since names in files can't be
relied on.
"""

from __future__ import annotations

import base64
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DTYPES = {"MS:1000521": "<f4", "MS:1000523": "<f8", "MS:1000519": "<i4", "MS:1000522": "<i8"}
ASCII = "MS:1001479"
ZLIB, PLAIN = "MS:1000574", "MS:1000576"
LINEAR, PIC, SLOF = "MS:1002312", "MS:1002313", "MS:1002314"
#: The same codecs followed by zlib.
DEFLATED = {"MS:1002746": LINEAR, "MS:1002747": PIC, "MS:1002748": SLOF}


# -- half bytes --------------------------------------------------------------------------------------------------------


def encode_int(x: int) -> list[int]:
    """Half bytes of a 32-bit integer: how many leading half bytes are left out, then the others, lowest first.

    Up to 8 leading zeros, or (counted from 8 on) up to 7 leading half bytes of
    15.  All eight are written after a header of 0.
    """
    if not -(1 << 31) <= x < 1 << 31:
        raise ValueError(f"{x} isn't a 32-bit integer")
    u = x & 0xFFFFFFFF
    parts = [u >> 4 * k & 15 for k in range(8)]
    lead = 0
    if parts[7] == 0:
        while lead < 8 and parts[7 - lead] == 0:
            lead += 1
        return [lead, *parts[: 8 - lead]]
    if parts[7] == 15:
        while lead < 7 and parts[7 - lead] == 15:
            lead += 1
        return [8 + lead, *parts[: 8 - lead]]
    return [0, *parts]


def decode_ints(halves: list[int], start: int = 0) -> list[int]:
    """All integers of a stream; a last 0 that only fills the byte is none."""
    out, k, n = [], start, len(halves)
    while k < n:
        head = halves[k]
        k += 1
        lead = head if head <= 8 else head - 8
        count = 8 - lead
        if k + count > n:
            if head == 0 and k == n:
                break  # padding
            raise ValueError("the stream of half bytes breaks off")
        u = 0
        for j in range(count):
            u |= halves[k + j] << 4 * j
        k += count
        if head > 8:
            u |= (0xFFFFFFFF << 4 * count) & 0xFFFFFFFF
        out.append(u - (1 << 32) if u >= 1 << 31 else u)
    return out


def _pack(halves: list[int]) -> bytes:
    if len(halves) % 2:
        halves = [*halves, 0]
    return bytes(a << 4 | b for a, b in zip(halves[::2], halves[1::2]))


def _unpack(data: bytes) -> list[int]:
    return [h for b in data for h in (b >> 4, b & 15)]


# -- numpress ----------------------------------------------------------------------------------------------------------


def linear_fixed_point(values: list[float]) -> float:
    """The largest factor at which every residual still fits into 31 bits."""
    if not values:
        return 0.0
    most = max(values[0], values[1] if len(values) > 1 else 0)
    for a, b, c in zip(values, values[1:], values[2:]):
        most = max(most, math.ceil(abs(c - (2 * b - a)) + 1))
    return float(math.floor(0x7FFFFFFF / most)) if most else float(0x7FFFFFFF)


def encode_linear(values: list[float], fixed_point: float | None = None) -> bytes:
    fp = linear_fixed_point(values) if fixed_point is None else fixed_point
    out = struct.pack(">d", fp)
    ints = [int(v * fp + 0.5) for v in values]
    for x in ints[:2]:
        out += struct.pack("<I", x & 0xFFFFFFFF)
    halves: list[int] = []
    for a, b, c in zip(ints, ints[1:], ints[2:]):
        halves += encode_int(c - (2 * b - a))
    return out + _pack(halves)


def decode_linear(data: bytes) -> np.ndarray:
    if len(data) < 8:
        raise ValueError("linear data lacks its fixed point")
    fp = struct.unpack(">d", data[:8])[0]
    if len(data) == 8:
        return np.zeros(0)
    first = struct.unpack("<i", data[8:12])[0]
    if len(data) == 12:
        return np.array([first / fp])
    second = struct.unpack("<i", data[12:16])[0]
    residuals = np.array(decode_ints(_unpack(data[16:])), dtype=np.int64)
    # x[n] = 2 x[n-1] - x[n-2] + d[n]: two running sums.
    steps = np.concatenate(([second - first], residuals)).cumsum()
    return np.concatenate(([first], first + steps.cumsum())) / fp


def encode_pic(values: list[float] | np.ndarray) -> bytes:
    """``encode_int`` of each rounded value, all at once."""
    x = np.trunc(np.asarray(values, dtype=np.float64) + 0.5)
    if len(bad := x[~((x >= -(1 << 31)) & (x < 1 << 31))]):
        raise ValueError(f"{bad[0]} isn't a 32-bit integer")
    u = x.astype(np.int64).astype(np.uint32)[:, None]
    shifts = np.arange(0, 32, 4, dtype=np.uint32)
    # Leading half bytes are what neither the number nor its complement fills.
    low, high = (8 - np.count_nonzero(v >> shifts, axis=1) for v in (u, ~u))
    high = np.minimum(high, 7)
    halves = np.concatenate((np.where(low, low, np.where(high, 8 + high, 0))[:, None], u >> shifts & np.uint32(15)), axis=1).astype(np.uint8)
    stream = halves[np.arange(9) <= 8 - np.maximum(low, high)[:, None]]
    if len(stream) % 2:
        stream = np.append(stream, np.uint8(0))
    return (stream[::2] << 4 | stream[1::2]).tobytes()


def decode_pic(data: bytes) -> np.ndarray:
    return np.array(decode_ints(_unpack(data)), dtype=np.float64)


def slof_fixed_point(values: list[float]) -> float:
    return float(math.floor(0xFFFF / max(1.0, math.log(max(values) + 1)))) if values else 0.0


def encode_slof(values: list[float], fixed_point: float | None = None) -> bytes:
    fp = slof_fixed_point(values) if fixed_point is None else fixed_point
    return struct.pack(">d", fp) + np.floor(np.log(np.array(values, dtype=np.float64) + 1) * fp + 0.5).astype("<u2").tobytes()


def decode_slof(data: bytes) -> np.ndarray:
    if len(data) < 8:
        raise ValueError("slof data lacks its fixed point")
    fp = struct.unpack(">d", data[:8])[0]
    return np.exp(np.frombuffer(data[8:], "<u2") / fp) - 1


_DECODERS = {LINEAR: decode_linear, PIC: decode_pic, SLOF: decode_slof}
_ENCODERS = {LINEAR: encode_linear, PIC: encode_pic, SLOF: encode_slof}


# -- arrays ------------------------------------------------------------------------------------------------------------


def decode(text: str | None, accessions: list[str]) -> np.ndarray:
    """One array from its base64 text and the accessions beside it; nothing gives an empty array."""
    if not text or not text.strip():
        return np.zeros(0)
    data = base64.b64decode(text)
    found = set(accessions)
    deflated = [DEFLATED[a] for a in found & DEFLATED.keys()]
    if ZLIB in found or deflated:
        data = zlib.decompress(data)
    press = deflated or sorted(found & _DECODERS.keys())
    if press:
        return _DECODERS[press[0]](data)
    if ASCII in found:
        raise ValueError("arrays of text aren't decoded to numbers")
    kind = next((d for a, d in DTYPES.items() if a in found), None)
    if kind is None:
        raise ValueError(f"no known type of array among {sorted(found)}")
    return np.frombuffer(data, dtype=kind).astype(np.float64)


def encode(values: list[float], accessions: list[str]) -> str:
    """The reverse of ``decode``."""
    found = set(accessions)
    deflated = [DEFLATED[a] for a in found & DEFLATED.keys()]
    press = deflated or sorted(found & _ENCODERS.keys())
    if press:
        data = _ENCODERS[press[0]](values if press[0] == PIC else list(values))
    else:
        data = np.array(values, dtype=next(d for a, d in DTYPES.items() if a in found)).tobytes()
    return base64.b64encode(zlib.compress(data) if ZLIB in found or deflated else data).decode()


def decode_all(b64: pa.Array, codes: pa.Array) -> pa.Array:
    """Arrays from texts and their accessions, one by one; no number becomes an object."""
    found = [decode(t.as_py(), a.as_py() or []) for t, a in zip(b64, codes)]
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0)))


def encode_all(values: pa.Array, accessions: list[str]) -> pa.Array:
    """The reverse of ``decode_all``; null stays null."""
    return pa.array((encode(v.values.to_numpy(zero_copy_only=False), accessions) if v.is_valid else None for v in values), pa.string(), size=len(values))


def decoded(text: Column | str, accessions: Column | str) -> Column:
    """array<double> from base64 and an array of accessions."""

    @F.arrow_udf("array<double>")
    def run(b64: pa.Array, codes: pa.Array) -> pa.Array:
        return decode_all(b64, codes)

    return run(text, accessions)


def encoded(values: Column | str, accessions: list[str]) -> Column:
    """Base64 text from array<double>."""

    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        return encode_all(v, accessions)

    return run(values)
