"""Posting-list codecs: fixed width, variable byte, Elias gamma.

Whole lists are encoded and decoded in numpy on Arrow batches: string expressions would take quadratic
time for bits, and Catalyst can't be relied on to extract a Python function whose argument has nested
lambdas. :func:`vbe_encode` is the variable-byte code as built-in expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, LongType

CODECS = ("standard", "vbe", "elias-gamma")


def gaps(ids: Column) -> Column:
    """The first id, then differences between neighbours of an ascending list, in one pass."""
    shifted = F.slice(F.concat(F.array(F.lit(0).cast("bigint")), ids), F.lit(1), F.size(ids))
    return F.zip_with(ids, shifted, lambda x, before: x - before)


def bit_length(n: Column) -> Column:
    return F.length(F.bin(n))


def vbe_bytes(n: Column) -> Column:
    """Bytes a number takes: seven bits each, at least one."""
    return F.ceil(bit_length(n) / F.lit(7)).cast("long")


def vbe_number(n: Column) -> Column:
    """Hex of one number, most significant group first, the last byte with its high bit set."""
    return F.array_join(
        F.transform(
            F.sequence(vbe_bytes(n) - 1, F.lit(0).cast("long"), F.lit(-1).cast("long")),
            lambda i: F.lpad(
                F.hex(
                    F.call_function("shiftright", n, (i * 7).cast("int")).bitwiseAND(F.lit(127).cast("long"))
                    + F.when(i == 0, F.lit(128)).otherwise(F.lit(0))
                ),
                2,
                "0",
            ),
        ),
        "",
    )


def vbe_encode(numbers: Column) -> Column:
    """Binary of a list of non-negative numbers; an empty list gives no bytes."""
    return F.unhex(F.array_join(F.transform(numbers, vbe_number), ""))


def _widths(numbers: np.ndarray) -> np.ndarray:
    """Bits of each number, at least 1."""
    width = np.frexp(np.maximum(numbers, 1).astype(np.float64))[1].astype(np.int64)
    return width - ((np.maximum(numbers, 1) >> np.minimum(width - 1, 62)) == 0)


def _vbe(numbers: np.ndarray) -> bytes:
    n = (_widths(numbers) + 6) // 7
    end = np.repeat(np.cumsum(n) - 1, n)
    left = end - np.arange(n.sum())
    return (((np.repeat(numbers, n) >> (7 * left)) & 127) | np.where(left == 0, 128, 0)).astype(np.uint8).tobytes()


def _gaps(ids: np.ndarray) -> np.ndarray:
    return np.diff(ids, prepend=0)


def _vbe_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    ends = np.flatnonzero(raw >= 128)
    if not len(ends):
        return np.empty(0, np.int64)
    raw = raw[: ends[-1] + 1]
    starts = np.concatenate([[0], ends[:-1] + 1])
    end = np.repeat(ends, ends - starts + 1)
    return np.add.reduceat((raw & 127) << (7 * (end - np.arange(len(raw)))), starts)


def _gamma(numbers: np.ndarray) -> bytes:
    if len(numbers) and numbers.min() < 1:
        raise ValueError("Elias gamma needs numbers of at least 1")
    n = len(numbers)
    head = np.frombuffer(np.array([n], ">u4").tobytes(), np.uint8)
    if not n:
        return head.tobytes()
    width = _widths(numbers)
    size = 2 * width - 1
    start = np.cumsum(size) - size
    at = np.repeat(start + width - 1, width) + (np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width))
    shift = np.repeat(start + size - 1, width) - at
    bits = np.zeros(size.sum(), np.uint8)
    bits[at] = (np.repeat(numbers, width) >> shift) & 1
    return head.tobytes() + np.packbits(bits).tobytes()


def _gamma_numbers(data: bytes) -> np.ndarray:
    """Decode; a truncated stream ends quietly with the numbers that are whole."""
    if len(data) < 4:
        return np.empty(0, np.int64)
    n = int(np.frombuffer(data[:4], ">u4")[0])
    bits = np.unpackbits(np.frombuffer(data[4:], np.uint8)).astype(np.int64)
    size = len(bits)
    # the next one at or after every position, and where the code that begins there would end; ``size + 1`` for none
    one = np.minimum.accumulate(np.where(bits == 1, np.arange(size), size)[::-1])[::-1]
    end = 2 * one - np.arange(size) + 1
    jump = np.append(np.where((one < size) & (end <= size), end, size + 1), [size + 1, size + 1])
    # beginnings of all codes: each doubling knows twice as many
    starts = np.zeros(min(n, size) + 1, np.int64)
    known = 1
    while known < len(starts):
        more = min(known, len(starts) - known)
        starts[known : known + more] = jump[starts[:more]]
        jump, known = jump[jump], known + more
    starts = starts[starts <= size]
    starts, ends = starts[:-1], starts[1:]
    if not len(starts):
        return np.empty(0, np.int64)
    width = (ends - starts + 1) // 2
    at = np.repeat(ends - width, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    return np.add.reduceat(bits[at] << (np.repeat(ends, width) - 1 - at), np.cumsum(width) - width)


def _each(convert):
    return lambda column: column.map(lambda x: None if x is None else convert(x))


def _numbers(x) -> np.ndarray:
    return np.asarray(x, np.int64)


@pandas_udf(BinaryType())
def standard_encode(numbers: pd.Series) -> pd.Series:
    """Eight bytes a number, little endian."""
    return _each(lambda x: np.asarray(x, "<i8").tobytes())(numbers)


@pandas_udf(ArrayType(LongType()))
def standard_decode(data: pd.Series) -> pd.Series:
    return _each(lambda x: np.frombuffer(x, "<i8").astype(np.int64))(data)


@pandas_udf(BinaryType())
def vbe_pack(numbers: pd.Series) -> pd.Series:
    return _each(lambda x: _vbe(_numbers(x)))(numbers)


@pandas_udf(BinaryType())
def vbe_pack_ids(ids: pd.Series) -> pd.Series:
    """The first id, then gaps."""
    return _each(lambda x: _vbe(_gaps(_numbers(x))))(ids)


@pandas_udf(ArrayType(LongType()))
def vbe_decode(data: pd.Series) -> pd.Series:
    return _each(_vbe_numbers)(data)


@pandas_udf(ArrayType(LongType()))
def vbe_decode_ids(data: pd.Series) -> pd.Series:
    return _each(lambda x: np.cumsum(_vbe_numbers(x)))(data)


@pandas_udf(BinaryType())
def gamma_encode(numbers: pd.Series) -> pd.Series:
    """Count in four bytes, then the codes of numbers of at least 1, padded with zero bits."""
    return _each(lambda x: _gamma(_numbers(x)))(numbers)


@pandas_udf(BinaryType())
def gamma_encode_ids(ids: pd.Series) -> pd.Series:
    """Gaps plus 1, so that id 0 has a code."""
    return _each(lambda x: _gamma(_gaps(_numbers(x)) + 1))(ids)


@pandas_udf(ArrayType(LongType()))
def gamma_decode(data: pd.Series) -> pd.Series:
    return _each(_gamma_numbers)(data)


@pandas_udf(ArrayType(LongType()))
def gamma_decode_ids(data: pd.Series) -> pd.Series:
    return _each(lambda x: np.cumsum(_gamma_numbers(x) - 1))(data)


_CODES = {
    "standard": (standard_encode, standard_decode, standard_encode, standard_decode),
    "vbe": (vbe_pack_ids, vbe_decode_ids, vbe_pack, vbe_decode),
    "elias-gamma": (gamma_encode_ids, gamma_decode_ids, gamma_encode, gamma_decode),
}


def _code(codec: str, which: int):
    if codec not in _CODES:
        raise ValueError(f"codec is one of {CODECS}, not {codec!r}")
    return _CODES[codec][which]


def encode_ids(codec: str, ids: Column) -> Column:
    """Bytes of an ascending list of ids."""
    return _code(codec, 0)(ids)


def decode_ids(codec: str, data: Column) -> Column:
    return _code(codec, 1)(data)


def encode_counts(codec: str, tf: Column) -> Column:
    """Bytes of a list of frequencies."""
    return _code(codec, 2)(tf)


def decode_counts(codec: str, data: Column) -> Column:
    return _code(codec, 3)(data)
