"""Log positions: ten bytes, big-endian, so byte order is numeric order, in Python and as Spark binary alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 10
ZERO = bytes(WIDTH)


def to_lsn(number: int) -> bytes:
    return number.to_bytes(WIDTH, "big")


def successor(lsn: bytes) -> bytes:
    """The next position; refuses other widths and the last position there is."""
    if len(lsn) != WIDTH:
        raise ValueError(f"a log position has {WIDTH} bytes, not {len(lsn)}")
    if lsn == b"\xff" * WIDTH:
        raise ValueError("the last log position has no successor")
    return to_lsn(int.from_bytes(lsn, "big") + 1)


def mask_width(columns: int) -> int:
    """Bytes of an update mask over so many captured columns."""
    return -(-columns // 8)


def lsn_column(number: Column) -> Column:
    """A non-negative long as a log position."""
    return F.unhex(F.lpad(F.hex(number), 2 * WIDTH, "0"))


def hex_column(lsn: Column) -> Column:
    return F.hex(lsn)


def binary(value: bytes) -> Column:
    return F.lit(bytearray(value))
