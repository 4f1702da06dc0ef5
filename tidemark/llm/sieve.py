"""A sieve of bounded size: bits of the hashes of some keys, by which most rows without such a key are told apart without a shuffle.

A sieve has about ``SPARE`` bits a key, in bitmaps of 4 KB, and never more than
``BUCKETS`` of these (16 MB), however many keys there are, so it may be
broadcast.  A row whose bit is not set has no key; one whose bit is set
probably has, and goes on to an exact join.  When very many keys have set all
bits, every row goes on: nothing is lost but the saving.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import staged

BUCKETS, BITS, SPARE = 4096, 8 * 4096, 64


@dataclass(frozen=True)
class Sieve:
    """bitmaps: (bucket, bits), of so many buckets."""

    bitmaps: DataFrame
    buckets: int


def fresh(name: str, columns: list[str]) -> str:
    """name, or a longer one, that none of the columns has (upper and lower case are the same to Spark)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _number(key_hash: Column, buckets: int) -> Column:
    return F.pmod(key_hash, F.lit(buckets * BITS)) + 1


def sieve(key_hashes: DataFrame) -> Sieve:
    """The sieve of a column of hashes."""
    keys = staged(key_hashes.toDF("hash"))
    buckets = min(BUCKETS, max(1, -(-keys.count() * SPARE // BITS)))
    number = _number(F.col("hash"), buckets)
    some = keys.select(F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("place"))
    return Sieve(staged(some.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))), buckets)


def held(rows: DataFrame, key_hash: Column, own: Sieve, wanted: bool = True) -> DataFrame:
    """The rows whose key may be in the sieve, or (wanted=False) those whose key is not."""
    bucket, bits, place = (fresh(n, rows.columns) for n in ("_bucket", "_bits", "_place"))
    number = _number(key_hash, own.buckets)
    asked = rows.withColumns({place: F.bitmap_bit_position(number), bucket: F.bitmap_bucket_number(number)})
    side = F.broadcast(own.bitmaps.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits)))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    one = F.coalesce(F.getbit(byte, (F.col(place) % 8).cast("int")) == 1, F.lit(False))
    return asked.join(side, bucket, "left").where(one if wanted else ~one).select(*[F.col(f"`{c}`") for c in rows.columns])
