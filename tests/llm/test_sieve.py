from pyspark.sql import functions as F

from tidemark.llm import sieve


def test_rows_with_a_key_are_held_and_nearly_no_others(spark):
    rows = spark.range(200_000).withColumnRenamed("id", "_place")
    own = sieve.sieve(rows.where("_place % 100 = 0").select(F.xxhash64("_place")))
    assert own.buckets == 4 and own.bitmaps.count() == 4
    found, rest = (sieve.held(rows, F.xxhash64("_place"), own, wanted=w) for w in (True, False))
    assert found.where("_place % 100 = 0").count() == 2000 and found.count() < 7_000 and found.count() + rest.count() == 200_000 and found.columns == ["_place"]


def test_empty_and_full_sieves(spark, monkeypatch):
    rows = spark.range(1000)
    none = sieve.sieve(rows.limit(0).select(F.xxhash64("id")))
    assert sieve.held(rows, F.xxhash64("id"), none).count() == 0 and sieve.held(rows, F.xxhash64("id"), none, wanted=False).count() == 1000
    monkeypatch.setattr(sieve, "BUCKETS", 1)
    monkeypatch.setattr(sieve, "BITS", 8)  # every bit is set: all rows go on
    full = sieve.sieve(rows.select(F.xxhash64("id")))
    assert sieve.held(rows, F.xxhash64("id"), full).count() == 1000


def test_fresh_names():
    assert sieve.fresh("_a", ["_A", "__a"]) == "___a" and sieve.fresh("_a", ["b"]) == "_a"
