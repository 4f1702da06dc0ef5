import os

from tidemark.functions.pinned import pinned, release, shared_dir


def test_pinned_frames_do_not_follow_their_source(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    held = pinned(spark.read.parquet(path))
    spark.range(9).write.mode("overwrite").parquet(path)
    assert held.count() == 3 and held.columns == ["id"]


def test_folder_is_the_session_setting(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    pinned(spark.range(1))
    folder = f"{shared_dir(spark)}/tidemark".removeprefix("file:")
    assert os.listdir(folder)
    release(spark)
    assert not os.path.exists(folder)
