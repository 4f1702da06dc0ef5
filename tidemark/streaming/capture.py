"""A run as a Structured Streaming query.

Every micro-batch of a trigger stream is one batch of the run.  The state
after batch n is written under its number before batch n + 1 can start, and
batch n always starts from the state after n - 1; if that is missing, the
stream stops, as going on without it would lose changes.  Where batch n's log
window ends is written before the window is read, so a batch that Spark
repeats after a failure reads the same window again, however far the log has
grown; and the sink is told the batch's number, so writing is idempotent.
Files are written under another name and then renamed, so none is ever half
there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators.run import CHUNK_SIZE, INSPECT_EVERY, capture_batch
from tidemark.plans.state import RunState
from tidemark.sources.base import ChangeSource


class StateLog:
    """States and window ends by batch number, as text files in a folder that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str | None:
        path, files = self._path(name)
        return "".join(r[0] for r in self.spark.read.text(f"{self.folder}/{name}").collect()) if files.exists(path) else None

    def _put(self, name: str, text: str) -> None:
        path, files = self._path(name)
        new, _ = self._path(f".{name}.{uuid.uuid4().hex}")
        out = files.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not files.rename(new, path):  # some stores do not rename over a file
            files.delete(path, False)
            if not files.rename(new, path):
                raise OSError(f"could not write {path}")

    def read(self, batch: int) -> RunState | None:
        text = self._text(f"state-{batch}")
        return RunState.from_json(text) if text else None

    def write(self, batch: int, state: RunState) -> None:
        self._put(f"state-{batch}", state.to_json())

    def bound(self, batch: int, high: bytes) -> bytes:
        """Where a batch's window ends: as it was first said, and high the first time."""
        text = self._text(f"bound-{batch}")
        if text is None:
            self._put(f"bound-{batch}", high.hex())
        return bytes.fromhex(text) if text else high


def parquet_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """Each batch in a subfolder of its own, overwritten when it is repeated."""
    return lambda frame, batch: frame.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch}")


def capture_stream(
    trigger: DataFrame, source: ChangeSource, schema: str, table: str, sink: Callable[[DataFrame, int], None], states: StateLog,
    start: RunState | None = None, chunk_size: int = CHUNK_SIZE, inspect_every: timedelta | None = INSPECT_EVERY,
) -> DataStreamWriter:
    """A stream writer to start: one batch of the run for each micro-batch of trigger, whose rows do not matter."""

    def step(_: DataFrame, number: int) -> None:
        before = start if number == 0 else states.read(number - 1)
        if number and before is None:
            raise RuntimeError(f"the state after batch {number - 1} is missing from {states.folder}; going on without it would lose changes")
        result = capture_batch(source, schema, table, before, chunk_size, inspect_every, lambda high: states.bound(number, high))
        if result.frame is not None:
            sink(result.frame, number)
        states.write(number, result.state)
        result.release()

    return trigger.writeStream.foreachBatch(step)
