"""Change capture with Spark: a table's dump and its change log as one stream of frames."""

from tidemark.functions.log import configure_logging
from tidemark.operators.run import CdcRetentionExpiredError, SchemaChangedError, batches, capture_batch, state_at_lsn
from tidemark.plans.spec import ColumnSpec, TableSpec
from tidemark.plans.state import BatchResult, RunState
from tidemark.sources.base import ChangeSource, build_source, register_source
from tidemark.sources.frames import CapturedTable, FrameSource
from tidemark.sources.jdbc import JdbcSource

__all__ = [
    "BatchResult", "CapturedTable", "CdcRetentionExpiredError", "ChangeSource", "ColumnSpec", "FrameSource", "JdbcSource", "RunState", "SchemaChangedError", "TableSpec",
    "batches", "build_source", "capture_batch", "configure_logging", "register_source", "state_at_lsn",
]
