"""A run as a value: the caller keeps it, and passing an older one reads the same batch again."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from tidemark.functions.pinned import release
from tidemark.plans.spec import ColumnSpec, TableSpec


@dataclass(frozen=True)
class RunState:
    """Where a run on a table stands. last_lsn: where the next window opens; chunk_key: where the next page does."""

    spec: TableSpec
    last_lsn: bytes
    last_inspect: datetime
    chunk_key: int | None = None
    dump_done: bool = False

    def __post_init__(self) -> None:
        at = self.last_inspect
        object.__setattr__(self, "last_inspect", at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC))

    def with_(self, **changes: object) -> RunState:
        return replace(self, **changes)

    def to_json(self) -> str:
        spec = {k: getattr(self.spec, k) for k in ("source_schema", "source_table", "pk_columns", "capture_instance")}
        spec |= {k: [c.plain() for c in getattr(self.spec, k)] for k in ("columns", "captured_columns")}
        plain = {"spec": spec, "last_lsn": self.last_lsn.hex(), "last_inspect": self.last_inspect.isoformat(), "chunk_key": self.chunk_key, "dump_done": self.dump_done}
        return json.dumps(plain, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> RunState:
        plain = json.loads(text)
        if unknown := set(plain) - {"spec", "last_lsn", "last_inspect", "chunk_key", "dump_done"}:
            raise ValueError(f"not a run state: {sorted(unknown)}")
        spec = plain["spec"]
        columns = {k: [ColumnSpec(**c) for c in spec[k]] for k in ("columns", "captured_columns")}
        return cls(**plain | {"spec": TableSpec(**spec | columns), "last_lsn": bytes.fromhex(plain["last_lsn"]), "last_inspect": datetime.fromisoformat(plain["last_inspect"])})


@dataclass(frozen=True, eq=False)
class BatchResult:
    """One unit of work: its frame (None: nothing now) and the state to go on from. pins: the folders that the frame is read from."""

    frame: DataFrame | None
    state: RunState
    pins: tuple[str, ...] = ()

    def release(self) -> None:
        """Removes what the frame is read from; for when the frame has been written, or is not needed."""
        if self.frame is not None:
            release(self.frame.sparkSession, self.pins)
