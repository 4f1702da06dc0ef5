"""What a consumer makes of the stacked frames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.frames import DELETE


def latest_image(events: DataFrame, pk_columns: list[str], epoch: str | None = None) -> DataFrame:
    """The newest image of each key, deleted keys left out.

    An aggregation, not a window: each task keeps one row a key before the
    shuffle, so a key changed very often is no hot spot.  epoch: a column that
    tells a dump made again from those before it.
    """
    order = F.struct(*([epoch] if epoch else []), "start_lsn", "seqval", "operation")
    rest = [c for c in events.columns if c not in pk_columns]
    newest = events.groupBy(*pk_columns).agg(F.max_by(F.struct(*rest), order).alias("_row")).where(F.col("_row.operation") != DELETE)
    return newest.select(*[F.col(c) if c in pk_columns else F.col("_row")[c].alias(c) for c in events.columns])


def recompute(events: DataFrame, formulas: Mapping[str, str]) -> DataFrame:
    """Computed columns, which neither the table's pages nor the log carry, from SQL formulas over the others."""
    return events.withColumns({name: F.expr(text).cast(events.schema[name].dataType) for name, text in formulas.items()})
