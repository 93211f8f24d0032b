"""Score a stream of rows into files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabwright.operators.models import NeighborModel, Trained
from tabwright.plans.scoring import score


def score_stream(trained: Trained, rows: DataFrame, path: str, checkpoint: str, model: str | None = None, once: bool = True) -> StreamingQuery:
    """Append predictions for new rows to Parquet files under ``path``.

    A neighbour search looks at a whole table per batch, so it goes through ``foreachBatch``.
    """
    if isinstance(trained.models[model or trained.best()], NeighborModel):
        writer = rows.writeStream.foreachBatch(lambda part, _: score(trained, part, model).write.mode("append").parquet(path))
    else:
        writer = score(trained, rows, model).writeStream.format("parquet").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
