"""Streams: bounded appends to an engine batch by batch, and scoring of a stream against a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from polyview.engine import Engine
from polyview.operators.likelihood import logp
from polyview.sources.readers import ROW, with_row_names


def append_stream(engine: Engine, stream: DataFrame, append: tuple | None = ("window",), sweeps: int = 1, checkpoint: str | None = None) -> StreamingQuery:
    """Each micro-batch's rows are appended (the table kept within the append strategy) and the model is updated by a few
    sweeps. After a restart from the checkpoint the last batch may come again: rows of it that the engine (saved by then) has already
    are left out, by their names, so it is applied once; a row that was evicted meanwhile is appended anew."""
    done: set[int] = set()

    def apply(batch: DataFrame, number: int) -> None:
        if number in done:
            return
        named = with_row_names(batch)
        fresh = named.join(engine.model.rows().select(F.col("row").alias("_known")), F.col(ROW) == F.col("_known"), "left_anti").withColumnRenamed(ROW, "ID")
        if not fresh.isEmpty():
            engine.append_rows(fresh, append)
            if sweeps:
                engine.update(sweeps)
        done.add(number)

    writer = stream.writeStream.foreachBatch(apply)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def score_stream(engine: Engine, stream: DataFrame, cols: list[str], given: dict | None = None) -> DataFrame:
    """The stream with ``logp`` of the named columns: stateless, the model's parameters are broadcast."""
    return logp(engine.model, stream, cols, given)


__all__ = ["append_stream", "score_stream"]
