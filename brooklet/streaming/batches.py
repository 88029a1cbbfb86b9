"""Unbounded sources: Column steps run natively on a streaming DataFrame, everything else batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import PipelineBuildError
from ..plans.pipeline import Pipeline


def stream_frame(df: DataFrame, build) -> DataFrame:
    """build(Pipeline) over a streaming df as a streaming DataFrame; a stream has no encounter order, so steps that need one are refused."""
    if not df.isStreaming:
        raise PipelineBuildError("not a streaming DataFrame; use Pipeline.from_table")
    out = build(Pipeline.from_table(df).unordered())
    if any(name in ("sorted", "skip") for name, *_ in out._steps):
        raise PipelineBuildError("sorted and skip run batch by batch: use for_each_batch")
    return out.frame()


def for_each_batch(df: DataFrame, build, consumer, checkpoint: str, order_by=None, **trigger):
    """Starts a query that runs consumer(build(Pipeline), batch id) on each micro-batch; at least once, so consumers should
    write by batch id. trigger: arguments of DataStreamWriter.trigger. Returns the StreamingQuery; stop() cancels."""

    def run(batch: DataFrame, number: int) -> None:
        consumer(build(Pipeline.from_table(batch, order_by)), number)

    writer = df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
