"""Streaming adapters over a file source."""

import pytest

from brooklet import PipelineBuildError, by
from brooklet.streaming import for_each_batch, stream_frame


def test_streams(spark, tmp_path):
    spark.range(20).selectExpr("id", "id % 3 AS k").write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema("id long, k long").parquet(f"{tmp_path}/in")
    out = stream_frame(source(), lambda p: p.filter(lambda e: e.k == 1).map(lambda e: {"id": e.id}))
    q = out.writeStream.format("memory").queryName("picked").option("checkpointLocation", f"{tmp_path}/a").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.id for r in spark.table("picked").collect()) == [1, 4, 7, 10, 13, 16, 19]
    got = []
    q = for_each_batch(source(), lambda p: p.sorted(by(lambda e: -e.id)).limit(2), lambda p, n: got.extend(r.id for r in p.to_array()), f"{tmp_path}/b", "id", availableNow=True)
    q.awaitTermination(60)
    assert got == [19, 18]
    with pytest.raises(PipelineBuildError):
        stream_frame(source(), lambda p: p.sorted())
