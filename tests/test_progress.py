"""Progress as a stream: after each micro-batch, and after a restart, the rows of the batch query."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gleanworks.operators import runs
from gleanworks.streaming import live


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def answers(rng, n, hour):
    return [{"answered_at": f"2024-01-01 {hour:02d}:00:0{rng.randrange(9)}", "run_id": f"r{rng.randrange(3)}", "record_id": f"k{rng.randrange(60)}", "latency_ms": rng.choice([None, *range(5, 40)]), "failed": rng.random() < 0.2, "retries": rng.choice([None, 0, 1, 2]), "prompt_tokens": rng.randrange(900), "total": 60} for _ in range(n)]


def test_lower_median():
    rng = random.Random(1)
    for _ in range(300):
        values = [rng.randrange(9) for _ in range(rng.randrange(1, 12))]
        assert live.lower_median({v: values.count(v) for v in values}) == sorted(values)[(len(values) - 1) // 2]
    assert live.lower_median({}) is None


def test_batches_and_restarts_give_the_batch_query(rocks, tmp_path):
    rng, every = random.Random(8), {}
    (tmp_path / "in").mkdir()
    for batch in range(3):  # each a stream of its own that goes on from the checkpoint
        rows = answers(rng, 25, 1)
        (tmp_path / "in" / f"{batch}.json").write_text("\n".join(map(json.dumps, rows)))
        touched = {r["run_id"] for r in rows}
        for r in rows:
            every.setdefault((r["run_id"], r["record_id"]), r)
        out = f"{tmp_path}/out-{batch}"
        stream = live.run_progress(rocks.readStream.schema(live.ANSWERED).json(str(tmp_path / "in")))
        query = stream.writeStream.foreachBatch(lambda df, _, out=out: df.write.mode("append").parquet(out)).option("checkpointLocation", f"{tmp_path}/state").outputMode("update").trigger(availableNow=True).start()
        assert query.awaitTermination(100)
        so_far = rocks.createDataFrame([{k: v for k, v in r.items() if k != "answered_at"} for r in every.values()], live.ANSWERED)
        expected = runs.run_progress(so_far, "run_id", "latency_ms", F.lit(60), F.col("failed"), F.col("retries"), F.col("prompt_tokens")).where(F.col("run_id").isin(*touched))
        columns = ["run_id", "done", "parse_failures", "retries", "median_latency", "prompt_tokens"]
        got = rocks.read.parquet(out)
        plain = lambda df: sorted((*r[:4], None if r[4] is None else int(r[4]), *r[5:]) for r in df.select(columns).collect())
        assert plain(got) == plain(expected)
        assert all(r.pending == 60 - r.done and not r.idle for r in got.collect())


def test_idle_runs_are_dropped(rocks, tmp_path):
    (tmp_path / "in").mkdir()
    rows = []
    for batch, hour in enumerate((1, 5)):
        new = [{"run_id": f"r{batch}", "record_id": "k", "answered_at": f"2024-01-01 0{hour}:00:00", "latency_ms": 7, "failed": False, "retries": 0, "prompt_tokens": 1, "total": 3}]
        (tmp_path / "in" / f"{batch}.json").write_text("\n".join(map(json.dumps, new)))
        stream = live.run_progress(rocks.readStream.schema(live.ANSWERED).json(str(tmp_path / "in")), idle=3600)
        query = stream.writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").outputMode("update").trigger(availableNow=True).start()
        assert query.awaitTermination(100)
    assert [(r.run_id, r.done, r.pending, r.idle) for r in rows] == [("r0", 1, 2, False), ("r1", 1, 2, False), ("r0", 1, 2, True)]
