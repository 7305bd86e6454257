import pytest

from tessera.operators import frames as T
from tessera.streaming import frames as S


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(i, i % 3, f"2024-01-01 00:{i:02d}:00", float(i * i % 17)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts string, v double").selectExpr("event_id", "user_id", "timestamp(ts) AS ts", "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("name, args", [("ema", (0.25,)), ("kalman_1d", (0.01, 1.0)), ("running_background", (0.2, 5.0))])
def test_state_equals_batch(spark, stream, name, args):
    batch, live = stream
    got = S.run_to_memory(getattr(S, name)(live, "user_id", "event_id", "v", *args), f"mem_{name}").collect()
    want = getattr(T, name)(batch, ["user_id"], ["event_id"], "v", *args).collect()
    assert {r[1]: r[2] for r in got} == pytest.approx({r["event_id"]: r[-1] for r in want})


def test_windows_and_sessions(spark, stream):
    batch, live = stream
    got = S.run_to_memory(S.windowed_stats(live, "ts", ["user_id"], "v", "10 minutes"), "mem_w", "complete").collect()
    assert sum(r["n"] for r in got) == batch.count() and len(got) == 12
    assert S.run_to_memory(S.distinct_within(live.selectExpr("ts", "user_id % 2 AS u"), "ts", ["u"], "1 hour"), "mem_d").count() == 2


def test_sessions_batch(spark, stream):
    batch, _ = stream
    got = S.sessions(batch, "ts", ["user_id"], "4 minutes").collect()
    assert sorted(r["n"] for r in got) == [13, 13, 14]
