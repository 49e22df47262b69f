"""Live sessions by timers, against counting at each moment."""

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from lodestar.operators.index import active_users
from lodestar.streaming.live import PROVIDER, LiveSessions, follow, ticks

DAY = datetime(2024, 1, 1)


def active(rows, at, horizon=300):
    last = {}
    for s, t in rows:
        if s is not None and t is not None and t <= at:
            last[s] = max(t, last.get(s, t))
    return sum(t >= at - timedelta(seconds=horizon) for t in last.values())


def test_each_moment_and_the_last_tick(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted((DAY + timedelta(seconds=rng.randrange(4000)), f"s{rng.randrange(25)}") for _ in range(150))
    rows = [(s, t) for t, s in rows]
    schema = "session_id string, last_seen timestamp"
    for part in (rows[:70], rows[70:] + [(None, DAY), ("s1", None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        follow(spark, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check")
    assert "RocksDB" not in (spark.conf.get(PROVIDER, None) or "")
    changes = [(r.at, r.change) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    now = max(t for _, t in rows)
    for at in [*(DAY + timedelta(seconds=s) for s in range(0, 4000, 37)), now]:
        if at <= now:
            assert sum(c for t, c in changes if t <= at) == active(rows, at)
    told = ticks(spark.read.parquet(f"{tmp_path}/out")).orderBy(F.desc("tick")).first().active
    want = active_users(spark.createDataFrame(rows, schema).withColumn("last_seen", F.unix_seconds("last_seen")), F.lit(int(now.timestamp()))).first().active
    assert told == want == active(rows, now)


class Handle:
    """A key's state and timers, held here."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_all_sessions_of_a_key_come_in_one_frame():
    live, handle = LiveSessions(10), Handle()
    live.init(handle)
    frames = lambda *batches: iter([pd.DataFrame({"ms": b}) for b in batches])
    (one,) = live.handleInputRows(("s",), frames([50_000, 1_000], [30_000, 39_000]), None)
    assert list(zip(one["ms"], one["change"], strict=True)) == [(1_000, 1), (11_001, -1), (30_000, 1), (49_001, -1), (50_000, 1)]
    assert list(live.handleInputRows(("s",), frames([45_000, 55_000]), None)) == []
    assert handle.value == (55_000,) and handle.timers == {65_001}
    (two,) = live.handleInputRows(("s",), frames([65_001]), None)
    assert two["ms"].tolist() == [65_001, 65_001] and two["change"].tolist() == [-1, 1] and handle.timers == {75_002}
