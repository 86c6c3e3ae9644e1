import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import key_state as K
from tessera.streaming import calls as stream_calls
from tessera.streaming import key_state as stream_state

DAY = 86_400
START = 1_700_000_000


def _rests(*events):
    state, out = K.State(), []
    for i, e in enumerate(events):
        code, asked = e if isinstance(e, tuple) else (e, None)
        state, _ = K.advance(state, K.Event(i * K.MICRO, i, code, asked, 45.0), 2.0)
        out.append(state.until // K.MICRO - i if state.until else 0)
    return out


def test_rests_of_all_answers():
    assert _rests(401) == [300] and _rests(402) == [DAY] and _rests(403) == [300] and _rests(500) == [0]
    assert _rests(401, 401)[-1] == DAY and _rests(401, 500, 403)[-1] == DAY
    # A success in between forgets the first refusal; the running rest stays.
    assert _rests(401, 200, 401)[-1] == 300
    assert [_rests((429, x))[0] for x in (0, 30, 120, 600, 4000, 100_000, None)] == [45, 30, 120, 600, 4000, 90_000, 45]
    assert _rests((429, 30), (429, 5))[-1] == 29


@pytest.mark.parametrize(("control", "rest", "last", "refusals", "ok"), [("rpm_reset", 0, 0, 1, 1), ("rpd_reset", 0, 0, 0, 1), ("full_reset", 0, 0, 0, 0), ("unban", 0, 1, 0, 1), ("other", 300, 1, 1, 1)])
def test_controls_renew_a_key(control, rest, last, refusals, ok):
    state = K.State()
    for i, code in enumerate((200, 401)):
        state, _ = K.advance(state, K.Event(i * K.MICRO + 5, i, code), 0)
    state, free = K.advance(state, K.Event(2 * K.MICRO, 2, None, control=control), 0)
    assert not free and (max(0, state.until - K.MICRO) // K.MICRO, bool(state.last), state.refusals, state.ok) == (rest, bool(last), refusals, ok)


def _events(spark, n=1500, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        control = rng.choice(K.CONTROLS + ("unknown",)) if rng.random() < 0.06 else None
        code = None if control or rng.random() < 0.02 else rng.choice([200, 200, 200, 401, 402, 403, 429, 429, 500, 404])
        rows.append((f"P{rng.randrange(3)}", f"k{rng.randrange(4)}", START + rng.randrange(40_000), i, code, rng.choice([None, 0.0, 30.0, 90.0, 4000.0, 1e6]), 45.0, control))
    made = spark.createDataFrame(rows, "provider string, key string, at long, seq long, code int, retry_after double, usual double, control string")
    return made.withColumn("ts", F.timestamp_seconds("at")).drop("at")


def _rows(df):
    return sorted(map(tuple, df.select(*K.COLUMNS).collect()), key=str)


def test_windows_equal_the_replay(spark):
    events = _events(spark)
    assert _rows(K.key_states(events, 2.0)) == _rows(K.replay(events, 2.0))
    none = events.limit(0)
    assert K.replay(none, 2.0).count() == K.key_states(none, 2.0).count() == 0


def test_stream_of_shuffled_and_late_events_equals_the_replay(spark, tmp_path):
    events = _events(spark, 600)
    restored = spark.createDataFrame([("P0", "k1", (START + 30_000) * K.MICRO), ("P9", "k9", 1)], "provider string, key string, until long")
    # Files come by blocks of time; within a block and its neighbour all is shuffled. An event per key closes the stream.
    closing = events.select("provider", "key").distinct().withColumn("ts", F.timestamp_seconds(F.lit(START + 200_000)))
    for part, rows in enumerate([events.where(F.pmod(F.hash("seq"), F.lit(3)) == k) for k in range(3)]):
        rows.orderBy(F.hash("seq")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={part}"))
    closing.select(*(F.col(c) if c in closing.columns else F.lit(None).cast(t).alias(c) for c, t in events.dtypes)).fillna({"seq": 10**6}).coalesce(1).write.parquet(str(tmp_path / "in" / "p=9"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    stream_calls.run_to_table(stream_state.follow(stream, 2.0, "20 hours", restored), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.schema(K.OUTPUT).parquet(str(tmp_path / "out"))
    assert _rows(got) == _rows(K.replay(events, 2.0, restored))


def test_only_running_rests_are_kept_and_restored(spark):
    states = spark.createDataFrame([("P", "a", 1, 500), ("P", "a", 2, 900), ("P", "b", 3, 100), ("P", "c", 4, 0)], "provider string, key string, seq long, resting_until long")
    assert [tuple(r) for r in K.kept_rests(states, F.lit(100)).collect()] == [("P", "a", 900)]
    call = spark.createDataFrame([("P", "a", 5, 200), ("P", "z", 6, 200)], "provider string, key string, seq long, code int").withColumn("ts", F.timestamp_micros(F.lit(600)))
    got = {r["key"]: r["free"] for r in K.replay(call, 0, K.kept_rests(states, F.lit(600))).collect()}
    assert got == {"a": False, "z": True}


def test_retry_after(spark):
    at = "TIMESTAMP '2024-03-01 23:00:00'"
    cases = [
        ("map('Retry-After', '7.5')", 500, "null", 7.5),
        ("map('retry-after', 'soon')", 200, "null", None),
        ("map('x-ratelimit-reset-requests', '12', 'retry-after', '')", 429, "null", 12.0),
        ("map()", 429, """'{"error": {"details": [{"x": 1}, {"retryDelay": "86400s"}, {"retryDelay": "5s"}]}}'""", 86400.0),
        ("map()", 429, """'{"error": {"status": "RESOURCE_EXHAUSTED"}}'""", 3660.0),
        ("map()", 429, """'{"error": {"message": "Quota is gone"}}'""", 3660.0),
        ("map()", 429, """'{"error": {"message": "Rate limit"}}'""", 12.0),
        ("map()", 429, """'{"error": {"message": "other"}}'""", None),
        ("map()", 429, "'no json'", None),
        ("map()", 403, """'{"error": {"status": "RESOURCE_EXHAUSTED"}}'""", None),
    ]
    for headers, code, body, want in cases:
        row = spark.sql(f"SELECT CAST({headers} AS map<string, string>) AS headers, {code} AS code, CAST({body} AS string) AS body, {at} AS ts")
        made = K.retry_after(F.col("code"), F.col("headers"), F.col("body"), F.col("ts"), F.lit(12))
        assert row.select(made.alias("x")).head()["x"] == want, (headers, code, body)


def test_calls_to_the_state_store_do_not_grow_with_the_events_of_a_key():
    class Kept:
        def __init__(self):
            self.rows, self.calls = [], 0

        def __getattr__(self, name):  # each method that writes or reads is a call
            self.calls += 1
            return {"appendList": self.rows.extend, "appendValue": self.rows.append, "get": lambda: iter(list(self.rows)), "exists": lambda: False,
                    "put": lambda x: self.rows.__setitem__(slice(None), x), "clear": self.rows.clear, "update": lambda x: None}[name]

    class Handle:
        def __init__(self):
            self.timers, self.kept = [], {"state": Kept(), "waiting": Kept()}

        def getValueState(self, name, schema):  # noqa: N802
            return self.kept[name]

        getListState = getValueState  # noqa: N815

        def registerTimer(self, t):  # noqa: N802
            self.timers.append(t)

    class Times:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 250

    handle, follower = Handle(), stream_state._Follower(2.0)
    follower.init(handle)
    frame = pd.DataFrame({"micros": [i * 1000 for i in range(500)][::-1], "seq": range(500), "code": 200, "retry_after": None, "usual": 0.0, "control": None})
    assert list(follower.handleInputRows(("P", "k"), iter([frame[:300], frame[300:]]), None)) == []
    assert handle.timers == [1] and handle.kept["waiting"].calls == 1
    out = pd.concat(follower.handleExpiredTimer(("P", "k"), Times(), None))
    assert out["seq"].tolist() == list(range(499, 249, -1)) and handle.timers == [1, 251] and len(handle.kept["waiting"].rows) == 250
