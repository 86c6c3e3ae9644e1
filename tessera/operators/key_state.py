"""States of service keys: rests after refusals and exhausted quotas, and who may call when.

Events of a key, in the order (ts, seq), are answers to calls (`code`, `retry_after` in seconds or
null, `usual`: what the provider's profile says) or controls (`control`) that renew it:

- `rpm_reset` ends the rest and forgets the last call,
- `rpd_reset` and `full_reset` forget refusals too, `full_reset` also the counts of answers,
- `unban` ends the rest and forgets refusals.

`advance` is the one transition. `replay` runs it over a table, sorted by key and streamed, so no
key's events are ever held; `tessera.streaming.key_state` runs it over a stream; `key_states` states
the same by windows, in the JVM. Null codes count as answers without effect. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.fleet import _micros

# Seconds that a key rests, by answer.
REST_REFUSED, REST_UNPAID, LONGEST_DAILY, LONGEST_HOURS, LONGEST_MINUTE = 300, 86400, 90000, 86400, 120
REFUSED = (401, 402, 403)
FORGET_CALL = ("rpm_reset", "rpd_reset", "full_reset")
FORGET_REFUSALS = ("rpd_reset", "full_reset", "unban")
CONTROLS = ("rpm_reset", "rpd_reset", "full_reset", "unban")
OUTPUT = "provider string, key string, seq long, code int, control string, resting_until long, free boolean, ok long, failed long, rejected long"
MICRO = 1_000_000


@dataclass(frozen=True)
class State:
    """until and last: microseconds since 1970, 0 if none; refusals: since the last 200."""

    until: int = 0
    last: int = 0
    refusals: int = 0
    ok: int = 0
    failed: int = 0
    rejected: int = 0


@dataclass(frozen=True)
class Event:
    micros: int
    seq: int
    code: int | None
    retry_after: float | None = None
    usual: float = 0.0
    control: str | None = None


def seconds_of_rest(code: int | None, refusals: int, retry_after: float | None, usual: float) -> float:
    if code in REFUSED:
        return REST_UNPAID if code == 402 or refusals >= 2 else REST_REFUSED
    if code != 429:
        return 0
    asked = retry_after or 0
    if asked > 3600:
        return min(asked, LONGEST_DAILY)
    if asked > 60:
        return min(asked, LONGEST_HOURS)
    return min(asked, LONGEST_MINUTE) if asked > 0 else usual


def advance(state: State, event: Event, min_gap: float) -> tuple[State, bool]:
    """The state after an event, and whether the key was free when it came: rested, and min_gap
    seconds after the call before."""
    free = state.until <= event.micros and (not state.last or event.micros - state.last >= int(min_gap * MICRO))
    if event.control:
        if event.control not in CONTROLS:
            return state, free
        none = State() if event.control == "full_reset" else replace(state, until=0)
        last = 0 if event.control in FORGET_CALL else state.last
        refusals = 0 if event.control in FORGET_REFUSALS else state.refusals
        return replace(none, last=last, refusals=refusals), free
    code = event.code
    refusals = 0 if code == 200 else state.refusals + (code in REFUSED)
    rest = seconds_of_rest(code, refusals, event.retry_after, event.usual)
    known = code or 0
    return State(
        until=max(state.until, event.micros + int(rest * MICRO)) if rest > 0 else state.until, last=event.micros, refusals=refusals,
        ok=state.ok + (0 < known < 400), failed=state.failed + (known >= 500), rejected=state.rejected + (400 <= known < 500),
    ), free


def _or_none(value: object) -> object:
    return None if value is None or value != value else value


def events_of(frame: pd.DataFrame) -> Iterator[Event]:
    for r in frame.itertuples(index=False):
        code, asked = _or_none(r.code), _or_none(r.retry_after)
        yield Event(int(r.micros), int(r.seq), None if code is None else int(code), None if asked is None else float(asked), float(_or_none(r.usual) or 0), _or_none(r.control))


def row_of(provider: str, key: str, event: Event, state: State, free: bool) -> tuple:
    return provider, key, event.seq, event.code, event.control, state.until, free, state.ok, state.failed, state.rejected


COLUMNS = [c.split(" ")[0] for c in OUTPUT.split(", ")]


def frame_of(rows: list[tuple]) -> pd.DataFrame:
    """Rows with the types that Spark expects, null codes kept."""
    out = pd.DataFrame(rows, columns=COLUMNS)
    return out.astype({"code": "Int32", "seq": "int64", "resting_until": "int64", "ok": "int64", "failed": "int64", "rejected": "int64", "free": "bool"})


def as_events(calls: DataFrame) -> DataFrame:
    """provider, key, ts, micros, seq, code, retry_after, usual and control, missing ones null."""
    have = set(calls.columns)
    optional = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    return calls.select(
        F.col("provider").cast("string").alias("provider"), F.col("key").cast("string").alias("key"), "ts", _micros(F.col("ts")).alias("micros"), F.col("seq").cast("long").alias("seq"),
        F.col("code").cast("int").alias("code"), optional("retry_after", "double"), optional("usual", "double"), optional("control", "string"),
    )


def replay(calls: DataFrame, min_gap: float, restored: DataFrame | None = None) -> DataFrame:
    """Every event with the state of its key after it, from the first on. restored: provider, key,
    until (microseconds) of rests that were kept."""
    events = as_events(calls).drop("ts")
    if restored is not None:
        first = restored.select(F.col("provider").cast("string").alias("p"), F.col("key").cast("string").alias("k"), F.col("until").cast("long").alias("kept_until"))
        events = events.join(first, events.provider.eqNullSafe(F.col("p")) & events.key.eqNullSafe(F.col("k")), "left").drop("p", "k")
    else:
        events = events.withColumn("kept_until", F.lit(None).cast("long"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, State()
        for frame in frames:
            made = []
            for name, kept, event in zip(zip(frame["provider"], frame["key"], strict=True), frame["kept_until"], events_of(frame), strict=True):
                if name != now:
                    now, state = name, State(until=int(_or_none(kept) or 0))
                state, free = advance(state, event, min_gap)
                made.append(row_of(*name, event, state, free))
            if made:
                yield frame_of(made)

    ordered = events.repartition("provider", "key").sortWithinPartitions("provider", "key", "micros", "seq")
    return ordered.mapInPandas(run, OUTPUT)


def kept_rests(states: DataFrame, now: Column) -> DataFrame:
    """provider, key and until of the keys that still rest: what is worth keeping, and restoring.
    states: rows of `replay`, `key_states` or the stream; now: microseconds. A key's last event counts."""
    last = states.groupBy("provider", "key").agg(F.max_by("resting_until", "seq").alias("until"))
    return last.where(F.col("until") > now)


def rest_seconds(code: Column, refusals: Column, retry_after: Column, usual: Column) -> Column:
    """How long a key rests after an answer: a day if it is not paid for or refused twice, else as the
    service asks within bounds, else as usual for it."""
    asked = F.when(retry_after > 3600, F.least(retry_after, F.lit(LONGEST_DAILY))).when(retry_after > 60, F.least(retry_after, F.lit(LONGEST_HOURS)))
    asked = asked.when(retry_after > 0, F.least(retry_after, F.lit(LONGEST_MINUTE))).otherwise(F.coalesce(usual, F.lit(0)))
    refused = F.when((code == 402) | (refusals >= 2), REST_UNPAID).otherwise(REST_REFUSED)
    return F.coalesce(F.when(code.isin(*REFUSED), refused).when(code == 429, asked), F.lit(0)).cast("double")


def key_states(calls: DataFrame, min_gap: float) -> DataFrame:
    """The same as `replay`, by windows: counts and maxima within eras that answers and controls begin."""
    keys = ["provider", "key"]
    so_far = lambda *era: Window.partitionBy(*keys, *era).orderBy("micros", "seq").rowsBetween(Window.unboundedPreceding, 0)
    before = lambda *era: Window.partitionBy(*keys, *era).orderBy("micros", "seq").rowsBetween(Window.unboundedPreceding, -1)
    control = F.when(F.col("control").isin(*CONTROLS), F.col("control"))
    is_call = F.col("control").isNull()
    forget_call, forget_refusals = control.isin(*FORGET_CALL), control.isin(*FORGET_REFUSALS)
    out = as_events(calls).drop("ts")
    # An era begins with the event that ends the one before: rows before it look back into the old one.
    out = out.withColumn("rest_era", F.count(control).over(so_far())).withColumn("rest_era_before", F.count(control).over(before()))
    out = out.withColumn("refusal_era", F.count_if((is_call & (F.col("code") == 200)) | forget_refusals).over(so_far()))
    out = out.withColumn("call_era", F.count_if(forget_call).over(so_far())).withColumn("count_era", F.count_if(control == "full_reset").over(so_far()))
    refusals = F.count_if(is_call & F.col("code").isin(*REFUSED)).over(so_far("refusal_era"))
    out = out.withColumn("refusals", refusals)
    rest = F.when(is_call, rest_seconds(F.col("code"), F.col("refusals"), F.col("retry_after"), F.col("usual"))).otherwise(0.0)
    out = out.withColumn("ends", F.when(rest > 0, F.col("micros") + (rest * MICRO).cast("long")))
    out = out.withColumn("until", F.coalesce(F.max("ends").over(so_far("rest_era")), F.lit(0)).cast("long"))
    out = out.withColumn("last", F.coalesce(F.max(F.when(is_call, F.col("micros"))).over(so_far("call_era")), F.lit(0)))
    # What held before the event: the row before has it.
    order = Window.partitionBy(*keys).orderBy("micros", "seq")
    until, last = F.coalesce(F.lag("until").over(order), F.lit(0)), F.coalesce(F.lag("last").over(order), F.lit(0))
    free = (until <= F.col("micros")) & ((last == 0) | (F.col("micros") - last >= int(min_gap * MICRO)))
    known = F.when(is_call, F.col("code"))
    count = lambda c: F.count_if(c).over(so_far("count_era"))
    return out.select(
        *keys, "seq", "code", "control", F.col("until").alias("resting_until"), free.alias("free"),
        count((known > 0) & (known < 400)).alias("ok"), count(known >= 500).alias("failed"), count((known >= 400) & (known < 500)).alias("rejected"),
    )


# Headers that say how long to wait, the first one that is there counts.
WAIT_HEADERS = ("Retry-After", "retry-after", "x-ratelimit-reset-requests")


def retry_after(code: Column, headers: Column, body: Column, ts: Column, usual: Column) -> Column:
    """Seconds that an answer asks to wait: its header, or for 429 the first delay in its body, the
    time to a minute past the next midnight (UTC) if the quota is used up, the provider's usual wait
    if the rate is exceeded; else null. headers: map; body: JSON text."""
    said = [F.nullif(F.try_element_at(headers, F.lit(h)), F.lit("")) for h in WAIT_HEADERS]
    header = F.coalesce(*said)
    detail = "struct<error:struct<message:string,status:string,details:array<struct<retryDelay:string>>>>"
    error = F.from_json(body, detail)["error"]
    delays = F.filter(F.transform(F.coalesce(error["details"], F.array().cast("array<struct<retryDelay:string>>")), lambda d: d["retryDelay"]), lambda d: d.endswith("s"))
    delay = F.get(delays, F.lit(0))
    message, status = F.lower(F.coalesce(error["message"], F.lit(""))), F.lower(F.coalesce(error["status"], F.lit("")))
    micros = _micros(ts)
    day = 86_400 * MICRO
    to_midnight = (F.lit(day) - F.pmod(micros, F.lit(day))) / MICRO + 60.0
    used_up = status.contains("resource_exhausted") | message.contains("quota")
    too_fast = status.contains("rate_limit_exceeded") | message.contains("rate limit")
    in_body = F.when(delay.isNotNull(), F.left(delay, F.length(delay) - 1).try_cast("double")).when(used_up, to_midnight).when(too_fast, usual.cast("double"))
    return F.when(header.isNotNull() & header.try_cast("double").isNotNull(), header.try_cast("double")).when(code == 429, in_body)
