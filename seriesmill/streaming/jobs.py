"""Continuous forms of the batch operators, on Structured Streaming."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalar
from ..operators import series


def activity_windows(stream: DataFrame, t: str, key: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling counts; rows later than the watermark are dropped."""
    return stream.withWatermark(t, late).groupBy(F.window(t, size), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def timeline(stream: DataFrame, t: str, replay: Sequence[str], late: str = "1 hour") -> DataFrame:
    """New rows; exact replays within the watermark are dropped, equal values of other sources stay. A table at hand has no
    watermark, so there all replays go."""
    if not stream.isStreaming:
        return stream.dropDuplicates(list(replay))
    return stream.withWatermark(t, late).dropDuplicatesWithinWatermark(list(replay))


def rule_stream(stream: DataFrame, key: Sequence[str], text: str, rules: Sequence[tuple[int, str, str]]) -> DataFrame:
    """Every message through the rules, without state."""
    out = None
    for _, category, pattern in sorted(rules):
        test = F.col(text).rlike(pattern)
        out = F.when(test, category) if out is None else out.when(test, category)
    return stream.select(*key, out.alias("category"))


#: Scopes of failed attempts and how many a window bears: fixed values.
RATE_LIMITS = {"source": 60, "source_email": 8}


def _windows(times: np.ndarray, begun: int | None, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted times the window that each is in and its number there, from the window at hand on. A window opens at the first row after the
    last one's end; one step for each window, not for each row."""
    begins, numbers, at = np.empty(len(times), np.int64), np.empty(len(times), np.int64), 0
    while at < len(times):
        if begun is None or times[at] - begun >= size:
            begun, n = int(times[at]), 0
        end = int(np.searchsorted(times, begun + size))
        begins[at:end], numbers[at:end] = begun, np.arange(n + 1, n + 1 + end - at)
        n, at = n + end - at, end
    return begins, numbers


def _alerts(df: DataFrame, size_s: int, limit: int) -> DataFrame:
    """(..., us, n, begun_us) with the alert and the whole seconds until the window ends, at least one."""
    alert = F.col("n") > limit
    wait = F.greatest(F.lit(1), F.floor((F.col("begun_us") + size_s * 1_000_000 - F.col("us")) / 1_000_000)).cast("int")
    return df.withColumns({"alert": alert, "retry_after": F.when(alert, wait)})


def rate_alerts_stream(stream: DataFrame, key: str, t: str, size_s: int = 900, limit: int = 8, late: str = "1 hour") -> DataFrame:
    """Per key, a counter whose window opens at its first row and resets at the first row after it has ended. State is two
    numbers a key and goes after a day without rows. Batches are folded in order of time."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begun, n = state.get if state.exists else (None, 0)
        times = np.sort(np.concatenate([b["us"].to_numpy() for b in batches] or [np.zeros(0, np.int64)]))
        if len(times):
            begins, numbers = _windows(times, begun, n, size_s * 1_000_000)
            state.update((int(begins[-1]), int(numbers[-1])))
            state.setTimeoutTimestamp(max(int(times[-1]) // 1000, state.getCurrentWatermarkMs()) + 86_400_000)
            yield pd.DataFrame({"key": k[0], "us": times, "n": numbers, "begun_us": begins})

    keyed = stream.withColumn("at_", F.col(t).cast("timestamp")).withWatermark("at_", late).select(F.col(key).cast("string").alias("key"), "at_", F.unix_micros("at_").alias("us"))
    out = "key string, us long, n int, begun_us long"
    return _alerts(keyed.groupBy("key").applyInPandasWithState(fold, out, "begun long, n int", "append", GroupStateTimeout.EventTimeTimeout), size_s, limit)


def rate_alerts(df: DataFrame, key: str, t: str, size_s: int = 900, limit: int = 8) -> DataFrame:
    """The batch twin. A key's rows fall apart where two of them lie a window or more apart, as a new one opens there
    whatever came before; such gaps are found on counts by key and slot of the window's length, so no task sees all rows of a hot key
    unless they never pause. Pieces are dealt and sorted by Spark and stream by, and a piece is never held together."""
    size = size_s * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, begun, n = None, None, 0
        for b in batches:
            if not len(b):
                continue
            own = list(zip(b["key"], b["piece"], strict=True))
            opens = [k for k in range(len(own)) if not k or own[k] != own[k - 1]]
            out = []
            for at, end in zip(opens, [*opens[1:], len(own)], strict=True):
                if own[at] != last:
                    last, begun, n = own[at], None, 0
                times = b["us"].to_numpy()[at:end]
                begins, numbers = _windows(times, begun, n, size)
                begun, n = int(begins[-1]), int(numbers[-1])
                out.append(pd.DataFrame({"key": own[at][0], "us": times, "n": numbers, "begun_us": begins}))
            yield pd.concat(out)

    keyed = df.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(t).cast("timestamp")).alias("us")).withColumn("slot", F.floor(F.col("us") / size)).filter("us is not null")
    slots = keyed.groupBy("key", "slot").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    w = Window.partitionBy("key").orderBy("slot")
    apart = F.coalesce(F.col("first") - F.lag("last").over(w) >= size, F.lit(True))
    pieces = slots.withColumn("apart", apart).withColumn("piece", F.sum(F.col("apart").cast("long")).over(w)).select(F.col("key").alias("key_"), F.col("slot").alias("slot_"), "piece")
    rows = keyed.join(pieces, F.col("key").eqNullSafe(F.col("key_")) & (F.col("slot") == F.col("slot_"))).select("key", "piece", "us")
    return _alerts(rows.repartition("key", "piece").sortWithinPartitions("key", "piece", "us").mapInPandas(run, "key string, us long, n int, begun_us long"), size_s, limit)


def login_alerts(attempts: DataFrame, source: str, account: str, t: str, secret: bytes, size_s: int = 900) -> DataFrame:
    """Failed attempts by source and by source and account (blanks and case of the account don't count), each with its own limit;
    keys are opaque: scope, key, us, n, begun_us, alert, retry_after."""
    out = None
    for scope, limit in RATE_LIMITS.items():
        value = F.concat(F.lit(f"{scope}:"), F.col(source).cast("string"))
        if scope == "source_email":
            value = F.concat(value, F.lit("\0"), F.lower(F.trim(F.col(account).cast("string"))))
        one = rate_alerts(attempts.select(scalar.pseudonym(value, secret).alias("key"), t), "key", t, size_s, limit).select(F.lit(scope).alias("scope"), "*")
        out = one if out is None else out.unionByName(one)
    return out


class Hull:
    """Points (i, p) of a walk in rising order of i, as far as they can be the least (or the greatest) of p - c i for some c."""

    def __init__(self, sign: float, data: bytes | None = None):
        self.sign = sign
        self.points: list[tuple[float, float]] = [tuple(x) for x in np.frombuffer(data, np.float64).reshape(-1, 2)] if data else []

    def add(self, i: float, p: float) -> None:
        own, s = self.points, self.sign
        while len(own) > 1 and s * ((own[-1][1] - own[-2][1]) * (i - own[-1][0]) - (p - own[-1][1]) * (own[-1][0] - own[-2][0])) >= 0:
            own.pop()
        own.append((i, p))

    def least(self, c: float) -> float:
        """Of sign (p - c i) over the points, the origin included."""
        return min((self.sign * (p - c * i) for i, p in self.points), default=0.0)

    def packed(self) -> bytes:
        return np.array(self.points, np.float64).tobytes()


def _half_up(x: float, digits: int) -> float:
    """Half away from zero on the number as written, as Spark rounds."""
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def monitor_stream(stream: DataFrame, t: str = "ts", keys: Sequence[str] = series.KEYS, v: str = "value", i: str = "evidence_id", late: str = "1 hour", z_limit: float = 2.0, step_limit: float = 0.25, k: float = 0.5, h: float = 4.0, groups: int = 1024) -> DataFrame:
    """``series.monitor`` of the newest reading, each time readings of a series arrive: keys, at_us, and monitor's columns; the row
    with the most readings (n) is the last word. Readings may come late, up to the watermark: the ones newer than that wait
    in the state with their own time and are taken in order, so a late one changes what is said and it is said anew.
    Older ones are final and kept as sums and, for the CUSUM against a mean that moves on, as the two convex hulls of the
    series' running sums: a few points each, whatever the series' length. A timer folds the waiting ones once they are
    final. Nothing but readings with a value counts.

    Series are dealt over ``groups`` groups, each with one state, since a group costs Spark several milliseconds a time however small it
    is; a state is read and written whole, so more series need more groups."""
    names = list(keys)
    waiting = np.dtype([("us", np.int64), ("id", np.int64), ("v", np.float64)])

    def settle(n: int, base: float, total: float, square: float, low: Hull, up: Hull, rows: np.ndarray) -> tuple:
        for x in rows["v"].tolist():
            if not n:
                base = x
            n, total, square = n + 1, total + x - base, square + (x - base) ** 2
            low.add(n, total)
            up.add(n, total)
        return n, base, total, square

    def judge(n: int, base: float, total: float, square: float, low: Hull, up: Hull, last: float, rows: np.ndarray) -> tuple:
        values = rows["v"]
        count = n + len(values)
        if count < 3:
            return count, False, 0.0, "zscore_fallback", None, None, False, ""
        base = base if n else float(values[0])
        walk = total + np.cumsum(values - base)
        past = count - 1
        newest, before = float(values[-1]), float(values[-2]) if len(values) > 1 else last
        sums = total + float((values[:-1] - base).sum())
        mean = sums / past
        std = max((square + float(((values[:-1] - base) ** 2).sum())) / past - mean * mean, 0.0) ** 0.5
        flat = std <= 1e-12
        z = 0.0 if flat else (newest - base - mean) / std
        step = (newest - before) / max(abs(before), 1e-6)
        size = 0.0
        if not flat:
            for hull, sign in ((low, 1.0), (up, -1.0)):
                c = mean + sign * k * std
                tops = sign * (walk - c * np.arange(n + 1, count + 1))
                size = max(size, (tops[-1] - min(0.0, float(tops.min()), hull.least(c))) / std)
        z, step, size = _half_up(z, 9), _half_up(step, 9), _half_up(float(size), 9)
        by_z, by_step, by_sum = abs(z) >= z_limit, abs(step) >= step_limit, not flat and size > h
        strength = max(min(abs(z) / 3, 1.0), min(abs(step) / (2 * step_limit), 1.0), 0.0 if flat else min(size / h, 1.0))
        told = "+".join(name for name, on in (("causal_z", by_z), ("pct_delta", by_step), ("cusum", by_sum)) if on)
        return count, by_z or by_sum, _half_up(1 - 2 * strength, 4), "statistical_monitor", _half_up(z, 4), _half_up(step, 4), by_sum, told

    def arrived(none: int, batches: Iterator[pd.DataFrame]) -> dict[tuple, np.ndarray]:
        """The new readings of each series, in order. A key that is null is so in the whole group."""
        b = pd.concat(list(batches), ignore_index=True)
        us, i, there = b["us_"].to_numpy(), b["id_"].astype(np.int64).to_numpy(), [x for at, x in enumerate(names) if not none >> at & 1]
        order = np.lexsort((i, us))
        rows = np.empty(len(b), waiting)
        rows["us"], rows["id"], rows["v"] = us[order], i[order], b["v_"].to_numpy()[order]
        number = b.groupby(there, sort=False, dropna=False).ngroup().to_numpy()[order] if there else np.zeros(len(b), int)
        own = np.argsort(number, kind="stable")
        opens = np.flatnonzero(np.diff(number[own], prepend=-1))
        first = [b[x].iloc[order[own[opens]]].tolist() if x in there else [None] * len(opens) for x in names]
        return dict(zip(zip(*first, strict=True), np.split(rows[own], opens[1:]), strict=True))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        every = pickle.loads(state.get[0]) if state.exists else {}
        fresh = {} if state.hasTimedOut else arrived(key[1], batches)
        mark, out, wakes = state.getCurrentWatermarkMs(), [], []
        for one in fresh.keys() - every.keys():
            every[one] = (0, 0.0, 0.0, 0.0, 0.0, b"", b"", b"")
        for one, (n, base, total, square, last, low, up, held) in every.items():
            rows = np.frombuffer(held, waiting)
            if one in fresh:
                rows = np.sort(np.concatenate([rows, fresh[one]]), order=["us", "id"]) if held else fresh[one]
                out.append((*one, int(rows["us"][-1]), *judge(n, base, total, square, Hull(1.0, low), Hull(-1.0, up), last, rows)))
            # the newest reading always waits, as it is judged against those before it
            final = rows["us"] < mark * 1000
            final[-1:] = False
            if final.any():
                done, rows = rows[final], rows[~final]
                lower, upper = Hull(1.0, low), Hull(-1.0, up)
                n, base, total, square = settle(n, base, total, square, lower, upper, done)
                last, low, up = float(done["v"][-1]), lower.packed(), upper.packed()
            every[one] = n, base, total, square, last, low, up, rows.tobytes()
            if len(rows) > 1:
                wakes.append(int(rows["us"][-2]) // 1000)
        state.update((pickle.dumps(every),))
        if wakes:
            state.setTimeoutTimestamp(max(min(wakes), mark) + 1)
        if out:
            yield pd.DataFrame(out, columns=columns)

    columns = [*names, "at_us", "n", "alarm", "score", "method", "causal_z", "pct_delta", "cusum_alarm", "triggers"]
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    out = ", ".join(f"`{x}` {kinds[x]}" for x in names) + ", at_us long, n long, alarm boolean, score double, method string, causal_z double, pct_delta double, cusum_alarm boolean, triggers string"
    rows = stream.filter(F.col(v).isNotNull()).withColumn("at_", F.col(t).cast("timestamp")).withWatermark("at_", late)
    none = sum((F.when(F.col(x).isNull(), F.lit(1 << at)).otherwise(F.lit(0)) for at, x in enumerate(names)), F.lit(0))
    dealt = [F.pmod(F.xxhash64(*names), F.lit(groups)).cast("int").alias("group_"), none.cast("int").alias("none_")]
    rows = rows.select(*dealt, *names, "at_", F.unix_micros("at_").alias("us_"), F.col(i).cast("long").alias("id_"), F.col(v).cast("double").alias("v_"))
    return rows.groupBy("group_", "none_").applyInPandasWithState(fold, out, "series binary", "append", GroupStateTimeout.EventTimeTimeout)


def last_word(rows: DataFrame, keys: Sequence[str] = series.KEYS) -> DataFrame:
    """Of a drained monitor the row with the most readings of each series."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "n").alias("r")).select(*keys, "r.*")


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs what is available to the end, into Parquet."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def gaps(df: DataFrame, key: str, t: str, seconds: int) -> DataFrame:
    """Sessions: rows of a key with less than ``seconds`` between neighbours."""
    w = Window.partitionBy(key).orderBy(t)
    fresh = F.coalesce((F.unix_micros(F.col(t).cast("timestamp")) - F.lag(F.unix_micros(F.col(t).cast("timestamp"))).over(w) >= seconds * 1_000_000).cast("int"), F.lit(1))
    return df.withColumn("session", F.sum(fresh).over(w))
