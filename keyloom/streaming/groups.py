"""Stateful streaming forms: consumer groups, blocking pops, increasing ids, counters."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deliver(entries: DataFrame, consumers: list[str], count: int, key: str = "key") -> DataFrame:
    """XREADGROUP on a stream (key, ts_ms, seq): new entries in order of id, in batches of ``count`` to the consumers in turn.

    The state of a key is the number of entries delivered and the last id;
    entries that are not beyond it are refused, as XADD refuses them.
    """

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ms, seq = state.get if state.exists else (0, -1, -1)
        rows = pd.concat(list(batches)).sort_values(["ts_ms", "seq"], kind="stable")
        out: list[tuple[Any, ...]] = []
        for t, s in zip(rows["ts_ms"], rows["seq"], strict=True):
            if (t, s) > (ms, seq):
                out.append((keys[0], int(t), int(s), n // count, consumers[n // count % len(consumers)]))
                n, ms, seq = n + 1, int(t), int(s)
        state.update((n, ms, seq))
        yield pd.DataFrame(out, columns=["key", "ts_ms", "seq", "batch", "consumer"])

    return entries.select(F.col(key).alias("key"), "ts_ms", "seq").groupBy("key").applyInPandasWithState(
        run, "key string, ts_ms long, seq long, batch long, consumer string", "n long, ms long, seq long", "append", GroupStateTimeout.NoTimeout
    )


def blocking_pop(actions: DataFrame, end: str = "left") -> DataFrame:
    """BLPOP, BRPOP, BZPOPMIN and BZPOPMAX on a stream of actions (key, at, kind, value), served in arrival order.

    ``push`` adds a value at the right end, ``lpush`` at the left; ``pop`` rows
    name a waiter in value. ``end`` is left, right, min or max; for the latter
    two ``push`` sets the score (a column of that name) of a member, and equal
    scores go by member; a member without a score is left out. Rows of one ``at`` take effect together: all are pushed,
    then the oldest waiters are served. With a column ``until`` (same clock as
    ``at``, null for no limit) a waiter gives up at that time, which shows as a
    null value when the next action of the key arrives.
    Output: (key, waiter, value).
    """
    if end not in ("left", "right", "min", "max"):
        raise ValueError(f"end must be left, right, min or max, not {end!r}")
    ranked, has_until = end in ("min", "max"), "until" in actions.columns
    score = F.col("score").cast("double") if ranked else F.lit(None).cast("double")
    until = F.col("until").cast("long") if has_until else F.lit(None).cast("long")
    never = 2**63 - 1

    def take(items: list[tuple[float, str]]) -> str:
        if ranked:
            best = (min if end == "min" else max)(items)
            items.remove(best)
            return best[1]
        return items.pop(0 if end == "left" else -1)[1]

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values, scores, names, untils = state.get if state.exists else ([], [], [], [])
        items, waiters = list(zip(scores, values, strict=True)), list(zip(names, untils, strict=True))
        out = []
        for at, rows in pd.concat(list(batches)).sort_values("at", kind="stable").groupby("at", sort=True):
            out += [(keys[0], w, None) for w, limit in waiters if limit <= at]
            waiters = [w for w in waiters if w[1] > at]
            for kind, value, s, limit in zip(rows["kind"], rows["value"], rows["score"], rows["until"], strict=True):
                if kind == "pop":
                    waiters.append((value, never if pd.isna(limit) else int(limit)))
                elif ranked and pd.notna(s):
                    items = [i for i in items if i[1] != value] + [(float(s), value)]
                elif not ranked:
                    items.insert(0 if kind == "lpush" else len(items), (0.0, value))
            while items and waiters:
                out.append((keys[0], waiters.pop(0)[0], take(items)))
        state.update(([v for _, v in items], [s for s, _ in items], [w for w, _ in waiters], [u for _, u in waiters]))
        yield pd.DataFrame(out, columns=["key", "waiter", "value"])

    return actions.select("key", F.col("at").cast("long").alias("at"), "kind", "value", score.alias("score"), until.alias("until")).groupBy("key").applyInPandasWithState(
        run, "key string, waiter string, value string", "items array<string>, scores array<double>, waiters array<string>, untils array<long>", "append", GroupStateTimeout.NoTimeout
    )


def counters(log: DataFrame, keys: list[str], delta: str) -> DataFrame:
    """INCRBY on a stream: running totals, for update or complete mode."""
    return log.groupBy(*keys).agg(F.sum(delta).alias("value"))


def windowed_counts(events: DataFrame, ts: str, late: str, width: str, *by: str) -> DataFrame:
    """Tumbling counts with a watermark; later rows are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def route_stream(messages: DataFrame, subscriptions: DataFrame, channel: str = "channel") -> DataFrame:
    """PUBLISH on a stream: stream-static join with the channel subscriptions."""
    return messages.join(subscriptions, channel)
