"""Progress events: epochs, high-water marks and sliding rates, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def epochs(events: DataFrame, key: str, order: str, counter: str) -> DataFrame:
    """A new epoch starts where the counter falls."""
    w = Window.partitionBy(key).orderBy(order)
    fall = F.coalesce(F.col(counter) < F.lag(counter).over(w), F.lit(False)).cast("int")
    return events.withColumn("_fall", fall).withColumn("epoch", F.sum("_fall").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fall")


def high_water(events: DataFrame, key: str, order: str, counter: str) -> DataFrame:
    w = Window.partitionBy(key, "epoch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("high", F.max(counter).over(w))


def sliding_rate(events: DataFrame, key: str, ts: str, counter: str, seconds: int) -> DataFrame:
    """Counter gain a second over the trailing window inside an epoch; null below two samples."""
    t = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")
    w = Window.partitionBy(key, "epoch").orderBy(t).rangeBetween(-seconds * 1_000_000, 0)
    gain, span = F.col(counter) - F.min_by(counter, t).over(w), (t - F.min(t).over(w)) / 1e6
    return events.withColumn("rate", F.when(span > 0, F.round(gain / span, 6)))


def latest(events: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """The last event of each key; the same aggregate serves a stream in update mode."""
    return events.groupBy(key).agg(F.max(F.struct(seq, *columns)).alias("e")).select(key, f"e.{seq}", *[f"e.{c}" for c in columns])


def windowed_totals(stream: DataFrame, ts: str, key: str, value: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Watermarked tumbling totals for readStream sources."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


#: Bytes of advance that publish an event without any other reason.
QUANTUM = 1 << 20
#: Stages between which progress goes on rising.
PIPELINE = ("reading", "compressing", "writing")

EVENT = "op string, seq long, stage string, total_bytes long, total_items long, done_bytes long, done_items long, path string"
STATE = "stage string, total_bytes long, total_items long, done_bytes long, done_items long, path string"


def _publish(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, expire: int | None) -> Iterator[pd.DataFrame]:
    if expire and state.hasTimedOut:
        state.remove()
        return
    last = tuple(state.get) if state.exists else None
    for rows in batches:
        out = []
        for seq, stage, tb, ti, db, di, path in rows.sort_values("seq")[["seq", "stage", "total_bytes", "total_items", "done_bytes", "done_items", "path"]].itertuples(index=False):
            tb, ti, db, di = (0 if pd.isna(x) else int(x) for x in (tb, ti, db, di))
            stage, path = (None if pd.isna(x) else x for x in (stage, path))
            if last and last[1:3] == (tb, ti) and (stage == last[0] or (stage in PIPELINE and last[0] in PIPELINE)):
                db, di = max(db, last[3]), max(di, last[4])
            now = (stage, tb, ti, db, di, path)
            edge = last is None or now[:3] != last[:3] or di != last[4] or path != last[5] or 0 < tb <= db
            if edge or db >= last[3] + QUANTUM:
                last = now
                out.append((key[0], int(seq), *now))
        yield pd.DataFrame(out, columns=["op", "seq", "stage", "total_bytes", "total_items", "done_bytes", "done_items", "path"])
    if last is not None:
        state.update(last)
        if expire:
            state.setTimeoutDuration(expire)


def published(stream: DataFrame, expire: int | None = 86_400_000) -> DataFrame:
    """Events worth showing of a stream of progress reports (the columns of EVENT), in order of arrival, by seq inside a batch of rows.

    An event is published at a change of stage, totals, items or path, at the end, or a mebibyte after the last published one. Inside an epoch
    (same totals, same or pipeline stage) reports never fall: a late one is raised to the published value, not dropped. Null counts are 0, a null
    op is a key of its own. An operation's state goes after expire milliseconds without reports. With availableNow give None, which keeps
    it: there Spark would run empty batches for ever to look for expired state.
    """
    columns = stream.select("op", "seq", "stage", "total_bytes", "total_items", "done_bytes", "done_items", "path")
    return columns.groupBy("op").applyInPandasWithState(
        lambda key, batches, state: _publish(key, batches, state, expire), EVENT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout
    )
