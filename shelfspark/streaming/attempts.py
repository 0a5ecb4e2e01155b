"""Attempt limits, sessions, reminders sent once, the daily job, and change capture.

Timestamps without a time zone can't carry a watermark; ``timed`` casts them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans import reports

LOGIN_ATTEMPTS, THROTTLE_ATTEMPTS, DECAY_SECONDS = 5, 6, 60
SESSION_MINUTES, TOKEN_MINUTES, RESEND_SECONDS, CONFIRMED_SECONDS = 120, 60, 60, 10800


def timed(df: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def attempts_by_window(df: DataFrame, key: Column, ts: str = "ts", decay: str = "1 minute") -> DataFrame:
    """Attempts per key and epoch-aligned window, for batch and streaming tables."""
    return df.groupBy(F.window(ts, decay).alias("w"), key.alias("chave")).agg(F.count(F.lit(1)).alias("tentativas")).select("chave", F.col("w.start").alias("inicio"), "tentativas")


def locked_out(df: DataFrame, key: Column, most: int = LOGIN_ATTEMPTS, ts: str = "ts", decay: str = "1 minute") -> DataFrame:
    return attempts_by_window(df, key, ts, decay).filter(F.col("tentativas") >= most)


def sessions(df: DataFrame, key: Column, ts: str = "ts", idle: str = f"{SESSION_MINUTES} minutes") -> DataFrame:
    """Sessions that end after ``idle`` without an event."""
    return df.groupBy(F.session_window(ts, idle).alias("w"), key.alias("chave")).agg(F.count(F.lit(1)).alias("eventos")).select("chave", F.col("w.start").alias("inicio"), F.col("w.end").alias("fim"), "eventos")


def sent_once(df: DataFrame, key: str, late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Each key once within the watermark."""
    return timed(df, ts, late).dropDuplicatesWithinWatermark([key])


def _attempt(opened: float, n: int, now: float, ok: bool, most: int, decay: float) -> tuple[float, int, bool]:
    """State after an attempt, and whether it is rejected; ``n`` attempts count since ``opened``."""
    if n and now >= opened + decay:
        n = 0
    if n >= most:
        return opened, n, True
    if ok:
        return opened, 0, False
    return (opened if n else now), n + 1, False


def limited_rows(df: DataFrame, key: str, at: Column, success: Column, pk: str, most: int = LOGIN_ATTEMPTS, decay_seconds: int = DECAY_SECONDS) -> DataFrame:
    """``limited`` for a table: (pk, rejected), attempts in order of ``at`` (microseconds) and ``pk``.

    A window that opens in one span of ``decay_seconds`` has ended two spans later,
    so a key's attempts on both sides of an empty span don't depend on each other
    and are dealt apart. Each such run is folded as a sorted stream, batch by batch;
    only a key that is tried without a break is one task's work, as the rule is
    sequential. A null key counts as a key."""
    decay = decay_seconds * 1_000_000
    rows = df.select(F.to_json(F.struct(F.col(key))).alias("__k"), at.alias("__at"), success.alias("__ok"), pk).withColumn("__b", F.expr(f"__at div {decay}"))
    spans = Window.partitionBy("__k").orderBy("__b")
    runs = rows.select("__k", "__b").distinct().withColumn("__gap", F.col("__b") - F.lag("__b").over(spans) > 1)
    runs = runs.select("__k", "__b", F.count_if("__gap").over(spans).alias("__run"))
    dealt = rows.join(runs, ["__k", "__b"]).repartition("__k", "__run").sortWithinPartitions("__k", "__run", "__at", pk)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, opened, n = None, 0, 0
        for b in batches:
            out = []
            for k, run, now, ok in zip(b["__k"], b["__run"], b["__at"], b["__ok"], strict=True):
                if (k, run) != last:
                    last, opened, n = (k, run), 0, 0
                opened, n, rejected = _attempt(opened, n, now, ok, most, decay)
                out.append(rejected)
            yield pd.DataFrame({pk: b[pk], "rejected": out})

    return dealt.select("__k", "__run", "__at", "__ok", pk).mapInPandas(fold, f"{pk} {df.schema[pk].dataType.simpleString()}, rejected boolean")


def limited(df: DataFrame, key: str, ts: str = "ts", success: str = "success", most: int = LOGIN_ATTEMPTS, decay_seconds: int = DECAY_SECONDS) -> DataFrame:
    """Every attempt with whether it is rejected: (key, ts, rejected).

    The exact rule: the window opens at the first failure and lasts ``decay_seconds``;
    once ``most`` failures are in it, attempts are rejected till it ends; a success
    that isn't rejected clears it. Attempts are taken in time order within a trigger.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        out = []
        for at, ok in zip(rows[ts], rows[success], strict=True):
            opened, n, rejected = _attempt(opened, n, at.timestamp(), ok, most, decay_seconds)
            out.append((k[0], at, rejected))
        state.update((opened, n))
        state.setTimeoutTimestamp(max(int((opened + decay_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, ts, "rejected"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ts, success).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {ts} timestamp, rejected boolean", "opened double, n int", "append", GroupStateTimeout.EventTimeTimeout)


def live(at: Column, now: Column, seconds: int) -> Column:
    """Whether what was made ``at`` still holds at ``now``: up to and with its last second."""
    return (at <= now) & (at + F.make_dt_interval(secs=F.lit(seconds)) >= now)


def remind(days: DataFrame, loans: Callable[[], DataFrame], sent: str, checkpoint: str) -> StreamingQuery:
    """One run of the daily job over a stream of days (``dia``): the reminders of each
    day that no earlier run has seen are written to the log ``sent`` (EMPCODIGO, dia).

    The checkpoint tells which days are done. A batch that is run again writes its own
    part of the log anew, so a reminder stands there once; loans are read in each batch."""
    spark = days.sparkSession
    schema = "EMPCODIGO long, dia date"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{sent}/lote=-1")

    def run(batch: DataFrame, number: int) -> None:
        log = spark.read.schema(f"{schema}, lote long").parquet(sent).filter(F.col("lote") != number)
        due = reports.due_on(loans(), batch).select("EMPCODIGO", "dia")
        due.join(log.select("EMPCODIGO").distinct(), "EMPCODIGO", "left_anti").write.mode("overwrite").parquet(f"{sent}/lote={number}")

    return days.select("dia").writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def captured(df: DataFrame, pk: str, version: str) -> DataFrame:
    """Change capture over a stream of record versions (pk, version, dados, apagado):
    (pk, version, acao, antes, depois), where ``dados`` is the record as JSON.

    State is the last ``dados`` of each key; a version equal to it gives nothing."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for v, data, gone in pd.concat(list(batches)).sort_values(version, kind="stable")[[version, "dados", "apagado"]].itertuples(index=False):
            if gone:
                if last is not None:
                    out.append((k[0], v, "excluiu", last, None))
                last = None
            elif data != last:
                out.append((k[0], v, "criou" if last is None else "editou", last, data))
                last = data
        if last is None:
            if state.exists:
                state.remove()
        else:
            state.update((last,))
        yield pd.DataFrame(out, columns=[pk, version, "acao", "antes", "depois"])

    kinds = {c: df.schema[c].dataType.simpleString() for c in (pk, version)}
    schema = f"{pk} {kinds[pk]}, {version} {kinds[version]}, acao string, antes string, depois string"
    return df.select(pk, version, "dados", "apagado").groupBy(pk).applyInPandasWithState(run, schema, "dados string", "append", GroupStateTimeout.NoTimeout)
