"""Streams run to the end of their input and agree with their batch form."""

import datetime as dt
import random

from pyspark.sql import functions as F

from shelfspark.streaming import attempts

T0 = dt.datetime(2026, 1, 1)


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def stream(spark, df, path):
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_exact_limiter(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    seen = [("a", at(s), False) for s in (0, 10, 20, 30, 40)]  # five failures
    seen += [("a", at(50), True), ("a", at(59), False), ("a", at(60), False)]  # rejected twice; the window ends at 60
    seen += [("b", at(s), s == 30) for s in (0, 10, 20, 30, 40, 50, 55, 58)]  # a success clears
    df = stream(spark, spark.createDataFrame(seen, "k string, ts timestamp, success boolean"), str(tmp_path / "in"))
    got = run(spark, attempts.limited(attempts.timed(df), "k"), "limited").orderBy("k", "ts").collect()
    assert [r.rejected for r in got if r.k == "a"] == [False] * 5 + [True, True, False]
    assert not any(r.rejected for r in got if r.k == "b")


def test_exact_limiter_of_a_table(spark):
    """Against the rule applied attempt by attempt, with ties, breaks, a null key and a key that is always tried."""
    rng = random.Random(5)
    for most, decay in ((5, 60), (2, 1)):
        seen, at = [], {"a": 0, "b": 0, None: 0}
        for i in range(900):
            k = rng.choice(list(at))
            at[k] += rng.choice([0, 1, 7, 20]) * 1_000_000 if k != "b" else rng.choice([0, 30, 59, 60, 61, 200]) * 1_000_000 - (i % 3 == 0 and at[k] > 0)
            seen.append((i, k, at[k], rng.random() < 0.1))
        want, state = {}, {}
        for i, k, now, ok in sorted(seen, key=lambda r: (r[2], r[0])):
            opened, n = state.get(k, (0, 0))
            if n and now >= opened + decay * 1_000_000:
                n = 0
            want[i] = n >= most
            if not want[i]:
                opened, n = (opened, 0) if ok else (opened if n else now, n + 1)
            state[k] = opened, n
        df = spark.createDataFrame(seen, "id long, k string, at long, ok boolean")
        got = {r.id: r.rejected for r in attempts.limited_rows(df, "k", F.col("at"), F.col("ok"), "id", most, decay).collect()}
        assert got == want and 0 < sum(want.values()) < len(want)
    assert attempts.limited_rows(df.limit(0), "k", F.col("at"), F.col("ok"), "id").isEmpty()


def test_terms_end_after_their_last_second(spark):
    at = spark.createDataFrame([(T0 + dt.timedelta(seconds=s),) for s in (-3600, -3601, 0, 1)], "at timestamp")
    assert [r[0] for r in at.select(attempts.live(F.col("at"), F.lit(T0), 3600)).collect()] == [True, False, True, False]


def test_daily_job_reminds_once(spark, tmp_path):
    day = lambda n: dt.date(2026, 11, n)
    loans = spark.createDataFrame([(1, day(5), None), (2, day(5), day(6)), (3, day(6), None), (4, day(7), None)], "EMPCODIGO long, EMPDTEMPR date, EMPDTDEVOL date")
    ticks, sent = str(tmp_path / "ticks"), str(tmp_path / "sent")

    def tick(*days, checkpoint="state"):
        spark.createDataFrame([(d,) for d in days], "dia date").coalesce(1).write.mode("append").parquet(ticks)
        attempts.remind(spark.readStream.schema("dia date").parquet(ticks), lambda: loans, sent, str(tmp_path / checkpoint)).awaitTermination()
        return sorted((r.EMPCODIGO, r.dia) for r in spark.read.parquet(sent).collect())

    assert tick(day(10)) == [(1, day(10))]
    assert tick(day(11), day(12), day(11)) == [(1, day(10)), (3, day(11)), (4, day(12))]
    assert tick(day(10)) == [(1, day(10)), (3, day(11)), (4, day(12))]


def test_windows_agree_with_batch(spark, tmp_path):
    rows = [(i % 3, T0 + dt.timedelta(seconds=7 * i)) for i in range(100)]
    batch = spark.createDataFrame(rows, "k int, ts timestamp")
    want = {tuple(r) for r in attempts.locked_out(batch, F.col("k"), most=3).collect()}
    got = {tuple(r) for r in run(spark, attempts.locked_out(attempts.timed(stream(spark, batch, str(tmp_path / "in"))), F.col("k"), most=3), "windows", "complete").collect()}
    assert got == want and want


def test_sessions_agree_with_batch(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(minutes=m)) for m in (0, 100, 219, 500)]
    batch = spark.createDataFrame(rows, "k string, ts timestamp")
    want = sorted(r.eventos for r in attempts.sessions(batch, F.col("k")).collect())
    got = run(spark, attempts.sessions(attempts.timed(stream(spark, batch, str(tmp_path / "in"))), F.col("k")), "sess", "complete").collect()
    assert sorted(r.eventos for r in got) == want == [1, 3]


def test_sent_once(spark, tmp_path):
    df = spark.createDataFrame([(1, T0), (1, T0), (2, T0)], "id long, ts timestamp")
    got = run(spark, attempts.sent_once(stream(spark, df, str(tmp_path / "in")), "id"), "sent").collect()
    assert sorted(r.id for r in got) == [1, 2]


def test_change_capture(spark, tmp_path):
    rows = [(1, 1, "a", False), (1, 2, "a", False), (1, 3, "b", False), (2, 1, "x", False), (2, 2, None, True), (2, 3, None, True)]
    df = stream(spark, spark.createDataFrame(rows, "id long, v long, dados string, apagado boolean"), str(tmp_path / "in"))
    got = sorted(tuple(r) for r in run(spark, attempts.captured(df, "id", "v"), "captured").collect())
    assert got == [(1, 1, "criou", None, "a"), (1, 3, "editou", "a", "b"), (2, 1, "criou", None, "x"), (2, 2, "excluiu", "x", None)]
