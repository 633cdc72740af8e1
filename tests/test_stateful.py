"""Streams with state against their table forms, with rows out of order and late ones."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexarium.operators import sessions
from lexarium.streaming import mentions, stateful

T0 = dt.datetime(2024, 1, 1)
ROW = "id string, ts timestamp"


def at(days, micros=0):
    return T0 + dt.timedelta(days=days, microseconds=micros)


def played(spark, tmp_path, make, batches, restart=True):
    """What a stream gives for files that come one after the other, each run from the checkpoint."""
    folder, out = str(tmp_path / "in"), []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(ROW).parquet(folder)
        mentions.run_once(make(stream), str(tmp_path / "cp"), lambda df, n: out.extend(tuple(r) for r in df.collect()))
    return sorted(out, key=str)


#: Far enough that the watermark passes all that went before.
END = [("end", at(4000)), ("end", at(8001))]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stream_of_dispatches_is_the_table(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted(((rng.choice("abcdef"), at(rng.randrange(60), rng.randrange(3) * 1_500)) for _ in range(150)), key=lambda r: r[1])
    rows += [("x", at(70)), ("x", at(77)), ("x", at(77, 1)), ("y", at(70)), ("y", at(76)), ("y", at(78)), ("y", at(80)), ("y", at(85, 1))]
    # within each batch, and between neighbouring ones, the order is mixed
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for b in batches:
        rng.shuffle(b)
    for a, b in zip(batches[:-1], batches[1:], strict=True):
        a[0], b[0] = b[0], a[0]
    got = played(spark, tmp_path, lambda s: stateful.dispatched_once(s, 7, "90 days"), [*batches, END])
    want = sessions.dispatched_once(spark.createDataFrame(rows + END, ROW), 7).where("id <> 'end'")
    assert [r for r in got if r[0] != "end"] == sorted((tuple(r) for r in want.collect()), key=str)
    assert {r[1] for r in got if r[0] == "x"} == {at(70), at(77, 1)}
    assert {r[1] for r in got if r[0] == "y"} == {at(70), at(78), at(85, 1)}


def test_too_late_mentions_are_dropped(spark, tmp_path):
    got = played(spark, tmp_path, lambda s: stateful.dispatched_once(s, 7, "1 hour"), [[("a", at(10))], [("b", at(20))], [("a", at(3)), ("b", at(19, 86_000_000_000))], END])
    assert [r for r in got if r[0] != "end"] == [("a", at(10)), ("b", at(19, 86_000_000_000))]


@pytest.mark.parametrize("days", [14, 90])
def test_counters_live_their_days(spark, tmp_path, days):
    rows = [("in", at(0)), ("in", at(days, -1)), ("out", at(0)), ("out", at(days)), ("twice", at(1)), ("twice", at(1)), ("twice", at(1 + days // 2)), ("twice", at(days + 2))]
    got = played(spark, tmp_path, lambda s: stateful.living_counts(s, F.col("id"), "ts", days, "200 days"), [rows[:5], rows[5:], END])
    table = spark.createDataFrame(rows, ROW)
    counts = sessions.living_counts(table, F.col("id"), "ts", days)
    assert [r for r in got if r[2] and r[0] != "end"] == sorted((tuple(r) for r in counts.collect()), key=str)
    # a microsecond before the life is over the count goes on, at its end it begins anew
    assert ("in", at(days, -1), 2) in got and ("out", at(days), 1) in got and ("twice", at(days + 2), 4) in got
    # forgotten once, a life after the last row
    assert [r[:2] for r in got if r[2] == 0 and r[0] != "end"] == [("in", at(2 * days, -1)), ("out", at(2 * days)), ("twice", at(2 * days + 2))]
    now = lambda t: {r["key"]: r["n"] for r in sessions.living_now(counts, days, F.lit(t)).collect()}
    assert now(at(2 * days, -2)) == {"in": 2, "out": 1, "twice": 4} and now(at(2 * days, -1)) == {"out": 1, "twice": 4} and now(at(2 * days)) == {"twice": 4}
