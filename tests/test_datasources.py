"""The listing source and the ledger sink: restarts, pushed filters, retries; failures, replays."""

from __future__ import annotations

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from lexarium.sources import ledger, listing

HERE = "tests.test_datasources"


def note(scope, token):
    with open(f"{scope}.log", "a") as f:
        f.write(f"{token}\n")


def five_pages(scope, token):
    """Five pages of two members; a scope is the path its calls are noted at."""
    note(scope, token)
    page = int(token or 0)
    return [{"n": 2 * page}, {"n": 2 * page + 1}], str(page + 1) if page < 4 else None


def failing(scope, token):
    """Every page fails twice before it comes."""
    note(scope, token)
    if open(f"{scope}.log").read().split("\n").count(str(token)) < 3:
        error = OSError("busy")
        error.retry_after = 0.0
        raise error
    return [{"n": 1}], "next" if token is None else None


def asked(scope):
    return open(f"{scope}.log").read().split() if os.path.exists(f"{scope}.log") else []


@pytest.fixture
def scopes(tmp_path):
    return [str(tmp_path / s) for s in ("eu", "us", "asia")]


def options(spark, fetch, scopes, **more):
    listing.registered(spark)
    return {"fetch": f"{HERE}:{fetch}", "scopes": ",".join(scopes), **more}


def test_pushed_scopes_read_fewer_pages(spark, scopes):
    load = lambda: spark.read.format("listing").options(**options(spark, "five_pages", scopes, pushdown="true")).load()
    assert load().where(F.col("scope") == scopes[1]).count() == 10 and [len(asked(s)) for s in scopes] == [0, 5, 0]
    assert load().where(F.col("scope").isin(scopes[0], scopes[2]) & (F.col("page") > 2)).count() == 8 and [len(asked(s)) for s in scopes] == [5, 5, 5]
    assert load().count() == 30


def test_one_frame_serves_many_queries_without_pushdown(spark, scopes):
    source = spark.read.format("listing").options(**options(spark, "five_pages", scopes)).load()
    assert source.where(F.col("scope") == scopes[1]).count() == 10 and source.count() == 30


def test_pages_are_asked_for_again(spark, scopes):
    opts = options(spark, "failing", scopes[:1], wait="0")
    assert spark.read.format("listing").options(**opts).load().count() == 2
    assert asked(scopes[0]) == ["None"] * 3 + ["next"] * 3
    with pytest.raises(Exception, match="busy"):
        spark.read.format("listing").options(**(opts | {"retries": "1", "scopes": scopes[1]})).load().collect()


def test_a_listing_that_never_ends_is_an_error(spark, scopes):
    with pytest.raises(Exception, match="token is left"):
        spark.read.format("listing").options(**options(spark, "five_pages", scopes[:1], most_pages="3")).load().collect()


def test_a_stream_goes_on_at_its_token(spark, scopes, tmp_path):
    stream = spark.readStream.format("listing").options(**options(spark, "five_pages", scopes[:2], pages_per_batch="2")).load()
    rows, cp = [], str(tmp_path / "cp")

    def once():
        query = stream.writeStream.option("checkpointLocation", cp).trigger(once=True).foreachBatch(lambda df, n: rows.extend((r["scope"], r["page"], json.loads(r["member"])["n"]) for r in df.collect())).start()
        query.awaitTermination()

    seen = []
    for _ in range(4):
        once()
        seen.append(len(rows))
    assert seen == [8, 16, 20, 20]
    assert sorted(rows) == sorted((s, n // 2, n) for s in scopes[:2] for n in range(10))
    # a batch may ask for its pages twice, to plan and to read; no run asks for a page of a batch that was done
    calls = asked(scopes[0])
    assert calls.index("2") > max(i for i, t in enumerate(calls) if t in ("None", "1")) and calls.index("4") > max(i for i, t in enumerate(calls) if t in ("2", "3"))


# ---- ledger

SHAPE = "id long, at timestamp, tags array<string>, part struct<x:int>"


def rows_of(spark, n, start=0):
    return spark.range(start, start + n).select("id", F.timestamp_seconds(F.col("id")).alias("at"), F.array(F.lit("ü"), F.lit(None).cast("string")).alias("tags"), F.struct(F.col("id").cast("int").alias("x")).alias("part"))


def test_committed_rows_come_back(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.registered(spark)
    assert ledger.read(spark, path, SHAPE).count() == 0
    for start in (0, 10):
        rows_of(spark, 10, start).write.format("ledger").option("path", path).mode("append").save()
    got = ledger.read(spark, path, SHAPE)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows_of(spark, 20).collect()))
    with pytest.raises(Exception, match="only appended"):
        rows_of(spark, 1).write.format("ledger").option("path", path).mode("overwrite").save()


def test_a_failed_task_leaves_no_row(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.registered(spark)
    rows_of(spark, 5).write.format("ledger").option("path", path).mode("append").save()
    before = set(glob.glob(f"{path}/data/*"))
    bad = rows_of(spark, 400).repartition(4).where(F.when(F.col("id") == 399, F.raise_error(F.lit("broken"))).otherwise(F.lit(True)).cast("boolean"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("ledger").option("path", path).mode("append").save()
    assert ledger.read(spark, path, SHAPE).count() == 5
    ledger.vacuumed(path)
    assert set(glob.glob(f"{path}/data/*")) == before


def test_a_batch_counts_once(spark, tmp_path):
    path, source, cp = str(tmp_path / "ledger"), str(tmp_path / "in"), str(tmp_path / "cp")
    ledger.registered(spark)

    def run():
        stream = spark.readStream.schema(SHAPE).parquet(source)
        stream.writeStream.format("ledger").option("path", path).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()

    rows_of(spark, 10).write.mode("append").parquet(source)
    run()
    rows_of(spark, 10, 10).write.mode("append").parquet(source)
    run()
    assert ledger.read(spark, path, SHAPE).count() == 20
    # the sink committed, the stream's own log didn't get that far: the batch is run again
    last = max(int(f) for f in os.listdir(f"{cp}/commits") if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{cp}/commits/{f}"):
            os.remove(f"{cp}/commits/{f}")
    files = set(glob.glob(f"{path}/data/*"))
    run()
    assert sorted(r["id"] for r in ledger.read(spark, path, SHAPE).collect()) == list(range(20))
    assert set(glob.glob(f"{path}/data/*")) == files
