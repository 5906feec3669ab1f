import json

import pytest
from pyspark.sql import functions as F

from marketlake.session import stream_session
from marketlake.sources.messages import ENVELOPE_SCHEMA, publish_frame, stream_table, unpack_log
from marketlake.streaming import dedup, jobs, replay, routing, sinks, windows
from marketlake.streaming.parse import parse_events


def event(i, ts, created=None, kind="trade", **more):
    body = {
        "event_id": str(i),
        "event_type": kind,
        "event_timestamp": ts,
        "created_ts": created or ts,
        "session_type": "continuous",
        "ticker": "A",
        "price": 10.0 + i,
        "quantity": i,
    }
    return json.dumps({**body, **more})


@pytest.fixture
def raw(spark):
    def make(payloads, start=0):
        rows = [(p, start + i, 0, "t", None, "A", None) for i, p in enumerate(payloads)]
        return spark.createDataFrame(
            rows,
            ENVELOPE_SCHEMA.replace("kafka_ts timestamp", "kafka_ts string").replace(
                "_ingested_at timestamp", "_ingested_at string"
            ),
        ).withColumns(
            {
                "kafka_ts": F.lit("2025-01-01 10:00:00").cast("timestamp"),
                "_ingested_at": F.lit("2025-01-01 10:00:00").cast("timestamp"),
            }
        )

    return make


@pytest.fixture
def live(spark):
    return stream_session(spark, state_partitions=2)


def feed(live, raw, path, *batches):
    """A stream with one micro-batch for each list of payloads."""
    offset = 0
    for payloads in batches:
        raw(payloads, offset).coalesce(1).write.mode("append").parquet(path)
        offset += len(payloads)
    return stream_table(live, path, ENVELOPE_SCHEMA, files_per_batch=1)


def table(spark, df, tmp_path, name="out"):
    sinks.drain(sinks.append_to(df, str(tmp_path / name), str(tmp_path / f"{name}-cp")))
    return spark.read.schema(df.schema).parquet(str(tmp_path / name))


def test_parse_reasons_and_wrapping(raw):
    good = event(1, "2025-01-01T10:00:00Z")
    df = parse_events(
        raw(
            [
                good,
                json.dumps({"payload": json.loads(good)}),
                "{broken",
                event(2, "soon"),
                event(3, "2025-01-01T10:00:00+07:00"),
                "[1]",
            ]
        )
    )
    rows = df.orderBy("source_offset").collect()
    assert [r.reason for r in rows] == [None, None, "bad_json", "bad_event_time", None, "bad_json"]
    assert rows[0].event_ts == rows[1].event_ts and rows[1].price == 11.0
    assert str(df.filter("event_id = '3'").select(F.col("event_ts").cast("string")).first()[0]) == (
        "2025-01-01 03:00:00"
    )


def test_late_flag_boundary(raw):
    df = routing.flag_late(
        parse_events(
            raw(
                [
                    event(1, "2025-01-01T10:00:00Z", "2025-01-01T10:01:00Z"),
                    event(2, "2025-01-01T10:00:00Z", "2025-01-01T10:01:01Z"),
                    event(3, "2025-01-01T10:00:00Z", "nonsense"),
                ]
            )
        )
    )
    flags = {r.event_id: r._late_flag for r in df.collect()}
    assert flags == {"1": False, "2": True, "3": False}


def test_staged_job_routes_and_dedups(spark, live, raw, tmp_path):
    first = event(1, "2025-01-01T10:00:00Z")
    stream = feed(
        live,
        raw,
        str(tmp_path / "raw"),
        [first, event(2, "2025-01-01T10:00:01Z", kind="quote"), event(5, "2025-01-01T10:00:02Z", kind="index_update"), "{bad", "{worse"],
        [event(1, "2025-01-01T10:00:00Z", "2025-01-01T10:02:30Z"), event(3, "2025-01-01T10:00:30Z", "2025-01-01T10:03:00Z")],
    )
    sinks.drain(jobs.staged_job(stream, str(tmp_path)))
    read = {
        n: spark.read.parquet(str(tmp_path / n))
        for n in ("stg_trades", "stg_quotes", "stg_events_quarantine")
    }
    assert [r.event_id for r in read["stg_trades"].collect()] == ["1"]
    assert [r.event_id for r in read["stg_quotes"].collect()] == ["2"]
    held = sorted((r.event_id or "", r.reason) for r in read["stg_events_quarantine"].collect())
    assert held == [("", "bad_json"), ("", "bad_json"), ("3", "late_arrival")]


def test_restart_takes_only_new_data(spark, live, raw, tmp_path):
    path = str(tmp_path / "raw")
    feed(live, raw, path, [event(1, "2025-01-01T10:00:00Z")])
    for extra in ([], [event(2, "2025-01-01T10:00:00Z")]):
        if extra:
            raw(extra, 1).coalesce(1).write.mode("append").parquet(path)
        sinks.drain(jobs.raw_job(stream_table(live, path, ENVELOPE_SCHEMA), str(tmp_path)))
    stored = spark.read.parquet(str(tmp_path / "raw_market_events"))
    assert sorted(r.source_offset for r in stored.collect()) == [0, 1]


@pytest.mark.parametrize("salt_on", [None, "source_offset"])
def test_dedup_within_watermark(spark, live, raw, tmp_path, salt_on):
    e = event(1, "2025-01-01T10:00:00Z")
    stream = feed(live, raw, str(tmp_path / "raw"), [e, e, e, event(2, "2025-01-01T10:00:10Z")], [e])
    once = dedup.dedup_within_watermark(
        parse_events(stream), "event_id", "event_ts", "60 seconds", salt_on
    )
    assert sorted(r.event_id for r in table(spark, once, tmp_path).collect()) == ["1", "2"]


def test_dedup_forever_and_with_ttl(spark, live, raw, tmp_path):
    e = event(1, "2025-01-01T10:00:00Z")
    again = event(1, "2025-01-01T12:00:00Z")
    mid = event(2, "2025-01-01T11:30:00Z")
    stream = feed(live, raw, str(tmp_path / "raw"), [e, e], [mid], [event(3, "2025-01-01T11:40:00Z")], [again])
    parsed = parse_events(stream)
    forever = table(spark, dedup.dedup_forever(parsed, "event_id"), tmp_path, "forever")
    assert sorted(r.event_id for r in forever.collect()) == ["1", "2", "3"]
    ttl = table(spark, dedup.dedup_with_ttl(parsed, "event_id", "event_ts", 600), tmp_path, "ttl")
    assert sorted(r.event_id for r in ttl.collect()) == ["1", "1", "2", "3"]


def test_late_router_uses_the_watermark_before_the_batch(spark, live, raw, tmp_path):
    stream = feed(
        live,
        raw,
        str(tmp_path / "raw"),
        [event(1, "2025-01-01T10:00:00Z"), event(2, "2025-01-01T09:00:00Z")],
        [
            event(3, "2025-01-01T09:58:00Z"),
            event(4, "2025-01-01T09:57:59Z"),
            event(5, "2025-01-01T11:00:00Z"),
            event(6, "soon"),
        ],
    )

    def deliver(ok, late, i):
        sinks.put_batch(ok, str(tmp_path / "ok"), i)
        sinks.put_batch(late, str(tmp_path / "late"), i)

    run = routing.late_router(str(tmp_path / "state"), deliver)
    parsed = parse_events(stream)
    sinks.drain(sinks.for_each_batch(parsed, run, str(tmp_path / "cp")))
    late = spark.read.parquet(str(tmp_path / "late"))
    assert [r.event_id for r in late.collect()] == ["4"]
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 5
    # a retried batch gives the same split
    run(parse_events(raw([event(4, "2025-01-01T09:57:59Z")])), 1)
    assert [r.event_id for r in spark.read.parquet(str(tmp_path / "late")).collect()] == ["4"]


@pytest.fixture
def trades(spark):
    return spark.range(400).select(
        (F.col("id") % 3).cast("string").alias("ticker"),
        F.timestamp_seconds(F.lit(1_735_700_000) + F.col("id") * 37).alias("event_ts"),
        (F.col("id") % 11 + 1).cast("double").alias("price"),
        (F.col("id") % 5).alias("quantity"),
    )


def test_panes_equal_direct_windows(trades):
    direct = windows.sliding_momentum(trades)
    panes = windows.sliding_momentum_backfill(trades)
    assert direct.columns == panes.columns
    assert sorted(direct.collect()) == sorted(panes.collect())


def test_stream_features_equal_batch_on_closed_windows(spark, live, trades, tmp_path):
    path = str(tmp_path / "trades")
    trades.coalesce(1).write.parquet(path)
    stream = stream_table(live, path, trades.schema)
    sinks.drain(jobs.feature_job(stream, str(tmp_path), tickers=3000))
    names = [
        "ticker_id",
        "event_timestamp",
        "f_stream_volume_5m",
        "f_stream_trade_count_30m",
        "f_stream_price_momentum_30m",
        "f_stream_burst_flag",
    ]
    got = spark.read.parquet(str(tmp_path / "feat_stream_intraday")).select(*names)
    closed = trades.agg(F.max("event_ts")).first()[0]
    want = (
        windows.stream_features(trades, tickers=3000)
        .filter(F.col("event_timestamp") <= F.lit(closed) - F.expr("INTERVAL 60 SECONDS"))
        .select(*names)
    )
    assert got.count() > 100
    assert sorted(got.collect()) == sorted(want.collect())
    assert {r.f_stream_burst_flag for r in got.collect()} == {0, 1}


def test_update_mode_upsert(spark, live, trades, tmp_path):
    path = str(tmp_path / "trades")
    for part in (0, 1):
        trades.filter(F.col("quantity") % 2 == part).coalesce(1).write.mode("append").parquet(path)
    stream = stream_table(live, path, trades.schema, files_per_batch=1)
    updating = windows.tumbling_volume(stream.withWatermark("event_ts", "1 day"))
    sinks.drain(sinks.upsert_changes(updating, str(tmp_path / "c"), str(tmp_path / "cp")))
    latest = sinks.latest_state(spark, str(tmp_path / "c"), ["ticker", "window_end"])
    want = windows.tumbling_volume(trades)
    columns = ["ticker", "window_end", "f_stream_volume_5m"]
    assert sorted(latest.select(*columns).collect()) == sorted(want.select(*columns).collect())
    assert spark.read.parquet(str(tmp_path / "c")).count() > latest.count()


def test_quarantine_replay(trades):
    rows = trades.withColumn("event_id", F.monotonically_increasing_id())
    late = F.col("quantity") == 3
    staged, released = rows.filter(~late), rows.filter(late)
    merged = replay.merge_quarantine(staged, released.unionByName(released))
    assert merged.count() == 400
    assert replay.merge_quarantine(merged, released).count() == 400
    repaired = replay.repair_windows(windows.tumbling_volume(staged), merged, released)
    assert sorted(repaired.collect()) == sorted(windows.tumbling_volume(rows).collect())


def test_sessions(frame):
    df = frame(
        "k string, ts timestamp",
        [("a", "2025-01-01 10:00:00"), ("a", "2025-01-01 10:20:00"), ("a", "2025-01-01 13:00:00")],
    )
    got = windows.session_activity(df, "k", "ts", "30 minutes", {"n": F.count("*")})
    assert sorted(r.n for r in got.collect()) == [1, 2]


def test_publish_frame_and_envelope(spark, frame):
    df = frame("ticker string, ts timestamp, p double", [("A", "2025-01-01 10:00:00", 1.0), (None, "2025-01-01 10:00:00", 2.0), ("", "2025-01-01 10:00:00", 3.0)])
    out = publish_frame(df, "ticker", "ts", ["ticker", "p"])
    assert [r.key for r in out.collect()] == ["A", "INDEX", "INDEX"]
    log = out.selectExpr(
        "CAST(key AS BINARY) key", "CAST(value AS BINARY) value", "'t' topic", "1 partition", "7L offset", "timestamp"
    )
    row = unpack_log(log).first()
    assert (row.kafka_key, row.source_offset, row.source_topic) == ("A", 7, "t")
    assert json.loads(row.payload_json) == {"ticker": "A", "p": 1.0}


def test_start_all_stops_what_runs():
    stopped = []

    class Query:
        def stop(self):
            stopped.append(self)

    def fail():
        raise RuntimeError("no sink")

    with pytest.raises(RuntimeError):
        sinks.start_all([Query, Query, fail])
    assert len(stopped) == 2
    assert len(sinks.start_all([Query])) == 1


def test_no_event_vanishes(frame):
    schema = ", ".join(f"{c} string" for c in dict.fromkeys(routing.TRADE_COLUMNS + routing.QUOTE_COLUMNS + routing.QUARANTINE_COLUMNS) if c != "_late_flag")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = ["trade", "quote", "index_update", "halt", None]
    rows = [tuple(k if n == "event_type" else None if n == "reason" else f"{n}{i}" for n in names) + (False,) for i, k in enumerate(kinds)]
    parts = routing.routes(frame(schema + ", _late_flag boolean", rows))
    assert parts["stg_trades"].count() == parts["stg_quotes"].count() == 1
    held = parts["stg_events_quarantine"].collect()
    assert {(r.event_type, r.reason) for r in held} == {("halt", "unknown_type"), (None, "unknown_type")}
