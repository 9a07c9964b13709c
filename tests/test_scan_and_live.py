from __future__ import annotations

import time
from datetime import date, datetime
from pathlib import Path

import pytest
from chains import random_chain, rows_of
from compare import formatted_plan
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from test_ingest import tick, ticks

from strikeforge.__main__ import main
from strikeforge.operators.ingest import latest_quotes
from strikeforge.plans.landed import Wanted, in_window
from strikeforge.plans.scan import Strategies, run_scan
from strikeforge.schema import (
    CHAIN_SCHEMA, DATASETS, LISTING_SCHEMA, POLL_SCHEMA, RESULT_COLUMNS, TICK_SCHEMA,
)
from strikeforge.operators import quality, screens
from strikeforge.sources.landing import read_landed
from strikeforge.sources.tables import (
    STATISTICS, Stage, chain_from_rows, load_dataset, load_datasets, load_statistics, read_table,
    shared_folder, write_table,
)
from strikeforge.sources.versioned import VersionedTable
from strikeforge.streaming import live as live_module
from strikeforge.streaming.live import (
    BUCKET_BYTES, STATE_PARTITION_BYTES, LiveQuotes, buckets_for, latest_in_state, state_sized_for,
)


def test_scan_writes_all_datasets_and_counts_them(spark, tmp_path):
    chain = chain_from_rows(spark, random_chain(31))
    out = str(tmp_path / "out")
    rows = run_scan(spark, chain, out)
    assert list(rows) == DATASETS
    stored = load_datasets(spark, out, DATASETS)
    assert {n: df.count() for n, df in stored.items()} == rows
    assert all(df.columns == RESULT_COLUMNS[n] for n, df in stored.items())
    run = Strategies(chain)
    assert sorted(map(str, rows_of(stored["spreads"]))) == sorted(map(str, rows_of(run.spreads())))
    assert sorted(map(str, rows_of(stored["iron_condors"]))) == sorted(
        map(str, rows_of(run.iron_condors())))
    assert run_scan(spark, chain.limit(30), out)["option_chain"] == 30
    assert load_dataset(spark, out, "option_chain").count() == 30


def test_empty_chain_writes_nothing(spark, tmp_path):
    chain = chain_from_rows(spark, random_chain(31)).limit(0)
    assert run_scan(spark, chain, str(tmp_path / "out")) == {}
    assert not (tmp_path / "out").exists()


def test_repeated_contracts_stop_a_scan(spark, tmp_path):
    rows = random_chain(31)
    chain = chain_from_rows(spark, [*rows, rows[0]])
    with pytest.raises(ValueError, match="repeats contracts"):
        run_scan(spark, chain, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_missing_and_unreadable_datasets_are_none(spark, tmp_path):
    assert load_dataset(spark, str(tmp_path), "nothing") is None
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("not parquet")
    assert load_dataset(spark, str(tmp_path), "broken") is None


def test_landed_files_are_read_with_the_fixed_schema(spark, tmp_path):
    chain = chain_from_rows(spark, random_chain(32))
    for fmt in ("json", "csv", "orc", "parquet"):
        path = str(tmp_path / fmt)
        chain.write.format(fmt).save(path)
        back = read_table(spark, path, CHAIN_SCHEMA, fmt)
        assert [f.dataType for f in back.schema] == [f.dataType for f in CHAIN_SCHEMA]
        assert sorted(map(str, rows_of(back))) == sorted(map(str, rows_of(chain)))


def test_row_count_is_taken_during_the_write(spark, tmp_path):
    path = str(tmp_path / "t")
    assert write_table(spark.range(100).toDF("x"), path, ["x"]) == 100
    assert write_table(spark.range(0).toDF("x"), path) == 0


def test_writes_keep_sizes_and_null_counts(spark, tmp_path):
    chain = chain_from_rows(spark, random_chain(31))
    out = str(tmp_path / "out")
    run_scan(spark, chain, out)
    datasets, statistics = load_datasets(spark, out, DATASETS), load_statistics(spark, out)
    assert sorted(quality.stored_null_profile(statistics).collect()) == sorted(
        quality.null_profile(datasets).collect())
    assert sorted(quality.stored_sizes(statistics).collect()) == sorted(
        quality.dataset_sizes(datasets).collect())
    for profile in (quality.stored_null_profile, quality.stored_sizes):
        plan = formatted_plan(profile(statistics))
        assert plan.count("ReadSchema") == 1 and f"/{STATISTICS}" in plan


def one_symbol(seed):
    rows = random_chain(seed)
    return [r for r in rows if r["symbol"] == rows[0]["symbol"]]


def files_under(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_rerun_of_one_symbol_leaves_the_others(spark, tmp_path):
    rows = one_symbol(31)
    rows = rows + [r | {"symbol": "007"} for r in rows] + [r | {"symbol": "ZZZ"} for r in rows]
    out = tmp_path / "out"
    chain = chain_from_rows(spark, rows)
    whole = run_scan(spark, chain, str(out), by_symbol=True)
    before = files_under(out)
    stored = load_datasets(spark, str(out), DATASETS)
    assert {n: df.count() for n, df in stored.items()} == whole
    assert all(df.columns == RESULT_COLUMNS[n] for n, df in stored.items())
    assert "007" in {r.symbol for r in stored["spreads"].select("symbol").distinct().collect()}

    again = run_scan(spark, chain.filter("symbol = '007' AND strike < underlying_price"), str(out), by_symbol=True)
    after = files_under(out)
    kept = {p: t for p, t in before.items() if "symbol=007" not in p}
    assert kept and {p: after.get(p) for p in kept} == kept
    assert not set(before) - set(kept) & set(after)
    assert 0 < again["option_chain"] < whole["option_chain"] / 3
    expected = Strategies(chain.filter("symbol <> '007' OR strike < underlying_price"))
    for name, df in (("spreads", expected.spreads()), ("iron_condors", expected.iron_condors()),
                     ("calendars", expected.calendars()), ("max_pain", expected.max_pain())):
        back = load_dataset(spark, str(out), name)
        assert sorted(map(str, rows_of(back))) == sorted(map(str, rows_of(df))), name
    assert not list((out / "iron_condors").glob("symbol=007/*.parquet"))  # it has none any more
    assert load_statistics(spark, str(out)) is None


def test_chosen_symbols_are_the_only_folders_read(spark, tmp_path):
    rows = one_symbol(31)
    rows = rows + [r | {"symbol": f"T{i}"} for r in rows for i in range(5)]
    run_scan(spark, chain_from_rows(spark, rows), str(tmp_path), by_symbol=True)
    chain = load_dataset(spark, str(tmp_path), "option_chain")
    listed = screens.chain_list(chain, {"symbol": ["T1", "T3"]})
    assert "PartitionFilters: [symbol" in formatted_plan(listed).replace("\n", " ")
    table = spark.createDataFrame([("T1",), ("T3",), ("T1",), (None,)], "symbol string")
    table.write.parquet(str(tmp_path / "chosen"))
    chosen = spark.read.parquet(str(tmp_path / "chosen")).filter("symbol > 'T'")
    joined = screens.chain_list(chain, {"symbol": chosen})
    assert "dynamicpruning" in formatted_plan(joined)
    assert rows_of(joined) == rows_of(listed)
    assert screens.chain_list(chain, {"symbol": chosen.limit(0)}).count() == 0


def test_very_many_choices_are_a_table(spark):
    chain = chain_from_rows(spark, random_chain(31))
    some = spark.range(100_000).selectExpr("id / 2D AS strike")
    by_table = screens.choose(chain, ["strike"], {"strike": some})
    assert rows_of(by_table) == [r for r in rows_of(chain) if r["strike"] * 2 % 1 == 0]
    assert "LeftSemi" in formatted_plan(by_table)


# ---- landing


LINES = [
    '{"symbol":"AAA","expiration":"2026-05-15","strike":95.0,"right":"C","underlying_price":99.5,"dte":44,"mid":1.5}',
    '{"symbol":"AAA","expiration":"2026-05-15","strike":"ninety","right":"C","underlying_price":99.5,"dte":44}',
    '{"symbol":"AAA","expiration":"2026-05-15","stri',
    '{"expiration":"2026-05-15","strike":95.0,"right":"C","underlying_price":99.5,"dte":44}',
    '{"symbol":"AAA","expiration":"2026-05-15","strike":95.0,"right":"P","underlying_price":99.5,"dte":null}',
    '{"symbol":"AAA","expiration":"2026-05-15","strike":95.0,"right":"P","underlying_price":99.5,"dte":44,"_record":1}',
    "",
]


def test_bad_json_is_set_aside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part.json").write_text("\n".join(LINES))
    landed = read_landed(spark, str(tmp_path / "in"), CHAIN_SCHEMA, "json")
    assert [(r.strike, r.right, r.mid) for r in landed.good.collect()] == [(95.0, "C", 1.5), (95.0, "P", None)]
    assert landed.good.columns == CHAIN_SCHEMA.fieldNames()
    refused = sorted(map(tuple, landed.refused.collect()))
    assert [r for r, _ in refused] == ["dte missing", "symbol missing", "unreadable", "unreadable"]
    assert {LINES[1], LINES[2]} == {text for reason, text in refused if reason == "unreadable"}
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    for _ in range(2):
        assert landed.write(good, bad) == {"good": 2, "unreadable": 2, "symbol missing": 1, "dte missing": 1}
        assert spark.read.parquet(good).count() == 2 and spark.read.parquet(bad).count() == 4
    (tmp_path / "none").mkdir()
    assert read_landed(spark, str(tmp_path / "none"), CHAIN_SCHEMA, "json").write(good, bad) == {"good": 0}
    assert spark.read.parquet(bad).count() == 0


def test_bad_csv_is_set_aside(spark, tmp_path):
    (tmp_path / "in.csv").write_text("AAA,1,2.5\nBBB,x,2.5\nCCC,3\n,4,1.0\nDDD,5,\n")
    schema = "symbol string NOT NULL, poll int, bid double"
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL(schema)
    landed = read_landed(spark, str(tmp_path / "in.csv"), schema, "csv")
    assert sorted(map(tuple, landed.good.collect())) == [("AAA", 1, 2.5), ("DDD", 5, None)]
    assert sorted(map(tuple, landed.refused.collect())) == [
        ("symbol missing", '{"poll":4,"bid":1.0}'), ("unreadable", "BBB,x,2.5"), ("unreadable", "CCC,3")]


def test_missing_values_are_refused_in_every_format(spark, tmp_path):
    rows = spark.createDataFrame([("AAA", 1, 2.0), (None, 2, 1.0), ("BBB", None, 3.0)],
                                 "symbol string, poll int, bid double")
    rows.write.parquet(str(tmp_path / "in"))
    landed = read_landed(spark, str(tmp_path / "in"), POLL_SCHEMA, "parquet")
    assert [r.symbol for r in landed.good.collect()] == ["AAA"]
    assert sorted(r.reason for r in landed.refused.collect()) == ["poll missing", "symbol missing"]


def test_stage_lives_in_the_shared_folder(spark):
    stage = Stage(spark)
    assert stage.path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    stage.write("t", spark.range(3))
    assert stage.read("t").count() == 3


def test_landed_tables_to_datasets(spark, tmp_path):
    feed = ticks(
        spark,
        *(tick(k, r, symbol=s, bid=b) for s in ("AAA", "BBB") for r in "CP"
          for k, b in ((95.0, 2.0), (100.0, 1.5), (105.0, 1.0), (150.0, 0.1))),
        tick(expiry="20270115"),
    )
    polls = spark.createDataFrame(
        [(s, 1, 99.5, 100.5, None, None, None) for s in ("AAA", "BBB", "CCC")], POLL_SCHEMA)
    days, strikes = ["20260515", "20270115"], [95.0, 100.0, 105.0, 150.0]
    listings = spark.createDataFrame(
        [(s, "MAIN", days, strikes) for s in ("AAA", "BBB", "CCC")], LISTING_SCHEMA)
    for name, df in (("ticks", feed), ("polls", polls), ("listings", listings)):
        df.write.json(str(tmp_path / name))
    rows = main([
        *(a for n in ("ticks", "polls", "listings", "out") for a in (f"--{n}", str(tmp_path / n))),
        "--format", "json", "--exchange", "MAIN", "--as-of", "2026-04-01", "--symbols", " aaa,ccc",
    ])
    chain = load_dataset(spark, str(tmp_path / "out"), "option_chain").collect()
    assert sorted((r.symbol, r.strike, r.right, r.dte) for r in chain) == [
        ("AAA", k, r, 44) for k in (95.0, 100.0, 105.0) for r in "CP"]
    assert rows["option_chain"] == 6 and rows["expected_move"] == 1

    # Bad rows are set aside, and a second scan of other symbols leaves the first one's folders.
    (tmp_path / "ticks" / "bad.json").write_text('{"symbol":"BBB","strike":\n{"strike":1.0,"right":"C"}\n')
    out, refused = str(tmp_path / "folders"), str(tmp_path / "refused")
    for symbol in ("aaa", "bbb"):
        rows = main([
            *(a for n in ("ticks", "polls", "listings") for a in (f"--{n}", str(tmp_path / n))),
            "--out", out, "--refused", refused, "--by-symbol", "--format", "json",
            "--exchange", "MAIN", "--as-of", "2026-04-01", "--symbols", symbol,
        ])
        assert rows["option_chain"] == 6
    stored = load_dataset(spark, out, "option_chain")
    assert {(r.symbol, r["count"]) for r in stored.groupBy("symbol").count().collect()} == {("AAA", 6), ("BBB", 6)}
    reasons = sorted(r.reason for r in spark.read.parquet(f"{refused}/ticks").collect())
    assert reasons == ["symbol missing", "unreadable"]
    assert spark.read.parquet(f"{refused}/polls").count() == 0


def test_ticks_are_filtered_early_with_the_same_result(spark, tmp_path):
    feed = ticks(
        spark, *(tick(k, ts=t, bid=1.0 + t, expiry=e) for k in (80.0, 100.0, 120.0, 120.5)
                 for t in (1, 2) for e in ("20260508", "20260509", "20260523", "20260524")))
    feed.write.parquet(str(tmp_path / "ticks"))
    feed = spark.read.schema(TICK_SCHEMA).parquet(str(tmp_path / "ticks"))
    near = in_window(feed, Wanted(date(2026, 4, 1), "MAIN"))
    assert near.columns == feed.columns and near.count() == 4 * 2 * 2
    plan = formatted_plan(near)
    assert "GreaterThanOrEqual(lastTradeDateOrContractMonth,20260509)" in plan
    assert "Exchange hashpartitioning" not in plan


# ---- live


def land(spark, folder, *rows):
    ticks(spark, *rows).coalesce(1).write.mode("append").parquet(str(folder))


def drain(live, spark, folder):
    stream = spark.readStream.schema(TICK_SCHEMA).option("maxFilesPerTrigger", 1)
    query = live.writer(stream.parquet(str(folder))).trigger(availableNow=True).start()
    query.awaitTermination()


def quotes(df):
    return sorted((r.symbol, r.strike, r.right, r.ts, r.bid) for r in df.collect())


def test_stream_equals_batch_with_late_ticks_and_restart(spark, tmp_path):
    landing = tmp_path / "landing"
    seen = []
    live = LiveQuotes(
        spark, str(tmp_path / "live"), on_snapshot=lambda df, n: seen.append((n, df.count())))
    land(spark, landing, tick(ts=5, bid=5.0), tick(right="P", ts=1, bid=1.0))
    land(spark, landing, tick(ts=3, bid=3.0), tick(strike=105.0, ts=2, bid=2.0))
    drain(live, spark, landing)
    assert [n for n, _ in seen] == [0, 1] and seen[-1][1] == 3
    land(spark, landing, tick(right="P", ts=9, bid=9.0))
    resumed = LiveQuotes(spark, str(tmp_path / "live"))
    drain(resumed, spark, landing)
    batch = latest_quotes(spark.read.schema(TICK_SCHEMA).parquet(str(landing)))
    assert quotes(resumed.current()) == quotes(batch)
    assert [q[4] for q in quotes(batch)] == [5.0, 9.0, 2.0]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    live = LiveQuotes(spark, str(tmp_path))
    first, second = ticks(spark, tick(ts=1, bid=1.0)), ticks(spark, tick(ts=2, bid=2.0))
    live.merge(first, 0)
    live.merge(second, 1)
    once = quotes(live.current())
    live.merge(second, 1)
    assert quotes(live.current()) == once == [("AAA", 100.0, "C", datetime(2026, 4, 1, 10, 2), 2.0)]


def test_expired_contracts_drop_out(spark, tmp_path):
    live = LiveQuotes(spark, str(tmp_path), as_of=lambda: date(2026, 5, 15))
    live.merge(ticks(spark, tick(expiry="20260514"), tick(expiry="20260515")), 0)
    assert [r.lastTradeDateOrContractMonth for r in live.current().collect()] == ["20260515"]


def grid(*strikes, **more):
    return [tick(k, r, **more) for k in strikes for r in "CP"]


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    live = LiveQuotes(spark, str(tmp_path), n_buckets=32)
    symbols = [f"S{i:02}" for i in range(40)]
    live.merge(ticks(spark, *(t for s in symbols for t in grid(95.0, 100.0, symbol=s))), 0)
    first = live.table.manifest()
    files = files_under(tmp_path / "snapshot" / "data")
    live.merge(ticks(spark, tick(95.0, symbol="S07", ts=9, bid=9.0), tick(97.0, symbol="S07")), 1)
    second = live.table.manifest()
    bucket = {b for b in first.buckets if live.table.read(first, [b]).filter("symbol = 'S07'").count()}
    assert second.rewritten(first) == bucket and len(bucket) == 1 < len(first.buckets)
    now = files_under(tmp_path / "snapshot" / "data")
    assert {p: t for p, t in files.items() if f"/bucket={min(bucket)}/" not in p}.items() <= now.items()
    assert live.current().count() == 40 * 4 + 1
    assert live.current().filter("symbol = 'S07' AND bid = 9").count() == 1


def test_a_reader_sees_one_version_during_a_write(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), ["k"], n_buckets=4)
    rows = lambda n, v: spark.range(n).selectExpr("id AS k", f"{v} AS v")
    keep = lambda df: df.groupBy("k").agg({"v": "max"}).withColumnRenamed("max(v)", "v")
    table.upsert(rows(100, 1), 0, keep)
    reader = table.current()
    seen = []

    def settle(df):
        seen.append({r.v for r in table.current().collect()})  # another reader, while this version is made
        return keep(df)

    table.upsert(rows(50, 2), 1, settle)
    assert seen == [{1}]
    assert reader.agg({"v": "sum"}).first()[0] == 100  # still the version it has opened
    assert table.current().agg({"v": "sum"}).first()[0] == 150 and table.versions() == [0, 1]

    def fail(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.upsert(rows(100, 7), 2, fail)
    assert table.current().agg({"v": "sum"}).first()[0] == 150
    again = table.upsert(rows(100, 3), 2, keep)
    assert table.current().agg({"v": "sum"}).first()[0] == 300
    assert table.versions() == [1, 2]
    folders = {p.parent.parent.name for p in (tmp_path / "data").rglob("*.parquet")}
    kept = set(again.buckets.values()) | set(table.manifest(1).buckets.values())
    assert folders == kept  # what was cut off and what no kept version needs is gone
    assert table.upsert(rows(100, 9), 2, keep) == again
    assert table.upsert(rows(100, 9), 1, keep).version == 1
    assert table.current().agg({"v": "max"}).first()[0] == 3


def test_buckets_that_are_empty_leave_the_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), ["k"], n_buckets=3)
    rows = spark.range(20).selectExpr("id AS k")
    table.upsert(rows, 5, lambda df: df)
    table.upsert(rows, 6, lambda df: df.filter("false"))
    assert table.manifest().buckets == {} and table.current().count() == 0
    assert table.current().schema == rows.schema
    other = VersionedTable(spark, str(tmp_path), ["k"], n_buckets=50)
    assert other.upsert(rows, 7, lambda df: df.distinct()).n_buckets == 3
    assert other.current().count() == 20


def test_state_keeps_the_last_tick_and_forgets_old_windows(spark, tmp_path):
    landing = tmp_path / "landing"
    progress = []

    def run(folder, delay):
        stream = spark.readStream.schema(TICK_SCHEMA).option("maxFilesPerTrigger", 1)
        stream = stream.parquet(str(landing))
        live = LiveQuotes(spark, str(folder))
        kept = latest_in_state(stream, ["ts"], delay=delay, window="10 minutes")
        query = live.writer(kept, "update").trigger(availableNow=True).start()
        query.awaitTermination()
        progress[:] = [o for p in query.recentProgress for o in p.stateOperators]
        return live.current()

    land(spark, landing, tick(ts=5, bid=5.0), tick(right="P", ts=1, bid=1.0))
    land(spark, landing, tick(ts=3, bid=3.0), tick(strike=105.0, ts=52, bid=2.0))
    land(spark, landing, tick(ts=49, bid=9.0))
    land(spark, landing, tick(right="P", ts=4, bid=4.0), tick(ts=58, bid=8.0))
    batch = latest_quotes(spark.read.schema(TICK_SCHEMA).parquet(str(landing)))
    assert quotes(run(tmp_path / "patient", "1 hour")) == quotes(batch)
    assert [q[4] for q in quotes(batch)] == [8.0, 4.0, 2.0]
    assert sum(p.numRowsDroppedByWatermark for p in progress) == 0
    # A short delay drops the put's late tick and lets the windows of the first minutes go.
    hasty = quotes(run(tmp_path / "hasty", "5 minutes"))
    assert [q[4] for q in hasty] == [8.0, 1.0, 2.0]
    assert sum(p.numRowsDroppedByWatermark for p in progress) == 1
    assert progress[-1].numRowsTotal < 5


def test_no_snapshot_yet(spark, tmp_path):
    with pytest.raises(ValueError, match="no snapshot"):
        LiveQuotes(spark, str(tmp_path)).current()


def test_state_is_on_disk_in_partitions_sized_by_the_ticks(spark, tmp_path):
    landing, folder = tmp_path / "landing", tmp_path / "live"
    land(spark, landing, tick(ts=5, bid=5.0), tick(right="P", ts=1, bid=1.0))
    land(spark, landing, tick(ts=3, bid=3.0), tick(strike=105.0, ts=2, bid=2.0))
    stream = spark.readStream.schema(TICK_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(landing))
    live = LiveQuotes(spark, str(folder))
    kept = latest_in_state(stream, ["ts"], delay="1 hour", window="10 minutes")
    session = dict(spark.conf.getAll)
    with state_sized_for(spark, 5 * STATE_PARTITION_BYTES + 1) as partitions:
        query = live.writer(kept, "update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert partitions == 6 and dict(spark.conf.getAll) == session
    assert quotes(live.current()) == quotes(latest_quotes(spark.read.schema(TICK_SCHEMA).parquet(str(landing))))
    operators = [o for p in query.recentProgress for o in p.stateOperators]
    assert {o.numShufflePartitions for o in operators} == {6}
    assert all(any(m.startswith("rocksdb") for m in o.customMetrics) for o in operators)
    with state_sized_for(spark, 1) as partitions:  # never fewer than the session shuffles to
        assert partitions == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_the_registered_state_is_on_disk(spark, tmp_path, monkeypatch):
    import __spark_entry__ as e
    found = []
    awaited = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda q: (
        awaited(q), found.extend(o for p in q.recentProgress for o in p.stateOperators)))
    feed = ticks(spark, tick(ts=5, bid=5.0), tick(right="P", ts=1, bid=1.0))
    feed = feed.withColumn("sequence", F.struct(F.lit(1).alias("l_orderkey")))
    tables = e.Tables(spark, str(tmp_path))
    monkeypatch.setattr(tables, "ticks", lambda dealt: feed)
    assert e.replay(tables, in_state=True).current().count() == 2
    assert found and all(any(m.startswith("rocksdb") for m in o.customMetrics) for o in found)


def test_a_merge_shuffles_stored_rows_once(spark, tmp_path, monkeypatch):
    plans, unexpired = [], live_module._unexpired

    def seen(rows, today):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return unexpired(rows, today)

    live = LiveQuotes(spark, str(tmp_path), n_buckets=3)
    stored, written = live_module.VersionedTable._store, []
    monkeypatch.setattr(live_module, "_unexpired", seen)
    monkeypatch.setattr(live_module.VersionedTable, "_store", lambda table, rows, *more: (
        written.append(rows), stored(table, rows, *more)))
    symbols = [f"S{i}" for i in range(9)]
    old = [t for s in symbols for t in grid(95.0, 100.0, symbol=s, ts=2)]
    new = [t for s in symbols[:5] for t in grid(95.0, 105.0, symbol=s, ts=3, bid=9.0)]
    late = [t for s in symbols for t in grid(100.0, symbol=s, ts=1, bid=7.0)]
    live.merge(ticks(spark, *old), 0)
    live.merge(ticks(spark, *new, *late), 1)
    assert all(p.count("Exchange hashpartitioning(") == 1 for p in plans)
    assert all("Exchange hashpartitioning(bucket" in p for p in plans) and len(plans) == 2
    assert "bucket" in written[1].columns and "bucket" in written[3].columns  # not dealt again
    assert quotes(live.current()) == quotes(latest_quotes(ticks(spark, *old, *new, *late)))
    assert "bucket" not in live.current().columns


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def test_new_rows_are_dealt_once(spark, tmp_path, monkeypatch):
    dealt, deal = [], VersionedTable._deal
    monkeypatch.setattr(VersionedTable, "_deal", lambda table, rows, n: (
        dealt.append(rows), deal(table, rows, n))[1])
    live = LiveQuotes(spark, str(tmp_path), n_buckets=3)
    live.merge(ticks(spark, *grid(95.0, 100.0, ts=2)), 0)
    live.merge(ticks(spark, *grid(100.0, ts=1), *grid(105.0, symbol="BBB"), tick(ts=3, bid=9.0)), 1)
    live.merge(ticks(spark), 2)
    assert len(dealt) == 3
    assert live.current().count() == 6 and live.current().filter("bid = 9").count() == 1
    assert not list((tmp_path / "snapshot" / "data").glob("*-new-*"))


def test_what_the_state_hands_over_is_stored_without_a_shuffle(spark, tmp_path, monkeypatch):
    landing, stored, plans = tmp_path / "landing", VersionedTable._store, []
    monkeypatch.setattr(VersionedTable, "_store", lambda table, rows, *more: (
        plans.append(rows._jdf.queryExecution().executedPlan().toString()), stored(table, rows, *more)))
    # One contract in two windows of a batch, one of them older than what is stored.
    land(spark, landing, tick(ts=15, bid=5.0), tick(right="P", ts=31, bid=1.0))
    land(spark, landing, tick(ts=58, bid=8.0), tick(ts=3, bid=3.0), tick(right="P", ts=2, bid=2.0),
         tick(right="P", ts=14, bid=4.0))
    stream = spark.readStream.schema(TICK_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(landing))
    live = LiveQuotes(spark, str(tmp_path / "live"))
    kept = latest_in_state(stream, ["ts"], delay="1 hour", window="10 minutes")
    live.writer(kept, "update").trigger(availableNow=True).start().awaitTermination()
    assert quotes(live.current()) == quotes(latest_quotes(spark.read.schema(TICK_SCHEMA).parquet(str(landing))))
    assert [q[4] for q in quotes(live.current())] == [8.0, 1.0]
    assert len(plans) >= 4 and not any("Exchange" in p for p in plans[::2])


def test_the_registered_state_leaves_no_shuffles_and_no_landed_copy(spark, tmp_path, monkeypatch):
    import __spark_entry__ as e
    feed = ticks(spark, *(tick(k, ts=5, bid=k) for k in (95.0, 100.0)))
    years = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("year")
    feed = feed.select("*", years).withColumn("ts", F.expr("ts + make_interval(year)")).drop("year")
    feed = feed.withColumn("sequence", F.struct(F.lit(1).alias("l_orderkey"))).repartition(1)
    tables = e.Tables(spark, str(tmp_path))
    monkeypatch.setattr(tables, "ticks", lambda dealt: feed)
    before, between, measured = set(), [], e.folder_bytes
    monkeypatch.setattr(e, "folder_bytes", lambda *landing: (  # what landing the ticks has shuffled
        before.update(shuffle_files(spark)), measured(*landing))[1])
    stages = set(Path(shared_folder(spark)).glob("stage-*"))
    live = e.replay(
        tables, lambda df, n: (df.count(), between.append(shuffle_files(spark) - before)), in_state=True)
    for _ in range(100):  # removed in the background
        left = [f for f in shuffle_files(spark) - before if Path(f).exists()]
        if not left:
            break
        time.sleep(0.1)
    assert len(between) >= 4 and any(between)  # there were shuffles
    assert not left
    (folder,) = set(Path(shared_folder(spark)).glob("stage-*")) - stages
    assert len(list((folder / "landing").glob("*.parquet"))) < 6
    assert {(r.strike, r.ts.year) for r in live.current().collect()} == {(95.0, 2031), (100.0, 2031)}


def test_buckets_grow_with_the_landed_ticks(spark, tmp_path, monkeypatch):
    import __spark_entry__ as e
    assert buckets_for(1) == 64 and buckets_for(100 * BUCKET_BYTES + 1) == 101
    monkeypatch.setattr(e, "folder_bytes", lambda *_: 70 * BUCKET_BYTES)
    feed = ticks(spark, *(tick(symbol=f"S{i}", bid=float(i)) for i in range(40)))
    feed = feed.withColumn("sequence", F.struct(F.lit(1).alias("l_orderkey")))
    tables = e.Tables(spark, str(tmp_path))
    monkeypatch.setattr(tables, "ticks", lambda dealt: feed)
    live = e.replay(tables, in_state=True)
    assert live.table.manifest().n_buckets == 70
    assert sorted(r.bid for r in live.current().collect()) == [float(i) for i in range(40)]
