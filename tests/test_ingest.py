import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import ingest
from conftest import bar_rows
from tidemark.config import QualityRules
from tidemark.operators import ingest as I
from tidemark.operators import quality as Q
from tidemark.operators import timeline as T
from tidemark.plans.collect import collect, run_collection
from tidemark.schema import BARS, METADATA
from tidemark.sources import tables as S
from tidemark.sources.bars import make_bars, packed_order

D = dt.date


def test_densify_fills_gaps_with_null_rows(spark):
    rows = [r for r in bar_rows("A", [1.0, 2.0, 3.0, 4.0, 5.0]) if r[0].day in (1, 3, 5)]
    got = T.densify(spark.createDataFrame(rows, BARS)).orderBy("date").collect()
    assert [r.date.day for r in got] == [1, 2, 3, 4, 5]
    assert [r.close for r in got] == [1.0, None, 3.0, None, 5.0]
    filled = T.densify(spark.createDataFrame(rows, BARS), fill=True).orderBy("date").collect()
    assert [r.close for r in filled] == [1.0, 1.0, 3.0, 3.0, 5.0]


def test_densify_leaves_out_symbols_with_a_repeated_day(spark):
    rows = bar_rows("A", [1.0, 2.0]) + bar_rows("B", [1.0]) * 2 + bar_rows("C", [7.0])
    bars = spark.createDataFrame(rows, BARS)
    assert {r.symbol for r in T.densify(bars).collect()} == {"A", "C"}
    status = {r.symbol: r.timeline_ok for r in T.timeline_status(bars).collect()}
    assert status == {"A": True, "B": False, "C": True}


def test_calendar_parts_and_horizon(spark, make_panel):
    panel = make_panel({"A": [100.0, 101.0, 102.0]})
    first = T.filled_panel(panel).orderBy("date").first()
    assert (first.day_of_week, first.day_of_year, first.month) == (7, 1, 1)
    assert T.within_horizon(panel, 1).count() == 2
    assert T.within_horizon(panel, 0).count() == 3
    assert T.within_horizon(panel.limit(0), 5).count() == 0


@pytest.mark.parametrize(
    "change, check",
    [
        ({"low": -1.0}, "price_positivity"),
        ({"high": 1.0}, "high_low_consistency"),
        ({"volume": -5}, "volume_non_negative"),
        ({"close": 500.0}, "ohlc_relationships"),
        ({"open": 1.0}, "ohlc_relationships"),
    ],
)
def test_quality_names_the_failed_check(spark, change, check):
    rows = bar_rows("A", [100.0, 101.0, 102.0])
    bad = dict(zip(BARS.names, rows[1])) | change
    rows[1] = tuple(bad[n] for n in BARS.names)
    result = Q.quality_report(spark.createDataFrame(rows, BARS)).first()
    assert check in result.failed_checks and not result.is_valid
    assert result.validation_details[check] is False
    assert result.rows_with_issues >= 1


def test_quality_extreme_move_and_all_null_column(spark):
    rows = bar_rows("A", [1.0, 20.0, 20.5])
    result = Q.quality_report(spark.createDataFrame(rows, BARS)).first()
    assert result.failed_checks == ["extreme_price_movements"]
    assert result.warnings == ["Extreme price movement on 2023-01-02: 1900.0% change"]
    text = Q.quality_summary(Q.quality_report(spark.createDataFrame(rows, BARS))).first().summary
    assert "Status: FAILED" in text and "    - Extreme" in text
    empty = [(r[0], r[1], r[2], r[3], r[4], None, r[6]) for r in rows]
    result = Q.quality_report(spark.createDataFrame(empty, BARS)).first()
    assert result.failed_checks == ["required_columns"] and result.rows_with_issues == 0
    assert Q.quality_gate(spark.createDataFrame(rows, BARS)).count() == 0
    keep = Q.quality_gate(spark.createDataFrame(rows, BARS), QualityRules(on_failure="warn"))
    assert keep.count() == 3


def test_quality_gate_query_returns_whole_rows(spark):
    sf = "/root/testdata/sf0.001"
    kept = Q.quality_gate(T.densify(ingest.mixed_bars(spark, sf)))
    got = ingest.quality_gate(spark, sf)
    assert got.columns == ["symbol", "date", "open", "high", "low", "close", "volume"]
    key = lambda r: (r.symbol, str(r.date))
    assert sorted(map(key, got.collect())) == sorted(map(key, kept.collect()))
    assert got.count() > got.select("symbol").distinct().count() > 0


def test_summary_counts_the_merged_history_without_moving_it(spark):
    tickers = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    bars = bar_rows("A", [1.0, 1.1, 1.2, 1.3], D(2023, 1, 5)) + bar_rows("B", [1.0, 2.0]) * 2
    offered = [r for r in bars if r[0].day != 7]
    # before, in a gap of, and behind the new days; a repeated row; a symbol without new days, one without a date
    old = bar_rows("A", [2.0] * 7, D(2023, 1, 3)) + bar_rows("A", [2.5], D(2023, 1, 3)) + bar_rows("C", [3.0, 3.1])
    old.append((None, "A", 1.0, 1.0, 1.0, 1.0, 1))
    done = collect(
        tickers, spark.createDataFrame([], METADATA), spark.createDataFrame(offered, BARS),
        spark.createDataFrame(old, BARS), D(2023, 2, 1),
    )
    got = done.summary.first()
    assert got.new_records == done.accepted.count() == 4 and got.symbols_updated == 1
    assert got.total_records == done.history.count() == 10
    assert "_src" in done.history._jdf.queryExecution().optimizedPlan().toString()
    assert "_src" not in done.summary.select("total_records")._jdf.queryExecution().optimizedPlan().toString()


def test_plans(spark):
    tickers = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    meta = spark.createDataFrame(
        [("A", D(2023, 1, 1), None, "data_issue"), ("A", D(2023, 1, 5), None, "active"),
         ("B", D(2023, 1, 5), None, "collection_issue")], METADATA)
    got = {r.symbol: (r.period, r.start) for r in I.collection_plan(tickers, meta).collect()}
    assert got == {"A": (None, "2023-01-06"), "C": ("max", None)}
    assert [r.symbol for r in I.skipped_tickers(tickers, meta).collect()] == ["B"]


def test_plan_rules(spark):
    schema = "symbol string, start string, end string, interval string, period string"
    rows = [
        ("ok", "2023-01-01", "2023-02-01", None, None),
        ("none", None, None, None, None),
        ("both", "2023-01-01", None, None, "max"),
        ("order", "2023-02-01", "2023-01-01", None, None),
        ("format", "01/02/2023", None, None, None),
        ("interval", "2023-01-01", "2023-02-01", "1d", None),
        ("enum", None, None, "4h", "7y"),
    ]
    got = {r.symbol: r.violations for r in I.validate_plans(spark.createDataFrame(rows, schema)).collect()}
    assert got["ok"] == []
    assert got["none"] == ["no_parameter", "start_or_period_required"]
    assert got["both"] == ["start_and_period"]
    assert got["order"] == ["start_not_before_end"]
    assert got["format"] == ["start_format"]
    assert got["interval"] == ["interval_with_start_and_end"]
    assert got["enum"] == ["unknown_interval", "unknown_period"]
    assert I.period_start("1mo", D(2023, 3, 31)) == D(2023, 2, 28)
    assert I.period_start("ytd", D(2023, 3, 31)) == D(2023, 1, 1)
    assert I.period_start("max", D(2023, 3, 31)) is None


def test_upsert_history_new_row_wins_whole(spark):
    old = spark.createDataFrame(bar_rows("A", [1.0, 2.0]), BARS)
    new = [(D(2023, 1, 2), "A", None, 9.0, 8.0, 8.5, 7)]
    got = I.upsert_history(old, spark.createDataFrame(new, BARS)).orderBy("date").collect()
    assert len(got) == 2 and got[1].open is None and got[1].close == 8.5


def test_run_collection_is_incremental(spark, tmp_path):
    meta, hist = str(tmp_path / "meta"), str(tmp_path / "hist")
    tickers = spark.createDataFrame([("A",), ("B",), ("Z",)], "symbol string")
    source = spark.createDataFrame(bar_rows("A", [100.0, 101.0]) + bar_rows("B", [1.0, 50.0]), BARS)
    one = run_collection(spark, tickers, source, meta, hist, D(2023, 1, 2)).first()
    assert (one.tickers_processed, one.successful_collections, one.new_records) == (3, 1, 2)
    status = {r.symbol: r.status for r in S.read_metadata(spark, meta).collect()}
    assert status == {"A": "active", "B": "data_quality_issue", "Z": "collection_issue"}
    source = spark.createDataFrame(bar_rows("A", [100.0, 101.0, 102.0, 103.0]), BARS)
    two = run_collection(spark, tickers, source, meta, hist, D(2023, 1, 4)).first()
    assert (two.tickers_processed, two.new_records, two.total_records) == (1, 2, 4)
    assert S.read_bars(spark, hist).count() == 4


def test_table_readers(spark, tmp_path):
    assert S.read_metadata(spark, str(tmp_path / "absent")).count() == 0
    assert S.join_path("s3://b/x/", "/f.csv") == "s3://b/x/f.csv"
    (tmp_path / "t.csv").write_text("Symbol,Name\nA,x\n")
    with pytest.raises(ValueError):
        S.read_tickers(spark, str(tmp_path / "t.csv"))
    head = "Symbol,Name,Country,IPO Year,Sector,Industry,Extra\n"
    (tmp_path / "u.csv").write_text(head + "A,x,US,1999,T,S,9\n")
    assert "ipo_year" in S.read_tickers(spark, str(tmp_path / "u.csv")).columns
    with pytest.raises(ValueError):
        S.read_labelled(spark, str(tmp_path / "absent"))


def test_cast_failures_are_flagged(spark):
    raw = spark.createDataFrame(
        [("2023-01-01", "A", "1.5", 2.0, 1.0, 1.2, "x")],
        "date string, symbol string, open string, high double, low double, close double, volume string",
    )
    row = S.enforce_schema(raw).first()
    assert row._cast_failed and row.open == 1.5 and row.date == D(2023, 1, 1) and row.volume is None


def test_bars_open_and_close_follow_the_total_order(spark):
    rows = [("A", dt.datetime(2023, 1, 1, 10), 2, 5.0), ("A", dt.datetime(2023, 1, 1, 10), 1, 4.0),
            ("A", dt.datetime(2023, 1, 1, 15), 0, 9.0), ("A", dt.datetime(2023, 1, 2, 9), 0, 3.0)]
    t = spark.createDataFrame(rows, "s string, ts timestamp, id int, p double")
    args = dict(symbol="s", ts="ts", price="p", quantity=F.lit(1), tie_break=["id"])
    day = make_bars(t, **args).orderBy("date").first()
    assert (day.open, day.high, day.low, day.close, day.volume) == (4.0, 9.0, 4.0, 9.0, 3)
    assert make_bars(t, **args, interval="1h").count() == 3
    assert make_bars(t, **args, start="2023-01-02").count() == 1
    with pytest.raises(ValueError):
        make_bars(t, **args, interval="7m")


@pytest.mark.parametrize("zoned", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("interval", ["5m", "1h", "5d", "1d", "1wk", "1mo", "3mo"])
def test_packed_order_gives_the_bars_of_the_struct(spark, monkeypatch, zoned, interval):
    rng = np.random.default_rng(7)
    base = dt.datetime(2023, 2, 27, 22)
    at = [base + dt.timedelta(microseconds=int(x)) for x in rng.integers(0, 40 * 86_400, 40) * 1_000_000]
    ids = [-(2**63), 2**63 - 1, 0, -1, None]
    rows = []
    for i in range(600):
        j = int(rng.integers(0, 40))
        late = dt.timedelta(microseconds=int(rng.integers(0, 3)))
        # ids differ within an instant unless a short tells them apart; None is the least of both
        rows.append((None if i % 97 == 0 else f"S{i % 3}", None if i % 89 == 0 else at[j] + late,
                     ids[i % 5] if i % 2 else i, None if i == 5 else i % 30_000 - 15_000, float(i)))
    t = spark.createDataFrame(rows, f"s string, ts {zoned}, id long, leg short, p double")
    args = dict(symbol="s", ts="ts", price="p", quantity=F.lit(1), tie_break=["id", "leg"], interval=interval)
    packed = make_bars(t, **args)
    plan = packed._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan
    with monkeypatch.context() as m:
        m.setattr("tidemark.sources.bars.packed_order", lambda *x: None)
        struct = make_bars(t, **args)
    assert "SortAggregate" in struct._jdf.queryExecution().sparkPlan().toString()
    got, want = packed.collect(), struct.collect()
    assert len(got) == len(want) and sorted(map(repr, got)) == sorted(map(repr, want))
    assert packed.where(F.lit(False)).count() == 0


def test_orders_that_do_not_fit_a_number_stay_structs(spark):
    t = spark.createDataFrame([], "ts timestamp, a long, b long, c string, d int, e date")
    fits = lambda *ties, ts="ts": packed_order(t.schema, ts, list(ties), "1d") is not None
    assert fits("a") and fits("d") and fits("d", "d")
    assert not fits("a", "b") and not fits("c") and not fits("a", ts="e") and not fits("missing")


@pytest.mark.parametrize("crash", ["while writing", "between the renames"])
def test_a_broken_overwrite_loses_no_history(spark, tmp_path, make_panel, crash):
    path = str(tmp_path / "history")
    old = make_panel({"A": [1.0, 2.0, 3.0]})
    S.overwrite_parquet(old, path)
    (tmp_path / "history.staging-x").mkdir()
    if crash == "between the renames":
        (tmp_path / "history").rename(tmp_path / "history.previous-x")
    assert S.read_bars(spark, path).count() == 3
    S.overwrite_parquet(S.read_bars(spark, path).where("close > 1"), path)
    assert S.read_bars(spark, path).count() == 2
    assert not list(tmp_path.glob("history.previous-*"))
    assert S.read_bars(spark, str(tmp_path / "none")).isEmpty()


def test_high_water_marks_and_few_symbols_reach_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "bars")
    rows = [r for s in "ABC" for r in bar_rows(s, [1.0 + i for i in range(30)])]
    spark.createDataFrame(rows, BARS).write.parquet(path)
    source = spark.read.parquet(path)
    plan = lambda rows: spark.createDataFrame(rows, "symbol string, start string, period string")

    def scanned(plans):
        pruned = I.prune_source(source, plans)
        pruned.explain("formatted")
        kept = I.planned_rows(pruned, plans)
        assert kept.exceptAll(I.planned_rows(source, plans)).isEmpty() and kept.count() == I.planned_rows(source, plans).count()
        return next(x for x in capsys.readouterr().out.splitlines() if "PushedFilters" in x)

    both = scanned(plan([("A", "2023-01-20", None), ("B", "2023-01-25", None)]))
    assert "GreaterThanOrEqual(date,2023-01-20)" in both and "In(symbol, [A,B])" in both
    # a symbol without a start asks for everything
    open_start = scanned(plan([("A", "2023-01-20", None), ("C", None, "max")]))
    assert "date" not in open_start and "In(symbol, [A,C])" in open_start
    assert I.planned_rows(I.prune_source(source, plan([])), plan([])).count() == 0
