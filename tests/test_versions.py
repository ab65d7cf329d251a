"""Versioned history: what a change touches, what a broken one leaves, what readers see."""

import datetime as dt
from pathlib import Path

import pytest

from conftest import bar_rows
from tidemark.config import QualityRules
from tidemark.operators.ingest import upsert_history
from tidemark.plans.collect import run_collection
from tidemark.schema import BARS
from tidemark.sources import tables as S
from tidemark.sources import versions as V

D = dt.date


def bars(spark, symbol, closes, start):
    return spark.createDataFrame(bar_rows(symbol, closes, start), BARS)


def upsert(spark, path, new):
    return V.upsert(spark, path, new, upsert_history)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("data/*/*/*.parquet")}


def closes(df):
    return sorted((r.symbol, r.date, r.close) for r in df.collect())


def test_one_new_day_rewrites_one_month(spark, tmp_path):
    path = str(tmp_path / "h")
    one = upsert(spark, path, bars(spark, "A", [float(i) for i in range(1, 100)], D(2023, 1, 1)))
    assert one.number == 1 and one.total == 99 and sorted(one.months) == ["2023-01", "2023-02", "2023-03", "2023-04"]
    before = files(path)
    two = upsert(spark, path, bars(spark, "A", [7.5, 8.5], D(2023, 4, 9)))
    after = files(path)
    assert {k: after[k] for k in before} == before
    assert {k.split("/")[2] for k in set(after) - set(before)} == {"month=2023-04"}
    assert {m for m in one.months if one.months[m] != two.months[m]} == {"2023-04"}
    assert two.total == 100 == V.read(spark, path).count()
    got = closes(V.read(spark, path))
    assert got[98:] == [("A", D(2023, 4, 9), 7.5), ("A", D(2023, 4, 10), 8.5)]
    # a reader that pinned the first version still sees it, whole or by month
    assert V.read(spark, path, one).count() == 99
    assert V.read(spark, path, V.version(spark, path, 1), ["2023-02", "2030-01"]).count() == 28
    assert upsert(spark, path, bars(spark, "A", [], D(2023, 1, 1))) == two


@pytest.mark.parametrize("step", ["_write", "_publish", "rename"])
def test_a_kill_between_any_two_steps_leaves_a_readable_version(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "h")
    upsert(spark, path, bars(spark, "A", [1.0, 2.0], D(2023, 1, 31)))
    want = closes(V.read(spark, path))

    class Killed(Exception):
        pass

    def broken(*args):
        if step == "_write":
            real["_write"](*args)
        raise Killed

    real = {"_write": V._write}
    if step == "rename":
        # the draft is written whole, but not yet in place
        manifests = Path(path) / "manifests"
        (manifests / ".draft-x").write_text("{")
    else:
        monkeypatch.setattr(V, step, broken)
        with pytest.raises(Killed):
            upsert(spark, path, bars(spark, "A", [9.0], D(2023, 2, 1)))
        monkeypatch.undo()
    assert closes(V.read(spark, path)) == want == closes(S.read_bars(spark, path))
    assert upsert(spark, path, bars(spark, "A", [9.0], D(2023, 2, 1))).number == 2
    assert closes(V.read(spark, path))[1] == ("A", D(2023, 2, 1), 9.0)


def test_the_second_of_two_writers_fails_and_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    upsert(spark, path, bars(spark, "A", [1.0], D(2023, 1, 1)))
    write = V._write

    def late(df, where):
        done = write(df, where)
        monkeypatch.setattr(V, "_write", write)
        upsert(spark, path, bars(spark, "B", [5.0], D(2023, 1, 1)))
        return done

    monkeypatch.setattr(V, "_write", late)
    with pytest.raises(V.Conflict):
        upsert(spark, path, bars(spark, "A", [3.0], D(2023, 1, 2)))
    assert closes(V.read(spark, path)) == [("A", D(2023, 1, 1), 1.0), ("B", D(2023, 1, 1), 5.0)]
    assert V.numbers(spark, path) == [1, 2]


def test_files_are_ordered_and_skipped_by_symbol(spark, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "h")
    rows = [r for s in "ABCDEFGH" for r in bar_rows(s, [1.0 + i for i in range(20)])]
    upsert(spark, path, spark.createDataFrame(rows, BARS).repartition(3))
    held = {}
    for p in Path(path).rglob("*.parquet"):
        table = pq.read_table(str(p), partitioning=None)
        keys = list(zip(table["symbol"].to_pylist(), table["date"].to_pylist()))
        assert keys == sorted(keys)
        group = pq.ParquetFile(str(p)).metadata.row_group(0)
        stats = group.column(table.schema.names.index("symbol")).statistics
        held[p] = (stats.min, stats.max)
    assert len(held) == 4
    for symbol in "ABCDEFGH":
        assert sum(low <= symbol <= high for low, high in held.values()) <= 2


def test_vacuum_keeps_what_kept_versions_need(spark, tmp_path):
    path = str(tmp_path / "h")
    for i in range(4):
        upsert(spark, path, bars(spark, "A", [float(i)] * 40, D(2023, 1, 1 + i)))
    want = closes(V.read(spark, path))
    assert V.vacuum(spark, path, keep=2) > 0
    assert V.numbers(spark, path) == [3, 4]
    assert closes(V.read(spark, path)) == want
    assert V.read(spark, path, V.version(spark, path, 3)).count() == 42
    assert V.vacuum(spark, path, keep=2) == 0
    with pytest.raises(ValueError):
        V.version(spark, path, 1)
    with pytest.raises(ValueError):
        V.vacuum(spark, path, keep=0)


def test_a_plain_table_is_taken_over_and_later_runs_touch_new_months_only(spark, tmp_path):
    meta, hist = str(tmp_path / "meta"), str(tmp_path / "hist")
    old = bar_rows("A", [10.0 + i for i in range(60)])
    S.overwrite_parquet(spark.createDataFrame(old, BARS), hist)
    tickers = spark.createDataFrame([("A",)], "symbol string")
    source = spark.createDataFrame(old + bar_rows("A", [70.0, 71.0], D(2023, 3, 2)), BARS)
    rules = QualityRules(extreme_price_movements=False)
    first = run_collection(spark, tickers, source, meta, hist, D(2023, 3, 3), rules).first()
    assert first.total_records == 62 == S.read_bars(spark, hist).count()
    one = V.version(spark, hist)
    later = spark.createDataFrame(bar_rows("A", [72.0], D(2023, 3, 4)), BARS)
    second = run_collection(spark, tickers, later, meta, hist, D(2023, 3, 4), rules).first()
    assert (second.new_records, second.total_records) == (1, 63)
    two = V.version(spark, hist)
    assert two.months["2023-01"] == one.months["2023-01"] and two.months["2023-03"] != one.months["2023-03"]
    with pytest.raises(ValueError):
        upsert(spark, hist, spark.createDataFrame([(None, "A", 1.0, 1.0, 1.0, 1.0, 1)], BARS))
