"""History as versions: month folders that never change, and manifests that say which belong together.

A change writes new folders for the months it touches, then publishes a manifest with
the next number. Readers take one manifest and see its folders only, so they are not disturbed by
later changes; a job that ends before its manifest is in place has changed nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import BAR_COLUMNS
from tidemark.schema import BARS
from tidemark.session import shuffle_partitions

#: Rows of one file, about; a month of few rows is one file.
FILE_ROWS = 2_000_000


class Conflict(RuntimeError):
    """Another writer published the version that this one was to become."""


@dataclass(frozen=True)
class Version:
    """`months` maps a month (2023-01) to its folder, `rows` to its number of rows."""

    number: int = 0
    months: dict[str, str] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)

    @property
    def total(self) -> int:
        return sum(self.rows.values())


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _manifests(path: str) -> str:
    return f"{path.rstrip('/')}/manifests"


def _data(path: str) -> str:
    return f"{path.rstrip('/')}/data"


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Published versions, ascending."""
    fs, folder = _hadoop(spark, _manifests(path))
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n[0].isdigit())


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A published version, by default the newest; an empty one if there is none."""
    known = numbers(spark, path)
    if number is None and not known:
        return Version()
    number = known[-1] if number is None else number
    if number not in known:
        raise ValueError(f"{path} has no version {number}")
    fs, p = _hadoop(spark, f"{_manifests(path)}/{number:012d}.json")
    stream = fs.open(p)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return Version(**json.loads(text))


def _publish(spark: SparkSession, path: str, new: Version) -> None:
    """Put the manifest in place whole, or fail if its number is taken."""
    jvm = spark._jvm
    fs, draft = _hadoop(spark, f"{_manifests(path)}/.draft-{uuid.uuid4().hex}")
    fs.mkdirs(draft.getParent())
    stream = fs.create(draft, False)
    try:
        stream.write(json.dumps(new.__dict__).encode())
    finally:
        stream.close()
    _, target = _hadoop(spark, f"{_manifests(path)}/{new.number:012d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration()
    )
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(target):
            raise Conflict(f"version {new.number} of {path} was published meanwhile") from e
        raise


def read(spark: SparkSession, path: str, at: Version | None = None, months: list[str] | None = None) -> DataFrame:
    """Bars of one version (the newest), or of some of its months only; other folders are never listed."""
    at = version(spark, path) if at is None else at
    wanted = sorted(at.months if months is None else set(months) & set(at.months))
    if not wanted:
        return spark.createDataFrame([], BARS)
    folders = [f"{_data(path)}/{at.months[m]}" for m in wanted]
    return spark.read.schema(BARS).parquet(*folders).select(*BAR_COLUMNS)


def month_of(column: str = "date"):
    return F.date_format(column, "yyyy-MM")


def _write(df: DataFrame, path: str) -> tuple[dict[str, str], dict[str, int]]:
    """New folders for the rows' months, laid out and sorted by (symbol, date) within each.

    Ranges of (month, symbol, date) are sampled, so a month or symbol with most rows spreads over
    several tasks, and each file holds a narrow range: its minima and maxima let reads by
    symbol skip it.
    """
    spark = df.sparkSession
    commit = uuid.uuid4().hex
    order = ["month", "symbol", "date"]
    laid = df.withColumn("month", month_of()).repartitionByRange(shuffle_partitions(spark), *order)
    laid.sortWithinPartitions(*order).write.partitionBy("month").option(
        "maxRecordsPerFile", FILE_ROWS
    ).parquet(f"{_data(path)}/{commit}")
    written = spark.read.parquet(f"{_data(path)}/{commit}")
    counts = written.groupBy(F.col("month").cast("string").alias("month")).count().collect()
    rows = {r["month"]: r["count"] for r in counts}
    return {m: f"{commit}/month={m}" for m in rows}, rows


def upsert(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    base: DataFrame | None = None,
) -> Version:
    """Publish the next version: `merge` of the newest one's bars and the `new` ones.

    Only the months that `new` touches are read and written. Rows without a date raise: they
    belong to no month. `base` are bars that a table without any version begins with. `new`
    must be stored, as it is read twice. If another writer publishes first this raises
    Conflict and the table is as that writer left it.
    """
    at = version(spark, path)
    touched = {r["m"] for r in new.select(month_of().alias("m")).distinct().collect()}
    if None in touched:
        raise ValueError("bars without a date cannot be stored")
    first = at.number == 0 and base is not None
    if not touched and not first:
        return at
    old = base if first else read(spark, path, at, sorted(touched))
    months, rows = _write(merge(old, new), path)
    after = Version(at.number + 1, {**at.months, **months}, {**at.rows, **rows})
    _publish(spark, path, after)
    return after


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the newest `keep` versions and the folders that only those had; returns how many folders.

    Folders of a writer that has not published yet are in no version: run this while none writes.
    """
    if keep < 1:
        raise ValueError("the newest version must stay")
    known = numbers(spark, path)
    kept = [version(spark, path, n) for n in known[-keep:]]
    used = {f for v in kept for f in v.months.values()}
    fs, _ = _hadoop(spark, path)
    for n in known[:-keep]:
        fs.delete(_hadoop(spark, f"{_manifests(path)}/{n:012d}.json")[1], False)
    gone = 0
    for commit in fs.listStatus(_hadoop(spark, _data(path))[1]):
        name = commit.getPath().getName()
        for month in fs.listStatus(commit.getPath()):
            if month.isDirectory() and f"{name}/{month.getPath().getName()}" not in used:
                gone += bool(fs.delete(month.getPath(), True))
        if not any(f.startswith(f"{name}/") for f in used):
            fs.delete(commit.getPath(), True)
    return gone
