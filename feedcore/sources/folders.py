"""A stored set of which a run rewrites only the folders it touches.

Rows lie in folders by official flag and month.  A folder is never changed: a run writes
the new state of the folders it touches below ``data/v=<run>``, and then a small
table, ``_manifest/run=<run>``, that names the folders in force.  That table's
``_SUCCESS`` mark puts the run in force, so a crash at any step leaves the set as it
was, and the run can be repeated.  Folders and tables that neither this run nor
the one before needs are removed last.

A set written whole (``write_store``) can be carried on: its folders are in force until touched.
One writer at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedcore.rules import RuleBook
from feedcore.schema import STORED, no_rows

LAYOUT = ["is_official", "month"]
_NULL = "__HIVE_DEFAULT_PARTITION__"
_MANIFEST = "folder string, is_official boolean, month string, rules string"


@dataclass(frozen=True, order=True)
class Folder:
    """A folder in force, relative to the store; ``rules`` marks the rules its rows were checked by."""

    folder: str
    is_official: bool
    month: str | None
    rules: str

    @property
    def key(self) -> tuple[bool, str | None]:
        return self.is_official, self.month


def rules_mark(rules: RuleBook) -> str:
    return hashlib.md5(repr(rules).encode()).hexdigest()


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def names_below(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder on whatever file system the path names; none if absent."""
    fs, target = _files(spark, path)
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def finished_runs(spark: SparkSession, path: str) -> list[int]:
    """Runs with Spark's mark of success, newest first."""
    runs = [int(name[4:]) for name in names_below(spark, path) if name.startswith("run=")]
    return [n for n in sorted(runs, reverse=True) if "_SUCCESS" in names_below(spark, f"{path}/run={n}")]


def _written(spark: SparkSession, store: str, base: str, mark: str) -> list[Folder]:
    """Folders by flag and month below ``base``; a few hundred names, read by the driver."""
    found = []
    for flag in names_below(spark, f"{store}/{base}"):
        if flag.startswith("is_official="):
            for month in names_below(spark, f"{store}/{base}/{flag}"):
                if month.startswith("month="):
                    value = month[6:]
                    found.append(Folder(f"{base}/{flag}/{month}", flag[12:] == "true", None if value == _NULL else value, mark))
    return found


def in_force(spark: SparkSession, store: str) -> tuple[int, list[Folder]]:
    """The newest finished run, -1 if there is none, and its folders."""
    touched, whole = finished_runs(spark, f"{store}/_manifest")[:1], finished_runs(spark, store)[:1]
    run = max([-1, *touched, *whole])
    if touched and touched == [run]:
        rows = spark.read.schema(_MANIFEST).parquet(f"{store}/_manifest/run={run}").collect()
        return run, sorted((Folder(*row) for row in rows), key=lambda f: f.folder)
    return run, _written(spark, store, f"run={run}", "") if whole else []


def read_folders(spark: SparkSession, store: str, folders: Iterable[Folder]) -> DataFrame:
    paths = [f"{store}/{f.folder}" for f in folders]
    if not paths:
        return no_rows(spark, STORED)
    return spark.read.schema(STORED).parquet(*paths)


def unexpired(folders: Sequence[Folder], keep_from) -> list[Folder]:
    """Folders that can hold official rows, rows without a day, or rows of that month and later."""
    if keep_from is None:
        return list(folders)
    return [f for f in folders if f.is_official or f.month is None or f.month >= str(keep_from)[:7]]


def put_in_force(spark: SparkSession, store: str, run: int, rows: DataFrame, stay: Sequence[Folder], mark: str) -> None:
    """Write touched folders (``rows`` has the columns of ``LAYOUT``) and the table that names all in force."""
    base = f"data/v={run}"
    # What a crashed attempt left behind was never in force and is replaced.
    rows.hint("rebalance", *LAYOUT).write.mode("overwrite").partitionBy(*LAYOUT).parquet(f"{store}/{base}")
    folders = [*stay, *_written(spark, store, base, mark)]
    table = [(f.folder, f.is_official, f.month, f.rules) for f in sorted(folders, key=lambda f: f.folder)]
    spark.createDataFrame(table, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{store}/_manifest/run={run}")


def remove_unused(spark: SparkSession, store: str, keep: int = 2) -> list[str]:
    """Delete what the newest ``keep`` runs do not name; returns the folders that went."""
    runs = finished_runs(spark, f"{store}/_manifest")
    if len(runs) < keep:
        return []
    used, gone = set(), []
    for n in runs[:keep]:
        used |= {r.folder for r in spark.read.schema(_MANIFEST).parquet(f"{store}/_manifest/run={n}").collect()}
    versions = [f"data/{v}" for v in names_below(spark, f"{store}/data") if v.startswith("v=") and int(v[2:]) <= runs[0]]
    versions += [f"run={n}" for n in finished_runs(spark, store) if n < runs[keep - 1]]
    for base in versions:
        folders = [f.folder for f in _written(spark, store, base, "")]
        gone += [f for f in folders if f not in used]
        if folders and not used & set(folders):
            gone.append(base)
    gone += [f"_manifest/run={n}" for n in runs[keep:]]
    gone += [f"_fresh/run={n}" for n in finished_runs(spark, f"{store}/_fresh") if n < runs[keep - 1]]
    for folder in gone:
        fs, target = _files(spark, f"{store}/{folder}")
        fs.delete(target, True)
    return gone
