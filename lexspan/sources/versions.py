"""Tables that are replaced by key: each change is a version, visible once it is committed.

A version is a folder with the rows of a change; its commit is written after it. Readers
take committed versions only, and of each key the rows of the newest one, so a write that
breaks half-way leaves the table as it was, a repeated write of one version changes nothing,
and a change of a few documents writes a few rows. ``compact`` writes the whole table as one
version, behind which older ones are no longer read. A table has one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def write(rows: DataFrame, path: str, version: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/data/version={version}")


def read(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/data/version={version}")


def commit(spark: SparkSession, path: str, version: int, stage: str = "done", full: bool = False) -> None:
    spark.range(1).select(F.lit(full).alias("full")).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/version={version}/stage={stage}")


def committed(spark: SparkSession, path: str) -> dict[int, set[str]]:
    """Stages of each version (of a version that is full also ``full``): a few words for each version since the table was cleaned up."""
    if not exists(spark, f"{path}/commits"):
        return {}
    found: dict[int, set[str]] = {}
    for r in spark.read.parquet(f"{path}/commits").select("version", "stage", "full").collect():
        found.setdefault(int(r["version"]), set()).update({str(r["stage"]), *(["full"] if r["full"] else [])})
    return found


def current(spark: SparkSession, path: str, *key: str, before: int | None = None) -> DataFrame | None:
    """The rows of the table (as it was before a version); None if nothing is committed."""
    done = {v: s for v, s in committed(spark, path).items() if "done" in s and (before is None or v < before)}
    if not done:
        return None
    least = max([v for v, s in done.items() if "full" in s], default=0)
    folders = [f"{path}/data/version={v}" for v in sorted(done) if v >= least]
    rows = spark.read.option("basePath", f"{path}/data").option("mergeSchema", "true").parquet(*folders)
    if len(folders) == 1:
        return rows.drop("version")
    newest = rows.groupBy(*key).agg(F.max("version").alias("version"))
    return rows.join(newest, [*key, "version"], "left_semi").drop("version")


def replace(rows: DataFrame, path: str, *key: str, version: int | None = None, compact_after: int = 32) -> None:
    """A new version of the keys that ``rows`` hold; even numbers are changes, odd ones compactions."""
    spark = rows.sparkSession
    known = committed(spark, path)
    version = version if version is not None else max([v // 2 * 2 + 2 for v in known], default=0)
    write(rows, path, version)
    commit(spark, path, version)
    full = max([v for v, s in known.items() if "full" in s], default=-1)
    if sum(v > full for v in known) >= compact_after:
        compact(spark, path, *key, version=version + 1)


def compact(spark: SparkSession, path: str, *key: str, version: int) -> None:
    """The whole table as one version."""
    rows = current(spark, path, *key, before=version)
    if rows is not None:
        write(rows, path, version)
        commit(spark, path, version, full=True)
