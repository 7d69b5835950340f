"""Reload of a stored star: only the years whose rows have changed are written again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eraframe import schemas
from eraframe.sources import commits
from eraframe.sources.star import TABLES, Star

FACT = TABLES["fact"][0]
DIGESTS = "fact_digests"


@dataclass(frozen=True)
class Reload:
    """What a reload did: the version it published and the years that it touched."""

    version: commits.Version
    written: list[int | None]
    removed: list[int | None]
    kept: list[int | None]


def year_digests(fact: DataFrame) -> DataFrame:
    """Row count and two digests per year, which any order of the rows leaves the same.

    Sums of row hashes are merged in every task before the shuffle, which
    carries a row per task and year.
    """
    columns = [F.col(c) for c in schemas.FACT_BOX_OFFICE.fieldNames()]
    # A hash skips nulls, so their places are hashed besides.
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])

    def digest(seed: int):
        row = F.xxhash64(F.lit(seed), nulls, *columns).cast("decimal(38,0)")
        return F.sum(row).cast("string")

    return fact.groupBy("date_key").agg(
        F.count(F.lit(1)).alias("row_count"),
        digest(1).alias("digest_1"),
        digest(2).alias("digest_2"),
    )


def _year_of(folder: str) -> int | None:
    value = folder.rsplit("date_key=", 1)[1]
    return None if value.startswith("__HIVE") else int(value)


def reload_star(
    spark: SparkSession, path: str, star: Star, untouched: Sequence[str] = ()
) -> Reload:
    """Brings a stored star to the state of ``star``, which may lack or add years.

    Digests of the new rows are compared with the stored ones, and only years that differ
    are written; the others keep their files. Dimensions are small beside the fact and are
    replaced, but for the ``untouched`` ones (``movies`` and so on). All of it is one commit, which
    raises :class:`~eraframe.sources.commits.Conflict` if another load got in meanwhile; nothing
    has changed then, and the reload can be run again. The fact is read twice: hand in a stored one.

    The years (one row each) are the only rows that reach the driver.
    """
    base = commits.latest(spark, path)
    new = year_digests(star.fact)
    old = commits.read_rows(spark, path, DIGESTS, schemas.FACT_DIGESTS, base)
    same = (new["row_count"] == old["row_count"]) & (new["digest_1"] == old["digest_1"])
    same &= new["digest_2"] == old["digest_2"]
    years = (
        new.join(old, new["date_key"].eqNullSafe(old["date_key"]), "full")
        .select(
            F.coalesce(new["date_key"], old["date_key"]).alias("date_key"),
            new["row_count"].isNotNull().alias("is_new"),
            F.coalesce(same, F.lit(False)).alias("same"),
            new["row_count"],
            new["digest_1"],
            new["digest_2"],
        )
        .collect()
    )
    written = {r["date_key"] for r in years if r["is_new"] and not r["same"]}
    kept = {r["date_key"] for r in years if r["same"]}
    removed = {r["date_key"] for r in years if not r["is_new"]}

    folders = [f for f in base.folders(FACT) if _year_of(f) in kept]
    if written:
        known = F.col("date_key").isin([y for y in written if y is not None])
        wanted = known | F.col("date_key").isNull() if None in written else known
        rows = star.fact.filter(wanted).hint("rebalance", "date_key")
        folders += commits.write_rows(rows, path, FACT, by="date_key").folders
    changed = {FACT: folders}
    digests = [tuple(r[c] for c in schemas.FACT_DIGESTS.fieldNames()) for r in years if r["is_new"]]
    stored = spark.createDataFrame(digests, schemas.FACT_DIGESTS).coalesce(1)
    changed[DIGESTS] = commits.write_rows(stored, path, DIGESTS).folders
    for field, (table, _) in TABLES.items():
        if field != "fact" and field not in untouched:
            changed[table] = commits.write_rows(getattr(star, field), path, table).folders
    version = commits.publish(spark, path, base, changed, {"years": str(len(written))})
    ordered = [sorted(some, key=lambda y: (y is not None, y)) for some in (written, removed, kept)]
    return Reload(version, *ordered)


def fact_origin(spark: SparkSession, path: str, first: commits.Version) -> DataFrame:
    """The fact as it is, with ``reloaded``: whether its file came after the version ``first``."""
    now = commits.latest(spark, path)
    older = [f for f in now.folders(FACT) if f in set(first.folders(FACT))]
    newer = [f for f in now.folders(FACT) if f not in set(first.folders(FACT))]
    parts = [
        commits.read_rows(
            spark, path, FACT, schemas.FACT_BOX_OFFICE, commits.Version(1, {FACT: some})
        ).withColumn("reloaded", F.lit(flag))
        for some, flag in ((older, False), (newer, True))
    ]
    return parts[0].unionByName(parts[1])
