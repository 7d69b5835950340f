"""Writers and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eraframe.operators.keyed import only_new


# For sessions whose ``spark.checkpoint.dir`` is unset and can no longer be set.
SHARED_FOLDER = "spark.eraframe.sharedFolder"


def shared_folder(spark: SparkSession) -> str | None:
    """``spark.checkpoint.dir``, else the folder in :data:`SHARED_FOLDER`."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SHARED_FOLDER, None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder, which every executor must see."""
    shared = shared_folder(spark)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def hand_off(df: DataFrame, name: str) -> DataFrame:
    """Store a frame in the shared folder and go on from the stored copy.

    For results several steps read: they are computed once, each reader scans
    only its columns, and a lost executor costs no recomputation from source.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hand_off_lines(lines: DataFrame, name: str) -> str:
    """Store lines as text files in the shared folder; the path of the folder."""
    path = scratch_path(lines.sparkSession, name)
    lines.write.text(path)
    return path


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes in text are doubled, blanks are kept."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table does not hold yet, one row per key.

    Of new rows with one key the least in the order of the columns goes in. Run again after a failure, it adds only what is still missing.
    """
    spark = df.sparkSession
    least = F.min(F.struct(*df.columns)).alias("row")
    df = df.groupBy(F.col(key).alias("new_key")).agg(least).select("row.*")
    try:
        existing = spark.read.schema(df.schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        df.write.mode("append").parquet(path)
        return
    only_new(df, existing, key).write.mode("append").parquet(path)
