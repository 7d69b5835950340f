"""Tables whose changes become visible by numbered commits.

A folder holds tables, and ``_commits`` below it one manifest per version: for every table the
folders of files that belong to it. Files are written first, each load in a folder of its own, and
never changed; a manifest is then renamed into place under the next number. A rename onto
an existing name fails, so of two loads that started from one version one gets in and the other
has to look again. Readers open the files that one manifest names: they see a load in
whole or not at all, also over several tables, and a load that died leaves files that nobody reads.

The rename must fail on an existing target, as it does on HDFS. Plain object stores lack that.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eraframe.operators.keyed import keep_first, only_new

_COMMITS = "_commits"
_LOAD = "load"


# Folders of the changed tables, and notes.
Change = tuple[dict[str, list[str]], dict[str, str]]


class Conflict(Exception):
    """Another load has published the version that was to be written."""


@dataclass(frozen=True)
class Version:
    """A published state: the folders of every table, below ``<path>/<table>``."""

    number: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)

    def folders(self, table: str) -> list[str]:
        return self.tables.get(table, [])


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a function that makes its path objects."""
    jvm = spark._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), make


def _manifest(number: int) -> str:
    return f"{number:020d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    files, make = _files(spark, path)
    folder = make(f"{path}/{_COMMITS}")
    if not files.exists(folder):
        return []
    names = (status.getPath().getName() for status in files.listStatus(folder))
    return sorted(int(name[:-5]) for name in names if name.endswith(".json"))


def version_at(spark: SparkSession, path: str, number: int) -> Version:
    if not number:
        return Version()
    files, make = _files(spark, path)
    stream = files.open(make(f"{path}/{_COMMITS}/{_manifest(number)}"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    held = json.loads(text)
    return Version(number, held["tables"], held["notes"])


def latest(spark: SparkSession, path: str) -> Version:
    """The last published version; one without tables where there is none."""
    return version_at(spark, path, max(versions(spark, path), default=0))


def publish(
    spark: SparkSession,
    path: str,
    after: Version,
    changed: dict[str, list[str]],
    notes: dict[str, str] | None = None,
) -> Version:
    """The version after ``after``, with the folders of the ``changed`` tables replaced.

    Raises :class:`Conflict` if another load has published that number.
    """
    version = Version(after.number + 1, {**after.tables, **changed}, notes or {})
    files, make = _files(spark, path)
    final = make(f"{path}/{_COMMITS}/{_manifest(version.number)}")
    draft = make(f"{path}/{_COMMITS}/.{uuid.uuid4().hex}.draft")
    stream = files.create(draft, False)
    stream.write(json.dumps({"tables": version.tables, "notes": version.notes}).encode())
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(
        files.makeQualified(final).toUri(), spark._jsparkSession.sessionState().newHadoopConf()
    )
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(final), none)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            raise Conflict(f"version {version.number} of {path} exists") from error
        raise
    return version


@dataclass(frozen=True)
class Load:
    """Folders that a load has written, and the rows in them."""

    folders: list[str]
    rows: int


def write_rows(
    rows: DataFrame, path: str, table: str, by: str | Sequence[str] | None = None
) -> Load:
    """Writes rows of a table as a load of its own, partitioned by ``by``.

    There is one folder per value of its (first) column. The rows are counted by the write itself. Nobody reads the folders before a
    :func:`publish` that names them; there are none if there are no rows.
    """
    load = f"{_LOAD}={uuid.uuid4().hex}"
    target = f"{path}/{table}/{load}"
    written = Observation()
    rows = rows.observe(written, F.count(F.lit(1)).alias("rows"))
    if by is None:
        rows.write.parquet(target)
        return Load([load] if written.get["rows"] else [], written.get["rows"])
    columns = [by] if isinstance(by, str) else list(by)
    rows.write.partitionBy(*columns).parquet(target)
    files, make = _files(rows.sparkSession, path)
    names = (s.getPath().getName() for s in files.listStatus(make(target)) if s.isDirectory())
    folders = sorted(f"{load}/{name}" for name in names if name.startswith(f"{columns[0]}="))
    return Load(folders, written.get["rows"])


def read_rows(
    spark: SparkSession,
    path: str,
    table: str,
    schema: T.StructType,
    version: Version | None = None,
    listed: str | None = None,
) -> DataFrame:
    """Rows of a table as of a version, the last one if none is given.

    ``listed`` is the name under which the manifest has the folders, if it is not the table's.
    """
    folders = (version or latest(spark, path)).folders(listed or table)
    base = f"{path}/{table}"
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", base)
    return rows.parquet(*[f"{base}/{f}" for f in folders]).select(*schema.fieldNames())


def replace_tables(
    spark: SparkSession,
    path: str,
    tables: dict[str, tuple[DataFrame, str | None]],
    notes: dict[str, str] | None = None,
) -> Version:
    """Replaces tables, all in one version; ``tables`` has rows and partition column by name."""
    changed = {
        name: write_rows(rows, path, name, by).folders for name, (rows, by) in tables.items()
    }
    return retried(spark, path, lambda base: (changed, notes or {}))


def retried(
    spark: SparkSession,
    path: str,
    make: Callable[[Version], Change | None],
    attempts: int = 20,
) -> Version:
    """Publishes what ``make`` gives for the last version; after a conflict it is asked again.

    ``make`` returns None if there is nothing to publish.
    """
    for _ in range(attempts):
        base = latest(spark, path)
        made = make(base)
        if made is None:
            return base
        try:
            return publish(spark, path, base, *made)
        except Conflict:
            continue
    raise Conflict(f"{path} changed {attempts} times in a row")


def append_absent(rows: DataFrame, path: str, table: str, key: str, *order: str) -> Version:
    """Adds the rows whose key the table lacks, one per key: the first in ``order``.

    A null is a key like any other, so it is added once. Rows that are there stay as they are.
    If another load gets in between, its rows count as there and the rest is tried again.
    """
    spark = rows.sparkSession
    chosen = keep_first(rows, key, *(order or rows.columns))

    def make(base: Version) -> Change | None:
        there = read_rows(spark, path, table, chosen.schema, base)
        load = write_rows(only_new(chosen, there, key), path, table)
        notes = {"added": str(load.rows)}
        return ({table: [*base.folders(table), *load.folders]}, notes) if load.rows else None

    return retried(spark, path, make)


def compact(spark: SparkSession, path: str, table: str, schema: T.StructType) -> Version:
    """Rewrites a table that many loads have added to as one load.

    Loads that get in meanwhile are kept beside it.
    """
    base = latest(spark, path)
    old = base.folders(table)
    if len(old) < 2:
        return base
    merged = write_rows(read_rows(spark, path, table, schema, base), path, table).folders

    def make(now: Version) -> Change:
        if not set(old) <= set(now.folders(table)):
            raise Conflict(f"{table} was replaced meanwhile")
        return {table: merged + [f for f in now.folders(table) if f not in old]}, {}

    return retried(spark, path, make)
