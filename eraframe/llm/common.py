"""Small helpers that several operators share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eraframe.sources import sinks

# White space of the word definition, as a regular expression class and as text.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"

# Name of the column that holds a row's digest inside operators.
ROW_KEY = "__row_key__"

FILTER_WORDS = 65_536  # of 64 bits, in the filter of words before they are joined with terms

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str | Column = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters that are not blank."""
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once per row.

    A column that a lambda merely captures can be inlined into it and then be
    computed again for every element; a lambda variable cannot.
    """
    return F.transform(F.array(value), body)[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see; a scratch one in local mode if unset."""
    folder = sinks.shared_folder(spark)
    if not folder:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set(sinks.SHARED_FOLDER, folder)
    return folder


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of keys in which null equals null."""
    condition = F.lit(True)
    for key in keys:
        condition &= left[key].eqNullSafe(right[key])
    return condition


def ranked(
    df: DataFrame, keys: Sequence[str], group_size: str, order: Sequence[str], per_task: int = 4_000
) -> DataFrame:
    """Adds ``rank``, from 1, of each row among the rows with its ``keys``.

    ``group_size`` is a column with the number of rows of the group. Larger groups
    are cut by hash into parts of about ``per_task`` rows; a part starts after the
    rows of the parts before it, so no group has to fit into one task.
    """
    parts = F.ceil(F.col(group_size) / F.lit(per_task)).cast("long")
    cut = df.withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), *order), parts))
    sized = cut.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        F.col("_part").alias("_own"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
    )
    condition = cut["_part"] == starts["_own"]
    for i, key in enumerate(keys):
        condition &= cut[key].eqNullSafe(starts[f"_key{i}"])
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (
        cut.join(starts, condition)
        .withColumn("rank", F.col("_start") + F.row_number().over(inside))
        .drop("_part", "_own", "_start", *[f"_key{i}" for i in range(len(keys))])
    )


def row_key(df: DataFrame, seed: int = 0) -> Column:
    """A digest of the whole row, the same for rows that are equal in every column."""
    columns = [F.col(f"`{c}`").cast("string") for c in df.columns]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    halves = [F.hex(F.xxhash64(F.lit(seed + i), nulls, *columns)) for i in range(2)]
    return F.concat_ws("-", *halves)


def map_carrying(df: DataFrame, carried: Sequence[str], work, made: str) -> DataFrame:
    """``mapInPandas`` that yields the ``carried`` columns and those in ``made``.

    The carried ones travel as text: pandas turns whole numbers with nulls into
    floating ones, which cannot hold large ids.
    """
    kinds = {c: df.schema[c].dataType for c in carried}
    as_text = df.withColumns({c: F.col(c).cast("string") for c in carried})
    schema = ", ".join([*[f"`{c}` string" for c in carried], made])
    done = as_text.mapInPandas(work, schema)
    return done.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


def may_hold(terms: DataFrame, term: Column) -> Column:
    """A test that all of ``terms`` pass and few other words: their bits in one array.

    Its size is fixed; more terms only let more words pass.
    """
    spark = terms.sparkSession
    at = lambda word: F.pmod(F.xxhash64(word), F.lit(64 * FILTER_WORDS))
    own = terms.select(at(F.col("term")).alias("at")).selectExpr(
        "at div 64 AS word", "shiftleft(1L, int(at % 64)) AS bits"
    )
    none = spark.range(FILTER_WORDS).selectExpr("id AS word", "0L AS bits")
    bits = (
        own.unionByName(none)
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all"))
        .select(F.transform("all", lambda x: x["bits"]))
        .scalar()
    )
    word = F.floor(at(term) / 64).cast("int")
    return F.getbit(F.get(bits, word), F.pmod(at(term), F.lit(64)).cast("int")) == 1


def with_any_columns(*own: str):
    """Makes a function from documents to documents safe for any other columns.

    Columns but the ``own`` ones travel under numbered names, so none can clash with the names
    that operators use inside, and get their names back at the end, dots and all.
    """

    def around(work):
        @functools.wraps(work)
        def run(docs: DataFrame, *args, **parameters) -> DataFrame:
            names = [c if c in own else f"carried_{i}" for i, c in enumerate(docs.columns)]
            return work(docs.toDF(*names), *args, **parameters).toDF(*docs.columns)

        return run

    return around


_CHUNK = 256


def before_each(values: Column, merge, zero: Column) -> Column:
    """For each element of an array, what merging all elements before it gives.

    ``merge`` is associative, ``zero`` its neutral element. Arrays are worked on in
    runs of 256 elements, because appending to an array copies it: the cost of a step
    depends on a run and on the number of runs, not on all elements.
    """

    def scanned(short: Column) -> Column:
        """One element more than given: the last is the merge of all."""
        return F.aggregate(
            short, F.array(zero), lambda done, x: F.concat(done, F.array(merge(F.element_at(done, -1), x)))
        )

    def of_runs(runs: Column) -> Column:
        totals = F.transform(runs, lambda run: F.aggregate(run, zero, merge))
        begins = let(totals, scanned)
        return F.flatten(
            F.zip_with(
                runs,
                F.slice(begins, F.lit(1), F.size(runs)),
                lambda run, begin: F.transform(
                    F.slice(scanned(run), F.lit(1), F.size(run)), lambda x: merge(begin, x)
                ),
            )
        )

    def all_of(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / _CHUNK).cast("int")
        runs = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.slice(values, i * _CHUNK + 1, F.lit(_CHUNK)),
        )
        return let(runs, of_runs)

    return let(values, all_of)
