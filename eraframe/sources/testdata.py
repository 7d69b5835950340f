"""Inputs of the jobs, derived from the generic order tables by Spark.

The star treats every part as a film and every (order, part) pair as a release
of it; the raw film, title and indicator inputs are spelled out of ``orders``
and ``lineitem`` with the blemishes the cleaning job has to deal with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eraframe import schemas
from eraframe.functions.classify import decade_label
from eraframe.functions.rounding import round_half_up
from eraframe.operators.keyed import keep_first
from eraframe.plans.load import popularity
from eraframe.session import shuffle_tasks
from eraframe.sources.readers import constant_table
from eraframe.sources.star import Star

# Invented yearly rates (year, growth, unemployment, inflation)
# that sit on the limits of both crisis rules.
MACRO_ROWS = [
    (1995, 2.5, 5.6, 2.8),
    (1996, -0.4, 5.4, 2.9),
    (1997, 4.4, 8.0, 2.3),
    (1998, 0.0, 6.0, 0.0),
    (1999, None, 8.1, 2.2),
    (2000, 4.1, 4.0, 3.4),
    (2001, None, None, -0.4),
]
# Invented events (seq, year, name, type); two in 2000.
EVENT_ROWS = [
    (1, 1995, "Stable Period", "Stable Period"),
    (2, 1998, "Stable Period", "Stable Period"),
    (3, 2000, "Bubble Burst", "Economic Crisis"),
    (4, 2000, "Border War", "War"),
]
# Genre list by the second word of the part name.
PART_GENRES = {
    "ring": "Comedy",
    "bolt": "Horror",
    "gear": "Drama, Comedy",
    "rod": "Comedy, Horror",
    "plate": "Action, Drama",
}


# Declared, so that opening a table reads no file.
TABLE_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# Stored bytes of texts for one task of a join, and the most tasks that are asked for. Beyond 200 tasks the
# shuffle sorts texts in memory where they are read, so tasks are not smaller than they need be.
TEXT_TASK_BYTES = 32 << 20
TEXT_TASKS = 20_000


def texts_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, dealt by id to as many tasks as their files call for.

    A join sorts them; with the few shuffle partitions of some sessions a task's texts would
    outgrow its memory and be spilled whole. Where the session has enough partitions, they are
    left to adaptive execution.
    """
    documents = table(spark, sf_dir, "documents")
    files = documents.select("_metadata.file_path", "_metadata.file_size").distinct()
    stored = files.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]
    documents = documents.select("doc_id", "text")
    tasks = min(-(-stored // TEXT_TASK_BYTES), TEXT_TASKS)
    return documents.repartition(tasks, "doc_id") if tasks > shuffle_tasks(spark) else documents


def release_fact(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """One release per (order, part), its money scaled to film budgets.

    Lines are combined per order and part before the part is looked up, so a
    part on very many orders is spread over all tasks by the order key.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    releases = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_partkey")
        .agg(
            F.min("l_shipdate").alias("shipped"),
            F.sum("l_quantity").alias("quantity"),
            # Whole cents, so that the order of the lines cannot change a sum.
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
            F.max(F.abs("l_discount")).alias("discount"),
        )
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_partkey").alias("movie_key"),
            (F.year("shipped") + shift).cast("int").alias("date_key"),
            F.floor(F.col("quantity") * F.col("p_retailprice") * 5000).alias("budget"),
            (F.col("cents") * 50).alias("revenue"),
            round_half_up(5 + 50 * F.col("discount"), 1).alias("vote_average"),
            (F.col("quantity") * 100).cast("int").alias("vote_count"),
        )
        .withColumn("roi", (F.col("revenue") - F.col("budget")) / F.col("budget"))
    )
    mean_rating = releases.agg(F.avg("vote_average")).scalar()
    votes = F.col("vote_count").cast("double")
    return releases.withColumn(
        "popularity", popularity(F.col("vote_average"), votes, mean_rating)
    ).select(*schemas.FACT_BOX_OFFICE.fieldNames())


def film_dimension(spark: SparkSession, sf_dir: str, overviews: bool = False) -> DataFrame:
    """Parts as films; the overview is looked up only where it is asked for."""
    kind = F.split_part("p_name", F.lit(" "), F.lit(2))
    genre: Column = F.lit("Unknown")
    for word, genres in PART_GENRES.items():
        genre = F.when(kind == word, genres).otherwise(genre)
    films = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("movie_key"),
        F.col("p_partkey").alias("movie_id"),
        F.col("p_name").alias("title"),
        genre.alias("genre"),
        (60 + 3 * F.col("p_size")).alias("runtime"),
    )
    if not overviews:
        return films.withColumn("overview", F.lit(None).cast("string"))
    texts = texts_by_id(spark, sf_dir).select(
        F.col("doc_id").alias("movie_key"), F.col("text").alias("overview")
    )
    return films.join(texts, "movie_key", "left")


def star(
    spark: SparkSession, sf_dir: str, overviews: bool = False, shift: int = 0
) -> Star:
    """The whole star; ``shift`` moves every year, facts and calendar alike."""
    fact = release_fact(spark, sf_dir, shift)
    macro = constant_table(
        spark, [(year + shift, *rates) for year, *rates in MACRO_ROWS], schemas.DIM_MACROECONOMICS
    )
    events = constant_table(
        spark, [(seq, year + shift, name, kind) for seq, year, name, kind in EVENT_ROWS], schemas.EVENTS
    )
    return Star(
        fact=fact,
        movies=film_dimension(spark, sf_dir, overviews),
        dates=fact.select("date_key").distinct().select(
            "date_key",
            F.col("date_key").alias("release_year"),
            decade_label(F.col("date_key")).alias("decade"),
        ),
        macro=macro,
        events=keep_first(events, "year", "seq").select(
            F.col("year").alias("event_year"), "event_name", "event_type"
        ),
    )


# Written once for Spark and for the SQL that checks it: plain SQL both read,
# table names in braces, braces of the data doubled.
RAW_FILMS_SQL = """
SELECT
  o.o_orderkey AS seq,
  o.o_custkey AS id,
  CASE
    WHEN o.o_orderpriority = '1-URGENT' THEN concat('tt', lpad(CAST(o.o_orderkey AS STRING), 12, '0'))
    WHEN o.o_orderpriority = '2-HIGH' THEN concat(' "tt', CAST(o.o_orderkey AS STRING), '" ')
    WHEN o.o_orderpriority = '3-MEDIUM' THEN CAST(o.o_orderkey AS STRING)
    WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN concat('tt', CAST(o.o_orderkey AS STRING), '/x9')
    WHEN o.o_orderstatus = 'P' THEN 'missing'
    WHEN o.o_orderstatus = 'O' THEN concat('tt', CAST(o.o_orderkey AS STRING))
  END AS imdb_id,
  CASE o.o_orderstatus
    WHEN 'F' THEN concat('"', substr(o.o_orderpriority, 3), ' no. ', CAST(o.o_orderkey AS STRING), '"')
    WHEN 'O' THEN concat('  ''', substr(o.o_orderpriority, 3), ' "', CAST(o.o_custkey AS STRING), '" "  ')
    ELSE concat(substr(o.o_orderpriority, 3), ', "', CAST(o.o_custkey AS STRING), '"')
  END AS title,
  CASE
    WHEN o.o_orderpriority = '3-MEDIUM' AND o.o_orderstatus = 'P'
      THEN concat(substr(CAST(CAST(o.o_orderdate AS DATE) AS STRING), 1, 4), '-13-01')
    WHEN o.o_orderpriority = '4-NOT SPECIFIED' AND o.o_orderstatus = 'P' THEN 'not a date'
    WHEN o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'P'
      THEN concat('1969', substr(CAST(CAST(o.o_orderdate AS DATE) AS STRING), 5))
    ELSE CAST(CAST(o.o_orderdate AS DATE) AS STRING)
  END AS release_date,
  CASE WHEN day(o.o_orderdate) = 13 THEN NULL WHEN day(o.o_orderdate) = 14 THEN 0.0
    ELSE o.o_totalprice * 9000 END AS budget,
  CASE WHEN day(o.o_orderdate) = 15 THEN 0.0
    ELSE o.o_totalprice * 1000 * month(o.o_orderdate) END AS revenue,
  CASE WHEN day(o.o_orderdate) = 1 THEN NULL
    ELSE CAST(56 + 4 * day(o.o_orderdate) AS DOUBLE) - CASE WHEN day(o.o_orderdate) = 2 THEN 64 ELSE 0 END
  END AS runtime,
  CASE WHEN month(o.o_orderdate) = 2 THEN 0.0 ELSE CAST(month(o.o_orderdate) AS DOUBLE) / 2 + 3 END
    AS vote_average,
  CAST(floor(o.o_totalprice / 100) AS BIGINT) - 20 AS vote_count,
  d.text AS overview,
  CASE o.o_orderstatus
    WHEN 'F' THEN CASE o.o_orderpriority
      WHEN '1-URGENT' THEN '[{{''id'': 28, ''name'': ''Action''}}, {{''id'': 35, ''name'': ''Comedy''}}]'
      WHEN '2-HIGH' THEN 'Action|Comedy'
      WHEN '3-MEDIUM' THEN '[{{"name": "Drama"}}]'
      WHEN '4-NOT SPECIFIED' THEN ' Horror ,, Comedy, '
      ELSE '["Action"]' END
    WHEN 'O' THEN CASE o.o_orderpriority
      WHEN '1-URGENT' THEN '[{{''id'': 1}}]'
      WHEN '2-HIGH' THEN '[{{''name'': ''Drama''}}'
      WHEN '3-MEDIUM' THEN ''
      WHEN '4-NOT SPECIFIED' THEN '[{{''id'': 2}}, {{''name'': ''Horror''}}]'
      ELSE ' , | ' END
    ELSE CASE o.o_orderpriority WHEN '2-HIGH' THEN NULL ELSE 'Thriller' END
  END AS genres
FROM {orders} o LEFT JOIN {documents} d ON d.doc_id = o.o_orderkey
"""

BASICS_LINES_SQL = """
SELECT concat(
  concat_ws(chr(9),
    concat('tt', lpad(CAST(o_orderkey AS STRING), 12, '0')),
    CASE o_orderstatus WHEN 'F' THEN 'movie' WHEN 'O' THEN ' movie ' ELSE 'tvSeries' END),
  CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN ''
  ELSE concat(chr(9), concat_ws(chr(9),
    concat('"Part ', CAST(o_custkey AS STRING)),
    o_orderpriority, '0', '1999', concat(chr(92), 'N'),
    CASE WHEN o_orderpriority = '3-MEDIUM' THEN concat(chr(92), 'N')
      ELSE CAST(80 + day(o_orderdate) AS STRING) END,
    'Drama'),
    CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN concat(chr(9), 'extra') ELSE '' END)
  END) AS value
FROM {orders}
"""

RATINGS_LINES_SQL = """
SELECT concat_ws(chr(9),
  concat('tt', lpad(CAST(o_orderkey AS STRING), 12, '0')),
  CASE WHEN day(o_orderdate) = 20 THEN concat(chr(92), 'N')
    ELSE concat(CAST(month(o_orderdate) AS STRING), '.', CAST(day(o_orderdate) AS STRING)) END,
  CAST(CAST(floor(o_totalprice / 25) AS BIGINT)
    - CASE WHEN month(o_orderdate) = 3 THEN 5000 ELSE 0 END AS STRING)) AS value
FROM {orders}
WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')
"""

# Fifty years, 1976 to 2025, out of the ordered quantity; unemployment has gaps.
INDICATORS_SQL = """
SELECT 'FP.CPI.TOTL.ZG' AS indicator, CAST(1975 + l_quantity AS INT) AS year,
  CAST(CAST(count(*) AS DECIMAL(18, 0)) / 1000 AS DOUBLE) AS value
FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY l_quantity
UNION ALL
SELECT 'NY.GDP.MKTP.KD.ZG', CAST(1975 + l_quantity AS INT),
  CAST(count(*) - 4 * count(DISTINCT l_suppkey) AS DOUBLE)
FROM {lineitem} WHERE l_linestatus = 'F' GROUP BY l_quantity
UNION ALL
SELECT 'SL.UEM.TOTL.ZS', CAST(1975 + l_quantity AS INT),
  CASE WHEN l_quantity BETWEEN 4 AND 9 THEN NULL
    ELSE CAST(CAST(count(*) AS DECIMAL(18, 0)) / 250 AS DOUBLE) END
FROM {lineitem} WHERE l_quantity > 2 GROUP BY l_quantity
"""


def raw_films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders spelled as raw film rows; customers are the film ids, so ids repeat."""
    return spark.sql(
        RAW_FILMS_SQL,
        orders=table(spark, sf_dir, "orders"),
        documents=texts_by_id(spark, sf_dir),
    )


def basics_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a title-basics file, some short, some over-long."""
    return spark.sql(BASICS_LINES_SQL, orders=table(spark, sf_dir, "orders"))


def ratings_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a title-ratings file."""
    return spark.sql(RATINGS_LINES_SQL, orders=table(spark, sf_dir, "orders"))


def indicator_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long indicator series with gaps."""
    series = spark.sql(INDICATORS_SQL, lineitem=table(spark, sf_dir, "lineitem"))
    return series.select(
        "indicator", "year", F.col("value").cast(T.DoubleType()).alias("value")
    )
