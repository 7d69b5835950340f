from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from eraframe import read_star, schemas, write_star
from eraframe.plans import clean as clean_module
from eraframe.plans import reports
from eraframe.plans.clean import clean_films, clean_funnel
from eraframe.plans.load import dim_events, dim_macroeconomics
from eraframe.sources import readers, sinks, testdata
from tests.conftest import SMALL, tuples

HEADER = ",".join(schemas.RAW_FILMS.fieldNames())


def _film_line(**values) -> str:
    film = {
        "id": 1, "title": "A", "vote_average": 5.5, "vote_count": 10, "release_date": "2010-07-15",
        "revenue": 20.0, "runtime": 100.0, "budget": 10.0, "imdb_id": "tt1", "overview": "o",
        "genres": "Drama", **values,
    }
    quoted = ['"{}"'.format(str(v).replace('"', '""')) if isinstance(v, str) else str(v) for v in film.values()]
    return ",".join(quoted)


def test_film_csv_with_quotes_and_line_ends(spark, tmp_path):
    text = 'He said "hi",\nthen left'
    lines = [HEADER, _film_line(overview=text, title='"T"'), _film_line(id=2, runtime="NaN")]
    (tmp_path / "films.csv").write_text("\n".join(lines).replace('"NaN"', "NaN") + "\n")
    films = readers.read_films(spark, str(tmp_path))
    rows = {row["id"]: row for row in films.collect()}
    assert rows[1]["overview"] == text and rows[1]["title"] == '"T"'
    assert rows[2]["runtime"] is None
    assert rows[1]["seq"] < rows[2]["seq"]
    cleaned = clean_films(films).collect()
    assert [(r["id"], r["title"], r["imdb_id_cleaned"], r["year"]) for r in cleaned] == [(1, "T", 1, 2010)]


def test_source_order_follows_file_names(spark, tmp_path):
    for name, first in (("b.csv", 10), ("a.csv", 20)):
        rows = [_film_line(id=first + i) for i in range(3)]
        (tmp_path / name).write_text("\n".join([HEADER, *rows]) + "\n")
    films = readers.read_films(spark, str(tmp_path)).orderBy("seq")
    assert [r["id"] for r in films.collect()] == [20, 21, 22, 10, 11, 12]


def test_missing_input_and_missing_column(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        readers.read_films(spark, str(tmp_path / "none")).count()
    with pytest.raises(ValueError, match="imdb_id"):
        clean_films(spark.range(1))


def test_cleaning_keeps_optional_columns_optional(spark, tmp_path):
    schema = T.StructType([f for f in schemas.RAW_FILMS if f.name not in ("genres", "overview")])
    raw = spark.createDataFrame(
        [(1, "A", 5.0, 3, "2020-13-01", 2.0, 90.0, 1.0, "tt1"), (2, "B", 5.0, 3, "2020-12-01", 2.0, 90.0, 1.0, "tt2")],
        schema,
    )
    cleaned = clean_films(raw)
    assert "genres" not in cleaned.columns and "seq" not in cleaned.columns
    assert [r["id"] for r in cleaned.collect()] == [2]


def test_cleaning_limits(spark):
    base = (5.0, 3, "2000-01-01", 2.0, 90.0, 1.0, "tt1", None, None)
    names = ("vote_average", "vote_count", "release_date", "revenue", "runtime", "budget", "imdb_id")
    changes = [
        {}, {"imdb_id": "none"}, {"runtime": 0.0}, {"runtime": None}, {"budget": 0.0},
        {"revenue": None}, {"budget": 4_000_000_001.0}, {"revenue": 4_000_000_000.0},
        {"vote_count": 0}, {"vote_average": 0.0}, {"release_date": "1969-12-31"},
        {"release_date": "1970-01-01"}, {"release_date": "2024-12-31"},
        {"release_date": "2025-01-01"}, {"release_date": "soon"}, {"release_date": None},
    ]
    rows = []
    for i, change in enumerate(changes):
        values = {**dict(zip(names, base, strict=False)), **change}
        rows.append((i, "t", *[values[n] for n in names], None, None))
    raw = spark.createDataFrame(rows, schemas.RAW_FILMS)
    assert sorted(r["id"] for r in clean_films(raw).collect()) == [0, 7, 11, 12]
    funnel = [count for _, _, count in tuples(clean_funnel(raw))]
    assert funnel == [16, 15, 13, 11, 10, 8, 4, 12]


def test_title_lines(spark, tmp_path):
    columns = ["tconst", "titleType", "runtimeMinutes"]
    (tmp_path / "t.tsv").write_text(
        "\t".join(columns) + '\ntt1\t movie \t90\ntt2\tmovie\ntt3\tmovie\t\\N\n'
        'tt4\t"movie\t5\ntt5\tmovie\t1\textra\n\ntt6\t\t\ntt7\tmovie\t1\t\ntt8\n'
    )
    rows = tuples(readers.read_titles(spark, str(tmp_path), columns).orderBy("tconst"))
    assert rows == [
        ("tt1", " movie ", "90"), ("tt2", "movie", None), ("tt3", "movie", None),
        ("tt4", '"movie', "5"), ("tt6", None, None), ("tt8", None, None),
    ]
    # Reading one column only must not change which lines are left out.
    assert readers.read_titles(spark, str(tmp_path), columns).select("titleType").count() == 6


def test_csv_round_trip(spark, tmp_path):
    films = spark.createDataFrame(
        [(1, ' "x", y\nz ', 1.5), (2, "\\", None), (3, None, 0.1)], "id bigint, title string, budget double"
    )
    sinks.write_csv(films, str(tmp_path / "out"))
    back = readers.read_films(spark, str(tmp_path / "out"), films.schema).drop("seq")
    assert sorted(tuples(back)) == sorted(tuples(films))


def test_append_new_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "dim")
    first = spark.createDataFrame([(1, "old")], "k bigint, v string")
    second = spark.createDataFrame([(1, "new"), (2, "new"), (2, "newer")], "k bigint, v string")
    sinks.append_new(first, path, "k")
    sinks.append_new(second, path, "k")
    sinks.append_new(second, path, "k")
    assert sorted(tuples(spark.read.parquet(path))) == [(1, "old"), (2, "new")]


def test_scratch_folder_is_the_shared_one(spark):
    path = sinks.scratch_path(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and path != sinks.scratch_path(spark, "x")


def test_stored_star_round_trip(spark, tmp_path):
    star = testdata.star(spark, SMALL)
    write_star(star, str(tmp_path))
    write_star(star, str(tmp_path))
    stored = read_star(spark, str(tmp_path))
    for name in ("industry_baseline_trends", "escapism_index", "genre_performance_summary"):
        report = getattr(reports, name)
        assert sorted(tuples(report(stored))) == sorted(tuples(report(star)))


def test_indicator_and_macro_files(spark, tmp_path):
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "x.csv").write_text("indicator,year,value\nFP.CPI.TOTL.ZG,2000,3.4\nFP.CPI.TOTL.ZG,2001,\n")
    assert tuples(readers.read_indicators(spark, str(tmp_path / "i"))) == [
        ("FP.CPI.TOTL.ZG", 2000, 3.4), ("FP.CPI.TOTL.ZG", 2001, None),
    ]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "m.csv").write_text(
        ",".join(schemas.MACRO.fieldNames()) + "\n2022,8.0,2.5,3.65,First,Economic Crisis\n2022,8.0,2.5,3.65,Second,War\n"
    )
    macro = readers.read_macro(spark, str(tmp_path / "m"))
    assert tuples(dim_events(macro)) == [(2022, "First", "Economic Crisis")]
    assert tuples(dim_macroeconomics(macro)) == [(2022, 2.5, 3.65, 8.0)]


def _split_blocks(spark, size: int):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.mark.parametrize("size", [64, 700, 100_000])
def test_split_csv_equals_the_whole_read(spark, tmp_path, size):
    """Quoted line ends, doubled quotes, records over many blocks, blank lines and line ends."""
    rows = []
    for i in range(40):
        text = ["plain", 'a "quoted" word', "two\nlines", '"\n"\n\n"', "x," * 5, "", "long\n" * 60][i % 7]
        rows.append(_film_line(id=i, overview=text, title=f't"{i}', runtime="NaN" if i % 5 else 9.0))
    text = "\n".join([HEADER, *rows]).replace('"NaN"', "NaN")
    (tmp_path / "a.csv").write_text(text + "\n\n")
    (tmp_path / "b.csv").write_text(text.replace("\n1,", "\r\n1,"), newline="")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        _split_blocks(spark, size)
        films = readers.read_films_split(spark, str(tmp_path))
        got = films.orderBy("seq").drop("seq").collect()
        tasks = films.select("seq.block").distinct().count()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    wanted = readers.read_films(spark, str(tmp_path)).orderBy("seq").drop("seq").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in wanted] and len(got) == 80
    assert tasks > 1 or size == 100_000


def test_funnel_is_counted_by_the_write(spark, tmp_path):
    derived = testdata.raw_films(spark, SMALL)
    derived.write.parquet(str(tmp_path / "raw"))
    raw = spark.read.schema(derived.schema).parquet(str(tmp_path / "raw"))
    spark.sparkContext.setJobGroup("funnel-write", "")
    written = clean_module.write_clean(raw, str(tmp_path / "clean"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("funnel-write")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) == 1
    assert sorted(tuples(written)) == sorted(tuples(clean_funnel(raw)))
    assert spark.read.parquet(str(tmp_path / "clean")).count() == clean_films(raw).count()


def test_texts_are_dealt_to_as_many_tasks_as_their_files_call_for(spark, tmp_path, monkeypatch):
    def rows(name: str, schema: str, *some: tuple) -> None:
        spark.createDataFrame(list(some), schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    texts = [(i, f"text {i}", "en", "web", 6) for i in range(50)]
    rows("documents", testdata.TABLE_SCHEMAS["documents"], *texts, (None, "lost", "en", "web", 4))
    rows("part", testdata.TABLE_SCHEMAS["part"], *[(i, f"a ring {i}", "b", "t", 1, 1.0) for i in (1, 2, 70)])
    few = testdata.texts_by_id(spark, str(tmp_path))
    monkeypatch.setattr(testdata, "TEXT_TASK_BYTES", 64)
    many = testdata.texts_by_id(spark, str(tmp_path))
    films = testdata.film_dimension(spark, str(tmp_path), overviews=True)
    assert "RepartitionByExpression" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(many.fillna(-1).collect()) == sorted(few.fillna(-1).collect())
    assert {(r.movie_id, r.overview) for r in films.collect()} == {(1, "text 1"), (2, "text 2"), (70, None)}
