from __future__ import annotations

import json
import threading
from dataclasses import replace
from pathlib import Path

import pytest

from eraframe import read_star, schemas, write_star
from eraframe.operators.numbering import numbered
from eraframe.plans import load
from eraframe.plans.reload import reload_star, year_digests
from eraframe.sources import commits, testdata
from tests.conftest import SMALL, tuples
from tests.test_stage_load import STAGED

ROWS = "k bigint, v string"


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def _read(spark, path, version=None):
    schema = _rows(spark, (1, "a")).schema
    return sorted(tuples(commits.read_rows(spark, path, "t", schema, version)), key=repr)


def test_null_key_is_added_once_and_rows_stay(spark, tmp_path):
    path = str(tmp_path)
    first = commits.append_absent(_rows(spark, (1, "old"), (None, "none")), path, "t", "k")
    assert first.number == 1 and first.notes == {"added": "2"}
    later = _rows(spark, (1, "new"), (None, "other"), (2, "z"), (2, "y"))
    second = commits.append_absent(later, path, "t", "k", "v")
    assert _read(spark, path) == [(1, "old"), (2, "y"), (None, "none")]
    # Nothing new: no further version.
    assert commits.append_absent(later, path, "t", "k", "v") == second
    assert _read(spark, path, first) == [(1, "old"), (None, "none")]


def test_key_order_may_leave_out_columns_without_order(spark, tmp_path):
    rows = _rows(spark, (1, "a")).selectExpr("k", "map('x', v) AS m")
    commits.append_absent(rows, str(tmp_path), "t", "k", "k")
    stored = commits.read_rows(spark, str(tmp_path), "t", rows.schema)
    assert tuples(stored) == [(1, {"x": "a"})]


def test_failed_load_leaves_nothing_to_read(spark, tmp_path):
    path = str(tmp_path)
    commits.append_absent(_rows(spark, (1, "a")), path, "t", "k")
    broken = _rows(spark, (2, "b"), (3, "x")).selectExpr(
        "k", "if(k = 3, raise_error('lost'), v) AS v"
    )
    with pytest.raises(Exception, match="lost"):
        commits.append_absent(broken, path, "t", "k", "k")
    # Files were written, but the load died before its commit.
    commits.write_rows(_rows(spark, (4, "half")), path, "t")
    assert _read(spark, path) == [(1, "a")]
    assert commits.versions(spark, path) == [1]


def test_second_of_two_loads_looks_again(spark, tmp_path):
    path = str(tmp_path)
    base = commits.latest(spark, path)
    mine = commits.write_rows(_rows(spark, (1, "late")), path, "t")
    commits.append_absent(_rows(spark, (1, "early")), path, "t", "k")
    with pytest.raises(commits.Conflict):
        commits.publish(spark, path, base, {"t": mine.folders})
    assert _read(spark, path) == [(1, "early")]


def test_loads_at_once(spark, tmp_path):
    path = str(tmp_path)
    failed = []

    def run(worker: int) -> None:
        try:
            rows = _rows(spark, (0, str(worker)), (worker, "own"), (None, str(worker)))
            commits.append_absent(rows, path, "t", "k")
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=run, args=(n,)) for n in range(1, 5)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert not failed
    assert sorted(k for k, _ in _read(spark, path) if k is not None) == [0, 1, 2, 3, 4]
    assert len(_read(spark, path)) == 6
    assert commits.versions(spark, path) == [1, 2, 3, 4]


def test_compaction_keeps_rows_and_later_loads(spark, tmp_path):
    path = str(tmp_path)
    for k in range(3):
        commits.append_absent(_rows(spark, (k, "x")), path, "t", "k")
    schema = _rows(spark, (1, "a")).schema
    version = commits.compact(spark, path, "t", schema)
    assert len(version.folders("t")) == 1 and len(_read(spark, path)) == 3
    assert commits.compact(spark, path, "t", schema) == version


def test_star_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path)
    star = testdata.star(spark, SMALL)
    write_star(star, path)
    reader = read_star(spark, path)
    write_star(replace(star, fact=star.fact.filter("date_key = 1997")), path)
    assert reader.fact.select("date_key").distinct().count() == 7
    assert tuples(read_star(spark, path).fact.select("date_key").distinct()) == [(1997,)]
    assert [json.loads(p.read_text())["notes"] for p in Path(path, "_commits").glob("0*.json")] == [{}, {}]


def test_no_star(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_star(spark, str(tmp_path))


def _fact(spark, *rows):
    return spark.createDataFrame(
        [(key, year, 1, 2, roi, 5.0, votes, 1.0) for key, year, roi, votes in rows],
        schemas.FACT_BOX_OFFICE,
    )


def test_reload_touches_changed_years_only(spark, tmp_path, make_star):
    path = str(tmp_path)
    old = [(1, 2000, 1.0, 5), (2, 2001, 1.0, 5), (3, 2002, None, 5), (3, 2002, None, 5), (9, None, 1.0, 1)]
    star = make_star([{"date_key": 2000}])
    first = reload_star(spark, path, replace(star, fact=_fact(spark, *old)))
    assert first.written == [None, 2000, 2001, 2002] and not first.kept
    files = {p: p.stat().st_mtime_ns for p in Path(path).rglob("fact_box_office/*/*/*.parquet")}
    # The same rows in another order, one changed year, one gone and one new.
    new = [old[4], old[3], old[2], (1, 2000, 1.0, 6), (7, 2003, 1.0, 1)]
    second = reload_star(spark, path, replace(star, fact=_fact(spark, *new)))
    assert (second.written, second.removed, second.kept) == ([2000, 2003], [2001], [None, 2002])
    assert {p: p.stat().st_mtime_ns for p in files} == files
    added = [p for p in Path(path).rglob("fact_box_office/*/*/*.parquet") if p not in files]
    assert {p.parent.name for p in added} == {"date_key=2000", "date_key=2003"}
    stored = read_star(spark, path).fact
    assert sorted(tuples(stored), key=repr) == sorted(tuples(_fact(spark, *new)), key=repr)
    third = reload_star(spark, path, replace(star, fact=_fact(spark, *new)))
    assert not third.written and not third.removed


def test_digests_tell_nulls_copies_and_columns_apart(spark):
    sets = [
        [(1, 2000, None, 5)], [(1, 2000, 0.0, 5)], [(1, 2000, None, 5)] * 2, [(1, 2000, None, 5)] * 3,
        [(5, 2000, None, 1)], [(1, 2000, None, 5), (1, 2000, 0.0, 5)],
    ]
    digests = [tuple(year_digests(_fact(spark, *rows)).first()) for rows in sets]
    assert len(set(digests)) == len(sets)


def test_numbers_are_gapless_over_many_tasks(spark):
    rows = spark.range(5000).selectExpr("id % 7 AS a", "if(id % 3 = 0, null, id) AS b")
    got = numbered(rows, ["a", "b"], "n", after=10).collect()
    assert sorted(r["n"] for r in got) == list(range(11, 5011))
    ordered = sorted(got, key=lambda r: r["n"])
    keys = [(r["a"], r["b"] is not None, r["b"] or 0) for r in ordered]
    assert keys == sorted(keys)
    assert numbered(rows.limit(0), ["a"], "n").collect() == []


def _staged(spark, *films):
    rows = [(i, film, f"t{film}", year, 1, 2, 90, None, "Drama", 7.0, 5000) for i, (film, year) in enumerate(films)]
    return spark.createDataFrame(rows, STAGED)


def test_film_keys_go_on_after_the_greatest(spark, tmp_path):
    path = str(tmp_path)
    load.append_movies(spark, path, _staged(spark, (50, 2000), (40, 2000), (50, 2001)))
    load.append_movies(spark, path, _staged(spark, (45, 2000), (50, 1999), (None, 2000), (None, 2001)))
    load.append_movies(spark, path, _staged(spark, (None, 1990), (40, 1990)))
    movies = commits.read_rows(spark, path, "dim_movies", schemas.DIM_MOVIES)
    keys = sorted(tuples(movies.select("movie_key", "movie_id", "title")))
    assert keys == [(1, 40, "t40"), (2, 50, "t50"), (3, None, "tNone"), (4, 45, "t45")]
