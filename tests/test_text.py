from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from eraframe.functions import text
from tests.conftest import tuples


def _apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    out = df.select("i", function(F.col("v")).alias("out")).orderBy("i")
    return [value for _, value in tuples(out)]


def _check(spark, function, cases, kind="string"):
    values, expected = zip(*cases, strict=True)
    assert _apply(spark, function, values, kind) == list(expected)


def test_imdb_number(spark):
    _check(
        spark,
        text.imdb_number,
        [
            ("tt0111161", 111161), ("abc", None), (None, None), ("", None), (' "tt12" ', 12),
            ("tt5/x9", 5), ("99999999999999999999", None),
        ],
    )


def test_strip_quotes(spark):
    _check(
        spark,
        text.strip_quotes,
        [
            ('"A"', "A"), ("'A\"", "A"), ('"', ""), ('""A""', '"A"'), ("“A”", "“A”"),
            (None, None), (' "A" \n', "A"), ('" A\t"', "A"), ('A"', 'A"'), ('"x\ny"', "x\ny"),
            ('""', ""), (" 'B'\x1f", "B"),
        ],
    )


def test_genre_list(spark):
    _check(
        spark,
        text.genre_list,
        [
            ("[{'name': 'Action'}, {'name': 'Comedy'}]", "Action, Comedy"),
            ('["Action"]', '["Action"]'),
            ("Action|Comedy", "Action, Comedy"),
            ("a,, b,", "a, b"),
            (None, "Unknown"),
            ("", "Unknown"),
            (" , | ", "Unknown"),
            # an entry without a name is passed over, a name that is no text spoils the list
            ("[{'name': 'A'}, {'id': 2}]", "A"),
            ("[{'name': 'A'}, 'x']", "A"),
            ("[{'name': 3}]", "[{'name': 3}]"),
            ("[{'name': null}, {'name': 'B'}]", "[{'name': null}, {'name': 'B'}]"),
            ("[1, {'name': 'A'}]", "[1, {'name': 'A'}]"),
            ("[{'name': 'A'}, 'rename']", "[{'name': 'A'}, 'rename']"),
            ("[{'name': ''}]", ""),
            ("[]", "[]"),
            ("[broken", "[broken"),
            ("[{'name': 'Rock 'n' Roll'}]", "[{'name': 'Rock 'n' Roll'}]"),
        ],
    )


def test_primary_genre(spark):
    _check(
        spark, text.primary_genre, [("A, B", "A"), ("A", "A"), (",A", ""), (None, None), ("", "")]
    )


@pytest.mark.parametrize(
    ("value", "label"),
    [
        (999, "$999"), (0, "$0"), (-5000, "$-5000"), (1000, "$1K"), (1499, "$1K"), (1500, "$2K"),
        (2500, "$3K"), (999_999, "$1000K"), (1_450_000, "$1.4M"), (1_250_000_000, "$1.3B"),
        (1_150_000_000, "$1.1B"), (4_000_000_000, "$4.0B"), (1_234_150_000_000, "$1234.2B"),
    ],
)
def test_format_currency(spark, value, label):
    assert _apply(spark, text.format_currency, [value], "bigint") == [label]
