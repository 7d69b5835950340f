"""Inputs with every oddity that the operators must take, and plain readings of texts."""

from __future__ import annotations

import re

import duckdb

from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "size int, score double, spans string, component string, `rank` int"
)
LARGE_ID = 2**61 + 1


def small_documents() -> list[tuple[int, str]]:
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id")
    return rows.fetchall()


def odd_rows() -> list[tuple]:
    """Nulls in each column, empty, blank and very long texts, ties and repeated rows."""
    base = " ".join(f"w{i % 97}x{i % 31}" for i in range(120))
    texts = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, None, "en", "a"),
        (4, "", "en", "b"),
        (5, " \t\n\x0b\x0c\r ", "en", "b"),
        (None, base + " tail", "en", "b"),
        (None, None, None, None),
        (None, None, None, None),
        (6, "one", None, "b"),
        (7, "one two", "fr", None),
        (8, "mail a.b@c.de now +49 30 1234567 \U0001f600 10.0.0.1", "fr", "z"),
        (9, "é" * 300 + "\x00\x1c\x85 ß " + base, "fr", "z"),
        (LARGE_ID, " ".join(f"long{i * 7919 % 10007}" for i in range(30_000)), "en", "a"),
        (LARGE_ID + 1, "x" * 60_000, "en", "a"),
        (12, "AKIA" + "Z" * 20 + " token = abcdefgh12 " + "0a" * 20, "en", "a"),
    ]
    return [(*t, 99, 7, 0.5, "s", "c", 3) for t in texts]


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def rows_of(df, *columns: str) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


UPPER_TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
