"""Text expressions: identifiers, titles, genre lists and money labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eraframe.constants import UNKNOWN_GENRE

# The characters that count as blank.
_BLANKS = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_BLANK = f"[{_BLANKS}]"
_OUTER_BLANKS = rf"^{_BLANK}+|{_BLANK}+\z"
_SEPARATORS = rf"{_BLANK}*[,|][,|{_BLANKS}]*"
_OUTER_SEPARATORS = rf"^[,|{_BLANKS}]+|[,|{_BLANKS}]+\z"
# One layer of straight quotes around the text, or the text without its blanks.
_TITLE = rf"""(?s)^{_BLANK}*+(?:["'](?:{_BLANK}*+(.*?){_BLANK}*["'])?|(.*?)){_BLANK}*\z"""
_BRACKETED = rf"(?s)^{_BLANK}*\[.*\]{_BLANK}*\z"


def strip_blanks(text: Column) -> Column:
    """Drop leading and trailing blanks of any kind, line ends included."""
    return F.regexp_replace(text, _OUTER_BLANKS, "")


def imdb_number(text: Column) -> Column:
    """First run of digits as BIGINT; null when there is none."""
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("bigint")


def strip_quotes(title: Column) -> Column:
    """Trim, then take off one layer of straight quotes, matching or not."""
    return F.regexp_replace(title, _TITLE, "$1$2")


def _json_genres(json: Column) -> Column:
    """Names of a JSON list of objects joined by ", "; null if unusable.

    Objects without a name are passed over. A name that is not text, or an
    entry that can hold no name at all, makes the whole value unusable. The
    text is parsed once, its entries are folded one after the other.
    """
    entries = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")

    def add(found: Column, entry: Column) -> Column:
        kind = F.schema_of_variant(entry)
        name_kind = F.schema_of_variant(F.try_variant_get(entry, "$.name", "variant"))
        name = F.try_variant_get(entry, "$.name", "string")
        spoils = (
            F.when(kind.startswith("OBJECT"), F.coalesce(name_kind != "STRING", F.lit(False)))
            .when(kind == "STRING", F.try_variant_get(entry, "$", "string").contains("name"))
            .otherwise(~kind.startswith("ARRAY"))
        )
        joined = F.when(name_kind == "STRING", F.concat_ws(", ", found["names"], name))
        return F.struct(
            (found["usable"] & ~spoils).alias("usable"),
            F.coalesce(joined, found["names"]).alias("names"),
        )

    nothing = F.struct(F.lit(True).alias("usable"), F.lit(None).cast("string").alias("names"))
    return F.aggregate(entries, nothing, add, lambda found: F.when(found["usable"], found["names"]))


def _plain_genres(text: Column) -> Column:
    """Entries between commas or pipes, blanks dropped, joined by ", "."""
    return F.regexp_replace(F.regexp_replace(text, _OUTER_SEPARATORS, ""), _SEPARATORS, ", ")


def genre_list(genres: Column) -> Column:
    """One clean ``"A, B"`` string out of the JSON and plain notations."""
    plain = F.coalesce(F.nullif(_plain_genres(genres), F.lit("")), F.lit(UNKNOWN_GENRE))
    json = F.translate(strip_blanks(genres), "'", '"')
    return F.coalesce(F.when(genres.rlike(_BRACKETED), _json_genres(json)), plain)


def primary_genre(genre: Column) -> Column:
    """Text before the first comma, the whole text where there is none."""
    return F.substring_index(genre, ",", 1)


def mentions_genre(genre: Column, name: str) -> Column:
    """Case-blind containment test."""
    return F.lower(genre).contains(name.lower())


def _fixed(value: Column, digits: int) -> Column:
    """Text of a positive double with 0 or 1 decimals, ties upwards.

    The tie test is made on the binary value itself: scaling by a power of two
    is exact, so 1.15 (stored slightly below) gives 1.1 and 1.25 gives 1.3.
    """
    bits = (
        F.when(value < 2.0**10, 52).when(value < 2.0**20, 42).when(value < 2.0**33, 29)
        .when(value < 2.0**43, 19).otherwise(9)
    )
    scale = F.pow(F.lit(2.0), bits)
    wide = "decimal(20,0)"
    # From 2**53 on a double is a whole number, and its units need not be counted.
    counted = F.when(value < 2.0**53, value * scale).otherwise(F.lit(0.0))
    units = counted.cast("bigint").cast(wide) * F.lit(10**digits).cast("decimal(2,0)")
    half = (scale / 2).cast("bigint").cast(wide)
    whole = F.call_function("div", units + half, scale.cast("bigint").cast(wide))
    large = value.cast("decimal(38,0)").cast("string")
    if digits == 0:
        return F.when(value < 2.0**53, whole.cast("string")).otherwise(large)
    tenths = F.concat_ws(
        ".", F.call_function("div", whole, F.lit(10)).cast("string"), (whole % 10).cast("string")
    )
    return F.when(value < 2.0**53, tenths).otherwise(F.concat(large, F.lit(".0")))


def format_currency(value: Column) -> Column:
    """Short money label: ``$1.2B``, ``$3.4M``, ``$5K`` or the plain number."""
    amount = value.cast("double")
    return (
        F.when(amount >= 1e9, F.concat(F.lit("$"), _fixed(amount / 1e9, 1), F.lit("B")))
        .when(amount >= 1e6, F.concat(F.lit("$"), _fixed(amount / 1e6, 1), F.lit("M")))
        .when(amount >= 1e3, F.concat(F.lit("$"), _fixed(amount / 1e3, 0), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), value.cast("string")))
    )
