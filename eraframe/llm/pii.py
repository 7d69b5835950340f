"""Personal data: patterns, and terms that give protected values away.

Base kinds are found by pattern. A term that mostly occurs in or beside lines with
one protected value tells as much as the value itself: by corpus counts of lines its
pointwise mutual information comes close to the value's information content. Such
terms are removed or generalised where the value is protected. Everything is a
DataFrame expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    ROW_KEY,
    before_each,
    let,
    may_hold,
    row_key,
    stored,
    whole_text,
    with_any_columns,
)

# Kinds in their order, each with its pattern. A match can only start
# where a run of its characters starts or the last match ended, and takes all it can;
# said so, no pattern tries a run again from its middle. Runs of fewer than twelve digits
# are no card, and texts may have very many of them, so they are no match.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = [*PATTERNS, "term"]
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

IN_TERM, NO_TERM = r"[\p{L}\p{M}\p{N}]", r"[^\p{L}\p{M}\p{N}]+"
_RUN = 1024  # code points of a text that are cut out of at a time
# Part of the lines with a term that must have the value for a disclosure.
CERTAINTY = 0.75
DISCLOSURE = 0.9  # share of a value's information that a term may not reach
REMOVAL = 0.99  # from here on it is removed, below it is generalised


def located(text: Column, pattern: str | Column) -> Column:
    """Leftmost matches of a pattern as (start, end, value), in code points.

    The text is split at the matches; lengths of pieces and matches add up to places.
    """
    expression = F.lit(pattern) if isinstance(pattern, str) else pattern

    def spans(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: p["gap"] + F.coalesce(F.length(p["value"]), F.lit(0)))
        placed = F.zip_with(
            parts,
            before_each(lengths, lambda a, b: a + b, F.lit(0)),
            lambda p, at: F.struct(
                (at + p["gap"]).alias("start"),
                (at + p["gap"] + F.length(p["value"])).alias("end"),
                p["value"].alias("value"),
            ),
        )
        return F.filter(placed, lambda s: s["value"].isNotNull())

    parts = F.zip_with(
        F.split(text, expression, -1),
        F.regexp_extract_all(text, expression, F.lit(0)),
        lambda piece, value: F.struct(F.length(piece).alias("gap"), value.alias("value")),
    )
    return let(parts, spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digit sum, every second digit from the right doubled, ends in 0."""

    def weighed(i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    numbers = F.transform(F.sequence(F.lit(1), F.length(digits)), weighed)
    return F.aggregate(numbers, F.lit(0), lambda a, d: a + d) % 10 == 0


def _accepted(kind: str, value: Column) -> Column:
    """Whether a match counts as personal data."""
    if kind == "ip":
        parts = F.split(value, r"\.")
        small = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(
            parts,
            lambda p: (F.length(small(p)) < 3)
            | ((F.length(small(p)) == 3) & (small(p) <= "255")),
        )
    if kind == "card":
        size = F.length(_digits(value))
        return F.when(size.between(12, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _possible(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match of the kind passes."""
    if kind == "card":
        return text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")
    hint = F.contains(text, F.lit(HINTS[kind]))
    return hint & text.rlike(r"[0-9]\.[0-9]") if kind == "ip" else hint


def base_spans(text: Column) -> Column:
    """All base spans (start, nth, end, kind, value) by start, then kind."""

    def of_kind(nth: int, kind: str, pattern: str) -> Column:
        found = F.filter(located(text, pattern), lambda s: _accepted(kind, s["value"]))
        named = F.transform(
            found,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(nth).alias("nth"),
                s["end"].alias("end"),
                F.lit(kind).alias("kind"),
                s["value"].alias("value"),
            ),
        )
        return F.when(_possible(kind, text), named)

    kinds = F.array_compact(
        F.array(*[of_kind(n, kind, p) for n, (kind, p) in enumerate(PATTERNS.items())])
    )
    return F.sort_array(F.flatten(kinds))


def _entities(spans: Column) -> Column:
    """Protected values of spans, cards and phones by their digits."""
    return F.array_distinct(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":",
                s["kind"],
                F.when(s["kind"].isin("card", "phone"), _digits(s["value"])).otherwise(
                    F.lower(s["value"])
                ),
            ),
        )
    )


def _terms(line: Column) -> Column:
    """Distinct runs of letters and digits of a line, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(line), NO_TERM), lambda w: w != ""))


def _without_values(line: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, " "), PATTERNS.values(), line)


def _share(both: Column, n_term: Column, n_value: Column, n_lines: Column) -> Column:
    """Share of a value's information that a term has, by counts of lines; null where the value
    is in all lines and so has none."""
    return F.try_divide(
        F.log(both * n_lines / (n_term * n_value)), F.log(n_lines / n_value)
    )


def _sure_share(both: Column, n_term: Column, n_value: Column, n_lines: Column) -> Column:
    """The share that decides, or 0.

    Part of a line with the term, in which the value is as likely as anywhere, is added for
    chance: a whole one where they met once, half as much with each further meeting. And
    the value must be in three quarters of the lines with the term: the share alone grows with
    the corpus, so that a word of a dozen lines that once meets a value has nearly all of its
    information among a billion lines.
    """
    chance = F.pow(F.lit(2.0), 1 - both)
    share = _share(both + chance * n_value / n_lines, n_term + chance, n_value, n_lines)
    likely = both >= CERTAINTY * n_term
    return F.coalesce(F.when(likely, share), F.lit(0.0))


def _value_lines(found: DataFrame) -> DataFrame:
    """(entities, near, terms) of the lines in or beside which a value is."""

    def around(values: Column) -> Column:
        beside = lambda i: F.coalesce(F.get(values, i), F.array().cast("array<string>"))
        return F.transform(
            values,
            lambda own, i: F.struct(
                own.alias("entities"),
                F.array_distinct(F.concat(own, beside(i - 1), beside(i + 1))).alias("near"),
            ),
        )

    lines = F.split("text", "\n")
    values = F.transform(lines, lambda line: _entities(base_spans(line)))
    return (
        found.select(F.explode(F.arrays_zip(lines.alias("line"), let(values, around).alias("v"))).alias("l"))
        .select("l.line", "l.v.entities", "l.v.near")
        .filter(F.size("near") > 0)
        .select(
            "entities",
            "near",
            _terms(_without_values(F.col("line"))).alias("terms"),
        )
    )


def disclosing_terms(
    docs: DataFrame,
    found: DataFrame,
    disclosure: float = DISCLOSURE,
) -> DataFrame:
    """(entity, term, share, sure, spread): terms that reach ``disclosure`` of a value's
    information. ``spread`` ones are in lines, too, that are not in or beside the value's.

    ``docs`` are all documents, ``found`` the texts with protected values.
    A term's contexts are its lines; the value is in the line, or else in the line or
    one beside it, whichever tells more. With N lines, n(a) with the value so placed,
    a term in n(t) and both in n(t,a), the share is
    log(n(t,a) N / n(t) n(a)) / log(N / n(a)): 1 if the term occurs with this value only.

    ``sure`` is the share that decides (see :func:`_sure_share`). n(t) also counts lines in
    which a value itself has the word, so a common part of values is not disclosing.
    """
    held = stored(_value_lines(found), "pii-lines")
    near = F.explode("near").alias("entity")
    own = F.array_contains("entities", F.col("entity")).cast("long")
    by_entity = (
        held.select(near, "entities")
        .select("entity", own.alias("own"))
        .groupBy("entity")
        .agg(F.sum("own").alias("n_own"), F.count(F.lit(1)).alias("n_near"))
    )
    pairs = (
        held.select(near, "entities", "terms")
        .select("entity", own.alias("own"), F.explode("terms").alias("term"))
        .groupBy("entity", "term")
        .agg(F.sum("own").alias("own_both"), F.count(F.lit(1)).alias("near_both"))
    )
    candidates = stored(pairs, "pii-pairs")
    every_line = docs.select(F.explode(F.split(whole_text("text"), "\n")).alias("line"))
    # Counted before the join, so that a word moves once per task and not once per line.
    n_terms = (
        every_line.select(F.explode(_terms(F.col("line"))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n_term"))
        .join(candidates.select("term").distinct(), "term", "left_semi")
    )
    n_lines = docs.agg(
        F.sum(F.regexp_count(whole_text("text"), F.lit("\n")) + 1).cast("double").alias("n_lines")
    ).scalar()

    def shares(at: str) -> list[Column]:
        both, value, lines = F.col(f"{at}_both"), F.col(f"n_{at}"), F.col("n_lines")
        counts = (both, F.col("n_term"), value, lines)
        return [F.when(both > 0, _share(*counts)), F.when(both > 0, _sure_share(*counts))]

    (own_share, own_sure), (near_share, near_sure) = shares("own"), shares("near")
    return (
        candidates.join(n_terms, "term")
        .join(by_entity, "entity")
        .withColumn("n_lines", n_lines)
        .withColumn("share", F.greatest(own_share, near_share))
        .withColumn("sure", F.greatest(own_sure, near_sure))
        .filter(F.col("sure") >= disclosure)
        .select(
            "entity", "term", "share", "sure", (F.col("n_term") > F.col("near_both")).alias("spread")
        )
    )


def find_private(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), everywhere: bool = False
) -> DataFrame:
    """Columns ``keep`` of every document, its ``blob`` digest, and ``spans``: structs
    (start, nth, end, kind, value, gone), base kinds and disclosing terms, by start and
    then kind. Terms are marked in texts that hold their value, or ``everywhere``.

    Null texts are empty and have no spans; equal texts have equal spans; repeated
    rows give a row each, and no rows none.
    """
    text = whole_text("text")
    base = docs.select(
        *keep,
        F.sha2(text, 256).alias("blob"),
        text.alias("_text"),
        base_spans(text).alias("base"),
    )
    # One pass over all texts; only those with protected values are held on to.
    held = stored(
        base.withColumn("_text", F.when(F.size("base") > 0, F.col("_text"))), "pii-base"
    )
    found = held.filter(F.size("base") > 0)
    risky = stored(
        disclosing_terms(docs, found.select(F.col("_text").alias("text"))),
        "pii-risky",
    )
    pairs = (
        found.select("blob", F.explode(_entities(F.col("base"))).alias("entity"))
        .distinct()
        .join(risky, "entity")
        .select("blob", "term", "sure")
    )
    texts = found.select("blob", "_text")
    if everywhere:
        # Terms that are not spread have no line in other texts.
        spread = stored(
            risky.filter("spread").groupBy("term").agg(F.max("sure").alias("sure")), "pii-spread"
        )
        texts = docs.select(F.sha2(text, 256).alias("blob"), text.alias("_text"))
        others = texts.select("blob", F.explode(_terms(F.col("_text"))).alias("term")).filter(
            may_hold(spread, F.col("term"))
        )
        pairs = stored(
            pairs.unionByName(others.join(spread, "term").select("blob", "term", "sure")),
            "pii-told",
        )
    told = (
        pairs.groupBy("blob", "term")
        .agg(F.max("sure").alias("sure"))
        .groupBy("blob")
        .agg(F.collect_list(F.struct("term", "sure")).alias("told"))
    )
    words = F.transform("told", lambda t: t["term"])
    pattern = F.concat(
        F.lit(rf"(?iu)(?<!{IN_TERM})(?:"),
        F.array_join(F.array_sort(words), "|"),
        F.lit(rf")(?!{IN_TERM})"),
    )
    shares = F.map_from_entries("told")
    terms = (
        texts.join(told, "blob")
        .dropDuplicates(["blob"])
        .select(
            F.col("blob").alias("_blob"),
            F.transform(
                located(F.col("_text"), pattern),
                lambda s: F.struct(
                    s["start"].alias("start"),
                    F.lit(len(PATTERNS)).alias("nth"),
                    s["end"].alias("end"),
                    F.lit("term").alias("kind"),
                    s["value"].alias("value"),
                    (
                        F.coalesce(F.try_element_at(shares, F.lower(s["value"])), F.lit(0.0))
                        >= REMOVAL
                    ).alias("gone"),
                ),
            ).alias("_terms"),
        )
    )
    named = F.transform("base", lambda s: s.withField("gone", F.lit(False)))
    return held.join(terms, held["blob"] == terms["_blob"], "left").select(
        *keep,
        "blob",
        F.when(F.col("_terms").isNull(), named)
        .otherwise(F.sort_array(F.concat(named, F.col("_terms"))))
        .alias("spans"),
    )


def sanitised(text: Column, spans: Column) -> Column:
    """``text`` with spans replaced by the label of their kind, removed terms by
    nothing. Spans that overlap an earlier one only remove what it left.

    The text is cut into runs of 1,024 code points first, so that a piece of it is found without
    reading all that stands before.
    """

    def piece(runs: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / _RUN).cast("int"), F.floor(end / _RUN).cast("int")
        head = F.substring(F.get(runs, first), start % _RUN + 1, F.least(end - start, F.lit(_RUN)))
        tail = F.coalesce(F.substring(F.get(runs, last), F.lit(1), end % _RUN), F.lit(""))
        middle = F.array_join(F.slice(runs, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        across = F.concat(head, middle, tail)
        return F.when(start >= end, "").when(first == last, head).otherwise(across)

    def label(span: Column, reached: Column) -> Column:
        name = F.lit("")
        for kind, own in LABELS.items():
            name = F.when(span["kind"] == kind, F.lit(own)).otherwise(name)
        return F.when(span["gone"] | (span["start"] < reached), F.lit("")).otherwise(name)

    def joined(runs: Column, spans: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        parts = F.zip_with(
            spans,
            before_each(ends, lambda a, b: F.greatest(a, b), F.lit(0)),
            lambda s, reached: F.concat(piece(runs, reached, s["start"]), label(s, reached)),
        )
        rest = piece(runs, F.array_max(ends), F.length(text))
        return F.concat(F.array_join(parts, ""), rest)

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_RUN}}}"), F.lit(0))
    whole = lambda own: let(cut, lambda runs: joined(runs, own))
    return F.when(F.size(spans) == 0, text).otherwise(let(spans, whole))


@with_any_columns("text", "n_chars")
def sanitise_documents(docs: DataFrame, everywhere: bool = False) -> DataFrame:
    """The documents, with the columns they have, with private spans replaced in text.
    Disclosing terms go from texts that hold their value, or ``everywhere``.

    Texts without spans, null ones included, stay as they are.
    """
    keyed = docs.withColumn(ROW_KEY, row_key(docs))
    private = (
        find_private(keyed, keep=(ROW_KEY,), everywhere=everywhere)
        .filter(F.size("spans") > 0)
        .select(ROW_KEY, F.col("spans").alias("_spans"))
        .dropDuplicates([ROW_KEY])
    )
    clean = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(
        sanitised(F.col("text"), F.col("_spans"))
    )
    joined = keyed.join(private, ROW_KEY, "left").withColumn("text", clean)
    if "n_chars" in docs.columns:
        changed = F.col("_spans").isNotNull()
        joined = joined.withColumn(
            "n_chars",
            F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(
                F.col("n_chars")
            ),
        )
    return joined.select(*docs.columns)
