"""Phrases of a test set found in documents by a positional inverted index.

Documents are read in shards. A posting holds a term, a shard and the places where the
term stands on the shard's axis of words; documents lie on it one after the other with
a gap between them. Postings are stored; a phrase meets them by equi-joins on
terms. Only shards with its rarest term become candidates, and there its lists,
moved by their offsets, are intersected from the shortest on.

Hot terms: a term has one posting per shard, however often it occurs, and joins on terms are
salted by shard. A group of the last step is one shard with one block of phrases,
so it is bounded whatever the size of the table or of the test set.

Defined cases: null and empty texts have no words and cannot hit or be hit; equal items
share their phrases, and each is reported; rows with one item id are one item, a null id
is an item named by the empty text; equal or null document ids are documents of their own;
long texts are read whole (a text beyond a shard's size is a shard). Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, may_hold, stored, whole_text
from .shards import dealt

WINDOW = 10
# Bytes of texts in a shard, and phrases of a block.
SHARD = 8_000_000
BLOCK = 20_000
# Parts that the postings of a term are dealt to in joins.
SALTS = 32
# Empty places between documents, more than any span of a proximity match.
GAP = 64

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class _Numbers(dict):
    """Numbers terms in the order in which they come up."""

    def __missing__(self, term: bytes) -> int:
        number = self[term] = len(self)
        return number


def _postings(number: int, table: pa.Table) -> pa.RecordBatch:
    """Rows of a shard: one per term, and one per document (without term)."""
    numbers = _Numbers()
    texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in table["text"]]
    counts = np.zeros(len(texts), np.int64)
    parts = []
    for i, text in enumerate(texts):
        words = _TERM.findall(text.lower())
        counts[i] = len(words)
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
    terms = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    firsts = np.cumsum(counts + GAP) - counts - GAP
    places = np.arange(len(terms)) + np.repeat(np.arange(len(texts)) * GAP, counts)
    order = np.argsort(terms, kind="stable")
    stops = np.searchsorted(terms[order], np.arange(len(numbers)), side="right")
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], stops]).astype(np.int32)),
        pa.array(places[order].astype(np.int32)),
    )
    n_terms, n_docs = len(numbers), len(texts)
    # Bytes of a regular expression match on valid UTF-8 at ASCII borders, so valid too.
    names = pa.array(list(numbers), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n_terms + n_docs, number, np.int64)),
            pa.concat_arrays([names, pa.nulls(n_docs, pa.string())]),
            pa.concat_arrays([lists, pa.nulls(n_docs, lists.type)]),
            pa.concat_arrays([pa.nulls(n_terms, pa.int64()), pa.array(firsts)]),
            pa.concat_arrays([pa.nulls(n_terms, pa.int64()), pa.array(counts)]),
            pa.concat_arrays(
                [
                    pa.nulls(n_terms, table["doc_id"].type),
                    table["doc_id"].combine_chunks(),
                ]
            ),
        ],
        names=["shard", "term", "places", "first", "n_words", "doc_id"],
    )


def build_index(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """The stored index: posting rows (``term``, ``places``) and document rows (``first``,
    ``n_words``, ``doc_id``), both with their ``shard``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in dealt(batches, "text", shard):
            yield _postings(number, table)

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        work,
        f"shard long, term string, places array<int>, first long, n_words long, doc_id {kind}",
    )
    return stored(made, "phrase-index", "zstd")


def term_list(text: Column) -> Column:
    """Words of a text: runs of digits, letters a-z in lower case, and non-ASCII characters."""
    return F.filter(F.split(ascii_lower(text), _BREAK), lambda w: w != "")


def phrases_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (``phrase``, ``item``): all windows of an item, or the whole of a shorter one."""
    words = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        term_list(whole_text()).alias("words"),
    ).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return (
        words.select("item", "words", F.explode(starts).alias("start"))
        .select(F.array_join(F.slice("words", F.col("start"), window), " ").alias("phrase"), "item")
        .distinct()
    )


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).alias("salt")


def _with_salts(terms: DataFrame) -> DataFrame:
    return terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def matched_postings(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """Postings of the terms that occur in phrases, stored: all that the search reads.

    Terms pass a filter of bits before the join, so that few others are moved.
    """
    wanted = phrases.select(F.explode(F.split("phrase", " ")).alias("term")).distinct()
    wanted = stored(wanted, "phrase-terms")
    postings = index.filter("term IS NOT NULL").select("shard", "term", "places", _salt("shard"))
    likely = postings.filter(may_hold(wanted, F.col("term")))
    return stored(likely.join(_with_salts(wanted), ["term", "salt"], "left_semi"), "postings")


def plan_phrases(phrases: DataFrame, postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """Phrases with their terms from the rarest on, each with its offset.

    A phrase with a term that the postings lack is left out, for it cannot match.
    ``terms`` is an array of (``n``, ``offset``, ``term``), ``block`` a bounded share of the phrases.
    """
    words = phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
    counted = postings.groupBy("term").agg(F.sum(F.size("places")).alias("n"))
    blocks = max(1, -(-phrases.count() // block))
    return (
        words.join(counted, "term")
        .groupBy("phrase")
        .agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("terms"))
        .filter(F.size("terms") == F.size(F.split("phrase", " ")))
        .withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(blocks)).cast("int"))
    )


def _near(lists: list[np.ndarray], within: int) -> np.ndarray:
    """Places of the first list with one of every other in one span of ``within`` words around them."""
    places = lists[0]
    back, ahead = [], []
    for others in lists[1:]:
        at = np.searchsorted(others, places)
        before = np.where(at > 0, places - others[at - 1], within)
        after = np.where(at < len(others), others[np.minimum(at, len(others) - 1)] - places, within)
        keep = np.minimum(before, after) < within
        if not keep.all():
            places, before, after = places[keep], before[keep], after[keep]
            back, ahead = [b[keep] for b in back], [a[keep] for a in ahead]
        if not len(places):
            return places
        back.append(np.minimum(before, within))
        ahead.append(np.minimum(after, within))
    if not back:
        return places
    behind, front = np.array(back), np.array(ahead)
    # A span begins at the place itself or at a term before it; the terms that are
    # farther back than its begin must lie ahead.
    fits = front.max(axis=0) < within
    for begin in behind:
        farther = np.where(behind > begin, front, 0).max(axis=0)
        fits |= begin + farther < within
    return places[fits]


def _exact(lists: list[np.ndarray], offsets: list[int]) -> np.ndarray:
    """Places where a phrase begins: lists, the shortest first, less their offsets, intersected."""
    begins = lists[0] - offsets[0]
    for places, offset in zip(lists[1:], offsets[1:], strict=True):
        at = np.searchsorted(places, begins + offset)
        begins = begins[places[np.minimum(at, len(places) - 1)] == begins + offset]
        if not len(begins):
            break
    return begins


def _match(left: pa.Table, right: pa.Table, within: int) -> pa.Table:
    """Matches of a block's phrases in a shard, one row per document that has any."""
    is_doc = np.asarray(left["term"].is_null())
    firsts = np.sort(np.asarray(left["first"].filter(pa.array(is_doc))))
    posted = left.filter(pa.array(~is_doc)).combine_chunks()
    column, names = posted["places"].combine_chunks(), posted["term"].combine_chunks()
    flat, stops = np.asarray(column.values), np.asarray(column.offsets)
    sizes = np.diff(stops)

    terms = right["terms"].combine_chunks()
    bounds = np.asarray(terms.offsets)
    number = pc.index_in(terms.values.field("term"), value_set=names)
    number = np.asarray(pc.fill_null(number, -1))
    offset = np.asarray(terms.values.field("offset"))
    spans: dict[int, list[tuple[int, int]]] = {}
    exact: dict[int, list[str]] = {}
    near: dict[int, list[str]] = {}
    # Phrases with a term that the shard lacks cannot match in it.
    for row in np.flatnonzero(np.minimum.reduceat(number, bounds[:-1]) >= 0).tolist():
        own = number[bounds[row] : bounds[row + 1]]
        order = np.argsort(sizes[own], kind="stable")
        lists = [flat[stops[n] : stops[n + 1]] for n in own[order]]
        begins = _exact(lists, offset[bounds[row] : bounds[row + 1]][order])
        hit: list[int] = []
        if len(begins):
            docs = (np.searchsorted(firsts, begins, side="right") - 1).tolist()
            for doc, begin in zip(docs, begins.tolist(), strict=True):
                spans.setdefault(doc, []).append((begin, begin + len(own)))
            hit = sorted(set(docs))
            for doc in hit:
                exact.setdefault(doc, []).append(right["phrase"][row].as_py())
        if within:
            distinct = dict(zip(own[order].tolist(), lists, strict=True))
            beside = _near(list(distinct.values()), within)
            docs = np.unique(np.searchsorted(firsts, beside, side="right") - 1)
            for doc in np.setdiff1d(docs, hit).tolist():
                near.setdefault(doc, []).append(right["phrase"][row].as_py())
    found = sorted(exact.keys() | near.keys())
    merged = [_merged(spans.get(doc, [])) for doc in found]
    return pa.table(
        {
            "shard": pa.array([left["shard"][0].as_py()] * len(found), pa.int64()),
            "first": pa.array([int(firsts[doc]) for doc in found], pa.int64()),
            "spans": pa.array(
                [
                    [{"start": s - int(firsts[doc]), "stop": e - int(firsts[doc])} for s, e in m]
                    for doc, m in zip(found, merged, strict=True)
                ],
                pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])),
            ),
            "phrases": pa.array([exact.get(doc, []) for doc in found], pa.list_(pa.string())),
            "near": pa.array([near.get(doc, []) for doc in found], pa.list_(pa.string())),
        }
    )


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
        else:
            merged.append((start, stop))
    return merged


_FOUND = (
    "shard long, first long, spans array<struct<start: long, stop: long>>, "
    "phrases array<string>, near array<string>"
)


def search(
    index: DataFrame, phrases: DataFrame, within: int = 0, block: int = BLOCK
) -> DataFrame:
    """Documents of the index (``shard``, ``first``) with matches of ``phrases``.

    ``spans`` are the places, in words of the document, that exact matches cover, merged per
    block of phrases; ``phrases`` the ones that match. With ``within``, ``near`` has those that match
    nowhere in the document, but all of whose words stand in a span of so many words, in any order.
    """
    if within > GAP:
        raise ValueError(f"a proximity span has at most {GAP} words")
    postings = matched_postings(phrases, index)
    documents = index.filter("term IS NULL")
    planned = stored(plan_phrases(phrases, postings, block), "phrase-plan")

    rarest = planned.select("phrase", "terms", "block", F.col("terms")[0]["term"].alias("term"))
    candidates = _with_salts(rarest).join(postings.select("shard", "term", "salt"), ["term", "salt"])
    candidates = candidates.select(
        F.col("shard").alias("in_shard"), F.col("block").alias("in_block"), "phrase", "terms"
    )

    wanted = planned.select("block", F.explode("terms.term").alias("term")).distinct()
    lists = postings.join(_with_salts(wanted), ["term", "salt"])
    lists = lists.select("shard", "block", "term", "places", F.lit(None).cast("long").alias("first"))
    axes = documents.select("shard", "first").withColumn("term", F.lit(None).cast("string"))
    last = planned.agg(F.max("block")).first()[0] or 0
    axes = axes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last))))
    axes = axes.withColumn("places", F.lit(None).cast("array<int>"))
    left = lists.unionByName(axes)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        return _match(left, right, within) if left.num_rows and right.num_rows else _none()

    return (
        left.groupBy("shard", "block")
        .cogroup(candidates.groupBy("in_shard", "in_block"))
        .applyInArrow(work, _FOUND)
    )


def _none() -> pa.Table:
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), span, pa.list_(pa.string()), pa.list_(pa.string())]
    names = ["shard", "first", "spans", "phrases", "near"]
    return pa.table([pa.array([], k) for k in kinds], names=names)


def covered(spans: Column) -> Column:
    """Words that spans cover, each counted once; a running sum over spans by start."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("reach")),
        lambda acc, s: F.struct(
            (acc["sum"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], acc["reach"]))).alias(
                "sum"
            ),
            F.greatest(acc["reach"], s["stop"]).alias("reach"),
        ),
        lambda acc: acc["sum"],
    )


def contamination(
    docs: DataFrame, items: DataFrame, within: int = 0, shard: int = SHARD, block: int = BLOCK
) -> DataFrame:
    """Every document with what of the items it holds.

    Returns ``doc_id``, ``n_words``, ``n_hit`` (words inside matches), ``spans``, ``items`` (sorted
    names of the items with an exact match) and ``near_items`` (those with proximity matches alone).
    """
    index = build_index(docs, shard)
    phrases = stored(phrases_of(items), "phrases")
    found = stored(
        search(index, phrases.select("phrase").distinct(), within, block), "phrase-matches"
    )
    rows = ["shard", "first"]

    def named(column: str) -> DataFrame:
        listed = found.select(*rows, F.explode(column).alias("phrase"))
        return listed.join(phrases, "phrase").select(*rows, "item").distinct()

    exact = named("phrases").withColumn("exact", F.lit(True))
    near = named("near").withColumn("exact", F.lit(False))
    both = exact.unionByName(near).groupBy(*rows, "item").agg(F.max("exact").alias("exact"))
    items_of = both.groupBy(*rows).agg(
        F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"),
        F.sort_array(F.collect_list(F.when(~F.col("exact"), F.col("item")))).alias("near_items"),
    )
    spans_of = found.groupBy(*rows).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    documents = index.filter("term IS NULL").select(*rows, "doc_id", "n_words")
    no_names = F.array().cast("array<string>")
    return (
        documents.join(spans_of, rows, "left")
        .join(items_of, rows, "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
            "spans",
            F.coalesce("items", no_names).alias("items"),
            F.coalesce("near_items", no_names).alias("near_items"),
        )
    )
