"""Alignment of the tokens of two tokenizers over the bytes of a text.

All documents of a shard are merged in lockstep: a state vector holds, for every document
still under way, the token of A and the token of B that it has come to. Each step
emits the link of both, cuts where both end at one byte, and moves on the side that ends
first; documents that are done leave the vector. The tokens of a long
document are dealt to several places of the vector, each with its own stretch of A tokens,
so that one long text does not add steps with a nearly empty vector.

Defined cases: a text that is null or empty, or that either tokenizer does not give back byte
by byte, has no tokens, links or groups; equal and repeated rows count as documents
of their own; ids may be null or equal; texts of any length are aligned whole. Other columns
are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .shards import dealt

# Bytes of texts in a shard; A tokens of one place in the state vector.
SHARD = 3_000_000
LANE = 1024
# Chunks whose tokens a worker remembers before it starts afresh.
_REMEMBERED = 400_000
_SPACE = "▁"


def _byte_of_mark() -> dict[str, int]:
    """Bytes by the characters that stand for them in byte-level vocabularies: printable
    Latin-1 characters for themselves, all others by characters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Chunks(dict):
    """Token ids of chunks of text, which tokens never cross, kept once per distinct chunk."""

    def __init__(self, split: Callable[[str], list[str]], encode, token_bytes: list[bytes]) -> None:
        super().__init__()
        self.split, self.encode_all = split, encode
        self.token_bytes = token_bytes
        self.lengths = np.array([len(t) for t in token_bytes], np.int32)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.flat = np.zeros(0, np.int32)
        self.stops = np.zeros(1, np.int64)  # where the ids of each chunk end, after a 0
        self.sound = np.zeros(0, bool)

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number

    def learn(self) -> None:
        """Encodes the chunks that came up since the last call."""
        if not self.new:
            return
        ids = self.encode_all(self.new)
        told = self.token_bytes
        sound = [
            b"".join([told[i] for i in part]) == chunk.encode()
            for part, chunk in zip(ids, self.new, strict=True)
        ]
        sizes = np.array([len(part) for part in ids], np.int64)
        self.flat = np.concatenate([self.flat, np.array([i for p in ids for i in p], np.int32)])
        self.stops = np.concatenate([self.stops, self.stops[-1] + np.cumsum(sizes)])
        self.sound = np.concatenate([self.sound, np.array(sound, bool)])
        self.new = []

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of every text, and whether its tokens are its bytes."""
        if len(self) > _REMEMBERED:
            self.forget()
        numbers = []
        for text in texts:
            chunks = self.split(text)
            numbers.append(np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks)))
        self.learn()
        ids, sound = [], []
        for number in numbers:
            begins = self.stops[number]
            sizes = self.stops[number + 1] - begins
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            ids.append(self.flat[np.arange(total) + np.repeat(begins - (ends - sizes), sizes)])
            sound.append(bool(self.sound[number].all()))
        return ids, sound


def _byte_chunks(path: str) -> _Chunks:
    """Chunks of the byte-level tokenizer: its words begin at a space before a character
    that is no space, whatever stands before."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    byte_of = _byte_of_mark()
    table = [b""] * tokenizer.get_vocab_size()
    for mark, number in tokenizer.get_vocab().items():
        table[number] = bytes([byte_of[c] for c in mark]) if set(mark) <= byte_of.keys() else b""
    before_word = re.compile(r" (?=\S)")

    def split(text: str) -> list[str]:
        first, *rest = before_word.split(text)
        return ([first] if first else []) + [" " + r for r in rest]

    def encode(chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    return _Chunks(split, encode, table)


def _piece_chunks(path: str) -> _Chunks:
    """Chunks of the piece tokenizer, which puts a space before every text: a chunk begins at
    a space after a character that is none. No piece holds a space behind another character, so
    none crosses into a chunk; a vocabulary with such pieces gets whole texts."""
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=path)
    table = []
    for number in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(number)
        if pieces.is_byte(number):
            table.append(bytes([int(piece[3:-1], 16)]))
        elif pieces.is_control(number) or pieces.is_unknown(number):
            table.append(b"")
        else:
            table.append(piece.replace(_SPACE, " ").encode())
    inside = any(_SPACE in pieces.id_to_piece(n).lstrip(_SPACE) for n in range(len(table)))
    alone = [pieces.piece_to_id(_SPACE)]
    at_word = re.compile(r"(?<! ) ")

    def split(text: str) -> list[str]:
        return [text] if inside else [" " + chunk for chunk in at_word.split(text)[1:]]

    def encode(chunks: list[str]) -> list[list[int]]:
        # The tokenizer adds the space that each chunk begins with.
        ids = pieces.encode([chunk[1:] for chunk in chunks], num_threads=1)
        return [part if len(chunk) > 1 else alone for part, chunk in zip(ids, chunks, strict=True)]

    return _Chunks(split, encode, table)


@functools.lru_cache(maxsize=1)
def tokenizers(path_a: str, path_b: str) -> tuple[_Chunks, _Chunks]:
    return _byte_chunks(path_a), _piece_chunks(path_b)


def merge(
    ends_a: np.ndarray, ends_b: np.ndarray, stops_a: np.ndarray, lane: int = LANE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (A token, B token) and cuts (flags of A and of B tokens) of all documents of a shard.

    ``ends_a`` and ``ends_b`` are ascending ends of the tokens in the joined bytes of all documents,
    where the tokens of both end with every document; ``stops_a`` are the counts of A tokens
    up to the end of each document.
    """
    n_a = len(ends_a)
    cut_a, cut_b = np.zeros(n_a, bool), np.zeros(len(ends_b), bool)
    if not n_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), cut_a, cut_b
    begins = np.concatenate([[0], stops_a[:-1]])
    pieces = np.maximum(-(-(stops_a - begins) // lane), 0)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    i = np.repeat(begins, pieces) + within * lane
    stop = np.minimum(i + lane, np.repeat(stops_a, pieces))
    first_byte = np.where(i > 0, ends_a[i - 1], 0)
    j = np.searchsorted(ends_b, first_byte, side="right")
    last_b = np.searchsorted(ends_b, ends_a[stop - 1], side="left")
    # A stretch of a and b tokens has fewer than a + b links.
    room = np.cumsum((stop - i) + (last_b - j + 1))
    at = np.concatenate([[0], room[:-1]])
    link_a = np.full(room[-1], -1, np.int32)
    link_b = np.full(room[-1], -1, np.int32)
    while len(i):
        link_a[at], link_b[at] = i, j
        end_a, end_b = ends_a[i], ends_b[j]
        move_a, move_b = end_a <= end_b, end_b <= end_a
        both = move_a & move_b
        cut_a[i[both]] = True
        cut_b[j[both]] = True
        at += 1
        i = i + move_a
        j = j + move_b
        under_way = i < stop
        if not under_way.all():
            i, j, stop, at = i[under_way], j[under_way], stop[under_way], at[under_way]
    made = link_a >= 0
    return link_a[made], link_b[made], cut_a, cut_b


@functools.lru_cache(maxsize=1)
def _texts_upto(power: int) -> list[str]:
    return [f"{number}{mark}" for number in range(2**power) for mark in ",|;"]


def _marked_ids(most: int) -> list[str]:
    """Ids below ``most`` (and a few more), each with the three marks in turn."""
    return _texts_upto(max(16, int(most).bit_length()))


def group_texts(
    ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray
) -> list[str]:
    """The tokens of all groups as text, in order, each with the mark that follows it."""
    n = len(ids_a) + len(ids_b)
    upto_a = np.flatnonzero(cut_a) + 1  # tokens up to the end of each group
    upto_b = np.flatnonzero(cut_b) + 1
    before_b = np.concatenate([[0], upto_b])
    group_a = np.cumsum(cut_a) - cut_a
    group_b = np.cumsum(cut_b) - cut_b
    place_a = np.arange(len(ids_a)) + before_b[group_a]
    place_b = np.arange(len(ids_b)) + upto_a[group_b]
    # Numbers of texts: an id with the mark that follows it.
    code = np.empty(n, np.int64)
    code[place_a] = ids_a * 3 + np.where(cut_a, 1, 0)
    code[place_b] = ids_b * 3 + np.where(cut_b, 2, 0)
    texts = _marked_ids(int(code.max(initial=0)) // 3 + 1)
    return [texts[k] for k in code.tolist()]


def _aligned(
    number: int, table: pa.Table, both: tuple[_Chunks, _Chunks], lane: int = LANE
) -> pa.RecordBatch:
    """Rows of a shard: one per document, and one per distinct id pair (without ``n_a``)."""
    texts = [" " + t if t else "" for t in table["text"].to_pylist()]
    found = [chunks.tokens(texts) for chunks in both]
    sound = [bool(t) and a and b for t, a, b in zip(texts, found[0][1], found[1][1], strict=True)]
    empty = np.zeros(0, np.int32)
    (ids_a, n_a), (ids_b, n_b) = (
        (
            np.concatenate([i if ok else empty for i, ok in zip(ids, sound, strict=True)] + [empty]),
            np.array([len(i) if ok else 0 for i, ok in zip(ids, sound, strict=True)], np.int64),
        )
        for ids, _ in found
    )
    stops_a, stops_b = np.cumsum(n_a), np.cumsum(n_b)
    link_a, link_b, cut_a, cut_b = merge(
        np.cumsum(both[0].lengths[ids_a], dtype=np.int64),
        np.cumsum(both[1].lengths[ids_b], dtype=np.int64),
        stops_a,
        lane,
    )
    doc_of_a = np.repeat(np.arange(len(texts)), n_a)
    doc_of_link = doc_of_a[link_a]
    n_links = np.bincount(doc_of_link, minlength=len(texts))
    n_groups = np.bincount(doc_of_a[cut_a], minlength=len(texts))

    width = len(both[1].lengths)
    pairs, pair = np.unique(
        ids_a[link_a].astype(np.int64) * width + ids_b[link_b], return_inverse=True
    )
    held, times = np.unique(doc_of_link * max(len(pairs), 1) + pair, return_counts=True)
    held_doc, held_pair = np.divmod(held, max(len(pairs), 1))
    holders = np.bincount(held_pair, minlength=len(pairs))
    held_stops = np.searchsorted(held_doc, np.arange(len(texts)), side="right")
    offsets = pa.array(np.concatenate([[0], held_stops]).astype(np.int32))

    parts = group_texts(ids_a, ids_b, cut_a, cut_b)
    digests = []
    for doc, ok in enumerate(sound):
        first = int(stops_a[doc] - n_a[doc]) + int(stops_b[doc] - n_b[doc])
        own = "".join(parts[first : first + int(n_a[doc] + n_b[doc])])[:-1]
        digests.append(hashlib.sha256(own.encode()).hexdigest() if ok else "")

    n_docs, n_pairs = len(texts), len(pairs)

    def column(of_docs: pa.Array, of_pairs: pa.Array) -> pa.Array:
        return pa.concat_arrays(
            [
                pa.nulls(n_docs, of_pairs.type) if of_docs is None else of_docs,
                pa.nulls(n_pairs, of_docs.type) if of_pairs is None else of_pairs,
            ]
        )

    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n_docs + n_pairs, number, np.int64)),
            column(table["doc_id"].combine_chunks(), None),
            column(pa.array(n_a), None),
            column(pa.array(n_b), None),
            column(pa.array(n_groups.astype(np.int64)), None),
            column(pa.array(n_links.astype(np.int64)), None),
            column(pa.array(digests), None),
            column(pa.ListArray.from_arrays(offsets, pa.array(held_pair.astype(np.int32))), None),
            column(pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))), None),
            column(None, pa.array((pairs // width).astype(np.int32))),
            column(None, pa.array((pairs % width).astype(np.int32))),
            column(None, pa.array(np.arange(n_pairs, dtype=np.int32))),
            column(None, pa.array(holders.astype(np.int64))),
        ],
        names=_NAMES,
    )


_NAMES = [
    "shard", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held", "times",
    "a_id", "b_id", "pair", "holders",
]


def align(
    docs: DataFrame, path_a: str, path_b: str, shard: int = SHARD, lane: int = LANE
) -> DataFrame:
    """The stored alignment, shard by shard.

    Document rows have ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` and the linked
    pairs: ``held`` (numbers of pairs in the shard) and ``times``. Pair rows (``pair`` is not
    null) name a pair by ``a_id`` and ``b_id``, with ``holders``, its documents in the shard.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(path_a, path_b)
        for number, table in dealt(batches, "text", shard):
            yield _aligned(number, table, both, lane)

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    made = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        work,
        f"shard long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, "
        "groups_sha256 string, held array<int>, times array<int>, a_id int, b_id int, pair int, "
        "holders long",
    )
    return stored(made, "alignment")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Per linked id pair ``count``, the documents that hold it, and whether none of its
    A id's pairs has more (``best``)."""
    counts = (
        aligned.filter("pair IS NOT NULL")
        .groupBy("a_id", "b_id")
        .agg(F.sum("holders").alias("count"))
    )
    highest = counts.groupBy("a_id").agg(F.max("count").alias("highest"))
    return counts.join(highest, "a_id").select(
        "a_id", "b_id", "count", (F.col("count") == F.col("highest")).alias("best")
    )


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a shard with the sums over their links."""
    order = np.asarray(right["pair"])
    count, best = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    count[order] = np.asarray(right["count"])
    best[order] = np.asarray(right["best"]).astype(np.int64)
    held, times = left["held"].combine_chunks(), left["times"].combine_chunks()
    pair, often = np.asarray(held.flatten()), np.asarray(times.flatten()).astype(np.int64)
    sizes = np.array([len(h) for h in held], np.int64)
    stops = np.cumsum(sizes)

    def summed(values: np.ndarray) -> pa.Array:
        upto = np.concatenate([[0], np.cumsum(values)])
        return pa.array(upto[stops] - upto[stops - sizes])

    return left.drop_columns(["in_shard", "held", "times"]).append_column(
        "n_best", summed(often * best[pair])
    ).append_column("count_sum", summed(often * count[pair]))


def compare_tokens(
    docs: DataFrame, path_a: str, path_b: str, shard: int = SHARD, lane: int = LANE
) -> DataFrame:
    """Per document the tokens, groups and links of both tokenizers, with corpus-wide counts.

    ``count_sum`` adds up, over the links of the document, how many documents hold the pair
    linked; ``n_best`` are the links whose pair has the highest such count of its A id.
    """
    aligned = align(docs, path_a, path_b, shard, lane)
    kind = aligned.schema["doc_id"].dataType.simpleString()
    counts = stored(pair_counts(aligned), "pair-counts")
    told = (
        aligned.filter("pair IS NOT NULL")
        .select("shard", "a_id", "b_id", "pair")
        .join(counts, ["a_id", "b_id"])
        .select("shard", "pair", "count", "best")
    )
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = aligned.filter("pair IS NULL").select(
        F.col("shard").alias("in_shard"), *own, "held", "times"
    )
    return (
        rows.groupBy("in_shard")
        .cogroup(told.groupBy("shard"))
        .applyInArrow(
            _scored,
            f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "n_best long, count_sum long",
        )
    )
