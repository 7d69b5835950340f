"""Best-fit packing of token sequences with large-item matching.

Pieces longer than a third of the capacity fit at most two to a sequence; a greedy
matching gives each, from long to short, the longest partner that still fits.
Smaller pieces then go, from long to short, into the smallest gap that takes them.
Both work on the number of pieces of each length, so the plan has a bounded size
whatever the corpus; pieces find their place by their rank among equal lengths.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_carrying, ranked, stored
from .tokens import encoder, in_parts

CAPACITY = 4096
END_ID = 1
_RANK_BITS = 48
# Characters of texts whose ids a worker holds at a time.
_AT_ONCE = 1_000_000


def pack_lengths(docs: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Places for all pieces, from the number of pieces of each length.

    Returns placements, one row (length, first rank, bin, fill, pieces per bin) for
    each run of bins that take pieces of a length at the same fill, and the number of
    bins. Ranks count from 0 within a length.
    """
    left = {size: n for size, n in docs.items() if n > 0}
    used = dict.fromkeys(left, 0)
    places: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: ranges of bins
    open_gaps: list[int] = []  # sorted keys of gaps
    bins = 0

    def put(size: int, first: int, end: int, fill: int, per_bin: int) -> None:
        n = (end - first) * per_bin
        places.append((size, used[size], first, fill, per_bin))
        used[size] += n
        left[size] -= n

    def add_gap(gap: int, first: int, end: int) -> None:
        if gap and first < end:
            if gap not in gaps:
                bisect.insort(open_gaps, gap)
                gaps[gap] = []
            gaps[gap].append((first, end))

    large = sorted(size for size in left if 3 * size > capacity)
    i, j = len(large) - 1, len(large) - 1
    while i >= 0:
        size = large[i]
        if not left[size]:
            i -= 1
            continue
        # The longest partner that fits, itself included.
        j = min(bisect.bisect_right(large, capacity - size) - 1, i)
        while j >= 0 and not left[large[j]]:
            j -= 1
        if j >= 0 and (large[j] != size or left[size] > 1):
            other = large[j]
            n = left[size] // 2 if other == size else min(left[size], left[other])
            put(size, bins, bins + n, 0, 1)
            put(other, bins, bins + n, size, 1)
            add_gap(capacity - size - other, bins, bins + n)
        else:
            n = left[size]
            if j >= 0 and n == 1:  # one is left of a length that fits itself
                j -= 1
                while j >= 0 and not left[large[j]]:
                    j -= 1
                if j >= 0:
                    put(size, bins, bins + 1, 0, 1)
                    put(large[j], bins, bins + 1, size, 1)
                    add_gap(capacity - size - large[j], bins, bins + 1)
                    bins += 1
                    continue
            put(size, bins, bins + n, 0, 1)
            add_gap(capacity - size, bins, bins + n)
        bins += n
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect.bisect_left(open_gaps, size)
            if at == len(open_gaps):
                need = -(-left[size] // (capacity // size))
                add_gap(capacity, bins, bins + need)
                bins += need
                continue
            gap = open_gaps[at]
            first, end = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.pop(at)
            per_bin, fill = gap // size, capacity - gap
            full = min(end - first, left[size] // per_bin)
            if full:
                put(size, first, first + full, fill, per_bin)
                add_gap(gap - per_bin * size, first, first + full)
                first += full
            if first < end and left[size]:  # the last pieces start one more bin
                last = left[size]
                put(size, first, first + 1, fill, last)
                add_gap(gap - last * size, first, first + 1)
                first += 1
            add_gap(gap, first, end)
    return np.array(places, dtype=np.int64).reshape(-1, 5), bins


def cut_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids).

    A document is its token ids and a closing id; null and empty texts are the
    closing id alone. Longer ones are cut every ``capacity`` ids.
    """
    schema = "piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        for batch in batches:
            for part in in_parts(batch, _AT_ONCE):
                flat, ends = encode(part["text"].tolist())
                rows = []
                begin = 0
                for doc_id, end in zip(part["doc_id"], ends, strict=True):
                    ids = np.append(flat[begin:end], np.uint32(END_ID)).astype("<u4")
                    begin = end
                    for start in range(0, len(ids), capacity):
                        cut_ids = ids[start : start + capacity]
                        crc = zlib.crc32(cut_ids.tobytes())
                        row = (doc_id, start // capacity, start, len(cut_ids), crc)
                        rows.append((*row, cut_ids.tolist()) if with_ids else row)
                yield pd.DataFrame(rows, columns=names[: 6 if with_ids else 5])

    return map_carrying(
        docs.select("doc_id", "text"), ["doc_id"], cut, schema + ", ids array<long>" * with_ids
    )


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """The pieces of all documents with their ``sequence_id`` and ``offset``.

    Equal lengths share their places in the order of a hash, so repeated rows and
    null ids are pieces like others. No rows give no rows. The driver sees a count per
    length, at most ``capacity`` numbers; the placements, a few per length, go to the
    tasks.
    """
    pieces = stored(cut_pieces(docs, tokenizer, capacity, with_ids), "pack-pieces")
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("_same"))
    lengths = {row.length: row._same for row in counts.collect()}
    places, _ = pack_lengths(lengths, capacity)
    order = np.lexsort((places[:, 1], places[:, 0]))
    places = places[order]
    keys = (places[:, 0] << _RANK_BITS) + places[:, 1]

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = "piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length = batch["length"].to_numpy(np.int64)
            rank = batch["rank"].to_numpy(np.int64) - 1
            at = np.searchsorted(keys, (length << _RANK_BITS) + rank, side="right") - 1
            _, first_rank, first_bin, fill, per_bin = places[at].T
            nth = rank - first_rank
            out = batch[columns].copy()
            out["sequence_id"] = first_bin + nth // per_bin
            out["offset"] = fill + nth % per_bin * length
            yield out

    same = F.map_from_arrays(
        F.lit(list(lengths) or [0]).cast("array<bigint>"),
        F.lit(list(lengths.values()) or [1]).cast("array<bigint>"),
    )
    numbered = ranked(
        pieces.withColumn("_same", same[F.col("length")]).withColumn(
            "_draw", F.xxhash64(F.col("doc_id"), F.col("piece"))
        ),
        ["length"],
        "_same",
        ["_draw", "doc_id", "piece", "ids_crc32"],
    )
    return map_carrying(
        numbered.select(*columns, "rank"),
        ["doc_id"],
        place,
        f"{schema}, sequence_id long, offset long",
    )
