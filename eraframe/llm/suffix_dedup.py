"""Removal of long repeated byte strings by suffix arrays.

Texts are read in shards. A suffix array per shard finds every string that repeats
within it. For strings that repeat in another shard, each shard publishes the anchors
of its strings: the place of the smallest hash inside a string, which depends on
the string alone. Strings with one anchor form a run; runs of equal context are
settled by counting, and only anchors that meet with different contexts send the
bytes of one run per context to a merge, which builds a suffix array over them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_text
from .suffix_arrays import Hashes, anchors, mixed, repeated_starts, runs
from .tokens import in_parts

LENGTH = 200
GRAM = 64
# Bytes of a shard, and strings of a text that it takes at most. The bytes that a suffix
# array is made of, a string's length more for each stretch of runs, fit its positions.
LARGEST = 500_000
_PART = 400_000
_ROWS = 5_000  # rows that a worker gathers before it hands them on
# Contexts of one anchor that a merge takes at most: their bytes and those gathered before
# them fit the positions of one suffix array. More of them meet by parts of their strings.
CROWD = 4_096
_STEP = 16  # strings of a run that meet by the bytes which all of them hold

_MARK = "kind int, key long, context long, shard long, b0 long, b1 long, start int, size int"
_RUN = "b0 long, b1 long, start int, size int"
_CUT = f"key long, {_RUN}, open boolean, crowd boolean, bytes binary"


def text_key(text: Column) -> list[Column]:
    """Two digests that name a text; equal texts lose the same bytes."""
    return [F.xxhash64(text).alias("b0"), F.xxhash64(F.lit(1), text).alias("b1")]


def _shards(batches: Iterator[pd.DataFrame], length: int):
    """Lists of (b0, b1, offset, bytes) that fit into one suffix array. Parts of a long
    text overlap by a string less a byte, so each string starts in one part."""
    shard, used = [], 0
    for batch in batches:
        for b0, b1, text in zip(batch["b0"], batch["b1"], batch["text"], strict=True):
            raw = text.encode()
            for offset in range(0, max(len(raw) - length + 1, 0), _PART):
                part = raw[offset : offset + _PART + length - 1]
                if used + len(part) > LARGEST:
                    yield shard
                    shard, used = [], 0
                shard.append((b0, b1, offset, part))
                used += len(part)
    if shard:
        yield shard


def _repeated_places(
    data: np.ndarray,
    lo: np.ndarray,
    count: np.ndarray,
    text: np.ndarray,
    key: np.ndarray,
    length: int,
) -> np.ndarray:
    """Places of a shard whose strings start at another place of it too.

    Equal strings have equal anchors, so the suffix array is made of the strings in runs
    whose anchor comes up again; runs that follow each other share their bytes.
    """
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[inverse] > 1)
    if not len(again):
        return np.zeros(0, dtype=np.int64)
    first = np.ones(len(again), dtype=bool)
    first[1:] = (again[1:] != again[:-1] + 1) | (text[again[1:]] != text[again[:-1]])
    at = np.flatnonzero(first)
    begin = lo[again[at]]
    starts = np.add.reduceat(count[again], at)
    width = starts + length - 1
    offset = np.cumsum(width) - width
    owner = np.repeat(np.arange(len(width)), width)
    within = np.arange(len(owner)) - offset[owner]
    place = begin[owner] + within
    return place[repeated_starts(data[place], within < starts[owner], length)]


def _marks_of(shard: list[tuple], number: int, length: int) -> pd.DataFrame:
    """Repeated strings within a shard (kind 0) and its anchors' runs (kind 1)."""
    sizes = np.array([len(s[3]) for s in shard])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(s[3] for s in shard), dtype=np.uint8)
    allowed = np.zeros(len(data), dtype=bool)
    for begin, end in zip(begins, ends, strict=True):
        allowed[begin : end - length + 1] = True
    hashes, other = Hashes(data), Hashes(data, 1)
    places = np.flatnonzero(allowed)
    anchor = anchors(hashes, GRAM, length)[places]
    text = np.repeat(np.arange(len(sizes)), sizes - length + 1)
    first = np.ones(len(places), dtype=bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    lo, count = places[at], np.diff(np.append(at, len(places)))
    hi = lo + count + length - 1
    key = hashes.of(anchor[at], anchor[at] + GRAM)
    context = mixed(other.of(lo, hi) + mixed((anchor[at] - lo).astype(np.uint64)) + hashes.of(lo, hi))
    repeated = _repeated_places(data, lo, count, text[at], key, length)
    begun = np.searchsorted(begins, repeated, side="right")
    # One more per text keeps runs of neighbouring texts apart.
    start, size = runs(repeated + begun)
    start = start - begun[np.searchsorted(repeated + begun, start)] if len(start) else start
    # Runs of equal context in one shard are known to repeat: one stands for all.
    _, one = np.unique(context, return_index=True)
    starts = np.concatenate([start, lo[one]])
    owner = np.searchsorted(begins, starts, side="right") - 1
    names = np.array([[s[0], s[1], s[2]] for s in shard], dtype=np.int64)
    zeros = np.zeros(len(start), dtype=np.int64)
    return pd.DataFrame(
        {
            "kind": np.repeat([0, 1], [len(start), len(one)]).astype(np.int32),
            "key": np.concatenate([zeros, key[one].view(np.int64)]),
            "context": np.concatenate([zeros, context[one].view(np.int64)]),
            "shard": np.int64(number),
            "b0": names[owner, 0],
            "b1": names[owner, 1],
            "start": (starts - begins[owner] + names[owner, 2]).astype(np.int32),
            "size": np.concatenate([size, count[one]]).astype(np.int32),
        }
    )


def shard_marks(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Marks of all shards; a task reads its texts into one shard after the other."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for shard in _shards(batches, length):
            yield _marks_of(shard, number, length)
            number += 1

    return texts.select("b0", "b1", "text").mapInPandas(work, _MARK)


def _cut_runs(length: int):
    """Texts with their runs to the bytes of each run."""
    names = ["key", "b0", "b1", "start", "size", "open", "crowd", "bytes"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                raw = row.text.encode()
                listed = zip(row.key, row.start, row.size, row.open, row.crowd, strict=True)
                for key, start, size, still, crowd in listed:
                    cut = raw[start : start + size + length - 1]
                    out.append((key, row.b0, row.b1, start, size, still, crowd, cut))
                if len(out) > _ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        yield pd.DataFrame(out, columns=names)

    return work


def _laid_out(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' bytes in one array, the first place of each row, and its number of strings."""
    data = np.frombuffer(b"".join(rows["bytes"]), dtype=np.uint8)
    width = rows["bytes"].str.len().to_numpy(np.int64)
    return data, np.cumsum(width) - width, rows["size"].to_numpy(np.int64)


def _merge(length: int):
    """Runs sorted by key to those parts of open ones whose strings start elsewhere too.

    Strings of different keys differ, so whole keys are gathered into one suffix array,
    which compares all their strings byte by byte.
    """

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        data, first, size = _laid_out(rows)
        row = np.repeat(np.arange(len(rows)), size)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        allowed = np.zeros(len(data), dtype=bool)
        allowed[first[row] + nth] = True
        hit = repeated_starts(data, allowed, length)[first[row] + nth]
        # One more per row keeps runs of neighbouring rows apart.
        place = np.flatnonzero(hit & rows["open"].to_numpy(bool)[row])
        start, count = runs(place + row[place])
        begin = start - row[place][np.searchsorted(place + row[place], start)]
        owner = row[begin]
        return pd.DataFrame(
            {
                "b0": rows["b0"].to_numpy()[owner],
                "b1": rows["b1"].to_numpy()[owner],
                "start": (rows["start"].to_numpy()[owner] + nth[begin]).astype(np.int32),
                "size": count.astype(np.int32),
            }
        )

    def whole_keys(rows: pd.DataFrame, last: bool) -> Iterator[pd.DataFrame]:
        """Rows of whole keys with just over LARGEST bytes; what is left comes last."""
        key = rows["key"].to_numpy()
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], last)) + 1
        used = np.cumsum(rows["bytes"].str.len().to_numpy(np.int64))
        begin, before = 0, 0
        for end in ends:
            if used[end - 1] - before >= LARGEST or (last and end == len(rows)):
                yield rows.iloc[begin:end].reset_index(drop=True)
                begin, before = end, used[end - 1]
        yield rows.iloc[begin:]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            *full, rest = whole_keys(batch if rest is None else pd.concat([rest, batch], ignore_index=True), False)
            for rows in full:
                yield merged(rows)
        if rest is not None and len(rest):
            *full, _ = whole_keys(rest, True)
            for rows in full:
                yield merged(rows)

    return work


def _parts(length: int, step: int):
    """Runs to parts of up to ``step`` neighbouring strings.

    A string's part is told by the distance to its anchor, and a part's key by the bytes
    that all strings of such a part hold, so equal strings come with equal keys.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 2000):
                rows = batch.iloc[i : i + 2000].reset_index(drop=True)
                data, first, size = _laid_out(rows)
                hashes, other = Hashes(data), Hashes(data, 1)
                anchor = anchors(hashes, GRAM, length)[first]
                # Distances to the anchor, from that of the last string to that of the first.
                near, far = anchor - first - size + 1, anchor - first
                counts = far // step - near // step + 1
                row = np.repeat(np.arange(len(rows)), counts)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                part = (near // step)[row] + nth
                latest, earliest = anchor[row] - part * step, anchor[row] - (part + 1) * step + 1
                named = mixed(hashes.of(latest, earliest + length) ^ mixed(part.astype(np.uint64)))
                named = mixed(named ^ mixed(other.of(latest, earliest + length)))
                begin = np.maximum(earliest, first[row])
                end = np.minimum(latest, (first + size - 1)[row]) + 1
                raw = data.tobytes()
                yield pd.DataFrame(
                    {
                        "key": named.view(np.int64),
                        "b0": rows["b0"].to_numpy()[row],
                        "b1": rows["b1"].to_numpy()[row],
                        "start": (rows["start"].to_numpy()[row] + begin - first[row]).astype(np.int32),
                        "size": (end - begin).astype(np.int32),
                        "open": rows["open"].to_numpy(bool)[row],
                        "crowd": True,
                        "bytes": [raw[a : b + length - 1] for a, b in zip(begin, end, strict=True)],
                    }
                )

    return work


def _met(rows: DataFrame, length: int, step: int, name: str) -> DataFrame:
    """The parts of runs that come up more than once: by their key, single strings by their bytes."""
    parts = stored(rows.mapInPandas(_parts(length, step), _CUT), name)
    by = ["key"] if step > 1 else ["key", "bytes"]
    again = parts.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*by)
    return parts.join(again, by).select(*parts.columns)


def one_text_each(texts: DataFrame) -> DataFrame:
    """A text per name; copies go before anything is shuffled."""
    return texts.groupBy("b0", "b1").agg(F.first("text").alias("text"))


def repeated_runs(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(b0, b1, start, size): runs of starts of strings that also start elsewhere.

    What an anchor's merge receives is a row per context, whatever number of copies
    and shards hold it. An anchor in more than ``CROWD`` contexts meets by parts of its
    runs instead, and those that come up again by single strings.
    """
    marks = stored(shard_marks(texts, length), "suffix-marks")
    within = marks.filter("kind = 0").select("b0", "b1", "start", "size")
    published = marks.filter("kind = 1")
    met = (
        published.groupBy("key")
        .agg(
            F.min("shard").alias("s0"),
            F.max("shard").alias("s1"),
            F.min("context").alias("c0"),
            F.max("context").alias("c1"),
        )
        .filter("s0 <> s1")
        .select("key", (F.col("c0") != F.col("c1")).alias("differ"))
    )
    shared = stored(published.join(met, "key").drop("kind"), "suffix-shared")
    # Anchors with one context everywhere: all strings of their runs repeat.
    whole = shared.filter("NOT differ").select("b0", "b1", "start", "size")
    differ = shared.filter("differ")
    contexts = stored(
        differ.groupBy("key", "context").agg(
            (F.min("shard") == F.max("shard")).alias("open"),
            F.min(F.struct("b0", "b1", "start", "size")).alias("run"),
        ),
        "suffix-contexts",
    )
    # So do those of a context in several shards; one of them stands for all from here on.
    settled = contexts.filter("NOT open").select("key", "context")
    known = differ.join(settled, ["key", "context"]).select("b0", "b1", "start", "size")
    crowds = (
        contexts.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("key", (F.col("n") > CROWD).alias("crowd"))
    )
    # A text's list is bounded by its length: each place in it starts one run.
    names = ["key", "start", "size", "open", "crowd"]
    run = F.struct("key", "run.start", "run.size", "open", "crowd").alias("run")
    wanted = (
        contexts.join(crowds, "key")
        .select("run.b0", "run.b1", run)
        .groupBy("b0", "b1")
        .agg(F.collect_list("run").alias("runs"))
    )
    cut = (
        one_text_each(texts)
        .join(wanted, ["b0", "b1"])
        .select("b0", "b1", "text", *[F.col(f"runs.{c}").alias(c) for c in names])
        .mapInPandas(_cut_runs(length), _CUT)
    )
    cuts = stored(cut, "suffix-cuts")
    merged = (
        cuts.filter("NOT crowd")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInPandas(_merge(length), _RUN)
    )
    parts = _met(cuts.filter("crowd"), length, _STEP, "suffix-parts")
    strings = _met(parts, length, 1, "suffix-strings").filter("open")
    single = strings.select("b0", "b1", "start", "size")
    return (
        within.unionByName(whole).unionByName(known).unionByName(merged).unionByName(single)
    )


def _remove(length: int, with_kept: bool):
    """Texts with the runs of their repeated strings to what is left of them."""
    names = ["b0", "b1", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def spans_of(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal stretches that the strings of sorted runs cover."""
        order = np.argsort(start, kind="stable")
        begin = start[order].astype(np.int64)
        end = np.maximum.accumulate(begin + size[order] + length - 1)
        first = np.ones(len(begin), dtype=bool)
        first[1:] = begin[1:] > end[:-1]
        at = np.flatnonzero(first)
        return begin[at], end[np.append(at[1:], len(end)) - 1]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in in_parts(batch):
                out = []
                for row in part.itertuples(index=False):
                    raw, n_spans, left = row.text.encode(), 0, row.text.encode()
                    if row.start is not None and len(row.start):
                        begins, ends = spans_of(row.start, row.size)
                        n_spans = len(begins)
                        edges = zip([0, *ends], [*begins, len(raw)], strict=True)
                        left = b"".join(raw[a:b] for a, b in edges)
                    digest = hashlib.sha256(left).hexdigest()
                    made = (row.b0, row.b1, len(raw), len(raw) - len(left), n_spans, digest)
                    out.append((*made, left) if with_kept else made)
                yield pd.DataFrame(out, columns=names[: 7 if with_kept else 6])

    return work


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) and kept_sha256 of every document.

    Every byte in a string of ``length`` bytes that also starts anywhere else goes. Null
    texts count as empty; texts shorter than a string lose nothing; repeated rows are
    documents of their own, so long ones go wholly. No rows give no rows. Bytes at a cut
    may be part of a character, hence the result is bytes.
    """
    text = whole_text("text")
    texts = docs.select("doc_id", text.alias("text"), *text_key(text))
    found = repeated_runs(texts.select("b0", "b1", "text"), length)
    repeats = found.groupBy("b0", "b1").agg(
        F.collect_set(F.struct("start", "size")).alias("repeats")
    )
    joined = (
        one_text_each(texts.select("b0", "b1", "text"))
        .join(repeats, ["b0", "b1"], "left")
        .select(
            "b0", "b1", "text", F.col("repeats.start").alias("start"), F.col("repeats.size").alias("size")
        )
    )
    made = "b0 long, b1 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    cleaned = joined.mapInPandas(_remove(length, with_kept), made + ", kept binary" * with_kept)
    return texts.select("doc_id", "b0", "b1").join(cleaned, ["b0", "b1"]).drop("b0", "b1")
