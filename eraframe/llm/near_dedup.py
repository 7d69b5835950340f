"""MinHash near-duplicates with sequential Bayesian verification.

Texts with equal shingle sets are one class, so copies cost one row. Classes meet
in buckets by bands of their signatures. A pair's signatures are compared batch by
batch; it is dropped once the posterior chance that its likeness reaches the threshold
is below the chosen miss probability. Survivors are verified on their full sets.

First every class of a bucket meets the bucket's smallest class. Buckets whose
classes then still belong to different components are cut into blocks, and tasks take
pairs of blocks with all signatures and sets. Pairs never leave a task: it hands on a
forest of verified links, no more than it has classes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, map_carrying, row_key, stored, with_any_columns
from .components import connected_components
from .tokens import in_parts

_REMEMBERED = 500_000
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_ROWS = 4096


@dataclass(frozen=True)
class Likeness:
    """What makes two texts near-duplicates, and how they are looked for.

    Texts are linked if 100 * |A and B| >= percent * |A or B| for their sets of
    ``shingle``-word runs. A pair at the threshold shares no band with probability
    (1 - (percent / 100) ** rows) ** bands, and is dropped by a batch of hashes with
    probability ``miss`` at most.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    extra: int = 32
    miss: float = 1e-6
    batch: int = 16
    block: int = 1024

    @property
    def hashes(self) -> int:
        return self.bands * self.rows + self.extra

    def needed_matches(self) -> list[tuple[int, int]]:
        """(hashes compared, least matches to go on) after each batch.

        With a uniform prior, the chance that the likeness reaches t after m of n
        matches is that of at most m successes in n + 1 trials of chance t.
        """
        t = self.percent / 100
        steps = []
        for n in range(self.batch, self.hashes + 1, self.batch):
            chance, m = 0.0, -1
            while chance < self.miss:
                m += 1
                chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            steps.append((n, m))
        return steps


class _Words(dict):
    """64-bit hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value


@functools.lru_cache(maxsize=1)
def _known_words() -> _Words:
    return _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in _MIX:
        x = (x ^ (x >> np.uint64(33))) * factor
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``shingle`` words, A-Z in lower case.

    A shorter text is one run of all its words; without a word the set is empty.
    """
    known = _known_words()
    if len(known) > _REMEMBERED:
        known.clear()
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    runs = np.full(len(words) - width + 1, np.uint64(width))
    for n in range(width):
        runs = _mixed(runs * np.uint64(31) + hashed[n : n + len(runs)])
    return np.unique(runs)


@functools.lru_cache(maxsize=4)
def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(7)
    whole = np.iinfo(np.uint64).max
    a = random.integers(0, whole, n, dtype=np.uint64, endpoint=True) | np.uint64(1)
    return a, random.integers(0, whole, n, dtype=np.uint64, endpoint=True)


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash values of a set, their upper 32 bits."""
    a, b = _factors(n)
    least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), _ROWS):
        part = hashes[i : i + _ROWS, None] * a
        part += b
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def describe(docs: DataFrame, likeness: Likeness) -> DataFrame:
    """doc_id, blob (digest of the text), n_shingles, class_key (digest of the set),
    signature and band keys of every document."""
    n, bands, rows = likeness.hashes, likeness.bands, likeness.rows

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                hashes = shingle_set(text, likeness.shingle)
                if not len(hashes):
                    out.append((0, None, None, None))
                    continue
                values = signature(hashes, n)
                keys = np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    keys = _mixed(
                        keys * np.uint64(31) + values[r : bands * rows : rows].astype(np.uint64)
                    )
                digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
                out.append((len(hashes), digest, values.tobytes(), keys.view(np.int64).tolist()))
            names = ["n_shingles", "class_key", "signature", "bands"]
            made = pd.DataFrame(out, columns=names)
            made.insert(0, "blob", batch["blob"])
            made.insert(0, "doc_id", batch["doc_id"])
            yield made

    text = F.coalesce(F.col("text"), F.lit(""))
    return map_carrying(
        docs.select("doc_id", "text", F.sha2(text, 256).alias("blob")),
        ["doc_id"],
        work,
        "blob string, n_shingles long, class_key binary, signature binary, bands array<long>",
    )


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets reach the likeness; sizes alone may rule it out."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _passing(x: np.ndarray, y: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Matches of pairs of signatures that no batch drops, -1 for dropped ones.

    The hashes that formed no bands are compared first.
    """
    x, y = x[:, ::-1], y[:, ::-1]
    matches = np.zeros(len(x), dtype=np.int64)
    on, done = np.arange(len(x)), 0
    for n, least in steps:
        matches[on] += (x[on, done:n] == y[on, done:n]).sum(axis=1)
        stays = matches[on] >= least
        matches[on[~stays]] = -1
        on, done = on[stays], n
        if not len(on):
            break
    return matches


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").reshape(len(column), -1)


def _verifier(likeness: Likeness) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pairs with signatures and sets to the pairs that are linked."""
    steps = likeness.needed_matches()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            passed = _passing(_signatures(batch["sig_a"]), _signatures(batch["sig_b"]), steps) >= 0
            linked = [
                (a, b)
                for a, b, x, y in batch.loc[passed, ["a", "b", "set_a", "set_b"]].itertuples(index=False)
                if _alike(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), likeness.percent)
            ]
            yield pd.DataFrame(linked, columns=["a", "b"])

    return work


def verified(pairs: DataFrame, classes: DataFrame, likeness: Likeness) -> DataFrame:
    """The pairs (a, b) of class keys that are linked, by signatures and full sets."""

    def side(name: str) -> DataFrame:
        return classes.select(
            F.col("class_key").alias(name),
            F.col("signature").alias(f"sig_{name}"),
            F.col("hashes").alias(f"set_{name}"),
        )

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    columns = ["a", "b", "sig_a", "sig_b", "set_a", "set_b"]
    return joined.select(*columns).mapInPandas(_verifier(likeness), "a binary, b binary")


def _block_links(
    likeness: Likeness,
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows sorted by (bucket, left, right) to links that join components."""
    steps, rows_of_band = likeness.needed_matches(), likeness.rows

    def candidates(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Pairs across components and blocks that meet in no earlier band, likely first."""
        component = pd.factorize(group["component"])[0]
        values = _signatures(group["signature"])
        own = (group["block"] == group["left"]).to_numpy()
        same_block = group["left"].iloc[0] == group["right"].iloc[0]
        band = int(group["band"].iloc[0])
        earlier = values[:, : band * rows_of_band]
        found = []
        for i in range(len(group) - 1):
            use = component[i + 1 :] != component[i]
            if not same_block:
                use &= own[i + 1 :] != own[i]
            j = i + 1 + np.flatnonzero(use)
            if band and len(j):
                met = (earlier[j] == earlier[i]).reshape(len(j), band, rows_of_band)
                j = j[~met.all(axis=2).any(axis=1)]
            if len(j):
                matches = _passing(np.broadcast_to(values[i], (len(j), values.shape[1])), values[j], steps)
                on = matches >= 0
                found.append(np.stack([matches[on], np.full(on.sum(), i), j[on]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
        order = np.argsort(-pairs[0], kind="stable")
        return component, pairs[1:, order]

    def links(group: pd.DataFrame) -> list[tuple[bytes, bytes]]:
        if group["component"].nunique() == 1:
            return []
        root, pairs = candidates(group)
        root = root.copy()
        keys, sets = group["class_key"].tolist(), {}
        out = []
        for i, j in pairs.T:
            if root[i] == root[j]:
                continue
            for n in (i, j):
                if n not in sets:
                    sets[n] = np.frombuffer(group["hashes"].iat[n], "<u8")
            if _alike(sets[i], sets[j], likeness.percent):
                root[root == root[j]] = root[i]
                out.append((keys[i], keys[j]))
        return out

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["bucket", "left", "right"]
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            changed = (rows[names] != rows[names].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(changed)
            out = []
            for start, end in zip(starts[:-1], starts[1:], strict=True):
                out += links(rows.iloc[start:end])
            rest = rows.iloc[starts[-1] :] if len(starts) else rows
            yield pd.DataFrame(out, columns=["a", "b"])
        if rest is not None and len(rest):
            yield pd.DataFrame(links(rest), columns=["a", "b"])

    return work


def _open_links(
    members: DataFrame, components: DataFrame, classes: DataFrame, likeness: Likeness
) -> DataFrame:
    """Links between components that meet in a bucket."""
    named = members.join(components, "class_key", "left").withColumn(
        "component", F.coalesce("component", "class_key")
    )
    mixed = (
        named.groupBy("bucket")
        .agg(
            F.min("component").alias("first"),
            F.max("component").alias("last"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter(F.col("first") != F.col("last"))
        .select("bucket", F.ceil(F.col("n") / likeness.block).cast("int").alias("blocks"))
    )
    blocks = F.col("blocks")
    dealt = (
        named.join(mixed, "bucket")
        .withColumn("block", F.pmod(F.xxhash64("class_key"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "bucket",
            "band",
            F.least("block", "other").alias("left"),
            F.greatest("block", "other").alias("right"),
            "block",
            "class_key",
            "component",
        )
    )
    filled = dealt.join(classes, "class_key")
    sorted_blocks = filled.repartition("bucket", "left", "right").sortWithinPartitions(
        "bucket", "left", "right", "class_key"
    )
    return sorted_blocks.mapInPandas(_block_links(likeness), "a binary, b binary").distinct()


def _with_sets(likeness: Likeness) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in in_parts(batch):
                hashes = [shingle_set(t, likeness.shingle).astype("<u8").tobytes() for t in part["text"]]
                yield part[["class_key", "signature"]].assign(hashes=hashes)

    return work


def near_duplicates(docs: DataFrame, likeness: Likeness = Likeness()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, class_key, component_id and kept of every document.

    ``component_id`` is the smallest doc_id that a document reaches by links, its own
    included, and ``kept`` marks the document with this id; ``class_key`` is equal for
    texts with equal sets. Null, empty and blank texts have no set and link with
    nothing: their component is their own. A document without an id is kept if its
    component has no id. Rows that repeat an id are kept or dropped alike. No rows give
    no rows.
    """
    described = stored(describe(docs, likeness), "near-described")
    classes = stored(
        described.filter(F.col("class_key").isNotNull())
        .groupBy("class_key")
        .agg(
            F.min("doc_id").alias("least_id"),
            F.min("blob").alias("blob"),
            F.first("signature").alias("signature"),
            F.first("bands").alias("bands"),
        ),
        "near-classes",
    )
    banded = classes.select("class_key", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(
        F.min("class_key").alias("head"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1")
    members = stored(banded.join(shared.select("bucket", "head"), "bucket"), "near-members")
    wanted = members.select("class_key").distinct().join(classes, "class_key").select(
        "class_key", "blob", "signature"
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    candidates = stored(
        texts.join(wanted, "blob")
        .dropDuplicates(["class_key"])
        .select("class_key", "signature", "text")
        .mapInPandas(_with_sets(likeness), "class_key binary, signature binary, hashes binary"),
        "near-candidates",
    )
    stars = members.filter(F.col("class_key") != F.col("head")).select(
        F.col("class_key").alias("a"), F.col("head").alias("b")
    ).distinct()
    links = stored(verified(stars, candidates, likeness), "near-links")
    found = _open_links(
        members.select("bucket", "band", "class_key"), _components(links), candidates, likeness
    )
    links = links.unionByName(stored(found, "near-links"))
    components = _components(links)
    reached = classes.select("class_key", "least_id").join(components, "class_key", "left")
    named = reached.withColumn("component", F.coalesce("component", "class_key"))
    heads = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = named.join(heads, "component").select(
        F.col("class_key").alias("_class"), "component_id"
    )
    own = described.select("doc_id", "n_shingles", "class_key")
    return (
        own.join(of_class, own["class_key"] == of_class["_class"], "left")
        .withColumn(
            "component_id",
            F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")),
        )
        .select(
            "doc_id",
            "n_shingles",
            "class_key",
            "component_id",
            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links).withColumnRenamed("node", "class_key")


@with_any_columns("doc_id", "text")
def drop_near_duplicates(docs: DataFrame, likeness: Likeness = Likeness()) -> DataFrame:  # noqa: B008
    """One document of each group of near-duplicates, with the columns it has.

    The document with the smallest id stays, one without an id only if no other is
    there. Of rows that are equal in every column one stays; documents without words
    are linked with nothing and all stay but for such repeats.
    """
    keyed = docs.withColumn(ROW_KEY, row_key(docs))
    found = near_duplicates(keyed.select(F.col(ROW_KEY).alias("doc_id"), "text"), likeness)
    ids = keyed.select(ROW_KEY, F.col("doc_id").alias("_id")).distinct()
    first = F.min(F.struct(F.col("_id").isNull(), "_id", ROW_KEY))[ROW_KEY]
    stays = (
        found.select(F.col("doc_id").alias(ROW_KEY), "component_id")
        .distinct()
        .join(ids, ROW_KEY)
        .groupBy("component_id")
        .agg(first.alias(ROW_KEY))
        .select(ROW_KEY)
    )
    return keyed.join(stays, ROW_KEY, "left_semi").dropDuplicates([ROW_KEY]).select(*docs.columns)
