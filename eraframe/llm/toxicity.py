"""Toxic spans by a linear-chain conditional random field.

Labels come per document. Words that stand out in toxic training documents label
tokens, and the field learns from those which words and word parts are toxic and how
toxic words follow each other. Forward-backward marginals of all tokens add up to a
document's score and name the offending places.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, map_carrying
from .tokens import in_parts

STEPS = 32  # words that messages pass through at a time; a text is a run of such rows
SAMPLE = 4_000  # labelled documents that the model is fitted on at most
SAMPLE_CHARS = 16_000_000  # and their code points
FOLDS = 5
_PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&|-_"
_REMEMBERED = 1_000_000
_LIMIT = 30.0


def word_features(word: str) -> list[str]:
    """The word without punctuation in lower case, its beginnings and its end."""
    core = word.strip(_PUNCTUATION).lower()
    if len(core) < 3:
        return []
    return [f"w{core}", f"4{core[:4]}", f"5{core[:5]}", f"e{core[-4:]}"]


def marginals(emission: np.ndarray, start: np.ndarray, moves: np.ndarray):
    """:func:`text_marginals` of sequences of one length, [n, steps]."""
    n, steps = emission.shape
    toxic, pairs = text_marginals(emission.ravel(), np.arange(1, n + 1) * steps, start, moves)
    return toxic.reshape(n, steps), pairs


def text_marginals(emission: np.ndarray, ends: np.ndarray, start: np.ndarray, moves: np.ndarray):
    """Chance of state 1 at each word of texts that end at ``ends``, and of each move summed.

    ``emission`` is the score of state 1 over state 0, ``start`` and ``moves`` are the
    scores of the first state and of moves between states. A text is a chain over all of
    its words, laid out in rows of ``STEPS``: all rows at once get the product of their
    steps, those products carry messages from row to row, and the rows then pass the
    messages that they received through their words. Messages are scaled to sum to one.
    """
    if not len(emission):
        return np.zeros(0), np.zeros((2, 2))
    sizes = np.diff(np.concatenate([[0], ends]))
    in_rows = -(-sizes // STEPS)
    first_row = np.cumsum(in_rows) - in_rows
    at = np.repeat(first_row * STEPS, sizes) + np.arange(len(emission)) - np.repeat(ends - sizes, sizes)
    n = int(in_rows.sum())
    lift, real = np.ones(n * STEPS), np.zeros(n * STEPS, dtype=bool)
    lift[at], real[at] = np.exp(np.clip(emission, -_LIMIT, _LIMIT)), True
    lift, real = lift.reshape(n, STEPS).T, real.reshape(n, STEPS).T
    opening = np.zeros(n, dtype=bool)
    opening[first_row[sizes > 0]] = True
    step = _steps(lift, real, opening, np.exp(start), np.exp(moves))
    ahead, after = _messages(step, first_row, in_rows)
    return _passed_on(step, ahead, after, real, opening, at)


def _steps(lift, real, opening, start, move) -> np.ndarray:
    """[step, from, to, row]: weights of each move; a first word counts from either state
    alike, and nothing moves behind a text's end."""
    steps, n = lift.shape
    step = np.empty((steps, 2, 2, n))
    for i in (0, 1):
        for j in (0, 1):
            step[:, i, j] = np.where(real, move[i, j] * (lift if j else 1.0), float(i == j))
            step[0, i, j, opening] = start[j] * (lift[0, opening] if j else 1.0)
    return step


def _messages(step, first_row, in_rows) -> tuple[np.ndarray, np.ndarray]:
    """Messages [state, row] that reach each row from before and from behind."""
    product = step[0]
    for t in range(1, len(step)):
        product = np.einsum("ijn,jkn->ikn", product, step[t])
        product = product / product.sum(axis=(0, 1))
    n = product.shape[2]
    ahead, after = np.full((2, n), 0.5), np.full((2, n), 0.5)
    longest_first = np.argsort(-in_rows, kind="stable")
    first, count = first_row[longest_first], in_rows[longest_first]
    for r in range(1, int(count[0]) if len(count) else 0):
        open_texts = np.searchsorted(-count, -r, side="left")
        row = first[:open_texts] + r
        ahead[:, row] = _scaled(np.einsum("in,ijn->jn", ahead[:, row - 1], product[:, :, row - 1]))
        row = (first + count)[:open_texts] - 1 - r
        after[:, row] = _scaled(np.einsum("ijn,jn->in", product[:, :, row + 1], after[:, row + 1]))
    return ahead, after


def _scaled(message: np.ndarray) -> np.ndarray:
    return message / message.sum(axis=0)


def _passed_on(step, ahead, after, real, opening, at) -> tuple[np.ndarray, np.ndarray]:
    """Chances of words and summed moves from the messages that reach the rows."""
    steps, n = real.shape
    held = np.empty((steps + 1, 2, n))
    held[0] = ahead
    for t in range(steps):
        a0, a1 = held[t]
        held[t + 1] = _scaled(
            np.stack([a0 * step[t, 0, 0] + a1 * step[t, 1, 0], a0 * step[t, 0, 1] + a1 * step[t, 1, 1]])
        )
    toxic, pairs = np.empty((n, steps)), np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        both = held[t + 1] * after
        toxic[:, t] = both[1] / both.sum(axis=0)
        joint = held[t][:, None] * step[t] * after[None]
        moved = real[t] & ~opening if t == 0 else real[t]
        pairs += (joint / joint.sum(axis=(0, 1)))[:, :, moved].sum(axis=2)
        after = _scaled(joint.sum(axis=1) / held[t])
    return toxic.ravel()[at], pairs


@dataclass
class ToxicField:
    """A fitted field and the calibration of its document scores."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -_LIMIT
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: np.ndarray = field(default_factory=lambda: np.array([-5.0, 0.0, 0.0]))

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in word_features(word))

    def document_score(self, evidence: np.ndarray) -> np.ndarray:
        z = self.calibration[0] + evidence @ self.calibration[1:]
        return 1 / (1 + np.exp(-np.clip(z, -_LIMIT, _LIMIT)))


def token_chances(model: ToxicField, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Chance that each token is toxic; a text is one chain."""
    return text_marginals(flat, ends, model.start, model.moves)[0]


def evidence(chances: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per text log(1 + sum of the chances of rather toxic tokens) and the largest chance.

    Slight chances are left out of the sum: a long text has very many of them.
    """
    starts = np.concatenate([[0], ends])[:-1]
    total = np.concatenate([[0.0], np.cumsum(np.where(chances >= 0.5, chances, 0.0))])
    largest = np.zeros(len(ends))
    filled = ends > starts
    if filled.any():
        largest[filled] = np.maximum.reduceat(chances, starts[filled])
    return np.stack([np.log1p(np.maximum(total[ends] - total[starts], 0)), largest], axis=1)


def _marking_features(texts: Sequence[list[str]], toxic: np.ndarray) -> set[str]:
    """Features whose share of toxic documents stands out by a likelihood ratio.

    The ratio asked for grows with the number of features, so that about one of them
    would pass by chance however large the vocabulary.
    """
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for words, label in zip(texts, toxic, strict=True):
        features = {f for w in set(words) for f in word_features(w)[:3]}
        seen[int(label)].update(features)
    bad, good = int(toxic.sum()), int(len(toxic) - toxic.sum())
    rate = bad / (bad + good)
    enough = 2 * np.log(max(len(seen[0].keys() | seen[1].keys()), 2))
    marking = set()
    for name, a in seen[1].items():
        b = seen[0][name]
        p = a / (a + b)
        if p <= rate:
            continue
        gain = a * np.log(p / rate) + (b * np.log((1 - p) / (1 - rate)) if b else 0.0)
        if 2 * gain >= enough and p >= 0.9:
            marking.add(name)
    return marking


def _fit_field(texts: Sequence[list[str]], toxic: np.ndarray, rounds: int = 60) -> ToxicField:
    """Weights by AdaGrad on whole documents with labelled tokens."""
    marking = _marking_features(texts, toxic)
    names: dict[str, int] = {}
    known = {w: i for i, w in enumerate(dict.fromkeys(w for words in texts for w in words))}
    width = 4
    features = np.zeros((len(known), width), dtype=np.int64)
    marked = np.zeros(len(known), dtype=bool)
    for word, i in known.items():
        own = word_features(word)
        features[i, : len(own)] = [names.setdefault(f, len(names) + 1) for f in own]
        marked[i] = not marking.isdisjoint(own[:3])
    sizes = np.array([len(words) for words in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    opens = (ends - sizes)[sizes > 0]
    word = np.array([known[w] for words in texts for w in words], dtype=np.int64)
    y = (marked[word] & np.repeat(toxic.astype(bool), sizes)).astype(np.float64)
    inside = np.ones(len(y), dtype=bool)
    inside[opens] = False
    later = np.flatnonzero(inside)
    seen = np.bincount((2 * y[later - 1] + y[later]).astype(np.int64), minlength=4).reshape(2, 2)
    first = np.array([(y[opens] == 0).sum(), (y[opens] == 1).sum()])
    weights, start, moves, bias = np.zeros(len(names) + 1), np.zeros(2), np.zeros((2, 2)), -4.0
    square = {k: 1e-8 for k in ("w", "s", "m", "b")}
    square["w"] = np.full(len(weights), 1e-8)

    def step(key: str, gradient):
        square[key] = square[key] + gradient**2
        return 0.5 * gradient / np.sqrt(square[key])

    for _ in range(rounds):
        scores = weights[features].sum(axis=1) + bias
        chance, pairs = text_marginals(scores[word], ends, start, moves)
        error = chance - y
        by_word = np.bincount(word, error, minlength=len(known))
        g = np.bincount(features.ravel(), np.repeat(by_word, width), minlength=len(weights))
        g += 0.05 * weights
        g[0] = 0.0
        weights -= step("w", g)
        weights[0] = 0.0
        bias -= step("b", error.sum())
        moves = moves - step("m", pairs - seen + 0.05 * moves)
        begun = np.array([(1 - chance[opens]).sum(), chance[opens].sum()])
        start = start - step("s", begun - first + 0.05 * start)
    kept = {f: float(weights[i]) for f, i in names.items() if abs(weights[i]) > 0.02}
    return ToxicField(kept, float(bias), start, moves)


def _calibrate(seen: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression of labels on document evidence, by Newton steps."""
    x = np.concatenate([np.ones((len(seen), 1)), seen], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -_LIMIT, _LIMIT)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - toxic) + 0.05 * w)
    return w


def _split(text: str | None) -> list[str]:
    return [w.decode() for w in text.encode().split()] if text else []


def fit(texts: Sequence[str | None], toxic: Sequence[int]) -> ToxicField:
    """A field from labelled documents: two thirds teach words, a third the score.

    Without both labels among them there is nothing to learn, and all score the same.
    """
    label = np.asarray(toxic, dtype=np.int64)
    words = [_split(t) for t in texts]
    if label.sum() < 3 or (1 - label).sum() < 3:
        share = np.clip(label.mean() if len(label) else 0.0, 0.01, 0.99)
        return ToxicField(calibration=np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    third = np.zeros(len(label), dtype=bool)
    for value in (0, 1):  # every third of each label calibrates
        third[np.flatnonzero(label == value)[2::3]] = True
    model = _fit_field([w for w, t in zip(words, third, strict=True) if not t], label[~third])
    held = [w for w, t in zip(words, third, strict=True) if t]
    flat = np.array([model.emission(w) for doc in held for w in doc])
    ends = np.cumsum([len(doc) for doc in held])
    model.calibration = _calibrate(evidence(token_chances(model, flat, ends), ends), label[third])
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from the model."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS
) -> DataFrame:
    """(text, toxic) of labelled documents that are not held out, chosen by a hash of their
    id: at most ``sample`` of them, and of those at most ``chars`` code points in all.
    The chosen ids are bounded, so they are broadcast. No labels or no rows give no rows."""
    chosen = (
        labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
        .filter(F.col("doc_id").isNotNull())
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(sample)
    )
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "text", size.alias("size")).filter(F.col("size") <= chars)
    order = [F.xxhash64("doc_id"), F.col("text"), F.col("toxic")]
    few = rows.join(F.broadcast(chosen), "doc_id").orderBy(*order).limit(sample)
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return few.withColumn("used", F.sum("size").over(so_far)).filter(F.col("used") <= chars).drop(
        "size", "used"
    )


class _Emissions(dict):
    def __init__(self, model: ToxicField) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        value = self[word] = self.model.emission(word.decode())
        return value


# Word scores of the model that a worker used last.
_KNOWN: dict[str, _Emissions] = {}


def _emissions(name: str, model: ToxicField) -> _Emissions:
    if name not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[name] = _Emissions(model)
    return _KNOWN[name]


def score_documents(
    docs: DataFrame, model: ToxicField, keep: Sequence[str] = ("doc_id",), with_spans: bool = True
) -> DataFrame:
    """Columns ``keep`` with score, predicted and spans of every document.

    ``spans`` are the words (start, end in code points) that are rather toxic than not.
    Null and blank texts have no tokens and the score of no evidence. Equal texts
    have equal scores; no rows give no rows.
    """
    columns = [*keep, "text"]
    name = uuid.uuid4().hex

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _emissions(name, model)
        for batch in batches:
            for part in in_parts(batch):
                if len(known) > _REMEMBERED:
                    known.clear()
                words: list[bytes] = []
                ends = np.zeros(len(part), dtype=np.int64)
                for i, text in enumerate(part["text"]):
                    words += text.encode().split()
                    ends[i] = len(words)
                flat = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                chances = token_chances(model, flat, ends)
                score = model.document_score(evidence(chances, ends))
                out = part[list(keep)].copy()
                out["score"] = score
                out["predicted"] = (score >= 0.5).astype(np.int32)
                if with_spans:
                    begins = np.concatenate([[0], ends])[:-1]
                    out["spans"] = [
                        _offending(text, chances[begin:end])
                        for text, begin, end in zip(part["text"], begins, ends, strict=True)
                    ]
                yield out

    made = "score double, predicted int"
    if with_spans:
        made += ", spans array<struct<start:int,end:int>>"
    return map_carrying(docs.select(*columns), keep, work, made)


def _offending(text: str | None, chances: np.ndarray) -> list[dict[str, int]]:
    if not len(chances) or chances.max() < 0.5:
        return []
    places = [m.span() for m in re.finditer(WORD, text)]
    return [
        {"start": places[i][0], "end": places[i][1]} for i in np.flatnonzero(chances >= 0.5)
    ]


def learn_and_score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and spans, with a model from the labels.

    Only the text decides a score. Documents without an id are scored and not held out.
    Rows that repeat a labelled id teach once each; ties in the order of the sample go by
    text and label. No documents give no rows, and no labels the same score for all.
    """
    rows = training_rows(docs, labels, sample).collect()
    model = fit([r.text for r in rows], [r.toxic for r in rows])
    return score_documents(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans"
    )
