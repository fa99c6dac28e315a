"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import bounded_sample, drop_path, stored

#: Labelled documents of each class that the model is fitted on, at most; taken by a hash of doc_id.
SAMPLE = 6_000
#: Weight of the Dirichlet prior in tokens (a tenth of the counts, where they are few), deviation beyond which a log-odds ratio counts, length of stems.
PRIOR, DEVIATION, STEM = 5_000.0, 3.0, 4
#: Log-odds ratio of a token that counts, at least.
LEAST_ODDS = 0.05
#: Expected number of segments as good in clean text of the same length, below which one is significant.
SIGNIFICANT = 0.01

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Model:
    """Log-odds of words and of stems (for words without odds of their own), what any other word costs, and the calibration."""

    odds: dict[str, float]
    stems: dict[str, float]
    other: float
    decay: float = 1.0
    scale: float = 1.0
    slope: float = 1.0
    shift: float = 0.0

    def steps(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that have a score, and the scores."""
        odds, stems = self.odds, self.stems
        place, score, seen = [], [], {}
        for i, t in enumerate(tokens):
            s = odds.get(t) or stems.get(t[:STEM])
            if s:
                if s > 0:  # a word that a text repeats says less each time
                    seen[t] = k = seen.get(t, 0) + 1
                    s /= k
                place.append(i)
                score.append(s)
        return np.array(place, np.int64), np.array(score)


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratios and z-scores of tokens by their counts in both classes, with an informative Dirichlet prior in the proportion of both counts together."""
    n_toxic, n_clean = toxic.sum(), clean.sum()
    total = max(1, n_toxic + n_clean)
    weight = min(PRIOR, total / 10)
    prior = weight * (toxic + clean) / total
    odds = np.log((toxic + prior) / (n_toxic + weight - toxic - prior)) - np.log((clean + prior) / (n_clean + weight - clean - prior))
    return odds, odds / np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))


def segments(place: np.ndarray, score: np.ndarray, other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a text, in one pass.

    Words between the scored places cost ``other`` each. Ruzzo and Tompa's scan: candidates are kept
    with the running sum before and after them; a new one is merged with the last candidate that began
    lower and ended lower, for as long as there is one, else it stands by itself. Links to the nearest
    candidate that began lower make the whole scan linear.
    """
    spans: list[list] = []  # start, end, sum before, sum after, index of the nearest candidate with a lower sum before
    total, at = 0.0, 0
    for i, s in zip(place.tolist(), score.tolist(), strict=True):
        total += other * (i - at)
        at = i + 1
        before, total = total, total + s
        if s <= 0:
            continue
        start, end, low, high = i, i + 1, before, total
        j = len(spans) - 1
        while True:
            while j >= 0 and spans[j][2] >= low:
                j = spans[j][4]
            if j < 0 or spans[j][3] >= high:
                break
            start, low = spans[j][0], spans[j][2]
            del spans[j:]
            j -= 1
        spans.append([start, end, low, high, j])
    return [(a, b, high - low) for a, b, low, high, _ in spans]


def evidence(model: Model, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
    """(how surprising the text's toxic passages are together, its significant segments by word).

    In clean text the best segment's score follows an extreme-value law: a segment of score s is
    expected scale * n * exp(-decay * s) times among n words. Each significant segment adds the
    logarithm by which its expectation falls below one.
    """
    tokens = words(text)
    if not tokens:
        return 0.0, []
    base = math.log(model.scale * len(tokens))
    good = [x for x in segments(*model.steps(tokens), model.other) if base - model.decay * x[2] < math.log(SIGNIFICANT)]
    return sum(model.decay * s - base for _, _, s in good), good


def score(model: Model, text: str | None) -> float:
    x = math.log1p(evidence(model, text)[0])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * x + model.shift))))


class Sample:
    """Labelled texts that are read several times: here a list, in ``Stored`` a table that executors read."""

    def __init__(self, labelled: Iterable[tuple[str | None, int]]) -> None:
        self.labelled = list(labelled)

    def each(self, of: Callable[[str | None, int], list[tuple]], kinds: str) -> Iterator[tuple]:
        """The rows that ``of`` makes of each (text, label); kinds: their columns."""
        for text, label in self.labelled:
            yield from of(text, label)

    def summed(self, of: Callable[[str | None, int], list[tuple]], kinds: str) -> dict:
        """Sums of each row's last two values by its first."""
        out: dict = {}
        for key, x, y in self.each(of, kinds):
            a, b = out.get(key, (0, 0))
            out[key] = a + x, b + y
        return out

    def telling(self, cut: slice) -> dict[str, float]:
        """The log-odds of those tokens (the given part of each word) whose deviation counts.

        A token counts once a document: one that a document repeats is no evidence about its class.
        """
        counts = self.summed(_tokens(cut), "key string, x long, y long")
        if not counts:
            return {}
        odds, deviation = log_odds(*np.array(list(counts.values())).T)
        return {t: float(o) for t, o, d in sorted(zip(counts, odds, deviation, strict=True)) if abs(d) >= DEVIATION and abs(o) > LEAST_ODDS}


class Stored(Sample):
    """A table (text, y): every pass runs on the executors, and the driver gets sums or a few numbers a text."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table.repartition(2 * table.sparkSession.sparkContext.defaultParallelism)

    def rows(self, of: Callable[[str | None, int], list[tuple]], kinds: str) -> DataFrame:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[k]) for n, k in (x.split() for x in kinds.split(", "))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [x for text, y in zip(b["text"].to_pylist(), b["y"].to_pylist(), strict=True) for x in of(text, y)]
                columns = list(zip(*out, strict=True)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        return self.table.mapInArrow(run, kinds)

    def each(self, of: Callable[[str | None, int], list[tuple]], kinds: str) -> Iterator[tuple]:
        return map(tuple, sorted(self.rows(of, kinds).collect()))

    def _sums(self, of: Callable[[str | None, int], list[tuple]], kinds: str) -> DataFrame:
        return self.rows(of, kinds).groupBy("key").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))

    def summed(self, of: Callable[[str | None, int], list[tuple]], kinds: str) -> dict:
        return {r["key"]: (r["x"], r["y"]) for r in sorted(self._sums(of, kinds).collect())}

    def telling(self, cut: slice) -> dict[str, float]:
        """As in ``Sample``; the tokens that tell are chosen before the driver sees any."""
        counts, _ = stored(self._sums(_tokens(cut), "key string, x long, y long"), "token-counts")
        n_toxic, n_clean = (x or 0 for x in counts.agg(F.sum("x"), F.sum("y")).first())
        total = max(1, n_toxic + n_clean)
        weight = min(PRIOR, total / 10)
        prior = (F.col("x") + F.col("y")) * (weight / total)
        odds = F.log((F.col("x") + prior) / (n_toxic + weight - F.col("x") - prior)) - F.log((F.col("y") + prior) / (n_clean + weight - F.col("y") - prior))
        deviation = odds / F.sqrt(1 / (F.col("x") + prior) + 1 / (F.col("y") + prior))
        found = counts.select("key", odds.alias("odds"), deviation.alias("deviation")).where((F.abs("deviation") >= DEVIATION) & (F.abs("odds") > LEAST_ODDS))
        return {r["key"]: r["odds"] for r in sorted(found.collect())}


def _tokens(cut: slice) -> Callable[[str | None, int], list[tuple]]:
    """Each token of a text once, with its counts in toxic and in clean texts."""
    return lambda text, label: [(t, label, 1 - label) for t in {t[cut] for t in words(text)}]


def fit(labelled: Iterable[tuple[str | None, int]] | Sample) -> Model:
    """The model of (text, label) pairs, which are read several times; without both labels it finds nothing toxic."""
    sample = labelled if isinstance(labelled, Sample) else Sample(labelled)
    with_words = sample.summed(lambda text, label: [(0, label, 1 - label)] if words(text) else [], "key long, x long, y long")
    if 0 in with_words.get(0, (0, 0)):
        return Model({}, {}, -1.0, shift=-30.0)
    model = Model(sample.telling(slice(None)), sample.telling(slice(STEM)), other=-0.25)

    # what a word of clean text scores: the decay is the positive root of E[exp(decay * score)] = 1
    def values_of(text: str | None, label: int, odds: dict = model.odds, stems: dict = model.stems, other: float = model.other) -> list[tuple]:
        return [] if label else [(v, n, 0) for v, n in Counter(round(odds.get(t) or stems.get(t[:STEM]) or other, 3) for t in words(text)).items()]

    values = sample.summed(values_of, "key double, x long, y long")
    x, p = np.array(list(values)), np.array([n for n, _ in values.values()], float)
    p /= max(1, p.sum())
    drift = float(x @ p)
    if drift >= 0:  # else clean text would be one segment
        model.other -= drift + 0.05
        x = np.where(x == -0.25, model.other, x)
    if len(x) and x.max() > 0:
        low, high = 1e-6, 50.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if p @ np.exp(np.minimum(mid * x, 700)) < 1 else (low, mid)
        model.decay = low

    # the scale from the best segments of clean documents: the maximum-likelihood K of the extreme-value law
    def best_of(text: str | None, label: int, model: Model = model) -> list[tuple]:
        tokens = [] if label else words(text)
        return [(max((s for _, _, s in segments(*model.steps(tokens), model.other)), default=0.0), len(tokens))] if tokens else []

    best = np.array(list(sample.each(best_of, "best double, size long")), float).reshape(-1, 2)
    if len(best):
        model.scale = len(best) / max(1e-9, float(best[:, 1] @ np.exp(-model.decay * best[:, 0])))

    # a logistic line from the evidence to the label, by Newton's steps with a little shrinkage
    def evidence_of(text: str | None, label: int, model: Model = model) -> list[tuple]:
        return [(math.log1p(evidence(model, text)[0]), label)]

    found = np.array(list(sample.each(evidence_of, "evidence double, label long")), float)
    e, y = np.stack([found[:, 0], np.ones(len(found))], axis=1), found[:, 1]
    w = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(e @ w, -30, 30)))
        grad = e.T @ (q - y) + 1e-3 * w
        hess = (e * (q * (1 - q))[:, None]).T @ e + 1e-3 * np.eye(2)
        w -= np.linalg.solve(hess, grad)
    model.slope, model.shift = float(w[0]), float(w[1])
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, most: int = SAMPLE) -> Model:
    """Fit on at most ``most`` labelled documents of each class, in a table of their own; no text comes to the driver."""
    sample, path = stored(bounded_sample(docs, labels, "toxic", usable, most), "labelled")
    model = fit(Stored(sample))
    drop_path(docs.sparkSession, path)
    return model


def scored(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted, passages`` of every whole text: passages are the significant segments as [first word, words, score].

    Only text is read for the score. Null and empty texts score as text without any toxic passage;
    repeated rows score alike, whatever their doc_id; an empty table gives no rows; no other column is
    read or returned.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            scores, spans = [], []
            for text in (x.as_py() for x in b["text"]):
                total, found = evidence(model, text)
                x = model.slope * math.log1p(total) + model.shift
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))
                spans.append([{"first": a, "words": e - a, "score": s} for a, e, s in found])
            flags = pa.array([int(s >= threshold) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(scores, pa.float64()), flags, pa.array(spans, kind)], ["doc_id", "score", "predicted", "passages"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int, passages array<struct<first: long, words: long, score: double>>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold; null text stays. One pass, no join."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        model = shipped.value
        return pa.array((score(model, x.as_py()) < threshold for x in texts), pa.bool_())

    return docs.where(clean(F.coalesce(F.col("text").cast("string"), F.lit(""))))
