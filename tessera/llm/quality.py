"""Quality of documents by attention-based multiple-instance learning over their passages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import bounded_sample, drop_path, stored

#: Bytes of a passage, hashed pairs of bytes, width of a passage's encoding and of the attention.
PASSAGE, PAIRS, WIDTH, GATE = 1_000, 256, 32, 16
#: Labelled documents of each class that are learnt from, at most (by a hash of doc_id), and bytes of text that are held at once.
SAMPLE, HELD = 4_000, 1 << 22
#: Bytes of all texts of a class that are learnt from, at most: a document that no longer fits is left out of the fit.
SAMPLE_BYTES = 1 << 26

_BUCKET = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(PAIRS)


def passages(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage of every text, first passage of each text); an empty text is one empty passage.

    A passage is a run of PASSAGE bytes of UTF-8. Features: square roots of the shares of each byte, of
    hashed pairs of neighbouring bytes, and how many of the pairs' buckets occur.
    """
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    count = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    within = np.arange(len(data)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    at = np.repeat(first[:-1], sizes) + within // PASSAGE
    n = int(first[-1])
    single = np.bincount(at * 256 + data, minlength=n * 256).reshape(n, 256)
    code = _BUCKET[data[:-1].astype(np.int64) * 256 + data[1:]].astype(np.int64) if len(data) > 1 else np.empty(0, np.int64)
    inside = at[:-1] == at[1:]
    double = np.bincount((at[:-1] * PAIRS + code)[inside], minlength=n * PAIRS).reshape(n, PAIRS)
    total = np.maximum(1, single.sum(axis=1, keepdims=True))
    spread = (double > 0).mean(axis=1, keepdims=True)
    return np.hstack([np.sqrt(single / total), np.sqrt(double / total), spread]).astype(np.float32), first[:-1]


@dataclass
class Model:
    """Centre and scale of the features, and the weights by name."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        """Gated attention: passages are encoded, weighed by softmax within their document, and the weighted encoding is scored."""
        w = self.w
        x = (x - self.mean) * self.scale
        h = np.maximum(0, x @ w["encode"] + w["encode0"])
        t, g = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (t * g) @ w["attend"]
        sizes = np.diff(np.append(first, len(x)))
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
        a /= np.repeat(np.add.reduceat(a, first), sizes)
        z = np.add.reduceat(h * a[:, None], first, axis=0)
        return x, h, t, g, a, sizes, z, z @ w["score"] + w["score0"]

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        x, h, t, g, a, sizes, z, logit = self.forward(x, first)
        d = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / weight.sum()
        dz = np.repeat(d[:, None] * w["score"], sizes, axis=0)
        da = (h * dz).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), sizes))
        dt, dg = de[:, None] * w["attend"] * g * (1 - t * t), de[:, None] * w["attend"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ w["tanh"].T + dg @ w["gate"].T) * (h > 0)
        return {"score": z.T @ d, "score0": d.sum(keepdims=True), "attend": (t * g).T @ de, "tanh": h.T @ dt, "gate": h.T @ dg, "encode": x.T @ dh, "encode0": dh.sum(axis=0)}

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(score 0 to 1, the most attended passage) of each text."""
        if not texts:
            return np.empty(0), np.empty(0, np.int64)
        x, first = passages(texts)
        *_, a, sizes, _, logit = self.forward(x, first)
        top = [int(a[i : i + n].argmax()) for i, n in zip(first.tolist(), sizes.tolist(), strict=True)]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), np.array(top, np.int64)


def _runs(texts: list[str | None], held: int = HELD) -> Iterator[list[str | None]]:
    """The texts in runs of at most ``held`` characters (or one longer text)."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= held):
            size += len(texts[end] or "")
            end += 1
        yield texts[at:end]
        at = end


def _all_passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """As ``passages``, run by run, so that only the features of all texts are held at once."""
    parts = [passages(part) for part in _runs(texts, HELD >> 2)]
    offsets = np.cumsum([0, *(len(x) for x, _ in parts)])
    return np.vstack([x for x, _ in parts]), np.concatenate([first + o for (_, first), o in zip(parts, offsets, strict=False)])


def fit(labelled: list[tuple[str | None, int]], share: float | None = None, rounds: int = 40, seed: int = 7) -> Model:
    """Learn from (text, label) pairs; ``share``: of label 1 in the population, which the loss is weighted to. One label alone is scored as sure."""
    y = np.array([label for _, label in labelled], float)
    x, first = _all_passages([text for text, _ in labelled]) if labelled else (np.zeros((1, 256 + PAIRS + 1), np.float32), np.zeros(1, np.int64))
    rng = np.random.default_rng(seed)
    scale = 1 / np.maximum(x.std(axis=0), 1e-2)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"encode": draw(x.shape[1], WIDTH), "encode0": np.zeros(WIDTH), "tanh": draw(WIDTH, GATE), "gate": draw(WIDTH, GATE), "attend": draw(GATE), "score": np.zeros(WIDTH), "score0": np.zeros(1)}
    model = Model(x.mean(axis=0), scale, w)
    if len(set(y)) < 2:
        w["score0"] += (1 if y.mean() else -1) * 5.0 if len(y) else 0.0
        return model
    share = y.mean() if share is None else share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w["score0"] += np.log(share / (1 - share))
    m, v = ({k: np.zeros_like(u) for k, u in w.items()} for _ in range(2))
    steps = 0
    ends = np.append(first, len(x))
    batch = max(8, min(64, len(y) // 8))
    for r in range(rounds):
        order = rng.permutation(len(y))
        rate = 2e-3 * (1 - r / rounds)
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            rows = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in docs])
            starts = np.concatenate([[0], np.cumsum(ends[docs + 1] - ends[docs])[:-1]])
            grads = model.gradients(x[rows], starts, y[docs], weight[docs])
            steps += 1
            for k, g in grads.items():
                g = g + (1e-4 * w[k] if w[k].ndim > 1 else 0)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                w[k] -= rate * m[k] / (1 - 0.9**steps) / (np.sqrt(v[k] / (1 - 0.999**steps)) + 1e-8)
    return model


def within(rows: list[tuple], most_bytes: int) -> list:
    """Of (y, order, bytes, what) rows what is taken by order, class by class, as long as it fits the class's bytes."""
    left, out = {}, []
    for y, _, size, what in sorted(rows):
        if size <= left.setdefault(y, most_bytes):
            left[y] -= size
            out.append(what)
    return out


def train(docs: DataFrame, labels: DataFrame, usable: Column, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``most`` labelled documents and ``most_bytes`` of text of each class, weighted to the classes' shares among all usable labels."""
    share = labels.where(F.col("quality").isin(0, 1) & usable).agg(F.avg("quality")).first()[0]
    sample, path = stored(bounded_sample(docs, labels, "quality", usable, most), "labelled")
    digest = F.xxhash64("text").alias("digest")
    sizes = sample.select("y", digest, F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).collect()
    taken = within([(r["y"], r["digest"], r["size"], (r["y"], r["digest"])) for r in sizes], most_bytes)
    if len(taken) < len(sizes):
        fits = docs.sparkSession.createDataFrame(sorted(set(taken)), "y int, digest long")
        sample = sample.withColumn("digest", F.xxhash64("text")).join(F.broadcast(fits), ["y", "digest"], "left_semi")
    rows = sample.select("text", "y").collect()
    drop_path(docs.sparkSession, path)
    return fit(sorted(((r["text"], r["y"]) for r in rows), key=lambda x: (x[0] or "", x[1])), share)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted, top_passage`` of every whole text: the passage (from 0, of PASSAGE bytes) with the largest weight.

    Only text is read for the score. Null counts as empty: one passage without content, scored like any
    other; repeated rows score alike; an empty table gives no rows. Texts are taken in runs of about
    HELD bytes (or one longer text).
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for b in batches:
            texts = b["text"].to_pylist()
            parts = [model.scores(part) for part in _runs(texts)]
            score, top = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(top)], ["doc_id", "score", "predicted", "top_passage"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int, top_passage long")
