"""Packing of token sequences: large-item matching, then best fit, planned on the length histogram."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm._shared import stored

#: Rows of a length that are ranked together, at most about.
RANKED = 20_000


def pieces(docs: DataFrame, vocabulary: str, pattern: str, end_id: int, capacity: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids with ``end_id`` after them.

    Only documents of more than ``capacity`` ids are cut; all pieces but the first then have
    ``capacity`` ids, the first has what remains. Null text counts as empty: one piece, the end id. The
    added tokens of the vocabulary's JSON file are found in a text, as ``tokenizers`` does. Texts of any
    length are encoded whole; no column but doc_id and text is read.
    """
    ranks, added = tokens.ranks_of(vocabulary), tokens.added_of(vocabulary)
    shipped = docs.sparkSession.sparkContext.broadcast((ranks, pattern, tokens.key_of(ranks, added), added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(*shipped.value)
        added = shipped.value[3]
        # without an added token in the text both give the same ids; looking first is the faster way
        encode = lambda x: encoder.encode(x, allowed_special="all") if any(t in x for t in added) else encoder.encode_ordinary(x)
        for b in batches:
            row: list[int] = []
            out: list[tuple[int, int, int, int]] = []
            for at, text in enumerate(b["text"].to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                first = len(ids) % capacity or capacity
                for i, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = end - capacity if i else 0
                    row.append(at)
                    out.append((i, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(row, pa.int64())), *columns], ["doc_id", *kinds])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how many sequences have each: ``[(lengths in order, sequences), ...]``.

    Lengths above a third of the capacity go at most two to a sequence: from the longest down, each is
    matched with the longest other that still fits. Then, from the longest down, each smaller length
    goes where the least room would stay that still holds it, and opens a new sequence where none does.
    Items of one length are interchangeable, so all steps handle counts: their number follows the number
    of different lengths (at most ``capacity``), and so does the number of fillings, whatever the corpus.
    """
    if any(length > capacity or length < 1 for length in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    left = Counter({length: n for length, n in counts.items() if n})
    fills: Counter[tuple[int, ...]] = Counter()
    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        if at < 0:
            fills[(a,)] += left.pop(a)
            large.pop()
            continue
        b = large[at]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        if n:
            fills[(a, b)] += n
            left[a] -= n
            left[b] -= n
        if a == b and left[a]:  # the odd one out takes the next shorter, if any
            rest = [x for x in large[:at] if left[x]]
            other = (a, rest[-1]) if rest else (a,)
            fills[other] += 1
            left.subtract(other)
        large = [x for x in large if left[x] > 0]
    left = +left
    room: dict[int, list[list]] = {}  # room left: [filling, sequences]
    for filling, n in fills.items():
        room.setdefault(capacity - sum(filling), []).append([filling, n])
    gaps = sorted(room)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                room.setdefault(capacity, []).append([(), -(-n // (capacity // length))])
                gaps.append(capacity)
                at = len(gaps) - 1
            gap = gaps[at]
            filling, bins = room[gap].pop()
            if not room[gap]:
                del room[gap]
                gaps.pop(at)
            fit = gap // length  # best fit goes on with the sequence it has just narrowed
            full = min(bins, n // fit)
            n -= full * fit
            parts = [(full, fit)]
            if n and full < bins:
                parts.append((1, n))
                n = 0
            for m, k in [*parts, (bins - sum(m for m, _ in parts), 0)]:
                if m:
                    now = gap - k * length
                    if now not in room:
                        bisect.insort(gaps, now)
                    room.setdefault(now, []).append([filling + (length,) * k, m])
    total: Counter[tuple[int, ...]] = Counter()
    for entries in room.values():
        for filling, n in entries:
            total[filling] += n
    return list(total.items())


def _slots(fillings: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length, first rank) and, for the ranks from there on, the first sequence and the offset in it."""
    taken: Counter[int] = Counter()
    rows, sequence = [], 0
    for filling, n in fillings:
        offset = 0
        for length in filling:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return columns[0], columns[1], columns[2], columns[3]


def packed(parts: DataFrame, capacity: int) -> DataFrame:
    """``parts`` (see ``pieces``) with ``sequence_id`` and ``offset``: each sequence is filled gaplessly from 0, to ``capacity`` at most.

    The driver sees the length histogram only (at most ``capacity`` rows) and ships the plan, whose size
    is bounded likewise. Pieces of one length are numbered in salted groups of about RANKED rows with
    the groups' offsets from their counts, so that a length which a third of all pieces have meets in no
    single task. An empty table gives no rows; repeated rows are packed one by one; of pieces of one length
    it does not matter which goes where.
    """
    spark = parts.sparkSession
    parts, _ = stored(parts, "pieces")
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    slots = spark.sparkContext.broadcast(_slots(plan(counts, capacity)))
    salts = max(32, -(-max(counts.values(), default=0) // RANKED))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups, _ = stored(groups.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")), "piece-groups")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within)).join(groups, ["length", "salt"])
    ranked = ranked.select(*parts.columns, (F.col("before") + F.col("rank") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first, sequence, offset = slots.value
        if len(lengths):
            spread = np.int64(1) << np.int64(42)
            keys = lengths * spread + first
        for b in batches:
            rank = b["rank"].to_numpy()
            if len(rank):
                at = np.searchsorted(keys, b["length"].to_numpy() * spread + rank, side="right") - 1
                placed = {"sequence_id": pa.array(sequence[at] + rank - first[at]), "offset": pa.array(offset[at])}
                yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), *placed.values()], [*kept, *placed])

    kept = parts.columns
    return ranked.mapInArrow(place, ", ".join(f"{n} {k}" for n, k in parts.dtypes) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens; see ``pieces`` and ``packed``."""
    return packed(pieces(docs, vocabulary, pattern, end_id, capacity), capacity)
