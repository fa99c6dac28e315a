"""SimHash near-duplicates, linked by multi-index hashing over fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import components, stored

SEED = 42
BITS = 64


def simhash(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text, unsigned.

    Words are runs of bytes other than ASCII white space, after A-Z went to lower case; a shingle is
    ``shingle`` words joined by a blank, repeats included (all words, where there are fewer). A bit is
    one if it is set in more than half of the shingles' XXH64. Null or no words: zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts[:-shingle].tolist(), (starts[shingle:] - 1).tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    every = np.array(hashes, "<u8")
    for at in range(0, len(every), 1 << 16):
        bits = np.unpackbits(every[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    mark = np.packbits(2 * ones > len(every), bitorder="little")
    return int(mark.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``digest`` of the text and ``fp``, the SimHash as a signed long, of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(x, shingle) for x in b["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["digest"], pa.array(fps)], ["doc_id", "digest", "fp"])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(F.col("text")).alias("digest"), F.col("text").cast("string").alias("text"))
    return whole.mapInArrow(run, "doc_id long, digest long, fp long")


def _radii(distance: int, segments: int) -> list[int]:
    """Ball radii by segment with sum(r + 1) = distance + 1: a pair within the distance agrees within some segment's radius."""
    return [(distance + 1 + i) // segments - 1 for i in reversed(range(segments))]


def _masks(width: int, radius: int) -> list[int]:
    """Every change of at most ``radius`` of the ``width`` low bits, as XOR masks."""
    out, last = [0], [0]
    for _ in range(max(0, radius)):
        last = sorted({m | 1 << b for m in last for b in range(width) if not m >> b & 1})
        out += last
    return out


def near_pairs(prints: DataFrame, distance: int = 2, segments: int = 2) -> DataFrame:
    """Pairs ``(u, v)``, u < v, of different fingerprints ``fp`` that differ in at most ``distance`` bits.

    Multi-index hashing: the table holds each fingerprint under the value of each of its segments; a
    probe enumerates the Hamming ball of the segment's radius about its own value, fetches the matches
    and verifies the whole distance. The radii follow from the pigeonhole principle (for 2 bits and two
    segments of 32: radius 1 and radius 0), so that no pair is missed. ``fp`` must be distinct: a
    fingerprint then has no more partners than its Hamming ball has points, whatever the copies.

    The join is a merge join by a hint: the optimizer's estimate of the probes' size leaves out that each
    fingerprint makes 34 of them, so that it would have the driver gather and broadcast them all.
    """
    width = BITS // segments
    parts: list[tuple[DataFrame, DataFrame]] = []
    for i, radius in enumerate(_radii(distance, segments)):
        if radius < 0:
            continue
        value = F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1))
        stock = prints.select(F.lit(i).alias("seg"), value.alias("key"), F.col("fp").alias("v"))
        masks = F.explode(F.array(*[F.lit(m).cast("long") for m in _masks(width, radius)]))
        asks = prints.select(F.col("fp").alias("u"), value.alias("own"), masks.alias("mask")).select(F.lit(i).alias("seg"), F.col("own").bitwiseXOR(F.col("mask")).alias("key"), "u")
        parts.append((stock, asks))
    stock, asks = parts[0]
    for s, a in parts[1:]:
        stock, asks = stock.union(s), asks.union(a)
    found = asks.hint("merge").join(stock, ["seg", "key"]).where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance))
    return found.select("u", "v").distinct()


def near_duplicates(docs: DataFrame, distance: int = 2, segments: int = 2, shingle: int = 3) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (signed long), ``component_id``.

    ``component_id`` is the smallest doc_id that links of at most ``distance`` differing bits reach, the
    own one included. Documents without words have fingerprint zero and link like any other. Equal
    fingerprints collapse to one node before any join, so that groups of copies cost one row; links are
    kept between different fingerprints only. Repeated doc_ids give a row each; a null doc_id keeps its
    row and never names a component unless the whole component is null. An empty table gives no rows.
    """
    prints, known = _classes(docs, distance, segments, shingle)
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def _classes(docs: DataFrame, distance: int, segments: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: (doc_id, digest of the text, fp) by row; (fp, component_id, survivor) by different fingerprint."""
    prints, _ = stored(fingerprints(docs, shingle), "simhash")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    nodes, _ = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(row).alias("first")), "simhash-nodes")
    roots, _ = stored(components(near_pairs(nodes.select("fp"), distance, segments)), "simhash-roots")
    linked = roots.join(nodes, roots["node"] == nodes["fp"]).groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("survivor"))
    linked, _ = stored(linked, "simhash-linked")
    of_linked, _ = stored(roots.join(linked, "root").select(F.col("node").alias("fp"), "component_id", "survivor"), "simhash-components")
    known = nodes.join(of_linked, "fp", "left").select("fp", F.when(F.col("survivor").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("survivor", "first").alias("survivor"))
    known, _ = stored(known, "simhash-classes")
    return prints, known


def keep_one(docs: DataFrame, distance: int = 2, segments: int = 2, shingle: int = 3) -> DataFrame:
    """The rows that open their component, all columns of docs: one document of each group stays.

    It is the row of the smallest doc_id (nulls last), among rows of one doc_id the one whose text has
    the smallest digest; of wholly repeated (doc_id, text) rows one stays.
    """
    prints, known = _classes(docs, distance, segments, shingle)
    stays, _ = stored(known.select("survivor.doc_id", "survivor.digest").distinct(), "simhash-stays")
    return kept_rows(docs, prints, stays)


def kept_rows(docs: DataFrame, prints: DataFrame, stays: DataFrame) -> DataFrame:
    """The rows of docs that stay (doc_id, digest), wholly repeated ones once. prints: (doc_id, digest) of every row."""
    stays = stays.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    same = docs["doc_id"].cast("long").eqNullSafe(stays["_id"]) & (_digest(docs["text"]) == stays["_digest"])
    kept = docs.join(stays, same, "left_semi")
    repeated = prints.groupBy("doc_id", "digest").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
