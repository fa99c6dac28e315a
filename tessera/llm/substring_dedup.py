"""Passages that repeat across documents: paragraph MinHash banding, and anchors for passages within paragraphs."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import UNNAMED, Scratch, components, keyed, may_be_among

#: Words of a shingle, similarity and recall of the banding. Paragraphs of fewer words than a shingle repeat by equality only.
SHINGLE, SIMILAR, RECALL = 5, 0.8, 0.998
#: Rows of a band of the second, finer banding.
FINE_ROWS = 8
#: Words of an anchor, and anchors' starts of which one is chosen: any common run of ANCHOR + CHOICE - 1 = 49 words has one.
ANCHOR, CHOICE = 20, 30
#: Values that a worker gathers before it hands them on.
HELD = 1 << 17
#: Words to each side of an anchor's first word in which the starts of the runs lie that it stands for.
REACH = CHOICE - 1
#: Bits of a paragraph's map of shingles, by which most unlike pairs drop out before their sets are fetched.
MARKS = 1024

_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"\S+")


def bands_for(similar: float = SIMILAR, recall: float = RECALL, most: int = 10) -> tuple[int, int]:
    """(bands, rows of a band): the longest bands with which at most ``most`` of them find a pair of that similarity with that recall."""
    found = (1, 1)
    for rows in range(1, 9):
        p = similar**rows
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands <= most:
            found = bands, rows
    return found


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """A hash for each run of n words."""
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = _mix(out) + h[k : len(h) - n + 1 + k]
    return _mix(out)


class _Sums:
    """Prefix sums of a text's word hashes, weighted by powers, from which the hash of any stretch of words follows."""

    def __init__(self, h: np.ndarray) -> None:
        base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
        up, down = np.full(len(h) + 1, base, np.uint64), np.full(len(h) + 1, inverse, np.uint64)
        up[0] = down[0] = 1
        up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64)])

    def runs(self, n: int) -> np.ndarray:
        """A hash for each run of n words."""
        return _mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])

    def stretches(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash for the words from each start up to the end."""
        return _mix(_mix((self.sums[end] - self.sums[start]) * self.down[start]) + (end - start).astype(np.uint64) * _ODD)


def anchors(sums: _Sums) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of the chosen runs of ANCHOR words: the smallest hash of each CHOICE neighbouring runs (winnowing).

    A run that equals the one before (one word over and over) is not chosen again.
    """
    if len(sums.sums) <= ANCHOR:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = sums.runs(ANCHOR)
    rank = g.copy()
    rank[1:][g[1:] == g[:-1]] = np.uint64(2**64 - 1)
    if len(g) <= CHOICE:
        at = np.array([int(rank.argmin())])
    else:
        windows = np.lib.stride_tricks.sliding_window_view(rank, CHOICE)
        at = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
    return at, g[at]


def _paragraphs(text: str) -> tuple[list[str], list[tuple[int, int, str]]]:
    """(words of the text in lower case, [(first word, end, paragraph's words joined)]); a paragraph is a line that is not blank."""
    words: list[str] = []
    found = []
    for line in text.lower().split("\n"):
        own = line.split()
        if own:
            found.append((len(words), len(words) + len(own), " ".join(own)))
        words += own
    return words, found


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of n MinHash functions, as columns. What they are applied to is mixed already, so a product and a sum do."""
    rng = np.random.default_rng(11)
    factor = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factor[:, None], rng.integers(0, 1 << 63, n, dtype=np.uint64)[:, None]


def _least(shingles: np.ndarray, cuts: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least hash of each function (rows) in the slices that begin at the cuts (columns); few functions at once where the text is long."""
    factor, offset = functions
    step = max(1, (1 << 21) // max(1, len(shingles)))
    parts = []
    for i in range(0, len(factor), step):
        x = shingles * factor[i : i + step]
        x += offset[i : i + step]
        parts.append(np.minimum.reduceat(x, cuts, axis=1))
    return np.concatenate(parts)


def _band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys (bands x sets) of the least hashes (functions x sets)."""
    keys = np.zeros((bands, least.shape[1]), np.uint64)
    for r in range(rows):
        keys = _mix(keys + least[r::rows] + np.arange(bands, dtype=np.uint64)[:, None] * _ODD)
    return keys


def _units(rows: DataFrame, bands: int, size: int) -> DataFrame:
    """Per row (key, text) its paragraphs (kind 0: two hashes, bands) and anchors (kind 1), by first word and end.

    An anchor bears its hash, h1, and the hash of all words that the runs it stands for have, h2: its
    variant. First word and end are theirs.
    """
    functions = _functions(bands * size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b["key"].to_pylist()
            held, out = 0, []
            for name, text in zip(names, (x.as_py() for x in b["text"]), strict=True):
                words, found = _paragraphs(text or "")
                if not words:
                    continue
                h = _hashes(words)
                long = [(a, e) for a, e, _ in found if e - a >= SHINGLE]
                own = iter(())
                if long:
                    sh = _shingles(h)
                    start, end = np.array(long).T
                    # rows of shingles between the paragraphs belong to none: every second slice
                    cuts = np.stack([start, np.minimum(end - SHINGLE + 1, len(sh))], axis=1).ravel()
                    cuts = cuts[:-1] if cuts[-1] == len(sh) else cuts
                    own = iter(_band_keys(_least(sh, cuts, functions)[:, ::2], bands, size).T.view(np.int64))
                for a, e, joined in found:
                    two = xxhash.xxh128_intdigest(joined)
                    out.append((name, 0, a, e, two & (2**64 - 1), two >> 64, next(own) if e - a >= SHINGLE else None))
                held += len(found) * (bands + 6)
                sums = _Sums(h)
                at, g = anchors(sums)
                if len(at):
                    first, end = np.maximum(at - REACH, 0), np.minimum(at + REACH + ANCHOR, len(h))
                    around = _mix(sums.stretches(first, end) + (at - first).astype(np.uint64))
                    out += [(name, 1, a, e, x, y, None) for a, e, x, y in zip(first.tolist(), end.tolist(), g.tolist(), around.tolist(), strict=True)]
                    held += len(at) * 6
                if held > HELD:
                    yield batch(out)
                    held, out = 0, []
            yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        data = [pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[1:4]), signed(cols[4]), signed(cols[5]), pa.array(cols[6], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(data, ["key", "kind", "first", "end", "h1", "h2", "bands"])

    return rows.select("key", "text").mapInArrow(run, "key long, kind int, first int, end int, h1 long, h2 long, bands array<long>")


def packed_span(first: Column, end: Column) -> Column:
    """First word and end in one long."""
    return F.shiftleft(first.cast("long"), 32).bitwiseOR(end.cast("long"))


def _fetched(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """What is wanted of the texts: shingle sets (kind 0: h1, shingles, marks) and runs (kind 1: the run's hash as h1, key, first).

    wanted: (kind, least, pos, h1): the key of a row, and a span of its words. Of kind 0 the set of the
    span's shingles is made; of kind 1 all runs of ANCHOR words within it. Only rows of which something is
    wanted are read, by one join.
    """
    lists = wanted.groupBy("least").agg(F.collect_list(F.struct("kind", "pos", "h1")).alias("wanted"))
    some = may_be_among(rows.select("key", "text"), wanted.select(F.col("least").alias("key")).distinct(), "key")
    met = some.join(lists, F.col("key") == F.col("least")).select("key", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pa.compute.list_value_length(b["wanted"]).to_numpy(zero_copy_only=False))
            kinds, spans, names = (x.to_numpy() for x in b["wanted"].flatten().flatten())
            held, out = 0, []
            for i, (key, text) in enumerate(zip(b["key"].to_pylist(), (x.as_py() for x in b["text"]), strict=True)):
                h = _hashes((text or "").lower().split())
                own = slice(ends[i - 1] if i else 0, ends[i])
                kind, first, end = kinds[own], spans[own] >> 32, spans[own] & (2**32 - 1)
                for a, e, name in zip(first[kind == 0].tolist(), end[kind == 0].tolist(), names[own][kind == 0].tolist(), strict=True):
                    x = np.unique(_shingles(h[a:e]).view(np.int64))
                    out.append(((0, name, key, 0), x, _marks(x)))
                    held += len(x)
                if (kind == 1).any():
                    every = _Sums(h).runs(ANCHOR)
                    edges = np.zeros(len(every) + 1, np.int64)
                    np.add.at(edges, first[kind == 1], 1)
                    np.add.at(edges, end[kind == 1] - ANCHOR + 1, -1)
                    near = np.flatnonzero(np.cumsum(edges[:-1]))
                    out.append((np.stack([np.ones(len(near), np.int64), every[near].view(np.int64), np.full(len(near), key, np.int64), near]), None, None))
                    held += 4 * len(near)
                if held > HELD:
                    yield batch(out)
                    held, out = 0, []
            yield batch(out)

    def batch(found: list[tuple]) -> pa.RecordBatch:
        sizes = [1 if x is not None else f.shape[1] for f, x, _ in found]
        flat = np.concatenate([np.array(f, np.int64).reshape(4, -1) for f, _, _ in found], axis=1) if found else np.empty((4, 0), np.int64)

        def listed(at: int) -> pa.Array:
            whole = [x for f in found if (x := f[at]) is not None]
            lengths = np.repeat([0 if f[at] is None else len(f[at]) for f in found], sizes) if found else np.empty(0, np.int64)
            values = np.concatenate(whole) if whole else np.empty(0, np.int64)
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))

        columns = [pa.array(flat[0].astype(np.int32)), pa.array(flat[1]), pa.array(flat[2]), pa.array(flat[3].astype(np.int32)), listed(1), listed(2)]
        return pa.RecordBatch.from_arrays(columns, ["kind", "h1", "key", "first", "shingles", "marks"])

    return met.mapInArrow(run, "kind int, h1 long, key long, first int, shingles array<long>, marks array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have that Jaccard similarity or more."""
    side = lambda x: sets.select(F.col("h1").alias(x), F.col("shingles").alias(f"{x}_set"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    common = F.size(F.array_intersect("u_set", "v_set"))
    return both.where(common >= similar * (F.size("u_set") + F.size("v_set") - common)).select("u", "v")


def _fine_bands(sets: DataFrame, similar: float) -> DataFrame:
    """(key, h1): the shingle sets under FINE_ROWS rows a band, which hardly any pair of lesser similarity shares."""
    bands = math.ceil(math.log(1 - RECALL) / math.log(1 - similar**FINE_ROWS))
    rng = np.random.default_rng(12)
    factor = rng.integers(0, 1 << 63, (bands, FINE_ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for x in b["shingles"]:
                values = x.values.to_numpy().view(np.uint64)
                least = np.stack([_mix(f * values).min(axis=1) for f in factor])
                key = np.arange(bands, dtype=np.uint64) * _ODD
                for r in range(FINE_ROWS):
                    key = _mix(key + least[:, r])
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)), b["h1"].take(pa.array(np.repeat(np.arange(len(keys)), bands)))], ["key", "h1"])

    return sets.mapInArrow(run, "key long, h1 long")


def _buckets(scratch: Scratch, rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(members with their bucket's size, pairs of each member with its bucket's chosen ones): buckets of at least two."""
    shuffled = [F.xxhash64("h1", F.lit(i)) for i in range(2)]
    chosen = [F.min("h1").alias("r0"), F.max("h1").alias("r1"), *[F.min_by("h1", x).alias(f"r{i + 2}") for i, x in enumerate(shuffled)]]
    buckets = scratch.write(f"{label}-buckets", rows.groupBy("key").agg(*chosen, F.count(F.lit(1)).alias("n")).where("r0 <> r1"))
    members = scratch.write(f"{label}-members", rows.join(buckets, "key"))
    star = members.select("h1", F.explode(F.array("r0", "r1", "r2", "r3")).alias("r")).where("h1 <> r")
    star = scratch.write(f"{label}-star", star.select(F.least("h1", "r").alias("u"), F.greatest("h1", "r").alias("v")).distinct())
    return members.select("key", "h1", "n"), star


def _mixed(scratch: Scratch, members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (key, h1, root) of buckets that still hold several components and had pairs that no star compared."""
    known = members.where("n > 3").join(roots.withColumnRenamed("node", "h1"), "h1", "left").select("key", "h1", F.coalesce("root", "h1").alias("root"))
    known = scratch.write("bucket-roots", known)
    mixed = scratch.write("mixed-buckets", known.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key"))
    return scratch.write("mixed-members", known.join(mixed, "key", "left_semi"))


def _marks(shingles: np.ndarray) -> np.ndarray:
    """A bit map of MARKS bits with one bit set for each shingle (some share one), as longs."""
    bits = np.zeros(MARKS, np.uint8)
    bits[_mix(shingles.view(np.uint64)) % np.uint64(MARKS)] = 1
    return np.packbits(bits).view(np.int64)


def _may_be_similar(u: str, v: str, similar: float) -> Column:
    """False only for pairs that cannot reach the similarity: a mark that one has alone is a shingle that it has alone."""
    words = range(MARKS // 64)
    need = (F.col(f"{u}_n") + F.col(f"{v}_n")) * (similar / (1 + similar)) - 1e-6
    alone = lambda a, b: sum((F.bit_count(F.get(f"{a}_marks", F.lit(i)).bitwiseAND(F.bitwise_not(F.get(f"{b}_marks", F.lit(i))))) for i in words), F.lit(0))
    return (F.col(f"{u}_n") - alone(u, v) >= need) & (F.col(f"{v}_n") - alone(v, u) >= need)


class NearSets:
    """Components of similar shingle sets: (node, root), both ``h1``. distinct: (h1, least, pos, bands), one row a set.

    Sets that collide in a band form a bucket. In every bucket each member is compared with four
    chosen ones (smallest, largest, two by hash). Members of buckets of more than three go through a
    second, finer banding, again with chosen ones; the verified links give first components, and what
    they leave apart in a fine bucket is compared pair by pair across components, first by maps of the
    shingles that rule out no similar pair. So a group of near copies costs some rows a member instead
    of all its pairs, and no component misses a link that both bandings find (each with RECALL at the
    threshold, more above).

    ``wanted`` are the sets to fetch from the texts; ``components`` takes them.
    """

    def __init__(self, scratch: Scratch, distinct: DataFrame, similar: float) -> None:
        self.scratch, self.similar = scratch, similar
        rows = scratch.write("bands", distinct.select("h1", F.explode("bands").alias("key")))
        self.members, self.star = _buckets(scratch, rows, "band")
        scratch.drop("bands", "band-buckets")
        wanted = distinct.select("h1", "least", "pos").join(self.members.select("h1").distinct(), "h1", "left_semi")
        self.wanted = scratch.write("wanted", wanted.select(F.lit(0).alias("kind"), "least", "pos", "h1"))

    def components(self, sets: DataFrame) -> DataFrame:
        """sets: (h1, shingles, marks) of all that is wanted, one row a set."""
        scratch, similar = self.scratch, self.similar
        fine = scratch.write("fine-bands", _fine_bands(sets.join(self.members.where("n > 3").select("h1").distinct(), "h1", "left_semi"), similar))
        members, more = _buckets(scratch, fine, "fine")
        links = scratch.write("set-links", _similar(self.star.union(more).distinct(), sets, similar))
        roots = scratch.write("roots", components(links))
        rest = _mixed(scratch, members, roots)
        rest = rest.join(sets.select("h1", F.size("shingles").alias("n"), "marks"), "h1")
        side = lambda x: rest.select("key", F.col("h1").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("root", "n", "marks")])
        across = side("u").join(side("v"), "key").where((F.col("u") < F.col("v")) & (F.col("u_root") != F.col("v_root")) & _may_be_similar("u", "v", similar))
        across = across.select("u", "v").distinct()
        more = scratch.write("set-links-across", _similar(across, sets, similar))
        return roots if more.isEmpty() else scratch.write("roots-again", components(links.union(more)))


def near_sets(scratch: Scratch, rows: DataFrame, distinct: DataFrame, similar: float) -> DataFrame:
    """``NearSets`` of spans of rows (key, text), fetched by themselves."""
    near = NearSets(scratch, distinct, similar)
    sets = scratch.write("shingle-sets", _fetched(rows, near.wanted).dropDuplicates(["h1"]).select("h1", "shingles", "marks"))
    return near.components(sets)


def _spans(scratch: Scratch, rows: DataFrame, similar: float) -> DataFrame:
    """(key, first_key, first, end) of all repeated passages of rows (key, text), each as often as it is found; see ``repeated_passages``."""
    bands, size = bands_for(similar)
    units = scratch.write("units", _units(rows, bands, size), by="kind")
    whole, parts = units.where("kind = 0"), units.where("kind = 1")

    flat = [F.get("bands", F.lit(i)).alias(f"b{i}") for i in range(bands)]
    own = whole.select("key", "h1", "h2", packed_span(F.col("first"), F.col("end")).alias("pos"), *flat)
    distinct = own.groupBy("h1", "h2").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.min_by("pos", "key").alias("pos"), *[F.first(f"b{i}").alias(f"b{i}") for i in range(bands)])
    distinct = scratch.write("paragraphs", distinct.select("h1", "h2", "least", "most", "pos", F.array(*[f"b{i}" for i in range(bands)]).alias("bands")))
    # runs: a variant that another row has is met as it stands; of anchors with several variants the first row of each is compared run by run
    variants = parts.groupBy(F.col("h2").alias("variant")).agg(F.first("h1").alias("h"), F.min("key").alias("least"), F.max("key").alias("most"), F.min_by(packed_span(F.col("first"), F.col("end")), "key").alias("pos"))
    variants = scratch.write("variants", variants)
    apart = variants.groupBy("h").agg(F.min("least").alias("a"), F.max("most").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b and n > 1").select("h")
    apart = scratch.write("anchors-apart", variants.join(apart, "h", "left_semi").select(F.lit(1).alias("kind"), "least", "pos", F.lit(0).cast("long").alias("h1")))
    again = scratch.write("variants-again", variants.where("least < most").select(F.col("variant").alias("h2"), F.col("least").alias("first_key")))
    scratch.drop("variants")

    near = NearSets(scratch, distinct.where("bands[0] is not null"), similar)
    got = scratch.write("fetched", _fetched(rows, near.wanted.unionByName(apart)), by="kind")
    sets = scratch.write("shingle-sets", got.where("kind = 0").dropDuplicates(["h1"]).select("h1", "shingles", "marks"))
    roots = near.components(sets).withColumnRenamed("node", "h1")
    plain = distinct.select("h1", "h2", "least", "most")
    placed = scratch.write("near-paragraphs", plain.join(roots, "h1").select("h1", "h2", "root", "least", "most"))
    classes = scratch.write("near-classes", placed.groupBy("root").agg(F.min("least").alias("class_least"), F.max("most").alias("class_most")).where("class_least < class_most"))
    together = scratch.write("near-firsts", placed.join(classes, "root").select("h1", "h2", F.col("class_least").alias("first_key")))
    exact = plain.where("least < most").join(together, ["h1", "h2"], "left_anti").select("h1", "h2", F.col("least").alias("first_key"))
    firsts = scratch.write("paragraph-firsts", together.unionByName(exact))

    runs = got.where("kind = 1").select(F.col("h1").alias("run"), "key", "first")
    common = scratch.write("runs-common", runs.groupBy("run").agg(F.min("key").alias("first_key"), F.max("key").alias("most")).where("first_key < most").select("run", "first_key"))
    spans = whole.select("key", "first", "end", "h1", "h2").join(firsts, ["h1", "h2"]).select("key", "first_key", "first", "end")
    spans = spans.unionByName(parts.select("key", "first", "end", "h2").join(again, "h2").select("key", "first_key", "first", "end"))
    spans = spans.unionByName(runs.join(common, "run").select("key", "first_key", "first", (F.col("first") + ANCHOR).alias("end")))
    found = spans.repartition("key").sortWithinPartitions("key", "first_key", "first").mapInArrow(_unite, "key long, first_key long, first_word long, n_words long")
    found = scratch.write("passages", found)
    scratch.drop(*[x for x in scratch.paths if x != "passages"])
    return found


def repeated_passages(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per repeated passage of a document: ``doc_id, first_doc_id, first_word, n_words, removed``.

    Two kinds, united where they overlap and share ``first_doc_id``. Paragraphs (lines that are not
    blank) that are equal or whose sets of 5-word shingles are similar (exact Jaccard, components of
    such links; under five words only equality counts);
    and exact runs of words within any text: of each neighbourhood one run of ANCHOR words is chosen by
    its hash, so that every common run of 49 words or more is met; about a met one all runs of ANCHOR
    words are compared, and those that several documents have are the passage, to the word. (Where the
    whole neighbourhood is the same in several documents, one comparison of it stands for all.) Words
    are split at white space and compared in lower case; numbers count from 0.

    ``first_doc_id`` is the document that has the passage first; it has a row, too, and in every other
    ``removed`` is true. What repeats in one document only is no repetition; documents without any have
    no row. Every row of docs is a document of its own: rows with a null doc_id, and those of different
    texts under one doc_id, come after all others, in an order by hash (see ``_shared.keyed``); rows that
    repeat doc_id and text count as one document. Null and empty texts have no passages; an empty table
    gives no rows; other columns are not read.
    """
    rows = keyed(docs)
    scratch = Scratch(docs.sparkSession)
    found = _spans(scratch, rows.select("key", "text"), similar)
    removed = (F.col("key") > F.col("first_key")).alias("removed")
    if found.where((F.col("key") >= UNNAMED) | (F.col("first_key") >= UNNAMED)).isEmpty():
        return found.select(F.col("key").alias("doc_id"), F.col("first_key").alias("first_doc_id"), "first_word", "n_words", removed)
    names = scratch.write("names", rows.where(F.col("key") >= UNNAMED).select("key", F.col("row.doc_id").cast("long").alias("doc_id")).distinct())
    name = lambda c, out: F.when(F.col(c) < UNNAMED, F.col(c)).otherwise(F.col(f"{out}_named")).alias(out)
    for c, out in (("key", "doc_id"), ("first_key", "first_doc_id")):
        found = found.join(names.select(F.col("key").alias(f"{out}_of"), F.col("doc_id").alias(f"{out}_named")), F.col(c) == F.col(f"{out}_of"), "left")
    return found.select(name("key", "doc_id"), name("first_key", "first_doc_id"), "first_word", "n_words", removed)


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping or touching spans of one document and first document as one; rows in order of these and of the starts."""
    last = np.empty((0, 4), np.int64)  # the span that a next batch may prolong

    def rows(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (x[:, 0], x[:, 1], x[:, 2], x[:, 3] - x[:, 2])], ["key", "first_key", "first_word", "n_words"])

    for b in batches:
        new = np.stack([b[c].to_numpy().astype(np.int64) for c in ("key", "first_key", "first", "end")], axis=1)
        x = np.concatenate([last, new])
        if not len(x):
            continue
        other = np.r_[True, (x[1:, :2] != x[:-1, :2]).any(axis=1)]
        shift = np.cumsum(other) << 32
        reach = np.maximum.accumulate(x[:, 3] + shift) - shift  # groups lie 2 ** 32 apart
        start = np.flatnonzero(other | np.r_[True, x[1:, 2] > reach[:-1]])
        x = np.stack([x[start, 0], x[start, 1], x[start, 2], reach[np.r_[start[1:], len(x)] - 1]], axis=1)
        last = x[-1:]
        yield rows(x[:-1])
    yield rows(last)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one; spans in order of their starts."""
    out: list[tuple[int, int]] = []
    for a, e in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((a, e))
    return out


def remove_passages(docs: DataFrame, similar: float = SIMILAR, drop_emptied: bool = False) -> DataFrame:
    """All rows and columns of docs; from ``text`` every repeated passage is cut but where it stands first (see ``repeated_passages``).

    Documents without such a passage keep their text to the letter; what is cut takes the white space
    before it along. A text may become empty, and its row goes if ``drop_emptied``; null stays null. No
    name of a column clashes.
    """
    rows = keyed(docs)
    scratch = Scratch(docs.sparkSession)
    found = _spans(scratch, rows.select("key", "text"), similar).where("key > first_key")
    spans = F.array_sort(F.collect_set(F.struct(F.col("first_word").alias("a"), (F.col("first_word") + F.col("n_words")).alias("e")))).alias("spans")
    gone = scratch.write("passages-gone", found.groupBy(F.col("key").alias("of")).agg(spans))
    scratch.drop("passages")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array((None if s is None else without(t.as_py(), [(x["a"], x["e"]) for x in s]) for t, s in ((t, s.as_py()) for t, s in zip(texts, spans))), pa.string())

    joined = rows.select("key", "row").join(gone, F.col("key") == F.col("of"), "left")
    own = F.col("row.text").cast("string")
    # only texts that lose something go to Python, and once: a deterministic function would be put into the filter below again
    met = F.col("spans").isNotNull() & own.isNotNull()
    text = F.when(met, cut.asNondeterministic()(F.when(met, own), F.when(met, F.col("spans")))).otherwise(own)
    joined = joined.withColumn("left", text)
    if drop_emptied:
        joined = joined.where(F.col("spans").isNull() | F.col("left").isNull() | (F.trim("left") != ""))
    return joined.select(*[F.col("left").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (by word number, in order)."""
    ends = [0]
    starts = []
    for m in _WORD.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    out, at = [], 0
    for a, e in united(spans):
        out.append(text[at : ends[a] if a else 0])
        at = ends[min(e, len(starts))] if e else 0
    out.append(text[at:])
    return "".join(out)
