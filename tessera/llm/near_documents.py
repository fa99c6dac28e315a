"""Near copies of whole documents: wide SimHashes of 5-word shingles for candidates, exact Jaccard for links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Scratch, components, keyed
from tessera.llm.substring_dedup import SHINGLE, SIMILAR, _fetched, _hashes, _marks, _mix, _shingles, _similar, packed_span

#: Sets of fewer shingles are short: their counts are small numbers, which tell less of which bits may differ.
SHORT = 24
#: Segments of the SimHash and their bits, for short sets.
SEGMENTS, WIDTH = 28, 24
#: And for others: so wide that few documents share one by chance (a pair of them with probability 2.3e-5, counting all probes).
WIDE_SEGMENTS, WIDE = 24, 32
#: Bits of a segment, those nearest to a tie, that are probed both ways, and most bits of 64 in which candidates differ: (of short sets, of others).
FLIPS, DISTANCE = (5, 6), (24, 21)
#: Words of 64 bits that hold the segments and 64 further bits, the fingerprint that candidates are compared by.
WORDS = -(-(max(SEGMENTS * WIDTH, WIDE_SEGMENTS * WIDE) + 64) // 64)
#: Documents whose values of a segment are met in one group, and probes of a group that are sorted at once.
DEALT, SORTED = 1 << 15, 1 << 21
#: Buckets of more documents are large: in the first round each is compared with two others there only.
LARGE = 16
#: Most bits in which candidates differ over all segments: (of short sets, of others). At similarity 0.8 at most 19 % and 16 % do; this is four deviations more.
WHOLE = (168, 162)
#: Segments by which nodes of different components find their closest.
FEW = 8
_STEPS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
_OFFSETS = np.arange(8 * WORDS) * 256
_SET = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def balances(shingles: np.ndarray) -> np.ndarray:
    """For each bit of the wide SimHash the shingles (hashes) that set it, less those that don't; the bit is one where that is positive."""
    counts = np.zeros(len(_OFFSETS) * 256, np.int64)
    for at in range(0, len(shingles), 1 << 12):
        wide = _mix(_mix(shingles[at : at + (1 << 12), None].view(np.uint64) + _STEPS))
        counts += np.bincount((np.ascontiguousarray(wide).view(np.uint8).reshape(len(wide), -1) + _OFFSETS).ravel(), minlength=len(counts))
    return 2 * (counts.reshape(-1, 256) @ _SET).ravel() - len(shingles)


def segments(balance: np.ndarray, count: int = SEGMENTS, width: int = WIDTH, flips: int = FLIPS[0]) -> np.ndarray:
    """Each segment's bits in the low bits of a long, and above them, 5 bits each, the places of those nearest to a tie."""
    own = balance[: count * width].reshape(count, width)
    weakest = np.argsort(np.abs(own), axis=1, kind="stable")[:, :flips]
    return (own > 0) @ (1 << np.arange(width)) + (weakest << (width + 5 * np.arange(flips))).sum(axis=1)


def _prints(docs: DataFrame, similar: float) -> DataFrame:
    """Per row (key, text) its key, number of words and two hashes of them; where it has a shingle, their number, 64 bits, the segments and a map of the shingles.

    Short sets have narrow segments, others wide ones; short sets that may be similar to others have both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            two, narrow, wide, marks, sizes, n, fps = [], [], [], [], [], [], []
            for text in (x.as_py() for x in b["text"]):
                words = (text or "").lower().split()
                sizes.append(len(words))
                two.append(xxhash.xxh128_intdigest(" ".join(words)))
                sh = np.unique(_shingles(_hashes(words))) if len(words) >= SHINGLE else ()
                n.append(len(sh))
                balance = balances(sh) if n[-1] else np.zeros(64 * WORDS)
                fps.append(int(np.packbits(balance[-64:] > 0).view(np.int64)[0]))
                marks.append(_marks(sh).tobytes() if n[-1] else None)
                narrow.append(segments(balance) if 0 < n[-1] < SHORT else None)
                wide.append(segments(balance, WIDE_SEGMENTS, WIDE, FLIPS[1]) if n[-1] and n[-1] >= similar * SHORT - 1e-9 else None)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            h1, h2 = signed([t & (2**64 - 1) for t in two]), signed([t >> 64 for t in two])
            columns = [b["key"], pa.array(sizes, pa.int32()), h1, h2, pa.array(n, pa.int32()), pa.array(fps, pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in (narrow, wide)], pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "size", "h1", "h2", "n", "fp", "narrow", "wide", "marks"])

    return docs.select("key", "text").mapInArrow(run, "key long, size int, h1 long, h2 long, n int, fp long, narrow array<long>, wide array<long>, marks binary")


def _dealt(nodes: DataFrame, lead: int, rooted: bool = False, few: int = 64) -> DataFrame:
    """(part, held, h1, fp, n): every segment of every node, under its number and its ``lead`` highest bits (part).

    Where bits nearest to a tie are among the highest, there is a row for each choice of these; held is the
    value, and above 32 bits those of the lower bits that are probed both ways. rooted: with root and marks,
    columns of nodes, and whole, the bits of all segments. few: only so many segments.
    """
    others = ("h1", "fp", "n", *(["root", "marks"] if rooted else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for column, first, size, width, flips in (("narrow", 0, SEGMENTS, WIDTH, FLIPS[0]), ("wide", SEGMENTS, WIDE_SEGMENTS, WIDE, FLIPS[1])):
                there = np.flatnonzero(b[column].is_valid().to_numpy(zero_copy_only=False))
                x = b[column].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                row, at = np.repeat(there, size), np.tile(np.arange(size), len(there))
                every = x
                row, at, x = (y[at < few] for y in (row, at, x))
                value, one = x & np.uint64((1 << width) - 1), np.uint64(1)
                weak = [one << (x >> np.uint64(width + 5 * j) & np.uint64(31)) for j in range(flips)]
                low = np.uint64((1 << width - lead) - 1)
                lower = sum((w & low for w in weak), np.zeros(len(x), np.uint64))
                which = np.arange(len(x))
                for w in weak:
                    turned = np.flatnonzero(w[which] > low)
                    value = np.concatenate([value, value[turned] ^ w[which[turned]]])
                    which = np.concatenate([which, which[turned]])
                part = (first + at[which] << lead) + (value >> np.uint64(width - lead)).astype(np.int64)
                held = (value | lower[which] << np.uint64(32)).view(np.int64)
                taken = pa.array(row[which])
                columns = [pa.array(part.astype(np.int32)), pa.array(held), *[b[c].take(taken) for c in others]]
                if rooted:
                    whole = (every & np.uint64((1 << width) - 1)).astype(np.uint32).reshape(-1, size)
                    columns.append(pa.array([w.tobytes() for w in whole], pa.binary()).take(pa.array(which // min(few, size))))
                yield pa.RecordBatch.from_arrays(columns, ["part", "held", *others, *(["whole"] if rooted else [])])

    types = dict(nodes.dtypes)
    some = nodes.where("narrow is not null or wide is not null").select("narrow", "wide", *others)
    return some.mapInArrow(run, ", ".join(["part int", "held long", *[f"{c} {types[c]}" for c in others], *(["whole binary"] if rooted else [])]))


def _runs(held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All probes of a group's rows: (rows, starts of the buckets, their sizes), rows in order within a bucket; some buckets at a time."""
    value, left = held.view(np.uint64) & np.uint64(2**32 - 1), held.view(np.uint64) >> np.uint64(32)
    weak, row = [], np.arange(len(held), dtype=np.uint64)
    while left.any():
        weak.append(left & (~left + np.uint64(1)))
        left = left ^ weak[-1]
    turns = -(-(len(held) << len(weak)) // SORTED)
    for turn in range(turns):
        found = []
        for s in range(1 << len(weak)):
            own = [w for j, w in enumerate(weak) if s >> j & 1]
            there = np.flatnonzero(np.logical_and.reduce([w > 0 for w in own])) if own else np.arange(len(held))
            key = value[there]
            for w in own:
                key = key ^ w[there]
            mine = _mix(key) % np.uint64(turns) == turn if turns > 1 else slice(None)
            found.append(key[mine] << np.uint64(32) | row[there][mine])
        every = np.sort(np.concatenate(found))
        key = every >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(key)])
        several = sizes > 1
        keep = np.repeat(several, sizes)
        sizes = sizes[several]
        yield (every[keep] & np.uint64(2**32 - 1)).astype(np.int64), np.cumsum(sizes) - sizes, sizes


def _near(a: np.ndarray, b: np.ndarray, fp: np.ndarray, n: np.ndarray, similar: float) -> np.ndarray:
    """The different pairs of rows, a * 2^32 + b, whose fingerprints and numbers of shingles allow the similarity."""
    least, most = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    near = (least >= similar * most - 1e-9) & (np.bitwise_count(fp[a] ^ fp[b]) <= np.where(least < SHORT, *DISTANCE))
    return np.unique(a[near] << 32 | b[near])


def _candidates(dealt: DataFrame, similar: float) -> DataFrame:
    """(node, before, bits, lone, several), by part: nodes of pairs that may be similar, the closest before each, its only partner or whether there are more.

    Pairs are those of buckets of up to LARGE nodes; in larger ones a node is compared with the least and with
    the one before, and may have more.
    """

    def run(t: pa.Table) -> pa.Table:
        held, h1, fp, n = (t[c].to_numpy() for c in ("held", "h1", "fp", "n"))
        order = np.argsort(h1)
        held, h1, fp, n = held[order], h1[order], fp[order].view(np.uint64), n[order]
        several, found = np.zeros(len(h1), bool), np.empty(0, np.int64)
        for row, starts, sizes in _runs(held):
            size = np.repeat(sizes, sizes)
            place = np.arange(len(row)) - np.repeat(starts, sizes)
            several[row[size > LARGE]] = True
            at = np.flatnonzero((size > LARGE) & (place > 0))
            met = [found, _near(row[at - 1], row[at], fp, n, similar), _near(row[at - place[at]], row[at], fp, n, similar)]
            for d in range(1, LARGE):
                at = np.flatnonzero((size <= LARGE) & (place >= d))
                if not len(at):
                    break
                met.append(_near(row[at - d], row[at], fp, n, similar))
            found = np.unique(np.concatenate(met))
        u, v = found >> 32, found & (2**32 - 1)
        bits = np.bitwise_count(fp[u] ^ fp[v]).astype(np.int32)
        order = np.lexsort((u, bits, v))
        u, v, bits = u[order], v[order], bits[order]
        first = np.r_[True, v[1:] != v[:-1]][: len(v)]
        before, lone, least = np.full(len(h1), -1), np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int32)
        before[v[first]], least[v[first]], lone[u], lone[v] = u[first], bits[first], v, u
        degree = np.bincount(u, minlength=len(h1)) + np.bincount(v, minlength=len(h1))
        several |= degree > 1
        some = np.flatnonzero(several | (degree > 0))
        named = lambda x, there: pa.array(h1[x[some]], pa.int64(), mask=~there[some])
        return pa.table({"node": h1[some], "before": named(before, before >= 0), "bits": least[some], "lone": named(lone, ~several), "several": several[some]})

    return dealt.groupBy("part").applyInArrow(run, "node long, before long, bits int, lone long, several boolean")


def _across(dealt: DataFrame, lead: int, similar: float, closest: bool) -> DataFrame:
    """(u, v, bits), by part: the pairs of buckets that may be similar and have different roots, or for each node u the closest v.

    Pairs are compared by all bits of the segments too, and by the maps of the shingles, which rule out no similar pair.
    """

    def run(t: pa.Table) -> pa.Table:
        held, h1, fp, n, root = (t[c].to_numpy() for c in ("held", "h1", "fp", "n", "root"))
        whole, marks = (np.frombuffer(b"".join(t[c].to_pylist()), np.uint64).reshape(len(h1), -1) for c in ("whole", "marks"))
        order = np.argsort(root)
        held, h1, fp, n, root, whole, marks = held[order], h1[order], fp[order].view(np.uint64), n[order], root[order], whole[order], marks[order]
        most = WHOLE[0] if t["part"][0].as_py() >> lead < SEGMENTS else WHOLE[1]
        found, bits = np.empty(0, np.int64), np.empty(0, np.int32)
        for row, starts, sizes in _runs(held):
            bucket, place = np.repeat(starts, sizes), np.arange(len(row))
            opens = (place == bucket) | np.r_[True, root[row[1:]] != root[row[:-1]]][: len(row)]
            before = np.maximum.accumulate(np.where(opens, place, 0)) - bucket  # nodes of its bucket with smaller roots
            ends = np.cumsum(before)
            at = 0
            while at < len(row):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SORTED, "right")))
                many = before[at:to]
                second = np.repeat(place[at:to], many)
                first = bucket[second] + np.arange(len(second)) - np.repeat(np.cumsum(many) - many, many)
                met = np.setdiff1d(_near(row[first], row[second], fp, n, similar), found, assume_unique=True)
                a, b = met >> 32, met & (2**32 - 1)
                apart, alone_a, alone_b = (np.zeros(len(met), np.int32) for _ in range(3))
                for w in whole.T:
                    apart += np.bitwise_count(w[a] ^ w[b])
                for w in marks.T:
                    alone_a += np.bitwise_count(w[a] & ~w[b])
                    alone_b += np.bitwise_count(w[b] & ~w[a])
                need = (n[a] + n[b]) * (similar / (1 + similar)) - 1e-6
                near = (apart <= most) & (n[a] - alone_a >= need) & (n[b] - alone_b >= need)
                found, bits = np.r_[found, met[near]], np.r_[bits, apart[near]]
                at = to
        u, v = found >> 32, found & (2**32 - 1)
        if closest:
            u, v, bits = np.r_[u, v], np.r_[v, u], np.r_[bits, bits]
            order = np.lexsort((h1[v], bits, u))
            u, v, bits = u[order], v[order], bits[order]
            first = np.r_[True, u[1:] != u[:-1]][: len(u)]
            return pa.table({"u": h1[u[first]], "v": h1[v[first]], "bits": bits[first]})
        return pa.table({"u": np.minimum(h1[u], h1[v]), "v": np.maximum(h1[u], h1[v]), "bits": bits})

    return dealt.groupBy("part").applyInArrow(run, "u long, v long, bits int")


def _roots(scratch: Scratch, rows: DataFrame, nodes: DataFrame, similar: float) -> DataFrame:
    """(node, root), both ``h1``: components of the nodes that are linked.

    Nodes that share a probe form a bucket. They meet by parts of the segments' values, where the probes
    are made, so that these are not shuffled, and pairs leave a part only if their fingerprints are
    close. In a first round a node is compared with the closest one before it only, in a second, if it has
    further pairs, with the closest of another component. What these links leave apart is then compared
    pair by pair across components. So a group of near copies costs some rows a member instead of all its pairs.
    """
    lead = min(16, max(2, (nodes.count() // DEALT).bit_length()))
    closest = F.min(F.when(F.col("before").isNotNull(), F.struct("bits", "before")))["before"].alias("before")
    found = _candidates(_dealt(nodes, lead), similar).groupBy("node").agg(closest, F.min("lone").alias("lone"), F.max("lone").alias("other"), F.max("several").alias("several"))
    found = scratch.write("candidates", found)
    pairs = scratch.write("near-pairs", found.where("before is not null").select(F.col("before").alias("u"), F.col("node").alias("v")))

    def linked(pairs: DataFrame, label: str) -> DataFrame:
        ends = pairs.select(F.explode(F.array("u", "v")).alias("h1")).distinct()
        wanted = nodes.join(ends, "h1", "left_semi").select(F.lit(0).alias("kind"), "least", packed_span(F.lit(0), F.col("size")).alias("pos"), "h1")
        wanted = scratch.write(f"{label}-wanted", wanted)
        sets = scratch.write(f"{label}-sets", _fetched(rows, wanted).dropDuplicates(["h1"]).select("h1", "shingles"))
        links = scratch.write(f"{label}-links", _similar(pairs, sets, similar))
        scratch.drop(f"{label}-sets", f"{label}-wanted")
        return links

    links = linked(pairs, "first")
    roots = scratch.write("roots", components(links))
    # settled are nodes with one pair, which has been compared
    more = F.col("several") | (F.col("lone") != F.col("other"))
    single = found.where(~more & (F.col("lone") > F.col("node"))).select(F.col("node").alias("u"), F.col("lone").alias("v"))
    others = found.where(more).select(F.col("node").alias("h1")).union(single.join(pairs, ["u", "v"], "left_anti").select("u"))
    others = scratch.write("nodes-again", nodes.join(others, "h1", "left_semi"))
    if others.isEmpty():
        return roots
    for label, few in (("closest", FEW), ("across", SEGMENTS)):
        known = others.join(roots.withColumnRenamed("node", "h1"), "h1", "left").withColumn("root", F.coalesce("root", "h1"))
        across = _across(_dealt(known, lead, rooted=True, few=few), lead, similar, closest=label == "closest")
        if label == "closest":
            across = across.groupBy("u").agg(F.min_by("v", F.struct("bits", "v")).alias("v"))
            across = across.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        across = scratch.write(f"pairs-{label}", across.select("u", "v").distinct().join(pairs, ["u", "v"], "left_anti"))
        more, pairs = linked(across, label), pairs.union(across)
        if not more.isEmpty():
            links = links.union(more)
            roots = scratch.write(f"roots-{label}", components(links))
    return roots


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows that open their group, all columns of docs: one document of each group of near copies stays.

    Two documents are linked if the sets of their 5-word shingles (lower case, split at white space)
    have that Jaccard similarity or more, or if their words are equal; groups are the components of
    such links. Candidates come from SimHash: at similarity 0.8 two of them differ in some 15 % of the
    bits, which no complete search of 64 bits serves. So there are WIDE_SEGMENTS segments of WIDE bits
    (for short sets SEGMENTS of WIDTH), and both sides of a pair probe each with all values of its FLIPS
    bits that are nearest to a tie, as these are the likeliest to differ (for recall at 0.8 see the
    README; more above). Candidates are then compared by 64 further bits, and every link is verified on the
    whole sets. Documents under five words link by equal words only, those without words to each other.

    The row of the smallest doc_id stays; rows with a null doc_id, and those of different texts under
    one doc_id, come after all others, in an order by hash (see ``_shared.keyed``). Of wholly repeated
    (doc_id, text) rows one stays. An empty table gives no rows; no name of a column clashes.
    """
    scratch, rows = Scratch(docs.sparkSession), keyed(docs)
    prints = scratch.write("document-prints", _prints(rows, similar))
    nodes = scratch.write("document-nodes", prints.groupBy("h1", "h2").agg(F.min("key").alias("least"), *[F.first(c).alias(c) for c in ("size", "n", "fp", "narrow", "wide", "marks")]))
    roots = _roots(scratch, rows, nodes, similar).withColumnRenamed("node", "h1")
    placed = nodes.select("h1", "least").join(roots, "h1", "left").select(F.coalesce("root", "h1").alias("root"), "least")
    stays = placed.groupBy("root").agg(F.min("least").alias("stays"))
    by_node = nodes.select("h1", "h2").join(roots, "h1", "left").select("h1", "h2", F.coalesce("root", "h1").alias("root")).join(stays, "root")
    # those that go are few as a rule, so that the texts need no shuffle
    gone = prints.select("key", "h1", "h2").join(by_node, ["h1", "h2"]).where("key <> stays").select(F.col("key").alias("gone")).distinct()
    gone = scratch.write("documents-gone", gone)
    several = scratch.write("repeated-keys", prints.groupBy("key").count().where("count > 1").select("key"))
    scratch.drop(*[x for x in scratch.paths if x not in ("documents-gone", "repeated-keys")])
    kept = rows.select("key", "row").join(gone, F.col("key") == F.col("gone"), "left_anti")
    if not several.isEmpty():
        once = kept.join(several, "key", "left_semi").dropDuplicates(["key"])
        kept = kept.join(several, "key", "left_anti").unionByName(once)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
