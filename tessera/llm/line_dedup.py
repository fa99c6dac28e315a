"""Line dedup by a segment-partition edit join. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Scratch, keyed, may_be_among

#: Edit distance up to which a line repeats another, and code points that a line needs for that.
DISTANCE, LEAST_CHARS = 2, 20
#: Characters whose counts tell most pairs of different lines apart before their texts are fetched, twelve to a long.
LETTERS = ("etaoinsrhldu", "cmfwgypbvk .")


def _lines(rows: DataFrame, least_chars: int, least_keyed: int | None = None) -> DataFrame:
    """(key, line_no, line, size, h1, h2) of every line, outer white space cut, with at least ``least_chars`` code points. rows: (key, text).

    least_keyed: with ``wide``, the line in four bytes a code point, so that each is reached at once, and
    ``span``, its size; no bytes and zero where it has fewer code points than that.
    """
    others = ["\t", "\r", "\f", "\u000b"]

    def cut(x: Column) -> Column:  # blanks go fast, the other white space only where there is any
        left = reduce(or_, [F.startswith(x, F.lit(c)) | F.endswith(x, F.lit(c)) for c in others])
        return F.when(left, F.trim(x, F.lit(" \t\r\f\u000b"))).otherwise(x)

    trimmed = F.transform(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), cut)
    # line and size come out of the generator as they are; as expressions they would be worked out anew for every use

    def wide(x: Column) -> list[Column]:
        if least_keyed is None:
            return []
        enough = F.length(x) >= least_keyed
        return [F.when(enough, F.encode(x, "UTF-32")).alias("wide"), F.when(enough, F.length(x)).otherwise(0).alias("span")]

    each = rows.select("key", F.posexplode(F.transform(trimmed, lambda x: F.struct(x.alias("line"), F.length(x).alias("size"), *wide(x)))).alias("line_no", "e"))
    sized = each.select("key", "line_no", "e.*").where(F.col("size") >= least_chars)
    return sized.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


def _place() -> Column:
    """Where a line stands, as one number: by key of the row, then by line number."""
    return F.col("key").cast("decimal(19,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("line_no")


def _segment(size: int, i: int, parts: int) -> tuple[int, int]:
    """Start (from 0) and length of segment i of a line of that size: ``parts`` even segments, the longer ones last."""
    short, extra = divmod(size, parts)
    return i * short + max(0, i - (parts - extra)), short + (i >= parts - extra)


def _spots(residue: int, distance: int) -> list[tuple[int, int, int]]:
    """(segment, start, length) of all substrings that stand for a line of size n * (distance + 1) + residue, for n = 0.

    Each start grows by the segment's number and each length by one, if n does. If two lines are within
    the distance, one of distance + 1 segments of the shorter one stands unchanged in the longer one.
    Segment i can have moved by at most i (edits before it, counted from the left) and, from the right,
    by the difference in length and the edits after it: both bounds leave about distance^2 / 2 places
    for each length. A line has the segments of its own size and, at all these places, those that lines
    of up to ``distance`` fewer code points may have in common with it; most are the same substring.
    """
    parts = distance + 1
    found = set()
    for shorter in range(distance + 1):
        for i in range(parts):
            start, width = _segment(residue - shorter + 9 * parts, i, parts)
            for shift in range(max(-i, shorter - (distance - i)), min(i, shorter + (distance - i)) + 1):
                found.add((i, start + shift - 9 * i, width - 9))
    return sorted(found)


def _keys(size: str, wide: str, distance: int) -> list[Column]:
    """The keys of a line: hashes of segment number and substring (see ``_spots``); null where there is no such place."""
    parts = distance + 1
    n, spots = F.floor(F.col(size) / parts).cast("int"), [_spots(r, distance) for r in range(parts)]
    out = []
    for k in range(n_keys(distance)):
        own = [s[k] if k < len(s) else (-1, -1, 0) for s in spots]
        i, start, width = (F.get(F.array(*[F.lit(x) for x in values]), F.col(size) % parts) for values in zip(*own, strict=True))
        at, long = n * i + start, n + width
        inside = (i >= 0) & (at >= 0) & (long > 0) & (at + long <= F.col(size))
        out.append(F.when(inside, F.xxhash64(F.substring(F.col(wide), 4 * at + 1, 4 * long), i)))
    return out


def n_keys(distance: int) -> int:
    return max(len(_spots(r, distance)) for r in range(distance + 1))


def banded_distance(a: Column, b: Column, distance: int) -> Column:
    """Edit distance of two strings if it is at most ``distance``, else distance + 1.

    Bit-parallel within the band of 2 * distance + 1 diagonals: bit k of level e says that the first
    j - distance + k code points of a and the first j of b are within e edits. One step of j works on a
    whole level at once: keep where the code points agree; from the level below, substitute in place,
    insert from the next bit, delete from the previous bit of the same step. All levels share one long.
    """
    width = 2 * distance + 1
    if (distance + 1) * width > 63:
        raise ValueError("the levels of this distance do not fit a long")
    mask = (1 << width) - 1
    # four bytes a code point, so that each is reached at once however long the line is
    wide_a, wide_b = F.encode(a, "UTF-32"), F.encode(b, "UTF-32")
    size_a, size_b = F.length(a), F.length(b)
    start = 0
    for e in range(distance + 1):
        start |= sum(1 << (distance + d) for d in range(e + 1)) << (e * width)

    def step(levels: Column, j: Column) -> Column:
        mine = F.substring(wide_b, 4 * j - 3, F.lit(4))
        same = F.lit(0).cast("long")
        for k in range(width):
            i = j + (k - distance)
            agree = (i >= 1) & (F.substring(wide_a, 4 * i - 3, F.lit(4)) == mine)
            same = same.bitwiseOR(F.when(agree, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.struct(levels.alias("old"), same.alias("same"))

    def advance(levels: Column, j: Column) -> Column:
        # the agreement mask is used by every level: bind it once by a one-element transform
        def levelled(x: Column) -> Column:
            old, same = x["old"], x["same"]
            new, below, below_old = F.lit(0).cast("long"), None, None
            for e in range(distance + 1):
                was = F.shiftrightunsigned(old, e * width).bitwiseAND(F.lit(mask).cast("long"))
                now = was.bitwiseAND(same)
                if below is not None:
                    now = now.bitwiseOR(below_old).bitwiseOR(F.shiftrightunsigned(below_old, 1)).bitwiseOR(F.shiftleft(below, 1)).bitwiseAND(F.lit(mask).cast("long"))
                below, below_old = now, was
                new = new.bitwiseOR(F.shiftleft(now, e * width))
            return new

        # once no level holds anything the distance is exceeded, and the rest of the text is skipped
        return F.when(levels == 0, levels).otherwise(F.get(F.transform(F.array(step(levels, j)), levelled), F.lit(0)))

    steps = F.when(size_b > 0, F.sequence(F.lit(1), size_b)).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(steps, F.lit(start).cast("long"), advance)
    corner = size_a - size_b + distance
    out = F.lit(distance + 1)
    for e in reversed(range(distance + 1)):
        out = F.when(F.getbit(last, (corner + e * width).cast("int")) == 1, F.lit(e)).otherwise(out)
    return F.when(F.abs(size_a - size_b) > distance, F.lit(distance + 1)).otherwise(out)


def letter_counts(line: Column) -> Column:
    """How often each of LETTERS stands in the line, modulo 32, five bits each, in an array of longs."""
    out = []
    for letters in LETTERS:
        one = F.lit(0).cast("long")
        for i, letter in enumerate(letters):
            n = F.length(line) - F.length(F.replace(line, F.lit(letter), F.lit("")))
            one = one.bitwiseOR(F.shiftleft(F.pmod(n, F.lit(32)).cast("long"), 5 * i))
        out.append(one)
    return F.array(*out)


def _letters_apart(a: Column, b: Column) -> Column:
    """A lower bound of by how much the letters' counts differ; an edit changes two of them by one, at most."""
    out = F.lit(0)
    for k, letters in enumerate(LETTERS):
        for i in range(len(letters)):
            five = lambda x: F.shiftrightunsigned(F.get(x, F.lit(k)), 5 * i).bitwiseAND(F.lit(31))  # noqa: B023, E731
            apart = F.abs(five(a) - five(b))
            out = out + F.least(apart, 32 - apart)
    return out


def _common_start(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by steps of halving powers of two."""
    most = F.least(F.length(a), F.length(b))

    def grow(n: Column, step: Column) -> Column:
        fits = (n + step <= most) & (F.substring(a, F.lit(1), n + step) == F.substring(b, F.lit(1), n + step))
        return F.when(fits, n + step).otherwise(n)

    return F.aggregate(F.array(*[F.lit(1 << p) for p in reversed(range(24))]), F.lit(0), grow)


def _without_common_ends(scratch: Scratch, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cut the common prefix and then the common suffix of two string columns; their edit distance stays.

    Each cut is written out, or else the optimizer would inline it into every use of the shorter text.
    """
    for flip in (False, True):
        x, y = (F.reverse(a), F.reverse(b)) if flip else (F.col(a), F.col(b))
        # few bytes, much work: spread by rows, not by size
        pairs = pairs.repartition(2 * pairs.sparkSession.sparkContext.defaultParallelism)
        pairs = scratch.write(f"line-compared-{flip}", pairs.withColumn("_n", _common_start(x, y)))
        start = F.lit(1) if flip else F.col("_n") + 1
        pairs = pairs.withColumn(a, F.substring(F.col(a), start, F.length(a) - F.col("_n"))).withColumn(b, F.substring(F.col(b), start, F.length(b) - F.col("_n"))).drop("_n")
    return pairs.repartition(2 * pairs.sparkSession.sparkContext.defaultParallelism)


def near_members(known: DataFrame, names: list[str]) -> DataFrame:
    """(key, id) of the keys that two lines have. known: distinct lines, ``h1`` and the keys under these names.

    One shuffle by key serves both the search for shared keys and the choice of their rows; nearly all
    keys belong to one line and end here.
    """
    rows = known.select(F.col("h1").alias("id"), F.explode(F.array(*names)).alias("key")).where("key is not null")
    rows = rows.repartition("key")
    shared = rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("key")
    return rows.join(shared.hint("shuffle_hash"), "key", "left_semi").select("key", "id")


def near_pairs(members: DataFrame, letters: DataFrame, distance: int) -> DataFrame:
    """Pairs (u, v), u < v, of ids that share a key and about the size and the letters' counts. letters: (id, size, letters)."""
    full = members.join(letters, "id")
    side = lambda x: full.select("key", F.col("id").alias(x), F.col("size").alias(f"{x}_size"), F.col("letters").alias(f"{x}_letters"))
    met = (F.col("u") < F.col("v")) & (F.abs(F.col("u_size") - F.col("v_size")) <= distance) & (_letters_apart(F.col("u_letters"), F.col("v_letters")) <= 2 * distance)
    return side("u").join(side("v"), "key").where(met).select("u", "v").distinct()


def _repeated(scratch: Scratch, rows: DataFrame, distance: int, least_chars: int, least_exact: int | None) -> DataFrame:
    """(key, line_no, exact) of the lines to remove from rows (key, text); see ``dedup_lines``.

    Equal lines collapse before the join (a partial aggregate by two 64-bit hashes), so a line that a
    third of the documents have costs one row; only the texts of candidates are fetched for the check.
    """
    least = max(1, least_chars if least_exact is None else min(least_exact, least_chars))
    names = [f"key_{i}" for i in range(n_keys(distance))]
    keys = [k.alias(c) for c, k in zip(names, _keys("span", "wide", distance), strict=True)]
    every = scratch.write("lines", _lines(rows, least, least_chars).select("key", "line_no", "h1", "h2", *keys))
    flat = every.select("h1", "h2", _place().alias("place"), *names)
    known = flat.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in names])
    known = scratch.write("lines-known", known)
    members = scratch.write("line-members", near_members(known, names))
    wanted = scratch.write("lines-wanted", members.select("id").distinct())
    places = scratch.write("line-places", known.select("h1", "h2", "place", "n").join(wanted.withColumnRenamed("id", "h1"), "h1", "left_semi"))
    repeats = scratch.write("lines-repeated", known.where("n > 1").select("h1", "h2", "place"))
    scratch.drop("lines-known")

    with_id = _lines(rows, least).select("h1", "h2", "line", "size", F.col("h1").alias("id"))
    texts = may_be_among(with_id, wanted, "id").join(wanted, "id").dropDuplicates(["h1", "h2"]).join(places, ["h1", "h2"])
    texts = scratch.write("line-texts", texts)
    letters = scratch.write("line-letters", texts.select("id", "size", letter_counts(F.col("line")).alias("letters")))
    pairs = scratch.write("line-pairs", near_pairs(members, letters, distance))
    side = lambda x: texts.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("h1", "h2", "line", "place")])
    both = pairs.join(side("u"), "u").join(side("v"), "v").where("u_line <> v_line")
    both = _without_common_ends(scratch, both, "u_line", "v_line")
    close = both.where(banded_distance(F.col("u_line"), F.col("v_line"), distance) <= distance)
    later = close.select(*[F.when(F.col("u_place") > F.col("v_place"), F.col(f"u_{c}")).otherwise(F.col(f"v_{c}")).alias(c) for c in ("h1", "h2", "place")]).distinct()
    near = scratch.write("line-later", later.withColumn("near", F.lit(True)))
    judged = repeats.join(near.select("h1", "h2", "near"), ["h1", "h2"], "left").select("h1", "h2", "place", F.coalesce("near", F.lit(False)).alias("near"))
    judged = judged.unionByName(near.join(repeats, ["h1", "h2"], "left_anti").select("h1", "h2", "place", "near"))
    judged = scratch.write("line-judged", judged.withColumnRenamed("place", "first"))
    found = every.select("key", "line_no", "h1", "h2", _place().alias("place")).join(judged, ["h1", "h2"]).where("near or place > first")
    return found.select("key", "line_no", (F.col("place") > F.col("first")).alias("exact"))


def dedup_lines(docs: DataFrame, distance: int = DISTANCE, least_chars: int = LEAST_CHARS, least_exact: int | None = None, counts: bool = True, drop_emptied: bool = False) -> DataFrame:
    """All rows and columns of docs, ``text`` without its repeated lines, with ``n_lines``, ``n_exact`` and ``n_near`` (lines removed) if ``counts``.

    A line repeats another if it comes later, by (doc_id, line number), and differs in at most
    ``distance`` edits of code points, outer white space aside. Lines of under ``least_chars`` code
    points repeat equal ones only, those of under ``least_exact`` (``least_chars``, if not given) are
    left alone; blank lines always are. Of a chain of near lines all but the first go.

    What stays keeps its order and its line breaks. Null text stays null (no lines); a text may become
    empty, and its row goes if ``drop_emptied``. Every row is a document of its own: rows with a null doc_id, and those of different texts
    under one doc_id, come after all others, in an order by hash (see ``_shared.keyed``); rows that
    repeat doc_id and text count as one document, so neither loses lines to the other. An empty table
    gives no rows. Columns of docs that bear one of the three new names are replaced; no other name clashes.
    """
    rows = keyed(docs)
    scratch = Scratch(docs.sparkSession)
    gone = _repeated(scratch, rows.select("key", "text"), distance, least_chars, least_exact).distinct().groupBy("key").agg(
        F.collect_set("line_no").alias("gone"), F.count(F.when(F.col("exact"), 1)).alias("exact")
    )
    gone = scratch.write("lines-gone", gone.withColumnRenamed("key", "of"))
    scratch.drop(*[x for x in scratch.paths if x != "lines-gone"])
    joined = rows.select("key", "row").join(gone.hint("shuffle_hash"), F.col("key") == F.col("of"), "left")
    # a column of its own, or else the text would be split again for every line
    joined = joined.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split(F.col("row.text").cast("string"), "\n")))
    stays = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get(F.col("lines"), i))
    text = F.when(F.col("gone").isNull() | F.col("row.text").isNull(), F.col("row.text")).otherwise(F.array_join(stays, "\n"))
    own = F.col("row.text").cast("string")
    made = {
        "n_lines": F.when(own.isNull(), 0).otherwise(F.length(own) - F.length(F.replace(own, F.lit("\n"), F.lit(""))) + 1),
        "n_exact": F.coalesce(F.col("exact"), F.lit(0)).cast("int"),
        "n_near": F.coalesce(F.size("gone") - F.col("exact"), F.lit(0)).cast("int"),
    }
    made = made if counts else {}
    kept = [c for c in docs.columns if c.lower() not in made]
    joined = joined.withColumn("left", text)
    if drop_emptied:
        joined = joined.where(F.col("gone").isNull() | F.col("left").isNull() | (F.trim("left") != ""))
    return joined.select(*[F.col("left").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in kept], *[v.alias(k) for k, v in made.items()])
