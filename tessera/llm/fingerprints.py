"""Document fingerprints: sketches of word shingles whose size follows the document. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shingle length in words, share of all hash values that a sketch keeps (one of so many), and hashes it keeps at least.
WORDS, ONE_OF, LEAST = 5, 16, 64
#: Documents of a window partition, about.
BUCKET = 2_000
#: Buckets up to which their first keys are broadcast (16 bytes each).
OPENED = 200_000

_MOST = (1 << 63) - 1


def with_sketch(df: DataFrame, text: str, name: str, words: int = WORDS, one_of: int = ONE_OF, least: int = LEAST) -> DataFrame:
    """Add ``name``: struct<cutoff long, hashes array<long>>, the sketch of the text column.

    A document's shingles are its runs of ``words`` words (lower case, split at white space); with
    fewer words the whole sequence is one; with none there are none. The sketch keeps every distinct
    shingle hash below a fixed share of the hash range, 1 / ``one_of``, and never fewer than the
    ``least`` smallest (all, if there are fewer). ``cutoff`` says up to where it is complete, so
    sketches of very unequal documents compare and merge (see ``merge``) without the texts.
    """
    threshold = -(1 << 63) + (1 << 64) // one_of
    tmp = f"_{name}"
    spelled = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")
    df = df.withColumn(tmp, F.transform(spelled, lambda w: F.xxhash64(w)))
    run = F.transform(
        F.sequence(F.lit(0), F.size(tmp) - words),
        lambda i: F.xxhash64(*[F.get(F.col(tmp), i + k) for k in range(words)]),
    )
    whole = F.when(F.size(tmp) > 0, F.array(F.xxhash64(F.col(tmp)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(tmp, F.when(F.size(tmp) >= words, run).otherwise(whole))
    df = df.withColumn(tmp, F.sort_array(F.array_distinct(tmp)))
    below = F.size(F.filter(F.col(tmp), lambda h: h < threshold))
    df = df.withColumn(f"{tmp}_n", F.greatest(below, F.lit(least)))
    kept = F.slice(F.col(tmp), F.lit(1), F.col(f"{tmp}_n"))
    cutoff = F.when(F.size(tmp) <= F.col(f"{tmp}_n"), F.lit(_MOST)).otherwise(F.greatest(F.lit(threshold - 1), F.get(F.col(tmp), F.col(f"{tmp}_n") - 1)))
    return df.withColumn(name, F.struct(cutoff.alias("cutoff"), kept.alias("hashes"))).drop(tmp, f"{tmp}_n")


def written(sketch: str) -> Column:
    """The sketch as text: cutoff, colon, hashes in order, each as 16 hexadecimal digits."""
    digits = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    return F.concat(digits(F.col(f"{sketch}.cutoff")), F.lit(":"), F.array_join(F.transform(F.col(f"{sketch}.hashes"), digits), ""))


def _common(a: str, b: str) -> tuple[Column, Column, Column]:
    """Hashes in both, in a, in b, of those up to the lower cutoff: there both sketches are complete."""
    upto = F.least(F.col(f"{a}.cutoff"), F.col(f"{b}.cutoff"))
    both = F.size(F.filter(F.array_intersect(f"{a}.hashes", f"{b}.hashes"), lambda h: h <= upto))
    return both, F.size(F.filter(F.col(f"{a}.hashes"), lambda h: h <= upto)), F.size(F.filter(F.col(f"{b}.hashes"), lambda h: h <= upto))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1; two documents without words are alike, one without is unlike any other."""
    both, in_a, in_b = _common(a, b)
    return F.when(in_a + in_b == 0, F.lit(1.0)).otherwise(both / (in_a + in_b - both))


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an a without words."""
    both, in_a, _ = _common(a, b)
    return F.when(in_a == 0, F.lit(1.0)).otherwise(both / in_a)


def merge(a: str, b: str) -> Column:
    """The sketch of the shingles of both: the union up to the lower cutoff."""
    upto = F.least(F.col(f"{a}.cutoff"), F.col(f"{b}.cutoff"))
    return F.struct(upto.alias("cutoff"), F.sort_array(F.filter(F.array_union(f"{a}.hashes", f"{b}.hashes"), lambda h: h <= upto)).alias("hashes"))


def _buckets(df: DataFrame, key: str, tie: str, size: int) -> tuple[DataFrame, int]:
    """(df with ``_bucket``, rows): ranges of about ``size`` rows, in descending order those of ``with_next``.

    Ranges of equal width serve where ids are dense. One that holds over four times as many rows is cut
    again between its own least and largest key, up to three times, so that ids far off the others do no harm.
    Rows without a key are dealt by ranges of the hash ``tie``, below all others.
    """
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.count(key).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    lo, hi, unnamed = found["lo"] or 0, found["hi"] or 0, found["rows"] - found["n"]
    width = max(1, (hi - lo + 1) * size // max(1, found["n"]))
    away = lambda least: F.col(key) - least if hi - lo < 1 << 63 else F.col(key).cast("decimal(20,0)") - least
    df = df.withColumn("_bucket", F.call_function("shiftleft", F.floor(away(F.lit(lo)) / width).cast("long"), F.lit(33)))
    for shift in (22, 11, 0):
        crowded = df.where("_bucket is not null").groupBy(F.col("_bucket").alias("_crowded")).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_low"), F.max(key).alias("_high"))
        crowded = crowded.where(f"_n > {4 * size} and _high > _low")
        if crowded.isEmpty():
            break
        if found["rows"] // size < OPENED:
            crowded = F.broadcast(crowded)
        df = df.join(crowded, F.col("_bucket") == F.col("_crowded"), "left")
        parts = F.least(F.ceil(F.col("_n") / size), F.lit(1 << 11))
        part = F.floor(away(F.col("_low")).cast("double") / (F.col("_high").cast("double") - F.col("_low") + 1) * parts)
        part = F.coalesce(F.least(part, parts - 1).cast("long"), F.lit(0).cast("long"))
        df = df.withColumn("_bucket", F.col("_bucket") + F.call_function("shiftleft", part, F.lit(shift))).drop("_crowded", "_n", "_low", "_high")
    below = F.floor((F.col(tie).cast("double") / 2.0**64 + 0.5) * -(-unnamed // size)).cast("long")
    return df.withColumn("_bucket", F.coalesce("_bucket", -1 - below)), found["rows"]


def with_next(df: DataFrame, columns: list[str], key: str = "doc_id", tie: str = "_tie", add: Callable[[DataFrame], DataFrame] = lambda df: df, size: int = BUCKET) -> DataFrame:
    """Add ``next_<column>`` for each of columns: the value in the next row by descending key (nulls last, then by tie, a hash); after the last row, the first's.

    Rows are dealt by ranges of the key into buckets of about ``size`` rows (``_buckets``), so that one
    shuffle serves: each bucket gets, besides its own rows, a copy of the row that opens the next
    bucket. Only the buckets' first rows (one of some 2,000) are looked up beforehand. ``add`` puts in
    columns before the shuffle, so that no row has them computed twice. Rows that repeat a key lie in
    one bucket, sorted on disk if need be.
    """
    df, n = _buckets(df, key, tie, size)
    place = F.struct(F.col(key).isNull().alias("unnamed"), F.bitwise_not(key).alias("key"), F.col(tie).alias("tie"))
    tops = df.groupBy("_bucket").agg(F.min(place).alias("_first")).withColumn("_area", F.shiftright("_bucket", 43))
    # of every bucket the next higher one that has rows, or the lowest for the highest: two levels
    higher = Window.partitionBy("_area").orderBy("_bucket")
    areas = tops.groupBy("_area").agg(F.min("_bucket").alias("_low"))
    first = Window.orderBy("_area").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    areas = areas.select("_area", F.coalesce(F.lead("_low").over(Window.orderBy("_area")), F.min("_low").over(first)).alias("_above"))
    opened = tops.withColumn("_to", F.lead("_bucket").over(higher)).join(areas, "_area")
    opened = opened.select(F.coalesce("_to", "_above").alias("_to"), F.bitwise_not("_first.key").alias("_top"), F.col("_first.tie").alias("_top_tie"))
    if n // size < OPENED:  # so many rows at most, but for a few: small enough to spare the table a shuffle
        opened = F.broadcast(opened)
    guests = df.join(opened, df[key].eqNullSafe(opened["_top"]) & (df[tie] == opened["_top_tie"]))
    guests = guests.drop("_bucket", "_top", "_top_tie").withColumnRenamed("_to", "_bucket").dropDuplicates(["_bucket"]).withColumn("_guest", F.lit(1))
    rows = add(df.withColumn("_guest", F.lit(0)).unionByName(guests))
    order = Window.partitionBy("_bucket").orderBy("_guest", F.desc_nulls_last(key), tie)
    for c in columns:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))
    return rows.where("_guest = 0").drop("_guest", "_bucket")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, and that of its text with the last half replaced.

    The last floor(n_chars / 2) code points give way to the first as many (or all) of the next document
    by descending doc_id (after the last the first; a lone document follows itself; rows that repeat a
    doc_id follow one another by the digest of their texts; null ids come last). Columns: ``doc_id``,
    ``n_chars`` (code points; null text counts as empty), ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next`` (``likeness`` to the edited text and to the
    next document), ``held_by_edited`` and ``held_by_next`` (``containment`` in them). Equal texts have
    equal fingerprints. An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("_tie", F.xxhash64("text"))
    rows = with_next(rows, ["text", "sketch"], add=lambda df: with_sketch(df, "text", "sketch")).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = with_sketch(rows.drop("text", "next_text"), "edited", "edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written("sketch").alias("fingerprint"), written("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"),
        containment("sketch", "edited_sketch").alias("held_by_edited"), containment("sketch", "next_sketch").alias("held_by_next"),
    )
