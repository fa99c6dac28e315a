"""What several operators need: shared storage, lineage cuts, keys of rows and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None

#: Spark's setting by which a query's shuffle files go when it has ended, and not when the driver next collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits for each wanted value in a map of them, and values up to which there is such a map (a word of 64 bits is a row of 16 bytes).
BITS_EACH, MAPPED = 8, 8_000_000
#: Keys of rows from here on are hashes; smaller ones are doc_ids.
UNNAMED = 1 << 62


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: a cluster names it in ``spark.checkpoint.dir``.

    Where that is unset and everything runs in one process (``local[n]``), a folder of our own serves
    until the process ends; on a cluster it is an error.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_dir = "file://" + folder
    return _own_dir


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whichever store it lies in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, label: str, by: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` into the shared folder and read it again: (frame, path). by: a column to lay the files out by.

    This cuts the lineage, survives lost executors, and what has several readers is computed once. The
    shuffle files of the query go as soon as the table is there.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    schema = df.schema if by is None else df.select(*[c for c in df.columns if c != by], by).schema
    return spark.read.schema(schema).parquet(path), path


@dataclass
class Scratch:
    """Written tables of one computation, which go when they are no longer needed."""

    spark: SparkSession
    paths: dict[str, str] = field(default_factory=dict)

    def write(self, label: str, df: DataFrame, by: str | None = None) -> DataFrame:
        frame, self.paths[label] = stored(df, label, by)
        return frame

    def drop(self, *labels: str) -> None:
        for label in labels:
            drop_path(self.spark, self.paths.pop(label))


def keyed(docs: DataFrame) -> DataFrame:
    """(key long, text string, row struct of all columns of docs): rows with a key of their own, whatever their doc_id.

    The key is the doc_id where it is one (not null, under 2^62, and all rows that bear it have one
    text). Other rows get 2^62 and the upper 62 bits of a hash of doc_id and text, so that they come
    after all others, and different rows are different documents. Rows that repeat doc_id and text
    share a key. Columns of docs lie in ``row``, so that no name of theirs clashes.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), row.alias("row"))
    digest = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    hashed = F.shiftrightunsigned(digest, 2).bitwiseOR(F.lit(UNNAMED))
    proper = F.col("doc_id") < UNNAMED
    repeated = rows.where(proper).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    repeated, path = stored(repeated, "repeated-ids")
    if not repeated.isEmpty():
        several = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b")
        several, _ = stored(several.select(F.col("doc_id").alias("_several")), "several-texts")
        rows = rows.join(several, F.col("doc_id") == F.col("_several"), "left")
        proper = proper & F.col("_several").isNull()
    drop_path(docs.sparkSession, path)
    return rows.select(F.when(proper, F.col("doc_id")).otherwise(hashed).alias("key"), "text", "row")


def may_be_among(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose value (a long) may be among the wanted ones, in the column of the same name, to spare most others the shuffle.

    A map of BITS_EACH bits a wanted value is built by an aggregate and broadcast as rows of 64 bits;
    with more than MAPPED wanted ones the rows stay as they are and the join that follows does it all.
    That must be an inner one, for the optimizer would move a semi-join below this.
    """
    n = wanted.count()
    if n > MAPPED:
        return rows
    words = max(1, n * BITS_EACH // 64)
    spread = F.xxhash64(F.col(column), F.lit(7))
    word, bit = F.pmod(F.shiftrightunsigned(spread, 6), F.lit(words)), spread.bitwiseAND(F.lit(63).cast("long")).cast("int")
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    table = wanted.groupBy(word.alias("_word")).agg(F.bit_or(mark).alias("_marks"))
    met = rows.withColumn("_at", word).join(F.broadcast(table), F.col("_at") == F.col("_word"))
    return met.where(F.getbit("_marks", bit) == 1).drop("_at", "_word", "_marks")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _signature(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is itself a u: then each v is the smallest node of its component."""
    nodes = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).select(F.col("u").alias("x"), F.when(F.col("n") > 1, 2).otherwise(1).alias("role"))
    roots = edges.select(F.col("v").alias("x")).distinct().withColumn("role", F.lit(1))
    return nodes.union(roots).groupBy("x").agg(F.sum("role").alias("roles")).where("roles > 1").isEmpty()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links ``(u, v)``: rows ``(node, root)``, root the smallest node.

    Alternating large-star and small-star steps. Every round halves the paths, so that a chain of n
    nodes takes O(log n) rounds. Each step is a partial aggregate (the smallest neighbour) and a join
    whose two sides are read from written tables, so that AQE can split a node with very many links;
    no neighbour list is ever gathered. Nodes without a link to another node are not returned. Links
    to the node itself, repeated links and nulls do no harm. No links give no rows.
    """
    spark = links.sparkSession
    edges = (
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    edges, path = stored(edges, "links")
    seen = _signature(edges)
    old = [path]

    def star(frame: DataFrame) -> tuple[DataFrame, str]:
        """frame: (u, v) by which each u sees v; adds to each the smallest of them and u itself."""
        smallest, at = stored(frame.groupBy("u").agg(F.min("v").alias("m")), "smallest")
        old.append(at)
        return frame.join(smallest.select("u", F.least("u", "m").alias("m")), "u")

    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, at = stored(star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        old.append(at)
        near = star(large)
        small = near.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after, path = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        now = _signature(after)
        for at in old:
            drop_path(spark, at)
        old = [path]
        edges, done, seen = after, now == seen, now
        if done or _are_stars(edges):
            break
    else:
        raise RuntimeError(f"no fixed point of the components after {max_rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select("v", "v").distinct())


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """(text, y): at most ``most`` labelled documents of each class, by a hash of doc_id.

    Ids without a label, with labels that contradict one another, or repeated rows of one text count
    once or not at all; of several texts under one id that with the least hash is taken. The hash threshold is chosen from the class's count, so that no sort of all
    rows is needed; the final limit holds the bound whatever the hash does.
    """
    given = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).alias("_other")).where(F.col("y") == F.col("_other")).select("doc_id", "y")
    sizes = {r["y"]: r["count"] for r in given.groupBy("y").count().collect()}
    picked = None
    for y in (0, 1):
        share = min(1.0, 1.2 * most / max(1, sizes.get(y, 0)))
        dealt = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(y)), F.lit(1 << 20)) < int(share * (1 << 20))
        part = given.where((F.col("y") == y) & dealt).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.union(part)
    whole = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    met = whole.join(F.broadcast(picked), "doc_id").withColumn("_h", F.xxhash64("text"))
    return met.groupBy("doc_id").agg(F.min_by("text", F.struct("_h", "text")).alias("text"), F.first("y").alias("y")).select("text", "y")
