"""Shards of a bounded size by extendible hashing, with DataFrame functions.

A document's shard is the shortest prefix of its id's hash whose documents fit the byte limit together: where a bucket is
too large, it alone splits on one more bit. Bucket sizes come from one grouped sum at a depth that leaves nearly all
buckets small, rolled up a bit at a time towards the root, so that no task sees a whole level; only buckets still too
large there are summed again, some bits deeper. What is joined back is the directory, a row per slot, on a hash prefix,
which no hot source or group of copies can skew.

Defined results
---------------
* Null text has 0 bytes. Null ids hash as the empty string.
* Rows that share an id share their hash: they stay together, and where they exceed the limit at BITS bits, as one
  document larger than the limit does, their shard is marked oversized.
* An empty table gives an empty result; other columns are neither read nor in the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, fresh

BITS, STEP = 60, 8
#: Buckets are rolled up one level at a time until at most 2^TOP of them have an ancestor in common, and these at once.
TOP = 10
SHARD_BYTES = 1 << 20


def hashed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, hash): hash is the first BITS bits of the id's MD5."""
    digest = F.md5(F.coalesce(docs[doc_id].cast("string"), F.lit("")))
    return docs.select(docs[doc_id].alias("doc_id"), F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long").alias("n_bytes"), F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long").alias("hash"))


def _directory(rows: DataFrame, start: int, depth: int, limit: int, top: int = TOP) -> DataFrame:
    """(slot, depth, shard_bytes, shard_rows, fits): for each prefix of `depth` bits the shallowest bucket from `start` on that fits.

    A bucket that fits is a shard once its parent does not.
    """
    sums = (F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    level = cut(rows.groupBy(F.shiftright("hash", BITS - depth).alias("bucket")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows")), "slots")
    done = level.filter(F.col("bytes") > limit).select("bucket", F.lit(depth).alias("level"), "bytes", "rows")
    at = depth
    while at - start > top:
        parents = cut(level.groupBy(F.shiftright("bucket", 1).alias("parent")).agg(*sums), "bucket-level")
        large = parents.filter(F.col("bytes") > limit).select("parent")
        fitting = level.filter(F.col("bytes") <= limit).join(large, F.shiftright("bucket", 1) == F.col("parent"), "left_semi")
        done = done.unionByName(fitting.select("bucket", F.lit(at).alias("level"), "bytes", "rows"))
        level, at = parents.withColumnRenamed("parent", "bucket"), at - 1
    levels = level.select("*", F.explode(F.sequence(F.lit(start), F.lit(at))).alias("level"))
    ancestor = W.partitionBy("level", F.expr(f"shiftright(bucket, {at} - level)"))
    sized = levels.select("bucket", "level", F.sum("bytes").over(ancestor).alias("bytes"), F.sum("rows").over(ancestor).alias("rows"))
    best = F.min(F.when(F.col("bytes") <= limit, F.struct("level", "bytes", "rows"))).alias("best")
    above = sized.groupBy("bucket").agg(best).filter("best is not null").select(F.expr(f"shiftright(bucket, {at} - best.level)").alias("bucket"), F.col("best.level").alias("level"), F.col("best.bytes").alias("bytes"), F.col("best.rows").alias("rows")).distinct()
    done = cut(done.unionByName(above), "buckets")
    first = F.expr(f"shiftleft(bucket, {depth} - level)")
    slots = F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {depth} - level)") - 1))
    return done.select(slots.alias("slot"), F.col("level").alias("depth"), F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"), (F.col("bytes") <= limit).alias("fits"))


def sharded(docs: DataFrame, limit: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, shard (the prefix, as binary digits), depth, shard_bytes, shard_rows, oversized."""
    open_rows = cut(hashed(docs, doc_id, text), "hashed")
    total = open_rows.agg(F.sum("n_bytes")).first()[0] or 0
    start, depth = 0, min(BITS, (total // limit).bit_length() + 2)
    done = None
    while True:
        directory = cut(_directory(open_rows, start, depth, limit), "directory")
        placed = open_rows.join(directory, F.shiftright(open_rows["hash"], BITS - depth) == directory["slot"])
        settled = placed if depth == BITS else placed.filter("fits")
        settled = settled.select("doc_id", "n_bytes", F.shiftright("slot", 0).alias("slot"), F.lit(depth).alias("of"), "depth", "shard_bytes", "shard_rows", (~F.col("fits")).alias("oversized"))
        done = settled if done is None else done.unionByName(settled)
        if depth == BITS or directory.filter("not fits").isEmpty():
            break
        open_rows = cut(placed.filter("not fits").select("doc_id", "n_bytes", "hash"), "oversized-rows")
        start, depth = depth + 1, min(BITS, depth + STEP)
    digits = F.expr("CASE WHEN depth = 0 THEN '' ELSE lpad(bin(shiftright(slot, of - depth)), depth, '0') END")
    return done.select("doc_id", "n_bytes", digits.alias("shard"), F.col("depth").cast("long").alias("depth"), "shard_bytes", "shard_rows", "oversized")


def shards(rows: DataFrame) -> DataFrame:
    """The shards of the rows that `sharded` gives: shard, depth, n_bytes, n_rows, oversized."""
    return rows.groupBy("shard", "depth").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows"), F.bool_or("oversized").alias("oversized"))


def write(docs: DataFrame, path: str, limit: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write docs as Parquet, a folder b<prefix> per shard, all columns as they are; texts are dealt out by shard once."""
    key, shard = fresh(docs, "shard_id", "shard")
    keys = sharded(docs, limit, doc_id, text).select(F.col("doc_id").alias(key), F.concat(F.lit("b"), "shard").alias(shard)).distinct()
    docs.join(keys, docs[doc_id].eqNullSafe(keys[key])).drop(key).repartition(shard).write.partitionBy(shard).parquet(path)
