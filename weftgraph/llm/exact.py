"""Exact dedup by an extendible-hash index on shared files. Built-in functions only.

1. One scan of the texts writes slim entries (doc_id, 64-bit key, SHA-256) to the shared folder.
2. Entries are combined by key before and after the shuffle, so that a text with a third of all
   rows costs one row a task. Each key is one index entry.
3. A histogram of key prefixes drives the directory: while a bucket holds more than ``capacity``
   entries it splits on its next bit, and the directory doubles when that bucket was as deep as
   the directory. The prefixes have as many bits as the number of keys needs and four more, so
   the histogram and the directory have at most some 32 entries for each ``capacity`` keys.
4. The index is written as files that each hold a range of buckets, sorted by key. Owner tasks
   take ranges of buckets and keys: the rows of keys that hold several are dealt to them by
   bucket and key, and chained by comparing whole texts. Equal texts of one task are combined
   before they are sent, so an owner gets a row of each task for a hot text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, small_enough, write_out

CAPACITY = 100_000
_SPARE_BITS = 4


def build_directory(histogram: dict[int, int], capacity: int, max_depth: int) -> tuple[int, dict[int, int]]:
    """Global depth and, for each slot of that depth, its bucket.

    histogram: entries for each prefix of ``max_depth`` bits. A bucket is named by its prefix with
    a leading one, so a name tells the local depth too.
    """
    depth, buckets, waiting = 0, {}, [(0, 0, sorted(histogram.items()))]
    while waiting:
        local, prefix, held = waiting.pop()
        if sum(n for _, n in held) <= capacity or local == max_depth:
            buckets[(local, prefix)] = 1 << local | prefix
            continue
        depth = max(depth, local + 1)
        bit = max_depth - local - 1
        for side in (0, 1):
            waiting.append((local + 1, prefix << 1 | side, [x for x in held if x[0] >> bit & 1 == side]))
    directory = {}
    for (local, prefix), name in buckets.items():
        free = depth - local
        directory.update((prefix << free | low, name) for low in range(1 << free))
    return depth, directory


def depth_for(keys: int, capacity: int) -> int:
    """Bits of the prefixes that are counted: a bucket of uniformly hashed keys never needs the last of them."""
    return min(40, (keys // max(1, capacity)).bit_length() + _SPARE_BITS)


def key_prefix(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def chains(several: DataFrame) -> DataFrame:
    """bucket, k, sha, keep_id, group_size for each different text of (bucket, k, doc_id, body), a chain of one or more texts for each key.

    Equal texts are first combined in the task that read them; then owners of ranges of (bucket,
    k) bring together what all tasks found. Their aggregation compares whole texts.
    """
    own = several.groupBy(F.spark_partition_id().alias("part"), "bucket", "k", "body").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n"))
    dealt = own.select("bucket", "k", "body", "doc_id", "n").repartitionByRange("bucket", "k")
    found = dealt.groupBy("bucket", "k", "body").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return found.select("bucket", "k", F.sha2("body", 256).alias("sha"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key=F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of ``docs``.

    Equal texts form a group; its largest id stays. A null text counts as empty; a text of any
    length is compared whole. Rows that repeat an id are one document: they count in group_size
    and share the verdict. A null id never wins over another; a group of null ids only has keep_id
    null and stays. An empty table gives no rows. Other columns are ignored, so their names can't
    clash. ``key`` may be any function from text to a long: texts that share a key are told apart
    by comparing them. Keys that agree in more leading bits than the directory counts share a
    bucket, however many they are.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    keyed = rows.select("doc_id", "body", key("body").cast("long").alias("k"))
    entries = write_out(keyed.select("doc_id", "k", F.sha2("body", 256).alias("sha")), "exact-entries")

    held = write_out(entries.groupBy("k").agg(F.count("*").alias("n")), "exact-keys")
    deepest = depth_for(held.count(), capacity)
    counted = held.groupBy(key_prefix(F.col("k"), deepest).alias("p")).agg(F.count("*").alias("n"))
    depth, directory = build_directory({r.p: r.n for r in counted.collect()}, capacity, deepest)
    slots = spark.createDataFrame(sorted(directory.items()), "slot long, bucket long")
    placed = held.withColumn("slot", key_prefix(F.col("k"), depth)).join(F.broadcast(slots), "slot")  # some 32 rows at most for each ``capacity`` keys
    index = write_out(placed.select("bucket", "k", "n").repartitionByRange("bucket", "k").sortWithinPartitions("bucket", "k"), "exact-index")

    shared_keys = write_out(index.filter("n > 1").select("bucket", "k"), "exact-shared")
    several = keyed.join(small_enough(shared_keys), "k")
    chained = write_out(chains(several), "exact-chains")
    forget(held, index, shared_keys)

    found = entries.join(small_enough(chained.drop("bucket")), ["k", "sha"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
