"""Exact deduplication with an extendible-hash index on shared files. DataFrame operations only.

Every text gets a 64-bit key. Keys that several rows share enter the index. The directory starts with one bucket; a
bucket with more keys than its capacity is split on the next bit of the key, which doubles the directory where needed.
An entry holds a key, a whole text, and how many rows have it with their largest doc_id; rows are pre-aggregated into at
most SALTS entries for a text, so a group of any size is a few entries. Entries are written to the shared folder, a file
or more for each bucket. The owner task of a bucket reads its key range back and compares the whole texts of a key's
entries: equal ones become one group, and keys that collide give a chain of groups. Rows take their group from it. The
joins that move texts are shuffled joins at every size, salted against hot keys.

Defined cases: a null text is an empty text; a null doc_id takes part in a group but stays only where all the
group's doc_ids are null; rows that repeat a doc_id and text all count and share one decision; an empty table
gives an empty result; other columns, whatever their names, pass through `keep_last` unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, packed, table, unpacked

#: Depth to which buckets can be split: the directory has at most 2 ** MAX_DEPTH entries.
MAX_DEPTH = 14
#: Entries of a bucket before it is split, and the most buckets aimed at (large inputs get larger buckets).
CAPACITY = 2_048
MAX_BUCKETS = 1_024
#: Parts into which the rows of one key are dealt in joins.
SALTS = 32


def directory(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[tuple[int, int]]:
    """Split overfull buckets from depth 0 on. counts: entries by the first max_depth bits. Gives (prefix, depth)."""
    leaves, queue = [], [(0, 0)]
    sums = {max_depth: dict(counts)}
    for d in range(max_depth - 1, -1, -1):
        level: dict[int, int] = {}
        for p, n in sums[d + 1].items():
            level[p >> 1] = level.get(p >> 1, 0) + n
        sums[d] = level
    while queue:
        prefix, depth = queue.pop()
        if depth < max_depth and sums[depth].get(prefix, 0) > capacity:
            queue += [(2 * prefix + 1, depth + 1), (2 * prefix, depth + 1)]
        else:
            leaves.append((prefix, depth))
    return leaves


def build_index(keys: DataFrame, entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Write the entries (key, text, keep_id, n) into buckets on shared files, split by the keys in them; gives the index as read back."""
    spark, slot = entries.sparkSession, F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int")
    counts = {r["slot"]: r["n"] for r in keys.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).collect()}  # at most 2 ** MAX_DEPTH rows
    leaves = directory(counts, max(capacity, sum(counts.values()) // MAX_BUCKETS))
    slots = [(s, b) for b, (p, d) in enumerate(leaves) for s in range(p << (MAX_DEPTH - d), (p + 1) << (MAX_DEPTH - d))]
    owners = spark.createDataFrame(slots, "slot int, bucket int")
    path = new_path(spark, "extendible")
    (entries.withColumn("slot", slot).join(F.broadcast(owners), "slot").drop("slot").repartition("bucket")
        .write.partitionBy("bucket").option("compression", "zstd").parquet(path))
    return spark.read.schema("key long, text string, keep_id long, n long, bucket int").parquet(path)


def groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Groups of at least two equal texts: key, chain (the text's SHA-256), keep_id, group_size."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    repeated = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    wanted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = dealt.join(wanted.hint("shuffle_hash"), ["key", "salt"], "left_semi")
    entries = members.groupBy("key", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")).drop("salt")
    # The owner of a bucket reads all of it, so texts are compared where the bucket is.
    owned = build_index(repeated, entries, capacity).repartition("bucket")
    chains = owned.groupBy("bucket", "key", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return chains.where("group_size > 1").select("key", F.sha2("text", 256).alias("chain"), "keep_id", "group_size")


def judged_rows(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """docs in a struct `__row`, with doc_id, keep_id, group_size, kept and text_sha256."""
    text = F.coalesce(F.col("__row.text"), F.lit(""))
    rows = packed(docs).select(
        "__row", F.col("__row.doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("text_sha256"),
        F.pmod(F.xxhash64(F.col("__row.doc_id").cast("long")), F.lit(SALTS)).cast("int").alias("salt"))
    found = groups(docs, capacity).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({"key": "g_key", "salt": "g_salt"})
    on = (rows["key"] == found["g_key"]) & (rows["salt"] == found["g_salt"]) & (rows["text_sha256"] == found["chain"])
    return rows.join(found.hint("shuffle_hash"), on, "left").select(
        "__row", "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def exact_groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    return judged_rows(docs.select("doc_id", "text"), capacity).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_last(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the row with the largest doc_id."""
    return unpacked(judged_rows(docs, capacity).where("kept"), docs.columns)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
