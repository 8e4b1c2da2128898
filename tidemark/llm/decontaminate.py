"""Benchmark decontamination with SimHash windows and a multi-index for Hamming distance. DataFrame operations only.

Texts are lower-cased and cut into words at x20 and x09-x0D; a shingle is five words (all words, if fewer). A
window has as many words as a benchmark item, so each item is compared with windows of its own size. Windows
are laid where a document shares a shingle with the item, so that the two align, and at every start between two
such places next to each other, unless they are too far apart for one window to hold what it needs of both. At a
start before or behind all alignments of what it shares, a window holds no more than at the nearest one; a window
that shares no shingle can't reach the threshold. A window's SimHash (64 bits, each occurrence of a shingle counts) is looked up in an
index of the items' fingerprints: 64 bits in BLOCKS blocks, where of two fingerprints within RADIUS some block
differs in at most RADIUS // BLOCKS bits, so the index holds every block value within that distance. All items
within RADIUS are found. They are verified by the exact weighted similarity: with shingles weighted by their
occurrences, sum of minima over sum of maxima, at least 0.8.

RADIUS: at similarity 0.8 fingerprints differ in 10 bits on average, with a deviation of 3; 20 loses about one
such window in 5,000, and fewer above it.

Defined cases: null and empty texts have no words and match nothing, on either side; a document or item of
fewer than five words is one shingle, so a short item is found where its words stand in a row; items that repeat are reported each under their item_id; rows with a null
doc_id are not examined and stay; an empty benchmark or table gives no rows; extra columns pass through.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import packed, table, unpacked

WIDTH = 5
NUMERATOR, DENOMINATOR = 80, 100
RADIUS, BLOCKS = 20, 7
#: Words of all items up to which their shingles are broadcast; more are joined by a shuffle.
BROADCAST_WORDS = 1_000_000
SALTS = 16
_SIZES = [64 // BLOCKS + (i < 64 % BLOCKS) for i in range(BLOCKS)]
_STARTS = [sum(_SIZES[:i]) for i in range(BLOCKS)]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_at(words: Column, i: Column) -> Column:
    return F.xxhash64(F.concat_ws(" ", *[F.get(words, i + k) for k in range(WIDTH)]))


def places(words: Column) -> Column:
    """Where shingles start; empty without words."""
    n = F.size(words)
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - WIDTH, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def shingles_of(words: Column) -> Column:
    return F.transform(places(words), lambda i: shingle_at(words, i))


def simhash(shingles: Column) -> Column:
    """A bit is set where more of the shingles have it than not."""
    half = F.size(shingles)
    bit = lambda b: F.aggregate(shingles, F.lit(0), lambda n, h: n + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1)).cast("int"))
    out = F.lit(0).cast("long")
    for b in range(64):
        out = out.bitwiseOR(F.when(2 * bit(b) > half, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def block(fingerprint: Column, i: int) -> Column:
    return F.shiftrightunsigned(fingerprint, _STARTS[i]).bitwiseAND(F.lit((1 << _SIZES[i]) - 1)).cast("int")


def near_masks(size: int) -> list[int]:
    """Bit patterns of a block that differ in at most RADIUS // BLOCKS places."""
    return [sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(size), k)]


def hamming_index(items: DataFrame) -> DataFrame:
    """For each item and block all block values within reach: size, block, value, item_id, fingerprint, shingles."""
    near = lambda i: F.transform(F.lit(near_masks(_SIZES[i])), lambda m: m.bitwiseXOR(block(F.col("fingerprint"), i)))
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), near(i).alias("values")) for i in range(BLOCKS)])
    return items.select("*", F.inline(blocks)).select("size", "block", F.explode("values").alias("value"), "item_id", "fingerprint", "shingles")


def reach(size: Column) -> Column:
    """How far apart two neighbouring alignments of an item are at most that one window between them needs.

    With n shingles, of which a window shares n * 2 * 0.8 / 1.8 at least: those aligned e before its start lie behind
    the item's first e, those aligned f behind it before the last f, so they are 2 * n - e - f at most.
    """
    return F.floor(2 * DENOMINATOR * F.greatest(size - WIDTH + 1, F.lit(1)) / (NUMERATOR + DENOMINATOR)).cast("int")


def held_by(rows: DataFrame, shingles: DataFrame, small: bool) -> DataFrame:
    """rows with the items that hold their shingle; where these are too many for a broadcast, a shingle of very many rows is dealt into SALTS parts."""
    if small:
        return rows.join(F.broadcast(shingles), "shingle")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(shingles.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["shingle", "salt"]).drop("salt")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming, similarity: the best window of each document and item."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = words.select("item_id", F.size("words").alias("size"), shingles_of(F.col("words")).alias("shingles"))
    offsets = items.select("size", F.xxhash64("shingles").alias("kind"), F.posexplode("shingles").alias("offset", "shingle")).distinct()
    small = (words.agg(F.sum(F.size("words"))).first()[0] or 0) <= BROADCAST_WORDS
    short = [r["size"] for r in items.where(F.col("size") < WIDTH).select("size").distinct().collect()]  # at most WIDTH - 1

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("whole"), words_of(F.col("text")).alias("words"))
    rows = texts.select("doc_id", "whole", "words", F.explode(places(F.col("words"))).alias("at"))
    met = held_by(rows.withColumn("shingle", shingle_at(F.col("words"), F.col("at"))), offsets, small)
    start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("offset"), F.size("words") - F.col("size")))
    aligned = met.select("doc_id", "whole", "kind", "size", start.alias("first"), F.slice("words", start + 1, F.col("size") + reach(F.col("size"))).alias("near")).distinct()
    after = F.lead("first").over(W.partitionBy("doc_id", "whole", "kind").orderBy("first"))
    laid = aligned.withColumn("after", after).withColumn("last", F.when(F.col("after") - F.col("first") <= reach(F.col("size")), F.col("after") - 1).otherwise(F.col("first")))
    starts = laid.select("doc_id", "size", "first", "near", F.explode(F.sequence("first", "last")).alias("start"))
    windows = starts.select("doc_id", "size", "start", F.slice("near", F.col("start") - F.col("first") + 1, F.col("size")).alias("window")).distinct()
    windows = windows.select("doc_id", "size", "start", F.size("window").alias("n_words"), shingles_of(F.col("window")).alias("held"))
    for size in short:  # an item of fewer words than a shingle is one shingle of its own width, looked for at every word
        whole = items.where(F.col("size") == size).select(F.col("shingles")[0].alias("shingle")).distinct()
        at = texts.where(F.size("words") >= size).select("doc_id", "words", F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("start"))
        at = held_by(at.withColumn("shingle", F.xxhash64(F.concat_ws(" ", F.slice("words", F.col("start") + 1, size)))), whole, small)
        windows = windows.unionByName(at.select("doc_id", F.lit(size).alias("size"), "start", F.lit(size).alias("n_words"), F.array("shingle").alias("held")).distinct())
    prints = windows.select("*", simhash(F.col("held")).alias("print"))

    index = hamming_index(items.withColumn("fingerprint", simhash(F.col("shingles"))))
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), block(F.col("print"), i).alias("value")) for i in range(BLOCKS)])
    looked = prints.select("*", F.inline(blocks)).join(index, ["size", "block", "value"])
    within = looked.withColumn("hamming", F.bit_count(F.col("print").bitwiseXOR(F.col("fingerprint")))).where(F.col("hamming") <= RADIUS)
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    shared = F.aggregate(F.array_intersect("held", "shingles"), F.lit(0), lambda n, x: n + F.least(count(F.col("held"), x), count(F.col("shingles"), x)))
    judged = within.select("doc_id", "item_id", "start", "n_words", "hamming", shared.alias("shared"), (F.size("held") + F.size("shingles")).alias("both"))
    judged = judged.where(DENOMINATOR * F.col("shared") >= NUMERATOR * (F.col("both") - F.col("shared")))
    similarity = F.col("shared") / (F.col("both") - F.col("shared"))
    best = judged.groupBy("doc_id", "item_id").agg(F.max(F.struct(similarity.alias("similarity"), (-F.col("start")).alias("before"), "n_words", "hamming")).alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.before")).alias("start_word"), F.col("x.n_words").alias("n_words"), F.col("x.hamming").alias("hamming"), F.round("x.similarity", 6).alias("similarity"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    hit = contaminated(docs.select("doc_id", "text"), benchmark).select("doc_id").distinct()
    rows = packed(docs).withColumn("doc_id", F.col("__row.doc_id").cast("long"))
    return unpacked(rows.join(hit.hint("shuffle_hash"), "doc_id", "left_anti"), docs.columns)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
