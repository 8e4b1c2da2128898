"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents with the same set of shingles are one class, represented by the least doc_id. Tokens (shingle hashes)
have one order for all documents: those that are frequent in prefixes come last, by their count, the others by
their hash. If two sets overlap as the threshold asks, their first n - ceil(0.8 n) + l tokens share at least l.
Each document lengthens its prefix, that is, chooses l, where this costs least: frequent tokens that it can't
avoid bring many candidates, and a candidate of a pair must share the lesser l of the two before it is verified.

First each document is verified against the one leader it shares most prefix tokens with (of the documents of a
token the one that can share most of itself), which joins large
groups of near copies without their pairs. Then all pairs of documents of different components that share
enough tokens are verified, so no link between components is lost. Of two prefixes one ends first in the order of
tokens. What the two share up to there lies in both prefixes, and what they share behind it in the rest of that
document; a pair for which this is too little is left out, and so is one whose bitmaps differ in more bits than two
linked sets can differ in shingles (checked where the pair would be made). Verification compares whole sets.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; rows that
share a doc_id are rows of one document and share its component; rows with a null doc_id get no component
(null) and link with nothing; an empty table gives no rows; extra columns pass through `keep_first` unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import packed, python_batches, staged, table, unpacked
from tidemark.llm.components import components

NUMERATOR, DENOMINATOR = 80, 100
#: At least so many prefixes make a token frequent; the order knows so many of the most frequent ones (their list is broadcast).
FREQUENT = 8
MAX_FREQUENT = 200_000
#: Prefix extensions tried, and what verifying a candidate costs against one more prefix token.
EXTENSIONS = (1, 2, 3, 4, 6, 8, 12, 16)
#: Frequent tokens are counted in prefixes so many times as long, as the prefix moves on past those it skips.
COUNTED = 2
VERIFY_COST = 16
#: Counts from which `last` no longer tells tokens apart.
MAX_ORDERED = (1 << 24) - 1
#: Documents of a frequent token that one group holds in the first round; more are dealt into several.
GROUP = 2_000
#: Shared tokens from which a leader is worth verifying in the first round.
LEADER_MATCHES = 3
SALTS = 16
#: Bits of a set's bitmap, and rows of one key in a part of a dealt join.
BITS = 512
BITMAP = [f"bits{i}" for i in range(BITS // 64)]
DEALT = 1_000


def _prepared(texts):
    return [(x.as_py() or "").encode() for x in texts]


def sets_of(docs: DataFrame, prefixes: bool) -> DataFrame:
    """doc_id, n and a 128-bit signature of the set; with prefixes only their tokens, in hash order."""
    python_batches(docs.sparkSession)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        from tidemark.llm.shingles import mixed, shingle_sets

        for batch in batches:
            if not batch.num_rows:
                continue
            h, counts = shingle_sets(_prepared(batch.column(1)))
            first = np.concatenate([[0], np.cumsum(counts)])
            if prefixes:
                keep = COUNTED * (counts - (counts * NUMERATOR + DENOMINATOR - 1) // DENOMINATOR + 1) + EXTENSIONS[-1] // 2
                rank = np.arange(len(h)) - np.repeat(first[:-1], counts)
                yield pa.RecordBatch.from_arrays([pa.array(h[rank < np.repeat(keep, counts)].view(np.int64))], names=["token"])
                continue
            s1, s2 = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
            full = counts > 0
            if full.any():
                at = first[:-1][full]
                s1[full] = np.add.reduceat(mixed(h ^ np.uint64(0x5851F42D4C957F2D)), at)
                s2[full] = np.add.reduceat(mixed(h ^ np.uint64(0x14057B7EF767814F)), at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))], names=["doc_id", "n", "s1", "s2"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(work, "token long" if prefixes else "doc_id long, n long, s1 long, s2 long")


def frequent_tokens(docs: DataFrame):
    """The most frequent tokens of hash-ordered prefixes and their counts, as sorted arrays: at most MAX_FREQUENT."""
    import numpy as np

    counts = sets_of(docs, True).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counts.orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).toPandas()
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows["n"].to_numpy(np.int64)[order]


def prefixes_of(docs: DataFrame, frequent) -> DataFrame:
    """doc_id, n, ell, and the prefix as tokens with their parts (groups into which a very frequent token is dealt).

    last is where the prefix ends in the order of tokens, in one number; equal numbers can be different places.
    """
    python_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most MAX_FREQUENT entries

    def work(batches):
        import numpy as np
        import pyarrow as pa

        from tidemark.llm.shingles import shingle_sets

        hot, hot_n = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            h, counts = shingle_sets(_prepared(batch.column(1)))
            first = np.concatenate([[0], np.cumsum(counts)])
            doc = np.repeat(np.arange(len(counts)), counts)
            often = np.zeros(len(h), np.int64)
            if len(hot) and len(h):
                at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                often = np.where(hot[at] == h, hot_n[at], 0)
            order = np.lexsort((h, often, doc))
            h, often = h[order], often[order]
            others = np.concatenate([[0], np.cumsum(np.maximum(often - 1, 0))])
            keep = counts - (counts * NUMERATOR + DENOMINATOR - 1) // DENOMINATOR
            ell, best = np.ones(len(counts), np.int64), None
            for e in EXTENSIONS:
                length = np.minimum(keep + e, counts)
                cost = length + VERIFY_COST * (others[first[:-1] + length] - others[first[:-1]]) / e
                cost[keep + e > counts] = np.inf
                if best is None:
                    best = cost
                better = cost < best
                ell[better], best = e, np.minimum(cost, best)
            length = np.minimum(keep + ell, counts)
            rank = np.arange(len(h)) - np.repeat(first[:-1], counts)
            within = rank < np.repeat(length, counts)
            end = np.zeros(len(counts), np.int64)
            some = counts > 0
            at = (first[:-1] + length - 1)[some]
            far = often[at] >= MAX_ORDERED
            end[some] = np.minimum(often[at], MAX_ORDERED) << 39 | np.where(far, 0, (h[at] >> np.uint64(25)).astype(np.int64))
            ids = np.asarray(batch.column(0).fill_null(0))
            parts = (often[within] // GROUP + 1).astype(np.int64)
            part = (ids[doc[within]] * 2654435761 % 1000003 % parts).astype(np.int32)
            part = np.where(parts > 1, part + 1, 0).astype(np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int32()), pa.array(ell, pa.int32()), pa.array(length, pa.int32()), pa.array(end),
                 pa.ListArray.from_arrays(offsets, pa.array(h[within].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(part))],
                names=["doc_id", "n", "ell", "length", "last", "tokens", "parts"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("doc_id is not null")
    return rows.mapInArrow(work, "doc_id long, n int, ell int, length int, last long, tokens array<long>, parts array<int>")


def compressed(docs: DataFrame) -> DataFrame:
    """doc_id, the text, compressed (what is shuffled for verification), and the set's bitmap in BITS // 64 numbers.

    A bit of the bitmap is set if an odd number of the set's shingles fall on it, so two bitmaps differ in at most
    as many bits as their sets differ in shingles.
    """
    python_batches(docs.sparkSession)

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        from tidemark.llm.shingles import shingle_sets

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = _prepared(batch.column(1))
            h, counts = shingle_sets(texts)
            at = np.repeat(np.arange(len(counts)), counts) * BITS + (h >> np.uint64(20)).astype(np.int64) % BITS
            odd = (np.bincount(at, minlength=len(counts) * BITS) & 1).astype(np.uint8).reshape(len(counts), BITS)
            words = np.packbits(odd, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([pack(x) for x in texts], pa.binary()), *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(BITS // 64)]],
                names=["doc_id", "blob", *BITMAP])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, f"doc_id long, blob binary, {', '.join(f'{c} long' for c in BITMAP)}")


def dealt_join(rows: DataFrame, key: str, values: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows (the pairs, and perhaps more columns) with the value of their key; a key that stands in very many pairs is dealt into parts of DEALT pairs."""
    parts = pairs.groupBy(key).agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts")).withColumnRenamed(key, "__key")
    wide = values.join(parts.hint("shuffle_hash"), values[key] == parts["__key"]).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop(key, "parts")
    many = parts.where("parts > 1")
    sized = rows.join(many.hint("shuffle_hash"), rows[key] == many["__key"], "left").drop("__key")
    dealt = sized.withColumn("__part", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return dealt.join(wide.hint("shuffle_hash"), (dealt[key] == wide["__key"]) & (dealt["__part"] == wide["__salt"])).drop("__key", "__salt", "__part")


def verified(pairs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose sets overlap enough, with the sizes of intersection and union."""
    python_batches(pairs.sparkSession, 256)
    pairs, texts = staged(pairs.select("a", "b"), "pairs"), blobs.select("doc_id", "blob")
    left = dealt_join(pairs, "b", texts.withColumnsRenamed({"doc_id": "b", "blob": "blob_b"}), pairs)
    whole = dealt_join(left, "a", texts.withColumnsRenamed({"doc_id": "a", "blob": "blob_a"}), pairs).select("a", "b", "blob_a", "blob_b")

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        from tidemark.llm.shingles import shingle_sets

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            if not batch.num_rows:
                continue
            blobs = [x.as_py() for c in (2, 3) for x in batch.column(c)]
            number = {x: i for i, x in enumerate(dict.fromkeys(blobs))}
            h, counts = shingle_sets([unpack(x) for x in number])
            sets = np.split(h, np.cumsum(counts)[:-1])
            shared, union = [], []
            half = batch.num_rows
            for i in range(half):
                x, y = sets[number[blobs[i]]], sets[number[blobs[half + i]]]
                both = np.sort(np.concatenate([x, y]), kind="stable")
                n = int((both[1:] == both[:-1]).sum())
                shared.append(n)
                union.append(len(x) + len(y) - n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "shared", "total"])

    counted = whole.mapInArrow(work, "a long, b long, shared long, total long")
    return counted.where((F.col("total") > 0) & (DENOMINATOR * F.col("shared") >= NUMERATOR * F.col("total")))


def reaching(rows: DataFrame) -> DataFrame:
    """With the most that a document shares with one whose prefix ends no earlier: its prefix tokens that another prefix has, and its rest."""
    return rows.join(rows.groupBy("doc_id").agg((F.count("*") + F.max(F.col("n") - F.col("length"))).alias("most")).hint("merge"), "doc_id")


def _of_first(x: str, y: str):
    """What the document of a pair has whose prefix ends first; the greater, where this can't be told."""
    return F.when(F.col("last_x") < F.col("last_y"), x).when(F.col("last_x") > F.col("last_y"), y).otherwise(F.greatest(x, y))


def _needed(both):
    """The least overlap of two sets that link, from the sum of their sizes."""
    return F.ceil(both * NUMERATOR / (NUMERATOR + DENOMINATOR))


def _differ():
    """Bits in which the bitmaps of a pair differ: no more than the shingles in which the sets do."""
    return sum((F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in BITMAP), F.lit(0))


def _sizes(x: str, y: str):
    return DENOMINATOR * F.least(x, y) >= NUMERATOR * F.greatest(x, y)


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, n, rep: the least doc_id with the same set) and components (node, component) of linked reps."""
    sets = staged(sets_of(docs, False), "sets")
    usable = sets.where("doc_id is not null and n > 0")
    same = usable.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    same = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = sets.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    members = staged(dealt.join(same.hint("shuffle_hash"), ["s1", "s2", "n", "salt"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "members")
    reps = members.where("n > 0 and doc_id = rep").select("doc_id").distinct()

    prefixes = prefixes_of(docs, frequent_tokens(docs)).join(reps.hint("shuffle_hash"), "doc_id", "left_semi")
    tokens = prefixes.select(
        "doc_id", "n", "ell", "length", "last", F.inline(F.arrays_zip("tokens", "parts"))).withColumnsRenamed({"tokens": "token", "parts": "part"})
    group = W.partitionBy("token", "part")
    rows = tokens.withColumn("copies", F.count("*").over(group)).where("copies > 1 or part > 0")
    rows = staged(rows.select("token", "doc_id", "n", "ell", "length", "last"), "prefixes")
    rows = staged(reaching(rows), "prefixes")

    blobs = staged(compressed(docs).join(rows.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")

    # A token's leader is the document that can share most of itself: of near copies the one with fewest edits.
    lead = F.max_by(F.struct(F.col("doc_id").alias("leader"), F.col("n").alias("leader_n")), F.struct(F.col("most") / F.col("n"), -F.col("doc_id")))
    leaders = rows.groupBy("token").agg(lead.alias("x")).select("token", "x.*")
    stars = rows.join(leaders.hint("merge"), "token").where(F.col("doc_id") != F.col("leader")).where(_sizes("n", "leader_n")).groupBy("doc_id", "leader").agg(F.count("*").alias("m")).where(F.col("m") >= LEADER_MATCHES)
    stars = stars.groupBy(F.col("doc_id").alias("b")).agg(F.max_by("leader", F.struct("m", -F.col("leader"))).alias("a"))
    near = staged(verified(stars.select("a", "b"), blobs).select("a", "b"), "links")
    known = components(near)

    rows = rows.join(known.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    rows = staged(rows.select("token", "doc_id", "n", "ell", F.expr("n - length").alias("rest"), "last", "most", "component"), "prefixes")
    of_token = rows.groupBy("token", "component").agg(F.count("*").alias("m")).groupBy("token").agg(F.count("*").alias("kinds"), F.max_by("component", F.struct("m", "component")).alias("main"))
    mixed = rows.join(of_token.where("kinds > 1").select("token", "main").hint("merge"), "token")
    mixed = staged(mixed.join(blobs.select("doc_id", *BITMAP).hint("merge"), "doc_id"), "mixed")
    some = mixed.where("component != main").drop("main")
    names = ["doc_id", "n", "ell", "rest", "last", "most", "component", *BITMAP]
    x, y = mixed.select("token", "main", *[F.col(c).alias(f"{c}_x") for c in names]), some.select("token", *[F.col(c).alias(f"{c}_y") for c in names])
    met = x.join(y.hint("merge"), "token").where("component_x != component_y and (component_x = main or doc_id_x < doc_id_y)").where(_sizes("n_x", "n_y"))
    both = F.col("n_x") + F.col("n_y")
    met = met.where((both - _differ() >= 2 * _needed(both)) & (_of_first(F.col("most_x"), F.col("most_y")) >= _needed(both)))
    least, most = F.least("doc_id_x", "doc_id_y"), F.greatest("doc_id_x", "doc_id_y")
    pairs = met.groupBy(least.alias("a"), most.alias("b")).agg(
        F.count("*").alias("m"), F.first(F.least("ell_x", "ell_y")).alias("ell"),
        F.first(_of_first(F.col("rest_x"), F.col("rest_y"))).alias("rest"), F.first(F.col("n_x") + F.col("n_y")).alias("both"))
    pairs = pairs.where((F.col("m") >= F.col("ell")) & (F.col("m") + F.col("rest") >= _needed(F.col("both"))))
    far = verified(pairs.select("a", "b"), blobs).select("a", "b")
    return members, components(near.unionByName(far))


def classed(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id."""
    members, found = link(docs)
    found = found.where("node != component").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("node", "rep")
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(found.hint("shuffle_hash"), ["rep", "salt"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of each component the one with the least doc_id.

    Rows with a null doc_id stay; rows that repeat a doc_id stay or go together.
    """
    dropped = classed(docs.select("doc_id", "text")).where("doc_id != component_id").select("doc_id").distinct()
    rows = packed(docs).withColumn("doc_id", F.col("__row.doc_id").cast("long"))
    return unpacked(rows.join(dropped.hint("shuffle_hash"), "doc_id", "left_anti"), docs.columns)


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return classed(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS h FROM w),
n AS (SELECT w.doc_id, count(s.h) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 80 * (na.n + nb.n - x)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
