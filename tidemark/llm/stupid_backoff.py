"""Stupid-backoff scores of all documents (orders 1 to 3), from n-gram count tables of the whole corpus.

Words are runs of bytes between white space, with their case; a start mark stands before each document. No word
and no n-gram is left out: all are known by 64-bit hashes. Documents are gathered into packs of some PACK_WORDS
words. The count tables are partitioned by the hash of the n-gram into shards of some SHARD_WORDS words. A pack's
different n-grams are exploded, with their counts, into one block for each shard (sorted and packed, as single rows
would take more than the disk budget); a shard sums its count table from all its blocks and joins it to them, and a
pack gets back, for each of its n-grams, what other packs have. Trigrams follow in a second pass, and only those whose
two bigrams other documents have: no other trigram can occur again. Scores are summed per document.

A document's own occurrences are left out of all counts when it is scored, otherwise nothing would ever back off.
With C' for what is left, the word c after a, b scores log(C'(abc) / C'(ab)) if C'(abc) is positive, else
log(ALPHA) + log(C'(bc) / C'(b)) if C'(bc) is, else 2 log(ALPHA) + log(max(C'(c), 1) / words of the others). The
first word of a document starts at the bigram with the start mark, whose count is the number of documents.

Defined cases: a null or empty text has no words, n_words 0 and a null score; rows that share a doc_id are added
up; a null doc_id is a document of its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, python_batches, staged, table

ALPHA = 0.4
#: Words of a pack; a document is never cut, so a longer one is a pack by itself.
PACK_WORDS = 1_000_000
#: Words of the corpus for each shard of the count tables; there are as many shards as this takes, and one a partition at least.
SHARD_WORDS = 2_000_000
NO_ID = -(2**63)
_START = 0x2545F4914F6CDD1D
_STEPS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
BLOCKS = "pack long, shard long, level int, grams binary, counts binary"
COUNTED = "pack long, shard long, level int, others binary"


def packs_of(docs: DataFrame) -> DataFrame:
    """pack, ids and sizes (bytes) of its documents, n_words, and their texts in one compressed blob."""

    def work(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=3).compress
        ids, texts, words, number = [], [], 0, TaskContext.get().partitionId() << 32

        def out():
            row = [number], [ids], [[len(x) for x in texts]], [words], [press(b"".join(texts))]
            types = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.large_binary()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], names=["pack", "ids", "sizes", "n_words", "blob"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append((text.as_py() or "").encode())
                words += len(texts[-1].split())
                if words >= PACK_WORDS:
                    yield out()
                    ids, texts, words, number = [], [], 0, number + 1
        if ids:
            yield out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    return rows.mapInArrow(work, "pack long, ids array<long>, sizes array<long>, n_words long, blob binary")


class Pack:
    """The words of a pack: hashes of the n-grams that end at each word, and the document of each word."""

    def __init__(self, sizes, blob: bytes):
        import numpy as np
        import zstandard

        from tidemark.llm.shingles import mixed, word_hashes

        data, texts, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
        for n in sizes:
            texts.append(data[at : at + n])
            at += n
        c, self.counts = word_hashes(texts, cased=True)
        first = (np.cumsum(self.counts) - self.counts)[self.counts > 0]
        self.first = np.zeros(len(c), bool)
        self.first[first] = True
        b = np.roll(c, 1)
        b[first] = np.uint64(_START)
        self.before, self.word = b, c
        self.pair = mixed(b * np.uint64(_STEPS[0]) + c)
        self.pair_before = np.roll(self.pair, 1)
        self.triple = mixed(self.pair_before * np.uint64(_STEPS[1]) + c)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.has_words = int((self.counts > 0).sum())

    def own(self, grams):
        """How often each position's n-gram occurs in its own document."""
        import numpy as np

        from tidemark.llm.shingles import mixed

        _, where, n = np.unique(mixed(grams + self.doc.astype(np.uint64) * np.uint64(_STEPS[1])), return_inverse=True, return_counts=True)
        return n[where]


def pressed(numbers) -> bytes:
    """Numbers as their eight planes of bytes, compressed."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpressed(blob: bytes):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def blocks_of(pack: int, level: int, gram, n, shards: int):
    """A pack's different n-grams (sorted) and their counts, a row for each shard, which is a range of hashes."""
    import numpy as np
    import pyarrow as pa

    shard = ((gram >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    edge = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(gram))
    step = np.diff(gram, prepend=np.uint64(0))
    rows: list[tuple] = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        step[a] = gram[a]
        rows.append((pack, shard[a], level, pressed(step[a:b]), pressed(n[a:b])))
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["pack", "shard", "level", "grams", "counts"])


def low_grams(p: Pack):
    """The different words and bigrams of a pack and its start mark, sorted, with their counts."""
    import numpy as np

    return np.unique(np.concatenate([p.word, p.pair, np.full(p.has_words, _START, np.uint64)]), return_counts=True)


def high_grams(p: Pack, again):
    """The same of the trigrams whose two bigrams other documents have."""
    import numpy as np

    return np.unique(p.triple[again & np.roll(again, 1) & ~p.first], return_counts=True)


def words_and_pairs(packs: DataFrame, shards: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                p = Pack(row["sizes"], row["blob"])
                if len(p.word):
                    yield blocks_of(row["pack"], 2, *low_grams(p), shards)

    return packs.select("pack", "sizes", "blob").mapInArrow(work, BLOCKS)


def counted(blocks: DataFrame) -> DataFrame:
    """pack, shard, level and others: for each n-gram of a block what other packs have, by the shard's count table."""

    def join(rows):
        import numpy as np
        import pyarrow as pa

        grams = [np.cumsum(unpressed(x.as_py()).view(np.uint64), dtype=np.uint64) for x in rows.column("grams")]
        counts = [unpressed(x.as_py()) for x in rows.column("counts")]
        n = np.concatenate(counts)
        _, which = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(which, n).astype(np.int64)
        others = np.split(total[which] - n, np.cumsum([len(x) for x in counts])[:-1])
        return pa.table({"pack": rows.column("pack"), "shard": rows.column("shard"), "level": rows.column("level"), "others": pa.array([pressed(x) for x in others], pa.binary())})

    return blocks.groupBy("shard").applyInArrow(join, COUNTED)


class Others:
    """What the other documents have of each position's n-gram: the answers to a pack's blocks and its other documents."""

    def __init__(self, answers, level: int, gram, n):
        import numpy as np

        rows = sorted((r["shard"], r["others"]) for r in answers if r["level"] == level)
        self.gram, self.total = gram, n + np.concatenate([unpressed(x) for _, x in rows]) if rows else n

    def of(self, grams, own):
        import numpy as np

        if not len(self.gram):
            return np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(self.gram, grams), len(self.gram) - 1)
        return np.where(self.gram[at] == grams, self.total[at] - own, 0)


def triples(packs: DataFrame, low: DataFrame, shards: int) -> DataFrame:
    """The blocks of each pack's trigrams whose two bigrams other documents have."""

    def work(left, right):
        import numpy as np
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([blocks_of(0, 3, np.empty(0, np.uint64), np.empty(0, np.int64), shards)])
        row = left.to_pylist()[0]
        p = Pack(row["sizes"], row["blob"])
        again = Others(right.to_pylist(), 2, *low_grams(p)).of(p.pair, p.own(p.pair)) > 0
        return pa.Table.from_batches([blocks_of(row["pack"], 3, *high_grams(p, again), shards)])

    return packs.select("pack", "sizes", "blob").groupBy("pack").cogroup(low.groupBy("pack")).applyInArrow(work, BLOCKS)


def pack_scores(packs: DataFrame, answers: DataFrame, n_words: int) -> DataFrame:
    """doc_id, n_words and score of each pack's documents."""

    def work(left, right):
        import numpy as np
        import pyarrow as pa

        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        row, found = left.to_pylist()[0], right.to_pylist()
        p, score = Pack(row["sizes"], row["blob"]), np.zeros(0)
        if len(p.word):
            low = Others(found, 2, *low_grams(p))
            word, pair = low.of(p.word, p.own(p.word)), low.of(p.pair, p.own(p.pair))
            triple = Others(found, 3, *high_grams(p, pair > 0)).of(p.triple, p.own(p.triple))
            triple[p.first] = 0
            starts = low.of(np.full(1, _START, np.uint64), 1)[0]
            before, pair_before = np.where(p.first, starts, np.roll(word, 1)), np.roll(pair, 1)
            log = lambda x: np.log(np.maximum(x, 1))
            rest = np.log(ALPHA) + log(word) - log(n_words - p.counts[p.doc])
            middle = np.where(pair > 0, log(pair) - log(np.maximum(before, pair)), rest) + np.where(p.first, 0.0, np.log(ALPHA))
            score = np.where(triple > 0, log(triple) - log(np.maximum(pair_before, triple)), middle)
        sums = np.bincount(p.doc, score, minlength=len(p.counts))
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_words": pa.array(p.counts, pa.int64()), "score": pa.array(sums)})

    columns = packs.select("pack", "ids", "sizes", "blob")
    return columns.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(work, "doc_id long, n_words long, score double")


def scored(docs: DataFrame) -> DataFrame:
    """One row per doc_id: doc_id, n_words, score (sum of natural logarithms) and mean_score."""
    spark = docs.sparkSession
    python_batches(spark)
    packs = staged(packs_of(docs), "packs")
    n_words = packs.agg(F.sum("n_words")).first()[0] or 0
    shards = max(partitions(spark), -(-n_words // SHARD_WORDS))
    low = staged(counted(words_and_pairs(packs, shards)), "counts")
    high = counted(triples(packs, low, shards))
    sums = pack_scores(packs, low.unionByName(high), n_words).groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("score").alias("score"))
    score = F.when(F.col("n_words") > 0, F.col("score"))
    return sums.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_words", F.round(score, 6).alias("score"), F.round(score / F.col("n_words"), 6).alias("mean_score"))


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
