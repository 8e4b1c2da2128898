"""Best-fit packing of token sequences, planned on the histogram of lengths.

Every document is its ids and the end mark. Documents longer than CAPACITY are cut into pieces of CAPACITY tokens;
only the last piece may be shorter. The number of pieces of each length is all that the plan needs: lengths are placed
in falling order, each into the sequences with the least room that still holds it, many equal sequences at once. A
planned slot says: of length L, the pieces of rank `first` to `last` stand at `offset` in the sequences from
`sequence` on. Pieces then take their slots by joining on their rank within their length.

The rank of a piece is its number within its task and length, counted while tokens are written, plus the pieces of
that length in the tasks before. So no task sees all pieces of a length, although a third of all may have the same.

The plan doesn't grow with the corpus: a length splits at most two runs of equal sequences and opens at most two, so
there are at most 4 * CAPACITY runs with at most CAPACITY pieces in a sequence.

Defined cases: a null or empty text is the end mark alone, one piece; a very long text is cut by tokens, never
by characters, and its ids are held in one worker while it is written; repeated rows and null doc_ids are documents of
their own; an empty table gives no rows; extra columns of documents are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import staged, table

CAPACITY = 2048
END = 0
#: Documents encoded together in a worker.
SLICE = 512
PIECES = "doc_id long, piece int, start long, length long, ids binary, task int, nth long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their ids (little-endian unsigned 32-bit); task and nth count equal lengths."""
    path = path or vocabulary_path()

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from tidemark.llm.word_tokens import word_end_coder

        coder, task, seen = word_end_coder(path), TaskContext.get().partitionId(), defaultdict(int)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
        names = ["doc_id", "piece", "start", "length", "ids", "task", "nth"]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                rows = []
                for doc, ids in zip(some.column(0).to_pylist(), coder.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    ids += END.to_bytes(4, "little")
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        size = len(part) // 4
                        rows.append((doc, k, start // 4, size, part, task, seen[size]))
                        seen[size] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(work, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first, last, sequence, offset): ranks first to last of a length stand in the sequences from sequence on."""
    room: dict[int, deque[tuple[int, int]]] = defaultdict(deque)  # room left: runs (first sequence, how many)
    slots, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for r in [*sorted(r for r in room if r >= length), capacity]:
            each = r // length
            while left and (r == capacity or room[r]):
                at, many = (opened, left) if r == capacity else room[r].popleft()
                took, layers = (min(many, left // each), each) if left >= each else (1, left)
                if r == capacity:
                    opened += took
                elif many > took:
                    room[r].appendleft((at + took, many - took))
                for k in range(layers):
                    slots.append((length, rank, rank + took - 1, at, capacity - r + k * length))
                    rank += took
                left -= took * layers
                if r > layers * length:
                    room[r - layers * length].append((at, took))
            if r in room and not room[r]:
                del room[r]
    return slots


def placed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of staged `pieces` with sequence_id and offset. The columns ids and others pass through."""
    spark: SparkSession = found.sparkSession
    tasks = found.groupBy("task", "length").agg(F.count(F.lit(1)).alias("many"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    tasks = staged(tasks.withColumn("before", F.coalesce(F.sum("many").over(before), F.lit(0))), "packing-tasks")
    counts = {r["length"]: r["many"] for r in tasks.groupBy("length").agg(F.sum("many").alias("many")).collect()}
    slots = plan(counts, capacity)

    # A length's ranks fall into as many buckets of equal width as it has slots, so that a piece meets few of them.
    of_length: dict[int, int] = defaultdict(int)
    for slot in slots:
        of_length[slot[0]] += 1
    width = {length: max(1, -(-counts[length] // of_length[length])) for length in counts}
    dealt = [(s[0], bucket, *s[1:]) for s in slots for bucket in range(s[1] // width[s[0]], s[2] // width[s[0]] + 1)]
    known = spark.createDataFrame(dealt, "length long, bucket long, first long, last long, sequence long, offset long")
    widths = spark.createDataFrame(list(width.items()), "length long, width long")

    own = tasks.join(F.broadcast(widths), "length").select("task", "length", "before", "width")  # at most CAPACITY widths
    ranked = found.join(own, ["task", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    ranked = ranked.withColumn("bucket", F.floor(F.col("rank") / F.col("width")))
    # The slots are broadcast: the plan's size has the bound above, whatever the corpus.
    met = ranked.join(F.broadcast(known), ["length", "bucket"]).where("rank between first and last")
    return met.select(*found.columns, (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id, length and ids of each packed sequence; a group has at most CAPACITY pieces and CAPACITY tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = rows.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
    ids = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return whole.select("sequence_id", "length", ids.alias("ids"))


def op12_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    found = pieces(table(spark, sf_dir, "documents"))
    found = staged(found.withColumn("ids_crc32", F.crc32("ids")), "packing-pieces")
    return placed(found.drop("ids")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
