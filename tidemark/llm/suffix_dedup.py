"""Suffix-array deduplication: every byte inside a string of LENGTH bytes that starts earlier too is removed.

Earlier means a smaller doc_id, or the same document and an earlier start; strings are judged on the input.

1. Where documents are read, each window of LENGTH bytes gets an anchor: of its GRAMS byte-grams the one of
   least hash, leftmost. Consecutive windows with one anchor form a run. Equal windows have equal anchors, so
   runs meet by the anchor's hash; a run equal to an earlier one of the batch is removed on the spot, so a hot
   passage is pre-aggregated before the shuffle.
2. Runs are shuffled by anchor hash and sorted. Of equal runs (by 128 bits of fingerprints) all but the first are
   removed. Where an anchor has different runs, the first of each kind is fetched from its text.
3. Where an anchor has more than HOT kinds of runs, its runs are cut into pieces of FINE windows at most, by the place of
   the anchor in them. A piece's anchor is what all its windows share, LENGTH - FINE + 1 bytes, and step 2 is done again.
4. What is left is dealt to shards, by anchor, or by window where a piece's anchor still has more than HOT kinds. A shard
   takes it in the order of doc_id and start, in batches of BATCH bytes. Each batch gets its suffix array
   (ranks of 8, 16, 32, 64 and LENGTH bytes by prefix doubling) and is merge-scanned against every level of the shard's
   index: a suffix is looked up in the level's order by comparing bytes, and one whose longest match there has
   LENGTH bytes is removed. What is new becomes a level; levels of like size merge, so sizes are geometric and a
   suffix is merged a logarithmic number of times. The levels stay for all batches of the shard.
5. Removals are gathered by document and cut out.

Suffixes that start no window of a run are not indexed: they belong to another shard. There are as many shards as
SHARD bytes of runs each take, so an index is bounded however large the input is.

Defined cases: a null text is empty; documents shorter than LENGTH stay whole; documents with a null doc_id are
neither indexed nor cut; of rows that repeat a doc_id each gets the removals found for that id, and later rows
count as starting with the others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, python_batches, staged, table

LENGTH = 100
#: Grams of a window, a power of two; a gram has LENGTH - GRAMS + 1 bytes.
GRAMS = 64
#: Bytes hashed at a time, and bytes of runs in one batch of the index.
PIECE = 1 << 20
BATCH = 1 << 20
#: Bytes of runs that one shard's index holds, about; kinds of runs of one anchor above which they are cut into pieces (kinds of
#: pieces: into single windows), and windows of a piece.
SHARD = 8 << 20
HOT = 1_000
FINE = 8


def _runs(texts: list[bytes], most: int = GRAMS):
    """Runs of the texts, of so many windows at most: text number, first window, windows, anchor hash and fingerprint of the run's bytes."""
    import numpy as np

    from tidemark.llm.rolling import Rolling

    roll = Rolling(b"".join(texts))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if total < LENGTH:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    least = roll.grams(LENGTH - GRAMS + 1)
    gram = least if most == GRAMS else roll.grams(LENGTH - most + 1)
    at = np.arange(len(least), dtype=np.int32)
    step = 1
    while step < GRAMS:
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    starts = ends - sizes
    doc = np.repeat(np.arange(len(texts)), np.maximum(sizes - LENGTH + 1, 0))
    if not len(doc):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    counts = np.maximum(sizes - LENGTH + 1, 0)
    window = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[doc]
    anchor = at[window]
    if most < GRAMS:  # the part of the text that the windows share whose anchor is as far from their start, by parts of so many windows
        anchor = anchor - (anchor - window) // most * most
    new = np.ones(len(doc), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(doc)))
    from_ = window[first]
    return doc[first], from_ - starts[doc[first]], n, gram[anchor[first]], roll.spans(from_, from_ + n + LENGTH - 1)


def runs_of(docs: DataFrame) -> DataFrame:
    """anchor, print, doc_id, start, windows of each run; a null anchor: it is removed."""
    python_batches(docs.sparkSession)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = [x.as_py().encode() for x in batch.column(1)]
            for lo, hi in pieces([len(x) for x in texts]):
                doc, start, n, anchor, mark = _runs(texts[lo:hi])
                if len(doc):
                    yield _given(anchor, mark, ids[lo:hi][doc], start, n)

    return docs.mapInArrow(work, RUN)


RUN = "anchor long, print long, doc_id long, start int, windows int"


def _given(anchor, mark, own, start, n):
    """A batch of RUN; of equal runs only the first keeps its anchor."""
    import numpy as np
    import pyarrow as pa

    order = np.lexsort((start, own, mark, anchor))
    own, start, n, anchor, mark = own[order], start[order], n[order], anchor[order], mark[order]
    again = np.zeros(len(own), bool)
    again[1:] = (anchor[1:] == anchor[:-1]) & (mark[1:] == mark[:-1])
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor.view(np.int64), mask=again), pa.array(mark.view(np.int64)), pa.array(own), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
        names=["anchor", "print", "doc_id", "start", "windows"])


def pieces_of(blobs: DataFrame, hot: DataFrame) -> DataFrame:
    """What runs_of gives, for pieces of FINE windows at most of the given runs (doc_id, start, windows)."""

    def work(batches):
        import numpy as np
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts, ids, first = [], [], []
            for own, blob, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = unpack(blob.as_py())
                for start, n in zip(*(runs.values.field(i).to_pylist() for i in (0, 1)), strict=True):
                    texts.append(data[start : start + n + LENGTH - 1])
                    ids.append(own)
                    first.append(start)
            ids, first = np.array(ids, np.int64), np.array(first, np.int64)
            for lo, hi in pieces([len(x) for x in texts]):
                run, start, n, anchor, mark = _runs(texts[lo:hi], FINE)
                if len(run):
                    yield _given(anchor, mark, ids[lo:hi][run], first[lo:hi][run] + start, n)

    lists = hot.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    return blobs.join(lists.hint("shuffle_hash"), "doc_id").select("doc_id", "blob", "runs").mapInArrow(work, RUN)


def pieces(sizes: list[int], most: int = PIECE):
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def compared_runs(runs: DataFrame) -> DataFrame:
    """doc_id, start, windows and anchor of runs: removed if the anchor is null, else to be compared by its bytes."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        held = None  # the last row: anchor, print, and its doc_id, start and windows if it is the first of its anchor
        out = lambda own, start, n, anchor, removed: pa.RecordBatch.from_arrays(
            [pa.array(own), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(anchor, pa.int64(), mask=removed)], names=["doc_id", "start", "windows", "anchor"])
        for batch in batches:
            if not batch.num_rows:
                continue
            nulls = np.asarray(batch.column(0).is_null())
            anchor, mark, own, start, n = (np.asarray(c.fill_null(0)) for c in batch.columns)
            if nulls.any():
                yield out(own[nulls], start[nulls], n[nulls], anchor[nulls], np.ones(nulls.sum(), bool))
                anchor, mark, own, start, n = (x[~nulls] for x in (anchor, mark, own, start, n))
                if not len(anchor):
                    continue
            if held is not None:  # the held row stands before this batch, but isn't given out again unless it is needed
                anchor, mark, own, start, n = (np.concatenate([[h], x]) for h, x in zip(held[:5], (anchor, mark, own, start, n), strict=True))
            new_anchor = np.ones(len(anchor), bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            again = np.zeros(len(anchor), bool)
            again[1:] = ~new_anchor[1:] & (mark[1:] == mark[:-1])
            group = np.cumsum(new_anchor) - 1
            kinds = np.bincount(group, ~again)
            need = ~again & (kinds[group] > 1)
            give = again | need
            if held is not None:
                # A group that began before: its first run was given out if a second kind came then.
                own_first = group == 0
                if held[6]:
                    need |= own_first & ~again
                    give |= own_first & ~again
                give[0] = need[0] and not held[6]
                if held[5] and not held[6] and need[0]:
                    yield out(np.array([held[7]]), np.array([held[8]]), np.array([held[9]]), np.array([anchor[0]]), np.zeros(1, bool))
                    give[0] = False
                elif held[5]:
                    give[0] = False
            if give.any():
                yield out(own[give], start[give], n[give], anchor[give], again[give])
            last = group == group[-1]
            many = bool(need[last].any()) or bool(held is not None and group[-1] == 0 and held[6])
            if held is not None and group[-1] == 0:
                first = held[7:10]
            else:
                i = int(np.flatnonzero(last)[0])
                first = (own[i], start[i], n[i])
            held = (anchor[-1], mark[-1], own[-1], start[-1], n[-1], True, many, *first)

    spread = F.coalesce(F.col("anchor"), F.xxhash64("doc_id", "start"))
    dealt = runs.repartition(partitions(runs.sparkSession), spread).sortWithinPartitions("anchor", "print", "doc_id", "start")
    return dealt.mapInArrow(work, "doc_id long, start int, windows int, anchor long")


def compressed(docs: DataFrame) -> DataFrame:
    def work(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(x.as_py().encode()) for x in batch.column(1)], pa.binary())], names=["doc_id", "blob"])

    return docs.mapInArrow(work, "doc_id long, blob binary")


def dealt(compared: DataFrame) -> DataFrame:
    """The runs to be compared (doc_id, start, windows, anchor) with single: whether their anchor has more than HOT kinds of runs."""
    wanted = compared.where("anchor is not null")
    kinds = wanted.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT).select("anchor", F.lit(True).alias("single"))
    flagged = wanted.join(kinds.hint("merge"), "anchor", "left").select("doc_id", "start", "windows", "anchor", F.coalesce("single", F.lit(False)).alias("single"))
    return staged(flagged, "dealt", by="single")


def indexed_bytes(runs: DataFrame) -> dict[bool, int]:
    """Bytes that dealt runs take in the index, by single."""
    n = F.col("windows").cast("long")
    return dict(runs.groupBy("single").agg(F.sum(F.when(F.col("single"), n * LENGTH).otherwise(n + LENGTH - 1))).collect())


def fetched(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """shard, doc_id, start and bytes of the wanted runs (doc_id, start, windows, anchor, single)."""

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        from tidemark.llm.rolling import Rolling

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            columns: list[list] = [[], [], [], []]

            def add(*row):
                for column, value in zip(columns, row, strict=True):  # noqa: B023
                    column.append(value)

            for own, blob, runs in zip(*batch.columns, strict=True):
                data, own = unpack(blob.as_py()), own.as_py()
                for r in runs.as_py():
                    run = data[r["start"] : r["start"] + r["windows"] + LENGTH - 1]
                    if not r["single"]:
                        add(r["anchor"], own, r["start"], run)
                        continue
                    for i, key in enumerate(Rolling(run).windows(np.arange(r["windows"]), LENGTH)[0].view(np.int64).tolist()):
                        add(key, own, r["start"] + i, run[i : i + LENGTH])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["shard", "doc_id", "start", "run"])

    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "windows", "single")).alias("runs"))
    return blobs.join(lists.hint("shuffle_hash"), "doc_id").select("doc_id", "blob", "runs").mapInArrow(work, "shard long, doc_id long, start int, run binary")


def suffix_ranks(data):
    """The rank of each position among all, by the LENGTH bytes that follow it (positions with fewer have no meaning): prefix doubling.

    A rank is the number of positions with a lower one, so a position that no other ties with keeps its rank and isn't sorted again.
    """
    import numpy as np

    rank, key = np.zeros(len(data), np.uint64), Suffixes.words(data)
    tied, size = np.arange(len(data)), 8
    while True:
        order = np.argsort(key)
        key = key[order]
        i = np.arange(len(key))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        low = np.maximum.accumulate(np.where(new, i, 0))
        if size > 8:  # from the first of those that tied before
            old = np.ones(len(key), bool)
            old[1:] = key[1:] >> np.uint64(32) != key[:-1] >> np.uint64(32)
            low = low - np.maximum.accumulate(np.where(old, i, 0)) + (key >> np.uint64(32)).astype(np.int64)
        tied = tied[order]
        rank[tied] = low
        tied = tied[~(new & np.append(new[1:], True))]
        if size == LENGTH or not len(tied):
            return rank
        step = min(size, LENGTH - size)
        ahead = np.zeros(len(tied), np.uint64)
        inside = tied + step < len(data)
        ahead[inside] = rank[tied[inside] + step]
        key = rank[tied] << np.uint64(32) | ahead
        size += step


class Suffixes:
    """Text with some of its suffixes in the order of the LENGTH bytes that follow: a batch's suffix array, or a level."""

    #: Offsets of the eight-byte words that cover LENGTH bytes.
    OFFSETS = [*range(0, LENGTH - 8, 8), LENGTH - 8]

    def __init__(self, data, order):
        self.data, self.order, self.first = data, order, self.words(data)

    @staticmethod
    def words(data):
        """At each position the next eight bytes as one number (behind the end: zero bytes)."""
        import numpy as np

        padded, out = np.concatenate([data, np.zeros(8, np.uint8)]), np.zeros(len(data), np.uint64)
        for k in range(8):
            out = out << np.uint64(8) | padded[k : k + len(data)]
        return out

    def place(self, other: Suffixes):
        """For the suffixes of another, in their order, the places where they belong in this order, and whether their match there has LENGTH bytes."""
        import numpy as np

        own, words = self.first[self.order], other.first[other.order]  # both in order
        low, high = np.searchsorted(own, words), np.searchsorted(own, words, "right")
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            less = self._compared(self.order[middle], other, other.order[open_]) < 0
            low[open_[less]], high[open_[~less]] = middle[less] + 1, middle[~less]
        same = np.zeros(len(low), bool)
        at = np.flatnonzero(low < len(self.order))
        same[at] = self._compared(self.order[low[at]], other, other.order[at]) == 0
        return low, same

    def _compared(self, own, other: Suffixes, others):
        """-1, 0 or 1: how LENGTH bytes from own places compare with those from the other's."""
        import numpy as np

        out, left = np.zeros(len(own), np.int8), np.arange(len(own))
        for offset in self.OFFSETS:
            x, y = self.first[own[left] + offset], other.first[others[left] + offset]
            differ = x != y
            out[left[differ]] = np.where(x[differ] < y[differ], -1, 1)
            left = left[~differ]
            if not len(left):
                break
        return out

    def merged(self, other: Suffixes) -> Suffixes:
        """One text and one order of both; no suffix of one is in the other."""
        import numpy as np

        place, _ = self.place(other)
        return Suffixes(np.concatenate([self.data, other.data]), np.insert(self.order, place, other.order + len(self.data)))


class IndexFamily:
    """Levels of suffixes; each is at least twice as large as the next."""

    def __init__(self):
        self.levels: list[Suffixes] = []

    def found(self, batch: Suffixes):
        """Which of the batch's suffixes, in their order, match one of some level over LENGTH bytes."""
        import numpy as np

        hit = np.zeros(len(batch.order), bool)
        for level in self.levels:
            left = np.flatnonzero(~hit)
            part = Suffixes.__new__(Suffixes)
            part.data, part.first, part.order = batch.data, batch.first, batch.order[left]
            hit[left] = level.place(part)[1]
        return hit

    def add(self, new: Suffixes) -> None:
        if not len(new.order):
            return
        while self.levels and len(self.levels[-1].order) < 2 * len(new.order):
            new = self.levels.pop().merged(new)
        self.levels.append(new)


def scanned(family: IndexFamily, runs: list[bytes]):
    """Scan a batch of runs against the family and add what is new to it: the removed windows, run by run, as a mask."""
    import numpy as np

    data = np.frombuffer(b"".join(runs), np.uint8)
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    begin, counts = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
    row = np.repeat(np.arange(len(runs)), counts)
    at = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    rank = suffix_ranks(data)[at]
    order = np.argsort(rank, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = rank[order[1:]] != rank[order[:-1]]
    distinct = order[first]  # of equal windows of the batch the earliest
    new = distinct[~family.found(Suffixes(data, at[distinct]))]
    removed = np.ones(len(at), bool)
    removed[new] = False
    # The text of runs without a new window isn't kept.
    used = np.zeros(len(runs), bool)
    used[row[new]] = True
    shift = begin - (np.cumsum(np.where(used, sizes, 0)) - np.where(used, sizes, 0))
    family.add(Suffixes(data[np.repeat(used, sizes)], at[new] - shift[row[new]]))
    return removed, row, at - begin[row]


def indexed(fetched_runs: DataFrame, shards: int) -> DataFrame:
    """doc_id, start, windows of removed windows, found by scanning batches against the index of their shard."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        family, rows, size = IndexFamily(), [], 0

        def close():
            removed, row, offset = scanned(family, [r[3] for r in rows])
            edge = np.flatnonzero(np.diff(np.concatenate([[False], removed, [False]]).astype(np.int8)))
            out: list[tuple] = []
            for a, b in zip(edge[0::2], edge[1::2], strict=True):  # a stretch of removed windows ends where its run does
                while a < b:
                    stop = min(b, int(np.searchsorted(row, row[a], side="right")))
                    out.append((rows[row[a]][1], rows[row[a]][2] + int(offset[a]), int(stop - a)))
                    a = stop
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "start", "windows"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(r)
                size += len(r[3])
                if size >= BATCH:
                    yield close()
                    rows, size = [], 0
        if rows:
            yield close()

    spread = fetched_runs.repartition(shards, "shard").sortWithinPartitions("doc_id", "start")
    return spread.mapInArrow(work, "doc_id long, start int, windows int")


def cut(blobs: DataFrame, removals: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary) of each document."""

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for blob, runs in zip(batch.column(1), batch.column(2), strict=True):
                data = unpack(blob.as_py())
                n, removed, spans = len(data), 0, 0
                if runs.is_valid and len(runs.values):
                    start, windows = (np.asarray(runs.values.field(i)).astype(np.int64) for i in (0, 1))
                    stop = np.minimum(start + windows + LENGTH - 1, n)
                    order = np.argsort(start, kind="stable")
                    start, stop = start[order], np.maximum.accumulate(stop[order])
                    new = np.concatenate([[True], start[1:] > stop[:-1]])
                    first, last = start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]
                    removed, spans = int((last - first).sum()), len(first)
                    edges = [0, *np.stack([first, last], 1).ravel().tolist(), n]
                    data = b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))
                for column, value in zip(columns, (n, removed, spans, hashlib.sha256(data).hexdigest(), data), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    lists = removals.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    joined = blobs.join(lists.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "blob", "runs")
    return joined.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    spark = docs.sparkSession
    python_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    usable = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    compared = staged(compared_runs(runs_of(usable)), "runs")
    blobs = compressed(rows)
    python_batches(spark, 20_000)
    known = blobs.where("doc_id is not null")
    wanted, removed = dealt(compared), compared.where("anchor is null")
    sizes = indexed_bytes(wanted)
    size = sizes.get(False, 0)
    if True in sizes:
        finer = staged(compared_runs(pieces_of(known, wanted.where("single"))), "pieces")
        hot = dealt(finer)
        size += sum(indexed_bytes(hot).values())
        wanted, removed = wanted.where("not single").unionByName(hot), removed.unionByName(finer.where("anchor is null"))
    more = staged(indexed(fetched(known, wanted), max(partitions(spark), -(-size // SHARD))), "removed")
    python_batches(spark)
    return cut(blobs, removed.select("doc_id", "start", "windows").unionByName(more))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("kept")
