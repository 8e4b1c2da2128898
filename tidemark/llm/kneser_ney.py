"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

For each language a trigram model of words is trained on all its trusted documents but the held-out half (by the hash
of doc_id), which sets the limits: no document, word or n-gram is left out, and no language with MIN_TRUSTED of each.
The pooled model, of all trusted documents, is trained if a document needs it.

Positions (a, b, c) are dealt by the hash of their middle word b into shards of some SHARD_BYTES of text, packed, a
block for each pack of documents and shard. All counts, contexts and interpolated probabilities of a position are in its
shard; what crosses shards, a word's own probability p1(c), is joined. A model is a table with a row of arrays for each
shard, in buckets of shards, so neither the driver nor a broadcast holds it and no round shuffles it.

All documents are scored the same way: a shard joins its blocks to its model and gives sums for each document and
the words c that no bigram knew, which meet p1 in a second join; the answers come together by pack. This goes in
rounds over parts of the documents, so that shuffle files don't stand side by side. A further table
holds, from the trained documents and all labelled toxic ones, how much more often a word occurs in toxic documents; a
document's evidence is its worst word.

A document is rejected if its mean negative log-probability, drawn to the language's median as by PRIOR_WORDS words
(so few words decide little), or its evidence is above the language's upper quantile of held-out trusted documents;
a language without enough trusted text takes the pooled model and its quantiles.

Words are runs of bytes between white space, with their case, known (like n-grams) by 48-bit hashes.
Defined cases: a null or empty text has no words,
perplexity null and is rejected; a null lang takes the pooled model; a null doc_id is scored like others; rows that
repeat count each; without labels there is no model, perplexity is null and everything with words is accepted; an
empty table gives no rows; extra columns, whatever their names, pass through `keep_good`; a text is never cut, so one
longer than a pack is a pack by itself.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bucketed, forgotten, packed, partitions, python_batches, staged, table, unpacked

#: Trusted documents that a language needs in each half for a model of its own.
MIN_TRUSTED = 20
#: Quantile of held-out trusted documents above which a document is rejected, for its mean and for its evidence.
QUANTILE = 0.995
#: Documents of the toxic ones that a word needs to be evidence.
TOXIC_DOCUMENTS = 3
POOL = "*"
PRIOR_WORDS = 20
PACK_BYTES = 6 << 20
SHARD_BYTES = 12 << 20
#: A shard has this much text at least, however many shuffle partitions there are, and a core some PACKERS partitions to pack at most while shards are few: blocks and words asked of other shards number packs by shards and shards by shards.
LEAST_SHARD_BYTES = 1 << 20
PACKERS = 8
#: Documents are scored in ROUNDS, as a round's shuffle takes some four times its Parquet; in fewer of so many bytes of text if there is little.
ROUND_BYTES = 8 << 20
ROUNDS = 8
#: Parts of the shards in which probabilities follow the counts, so that the counts of a part go as its tables come.
PARTS = 4
#: Behind each document's last word stands a position that ends with this mark, so that each word is a middle once.
END = 0
_STEPS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
BLOCKS = "pack long, salt long, shard long, a binary, b binary, c binary, docs binary"
COUNTS = "salt long, shard long, a binary, b binary, c binary, n binary, n3 array<double>, n2 array<double>, words binary, kinds binary"
#: One row for each shard of a model: sorted keys and log-values of trigrams, bigrams and contexts.
TABLES = ("p3", "p2", "b2", "b1")
TABLES_FIELD = "tables struct<" + ", ".join(f"{k}_keys: binary, {k}_values: binary" for k in TABLES) + ">"
PART = "pack long, kind int, shard long, docs binary, sums binary, n binary, unknown binary, evidence binary, words binary, packs binary"


def _press(x) -> bytes:
    """Numbers as their planes of bytes, compressed."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unpress(blob: bytes, kind):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _press_words(x) -> bytes:
    """48-bit numbers: six planes."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes())


def _unpress_words(blob: bytes):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view(np.uint64).ravel()


def _rises(x) -> bytes:
    import numpy as np

    return _press(np.diff(x, prepend=np.uint64(0)))


def _risen(blob: bytes):
    import numpy as np

    return np.cumsum(_unpress(blob, np.uint64), dtype=np.uint64)


def _gram(x, y, step: int = 0):
    import numpy as np

    from tidemark.llm.shingles import mixed

    return mixed(x * np.uint64(_STEPS[step]) + y) >> np.uint64(16)


def _words(texts, salts):
    """Salted hashes of all words, and how many each text has; the salt tells models apart."""
    import numpy as np

    from tidemark.llm.shingles import mixed, word_hashes

    c, counts = word_hashes(texts, cased=True)
    return mixed(c ^ np.repeat(salts, counts)) >> np.uint64(16), counts


def _positions(texts, salts):
    """a, b, c and the number of the text of each position."""
    import numpy as np

    from tidemark.llm.shingles import mixed

    words, counts = _words(texts, salts)
    has = counts > 0
    sizes = counts + has
    c = np.full(sizes.sum(), END, np.uint64)
    ends = np.cumsum(sizes)[has] - 1
    keep = np.ones(len(c), bool)
    keep[ends] = False
    c[keep] = words
    first = (np.cumsum(sizes) - sizes)[has]
    start = (mixed(salts + np.uint64(1)) >> np.uint64(16))[has]
    b = np.roll(c, 1)
    b[first] = start
    a = np.roll(b, 1)
    a[first] = start
    return a, b, c, np.repeat(np.arange(len(counts), dtype=np.uint32), sizes)


def shard_of(x, shards: int):
    """Shards are ranges of 48-bit hashes."""
    import numpy as np

    return ((x >> np.uint64(16)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _shard_column(key: Column, shards: int) -> Column:
    return F.shiftright(F.shiftright(key, 16) * shards, 32)


def _edges(*columns):
    """Where any of the columns begins a new value, and behind the last row."""
    import numpy as np

    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _table(schema: str, rows: list) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.Table.from_arrays([pa.array(list(x), kinds[kind]) for x, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _in_order(model, b, doc):
    """The order of model, b (48 bits) and doc: one sort of single numbers where their bits fit, which is some four times faster."""
    import numpy as np

    bits = [int(x.max()).bit_length() if len(x) else 0 for x in (model, doc)]
    if sum(bits) > 16:
        return np.lexsort((doc, b, model))
    return np.argsort(model << np.uint64(48 + bits[1]) | b << np.uint64(bits[1]) | doc)


def blocks(rows: DataFrame, shards: int, first_pack: int = 0) -> DataFrame:
    """rows (key, salt, text): the positions of each pack by model and shard, and a row with the pack's keys (in docs; its shard is below 0). Packs are a few for a shard however many partitions the rows have, so that there are no more blocks than the text needs."""
    python_batches(rows.sparkSession)
    rows = rows.coalesce(max(shards, PACKERS * rows.sparkSession.sparkContext.defaultParallelism))

    def work(batches):
        import numpy as np
        from pyspark import TaskContext

        pack, keys, salts, texts, size = first_pack + (TaskContext.get().partitionId() << 32), [], [], [], 0

        def out():
            salt = np.array(salts, np.int64).view(np.uint64)
            a, b, c, doc = _positions(texts, salt)
            kinds, which = np.unique(salt, return_inverse=True)
            model = which.astype(np.uint64)[doc]
            order = _in_order(model, b, doc)
            a, b, c, doc, model = a[order], b[order], c[order], doc[order], model[order]
            shard = shard_of(b, shards)
            at = np.append(np.flatnonzero(_edges(model, shard)), len(b)) if len(b) else np.zeros(1, np.int64)
            found = [(pack, int(kinds[model[i]].view(np.int64)), int(shard[i]), _press_words(a[i:j]), _rises(b[i:j]), _press_words(c[i:j]), _press(doc[i:j])) for i, j in zip(at[:-1], at[1:], strict=True)]
            found.append((pack, 0, -1 - (pack + (pack >> 32)) % shards, None, None, None, _press(np.array(keys, np.int64))))
            return _table(BLOCKS, found).to_batches()

        for batch in batches:
            for key, salt, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                keys.append(key)
                salts.append(salt)
                texts.append((text.as_py() or "").encode())
                size += len(texts[-1])
                if size >= PACK_BYTES:
                    yield from out()
                    pack, keys, salts, texts, size = pack + 1, [], [], [], 0
        if keys:
            yield from out()

    return rows.select("key", "salt", "text").mapInArrow(work, BLOCKS)


def salt_of(model: Column) -> Column:
    return F.xxhash64(model)


def trusted_documents(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All trusted documents of the languages that have enough, and of all for the pooled model if a document needs it (model, doc_id, key, text, held_out); all toxic ones of these models; and the staged table of both."""
    said = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    said = said.select("id", (F.col("toxic") == 1).alias("toxic"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("trusted")).where("toxic or trusted")
    said = said.withColumn("held_out", F.xxhash64("id") % 2 == 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "lang", document_key().alias("key"), "text")
    halves = rows.select("id", "lang").join(said.where("trusted"), "id").groupBy("lang").agg(F.count_if("held_out").alias("held"), F.count_if(~F.col("held_out")).alias("taught"))
    own = staged(halves.where((F.least("held", "taught") >= MIN_TRUSTED) & F.col("lang").isNotNull()).select("lang"), "languages")
    pool = not rows.join(F.broadcast(own), "lang", "left_anti").isEmpty()  # one row a language
    labelled = rows.join(said, "id").join(F.broadcast(own.withColumn("model", F.col("lang"))), "lang", "left")
    models = F.array_compact(F.array("model", F.lit(POOL))) if pool else F.array_compact(F.array("model"))
    labelled = staged(labelled.select("id", "key", "text", "held_out", "toxic", F.explode(models).alias("model")).withColumnRenamed("id", "doc_id"), "labelled")
    return labelled.where("not toxic").select("model", "doc_id", "key", "text", "held_out"), labelled.where("toxic").select("model", "doc_id", "text"), labelled


def _discounts(n1_to_n4: list[Column]) -> list[Column]:
    """The three discounts from the counts of counts."""
    n = [F.greatest(F.lit(1.0), x.cast("double")) for x in n1_to_n4]
    y = n[0] / (n[0] + 2 * n[1])
    return [F.least(F.lit(i - 0.01), F.greatest(F.lit(0.05 * i), F.lit(float(i)) - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]


def _counts(taught: DataFrame) -> DataFrame:
    """A row for each model and shard: its different trigrams, sorted by b, c and a, their counts, the counts of counts, and how many b stand before each c."""

    def work(rows):
        import numpy as np

        a, c = (np.concatenate([_unpress_words(x.as_py()) for x in rows.column(k)]) for k in ("a", "c"))
        b = np.concatenate([_risen(x.as_py()) for x in rows.column("b")])
        a, b, c = a[c != END], b[c != END], c[c != END]
        order = np.lexsort((a, c, b))
        a, b, c = a[order], b[order], c[order]
        at = np.flatnonzero(_edges(b, c, a)) if len(a) else np.zeros(0, np.int64)
        n = np.diff(np.append(at, len(a)))
        a, b, c = a[at], b[at], c[at]
        pairs = np.flatnonzero(_edges(b, c)) if len(a) else at
        n2 = np.diff(np.append(pairs, len(a)))
        words, kinds = np.unique(c[pairs], return_counts=True)
        of = lambda x: [float((x == i).sum()) for i in (1, 2, 3, 4)]
        row = rows.column("salt")[0].as_py(), rows.column("shard")[0].as_py(), _press_words(a), _rises(b), _press_words(c), _press(n), of(n), of(n2), _rises(words), _press(kinds)
        return _table(COUNTS, [row])

    return taught.groupBy("salt", "shard").applyInArrow(work, COUNTS)


def _exploded(counts: DataFrame) -> DataFrame:
    def work(batches):
        import numpy as np

        for batch in batches:
            for salt, shard, words, kinds in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                c, n = _risen(words).view(np.int64), _unpress(kinds, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), salt)), pa.array(np.full(len(c), shard)), pa.array(c), pa.array(n)], names=["salt", "shard", "c", "n"])

    return counts.select("salt", "shard", "words", "kinds").mapInArrow(work, "salt long, shard long, c long, n long")


def _interpolated(counts: DataFrame, known: DataFrame) -> DataFrame:
    """shard and tables: keys and log-values, from the counts with their discounts d3 and d2 and the p1 (c, p) of each shard's words."""
    schema = "shard long, " + ", ".join(f"{k}_keys binary, {k}_values binary" for k in TABLES)

    def work(left, right):
        import numpy as np

        salts, all_words, all_p = right.column("salt").to_numpy(), right.column("c").to_numpy().view(np.uint64), right.column("p").to_numpy()
        return _table(schema, [of_model(row, all_words[salts == row["salt"]], all_p[salts == row["salt"]]) for row in left.to_pylist()])

    def of_model(row, words, p):
        import numpy as np

        a, c = _unpress_words(row["a"]), _unpress_words(row["c"])
        b, n = _risen(row["b"]), _unpress(row["n"], np.int64)
        d3, d2 = np.array(row["d3"]), np.array(row["d2"])
        order = np.argsort(words)
        words, p = words[order], p[order]
        new = _edges(b, c)
        pair, at = np.cumsum(new) - 1, np.flatnonzero(new)
        n2, b2, c2 = np.bincount(pair), b[at], c[at]
        context = np.cumsum(_edges(b2)) - 1
        off2 = d2[np.minimum(n2, 3) - 1]
        total2 = np.bincount(context, n2)
        free2 = np.bincount(context, off2) / total2
        p2 = (n2 - off2) / total2[context] + free2[context] * p[np.searchsorted(words, c2)]
        ab, which = np.unique(_gram(a, b), return_inverse=True)
        off3 = d3[np.minimum(n, 3) - 1]
        total3 = np.bincount(which, n)
        free3 = np.bincount(which, off3) / total3
        p3 = (n - off3) / total3[which] + free3[which] * p2[pair]
        out = [row["shard"]]
        for keys, values in ((_gram(_gram(a, b), c, 1), p3), (_gram(b2, c2), p2), (ab, free3), (b2[_edges(b2)], free2)):
            order = np.argsort(keys)
            out += [_rises(keys[order]), _press(np.log(values[order]).astype(np.float32))]
        return out

    # By shard, as the model's buckets are: a task then writes few of them.
    return counts.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(work, schema)


def train(trusted: DataFrame, shards: int | None = None, spent: DataFrame | None = None) -> DataFrame:
    """The model of the trusted documents that aren't held out: model, kind, shards, shard, key, value and tables. Kinds are unk (value: log-probability of an unknown word), p1 (key and value of a word) and shard (the tables). The staged table `spent`, which `trusted` reads, is removed once all is counted."""
    shards = shards or partitions(trusted.sparkSession)
    taught = trusted.where("not held_out").select(F.lit(0).cast("long").alias("key"), salt_of(F.col("model")).alias("salt"), "text")
    part = F.pmod("shard", F.lit(PARTS)).cast("int")
    counts = staged(_counts(blocks(taught, shards).where("shard >= 0")).withColumn("part", part), "counts", by="part")
    names = staged(trusted.select("model", salt_of(F.col("model")).alias("salt")).distinct(), "model")
    forgotten(*([spent] if spent is not None else []))
    words = staged(_exploded(counts).withColumn("part", part), "words")
    c1 = words.groupBy("salt", "c").agg(F.sum("n").alias("n"))
    sums = c1.groupBy("salt").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), *[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count_if(F.col("n") >= 3).alias("more"))
    sums = sums.withColumn("d", F.array(*_discounts([F.col(f"n{i}") for i in (1, 2, 3, 4)])))
    free = (F.col("d")[0] * F.col("n1") + F.col("d")[1] * F.col("n2") + F.col("d")[2] * F.col("more")) / F.col("total")
    sums = staged(sums.select("salt", "total", "d", (free / (F.col("kinds") + 1)).alias("floor")), "model")
    p1 = c1.join(F.broadcast(sums), "salt")  # one row a model
    p1 = staged(p1.select("salt", "c", ((F.col("n") - F.col("d")[F.least("n", F.lit(3)).cast("int") - 1]) / F.col("total") + F.col("floor")).alias("p")), "model")
    known = staged(words.join(p1.hint("merge"), ["salt", "c"]).select("salt", "shard", "c", "p", "part"), "words", by="part")
    forgotten(words)
    each = staged(counts.groupBy("salt").agg(*[F.array(*_discounts([F.sum(F.col(f"n{k}")[i]) for i in range(4)])).alias(f"d{k}") for k in (3, 2)]), "model")
    unknown = sums.join(F.broadcast(names), "salt").select("model", F.lit("unk").alias("kind"), F.ln("floor").cast("float").alias("value"))  # one row a model
    single = p1.select(F.lit("p1").alias("kind"), _shard_column(F.col("c"), shards).alias("shard"), F.col("c").alias("key"), F.ln("p").cast("float").alias("value"))
    fields = "model string, kind string, shards int, shard long, key long, value float, " + TABLES_FIELD
    whole = lambda rows: rows.withColumn("shards", F.lit(shards)).select(*[F.col(n) if n in [*rows.columns, "shards"] else F.lit(None).cast(kind).alias(n) for n, kind in (x.split(" ", 1) for x in fields.split(", ", 6))])

    def parts():
        yield whole(unknown)
        yield whole(single.repartition(partitions(trusted.sparkSession), "shard"))
        for k in range(PARTS):
            some = counts.where(F.col("part") == k).join(F.broadcast(each), "salt")  # one row a model
            tables = _interpolated(some, known.where(F.col("part") == k).select("salt", "shard", "c", "p"))
            yield whole(tables.select(F.lit("shard").alias("kind"), "shard", F.struct(*[c for c in tables.columns if c != "shard"]).alias("tables")))
            for of_part in (counts, known):
                forgotten(of_part, folder=f"part={k}")

    model = bucketed(parts(), "model", "shard")
    forgotten(counts, known, sums, p1, each, names)
    return model


def words_held(rows: DataFrame) -> DataFrame:
    """model and c: the different words of each document."""
    python_batches(rows.sparkSession)

    def work(batches):
        import numpy as np

        for batch in batches:
            c, counts = _words([(x.as_py() or "").encode() for x in batch.column(2)], batch.column(1).to_numpy().view(np.uint64))
            doc = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((c, doc))
            c, doc = c[order], doc[order]
            new = _edges(c, doc) if len(c) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[new])), pa.array(c[new].view(np.int64))], names=["model", "c"])

    return rows.select("model", salt_of(F.col("model")).alias("salt"), "text").mapInArrow(work, "model string, c long")


def toxic_words(trusted: DataFrame, toxic: DataFrame) -> DataFrame:
    """key and value: of words in TOXIC_DOCUMENTS toxic documents or more, the logarithm of how much more often a toxic document has them than a trusted one."""
    held = lambda rows: words_held(rows).groupBy("model", "c").agg(F.count("*").alias("n"))
    sizes = lambda rows, name: rows.groupBy("model").agg(F.count("*").alias(name))
    good = trusted.where("not held_out")
    both = held(toxic).where(F.col("n") >= TOXIC_DOCUMENTS).withColumnRenamed("n", "bad").join(held(good), ["model", "c"], "left")
    both = both.join(F.broadcast(sizes(toxic, "toxic_documents")), "model").join(F.broadcast(sizes(good, "documents")), "model")  # one row a model
    share = lambda n, total: (F.coalesce(F.col(n), F.lit(0)) + 0.5) / (F.col(total) + 1)
    return staged(both.select(F.col("c").alias("key"), F.log(share("bad", "toxic_documents") / share("n", "documents")).cast("float").alias("value")).where("value > 0"), "toxic-words")


def _found(keys, values, asked):
    """Values of the asked keys, and which are known; keys are sorted."""
    import numpy as np

    value, known = np.zeros(len(asked), np.float32), np.zeros(len(asked), bool)
    if len(keys):
        order = np.argsort(asked)  # searching in order stays in the processor's cache
        asked = asked[order]
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        known[order] = hit = keys[at] == asked
        value[order[hit]] = values[at[hit]]
    return value, known


def _sums(pack, doc, value, n, unknown, evidence) -> list:
    """Rows of PART: what each document of each pack has, from its positions."""
    import numpy as np

    if not len(pack):
        return []
    run = np.flatnonzero(_edges(pack))
    which = np.unique(pack[run], return_inverse=True)[1].astype(np.uint64)
    order = np.argsort(np.repeat(which, np.diff(np.append(run, len(pack)))) << np.uint64(32) | doc)
    pack, doc = pack[order], doc[order]
    at = np.flatnonzero(_edges(pack, doc))
    add = lambda x: np.add.reduceat(x[order], at)
    s, n, u, e = add(value.astype(np.float64)), add(n.astype(np.int64)).astype(np.uint32), add(unknown.astype(np.int64)).astype(np.uint32), np.maximum.reduceat(evidence[order], at)
    pack, doc = pack[at], doc[at]
    cut = np.append(np.flatnonzero(_edges(pack)), len(pack))
    return [(int(pack[i]), 0, None, _press(doc[i:j]), _press(s[i:j]), _press(n[i:j]), _press(u[i:j]), _press(e[i:j]), None, None) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _known_of_shards(asked: DataFrame, tables: DataFrame, shards: int) -> DataFrame:
    """Rows of PART: sums of what the shard's model knows (kind 0), words that no bigram knew, by their shard (kind 1), and keys (kind 2). asked: blocks, and the key and value of the shard's toxic words."""

    def work(left, right):
        import numpy as np
        import pyarrow.compute as pc

        worst = left.filter(pc.is_valid(left.column("key"))).sort_by("key")
        rows = left.filter(pc.is_null(left.column("key"))).to_pylist()
        out = [(r["pack"], 2, None, r["docs"], None, None, None, None, None, None) for r in rows if r["shard"] < 0]
        rows = [r for r in rows if r["shard"] >= 0]
        if not rows:
            return _table(PART, out)
        held, value = right.column("tables").to_pylist(), {}
        for k in TABLES:
            keys = np.concatenate([np.zeros(0, np.uint64), *(_risen(t[f"{k}_keys"]) for t in held)])
            order = np.argsort(keys)
            value[k] = keys[order], np.concatenate([np.zeros(0, np.float32), *(_unpress(t[f"{k}_values"], np.float32) for t in held)])[order]
        worst = worst.column("key").to_numpy().view(np.uint64), worst.column("value").to_numpy()
        a, c = (np.concatenate([_unpress_words(r[k]) for r in rows]) for k in ("a", "c"))
        b, doc = np.concatenate([_risen(r["b"]) for r in rows]), [_unpress(r["docs"], np.uint32) for r in rows]
        pack, doc = np.repeat(np.array([r["pack"] for r in rows]), [len(x) for x in doc]), np.concatenate(doc)
        words, s = c != END, np.zeros(len(c), np.float32)
        rest = np.flatnonzero(words)
        ab = _gram(a[rest], b[rest])
        s[rest], known = _found(*value["p3"], _gram(ab, c[rest], 1))
        rest, ab = rest[~known], ab[~known]  # shorter n-grams are asked where no longer one is known
        low, known = _found(*value["p2"], _gram(b[rest], c[rest]))
        low[~known] = _found(*value["b1"], b[rest[~known]])[0]
        s[rest] = _found(*value["b2"], ab)[0] + low
        run = _edges(b)
        evidence = _found(*worst, b[run])[0][np.cumsum(run) - 1]
        out += _sums(pack, doc, s, words, np.zeros(len(s), bool), evidence)
        rest = rest[~known]
        rest = rest[np.argsort(c[rest])]
        if len(rest):
            at = shard_of(c[rest], shards)
            cut = np.append(np.flatnonzero(_edges(at)), len(at))
            out += [(None, 1, int(at[i]), _press(doc[rest[i:j]]), None, None, None, None, _rises(c[rest[i:j]]), _press(pack[rest[i:j]])) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        return _table(PART, out)

    return asked.groupBy("shard").cogroup(tables.groupBy("shard")).applyInArrow(work, PART)


def _known_of_words(rest: DataFrame, single: DataFrame) -> DataFrame:
    """Rows of PART (kind 0) for the words that no bigram knew, from the shard's p1."""

    def work(left, right):
        import numpy as np

        if not left.num_rows:
            return _table(PART, [])
        keys, values = right.column("key").to_numpy().view(np.uint64), right.column("value").to_numpy()
        order = np.argsort(keys)
        c = np.concatenate([_risen(x.as_py()) for x in left.column("words")])
        doc = np.concatenate([_unpress(x.as_py(), np.uint32) for x in left.column("docs")])
        pack = np.concatenate([_unpress(x.as_py(), np.int64) for x in left.column("packs")])
        p, known = _found(keys[order], values[order], c)
        return _table(PART, _sums(pack, doc, p, np.zeros(len(c), bool), ~known, np.zeros(len(c), np.float32)))

    return rest.groupBy("shard").cogroup(single.groupBy("shard")).applyInArrow(work, PART)


def _by_document(parts: DataFrame) -> DataFrame:
    """key, n_words, known, unknown and evidence of each pack's documents with words."""
    schema = "key long, n_words long, known double, unknown long, evidence double"

    def work(rows):
        import numpy as np

        rows = rows.to_pylist()
        keys = np.concatenate([_unpress(r["docs"], np.int64) for r in rows if r["kind"] == 2])
        n, known, unknown, evidence = (np.zeros(len(keys)) for _ in range(4))
        for r in rows:
            if r["kind"] == 0:
                doc = _unpress(r["docs"], np.uint32)
                known[doc] += _unpress(r["sums"], np.float64)
                n[doc] += _unpress(r["n"], np.uint32)
                unknown[doc] += _unpress(r["unknown"], np.uint32)
                evidence[doc] = np.maximum(evidence[doc], _unpress(r["evidence"], np.float32))
        has = n > 0
        return pa.table({"key": keys[has], "n_words": n[has].astype(np.int64), "known": known[has], "unknown": unknown[has].astype(np.int64), "evidence": evidence[has]})

    return parts.groupBy("pack").applyInArrow(work, schema)


def scores(rows: DataFrame, model: DataFrame, toxic: DataFrame, rounds: int = 1) -> DataFrame:
    """rows (key, salt, text) give key, n_words, known (sum of log-probabilities), unknown (words without one) and evidence, for texts with words."""
    spark = rows.sparkSession
    first = model.where("kind = 'unk'").select("shards").first()
    shards = first["shards"] if first else partitions(spark)
    tables = model.where("kind = 'shard'").select("shard", "tables")
    worst = toxic.select(_shard_column(F.col("key"), shards).alias("shard"), "key", "value")
    single = model.where("kind = 'p1'").select("shard", "key", "value")
    found = []
    for k in range(rounds):
        some = rows.where(F.pmod("key", F.lit(rounds)) == k)
        parts = staged(_known_of_shards(blocks(some, shards, k << 52).unionByName(worst, allowMissingColumns=True), tables, shards), "parts")
        rest = _known_of_words(parts.where("kind = 1").select("shard", "docs", "words", "packs"), single)
        # Rows that repeat have equal scores.
        each = _by_document(parts.where("kind != 1").unionByName(rest)).groupBy("key")
        found.append(staged(each.agg(F.max("n_words").alias("n_words"), F.avg("known").alias("known"), F.avg("unknown").alias("unknown"), F.max("evidence").alias("evidence")), "scores"))
        forgotten(parts)
    return reduce(DataFrame.unionByName, found)


def _shrunk(n, nll, median):
    return (nll + PRIOR_WORDS * median) / (n + PRIOR_WORDS)


def thresholds(found: DataFrame, held: DataFrame, model: DataFrame) -> DataFrame:
    """From the scores of held-out documents (key, model): model, floor (log-probability of an unknown word), median, and limits of the drawn mean and of evidence."""
    floor = model.where("kind = 'unk'").select("model", F.col("value").cast("double").alias("floor"))  # one row a model
    own = found.join(held.select("key", "model").distinct(), "key").join(F.broadcast(floor), "model")
    own = staged(own.select("model", "floor", "n_words", (-F.col("known") - F.col("unknown") * F.col("floor")).alias("nll"), "evidence"), "held-out")
    median = own.groupBy("model").agg(F.percentile(F.col("nll") / F.col("n_words"), 0.5).alias("median"), F.count("*").alias("n")).where(F.col("n") >= MIN_TRUSTED)
    drawn = own.join(F.broadcast(median), "model").withColumn("mean", _shrunk(F.col("n_words"), F.col("nll"), F.col("median")))
    return drawn.groupBy("model").agg(F.first("floor").alias("floor"), F.first("median").alias("median"), F.percentile("mean", QUANTILE).alias("limit"), F.percentile("evidence", QUANTILE).alias("most_evidence"))


def shards_for(size: int, most: int) -> int:
    """Shards for so many bytes of text: as many as there are shuffle partitions, unless the text is too little or too much for that."""
    return max(1, min(most, size // LEAST_SHARD_BYTES), -(-size // SHARD_BYTES))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """key (of a document: the hash of doc_id, lang and text), n_words, perplexity, evidence and kept; a row for each different document with words."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    trusted, toxic_docs, labelled = trusted_documents(docs, labels)
    # Held-out documents are scored among all; for the pooled model they are scored once more.
    pooled = trusted.where(F.col("held_out") & (F.col("model") == POOL)).select(F.xxhash64(F.lit("held out"), "model", "doc_id", "key").alias("key"), "model", "text")
    held = trusted.where(F.col("held_out") & (F.col("model") != POOL)).select("key", "model").unionByName(pooled.select("key", "model"))
    held, pooled = staged(held, "held-out"), staged(pooled, "held-out")
    toxic = toxic_words(trusted, toxic_docs)
    model = train(trusted, shards_for(size, partitions(spark)), spent=labelled)
    names = model.where("kind = 'unk'").select("model")
    of_lang = F.broadcast(names.where(F.col("model") != POOL).withColumn("lang", F.col("model")))  # one row a language
    rows = docs.select(document_key().alias("key"), "lang", "text").join(of_lang, "lang", "left").select("key", F.coalesce("model", F.lit(POOL)).alias("model"), "text")
    rounds = max(1, min(ROUNDS, size // ROUND_BYTES))
    found = scores(rows.unionByName(pooled).withColumn("salt", salt_of(F.col("model"))), model, toxic, rounds)
    limits = staged(thresholds(found, held, model), "limits")
    of_model = rows.select("key", "model").distinct()
    found = found.join(of_model.hint("shuffle_hash"), "key").join(F.broadcast(limits), "model", "left")  # one row a model
    nll = -F.col("known") - F.col("unknown") * F.col("floor")
    mean = _shrunk(F.col("n_words"), nll, F.col("median"))
    kept = F.coalesce((mean <= F.col("limit")) & (F.col("evidence") <= F.col("most_evidence")), F.lit(True))
    return found.select("key", "n_words", F.exp(nll / F.col("n_words")).alias("perplexity"), "evidence", kept.alias("kept"))


def document_key() -> Column:
    return F.xxhash64("doc_id", "lang", "text")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, n_words, perplexity, evidence, kept."""
    docs = docs.select("doc_id", "lang", "text")
    rows = docs.select(document_key().alias("key"), "doc_id", "lang")
    both = rows.join(judged(docs, labels).hint("shuffle_hash"), "key", "left")
    return both.select("doc_id", "lang", F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"), "perplexity", "evidence", F.coalesce("kept", F.lit(False)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    good = judged(docs.select("doc_id", "lang", "text"), labels).where("kept").select("key")
    rows = packed(docs).withColumn("key", F.xxhash64("__row.doc_id", "__row.lang", "__row.text"))
    return unpacked(rows.join(good.hint("shuffle_hash"), "key", "left_semi"), docs.columns)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
