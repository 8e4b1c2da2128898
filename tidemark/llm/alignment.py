"""Alignment of two tokenizers' tokens over the same bytes, by Spark's higher-order functions.

Python only tokenises: documents go in slices, and a slice gives its distinct words, each with its ids by A and by B
and the number of its shape, its distinct shapes (the byte ends of tokens by A and by B), and its documents as lists of
word numbers. No token of either tokenizer crosses a word, so groups lie within words. All else is higher-order
functions: `array_intersect` of the end arrays gives the cuts of a shape, and their places in both arrays cut its tokens
into groups, as numbers of tokens; the groups of a word take its ids at these, and the links of a group are all pairs of
its A and B ids. A document's groups and links are those of its words in order. Shapes are aligned and words get their
links once in a slice however often they occur.

How many documents hold a pair linked is counted over all documents; the counts go back to the documents' links
by a broadcast while they are at most BROADCAST pairs, and by a shuffled join beyond.

Defined cases: a null or empty text, or one whose bytes by A or B aren't those of a blank and the text (as where the
piece model's own sign for a blank stands in it), has no tokens, zeros and an empty groups_sha256. Special tokens'
strings are plain text. Repeated rows and null doc_ids are documents of their own. A very long text is a slice by
itself; a word of more than LONG_WORD tokens (text without blanks) is cut by sorting ends, not by searching them. An empty
table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import python_batches, staged, table

#: Characters and documents of a slice; a longer text is a slice of its own.
SLICE_CHARS, SLICE_DOCS = 1 << 21, 1024
LONG_WORD = 64
#: Distinct pairs of ids whose counts are broadcast.
BROADCAST = 1_000_000
TOKENS = "docs array<struct<doc_id:long,n_a:long,n_b:long,words:array<int>>>, words array<struct<a:array<int>,b:array<int>,shape:int>>, shapes array<struct<a_ends:array<int>,b_ends:array<int>>>"


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokenised(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Slices of documents: their word numbers, the tokens of the words, and the shapes of these. A document without tokens has null words."""
    path_a, path_b = paths or vocabulary_paths()

    def slices(batches):
        some, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_DOCS):
                part = batch.slice(at, SLICE_DOCS)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if some and (len(some) >= SLICE_DOCS or size + len(text or "") > SLICE_CHARS):
                        yield some
                        some, size = [], 0
                    some.append((doc, text))
                    size += len(text or "")
        if some:
            yield some

    def work(batches):
        import gc

        gc.disable()  # the slices' lists make no cycles, and are long to search for them
        try:
            yield from tokens_of(batches)
        finally:
            gc.enable()

    def tokens_of(batches):
        from collections import defaultdict
        from itertools import chain, count

        import numpy as np
        import pyarrow as pa

        from tidemark.llm.word_tokens import spread, two_coders

        coder = two_coders(path_a, path_b)

        def lists(values, lengths) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values.astype(np.int32)))

        def sides(packed):
            """All numbers of what the coder gives, the bounds of each, and for A and B the places and counts of ids."""
            flat = np.frombuffer(b"".join(packed), "<u4")
            bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4)))
            starts = bounds[:-1]
            in_a = flat[starts].astype(np.int64)
            in_b = np.diff(bounds) - 1 - in_a
            return flat, bounds, ((spread(starts + 1, in_a), in_a), (spread(starts + 1 + in_a, in_b), in_b))

        for some in slices(batches):
            words = [coder.words(text) for _, text in some]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            number = defaultdict(count().__next__)  # in order of occurrence
            chosen = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int32, int(sizes.sum()))
            of_doc = np.repeat(np.arange(len(some)), sizes)
            tokens, whole = coder.tokens(list(number)), sizes > 0
            if b"" in tokens:  # documents with such words have no tokens
                good = np.fromiter(map(bool, tokens), bool, len(tokens))
                whole[of_doc[~good[chosen]]] = False
                kept = whole[of_doc]
                chosen, of_doc, sizes = (np.cumsum(good, dtype=np.int32) - 1)[chosen[kept]], of_doc[kept], np.where(whole, sizes, 0)
                tokens = list(filter(None, tokens))
            numbers = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(chosen), mask=pa.array(~whole))
            flat, bounds, parts = sides(tokens)
            ends, of_words, totals = flat.copy(), [], []
            for (at, n), bytes_of in zip(parts, (coder.sizes_a, coder.sizes_b), strict=True):
                ids = flat[at]
                ends[at] = bytes_of[ids]
                of_words.append(lists(ids, n))
                totals.append(pa.array(np.bincount(of_doc, n[chosen] if len(chosen) else None, len(some)).astype(np.int64)))
            packed, bounds = ends.tobytes(), (4 * bounds).tolist()
            shape = defaultdict(count().__next__)  # of what tokens are, with bytes for ids
            of_words.append(pa.array(np.fromiter(map(shape.__getitem__, map(packed.__getitem__, map(slice, bounds, bounds[1:]))), np.int32, len(tokens))))
            flat, _, parts = sides(shape)
            of_shapes = []
            for at, n in parts:
                ends = np.concatenate(([0], np.cumsum(flat[at], dtype=np.int64)))
                of_shapes.append(lists(ends[1:] - np.repeat(ends[np.cumsum(n) - n], n), n))
            docs_ = pa.StructArray.from_arrays([pa.array([doc for doc, _ in some], pa.int64()), *totals, numbers], names=["doc_id", "n_a", "n_b", "words"])
            of_words, of_shapes = pa.StructArray.from_arrays(of_words, names=["a", "b", "shape"]), pa.StructArray.from_arrays(of_shapes, names=["a_ends", "b_ends"])
            columns = {"docs": docs_, "words": of_words, "shapes": of_shapes}
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns.values()], names=list(columns))

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(work, TOKENS)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _searched(shape: Column, cuts: Column) -> Column:
    return F.transform(cuts, lambda c: F.struct(F.array_position(shape["a_ends"], c).cast("int").alias("a"), F.array_position(shape["b_ends"], c).cast("int").alias("b")))


def _sorted(shape: Column) -> Column:
    """The same for words of many tokens: where an end of A and one of B stand together among all ends in order."""
    code = lambda ends, side: F.transform(ends, lambda e, i: F.shiftleft(e.cast("long"), 32) + i + side * 2**31)
    place = lambda x: x.bitwiseAND(2**31 - 1).cast("int") + 1
    def met(every: Column) -> Column:
        both = F.filter(F.sequence(F.lit(1), F.size(every) - 1), lambda k: F.shiftright(every[k - 1], 32) == F.shiftright(every[k], 32))
        return F.transform(both, lambda k: F.struct(place(every[k - 1]).alias("a"), place(every[k]).alias("b")))
    return _let(F.sort_array(F.concat(code(shape["a_ends"], 0), code(shape["b_ends"], 1))), met)


def _since(places: Column, k: Column, side: str) -> Column:
    """Tokens of a side before group k."""
    return F.when(k > 0, F.get(places, k - 1)[side]).otherwise(0)


def _placed(shape: Column, cuts: Column) -> Column:
    """places: for each group the tokens of a and b up to its end."""
    places = F.when(F.size(shape["a_ends"]) + F.size(shape["b_ends"]) > LONG_WORD, _sorted(shape)).otherwise(_searched(shape, cuts))
    return F.struct(places.alias("places"))


def _patterned(shape: Column, cuts: Column) -> Column:
    """n groups; single: each is one token of both sides; else links: pairs of token numbers (a << 32 | b), and order and marks: token numbers (of B as -1 - number) and what follows each in the text."""
    numbers = lambda g, side: F.sequence(g[side + "0"], g[side] - 1)
    of_b = lambda g: F.transform(numbers(g, "b"), lambda j: -1 - j)
    commas = lambda g, side: F.array_repeat(F.lit(","), g[side] - g[side + "0"] - 1)
    pairs = lambda g: F.flatten(F.transform(numbers(g, "a"), lambda i: F.transform(numbers(g, "b"), lambda j: _link(i, j))))
    marks = lambda g: F.concat(commas(g, "a"), F.array(F.lit("|")), commas(g, "b"), F.array(F.lit(";")))

    def made(groups: Column) -> Column:
        each = lambda of_one, of: F.flatten(F.transform(groups, lambda g: F.when((g["a"] - g["a0"] == 1) & (g["b"] - g["b0"] == 1), of_one(g)).otherwise(of(g))))
        links = each(lambda g: F.array(_link(g["a0"], g["b0"])), pairs)
        order = each(lambda g: F.array(g["a0"], -g["b"]), lambda g: F.concat(numbers(g, "a"), of_b(g)))
        return F.struct(F.size(groups).alias("n"), F.lit(False).alias("single"), links.alias("links"), order.alias("order"), each(lambda _: F.array(F.lit("|"), F.lit(";")), marks).alias("marks"))

    def from_to(places: Column) -> Column:
        return F.transform(places, lambda p, k: F.struct(_since(places, k, "a").alias("a0"), _since(places, k, "b").alias("b0"), p["a"].alias("a"), p["b"].alias("b")))

    n = F.size(cuts)
    none = F.struct(n.alias("n"), F.lit(True).alias("single"), F.array().cast("array<long>").alias("links"), F.array().cast("array<int>").alias("order"), F.array().cast("array<string>").alias("marks"))
    return F.when((n == F.size(shape["a_ends"])) & (n == F.size(shape["b_ends"])), none).otherwise(_let(_let(_placed(shape, cuts)["places"], from_to), made))


def _link(i: Column, j: Column) -> Column:
    return F.shiftleft(i.cast("long"), 32) + j


def _groups(word: Column, shape: Column) -> Column:
    places = shape["places"]
    return F.transform(places, lambda p, k: F.struct(*(F.slice(word[side], _since(places, k, side) + 1, p[side] - _since(places, k, side)).alias(side) for side in "ab")))


def _linked(word: Column, shape: Column) -> Column:
    """n, text (`a1,a2|b1;...`) and links (a << 32 | b) of a word's groups."""
    made = lambda t, links: F.struct(shape["n"].alias("n"), t.alias("text"), links.alias("links"))
    pairs = F.zip_with(word["a"], word["b"], lambda x, y: F.concat(x.cast("string"), F.lit("|"), y.cast("string")))
    token = lambda o: F.when(o < 0, F.get(word["b"], -1 - o)).otherwise(F.get(word["a"], o))
    text = F.rtrim(F.array_join(F.zip_with(shape["order"], shape["marks"], lambda o, mark: F.concat(token(o).cast("string"), mark)), ""), F.lit(";"))
    links = F.transform(shape["links"], lambda p: _link(F.get(word["a"], F.shiftright(p, 32).cast("int")), F.get(word["b"], p.bitwiseAND(2**31 - 1).cast("int"))))
    return F.when(shape["single"], made(F.array_join(pairs, ";"), F.zip_with(word["a"], word["b"], _link))).otherwise(made(text, links))


def grouped(tokens: DataFrame, shaped=_placed, of=_groups) -> DataFrame:
    """docs, and `groups`: of each word of the slice its groups (a: ids, b: ids), or what else `of` makes of the word and what `shaped` makes of its shape."""
    t = tokens.withColumn("cuts", F.transform("shapes", lambda s: F.array_intersect(s["a_ends"], s["b_ends"])))
    t = t.select("docs", "words", F.zip_with("shapes", "cuts", shaped).alias("shaped"))
    return t.select("docs", F.transform("words", lambda w: of(w, F.get(F.col("shaped"), w["shape"]))).alias("groups"))


def document_groups(made: DataFrame) -> DataFrame:
    """doc_id and groups (a: ids, b: ids) of each document, in order."""
    each = F.transform("docs", lambda d: F.struct(d["doc_id"].alias("doc_id"), F.flatten(F.transform(d["words"], lambda k: F.get(F.col("groups"), k))).alias("groups")))
    return made.select(F.inline(each))


def document_links(tokens: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, groups_sha256 and links, one for each pair of token occurrences."""
    def row(d: Column) -> Column:
        words = F.transform(d["words"], lambda k: F.get(F.col("groups"), k))  # once a document
        return _let(words, lambda w: F.struct(
            d["doc_id"].alias("doc_id"), d["n_a"].alias("n_a"), d["n_b"].alias("n_b"),
            F.coalesce(F.aggregate(w["n"], F.lit(0).cast("long"), lambda acc, n: acc + n), F.lit(0).cast("long")).alias("n_groups"),
            F.coalesce(F.sha2(F.array_join(w["text"], ";"), 256), F.lit("")).alias("groups_sha256"),
            F.coalesce(F.flatten(w["links"]), F.array().cast("array<long>")).alias("links")))

    return grouped(tokens, _patterned, _linked).select(F.inline(F.transform("docs", row)))


def link_counts(documents: DataFrame) -> DataFrame:
    """Staged link, a (its A id), held (documents with it), best (held is the highest of the A id)."""
    held = documents.select(F.explode(F.array_distinct("links")).alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("held"))
    held = held.withColumn("a", F.shiftright("link", 32).cast("int"))
    # An A id has at most as many pairs as B has ids.
    return staged(held.withColumn("best", (F.col("held") == F.max("held").over(W.partitionBy("a"))).cast("int")), "alignment-counts")


def scored(documents: DataFrame, counts: DataFrame) -> DataFrame:
    """Staged document_links with n_links, n_best and count_sum in place of links."""
    known = F.broadcast(counts) if counts.count() <= BROADCAST else counts.hint("merge")
    met = documents.select("row", F.explode("links").alias("link")).join(known.select("link", "held", "best"), "link")
    sums = met.groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("held").alias("count_sum"))
    rest = documents.select(*(c for c in documents.columns if c != "links"), F.size("links").cast("long").alias("n_links"))
    out = rest.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    python_batches(spark)
    made = document_links(tokenised(table(spark, sf_dir, "documents")))
    documents = staged(made.withColumn("row", F.monotonically_increasing_id()), "alignment-documents", "snappy")  # links hardly shrink further
    return scored(documents, link_counts(documents))
