"""Packing, repair and token alignment against brute force on small fixtures."""

import hashlib
import heapq
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import duckdb
import pytest

from tests.compare import spark_rows
from tidemark.llm import alignment, html_main, packing, registry, repair, word_tokens

FOLDER = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, task string, length string, ids string, rank string, row string"


def docs_of(limit=150):
    return [tuple(r) for r in duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY doc_id LIMIT {limit}").fetchall()]


def odd_texts(n=400):
    rng = random.Random(5)
    signs = list("abé ñ  \n\t\r\x1c\xa0 .,!'’12_①ﬁ́▁日本😀<|endoftext|>ABİßſ\x00\x85​")
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(n)]


ODD = [(9001, None), (9002, ""), (9003, " "), (9004, "a <|endoftext|> b<|endoftext|>c"), (9005, "x. y., z.. 3.5 d'll  e\n\nf "), (9006, "word " * 9000), (9007, "▁ x"), (9008, "q" * 3000), (None, "a b"), (None, "a b"), (1, "again")]


# tokens
def test_word_end_coder_equals_whole_texts(monkeypatch):
    monkeypatch.setattr(word_tokens, "CACHE", 500)
    coder = word_tokens.WordEndCoder(packing.vocabulary_path())
    texts = [t for _, t in docs_of()] + odd_texts()
    for at in range(0, len(texts), 60):
        some = texts[at : at + 60]
        for text, ids in zip(some, coder.encode(some), strict=True):
            assert array("I", ids).tolist() == coder.coder.encode(text, add_special_tokens=False).ids
    assert len(coder.known) < 5000


def bytes_of_tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.vocabulary_paths()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    bs = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(x): x for x in bs} | {chr(256 + k): x for k, x in enumerate(sorted(set(range(256)) - set(bs)))}
    of_a = lambda i: bytes(table[c] for c in a.id_to_token(i))
    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()
    return a, b, of_a, of_b


def aligned_by_definition(docs):
    a, b, of_a, of_b = bytes_of_tokens()
    made, held = [], Counter()
    for doc, text in docs:
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        pa, pb = [of_a(i) for i in ia], [of_b(i) for i in ib]
        if not text or b"".join(pa) != (" " + text).encode() or b"".join(pb) != (" " + text).encode():
            made.append((doc, [], [], [], []))
            continue
        groups, ka, kb, na, nb = [([], [])], 0, 0, 0, 0
        while ka < len(ia) or kb < len(ib):
            if na <= nb and ka < len(ia):
                groups[-1][0].append(ia[ka])
                na += len(pa[ka])
                ka += 1
            else:
                groups[-1][1].append(ib[kb])
                nb += len(pb[kb])
                kb += 1
            if na == nb:
                groups.append(([], []))
        groups.pop()
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        held.update(set(links))
        made.append((doc, ia, ib, groups, links))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for doc, ia, ib, groups, links in made:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc, len(ia), len(ib), len(groups), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), digest))
    return sorted(out, key=repr)


# 11
@pytest.mark.parametrize("case", ["as it is", "sorted ends", "joined counts", "small slices"])
def test_alignment(spark, monkeypatch, case):
    monkeypatch.setattr(alignment, "LONG_WORD", 0 if case == "sorted ends" else alignment.LONG_WORD)
    monkeypatch.setattr(alignment, "BROADCAST", 0 if case == "joined counts" else alignment.BROADCAST)
    if case == "small slices":
        monkeypatch.setattr(alignment, "SLICE_CHARS", 50)
        monkeypatch.setattr(word_tokens, "CACHE", 100)
    docs = docs_of(40) + ODD + list(enumerate(odd_texts(250), 20_000)) + [(30_000, "日本語のテキスト" * 300), (30_001, "nospace" * 2000)]
    frame = spark.createDataFrame([(*d, "x", "y", "z", "r", "o") for d in docs], DOC).repartition(3)
    documents = alignment.staged(alignment.document_links(alignment.tokenised(frame)).withColumn("row", alignment.F.monotonically_increasing_id()), "test-alignment")
    got = sorted((tuple(r) for r in alignment.scored(documents, alignment.link_counts(documents)).collect()), key=repr)
    assert got == aligned_by_definition(docs)


def test_alignment_groups_of_documents(spark):
    made = alignment.document_groups(alignment.grouped(alignment.tokenised(spark.createDataFrame([(1, "Unbelievable tokens"), (2, None)], "doc_id long, text string"))))
    got = {r.doc_id: r.groups and [(list(g.a), list(g.b)) for g in r.groups] for r in made.collect()}
    ia, ib, groups = aligned_groups("Unbelievable tokens")
    assert got == {1: groups, 2: None} and sum((g[0] for g in groups), []) == ia and sum((g[1] for g in groups), []) == ib


def test_words_of_parts_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(word_tokens, "CACHE", 60)
    coder = word_tokens.TwoCoders(*alignment.vocabulary_paths())
    a, b, *_ = bytes_of_tokens()
    rng, asked = random.Random(3), []
    stems, marks = ["Eau", "eleôr", "onesbleing", "the", "x", "d", "Anß", "Kn"], [".", ",", "!!", "###", "$%&*", "...", ";:", "?"]
    encode = coder._encode
    monkeypatch.setattr(coder, "_encode", lambda words: (asked.extend(words), encode(words)))
    for _ in range(30):
        words = list({"".join(rng.choice([s, s, m, "\n" + s]) for s, m in zip(rng.choices(stems, k=4), rng.choices(marks, k=4), strict=True)) for _ in range(20)} | {"x.", "d'll.", "3.5,", "x.\nx", "The\n\nend.", "ª.", "e\u0301."})
        for word, got in zip(words, coder.tokens(words), strict=True):
            of_a, of_b = a.encode(" " + word, add_special_tokens=False).ids, b.encode(word)
            # What doesn't come back byte by byte has no entry.
            assert array("I", got).tolist() == [len(of_a), *of_a, *of_b] if got else coder._alone(word) == b""
    made = word_tokens.TwoCoders(*alignment.vocabulary_paths())
    encode, asked = made._encode, []
    monkeypatch.setattr(made, "_encode", lambda words: (asked.extend(words), encode(words)))
    made.tokens([s + m for s in stems for m in marks])
    assert sorted(asked) == sorted({*stems, *("x" + m for m in marks)})
    assert not [x for x in map(b.id_to_piece, range(b.get_piece_size())) if re.search(f"[{word_tokens.LETTERS}][{word_tokens.MARKS}\n]|[{word_tokens.MARKS}\n][{word_tokens.LETTERS}]|[{word_tokens.MARKS}]\n", x)]


def test_alignment_of_a_shape_is_done_once(spark):
    """Words of equal ends share a shape; the links of each are those of its own ids."""
    words = duckdb.sql(f"SELECT DISTINCT unnest(string_split(text, ' ')) w FROM '{FOLDER}/documents.parquet' ORDER BY w LIMIT 3000").fetchall()
    slices = alignment.tokenised(spark.createDataFrame([(1, " ".join(w for (w,) in words if w))], "doc_id long, text string").coalesce(1)).collect()
    assert [len(set(map(str, r.shapes))) for r in slices] == [len(r.shapes) for r in slices] and sum(len(r.shapes) for r in slices) < sum(len(r.words) for r in slices) / 2


def aligned_groups(text):
    a, b, of_a, of_b = bytes_of_tokens()
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ends = lambda ids, of: [sum(len(of(i)) for i in ids[: k + 1]) for k in range(len(ids))]
    ea, eb = ends(ia, of_a), ends(ib, of_b)
    groups, last = [], 0
    for cut in sorted(set(ea) & set(eb)):
        groups.append(([i for i, e in zip(ia, ea, strict=True) if last < e <= cut], [i for i, e in zip(ib, eb, strict=True) if last < e <= cut]))
        last = cut
    return ia, ib, groups


def test_alignment_of_nothing(spark):
    documents = alignment.document_links(alignment.tokenised(spark.createDataFrame([], "doc_id long, text string"))).withColumn("row", alignment.F.monotonically_increasing_id())
    assert alignment.scored(documents, alignment.link_counts(documents)).count() == 0


# 12
def least_sequences(lengths, capacity):
    rooms, n = [], 0
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            n += 1
            rooms.append(capacity - length)
    return n


def test_plan_equals_best_fit_of_single_pieces():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([8, 20, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
        slots, taken, held = packing.plan(Counter(lengths), capacity), Counter(), defaultdict(list)
        for length, first, last, at, offset in slots:
            for k in range(first, last + 1):
                held[at + k - first].append((offset, length))
                taken[length] += 1
        assert taken == Counter(lengths)
        for parts in held.values():
            place = 0
            for offset, length in sorted(parts):
                assert offset == place
                place += length
            assert place <= capacity
        assert len(held) == least_sequences(lengths, capacity)


def test_plan_does_not_grow_with_the_counts():
    assert len(packing.plan({n: 10**9 // n for n in range(1, packing.CAPACITY + 1)})) < 100_000


def whole_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path()).encode(text or "", add_special_tokens=False).ids + [packing.END]


def test_words_with_any_mark_behind_them_share_their_stems():
    coder = word_tokens.WordEndCoder(packing.vocabulary_path())
    texts = [f"Stem9x{mark}{rest}" for mark in "$%&*#.!" for rest in ("", mark * 2, "'s", "<|endoftext|>", "\u0301a", "b\tc")]
    asked, encode = [], coder.coder.encode_batch_fast
    coder.coder = type("Counted", (), {"encode_batch_fast": staticmethod(lambda some, **kw: asked.extend(some) or encode(some, **kw))})
    got = coder.encode(texts)
    assert [[*array("I", g)] for g in got] == [encode([t], add_special_tokens=False)[0].ids for t in texts]
    assert sum(x.startswith("Stem9x") for x in asked) == 1


@pytest.mark.parametrize("capacity", [64, packing.CAPACITY])
def test_packing(spark, capacity):
    docs = docs_of(60) + ODD
    frame = spark.createDataFrame([(*d, "x", "y", "z", "r", "o") for d in docs], DOC).repartition(3)
    found = packing.staged(packing.pieces(frame, capacity=capacity), "test-pieces")
    rows = packing.placed(found, capacity).collect()
    got, held = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
        held[r.sequence_id].append((r.offset, r.length))
    expected = defaultdict(list)
    for doc, text in docs:
        ids = whole_ids(text)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected[doc].append((k, at, len(part), array("I", part).tobytes()))
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in expected.items()}
    for parts in held.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= capacity
    assert len(held) == least_sequences([p[2] for v in expected.values() for p in v], capacity)
    whole = packing.sequences(packing.placed(found, capacity)).collect()
    assert sum(len(bytes(r.ids)) for r in whole) == 4 * sum(p[2] for v in expected.values() for p in v)
    assert all(len(bytes(r.ids)) == 4 * r.length <= 4 * capacity for r in whole)


def test_packing_of_equal_lengths_spreads_over_tasks(spark):
    frame = spark.createDataFrame([(k, "a b c") for k in range(500)] + [(k, "d") for k in range(40)], "doc_id long, text string").repartition(5)
    rows = packing.placed(packing.staged(packing.pieces(frame, capacity=10), "test-pieces"), 10).collect()
    assert len(rows) == 540 and len({(r.sequence_id, r.offset) for r in rows}) == 540
    assert len({r.sequence_id for r in rows}) == 250


def test_packing_query_columns(spark):
    rows = registry.QUERIES["op12_best_fit_packing"](spark, FOLDER).collect()
    texts = dict(docs_of(10**6))
    sample = {r.doc_id for r in rows[::40]}
    for r in rows:
        if r.doc_id in sample:
            part = whole_ids(texts[r.doc_id])[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(array("I", part).tobytes()) and r.start == packing.CAPACITY * r.piece
    assert {r.doc_id for r in rows} == set(texts)


def test_packing_of_nothing(spark):
    assert packing.placed(packing.staged(packing.pieces(spark.createDataFrame([], "doc_id long, text string")), "test-pieces")).count() == 0


# 13
WHITE = " \t\n\x0b\x0c\r"


def repaired_by_search(turns):
    """Least cost, then least edits, by uniform-cost search over places and written initials."""
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for t, r, x in turns))
    seen, faults = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(WHITE)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, at, last, lines = heapq.heappop(heap)
        if (at, last) in done:
            continue
        if at == len(rows) and last in ("", "a"):
            break
        done.add((at, last))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for c in follows.replace("s", ""):
            heapq.heappush(heap, (cost + 3, edits + "I", at, c, (*lines, {"u": "user", "a": "assistant"}[c] + ":")))
        if at < len(rows):
            _, _, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, edits + "D", at + 1, last, lines))
            if faults[at] not in ("blank", "duplicate"):
                more = 3 if faults[at] else 0
                if role and role[0] in follows:
                    heapq.heappush(heap, (cost + more, edits + "K", at + 1, role[0], (*lines, f"{role}:{text}")))
                for c in follows.replace("s", ""):
                    heapq.heappush(heap, (cost + more + 3, edits + "R", at + 1, c, (*lines, {"u": "user", "a": "assistant"}[c] + ":" + text)))
    letters = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
    known = [r[1] for r in rows if r[0]]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    count = Counter(faults)
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def fuzzed_turns():
    rng, out = random.Random(11), []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["One.", "Two!", "Three", "Four?\n", " \t", "", None, "Five; ", f"Own {turn}.", f"Own {turn}."])
            out.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
    return out


@pytest.mark.parametrize("segment", [2, 3, repair.SEGMENT])
def test_repair_equals_search(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    turns = fuzzed_turns() + [(77, k, ["user", "assistant"][k % 3 % 2], f"Line {k}{'.' * (k % 5 > 0)}") for k in range(150)]
    frame = spark.createDataFrame([(*t, "p", "e") for t in turns], "conv_id long, turn long, role string, text string, pos string, edits string").repartition(5)
    by_conv = defaultdict(list)
    for conv, *rest in turns:
        by_conv[conv].append(rest)
    got = {r.conv_id: tuple(r)[1:] for r in repair.digest(frame).collect()}
    assert got == {c: repaired_by_search(t) for c, t in by_conv.items()}


def test_repair_of_hot_and_empty_tables(spark):
    kind = "conv_id long, turn long, role string, text string"
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", "x" * 20_000 + f" {k}.") for k in range(40)] + [(1, 3, "user", "same.")] * 700
    (row,) = repair.digest(spark.createDataFrame(turns, kind)).collect()
    assert tuple(row)[1:] == repaired_by_search([t[1:] for t in turns])
    assert repair.digest(spark.createDataFrame([], kind)).count() == 0


def test_repaired_rows(spark):
    turns = [(5, 0, "assistant", "Hello."), (5, 1, "tool", "Result."), (5, 2, "tool", "Result.")]
    rows = repair.numbered(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    segments = repair.segmented(rows)
    paths = repair.chosen(segments)
    out = repair.repaired(rows, repair.taken(segments, paths), paths).orderBy("pos", "nth").collect()
    assert [(r.role, r.text) for r in out] == [("user", "Hello."), ("assistant", "Result.")]


def test_every_new_query_has_its_columns(spark):
    names, rows = spark_rows(registry.QUERIES["op13_conversation_repair"](spark, FOLDER))
    assert names == ["audit", "blank", "conv_id", "cost", "duplicate", "gaps", "illegal", "repaired_sha256", "truncated"] and rows


# 4
@pytest.mark.parametrize("page", [
    "<main class='content with-sidebar'><p>Real text</p></main>", "<article class='post social-policy'><p>Real text</p></article>", "<article id='search'>Real text</article>",
    "<article><p>Real <button>x</button>text</p></article>", "<article><p>Real <label>y<select><option>z</select></label>text", "<main role='main' id='comments'><p>Real <span class='ad'>Buy</span>text</p><p hidden>no</p></main>",
])
def test_articles_stay_whatever_they_are_called(spark, page):
    rows = [(1, "http://a.b/1", page), (2, "http://a.b/2", "<article hidden><p>Gone</p></article><p>Other</p>")]
    got = {r.page_id: r.text for r in html_main.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Real text", 2: "Other"}


def test_a_dropped_part_does_not_end_its_line():
    kept = [x for x, p in html_main.lines("<p>Real <button>x</button> text <label>lab <i>el</i></label> end</p><p>Next <button>open<p>Third</p>") if p != html_main.DROPPED]
    assert kept[0] == "Real text end" and "Next" in kept


def test_a_staged_table_leaves_no_shuffle_files(spark):
    """Once a table is written, the shuffle files that it came from are gone, and the session's setting is as before."""
    from pyspark.sql import functions as F

    from tidemark.llm import common

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}
    before = {x for x in files() if x.startswith("shuffle_")}
    out = common.staged(spark.range(10_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    assert {x for x in files() if x.startswith("shuffle_")} <= before
    assert spark.conf.get(common.CLEANUP, "false") == "false" and out.count() == 7
