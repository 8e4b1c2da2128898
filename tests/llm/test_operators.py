"""The training-data operators against brute force on small fixtures, with nulls, ties, repeats and clashing names."""

import hashlib
import math
import os
import random
import subprocess
import sys
import time
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.compare import spark_rows, sql_rows
from tidemark.llm import bpe, chat, components, decontaminate, exact_dedup, html_main, jaccard, kneser_ney, registry, stupid_backoff, suffix_dedup, warc

FOLDER = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"
_xxhash64 = F.xxhash64


def docs_of(limit=150):
    return [tuple(r) for r in duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY doc_id LIMIT {limit}").fetchall()]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    assert spark_rows(registry.QUERIES[name](spark, FOLDER)) == sql_rows(registry.SQL[name], FOLDER)


# 1
ODD = [(5001, "abcdefghij" * 40), (5002, "xyz" + "abcdefghij" * 30 + "q"), (5003, "a" * 1000), (5004, "b" * 99), (5005, "é" * 200), (5006, None), (5007, ""), (5008, "zz" + "é" * 60 + "a" * 120)]


def removed_by_definition(docs):
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        mask = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                mask[k : k + 100] = b"\1" * 100
            seen.add(data[k : k + 100])
        spans = sum(1 for k in range(len(data)) if mask[k] and (k == 0 or not mask[k - 1]))
        out[i] = (len(data), sum(mask), spans, hashlib.sha256(bytes(c for c, m in zip(data, mask) if not m)).hexdigest())
    return out


@pytest.mark.parametrize("rows", [512, 3])
def test_suffix_dedup(spark, monkeypatch, rows):
    from tidemark.llm import common

    monkeypatch.setattr(suffix_dedup, "python_batches", lambda s, *a: common.python_batches(s, rows))
    docs = docs_of(120) + ODD
    got = suffix_dedup.deduplicated(spark.createDataFrame(docs, DOC).repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed_by_definition(docs)


def test_suffix_dedup_odd_rows(spark):
    rows = [(None, "q" * 300), (1, "w" * 50), (1, "w" * 50)]
    got = suffix_dedup.deduplicated(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(((r.doc_id or -1), r.n_bytes, r.n_removed) for r in got) == [(-1, 300, 0), (1, 50, 0), (1, 50, 0)]
    assert suffix_dedup.deduplicated(spark.createDataFrame([], DOC)).count() == 0


def test_suffix_arrays_and_levels():
    """A batch's ranks are the order of its bytes, levels are geometric and stay, and a merge keeps the order."""
    import numpy as np

    rng = random.Random(4)
    data = bytes(rng.choice(b"ab") for _ in range(600)) + b"ab" * 150
    rank = suffix_dedup.suffix_ranks(np.frombuffer(data, np.uint8))
    windows = [data[i : i + 100] for i in range(len(data) - 99)]
    assert [sorted(set(windows)).index(w) for w in windows] == [sorted(set(rank[: len(windows)].tolist())).index(r) for r in rank[: len(windows)].tolist()]
    family, seen = suffix_dedup.IndexFamily(), set()
    for k in range(40):
        runs = [bytes(rng.choice(b"xyz") for _ in range(130)) for _ in range(3)] + [data[:140]] * (k % 2) + [bytes(rng.choice(b"xy") for _ in range(40)) + data[:110]]
        removed, row, offset = suffix_dedup.scanned(family, runs)
        for gone, r, o in zip(removed, row, offset):
            w = runs[r][o : o + 100]
            assert gone == (w in seen)
            seen.add(w)
    sizes = [len(x.order) for x in family.levels]
    assert sum(sizes) == len(seen) and all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and len(sizes) <= 8
    for level in family.levels:
        kept = [level.data[i : i + 100].tobytes() for i in level.order]
        assert kept == sorted(kept)


def test_suffix_dedup_of_hot_anchors_and_without_an_index(spark, monkeypatch):
    passage = "the passage that all of these documents hold " * 3
    docs = [(i, f"{i * 7919} begins like this: {passage} and ends with {i * 104729}") for i in range(60)]
    rows = lambda: {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(spark.createDataFrame(docs, DOC).repartition(3).withColumn("run", F.lit("x"))).collect()}
    want = removed_by_definition(docs)
    assert rows() == want
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    assert rows() == want
    indexed = suffix_dedup.indexed
    monkeypatch.setattr(suffix_dedup, "indexed", lambda runs, shards: indexed(runs, shards).where("false"))
    assert rows() != want


def test_suffix_dedup_of_hot_anchors_sends_few_bytes_to_the_index(spark, monkeypatch):
    """A hot anchor's windows don't go one by one, 100 bytes each: only those that other pieces may equal are compared."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    line = "this is a line of some sixty bytes that most documents hold, "
    docs = [(i, " ".join(word() for _ in range(30)) + line + " ".join(word() for _ in range(30))) for i in range(80)]
    docs += [(100 + i, text[80:-90] + "x") for i, text in docs[::4]] + ODD
    indexed, sent = suffix_dedup.indexed, []
    monkeypatch.setattr(suffix_dedup, "indexed", lambda runs, shards: sent.append(runs.agg(F.sum(F.octet_length("run"))).first()[0]) or indexed(runs, shards))
    want = removed_by_definition(docs)
    for hot in (1_000, 5, 1):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        got = suffix_dedup.deduplicated(spark.createDataFrame(docs, DOC).repartition(3)).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert 0 < sent[1] < sent[0] < sent[2]  # with HOT = 1 all that is left goes by window


# 2
def test_exact_dedup_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a", "z"), (3, "a", "z"), (None, "b", "n"), (None, "b", "n"), (7, "c", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect())
    assert got == sorted([("1", "2", 2, False), ("2", "2", 2, True), ("3", "3", 2, True), ("3", "3", 2, True), ("None", "None", 2, True), ("None", "None", 2, True), ("7", "7", 1, True)])
    kept = exact_dedup.keep_last(df)
    assert kept.columns == df.columns and kept.where("keep_id = 'y'").count() == 1 and kept.where("keep_id = 'x'").count() == 0
    assert exact_dedup.exact_groups(spark.createDataFrame([], DOC)).count() == 0


def test_directory_splits_overfull_buckets():
    counts = Counter({3: 90, 4: 50, 16383: 5})
    leaves = exact_dedup.directory(counts, 60)
    covered = sorted(s for p, d in leaves for s in range(p << (14 - d), (p + 1) << (14 - d)))
    assert covered == list(range(2**14))
    assert (3, 14) in leaves and len(leaves) < 40
    assert exact_dedup.directory({}, 10) == [(0, 0)]


def test_exact_dedup_takes_its_groups_from_the_buckets(spark, monkeypatch):
    """Chains of colliding keys are told apart by their texts, and a bucket that is lost takes its groups with it."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 1 and "coalesce" in str(c[0]) else _xxhash64(*c))
    docs = [(i, f"text {i % 5}") for i in range(60)]
    rows = lambda: sorted(tuple(r) for r in exact_dedup.exact_groups(spark.createDataFrame(docs, DOC)).select("doc_id", "keep_id", "group_size", "kept").collect())
    want = [(i, 55 + i % 5, 12, i >= 55) for i in range(60)]
    assert rows() == want
    build = exact_dedup.build_index
    monkeypatch.setattr(exact_dedup, "build_index", lambda *a: build(*a).where("false"))
    assert rows() != want


def test_exact_dedup_is_native(spark):
    plan = exact_dedup.op2_exact_dedup(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 3
def contaminated_by_definition(docs, items):
    shingles = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    out = set()
    for d, text in docs:
        words = (text or "").lower().split()
        for i, item in items:
            own = (item or "").lower().split()
            c = shingles(own)
            for s in range(max(1, len(words) - len(own) + 1)) if own and words else ():
                v = shingles(words[s : s + len(own)])
                both = sum((v & c).values())
                if 100 * both >= 80 * (sum(v.values()) + sum(c.values()) - both):
                    out.add((d, i))
                    break
    return out


def test_decontamination(spark, monkeypatch):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(4)] + [(9, "tiny item"), (12, "solo"), (13, "of four plain words"), (10, None), (11, "")]
    edited = items[1][1].replace("w1x29", "other")
    bad = " ".join(w if k % 4 else "no" for k, w in enumerate(items[2][1].split()))
    docs = [(1, "a b c " + items[0][1].upper() + " d"), (2, "x " + edited), (3, bad), (4, "tiny item"), (5, None), (6, ""), (7, "Tiny item not"), (20, "here of four plain words and solo"), (21, "tiny, item of four plain"), (22, "solo"), (None, items[0][1]), (8, items[3][1] + " " + items[3][1]), (8, items[3][1])]
    df, bench = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(df, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == contaminated_by_definition([d for d in docs if d[0] is not None], items)
    kept = decontaminate.keep_clean(df.withColumn("hamming", F.lit(1)), bench)
    assert kept.columns == ["doc_id", "text", "hamming"] and {r.doc_id for r in kept.collect()} == {3, 5, 6, 21, None}
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 0)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == contaminated_by_definition([d for d in docs if d[0] is not None], items)
    assert decontaminate.contaminated(df, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame([], DOC), bench).count() == 0
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_near_masks_cover_the_radius():
    rng = random.Random(1)
    for _ in range(200):
        flips = rng.sample(range(64), decontaminate.RADIUS)
        per = [sum(s <= b < s + n for b in flips) for s, n in zip(decontaminate._STARTS, decontaminate._SIZES)]
        assert min(per) <= decontaminate.RADIUS // decontaminate.BLOCKS
    assert len(decontaminate.near_masks(9)) == 1 + 9 + 36


def test_decontamination_between_alignments(spark):
    item = [f"w{k}" for k in range(59)]
    docs = [(1, ["X", *item[1:29], "A", "B", *item[29:58], "Y"]), (2, ["p"] * 7 + ["X", *item[1:29], "A", "B", *item[29:58], "Y", "q", "r"]), (2, item[:30] + ["z"] * 40)]
    docs += [(3, ["X", *item[1:20], "A", "B", "C", *item[20:56], "Y", "Y", "Y"]), (4, item[30:] + item[:30])]
    rows = decontaminate.contaminated(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], DOC), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()

    def best(words):
        grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1)))
        own, found = grams(item), []
        for s in range(max(len(words) - 59, 0) + 1):
            held = grams(words[s : s + 59])
            found.append((round(sum((held & own).values()) / sum((held | own).values()), 6), -s))
        return max(found)

    want = {}
    for i, w in docs:
        want[i] = max(want.get(i, (0, 0)), best(w))
    assert {r.doc_id: (r.similarity, -r.start_word) for r in rows} == {i: x for i, x in want.items() if x[0] >= 0.8}
    assert want[1] == (round(49 / 61, 6), -1) and want[2] == (round(49 / 61, 6), -8)


# 4
def test_main_text(spark):
    page = lambda n, body: (n, f"http://h.example/a/{n}", f"<body><p>Top of the site</p><p>{body}</p><p>Bottom</p></body>")
    rows = [page(1, "one"), page(2, "two"), page(3, "three"), (None, None, None), (9, "http://o.example/", "<p>only"), (10, "::bad", "<article><h1>T &amp; t</h1><div class='ad'>x</div><p>a<br>b\n c<p>d</article><p>out")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_main.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("one", 3), 2: ("two", 3), 3: ("three", 5), None: ("", 0), 9: ("only", 4), 10: ("T & t\na b c\nd", 13)}
    assert html_main.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_lines_of_broken_pages():
    text = lambda h: [x for x, p in html_main.lines(h) if p != html_main.DROPPED]
    assert text("<p>3 < 4 &lt;b&gt; <script>var t='</p>'") == ["3 < 4 <b>"]
    assert text("<!-- <p>x</p> --><nav><ul><li>m</nav><div id='comments'>c</div><p title='>'>y") == ["y"]
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert text("") == [] and text("<") == ["<"]


@pytest.mark.parametrize("size", [1 << 24, 4])
def test_alignment_is_longest(monkeypatch, size):
    monkeypatch.setattr(html_main, "TABLE_BYTES", size)
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        found = sorted(html_main.common(a, b))
        rest = iter(b)
        assert len(found) == t[len(a)][len(b)] and all(a[i] in rest for i in found)


def composed(rng):
    """A page of known parts and its text: what a reader of the contract expects."""
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7)))
    said = lambda n: " ".join(word() for _ in range(n))
    blocks = [said(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
    wrapped = lambda t: rng.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<p><b>{}</b><br></p>", "<blockquote>{}</blockquote>"]).format(t.replace("ß", "&szlig;").replace(" ", rng.choice([" ", "\n", "&nbsp;", "  "])))
    noise = lambda: rng.choice(
        ["<nav><a href='/x'>{}</a></nav>", "<div class='ad'>{}</div>", "<script>{}</script>", "<aside>{}</aside>", "<form><input><label>{}</label></form>", "<!-- {} -->", "<style>{}</style>", "<div id='comments'><article><p>{}</p></article></div>", "<footer>{}</footer>", "<div class='cookie-notice'><p>{}</p></div>", "<p>{}</p>"]).format(said(5))
    inner = "".join(wrapped(t) + (rng.choice(["<div class='share'>{}</div>", "<aside>{}</aside>", "<script>{}</script>"]).format(said(3)) if rng.random() < 0.3 else "") for t in blocks)
    body = f"<article>{inner}</article>"
    body = rng.choice(["{}", "<form>{}</form>", "<div class='has-sidebar'>{}</div>", "<main>{}</main>", "<div><section>{}</section></div>"]).format(body)
    return f"<html><head><title>{said(4)}</title></head><body>" + "".join(noise() for _ in range(rng.randint(0, 3))) + body + "".join(noise() for _ in range(rng.randint(0, 3))) + "</body></html>", "\n".join(blocks)


def test_main_text_of_composed_pages(spark):
    rng = random.Random(11)
    pages = [composed(rng) for _ in range(400)]
    rows = [(i, f"https://h{i % 7}.example/{rng.randint(0, 50)}/{i}", page, "x") for i, (page, _) in enumerate(pages)] * 2
    got = html_main.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, hashes string").repartition(5)).collect()
    assert len(got) == 800
    wrong = [(r.text, pages[r.page_id]) for r in got if r.text != pages[r.page_id][1] or r.n_chars != len(r.text)]
    assert not wrong, wrong[0]


def test_differencing_decides(spark, monkeypatch):
    """Menus of pages without structure, copies among them, and lists of links in articles go by what the nearest page shares."""
    menu = "".join(f"<p>Entry {k} of the menu</p>" for k in range(20))
    bare = lambda n, t: (n, f"http://h.example/a/{n}", f"{menu}<p>{t}</p><p>{t} more words of this page only</p>")
    rows = [bare(1, "first"), (2, "http://h.example/a/1x", bare(1, "first")[2]), bare(3, "third")]
    article = lambda n, t: (n, f"http://g.example/b/{n}", f"<article><p>{t}</p><p>said by all</p><p><a href='/'>Share this</a></p><p><a href='/{n}'>Own {n}</a></p></article>")
    rows += [article(5, "five " * 9), article(6, "six " * 9)]
    run = lambda: {r.page_id: (r.text, r.n_deleted) for r in html_main.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    got = run()
    assert got[1] == got[2] == ("first\nfirst more words of this page only", 20) and got[3] == ("third\nthird more words of this page only", 20)
    assert got[5] == ("five " * 8 + "five\nsaid by all\nOwn 5", 1) and got[6][1] == 1
    monkeypatch.setattr(html_main, "deletions", lambda *a: [])
    assert run() != got


def test_pages_take_linear_time():
    began = time.time()
    assert html_main.lines("<span>" * 60_000 + "x" + "<p>y" * 20_000)[0] == ("x", html_main.ELSEWHERE)
    assert len(html_main.lines("<div><span>" * 20_000 + "<li>z</li>" * 20_000)) == 20_000
    a = list(range(6000))
    assert len(html_main.common(a, a[::-1] + a[3000:])) == 3001
    assert time.time() - began < 20


# 5
def test_warc_round_trip(spark, tmp_path):
    big = "x\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/", big), (2, "http://b/\nx", big), (3, None, None), (4, "u", "é"), (5, "u", "é"), (None, "n", big), (6, "u", big + "y"), (6, "u", big + "y")]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    records = warc.read_records(spark, path)
    t = warc.transactions(records)
    assert records.count() == 24 and t.count() == 8 and t.where("request is null or response is null or size(metadata) != 1").count() == 0
    got = sorted((r.response.warc_type, "-" if r.response.payload is None else bytes(r.response.payload).decode()) for r in t.collect())
    assert got == sorted([("revisit", "-"), ("response", big), ("response", ""), ("response", "é"), ("response", "é"), ("revisit", "-"), ("response", big + "y"), ("response", big + "y")])
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path + "0")
    assert warc.read_records(spark, path + "0").count() == 0


def test_warc_digest_is_checked():
    data = warc.record("response", [("WARC-Record-ID", "<a>"), ("WARC-Payload-Digest", warc.to_header("00" * 20))], b"HTTP/1.1 200 OK\r\n\r\nx")
    with pytest.raises(ValueError):
        list(warc.parse(data))


# 6
def backoff_by_definition(docs):
    """Scores from the definition, with None as the start mark; documents that share an id are added up."""
    grams = [(i, (text or "").split()) for i, text in docs]
    count, total = Counter(), sum(len(w) for _, w in grams)

    def of(w):
        w = [None, *w]
        return Counter(tuple(w[k - n + 1 : k + 1]) for n in (1, 2, 3) for k in range(n - 1, len(w)) if len(w) > 1)

    for _, w in grams:
        count.update(of(w))
    out = defaultdict(lambda: [0, 0.0])
    for i, w in grams:
        own, padded = of(w), [None, *w]
        left = lambda *g: count[g] - own[g]  # noqa: B023, E731
        for k in range(1, len(padded)):
            c, b = padded[k], padded[k - 1]
            score = 0.0
            if k > 1:
                a = padded[k - 2]
                if left(a, b, c):
                    out[i][1] += math.log(left(a, b, c)) - math.log(max(left(a, b), left(a, b, c)))
                    continue
                score = math.log(0.4)
            if left(b, c):
                score += math.log(left(b, c)) - math.log(max(left(b), left(b, c)))
            else:
                score += math.log(0.4) + math.log(max(left(c), 1)) - math.log(max(total - len(w), 1))
            out[i][1] += score
        out[i][0] += len(w)
    return out


@pytest.mark.parametrize("words", [1_000_000, 3_000])
def test_stupid_backoff(spark, monkeypatch, words):
    monkeypatch.setattr(stupid_backoff, "PACK_WORDS", words)
    monkeypatch.setattr(stupid_backoff, "SHARD_WORDS", words)
    docs = docs_of(100) + [(900, None), (901, ""), (902, "solo"), (903, "of the"), (903, "of the end"), (904, "x " * 4000), (None, "the end")]
    frame = spark.createDataFrame(docs, DOC).withColumn("score", F.lit("extra"))
    got = {r.doc_id: r for r in stupid_backoff.scored(frame.repartition(3)).collect()}
    want = backoff_by_definition(docs)
    assert set(got) == set(want)
    for i, (n, score) in want.items():
        assert got[i].n_words == n and ((got[i].score is None) if not n else abs(got[i].score - score) < 1e-3)
    assert stupid_backoff.scored(spark.createDataFrame([], DOC)).count() == 0


def test_stupid_backoff_needs_its_counts(spark, monkeypatch):
    docs = docs_of(60)
    score = lambda: {r.doc_id: r.score for r in stupid_backoff.scored(spark.createDataFrame(docs, DOC).repartition(3)).collect()}
    monkeypatch.setattr(stupid_backoff, "PACK_WORDS", 2_000)
    whole = score()
    counted = stupid_backoff.counted
    monkeypatch.setattr(stupid_backoff, "counted", lambda b: counted(b).where("false"))
    assert score() != whole


# 7
@pytest.fixture(scope="module")
def coders():
    import tiktoken

    data, pattern = bpe.vocabulary()
    own = bpe.Transducer(bpe.read_ranks(data), pattern)
    return own, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})


def test_bpe_equals_tiktoken(coders):
    own, other = coders
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "e", "é", "ñ", "日本", "\n", "!!", "###", "aaaa", "the", "123", "​", "😀", "'s", "\t", "한국", "<|endoftext|>"]
    texts = ["", "a" * 3000, " " * 2000, "ab" * 2000, "日" * 1000, "!" * 500 + "?" * 400, *(t for _, t in docs_of(60))]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    texts += ["".join(chr(rng.choice([rng.randint(97, 122), rng.randint(0x400, 0x44F), rng.randint(0x4E00, 0x4FFF)])) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for t in texts:
        ids = own.encode_text(t)
        assert ids.tolist() == other.encode_ordinary(t) and "".join(own.decode_stream(ids, 3)) == t


@pytest.mark.parametrize(("most", "misses"), [(0, 5), (7, 1), (300, 50), (100_000, 10)])
def test_bpe_with_evicted_states_is_the_same(coders, monkeypatch, most, misses):
    own, other = coders
    monkeypatch.setattr(bpe, "MAX_TRANSITIONS", most)
    monkeypatch.setattr(bpe, "MAX_MISSES", misses)
    own.pieces.clear()
    own.start_afresh()
    afresh, times = own.start_afresh, []
    monkeypatch.setattr(own, "start_afresh", lambda: (times.append(1), afresh()))
    for t in ["a" * 700, "ab" * 300 + "é" * 90, *(t for _, t in docs_of(10))]:
        assert own.encode_text(t).tolist() == other.encode_ordinary(t)
        assert len(own.moves) <= most and own.misses <= misses
    assert bool(times) == (most < 100_000)


def test_bpe_query(spark, coders):
    docs = [(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (None, "x")]
    rows = bpe.encode(spark.createDataFrame(docs, DOC))
    got = sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in rows.collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    n = len(coders[1].encode_ordinary("Hello world"))
    assert got == sorted([("1", 0, sha("")), ("2", 0, sha("")), ("3", n, sha("Hello world")), ("3", n, sha("Hello world")), ("None", 1, sha("x"))])
    assert sorted(str(r.text) for r in bpe.decode(rows).collect()) == ["", "", "Hello world", "Hello world", "x"]
    assert bpe.encode(spark.createDataFrame([], DOC)).count() == 0


# 8
def linked_by_definition(docs):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, text in docs:
        w = (text or "").encode().translate(lower).split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    inverted, shared, parent = defaultdict(list), Counter(), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for h in sets[i]:
            inverted[h].append(i)
    for v in inverted.values():
        shared.update((v[a], v[b]) for b in range(len(v)) for a in range(b))
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_jaccard(spark):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    common_ = [f"c{k}" for k in range(30)]
    docs = docs_of(60)
    for k in range(60):  # near copies with one to six edits
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**9)}"
        docs.append((1000 + k, " ".join(w)))
    for k in range(40):  # a passage that unrelated documents share
        docs.append((2000 + k, " ".join([f"u{rng.randint(0, 10**9)}" for _ in range(60)] + common_)))
    docs += [(3000, None), (3001, ""), (3002, "one two"), (3003, "ONE  two"), (3004, " \n"), (3005, "one two three")]
    got = jaccard.classed(spark.createDataFrame(docs, DOC).repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked_by_definition(docs) and len(got) == len(docs)


def test_jaccard_tokens_of_one_prefix_in_the_other_rest(spark):
    docs = []
    for g in range(6):  # x's prefix is long and holds the passage's frequent tokens, which lie in y's rest
        passage = " ".join(f"g{g}p{k}" for k in range(15))
        docs += [(g * 100 + k, " ".join([passage, *(f"g{g}k{k}o{i}" for i in range(4))])) for k in range(8)]
        docs += [(g * 100 + 50, f"{passage} w1g{g}"), (g * 100 + 51, f"{passage} w1g{g} w2g{g} w3g{g} w4g{g}")]
    want = linked_by_definition(docs)
    assert all(want[g * 100 + 51][1] == g * 100 + 50 for g in range(6))
    got = jaccard.classed(spark.createDataFrame(docs, DOC).repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_jaccard_odd_rows(spark):
    df = spark.createDataFrame([(5, "a b c d e f", 1), (5, "a b c d e f", 2), (None, "a b c d e f", 3), (2, "a b c d e f", 4)], "doc_id long, text string, rep int")
    assert sorted(((r.doc_id or 0), r.component_id) for r in jaccard.classed(df).where("doc_id is not null").collect()) == [(2, 2), (5, 2), (5, 2)]
    kept = jaccard.keep_first(df)
    assert kept.columns == df.columns and sorted(r.rep for r in kept.collect()) == [3, 4]
    assert jaccard.classed(spark.createDataFrame([], DOC)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randint(0, 60), 100 + rng.randint(0, 60)) for _ in range(40)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


# 9
def test_chat(spark):
    rows = [(1, 0, "system", "be #1 \\ <b>"), (1, 1, "user", "a" * 900), (1, 2, "assistant", "b: ### c</turn>\n\\h\\b"), (1, 3, "user", None), (1, 4, None, "x"), (1, 4, None, "x"), (1, 5, "assistant", "é" * 2000), (None, 0, "assistant", ""), (2, None, "a:b # <", "t")]
    windows = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("span", F.lit(1)))
    got = {r.conv_id: r for r in chat.digest(windows).collect()}
    for conv in (1, None, 2):
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in turns)
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    w = windows.where("conv_id = 1").collect()
    assert len(w) > 1 and all("be \\h1" in x.body for x in w)
    assert chat.digest(chat.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    assert "Python" not in chat.op9_chat_format(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


def test_chat_windows_keep_the_budget(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", "word " * 30) for k in range(60)]
    w = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("span").collect()
    assert len(w) > 3 and all(len(x.body) <= chat.BUDGET * chat.CHARS_PER_TOKEN for x in w)
    assert any("#~# " in x.body for x in w[1:])


def test_chat_of_one_long_conversation(spark):
    """20,000 turns of one conversation: linear work, every turn once, and the system turn in every window."""
    n = 20_000
    turns = spark.range(n).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "system").when(F.col("id") % 2 == 1, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn #"), "id").alias("text"))
    began = time.time()
    windows = chat.format_windows(turns)
    got = chat.digest(windows).first()
    text = [f"turn #{k}" for k in range(n)]
    roles = ["system", *("user" if k % 2 else "assistant" for k in range(1, n))]
    assert got.n_turns == n and got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in zip(roles, text)).encode()).hexdigest()
    assert got.loss_sha256 == hashlib.sha256("".join(t for r, t in zip(roles, text) if r == "assistant").encode()).hexdigest()
    assert windows.where(~F.col("body").contains("system: turn \\h0<")).count() == 0
    assert time.time() - began < 60


# 10
def kneser_ney_by_definition(texts):
    """Log-probability of a word after two others, from the published formulas, with sentence starts as None."""
    c3, c2, c1 = Counter(), Counter(), Counter()
    for text in texts:
        w = [None, None, *text.split()]
        c3.update(zip(w, w[1:], w[2:]))
    for a, b, c in c3:
        c2[b, c] += 1
    for b, c in c2:
        c1[c] += 1

    def discounts(counts):
        n = [max(1.0, float(sum(v == i for v in counts.values()))) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(i - 0.01, max(0.05 * i, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]

    d1, d2, d3 = discounts(c1), discounts(c2), discounts(c3)

    def level(counts, d, own, context, lower):
        rows = {k: n for k, n in counts.items() if k[:-1] == context}
        if not rows:
            return lower
        off = lambda n: d[min(n, 3) - 1]
        total = sum(rows.values())
        n = rows.get((*context, own), 0)
        return (n - off(n) if n else 0) / total + sum(map(off, rows.values())) / total * lower

    kinds, total = len(c1), sum(c1.values())

    def p(a, b, c):
        off = lambda n: d1[min(n, 3) - 1]
        low = (c1[c] - off(c1[c]) if c1[c] else 0) / total + sum(map(off, c1.values())) / total / (kinds + 1)
        return math.log(level(c3, d3, c, (a, b), level(c2, d2, c, (b,), low)))

    return p


def test_kneser_ney_equals_its_definition(spark):
    """Perplexities from joins equal the formulas', and after any context all words and the unknown one add up to one."""
    texts = ["a b c a b d", "a b c d", "b c a", "d a b c"] * 3 + ["a c b", "e a"]
    sample = spark.createDataFrame([("*", i, t, False) for i, t in enumerate(texts)], "model string, doc_id long, text string, held_out boolean")
    model = kneser_ney.train(sample)
    floor = model.where("kind = 'unk'").first().value
    asked = [*(f"a b {w}" for w in ("a", "b", "c", "d", "e", "unseen")), "a b", "e e e", "new words b c a", "c"]
    rows = spark.createDataFrame(list(enumerate(asked)), "key long, text string").withColumn("salt", kneser_ney.salt_of(F.lit("*")))
    none = spark.createDataFrame([], "key long, value float")
    got = {r.key: r.known + r.unknown * floor for r in kneser_ney.scores(rows, model, none).collect()}
    p = kneser_ney_by_definition(texts)
    for i, text in enumerate(asked):
        w = [None, None, *text.split()]
        assert abs(got[i] - sum(p(*w[k - 2 : k + 1]) for k in range(2, len(w)))) < 1e-4
    assert abs(sum(math.exp(got[i] - got[6]) for i in range(6)) - 1) < 1e-4


def test_toxic_words_are_evidence(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    text = lambda n, bad=0: " ".join(rng.sample([rng.choice(words) for _ in range(n)] + ["scum"] * bad, n + bad))
    docs = [(i, text(120, i >= 400), "xx") for i in range(500)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(i, 1, 1) for i in range(400, 440)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in kneser_ney.scored(spark.createDataFrame(docs, "doc_id long, text string, lang string"), labels).collect()}
    assert not any(got[i] for i in range(400, 500)) and sum(got[i] for i in range(400)) >= 390


def test_all_trusted_documents_train_the_classifier(spark):
    """Half of the trusted documents, however many, teach the model: their words, which no other document has, are known to it."""
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "xx") for i in range(1200)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1200)], "doc_id long, quality int, toxic int")
    got = sorted(r.perplexity for r in kneser_ney.scored(spark.createDataFrame(docs, "doc_id long, text string, lang string"), labels).collect())
    low = sum(p < got[-1] / 10 for p in got)
    assert 500 < low < 700


def test_words_are_hashed_in_pieces_of_bounded_memory():
    """A worker keeps tables as long as what it hashes at a time; pieces give the hashes that each text gives alone."""
    code = """
import random
from tidemark.llm import shingles
texts = [(b"%d word " % i) * random.Random(i).randint(0, 900) for i in range(900)]
words, counts = shingles.word_hashes(texts, cased=True)
alone = [shingles.word_hashes([t], cased=True) for t in texts]
assert words.tolist() == [w for x, _ in alone for w in x.tolist()] and counts.tolist() == [int(n[0]) for _, n in alone]
assert sum(map(len, texts)) > 3 * shingles.PIECE and len(shingles._powers) <= shingles.PIECE + len(texts) + 1
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env=os.environ | {"PYTHONPATH": root})


def test_blocks_follow_the_text_and_not_its_partitions(spark):
    """Few texts in many partitions and under many shuffle partitions make few packs and shards, and so few blocks."""
    rows = spark.range(400).selectExpr("id key", "0L salt", "concat('a b c d ', id) text").repartition(100)
    shards = kneser_ney.shards_for(6 << 20, 211)
    found = kneser_ney.blocks(rows, shards).groupBy("pack").agg(F.count("*").alias("n")).collect()
    assert shards <= 6 and len(found) <= max(shards, kneser_ney.PACKERS * spark.sparkContext.defaultParallelism) < 100
    assert kneser_ney.shards_for(0, 211) == 1 and kneser_ney.shards_for(1 << 40, 4) >= (1 << 40) / kneser_ney.SHARD_BYTES


def test_rounds_do_not_shuffle_the_model(spark):
    rows = [("*", i, "a b c d", i % 2 == 0) for i in range(4)]
    model = kneser_ney.train(spark.createDataFrame(rows, "model string, doc_id long, text string, held_out boolean"))
    same = model.where("kind = 'shard'").select("shard", "tables").groupBy("shard").applyInArrow(lambda x: x, "shard long, " + kneser_ney.TABLES_FIELD)
    assert same.count() and "Exchange" not in same._jdf.queryExecution().executedPlan().toString()


def test_classifier(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(50)]
    good = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, good(80), "xx" if i % 2 else None, f"p{i}") for i in range(300)] + [(1000 + i, " ".join(f"J{rng.randint(0, 10**9)}!!" for _ in range(60)), "xx", "j") for i in range(20)]
    docs += [(2000, None, "xx", "e"), (2001, "", None, "e"), (2002, "w1 w2", "zz", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, perplexity string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300)] + [(1000, 0, 0), (None, 1, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.scored(df, labels).collect()}
    assert len(got) == len(docs) and not any(got[1000 + i].kept for i in range(20)) and not got[2000].kept and got[2000].perplexity is None
    assert sum(got[i].kept for i in range(300)) >= 294 and got[2002].kept
    kept = kneser_ney.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got.values())
    assert kneser_ney.scored(df.limit(0), labels).count() == 0
    assert all(r.kept for r in kneser_ney.scored(df.where("doc_id < 50"), labels.limit(0)).collect())


def test_pipeline(spark):
    import corpus_pipeline
    from tidemark.llm.common import staged

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.count(), staged(stage(spark, docs, FOLDER), "test")
        assert docs.count() <= before
        assert name == "byte-level BPE" or docs.columns == columns
    ids = {r.doc_id for r in docs.collect()}
    assert ids == {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len({texts[i] for i in ids}) == len(ids)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert not contaminated_by_definition([(i, texts[i]) for i in ids], bench)
