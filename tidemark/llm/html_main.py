"""Main-text extraction: nearest-URL page differencing guided by the page's own structure.

A page is cut into lines, one for each block of text, with the place each stands in: inside an article or main
element, inside an article that a wrapper of doubtful name holds, inside boilerplate (by element, role, class or id),
or elsewhere. Pages of a host are ordered by URL path, and a page is compared with the one of its two neighbours that
shares the longer path and isn't a copy. The two pages' lines are aligned by their longest common subsequence, at
every size, and shared lines are deleted: all of them outside articles, and in an article those that are nothing
but links (articles may share passages, as copies do). The text is what is left of the article's lines if there is
an article, else of all lines.

Differencing alone can't give the article of pages whose menus, adverts and footers differ from page to page,
so structure guards it (see the README). n_deleted tells how many lines a page lost to its neighbour.

Defined cases: a null html is empty and gives empty text; a null url belongs to no host and has no neighbour;
pages of a host with the same lines are one page, at the least of their paths, so a page is never compared with its copy; unclosed elements end with the element around them; an empty table gives no rows;
extra columns are ignored. One page is one row, however long, and takes time in proportion to its length.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, python_batches, staged, table

#: Deletions (rows) up to which they are broadcast to the pages; more are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Bytes of an alignment's table; longer pages are aligned in halves.
TABLE_BYTES = 16 << 20

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[a-zA-Z/][^>]*(?:>|\Z)", re.S)
# Element names by their role, and words of class, id and role that mark boilerplate.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "canvas", "object", "title"}
BOILERPLATE = {"head", "nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "header", "fieldset", "label", "input"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adbox|banner|breadcrumb|breadcrumbs|comment|comments|commentlist|consent|cookie|cookies|"
    r"disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pager|pagination|popup|promo|promoted|related|replies|"
    r"respond|share|sharing|sidebar|site-header|social|sponsor|sponsored|subscribe|toolbar|widget|complementary|contentinfo|search)(?:[\s_-]|$)",
    re.I,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
# Elements and words that may wrap a whole page, whose articles still count.
MAY_WRAP = {"form", "fieldset"}
NEVER_WRAPS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adbox|comment|comments|commentlist|disqus|promo|promoted|related|replies|respond|sponsor|sponsored)(?:[\s_-]|$)", re.I)
#: Places of a line: in an article, a line of links in one, in a wrapped article, elsewhere, in boilerplate that may wrap an article, in other boilerplate.
IN_MAIN, LINKS, IN_WRAPPED, ELSEWHERE, MAYBE, DROPPED = range(6)


def boilerplate(attributes: str, words: bool = True) -> bool:
    """Whether attributes hide an element or, with words, name it as boilerplate."""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if words and name in ("class", "id", "role") and MARKED.search(value):
            return True
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def hides(attributes: str) -> bool:
    """Whether boilerplate of these attributes can't hold the page's article."""
    return any(name.lower() not in ("class", "id", "role") or NEVER_WRAPS.search("".join(values)) for name, *values in ATTRIBUTE.findall(attributes))


class Open:
    """The open elements, with what is asked about them at hand: each is looked at once when it opens and once when it closes."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []  # name, place outside
        self.names: dict[str, int] = {}
        self.blocks: list[int] = []
        self.articles = 0

    def push(self, name: str, outside: int) -> None:
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.articles += name in MAIN
        self.names[name] = self.names.get(name, 0) + 1
        self.stack.append((name, outside))

    def cut(self, depth: int) -> int:
        """Close all from this depth on; the place outside."""
        outside = self.stack[depth][1]
        for name, _ in self.stack[depth:]:
            self.names[name] -= 1
            self.articles -= name in MAIN
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()
        del self.stack[depth:]
        return outside

    def depth(self, name: str) -> int | None:
        if not self.names.get(name):
            return None
        return next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == name)


def lines(page: str) -> list[tuple[str, int]]:
    """The page's blocks of text in order, each with its place."""
    out: list[tuple[str, int]] = []
    open_ = Open()
    place, held, at, plain = ELSEWHERE, [], 0, False
    asides: list[tuple[int, list[str], bool]] = []  # dropped parts of a line: their depth, and the line so far

    def text(part: str) -> None:
        nonlocal plain
        held.append(part)
        plain = plain or not open_.names.get("a") and not part.isspace()

    def close() -> None:
        nonlocal plain
        if held:
            whole = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if whole:
                out.append((whole, LINKS if place == IN_MAIN and not plain else place))
        plain = False

    def resume(depth: int) -> None:
        """End the dropped parts from this depth on, and go on with the lines that they interrupt."""
        nonlocal place, plain
        while asides and asides[-1][0] >= depth:
            close()
            at_, before_, plain = asides.pop()
            held[:], place = before_, open_.stack[at_][1]

    size = len(page)
    lower = None
    for _ in range(size + 1):
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            depth = open_.depth(name)
            if depth is not None:
                resume(depth)
            if name in BLOCK or depth is not None and open_.blocks and open_.blocks[-1] >= depth:
                close()
            if depth is not None:
                if open_.stack[depth][1] != place:
                    close()
                place = open_.cut(depth)
            continue
        if name in RAW:
            if name == "title":
                close()
            if m[3].endswith("/"):
                continue
            lower = lower or page.lower()
            end = lower.find(f"</{name}", at) if len(lower) == size else -1
            if end < 0:
                found = re.compile(f"</{name}", re.I).search(page, at)
                end = found.start() if found else size
            close_at = page.find(">", end)
            at = size if close_at < 0 else close_at + 1
            held.append(" ")
            continue
        if name in VOID:
            if name in BLOCK:
                close()
            elif name == "br":
                held.append(" ")
            continue
        if name in BLOCK:
            close()
            if (name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name in HEADINGS) and open_.blocks:
                # An open paragraph or item ends where the next begins.
                own = open_.stack[open_.blocks[-1]][0]
                if own == name or own == "p" and name in HEADINGS:
                    resume(open_.blocks[-1])
                    close()
                    place = open_.cut(open_.blocks[-1])
        if m[3].endswith("/") and name not in BLOCK:
            continue
        before = place
        marked = name not in ("html", "body") and bool(m[3]) and boilerplate(m[3], name not in MAIN)
        if place == MAYBE and name in MAIN and not marked:
            place = IN_WRAPPED
        elif place != DROPPED:
            if name in MAIN and not marked:
                place = IN_MAIN if place in (IN_MAIN, ELSEWHERE) else place
            elif name == "header" and open_.articles:
                pass
            elif name in BOILERPLATE or marked:
                wraps = place in (ELSEWHERE, MAYBE) and (name in MAY_WRAP or name not in BOILERPLATE) and not (marked and hides(m[3]))
                place = MAYBE if wraps else DROPPED
        if place != before and name not in BLOCK and before not in (MAYBE, DROPPED):
            asides.append((len(open_.stack), held[:], plain))
            held.clear()
            plain = False
        elif place != before:
            now, place = place, before
            close()
            place = now
        open_.push(name, before)
    resume(0)
    close()
    return out


def _rows(x: list[int], y: list[int]):
    """For each line of x the row of the alignment's table, as bits: a bit of y is 0 where the common subsequence grows by it."""
    masks: dict[int, int] = {}
    for j, h in enumerate(y):
        masks[h] = masks.get(h, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for h in x:
        both = row & masks.get(h, 0)
        row = (row + both | row - both) & full
        yield row


def _lengths(x: list[int], y: list[int]):
    """The length of a longest common subsequence of x and each beginning of y."""
    import numpy as np

    row = (1 << len(y)) - 1
    for row in _rows(x, y):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common(a: list[int], b: list[int]) -> set[int]:
    """Places in a of a longest common subsequence of a and b: by rows of bits, and in halves where these take too much."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    out = {*range(start), *range(len(a) - end, len(a))}
    held = set(b)
    places = [i for i in range(start, len(a) - end) if a[i] in held]
    x, own = [a[i] for i in places], set(a)
    y = [h for h in b[start : len(b) - end] if h in own]
    if not x or not y:
        return out
    if len(x) > 1 and len(x) * (len(y) // 8 + 1) > TABLE_BYTES:
        half = len(x) // 2
        both = _lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]
        at = int(both.argmax())
        return out | {places[i] for i in common(x[:half], y[:at])} | {places[half + i] for i in common(x[half:], y[at:])}
    rows = list(_rows(x, y))
    i, j = len(x), len(y)
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> j - 1 & 1:
            out.add(places[i])
            j -= 1
    return out


def host_path(url: str | None) -> tuple[str | None, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or None), parts.path
    except ValueError:
        return None, ""


def shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def deletions(a: list[int], places: list[int], b: list[int]) -> list[int]:
    """Lines of the page a that the neighbour b holds too, in order, and that aren't text of an article."""
    return sorted(i for i in common(a, b) if places[i] not in (IN_MAIN, IN_WRAPPED))


def _line_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def keyed(pages: DataFrame) -> DataFrame:
    return pages.select(F.xxhash64("page_id", "url", "html").alias("key"), F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))


def found_deletions(rows: DataFrame) -> DataFrame:
    """key and gone (numbers of lines) of the pages that lose lines to their nearest neighbour."""
    spark = rows.sparkSession

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for key, page_id, url, page in zip(*batch.columns, strict=True):
                host, path = host_path(url.as_py())
                if host is None:
                    continue
                found = lines(page.as_py())
                for column, value in zip(columns, (key.as_py(), page_id.as_py(), host, path, [_line_hash(x) for x, _ in found], [p for _, p in found]), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "page_id", "host", "path", "hashes", "places"])

    cut_pages = rows.mapInArrow(cut, "key long, page_id long, host string, path string, hashes array<long>, places array<tinyint>")
    cut_pages = staged(cut_pages.withColumn("body", F.xxhash64("host", "hashes")), "lines")
    one = F.min_by(F.struct("page_id", "path", "hashes", "places"), F.struct("path", "page_id", "key")).alias("one")
    bodies = cut_pages.groupBy("host", "body").agg(one).select("host", "body", "one.*")

    def numbered(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), *batch.columns], names=["part", "at", *batch.schema.names])
            at += n

    ordered = bodies.repartitionByRange(partitions(spark), "host", "path", "page_id", "body").sortWithinPartitions("host", "path", "page_id", "body")
    ordered = staged(ordered.mapInArrow(numbered, "part int, at long, host string, body long, page_id long, path string, hashes array<long>, places array<tinyint>"), "pages")
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a partition
    first, total = [], 0
    for part, n in sizes:
        first.append((part, total))
        total += n
    ranked = ordered.join(F.broadcast(spark.createDataFrame(first, "part int, first long")), "part").withColumn("rank", F.col("first") + F.col("at"))
    ranked = ranked.select("rank", "body", "host", "path", "hashes", "places")
    side = lambda step, tag: ranked.select((F.col("rank") + step).alias("rank"), F.struct("host", "path", "hashes").alias(tag))
    both = ranked.join(side(1, "before").hint("shuffle_hash"), "rank", "left").join(side(-1, "after").hint("shuffle_hash"), "rank", "left")

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            keys, gone = [], []
            for r in batch.to_pylist():
                near = [(shared_prefix(r["path"], x["path"]), -i, x["hashes"]) for i, x in enumerate((r["before"], r["after"])) if x and x["host"] == r["host"]]
                out = deletions(r["hashes"], r["places"], max(near, key=lambda x: x[:2])[2]) if near else []
                if out:
                    keys.append(r["body"])
                    gone.append(out)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["body", "gone"])

    found = both.mapInArrow(compare, "body long, gone array<int>")
    return staged(cut_pages.select("key", "body").distinct().join(found.hint("shuffle_hash"), "body").select("key", "gone"), "deletions")


def extracted(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_deleted (lines that the nearest page shares)."""
    spark = pages.sparkSession
    python_batches(spark)
    rows = keyed(pages)
    gone = found_deletions(rows)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone.hint("shuffle_hash")

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            texts, deleted = [], []
            for page, numbers in zip(batch.column(2), batch.column(3), strict=True):
                found = lines(page.as_py())
                drop = set(numbers.as_py() or ())
                there = {p for _, p in found}
                wanted = {IN_MAIN, LINKS} if there & {IN_MAIN, LINKS} else {IN_WRAPPED} if IN_WRAPPED in there else {ELSEWHERE}
                texts.append("\n".join(x for i, (x, p) in enumerate(found) if p in wanted and i not in drop))
                deleted.append(len(drop))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array(deleted, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_deleted"])

    joined = rows.join(gone, "key", "left").select("page_id", "url", "html", "gone")
    return joined.mapInArrow(write, "page_id long, url string, text string, n_chars long, n_deleted long")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
