"""Conversation structure repair by composing weighted automata.

A conversation's rows, in order, are a string of symbols: the initial of the role, whether the row must go (blank, or
a role and text seen before), whether its text is cut off. Three machines are composed: the string itself; a transducer
that keeps, re-roles or deletes a row and puts in rows without text; and the role grammar `(s?(ua)+)?`. States of the
composition are made when a path reaches them. As the transducer counts the rows put in since the last row of the
input, and two are enough to go from any state of the grammar to any other, the composition has no cycle, and one pass
in topological order finds the shortest paths. Weights are (cost, edits): the lesser cost, then the lesser string
of the edits' initials.

Rows are sorted and numbered by range partitions, and a conversation is cut wherever its rows cross a block of SEGMENT
numbers. A segment's shortest paths from each state of the grammar to each other are found by themselves; a second step
chooses the states in which segments meet. Strings of edits of different states that end with the same row never
begin with one another, so there an order of the four states stands for their strings, and no string is longer than a
segment until the whole is written. So a conversation with a third of all rows is many tasks' work.

Defined cases: rows are ordered by turn (null first), role, text; repeated rows are repeated turns; a null role or
text is one space, a null conv_id a conversation of its own. A role that is empty or begins with another letter than
s, u or a fits nowhere and is re-roled or deleted. Texts of any length are only compared, never cut. An empty table
gives no rows; extra columns are ignored, whatever their names. Only the digest of the query gathers a conversation's
texts in one row, as its hash covers them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged, table

#: Numbers of rows in one block; a segment is what a conversation has in a block.
SEGMENT = 512
WHITE = " \t\n\x0b\x0c\r"
RE_ROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: The grammar's arcs; it begins in 0 and ends in 0 or 3.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS = 4, {0: "", 1: "II", 2: "I", 3: ""}
Weight = tuple[int, str]


def symbol_arcs(symbols: str, at: int) -> Iterator[tuple[str, int]]:
    """The input: one arc from each place to the next."""
    if at < len(symbols):
        yield symbols[at], at + 1


def edit_arcs(inserted: int, symbol: str | None) -> Iterator[tuple[str, int, str | None, int]]:
    """The transducer: (edit, cost, output, next state) without input (symbol None) or for a symbol; output None is nothing."""
    if symbol is None:
        if inserted < 2:
            for role in "ua":
                yield "I", INSERT, role, inserted + 1
        return
    yield "D", DELETE, None, 0
    if symbol != "d":
        more = CUT_OFF if symbol.isupper() else 0
        yield "K", more, symbol.lower(), 0
        for role in "ua":
            yield "R", RE_ROLE + more, role, 0


@lru_cache(maxsize=20_000)
def shortest(symbols: str, entry: int) -> dict[int, Weight]:
    """For each state of the grammar that a path from entry over all symbols ends in: the least weight. Paths end with a row."""
    best: dict[tuple[int, int, int], Weight] = {(0, 0, entry): (0, "")}
    for at in range(len(symbols)):
        for inserted in range(3):
            for g in range(STATES):
                if (weight := best.pop((at, inserted, g), None)) is None:
                    continue
                for symbol, place in [(None, at), *symbol_arcs(symbols, at)]:
                    for edit, cost, output, counted in edit_arcs(inserted, symbol):
                        to = g if output is None else GRAMMAR.get((g, output))
                        if to is not None:
                            reached, new = (place, counted, to), (weight[0] + cost, weight[1] + edit)
                            if reached not in best or new < best[reached]:
                                best[reached] = new
    return {g: w for (at, _, g), w in best.items() if at == len(symbols)}


def outputs(symbols: str, edits: str, entry: int) -> list[str]:
    """For each row the roles' initials that its edits write, rows put in before it first."""
    g, at, here, out = entry, 0, "", []
    for edit in edits:
        if edit == "D":
            written = ""
        elif edit == "K":
            written = symbols[at].lower()
        else:
            written = "a" if g == 2 else "u"
        g = GRAMMAR[g, written] if written else g
        here += written
        if edit != "I":
            out.append(here)
            at, here = at + 1, ""
    return out


def meet(segments: list[tuple[list[int], list[int]]]) -> tuple[int, str, list[int]]:
    """Cost, edits behind the last row, and the grammar's states before each segment and after the last.

    A segment is its costs (entry * STATES + exit; -1: no path) and the order of its strings among those of an entry.
    """
    now, back = {0: (0, 0)}, []  # state: (cost, order of its string)
    for costs, order in segments:
        reached: dict[int, tuple[int, tuple[int, int], int]] = {}
        for g, (cost, rank) in now.items():
            for to in range(STATES):
                k = g * STATES + to
                if costs[k] >= 0:
                    new = (cost + costs[k], (rank, order[k]), g)
                    if to not in reached or new[:2] < reached[to][:2]:
                        reached[to] = new
        ranks = {r: i for i, r in enumerate(sorted(v[1] for v in reached.values()))}
        back.append({to: v[2] for to, v in reached.items()})
        now = {to: (v[0], ranks[v[1]]) for to, v in reached.items()}
    cost, _, last = min((cost + INSERT * len(ENDS[g]), rank, g) for g, (cost, rank) in now.items())
    path = [last]
    for step in reversed(back):
        path.append(step[path[-1]])
    return cost, ENDS[last], path[::-1]


def numbered(turns: DataFrame) -> DataFrame:
    """Staged rows conv_id, turn, role, text, fault (0 none, 1 blank, 2 duplicate, 3 truncated) and pos, which orders all rows."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    t = staged(t.withColumn("row", F.monotonically_increasing_id()), "repair-rows")
    first = t.groupBy("conv_id", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row"))["row"].alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("x"), "first")
    t = t.join(first.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("x")))
    end = F.rtrim("text", F.lit(WHITE))
    repeated = F.col("row") != F.col("first")
    fault = F.when(end == "", 1).when(repeated, 2).when(F.substring(end, -1, 1).isin(*".!?"), 0).otherwise(3)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("again")]
    t = t.select("conv_id", "turn", "role", "text", fault.alias("fault"), repeated.alias("again"))
    t = t.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    return staged(t.drop("again"), "repair-numbered")


def _initial(role: Column) -> Column:
    return F.when(F.substring(role, 1, 1).isin(*"sua"), F.substring(role, 1, 1)).otherwise("x")


def segmented(rows: DataFrame) -> DataFrame:
    """conv_id, segment, symbols, initials, positions and the shortest paths: costs, order and edits by entry * STATES + exit. Staged."""
    initial = _initial(F.col("role"))
    symbol = F.when(F.col("fault").isin(1, 2), "d").when(F.col("fault") == 3, F.upper(initial)).otherwise(initial)
    part = F.array_sort(F.collect_list(F.struct("pos", symbol.alias("symbol"), initial.alias("initial"))))
    block = F.expr(f"pos div {SEGMENT}")
    s = rows.groupBy("conv_id", block.alias("segment")).agg(part.alias("part"))  # at most SEGMENT rows
    s = s.select("conv_id", "segment", F.array_join("part.symbol", "").alias("symbols"), F.array_join("part.initial", "").alias("initials"), F.col("part.pos").alias("positions"))

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            costs, order, edits = [], [], []
            for symbols in batch.column("symbols").to_pylist():
                cost, rank, edit = [-1] * STATES**2, [0] * STATES**2, [""] * STATES**2
                for entry in range(STATES):
                    found = shortest(symbols, entry)
                    strings = sorted(w[1] for w in found.values())
                    for to, (c, e) in found.items():
                        k = entry * STATES + to
                        cost[k], rank[k], edit[k] = c, strings.index(e), e
                costs.append(cost)
                order.append(rank)
                edits.append(edit)
            made = [pa.array(costs, pa.list_(pa.int32())), pa.array(order, pa.list_(pa.int32())), pa.array(edits, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "costs", "order", "edits"])

    kind = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {kind}, segment long, symbols string, initials string, positions array<long>, costs array<int>, `order` array<int>, edits array<string>"
    return staged(s.mapInArrow(work, schema), "repair-segments")


def chosen(segments: DataFrame) -> DataFrame:
    """conv_id, cost, illegal, tail (edits behind the last row) and path: segment, entry and exit of each segment. Staged."""
    part = F.struct("segment", "costs", "order", F.substring("initials", 1, 1).alias("begins"), F.substring("initials", -1, 1).alias("ends"))
    wrong = F.size(F.filter(F.sequence(F.lit(1), F.length("initials")), lambda i: (i > 1) & ~F.substr(F.col("initials"), i - 1, F.lit(2)).isin("su", "ua", "au")))
    whole = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.sum(wrong).alias("inside"))

    def work(batches):
        import pyarrow as pa

        step = pa.struct([("segment", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32())])
        for batch in batches:
            found = []
            for parts, inside in zip(batch.column("parts").to_pylist(), batch.column("inside").to_pylist(), strict=True):
                cost, tail, path = meet([(p["costs"], p["order"]) for p in parts])
                between = sum(a["ends"] + b["begins"] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:], strict=False))
                steps = [{"segment": p["segment"], "entry": path[k], "exit": path[k + 1]} for k, p in enumerate(parts)]
                found.append((cost, inside + between, tail, steps))
            made = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.list_(step)), strict=True)] if found else []
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *made], names=["conv_id", "cost", "illegal", "tail", "path"])

    kind = dict(segments.dtypes)["conv_id"]
    return staged(whole.mapInArrow(work, f"conv_id {kind}, cost long, illegal long, tail string, path array<struct<segment:long,entry:int,exit:int>>"), "repair-paths")


def taken(segments: DataFrame, paths: DataFrame) -> DataFrame:
    """conv_id, segment, positions, edits and written: what each row's edits write on the chosen path. Staged."""
    p = paths.select(F.col("conv_id").alias("c"), F.inline("path")).withColumnRenamed("segment", "s")
    t = segments.join(p.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")))
    t = t.select("conv_id", "segment", "positions", "symbols", "entry", F.element_at("edits", (F.col("entry") * STATES + F.col("exit") + 1)).alias("edits"))

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("symbols", "edits", "entry")), strict=True)
            written = pa.array([outputs(*r) for r in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "segment", "positions", "edits")), written], names=["conv_id", "segment", "positions", "edits", "written"])

    return staged(t.mapInArrow(work, f"conv_id {dict(segments.dtypes)['conv_id']}, segment long, positions array<long>, edits string, written array<string>"), "repair-taken")


def _inserted(initials: Column) -> Column:
    letters = F.filter(F.split(initials, ""), lambda x: x != "")
    return F.transform(letters, lambda x: F.struct(F.when(x == "a", "assistant").otherwise("user").alias("role"), F.lit("").alias("text")))


def repaired(rows: DataFrame, steps: DataFrame, paths: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, pos, nth (order within pos), role, text. Rows put in have an empty text."""
    each = F.regexp_extract_all("edits", F.lit("I*[KRD]"), F.lit(0))
    edits = steps.select(F.inline(F.arrays_zip(F.col("positions").alias("at"), each.alias("edit"), F.col("written").alias("written"))))
    r = rows.join(edits.hint("merge"), F.col("pos") == F.col("at"))
    before = F.length("edit") - 1
    put_in = _inserted(F.expr("substring(written, 1, length(edit) - 1)"))
    role = F.when(F.col("edit").endswith("K"), F.col("role")).when(F.substring("written", -1, 1) == "a", "assistant").otherwise("user")
    own = F.when(F.col("edit").endswith("D"), F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(role.alias("role"), F.col("text").alias("text"))))
    out = r.select("conv_id", "pos", F.posexplode(F.concat(F.when(before > 0, put_in).otherwise(F.array().cast("array<struct<role:string,text:string>>")), own)).alias("nth", "row"))
    tail = paths.where("tail <> ''").select("conv_id", F.lit(2**63 - 1).alias("pos"), F.posexplode(_inserted(F.expr("if(tail = 'II', 'ua', 'a')"))).alias("nth", "row"))
    return out.unionByName(tail).select("conv_id", "pos", "nth", "row.role", "row.text")


def digest(turns: DataFrame) -> DataFrame:
    """A row for each conversation of turns: its faults, the cost and edits of its repair, and the hash of what is left."""
    rows = numbered(turns)
    segments = segmented(rows)
    paths = chosen(segments)
    steps = taken(segments, paths)
    count = lambda k: F.count(F.when(F.col("fault") == k, 1))
    spread = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    faults = rows.groupBy("conv_id").agg(spread.cast("long").alias("gaps"), count(1).alias("blank"), count(2).alias("duplicate"), count(3).alias("truncated"))
    audit = steps.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("segment", "edits")))["edits"], "").alias("edits"))
    line = F.struct("pos", "nth", F.concat("role", F.lit(":"), "text").alias("line"))
    text = repaired(rows, steps, paths).groupBy("conv_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line))["line"], "\n"), 256).alias("repaired_sha256"))
    out = faults
    for k, more in enumerate((paths.select("conv_id", "cost", "illegal", "tail"), audit, text)):
        out = out.join(more.withColumnRenamed("conv_id", f"c{k}").hint("merge"), F.col("conv_id").eqNullSafe(F.col(f"c{k}")), "left").drop(f"c{k}")
    return out.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.concat("edits", "tail").alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """turns with the faults that crc32 of `conv_id:turn` deals out."""
    space = F.lit(" ")
    of = lambda c: F.coalesce(F.col(c).cast("string"), space)
    t = turns.select("conv_id", "turn", of("role").alias("role"), of("text").alias("text"), (F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn"))) % 20).alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    t = t.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return t.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy", "kind")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = digest(damaged(turns)).withColumnRenamed("conv_id", "c")
    every = turns.select("conv_id").distinct()
    out = every.join(found.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(k) + 1), lambda i: [ascii(substr(k, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"""
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
dealt AS (SELECT *, {_CRC} % 20 AS kind FROM keyed),
after AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text FROM dealt JOIN (VALUES (1), (2)) t(copy) ON copy = 1 OR kind = 3 WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, {_WHITE}) AS body FROM after),
copies AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen FROM placed),
judged AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault, left(role, 1) AS letter,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prior FROM copies),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE prior IS NOT NULL AND prior || letter NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM judged GROUP BY conv_id),
-- from each state of the grammar: up to two rows put in; then the row is kept, gets another role or goes
filled(g, edits, lines, mid) AS (VALUES (0, '', '', 0), (0, 'I', 'user:' || chr(10), 2), (0, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 3), (1, '', '', 1), (1, 'I', 'user:' || chr(10), 2), (1, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 3),
    (2, '', '', 2), (2, 'I', 'assistant:' || chr(10), 3), (2, 'II', 'assistant:' || chr(10) || 'user:' || chr(10), 2), (3, '', '', 3), (3, 'I', 'user:' || chr(10), 2), (3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 3)),
rules(mid, letter, role, nxt) AS (VALUES (0, 's', NULL, 1), (0, 'u', 'user', 2), (1, 'u', 'user', 2), (2, 'a', 'assistant', 3), (3, 'u', 'user', 2)),
walk(conv_id, pos, g, cost, edits, lines) AS (
  SELECT conv_id, 0::BIGINT, 0, 0::BIGINT, '', '' FROM counted
  UNION ALL
  SELECT conv_id, pos, g, cost, edits, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, g ORDER BY cost, edits) AS best FROM (
      SELECT w.conv_id, j.pos, CASE WHEN e.edit = 'D' THEN f.mid ELSE r.nxt END AS g,
        w.cost + 3 * length(f.edits) + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e.edit <> 'D' AND j.fault = 'truncated' THEN 3 ELSE 0 END AS cost,
        w.edits || f.edits || e.edit AS edits,
        w.lines || f.lines || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN j.role || ':' || j.text || chr(10) ELSE r.role || ':' || j.text || chr(10) END AS lines
      FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos + 1 JOIN filled f ON f.g = w.g
      JOIN (VALUES ('D'), ('K'), ('R')) e(edit) ON e.edit = 'D' OR j.fault NOT IN ('blank', 'duplicate')
      LEFT JOIN rules r ON e.edit <> 'D' AND r.mid = f.mid AND (e.edit = 'R' AND r.role IS NOT NULL OR e.edit = 'K' AND r.letter = j.letter)
      WHERE e.edit = 'D' OR r.nxt IS NOT NULL)) WHERE best = 1),
ended AS (SELECT w.conv_id, w.cost + 3 * length(x.tail) AS cost, w.edits || x.tail AS audit, w.lines || x.more AS lines, row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 3 * length(x.tail), w.edits || x.tail) AS best
  FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.pos
  JOIN (VALUES (0, '', ''), (1, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 'I', 'assistant:' || chr(10)), (3, '', '')) x(g, tail, more) ON x.g = w.g)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(lines, greatest(length(lines) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN (SELECT * FROM ended WHERE best = 1) e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""
