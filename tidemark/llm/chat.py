"""Chat formatting in budgeted windows. DataFrame operations only.

A conversation's turns, in order, get prefix sums of their tokens. With the system turn and the history budget
set aside, half of what is left of the budget is the stride: a turn falls into the span in which its prefix sum
ends, so a span's turns take less than two strides, unless one turn is longer than a stride. Each span is
written as one window: the system turn, then the latest earlier turns that fit the history budget, then the
span's own turns. The loss mask of a window covers the texts of its own assistant turns; the system turn and
history that are written again are outside it, so each target counts once.

A turn is written as `### role: text</turn>` and a line feed, or `#~# role: text</turn>` if written again. In
roles and texts `\\` becomes `\\b`, `#` becomes `\\h`, `<` becomes `\\l` and, in roles, `:` becomes `\\c`: no
written text holds a mark of the template, and `unescape` gives the text back.

Defined cases: a null text or role is empty; turns are ordered by turn (null first), then role, then text, and
repeated rows stay separate turns; a null conv_id is a conversation of its own; an empty table gives no rows;
extra columns of the input are ignored. A window is a row; work grows with the turns and what is written. Only the
digest of the query gathers a conversation's texts in one row, as its hash covers them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Budgets in tokens; a token is taken as CHARS_PER_TOKEN characters of the written turn.
BUDGET = 512
HISTORY = 96
CHARS_PER_TOKEN = 4
OWN, AGAIN, END = "### ", "#~# ", "</turn>\n"


def escape(text: Column) -> Column:
    for raw, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in (("<", "\\l"), ("#", "\\h"), (":", "\\c"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, span, body and targets of each window; targets are (from, chars) of the loss mask, from 1 on."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("ord", F.row_number().over(order))
    head = F.concat(F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(": "))
    t = t.select("conv_id", "ord", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    t = t.withColumn("is_system", (F.col("ord") == 1) & (F.col("role") == "system"))
    tokens = F.ceil((F.length("head") + F.length("body") + len(OWN) + len(END)) / CHARS_PER_TOKEN).cast("long")
    t = t.withColumn("tokens", tokens).withColumn("counted", F.when(F.col("is_system"), 0).otherwise(F.col("tokens")))
    upto = W.partitionBy("conv_id").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.withColumn("sys_tokens", F.sum(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(upto))
    t = t.withColumn("until", F.sum("counted").over(upto)).withColumn("start", F.col("until") - F.col("counted"))
    stride = F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.col("sys_tokens")) / 2))
    t = t.withColumn("span", F.when(F.col("is_system"), F.lit(0)).otherwise(F.floor((F.col("until") - 1) / stride)).cast("long"))
    by_turn = W.partitionBy("conv_id").orderBy("ord")
    t = t.withColumn("first", F.coalesce(F.lag("span").over(by_turn) != F.col("span"), F.lit(True)))

    # A turn is written in its own span and, as history, in the later spans that begin within the budget behind its own
    # start. These are at most history / (tokens of the shortest turn), however long the conversation is.
    ahead = W.partitionBy("conv_id").orderBy("start").rangeBetween(1, history)
    later = F.collect_list(F.when(F.col("first") & ~F.col("is_system"), F.col("span"))).over(ahead)
    t = t.withColumn("later", F.array_except(F.when(F.col("is_system"), F.array().cast("array<bigint>")).otherwise(later), F.array("span")))
    own = t.select("conv_id", "ord", "role", "head", "body", "is_system", F.explode(F.concat(F.array("span"), "later")).alias("at"), F.col("span"))
    # The system turn is written in all later spans: a row for each window that there is.
    spans = t.where(F.col("first") & ~F.col("is_system")).select("conv_id", F.col("span").alias("at")).where("at > 0").distinct()
    system = t.where("is_system").select(F.col("conv_id").alias("c"), "ord", "role", "head", "body", "is_system", "span")
    kept = spans.join(system.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "ord", "role", "head", "body", "is_system", "at", "span")
    rows = own.unionByName(kept)

    again = F.col("span") < F.col("at")
    part = F.struct("ord", F.concat(F.when(again, AGAIN).otherwise(OWN), "head").alias("lead"), "body", (~again & (F.col("role") == "assistant")).alias("target"))
    windows = rows.groupBy("conv_id", F.col("at").alias("span")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    size = lambda p: F.length(p["lead"]) + F.length(p["body"]) + F.lit(len(END))
    empty = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<from:bigint,chars:bigint>>").alias("targets"))
    masked = F.aggregate("parts", empty, lambda acc, p: F.struct(
        (acc["at"] + size(p)).cast("long").alias("at"),
        F.when(p["target"], F.concat(acc["targets"], F.array(F.struct((acc["at"] + F.length(p["lead"])).cast("long").alias("from"), F.length(p["body"]).cast("long").alias("chars")))))
        .otherwise(acc["targets"]).alias("targets")))
    body = F.array_join(F.transform("parts", lambda p: F.concat(p["lead"], p["body"], F.lit(END))), "")
    return windows.select("conv_id", "span", body.alias("body"), masked["targets"].alias("targets"))


def read_back(windows: DataFrame) -> DataFrame:
    """From the written windows alone, for each: conv_id, span, turns (role, text), loss (text under the mask), formatted_chars."""
    lines = F.filter(F.split("body", F.lit("</turn>\n")), lambda x: x.startswith(OWN))
    turns = F.transform(lines, lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, len(OWN) + 1, 2**31 - 1), ": ", 1)).alias("role"),
        unescape(F.substring(x, F.instr(x, ": ") + 2, F.lit(2**31 - 1))).alias("text")))
    loss = F.array_join(F.transform("targets", lambda s: unescape(F.substring(F.col("body"), s["from"].cast("int"), s["chars"].cast("int")))), "")
    return windows.select("conv_id", "span", turns.alias("turns"), loss.alias("loss"), F.length("body").cast("long").alias("formatted_chars"))


def digest(windows: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    back = read_back(windows).select("conv_id", F.size("turns").alias("n"), F.struct("span", whole.alias("whole"), "loss").alias("part"), "formatted_chars")
    conv = back.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("part")).alias("parts"), F.sum("formatted_chars").alias("formatted_chars"))
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    conv = conv.select("conv_id", "n_turns", joined("whole").alias("whole"), joined("loss").alias("loss"), "formatted_chars")
    return conv.select(
        "conv_id", "n_turns", F.sha2("whole", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: A conversation that holds the template's own marks.
PROBE = "\\### Assistant: </turn> ok"


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digest(format_windows(rows.unionByName(probe)))


_ESCAPED = r"replace(replace(replace({c}, '\', '\b'), '#', '\h'), '<', '\l')"
SQL = f"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS ord FROM rows_),
e AS (SELECT *, length(replace({_ESCAPED.format(c="role")}, ':', '\\c')) + 2 + length({_ESCAPED.format(c="text")}) + {len(OWN) + len(END)} AS size, ord = 1 AND role = 'system' AS is_system FROM o),
k AS (SELECT *, CAST(ceil(size / {CHARS_PER_TOKEN}) AS BIGINT) AS tokens FROM e),
s AS (SELECT *, sum(CASE WHEN is_system THEN tokens ELSE 0 END) OVER w AS sys, sum(CASE WHEN is_system THEN 0 ELSE tokens END) OVER w AS until FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT *, CASE WHEN is_system THEN 0 ELSE floor((until - 1) / greatest(1, floor(({BUDGET - HISTORY} - sys) / 2))) END AS span, until - CASE WHEN is_system THEN 0 ELSE tokens END AS start FROM s),
f AS (SELECT conv_id, span, min_by(start, ord) AS start FROM t GROUP BY conv_id, span),
c AS (SELECT f.conv_id, sum(t.size) AS chars FROM f JOIN t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND (t.span = f.span OR t.span < f.span AND (t.is_system OR f.start - t.start <= {HISTORY})) GROUP BY f.conv_id),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY ord) FILTER (WHERE role = 'assistant'), '') AS loss FROM o GROUP BY conv_id)
SELECT g.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g JOIN c ON c.conv_id IS NOT DISTINCT FROM g.conv_id
"""
