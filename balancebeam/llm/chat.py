"""Chat formatting with a grammar round trip, in DataFrame expressions alone.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. A deterministic parser takes the formatted string apart again. A turn is first rendered as it is and parsed;
where the parser does not give back the same role and text (control strings inside them, or what looks escaped), the turn is rendered escaped, and parsed and compared once
more; a turn that still differed would fail the job. Escaping: every ``<``, backslashes, ``|`` gets one more backslash, and a line feed in a role becomes a control string that no escaped role can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, FEED = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit(FEED))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(FEED), F.lit("\n")))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE + "\n"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted string, unescaped. A part that the grammar does not know gives a null role and text."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(len(OPEN) + 1))
        at = F.instr(body, "\n")
        fits = part.startswith(OPEN) & (at > 0) & ~F.contains(body, F.lit(OPEN)) & ~F.contains(body, F.lit(CLOSE))
        role, text = F.substr(body, F.lit(1), at - 1), F.substr(body, at + 1)
        return F.struct(F.when(fits, unescape_role(role)).alias("role"), F.when(fits, unescape(text)).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def parses_back(as_role: Column, as_text: Column, role: Column, text: Column) -> Column:
    """Whether the rendered turn is read back as one turn of this role and text."""
    back = parse(render(as_role, as_text))
    return (F.size(back) == 1) & F.coalesce((back[0]["role"] == role) & (back[0]["text"] == text), F.lit(False))


def format_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array<struct<start, length>>, in code points from 0: the texts of ``trained`` turns as formatted).

    Turns are ordered by turn, then role and text; a null turn comes first. A null role or text is empty, a null conv_id is one conversation, a repeated row is one more
    turn, an empty table gives no rows. Other columns are not read. Offsets are running sums in a window, so only a conversation's own strings meet in its row.
    """
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("same", parses_back(F.col("role"), F.col("text"), F.col("role"), F.col("text")))
    rows = rows.select("conv_id", "turn", "role", "text", "same", F.when(F.col("same"), F.col("role")).otherwise(escape_role(F.col("role"))).alias("as_role"), F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text"))).alias("as_text"))
    whole = F.col("same") | parses_back(F.col("as_role"), F.col("as_text"), F.col("role"), F.col("text"))
    rows = rows.withColumn("as_text", F.when(whole, F.col("as_text")).otherwise(F.raise_error(F.lit("a formatted turn does not parse back")).cast("string")))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("k", F.row_number().over(w))
    rows = rows.withColumn("end", F.sum(F.length(render(F.col("as_role"), F.col("as_text")))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    start = F.col("end") - len(CLOSE) - 1 - F.length("as_text")
    span = F.when(F.col("role") == trained, F.struct(start.alias("start"), F.length("as_text").cast("long").alias("length")))
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", render(F.col("as_role"), F.col("as_text")).alias("out"), span.alias("span")))).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return gathered.select("conv_id", F.array_join(F.transform("turns", lambda t: t["out"]), "").alias("formatted"), spans.alias("loss_spans"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
