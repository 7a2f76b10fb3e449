"""Chat formatting with a grammar round trip.

A template renders turns as ``<|im_start|>role\\nbody<|im_end|>\\n``. The grammar allows ``<|`` nowhere
but in its own marks, and a reader always unescapes. A turn is rendered as it is, reparsed and
compared; only if that differs from the source, its content is escaped and tried again. One escape
adds a backslash to every ``<\\...\\|``, which leaves no ``<|`` and is undone exactly, so the second
try always succeeds. Each whole conversation is reparsed too, and a difference stops the job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import whole


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    #: Roles whose bodies carry loss.
    learned: tuple[str, ...] = ("assistant",)


CHAT = Template()


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(body: Column) -> Column:
    return F.regexp_replace(body, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """Prefix code without line breaks and ``<|``."""
    for plain, code in (("\\", "\\s"), ("\n", "\\n"), ("<|", "\\p")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(code: Column) -> Column:
    for plain, tag in (("<|", "\\p"), ("\n", "\\n"), ("\\", "\\s")):
        code = F.replace(code, F.lit(tag), F.lit(plain))
    return code


def parse(formatted: Column, template: Template = CHAT) -> Column:
    """array<struct<role, text>> of a formatted conversation; null if it breaks the grammar."""
    pieces = F.split(formatted, _quoted(template.start))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        start = F.length(role) + 2
        body = F.substring(piece, start, F.length(piece) - F.lit(len(template.end)) - start + 1)
        well = piece.endswith(template.end) & (F.instr(piece, "\n") < F.length(piece)) & ~body.contains("<|")
        return F.when(well, F.struct(unescape_role(role).alias("role"), unescape_text(body).alias("text")))

    turns = F.transform(F.slice(pieces, 2, F.size(pieces)), turn)
    return F.when((F.element_at(pieces, 1) == "") & ~F.exists(turns, lambda t: t.isNull()), turns)


def format_chats(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (code points, end exclusive).

    rows: conv_id, turn, role, text; other columns are ignored, whatever their names.
    Null roles and texts count as empty. A null conv_id is a conversation of its own. Turns stand by
    ``turn`` (null first), ties by role then text; repeated rows are turns of their own. An empty table
    gives none. A conversation is the unit of output, so its turns meet in one task; nothing larger does.
    """
    turns = rows.select("conv_id", "turn", whole("role").alias("role"), whole("text").alias("text"))
    head = F.concat(F.lit(template.start), escape_role(F.col("role")), F.lit("\n"))

    def unit(body: Column) -> Column:
        return F.concat(head, body, F.lit(template.end))

    source = F.array(F.struct("role", "text"))
    plain, escaped = F.col("text"), escape_text(F.col("text"))
    again = F.when(F.coalesce(parse(unit(escaped), template) == source, F.lit(False)), escaped)
    body = (
        F.when(~plain.rlike(r"<\\*\|"), plain)  # nothing to conflict: the round trip is the identity
        .when(F.coalesce(parse(unit(plain), template) == source, F.lit(False)), plain)
        .otherwise(F.coalesce(again, F.raise_error(F.lit("a turn does not survive the round trip"))))
    )
    order = ["turn", "role", "text"]
    rendered = (
        turns.withColumn("body", body)
        .withColumn("head", head)
        .withColumn("unit", unit(F.col("body")))
        .withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy(*order)))
        .withColumn("stop", F.sum(F.length("unit")).over(W.partitionBy("conv_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    )
    start = F.col("stop") - F.length("unit") + F.length("head")
    span = F.when(
        F.col("role").isin(*template.learned), F.struct(start.alias("start"), (start + F.length("body")).alias("end"))
    )
    grouped = rendered.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "text", "unit", span.alias("span")))).alias("turns")
    )
    joined = grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["unit"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    same = F.coalesce(parse(F.col("formatted"), template) == F.col("source"), F.lit(False))
    return joined.select(
        "conv_id", "n_turns",
        F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip"))).alias("formatted"),
        "loss_spans",
    )


def read_chats(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, formatted, turns (reparsed) and learned (texts under the loss mask, unescaped)."""
    return formatted.select(
        "conv_id", "formatted",
        parse(F.col("formatted"), template).alias("turns"),
        F.transform(
            "loss_spans",
            lambda s: unescape_text(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
        ).alias("learned"),
    )


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in "|[](){}.*+?^$\\" else c for c in text)
