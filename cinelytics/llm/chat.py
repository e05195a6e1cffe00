"""Relational chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by (turn, role,
text); adjacent turns of one role merge into a block by array functions: the block
starts are the positions whose role differs from the one before, and a block's turns
are the slice up to the next start.  Each block is

    OPEN role SEP text (JOIN text)* CLOSE

with the template's control strings.  Control strings inside roles and texts are
escaped: one ``ESCAPE`` goes behind their first character; a string that already has
such escapes gets one more, so removing one undoes it exactly.  A formatted text
therefore holds control strings only where the template put them.

The loss mask is a list of [start, start + length) spans in code points: the escaped
texts of the trained role, without the joins between them.  ``read_back`` parses a
formatted conversation and its mask into turns and loss text.

Null text is empty, a null role is the empty role, rows without a conversation id
form one conversation without an id, and equal turn numbers sort by role and text;
repeated rows are turns of their own.  An empty table gives no conversations.  One
conversation is one output row, so its size is bounded by what a row can hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    open: str = "<s>[INST]"
    sep: str = "[/INST]"
    join: str = "<<SYS>>"
    close: str = "</s>"
    also: tuple[str, ...] = ("[INST]", "<s>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    train_role: str = "assistant"

    @property
    def controls(self) -> list[str]:
        return sorted({self.open, self.sep, self.join, self.close, *self.also}, key=lambda s: (-len(s), s))


ESCAPE = "\\"


def _quote(s: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c not in "<>/_ " else c for c in s)


def escape(text: Column, template: Template) -> Column:
    firsts = sorted({c[0] for c in template.controls})
    for f in firsts:
        rests = "|".join(_quote(c[1:]) for c in template.controls if c[0] == f)
        text = F.regexp_replace(text, F.lit(f"{_quote(f)}(?=\\\\*(?:{rests}))"), F.lit(f"{f}\\\\"))
    return text


def unescape(text: Column, template: Template) -> Column:
    firsts = sorted({c[0] for c in template.controls})
    for f in reversed(firsts):
        rests = "|".join(_quote(c[1:]) for c in template.controls if c[0] == f)
        text = F.regexp_replace(text, F.lit(f"{_quote(f)}\\\\(?=\\\\*(?:{rests}))"), F.lit(f))
    return text


def format_chats(turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, loss_spans: array<struct<start, length>> in code points."""
    t = template
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
                 F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).alias("t"))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    # positions (from 1) where a block starts
    out = out.withColumn("starts", F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (
        F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"])))
    blocks = F.transform("starts", lambda s, j: F.struct(
        F.get("turns", s - 1)["role"].alias("role"),
        F.transform(F.slice("turns", s, F.coalesce(F.get("starts", j + 1), n + 1) - s),
                    lambda x: escape(x["text"], t)).alias("texts")))
    out = out.withColumn("blocks", blocks)
    # (text, whether it is under the loss mask) in output order
    segments = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(F.struct(F.concat(F.lit(t.open), escape(b["role"], t), F.lit(t.sep)).alias("s"), F.lit(False).alias("on"))),
        F.flatten(F.transform(b["texts"], lambda x, k: F.array(
            F.struct(F.when(k > 0, F.lit(t.join)).otherwise(F.lit("")).alias("s"), F.lit(False).alias("on")),
            F.struct(x.alias("s"), (b["role"] == t.train_role).alias("on"))))),
        F.array(F.struct(F.lit(t.close).alias("s"), F.lit(False).alias("on"))))))
    out = out.select("conv_id", segments.alias("segments"))
    zero = F.struct(F.lit(0).cast("long").alias("at"),
                    F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    walk = F.aggregate("segments", zero, lambda acc, x: F.struct(
        (acc["at"] + F.length(x["s"])).alias("at"),
        F.when(x["on"], F.concat(acc["spans"], F.array(F.struct(
            acc["at"].alias("start"), F.length(x["s"]).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans")))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda x: x["s"]), "").alias("formatted"),
                      walk["spans"].alias("loss_spans"))


def read_back(formatted: DataFrame, template: Template = Template(), role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, turns: array<struct<role, text>>, loss_text: parsed from the output alone."""
    t = template
    blocks = F.transform(F.filter(F.split("formatted", _quote(t.close)), lambda b: b != ""), lambda b: F.substring(
        b, F.lit(len(t.open) + 1), F.length(b)))
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.split(b, _quote(t.sep), 2)[1], _quote(t.join)), lambda x: F.struct(
            unescape(F.split(b, _quote(t.sep), 2)[0], t).alias(role_col), unescape(x, t).alias(text_col)))))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(
        "formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")), t)), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def q_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over whole ``conversations`` plus the fixed conversation -7."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = turns.sparkSession.sql(
        f"SELECT -7L conv_id, 0L turn, 'user' role, '{probe}' text UNION ALL SELECT -7L, 1L, 'assistant', '{probe}'")
    back = read_back(format_chats(turns.unionByName(more)))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""),
               256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def _sql_escape(column: str, template: Template = Template()) -> str:
    """Length after escaping; DuckDB has no look-ahead, so the composed OPEN counts by its two parts."""
    parts = "|".join(f"{_quote(c[0])}\\\\*{_quote(c[1:])}" for c in template.controls if c != template.open)
    return f"length({column}) + len(regexp_extract_all({column}, '{parts}'))"


_T = Template()
SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM c),
b AS (SELECT *, n = 1 OR role <> lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS first FROM o)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({_sql_escape("text")} + CASE WHEN first THEN {len(_T.open) + len(_T.sep) + len(_T.close)}
            + {_sql_escape("role")} ELSE {len(_T.join)} END) AS BIGINT) AS formatted_chars
FROM b GROUP BY conv_id"""
