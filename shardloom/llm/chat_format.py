"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

The template gives each role an opening mark and says whether its text is trained on; every turn ends with one closing
mark. Inside texts a control string gets one backslash more after its first character (``</s>`` becomes ``<\\/s>``,
``<\\/s>`` becomes ``<\\\\/s>``), which can always be undone and leaves no control string in a text.

A conversation is one output row, so its turns meet in one aggregation buffer: its size is that of the row to be written.

Null or odd input: a null text is empty, a null role is the empty role; an unknown role gets a mark with its name in
URL encoding. Turns are ordered by turn, then role, then text; a null turn comes first. Rows with a null conv_id form one
conversation. An empty table gives an empty result; further columns are not returned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from shardloom.llm.registry import query, table


@dataclass(frozen=True)
class Template:
    """Marks of the roles, which of them are trained on, and the transitions of the state machine (state = last role)."""

    marks: dict[str, str] = field(default_factory=lambda: {"system": "SYS", "user": "INST", "assistant": "/INST"})
    trained: tuple[str, ...] = ("assistant",)
    transitions: tuple[tuple[str, str], ...] = (
        ("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"),
    )
    final: tuple[str, ...] = ("assistant",)
    close: str = "</s>"

    @property
    def controls(self) -> str:
        """Pattern of what may follow the first character of a control string."""
        marks = "|".join(f"{m}\\]" for m in self.marks.values())
        return f"s>|/s>|{marks}|ROLE="


LLAMA = Template()


def escape(text: Column, t: Template = LLAMA) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({t.controls})", r"$1\\$2$3")


def unescape(text: Column, t: Template = LLAMA) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({t.controls})", "$1$2$3")


def _lookup(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def opening(role: Column, t: Template = LLAMA) -> Column:
    known = F.element_at(_lookup(t.marks.items()), role)
    return F.concat(F.lit("<s>["), F.coalesce(known, F.concat(F.lit("ROLE="), F.url_encode(role))), F.lit("] "))


def format_chats(turns: DataFrame, t: Template = LLAMA) -> DataFrame:
    """One row per conversation: ``conv_id``, ``valid``, ``segments`` (text, loss), ``formatted``, ``loss_spans``.

    ``valid`` says whether the roles follow the state machine; invalid conversations are formatted all the same. Spans
    are (start, length) in code points of ``formatted``.
    """
    clean = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # Texts are escaped row by row, before they meet.
    rows = clean.select("conv_id", F.struct("turn", "role", "text", opening(F.col("role"), t).alias("open"), escape(F.col("text"), t).alias("body")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("t.turn", "t.role", "t.text", "t.open", "t.body"))).alias("turns"))
    steps = _lookup((f"{a}>{b}", b) for a, b in t.transitions)
    state = F.aggregate(
        F.transform("turns", lambda x: x["role"]), F.lit("start"),
        lambda at, role: F.coalesce(F.element_at(steps, F.concat(at, F.lit(">"), role)), F.lit("error")),
    )
    trained = lambda x: x["role"].isin(*t.trained)
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        segment(x["open"], F.lit(False)), segment(x["body"], trained(x)), segment(F.lit(t.close), F.lit(False))
    )))
    chats = chats.select("conv_id", state.isin(*t.final).alias("valid"), segments.alias("segments"))
    spans = F.aggregate(
        F.transform("segments", lambda s: F.struct(F.length(s["text"]).cast("long").alias("n"), s["loss"].alias("loss"))),
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["n"]).alias("at"),
            F.when(s["loss"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), s["n"].alias("length")))))
            .otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return chats.select(
        "conv_id", "valid", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_chats(formatted: DataFrame, t: Template = LLAMA) -> DataFrame:
    """The turns and the trained text, from ``formatted`` and ``loss_spans`` alone."""
    pieces = F.filter(F.split("formatted", F.lit(t.close), -1), lambda p: p != "")
    tag = lambda p: F.regexp_extract(p, r"^<s>\[([^\]]*)\] ", 1)
    roles = _lookup((mark, role) for role, mark in t.marks.items())
    role = lambda g: F.coalesce(F.element_at(roles, g), F.url_decode(F.substring(g, len("ROLE=") + 1, 1 << 30)))
    turns = F.transform(pieces, lambda p: F.struct(
        role(tag(p)).alias("role"), unescape(F.substr(p, F.length(tag(p)) + F.lit(len("<s>[] ") + 1)), t).alias("text")
    ))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")), t)), "")
    return formatted.select("*", turns.alias("turns"), loss.alias("loss_text"))


OP3_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(s>|/s>|SYS\]|INST\]|/INST\]|ROLE=)', '\1\\\2\3', 'g') AS body,
  CASE role WHEN 'system' THEN 'SYS' WHEN 'user' THEN 'INST' WHEN 'assistant' THEN '/INST' ELSE 'ROLE=' || url_encode(role) END AS mark,
  lag(role, 1, 'start') OVER turns || '>' || role AS step, lead(role) OVER turns IS NULL AND role <> 'assistant' AS open_end
  FROM c WINDOW turns AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<s>[' || mark || '] ' || body || '</s>'))::BIGINT AS formatted_chars,
  bool_and(NOT open_end AND step IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AS valid
FROM f GROUP BY conv_id
"""


@query("op3_chat_formatting", OP3_SQL)
def op3_chat_formatting(spark, sf_dir):
    extra = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_chats(format_chats(turns))
    digest = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
