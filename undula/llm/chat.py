"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and that reply alone is under
the loss mask (`loss_start`, `loss_chars`, in code points). A conversation whose last turn isn't the assistant's gets one
more example with an empty mask, so that the last example of any conversation holds all of its turns.

A turn is written `<|im_start|>role<|im_sep|>text<|im_end|>`. In roles and texts a backslash becomes two, and a
control string of this or another common template gets a backslash behind its first character; so no control string
can come from a text, and taking the character behind each backslash gives the text back.

Defined results: null text and null role are empty; a null turn number sorts first; turns of equal number sort by role, then text,
and repeated rows stay; rows of a null conv_id form one conversation; an empty table gives no rows; columns that
the template doesn't use are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm.common import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings that texts may not contain: this template's and those of other common ones. Fixed values.
CONTROL = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _quote(s: str) -> str:
    return "".join(f"\\{c}" if c in "\\|[](){}.*+?^$/" else c for c in s)


_FIRST = r"([<\[])(?=" + "|".join(_quote(c[1:]) for c in CONTROL) + ")"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _FIRST, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_examples(conversations: DataFrame, reply_role: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start (code points before the mask), loss_chars."""
    text = escape(F.coalesce(F.col("text").cast("string"), F.lit("")))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    head = F.concat(F.lit(START), escape(role), F.lit(SEP))
    turns = conversations.select(
        "conv_id",
        F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("body"), head.alias("head")).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    rendered = whole.withColumn("parts", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))))
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("turns", i.cast("int"))["role"] == reply_role) | (i == n))
    one = rendered.select("conv_id", "turns", "parts", F.posexplode(ends).alias("example", "upto"))
    last = F.element_at("turns", F.col("upto"))
    is_reply = last["role"] == reply_role
    prefix = F.array_join(F.slice("parts", F.lit(1), F.col("upto") - 1), "")
    return one.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        prefix.alias("prefix"),
        F.element_at("parts", F.col("upto")).alias("last"),
        F.when(is_reply, F.length(last["head"])).otherwise(0).alias("head_chars"),
        F.when(is_reply, F.length(last["body"])).otherwise(0).cast("long").alias("loss_chars"),
    ).select(
        "conv_id",
        "example",
        F.concat("prefix", "last").alias("formatted"),
        F.when(F.col("loss_chars") > 0, F.length("prefix") + F.col("head_chars")).otherwise(0).cast("long").alias("loss_start"),
        "loss_chars",
    )


def parse_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds, as an array of (role, text)."""
    segments = F.split(formatted, _quote(END))
    bodies = F.slice(segments, F.lit(1), F.size(segments) - 1)

    def turn(s: Column) -> Column:
        two = F.split(F.substring(s, len(START) + 1, 2**31 - 1), _quote(SEP))
        return F.struct(unescape(two[0]).alias("role"), unescape(two[1]).alias("text"))

    return F.transform(bodies, turn)


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples say when read back: turns from the last, masked text from each in order."""
    masked = unescape(F.col("formatted").substr(F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int")))
    read = examples.select("conv_id", "example", F.length("formatted").cast("long").alias("chars"), masked.alias("masked"), "formatted")
    by = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("example", "masked"))).alias("masks"),
    )
    by = by.select("conv_id", parse_turns(F.col("whole")).alias("turns"), "formatted_chars", F.array_join(F.transform("masks", lambda m: m["masked"]), "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The conversation that is formatted beside the table's own.
PROBE = "</s>[INST] ok [/INST]"


def op2_chat(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(format_examples(rows.unionByName(probe)))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    length('<|im_start|><|im_sep|><|im_end|>') + length(regexp_replace(replace(role, '\', '\\'), '(<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)', '#\1', 'g'))
    + length(regexp_replace(replace(text, '\', '\\'), '(<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)', '#\1', 'g')) AS chars
  FROM c
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(total) FILTER (WHERE role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars
FROM (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS total FROM s)
GROUP BY conv_id
"""
