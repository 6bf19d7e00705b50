"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every turn becomes one segment ``<|im_start|>role<|im_sep|>text<|im_end|>``. In roles and texts a backslash is put behind
each of ``\\ < [ |``; no control string (``</s>``, ``[INST]``, ``<|im_end|>`` and the like) survives that, and dropping
the backslash behind those characters restores the text.

An example is an assistant turn with all turns before it as context, and only the reply's text is trainable. Writing out
each context would cost the square of a conversation's length, so a conversation is stored once, as a stream of bounded
chunks, and each example holds offsets into it: the context is everything in front of ``start``, the target
``[start, start + length)``. ``expand_examples`` makes one row for each example, with offsets into the whole conversation's
stream, and the query's loss columns come from it; ``expand_examples(with_text=True)`` writes contexts out in full.

Defined cases: a null text or role is empty; turns sort by (turn, role, text) with nulls first, so repeated rows stay and
ties have one order; a null conv_id is a conversation of its own; conversations without an assistant turn have a stream and
no example; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sums_before
from ._common import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Turns of a chunk. A conversation of any length is formatted in parts of this many turn numbers.
CHUNK_TURNS = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[|])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[|])\\", "$1")


def format_conversations(conversations: DataFrame, trainable_role: str = "assistant", chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """conv_id, chunk, n_turns, stream, examples: array of (start, length), offsets in code points of this chunk's stream."""
    turns = conversations.select(
        "conv_id",
        F.floor(F.col("turn") / chunk_turns).alias("chunk"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    chunks = turns.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segments = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), escape(t.role), F.lit(SEP)).alias("head"),
            escape(t.text).alias("body"),
            (t.role == trainable_role).alias("trains"),
        ),
    )
    chunks = chunks.select("conv_id", "chunk", segments.alias("segments"))
    size = lambda t: F.length(t).cast("long")
    starts = sums_before(F.transform("segments", lambda s: size(s["head"]) + size(s["body"]) + len(END)))
    spans = F.transform(
        F.filter(F.arrays_zip(F.col("segments").alias("s"), starts.alias("at")), lambda x: x["s"]["trains"]),
        lambda x: F.struct((x["at"] + size(x["s"]["head"])).alias("start"), size(x["s"]["body"]).alias("length")),
    )

    return chunks.select(
        "conv_id",
        "chunk",
        F.size("segments").cast("long").alias("n_turns"),
        F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"], F.lit(END))), "").alias("stream"),
        spans.alias("examples"),
    )


def expand_examples(formatted: DataFrame, with_text: bool = False) -> DataFrame:
    """One row for each assistant turn: conv_id, chunk, example, start, length, target.

    ``example`` and ``start`` count from the conversation's first turn, over its chunks in order. ``with_text`` adds
    ``context``, everything in front of the target: the streams of earlier chunks and the beginning of the own one.
    """
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda n: F.coalesce(F.sum(n.cast("long")).over(before), F.lit(0).cast("long"))
    rows = formatted.select(
        "conv_id",
        "chunk",
        "stream",
        "examples",
        sum_before(F.length("stream")).alias("base"),
        sum_before(F.size("examples")).alias("n_before"),
        *([F.array_join(F.collect_list("stream").over(before), "").alias("earlier")] if with_text else []),
    )
    rows = rows.select("*", F.posexplode("examples").alias("pos", "span"))
    return rows.select(
        "conv_id",
        "chunk",
        (F.col("n_before") + F.col("pos")).alias("example"),
        (F.col("base") + F.col("span.start")).alias("start"),
        F.col("span.length").alias("length"),
        F.expr("substring(stream, int(span.start) + 1, int(span.length))").alias("target"),
        *([F.expr("concat(earlier, substring(stream, 1, int(span.start)))").alias("context")] if with_text else []),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the streams say: conv_id, chunk, n_turns, turns_text (role, newline, text, newline for each turn), formatted_chars."""
    turn = lambda t: F.split(F.substring_index(t, START, -1), F.lit(r"<\|im_sep\|>"), 2)
    parsed = F.transform(
        F.filter(F.split("stream", r"<\|im_end\|>"), lambda t: t != ""),
        lambda t: F.concat(unescape(turn(t)[0]), F.lit("\n"), unescape(turn(t)[1]), F.lit("\n")),
    )
    return formatted.select(
        "conv_id",
        "chunk",
        "n_turns",
        F.array_join(parsed, "").alias("turns_text"),
        F.length("stream").cast("long").alias("formatted_chars"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """One row for each conversation. A digest needs the whole text in order; only finished chunks meet for it."""
    parts = read_back(formatted).groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("chunk", "turns_text"))).alias("parts"),
        F.sum("formatted_chars").alias("formatted_chars"),
    )
    turns = F.array_join(F.transform("parts", lambda p: p.turns_text), "")
    examples = expand_examples(formatted).groupBy(F.col("conv_id").alias("_conv_id")).agg(
        F.sort_array(F.collect_list(F.struct("start", "example", unescape(F.col("target")).alias("text")))).alias("examples")
    )
    loss = F.array_join(F.transform("examples", lambda e: e.text), "")
    examples = examples.select("_conv_id", F.length(loss).cast("long").alias("chars"), F.sha2(loss, 256).alias("sha256"), F.size("examples").cast("long").alias("n"))
    return parts.join(examples, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left").select(
        "conv_id",
        "n_turns",
        F.sha2(turns, 256).alias("turns_sha256"),
        F.coalesce("chars", F.lit(0).cast("long")).alias("loss_chars"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("loss_sha256"),
        "formatted_chars",
        F.coalesce("n", F.lit(0).cast("long")).alias("n_examples"),
    )


#: Fixed by the query's contract: a conversation whose texts look like control strings.
PLANTED_ID, PLANTED_TEXT = -7, "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql(
        f"SELECT CAST({PLANTED_ID} AS BIGINT) conv_id, CAST(n AS BIGINT) turn, IF(n = 0, 'user', 'assistant') role, "
        f"'{PLANTED_TEXT}' text FROM VALUES (0), (1) AS v(n)"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return digest(format_conversations(rows))


QUERIES = {"op3_chat_format": op3_chat_format}
ORACLE_SQL = {
    "op3_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(32 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[|]', '', 'g'))) AS BIGINT) AS formatted_chars,
  CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS n_examples
FROM c GROUP BY conv_id""",
}
