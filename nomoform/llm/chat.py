"""Chat formatting by prefix-target expansion, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Control strings of the template and how they look inside a text.
ROLE_OPEN, ROLE_CLOSE, TURN_END = "[INST]", "[/INST]", "</s>"
ESCAPES = (("\\", "\\\\"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]"), ("</s>", "<\\/s>"))

#: Examples of one conversation that are written by one task.
SLICE = 64


def escape(text: Column) -> Column:
    """Reversibly hide control strings: backslashes double, then each control string gets one."""
    for plain, hidden in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(hidden))
    return text


def unescape(text: Column) -> Column:
    for plain, hidden in reversed(ESCAPES):
        text = F.replace(text, F.lit(hidden), F.lit(plain))
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """All examples of :func:`formatted_parts` in one table."""
    short, long = formatted_parts(turns)
    return short.unionByName(long)


def formatted_parts(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for every assistant turn: all turns so far, only that reply trainable.

    ``turns``: conv_id, turn, role, text; other columns are ignored. Returns
    conv_id, example (from 0), text, loss_start, loss_end (code points of the
    escaped reply in ``text``; null if the example has no reply) and is_last.
    A conversation that does not end in an assistant turn gets one more example
    without trainable text, so that no turn is lost.

    Null text or role is empty, a null turn number sorts first, equal turn
    numbers sort by role and text, and a null conv_id is a conversation of its
    own. An empty table gives no rows.

    A conversation is gathered once, as its last example holds all of it anyway.
    The examples, which grow with the square of its turns, are written ``SLICE``
    at a time: conversations of up to as many examples, the first table, stay
    where they were grouped; slices of longer ones, the second, are dealt to tasks,
    each with the turns up to its last reply.
    """
    parts = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (F.element_at("ts", i)["role"] == "assistant") | (i == F.col("n")))
    ended = whole.withColumn("n", F.size("ts")).withColumn("ends", ends)
    few = ended.where(F.size("ends") <= SLICE).select("conv_id", "ts", "ends", "n", F.lit(0).alias("first"))
    many = ended.where(F.size("ends") > SLICE).withColumn("first", F.explode(F.sequence(F.lit(0), F.size("ends") - 1, F.lit(SLICE))))
    mine = F.slice("ends", F.col("first") + 1, F.lit(SLICE))
    prefix = F.slice("ts", F.lit(1), F.element_at(mine, -1))
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A stated count of partitions, as few bytes go in where many come out.
    dealt = many.select("conv_id", prefix.alias("ts"), mine.alias("ends"), "n", "first").repartition(tasks, "conv_id", "first")
    return _examples(few), _examples(dealt)


def _examples(conversations: DataFrame) -> DataFrame:
    """The examples of conversations: conv_id, ts (turns), n, ends (the examples' last turns), first (the first one's number)."""

    def head(t: Column) -> Column:
        return F.concat(F.lit(ROLE_OPEN), escape(t["role"]), F.lit(ROLE_CLOSE))

    formatted = conversations.select(
        "conv_id",
        F.transform(
            "ts",
            lambda t: F.struct(
                (t["role"] == "assistant").alias("reply"),
                F.length(head(t)).alias("head_chars"),
                F.concat(head(t), escape(t["text"]), F.lit(TURN_END)).alias("body"),
            ),
        ).alias("ts"),
        "ends",
        "first",
        "n",
    )
    examples = formatted.select("conv_id", "ts", "n", "first", F.posexplode("ends").alias("place", "upto")).withColumn("example", F.col("first") + F.col("place"))
    last = F.element_at("ts", F.col("upto"))
    with_text = examples.select(
        "conv_id",
        "example",
        last["reply"].alias("reply"),
        last["head_chars"].alias("head_chars"),
        F.length(last["body"]).alias("last_chars"),
        F.concat_ws("", F.transform(F.slice("ts", 1, F.col("upto")), lambda t: t["body"])).alias("text"),
        (F.col("upto") == F.col("n")).alias("is_last"),
    )
    start = F.length("text") - F.col("last_chars") + F.col("head_chars")
    return with_text.select(
        "conv_id",
        "example",
        "text",
        F.when(F.col("reply"), start).alias("loss_start"),
        F.when(F.col("reply"), F.length("text") - len(TURN_END)).alias("loss_end"),
        "is_last",
    )


def parse_turns(text: Column) -> Column:
    """Read a formatted text back: array of (role, text)."""
    pieces = F.filter(F.split(text, r"</s>", -1), lambda p: F.length(p) > 0)

    def one(piece: Column) -> Column:
        return let(
            F.split(F.substr(piece, F.lit(len(ROLE_OPEN) + 1)), r"\[/INST\]", 2),
            lambda rt: F.struct(unescape(rt[0]).alias("role"), unescape(rt[1]).alias("text")),
        )

    return F.transform(pieces, one)


def digest(*parts: DataFrame) -> DataFrame:
    """Per conversation, what the formatted examples hold when read back.

    Tables that share no conversation, as of :func:`formatted_parts`, are read
    apart: one that is still grouped by conversation is not shuffled again.
    """
    return reduce(DataFrame.unionByName, map(_digest, parts))


def _digest(examples: DataFrame) -> DataFrame:
    masked = unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    said = F.when(F.col("is_last"), parse_turns(F.col("text")))
    rows = examples.select(
        "conv_id",
        "example",
        F.length("text").cast("long").alias("chars"),
        F.when(F.col("loss_start").isNotNull(), masked).alias("loss"),
        let(
            said,
            lambda t: F.struct(
                F.size(t).cast("long").alias("n"),
                F.sha2(F.concat_ws("", F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))), 256).alias("sha"),
            ),
        ).alias("back"),
        "is_last",
    )
    by_conv = rows.groupBy("conv_id").agg(
        F.max(F.when(F.col("is_last"), F.col("back.n"))).alias("n_turns"),
        F.max(F.when(F.col("is_last"), F.col("back.sha"))).alias("turns_sha256"),
        F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
    )
    loss = F.concat_ws("", F.transform("losses", lambda x: x["loss"]))
    return by_conv.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
