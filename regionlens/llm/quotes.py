"""Quotation linking and reply-ordered conversations, with DataFrame operations only.

Quote levels are the ``>`` signs before a line. Quoted passages (runs of lines of one level) are
normalised, hashed whole, by paragraph and by line, and joined to the earlier messages of the
conversation whose own words hold the same unit; the latest such message is the one quoted. A message
answers the message that its outermost linked passage quotes. A conversation is ordered thread by
thread: by the turn of the thread's first message, then by turn, so that no reply comes before what it
answers. The texts are returned without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import positions, table, written

TURNS = 1024
"""Turns looked at by one task of the as-of join; earlier ones come in as one row per block."""
_QUOTE = r"^[ \t]*>"
_MARKS = r"^([ \t]*>)+[ \t]?"
_NO_CONV = -(1 << 63)


def _lines(text: Column) -> Column:
    return F.split(text, "\r\n|\r|\n")


def normal(text: Column) -> Column:
    """Lower case, white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def own_text(text: Column) -> Column:
    """The lines that are no quotes, without empty lines at the ends; a text without quotes as it is."""
    kept = F.filter(_lines(text), lambda x: ~x.rlike(_QUOTE))
    return F.when(_has_quote(text), F.regexp_replace(F.array_join(kept, "\n"), r"^\s*\n|\s+$", "")).otherwise(text)


def _has_quote(text: Column) -> Column:
    return F.coalesce(F.exists(_lines(text), lambda x: x.rlike(_QUOTE)), F.lit(False))


def units(text: Column) -> Column:
    """Distinct non-empty normalised forms of a text, of its paragraphs and of its lines."""
    parts = F.concat(F.array(text), F.split(text, r"(\r?\n[ \t]*){2,}"), _lines(text))
    return F.array_distinct(F.filter(F.transform(parts, normal), lambda x: F.length(x) > 0))


def passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, passage) of messages (conv, turn, text): runs of quoted lines of one level."""
    quoting = messages.where(_has_quote(F.col("text"))).select("conv", "turn", "text", F.xxhash64("text").alias("digest")).distinct()
    lines = quoting.select("conv", "turn", "digest", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    marks = F.regexp_extract("line", _MARKS, 0)
    lines = lines.withColumn("level", F.length(marks) - F.length(F.translate(marks, ">", "")))
    message = Window.partitionBy("conv", "turn", "digest").orderBy("at")  # one message's lines
    new = F.when(F.col("level") == F.lag("level").over(message), 0).otherwise(1)
    runs = lines.withColumn("new", new).withColumn("run", F.sum("new").over(message)).where("level > 0")
    body = F.regexp_replace("line", _MARKS, "")
    runs = runs.groupBy("conv", "turn", "digest", "run", "level").agg(F.array_sort(F.collect_list(F.struct("at", body.alias("line")))).alias("x"))
    return runs.select("conv", "turn", "level", F.array_join("x.line", "\n").alias("passage"))


def _as_of(asked: DataFrame, held: DataFrame) -> DataFrame:
    """``asked`` (conv, hash, turn; distinct) with ``source``, the latest smaller turn of ``held`` (the same
    columns) under the same conv and hash, where there is one.

    Within blocks of turns by a window, from earlier blocks by one row per block, so that a key with very
    many turns is no single task's.
    """
    block = F.floor(F.col("turn") / TURNS)
    both = asked.withColumn("own", F.lit(None).cast("bigint")).union(held.withColumn("own", F.col("turn"))).withColumn("block", block)
    before = Window.partitionBy("conv", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("own").over(before)).where("own is null")
    last = held.withColumn("block", block).groupBy("conv", "hash", "block").agg(F.max("turn").alias("last"))
    every = asked.withColumn("block", block).select("conv", "hash", "block").distinct().withColumn("last", F.lit(None).cast("bigint"))
    earlier = Window.partitionBy("conv", "hash").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    far = last.union(every).groupBy("conv", "hash", "block").agg(F.max("last").alias("last")).withColumn("far", F.max("last").over(earlier))
    found = near.join(far.select("conv", "hash", "block", "far"), ["conv", "hash", "block"])
    return found.select("conv", "hash", "turn", F.coalesce("near", "far").alias("source")).where("source is not null")


def link(messages: DataFrame) -> DataFrame:
    """(conv, turn, parent, linked): per turn with a linked quotation the turn it answers, and how many of
    its passages are linked. ``messages``: conv, turn, text."""
    quoted = written(passages(messages).withColumn("unit", F.explode(units(F.col("passage")))).select(
        "conv", "turn", "level", F.xxhash64("passage").alias("passage"), F.xxhash64("unit").alias("hash"), F.length("unit").alias("size")
    ).distinct(), "quoted")
    busy = messages.join(quoted.select("conv").distinct(), "conv", "left_semi")
    held = busy.select("conv", F.explode(units(own_text(F.col("text")))).alias("unit"), "turn")
    held = held.select("conv", F.xxhash64("unit").alias("hash"), "turn").distinct()
    source = _as_of(quoted.select("conv", "hash", "turn").distinct(), held)
    best = F.max_by("source", F.struct("size", "source"))
    linked = quoted.join(source, ["conv", "hash", "turn"]).groupBy("conv", "turn", "level", "passage").agg(
        best.alias("source"), F.max("size").alias("size")
    )
    # the outermost level, there the longest unit, then the latest message
    outer = F.max_by("source", F.struct(-F.col("level"), F.col("size"), F.col("source")))
    return linked.groupBy("conv", "turn").agg(outer.alias("parent"), F.count("*").alias("linked"))


def threads(links: DataFrame) -> DataFrame:
    """``links`` with ``root``, the first turn of the thread, by doubling the step to the ancestor."""
    cur = written(links.withColumn("root", F.col("parent")), "thread")
    while True:
        up = cur.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"))
        step = cur.join(up, ["conv", "root"], "left")
        step = written(step.select(*links.columns, F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")), "thread")
        cur = step.drop("more")
        if step.where("more").isEmpty():
            return cur


def conversations(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Every message with its place: conv_id, turn, role, parent (turn answered, else null), root (first
    turn of its thread), linked (passages linked), reply_pos (0-based place in the conversation) and text
    (without quotes; null stays null).

    A null turn stands before all others, null conversation ids form one conversation. Rows with the same
    conversation and turn share their links and are ordered by role and text; repeated rows stay, each
    with its own place. A quoted passage that no earlier message of the conversation holds is left out of
    the text and linked to nothing. Passages of white space only are not looked up.
    """
    m = messages.select(
        F.coalesce(F.col(conv_col).cast("bigint"), F.lit(_NO_CONV)).alias("conv"), F.coalesce(F.col(turn_col).cast("bigint"), F.lit(-1)).alias("turn"),
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("given"), F.col(role_col).alias("role"), F.col(text_col).alias("text"),
    )
    rooted = threads(written(link(m.select("conv", "turn", "text").where("text is not null")), "links"))
    m = m.withColumn("text", own_text(F.col("text"))).join(rooted, ["conv", "turn"], "left").select(
        "conv", "turn", "conv_id", "given", "role", "text", "parent", F.coalesce("root", "turn").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked"),
    )
    m = positions(m, ["root", "turn", "role", "text"], ["conv"], "reply_pos")
    return m.select("conv_id", F.col("given").alias("turn"), "role", "parent", "root", "linked", "reply_pos", "text")


def op3_chat(spark, sf_dir: str) -> DataFrame:
    """Every message of every conversation in reply order, without quotes."""
    return conversations(table(spark, sf_dir, "conversations"))
