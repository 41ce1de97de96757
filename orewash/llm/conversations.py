"""Chat formatting: conversations in the order of replies, without quotations, in DataFrame functions only.

A line's quote level is the number of its leading ``>`` marks. Consecutive lines of one level are a passage. Quoted
passages are normalised, hashed and joined to the messages that say the same in their own words: as a whole, as a
paragraph, or as so many lines in a row. A message answers the one that its first linked passage comes from. Threads
follow from those links, by doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orewash.scratch import written

MARKS = r"^([ \t]*>)+"
NODE = ["conv_id", "turn"]


def normalised(text: Column) -> Column:
    """Lower case, white space as single spaces, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def passage_key(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def quoting(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?m)" + MARKS), F.lit(False))


def own_text(text: Column) -> Column:
    """The text without quoted lines, and without blank lines at its ends."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(MARKS))
    return F.when(quoting(text), F.regexp_replace(F.array_join(lines, "\n"), r"^\s*\n|\s+$", "")).otherwise(text)


def quoted_passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, first, level, lines, key): each passage that a message quotes, with its first line, its quote level
    and how many lines with words it has.

    A passage of level 2 stands inside one of level 1, which it splits; blank lines at the same level belong to the
    passage. Passages without a word are left out.
    """
    lines = messages.where(quoting(F.col("text"))).select(*NODE, F.xxhash64("text").alias("tag"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    marks = F.regexp_extract("line", r"^((?:[ \t]*>)*)", 1)
    lines = lines.select(
        *NODE, "tag", "at",
        F.length(F.regexp_replace(marks, r"[^>]", "")).alias("level"),
        F.regexp_replace("line", r"^(?:[ \t]*>)+[ \t]?", "").alias("body"),
    )
    message = Window.partitionBy(*NODE, "tag").orderBy("at")
    new = (F.col("level") != F.lag("level", 1, -1).over(message)).cast("int")
    run = F.sum("new").over(message.rowsBetween(Window.unboundedPreceding, 0))
    passages = lines.withColumn("new", new).withColumn("run", run).where("level > 0").groupBy(*NODE, "tag", "run", "level")
    parts = F.sort_array(F.collect_list(F.struct("at", "body")))
    whole = passages.agg(F.min("at").alias("first"), F.array_join(F.transform(parts, lambda p: p["body"]), "\n").alias("body"))
    worded = whole.withColumn("lines", F.size(own_lines(F.col("body")))).where("lines > 0")
    return worded.select(*NODE, "first", "level", "lines", passage_key(F.col("body")).alias("key"))


def own_lines(text: Column) -> Column:
    """The lines that have words, normalised."""
    return F.filter(F.transform(F.split(text, "\n", -1), normalised), lambda line: line != "")


def own_passages(messages: DataFrame, lengths: list[int]) -> DataFrame:
    """(conv_id, turn, key): what a message says itself, whole, by paragraph, and by runs of ``lengths`` lines."""
    own = F.col("own")
    parts = F.filter(F.concat(F.array(own), F.split(own, r"\n[ \t]*\n")), lambda part: F.length(normalised(part)) > 0)
    lines, asked = F.col("lines"), F.array(*map(F.lit, lengths)).cast("array<int>")
    said = messages.select(*NODE, own_text(F.col("text")).alias("own")).select(*NODE, "own", own_lines(own).alias("lines"))

    def runs(length: Column) -> Column:
        starts = F.when(F.size(lines) >= length, F.sequence(F.lit(1), F.size(lines) - length + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.array_join(F.slice(lines, at, length), " "))

    every = F.concat(F.transform(parts, normalised), F.flatten(F.transform(asked, runs)))
    return said.select(*NODE, F.explode(F.array_distinct(every)).alias("part")).select(*NODE, F.sha2("part", 256).alias("key"))


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_conv, parent_turn, n_linked): the message that each quoting message answers.

    A passage's original is the first message of the same conversation that says it, or else the first of all; it must
    stand before the message that quotes it. Quotes are the smaller side: what is said is reduced to quoted keys, then to
    one row for each key and conversation, before it meets the quotes. The parent comes from the first passage that is
    linked, those of level 1 first.
    """
    quotes = written(quoted_passages(messages), "quotes")
    wanted = quotes.select("key").distinct()
    lengths = sorted(r["lines"] for r in quotes.select("lines").distinct().collect())  # as many as quotes have lengths
    said = own_passages(messages, lengths).join(wanted, "key", "left_semi")
    here = said.groupBy("key", "conv_id").agg(F.min("turn").alias("here"))
    anywhere = said.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("anywhere"))
    found = quotes.join(here, ["key", "conv_id"], "left").join(anywhere, "key", "left")
    parent = F.when(F.col("here") < F.col("turn"), F.struct("conv_id", F.col("here").alias("turn"))).when(
        F.col("anywhere") < F.struct("conv_id", "turn"), F.col("anywhere")
    )
    found = found.withColumn("parent", parent)
    first = F.min(F.when(F.col("parent").isNotNull(), F.struct("level", "first", "parent")))
    return (
        found.groupBy(*NODE)
        .agg(first.alias("best"), F.count(F.lit(1)).alias("n_quotes"), F.count("parent").alias("n_linked"))
        .select(*NODE, "n_quotes", "n_linked", F.col("best.parent.conv_id").alias("parent_conv"), F.col("best.parent.turn").alias("parent_turn"))
    )


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root_conv, root_turn, depth) of messages that have a parent: where their chain of parents ends.

    Each round doubles the stretch of the chain that is known; parents stand before their children, so it ends.
    """
    ends = links.where(F.col("parent_turn").isNotNull()).select(
        *NODE, F.col("parent_conv").alias("root_conv"), F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")
    )
    ends = written(ends, "threads")
    while not ends.isEmpty():
        further = ends.select(
            F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"),
            F.col("root_conv").alias("next_conv"), F.col("root_turn").alias("next_turn"), F.col("depth").alias("more"),
        )
        joined = ends.join(further, ["root_conv", "root_turn"], "left")
        following = written(
            joined.select(
                *NODE, F.coalesce("next_conv", "root_conv").alias("root_conv"), F.coalesce("next_turn", "root_turn").alias("root_turn"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("more").isNotNull().alias("moved"),
            ),
            "threads",
        )
        ends = following.drop("moved")
        if following.where("moved").isEmpty():
            break
    return ends


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Messages without their quotations, and where they stand among the replies.

    Columns: conv_id, turn, role, text (own words), n_quotes, n_linked, parent_conv, parent_turn, root_conv, root_turn,
    depth. Ordered by root_conv, root_turn, depth, conv_id and turn, a thread's messages follow each other, and every one
    comes after what it answers; a message that quotes nothing known is a root of depth 0.

    Whole messages are compared, however long. Null text stays null and quotes nothing; null conv_id or turn makes a root
    that cannot be quoted. Repeated rows come
    out as often as they come in; rows of one conv_id and turn share their links. Other columns are ignored. No messages
    give no rows.
    """
    links = written(reply_links(messages.where("conv_id is not null and turn is not null")), "reply-links")
    ends = threads(links)
    placed = links.join(ends, NODE, "left")
    zero = F.lit(0).cast("long")
    return messages.select(*NODE, "role", "text").join(placed, NODE, "left").select(
        *NODE, "role", own_text(F.col("text")).alias("text"),
        F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"), "parent_conv", "parent_turn",
        F.coalesce("root_conv", "conv_id").alias("root_conv"), F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", zero).alias("depth"),
    )
