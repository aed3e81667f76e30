"""Chat formatting by quotation linking.  DataFrame and SQL functions only.

Lines that start with `>` are quotes; the number of marks is the level.  Neighbouring lines of one level are a passage.
A quoted passage of any level, normalised and hashed, is joined to the first message of its conversation that says it
(as a passage, a line or its whole own text); a passage that nobody says whole is looked up line by line.  Of the
shallowest level that is found, the message that says most quoted words, the latest one in ties, is what a message
replies to; the links of all levels are kept.  Replies are followed to their first message by pointer jumping;
(conv_id, thread, turn) is the reply order.  Nothing but the links of one message is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import scratch

QUOTE = "^(?:[ \\t]*>)+"
#: Line that introduces a quote; dropped from what a message says itself.
LEAD = "^(?:On|Am|Le|El) .{1,200}(?:wrote|schrieb|écrit|escribió) ?:[ \\t]*$"
PART = "struct<level:int,text:string>"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), "[^>]", ""))


def passages(text: Column) -> Column:
    """Array of (level, text): neighbouring lines of one quote level, marks removed, in order.  Work linear in the text."""
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(LEAD)), lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, QUOTE + "[ \t]?", "").alias("text")))

    def cut(xs: Column) -> Column:
        n = F.size(xs)
        before = F.concat(F.array(F.lit(-1)), F.transform(F.slice(xs, 1, F.greatest(n - 1, F.lit(0))), lambda x: x["level"]))
        marked = F.transform(F.arrays_zip(F.transform(xs, lambda x: x["level"]).alias("own"), before.alias("before")), lambda x, i: F.when(x["own"] != x["before"], i))
        return F.filter(marked, lambda i: i.isNotNull())

    def runs(x: Column) -> Column:
        xs, starts = x["lines"], x["starts"]
        ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(xs)))
        return F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r: F.struct(F.get(xs, r["s"])["level"].alias("level"), F.array_join(F.transform(F.slice(xs, r["s"] + 1, r["e"] - r["s"]), lambda y: y["text"]), "\n").alias("text")))

    # arrays of one element bind what is used twice, so that lines are made once
    with_starts = F.transform(F.array(lines), lambda xs: F.struct(xs.alias("lines"), cut(xs).alias("starts")))
    quoted = F.element_at(F.transform(with_starts, lambda x: F.when(F.size(x["lines"]) > 0, runs(x)).otherwise(F.array().cast(f"array<{PART}>"))), 1)
    return F.when(text.rlike("(?m)" + QUOTE), quoted).otherwise(F.array(F.struct(F.lit(0).alias("level"), text.alias("text"))))


def normalise(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "\\s+", " "))


def link(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, reply_to, thread, depth, links: one row per row of the input.

    links: (level, source, words) of every message that a quote of that level is from, sorted.
    Null texts are empty.  Rows with a null conv_id or turn, and messages that quote nothing known, start a thread of
    their own (reply_to null, depth 0).  Of rows that repeat conv_id and turn, all say what any of them says.  An empty
    table gives no rows; columns other than conv_id, turn, role, text are ignored, whatever their names.  Ties between
    sources go to the later message.  Work is linear in the length of a text.
    """
    rows = conversations.select("conv_id", "turn", "role", passages(F.coalesce("text", F.lit(""))).alias("parts"))
    own = F.filter("parts", lambda p: p["level"] == 0)
    said = F.array_join(F.transform(own, lambda p: p["text"]), "\n")
    rows = rows.select("conv_id", "turn", "role", "parts", said.alias("said"), F.size(F.filter("parts", lambda p: p["level"] > 0)).alias("n_quotes"))
    quotes = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode(F.filter("parts", lambda p: p["level"] > 0)).alias("q"))
    # a long passage is named by its hash, so that its lines do not each carry all of it
    wanted = quotes.select("conv_id", "turn", F.col("q.level").alias("level"), F.sha2(normalise(F.col("q.text")), 256).alias("whole"), F.concat(F.array(F.col("q.text")), F.split("q.text", "\n")).alias("units"))
    wanted = wanted.select("conv_id", "turn", "level", "whole", F.explode("units").alias("text"))
    wanted = wanted.select("conv_id", "turn", "level", "whole", normalise(F.col("text")).alias("text")).where("text <> ''")
    wanted = wanted.select("conv_id", "turn", "level", "whole", F.sha2("text", 256).alias("hash"), F.size(F.split("text", " ")).alias("words"))
    wanted = scratch.checkpoint(wanted.distinct())
    talk = wanted.select("conv_id").distinct()
    units = F.concat(F.array("said"), F.transform(F.filter("parts", lambda p: p["level"] == 0), lambda p: p["text"]), F.split("said", "\n"))
    sayings = rows.join(talk, "conv_id", "left_semi").where("turn IS NOT NULL").select("conv_id", "turn", F.explode(units).alias("text")).select("conv_id", "turn", F.sha2(normalise(F.col("text")), 256).alias("hash"))
    first = sayings.groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    hits = wanted.join(first, ["conv_id", "hash"]).where("source < turn")
    # a passage found whole counts once; its lines only otherwise
    best = hits.groupBy("conv_id", "turn", "level", "whole", "source").agg(F.max(F.when(F.col("hash") == F.col("whole"), F.col("words"))).alias("all"), F.sum("words").alias("some"))
    score = best.groupBy("conv_id", "turn", "level", "source").agg(F.sum(F.coalesce("all", "some")).alias("words"))
    nearest = F.max(F.struct((-F.col("level")).alias("near"), "words", "source"))
    reply = score.groupBy("conv_id", "turn").agg(nearest.alias("m"), F.sort_array(F.collect_list(F.struct("level", "source", "words"))).alias("links"))
    reply = scratch.checkpoint(reply.select("conv_id", "turn", F.col("m.source").alias("reply_to"), "links"))
    up = scratch.checkpoint(reply.select("conv_id", "turn", F.col("reply_to").alias("top"), F.lit(1).alias("depth")))
    while True:
        over = up.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        step = up.join(over, ["conv_id", "top"], "left")
        up = scratch.checkpoint(step.select("conv_id", "turn", F.coalesce("next", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
        if up.where("moved").isEmpty():
            break
        up = up.drop("moved")
    found = rows.select("conv_id", "turn", "role", F.trim(F.regexp_replace("said", "\\n{3,}", "\n\n")).alias("text"), "n_quotes")
    found = found.join(reply, ["conv_id", "turn"], "left").join(up.drop("moved"), ["conv_id", "turn"], "left")
    return found.select("conv_id", "turn", "role", "text", "n_quotes", "reply_to", F.coalesce("top", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("links", F.array().cast(reply.schema["links"].dataType)).alias("links"))


def op8_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
