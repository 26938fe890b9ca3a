"""Chat formatting by prefix-target expansion (operator 12), in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and only its reply under the loss
mask. A turn is written as `### role: text</turn>` and a line feed. Inside texts and roles a backslash becomes `\\b`, the
start of a turn `\\h`, its end `\\t`, and in roles the colon and space `\\c`; so a control string stands only where the
template put it, every backslash is followed by one of these letters, and reading an example back gives each turn as it was.

An example is a prefix of its conversation's text, so the conversation is formatted once and examples are cut out of it
by their ends. Turns after the last reply are nobody's context; they come in one closing example that trains nothing
(target is null), so the output holds every turn: the last example of a conversation has all of them.

Scale: one shuffle of the turns by conversation. An example is one row, so the formatted text of one conversation must fit one
(2 GB in Spark), and a conversation of n turns gives up to n examples as long as itself; both lie in the method.

Defined results: null texts and null roles are empty; turns are ordered by turn, nulls first, then role and text;
repeated rows are turns of their own; rows without a conv_id are one conversation; a conversation without an assistant has
the closing example alone; an empty text under the mask is an empty span; other columns are left out; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import cut

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
END = "</turn>"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    for plain, safe in (("\\", "\\b"), (OPEN, "\\h"), (END, "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for plain, safe in ((END, "\\t"), (OPEN, "\\h"), ("\\", "\\b")):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(BETWEEN), F.lit("\\c"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\c"), F.lit(BETWEEN)))


def head_of(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped_role(turn["role"]), F.lit(BETWEEN))


def chat_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), target (place of the trained turn), last (whether it is the conversation's last example),
    text, loss_start and loss_end: the trained code points of the text."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # array_sort puts nulls last, sort_array first
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    pieces = turns.withColumn("heads", F.transform("turns", head_of)).withColumn("bodies", F.transform("turns", lambda t: escaped(t["text"])))
    pieces = pieces.withColumn("texts", F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(CLOSE))))
    # running ends of turns, one pass over their lengths
    start = F.array().cast("array<int>")
    ends = F.aggregate("texts", F.struct(F.lit(0).alias("at"), start.alias("ends")), lambda a, t: F.struct((a["at"] + F.length(t)).alias("at"), F.concat(a["ends"], F.array(a["at"] + F.length(t))).alias("ends")))
    pieces = pieces.withColumn("ends", ends["ends"])
    n = F.size("turns")
    reply = lambda i: F.get(F.col("turns"), i)["role"] == ASSISTANT
    chosen = F.filter(F.sequence(F.lit(0), n - 1), lambda i: reply(i) | (i == n - 1))

    def example(i: Column, k: Column) -> Column:
        end = F.get(F.col("ends"), i)
        loss_end = F.when(reply(i), end - len(CLOSE))
        return F.struct(
            k.alias("example"), F.when(reply(i), i).alias("target"), (i == n - 1).alias("last"), end.alias("end"),
            (loss_end - F.length(F.get(F.col("bodies"), i))).alias("loss_start"), loss_end.alias("loss_end"),
        )

    whole = pieces.select("conv_id", F.array_join("texts", "").alias("whole"), F.transform(chosen, example).alias("examples"))
    # outer: there is always an example, and a plain explode would compute them once more to filter
    cut_out = F.substring(F.col("whole"), F.lit(1), F.col("e.end")).alias("text")
    return whole.select("conv_id", "whole", F.explode_outer("examples").alias("e")).select("conv_id", "e.example", "e.target", "e.last", cut_out, "e.loss_start", "e.loss_end")


def turns_of(text: Column) -> Column:
    """The turns of an example, read back from its text: an array of role and text."""
    pieces = F.split(text, CLOSE)  # no sign of it has a meaning in patterns

    def parsed(p: Column) -> Column:
        colon = F.instr(p, BETWEEN)
        role = F.substring(p, F.lit(len(OPEN) + 1), colon - 1 - len(OPEN))
        return F.struct(unescaped_role(role).alias("role"), unescaped(F.substring(p, colon + len(BETWEEN), F.length(p))).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), parsed)


def loss_text(text: Column) -> Column:
    """What an example trains, unescaped; empty if nothing."""
    taken = F.substring(text, F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    return unescaped(F.coalesce(taken, F.lit("")))


def chat_documents(conversations: DataFrame) -> DataFrame:
    """Digests of each conversation, from the written examples. The second shuffle has trained texts alone."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    examples = cut(chat_examples(rows), "chat")
    text = F.col("text")
    whole = F.transform(turns_of(text), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = examples.withColumn("whole", F.when(F.col("last"), whole)).select(
        "conv_id", "example", F.size("whole").alias("n"), F.sha2(F.array_join("whole", ""), 256).alias("digest"), loss_text(text).alias("loss"), F.length(text).alias("chars"), "last",
    )
    losses = F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"])
    found = read.groupBy("conv_id").agg(
        F.max(F.when(F.col("last"), F.col("n"))).cast("long").alias("n_turns"), F.max(F.when(F.col("last"), F.col("digest"))).alias("turns_sha256"),
        F.array_join(losses, "").alias("loss"), F.sum("chars").cast("long").alias("formatted_chars"),
    )
    return found.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The rows, and conversation -7, whose texts hold control strings."""
    said = "\\### Assistant: </turn> ok"
    probe = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, ASSISTANT, said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
