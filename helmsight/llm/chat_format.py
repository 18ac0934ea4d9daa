"""Chat formatting from an event log, with DataFrame functions only.

`fold` reconstructs the messages of each conversation from logged events, `render`
writes them by the template and marks what is learned from, `read_back` takes the
turns and the learned text out of the output again.

Template, for each turn:  <s>ROLE\\nBODY</s>\\n  where BODY is the text, for the role
`user` between "[INST] " and " [/INST]". Inside texts and roles, a control string
gets a backslash after its first character (and one more if it has some already), which
`read_back` takes off again; in roles, backslashes and line ends are escaped as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: events after which what was said before in the message no longer counts
RESETS = ("message", "edit", "regenerate")


def escaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2")
    return F.regexp_replace(text, r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"<\\(\\*)(/?s>)", r"<$1$2")
    return F.regexp_replace(text, r"\[\\(\\*)(/?INST\])", r"[$1$2")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    # between doubled backslashes, taken from the left, a single one stands for a line end
    between = F.transform(F.split(role, r"\\\\", -1), lambda part: F.replace(part, F.lit("\\n"), F.lit("\n")))
    return unescaped(F.array_join(between, "\\"))


def fold(events: DataFrame) -> DataFrame:
    """events: conv_id, seq, kind, message, role, text. Rows (conv_id, position, role, text), one per message.

    ``message`` opens a message, ``delta`` appends to it, ``edit`` replaces what it said,
    ``regenerate`` empties it for the deltas that follow (its own text comes first). A
    message stands where its first event stands and has that event's role.

    A conversation's log is in one partition and is gone through by sequence: each event
    of a message is in the round that the last reset before it began, and the last round
    is what the message says. Events of different messages may be mixed.

    * null text: empty; null role: empty; null conv_id or message: a group of its own;
    * events with equal seq in a message: in the order of their texts; a reset among them
      holds back none of them; repeated rows count each;
    * no events: no rows; other columns are ignored.
    """
    log = events.select("conv_id", "seq", "message", F.col("kind").isin(*RESETS).alias("resets"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # one exchange, by conversation; the aggregation below takes over its partitioning
    log = log.repartition("conv_id")
    own = W.partitionBy("conv_id", "message")
    log = log.withColumn("round", F.count(F.when(F.col("resets"), 1)).over(own.orderBy("seq")))
    log = log.withColumns({"first": F.min(F.struct("seq", "role")).over(own), "last_round": F.max("round").over(own)})
    last = log.filter(F.col("round") == F.col("last_round")).groupBy("conv_id", "message").agg(
        F.first("first").alias("first"), F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("said")  # one message, which ends up as one text anyway
    )
    return last.select("conv_id", F.struct("first.seq", "message").alias("position"), F.col("first.role").alias("role"), F.array_join(F.transform("said", lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages: conv_id, position, role, text. Rows (conv_id, formatted, loss_spans), one per conversation.

    loss_spans are the 0-based [start, end) code points of ``formatted`` that are learned
    from: the texts of the roles in ``learned``, without marks.

    A conversation becomes one text, so its turns meet in one task; what was logged of each
    message has been folded before, apart for each message. Equal positions: in the order of
    role and text. Null roles and texts are empty; no messages: no rows.
    """
    role = F.coalesce("role", F.lit(""))
    before = F.concat(F.lit("<s>"), _role_out(role), F.when(role == "user", F.lit("\n[INST] ")).otherwise(F.lit("\n")))
    after = F.when(role == "user", F.lit(" [/INST]</s>\n")).otherwise(F.lit("</s>\n"))
    body = escaped(F.coalesce("text", F.lit("")))
    rows = messages.select("conv_id", "position", role.alias("role"), before.alias("before"), body.alias("body"), after.alias("after"))
    rows = rows.withColumn("piece", F.concat("before", "body", "after"))
    order = W.partitionBy("conv_id").orderBy("position", "role", "body")
    rows = rows.select(
        "conv_id",
        F.row_number().over(order).alias("n"),
        "piece",
        (F.sum(F.length("piece")).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.length("piece") + F.length("before")).alias("start"),
        F.length("body").alias("size"),
        F.col("role").isin(*learned).alias("loss"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "piece", "start", "size", "loss"))).alias("all"))
    spans = F.transform(F.filter("all", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["size"]).alias("end")))
    return whole.select("conv_id", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """chats: conv_id, formatted, loss_spans. Adds turns (role, text) and loss_text, both unescaped.

    Null or empty formatted: null or no turns; null spans: null loss_text; no spans: an
    empty one. Very long chats are read whole, repeated ones each; an empty table gives no
    rows; other columns stay as they are.
    """
    pieces = F.split("formatted", r"</s>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        role = _role_in(F.regexp_extract(piece, r"(?s)\A<s>([^\n]*)\n", 1))
        body = F.regexp_extract(piece, r"(?s)\A<s>[^\n]*\n(.*)\z", 1)
        body = F.when(role == "user", F.substring(body, F.lit(8), F.length(body) - 15)).otherwise(body)
        return F.struct(role.alias("role"), unescaped(body).alias("text"))

    learned = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return chats.select("*", F.transform(pieces, turn).alias("turns"), F.array_join(learned, "").alias("loss_text"))
