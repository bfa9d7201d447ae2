"""Chat formatting by event sourcing, in DataFrame functions only.

A log row is an event of a conversation: ``message`` (a complete message of its own), ``start`` (opens a turn), ``delta``
(adds text to a turn), ``edit`` (replaces a turn's text) or ``regenerate`` (throws a turn's text away, deltas follow). Edits
and regenerations fork the conversation: what later turns held before them is void. The fold sorts by sequence, applies
these, and renders the surviving messages with ChatML-like marks.

Layout: events meet by (conversation, turn), turns by (conversation, block of turns), so that one very long conversation
is folded and rendered in many tasks. The output holds one row for each block, in order; its loss spans are code points of
that block's text. Only a caller who wants one row for a conversation gathers its blocks.

Escaping: ``<`` followed by any backslashes and ``|`` gets one backslash more, so no mark can occur inside a text, and
reading takes it away again. In roles a backslash is written ``\\s`` and a line feed ``\\n``.

Defined cases: null texts and roles are empty; null conversations form one conversation; a null turn or sequence comes
first; events that tie are taken in the order of kind, role, text; repeated ``message`` rows stay repeated; deltas of a
turn that was never opened open it; an empty log gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoloom.llm.quality import let

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns in a block.
BLOCK = 32
FORKS = ("edit", "regenerate")
MESSAGE = "struct<role:string,text:string>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def messages_as_events(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A log in which every row of a finished conversation is one complete message."""
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(turn).cast("long").alias("seq"),
        F.lit("message").alias("kind"), F.col(role).alias("role"), F.col(text).alias("text"),
    )


def fold(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, block, messages): the messages that survive, in order, in blocks of ``block`` turns."""
    clean = events.select(
        "conv", "turn", "kind",
        F.coalesce("seq", F.lit(-(2**63))).alias("seq"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    at = F.floor(F.col("turn") / block)
    turns = clean.groupBy("conv", "turn").agg(
        F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log"),
        F.max(F.when(F.col("kind").isin(*FORKS), F.col("seq"))).alias("fork"),
    )
    blocks = turns.withColumn("block", at).groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "fork", "log"))).alias("turns"))
    forks = (
        clean.where(F.col("kind").isin(*FORKS)).groupBy("conv", at.alias("fb")).agg(F.max("seq").alias("seq"))
        .groupBy(F.col("conv").alias("fc")).agg(F.collect_list(F.struct("fb", "seq")).alias("forks"))
    )
    bounded = blocks.join(forks, F.col("conv").eqNullSafe(F.col("fc")), "left").withColumn(
        "bound", F.array_max(F.transform(F.filter("forks", lambda f: f["fb"] < F.col("block")), lambda f: f["seq"]))
    )

    def survivors(turns: Column, outer: Column, turn: Column, i: Column) -> Column:
        before = F.array_max(F.transform(F.slice(turns, F.lit(1), i), lambda t: t["fork"]))
        bound = F.greatest(outer, before)
        live = F.filter(turn["log"], lambda e: bound.isNull() | (e["seq"] > bound))
        whole = F.transform(F.filter(live, lambda e: e["kind"] == "message"), lambda e: F.struct(e["role"].alias("role"), e["text"].alias("text")))
        parts = F.filter(live, lambda e: e["kind"] != "message")
        none = F.struct(F.lit("").alias("role"), F.array().cast("array<string>").alias("text"))

        def apply(acc: Column, e: Column) -> Column:
            text = F.when(e["kind"] == "delta", F.concat(acc["text"], F.array(e["text"]))).otherwise(F.array(e["text"]))
            return F.struct(F.when(e["role"] != "", e["role"]).otherwise(acc["role"]).alias("role"), text.alias("text"))

        built = F.aggregate(parts, none, apply, lambda acc: F.struct(acc["role"].alias("role"), F.array_join(acc["text"], "").alias("text")))
        return F.concat(whole, F.when(F.size(parts) > 0, F.array(built)).otherwise(F.array().cast(f"array<{MESSAGE}>")))

    # bound, so that no rewrite of the plan evaluates the sorted turns once for each of them
    messages = let(F.struct(F.col("turns").alias("t"), F.col("bound").alias("b")), lambda x: F.flatten(F.transform(x["t"], lambda t, i: survivors(x["t"], x["b"], t, i))))
    return bounded.select("conv", "block", messages.alias("messages")).where(F.size("messages") > 0)


def render(messages: Column) -> Column:
    """One text for an array of messages."""
    return F.array_join(
        F.transform(messages, lambda m: F.concat(F.lit(OPEN), escape_role(m["role"]), F.lit("\n"), escape(m["text"]), F.lit(f"{CLOSE}\n"))), ""
    )


def loss_spans(messages: Column, trained: str = "assistant") -> Column:
    """(start, length) in code points of the rendered text of each message whose role is ``trained``."""
    zero, fixed = F.lit(0).cast("long"), len(OPEN) + 1
    start = F.struct(zero.alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def add(acc: Column, m: Column) -> Column:
        begin = acc["at"] + fixed + F.length(escape_role(m["role"]))
        size = F.length(escape(m["text"])).cast("long")
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        spans = F.when(m["role"] == trained, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((begin + size + len(CLOSE) + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(messages, start, add, lambda acc: acc["spans"])


def format_chats(events: DataFrame, trained: str = "assistant", block: int = BLOCK) -> DataFrame:
    """(conv, block, formatted, loss): the rendered text in blocks of turns with its loss spans."""
    return fold(events, block).select("conv", "block", render(F.col("messages")).alias("formatted"), loss_spans(F.col("messages"), trained).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv, block, messages, trained): messages parsed out of the rendered text, and the texts under its loss spans."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda x: x != "")

    def parse(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        return F.struct(
            unescape_role(F.substring(role, len(OPEN) + 1, 2**31 - 1)).alias("role"),
            unescape(F.substring(piece, F.length(role) + 2, F.lit(2**31 - 1))).alias("text"),
        )

    under = let(F.col("formatted"), lambda f: F.transform("loss", lambda s: unescape(F.substring(f, (s["start"] + 1).cast("int"), s["length"].cast("int")))))
    return formatted.select("conv", "block", F.length("formatted").cast("long").alias("formatted_chars"), F.transform(pieces, parse).alias("messages"), under.alias("trained"))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes for each conversation, from what :func:`read_back` finds in the rendered text.

    A conversation's hash runs over its whole text, so its blocks (already reduced to one string each) meet in one row.
    """
    parts = read_back(formatted).select(
        "conv", "block", "formatted_chars",
        F.size("messages").cast("long").alias("n"),
        F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "").alias("all"),
        F.array_join("trained", "").alias("trained"),
    )
    gathered = parts.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("block", "all", "trained"))).alias("parts"),
        F.sum("n").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"),
    )
    text = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "")
    hashed = lambda c: F.sha2(text(c).cast("binary"), 256)
    return gathered.select(
        F.col("conv").alias("conv_id"), "n_turns", hashed("all").alias("turns_sha256"),
        F.length(text("trained")).cast("long").alias("loss_chars"), hashed("trained").alias("loss_sha256"), "formatted_chars",
    )
