"""Chat formatting with Spark's own functions: a state machine over roles and a declarative template.

A template names the role that is trained on, the allowed transitions, and the
strings around a turn.  A turn becomes three segments, head, text and tail; only
the text of a trained role carries loss.  Control strings inside texts and roles
are escaped: every backslash is doubled, and a single backslash goes in after the
first character of each control string.  A run of backslashes that stood in a
text has even length afterwards and one that was put in has length one, so that
reading back drops one backslash of every pair and every lone one.

A conversation is one output row and so one group; its size is that of the row.
Nulls: a null text or role is empty; a null turn sorts first; rows without conv_id
make one conversation.  Ties in turn are ordered by role, then text.  Repeated rows
are repeated turns.  Breaking the order of roles makes `valid` false and sets
`error_turn` to the position of the first turn at fault; the turns are kept.
"""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    head_open: str = "<s>"
    head_close: str = "[INST]"
    tail: dict = field(default_factory=lambda: {"assistant": "</s>"})
    other_tail: str = "[/INST]"
    trained: tuple = ("assistant",)
    #: Role by role: what may follow.  "" is the start.
    follows: dict = field(default_factory=lambda: {"": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]})
    may_end: tuple = ("assistant",)

    def controls(self) -> list[str]:
        return sorted({self.head_open, self.head_close, self.other_tail, *self.tail.values()})


def escape(text: Column, t: Template) -> Column:
    words = "|".join(re.escape(c[1:]) for c in t.controls())
    starts = "".join(sorted({re.escape(c[0]) for c in t.controls()}))
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"(?<=[{starts}])(?={words})", r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chat(df: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, error_turn, segments (text, loss), formatted."""
    t = template or Template()
    rows = df.select(
        "conv_id",
        F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("x"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    allowed = [f"{k}>{x}" for k, v in t.follows.items() for x in v]
    step = lambda s, x: F.struct(
        x["role"].alias("state"),
        (s["at"] + 1).alias("at"),
        F.when(s["bad"] >= 0, s["bad"]).when(F.concat(s["state"], F.lit(">"), x["role"]).isin(allowed), F.lit(-1)).otherwise(s["at"]).alias("bad"),
    )
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))
    end = lambda s: F.when(s["bad"] >= 0, s["bad"]).when(s["state"].isin(list(t.may_end)), F.lit(-1)).otherwise(s["at"])
    tails = F.lit(t.other_tail)
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def three(x):
        tail = tails
        for role, mark in t.tail.items():
            tail = F.when(x["role"] == role, F.lit(mark)).otherwise(tail)
        return F.array(
            segment(F.concat(F.lit(t.head_open), escape(x["role"], t), F.lit(t.head_close)), F.lit(False)),
            segment(escape(x["text"], t), x["role"].isin(list(t.trained))),
            segment(tail, F.lit(False)),
        )

    out = turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("turns", start, step, end).alias("error"),
        F.flatten(F.transform("turns", three)).alias("segments"),
    )
    return out.select(
        "conv_id",
        "n_turns",
        (F.col("error") < 0).alias("valid"),
        F.when(F.col("error") >= 0, F.col("error")).alias("error_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """From the formatted text: turns (role, text); from the segments under loss: loss_text, unescaped."""
    t = template or Template()
    ends = "|".join(re.escape(x) for x in sorted({t.other_tail, *t.tail.values()}))
    part = lambda x, i: unescape(F.split(x, re.escape(t.head_close), 2)[i])
    pieces = F.filter(F.split("formatted", ends), lambda x: x != "")
    turn = lambda x: F.struct(part(F.substr(x, F.lit(len(t.head_open) + 1)), 0).alias("role"), part(x, 1).alias("text"))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.withColumns({"turns": F.transform(pieces, turn), "loss_text": F.array_join(loss, "")})


def chat_digests(df: DataFrame, template: Template | None = None) -> DataFrame:
    read = read_back(format_chat(df, template), template)
    return read.select(
        "conv_id",
        "valid",
        "error_turn",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
