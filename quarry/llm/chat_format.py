"""Chat formatting: a finite-state machine over roles checks the order of turns, a declarative template turns a
conversation into text segments with a loss flag each. Only built-in functions: one shuffle on the conversation.

Defined results: a null text or role is empty; rows of equal turn follow by role, then text; repeated rows are repeated
turns; a null conv_id is a conversation of its own; a conversation that breaks the turn order is formatted all the same,
with valid = false and the index of its first bad turn; very long texts and conversations are one row each, as the result
is; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks around a turn, the roles whose text is trained on, and the automaton's edges (state, role) -> state.

    Texts and roles are escaped so that no mark can occur inside them: every "<|" gets a second bar. A role's line feed
    becomes "<|n|>". Both steps have an exact inverse."""

    turn_open: str = "<|im_start|>"
    role_end: str = "\n"
    turn_close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    edges: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    accepting: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        for mark in (self.turn_open, self.turn_close):
            if not mark.startswith("<|") or mark.startswith("<||") or mark.startswith("<|n|>"):
                raise ValueError("marks begin with '<|', not with '<||' or '<|n|>'")


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n|>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n")))


def format_chats(rows: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted string, valid boolean, first_bad_turn int (null if none;
    the number of turns if the conversation only ends in a wrong state)."""
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def turn_segments(t: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(template.turn_open), escape_role(t["role"]), F.lit(template.role_end)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.turn_close).alias("text"), F.lit(False).alias("loss")),
        )

    step = F.create_map(*(F.lit(x) for (state, role), to in template.edges.items() for x in (f"{state}\n{role}", to)))

    def advance(acc: Column, t: Column) -> Column:
        state = F.coalesce(F.try_element_at(step, F.concat(acc["state"], F.lit("\n"), t["role"])), F.lit("reject"))
        bad = F.coalesce(acc["bad"], F.when(state == "reject", acc["i"]))
        return F.struct(state.alias("state"), (acc["i"] + 1).alias("i"), bad.alias("bad"))

    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("bad"))
    chats = chats.select(
        "conv_id",
        F.flatten(F.transform("turns", turn_segments)).alias("segments"),
        F.aggregate("turns", begin, advance).alias("end"),
    )
    bad = F.coalesce(F.col("end.bad"), F.when(~F.col("end.state").isin(*template.accepting), F.col("end.i")))
    return chats.select("conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"), bad.isNull().alias("valid"), bad.alias("first_bad_turn"))


def read_back(chats: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Parses the formatted text again and lays the loss mask, a flag for each of its segments, over it: conv_id, turns
    array<struct<role, text>>, loss_text, formatted, valid, first_bad_turn."""
    body = F.split("formatted", F.lit(r"\Q" + template.turn_close + r"\E"))
    turn = lambda p: F.struct(
        unescape_role(F.substring_index(p, template.role_end, 1)).alias("role"),
        unescape(F.substr(p, F.length(F.substring_index(p, template.role_end, 1)) + len(template.role_end) + 1)).alias("text"),
    )
    cut = F.transform(F.slice(F.col("parts"), F.lit(1), F.size("parts") - 1), lambda p: F.substr(p, F.lit(len(template.turn_open) + 1)))
    read = chats.withColumn("parts", body).select("conv_id", F.transform(cut, turn).alias("turns"), F.col("segments.loss").alias("mask"), "formatted", "valid", "first_bad_turn")
    segments = F.flatten(F.transform("turns", lambda t: F.array(F.lit(None).cast("string"), t["text"], F.lit(None).cast("string"))))  # marks are in no text
    loss = F.array_join(F.filter(segments, lambda s, i: F.get("mask", i)), "")
    return read.select("conv_id", "turns", loss.alias("loss_text"), "formatted", "valid", "first_bad_turn")


def digest_chats(chats: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid: all read back from the output."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(chats, template).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
