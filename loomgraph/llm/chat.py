"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """How turns are written and which of them carry loss.

    ``start + role + separator + text + end`` is one turn. Inside roles and texts every ``<|`` gains one more bar
    (``<||``, ``<|||``, ...), so a control string can never appear there and taking one bar away restores the
    original; inside roles ``%`` and line feeds are also percent-encoded. ``moves`` maps a state and a role to the
    next state; a state is the name of the role last seen, ``""`` before the first turn.
    """

    start: str = "<|im_start|>"
    separator: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: Sequence[str] = ("assistant",)
    moves: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant", "tool"),
        }
    )
    final: Sequence[str] = ("assistant",)


def _escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\|+)", r"<|$1")


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\|(\|+)", r"<$1")


def _escape_role(c: Column) -> Column:
    return _escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(c: Column) -> Column:
    return F.replace(F.replace(_unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(rows: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conv_id: ``segments`` (role, text with marks and escapes, loss flag), ``formatted``, ``valid``, ``bad_turn``.

    Turns are ordered by (turn, role, text), null turns first, so ties and repeated rows have one defined order.
    Null texts and roles are empty. Conversations with a wrong order of turns are formatted all the same, with
    ``valid`` false and ``bad_turn`` the position (from 0) of the first turn the machine refuses, or the number of
    turns if the last state isn't final; otherwise null. Null conv_ids make one conversation. A turn has three
    segments: its opening mark, its text, its closing mark; only the text of a loss role carries loss. Columns
    other than conv_id, turn, role and text are ignored. An empty table gives an empty table.
    """
    t = template or ChatTemplate()
    empty = F.lit("")
    turns = rows.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("x"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    move_keys = F.array(*[F.lit(f"{a}\x00{b}") for a, to in t.moves.items() for b in to])
    loss_roles = F.array(*[F.lit(r) for r in t.loss_roles])

    def step(s: Column, x: Column) -> Column:
        ok = F.array_contains(move_keys, F.concat(s["at"], F.lit("\x00"), x["role"]))
        return F.struct(
            F.when(s["bad"].isNull() & ok, x["role"]).otherwise(s["at"]).alias("at"),
            (s["n"] + 1).alias("n"),
            F.when(s["bad"].isNotNull(), s["bad"]).when(~ok, s["n"]).alias("bad"),
        )

    first = F.struct(empty.alias("at"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    run = F.aggregate("turns", first, step)

    def parts(x: Column) -> Column:
        def part(text: Column, loss: Column) -> Column:
            return F.struct(x["role"].alias("role"), text.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(t.start), _escape_role(x["role"]), F.lit(t.separator))
        return F.array(part(head, F.lit(False)), part(_escape(x["text"]), F.array_contains(loss_roles, x["role"])), part(F.lit(t.end), F.lit(False)))

    out = chats.select("conv_id", F.flatten(F.transform("turns", parts)).alias("segments"), run.alias("run"))
    bad = F.coalesce(F.col("run.bad"), F.when(~F.col("run.at").isin(*t.final), F.col("run.n")))
    return out.select("conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"), bad.isNull().alias("valid"), bad.alias("bad_turn"))


def parse_chat(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns of a formatted conversation, read back: array of (role, text, loss), unescaped."""
    t = template or ChatTemplate()
    pieces = F.filter(F.split(formatted, _quoted(t.start)), lambda p: p != "")

    def turn(p: Column) -> Column:
        cut = F.instr(p, t.separator)
        role = _unescape_role(F.substring(p, F.lit(1), cut - 1))
        text = _unescape(F.substring(p, cut + len(t.separator), F.length(p) - cut - len(t.separator) - len(t.end) + 1))
        return F.struct(role.alias("role"), text.alias("text"), F.array_contains(F.array(*[F.lit(r) for r in t.loss_roles]), role).alias("loss"))

    return F.transform(pieces, turn)


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in s)


def chat_digests(chats: DataFrame) -> DataFrame:
    """What ``op1`` returns: turns read back from the formatted text, and the text under the loss mask from the segments' own flags.

    A conversation without loss has the digest of the empty text; an empty table gives an empty table.
    """
    read = chats.withColumn("back", parse_chat(F.col("formatted")))
    whole = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: _unescape(x["text"])), "")
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
