"""Chat formatting: a declarative template, a state machine over roles, and segments with loss flags.

Everything here is DataFrame functions.  A turn becomes three segments: its opening mark, its escaped text, its closing
mark; the template says which of them count in the loss.  Control strings inside texts are escaped by a backslash after
their first character (one more if backslashes stand there already), which unescaping takes away again.  A conversation's
rendered text is its segments one after the other; reading back finds the turns in that text by their marks alone,
while the segments' flags say what counts in the loss.

A conversation's digest needs its turns in order in one row, so a conversation must fit a row (2 GB); turns are formatted
before they are gathered.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Marks:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """roles: the marks of known roles.  other: those of any other role, whose name stands between open and named.

    controls: the control strings as (first character, rest), written as regular expressions that Java and RE2 share.
    moves: state and role to the next state; what is missing is an error.
    """

    roles: dict[str, Marks]
    other: Marks
    named: str
    controls: list[tuple[str, str]]
    moves: dict[tuple[str, str], str]

    @property
    def plain(self) -> str:
        first = "".join(sorted({a for a, _ in self.controls}))
        return rf"([{first}])(\\*)({'|'.join(b for _, b in self.controls)})"

    @property
    def turn(self) -> str:
        """A rendered turn.  Escaped texts hold no mark, so the first closing mark behind an opening one ends its turn."""
        return "(?s)" + "|".join(
            f"{re.escape(m.open)}.*?{re.escape(m.close)}" for m in [*self.roles.values(), self.other]
        )

    @property
    def escaped(self) -> str:
        return self.plain.replace(r"(\\*)", r"\\(\\*)", 1)


INSTRUCT = Template(
    roles={
        "system": Marks("<<SYS>>", "<</SYS>>"),
        "user": Marks("[INST]", "[/INST]"),
        "assistant": Marks("<s>", "</s>", loss=True),
    },
    other=Marks("[ROLE]", "[/ROLE]"),
    named="[TEXT]",
    controls=[("<", "/?s>"), ("<", "</?SYS>>"), (r"\[", r"/?INST\]"), (r"\[", r"/?ROLE\]"), (r"\[", r"TEXT\]")],
    moves={
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
)


def escape(text: Column, template: Template = INSTRUCT) -> Column:
    return F.regexp_replace(text, template.plain, r"$1\\$2$3")


def unescape(text: Column, template: Template = INSTRUCT) -> Column:
    return F.regexp_replace(text, template.escaped, "$1$2$3")


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _choose(role: Column, template: Template, part: str, other: Column) -> Column:
    out = None
    for name, marks in template.roles.items():
        value = F.lit(getattr(marks, part))
        out = F.when(role == name, value) if out is None else out.when(role == name, value)
    return out.otherwise(other)


def formatted(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv_id, n_turns, segments, state, bad_turn) per conversation.

    turns needs conv_id, turn, role and text; other columns are left out.  Null texts and roles count as empty; turns
    with one number are ordered by role, then text, and repeated rows are turns of their own; a null turn comes first.
    state is where the machine over roles ends, 'error' from the first move that the template does not name; bad_turn is
    that turn's place from 0, else null.  An empty table gives no conversation.
    """
    role = F.coalesce("role", F.lit(""))
    opening = F.concat(F.lit(template.other.open), escape(role, template), F.lit(template.named))
    rows = turns.select(
        "conv_id",
        F.struct(
            "turn",
            role.alias("role"),
            escape(F.coalesce("text", F.lit("")), template).alias("text"),
            _choose(role, template, "open", opening).alias("open"),
            _choose(role, template, "close", F.lit(template.other.close)).alias("close"),
            _choose(role, template, "loss", F.lit(template.other.loss)).alias("loss"),
        ).alias("_turn"),
    )
    moves = F.create_map(*(F.lit(x) for (a, b), c in template.moves.items() for x in (f"{a}>{b}", c)))

    def move(at: Column, turn: Column) -> Column:
        to = F.coalesce(F.try_element_at(moves, F.concat(at["state"], F.lit(">"), turn["role"])), F.lit("error"))
        bad = F.when((to == "error") & at["bad"].isNull(), at["n"]).otherwise(at["bad"])
        return F.struct(to.alias("state"), (at["n"] + 1).alias("n"), bad.alias("bad"))

    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    pieces = F.flatten(
        F.transform(
            "_turns",
            lambda t: F.array(
                _segment(t["open"], F.lit(False)), _segment(t["text"], t["loss"]), _segment(t["close"], F.lit(False))
            ),
        )
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    return whole.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        pieces.alias("segments"),
        F.aggregate("_turns", begin, move).alias("_end"),
    ).select("conv_id", "n_turns", "segments", F.col("_end.state").alias("state"), F.col("_end.bad").alias("bad_turn"))


def rendered(segments: Column) -> Column:
    """The text of a conversation: all its segments one after the other."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def _parsed(turn: Column, template: Template) -> Column:
    """Role and text of one rendered turn."""

    def inside(first: Column | int, close: str) -> Column:
        return unescape(F.substring(turn, F.lit(first) + 1, F.length(turn) - first - len(close)), template)

    start = len(template.other.open)
    named = F.locate(template.named, turn)  # the first one: roles are escaped
    role = unescape(F.substring(turn, F.lit(start + 1), named - 1 - start), template)
    other = F.struct(role.alias("role"), inside(named - 1 + len(template.named), template.other.close).alias("text"))
    out = None
    for name, marks in template.roles.items():
        known = F.struct(F.lit(name).alias("role"), inside(len(marks.open), marks.close).alias("text"))
        begins = turn.startswith(marks.open)
        out = F.when(begins, known) if out is None else out.when(begins, known)
    return out.otherwise(other)


def read_back(chats: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """formatted()'s rows with rendered, turns (role, text) as they are read from it, n_turns of them, and loss_text.

    loss_text is all text under the loss mask, unescaped.  An empty table gives an empty table.
    """
    chats = chats.withColumn("rendered", rendered(F.col("segments")))
    turns = F.transform(
        F.regexp_extract_all("rendered", F.lit(template.turn), F.lit(0)), lambda t: _parsed(t, template)
    )
    under = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template))
    chats = chats.withColumn("turns", turns).withColumn("loss_text", F.array_join(under, ""))
    return chats.withColumn("n_turns", F.size("turns").cast("long"))
