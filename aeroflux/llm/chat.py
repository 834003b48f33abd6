"""Chat formatting: a state machine over roles and a declarative template.

A :class:`Template` says how turns of every role open and close, which of them count for the loss, which strings steer the model, and which role may follow which. Rows of turns become rows of text segments with a loss flag; joined in order, the segments of a conversation are its formatted text.

The machine's state after a turn is that turn's role, so one window over the turns' order runs it: a turn is legal if its role may follow the state before it, and a conversation is valid if all its turns are and it ends in an accepting state. Nothing is dropped or repaired: what isn't valid is formatted too and says so.

Control strings inside texts are broken by a backslash after their first character, and backslashes are doubled, so reading back is exact and a text can't forge a turn. That needs markers that never join with a text to a control string, which the template checks.

Everything is DataFrame functions. One shuffle by conversation serves the window, the joining and whatever reads it back. :func:`segments` streams through windows that spill, so its memory doesn't depend on a conversation's length; :func:`formatted` holds one conversation as one row, which Spark limits to 2 GB.

Defined results: turns are ordered by turn, null first, ties by role and text, null first; repeated rows are turns of their own; a null text is empty; a null role is the role of empty name; a role that the template doesn't know is written with its name and is never legal; rows with a null conv_id are one conversation; texts are formatted whole, whatever their length; empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """How a role's turns are marked, and whether their text counts for the loss."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """A chat format as data.

    ``turns``: the marks of every role. ``other_open``, ``other_close``: around the name of a role that is not in ``turns``; ``other_end`` ends its text. ``controls``: strings that must not occur in a text. ``follows``: the roles that may come after each state, None being the start. ``accepts``: the states in which a conversation may end.
    """

    begin: str
    turns: Mapping[str, Turn]
    other_open: str
    other_close: str
    other_end: str
    controls: tuple[str, ...]
    follows: Mapping[str | None, tuple[str, ...]]
    accepts: tuple[str, ...] = field(default=("assistant",))

    def __post_init__(self) -> None:
        letters = set("".join(self.controls))
        ends = [t.close for t in self.turns.values()] + [self.other_close, self.other_end]
        begins = [t.open for t in self.turns.values()] + [self.other_open]
        if "\\" in letters:
            raise ValueError("a control string can't hold a backslash")
        if any(len(c) < 2 for c in self.controls):
            raise ValueError("a control string has at least two characters")
        if any(x[0] in letters for x in ends) or any(x[-1] in letters for x in begins):
            raise ValueError("marks meet texts in a character that no control string has")
        if any(not any(c in x for c in self.controls) for x in ends + begins):
            raise ValueError("every mark holds a control string")

    def pattern_of_controls(self) -> str:
        """The first character of a control string, where one begins."""
        return "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)

    def pattern_of_turns(self) -> str:
        """A whole turn; texts hold no mark, so the first close ends it."""
        quoted = re.escape
        known = [f"{quoted(t.open)}.*?{quoted(t.close)}" for t in self.turns.values()]
        return "(?s)" + "|".join([*known, f"{quoted(self.other_open)}.*?{quoted(self.other_close)}.*?{quoted(self.other_end)}"])


#: Instruction format with bracketed turns; system texts stand before the first instruction.
INSTRUCTIONS = Template(
    begin="<s>",
    turns={"system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("[ANSWER] ", " </s>", loss=True)},
    other_open="<<ROLE>> ",
    other_close=" <</ROLE>>\n",
    other_end="\n<</TURN>>\n",
    controls=("<s>", "</s>", "[INST]", "[/INST]", "[ANSWER]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<</TURN>>"),
    follows={None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)


def escaped(text: Column, template: Template) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, template.pattern_of_controls(), r"$0\\")


def unescaped(text: Column) -> Column:
    """A pair of backslashes is one, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def by_role(template: Template, role: Column, value, other: Column) -> Column:
    """value(turn) of the role's marks; other for roles that the template doesn't know."""
    found = other
    for name, turn in template.turns.items():
        found = F.when(role == name, value(turn)).otherwise(found)
    return found


def checked(rows: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """(conv_id, position, role, text, legal, valid_so_far): the state machine's steps."""
    order = Window.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "text")))
    position = F.row_number().over(order).cast("long")
    role = F.coalesce("role", F.lit(""))
    state = F.when(position > 1, F.lag(role).over(order))  # null at the start
    legal = F.lit(False)
    for before, after in template.follows.items():
        legal = F.when(state.eqNullSafe(F.lit(before)), role.isin(*after)).otherwise(legal)
    stepped = rows.select("conv_id", "turn", "role", "text").withColumns({"position": position, "legal": legal})
    so_far = F.min("legal").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stepped.select("conv_id", "position", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), "legal", so_far.alias("valid_so_far"))


def segments(rows: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """(conv_id, position, role, part, segment, loss, legal, valid_so_far): for each turn its opening mark (part 0), text (1) and closing mark (2), ready to be joined by (position, part)."""
    role, first = F.col("role"), F.col("position") == 1
    opening = by_role(template, role, lambda t: F.lit(t.open), F.concat(F.lit(template.other_open), escaped(role, template), F.lit(template.other_close)))
    closing = by_role(template, role, lambda t: F.lit(t.close), F.lit(template.other_end))
    loss = by_role(template, role, lambda t: F.lit(t.loss), F.lit(False))
    parts = F.array(
        F.struct(F.concat(F.when(first, F.lit(template.begin)).otherwise(F.lit("")), opening).alias("segment"), F.lit(False).alias("loss")),
        F.struct(escaped(F.col("text"), template).alias("segment"), loss.alias("loss")),
        F.struct(closing.alias("segment"), F.lit(False).alias("loss")),
    )
    return checked(rows, template).select("conv_id", "position", "role", F.posexplode(parts).alias("part", "piece"), "legal", "valid_so_far").select("conv_id", "position", "role", "part", "piece.segment", "piece.loss", "legal", "valid_so_far")


def formatted(rows: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """(conv_id, segments, valid, first_bad): the segments of a whole conversation as array<struct<segment, loss>> in order.

    ``valid``: every turn was legal and the last state accepts. ``first_bad``: position of the first turn that was not, null if there is none.
    """
    step = F.struct("position", "part", "segment", "loss")
    last = F.max_by("role", "position")
    joined = segments(rows, template).groupBy("conv_id").agg(F.sort_array(F.collect_list(step)).alias("steps"), F.min("legal").alias("legal"), F.min(F.when(~F.col("legal"), F.col("position"))).alias("first_bad"), last.alias("state"))
    return joined.select("conv_id", F.transform("steps", lambda s: F.struct(s.segment.alias("segment"), s.loss.alias("loss"))).alias("segments"), (F.col("legal") & F.col("state").isin(*template.accepts)).alias("valid"), "first_bad")


def joined_text(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda s: s.segment), "")


def loss_text(of: Column) -> Column:
    """All text under the loss mask, as it was before the template."""
    return F.array_join(F.transform(F.filter(of, lambda s: s.loss), lambda s: unescaped(s.segment)), "")


def read_back(text: Column, template: Template = INSTRUCTIONS) -> Column:
    """array<struct<role, text>> of the turns of a formatted text."""
    turns = F.regexp_extract_all(F.substr(text, F.lit(len(template.begin) + 1)), F.lit(template.pattern_of_turns()), F.lit(0))

    def parsed(turn: Column) -> Column:
        inner = F.substr(turn, F.lit(len(template.other_open) + 1), F.length(turn) - len(template.other_open) - len(template.other_end))
        name_ends = F.position(F.lit(template.other_close), inner)
        found = F.struct(unescaped(F.substr(inner, F.lit(1), name_ends - 1)).alias("role"), unescaped(F.substr(inner, name_ends + len(template.other_close))).alias("text"))
        for name, t in template.turns.items():
            body = F.substr(turn, F.lit(len(t.open) + 1), F.length(turn) - len(t.open) - len(t.close))
            found = F.when(F.startswith(turn, F.lit(t.open)), F.struct(F.lit(name).alias("role"), unescaped(body).alias("text"))).otherwise(found)
        return found

    return F.transform(turns, parsed)
