"""Format conversations by a declarative template, with turn order checked by a finite-state machine.

The template gives every role its two markers and says whether its text is learned from; texts under the loss mask are flagged
segment by segment. A text cannot forge a marker: a backslash is doubled, and one is put behind the first character of every
marker that occurs in a text, so both go back by dropping the first of each pair.

Only column expressions. A conversation is formatted in parts of neighbouring turn numbers, so one that holds a third of all
rows is many rows in many tasks and never one. The machine runs the same way: every part says where it leads from each state,
and a conversation is the chain of these narrow answers, so no text moves for the check.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

# Turn numbers of one part.
PART_TURNS = 256


@dataclass(frozen=True)
class Turn:
    """How the texts of one role are written; `learned` texts lie under the loss mask."""

    opening: str
    closing: str
    learned: bool = False


def _turns() -> dict[str, Turn]:
    return {
        "system": Turn("[SYS]", "[/SYS]"),
        "user": Turn("[INST]", "[/INST]"),
        "assistant": Turn("[OUT]", "</s>", learned=True),
    }


def _moves() -> dict[str, dict[str, str]]:
    return {
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    }


@dataclass(frozen=True)
class Template:
    """Markers by role, the markers of all other roles (before the name, between name and text, after the text), and the machine."""

    turns: Mapping[str, Turn] = field(default_factory=_turns)
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/TEXT]")
    start: str = "start"
    moves: Mapping[str, Mapping[str, str]] = field(default_factory=_moves)
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        markers = self.markers
        heads = {m[:1] for m in markers}
        if len(set(markers)) < len(markers) or any(len(m) < 2 or "\\" in m or heads & set(m[1:]) for m in markers):
            raise ValueError("markers are distinct, of two characters or more, and no marker begins inside another")

    @property
    def markers(self) -> list[str]:
        return [m for t in self.turns.values() for m in (t.opening, t.closing)] + list(self.other)

    @property
    def states(self) -> list[str]:
        """All states; the machine numbers them from 1, and 0 is where a wrong turn leads."""
        ends = [s for by_role in self.moves.values() for s in by_role.values()]
        return list(dict.fromkeys([self.start, *self.moves, *ends]))


def escaped(text: Column, template: Template) -> Column:
    """`text` without any marker in it; `unescaped` gives it back."""
    inside = "|".join(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in template.markers)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({inside})", "$1\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, template: Template, known, other: Column) -> Column:
    chosen = F
    for name, turn in template.turns.items():
        chosen = chosen.when(role == F.lit(name), F.lit(known(turn)))
    return chosen.otherwise(other)


def chat_parts(
    rows: DataFrame,
    template: Template = Template(),
    per_part: int = PART_TURNS,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Formatted conversations: `conv_id`, `part`, `n_turns`, `segments` (`text`, `loss`), one row per `per_part` turn numbers.

    The texts of a conversation's segments, parts in order (null first), are its formatted text. Turns come in order of number,
    then role, then text, nulls first; rows that repeat a turn all stay. A null text is empty, a null role is the empty name, rows
    with a null number make a part before all others, and rows with a null id make one conversation. Roles that the template does
    not know are written with their name and never learned from. Other columns are not read; an empty table gives no rows.
    Texts of any length pass whole.
    """
    number = F.col(turn_col).cast("long")
    turn = F.struct(
        number.alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    grouped = rows.select(
        F.col(conv_col).alias("conv_id"), F.floor(number / F.lit(per_part)).alias("part"), turn.alias("turn")
    ).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def segments(t: Column) -> Column:
        name, text, after = template.other
        opening = _by_role(t["role"], template, lambda x: x.opening, F.concat(F.lit(name), escaped(t["role"], template), F.lit(text)))
        closing = _by_role(t["role"], template, lambda x: x.closing, F.lit(after))
        learned = _by_role(t["role"], template, lambda x: x.learned, F.lit(False))
        plain = F.lit(False)
        return F.array(
            F.struct(opening.alias("text"), plain.alias("loss")),
            F.struct(escaped(t["text"], template).alias("text"), learned.alias("loss")),
            F.struct(closing.alias("text"), plain.alias("loss")),
        )

    return grouped.select(
        "conv_id", "part", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", segments)).alias("segments")
    )


def read_back(parts: DataFrame, template: Template = Template()) -> DataFrame:
    """What formatted parts say: `conv_id`, `part`, `chars` (code points), `turns` (`role`, `text`) and `learned` (texts under the mask).

    Turns are read from the joined text alone, by its markers. An empty table gives no rows.
    """
    joined = parts.withColumn("_joined", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    closings = "|".join(re.escape(m) for m in [*(t.closing for t in template.turns.values()), template.other[2]])

    def turn(written: Column) -> Column:
        name, text, _ = template.other
        named = F.split(F.substring(written, len(name) + 1, 1 << 30), re.escape(text), 2)
        role, said = named[0], F.get(named, F.lit(1))
        for known, t in template.turns.items():
            here = F.startswith(written, F.lit(t.opening))
            role = F.when(here, F.lit(known)).otherwise(role)
            said = F.when(here, F.substring(written, len(t.opening) + 1, (1 << 31) - 1)).otherwise(said)
        return F.struct(unescaped(role).alias("role"), unescaped(said).alias("text"))

    return joined.select(
        "conv_id", "part", F.length("_joined").cast("long").alias("chars"),
        F.transform(F.filter(F.split("_joined", closings), lambda w: w != ""), turn).alias("turns"),
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])).alias("learned"),
    )


def chat_verdicts(
    rows: DataFrame,
    template: Template = Template(),
    per_part: int = PART_TURNS,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
) -> DataFrame:
    """One row per conversation: `conv_id`, `n_turns`, `valid`, `complete` and `bad_turn`.

    `valid`: the machine allows every turn; `bad_turn` is the place, from 1, of the first that it does not. `complete`: valid, and
    the last turn ends in a final state. Order, nulls and ties are those of `chat_parts`; an unknown role is a wrong turn.
    """
    states, roles = template.states, list(template.turns)
    numbers = {state: n for n, state in enumerate(states, 1)}
    # One row of the table per state and one column per role, the last for unknown ones; 0 leads to 0.
    table = [0] * (len(roles) + 1)
    for state in states:
        table += [numbers.get(template.moves.get(state, {}).get(role), 0) for role in roles] + [0]
    machine = F.array(*map(F.lit, table))
    number = F.col(turn_col).cast("long")
    name = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    column = F
    for place, role in enumerate(roles):
        column = column.when(name == F.lit(role), F.lit(place))
    turn = F.struct(number.alias("turn"), name.alias("name"), column.otherwise(F.lit(len(roles))).alias("role"))
    grouped = rows.select(
        F.col(conv_col).alias("conv_id"), F.floor(number / F.lit(per_part)).alias("part"), turn.alias("turn")
    ).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def at(state: Column, seen: Column, bad: Column) -> Column:
        return F.struct(state.cast("int").alias("state"), seen.cast("long").alias("seen"), bad.cast("long").alias("bad"))

    def step(so_far: Column, t: Column) -> Column:
        state = F.get(machine, so_far["state"] * F.lit(len(roles) + 1) + t["role"])
        return at(state, so_far["seen"] + 1, F.coalesce(so_far["bad"], F.when(state == 0, so_far["seen"] + 1)))

    ways = F.array(*[
        F.aggregate("turns", at(F.lit(n), F.lit(0), F.lit(None)), step) for n in range(len(states) + 1)
    ])
    parts = grouped.select("conv_id", F.struct("part", ways.alias("ways")).alias("way"))

    def follow(so_far: Column, p: Column) -> Column:
        way = F.get(p["ways"], so_far["state"])
        return at(way["state"], so_far["seen"] + way["seen"], F.coalesce(so_far["bad"], so_far["seen"] + way["bad"]))

    chained = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("way")).alias("ways")).select(
        "conv_id", F.aggregate("ways", at(F.lit(numbers[template.start]), F.lit(0), F.lit(None)), follow).alias("end")
    )
    return chained.select(
        "conv_id", F.col("end.seen").alias("n_turns"), F.col("end.bad").isNull().alias("valid"),
        F.col("end.state").isin([numbers[s] for s in template.final]).alias("complete"), F.col("end.bad").alias("bad_turn"),
    )
