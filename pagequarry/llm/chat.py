"""Chat formatting with DataFrame functions only.

A finite-state machine over roles validates the order of turns. A declarative
template turns each conversation into text segments with a loss flag each; only
the texts of trained roles carry it. Control strings begin with an escaped
character, so no text can hold one, and escapes are undone exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """begin, then the role, middle, the text, end. escapes: characters and what stands for them;
    the first is the escape character itself, and all others' begin with it."""

    begin: str = "<|"
    middle: str = "|>\n"
    end: str = "<|end|>\n"
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\s"), ("<", "\\l"), ("|", "\\p"))
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    # Which role may follow which; a conversation is valid if it ends in an accepted state.
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "system"), ("start", "user", "user"), ("system", "user", "user"),
        ("user", "assistant", "assistant"), ("assistant", "user", "user"),
    )
    accepted: tuple[str, ...] = ("assistant",)

    def escape(self, text: Column) -> Column:
        return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), self.escapes, text)

    def unescape(self, text: Column) -> Column:
        """Each escape character begins a pair, so pairs can be undone one kind at a time, its own last."""
        return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), reversed(self.escapes), text)

    def state(self, roles: Column) -> Column:
        """The machine's state after all roles; null once no move fits."""
        table = F.create_map(*[F.lit(x) for a, role, b in self.moves for x in (f"{a}\n{role}", b)])
        return F.aggregate(roles, F.lit(self.start), lambda s, r: F.try_element_at(table, F.concat(s, F.lit("\n"), r)))


TEMPLATE = Template()


def format_chats(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, valid, segments (array of text, loss) and formatted of every conversation.

    turns: conv_id, turn, role, text. Turns go by number, ties by role and text, and
    repeated rows all count. Null roles and texts are empty; null ids are one
    conversation; an empty table gives none. Invalid conversations are formatted too. A
    conversation, however long its texts, is one row; other columns are not read, whatever they are called.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(F.concat(F.lit(template.begin), template.escape(t["role"]), F.lit(template.middle)), F.lit(False)),
                segment(template.escape(t["text"]), t["role"].isin(*template.trained)),
                segment(F.lit(template.end), F.lit(False)),
            ),
        )
    )
    valid = F.coalesce(template.state(F.transform("turns", lambda t: t["role"])).isin(*template.accepted), F.lit(False))
    return whole.select("conv_id", valid.alias("valid"), segments.alias("segments")).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns (array of role, text) that a formatted conversation holds."""
    parts = F.split(formatted, escape(template.end))

    def turn(part: Column) -> Column:
        head = F.substring_index(part, template.middle, 1)
        role = F.substr(head, F.lit(len(template.begin) + 1))
        text = F.substr(part, F.char_length(head) + len(template.middle) + 1)
        return F.struct(template.unescape(role).alias("role"), template.unescape(text).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def digest(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Counts and digests of each conversation, read back from its formatted text and its flagged segments; odd rows are as in format_chats()."""
    chats = format_chats(turns, template).withColumn("back", read_back(F.col("formatted"), template))
    lost = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.withColumn("lost", lost).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
