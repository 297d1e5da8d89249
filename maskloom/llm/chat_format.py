r"""Chat formatting by a finite-state machine over roles, from a declarative template.

A template names the control strings, the roles whose texts carry loss and the transitions of the
machine. ``format_chats`` returns one row per conversation: the verdict of the machine, the
segments with the loss flags that the machine emits as it enters a turn, and the formatted string,
which is the segments joined.
``read_chats`` parses formatted strings back. Both use built-in SQL functions only.

Control strings inside texts and roles are replaced by two-character escapes. Every backslash is
escaped first, so an escape never arises from text, and an escaped text holds no control string.

Defined cases: null texts are empty; a null role has its own escape and reads back as null; rows
are ordered by turn (null turns last), ties by role, then text; repeated rows are separate turns;
a null id is one conversation; a conversation that breaks the turn order is still formatted, with
``valid`` false and the place of the first offending turn (such a turn leaves the state as it is and
emits the flag of its role); an empty table gives no rows. Rows of one
conversation meet in one row, as the formatted conversation itself is one string. Only the four
named columns are read.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class ChatTemplate:
    head: str = "### "
    role_end: str = ": "
    turn_end: str = "</turn>\n"
    turn_mark: str = "</turn>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[str, str] = field(default_factory=lambda: {
        "start system": "system", "start user": "user", "system user": "user", "user assistant": "assistant", "assistant user": "user"})

    def escapes(self) -> list[tuple[str, str]]:
        """Backslash first; the order of the rest does not matter."""
        return [("\\", "\\s"), (self.turn_mark, "\\e"), (self.head, "\\h"), (self.role_end, "\\c")]

    def escape(self, text: Column) -> Column:
        for plain, code in self.escapes():
            text = F.replace(text, F.lit(plain), F.lit(code))
        return text

    def unescape(self, text: Column) -> Column:
        for plain, code in reversed(self.escapes()):
            text = F.replace(text, F.lit(code), F.lit(plain))
        return text


NULL_ROLE = "\\0"


def format_chats(rows: DataFrame, template: ChatTemplate = ChatTemplate(), id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: id, n_turns, valid, bad_turn, segments, formatted."""
    turn = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), F.col("role").cast("string").alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = rows.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # A move leads to a state and emits a flag: whether the state it enters carries loss.
    moves = F.create_map(*[x for pair, to in template.transitions.items()
                           for x in (F.lit(pair), F.struct(F.lit(to).alias("state"), F.lit("1" if to in template.loss_roles else "0").alias("flag")))])

    def step(now: Column, turn: Column) -> Column:
        move = moves[F.concat(now["state"], F.lit(" "), F.coalesce(turn["role"], F.lit("")))]
        stray = F.when(turn["role"].isin(*template.loss_roles), "1").otherwise("0")
        return F.struct(F.coalesce(move["state"], now["state"]).alias("state"), F.concat(now["flags"], F.coalesce(move["flag"], stray)).alias("flags"),
                        F.when(now["bad"].isNull() & move.isNull(), F.length(now["flags"])).otherwise(now["bad"]).alias("bad"))

    begin = F.struct(F.lit(template.start).alias("state"), F.lit("").alias("flags"), F.lit(None).cast("int").alias("bad"))

    def segments(turn: Column, at: Column) -> Column:
        role = F.coalesce(template.escape(turn["role"]), F.lit(NULL_ROLE))
        loss = F.substr(F.col("ended.flags"), at + 1, F.lit(1)) == "1"
        part = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        return F.array(part(F.concat(F.lit(template.head), role, F.lit(template.role_end)), F.lit(False)),
                       part(template.escape(turn["text"]), loss), part(F.lit(template.turn_end), F.lit(False)))

    # A generator, so that the machine runs once and not again for every turn that asks for its flag.
    run = chats.select("id", "turns", F.explode(F.array(F.aggregate("turns", begin, step))).alias("ended"))
    return (run.select("id", F.size("turns").cast("long").alias("n_turns"), F.col("ended.bad").alias("bad_turn"),
                       F.flatten(F.transform("turns", segments)).alias("segments"))
            .select(F.col("id").alias(id_col), "n_turns", F.col("bad_turn").isNull().alias("valid"), "bad_turn", "segments",
                    F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted")))


def read_chats(chats: DataFrame, template: ChatTemplate = ChatTemplate(), id_col: str = "conv_id") -> DataFrame:
    """Parse ``formatted`` and the loss mask back: id, turns (role, text), loss_text; the machine's verdict is passed on."""
    pieces = F.split("formatted", "\\Q" + template.turn_end + "\\E")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def parse(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(template.head) + 1))
        cut = F.locate(template.role_end, body)
        role = F.substr(body, F.lit(1), cut - 1)
        return F.struct(F.when(role != NULL_ROLE, template.unescape(role)).alias("role"),
                        template.unescape(F.substr(body, cut + len(template.role_end))).alias("text"))

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")
    return chats.select(id_col, F.transform(pieces, parse).alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn")
