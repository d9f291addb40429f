"""Operator 9, chat formatting: a finite-state machine over roles and a declarative template.

Built of SQL functions only. One output row per conversation holds the text segments with their
loss flags; their concatenation is the formatted text. Every control string of the template begins
with ``<``; texts and roles have ``&`` and ``<`` replaced by entities, so no text can contain a
control string and the replacement can be undone.

Defined cases: null text or role counts as empty; rows of a conversation are ordered by turn, role,
text (nulls first), repeated rows are repeated turns; a null conv_id is a conversation of its own;
unknown roles are formatted under their own name and make the conversation invalid; an empty table
gives an empty result; extra columns are ignored. A conversation's text is one value, so all rows of
one conversation meet in one task: the size of the longest conversation, not their number, bounds it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is written, which roles bear loss, and which role may follow which."""

    turn_open: str = "<|im_start|>"
    role_end: str = "\n"
    turn_close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> roles that may come next; the state after a turn is its role.
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    accept: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if not (self.turn_open.startswith("<") and self.turn_close.startswith("<")):
            raise ValueError("control strings must begin with '<', the character that texts have escaped")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def _states(roles: Column, template: Template) -> Column:
    """The machine's state after all roles: the last role, or 'error'."""
    moves = {(s, r) for s, rs in template.follows.items() for r in rs}
    step = lambda s, r: F.coalesce(*[F.when((s == a) & (r == b), F.lit(b)) for a, b in sorted(moves)], F.lit("error"))
    return F.aggregate(roles, F.lit("start"), step)


def format_chats(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, roles, valid, segments (text, loss) and formatted text of each conversation."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segments(t: Column) -> Column:
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(template.turn_open), _escape_role(t["role"]), F.lit(template.role_end))
        return F.array(
            seg(head, F.lit(False)),
            seg(escape(t["text"]), t["role"].isin(*template.loss_roles)),
            seg(F.lit(template.turn_close), F.lit(False)),
        )

    roles = F.transform("turns", lambda t: t["role"])
    return (
        chats.select("conv_id", roles.alias("roles"), F.flatten(F.transform("turns", segments)).alias("segments"))
        .withColumn("valid", _states(F.col("roles"), template).isin(*template.accept))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def parse_chats(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> read back from a formatted text."""
    body = F.split(formatted, r"\Q" + template.turn_close + r"\E")
    body = F.slice(body, F.lit(1), F.size(body) - 1)

    def turn(x: Column) -> Column:
        rest = F.substring(x, F.lit(len(template.turn_open) + 1), F.length(x))
        role = F.substring_index(rest, template.role_end, 1)
        text = F.substring(rest, F.length(role) + len(template.role_end) + 1, F.length(rest))
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(body, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
