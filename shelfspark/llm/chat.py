r"""Chat formatting: a finite-state machine over roles and a declarative template.

The template gives the text around each turn, the roles whose text is trained on
and the machine's transitions. Each conversation becomes a list of segments with
a loss flag; its formatted text is their concatenation, the loss mask the flags.

Control strings inside texts are escaped with a backslash, and so are backslashes;
an end marker always follows a newline that no escape can produce, so ``parse``
reads turns back exactly. Only DataFrame functions are used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written, what is trained on, and which role may follow which."""

    open: str = "### "
    after_role: str = ":\n"
    close: str = "\n</turn>\n"
    #: Strings that texts may hold only escaped: the openings and the end marker without its newlines.
    control: tuple[str, ...] = ("###", "</turn>")
    trained: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state; a conversation begins in ``start`` and may end in ``final``.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    start: str = "start"
    final: tuple[str, ...] = ("answered",)


TEMPLATE = Template()
ESCAPE = "\\"
DEAD = "invalid"


def escape(text: Column, t: Template = TEMPLATE) -> Column:
    for s in (ESCAPE, *t.control):
        text = F.replace(text, F.lit(s), F.lit(ESCAPE + s))
    return text


def unescape(text: Column, t: Template = TEMPLATE) -> Column:
    inner = "|".join(re.escape(s) for s in (ESCAPE, *t.control))
    return F.regexp_replace(text, rf"\\({inner})", "$1")


def _role(role: Column, t: Template) -> Column:
    """A role as it is written: escaped, and on one line."""
    return F.replace(escape(role, t), F.lit("\n"), F.lit(ESCAPE + "n"))


def _role_back(role: Column, t: Template) -> Column:
    inner = "|".join(re.escape(s) for s in t.control)
    # pairs are read from the left, since an escaped backslash may stand before an n; marks stand around the n of a newline
    kept = F.regexp_replace(role, rf"\\(?:(n)|(\\)|({inner}))", "$2$3\u0001$1\u0000")
    return F.replace(F.replace(kept, F.lit("\u0001n\u0000"), F.lit("\n")), F.lit("\u0001\u0000"), F.lit(""))


def verdict(roles: Column, t: Template = TEMPLATE) -> Column:
    """struct(state, at): the machine's last state, and the turn at which it broke off or null."""
    moves = F.create_map(*[F.lit(x) for (s, r), to in t.moves.items() for x in (f"{s}|{r}", to)])
    first = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("at"))

    def step(a: Column, role: Column) -> Column:
        to = F.coalesce(F.try_element_at(moves, F.concat(a["state"], F.lit("|"), role)), F.lit(DEAD))
        broken = F.when(a["at"].isNull() & (to == DEAD), a["n"]).otherwise(a["at"])
        return F.struct(to.alias("state"), (a["n"] + 1).alias("n"), broken.alias("at"))

    return F.aggregate(roles, first, step)


def format_conversations(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, segments array<struct<text, loss>>, formatted, valid, error_turn): one row per conversation.

    ``rows`` has conv_id, turn, role and text. Turns are put in order of turn, then
    role and text for ties; repeated rows are repeated turns; a null turn comes
    first, a null role or text counts as empty, and null ids are one conversation.
    A conversation that the machine refuses is formatted all the same, with
    ``valid`` false and the number of the first wrong turn (null if only the end is
    missing). Other columns are ignored; an empty table gives an empty result.
    """
    t = template
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def segments(x: Column) -> Column:
        head = F.concat(F.lit(t.open), _role(x["role"], t), F.lit(t.after_role))
        return F.array(segment(head, F.lit(False)), segment(escape(x["text"], t), x["role"].isin(*t.trained)), segment(F.lit(t.close), F.lit(False)))

    made = whole.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), verdict(F.transform("turns", lambda x: x["role"]), t).alias("v"))
    return made.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("v.state").isin(*t.final) & F.col("v.at").isNull()).alias("valid"),
        F.col("v.at").alias("error_turn"),
    )


def parse(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation."""
    t = template
    parts = F.split(formatted, re.escape(t.close))
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)  # nothing follows the last end marker

    def turn(x: Column) -> Column:
        line = F.instr(x, "\n")
        role = F.substring(x, F.lit(len(t.open) + 1), line - len(t.open) - len(t.after_role))
        text = F.substring(x, line + 1, F.length(x))
        return F.struct(_role_back(role, t).alias("role"), unescape(text, t).alias("text"))

    return F.transform(parts, turn)


def op6(rows: DataFrame) -> DataFrame:
    r"""Digests of all conversations and of conversation -7, read back from what was formatted."""
    odd = r"\### Assistant: </turn> ok"
    more = rows.sparkSession.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    made = format_conversations(rows.select("conv_id", "turn", "role", "text").unionByName(more))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = made.select("conv_id", parse(F.col("formatted")).alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "error_turn")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
        "error_turn",
    )


# formatted_chars: 4 + role + 2 + text + 9 characters a turn, and one for each escape
OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS n,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM rows
), sized AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) AS written,
    CASE WHEN role = 'user' THEN before IS NULL OR before IN ('system', 'assistant')
         WHEN role = 'assistant' THEN coalesce(before = 'user', false)
         ELSE role = 'system' AND n = 0 END AS fits FROM placed
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(15 + length(role) + written)::BIGINT AS formatted_chars,
  bool_and(fits) AND arg_max(role, n) = 'assistant' AS valid,
  min(n) FILTER (NOT fits)::INTEGER AS error_turn
FROM sized GROUP BY conv_id
"""
