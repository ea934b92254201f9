"""Chat formatting with turn spans found by incremental black-box rendering.

A template is a function from a list of (role, text) turns to one string; nothing of its inside
is used. A conversation's turn prefixes are rendered one after the other. Where each output
begins with the one before it, what it adds is the new turn's span; a turn whose output changes
earlier text shows a template that rewrites history. Inside a turn's span the text is found by
two more renderings of the same prefix, with one-letter texts in place of the turn's: what both
have in common before and after the letter is the turn's header and footer.

Templates that rewrite history have no fixed spans while turns arrive. Their spans are sought in
the whole conversation's output, by the same probes on every turn; a turn whose text isn't there
unchanged (dropped or cut by the template) gets none and no loss.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

#: Fixed values of the format.
START, END = "<|im_start|>", "<|im_end|>"
#: One mark is `<`, any number of backslashes, `|`; inside a text every mark has one backslash more.
MARK, SHORTER = re.compile(r"<(\\*)\|"), r"<\\(\\*)\|"
LOSS_ROLES = ("assistant",)
#: Characters of output that a task holds before it hands them on.
HELD_CHARS = 4_000_000
SPAN = "struct<turn:int,start:int,text_start:int,text_end:int,end:int,loss:boolean>"
FORMATTED = f"n_turns long, formatted string, spans array<{SPAN}>, rewritten array<int>"


def escape(text: str) -> str:
    return MARK.sub(r"<\1\\|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def chatml(turns: Sequence[Turn]) -> str:
    """Every turn between marks, its role on the first line; control strings inside are escaped."""
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def _common(a: str, b: str) -> int:
    """Length of the longest common beginning."""
    low, step = 0, 64
    while a[low:low + step] == b[low:low + step]:
        if low + step >= min(len(a), len(b)):
            return min(len(a), len(b))
        low, step = low + step, 2 * step
    while step > 1:  # they differ within the next `step` characters
        half = step // 2
        if a[low:low + half] == b[low:low + half]:
            low, step = low + half, step - half
        else:
            step = half
    return low


def _probe(template: Template, turns: list[Turn], at: int, first: int) -> tuple[int, int] | None:
    """(characters before, characters after) the text of turn ``at`` in the output, from character
    ``first`` on; None if the output doesn't show the turn's text at one place."""
    role = turns[at][0]
    a, b = (template([*turns[:at], (role, letter), *turns[at + 1:]]) for letter in "ab")
    before = first + _common(a[first:], b[first:])
    if len(a) != len(b) or a[before + 1:] != b[before + 1:] or (a[before:before + 1], b[before:before + 1]) != ("a", "b"):
        return None
    return before, len(a) - before - 1


def render(template: Template, turns: Sequence[Turn], escaped: Callable[[str], str] = escape,
           loss_roles: Sequence[str] = LOSS_ROLES) -> tuple[str, list[tuple], list[int]]:
    """(output, spans, rewritten turns) of one conversation.

    A span is (turn, start, text start, text end, end, loss) in characters of the output. For a
    template that rewrites, start and end are those of the text itself.
    """
    turns = list(turns)
    output = template([])
    ends, places, rewritten = [len(output)], [], []
    for i in range(len(turns)):
        longer = template(turns[:i + 1])
        if not longer.startswith(output):
            rewritten.append(i)
        elif not rewritten:
            places.append(_probe(template, turns[:i + 1], i, len(output)))
        ends.append(len(longer))
        output = longer
    spans = []
    if rewritten:
        places = [_probe(template, turns, i, 0) for i in range(len(turns))]
        for i, place in enumerate(places):
            if place and output[place[0]:len(output) - place[1]] == escaped(turns[i][1]):
                at, to = place[0], len(output) - place[1]
                spans.append((i, at, at, to, to, turns[i][0] in loss_roles))
        return output, spans, rewritten
    for i, place in enumerate(places):
        if place and output[place[0]:ends[i + 1] - place[1]] == escaped(turns[i][1]):
            spans.append((i, ends[i], place[0], ends[i + 1] - place[1], ends[i + 1], turns[i][0] in loss_roles))
    return output, spans, rewritten


def _conversations(template: Template, escaped: Callable[[str], str], loss_roles: Sequence[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, open_id, turns = [], 0, None, []

        def close():
            nonlocal size, turns
            output, spans, rewritten = render(template, turns, escaped, loss_roles)
            held.append((open_id, len(turns), output, spans, rewritten))
            size, turns = size + len(output), []

        def hand_on() -> pd.DataFrame:
            nonlocal held, size
            out = pd.DataFrame(held, columns=["id", "n_turns", "formatted", "spans", "rewritten"])
            held, size = [], 0
            return out

        for frame in frames:
            for key, role, text in zip(frame["id"], frame["role"], frame["text"]):
                if turns and key != open_id:
                    close()
                    if size > HELD_CHARS:
                        yield hand_on()
                open_id = key
                turns.append((role, text))
        if turns:
            close()
            yield hand_on()

    return run


def format_chats(df: DataFrame, template: Template = chatml, escaped: Callable[[str], str] = escape,
                 loss_roles: Sequence[str] = LOSS_ROLES, id_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, n_turns, formatted, spans, rewritten (turns whose rendering
    changed earlier output).

    Rows of one id are a conversation, by turn; rows with the same turn go by role and text, a
    null turn comes first, repeated rows are turns each. Null role and text count as empty. Rows
    without an id are one conversation. Extra columns are ignored; an empty table gives an empty
    one. ``escaped`` is what the template does to a text. A template sees a conversation whole,
    so one conversation is rendered in one task, with work that grows with its turns times its
    length; conversations are spread by id.
    """
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{id_col}`").cast("string")), F.lit(""))
    rows = df.select(key.alias("id"), F.col(f"`{turn_col}`").alias("turn"),
                     empty(role_col).alias("role"), empty(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    out = (rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
           .mapInPandas(_conversations(template, escaped, loss_roles), f"id string, {FORMATTED}"))
    own = F.when(F.col("id") != "", F.substring("id", 2, 2**31 - 1).cast(kind))
    return out.select(own.alias(id_col), "n_turns", "formatted", "spans", "rewritten")


def unescaped(text: Column) -> Column:
    """A text from the output, as it was before the template."""
    return F.regexp_replace(text, SHORTER, r"<$1|")


def _cut(low: Column, high: Column) -> Column:
    return F.substr(F.col("formatted"), low + 1, high - low)


def loss_text(spans: str = "spans") -> Column:
    """All text under the loss mask, read from the output, unescaped, nothing between."""
    some = F.filter(F.col(spans), lambda s: s["loss"])
    return F.array_join(F.transform(some, lambda s: unescaped(_cut(s["text_start"], s["text_end"]))), "")


def chatml_turns(spans: str = "spans") -> Column:
    """array of (role, text), read from a ``chatml`` output by its spans."""
    head = len(START)

    def role(s: Column) -> Column:
        line = unescaped(_cut(s["start"] + head, s["text_start"] - 1))
        return F.regexp_replace(F.regexp_replace(line, r"((?<!\\)(?:\\\\)*)\\n", "$1\n"), r"\\\\", r"\\")

    return F.transform(F.col(spans), lambda s: F.struct(
        role(s).alias("role"), unescaped(_cut(s["text_start"], s["text_end"])).alias("text")))
