"""Chat formatting by incremental black-box rendering.

A template is any object with ``render(messages) -> str`` and ``unescape(text) -> str``. Nothing
else is known about it: the turns of a conversation are rendered as growing prefixes, and what
each output adds to the one before is the span of the new turn. Where an output does not start
with the one before, the template rewrites history; the conversation is flagged and its contents
are then located in the final output only. The place of a content inside its span is found by
rendering the same prefix with two one-letter contents: they differ exactly there.

Rows are grouped by conversation with one shuffle and streamed in turn order; a task holds one
conversation at a time. Cases: null text is empty; null role is the empty role; turns sort nulls
first, equal turns by role and text; repeated rows are turns of their own; a null conv_id is one
conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import short_batches

SPANS = "array<struct<role:string,start:int,end:int,text_start:int,text_end:int,loss:boolean>>"
RESULT = f"conv_id long, formatted string, rewrites boolean, spans {SPANS}"
Message = tuple[str, str]


class InstTemplate:
    """Instruction marks around users, ``</s>`` after assistants; other roles are named.

    Control strings begin with one of ``< [ |``; texts never contain these, since escaping
    writes them as a backslash and a letter.
    """

    _CODE = {"\\": "\\\\", "<": "\\l", "[": "\\b", "|": "\\p"}
    _TABLE = str.maketrans(_CODE)
    _BACK = {v[1]: k for k, v in _CODE.items()}
    _ESCAPED = re.compile(r"\\(.)", re.DOTALL)
    _TURN = re.compile(r"\[INST\] (?P<user>[^\[]*) \[/INST\]|<<SYS>>\n(?P<system>[^<]*)\n<</SYS>>|<\|(?P<role>[^|]*)\|>(?P<other>[^<]*)<\|end\|>| (?P<assistant>[^<]*)</s>")

    def escape(self, text: str) -> str:
        return text.translate(self._TABLE)

    def unescape(self, text: str) -> str:
        return self._ESCAPED.sub(lambda m: self._BACK[m[1]], text)

    def render(self, messages: list[Message]) -> str:
        out = ["<s>"]
        for role, text in messages:
            t = self.escape(text)
            if role == "user":
                out.append(f"[INST] {t} [/INST]")
            elif role == "assistant":
                out.append(f" {t}</s>")
            elif role == "system":
                out.append(f"<<SYS>>\n{t}\n<</SYS>>")
            else:
                out.append(f"<|{self.escape(role)}|>{t}<|end|>")
        return "".join(out)

    def parse(self, formatted: str) -> list[Message]:
        """The turns of a rendered conversation."""
        turns, at = [], len("<s>")
        while at < len(formatted):
            m = self._TURN.match(formatted, at)
            if m is None:
                raise ValueError(f"no turn at {at}")
            kind = m.lastgroup
            role = m["role"] if kind == "other" else kind
            turns.append((self.unescape(role), self.unescape(m[kind])))
            at = m.end()
        return turns


def _differ(a: str, b: str, sure: int) -> tuple[int, int]:
    """Length of the common start and of the common end; ``sure`` letters are known equal."""
    head, most = sure, min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head, tail


def _added(template, context: list[Message], turn: Message) -> tuple[str, bool, int, int]:
    """What a turn adds after its context, whether that rewrites it, and where its text lies."""
    role, _ = turn
    before, out = template.render(context), template.render([*context, turn])
    one, two = template.render([*context, (role, "x")]), template.render([*context, (role, "y")])
    head, tail = _differ(one, two, len(before) if one.startswith(before) and two.startswith(before) else 0)
    return out[len(before) :], not out.startswith(before), head - len(before), len(out) - tail - len(before)


def spans_of(template, messages: list[Message], near: int = 8) -> tuple[str, bool, list[dict]]:
    """Rendered text, whether the template rewrites history, and the span of every turn.

    A turn is rendered after its prefix, or, beyond ``near`` turns, after the first turn and the
    ``near`` before it; the whole conversation rendered at once must then be the pieces put
    together. If it is not, the template looks further back and every whole prefix is rendered.
    """
    full = template.render(messages)
    for local in (True, False):
        at, spans, pieces, rewrites = len(template.render([])), [], [template.render([])], False
        for k, (role, text) in enumerate(messages):
            context = messages[:k] if k <= near or not local else [messages[0], *messages[k - near : k]]
            piece, rewritten, start, end = _added(template, context, (role, text))
            rewrites |= rewritten
            spans.append({"role": role, "start": at, "end": at + len(piece), "text_start": at + start, "text_end": at + end, "loss": role == "assistant"})
            pieces.append(piece)
            at += len(piece)
        if "".join(pieces) == full:
            break
    if rewrites or "".join(pieces) != full:
        rewrites = True
        for k, (role, _) in enumerate(messages):
            one, two = (template.render([*messages[:k], (role, c), *messages[k + 1 :]]) for c in "xy")
            head, tail = _differ(one, two, 0)
            end = len(full) - tail if one != two else head
            spans[k] |= {"start": head, "end": max(head, end), "text_start": head, "text_end": max(head, end)}
    return full, rewrites, spans


def format_conversations(turns: DataFrame, template=None) -> DataFrame:
    """One row per conversation: formatted text, rewrite flag, spans with the loss mask."""
    template = template or InstTemplate()
    short_batches(turns.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(b["conv_id"].astype("Int64"), b["role"], b["text"], strict=True)

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for conv, group in groupby(rows(batches), key=lambda r: None if pd.isna(r[0]) else int(r[0])):
            formatted, rewrites, spans = spans_of(template, [(r, t) for _, r, t in group])
            out.append((conv, formatted, rewrites, spans))
            if len(out) >= 256:
                yield _frame(out)
                out = []
        yield _frame(out)

    kept = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(render, RESULT)


def _frame(out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=["conv_id", "formatted", "rewrites", "spans"])
    return frame.assign(conv_id=frame["conv_id"].astype("Int64"))


def read_back(formatted: DataFrame, template=None) -> DataFrame:
    """The contract's columns, taken from the formatted texts and their loss spans."""
    template = template or InstTemplate()

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def read(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, marks in zip(texts, spans, strict=True):
            turns = template.parse(text)
            loss = "".join(template.unescape(text[m["text_start"] : m["text_end"]]) for m in marks if m["loss"])
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            out.append((len(turns), _sha(said), len(loss), _sha(loss), len(text)))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", read("formatted", "spans").alias("_r")).select("conv_id", "_r.*")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
