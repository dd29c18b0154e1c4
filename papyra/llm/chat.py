"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. Successive prefixes of a conversation are
rendered, and each output is compared with the one before: what was added is the new turn's span. A template
that changes what it had already written is detected. Within a turn's span, its text's place is found by
rendering the turn with another text. The loss mask is the assistant texts' places.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import partitions

Template = Callable[[list[tuple[str, str]]], str]
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
_ESCAPE = re.compile(r"[\\#<]")
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """No ``### `` or ``</turn>`` of a text can be taken for the template's: a backslash goes before each of ``\\ # <``."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def default_template(turns: list[tuple[str, str]]) -> str:
    """``### Role: text </turn>`` a line, roles and texts escaped."""
    return "".join(f"### {ROLES.get(r) or 'Role ' + escape_role(r)}: {escape(t)} </turn>\n" for r, t in turns)


def parse_default(text: str) -> list[tuple[str, str]]:
    """The turns that ``default_template`` wrote."""
    names = {v: k for k, v in ROLES.items()}
    out = []
    for m in re.finditer(r"### ((?:[^\\:]|\\.)*?): ((?:[^\\<]|\\.)*) </turn>\n", text, re.S):
        role = m[1]
        out.append((names.get(role) or unescape(role.removeprefix("Role ")), unescape(m[2])))
    return out


@dataclass
class Rendered:
    text: str
    spans: list[tuple[int, int]] = field(default_factory=list)  # each turn's
    bodies: list[tuple[int, int] | None] = field(default_factory=list)  # each turn's text within its span, as it was written; None: not found
    rewrites: bool = False


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def render(turns: list[tuple[str, str]], template: Template = default_template) -> Rendered:
    """Renders prefix after prefix. If the template rewrites history, the spans are not to be trusted: none are given."""
    out = Rendered(template([]))
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        if not now.startswith(out.text):
            return Rendered(template(turns), rewrites=True)
        at = len(out.text)
        # two probes that differ from the start and in the end show what stands before and after the text
        head = turns[:k - 1]
        role = turns[k - 1][0]
        a, b = template([*head, (role, "a")])[at:], template([*head, (role, "b")])[at:]
        left = _common(a, b)
        right = _common(a[left:][::-1], b[left:][::-1])
        out.spans.append((at, len(now)))
        body = now[at + left:len(now) - right] if left + right <= len(now) - at else None
        fits = body is not None and now[at:at + left] == a[:left] and (not right or now[-right:] == a[-right:])
        out.bodies.append((at + left, len(now) - right) if fits else None)
        out.text = now
    return out


def format_conversations(rows: DataFrame, template: Template = default_template) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, spans`` (array of turn, role, start, end, body_start,
    body_end, found), ``rewrites_history``. ``rows``: conv_id, turn, role, text.

    ``found`` is false, and the body's bounds are null, for a turn whose text the template writes in a way that two
    probes don't show (so that it depends on the text where it stands): its text is not in the loss mask.
    A conversation is rendered three times a turn, each time up to it: the work grows with the square of its turns,
    as it must for a template that is only known by its outputs. One conversation is held in one task.

    Null texts are empty, null roles the empty role. Turns are in order of turn (nulls first); ties by role,
    then text; repeated rows are turns of their own. A null conv_id is a conversation. An empty table gives
    no rows; extra columns are ignored. Offsets are in code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(done: list) -> pa.RecordBatch:
            out = [(c, len(t), render(t, template), t) for c, t in done]
            spans = [[{"turn": k, "role": t[k][0], "start": s[0], "end": s[1], "body_start": b and b[0], "body_end": b and b[1], "found": b is not None} for k, (s, b) in enumerate(zip(r.spans, r.bodies))] for _, _, r, t in out]
            kind = pa.list_(pa.struct([("turn", pa.int32()), ("role", pa.string()), *((n, pa.int64()) for n in ("start", "end", "body_start", "body_end")), ("found", pa.bool_())]))
            return pa.RecordBatch.from_arrays([pa.array([c for c, *_ in out], pa.int64()), pa.array([n for _, n, *_ in out], pa.int64()), pa.array([r.text for *_, r, _ in out], pa.string()),
                                               pa.array(spans, kind), pa.array([r.rewrites for *_, r, _ in out], pa.bool_())], ["conv_id", "n_turns", "formatted", "spans", "rewrites_history"])

        done: list = []
        for b in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if not done or done[-1][0] != conv:
                    if len(done) >= 500:
                        yield flush(done)
                        done = []
                    done.append((conv, []))
                done[-1][1].append((role or "", text or ""))
        if done:
            yield flush(done)

    dealt = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = dealt.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(
        run, "conv_id long, n_turns long, formatted string, spans array<struct<turn:int,role:string,start:long,end:long,body_start:long,body_end:long,found:boolean>>, rewrites_history boolean")


def digests(formatted: DataFrame, parse: Callable[[str], list[tuple[str, str]]] = parse_default, undo: Callable[[str], str] = unescape, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """What ``format_conversations`` wrote, read back from it: the turns parsed from the text, the loss text cut out
    of it by the spans and undone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            out = []
            for conv, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                turns = parse(text)
                loss = "".join(undo(text[s["body_start"]:s["body_end"]]) for s in spans if s["found"] and s["role"] in roles)
                out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
