"""Chat formatting by a grammar round trip.

Grammar of the rendered text:

    conversation = turn*
    turn         = "### " name LF body "</turn>" LF
    name, body   = (plain | escape)*
    escape       = "\\" followed by a control string, which stands for itself
    control      = "\\" | "###" | "</turn>"      (in a name also LF)

A turn is first rendered as it is and parsed again; where the parser recovers
anything but the source, conflicting control strings get escaped and the turn
is parsed once more, until both are identical. The loss mask covers the body
of assistant turns. Reading back parses each conversation as one text, across
the edges of its pieces, and cuts the loss text out by the mask's spans.

Defined results: a null text or role counts as empty; rows of a conversation
are ordered by turn (nulls first), then role, then text, so ties and repeated
rows each keep a place of their own; a null conversation id is one conversation;
an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD, END, ESC = "### ", "</turn>", "\\"
BODY_CONTROLS = (ESC, "###", END)
NAME_CONTROLS = (*BODY_CONTROLS, "\n")


def escape(text: str, controls: tuple[str, ...]) -> str:
    for c in controls:  # the escape character comes first
        text = text.replace(c, ESC + c)
    return text


#: What may need a closer look: the first characters of escapes, control strings and stops.
SIGNS = {stop: re.compile(f"[{re.escape(ESC)}#<{stop[0]}]") for stop in ("\n", END)}
ESCAPED = re.compile(re.escape(ESC) + "(" + "|".join(map(re.escape, BODY_CONTROLS)) + ")")


def unescape(body: str) -> str:
    """The text that a rendered body stands for."""
    return ESCAPED.sub(r"\1", body)


class Unfinished(ValueError):
    """A turn has begun, but not ended."""


def scan(text: str, at: int, controls: tuple[str, ...], stop: str) -> tuple[str, int]:
    """Plain text from `at` up to an unescaped `stop`, and the place of that stop.
    ValueError: another control string stands unescaped; Unfinished: no stop comes."""
    out, plain = [], at
    while at < len(text):
        if text[at] == ESC:
            known = next((c for c in controls if text.startswith(c, at + 1)), None)
            if known:
                out += [text[plain:at], known]
                at = plain = at + 1 + len(known)
                continue
        elif text.startswith(stop, at):
            out.append(text[plain:at])
            return "".join(out), at
        elif text.startswith("###", at) or text.startswith(END, at):
            raise ValueError("control string without escape")
        sign = SIGNS[stop].search(text, at + 1)
        at = sign.start() if sign else len(text)
    raise Unfinished("no end of turn")


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """Turns of a rendered conversation: role, text, and the span of the body."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(HEAD, at):
            raise ValueError("no head of turn")
        role, at = scan(rendered, at + len(HEAD), NAME_CONTROLS, "\n")
        start = at + 1
        text, at = scan(rendered, start, BODY_CONTROLS, END)
        turns.append((role, text, start, at))
        at += len(END)
        if rendered[at : at + 1] != "\n":
            raise ValueError("no line end after turn")
        at += 1
    return turns


def render(role: str, text: str) -> tuple[str, int, int, int]:
    """A turn, the span of its body, and how many of its two parts got escapes."""
    for escapes in ((False, False), (False, True), (True, False), (True, True)):
        name = escape(role, NAME_CONTROLS) if escapes[0] else role
        body = escape(text, BODY_CONTROLS) if escapes[1] else text
        rendered = f"{HEAD}{name}\n{body}{END}\n"
        try:
            found = parse(rendered)
        except ValueError:
            continue
        if [x[:2] for x in found] == [(role, text)]:
            return rendered, found[0][2], found[0][3], sum(escapes)
    raise AssertionError("the grammar escapes every conflict")


def format_turns(rows: DataFrame) -> DataFrame:
    """One row per row of (conv_id, turn, role, text): `rendered`, the span of
    its body in it (`body_from`, `body_to`, code points), `in_loss` and `escaped`.
    A conversation's text is its turns' `rendered` joined in order."""
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType(
        [T.StructField(c, kinds[c]) for c in ("conv_id", "turn", "role", "text")]
        + [T.StructField("rendered", T.StringType()), T.StructField("body_from", T.LongType()), T.StructField("body_to", T.LongType()), T.StructField("in_loss", T.BooleanType()), T.StructField("escaped", T.IntegerType())]
    )

    def batches(it):
        for batch in it:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            done = [render(r or "", t or "") for r, t in zip(roles, texts)]
            made = [pa.array([d[k] for d in done], kind) for k, kind in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))]
            made += [pa.array([r == "assistant" for r in roles], pa.bool_()), pa.array([d[3] for d in done], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema.names)

    return rows.select("conv_id", "turn", "role", "text").mapInArrow(batches, schema)


class Reader:
    """Reads one conversation from pieces of its rendered text, which may break anywhere."""

    def __init__(self, conv):
        self.conv, self.n, self.length, self.loss_chars = conv, 0, 0, 0
        self.turns, self.loss, self.rest = hashlib.sha256(), hashlib.sha256(), ""

    def feed(self, piece: str, spans: list[tuple[int, int]]) -> None:
        """spans: what the loss mask covers of this piece."""
        for start, end in spans:
            text = unescape(piece[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.length += len(piece)
        self.rest += piece
        # A turn may only be complete where its last line ends.
        if self.rest.endswith(f"{END}\n"):
            try:
                found = parse(self.rest)
            except Unfinished:  # that end was an escaped one
                return
            for role, text, _, _ in found:
                self.n += 1
                self.turns.update(f"{role}\n{text}\n".encode())
            self.rest = ""

    def close(self) -> tuple:
        if self.rest:
            raise Unfinished("no end of turn")
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.length


def read_back(turns: DataFrame) -> DataFrame:
    """One row per conversation, from the rendered text and its loss mask alone: digests of what the parser
    recovers and of what the mask covers. Turns stream past in order, so that a conversation of any length
    needs the memory of one turn."""
    kind = turns.schema["conv_id"].dataType
    schema = T.StructType(
        [T.StructField("conv_id", kind)]
        + [T.StructField(n, t) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))]
    )

    def batches(it):
        done, reader = [], None
        for batch in it:
            for c, rendered, masked, start, end in zip(*(x.to_pylist() for x in batch.columns)):
                if reader is None or c != reader.conv:
                    if reader is not None:
                        done.append(reader.close())
                    reader = Reader(c)
                reader.feed(rendered, [(start, end)] if masked else [])
            yield _table(done, schema)
            done = []
        if reader is not None:
            yield _table([reader.close()], schema)

    # One conversation's digest is one chain, so its turns meet in one task, but stream through it.
    order = ["conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    rows = turns.repartition("conv_id").sortWithinPartitions(*order)
    return rows.select("conv_id", "rendered", "in_loss", "body_from", "body_to").mapInArrow(batches, schema)


def _table(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.field(k).type) for k in range(len(schema))], schema=kinds)
