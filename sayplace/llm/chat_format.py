"""Chat formatting by a grammar round trip: render, reparse, compare with the source, escape until identical."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sayplace.llm.common import bound_batches

#: A turn is "### " role newline text newline "</turn>" newline. The marks below are control strings; with a
#: backslash before it a mark is text, and one backslash fewer is meant.
OPEN, CLOSE = "### ", "</turn>"
_MARK = re.compile(r"\\*(?:###|</turn>)")
_ESCAPED = re.compile(r"\\+(?:###|</turn>)")


def escape(text: str) -> str:
    return _MARK.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][1:], text)


def _role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def _unrole(written: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], written)


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, begin, end) of each turn, the offsets those of its written text; None if the whole isn't turns.

    A deterministic parser: a turn begins with OPEN, its role goes to the end of the line, and its text
    to the first CLOSE without a backslash before it, which must be on a line of its own.
    """
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            return None
        line = formatted.find("\n", at)
        if line < 0:
            return None
        begin = end = line + 1
        while True:
            end = formatted.find(CLOSE, end)
            if end < 0:
                return None
            if formatted[end - 1] != "\\":
                break
            end += len(CLOSE)
        if end <= begin or formatted[end - 1] != "\n" or not formatted.startswith("\n", end + len(CLOSE)):
            return None
        written = formatted[begin : end - 1]
        if any(m[0][0] != "\\" for m in _MARK.finditer(written)):
            return None
        out.append((_unrole(formatted[at + len(OPEN) : line]), unescape(written), begin, end - 1))
        at = end + len(CLOSE) + 1
    return out


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn as the template writes it, and where its text lies in it.

    The text goes in as it is; where the parser doesn't give back the same turn, it is escaped and parsed
    again until it does, which one escape brings about for any text.
    """
    head = f"{OPEN}{_role(role)}\n"
    for written in (text, escape(text)):
        formatted = f"{head}{written}\n{CLOSE}\n"
        if parse(formatted) == [(role, text, len(head), len(head) + len(written))]:
            return formatted, len(head), len(head) + len(written)
    raise ValueError("a turn that can't be written")


_FORMATTED = pa.struct([("formatted", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [render(r or "", t or "") for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array([d[0] for d in done], pa.string()),
             pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
            names=["conversation", "turn", "role", "formatted", "begin", "end"])


def format_turns(df: DataFrame, conversation: str, turn: str, role: str, text: str, in_order: bool = False) -> DataFrame:
    """Rows (conversation, turn, role, formatted, begin, end), one for every row of df.

    A conversation's text is the formatted turns of its rows, in order, with nothing between. begin and
    end are the place of the turn's written text in it, in code points: the span under the loss mask
    where the role is one that is learned. Null texts and roles are empty; a null conversation is one
    too. Repeated rows give repeated turns; other columns are left out. No shuffle; in_order takes one,
    after which each conversation's turns follow one another, by turn (null first), role and text.
    """
    bound_batches(df.sparkSession)
    kind = df.schema[conversation].dataType.simpleString()
    rows = df.select(F.col(conversation).alias("conversation"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if in_order:
        # By the text itself, before it is written: marks and escapes sort otherwise.
        rows = rows.repartition("conversation").sortWithinPartitions("conversation", "turn", "role", "text")
    return rows.mapInArrow(_render, f"conversation {kind}, turn long, role string, formatted string, begin long, end long")


def _digest(learned: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conversation", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kind, now, state, done = None, None, None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done))
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        def close() -> None:
            n, turns, chars, loss, total = state
            done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for batch in batches:
            kind = batch.schema.field(0).type
            for conversation, formatted, begin, end in zip(*(batch.column(c).to_pylist() for c in ("conversation", "formatted", "begin", "end"))):
                if state is None or conversation != now:
                    if state is not None:
                        close()
                    now, state = conversation, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                [(role, text, _, _)] = parse(formatted)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if role == learned:
                    under = unescape(formatted[begin:end])
                    state[2] += len(under)
                    state[3].update(under.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            if len(done) > 1000:
                yield out()
                done.clear()
        if state is not None:
            close()
        if done:
            yield out()

    return run


def digests(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """Rows (conversation, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of format_turns' rows in order, read back from their text.

    Turns are streamed, so a conversation of any length takes the memory of one batch: what is kept of it
    are counts and hash states.
    """
    kind = turns.schema["conversation"].dataType.simpleString()
    return turns.mapInArrow(_digest(learned), f"conversation {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
