"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "<<TURN>>" role "[INST]" text "[/INST]</s>" | "<<TURN>>" role "<s>" text "</s>"

Turns of the assistant take the second form, and their texts are the loss mask. A control string
counts only where no odd run of backslashes stands before it. A first rendering escapes nothing;
the parser then reads it back, and while the recovered turns differ from the source, the first turn
that differs has its role and text escaped (a backslash before each backslash and before the first
character of each control string). All turns escaped always read back right, so this ends.

The parser unescapes every role and text, so a text with backslashes differs at first and is escaped.

Defined results. Null role and null text are empty strings. Turns come in order of turn, role, text
(nulls first), so ties and repeated rows have one result. Null conv_id is one conversation of its
own. An empty table gives an empty table. Only conv_id, turn, role and text of the input are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, slices

TURN, OPEN, CLOSE, BEGIN, END = "<<TURN>>", "[INST]", "[/INST]", "<s>", "</s>"
CONTROL = (TURN, OPEN, CLOSE, BEGIN, END)
_TOKEN = re.compile(r"\\(.)|" + "|".join(f"({re.escape(c)})" for c in CONTROL), re.S)
_CONFLICT = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)

Turn = tuple[str, str]


def escape(text: str) -> str:
    return _CONFLICT.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(rendered: str) -> tuple[list[Turn], list[tuple[int, int]]] | None:
    """The turns and the spans of the assistant's texts in `rendered`; None if it is not of the grammar."""
    marks = [(m.lastindex, m.start(), m.end()) for m in _TOKEN.finditer(rendered) if m.lastindex != 1]
    turns: list[Turn] = []
    spans: list[tuple[int, int]] = []
    at = k = 0
    while at < len(rendered):
        step = marks[k : k + 4]
        kinds = [CONTROL[x[0] - 2] for x in step]
        if kinds[:4] == [TURN, OPEN, CLOSE, END] and step[3][1] == step[2][2]:
            used = 4
        elif kinds[:3] == [TURN, BEGIN, END]:
            used = 3
        else:
            return None
        if step[0][1] != at:
            return None
        turns.append((unescape(rendered[step[0][2] : step[1][1]]), unescape(rendered[step[1][2] : step[2][1]])))
        if used == 3:
            spans.append((step[1][2], step[2][1]))
        at, k = step[used - 1][2], k + used
    return turns, spans


def _render(turns: list[Turn], escaped: list[bool]) -> str:
    out = []
    for (role, text), esc in zip(turns, escaped, strict=True):
        r, t = (escape(role), escape(text)) if esc else (role, text)
        out.append(f"{TURN}{r}{BEGIN}{t}{END}" if role == "assistant" else f"{TURN}{r}{OPEN}{t}{CLOSE}{END}")
    return "".join(out)


def render(turns: list[Turn]) -> str:
    """The shortest rendering, in the order of escaping, that reads back as `turns`."""
    escaped = [parse(_render([t], [False])) != ([t], _span(t)) for t in turns]
    while True:
        out = _render(turns, escaped)
        read = parse(out)
        got = read[0] if read else None
        if got == turns:
            return out
        wrong = [k for k, e in enumerate(escaped) if not e and (got is None or k >= len(got) or got[k] != turns[k])]
        escaped[wrong[0]] = True


def _span(turn: Turn) -> list[tuple[int, int]]:
    head = len(TURN) + len(turn[0]) + len(BEGIN)
    return [(head, head + len(turn[1]))] if turn[0] == "assistant" else []


def format_chats(chats: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_spans (start and end code points of the loss mask in it)."""
    grouped = chats.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")))
        ).alias("turns")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts, spans, at, held = [], [], 0, 0
            for k in range(batch.num_rows):
                texts.append(render([(t["role"] or "", t["text"] or "") for t in batch["turns"][k].as_py()]))
                spans.append([{"start": a, "end": b} for a, b in parse(texts[-1])[1]])
                held += len(texts[-1])
                if k == batch.num_rows - 1 or held >= BLOCK:
                    ids = batch["conv_id"].slice(at, k + 1 - at)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.array(spans, span)], ["conv_id", "formatted", "loss_spans"])
                    texts, spans, at, held = [], [], k + 1, 0

    return grouped.mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """DIGEST of the turns that the parser recovers from `formatted`, and of the texts under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "formatted"):
            rows = []
            for conv, text, mask in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
                turns, _ = parse(text)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in mask)
                rows.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.mapInArrow(run, DIGEST)
