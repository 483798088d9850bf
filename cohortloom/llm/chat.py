"""Chat formatting: one example for each assistant turn, all earlier turns as context, only the reply trained.

A conversation that does not end with an assistant turn has one more example, without a trained reply, so
that every turn is in the output. Markers never occur inside a text: ``\\``, ``#`` and ``<`` are escaped.
The examples of a conversation repeat their context, so their total length grows with the square of its turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
ESCAPE, UNESCAPE = re.compile(r"[\\#<]"), re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*) </turn>\n", re.DOTALL)
TRAINED = "assistant"


def escape(text: str) -> str:
    return ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def _role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted example; an error if anything lies between its turns."""
    out, at = [], 0
    for m in TURN.finditer(text):
        if m.start() != at:
            raise ValueError("text outside a turn")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("text outside a turn")
    return out


def expand(turns: DataFrame) -> DataFrame:
    """Examples: conv_id, example (from 0), examples, text, mask_start, mask_end (code points of the trained reply).

    ``turns`` has conv_id, turn, role, text; rows are ordered by turn, then role, then text; null turns
    come first. A null role or text is empty. The span is empty in the closing example of a conversation
    that ends otherwise. Rows without a conversation id are one conversation; other columns are ignored.
    Each conversation is formatted by one task, which writes its examples one at a time.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("examples", pa.int64()), ("text", pa.string()), ("mask_start", pa.int64()), ("mask_end", pa.int64())])

    def write(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def format_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for conv, found in zip(batch.column(0), batch.column(1), strict=True):
                said = [(t["role"], t["text"]) for t in found.as_py()]
                replies = [i for i, (role, _) in enumerate(said) if role == TRAINED]
                ends = replies if replies and replies[-1] == len(said) - 1 else [*replies, len(said) - 1]
                context, at = "", 0
                for k, end in enumerate(ends):
                    context += "".join(OPEN + _role(r) + MIDDLE + escape(t) + CLOSE for r, t in said[at:end])
                    role, text = said[end]
                    head = context + OPEN + _role(role) + MIDDLE
                    body = escape(text)
                    trained = role == TRAINED
                    example = head + body + CLOSE
                    rows.append((conv.as_py(), k, len(ends), example, len(head), len(head) + len(body) if trained else len(head)))
                    context, at = example, end + 1
                    held += len(example)
                    if held > 8_000_000:
                        yield write(rows)
                        rows, held = [], 0
        if rows:
            yield write(rows)

    return whole.mapInArrow(format_, "conv_id long, example long, examples long, text string, mask_start long, mask_end long")


def read_back(examples: DataFrame) -> DataFrame:
    """What the formatted examples say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Each example gives its trained text; the last example of a conversation, which holds every turn,
    also the turns. Only those are exchanged.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss", pa.string()), ("chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k: [] for k in schema.names}
            for conv, k, n, text, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "example", "examples", "text", "mask_start", "mask_end")), strict=True):
                turns = read_turns(text) if k == n - 1 else None
                rows["conv_id"].append(conv)
                rows["example"].append(k)
                rows["n_turns"].append(None if turns is None else len(turns))
                rows["turns_sha256"].append(None if turns is None else hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                rows["loss"].append(unescape(text[a:b]))
                rows["chars"].append(len(text))
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    parts = examples.mapInArrow(read, "conv_id long, example long, n_turns long, turns_sha256 string, loss string, chars long")
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda s: s.loss), "")
    whole = parts.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
