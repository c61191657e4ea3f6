"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole and encoded once; token offsets and the sorted
spans of the trained turns meet by binary search. Turn markers are special tokens of
the encoder, so that no token spans a turn's edge; texts cannot forge them, as control
strings inside texts get an escape that can be undone.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_PARSE = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.S)
OUT = "conv_id long, formatted string, token_ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    """One more backslash inside every ``<``, backslashes, ``|``: no marker can occur in the result."""
    return _CONTROL.sub(lambda m: f"<\\{m[1]}|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}|", text)


def render(turns: list[tuple[str, str]], trained: str) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the trained texts, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        head = TURN + escape(role) + BODY
        at += len(head)
        if role == trained:
            spans.append((at, at + len(body)))
        parts += [head, body, END]
        at += len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(a), unescape(b)) for a, b in _PARSE.findall(formatted)]


def align(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Tokens (start, end) that lie in one of the sorted spans; ends by binary search."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    return (at >= 0) & (offsets[:, 1] <= spans[at, 1]) & (offsets[:, 0] < spans[at, 1])


def encoder(path: str):
    from tokenizers import Tokenizer, processors

    out = Tokenizer.from_file(path)
    out.post_processor = processors.ByteLevel(trim_offsets=False)
    out.add_special_tokens([TURN, BODY, END])
    return out


def masked(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Character runs under the mask: the union of the masked tokens' spans, one run per text."""
    out: list[list[int]] = []
    for s, e in offsets[mask].tolist():
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _format(path: str, trained: str):
    def run(batches):
        model = encoder(path)
        for batch in batches:
            for i in range(0, len(batch), 64):
                ids = batch["conv_id"][i : i + 64].to_pylist()
                made = [render([(t["role"] or "", t["text"] or "") for t in turns], trained) for turns in batch["turns"][i : i + 64].to_pylist()]
                out = [[], [], [], [], []]
                for conv, (formatted, spans), code in zip(ids, made, model.encode_batch([m[0] for m in made], add_special_tokens=False)):
                    offsets = np.array(code.offsets, np.int64).reshape(-1, 2)
                    mask = align(offsets, np.array(spans, np.int64).reshape(-1, 2))
                    found = [{"start": s, "end": e} for s, e in masked(formatted, offsets, mask)]
                    for column, v in zip(out, (conv, formatted, code.ids, mask.tolist(), found)):
                        column.append(v)
                types = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                names = ["conv_id", "formatted", "token_ids", "loss_mask", "loss_spans"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

    return run


def format_chats(turns: DataFrame, vocabulary: str = VOCABULARY, trained: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, token_ids, loss_mask, loss_spans)`` per conversation.

    Rows ``(conv_id, turn, role, text)`` stand by turn, nulls first, then by role and text;
    rows that repeat a turn stay. Null roles and texts are empty; an empty trained text has
    no token under the mask; a null conv_id is one conversation; an empty table gives an empty result; other columns
    are not read. A conversation is one row, as its rendering is.
    """
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return whole.mapInArrow(_format(vocabulary, trained), OUT)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what the formatted rows hold: turns parsed, escapes undone, text under the mask."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], [], []]
            for conv, text, spans in zip(*(batch[k].to_pylist() for k in ("conv_id", "formatted", "loss_spans"))):
                turns = parse(text)
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(unescape(text[x["start"] : x["end"]]) for x in spans)
                row = (conv, len(turns), _sha(told), len(loss), _sha(loss), len(text))
                for column, v in zip(out, row):
                    column.append(v)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], [x.split()[0] for x in DIGEST.split(", ")])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, DIGEST)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
