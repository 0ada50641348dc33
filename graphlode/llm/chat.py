"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: each turn is its role and text between control strings, which are escaped (reversibly)
where they occur inside roles and texts. A text stands between two added tokens of the tokenizer, which it always takes as tokens of
their own: no token reaches over the border of a text. The rendering is encoded once with offsets (in bytes); binary search intersects the
sorted spans of the assistant's texts with the sorted spans of tokens, which gives the loss mask. The learned text is read back by decoding the tokens under the mask.

Defined results: null roles and texts are empty; rows of a conversation are ordered by turn (null first), then role, then text, so
repeated rows and turns are kept, in a fixed order; a null conv_id is a conversation of its own; empty texts have an empty span and
no token; very long conversations are rendered and encoded whole; extra columns are dropped; an empty table has conversation -7 alone in the query and
gives an empty result in formatted(). Rows of a conversation stream through a sorted partition; a partition holds one conversation at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlode.llm import bpe, common

BORDER = "<|endoftext|>"
OPEN, COLON, CLOSE = "### ", f": {BORDER}", f"{BORDER}</turn>\n"
LEARNED = "assistant"
#: Conversations are encoded at once up to so many characters.
CHARS = 1 << 20


def escape(s: str, in_role: bool = False) -> str:
    """A text in which no control string occurs; each added backslash stands before the character it was put in front of."""
    if "\\" in s or "<" in s or "### " in s:
        s = s.replace("\\", "\\\\").replace("### ", "##\\# ").replace("</turn>", "<\\/turn>").replace(BORDER, "<\\|" + BORDER[2:])
    return s.replace(": ", "\\: ") if in_role else s


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S) if "\\" in s else s


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """The formatted conversation, and for each turn the span of its escaped text (in characters) and whether the loss covers it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, True)}{COLON}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role == LEARNED))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def byte_spans(text: str, spans: list[tuple[int, int, bool]]) -> list[tuple[int, int, bool]]:
    """Sorted spans of characters as spans of bytes."""
    if text.isascii():
        return spans
    out, at, seen = [], 0, 0
    for s, e, learned in spans:
        begin = seen + len(text[at:s].encode())
        at, seen = e, begin + len(text[s:e].encode())
        out.append((begin, seen, learned))
    return out


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError("no turn begins here")
        colon = formatted.index(COLON, at + len(OPEN))  # no escaped role or text has the border in it
        close = formatted.index(CLOSE, colon + len(COLON))
        out.append((unescape(formatted[at + len(OPEN) : colon]), unescape(formatted[colon + len(COLON) : close])))
        at = close + len(CLOSE)
    return out


def mask(offsets: np.ndarray, spans: list[tuple[int, int, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the loss covers each token (n x 2 offsets); and for covered tokens the stretch of text that is new under the mask.

    Tokens may share characters (bytes of one character) or reach over a span's border: stretches are clipped to the span and never overlap."""
    begin, end = offsets[:, 0], offsets[:, 1]
    on, a_all, b_all = np.zeros(len(offsets), bool), [], []
    for s, e, learned in spans:
        if learned and e > s:
            i, j = np.searchsorted(end, s, "right"), np.searchsorted(begin, e, "left")
            a, b = np.maximum(begin[i:j], s), np.minimum(end[i:j], e)
            seen = np.maximum.accumulate(np.concatenate([[s], b]))[:-1]
            on[i:j] |= b > a
            a_all.append(np.maximum(a, seen))
            b_all.append(b)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_all, b_all))
    return on, a[b > a], b[b > a]


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


SCHEMA = "conv_id bigint, formatted string, ids array<int>, loss_mask array<boolean>"


def formatted(rows: DataFrame, path: str) -> DataFrame:
    """conv_id, the formatted conversation, its token ids, and the loss mask."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def emit(convs: list[tuple[int | None, str, list]]) -> pa.RecordBatch:
        enc, texts = bpe.encoder(path), pa.array([c[1] for c in convs], pa.string())
        ids, ends, _ = enc.encode_all(texts)
        size = enc.n_bytes[ids]
        end = np.cumsum(size)
        on = np.zeros(len(ids), bool)
        for (_, text, spans), i, j in zip(convs, ends, ends[1:]):
            origin = end[i - 1] if i else 0
            offsets = np.stack([end[i:j] - size[i:j], end[i:j]], 1) - origin
            on[i:j] = mask(offsets, byte_spans(text, spans))[0]
        at = pa.array(ends, pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([c[0] for c in convs], pa.int64()), texts, pa.ListArray.from_arrays(at, pa.array(ids)), pa.ListArray.from_arrays(at, pa.array(on))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, waiting, size = (), [], [], 0
        for b in (part for whole in batches for part in common.slices(whole)):
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if key != (conv,):
                    if key:
                        waiting.append((key[0], *render(turns)))
                        size += len(waiting[-1][1])
                        if size > CHARS:
                            yield emit(waiting)
                            waiting, size = [], 0
                    key, turns = (conv,), []
                turns.append((role, text))
        if key:
            yield emit([*waiting, (key[0], *render(turns))])
        bpe.encoder(path).forget()
        common.give_back()

    ready = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").cast("bigint").alias("turn"))
    return ready.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def digests(convs: DataFrame, path: str | None = None) -> DataFrame:
    """What can be read back from formatted conversations: turns by parsing, the learned text by decoding the tokens under the mask."""
    path = path or default_path()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, on = b.column(2), b.column(3).flatten().to_numpy(zero_copy_only=False).astype(bool)
        ends = ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py()
        covered = np.concatenate([[0], np.cumsum(on)])[ends]
        decoded = bpe.encoder(path).decode_all(ids.flatten().to_numpy()[on], covered)
        out = []
        for text, raw in zip(b.column(1).to_pylist(), decoded):
            turns = parse(text)
            whole = "".join(f"{role}\n{t}\n" for role, t in turns)
            # a backslash pair may lie in two tokens, so they are joined before they are unescaped
            learned = unescape(raw.as_py().decode("utf-8", "replace"))
            out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        cols = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(np.diff(ends)), pa.array(np.diff(covered))], names)

    return common.map_batches(convs.select(*[c.split()[0] for c in SCHEMA.split(", ")]), batch, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, loss_tokens bigint")


#: A conversation whose texts hold the template's control strings.
HARD = "\\### Assistant: </turn> ok"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id bigint, turn bigint, role string, text string")
    return digests(formatted(rows.unionByName(hard), default_path()))
