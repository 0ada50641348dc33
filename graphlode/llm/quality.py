"""Quality rules by line sequence labelling.

Viterbi decoding of a linear-chain conditional random field marks each line of a text content or boilerplate; the share of a
text's words in content lines decides retention, after two base rules. The field is trained here by maximum
likelihood (forward-backward in numpy) on texts labelled by quality, each line taking its text's label; its
weights are the same for all texts.

Defined results: null and empty texts have no word, fail the base rules and aren't kept; very long texts are decoded whole; repeated
rows and ids give repeated rows; extra columns are dropped; ties in decoding go to content; an empty table gives an
empty result; without labels of both kinds every line is content.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlode.llm import common

#: At most so many labelled rows of each label are learned from: the bounded training sample, by smallest hash of the id.
MAX_PER_LABEL = 800
MIN_WORDS, MAX_REPEATED, MIN_CONTENT = 50, 50, 0.5
FEATURES = 11
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, content_words bigint, n_lines bigint, n_content_lines bigint"


def _kinds() -> np.ndarray:
    """For each byte: 1 upper case, 2 digit, 4 symbol, 8 bar, 16 exclamation, 32 ends a sentence, 64 white space."""
    k = np.zeros(256, np.uint8)
    for chars, bit in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b"#*$%&|<>", 4), (b"|", 8), (b"!", 16), (b".?,;:", 32), (b" \t\n\x0b\x0c\r", 64)):
        k[list(chars)] |= bit
    return k


KINDS = _kinds()


@dataclass
class Crf:
    #: (features, 2): weight of each feature for content and boilerplate
    node: np.ndarray
    #: (2, 2): weight of each state after each state
    step: np.ndarray


def repeated_words(parents: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """For each text, its words in 3-word windows that it holds twice or more, the first window's included."""
    covered = np.zeros(len(ids) + 2, bool)
    if len(ids) > 2:
        a, b, c = ids[:-2].astype(np.uint64), ids[1:-1].astype(np.uint64), ids[2:].astype(np.uint64)
        inside = np.flatnonzero(parents[:-2] == parents[2:])
        width = np.uint64(int(ids.max()) + 1)
        pair = np.unique(a[inside] * width + b[inside], return_inverse=True)[1].astype(np.uint64)
        triple = np.unique(pair * width + c[inside], return_inverse=True)[1].astype(np.int64)
        key = parents[inside].astype(np.int64) * (triple.max() + 1 if len(triple) else 1) + triple
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        at = inside[twice]
        for k in range(3):
            covered[at + k] = True
    return np.bincount(parents[covered[: len(ids)]], minlength=n)


def analyse(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base figures of each text; for each line with a word its text, features, and words."""
    texts = common.texts_of(texts)
    n = len(texts)
    parents, flat = common.split_words(texts)
    ids, _ = common.encode(flat)
    base = {"n_words": np.bincount(parents, minlength=n), "n_repeat_words": repeated_words(parents, ids, n)}
    lists = pc.split_pattern(texts, "\n")
    lines, line_doc = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    word_line, line_words_flat = common.split_words(lines)
    per_line = np.bincount(word_line, minlength=len(lines))
    full = np.flatnonzero(per_line > 0)
    line_ids = common.encode(lines.take(pa.array(full)))[0].astype(np.int64)
    doc = line_doc[full]
    first = np.zeros(len(full), bool)
    first[np.unique(doc * (len(full) + 1) + line_ids, return_index=True)[1]] = True
    base["n_dup_lines"] = np.bincount(doc[~first], minlength=n)
    buf = pc.binary_join_element_wise(lines, pa.scalar(""), "\n")
    size = pc.binary_length(buf).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(size)])
    raw = np.frombuffer(buf.buffers()[2], np.uint8)[int(np.frombuffer(buf.buffers()[1], np.int32)[buf.offset]) :][: edges[-1]] if len(lines) else np.zeros(0, np.uint8)
    kind = KINDS[raw]
    chars = np.add.reduceat((((raw & 0xC0) != 0x80) & (kind & 64 == 0)).astype(np.uint8), edges[:-1], dtype=np.int64) if len(lines) else np.zeros(0, np.int64)

    def count(bit: int) -> np.ndarray:
        return np.bincount(np.searchsorted(edges, np.flatnonzero(kind & bit), "right") - 1, minlength=len(lines))

    symbols = count(4)
    base["word_chars"] = np.bincount(line_doc, chars, n).astype(np.int64)
    base["n_symbols"] = np.bincount(line_doc, symbols, n).astype(np.int64)
    # features by line: how far each kind of character goes, repeated lines and words, length, how it ends
    w = per_line[full].astype(float)
    c = np.maximum(chars[full], 1).astype(float)
    wid = common.encode(line_words_flat)[0].astype(np.int64)
    uniq = np.unique(word_line.astype(np.int64) * (int(wid.max()) + 1 if len(wid) else 1) + wid) // (int(wid.max()) + 1 if len(wid) else 1)
    distinct = np.bincount(uniq, minlength=len(lines))[full]
    last = raw[np.maximum(edges[1:][full] - 2, 0)] if len(full) else raw[:0]
    x = np.stack([
        np.ones(len(full)), np.minimum(1, 8 * symbols[full] / c), np.minimum(1, 2 * count(1)[full] / c), np.minimum(1, 4 * count(2)[full] / c),
        np.minimum(1, 2 * count(8)[full] / w), np.minimum(1, 2 * count(16)[full] / w), 1 - distinct / w, (~first).astype(float), np.log1p(w) / 4,
        np.minimum(1, c / w / 12), (KINDS[last] & 32 > 0).astype(float),
    ], 1) if len(full) else np.zeros((0, FEATURES))
    return base, doc, x, per_line[full]


def by_position(doc: np.ndarray) -> list[np.ndarray]:
    """Indices of the first lines of all texts, of the second ones, and so on; within each by text. Few texts are long."""
    at = np.arange(len(doc)) - np.searchsorted(doc, doc)
    order = np.argsort(at, kind="stable")
    return np.split(order, np.cumsum(np.bincount(at))[:-1]) if len(doc) else []


def viterbi(crf: Crf, doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    """State of each line (0 content, 1 boilerplate) on its text's best path."""
    score = x @ crf.node
    back = np.zeros((len(doc), 2), np.int8)
    steps = by_position(doc)
    for here in steps[1:]:  # the line before is the one at the index below
        via = score[here - 1][:, :, None] + crf.step[None]
        back[here] = via.argmax(1)
        score[here] += via.max(1)
    state = np.zeros(len(doc), np.int8)
    ends = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    state[ends] = score[ends].argmax(1)
    for here in reversed(steps[1:]):
        state[here - 1] = back[here, state[here]]
    return state


def train(texts: list[str | None], good: list[int], rounds: int = 150) -> Crf:
    """Maximum likelihood of the labels of lines (those of their texts), with forward-backward, by Adagrad."""
    crf = Crf(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    _, doc, x, _ = analyse(pa.array(texts, pa.string()))
    if len(set(good)) < 2 or not len(doc):
        return crf
    y = 1 - np.asarray(good)[doc]
    steps = by_position(doc)
    pairs = np.flatnonzero(doc[1:] == doc[:-1])
    # each text and each label weighs the same
    weight = 1 / np.bincount(doc)[doc] * np.where(y == 0, 0.5 / (np.asarray(good) == 1).sum(), 0.5 / (np.asarray(good) == 0).sum())
    g_node, g_step = np.full(crf.node.shape, 1e-10), np.full((2, 2), 1e-10)
    want = np.eye(2)[y]
    for _ in range(rounds):
        node = x @ crf.node
        fwd, bwd = node.copy(), np.zeros_like(node)
        for here in steps[1:]:
            fwd[here] += np.logaddexp.reduce(fwd[here - 1][:, :, None] + crf.step[None], axis=1)
        for here in reversed(steps[1:]):
            bwd[here - 1] = np.logaddexp.reduce(crf.step[None] + (node[here] + bwd[here])[:, None, :], axis=2)
        z = np.logaddexp.reduce(fwd + bwd, axis=1)
        p = np.exp(fwd + bwd - z[:, None])
        pair = np.exp(fwd[pairs][:, :, None] + crf.step[None] + (node[pairs + 1] + bwd[pairs + 1])[:, None, :] - z[pairs][:, None, None])
        d_node = x.T @ ((p - want) * weight[:, None]) + 1e-4 * crf.node
        seen = want[pairs][:, :, None] * want[pairs + 1][:, None, :]
        d_step = ((pair - seen) * weight[pairs][:, None, None]).sum(0) + 1e-4 * crf.step
        g_node += d_node**2
        g_step += d_step**2
        crf.node -= 0.5 * d_node / np.sqrt(g_node)
        crf.step -= 0.2 * d_step / np.sqrt(g_step)
    return crf


def measure(texts: pa.Array, crf: Crf) -> dict[str, np.ndarray]:
    base, doc, x, words = analyse(texts)
    state = viterbi(crf, doc, x)
    n = len(texts)
    return base | {
        "content_words": np.bincount(doc, words * (state == 0), n).astype(np.int64),
        "n_lines": np.bincount(doc, minlength=n),
        "n_content_lines": np.bincount(doc[state == 0], minlength=n),
    }


def fit(docs: DataFrame, labels: DataFrame) -> Crf:
    parts = [labels.where(F.col("quality") == k).select("doc_id", "quality").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_PER_LABEL) for k in (0, 1)]
    # 2 x MAX_PER_LABEL ids at most, and one row of each: of rows with the same id the one with the least hash of the text
    found = docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    rows = found.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).orderBy("doc_id", "quality").collect()
    return train([r["text"] for r in rows], [int(r["quality"]) for r in rows])


def judge(docs: DataFrame, crf: Crf) -> DataFrame:
    """Base figures, words in content lines and the verdict for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        got = measure(b.column(1), shared.value)
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[k].astype(np.int64)) for k in names[1:])], names)

    out = common.map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), batch, SCHEMA)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    share = F.col("content_words") / F.greatest(F.col("n_words"), F.lit(1))
    return out.withColumn("base_failed", failed).withColumn("content_share", share).withColumn("kept", ~failed & (share >= MIN_CONTENT))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return judge(docs, fit(docs, common.table(spark, sf_dir, "labels")))
