"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is cut into windows of WINDOW words. A window's vector is the mean of its words' vectors, a word's the mean of the
vectors of its character n-grams, so that an unseen misspelling shares most of its vector with the word. Embeddings and the softmax
over {clean, toxic} are learned together by Adagrad, labels weighing the same; a text's score is the softmax's probability for its worst window, and in
training the worst window of each text carries the text's label.

Defined results: null, empty and letterless texts score as an empty window (the bias alone); very long texts are just more
windows; repeated rows and ids give repeated rows; extra columns are dropped; an empty table gives an empty result; without labels of both kinds the model is the constant 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlode.llm import common, subword

SIZES, BITS, DIM, WINDOW = range(3, 6), 17, 4, 12
#: At most so many labelled rows of each label are learned from: the bounded training sample, by smallest hash of the id.
MAX_PER_LABEL = 1500


@dataclass
class Model:
    #: logit of toxic against clean that each n-gram bucket adds, before averaging
    gram_logit: np.ndarray
    bias: float


def windows(parents: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For words with their texts (sorted): the start of each window, and its text. Texts without words have none."""
    offsets = common.starts_of(parents, n)
    per = -(-np.diff(offsets) // WINDOW)
    doc = np.repeat(np.arange(n), per)
    first = np.repeat(np.cumsum(per) - per, per)
    return offsets[doc] + (np.arange(len(doc)) - first) * WINDOW, doc


def word_logits(model: Model, words: list[str]) -> np.ndarray:
    sums, counts = subword.word_sums(words, model.gram_logit[:, None], SIZES, BITS)
    return sums[:, 0] / np.maximum(counts, 1)


def worst(values: np.ndarray, start: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean value of each text's highest window, and that window's index; -1 where a text has none."""
    mean = common.segment_sums(values, np.append(start, len(values))) / np.diff(np.append(start, len(values)))
    order = np.lexsort((np.arange(len(doc)), -mean, doc))
    d, at = np.unique(doc[order], return_index=True)
    best, which = np.zeros(n), np.full(n, -1)
    best[d], which[d] = mean[order[at]], order[at]
    return best, which


def train(texts: list[str | None], labels: list[int], rounds: int = 60, seed: int = 11) -> Model:
    """Fit on whole texts. Deterministic."""
    y = np.asarray(labels, np.float64)
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS), 0.0)
    parents, flat = common.split_words(common.texts_of(pa.array(texts, pa.string())))
    ids, distinct = common.encode(flat)
    words = subword.normalise(distinct).to_pylist()
    bucket, offset = subword.word_buckets(words, SIZES, BITS)
    width = np.maximum(np.diff(offset), 1)
    start, doc = windows(parents, len(texts))
    stop = np.append(start[1:], len(ids))
    rng = np.random.default_rng(seed)
    emb, soft, bias = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32), np.zeros((DIM, 2), np.float32), np.zeros(2)
    soft[:] = rng.normal(0, 0.1, soft.shape)
    g_emb, g_soft, g_bias = np.full(1 << BITS, 1e-8, np.float32), np.full(soft.shape, 1e-8), np.full(2, 1e-8)
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    some = np.flatnonzero(np.isin(np.arange(len(texts)), doc))
    first = np.searchsorted(doc, some)
    per = np.searchsorted(doc, some, "right") - first
    for step in range(rounds):
        if step < 12:  # before a worst window can be told, any window stands for its text
            chosen = np.concatenate([first + rng.integers(0, per) for _ in range(4)])
        elif step % 4 == 0:
            logit = emb @ (soft[:, 1] - soft[:, 0])
            per_word = common.segment_sums(logit[bucket], offset) / width
            chosen = worst(per_word[ids], start, doc, len(texts))[1][some]
            chosen = np.concatenate([chosen, first + rng.integers(0, per)][: 1 + (step < 24)])
        at = doc[chosen]
        sizes = stop[chosen] - start[chosen]
        w_row = np.repeat(np.arange(len(chosen)), sizes)
        w_ids = ids[np.repeat(start[chosen], sizes) + np.arange(len(w_row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        used, back = np.unique(w_ids, return_inverse=True)
        n_grams = np.diff(offset)[used]
        g_row = np.repeat(np.arange(len(used)), n_grams)
        g = bucket[np.repeat(offset[used], n_grams) + np.arange(len(g_row)) - np.repeat(np.cumsum(n_grams) - n_grams, n_grams)]
        wv = np.stack([np.bincount(g_row, emb[g, k], len(used)) for k in range(DIM)], 1) / width[used][:, None]
        xv = np.stack([np.bincount(w_row, wv[back, k], len(chosen)) for k in range(DIM)], 1) / sizes[:, None]
        z = xv @ soft + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        err = (p - np.stack([1 - y[at], y[at]], 1)) * balance[at][:, None] / len(chosen)
        d_soft, d_bias, d_x = xv.T @ err, err.sum(0), err @ soft.T / sizes[:, None]
        d_w = np.stack([np.bincount(back, d_x[w_row, k], len(used)) for k in range(DIM)], 1) / width[used][:, None]
        d_emb = np.stack([np.bincount(g, d_w[g_row, k], 1 << BITS) for k in range(DIM)], 1).astype(np.float32)
        g_emb += (d_emb**2).mean(1)
        emb -= 0.3 * d_emb / np.sqrt(g_emb)[:, None]
        g_soft += d_soft**2
        soft -= (0.3 * d_soft / np.sqrt(g_soft)).astype(np.float32)
        g_bias += d_bias**2
        bias -= 0.1 * d_bias / np.sqrt(g_bias)
    return Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of toxic for each whole text."""
    texts = common.texts_of(texts)
    parents, flat = common.split_words(texts)
    ids, distinct = common.encode(flat)
    per_word = word_logits(model, subword.normalise(distinct).to_pylist())
    start, doc = windows(parents, len(texts))
    raw = worst(per_word[ids], start, doc, len(texts))[0] if len(start) else np.zeros(len(texts))
    return 1 / (1 + np.exp(-np.clip(raw + model.bias, -30, 30)))


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic: at most MAX_PER_LABEL labelled rows of each label whose crc32(id) mod 5 isn't 0, by smallest hash of the id."""
    lab = labels.where(F.col("toxic").isin(0, 1) & (common.fold(F.col("doc_id"), 5) != 0)).select("doc_id", "toxic")
    parts = [
        lab.where(F.col("toxic") == k).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_PER_LABEL)
        for k in (0, 1)
    ]
    # 2 x MAX_PER_LABEL ids at most, and one row of each: of rows with the same id the one with the least hash of the text
    rows = docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_sample(docs, labels).orderBy("doc_id", "text").collect()
    return train([r["text"] for r in rows], [int(r["toxic"]) for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.gram_logit.astype(np.float32), model.bias))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        table, bias = shared.value
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(Model(table, bias), b.column(1)))], ["doc_id", "score"])

    return common.map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), batch, "doc_id bigint, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", (common.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
