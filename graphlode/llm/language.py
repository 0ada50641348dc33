"""Language identification by hierarchical discrimination.

Linear support vector machines over hashed character n-grams first choose a language family (one against the rest); within it,
one-versus-one machines separate the closely related languages by votes. All decision values are linear in the n-gram
shares of a text, so a text's value is the count-weighted mean over its words, each distinct word scored once.

Defined results: texts that are null or without a letter are `und` with score 0; very long texts are read whole;
repeated rows and ids give repeated rows; extra columns are dropped; ties go to the first language by name; an empty table gives an
empty result; without any labelled row every text is `und`.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlode.llm import common, subword

SIZES, BITS = range(1, 5), 16
#: At most so many rows of each language are learned from: the bounded training sample, by smallest hash of the id.
MAX_PER_LANG = 300
UND = "und"
#: Families of common languages; a language not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af",
    "romance": "fr es pt it ro ca gl",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "indic": "hi mr bn gu pa ne",
    "turkic": "tr az kk uz ky",
}
FAMILY_OF = {lang: fam for fam, langs in FAMILIES.items() for lang in langs.split()}


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    langs: list[list[str]] = field(default_factory=list)
    #: a column for each family, then one for each pair of languages of one family
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slope: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pairs: list[tuple[int, int, int]] = field(default_factory=list)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Text of each word, its index into the distinct normalised words, and these; words without letters are left out."""
    parents, flat = common.split_words(texts)
    ids, distinct = common.encode(flat)
    has = pc.match_substring_regex(distinct, r"\p{L}").to_numpy(zero_copy_only=False)
    ok = has[ids] if len(ids) else np.zeros(0, bool)
    return parents[ok], ids[ok], subword.normalise(distinct).to_pylist()


def svm(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, steps: int = 120, lam: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear SVM by full-batch Adagrad on the squared hinge loss; classes weigh the same. y is +1 or -1."""
    n, size = len(y), 1 << BITS
    w, b, gw, gb = np.zeros(size), 0.0, np.full(size, 1e-12), 1e-12
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (np.bincount(rows, w[cols] * vals, n) + b))
        g = -2 * slack * y * weight
        dw, db = np.bincount(cols, g[rows] * vals, size) + lam * w, g.sum()
        gw += dw * dw
        gb += db * db
        w -= 0.5 * dw / np.sqrt(gw)
        b -= 0.05 * db / np.sqrt(gb)
    return w, b


def train(texts: list[str | None], langs: list[str], seed: int = 5) -> Model:
    """Fit on whole texts and on short runs of their words, so that short texts are known too. Deterministic."""
    names = sorted(set(langs))
    if not names:
        return Model()
    parents, ids, words = words_of(common.texts_of(pa.array(texts, pa.string())))
    offsets = common.starts_of(parents, len(texts))
    rng = np.random.default_rng(seed)
    spans: list[tuple[int, int, int]] = []
    for i in range(len(texts)):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if b > a:
            spans.append((i, a, b))
            for n in (3, 8, 20):
                s = a + int(rng.integers(0, max(1, b - a - n)))
                spans.append((i, s, min(b, s + n)))
    bucket, offset = subword.word_buckets(words, SIZES, BITS)
    rows_, cols_, vals_ = [], [], []
    for r, (_, a, b) in enumerate(spans):
        wid, count = np.unique(ids[a:b], return_counts=True)
        n = np.diff(offset)[wid]
        at = np.repeat(offset[wid], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        col, back = np.unique(bucket[at], return_inverse=True)
        val = np.bincount(back, np.repeat(count, n))
        rows_.append(np.full(len(col), r))
        cols_.append(col)
        vals_.append(val / val.sum() * 10)
    rows, cols, vals = np.concatenate(rows_), np.concatenate(cols_), np.concatenate(vals_)
    lang = np.array([langs[i] for i, _, _ in spans], object)
    fam = np.array([FAMILY_OF.get(x, x) for x in lang], object)
    model = Model(families=sorted(set(fam)))
    model.langs = [[x for x in names if FAMILY_OF.get(x, x) == f] for f in model.families]
    fits = []

    def add(keep: np.ndarray, y: np.ndarray) -> None:
        inside = keep[rows]
        renumber = np.cumsum(keep) - 1
        r, c, v = renumber[rows[inside]], cols[inside], vals[inside]
        w, b = svm(r, c, v, y)
        margin = y * (np.bincount(r, w[c] * v, len(y)) + b)
        slope = 1.0  # of the logistic curve from margins to probabilities, by a few Newton steps
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(slope * margin, -30, 30)))
            slope = float(np.clip(slope + ((1 - p) * margin).mean() / max((p * (1 - p) * margin**2).mean(), 1e-6), 0.5, 8))
        fits.append((w * 10, b, slope))

    for f in model.families:
        add(np.ones(len(spans), bool), np.where(fam == f, 1.0, -1.0))
    for k, members in enumerate(model.langs):
        for a, b in combinations(range(len(members)), 2):
            keep = (lang == members[a]) | (lang == members[b])
            add(keep, np.where(lang[keep] == members[a], 1.0, -1.0))
            model.pairs.append((k, a, b))
    model.weights = np.stack([f[0] for f in fits], 1)
    model.bias, model.slope = np.array([f[1] for f in fits]), np.array([f[2] for f in fits])
    return model


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    n = len(texts)
    parents, ids, words = words_of(common.texts_of(texts))
    if not model.families:
        return [UND] * n, np.zeros(n)
    sums, counts = subword.word_sums(words, model.weights, SIZES, BITS)
    total = np.bincount(parents, counts[ids], n)
    value = np.stack([np.bincount(parents, sums[ids, k], n) for k in range(sums.shape[1])], 1) / np.maximum(total, 1)[:, None] + model.bias
    prob = 1 / (1 + np.exp(-np.clip(value * model.slope, -30, 30)))
    nf = len(model.families)
    fam = np.argmax(value[:, :nf], 1) if nf > 1 else np.zeros(n, np.int64)
    out, score = np.full(n, UND, object), np.zeros(n)
    for k, members in enumerate(model.langs):
        here = np.flatnonzero((fam == k) & (total > 0))
        votes, margins, sure = np.zeros((len(here), len(members))), np.zeros((len(here), len(members))), np.ones((len(here), len(members)))
        for j, (f, a, b) in enumerate(model.pairs, nf):
            if f == k:
                v, p = value[here, j], prob[here, j]
                votes[:, a] += v >= 0
                votes[:, b] += v < 0
                margins[:, a] += v
                margins[:, b] -= v
                sure[:, a] = np.minimum(sure[:, a], p)
                sure[:, b] = np.minimum(sure[:, b], 1 - p)
        best = np.argmax(votes + 1e-3 * np.tanh(margins), 1)
        out[here] = np.array(members, object)[best]
        score[here] = (prob[here, k] if nf > 1 else 1.0) * sure[np.arange(len(here)), best]
    return list(out), score


def training_sample(docs: DataFrame) -> DataFrame:
    """text, lang: at most MAX_PER_LANG rows of each language among those whose crc32(id) mod 4 isn't 2, by smallest hash of the id."""
    rows = docs.where(F.col("lang").isNotNull() & (common.fold(F.col("doc_id"), 4) != 2)).select("doc_id", "lang", "text")
    # a hash threshold from exact counts thins each language before the exact cut, so that no hot language is sorted whole
    counts = {r["lang"]: r["count"] for r in rows.where("text IS NOT NULL").groupBy("lang").count().collect()}
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    most = F.lit(1 << 30)
    for lang, n in counts.items():
        most = F.when(F.col("lang") == lang, F.lit(int(min(1.0, 3 * MAX_PER_LANG / n) * (1 << 30)) + 1)).otherwise(most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id", "text"))
    return rows.where((h < most) & F.col("text").isNotNull()).withColumn("rank_", rank).where(F.col("rank_") <= MAX_PER_LANG).drop("rank_")


def fit(docs: DataFrame) -> Model:
    rows = sorted(((r["lang"], r["doc_id"], r["text"]) for r in training_sample(docs).collect()), key=repr)
    return train([t for _, _, t in rows], [lang for lang, _, _ in rows])


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """lang_pred, score for the text of each row, after the columns named in keep (doc_id alone if None)."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").alias("read"))

    n, names = len(keep), [*rows.columns[: len(keep)], "lang_pred", "score"]

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        langs, score = predict(shared.value, b.column(n))
        return pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(langs, pa.string()), pa.array(score, pa.float64())], names)

    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields[: len(keep)]]
    out = common.map_batches(rows, batch, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return identify(docs, fit(docs)).select("doc_id", (common.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


#: Texts whose language is less sure than this are rejected by accepted(), as are those without a letter.
MIN_SCORE = 0.3


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is known, with all columns; a null lang becomes the predicted one."""
    cols = list(docs.columns)
    mine = docs.toDF(*[f"c{i}" if c != "text" else c for i, c in enumerate(cols)])
    out = identify(mine, model, mine.columns).where((F.col("lang_pred") != UND) & (F.col("score") >= MIN_SCORE))
    return out.select(*[F.coalesce(m, "lang_pred").alias(c) if c == "lang" else F.col(m).alias(c) for c, m in zip(cols, mine.columns)])
