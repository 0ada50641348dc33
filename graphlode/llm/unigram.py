"""Token counts by a count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates the vocabulary pieces in a word; dynamic programming over its characters carries only the best score
and the piece count of that best path. No piece, back-pointer or id is kept.

The tokenizer: pieces and their stored scores come from a public vocabulary file; spaces become the meta symbol, one is put in front, and a word
begins at each meta symbol (Metaspace, always prepended, split). Its tie rules are those of the library's unigram
model: a piece replaces the best path to its end only if strictly better, pieces being tried by start, then by length; a character that no
one-character piece covers is unknown at the least score less 10, and counts as its UTF-8 bytes if the vocabulary has byte pieces
(else each run of unknown characters counts once).

Defined results: null and empty texts have 0 tokens; texts of any length are counted whole; repeated rows and ids give repeated
rows; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlode.llm import common

META, UNKNOWN_PENALTY = "▁", 10.0
#: Words whose counts a worker keeps; the whole is dropped when it is full.
CACHE = 1_000_000


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.byte_pieces = byte_pieces
        self.counts: dict[str, int] = {}
        # words may be cut at characters that no piece holds and that count alike wherever they stand
        self.breaks = byte_pieces and not any("\n" in p for p, _ in pieces)

    def word(self, w: str) -> int:
        """Pieces on the best path through one word."""
        n = len(w)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]  # by start, as (end, score)
        for last, (size, score) in self.automaton.iter(w):
            ends[last + 1 - size].append((last + 1, score))
        best: list[float | None] = [None] * (n + 1)
        count, unknown_to = [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here, c, single = best[i], count[i], False
            for end, score in ends[i]:  # matches come by end, so by length
                if end == i + 1:
                    single = True
                b = best[end]
                if b is None or here + score > b:
                    best[end], count[end], unknown_to[end] = here + score, c + 1, False
            if not single:
                b = best[i + 1]
                if b is None or here + self.unknown > b:
                    best[i + 1], unknown_to[i + 1] = here + self.unknown, True
                    count[i + 1] = c + (len(w[i].encode("utf-8", "surrogatepass")) if self.byte_pieces else not unknown_to[i])
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, counts = 0, self.counts
        # a word is what follows each space; the text's start has a meta symbol put in front
        words = text.replace(META, " ").split(" ") if META in text else text.split(" ")
        if words[0] == "" and len(words) > 1:
            words = words[1:]  # the text begins with a space: it is the symbol in front
        if self.breaks and "\n" in text:
            parts: list[str] = []
            for w in words:
                if "\n" in w:
                    first, *rest = w.split("\n")
                    total += len(rest)
                    parts.append(META + first)
                    parts += filter(None, rest)
                else:
                    parts.append(META + w)
        else:
            parts = [META + w for w in words]
        if len(counts) > CACHE:
            counts.clear()
        for p in set(parts).difference(counts):
            counts[p] = self.word(p)
        return total + sum(map(counts.__getitem__, parts))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces with scores, in order of id, of a sentencepiece file; whether it has byte pieces. Control and unknown pieces are left out.

    As in the library, a byte piece also matches its own name in a text."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.vocab_size())
    text = [i for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    return [(m.id_to_piece(i), m.get_score(i)) for i in text], any(map(m.is_byte, ids))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(*load_pieces(path))


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens of each row."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([c.count(t.as_py()) for t in b.column(1)], pa.int64())], ["doc_id", "n_tokens"])

    return common.map_batches(df.select(F.col(id_col).cast("bigint"), F.col(text_col)), batch, "doc_id bigint, n_tokens bigint")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.documents(spark, sf_dir), default_path())
