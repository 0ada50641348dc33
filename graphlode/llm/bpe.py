"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

Within a pre-token, every prefix has one BPE encoding, so it has one last token. An Aho-Corasick automaton over the vocabulary (in
place of a suffix automaton: the matches are the same) names the tokens that end at each byte; the one that is compatible with the last token of the prefix
before it is stored, and following these tokens back from the end gives exactly the ids that merging by rank would.
Two tokens are compatible if no merge that BPE would do earlier crosses their border.

A batch is cut at its spaces into chunks (a space before anything but white space always begins a pre-token), each distinct chunk
is encoded once, and ids, decimal digits and bytes of the texts are gathered from those of the chunks in Arrow.

Defined results: null and empty texts have no tokens; texts of any length are encoded whole, in linear time; the string of an added
token is that token; repeated rows and ids give repeated rows; extra columns are dropped; an empty table gives an empty result.
Lone surrogates can't occur in Parquet strings.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlode.llm import common

#: Pre-tokens of the byte-level pre-tokenizer. \s here is Unicode's White_Space, as in the library.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
WHITE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Where texts are cut into chunks, unless they hold added tokens.
CUT = regex.compile(r" (?=\P{White_Space})")
#: Pre-tokens whose ids a worker keeps (beyond that, those of the batch before; longer ones than LONG aren't kept), and pairs of tokens whose compatibility it keeps.
CACHE, LONG, PAIRS = 600_000, 48, 700_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: dict[int, bytes] = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()}
        self.bytes |= {i: s.encode() for s, i in self.added.items()}
        n = max(self.bytes) + 1
        #: each token's two parts (a byte: itself), when its merge comes, and the token of each pair
        self.left, self.right, self.rank = [*range(n)], [*range(n)], [-1] * n
        self.merged: dict[tuple[int, int], int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            t = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = t
            if self.rank[t] < 0:
                self.left[t], self.right[t], self.rank[t] = vocab[a], vocab[b], rank
        self.known: dict[int, bool] = {}
        self.size = [len(self.bytes.get(i, b"")) for i in range(n)]
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[str, tuple[int]] = {}
        special = set(self.added.values())
        for i, b in self.bytes.items():
            if i not in special and (self.rank[i] < 0 or self._apart(self.left[i], self.right[i], self.rank[i])):
                self.automaton.add_word(b.decode("latin-1"), i)
                self.whole[b.decode("latin-1")] = (i,)
        self.automaton.make_automaton()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(PATTERN)
        self.gap = regex.compile(r" \p{White_Space}")
        #: texts that can't be cut at every space
        self.odd = f" [{WHITE}]" + "".join("|" + re.escape(x) for x in self.added)
        #: kept pre-tokens: place of each in the arrays of ids and of ends
        self.kept: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("q")
        self.recent: set[str] = set()
        self.cache, self.pairs = CACHE, PAIRS
        tokens = [self.bytes.get(i, b"") for i in range(n)]
        self.as_bytes = pa.array(tokens, pa.large_binary())
        self.n_bytes = np.fromiter(map(len, tokens), np.int64, n)
        self.as_decimal = pa.array([b"%d," % i for i in range(n)], pa.large_binary())
        self.n_decimal = np.fromiter((len(str(i)) + 1 for i in range(n)), np.int64, n)

    def _apart(self, a: int, b: int, before: float) -> bool:
        """Whether no merge ranked lower than `before`, nor one done before a or b is whole, crosses the border of a and b."""
        rank, merged = self.rank, self.merged
        while True:
            t = merged.get((a, b))
            if t is not None and rank[t] < before:
                return False
            # undo the later of the two merges that made a and b; of equal ones the right token's, as BPE merges from the left
            if rank[a] > rank[b]:
                before, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                before, b = rank[b] + 1, self.left[b]
            else:
                return True

    def _word(self, s: str) -> tuple[int, ...]:
        """Ids of one pre-token, given as one character a byte."""
        if s in self.whole:
            return self.whole[s]
        last, size, known = [-1] * (len(s) + 1), self.size, self.known
        for end, t in self.automaton.iter(s):
            end += 1
            if last[end] < 0:
                start = end - size[t]
                if not start:
                    last[end] = t
                elif (p := last[start]) >= 0:
                    ok = known.get(p << 20 | t)
                    if ok is None:
                        if len(known) > self.pairs:
                            known.clear()
                        ok = known[p << 20 | t] = self._apart(p, t, float("inf"))
                    if ok:
                        last[end] = t
        out, at = [], len(s)
        while at:
            out.append(last[at])
            at -= size[last[at]]
        return tuple(reversed(out))

    def _parts(self, text: str) -> list[str]:
        """A text in pieces that are pre-tokenized on their own: added tokens, and the rest cut at spaces."""
        parts: Iterable[str] = self.split.split(text) if self.split and any(x in text for x in self.added) else [text]
        out: list[str] = []
        for p in parts:
            if p in self.added:
                out.append(p)
            elif p:
                first, *more = CUT.split(p) if self.gap.search(p) else p.split(" ")
                out += [first, *(" " + x for x in more)] if first else (" " + x for x in more)
        return out

    def _places(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pre-tokens of all parts in the kept ids, and how many each part has."""
        find, added = self.words.findall, self.added
        # a part has at most one leading space before a letter: with ASCII letters alone it is one pre-token
        cut = [[p] if p.isascii() and p.lstrip(" ").isalpha() or p in added else find(p) for p in parts]
        every = list(chain.from_iterable(cut))
        now = set(every)
        if len(self.kept) > self.cache:
            self._keep({w for w in now | self.recent if w in self.kept and len(w) <= LONG})
        for w in now.difference(self.kept):
            # an added token's string can't be a pre-token: the split takes them all
            self.flat.extend((added[w],) if w in added else self._word(w.encode("utf-8", "surrogatepass").decode("latin-1")))
            self.kept[w] = len(self.ends)
            self.ends.append(len(self.flat))
        self.recent = now
        return np.fromiter(map(self.kept.__getitem__, every), np.int64, len(every)), np.fromiter(map(len, cut), np.int64, len(cut))

    def _keep(self, words: set[str]) -> None:
        flat, ends, kept = array("i"), array("q"), {}
        for w in words:
            k = self.kept[w]
            flat.extend(self.flat[self.ends[k - 1] if k else 0 : self.ends[k]])
            kept[w] = len(ends)
            ends.append(len(flat))
        self.flat, self.ends, self.kept = flat, ends, kept

    def forget(self) -> None:
        """Drops what was kept: at the end of a task, so that idle workers are small."""
        self.flat, self.ends, self.kept, self.recent, self.known = array("i"), array("q"), {}, set(), {}

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids of all texts (null: empty), the n + 1 offsets of the texts among them, and the decimal ids of each text with a comma after each."""
        texts = common.texts_of(texts)
        n = len(texts)
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain, own = np.flatnonzero(~odd), [self._parts(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
        codes, distinct = common.encode(lists.flatten())
        strings = distinct.to_pylist()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        # no space goes before the first chunk of a text
        at = np.cumsum(sizes) - sizes
        firsts, back = np.unique(codes[at], return_inverse=True) if len(at) else (codes[:0], codes[:0])
        codes = codes.astype(np.int64)
        codes[at] = len(strings) + back
        known: dict[str, int] = {}
        mine = [[known.setdefault(p, len(known)) for p in parts] for parts in own]
        base = len(strings) + len(firsts)
        parts = [*(" " + x for x in strings), *(strings[i] for i in firsts), *known]
        count = np.zeros(n, np.int64)
        count[plain], count[odd] = sizes, [len(x) for x in mine]
        order = np.empty(count.sum(), np.int64)
        is_odd = np.repeat(odd, count)
        order[~is_odd] = codes
        order[is_odd] = np.fromiter(chain.from_iterable(mine), np.int64) + base if mine else order[:0]
        places, per_part = self._places(parts)
        kept = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.frombuffer(self.ends, np.int64)])), pa.array(np.frombuffer(self.flat, np.int32)))
        words = kept.take(pa.array(places))
        ids = words.flatten()
        ends = np.concatenate([[0], np.cumsum(per_part)])
        edges = words.offsets.to_numpy()[ends] - words.offsets[0].as_py()
        of_text = pa.array(order)
        taken = pa.LargeListArray.from_arrays(pa.array(edges), ids).take(of_text)
        text_ends = np.concatenate([[0], np.cumsum(count)])
        offsets = taken.offsets.to_numpy()[text_ends] - taken.offsets[0].as_py()
        digits = joined(self.as_decimal, self.n_decimal, ids, edges).take(of_text)
        _, ends_, data = digits.buffers()
        decimal = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.frombuffer(ends_, np.int64)[digits.offset :][text_ends].copy()), data])
        if len(self.kept) > self.cache:
            self._keep({w for w in self.recent if len(w) <= LONG})
        return taken.flatten().to_numpy(), offsets, decimal

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of the tokens of each text, joined."""
        return joined(self.as_bytes, self.n_bytes, pa.array(ids), offsets)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def joined(tokens: pa.Array, sizes: np.ndarray, ids: pa.Array, offsets: np.ndarray) -> pa.Array:
    """What stands for the ids between neighbouring offsets, joined: large_binary."""
    total = np.concatenate([[0], np.cumsum(sizes[ids.to_numpy()])])
    got = tokens.take(ids)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(total[offsets]), got.buffers()[2]])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int> of each row."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets, _ = encoder(path).encode_all(b.column(1))
        return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], ["id", "ids"])

    return common.map_batches(df.select(F.col(id_col).cast("bigint"), F.col(text_col)), batch, "id bigint, ids array<int>", lambda: encoder(path).forget())


def decode_ids(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id, text of each row of ids."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return common.map_batches(df.select(F.col(id_col).cast("bigint"), F.col(ids_col)), batch, "id bigint, text string")


def digests(df: DataFrame, path: str, with_ids: bool = False, small: bool = False) -> DataFrame:
    """Token count and digests of ids and of the decoded text, in one pass; the ids themselves only if asked for. small: for executors with little memory
    left, a sixth of the caches and a third of the texts at once."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        enc.cache, enc.pairs = (CACHE // 6, PAIRS // 6) if small else (CACHE, PAIRS)
        ids, offsets, decimal = enc.encode_all(b.column(1))
        decoded = enc.decode_all(ids, offsets)
        sha = hashlib.sha256
        of_ids = [sha(memoryview(x.as_buffer())[:-1]).hexdigest() for x in decimal]
        of_text = [sha(bytes(memoryview(x.as_buffer())).decode("utf-8", "replace").encode()).hexdigest() for x in decoded]
        more = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))] if with_ids else []
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string()), *more], names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return common.map_batches(df.select(F.col("doc_id").cast("bigint"), "text"), batch, schema, lambda: encoder(path).forget(), common.SLICE_BYTES // 3 if small else common.SLICE_BYTES)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir), default_path())
