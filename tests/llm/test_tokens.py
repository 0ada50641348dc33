"""Token counts, BPE and chat formatting against the libraries."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from graphlode.llm import bpe, chat, unigram


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(bpe.default_path())


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


ALPHABET = ["<|endoftext|>", "'ll", " the", "ing", *"ab  \n\t'sSt.,é漢😀1 2\x1c\x85 lldre▁<0x41>"]


def strings(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_bpe_fuzz(enc, lib):
    for s in [*strings(3000, 1), "a" * 5000, " " * 3000, "\n" * 999, "é" * 777]:
        ids = lib.encode(s, add_special_tokens=False).ids
        assert enc.encode(s) == ids
        assert enc.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_every_token_and_bad_bytes(enc, lib):
    ids = list(range(50257))
    assert enc.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark, docs, odd, none, lib):
    for df in (docs, odd):
        text = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        got = bpe.digests(df, bpe.default_path(), with_ids=True).collect()
        assert len(got) == df.count()
        for r in got:
            ids = lib.encode(text[r["doc_id"]], add_special_tokens=False).ids
            assert r["ids"] == ids and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    assert bpe.digests(none, bpe.default_path()).count() == 0
    back = bpe.decode_ids(bpe.encode_texts(odd, bpe.default_path()), bpe.default_path()).collect()
    assert sorted(r["text"] for r in back) == sorted(r["text"] or "" for r in odd.collect())


def unigram_library(pieces):
    t = Tokenizer(models.Unigram([*pieces, ("<unk>", 0.0)], unk_id=len(pieces), byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_unigram_counts(spark, docs, odd, none):
    path = unigram.default_path()
    pieces, _ = unigram.load_pieces(path)
    lib, c = unigram_library(pieces), unigram.counter(path)
    for s in [*strings(3000, 2), "a" * 3000, " " * 500]:
        assert c.count(s) == len(lib.encode(s, add_special_tokens=False).ids), s
    for df in (docs, odd):
        text = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for r in unigram.token_counts(df, path).collect():
            assert r["n_tokens"] == len(lib.encode(text[r["doc_id"]], add_special_tokens=False).ids)
    assert unigram.token_counts(none, path).count() == 0


def test_unigram_ties():
    c = unigram.Counter([("▁ab", -2.0), ("▁a", -1.0), ("b", -1.0), ("▁", -1.0), ("a", -1.0)], False)
    assert c.word("▁ab") == 1  # equal scores: the path that began first, with the longer piece
    assert c.word("▁a") == 1 and c.word("▁azz") == 2  # unknown runs count once without byte pieces


HARD = ["\\", "### ", "</turn>", "\n", ": ", "a", "é", "漢", "😀", " ", "#", "<|endoftext|>", "\\:", "</turn>\n"]


def test_chat_round_trip_and_mask():
    rng, t = random.Random(3), chat.tokenizer(chat.default_path())
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "as: s\\", "", "### x"]), "".join(rng.choice(HARD) for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(1, 4))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        on, a, b = chat.mask(np.array(t.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2), spans)
        assert chat.unescape("".join(text[i:j] for i, j in zip(a, b))) == "".join(x for r, x in turns if r == "assistant")
        assert on.any() == any(r == "assistant" and x for r, x in turns)


def test_masked_tokens_lie_within_learned_texts(spark, lib):
    rng = random.Random(8)
    rows = [(i, j, rng.choice(["user", "assistant"]), "".join(rng.choice(HARD) for _ in range(rng.randint(0, 12)))) for i in range(300) for j in range(3)]
    convs = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").unionByName(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text"))
    enc = bpe.encoder(bpe.default_path())
    for r in chat.formatted(convs, bpe.default_path()).collect():
        text, raw = r["formatted"], r["formatted"].encode()
        assert r["ids"] == lib.encode(text, add_special_tokens=False).ids
        spans = chat.byte_spans(text, chat.render(chat.parse(text))[1])
        inside, at = set(), 0
        for s, e, learned in spans:
            assert chat.unescape(raw[s:e].decode()) == chat.unescape(raw.decode()[len(raw[:s].decode()) : len(raw[:e].decode())])
            inside.add((s, e)) if learned else None
        for i, on in zip(r["ids"], r["loss_mask"]):
            end = at + len(enc.bytes[i])
            assert on == any(s <= at and end <= e for s, e in inside)
            at = end
        assert at == len(raw)


def test_chat_query(spark, sf):
    got = {r["conv_id"]: r for r in chat.op9_chat_formatting(spark, sf).collect()}
    rows = sorted((r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in spark.read.parquet(f"{sf}/conversations.parquet").collect())
    rows += [(-7, 0, "user", chat.HARD), (-7, 1, "assistant", chat.HARD)]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = [x for x in rows if x[0] == conv]
        learned = "".join(x[3] for x in own if x[2] == "assistant")
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(learned)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()


def test_chat_odd_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, formatted string"
    rows = [(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (1, None, None, "first", None), (None, 1, "assistant", "z" * 50000, None), (2, 5, "assistant", "", None)]
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(spark.createDataFrame(rows, schema), chat.default_path())).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, None: 1, 2: 1}
    assert got[None]["loss_chars"] == 50000 and got[2]["loss_chars"] == 0
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\nfirst\nuser\n\nuser\n\n").hexdigest()
    assert chat.digests(chat.formatted(spark.createDataFrame([], schema), chat.default_path())).count() == 0
