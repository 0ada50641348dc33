"""The pipeline's stages, each against brute force on its own input."""

import hashlib

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_and_run(spark, sf):
    from test_dedup import brute_kept, brute_lines

    from graphlode.llm import bpe, common, mixing

    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, common.written(stage(spark, docs, sf), name)
        out[name] = (before, docs)
        assert name == "bpe" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = out["language_id"]
    assert after.count() == before.count()  # every document here has a language
    before, after = (x.orderBy("doc_id").collect() for x in out["line_dedup"])
    gone = brute_lines(before)
    assert [r["text"] for r in after] == ["\n".join(x for p, x in enumerate(r["text"].split("\n")) if (i, p) not in gone) for i, r in enumerate(before)]
    before, after = out["near_dedup"]
    assert sorted(r["doc_id"] for r in after.collect()) == brute_kept(before.collect())  # texts inside longer ones go, too
    before, after = out["mix_sources"]
    want = {r["doc_id"]: r["copies"] for r in mixing.plan(before).collect() if r["copies"]}
    got = {}
    for r in after.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == want
    before, after = out["bpe"]
    enc, text = bpe.encoder(bpe.default_path()), {r["doc_id"]: r["text"] for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count()
    assert all(r["ids"] == enc.encode(text[r["doc_id"]]) and r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in rows)
    whole = pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in whole) == sorted((r["doc_id"], r["ids_sha256"]) for r in rows)


def test_stages_take_odd_rows(spark, odd, none):
    """The fixture's extra columns (size, key, h, th) are names that the operators use themselves."""
    for df in (odd, none):
        rows, sizes = df, []
        for name, stage in pipeline.STAGES:
            rows = stage(spark, rows, "")
            sizes.append(rows.count())
            assert rows.columns == (df.columns if name != "bpe" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
            if name == "language_id" and df is odd:
                assert {r["doc_id"] for r in rows.collect()} == {1, 4, None, 5, 6, 7, 9} and all(r["lang"] for r in rows.collect())
            if name == "near_dedup" and df is odd:  # 6 lost its line to 5; of the two rows of 7 one stays
                assert sorted((r["doc_id"] for r in rows.collect()), key=lambda k: (k is None, k)) == [1, 4, 5, 6, 7, 9, None]
        assert sizes == ([8, 8, 7, *sizes[3:]] if df is odd else [0] * 5)
