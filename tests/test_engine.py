"""Building a small base and querying it; operators against golden values and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlode.functions import rng
from graphlode.functions import text as tx
from graphlode.operators import embed, graph, labels, metrics, ranking, splits, vectors
from graphlode.plans import build, evaluation
from graphlode.sources import files

TREE = {
    "alpha/1.0/setup/install.md": "---\ntitle: Install\ndescription: How to install\n---\n# Install\nRun the installer and wait for it to finish the work. See [use](../use.md) and [kb](/kb/alpha/reset).\n## Steps\n" + "step text " * 30 + "\n## Steps\nmore\n",
    "alpha/1.0/use.md": "# Use\n" + "using the thing well " * 20 + "[install](./setup/install.md)\n![i](x.png)\n",
    "alpha/guide.md": "# Guide\n" + "general advice on everything " * 10,
    "beta/readme.md": "no heading here but enough text to be a passage on its own, I should think so",
    "kb/alpha-2601/errors/reset.md": "---\ntitle: Reset password\nkeywords:\n  - Password\n  - reset me\ntags: [Auth]\nknowledge_article_id: kA1\n---\n# Symptom\nThe password can't be reset at all by the user.\n# Cause\nunknown " + "cause " * 20 + "[i](/alpha/1.0/use)",
    "kb/alpha/reset.md": "---\ntitle: Other\nkeywords: [password]\n---\ntext of the other article, which is long enough to be kept as a passage",
    "images/skip.md": "skipped", "alpha/CLAUDE.md": "skipped", "alpha/notes.txt": "skipped",
}
PRODUCTS = '[{"id":"alpha","name":"Alpha","categories":["Core"],"defaultVersion":"2.0","versions":[{"version":"1.0"},{"version":"2.0","isLatest":true}]}]'


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    for name, text in TREE.items():
        p = root / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    (root / "products.json").write_text(PRODUCTS)
    out = str(root / "out")
    told = build.run_build(spark, str(root / "tree"), files.products(spark, str(root / "products.json")), ["Core", "Other things"], out, images=True)
    b = build.Base(spark, out)
    b.told, b.root = told, root
    return b


def ids(df):
    return {r["id"] for r in df.collect()}


def test_nodes_and_edges(base):
    assert {i for i in ids(base.table("nodes")) if i.startswith(("doc:", "kb:"))} == {"doc:alpha@1.0/setup/install", "doc:alpha@1.0/use", "doc:alpha@2.0/guide", "doc:beta@current/readme", "kb:alpha-2601/errors/reset", "kb:alpha/reset"}
    e = {(r["src"], r["dst"], r["rel"]) for r in base.table("edges").collect()}
    assert ("doc:alpha@1.0/setup/install", "doc:alpha@1.0/use", "LINKS_TO") in e and ("doc:alpha@1.0/use", "doc:alpha@1.0/setup/install", "LINKS_TO") in e
    assert ("doc:alpha@1.0/setup/install", "kb:alpha/reset", "LINKS_TO") in e
    assert ("version:alpha@1.0", "section:alpha@1.0/setup", "HAS_SECTION") in e and ("section:alpha@1.0/setup", "doc:alpha@1.0/setup/install", "HAS_DOCUMENT") in e
    assert ("kbroot", "kbcat:alpha/errors", "CONTAINS") in e and ("kbcat:alpha/errors", "kb:alpha-2601/errors/reset", "CONTAINS") in e
    assert ("product:alpha", "category:core", "IN_CATEGORY") in e and ("root", "category:other-things", "CONTAINS") in e
    assert ("doc:alpha@1.0/setup/install", "head:doc:alpha@1.0/setup/install#steps-2", "HAS_HEADING") in e
    assert ("doc:alpha@1.0/use", "img:x.png", "EMBEDS_IMAGE") in e
    nodes = {r["id"]: r for r in base.table("nodes").collect()}
    assert nodes["kw:password"]["label"] == "password"  # the last article's spelling
    assert nodes["version:alpha@2.0"]["is_latest"] and not nodes["version:alpha@1.0"]["is_latest"]
    assert nodes["doc:alpha@1.0/use"]["url"] == "/docs/alpha/1_0/use" and nodes["kb:alpha-2601/errors/reset"]["url"] == "/kb/alpha-2601/errors/reset"
    chunks = [r for r in base.table("edges").collect() if r["rel"] == "NEXT"]
    assert len(chunks) == sum(max(0, r["count"] - 1) for r in base.items("chunk").groupBy("doc_id").count().collect())


def test_manifest(base):
    told = base.told
    assert told["counts"]["files"] == 6 and told["counts"]["kb_articles"] == 2 and told["counts"]["links"] == told["graph"]["edgeRelations"]["LINKS_TO"]
    assert told["products"][0]["id"] == "alpha" and told["levels"]["doc"] == {"items": 6, "dim": 256, "vectors": 6}


def test_searches(base):
    assert base.retrieve("reset a forgotten password", "doc", 2).first()["id"].startswith("kb:alpha")
    assert all(r["tier"] == "docs" for r in base.retrieve("password", "doc", 5, tier="docs").collect())
    near = base.similar("doc:alpha@1.0/use", 3)
    assert "doc:alpha@1.0/use" not in ids(near) and all(r["tier"] == "docs" for r in near.collect())
    with pytest.raises(ValueError):
        base.similar("tag:auth")
    n, _, alone = base.cluster(threshold=0.99)
    assert (n, alone) == (6, 6)
    with pytest.raises(ValueError):
        base.cluster(cap=3)


def test_paths(base):
    n, e = base.table("nodes"), base.table("edges")
    assert graph.shortest_path(n, e, "root", "root") == ["root"] and graph.shortest_path(n, e, "root", "nowhere") is None
    assert len(graph.shortest_path(n, e, "kw:password", "tag:auth")) == 3
    assert graph.neighbors(e, "kbroot", "in").first()["id"] == "root"


def test_labels_and_tuning(base, spark):
    lab = base.labels()
    rows = {(r["field"], r["grp"]): r["query"] for r in lab.collect()}
    assert rows["keywords", "kb:alpha-2601/errors/reset"] == "Password reset me" or rows["keywords", "kb:alpha-2601/errors/reset"] == "password reset me"
    assert rows["symptom", "kb:alpha-2601/errors/reset"] == "The password can't be reset at all by the user."
    link = base.labels(gold="link", fields=("title",)).collect()
    assert [(r["golds"], r["target_tier"]) for r in link] == [(["doc:alpha@1.0/use"], "docs")]
    doc = base.labels("doc", fields=("title", "headings")).collect()
    assert {r["grp"] for r in doc} == {"doc:alpha/setup/install", "doc:alpha/use", "doc:alpha/guide", "doc:beta/readme"} and [r["seq"] for r in sorted(doc, key=lambda r: r["seq"])] == [*range(len(doc))]
    grid = ranking.expand_grid(("doc", "chunk"), ("vector", "bm25", "rrf"), ("max", "mean"))
    assert len(grid) == 9
    configs = spark.createDataFrame(grid, ranking.CONFIG)
    got = evaluation.tune(base.gather(lab, ["doc", "chunk"], 20), lab, configs, cv=2, final_holdout=0.4)
    board = got["leaderboard"].orderBy("rank").collect()
    assert len(board) == 9 and all(0 <= r["metric"] <= 1 for r in board) and got["final"]["key"] == board[0]["config_key"]


def test_golden_values(spark):
    r = spark.range(1).select(*[tx.fnv1a(F.lit(w)).alias(w) for w in ("a", "reset", "password")], rng.draw(F.lit(7), F.lit(1)).alias("d7"), rng.draw(F.lit(1), F.lit(3)).alias("d1")).first()
    assert [r[w] for w in ("a", "reset", "password")] == [3826002220, 1695364032, 910909208]
    assert (r["d7"], r["d1"]) == (0.011704753153026104, 0.5274470399599522)
    assert "".join("abcdef"[i] for i in rng.shuffled(6, 1 ^ 1002371989)) == "cfdbae"
    one = spark.range(1).select(embed.hash_vector(F.lit("reset password")).alias("v")).first()["v"]
    assert {i: round(x * 2, 6) for i, x in enumerate(one) if x} == {192: 1.0, 52: 0.5, 176: 0.5, 24: 1.5, 253: 0.5}
    assert embed.hash_embed_py(["reset password"])[0].tolist() == pytest.approx(one)


def test_text_expressions(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    assert one(tx.slug(F.lit("  Foo Bar!/x@1.0 "))) == "foo-bar-/x@1.0" and one(tx.slugify_heading(F.lit("`Foo` *Bar*  baz?"))) == "foo-bar-baz"
    assert one(tx.path_normalize(F.lit("../b/./c.md"), F.array(F.lit("x"), F.lit("y")))) == "x/b/c"
    assert one(tx.doc_family(F.lit("doc:a@1/x@2/y"))) == "doc:a/x@2/y"
    assert one(tx.node_of_item(F.lit("chunk"), F.lit("chunk:doc:a#b#12"))) == "doc:a#b" and one(tx.node_of_item(F.lit("heading"), F.lit("head:kb:x#a#b"))) == "kb:x"
    assert one(tx.collapse(F.lit("  a \n b\t"))) == "a b"


def test_fusion_and_metrics(spark):
    cand = spark.createDataFrame([("q", "doc", "v", 0.9, 1, None, None, 1), ("q", "doc", "b", None, None, 3.0, 1, 201), ("q", "doc", "both", 0.5, 2, 1.0, 2, 2)], "qid string, lvl string, id string, v_score double, v_rank int, b_score double, b_rank int, arrival int")
    configs = spark.createDataFrame(ranking.expand_grid(signals=("vector", "bm25", "linear", "rrf")), ranking.CONFIG)
    r = ranking.rank(cand, configs).collect()
    by = {k: [x["node"] for x in sorted(r, key=lambda x: x["rank"]) if x["config_key"] == k] for k in {x["config_key"] for x in r}}
    assert by == {"doc/vector": ["v", "both"], "doc/bm25": ["b", "both"], "doc/linear@0.5": ["v", "b", "both"], "doc/rrf": ["both", "v", "b"]}
    lab = spark.createDataFrame([("q", ["b", "zz"], "g", "p", "title", 0), ("none", ["x"], "h", "p", "title", 1)], "qid string, golds array<string>, grp string, product string, field string, seq bigint")
    m = {(x["qid"], x["config_key"]): x for x in metrics.per_query(ranking.rank(cand, configs), lab, configs).collect()}
    x = m["q", "doc/rrf"]
    assert (x["mrr"], x["hit1"], x["hit5"], x["recall10"]) == (0.333333, 0, 1, 0.5)
    assert x["ndcg10"] == pytest.approx(0.5 / (1 + 1 / math.log2(3)), abs=1e-6) and m["none", "doc/rrf"]["mrr"] == 0
    ci = metrics.bootstrap(metrics.per_query(ranking.rank(cand, configs), lab, configs), "mrr").collect()
    assert all(c["lo"] <= c["mean"] <= c["hi"] for c in ci)


def test_splits(spark):
    rows = [(f"g{i}", s, i) for s, n in (("a", 1), ("b", 2), ("c", 7)) for i in [x + 10 * "abc".index(s) for x in range(n)]]
    lab = spark.createDataFrame([(f"q{i}{j}", g, p, i * 2 + j) for g, p, i in rows for j in (0, 1)], "qid string, grp string, product string, seq bigint")
    folds = {r["grp"]: r["fold"] for r in splits.kfold(lab).collect()}
    assert len(folds) == 10 and folds["g0"] == 0 and sorted(folds[g] for g, p, _ in rows if p == "c") == [0, 0, 1, 1, 2, 3, 4]
    test = [r for r in splits.holdout(lab).collect() if r["is_test"]]
    assert {s: sum(r["stratum"] == s for r in test) for s in "abc"} == {"a": 1, "b": 1, "c": 2}
    loo = splits.leave_one_out(lab)
    assert loo.count() == 3 * 20 and loo.where("is_test").count() == 20


def test_vector_ties_and_pairs(spark):
    v = spark.createDataFrame([(f"i{i}", i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(6)], "id string, row_idx bigint, embedding array<float>")
    got = vectors.search(v, F.array(F.lit(1.0), F.lit(0.0)), 4).collect()
    assert [r["row_idx"] for r in got] == [1, 3, 5, 0]
    comp = graph.components(vectors.similar_pairs(v, 0.9)).collect()
    assert {r["id"]: r["root"] for r in comp} == {0: 0, 2: 0, 4: 0, 1: 1, 3: 1, 5: 1}


def test_formats(spark, tmp_path):
    import numpy as np

    (tmp_path / "g.json").write_text('{"nodes":[{"id":"a","type":"X","label":"l"},{"id":"b","type":"Y"}],"edges":[["a","b","R"],["a","b","R"],["a","c","R"]]}')
    nodes, edges = files.graph_json(spark, str(tmp_path / "g.json"))
    assert [(r["src"], r["dst"], r["seq"]) for r in graph.merge_edges(edges, nodes).collect()] == [("a", "b", 0)]
    assert graph.merge_nodes(nodes).where("id = 'a'").first()["attrs"]["label"] == "l"
    np.arange(6, dtype="<f4").tofile(tmp_path / "v.f32")
    assert [r["embedding"] for r in files.packed_vectors(spark, str(tmp_path / "v.f32"), 3).orderBy("row_idx").collect()] == [[0, 1, 2], [3, 4, 5]]
    with pytest.raises(FileNotFoundError):
        files.load(spark, str(tmp_path), "nothing")
    lab = spark.createDataFrame([("0:t:g", "q", "t", ["g"], "g", "p", "kb", 0)], "qid string, query string, field string, golds array<string>, grp string, product string, target_tier string, seq bigint")
    files.save_labels(lab, str(tmp_path / "l"))
    assert files.labels_json(spark, str(tmp_path / "l")).first()["golds"] == ["g"]
    assert labels.stats(lab).where("kind = 'groups'").first()["n"] == 1


def test_streaming_items(spark, base, tmp_path):
    from graphlode.streaming.ingest import stream_items

    q = stream_items(spark, str(base.root / "tree" / "alpha"), files.products(spark, str(base.root / "products.json")), str(tmp_path / "items"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "items")).where("lvl = 'doc'").count() >= 3


def test_cli(base, spark, capsys):
    from graphlode import cli

    for args in (["stats"], ["manifest"], ["node", "kbroot"], ["neighbors", "kbroot", "--dir", "in"], ["path", "root", "kbroot"], ["search", "password", "--level", "doc", "-k", "2"], ["similar", "doc:alpha@1.0/use"], ["cluster"], ["labels"], ["eval"]):
        cli.main(["--out", base.out, *args], spark)
    told = capsys.readouterr().out
    assert "root -> kbroot" in told and "kb:alpha" in told


def test_rest_clients(spark, monkeypatch):
    import http.server
    import json
    import threading

    seen = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["content-length"])))
            seen.append((body["model"], len(body["input"]), body.get("input_type"), self.headers["authorization"]))
            ok = "fail" not in body["input"]
            data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])][::-1]
            self.send_response(200 if ok else 429)
            self.end_headers()
            self.wfile.write(json.dumps({"data": data}).encode() if ok else b"slow down")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = spark.createDataFrame([("doc", f"d{i}", i, "x" * i) for i in range(7)], "lvl string, id string, row_idx bigint, text string").coalesce(1)
    for provider, key in (("openai", "OPENAI_API_KEY"), ("voyage", "VOYAGE_API_KEY")):
        monkeypatch.delenv(key, raising=False)
        with pytest.raises(ValueError, match=key):
            embed.embed(rows, provider)
        monkeypatch.setenv(key, "secret")
        monkeypatch.setenv(f"GRAPHLODE_{provider.upper()}_URL", f"http://127.0.0.1:{server.server_port}/")
        got = embed.embed(rows, provider, batch=3, kind="query").orderBy("row_idx").collect()
        assert [round(r["embedding"][0] / r["embedding"][1]) for r in got] == [*range(7)]  # in the order of the texts
        assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-6 and r["dim"] == 2 for r in got)
    assert {s[1] for s in seen} == {3, 1} and {s[2] for s in seen} == {None, "query"} and all(s[3] == "Bearer secret" for s in seen)
    with pytest.raises(RuntimeError, match="429"):
        embed.rest_client("openai", "m")(["fail"])
    with pytest.raises(ValueError):
        embed.embed(rows, "nowhere")
    assert (embed.dimensions("openai", "text-embedding-3-large"), embed.dimensions("openai"), embed.dimensions("hash")) == (3072, 1536, 256)
    server.shutdown()


def test_hash_embeddings_of_a_batch(spark):
    texts = ["reset password reset", "", "a", None, "Zürich 12345 longword"]
    every = embed.hash_embed_py(texts)
    assert all(np.allclose(every[i], embed.hash_embed_py([t])[0]) for i, t in enumerate(texts))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in rows.select("i", embed.hash_vector(F.col("t")).alias("v")).collect():
        assert np.allclose(every[r["i"]], r["v"], atol=1e-6)


def test_search_many_in_blocks(spark, monkeypatch):
    from graphlode.operators import vectors

    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, i, rng.normal(size=8).astype(float).tolist()) for i in range(120)], "id int, row_idx int, embedding array<float>")
    q = rows.where("id % 5 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    want = sorted(map(tuple, vectors.search_many(rows, q, 4).select("qid", "id", "rank").collect()))
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, vectors.search_many(rows, q, 4).select("qid", "id", "rank").collect())) == want


def test_files_that_are_skipped(spark):
    from graphlode.sources.files import wanted

    paths = ["a/b.md", "a/B.MDX", "a/img/b.md", "node_modules/x.md", "CLAUDE.md", "a/b.txt", "img.md", "build/c/d.md"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").where(wanted(F.col("p"))).collect()
    assert [r["p"] for r in got] == ["a/b.md", "a/B.MDX", "img.md"]


def test_nodes_by_id(spark):
    nodes = spark.createDataFrame([("a", "T"), ("b", "U")], "id string, type string")
    assert graph.has_node(nodes, "a") and not graph.has_node(nodes, "c")
    assert graph.node(nodes, "b") == {"id": "b", "type": "U"} and graph.node(nodes, "c") is None


def test_searches_in_blocks_against_all_pairs(spark):
    """Ties, repeated rows, nulls, other lengths and NaN: ranks are those of all pairs, scores those of a sum in order."""
    from pyspark.sql import types as T

    from graphlode.operators import vectors

    rng = np.random.default_rng(2)
    vec = [rng.normal(size=7).round(1).tolist() for _ in range(300)]
    vec[5] = vec[6] = vec[40] = vec[41] = vec[7]
    vec[11], vec[12], vec[13], vec[14] = None, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [float("nan")] + [0.0] * 6
    kind = T.StructType([T.StructField("id", T.StringType()), T.StructField("row_idx", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    rows = spark.createDataFrame([(f"i{i}", i, v) for i, v in enumerate(vec)], kind)
    q = rows.where("row_idx < 60 OR row_idx = 299").select(F.col("row_idx").alias("qid"), F.col("embedding").alias("qvec"))

    def dot(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        s = 0.0
        for x, y in zip(a, b, strict=True):
            s += x * y
        return s

    for k in (3, 299):
        want = {}
        for i in [*range(60), 299]:
            all_ = [(dot(v, vec[i]), j) for j, v in enumerate(vec)]
            want[i] = sorted(all_, key=lambda x: (x[0] is None, x[0] == x[0], -x[0] if x[0] is not None and x[0] == x[0] else 0, x[1]))[:k]
        got = {}
        for r in vectors.search_many(rows, q, k, digits=None).collect():
            got.setdefault(r["qid"], []).append((r["rank"], r["score"], r["row_idx"]))
        assert {i: [j for _, _, j in sorted(g)] for i, g in got.items()} == {i: [j for _, j in w] for i, w in want.items()}
        assert {i: repr([s for _, s, _ in sorted(g)]) for i, g in got.items()} == {i: repr([s for s, _ in w]) for i, w in want.items()}


def test_bm25_in_blocks(spark):
    """Scores, ties by first term and row, and items that only some blocks have, against a plain count of all pairs."""
    from graphlode.operators import bm25

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, size=int(rng.integers(1, 12))) if x < 60) for _ in range(400)] + ["w1 w2", "w2 w1", None, ""]
    items = spark.createDataFrame([(f"d{i}", i, t) for i, t in enumerate(texts)], "id string, row_idx bigint, text string")
    asks = [(i, t) for i, t in enumerate(texts[:60])] + [(900, "w2 w1 nowhere w2"), (901, "nowhere"), (902, None)]
    queries = spark.createDataFrame(asks, "qid int, query string")
    toks = [(t or "").split() for t in texts]
    avg, df = sum(map(len, toks)) / len(toks), {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    want = []
    for q, text in asks:
        terms, found = list(dict.fromkeys((text or "").split())), []
        for i, t in enumerate(toks):
            hit = [w for w in terms if w in t]
            s = sum(round(math.log(1 + (len(toks) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) / 1e-12) for w in hit)
            found += [(-(s * 1e-12), terms.index(hit[0]), i)] if hit else []
        want += [(q, n, i, f) for n, (_, f, i) in enumerate(sorted(found)[:7], 1)]
    got = bm25.search(queries, bm25.postings(items), bm25.corpus_stats(items), 7, digits=None)
    assert sorted((r["qid"], r["rank"], r["row_idx"], r["first_pos"]) for r in got.collect()) == sorted(want)


def test_search_takes_no_row_a_pair(spark):
    """Pairs of queries and rows meet in blocks: no join or window of the plan has a row for each of them."""
    from graphlode.operators import bm25, vectors

    v = spark.createDataFrame([(i, i, [float(i), 1.0]) for i in range(100)], "id int, row_idx int, embedding array<double>")
    found = vectors.search_many(v, v.selectExpr("id AS qid", "embedding AS qvec"), 2)
    items = spark.createDataFrame([(i, i, "a b c") for i in range(100)], "id int, row_idx int, text string")
    lexical = bm25.search(items.selectExpr("id AS qid", "text AS query"), bm25.postings(items), bm25.corpus_stats(items), 2)
    for df in (found, lexical):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "zip_with" not in plan
        assert "qid" not in " ".join(x for x in plan.splitlines() if "Join" in x)


def test_golds_that_queries_share(spark):
    ranked = spark.createDataFrame([(q, "c", n, r) for q in (1, 2, 3) for r, n in enumerate((10, 11, 12), 1)], "qid int, config_key string, node int, rank int")
    configs = spark.createDataFrame([("c",)], "config_key string")
    own = [(1, [11, 12, 12]), (2, [11, 12]), (3, [])]
    a = spark.createDataFrame([(q, g, "g", "p", "f", q) for q, g in own], "qid int, golds array<int>, grp string, product string, field string, seq int")
    b = spark.createDataFrame([(1, "x", 2, "g", "p", "f", 1), (2, "x", 2, "g", "p", "f", 2), (3, None, 0, "g", "p", "f", 3)], "qid int, gold_key string, n_gold int, grp string, product string, field string, seq int")
    golds = spark.createDataFrame([("x", 11), ("x", 12)], "gold_key string, node int")
    assert sorted(metrics.per_query(ranked, a, configs).collect()) == sorted(metrics.per_query(ranked, b, configs, golds=golds).collect())


def test_pairs_and_forest_in_blocks(spark):
    """All pairs, each once and in whichever blocks, with scores of a sum in order; the forest has the same components in fewer rows, and no plan has a row for each pair."""
    rng = np.random.default_rng(4)
    vec = [x.tolist() for x in rng.normal(size=(150, 5)).round(1)]
    vec[3] = vec[77] = vec[78] = vec[149]
    vec[9] = None
    v = spark.createDataFrame([(f"i{i}", i, x) for i, x in enumerate(vec)] + [("again", 4, vec[4])], "id string, row_idx bigint, embedding array<double>")
    want = []
    rows = [*enumerate(vec), (4, vec[4])]
    for i, a in rows:
        for j, b in rows:
            if i < j and a and b:
                s = 0.0
                for x, y in zip(a, b, strict=True):
                    s += x * y
                want += [(i, j, s)] if s >= 5.0 else []
    for blocks in (None, 1, 4):
        assert sorted(map(tuple, vectors.similar_pairs(v, 5.0, blocks, digits=None).collect())) == sorted(want)
        forest = vectors.similar_forest(v, 5.0, blocks)
        assert {(r["a"], r["b"]) for r in forest.collect()} <= {x[:2] for x in want}
        assert sorted(graph.components(forest).collect()) == sorted(graph.components(vectors.similar_pairs(v, 5.0)).collect())
    assert vectors.similar_forest(v, 5.0, 1).count() < 151 < len(want)
    assert "Join" not in vectors.similar_pairs(v, 5.0)._jdf.queryExecution().optimizedPlan().toString()


def test_paths_from_both_ends(spark, monkeypatch):
    """The path is the one of a search from a alone: each node's predecessor by way, seq and id; frontiers broadcast or not."""
    from graphlode.operators import bm25

    rng = np.random.default_rng(5)
    rows = [(f"n{a}", f"n{b}", "R", int(rng.integers(0, 20))) for a, b in rng.integers(0, 60, size=(75, 2)).tolist()] + [("p", "q", "R", 0)]
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(60)] + [("p",), ("q",)], "id string")
    edges = spark.createDataFrame(rows, "src string, dst string, rel string, seq bigint")

    def alone(a, b):
        seen, front = {a: None}, [a]
        while front and b not in seen:
            best = {}
            for u, v, way, seq in [(s, d, 0, q) for s, d, _, q in rows] + [(d, s, 1, q) for s, d, _, q in rows]:
                if u in front and v not in seen:
                    best[v] = min(best.get(v, (9, 0, "")), (way, seq, u))
            seen |= {v: x[2] for v, x in best.items()}
            front = [*best]
        path = [b]
        while b in seen and path[-1] != a:
            path.append(seen[path[-1]])
        return path[::-1] if b in seen else None

    asked = [("n0", "n1"), ("n2", "n33"), ("n0", "p"), ("n5", "n40")]
    want = [alone(*x) for x in asked]
    assert want[2] is None and max(len(x) for x in want if x) > 4
    assert [graph.shortest_path(nodes, edges, *x) for x in asked] == want
    a, b = next(x for x, w in zip(asked, want, strict=True) if w and len(w) > 4)
    hops = len(alone(a, b)) - 1
    assert graph.shortest_path(nodes, edges, a, b, hops) == alone(a, b) and graph.shortest_path(nodes, edges, a, b, hops - 1) is None
    monkeypatch.setattr(bm25, "BROADCAST_BYTES", -1)
    assert graph.shortest_path(nodes, edges, a, b) == alone(a, b)
    # edges of a small frontier are found without an exchange
    monkeypatch.undo()
    assert "Join Inner" not in graph.touching(edges, nodes.limit(1).withColumnRenamed("id", "u"))._jdf.queryExecution().optimizedPlan().toString()


def test_edges_are_exchanged_once_an_end(spark, monkeypatch):
    """Rows as before: distinct, first seq, both ends there; in the plan edges are exchanged by src and by dst, and never sorted."""
    from graphlode.operators import bm25

    edges = spark.createDataFrame([("a", "b", "R", 3), ("a", "b", "R", 1), ("a", "b", "S", 2), ("a", "x", "R", 0), ("x", "b", "R", 0), ("b", "b", "R", 5), (None, "b", "R", 0)], "src string, dst string, rel string, seq int")
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    want = [("a", "b", "R", 1), ("a", "b", "S", 2), ("b", "b", "R", 5)]
    assert sorted(map(tuple, graph.merge_edges(edges, nodes).collect())) == want
    monkeypatch.setattr(bm25, "BROADCAST_BYTES", -1)
    df = graph.merge_edges(edges, nodes)
    assert sorted(map(tuple, df.collect())) == want
    plan = df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "SortMergeJoin" not in plan[0] and plan[1].count("Exchange hashpartitioning") == 4
