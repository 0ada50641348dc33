"""Every registered query with its DuckDB SQL (None where SQL can't express it). Queries run over whole tables.

Stand-ins for the graph's own tables: documents joined to embeddings by id are items with text and vector; the first line of a text is its title; sources
are products and nodes; the queries of searches over many are the rows whose id is divisible by 20; their golds are the items of the same label.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlode.config import METRICS, Settings
from graphlode.functions import rng
from graphlode.functions import text as tx
from graphlode.operators import bm25, cluster, embed, graph, ingest, metrics, ranking, splits, vectors
from graphlode.operators import labels as lb
from graphlode.operators.tables import stored
from graphlode.plans.evaluation import evaluate, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CAND, THETA = Settings.candidates, 0.35
#: The SQL's number of candidates.
SQL_CAND = CAND
GRID = ranking.expand_grid(signals=("vector", "bm25", "linear", "rrf"), alphas=(0.25, 0.5))


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("row_idx"), "text", "lang", "source")


def vecs(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("row_idx"), "embedding", "label")


def items(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).join(vecs(spark, sf).drop("row_idx"), "id")


def asked(it: DataFrame) -> DataFrame:
    title = F.split("text", "\n")[0]
    return it.where(F.col("id") % 20 == 0).select(F.col("id").alias("qid"), title.alias("query"), F.col("embedding").alias("qvec"), F.col("source").alias("product"), F.col("lang").alias("field"), "label")


TOK = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"


#: A sum that doesn't depend on the order of rows.
FIXED = "CAST(sum(CAST(round(({}) / 1e-12::DOUBLE) AS BIGINT)) AS DOUBLE) * 1e-12::DOUBLE"


def bm25_sql(docs: str, qs: str, k: int) -> str:
    """CTEs p, n, s ending in bt(qid, id, score, rank); docs has id, text, qs has qid, query."""
    return f"""
dt AS (SELECT id, {TOK.format('text')} AS t FROM {docs}),
p AS (SELECT id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM dt) GROUP BY id, term),
n AS (SELECT count(*) AS n, sum(len(t)) / greatest(count(*), 1) AS avgdl FROM dt),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
qx AS (SELECT qid, {TOK.format('query')} AS t FROM {qs}),
qt AS (SELECT qid, term, min(pos) AS pos FROM (SELECT qid, unnest(t) AS term, unnest(range(len(t))) AS pos FROM qx) GROUP BY qid, term),
bs AS (SELECT qid, id, {FIXED.format('ln(1 + (n.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / n.avgdl))')} AS score, min(pos) AS pos
  FROM qt JOIN p USING (term) JOIN df USING (term) CROSS JOIN n GROUP BY qid, id),
bt AS (SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos, id) AS rank FROM bs) WHERE rank <= {k})"""


IT = "it AS (SELECT d.doc_id AS id, d.text, d.source, d.lang, e.embedding::DOUBLE[] AS v, e.label FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)"
QS = "q AS (SELECT id AS qid, string_split(text, chr(10))[1] AS query, v AS qv, source AS product, lang AS field, label FROM it WHERE id % 20 = 0)"
VT = f"vt AS (SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, list_inner_product(v, qv) AS score FROM it, q)) WHERE rank <= {SQL_CAND})"
CAND_SQL = f"{IT}, {QS}, {VT}, {bm25_sql('it', 'q', SQL_CAND)}, c AS (SELECT coalesce(vt.qid, bt.qid) AS qid, coalesce(vt.id, bt.id) AS id, vt.score AS vs, vt.rank AS vr, bt.score AS bs, bt.rank AS br, coalesce(vt.rank, {SQL_CAND} + bt.rank) AS arrival FROM vt FULL JOIN bt ON vt.qid = bt.qid AND vt.id = bt.id)"
NORM = """cn AS (SELECT *, coalesce((vs - min(vs) OVER w) / coalesce(nullif(max(vs) OVER w - min(vs) OVER w, 0), 1), 0) AS nv,
  coalesce((bs - min(bs) OVER w) / coalesce(nullif(max(bs) OVER w - min(bs) OVER w, 0), 1), 0) AS nb FROM c WINDOW w AS (PARTITION BY qid))"""
GRID_SQL = "g AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{s}', {a}::DOUBLE, {r}, '{p}', {i})" for k, _, s, a, r, p, i in GRID) + ") t(config_key, signal, alpha, rrf_k, pool, place))"


def ranked_sql(grid: str, node: str) -> str:
    return f"""{CAND_SQL}, {NORM}, {grid},
sc AS (SELECT qid, config_key, pool, {node} AS node, arrival, CASE signal WHEN 'vector' THEN vs WHEN 'bm25' THEN bs WHEN 'linear' THEN alpha * nv + (1 - alpha) * nb
  ELSE coalesce(1.0::DOUBLE / (rrf_k + vr), 0) + coalesce(1.0::DOUBLE / (rrf_k + br), 0) END AS s FROM cn CROSS JOIN g),
po AS (SELECT qid, config_key, node, CASE any_value(pool) WHEN 'mean' THEN {FIXED.format('s')} / count(*) WHEN 'sum' THEN {FIXED.format('s')} ELSE max(s) END AS score, min(arrival) AS arrival FROM sc WHERE s IS NOT NULL GROUP BY qid, config_key, node),
r AS (SELECT qid, config_key, node, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, config_key ORDER BY score DESC, arrival, node) AS rank FROM po) WHERE rank <= 100)"""


def gathered(spark: SparkSession, sf: str) -> DataFrame:
    it = stored(items(spark, sf), "items")  # texts are exchanged for the join: once
    q = asked(it)
    vec = vectors.search_many(it, q, CAND, digits=None)
    bm = bm25.search(q, bm25.postings(it), bm25.corpus_stats(it), CAND, digits=None)
    return ranking.candidates(vec, bm, "doc", CAND)


def grid_df(spark: SparkSession, grid: list[tuple]) -> DataFrame:
    return spark.createDataFrame(grid, ranking.CONFIG)


# --- text -------------------------------------------------------------------


@query(f"SELECT doc_id, len({TOK.format('text')}) AS n_tokens, len(list_distinct({TOK.format('text')})) AS n_terms FROM documents")
def tokenize_counts(spark, sf):
    t = tx.tokens(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_terms"))


@query(f"WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY doc_id, term) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term")
def term_stats(spark, sf):
    return bm25.postings(documents(spark, sf)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"SELECT count(*) AS n, round(sum(len({TOK.format('text')})) / greatest(count(*), 1), 6) AS avgdl FROM documents")
def corpus_stats(spark, sf):
    return bm25.corpus_stats(documents(spark, sf)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"SELECT id, term, count(*) AS tf, any_value(n) AS doc_len FROM (SELECT id, len(t) AS n, unnest(t) AS term FROM (SELECT doc_id AS id, {TOK.format('text')} AS t FROM documents)) GROUP BY id, term")
def postings(spark, sf):
    return bm25.postings(documents(spark, sf)).select("id", "term", F.col("tf").cast("bigint").alias("tf"), F.col("doc_len").cast("bigint").alias("doc_len"))


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name || ' / ' || p_brand || '!')), '[^\w./@-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, regexp_replace(trim(regexp_replace(lower(p_name || ' *' || p_type || '* (x)'), '[`*_~]|[^\w\s-]', '', 'g')), '\s+', '-', 'g') AS heading_slug FROM part")
def slugify(spark, sf):
    p = read(spark, sf, "part")
    return p.select("p_partkey", tx.slug(F.concat_ws(" / ", "p_name", F.concat("p_brand", F.lit("!")))).alias("slug"), tx.slugify_heading(F.concat("p_name", F.lit(" *"), "p_type", F.lit("* (x)"))).alias("heading_slug"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS INTEGER) AS tokens, left(trim(text, chr(10) || ' '), 200) AS snippet FROM documents")
def estimated_tokens(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.est_tokens(F.col("text")).alias("tokens"), tx.cap(F.col("text"), 200).alias("snippet"))


ID_ROWS = "SELECT 'chunk:doc:p' || (o_orderkey % 7) || '@1.' || (o_orderkey % 3) || '/a/b#' || o_orderkey AS id FROM orders UNION ALL SELECT 'head:kb:a/b#x#' || o_orderkey FROM orders UNION ALL SELECT 'doc:p@2/x@3/' || o_orderkey FROM orders UNION ALL SELECT 'tag:' || o_orderkey FROM orders"


@query(f"""SELECT id, CASE WHEN id LIKE 'chunk:%' THEN 'chunk' WHEN id LIKE 'head:%' THEN 'heading' WHEN id LIKE 'doc:%' OR id LIKE 'kb:%' THEN 'doc' END AS lvl,
CASE WHEN id LIKE 'chunk:%' THEN regexp_replace(substr(id, 7), '#\\d+$', '') WHEN id LIKE 'head:%' THEN string_split(substr(id, 6), '#')[1] ELSE id END AS node, regexp_replace(id, '^(.*?)@[^/]+/', '\\1/') AS family FROM ({ID_ROWS})""")
def node_ids(spark, sf):
    read(spark, sf, "orders").createOrReplaceTempView("graphlode_orders")
    rows = spark.sql(ID_ROWS.replace("FROM orders", "FROM graphlode_orders"))
    lvl = tx.level_for_node(F.col("id"))
    return rows.select("id", lvl.alias("lvl"), tx.node_of_item(F.coalesce(lvl, F.lit("doc")), F.col("id")).alias("node"), tx.doc_family(F.col("id")).alias("family"))


HREF = "href=\"([^\"]*)\""


HREF_SQL = f"(SELECT page_id, unnest(regexp_extract_all(html, '{HREF}', 1)) AS h FROM pages)"


def hrefs(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("h"))


@query(rf"""WITH v AS (SELECT page_id, h, unnest([{{'href': h, 'key': CASE WHEN h LIKE '/docs/%' THEN substr(h, 7) WHEN h LIKE '/%' THEN substr(h, 2) ELSE array_to_string(list_concat(['a', 'b'], list_filter(string_split(h, '/'), lambda x: x NOT IN ('', '.'))), '/') END}},
  {{'href': '..' || h || '.md', 'key': 'a' || h || '.md'}}, {{'href': './x/..' || h || '/', 'key': 'a/b' || h || '/'}}, {{'href': 'https://e.org' || h, 'key': 'a/b/https:/e.org' || h}}]) AS e FROM {HREF_SQL})
SELECT page_id, e.href AS href, NOT regexp_matches(e.href, '(?i)^(https?:|mailto:|tel:|#)') AND (e.href LIKE '/%' OR e.href LIKE '.%' OR regexp_matches(e.href, '(?i)\.(md|mdx)(#|$)')) AS internal,
  regexp_replace(regexp_replace(e.key, '(?i)\.(md|mdx)$', ''), '/$', '') AS key FROM v""")
def url_path_normalize(spark, sf):
    """Each link of a page as it is, and as relative and outside links."""
    forms = F.array("h", F.concat(F.lit(".."), "h", F.lit(".md")), F.concat(F.lit("./x/.."), "h", F.lit("/")), F.concat(F.lit("https://e.org"), "h"))
    h = hrefs(spark, sf).select("page_id", F.explode(forms).alias("href"))
    return h.select("page_id", "href", tx.is_internal(F.col("href")).alias("internal"), tx.path_normalize(F.col("href"), F.array(F.lit("a"), F.lit("b"))).alias("key"))


@query("SELECT doc_id, left(trim(concat_ws(chr(10), nullif(string_split(text, chr(10))[1], ''), nullif(lang, ''), 'Sections: ' || array_to_string(string_split(text, chr(10))[1:40], ' · '), nullif(left(trim(text, ' ' || chr(10)), 600), '')), ' ' || chr(10)), 1600) AS text FROM documents")
def doc_embed_text(spark, sf):
    d = read(spark, sf, "documents").withColumn("h", F.split("text", "\n"))
    none = F.array().cast("array<string>")
    return d.select("doc_id", tx.doc_embed_text(F.col("h")[0], F.col("lang"), F.lit("docs"), none, none, F.col("h"), F.col("text"), F.lit("")).alias("text"))


PIECES = "list_transform(range(0, len({0}), 1040), lambda z: substr({0}, z + 1, 1280))"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, text, regexp_split_to_array(text, '\n{{2,}}') AS ps FROM (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents WHERE text IS NOT NULL)),
w(doc_id, i, now, out) AS (
  SELECT doc_id, 0::BIGINT, '', []::VARCHAR[] FROM d WHERE length(text) > 1280
  UNION ALL
  SELECT w.doc_id, i + 1,
    CASE WHEN length(ps[i + 1]) > 1280 THEN '' WHEN length(now) + 2 + length(ps[i + 1]) > 1280 THEN CASE WHEN now = '' THEN ps[i + 1] WHEN ps[i + 1] = '' THEN right(now, 240) ELSE right(now, 240) || chr(10) || chr(10) || ps[i + 1] END
      WHEN now = '' THEN ps[i + 1] ELSE now || chr(10) || chr(10) || ps[i + 1] END,
    CASE WHEN length(ps[i + 1]) > 1280 THEN list_concat(CASE WHEN now = '' THEN out ELSE list_append(out, now) END, {PIECES.format('ps[i + 1]')})
      WHEN length(now) + 2 + length(ps[i + 1]) > 1280 AND now <> '' THEN list_append(out, now) ELSE out END
  FROM w JOIN d USING (doc_id) WHERE i < len(ps)),
f AS (SELECT doc_id, CASE WHEN now = '' THEN out ELSE list_append(out, now) END AS out FROM w JOIN d USING (doc_id) WHERE i = len(ps)
  UNION ALL SELECT doc_id, [text] FROM d WHERE length(text) <= 1280)
SELECT doc_id, unnest(range(len(out))) AS i, unnest(out) AS piece FROM f""")
def chunk_windows(spark, sf):
    """The documents' texts, their lines as paragraphs, packed into windows."""
    from graphlode.sources.markdown import windows

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: windows(t, Settings.chunk_chars, Settings.overlap_chars))

    d = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return d.select("doc_id", F.posexplode(cut("text")).alias("i", "piece")).select("doc_id", F.col("i").cast("bigint").alias("i"), "piece")


# As the items of a document follow one another, so do the turns of a conversation: each is a file whose chunks are its turns.
@query("SELECT 'chunk:c' || conv_id || '#' || (i - 1) AS src, 'chunk:c' || conv_id || '#' || i AS dst FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations) WHERE i > 0")
def chunk_next_edges(spark, sf):
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    docs = c.select(F.concat(F.lit("c"), "conv_id").alias("doc_id"), F.col("conv_id").alias("seq"), F.posexplode(F.sequence(F.lit(1), F.col("n"))).alias("idx", "c"))
    return ingest.next_edges(docs).select("src", "dst")


# --- embeddings and vector search -------------------------------------------


@query(f"""WITH t AS (SELECT item_id, unnest({TOK.format('text')}) AS t FROM benchmark), g AS (SELECT item_id, t AS g, 1.0::DOUBLE AS w FROM t UNION ALL SELECT item_id, left(t, 4), 0.5 FROM t WHERE length(t) > 4 UNION ALL SELECT item_id, right(t, 4), 0.5 FROM t WHERE length(t) > 4)
SELECT item_id, CAST(list_reduce(list_transform(string_split(g, ''), lambda x: unicode(x)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) % 256 AS INTEGER) AS bucket, sum(w) AS weight FROM g GROUP BY 1, 2""")
def hash_embed_buckets(spark, sf):
    return embed.hash_buckets(read(spark, sf, "benchmark"), "item_id", F.col("text"))


@query()
def hash_embed_documents(spark, sf):
    rows = documents(spark, sf).select(F.lit("doc").alias("lvl"), "id", "row_idx", "text")
    return embed.embed(rows, "hash")


@query("SELECT vec_id AS id, round(score, 6) AS score FROM (SELECT vec_id, list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10)")
def vector_topk(spark, sf):
    v = vecs(spark, sf)
    one = v.where("id = 0").select("embedding").first()["embedding"]  # the query's vector
    return vectors.search(v, F.array(*map(F.lit, one)), 10).select("id", "score")


def with_vector(v: DataFrame, at: int, rows: DataFrame, k: int = 10) -> DataFrame:
    one = v.where(F.col("id") == at).select(F.col("embedding").alias("qvec"), F.lit(0).alias("qid")).limit(1)
    return vectors.search_many(rows, one, k)


@query("SELECT vec_id AS id, round(score, 6) AS score FROM (SELECT vec_id, list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10)")
def vector_topk_filtered(spark, sf):
    v = vecs(spark, sf)
    return with_vector(v, 0, v.where("label = 3")).select("id", "score")


@query("SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS qid, v.vec_id AS id, list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank <= 20")
def vector_topn_multi(spark, sf):
    v = vecs(spark, sf)
    return vectors.search_many(v, v.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec")), 20).select("qid", "id", "score", F.col("rank").cast("bigint").alias("rank"))


SIMILAR = "WITH it AS (SELECT d.doc_id AS id, CASE WHEN lang = 'en' THEN 'docs' ELSE 'kb' END AS tier, source, embedding::DOUBLE[] AS v FROM documents d JOIN embeddings ON vec_id = doc_id) SELECT id, round(score, 6) AS score FROM (SELECT it.id, list_inner_product(it.v, q.v) AS score FROM it, it q WHERE q.id = 1 AND it.id <> 1 {} ORDER BY score DESC, it.id LIMIT 8)"


def similar_to(spark: SparkSession, sf: str, **kw) -> DataFrame:
    it = items(spark, sf)
    meta = it.select("id", F.when(F.col("lang") == "en", "docs").otherwise("kb").alias("tier"), F.col("source").alias("product"))
    return vectors.similar(it.select("id", "row_idx", "embedding"), meta, 1, **kw).select("id", "score")


@query(SIMILAR.format("AND it.tier = q.tier"))
def similar_nodes(spark, sf):
    return similar_to(spark, sf)


@query(SIMILAR.format(""))
def similar_cross_tier(spark, sf):
    return similar_to(spark, sf, cross_tier=True)


@query(SIMILAR.format("AND it.source = 'src3'"))
def similar_in_product(spark, sf):
    return similar_to(spark, sf, cross_tier=True, product="src3")


# --- lexical and hybrid ranking ---------------------------------------------


@query(f"WITH q AS (SELECT item_id AS qid, text AS query FROM benchmark), d AS (SELECT doc_id AS id, text FROM documents), {bm25_sql('d', 'q', 10)} SELECT qid, id, round(score, 6) AS score, rank FROM bt")
def bm25_topk(spark, sf):
    d = documents(spark, sf)
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return bm25.search(q, bm25.postings(d), bm25.corpus_stats(d), 10).select("qid", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {CAND_SQL} SELECT qid, id, round(coalesce(vs, -1), 6) AS v_score, coalesce(vr, 0) AS v_rank, round(coalesce(bs, -1), 6) AS b_score, coalesce(br, 0) AS b_rank FROM c")
def candidates_fullouter(spark, sf):
    def known(c: str, kind: str, none: int) -> Column:
        return F.coalesce(F.col(c), F.lit(none)).cast(kind).alias(c)

    c = gathered(spark, sf).select("qid", "id", known("v_score", "double", -1), known("v_rank", "bigint", 0), known("b_score", "double", -1), known("b_rank", "bigint", 0))
    return c.withColumns({k: F.round(k, 6) for k in ("v_score", "b_score")})


def ranked(spark: SparkSession, sf: str, grid: list[tuple], node: Column | None = None) -> DataFrame:
    c = gathered(spark, sf)
    if node is not None:
        c = c.join(documents(spark, sf).select("id", "source"), "id")
    return ranking.rank(c, grid_df(spark, grid), node=node).select("qid", "config_key", "node", "score", F.col("rank").cast("bigint").alias("rank"))


def _rank_queries() -> None:
    for i, (key, _, signal, alpha, k, pool, _) in enumerate(GRID):
        name = f"rank_{signal}" + (f"_{int(alpha * 100)}" if signal == "linear" else "")
        row = [GRID[i]]
        one = f"g AS (SELECT '{key}' AS config_key, '{signal}' AS signal, {alpha}::DOUBLE AS alpha, {k} AS rrf_k, '{pool}' AS pool)"
        QUERIES[name] = lambda spark, sf, row=row: ranked(spark, sf, row)
        ORACLE[name] = f"WITH {ranked_sql(one, 'id')} SELECT * FROM r"
    for pool in ("max", "mean", "sum"):
        row = [(f"source/rrf/{pool}", "doc", "rrf", 0.5, 60, pool, 0)]
        one = f"g AS (SELECT 'source/rrf/{pool}' AS config_key, 'rrf' AS signal, 0.5::DOUBLE AS alpha, 60 AS rrf_k, '{pool}' AS pool)"
        QUERIES[f"pool_{pool}"] = lambda spark, sf, row=row: ranked(spark, sf, row, F.col("source"))
        ORACLE[f"pool_{pool}"] = f"WITH {ranked_sql(one, '(SELECT source FROM it WHERE it.id = cn.id)')} SELECT * FROM r"


_rank_queries()


# --- labels, metrics, tuning ------------------------------------------------

LABELS = "l AS (SELECT q.qid, q.product, q.field, q.label, q.qid % 5 AS grp, (SELECT count(*) FROM it WHERE it.label = q.label) AS ng FROM q)"


def hybrid_labels(spark: SparkSession, sf: str) -> DataFrame:
    it = items(spark, sf)
    n = it.groupBy(F.col("label").alias("gold_key")).agg(F.count_distinct("id").alias("n_gold"))
    q = asked(it).withColumnRenamed("label", "gold_key").join(n, "gold_key", "left")
    return q.select("qid", "gold_key", F.coalesce("n_gold", F.lit(0)).alias("n_gold"), (F.col("qid") % 5).cast("string").alias("grp"), "product", "field", F.col("qid").alias("seq"))


def hybrid_golds(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of each label; queries of a label share them."""
    return items(spark, sf).select(F.col("label").alias("gold_key"), F.col("id").alias("node")).distinct()


# Parts stand for articles, suppliers for their keywords; a part's symptom heading tells its type.
@query("""WITH k AS (SELECT l_partkey AS p, l_suppkey AS s, min(l_orderkey * 100 + l_linenumber) AS seq FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY ALL),
f AS (SELECT p_partkey AS p, p_brand, 0 AS f, 'title' AS field, p_name AS query FROM part UNION ALL SELECT p_partkey, p_brand, 1, 'description', 'a ' || lower(p_type) || ' part' FROM part
  UNION ALL SELECT p_partkey, p_brand, 2, 'keywords', string_agg(s_name, ' ' ORDER BY k.seq, s_name) FROM part JOIN k ON k.p = p_partkey JOIN supplier ON s_suppkey = k.s GROUP BY p_partkey, p_brand
  UNION ALL SELECT p_partkey, p_brand, 4, 'symptom', p_type || ' ' || p_size FROM part WHERE p_size % 2 = 0)
SELECT CAST(row_number() OVER (ORDER BY p, f) - 1 AS VARCHAR) || ':' || field || ':kb:' || p AS qid, query, field, 'kb:' || p AS gold, 'kb:' || p AS grp, p_brand AS product, 'kb' AS target_tier FROM f WHERE query <> ''""")
def labels_build(spark, sf):
    part, sup, li = (read(spark, sf, t) for t in ("part", "supplier", "lineitem"))
    none = F.lit(None).cast("string")
    nodes = part.select(F.concat(F.lit("kb:"), "p_partkey").alias("id"), F.lit("KBArticle").alias("type"), F.col("p_name").alias("label"), F.concat(F.lit("a "), F.lower("p_type"), F.lit("  part ")).alias("description"), F.col("p_brand").alias("product_id"), F.col("p_partkey").alias("seq"))
    nodes = nodes.unionByName(sup.select(F.concat(F.lit("kw:"), "s_suppkey").alias("id"), F.lit("Keyword").alias("type"), F.col("s_name").alias("label"), none.alias("description"), none.alias("product_id"), F.col("s_suppkey").alias("seq")))
    edges = li.select(F.concat(F.lit("kb:"), "l_partkey").alias("src"), F.concat(F.lit("kw:"), "l_suppkey").alias("dst"), F.lit("MENTIONS").alias("rel"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    edges = graph.merge_edges(edges, nodes)
    heads = part.where("p_size % 2 = 0").select(F.lit("kb").alias("tier"), F.concat(F.lit("head:kb:"), "p_partkey", F.lit("#symptoms")).alias("id"), F.lit("Symptoms").alias("label"), F.concat("p_name", F.lit("\n"), "p_type", F.lit("\n "), "p_size").alias("text"), F.col("p_partkey").alias("row_idx"))
    lab = lb.build(nodes, edges, heads)
    return lab.select("qid", "query", "field", F.col("golds")[0].alias("gold"), "grp", "product", "target_tier")


@query("SELECT item_id AS qid, doc_id AS gold FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def labels_from_passages(spark, sf):
    b = read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    return lb.passages(b, read(spark, sf, "documents").select("doc_id", "text")).select("qid", F.col("doc_id").alias("gold"))


@query(f"WITH {IT}, {QS}, {LABELS} SELECT 'product' AS kind, product AS name, count(*) AS n FROM l GROUP BY product UNION ALL SELECT 'field', field, count(*) FROM l GROUP BY field UNION ALL SELECT 'records', '', count(*) FROM l UNION ALL SELECT 'groups', '', count(DISTINCT grp) FROM l")
def label_stats(spark, sf):
    return lb.stats(hybrid_labels(spark, sf))


MET = f"""{ranked_sql(GRID_SQL, 'id')}, {LABELS},
h AS (SELECT r.qid, r.config_key, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS in10, sum(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS dcg
  FROM r JOIN l ON l.qid = r.qid JOIN it ON it.id = r.node AND it.label = l.label GROUP BY r.qid, r.config_key),
m AS (SELECT l.qid, g.config_key, CAST(l.grp AS VARCHAR) AS grp, l.product, l.field, round(coalesce(1.0::DOUBLE / first, 0), 12) AS mrr, coalesce(CAST(first <= 1 AS DOUBLE), 0) AS hit1, coalesce(CAST(first <= 5 AS DOUBLE), 0) AS hit5, coalesce(CAST(first <= 10 AS DOUBLE), 0) AS hit10,
  round(coalesce(in10::DOUBLE / greatest(ng, 1), 0), 12) AS recall10, round(coalesce(dcg / list_sum(list_transform(range(1, greatest(least(ng, 10), 1) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 0), 12) AS ndcg10
  FROM l CROSS JOIN g LEFT JOIN h ON h.qid = l.qid AND h.config_key = g.config_key)"""
AVGS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS)


def measured(spark: SparkSession, sf: str) -> DataFrame:
    configs = grid_df(spark, GRID)
    r = ranking.rank(gathered(spark, sf), configs)
    return stored(metrics.per_query(r, hybrid_labels(spark, sf), configs, digits=12, golds=hybrid_golds(spark, sf)), "measured")


@query(f"WITH {MET} SELECT qid, config_key, grp, product, field, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)} FROM m")
def metrics_per_query(spark, sf):
    return measured(spark, sf).select("qid", "config_key", "grp", "product", "field", *[F.round(m, 6).alias(m) for m in METRICS])


@query(f"WITH {MET} SELECT config_key, count(*) AS n, {AVGS} FROM m GROUP BY config_key")
def metrics_overall(spark, sf):
    return metrics.means(measured(spark, sf), "config_key")


@query(f"WITH {MET} SELECT config_key, product, count(*) AS n, {AVGS} FROM m GROUP BY config_key, product")
def metrics_by_product(spark, sf):
    return metrics.means(measured(spark, sf), "config_key", "product")


@query(f"WITH {MET} SELECT config_key, field, count(*) AS n, {AVGS} FROM m GROUP BY config_key, field")
def metrics_by_field(spark, sf):
    return metrics.means(measured(spark, sf), "config_key", "field")


@query(f"WITH {MET}, pp AS (SELECT config_key, product, {', '.join(f'avg({m}) AS {m}' for m in METRICS)} FROM m GROUP BY config_key, product) SELECT config_key, {AVGS} FROM pp GROUP BY config_key")
def metrics_macro(spark, sf):
    return metrics.macro(measured(spark, sf))


def draw_sql(seed: str, n: str) -> str:
    """A draw of the generator as nested SELECTs over HUGEINT, from a relation with the columns named."""
    m = "4294967295::HUGEINT"
    return f"""SELECT *, ((xor(t2, t2 >> 14)) & {m})::DOUBLE / 4294967296.0::DOUBLE AS u FROM (SELECT *, xor((t1 + ((xor(t1, t1 >> 7) * (t1 | 61)) & {m})) & {m}, t1) AS t2 FROM
  (SELECT *, (xor(a0, a0 >> 15) * (a0 | 1)) & {m} AS t1 FROM (SELECT *, (({seed})::HUGEINT + ({n})::HUGEINT * 1831565813) & {m} AS a0 FROM base)))"""


@query(f"""WITH {MET}, mg AS (SELECT config_key, grp, sum(ndcg10) AS total, count(*) AS cnt, row_number() OVER (PARTITION BY config_key ORDER BY min(qid), grp) - 1 AS at FROM m GROUP BY config_key, grp),
gc AS (SELECT config_key, count(*) AS gn FROM mg GROUP BY config_key), base AS (SELECT config_key, gn, b, unnest(range(gn)) AS s FROM (SELECT config_key, gn, unnest(range(500)) AS b FROM gc)),
dr AS (SELECT config_key, b, CAST(floor(u * gn) AS BIGINT) AS at FROM ({draw_sql('7', 'b * gn + s + 1')})),
rs AS (SELECT dr.config_key, b, sum(total) / greatest(sum(cnt), 1) AS v FROM dr JOIN mg ON mg.config_key = dr.config_key AND mg.at = dr.at GROUP BY dr.config_key, b),
li AS (SELECT config_key, list_sort(list(v)) AS vs FROM rs GROUP BY config_key)
SELECT m.config_key, round(avg(ndcg10), 6) AS mean, round(any_value(vs)[13], 6) AS lo, round(any_value(vs)[488], 6) AS hi, count(*) AS n FROM m JOIN li USING (config_key) GROUP BY m.config_key""")
def bootstrap_ci(spark, sf):
    found = evaluate(gathered(spark, sf), hybrid_labels(spark, sf), grid_df(spark, GRID), golds=hybrid_golds(spark, sf))["overall"]
    return found.where("metric = 'ndcg10'").drop("metric")


@query(f"WITH base AS (SELECT o_orderkey AS n FROM orders) SELECT n, u FROM ({draw_sql('7', 'n')})")
def prng_draws(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("n"), rng.draw(F.lit(7), F.col("o_orderkey")).alias("u"))


SHUFFLE = f"""WITH RECURSIVE o AS (SELECT CAST(o_custkey AS VARCHAR) AS grp, arg_min(o_orderpriority, o_orderkey) AS stratum, min(o_orderkey) AS first FROM orders GROUP BY o_custkey),
st AS (SELECT stratum, list(grp ORDER BY first, grp) AS l, count(*) AS n, xor(1::BIGINT, CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(stratum, ''), lambda x: unicode(x)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS BIGINT)) AS seed FROM o GROUP BY stratum),
base AS (SELECT stratum, seed, n, unnest(range(1, n)) AS k FROM st),
dr AS (SELECT stratum, k, n - k AS i, CAST(floor(u * (n - k + 1)) AS BIGINT) AS j FROM ({draw_sql('seed', 'k')})),
fy(stratum, k, l) AS (SELECT stratum, 0::BIGINT, l FROM st
  UNION ALL SELECT fy.stratum, fy.k + 1, CASE WHEN i = j THEN l ELSE list_concat(l[1:j], [l[i + 1]], l[j + 2:i], [l[j + 1]], l[i + 2:]) END FROM fy JOIN dr ON dr.stratum = fy.stratum AND dr.k = fy.k + 1),
sh AS (SELECT fy.stratum, st.n, unnest(fy.l) AS grp, unnest(range(len(fy.l))) AS pos FROM fy JOIN st ON st.stratum = fy.stratum AND fy.k = greatest(st.n - 1, 0))
"""


def order_labels(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("grp"), F.col("o_orderpriority").alias("product"), F.col("o_orderkey").alias("seq"))


@query(SHUFFLE + "SELECT grp, stratum, CAST(pos % 5 AS INTEGER) AS fold FROM sh")
def kfold_assign(spark, sf):
    return splits.kfold(order_labels(spark, sf))


@query(SHUFFLE + "SELECT grp, stratum, pos < greatest(1, floor(n * 0.3::DOUBLE + 0.5)) AS is_test FROM sh")
def holdout_assign(spark, sf):
    return splits.holdout(order_labels(spark, sf))


@query(f"WITH {IT}, {QS} SELECT n.product AS name, q.qid, q.product = n.product AS is_test FROM q, (SELECT DISTINCT product FROM q) n")
def lopo_folds(spark, sf):
    return splits.leave_one_out(hybrid_labels(spark, sf))


@query(f"""WITH {MET}, f AS (SELECT config_key, product, avg(ndcg10) AS v FROM m GROUP BY config_key, product)
SELECT config_key, round(avg(v), 6) AS metric, round(coalesce(stddev_samp(v), 0), 6) AS std, row_number() OVER (ORDER BY round(avg(v), 6) DESC, any_value(place)) AS rank FROM f JOIN g USING (config_key) GROUP BY config_key""")
def tune_leaderboard(spark, sf):
    got = tune(gathered(spark, sf), hybrid_labels(spark, sf), grid_df(spark, GRID), "ndcg10", lopo=True, golds=hybrid_golds(spark, sf))
    return got["leaderboard"].select("config_key", "metric", "std", F.col("rank").cast("bigint").alias("rank"))


# --- graph ------------------------------------------------------------------

PAIRS = f"pr AS (SELECT a.vec_id AS a, b.vec_id AS b, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE score >= {THETA})"
COMPONENTS = f"{PAIRS}, e AS (SELECT a AS u, b AS v FROM pr UNION SELECT b, a FROM pr), reach(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v), cc AS (SELECT u AS id, least(min(v), u) AS root FROM reach GROUP BY u)"


@query(f"WITH {PAIRS} SELECT a, b, round(score, 6) AS score FROM pr")
def similarity_pairs(spark, sf):
    return vectors.similar_pairs(vecs(spark, sf), THETA)


@query(f"WITH RECURSIVE {COMPONENTS} SELECT * FROM cc")
def connected_components(spark, sf):
    return graph.components(vectors.similar_forest(vecs(spark, sf), THETA))


@query(f"WITH RECURSIVE {COMPONENTS} SELECT root, count(*) AS size, arg_min(CAST(label AS VARCHAR), id) AS label, array_to_string(list_sort(list(id))[1:10], ',') AS members FROM cc JOIN embeddings ON vec_id = id GROUP BY root ORDER BY size DESC, root LIMIT 25")
def cluster_summary(spark, sf):
    _, found, _ = cluster.clusters(vecs(spark, sf), THETA, cap=None)
    return found.select("root", "size", "label", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


GRAPH = [("region", "r_regionkey", "'region:'", None), ("nation", "n_nationkey", "'nation:'", ("r_regionkey", "n_regionkey")), ("customer", "c_custkey", "'customer:'", None), ("supplier", "s_suppkey", "'supplier:'", None), ("orders", "o_orderkey", "'orders:'", None), ("part", "p_partkey", "'part:'", None)]
EDGES = [
    ("region", "n_regionkey", "nation", "n_nationkey", "nation", "HAS_NATION"), ("nation", "c_nationkey", "customer", "c_custkey", "customer", "HAS_CUSTOMER"), ("nation", "s_nationkey", "supplier", "s_suppkey", "supplier", "HAS_SUPPLIER"),
    ("customer", "o_custkey", "orders", "o_orderkey", "orders", "ORDERED"), ("orders", "l_orderkey", "part", "l_partkey", "lineitem", "CONTAINS"), ("supplier", "l_suppkey", "part", "l_partkey", "lineitem", "SUPPLIED"),
]
NODES_SQL = " UNION ALL ".join(f"SELECT {p} || {k} AS id, '{t}' AS type FROM {t}" for t, k, p, _ in GRAPH)
EDGES_SQL = " UNION ALL ".join(f"SELECT '{s}:' || {sk} AS src, '{d}:' || {dk} AS dst, '{rel}' AS rel FROM {t}" for s, sk, d, dk, t, rel in EDGES)


def tpch_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = None, None
    for t, k, _, _ in GRAPH:
        n = read(spark, sf, t).select(F.concat(F.lit(f"{t}:"), F.col(k)).alias("id"), F.lit(t).alias("type"))
        nodes = n if nodes is None else nodes.unionByName(n)
    for s, sk, d, dk, t, rel in EDGES:
        e = read(spark, sf, t).select(F.concat(F.lit(f"{s}:"), F.col(sk)).alias("src"), F.concat(F.lit(f"{d}:"), F.col(dk)).alias("dst"), F.lit(rel).alias("rel"), F.xxhash64(sk, dk).alias("seq"))
        edges = e if edges is None else edges.unionByName(e)
    return nodes, edges


@query(f"WITH n AS ({NODES_SQL}), e AS ({EDGES_SQL}), d AS (SELECT DISTINCT src, dst, rel FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)) SELECT 'node' AS kind, type AS name, count(*) AS n FROM n GROUP BY type UNION ALL SELECT 'edge', rel, count(*) FROM d GROUP BY rel")
def graph_stats(spark, sf):
    n, e = tpch_graph(spark, sf)
    return graph.stats(n, graph.merge_edges(e, n))


def _neighbour_queries() -> None:
    out = f"SELECT dst AS id, rel, 'out' AS dir FROM (SELECT DISTINCT * FROM ({EDGES_SQL})) WHERE src = 'nation:3'"
    into = f"SELECT src AS id, rel, 'in' AS dir FROM (SELECT DISTINCT * FROM ({EDGES_SQL})) WHERE dst = 'nation:3'"
    for way, sql in {"out": out, "in": into, "both": f"{out} UNION ALL {into}"}.items():
        def run(spark, sf, way=way):
            n, e = tpch_graph(spark, sf)
            return graph.neighbors(graph.merge_edges(e, n), "nation:3", way).select("id", "rel", "dir")

        QUERIES[f"graph_neighbors_{way}"], ORACLE[f"graph_neighbors_{way}"] = run, sql


_neighbour_queries()


# Pages are nodes, and of their links those that a page with an even id has; edges to others are left out.
@query(f"SELECT DISTINCT 'page:' || page_id AS src, h AS dst, 'LINKS_TO' AS rel FROM {HREF_SQL} WHERE h IN (SELECT h FROM {HREF_SQL} WHERE page_id % 2 = 0)")
def graph_edges_dedup(spark, sf):
    h = hrefs(spark, sf)
    nodes = read(spark, sf, "pages").select(F.concat(F.lit("page:"), "page_id").alias("id")).unionByName(h.where("page_id % 2 = 0").select(F.col("h").alias("id")).distinct())
    edges = h.select(F.concat(F.lit("page:"), "page_id").alias("src"), F.col("h").alias("dst"), F.lit("LINKS_TO").alias("rel"), F.col("page_id").alias("seq"))
    return graph.merge_edges(edges, nodes).select("src", "dst", "rel")


@query("SELECT DISTINCT array_to_string(p[1:i], '/') AS id, array_to_string(p[1:i - 1], '/') AS parent, p[i] AS label FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT list_filter(string_split(url, '/'), lambda x: x <> '') AS p FROM pages))")
def hierarchy_chain(spark, sf):
    p = read(spark, sf, "pages").select(F.explode(graph.prefixes(F.filter(F.split("url", "/"), lambda x: x != ""))).alias("pre"))
    return p.select(F.array_join("pre", "/").alias("id"), F.array_join(F.slice("pre", F.lit(1), F.size("pre") - 1), "/").alias("parent"), F.element_at("pre", -1).alias("label")).distinct()


@query(f"""WITH RECURSIVE e AS (SELECT src AS u, dst AS v FROM ({EDGES_SQL}) UNION SELECT dst, src FROM ({EDGES_SQL})), near(id, d) AS (SELECT 'region:0', 0 UNION SELECT e.v, near.d + 1 FROM near JOIN e ON e.u = near.id WHERE near.d < 6)
SELECT 'customer:7' AS target, CAST(min(d) + 1 AS INTEGER) AS n_nodes FROM near WHERE id = 'customer:7'""")
def shortest_path_len(spark, sf):
    n, e = tpch_graph(spark, sf)
    path = graph.shortest_path(n, e, "region:0", "customer:7")
    return spark.createDataFrame([("customer:7", len(path) if path else None)], "target string, n_nodes int")


@query("SELECT 'kw:' || lower(o_orderpriority) AS id, arg_max(o_orderstatus || o_orderkey, o_orderkey) AS label, arg_min(o_orderstatus, o_orderkey) AS type FROM orders GROUP BY lower(o_orderpriority)")
def node_merge(spark, sf):
    o = read(spark, sf, "orders").select(F.concat(F.lit("kw:"), F.lower("o_orderpriority")).alias("id"), F.col("o_orderstatus").alias("type"), F.create_map(F.lit("label"), F.concat("o_orderstatus", F.col("o_orderkey"))).alias("attrs"), F.col("o_orderkey").alias("seq"))
    return graph.merge_nodes(o).select("id", F.col("attrs")["label"].alias("label"), "type")


# Pages as documents: each lies at its first link's path and has its links in three forms.
@query(rf"""WITH d AS (SELECT page_id, regexp_extract_all(html, '{HREF}', 1) AS hs FROM pages), f AS (SELECT page_id, substr(hs[1], 2) || '.md' AS path, hs FROM d WHERE len(hs) > 0),
k AS (SELECT key, max(page_id) AS dst FROM (SELECT page_id, unnest([regexp_replace(path, '\.md$', ''), path, 'page/' || page_id]) AS key FROM f) GROUP BY key),
t AS (SELECT page_id, unnest(range(3 * len(hs))) AS place, unnest(list_concat(hs, hs, hs)) AS h FROM f),
n AS (SELECT page_id, place, regexp_replace(regexp_replace(substr(h, 2), '(?i)\.(md|mdx)$', ''), '/$', '') AS key FROM t),
r AS (SELECT n.page_id, place, coalesce(a.dst, b.dst, c.dst) AS dst FROM n LEFT JOIN k a ON a.key = n.key LEFT JOIN k b ON b.key = n.key || '.md' LEFT JOIN k c ON c.key = 'docs/' || n.key)
SELECT 'doc:' || page_id AS src, 'doc:' || dst AS dst, CAST(place AS BIGINT) AS place FROM r WHERE dst IS NOT NULL AND dst <> page_id""")
def link_resolve(spark, sf):
    d = read(spark, sf, "pages").select("page_id", F.regexp_extract_all("html", F.lit(HREF), F.lit(1)).alias("hs")).where(F.size("hs") > 0)
    path = F.concat(F.substring(F.col("hs")[0], 2, 1 << 30), F.lit(".md"))
    up = F.concat(F.array_join(F.transform(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), lambda x: F.lit("..")), "/"), F.lit(""))
    forms = F.concat("hs", F.transform("hs", lambda h: F.concat(F.when(up == "", F.lit(".")).otherwise(up), h, F.lit(".md"))), F.transform("hs", lambda h: F.concat(F.lit("/docs"), h, F.lit("/"))))
    docs = d.select(F.concat(F.lit("doc:"), "page_id").alias("doc_id"), F.col("page_id").alias("seq"), path.alias("path"), F.split(path, "/").alias("parts"), F.concat(F.lit("/page/"), "page_id").alias("url"), forms.alias("links"))
    return ingest.link_edges(docs).select("src", "dst", F.col("at").cast("bigint").alias("place"))


@query("SELECT source AS product, count(*) FILTER (WHERE lang = 'en') AS n_docs, count(*) FILTER (WHERE lang <> 'en') AS n_kb, count(*) AS total, CAST(count(DISTINCT lang) FILTER (WHERE lang = 'en') AS INTEGER) AS n_versions FROM documents GROUP BY source")
def manifest_products(spark, sf):
    d = read(spark, sf, "documents").select(F.col("source").alias("product"), (F.col("lang") != "en").alias("is_kb"), F.col("lang").alias("graph_version"), F.col("doc_id").alias("seq"))
    return ingest.product_counts(d).select("product", "n_docs", "n_kb", "total", F.size("versions").alias("n_versions"))


@query()
def markdown_parse(spark, sf):
    """Documents as Markdown: their first line a heading, a link and a list of front matter added."""
    from graphlode.sources.markdown import parsed

    head = F.concat(F.lit("---\ntitle: T"), F.col("doc_id"), F.lit("\ntags:\n  - a\n  - b\n---\n# "))
    files = read(spark, sf, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.concat(head, F.col("text"), F.lit("\n[next](./"), F.col("doc_id") + 1, F.lit(".md)\n")).alias("content"), F.col("doc_id").alias("seq"))
    p = parsed(files)
    return p.select("path", "title", F.size("headings").alias("n_headings"), F.array_join("links", ",").alias("links"), F.size("chunks").alias("n_chunks"), F.aggregate("chunks", F.lit(0), lambda s, c: s + c["tokens"]).alias("tokens"))
