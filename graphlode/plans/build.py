"""build: ingest and embed a Markdown tree into tables; and the searches over what was built."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlode.config import LEVELS, Settings
from graphlode.functions import text as tx
from graphlode.operators import bm25, cluster, embed, graph, ingest, labels, ranking, vectors
from graphlode.operators.tables import stored
from graphlode.sources import files, markdown

ATTRS = {"label": "string", "product_id": "string", "version": "string", "tier": "string", "url": "string", "path": "string", "description": "string", "knowledge_article_id": "string", "sidebar_position": "string", "level": "int", "idx": "int", "tokens": "int", "is_latest": "boolean"}


def run_ingest(spark: SparkSession, root: str, products: DataFrame, categories: list[str], out: str, only: list[str] | None = None, limit: int = 0, images: bool = False) -> dict:
    """Nodes, edges, items and the manifest of a Markdown tree, written below out. Files are parsed once."""
    tree = files.markdown_tree(spark, root, only, limit)
    numbered = labels.numbered_rows(tree.drop("seq"), "path")
    docs = stored(ingest.classify(stored(markdown.parsed(numbered), "parsed"), products), "classified")
    cats = spark.createDataFrame([(c,) for c in categories], "name string")
    rows = graph.merge_nodes(ingest.node_rows(docs, products, cats, images))
    nodes = rows.select("id", "type", *[F.try_element_at("attrs", F.lit(k)).cast(t).alias(k) for k, t in ATTRS.items()], F.from_json(F.try_element_at("attrs", F.lit("categories")), "array<string>").alias("categories"), "seq")
    files.save(nodes, out, "nodes")
    nodes = files.load(spark, out, "nodes")
    files.save(graph.merge_edges(ingest.edge_rows(docs, products, cats, images), nodes), out, "edges")
    files.save(ingest.items(docs), out, "items", by_level=True)
    told = ingest.manifest(docs, nodes, files.load(spark, out, "edges"), files.load(spark, out, "items"), categories, {"products": only or "all", "limit": limit or None, "images": images})
    files.save_text(spark, out, "manifest", told)
    return told


def run_embed(spark: SparkSession, out: str, provider: str = "hash", levels: tuple[str, ...] = LEVELS, model: str | None = None) -> dict:
    """Vectors of the levels that have items; the manifest learns provider, model and dimensions."""
    items = files.load(spark, out, "items").where(F.col("lvl").isin(*levels))
    files.save(embed.embed(items, provider, model, Settings.load(spark).embed_batch), out, "vectors", by_level=True)
    told = files.load_text(spark, out, "manifest")
    told["embedding"] = {"provider": provider, "model": model or embed.MODELS.get(provider, provider)}
    for r in files.load(spark, out, "vectors").groupBy("lvl").agg(F.first("dim").alias("dim"), F.count("*").alias("n")).collect():
        told["levels"].setdefault(r["lvl"], {}).update(dim=r["dim"], vectors=r["n"])
    files.save_text(spark, out, "manifest", told)
    return told


def run_build(spark: SparkSession, root: str, products: DataFrame, categories: list[str], out: str, provider: str = "hash", **kw) -> dict:
    run_ingest(spark, root, products, categories, out, **kw)
    return run_embed(spark, out, provider)


class Base:
    """A built base: its tables and the queries over them."""

    def __init__(self, spark: SparkSession, out: str) -> None:
        self.spark, self.out = spark, out

    def table(self, name: str) -> DataFrame:
        return files.load(self.spark, self.out, name)

    def items(self, lvl: str) -> DataFrame:
        return self.table("items").where(F.col("lvl") == lvl)

    def vectors(self, lvl: str) -> DataFrame:
        v = self.table("vectors").where(F.col("lvl") == lvl)
        if v.select(F.count("*")).first()[0] != self.items(lvl).select(F.count("*")).first()[0]:
            raise ValueError(f"level {lvl!r}: vectors and items don't match; embed it again")
        return v

    def query_vectors(self, queries: DataFrame) -> DataFrame:
        """qid, query, qvec by the provider that the base was embedded with."""
        how = files.load_text(self.spark, self.out, "manifest")["embedding"]
        rows = queries.select(F.lit("query").alias("lvl"), F.col("qid").alias("id"), F.lit(0).cast("bigint").alias("row_idx"), F.col("query").alias("text"))
        v = embed.embed(rows, how["provider"], how["model"], kind="query")
        return queries.join(v.select(F.col("id").alias("qid"), F.col("embedding").alias("qvec")), "qid")

    def retrieve(self, text: str, level: str = "chunk", k: int = 8, tier: str | None = None, product: str | None = None) -> DataFrame:
        """The k nearest items of a text, with their attributes; predicates come before the cut."""
        v = self.vectors(level)
        want = self.items(level)
        for c, x in (("tier", tier), ("product", product)):
            if x:
                want = want.where(F.col(c) == x)
        if tier or product:
            v = v.join(want.select("id"), "id", "left_semi")
        q = self.query_vectors(self.spark.createDataFrame([("q", text)], "qid string, query string"))
        best = vectors.search_many(v, q, k)
        return best.drop("qid", "row_idx").join(self.items(level), "id").orderBy("rank")

    def similar(self, node: str, k: int = 8, cross_tier: bool = False, product: str | None = None, level: str | None = None) -> DataFrame:
        level = level or self.spark.range(1).select(tx.level_for_node(F.lit(node))).first()[0]
        if level is None:
            raise ValueError(f"{node!r} has no level")
        return vectors.similar(self.vectors(level), self.items(level), node, k, cross_tier, product).join(self.items(level).drop("row_idx"), "id").orderBy(F.desc("score"), "row_idx")

    def cluster(self, level: str = "doc", tier: str | None = None, product: str | None = None, threshold: float = 0.55, cap: int | None = 2500, top: int = 25):
        v = self.vectors(level).join(self.items(level).select("id", "label", "tier", "product"), "id")
        for c, x in (("tier", tier), ("product", product)):
            if x:
                v = v.where(F.col(c) == x)
        return cluster.clusters(v, threshold, cap=cap, top=top)

    def gather(self, queries: DataFrame, levels: list[str], cand_n: int = 200) -> DataFrame:
        """Candidates of all queries(qid, query) on all levels."""
        out, q = None, self.query_vectors(queries.select("qid", "query"))
        for lvl in levels:
            it = self.items(lvl)
            bm = bm25.search(queries, bm25.postings(it), bm25.corpus_stats(it), cand_n, digits=None)
            c = ranking.candidates(vectors.search_many(self.vectors(lvl), q, cand_n, digits=None), bm, lvl, cand_n)
            out = c if out is None else out.unionByName(c)
        return stored(out, "candidates")

    def labels(self, target: str = "kb", gold: str = "self", fields: tuple[str, ...] = labels.FIELDS, product: str | None = None) -> DataFrame:
        return labels.build(self.table("nodes"), self.table("edges"), self.items("heading"), target, gold, fields, product)
