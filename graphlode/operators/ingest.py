"""From parsed files to nodes, edges, item corpora and the manifest: selects, explodes and joins over one parsed table."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlode.config import NODE_TYPES
from graphlode.functions import text as tx
from graphlode.operators import graph
from graphlode.operators.bm25 import small

STEM = r"(?i)\.(md|mdx)\z"


def classify(parsed: DataFrame, products: DataFrame) -> DataFrame:
    """parsed with is_kb, product, product_name, version, is_latest, section (path parts), base, url, doc_id, tier."""
    p = F.col("parts")
    kb = F.col("parts")[0] == "kb"
    second = F.coalesce(F.get(p, F.lit(1)), F.lit("unknown"))
    df = parsed.withColumn("is_kb", kb).withColumn("base", F.regexp_replace(F.element_at(p, -1), STEM, ""))
    df = df.withColumn("raw", F.when(kb, second).otherwise(p[0])).withColumn("product", F.when(kb, F.regexp_replace(second, r"-\d+\z", "")).otherwise(p[0]))
    dim = small(products.select("id", "name", F.col("path").alias("dim_path"), F.col("default_version"), F.col("latest_version"), F.transform("versions", lambda v: v["version"]).alias("known")))
    names = dim.select(*[F.col(c).alias(f"raw_{c}") for c in dim.columns])
    df = df.join(dim, df["product"] == dim["id"], "left").join(names, df["raw"] == names["raw_id"], "left")
    given = F.get(p, F.lit(1))
    versioned = ~F.col("is_kb") & F.coalesce(F.array_contains("known", given), F.lit(False))
    inner = F.when(F.size(p) > 1, F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    deeper = F.slice(p, F.lit(3), F.greatest(F.size(p) - 3, F.lit(0)))
    df = df.withColumn("version", F.when(F.col("is_kb"), F.lit(None)).when(versioned, given).otherwise(F.col("default_version")))
    df = df.withColumn("section", F.when(F.col("is_kb") | versioned, deeper).otherwise(inner))
    df = df.withColumn("product_name", F.coalesce("name", F.when(F.col("is_kb"), F.col("raw_name")), F.when(F.col("is_kb"), F.col("raw")).otherwise(F.col("product"))))
    df = df.withColumn("is_latest", F.coalesce(~F.col("is_kb") & (F.col("version") == F.col("latest_version")), F.lit(False)))
    full = F.filter(F.concat(F.array(F.coalesce("dim_path", F.concat(F.lit("docs/"), F.col("product"))), F.coalesce(tx.version_to_url(F.col("version")), F.lit(""))), F.col("section"), F.array("base")), lambda x: x != "")
    kb_url = F.concat(F.lit("/kb/"), F.array_join(inner, "/"), F.lit("/"), "base")
    df = df.withColumn("url", F.when(F.col("is_kb"), kb_url).otherwise(F.concat(F.lit("/"), F.array_join(full, "/"))))
    ver = F.coalesce(F.nullif("version", F.lit("")), F.lit("current"))
    doc = F.concat(F.lit("doc:"), "product", F.lit("@"), ver, F.lit("/"), F.array_join(F.concat("section", F.array("base")), "/"))
    df = df.withColumn("doc_id", F.when(F.col("is_kb"), F.concat(F.lit("kb:"), F.array_join(F.concat(inner, F.array("base")), "/"))).otherwise(doc))
    df = df.withColumn("tier", F.when(F.col("is_kb"), "kb").otherwise("docs")).withColumn("graph_version", ver).withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "base"))
    ref = F.when(F.col("is_kb"), F.concat("product_name", F.lit(" KB — "), "title")).otherwise(F.concat("product_name", F.lit(" "), ver, F.lit(" — "), "title"))
    return df.withColumn("ref", ref).drop("id", "name", "raw", *[c for c in names.columns])


def scalar(key: str) -> Column:
    return F.get(F.try_element_at("data", F.lit(key)), F.lit(0))


def many(key: str) -> Column:
    return F.filter(F.coalesce(F.try_element_at("data", F.lit(key)), F.array().cast("array<string>")), lambda x: x != "")


def headings(docs: DataFrame) -> DataFrame:
    """A row for each heading: idx, its section, and its id (a repeated slug gets -2, -3 and so on)."""
    h = docs.select("*", F.posexplode("sections").alias("idx", "h"))
    s = F.coalesce(F.nullif(F.col("h.slug"), F.lit("")), tx.slug(F.col("h.text")))
    h = h.withColumn("slug", s)
    seen = F.size(F.filter(F.slice("sections", F.lit(1), F.col("idx") + 1), lambda x: F.coalesce(F.nullif(x["slug"], F.lit("")), tx.slug(x["text"])) == F.col("slug")))
    h = h.withColumn("slug", F.when(seen > 1, F.concat("slug", F.lit("-"), seen.cast("string"))).otherwise(F.col("slug")))
    return h.withColumn("head_id", F.concat(F.lit("head:"), "doc_id", F.lit("#"), "slug"))


def items(docs: DataFrame) -> DataFrame:
    """The three item corpora. row_idx orders rows by file, then by place in it."""
    none = F.lit(None).cast("string")
    common = ["tier", "product", "version"]
    order = F.struct("path").alias("o")
    d = docs.select(F.lit("doc").alias("lvl"), F.col("doc_id").alias("id"), F.when(F.col("is_kb"), "KBArticle").otherwise("Document").alias("type"), none.alias("doc_id"), *common, F.col("title").alias("label"), none.alias("title"), "ref", "url", F.lit(None).cast("array<string>").alias("heading_path"),
        tx.doc_embed_text(F.col("title"), scalar("description"), F.col("tier"), many("keywords"), many("tags"), F.filter(F.transform("headings", lambda x: x["text"]), lambda t: t != ""), F.col("preamble"), F.get("sections", F.lit(0))["body"]).alias("text"), order, F.lit(0).alias("i"))
    h = headings(docs)
    h = h.select(F.lit("heading").alias("lvl"), F.col("head_id").alias("id"), F.when(F.col("h.level") <= 2, "Heading").otherwise("Subheading").alias("type"), none.alias("doc_id"), *common, F.col("h.text").alias("label"), none.alias("title"), F.concat("ref", F.lit(" › "), F.col("h.text")).alias("ref"),
        F.when(F.col("url") != "", F.concat("url", F.lit("#"), "slug")).otherwise("").alias("url"), F.lit(None).cast("array<string>").alias("heading_path"), tx.heading_embed_text(F.col("title"), F.col("h.crumbs"), F.col("h.text"), F.col("h.body")).alias("text"), order, F.col("idx").alias("i"))
    c = docs.select("*", F.posexplode("chunks").alias("idx", "c"))
    c = c.select(F.lit("chunk").alias("lvl"), F.concat(F.lit("chunk:"), "doc_id", F.lit("#"), "idx").alias("id"), F.lit("Chunk").alias("type"), "doc_id", *common, F.col("title").alias("label"), "title", "ref", "url", F.col("c.heading_path").alias("heading_path"), F.col("c.text").alias("text"), order, F.col("idx").alias("i"))
    every = d.unionByName(h).unionByName(c)
    # ranges of (path, level, place) in order: ids of rows grow with it, without all rows meeting in one task
    return every.repartitionByRange("o", "lvl", "i").sortWithinPartitions("o", "lvl", "i").withColumn("row_idx", F.monotonically_increasing_id()).drop("o", "i")


def node_rows(docs: DataFrame, products: DataFrame, categories: DataFrame, images: bool = False) -> DataFrame:
    """id, type, attrs, seq of every node mention; merge_nodes() makes them nodes."""

    def rows(df: DataFrame, node: Column, kind: Column | str, step: int, **attrs: Column) -> DataFrame:
        pairs = [x for k, v in attrs.items() for x in (F.lit(k), v.cast("string"))]
        return df.select(node.alias("id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), F.create_map(*pairs).alias("attrs"), (F.col("seq") * 0 + F.lit(step)).alias("stage"), "seq")

    spark = docs.sparkSession
    root = spark.createDataFrame([(0,)], "seq bigint")
    cats = categories.select(F.col("name"), F.lit(0).cast("bigint").alias("seq"))
    prod = docs.groupBy("product").agg(F.min("seq").alias("seq")).join(products, F.col("product") == F.col("id"), "left")
    own = prod.select("seq", F.explode("categories").alias("name"))
    vers = docs.where(~F.col("is_kb")).groupBy("product", "graph_version").agg(F.min("seq").alias("seq"), F.first("product_name").alias("product_name"))
    vmeta = products.select(F.col("id").alias("vid"), F.explode("versions").alias("v")).select("vid", F.col("v.version").alias("vv"), F.col("v.is_latest").alias("latest"))
    vers = vers.join(vmeta, (F.col("vid") == F.col("product")) & (F.col("vv") == F.col("graph_version")), "left")
    chain = docs.select("is_kb", "product", "graph_version", "seq", F.explode(graph.prefixes(F.col("section"))).alias("pre"))
    kb, doc = docs.where("is_kb"), docs.where("NOT is_kb")
    tag = kb.select("seq", F.explode(many("tags")).alias("t"))
    kw = kb.select("seq", F.explode(many("keywords")).alias("t"))
    heads, chunks = headings(docs), docs.select("*", F.posexplode("chunks").alias("idx", "c"))
    desc = F.coalesce(scalar("description"), F.lit(""))
    parts = [
        rows(root, F.lit("root"), "Root", 0, label=F.lit("Documentation")),
        rows(cats.unionByName(own.select("name", "seq")), F.concat(F.lit("category:"), tx.slug(F.col("name"))), "Category", 1, label=F.col("name")),
        rows(prod, F.concat(F.lit("product:"), "product"), "Product", 2, label=F.coalesce("name", "product"), product_id=F.col("product"), description=F.coalesce("description", F.lit("")), categories=F.to_json("categories")),
        rows(vers, F.concat(F.lit("version:"), "product", F.lit("@"), "graph_version"), "Version", 3, label=F.concat("product_name", F.lit(" "), "graph_version"), product_id=F.col("product"), version=F.col("graph_version"), is_latest=F.coalesce("latest", F.lit(False))),
        rows(chain.where("NOT is_kb"), F.concat(F.lit("section:"), "product", F.lit("@"), "graph_version", F.lit("/"), F.array_join("pre", "/")), "Section", 4, label=F.element_at("pre", -1), product_id=F.col("product")),
        rows(kb.agg(F.min("seq").alias("seq")).where("seq IS NOT NULL"), F.lit("kbroot"), "KBRoot", 5, label=F.lit("Knowledge Base")),
        rows(chain.where("is_kb"), F.concat(F.lit("kbcat:"), "product", F.lit("/"), F.array_join("pre", "/")), "KBCategory", 6, label=F.element_at("pre", -1), product_id=F.col("product")),
        rows(kb, F.col("doc_id"), "KBArticle", 7, label=F.col("title"), product_id=F.col("product"), tier=F.col("tier"), url=F.col("url"), path=F.col("path"), description=desc, knowledge_article_id=F.coalesce(scalar("knowledge_article_id"), F.lit(""))),
        rows(doc, F.col("doc_id"), "Document", 7, label=F.col("title"), product_id=F.col("product"), version=F.col("graph_version"), tier=F.col("tier"), url=F.col("url"), path=F.col("path"), description=desc, sidebar_position=scalar("sidebar_position")),
        rows(tag, F.concat(F.lit("tag:"), tx.slug(F.col("t"))), "Tag", 8, label=F.col("t")),
        rows(kw, F.concat(F.lit("kw:"), tx.slug(F.col("t"))), "Keyword", 8, label=F.col("t")),
        rows(heads, F.col("head_id"), F.when(F.col("h.level") <= 2, "Heading").otherwise("Subheading"), 9, label=F.col("h.text"), level=F.col("h.level")),
        rows(chunks, F.concat(F.lit("chunk:"), "doc_id", F.lit("#"), "idx"), "Chunk", 10, idx=F.col("idx"), tokens=F.col("c.tokens")),
    ]
    if images:
        parts.append(rows(docs.select("seq", F.explode("images").alias("src")), F.concat(F.lit("img:"), "src"), "Image", 11, label=F.element_at(F.split("src", "/"), -1)))
    return reduce(DataFrame.unionByName, parts).select("id", "type", "attrs", F.struct("stage", "seq").alias("seq"))


def link_edges(docs: DataFrame) -> DataFrame:
    """src, dst of the links that resolve: by path or url, else with .md, else below docs/. A key that several documents claim is the last one's."""
    keys = F.array(F.regexp_replace("path", STEM, ""), F.col("path"), F.regexp_replace("url", "^/", ""))
    known = docs.select(F.explode(keys).alias("key"), "doc_id", "seq").groupBy("key").agg(F.max_by("doc_id", "seq").alias("to"))
    t = docs.select("doc_id", "seq", F.slice("parts", F.lit(1), F.size("parts") - 1).alias("dir"), F.posexplode("links").alias("at", "href")).select("doc_id", "seq", "at", tx.path_normalize(F.col("href"), F.col("dir")).alias("key"))
    tries = t.select("doc_id", "seq", "at", F.posexplode(F.array("key", F.concat("key", F.lit(".md")), F.concat(F.lit("docs/"), "key"))).alias("try", "key"))
    found = tries.join(known, "key").groupBy("doc_id", "seq", "at").agg(F.min_by("to", "try").alias("to"))
    return found.where("doc_id <> to").select(F.col("doc_id").alias("src"), F.col("to").alias("dst"), "seq", "at")


def next_edges(chunks: DataFrame) -> DataFrame:
    """src, dst, seq, idx: an edge from each chunk (doc_id, idx) to the next one of its document."""
    cid = lambda i: F.concat(F.lit("chunk:"), F.col("doc_id"), F.lit("#"), i)
    return chunks.where("idx > 0").select(cid(F.col("idx") - 1).alias("src"), cid(F.col("idx")).alias("dst"), "seq", "idx")


def edge_rows(docs: DataFrame, products: DataFrame, categories: DataFrame, images: bool = False) -> DataFrame:
    """src, dst, rel, seq of every edge mention; merge_edges() makes them edges."""

    def rows(df: DataFrame, src: Column, dst: Column, rel: Column | str, step: int, at: Column | None = None) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), (F.lit(rel) if isinstance(rel, str) else rel).alias("rel"), F.struct(F.col("seq").alias("seq"), F.lit(step).alias("stage"), (F.lit(0) if at is None else at).cast("int").alias("at")).alias("seq"))

    pid = F.concat(F.lit("product:"), "product")
    prod = docs.groupBy("product").agg(F.min("seq").alias("seq")).join(products.select("id", "categories"), F.col("product") == F.col("id"), "left")
    vid = F.concat(F.lit("version:"), "product", F.lit("@"), "graph_version")
    sec = lambda pre: F.concat(F.lit("section:"), F.col("product"), F.lit("@"), F.col("graph_version"), F.lit("/"), F.array_join(pre, "/"))
    cat = lambda pre: F.concat(F.lit("kbcat:"), F.col("product"), F.lit("/"), F.array_join(pre, "/"))
    chain = docs.select("is_kb", "product", "graph_version", "seq", F.posexplode(graph.prefixes(F.col("section"))).alias("at", "pre")).withColumn("up", F.slice("pre", F.lit(1), F.size("pre") - 1))
    kb, doc = docs.where("is_kb"), docs.where("NOT is_kb")
    top = F.size("section") == 0
    heads, chunks = headings(docs), docs.select("*", F.posexplode("chunks").alias("idx", "c"))
    cid = lambda i: F.concat(F.lit("chunk:"), F.col("doc_id"), F.lit("#"), i)
    near = F.col("h.level") <= 2
    cats = categories.select("name", F.lit(0).cast("bigint").alias("seq"))
    parts = [
        rows(cats, F.lit("root"), F.concat(F.lit("category:"), tx.slug(F.col("name"))), "CONTAINS", 0),
        rows(prod, F.lit("root"), pid, "CONTAINS", 1),
        rows(prod.select("product", "seq", F.posexplode("categories").alias("at", "name")), pid, F.concat(F.lit("category:"), tx.slug(F.col("name"))), "IN_CATEGORY", 2, F.col("at")),
        rows(doc, pid, vid, "HAS_VERSION", 3),
        rows(chain.where("NOT is_kb"), F.when(F.size("up") == 0, vid).otherwise(sec(F.col("up"))), sec(F.col("pre")), "HAS_SECTION", 4, F.col("at")),
        rows(doc, F.when(top, vid).otherwise(sec(F.col("section"))), F.col("doc_id"), "HAS_DOCUMENT", 5),
        rows(kb, F.lit("root"), F.lit("kbroot"), "CONTAINS", 3),
        rows(chain.where("is_kb"), F.when(F.size("up") == 0, F.lit("kbroot")).otherwise(cat(F.col("up"))), cat(F.col("pre")), "CONTAINS", 4, F.col("at")),
        rows(kb, F.when(top, F.lit("kbroot")).otherwise(cat(F.col("section"))), F.col("doc_id"), "CONTAINS", 5),
        rows(kb, F.col("doc_id"), pid, "ABOUT_PRODUCT", 6),
        rows(kb.select("doc_id", "seq", F.posexplode(many("tags")).alias("at", "t")), F.col("doc_id"), F.concat(F.lit("tag:"), tx.slug(F.col("t"))), "TAGGED", 7, F.col("at")),
        rows(kb.select("doc_id", "seq", F.posexplode(many("keywords")).alias("at", "t")), F.col("doc_id"), F.concat(F.lit("kw:"), tx.slug(F.col("t"))), "MENTIONS", 8, F.col("at")),
        rows(heads, F.col("doc_id"), F.col("head_id"), F.when(near, "HAS_HEADING").otherwise("HAS_SUBHEADING"), 9, F.col("idx")),
        rows(chunks, F.col("doc_id"), cid(F.col("idx")), "HAS_CHUNK", 11, F.col("idx")),
        rows(next_edges(chunks), F.col("src"), F.col("dst"), "NEXT", 12, F.col("idx")),
        rows(link_edges(docs), F.col("src"), F.col("dst"), "LINKS_TO", 13, F.col("at")),
    ]
    if images:
        parts.append(rows(docs.select("doc_id", "seq", F.posexplode("images").alias("at", "src")), F.col("doc_id"), F.concat(F.lit("img:"), "src"), "EMBEDS_IMAGE", 10, F.col("at")))
    return reduce(DataFrame.unionByName, parts)


def product_counts(docs: DataFrame, id_col: str = "product") -> DataFrame:
    """product, n_docs, n_kb, total, and versions as an array of (version, n), the largest product first."""
    per = docs.groupBy(id_col, "graph_version", "is_kb").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    versions = F.sort_array(F.collect_list(F.when(~F.col("is_kb"), F.struct("seq", F.col("graph_version").alias("version"), "n"))))
    out = per.groupBy(id_col).agg(F.sum(F.when(F.col("is_kb"), 0).otherwise(F.col("n"))).alias("n_docs"), F.sum(F.when(F.col("is_kb"), F.col("n")).otherwise(0)).alias("n_kb"), versions.alias("v"), F.min("seq").alias("seq"))
    return out.select(id_col, "n_docs", "n_kb", (F.col("n_docs") + F.col("n_kb")).alias("total"), F.transform("v", lambda x: F.struct(x["version"].alias("version"), x["n"].alias("n"))).alias("versions"), "seq").orderBy(F.desc("total"), "seq")


def manifest(docs: DataFrame, nodes: DataFrame, edges: DataFrame, corpora: DataFrame, categories: list[str], params: dict) -> dict:
    """A description of the build: every part is a small aggregate."""
    c = docs.agg(F.count("*").alias("files"), F.sum((~F.col("is_kb")).cast("int")).alias("documents"), F.sum(F.col("is_kb").cast("int")).alias("kb_articles"), F.sum(F.size("chunks")).alias("chunks"), F.sum(F.size("headings")).alias("headings"), F.sum(F.size("images")).alias("images")).first().asDict()
    by = {(r["kind"], r["name"]): r["n"] for r in graph.stats(nodes, edges).collect()}
    kinds = {k: {n: v for (kk, n), v in by.items() if kk == k} for k in ("node", "edge")}
    counts = {k: v or 0 for k, v in c.items()} | {"nodes": sum(kinds["node"].values()), "edges": sum(kinds["edge"].values()), "links": kinds["edge"].get("LINKS_TO", 0)}
    return {
        "name": "Documentation knowledge graph", "generatedAt": datetime.datetime.now(datetime.UTC).isoformat(), "params": params, "counts": counts,
        "graph": {"nodeTypes": kinds["node"], "edgeRelations": kinds["edge"], "schema": {"nodeTypes": list(NODE_TYPES)}},
        "levels": {r["lvl"]: {"items": r["count"]} for r in corpora.groupBy("lvl").count().collect()}, "categories": categories,
        "products": [{"id": r["product"], "docCount": r["n_docs"], "kbArticleCount": r["n_kb"], "versions": [v.asDict() for v in r["versions"]]} for r in product_counts(docs).drop("seq").collect()], "embedding": None,
    }
