"""Labelled queries from the graph's own tables: fields of an article are queries whose gold is the article, or the documents it links to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlode.functions import text as tx
from graphlode.operators.bm25 import small
from graphlode.operators.graph import hashed

FIELDS = ("title", "description", "keywords", "symptom")
ORDER = {f: i for i, f in enumerate(("title", "description", "keywords", "tags", "symptom", "heading"))}
SYMPTOM = r"(?i)^(symptom|symptoms|issue|problem|question)\b"


def symptoms(heading_items: DataFrame) -> DataFrame:
    """id, text: the body of each article's first symptom heading, its breadcrumb line dropped, collapsed, 600 characters."""
    rows = heading_items.where((F.col("tier") == "kb") & F.col("label").rlike(SYMPTOM))
    body = tx.collapse(F.array_join(F.slice(F.split("text", "\n"), F.lit(2), F.greatest(F.size(F.split("text", "\n")), F.lit(1))), " "))
    rows = rows.select(tx.node_of_item(F.lit("heading"), F.col("id")).alias("id"), "row_idx", body.alias("text")).where("text <> ''")
    return rows.groupBy("id").agg(F.substring(F.min_by("text", "row_idx"), 1, 600).alias("text"))


def joined_labels(nodes: DataFrame, edges: DataFrame, rel: str) -> DataFrame:
    """id, text: labels of the nodes an article points to by rel, in order of the edges."""
    e = edges.where(F.col("rel") == rel).join(hashed(nodes.select(F.col("id").alias("dst"), "label").where("label <> ''")), "dst")
    e = e.select("src", "seq", "label").repartition("src")  # lists don't shrink before the exchange
    return e.groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "label"))), lambda x: x["label"]), " ").alias("text"))


def build(nodes: DataFrame, edges: DataFrame, heading_items: DataFrame | None = None, target: str = "kb", gold: str = "self", fields: tuple[str, ...] = FIELDS, product: str | None = None) -> DataFrame:
    """qid, query, field, golds, grp, product, target_tier, seq; numbered in order of node and field."""
    kind = {"kb": "KBArticle", "doc": "Document"}.get(target)
    if kind is None:
        raise ValueError(f"unknown label target {target!r}")
    base = nodes.where(F.col("type") == kind).withColumn("product_id", F.coalesce(F.nullif("product_id", F.lit("")), F.lit("?")))
    if product:
        base = base.where(F.col("product_id") == product)
    if target == "kb" and gold == "link":
        docs = nodes.where(F.col("type") == "Document").select(F.col("id").alias("dst"))
        linked = edges.where(F.col("rel") == "LINKS_TO").join(docs, "dst", "left_semi").groupBy(F.col("src").alias("id"))
        base = base.join(linked.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "dst"))), lambda x: x["dst"]).alias("golds")), "id").withColumn("target_tier", F.lit("docs"))
    else:
        base = base.withColumn("golds", F.array("id")).withColumn("target_tier", F.lit("kb" if target == "kb" else "docs"))
    base = base.withColumn("grp", F.col("id") if target == "kb" else tx.doc_family(F.col("id"))).withColumnRenamed("seq", "node_seq")
    cols = ["golds", "grp", F.col("product_id").alias("product"), "target_tier", "node_seq"]

    def of(df: DataFrame, field: str, text: Column, at: Column | None = None) -> DataFrame:
        return df.select(tx.collapse(F.coalesce(text, F.lit(""))).alias("query"), F.lit(field).alias("field"), *cols, F.struct(F.lit(ORDER[field]).alias("f"), (F.lit(0) if at is None else at).cast("bigint").alias("at")).alias("place"))

    parts = []
    if "title" in fields:
        parts.append(of(base, "title", F.col("label")))
    if target == "kb":
        if "description" in fields:
            parts.append(of(base, "description", F.col("description")))
        for field, rel in (("keywords", "MENTIONS"), ("tags", "TAGGED")):
            if field in fields:
                parts.append(of(base.join(joined_labels(nodes, edges, rel), "id"), field, F.col("text")))
        if "symptom" in fields and heading_items is not None:
            parts.append(of(base.join(symptoms(heading_items), "id"), "symptom", F.col("text")))
    elif {"heading", "headings"} & set(fields):
        h = edges.where(F.col("rel") == "HAS_HEADING").select(F.col("src").alias("id"), "dst", F.col("seq").alias("edge_seq"))
        h = h.join(nodes.select(F.col("id").alias("dst"), F.col("label").alias("text")), "dst")
        h = h.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("edge_seq", "dst")))
        parts.append(of(base.join(h, "id"), "heading", F.col("text"), F.col("at")))
    if not parts:
        raise ValueError(f"no field of {fields} belongs to target {target!r}")
    rows = reduce(DataFrame.unionByName, parts).where((F.col("query") != "") & (F.size("golds") > 0))
    numbered = numbered_rows(rows, "node_seq", "grp", "place")
    return numbered.select(F.concat_ws(":", F.col("seq").cast("string"), "field", "grp").alias("qid"), "query", "field", "golds", "grp", "product", "target_tier", "seq")


def numbered_rows(df: DataFrame, *order: str) -> DataFrame:
    """df with seq, 0 and up in the given order: ranges are sorted apart and shifted by the sizes of those before, so rows never meet in one task."""
    from graphlode.operators.tables import stored

    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id()).withColumn("in_part_", F.monotonically_increasing_id()), "numbered")
    sizes = ranged.groupBy("part_").agg(F.count("*").alias("n_"))
    shifts = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("shift_"))  # a row for each partition
    w = Window.partitionBy("part_").orderBy("in_part_")
    return ranged.join(F.broadcast(shifts), "part_").withColumn("seq", F.row_number().over(w) - 1 + F.col("shift_")).drop("part_", "in_part_", "shift_")


def passages(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """qid, doc_id: the documents whose text holds a passage(qid, passage) as it stands.

    Both sides are cut into words at ASCII white space. A word that stands wholly inside a passage (not its first or last) is in any text that holds it, so the
    longest such word of each passage is a join key, and only texts that have it are searched; passages without one are compared with every text."""
    ws = r"[\x20\x09-\x0D]+"
    inner = F.filter(F.slice(F.split("passage", ws), F.lit(2), F.greatest(F.size(F.split("passage", ws)) - 2, F.lit(0))), lambda w: w != "")
    keyed = wanted.withColumn("key", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    # of the documents' words only those that are a key travel, with their id; a text is read again for the pairs that met
    keys = small(keyed.where("key IS NOT NULL").select("key").distinct())
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", ws))).alias("key")).join(keys, "key", "left_semi")
    met = words.join(keyed.where("key IS NOT NULL"), "key").select("qid", "passage", "doc_id").join(docs, "doc_id")
    rest = docs.join(small(keyed.where("key IS NULL").drop("key")), F.lit(True)).select("qid", "passage", "doc_id", "text")
    return met.select("qid", "passage", "doc_id", "text").unionByName(rest).where(F.contains("text", "passage")).select("qid", "doc_id").distinct()


def stats(labels: DataFrame) -> DataFrame:
    """kind (product, field, records or groups), name, n."""
    by = [labels.groupBy(F.col(k).alias("name")).count().select(F.lit(k).alias("kind"), "name", F.col("count").alias("n")) for k in ("product", "field")]
    total = labels.agg(F.count("*").alias("records"), F.count_distinct("grp").alias("groups"))
    whole = total.select(F.expr("stack(2, 'records', '', records, 'groups', '', groups) AS (kind, name, n)"))
    return by[0].unionByName(by[1]).unionByName(whole)
