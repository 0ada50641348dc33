"""The property graph as two tables: merge, neighbours, statistics, shortest path, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlode.operators.bm25 import small
from graphlode.operators.tables import stored


def merge_nodes(rows: DataFrame) -> DataFrame:
    """One row an id: type and place are those of the first row, other attributes those of the last row that has them.

    A row's attributes are a map; a key with a null value does overwrite, an absent key doesn't."""
    kept = rows.groupBy("id").agg(F.min_by("type", "seq").alias("type"), F.min("seq").alias("seq"))
    attrs = rows.select("id", "seq", F.explode("attrs").alias("k", "v")).groupBy("id", "k").agg(F.max_by(F.struct("v"), "seq")["v"].alias("v"))
    maps = attrs.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("attrs"))
    return kept.join(maps, "id", "left")


def merge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges (first seq) both of whose ends exist. Edges are exchanged by their source, where they are made distinct too, and by their end."""
    ids = hashed(nodes.select("id"))
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    once = kept.groupBy("src", "dst", "rel").agg(F.min("seq").alias("seq"))
    return once.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "rel", "seq")


def hashed(df: DataFrame) -> DataFrame:
    """df, the smaller side of a join, with a hint: broadcast if a count finds it small, else hashed partition by partition, so that the other side needs no sort."""
    known = small(df)
    return known if known is not df else df.hint("shuffle_hash")


def neighbors(edges: DataFrame, node: str, direction: str = "out", rel: str | None = None) -> DataFrame:
    """id, rel, dir of the neighbours; any direction but out and in means both."""
    e = edges if rel is None else edges.where(F.col("rel") == rel)
    out = e.where(F.col("src") == node).select(F.col("dst").alias("id"), "rel", F.lit("out").alias("dir"), "seq")
    into = e.where(F.col("dst") == node).select(F.col("src").alias("id"), "rel", F.lit("in").alias("dir"), "seq")
    return {"out": out, "in": into}.get(direction, out.unionByName(into)).orderBy(F.desc("dir"), "seq")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node or edge), name, n."""
    return nodes.groupBy(F.col("type").alias("name")).count().select(F.lit("node").alias("kind"), "name", F.col("count").alias("n")).unionByName(
        edges.groupBy(F.col("rel").alias("name")).count().select(F.lit("edge").alias("kind"), "name", F.col("count").alias("n")))


def node(nodes: DataFrame, id_: str) -> dict | None:
    """A node's attributes, None if there is no such node."""
    row = nodes.where(F.col("id") == id_).first()
    return row.asDict(recursive=True) if row else None


def has_node(nodes: DataFrame, id_: str) -> bool:
    return not nodes.where(F.col("id") == id_).isEmpty()


def shortest_path(nodes: DataFrame, edges: DataFrame, a: str, b: str, max_hops: int | None = None) -> list[str] | None:
    """Ids from a to b over edges of either direction, or None (also if more than max_hops edges are needed, where that is given).

    Frontiers grow from both ends, the one with fewer nodes first, until they meet; each round reads the edges once and exchanges none while its frontier is small.
    Of the paths that are as short, each node's predecessor is the one with the first edge, as in a search from a alone."""
    if nodes.where(F.col("id").isin(a, b)).select("id").distinct().count() < len({a, b}):
        return None
    if a == b:
        return [a]
    spark = edges.sparkSession
    start = [stored(spark.createDataFrame([(x, None)], "id string, parent string"), "bfs") for x in (a, b)]
    layers, sizes, seen, links = [[start[0]], [start[1]]], [1, 1], [x.select("id") for x in start], []
    while True:
        if max_hops is not None and len(layers[0]) + len(layers[1]) - 1 > max_hops:
            return None
        side = int(sizes[1] < sizes[0])
        fresh = touching(edges, layers[side][-1].select(F.col("id").alias("u"))).join(small(seen[side].withColumnRenamed("id", "v")), "v", "left_anti")
        if side:  # which of these edges lie on the way is known when the frontiers meet
            links.append(stored(fresh, "bfs-edges"))
            layer = links[-1].select(F.col("v").alias("id")).distinct()
        else:
            layer = first_edges(fresh)
        layer = stored(layer, "bfs")
        layers[side].append(layer)
        if not (n := layer.count()):
            return None
        sizes[side], seen[side] = n, seen[side].unionByName(layer.select("id"))
        on = layers[0][-1].select("id").join(layers[1][-1].select("id"), "id", "left_semi")
        if not on.isEmpty():
            break
    # from where they met towards b: of each node between, the first edge from a node that lies on a shortest path too
    steps = layers[0][1:]
    for link in reversed(links):
        back = link.join(small(stored(on, "bfs").withColumnRenamed("id", "v")), "v", "left_semi")
        turned = back.select(F.col("v").alias("u"), F.col("u").alias("v"), (1 - F.col("way")).alias("way"), "seq")
        steps.append(stored(first_edges(turned), "bfs"))
        on = steps[-1].select("id")
    path = [b]
    for step in reversed(steps):  # one point lookup for each hop
        path.append(step.where(F.col("id") == path[-1]).first()["parent"])
    return path[::-1]


def first_edges(steps: DataFrame) -> DataFrame:
    """id, parent: where each end of the steps(u, v, way, seq) is come from by its first edge."""
    return steps.groupBy(F.col("v").alias("id")).agg(F.min(F.struct("way", "seq", "u"))["u"].alias("parent"))


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """u, v, way, seq of all edges with an end u in ids(u); way is 0 if u is the source."""
    e, known = edges.select("src", "dst", "seq"), small(ids)
    ways = [("src", "dst", 0), ("dst", "src", 1)]
    if known is not ids:  # one pass; edges that touch none go no further
        for x, _, way in ways:
            e = e.join(known.withColumnRenamed("u", f"u{way}_"), F.col(x) == F.col(f"u{way}_"), "left")
        e = e.where("u0_ IS NOT NULL OR u1_ IS NOT NULL")
        both = F.array(*[F.when(F.col(f"u{way}_").isNotNull(), F.struct(F.col(x).alias("u"), F.col(y).alias("v"), F.lit(way).alias("way"), "seq")) for x, y, way in ways])
        return e.select(F.explode(F.array_compact(both)).alias("s")).select("s.*")
    parts = [e.join(ids, F.col(x) == F.col("u")).select("u", F.col(y).alias("v"), F.lit(way).alias("way"), "seq") for x, y, way in ways]
    return parts[0].unionByName(parts[1])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, root: the least id of each node's connected component. Labels spread to neighbours and jump to their label's label."""
    # the pairs may be costly: they are computed once, each way of an edge is a row of the same pass
    ways = F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v"))))
    both = stored(edges.select(ways.alias("e")).select("e.*"), "edges")
    labels = stored(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("id")).alias("root")), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["id"]).groupBy("u").agg(F.min("root").alias("near"))
        step = labels.join(near, labels["id"] == near["u"]).select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        new = stored(step.join(step.select(F.col("id").alias("at"), F.col("root").alias("next")), F.col("root") == F.col("at")).select("id", "old", F.least("root", "next").alias("root")), "labels")
        if new.where("old <> root").isEmpty():
            return new.select("id", "root")
        labels = new.select("id", "root")


def prefixes(parts: Column) -> Column:
    """All prefixes of an array of path parts."""
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.slice(parts, F.lit(1), n))).otherwise(F.array().cast("array<array<string>>"))
