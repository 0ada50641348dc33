"""Command line: build, ingest, embed, stats, manifest, node, neighbors, path, search, similar, cluster, labels, eval, tune."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphlode.operators import graph, labels, ranking
from graphlode.plans import build, evaluation
from graphlode.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphlode", description=__doc__)
    p.add_argument("--out", default="out", help="folder of the built tables")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: tuple, aliases: tuple[str, ...] = ()) -> None:
        s = sub.add_parser(name, aliases=list(aliases))
        for names, kw in flags:
            s.add_argument(*names.split(), **kw)

    tree = [("--docs", {"required": True}), ("--products", {"required": True}), ("--categories", {"nargs": "*", "default": []}), ("--product", {"action": "append"}), ("--limit", {"type": int, "default": 0}), ("--images", {"action": "store_true"})]
    emb = [("--provider", {"default": "hash"}), ("--model", {})]
    where = [("--tier", {}), ("--product", {})]
    lab = [("--target", {"default": "kb"}), ("--gold", {"default": "self"}), ("--fields", {"default": ",".join(labels.FIELDS)}), ("--product", {}), ("--labels", {})]
    k = ("-k", {"type": int, "default": 8})
    add("build", *tree, *emb)
    add("ingest", *tree)
    add("embed", *emb, ("--levels", {"default": "chunk,doc,heading"}))
    add("stats")
    add("manifest")
    add("node", ("id", {}))
    add("neighbors", ("id", {}), ("--rel", {}), ("--dir", {"default": "both"}), aliases=("neighbours",))
    add("path", ("a", {}), ("b", {}))
    add("search", ("text", {}), ("--level", {"default": "chunk"}), *where, k)
    add("similar", ("id", {}), ("--level", {}), ("--cross-tier", {"action": "store_true"}), ("--product", {}), k)
    add("cluster", ("--level", {"default": "doc"}), *where, ("--threshold", {"type": float, "default": 0.55}), ("--cap", {"type": int, "default": 2500}), ("--top", {"type": int, "default": 25}))
    add("labels", *lab)
    rank = [("--level", {"default": "doc"}), ("--signal", {"default": "rrf"}), ("--alpha", {"type": float, "default": 0.5}), ("--rrfK", {"type": int, "default": 60}), ("--pool", {"default": "max"}), ("--candN", {"type": int, "default": 200})]
    add("eval", *lab, *rank)
    add("tune", *lab, ("--levels", {"default": "doc,chunk"}), ("--signals", {"default": "vector,bm25,rrf"}), ("--pools", {"default": "max,mean"}), ("--alphas", {"default": "0.5"}), ("--candN", {"type": int, "default": 200}), ("--metric", {"default": "mrr"}),
        ("--cv", {"type": int, "default": 5}), ("--holdout", {"type": float, "default": 0}), ("--lopo", {"action": "store_true"}), ("--final-holdout", {"type": float, "default": 0}), ("--seed", {"type": int, "default": 1}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphlode").getOrCreate()
    base, cmd = build.Base(spark, a.out), a.command
    if cmd in ("build", "ingest"):
        dim = files.products(spark, a.products)
        told = build.run_ingest(spark, a.docs, dim, a.categories, a.out, a.product, a.limit, a.images)
        if cmd == "build":
            told = build.run_embed(spark, a.out, a.provider, model=a.model)
        print(json.dumps(told["counts"], indent=2))
    elif cmd == "embed":
        print(json.dumps(build.run_embed(spark, a.out, a.provider, tuple(a.levels.split(",")), a.model)["levels"], indent=2))
    elif cmd == "stats":
        graph.stats(base.table("nodes"), base.table("edges")).orderBy("kind", F.desc("n"), "name").show(100, False)
    elif cmd == "manifest":
        print(json.dumps(files.load_text(spark, a.out, "manifest"), indent=2, ensure_ascii=False))
    elif cmd == "node":
        if found := graph.node(base.table("nodes"), a.id):
            print(json.dumps({k: v for k, v in found.items() if v is not None and k != "seq"}, indent=2, ensure_ascii=False))
        graph.neighbors(base.table("edges"), a.id, "both").show(25, False)
    elif cmd in ("neighbors", "neighbours"):
        graph.neighbors(base.table("edges"), a.id, a.dir, a.rel).select("id", "rel", "dir").show(200, False)
    elif cmd == "path":
        found = graph.shortest_path(base.table("nodes"), base.table("edges"), a.a, a.b)
        print(" -> ".join(found) if found else "no path")
    elif cmd == "search":
        base.retrieve(a.text, a.level, a.k, a.tier, a.product).select("rank", "score", "id", "ref", "url", F.substring("text", 1, 200).alias("snippet")).show(a.k, False)
    elif cmd == "similar":
        base.similar(a.id, a.k, a.cross_tier, a.product, a.level).select("score", "id", "ref").show(a.k, False)
    elif cmd == "cluster":
        n, found, alone = base.cluster(a.level, a.tier, a.product, a.threshold, a.cap, a.top)
        print(f"{n} items, {alone} alone")
        found.show(a.top, False)
    else:
        lab = files.labels_json(spark, a.labels) if a.labels else base.labels(a.target, a.gold, tuple(a.fields.split(",")), a.product)
        if cmd == "labels":
            files.save_labels(lab, f"{a.out}/labels.{a.target}")
            labels.stats(lab).show(100, False)
        elif cmd == "eval":
            grid = ranking.expand_grid((a.level,), (a.signal,), (a.pool,), (a.alpha,), a.rrfK)
            configs = spark.createDataFrame(grid, ranking.CONFIG)
            for name, df in evaluation.evaluate(base.gather(lab, [a.level], a.candN), lab, configs).items():
                if name != "rows":
                    print(name)
                    df.show(50, False)
        else:
            grid = ranking.expand_grid(a.levels.split(","), a.signals.split(","), a.pools.split(","), [float(x) for x in a.alphas.split(",")])
            configs = spark.createDataFrame(grid, ranking.CONFIG)
            got = evaluation.tune(base.gather(lab, a.levels.split(","), a.candN), lab, configs, a.metric, a.cv, a.holdout, a.lopo, a.final_holdout, seed=a.seed)
            print(got["scheme"])
            got["leaderboard"].orderBy("rank").show(100, False)
            if got["final"]:
                print("final holdout:", got["final"]["key"])
                got["final"]["overall"].show(50, False)


if __name__ == "__main__":
    main()
