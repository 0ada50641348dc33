"""Tunables, overridable by environment (GRAPHLODE_*) or by spark.graphlode.* settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    chunk_chars: int = 1280
    overlap_chars: int = 240
    min_chars: int = 64
    doc_chars: int = 1600
    heading_chars: int = 1000
    embed_batch: int = 64
    provider: str = "local"
    k1: float = 1.5
    b: float = 0.75
    candidates: int = 200
    rrf_k: int = 60

    @classmethod
    def load(cls, spark: SparkSession | None = None) -> Settings:
        given = {}
        for f in fields(cls):
            raw = os.environ.get(f"GRAPHLODE_{f.name.upper()}")
            if spark is not None:
                raw = spark.conf.get(f"spark.graphlode.{f.name}", raw)
            if raw is not None:
                given[f.name] = type(f.default)(raw)
        return cls(**given)


LEVELS = ("chunk", "doc", "heading")
SKIP_DIRS = (".git", "node_modules", "0-images", "images", "img", "assets", "static", "screenshots", ".docusaurus", "build", "__pycache__")
SKIP_FILES = ("CLAUDE.md",)
NODE_TYPES = ("Root", "Category", "Product", "Version", "Section", "Document", "Heading", "Subheading", "Chunk", "KBRoot", "KBCategory", "KBArticle", "Tag", "Keyword", "Image")
METRICS = ("mrr", "hit1", "hit5", "hit10", "recall10", "ndcg10")
