"""Embedding providers: a registry of functions from texts to vectors, applied in Arrow batches."""

from __future__ import annotations

import json
import os
import re
import urllib.error
import urllib.request
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlode.functions import text as tx
from graphlode.functions.rng import fnv1a_py
from graphlode.functions.vector import l2_normalize

#: Providers that were registered: dimensions (None: those of what comes back) and function from a list of texts to a list of vectors.
PROVIDERS: dict[str, tuple[int | None, Callable[[list[str]], list] | None]] = {}
#: Services with a REST interface: address, environment variable of the key, most texts of a request.
REST = {
    "openai": ("https://api.openai.com/v1/embeddings", "OPENAI_API_KEY", 2048),
    "voyage": ("https://api.voyageai.com/v1/embeddings", "VOYAGE_API_KEY", 1000),
}
MODELS = {"local": "all-MiniLM-L6-v2", "openai": "text-embedding-3-small", "voyage": "voyage-3.5-lite", "hash": "hash-256"}
DIMENSIONS = {"hash": 256, "local": 384, "openai": 1536, "voyage": 1024}


def register(name: str, dim: int | None, fn: Callable[[list[str]], list]) -> None:
    """A provider for embed(): local models and other clients plug in here."""
    PROVIDERS[name] = (dim, fn)


def dimensions(provider: str, model: str | None = None) -> int:
    """The length of a provider's vectors; the large model of the first service has twice as many."""
    if provider in PROVIDERS and PROVIDERS[provider][0]:
        return PROVIDERS[provider][0]
    return 3072 if provider == "openai" and "3-large" in (model or "") else DIMENSIONS.get(provider, 384)


def rest_client(provider: str, model: str, kind: str = "document", url: str | None = None) -> Callable[[list[str]], list]:
    """A function that posts texts to a service and gives their vectors in the order of the texts. The key is read here, on the driver."""
    address, variable, _ = REST[provider]
    address, key = url or os.environ.get(f"GRAPHLODE_{provider.upper()}_URL", address), os.environ.get(variable)
    if not key:
        raise ValueError(f"{variable} isn't set (provider {provider!r})")

    def vectors(texts: list[str]) -> list:
        body = {"model": model, "input": texts} | ({"input_type": kind} if provider == "voyage" else {})
        request = urllib.request.Request(address, json.dumps(body).encode(), {"content-type": "application/json", "authorization": f"Bearer {key}"})
        try:
            with urllib.request.urlopen(request, timeout=120) as r:
                data = json.load(r)["data"]
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"{provider} embeddings: {e.code}: {e.read()[:500].decode('utf-8', 'replace')}") from None
        return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]

    return vectors


def hash_buckets(df: DataFrame, key: str, text: Column, dim: int = 256) -> DataFrame:
    """key, bucket, weight: a token adds 1 to its bucket; tokens longer than 4 add half to those of their first and last four letters."""
    t = df.select(key, F.explode(tx.tokens(text)).alias("t"))
    long = F.length("t") > 4
    grams = F.array(F.struct(F.col("t").alias("g"), F.lit(1.0).alias("w")))
    more = F.array(F.struct(F.substring("t", 1, 4).alias("g"), F.lit(0.5).alias("w")), F.struct(F.right("t", F.lit(4)).alias("g"), F.lit(0.5).alias("w")))
    rows = t.select(key, F.explode(F.when(long, F.concat(grams, more)).otherwise(grams)).alias("e"))
    return rows.groupBy(key, F.pmod(tx.fnv1a(F.col("e.g")), F.lit(dim)).cast("int").alias("bucket")).agg(F.sum("e.w").alias("weight"))


def hash_vector(text: Column, dim: int = 256) -> Column:
    """The hash embedding of a text as one expression, for literals and for any row: unit length, floats."""
    t = tx.tokens(text)
    long = F.filter(t, lambda x: F.length(x) > 4)
    parts = F.concat(F.transform(t, lambda x: F.struct(x.alias("g"), F.lit(1.0).alias("w"))), F.transform(long, lambda x: F.struct(F.substring(x, 1, 4).alias("g"), F.lit(0.5).alias("w"))), F.transform(long, lambda x: F.struct(F.right(x, F.lit(4)).alias("g"), F.lit(0.5).alias("w"))))
    placed = F.transform(parts, lambda p: F.struct(F.pmod(tx.fnv1a(p["g"]), F.lit(dim)).cast("int").alias("b"), p["w"].alias("w")))
    return l2_normalize(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(placed, lambda p: p["b"] == i), F.lit(0.0), lambda s, p: s + p["w"])))


@lru_cache(maxsize=200_000)
def places(token: str, dim: int) -> tuple[int, ...]:
    """The buckets of a token, and of its first and last four letters (0 if it isn't longer). A worker keeps those of the tokens it saw last."""
    return tuple(fnv1a_py(g) % dim for g in (token, token[:4], token[-4:])) if len(token) > 4 else (fnv1a_py(token) % dim, 0, 0)


def hash_embed_py(texts: list[str], dim: int = 256) -> list[np.ndarray]:
    """Hash embeddings of a batch: each distinct token is hashed once, buckets of all texts are counted at once."""
    found = [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]
    place = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(found)))}
    at = np.array([places(w, dim) for w in place], np.int64).reshape(-1, 3)
    weight = np.where(np.fromiter(map(len, place), np.int64, len(place))[:, None] > 4, [1.0, 0.5, 0.5], [1.0, 0.0, 0.0])
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in found])
    ids = np.fromiter(map(place.__getitem__, chain.from_iterable(found)), np.int64, len(owner))
    bucket = (owner[:, None] * dim + at[ids]).ravel() if len(ids) else np.zeros(0, np.int64)
    v = np.bincount(bucket, weight[ids].ravel() if len(ids) else None, len(texts) * dim).reshape(len(texts), dim)
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return list((v / np.where(norm > 0, norm, 1)).astype(np.float32))


def embed(items: DataFrame, provider: str = "hash", model: str | None = None, batch: int = 64, kind: str = "document") -> DataFrame:
    """lvl, id, row_idx, provider, model, dim, embedding of items(lvl, id, row_idx, text). kind: document or query, for services that tell them apart."""
    model = model or MODELS.get(provider, provider)
    if provider == "hash":
        fn = hash_embed_py
    elif provider in PROVIDERS:
        fn = PROVIDERS[provider][1]
    elif provider in REST:
        fn, batch = rest_client(provider, model, kind), min(batch, REST[provider][2])
    elif provider == "local":
        raise ValueError("provider 'local' has no model here: register() a function of it")
    else:
        raise ValueError(f"unknown provider {provider!r}: one of {sorted({*DIMENSIONS, *PROVIDERS})}")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(texts: pd.Series) -> pd.Series:
        found = []
        for i in range(0, len(texts), batch):
            found += [np.asarray(v, np.float32) for v in fn([t or "" for t in texts[i : i + batch]])]
        if provider != "hash":
            found = [v / (np.sqrt(float(v @ v)) or 1) for v in found]
        return pd.Series(found)

    out = items.select("lvl", "id", "row_idx", F.lit(provider).alias("provider"), F.lit(model).alias("model"), vectors("text").alias("embedding"))
    return out.select("lvl", "id", "row_idx", "provider", "model", F.size("embedding").alias("dim"), "embedding")
