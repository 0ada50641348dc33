"""Text as Column expressions: all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M32 = 4294967295


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case; accented letters part tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def trim_all(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s﻿]+|[\s﻿]+\z", "")


def collapse(text: Column) -> Column:
    return trim_all(F.regexp_replace(text, r"(?U)\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trim_all(F.lower(text)), r"[^\w./@-]+", "-"), r"^-+|-+\z", "")


def slugify_heading(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"[`*_~]", ""), r"[^\w\s -]", "")
    return F.regexp_replace(trim_all(bare), r"(?U)\s+", "-")


def est_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


def cap(text: Column, n: int) -> Column:
    return F.substring(trim_all(text), 1, n)


def version_to_url(version: Column) -> Column:
    return F.replace(version, F.lit("."), F.lit("_"))


def doc_family(doc_id: Column) -> Column:
    """Without its first version segment, so that versions of a document share a group."""
    return F.regexp_replace(doc_id, r"^(.*?)@[^/]+/", "$1/")


def node_of_item(level: Column, item_id: Column) -> Column:
    chunk = F.regexp_replace(F.substring(item_id, 7, 1 << 30), r"#\d+\z", "")
    return F.when(level == "chunk", chunk).when(level == "heading", F.substring_index(F.substring(item_id, 6, 1 << 30), "#", 1)).otherwise(item_id)


def level_for_node(node: Column) -> Column:
    return F.when(node.startswith("chunk:"), "chunk").when(node.startswith("head:"), "heading").when(node.startswith("doc:") | node.startswith("kb:"), "doc")


def distinct_neighbours(items: Column) -> Column:
    """Without elements equal to the one before."""
    return F.filter(items, lambda x, i: (i == 0) | (x != F.try_element_at(items, F.greatest(i, F.lit(1)))))


def path_normalize(target: Column, dir_parts: Column) -> Column:
    """A link's target relative to the root: /docs/ or / taken off, otherwise . and .. resolved against the directory; no extension, no last slash."""
    t = trim_all(target)
    resolved = F.aggregate(
        F.split(t, "/"),
        dir_parts.cast("array<string>"),
        lambda st, g: F.when(g.isin("", "."), st).when(g == "..", F.slice(st, F.lit(1), F.greatest(F.size(st) - 1, F.lit(0)))).otherwise(F.concat(st, F.array(g))),
    )
    plain = F.when(t.startswith("/docs/"), F.substring(t, 7, 1 << 30)).when(t.startswith("/"), F.substring(t, 2, 1 << 30)).otherwise(F.array_join(resolved, "/"))
    return F.regexp_replace(F.regexp_replace(plain, r"(?i)\.(md|mdx)\z", ""), r"/\z", "")


def is_internal(href: Column) -> Column:
    return ~href.rlike(r"(?i)^(https?:|mailto:|tel:|#)") & (href.startswith("/") | href.startswith(".") | href.rlike(r"(?i)\.(md|mdx)(#|\z)"))


def fnv1a(token: Column) -> Column:
    """FNV-1a of 32 bits, for ASCII text, as a bigint."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(M32).cast("bigint")))


def doc_embed_text(title: Column, description: Column, tier: Column, keywords: Column, tags: Column, headings: Column, preamble: Column, first_body: Column, n: int = 1600) -> Column:
    """Title, description, keywords and tags (kb), the first 40 headings and the lead, a line each, capped."""
    none = F.lit(None).cast("string")

    def line(label: str, items: Column, sep: str) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, sep))).otherwise(none)

    kb = tier == "kb"
    lead = F.coalesce(F.nullif(preamble, F.lit("")), F.nullif(first_body, F.lit("")))
    lead = F.when(kb, cap(lead, 900)).otherwise(cap(lead, 600))
    lines = [F.nullif(title, F.lit("")), F.nullif(description, F.lit("")), F.when(kb, line("Keywords: ", keywords, ", ")), F.when(kb, line("Tags: ", tags, ", ")), line("Sections: ", F.slice(headings, 1, 40), " · "), F.nullif(lead, F.lit(""))]
    return cap(F.concat_ws("\n", *lines), n)


def heading_embed_text(title: Column, crumbs: Column, heading: Column, body: Column, n: int = 1000) -> Column:
    parts = F.filter(F.concat(F.array(title), crumbs, F.array(heading)), lambda x: x.isNotNull() & (x != ""))
    head = F.array_join(distinct_neighbours(parts), " › ")
    whole = F.concat(head, F.lit("\n"), cap(F.coalesce(body, F.lit("")), n))
    return trim_all(F.substring(trim_all(whole), F.lit(1), F.length(head) + n + 1))
