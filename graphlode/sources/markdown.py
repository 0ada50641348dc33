"""Markdown as data: front matter, headings, sections, links, images and passages of each file, in one pass over its lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from graphlode.config import Settings
from graphlode.schemas import PARSED

HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*#*\s*\Z")
KEY_LINE = re.compile(r"([A-Za-z_][A-Za-z0-9_-]*):\s?(.*)\Z", re.S)
LINK = re.compile(r'\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)')
IMAGE = re.compile(r"!\[[^\]]*\]\(([^)\s]+)")
IMG_TAG = re.compile(r"<img[^>]+src=[\"']([^\"']+)[\"']", re.I)
OUTSIDE = re.compile(r"(https?:|mailto:|tel:|#)", re.I)
MD_END = re.compile(r"\.(md|mdx)(#|\Z)", re.I)
NEWLINE = re.compile(r"\r?\n")
#: Bytes of text that are parsed at a time.
SLICE = 1 << 20


def front_matter(source: str) -> tuple[dict[str, list[str]], str]:
    """Values by key (a scalar is a list of one) and the body. Without an end mark all is body."""
    end = source.find("\n---", 3) if source.startswith("---") else -1
    if end < 0:
        return {}, source
    return values(re.sub(r"\A\r?\n", "", source[3:end])), re.sub(r"\A\r?\n", "", source[end + 4 :])


def unquote(v: str) -> str:
    v = v.strip()
    quoted = len(v) > 1 and v[0] == v[-1] and v[0] in "\"'"
    return v[1:-1] if quoted else ("" if v in ("'", '"') else v)


def values(raw: str) -> dict[str, list[str]]:
    """A subset of YAML: scalars, [inline] and indented lists, folded and literal blocks. Scalars stay strings."""
    found: dict[str, list[str]] = {}
    key, block, held, in_list = None, "", [], False

    def close() -> None:
        if key and block:
            found[key] = [" ".join(held).strip() if block == ">" else "\n".join(held)]

    for line in NEWLINE.split(raw):
        if not line.strip():
            if block == "|":
                held.append("")
            continue
        item = re.match(r"\s+-\s+(.*)\Z", line)
        if item and key and (in_list or key not in found):
            if not in_list:
                found[key], in_list, block = [], True, ""
            found[key].append(unquote(item[1]))
            continue
        inner = re.match(r"\s+(\S.*)\Z", line)
        if inner and block:
            held.append(inner[1])
            continue
        pair = KEY_LINE.match(line)
        if not pair:
            continue
        close()
        key, block, held, in_list = pair[1], "", [], False
        v = pair[2]
        if v[:1] in (">", "|"):
            block = v[0]
        elif v.startswith("[") and v.endswith("]"):
            found[key] = [x for x in map(unquote, v[1:-1].split(",")) if x]
        elif v:
            found[key] = [unquote(v)]
        # an empty value leaves the key absent: an indented list may follow
    close()
    return found


def plain_heading(raw: str) -> str:
    return re.sub(r"[`*_]", "", raw).strip()


def heading_slug(text: str) -> str:
    bare = re.sub(r"[^A-Za-z0-9_\s-]", "", re.sub(r"[`*_~]", "", text.lower()))
    return re.sub(r"\s+", "-", bare.strip())


def internal(href: str) -> bool:
    return not OUTSIDE.match(href) and (href[0] in "/." or bool(MD_END.search(href)))


def blocks(body: str) -> Iterator[tuple[tuple[int, str] | None, list[str], list[str]]]:
    """(level and text of the heading or None, crumbs of its ancestors, lines up to the next heading), first the preamble. Fences hide headings."""
    head, crumbs, stack, lines, fenced = None, [], [], [], False
    for line in NEWLINE.split(body):
        if re.match("```|~~~", line.strip()):
            fenced = not fenced
        elif not fenced and (m := HEADING.match(line)):
            yield head, crumbs, lines
            level, text = len(m[1]), plain_heading(m[2])
            stack = [c for c in stack if c[0] < level]
            crumbs = [c[1] for c in stack]
            head, lines = (level, text), []
            stack.append(head)
            continue
        lines.append(line)
    yield head, crumbs, lines


def windows(text: str, most: int, overlap: int) -> list[str]:
    """Paragraphs packed up to most characters, each window opening with the end of the one before; longer paragraphs are cut with overlap."""
    if len(text) <= most:
        return [text]
    out, now = [], ""
    for para in re.split(r"\n{2,}", text):
        if len(para) > most:
            out += [now] if now else []
            out += [para[i : i + most] for i in range(0, len(para), most - overlap)]
            now = ""
        elif len(now) + 2 + len(para) > most:
            out += [now] if now else []
            now = "\n\n".join(filter(None, (now[max(0, len(now) - overlap) :], para)))
        else:
            now = f"{now}\n\n{para}" if now else para
    return out + ([now] if now else [])


def passages(body: str, title: str, s: Settings, parsed: list | None = None) -> list[dict]:
    out = []
    for head, crumbs, lines in parsed if parsed is not None else blocks(body):
        text, path = "\n".join(lines).strip(), [*crumbs, *([head[1]] if head else [])]
        if not text:
            continue
        trail = [x for x in [title, *path] if x]
        crumb = " › ".join(trail[:1] + [b for a, b in pairwise(trail) if a != b])
        for piece in windows(text, s.chunk_chars, s.overlap_chars or Settings.overlap_chars):
            whole = f"{crumb}\n\n{piece}" if crumb else piece
            if len(whole.strip()) >= s.min_chars:
                out.append({"heading_path": path, "text": whole, "tokens": -(-len(whole) // 4)})
    if not out and body.strip():
        whole = (f"{title}\n\n" if title else "") + body.strip()[: s.chunk_chars]
        if len(whole.strip()) >= s.min_chars:
            out.append({"heading_path": [], "text": whole, "tokens": -(-len(whole) // 4)})
    return out


def parse(source: str, fallback: str = "", s: Settings = Settings()) -> dict:  # noqa: B008 (frozen)
    data, body = front_matter(source)
    title = (data.get("title") or [""])[0] or fallback
    parts = [*blocks(body)]
    sections = [{"level": h[0], "text": h[1], "slug": heading_slug(h[1]), "crumbs": c, "body": "\n".join(ls).strip()} for h, c, ls in parts if h]
    links = [m[1].split("#")[0] for m in LINK.finditer(body) if internal(m[1]) and m[1].split("#")[0]]
    images = [m[1] for m in IMAGE.finditer(body)] + [m[1] for m in IMG_TAG.finditer(body)]
    return {
        "data": data, "title": title, "headings": [{k: x[k] for k in ("level", "text", "slug")} for x in sections], "links": [*dict.fromkeys(links)],
        "images": [*dict.fromkeys(images)], "preamble": "\n".join(parts[0][2]).strip(), "sections": sections, "chunks": passages(body, title, s, parts),
    }


def parsed(files: DataFrame, settings: Settings | None = None) -> DataFrame:
    """path, parts, seq, and what is parsed of content. Rows without content (unreadable files) are left out. Files are parsed up to SLICE bytes at a time, as their parts take many times their memory."""
    s = settings or Settings.load(files.sparkSession)
    schema = T.StructType.fromDDL(f"path string, parts array<string>, seq bigint, {PARSED}")
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "content", SLICE):
                rows = [parse(t, re.sub(r"\.(md|mdx)\Z", "", p.rsplit("/", 1)[-1], flags=re.I), s) for p, t in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True)]
                for x in rows:
                    x["data"] = [*x["data"].items()]
                found = {f.name: batch[f.name] if f.name in ("path", "parts", "seq") else pa.array([x[f.name] for x in rows], f.type) for f in kinds}
                del rows
                yield pa.RecordBatch.from_arrays([*found.values()], names=[*found])
                del found
            pa.default_memory_pool().release_unused()

    rows = files.where("content IS NOT NULL").select("path", F.split("path", "/").alias("parts"), "content", F.col("seq").cast("bigint").alias("seq"))
    return rows.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batch, in order, with up to most bytes of a text column each, or one row."""
    ends = pc.cumulative_sum(pc.binary_length(batch[column]).cast("int64")).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(ends.searchsorted((ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to
