"""The Markdown parser on hand-written cases."""

from graphlode.config import Settings
from graphlode.sources import markdown as md


def test_front_matter():
    assert md.front_matter("no marks") == ({}, "no marks")
    assert md.front_matter("---\ntitle: x\nno end") == ({}, "---\ntitle: x\nno end")
    data, body = md.front_matter('---\ntitle: "A: b"\ndescription: >\n  one\n  two\nnote: |\n  x\n\n  y\nkeywords: [a, \'b c\', ]\ntags:\n  - t1\n  - "t 2"\nempty:\n- not a list\n---\nbody')
    assert data == {"title": ["A: b"], "description": ["one two"], "note": ["x\n\ny"], "keywords": ["a", "b c"], "tags": ["t1", "t 2"]}
    assert body == "body"


def test_headings_fences_and_crumbs():
    p = md.parse("# One #\ntext\n```\n# not\n~~~\n## Two `x`\n## Two *x*\n### Deep_er\nbody\n# Last", "f")
    assert [(h["level"], h["text"], h["slug"]) for h in p["headings"]] == [(1, "One", "one"), (2, "Two x", "two-x"), (2, "Two x", "two-x"), (3, "Deeper", "deeper"), (1, "Last", "last")]
    assert p["sections"][3]["crumbs"] == ["One", "Two x"] and p["sections"][4]["crumbs"] == [] and p["title"] == "f"


def test_links_and_images():
    p = md.parse('[a](/docs/x) [b](./a.md#h "t") [c](#f) [d](https://e) ![i](img/p.png) <img alt="" src=\'q.png\'> [e](../b.mdx) [a](/docs/x) ![j](/k.png) [m](mailto:x)')
    assert p["links"] == ["/docs/x", "./a.md", "../b.mdx", "/k.png"]
    assert p["images"] == ["img/p.png", "/k.png", "q.png"]


def test_chunks():
    s = Settings()
    assert md.windows("a" * 2600, 1280, 240) == ["a" * 1280, "a" * 1280, "a" * 520]
    paras = ["x" * 700, "y" * 700, "z" * 100]
    w = md.windows("\n\n".join(paras), 1280, 240)
    assert w == [paras[0], "x" * 240 + "\n\n" + paras[1] + "\n\n" + paras[2]]
    p = md.parse("---\ntitle: Same\n---\n# Same\n" + "word " * 30 + "\n## Small\nx", "f", s)
    assert len(p["chunks"]) == 1 and p["chunks"][0]["text"].startswith("Same\n\nword") and p["chunks"][0]["heading_path"] == ["Same"]
    assert md.parse("# only a heading that is long enough to be kept as a passage of its own here", "t")["chunks"][0]["heading_path"] == []


def test_files_are_parsed_in_small_parts(spark):
    """However large a batch is, a part has no more than SLICE bytes of text, or one row; all rows are in one part, in order."""
    import pyarrow as pa

    from graphlode.sources import markdown

    texts = ["x" * n for n in (5, 5, 0, 30, 4, 4, 4, 100, 1)]
    got = [b["content"].to_pylist() for b in markdown.slices(pa.RecordBatch.from_pydict({"content": texts}), "content", 12)]
    assert [len(x) for g in got for x in g] == [len(x) for x in texts] and all(sum(map(len, g)) <= 12 or len(g) == 1 for g in got)
    rows = spark.createDataFrame([(f"a/{i}.md", f"---\nk: [a, b]\ntitle: t{i}\n---\n# H{i}\n" + "word " * 40, i) for i in range(5)], "path string, content string, seq int")
    found = markdown.parsed(rows).orderBy("seq").collect()
    assert [(r["path"], r["parts"], r["title"], r["data"]["k"], r["headings"][0]["text"]) for r in found] == [(f"a/{i}.md", ["a", f"{i}.md"], f"t{i}", ["a", "b"], f"H{i}") for i in range(5)]
