"""Fences, links and media against plain Python, and files published by their content."""

import hashlib
import os
import posixpath
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmere.operators import markup


def fenced(text):
    """(is code, text) runs, line by line."""
    fence, out = None, []
    for line in re.findall(r"[^\n]*(?:\n|$)", text)[:-1] if text.endswith("\n") or not text else re.findall(r"[^\n]*(?:\n|$)", text):
        mark = re.match(r"[ \t]{0,3}(`{3,}|~{3,})", line)
        if fence is None:
            if mark:
                fence = mark[1]
            out.append((mark is not None, line))
        else:
            out.append((True, line))
            if re.match(rf"[ \t]{{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*(?:\n|$)", line) and re.fullmatch(r"[ \t]*[`~]+[ \t]*\n?", line):
                fence = None
    return out


LINES = ["plain X text", "```", "````", "~~~", "~~~~ X", "```py X", "   ```", "    ``` X", "```` ", "``` `", "", "X ``` X", "~~~`", "\t~~~~~", "``"]


def test_fences_are_those_of_a_scan_line_by_line(spark):
    rng = random.Random(3)
    texts = ["", "X", "```", "```\nX", "~~~\nX\n```\nX\n~~~\nX", "```\nX\n````\nX", "````\nX\n```\nX"] + ["\n".join(rng.choice(LINES) for _ in range(rng.randrange(14))) + rng.choice(["", "\n"]) for _ in range(600)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.o for r in rows.select("k", markup.outside_fences(F.col("t"), lambda p: F.replace(p, F.lit("X"), F.lit("Y"))).alias("o")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == "".join(line if code else line.replace("X", "Y") for code, line in fenced(t)), repr(t)


def test_long_texts_have_fences_too(spark):
    text = ("word X " * 20 + "\n") * 4000 + "```\n" + "X code\n" * 20_000 + "```\nX\n" + "~~~\nX"
    out = spark.createDataFrame([(text,)], "t string").select(markup.outside_fences(F.col("t"), lambda p: F.replace(p, F.lit("X"), F.lit("Y")))).first()[0]
    assert out == text.replace("word X", "word Y").replace("```\nX\n", "```\nY\n").replace("X X", "X X")


A, B = "asset_sha256_" + "a" * 64, "asset_sha256_" + "b" * 64
PLACE = {A: f"{markup.OBJECTS}aa/{A}.png", B: f"{markup.OBJECTS}bb/{B}.pdf"}


def test_uris_become_links(spark):
    assets = spark.createDataFrame(list(PLACE.items()), "asset_id string, relative_path string")
    docs = {
        "knowledge/semantic/x/y.md": f"see ![a](asset://{A}) and [b](asset://{B})\n```\n[c](asset://{A}) asset://\n```\n[d](asset://{A})",
        "knowledge/top.md": f"[a](asset://{A})", "knowledge/assets/objects/aa/n.md": f"[a](asset://{A})", "knowledge/none.md": "no links",
        "knowledge/bare.md": f"asset://{A}", "knowledge/lost.md": f"[x](asset://{'asset_sha256_' + 'c' * 64})", "other/z.md": "x", "knowledge/open.md": f"~~~\nasset://{B}", "knowledge/empty.md": None,
    }
    got = {r.path: (r.body, r.error) for r in markup.resolve_assets(spark.createDataFrame(list(docs.items()), "path string, body string"), assets).collect()}
    for path in ("knowledge/semantic/x/y.md", "knowledge/top.md", "knowledge/assets/objects/aa/n.md", "knowledge/none.md", "knowledge/open.md"):
        link = lambda m, path=path: m[1] + (lambda r: r if r.startswith(".") else "./" + r)(posixpath.relpath(PLACE[m[2]], posixpath.dirname(path))) + ")"
        want = "".join(line if code else re.sub(rf"(!?\[[^\]\n]*\]\()asset://({markup.ASSET})\)", link, line) for code, line in fenced(docs[path]))
        assert got[path] == (want, None)
    assert got["knowledge/empty.md"] == ("", None) and {k: v[1] for k, v in got.items() if v[0] is None} == {"knowledge/bare.md": "an asset's URI must be a Markdown link or image", "knowledge/lost.md": "no asset asset_sha256_" + "c" * 64, "other/z.md": "path is not in the workspace"}
    moved = spark.createDataFrame([("knowledge/semantic/x/y.md", "knowledge/procedural/q.md", got["knowledge/semantic/x/y.md"][0] + " [w](https://x.y) [r](../other.md)"), ("knowledge/top.md", "knowledge/a/b/c/d.md", f"[a](./assets/objects/aa/{A}.png) [s](./assets/objects/../objects/bb/{B}%2epdf)"), ("knowledge/bad.md", "knowledge/b2.md", f"[a](./assets/objects/aa/{A}.gif)")], "path string, new_path string, body string")
    out = {r.path: (r.body, r.error) for r in markup.relocate_assets(moved, assets).collect()}
    assert out["knowledge/procedural/q.md"] == (docs["knowledge/semantic/x/y.md"].replace(f"![a](asset://{A})", f"![a](../assets/objects/aa/{A}.png)").replace(f"[b](asset://{B})", f"[b](../assets/objects/bb/{B}.pdf)").replace(f"[d](asset://{A})", f"[d](../assets/objects/aa/{A}.png)") + " [w](https://x.y) [r](../other.md)", None)
    assert out["knowledge/a/b/c/d.md"][0] == f"[a](../../../assets/objects/aa/{A}.png) [s](../../../assets/objects/bb/{B}.pdf)" and "no published asset" in out["knowledge/b2.md"][1]


def test_media_are_numbered_and_replaced(spark):
    text = '<p id="1">a<img id="7" src="h1"/>b<source token="h2" name="n">c<img src="h1"><img alt="x"/><imgx src="z"/></p><cite type="user">Jo</cite>'
    docs = spark.createDataFrame([("d", text), ("e", "none"), ("f", '<img src="q"/>'), ("g", '<img src="q"/>'), ("n", None)], "key string, content string")
    rows = [(r.key, r.ordinal, r.element, r.handle, r.occurrence) for r in markup.media(docs).orderBy("key", "ordinal").collect()]
    assert rows == [("d", 0, "img", "h1", 1), ("d", 1, "source", "h2", 1), ("d", 2, "img", "h1", 2), ("d", 3, "img", None, None), ("f", 0, "img", "q", 1), ("g", 0, "img", "q", 1)]
    refs = [("d", 1, "attachment", "h2", "r2", 'n"<', None, "application/pdf"), ("d", 0, "image", "h1", "r1", None, "pic", None), ("d", 2, "image", "h1", "r3", None, None, None), ("d", 3, "image", None, "r4", None, None, None), ("f", 0, "image", "other", "r", None, None, None)]
    out = {r.key: r for r in markup.normalise_export(docs, spark.createDataFrame(refs, "key string, ordinal int, kind string, handle string, reference_id string, name string, alt string, mime string"), "lark").collect()}
    source = lambda r: "src_" + hashlib.sha256(f"lark\0d\0{r}".encode()).hexdigest()[:24]
    assert out["d"].error is None and out["d"].text == f'<p>a<asset-ref source-id="{source("r1")}" kind="image" alt="pic"/>b<asset-ref source-id="{source("r2")}" kind="attachment" name="n&quot;&lt;" content-type="application/pdf"/>c<asset-ref source-id="{source("r3")}" kind="image"/><asset-ref source-id="{source("r4")}" kind="image"/><imgx/></p>[REDACTED_PERSON]'
    assert out["e"].text == "none" and out["n"].text == "" and out["f"].error == "media reference mismatch at 0" and out["g"].error == "media references do not match content: 0 for 1"


@pytest.mark.parametrize("times", [1, 2])
def test_the_same_bytes_are_one_file(spark, tmp_path, times):
    png, pdf = b"\x89PNG\r\n\x1a\nxyz", b"%PDF-1.7 x"
    rows = [(f"s{k}", "image/png", png) for k in range(40)] + [("p", "Application/PDF", pdf), ("bad", "image/png", pdf), ("text", "text/plain", b"hello"), ("null", "image/png", None), ("webp", "image/webp", b"RIFF0000WEBPVP8 ")]
    for turn in range(times):
        out = markup.publish_assets(spark.createDataFrame(rows, "source_id string, content_type string, content binary").repartition(4), str(tmp_path)).collect()
        first = turn == 0
        assert sum(r.status == "published" for r in out) == (3 if first else 0) and {r.source_id for r in out if r.status == "refused"} == {"bad", "text", "null"}
    files = [os.path.join(d, n) for d, _, ns in os.walk(tmp_path) for n in ns]
    assert len(files) == 3 and all(hashlib.sha256(open(f, "rb").read()).hexdigest() in f for f in files)
    assert {r.relative_path for r in out if r.relative_path} == {os.path.relpath(f, tmp_path) for f in files}
