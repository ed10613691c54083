"""Operators on vectors and pages: against brute force, and on rows that take no part."""

import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import graph, lattice, pagetext, topk, warc


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")


ODD = [(None, [1.0, 0.0]), (90, None), (91, [1.0, None]), (92, [float("nan"), 1.0]), (93, [float("inf"), 1.0]), (94, [0.0, 0.0]), (95, [])]


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=20).round(1)]) for i in range(120)] + [(200, [0.5] * 20), (201, [0.5] * 20)]
    got = topk.integer_top_k(vectors(spark, rows), F.col("vec_id") % 10 == 0, queries_per_task=5, candidates_per_task=30).collect()
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows}
    expected = set()
    for q in whole:
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)[:5]
            expected |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert {tuple(r) for r in got} == expected


def test_top_k_odd_rows(spark):
    got = topk.integer_top_k(vectors(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), *ODD]), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 32768), (0, 2, 94, 0)]
    assert topk.integer_top_k(vectors(spark, [(1, [1.0])]).limit(0), F.col("vec_id") == 0).count() == 0


def test_top_k_beyond_doubles():
    big = np.array([[1 << 40, 3], [1 << 20, 5]])
    q, ids, score = topk.best_of_block(big[:1], np.array([7]), big, np.array([1, 2]), 5)
    assert score.tolist() == [(1 << 63) - 1, (1 << 60) + 15] and ids.tolist() == [1, 2]


def test_nearest_point_is_nearest():
    rng = np.random.default_rng(3)
    y = rng.normal(size=(500, 8)) * 2
    point = lattice.nearest_point(y)
    away = ((y - point) ** 2).sum(axis=1)
    near = ((y[:, None, :] - point[:, None, :] - lattice.SHORTEST[None]) ** 2).sum(axis=2).min(axis=1)
    assert (away <= near + 1e-9).all() and away.max() <= 1 + 1e-9


@pytest.mark.parametrize("block", [lattice.BLOCK, 8])
def test_links_recall_and_precision(spark, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 32))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(size=32) * 0.33]) for i in range(240)]
    rows += [(300 + i, rows[0][1]) for i in range(5)]
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    true = linked.sum(axis=1) - 1
    got = {r.vec_id: r for r in lattice.cosine_links(vectors(spark, rows), block=block).collect()}
    found = np.array([got[i].n_links for i, _ in rows])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum() > 0
    for k, (i, _) in enumerate(rows):
        assert got[i].kept == (got[i].component_id == i) and got[i].component_id <= i


def test_links_odd_rows(spark):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.cosine_links(vectors(spark, [(5, [1.0, 0.0]), (4, [2.0, 0.01]), (6, [1.0, 0.0, 0.0]), *ODD])).collect()}
    assert got == {5: (1, 4, False), 4: (1, 4, True), 6: (0, 6, True), None: (0, None, None)} | {i: (0, i, True) for i in range(90, 96)}
    assert lattice.cosine_links(vectors(spark, [(1, [1.0])]).limit(0)).count() == 0


def test_components_of_long_and_wide_graphs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


PAGES = [(3, "u", "x" * 200), (1, None, "x" * 200), (2, "http://a b", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", "é" * 60), (7, "u", "é" * 60), (8, "u", "y\r\n\r\n" * 400_000)]


def test_archives_come_back(spark):
    pages = spark.createDataFrame([(*row, "x") for row in PAGES], "page_id long, url string, html string, digest string")
    rows = warc.read_archives(warc.write_archives(pages)).collect()
    assert {r.kind for r in rows} == {"record"}
    got = {r.page_id: r for r in rows}
    html = {i: (h or "").encode() for i, _, h in PAGES}
    assert {i: r.payload_bytes for i, r in got.items()} == {i: len(h) for i, h in html.items()}
    assert {i: r.refers_to for i, r in got.items()} == {i: {3: 1, None: 7}.get(i) for i in html}
    assert all(r.payload == (None if r.record_type == "revisit" else html[i]) for i, r in got.items())
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def records(n, packed):
    import hashlib
    import zlib

    out = []
    for i in range(n):
        payload = bytes((i * 31 + k * k) % 251 for k in range(2000))
        data = warc.record_bytes(i, "u", payload, hashlib.sha256(payload).hexdigest(), None, False)
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(pack.compress(data) + pack.flush() if packed else data)
    return out


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "end"])
def test_salvage(packed, damage):
    parts = records(6, packed)
    if damage == "flip":
        parts[2] = parts[2][:200] + bytes([parts[2][200] ^ 1]) + parts[2][201:]
        lost = {2}
    elif damage == "cut":
        parts[2], lost = parts[2][:-300], {2}
    elif damage == "junk":
        parts[2], lost = parts[2] + b"WARC/1.1\r\n\x1f\x8b\x08junk", set()
    else:
        parts[5], lost = parts[5][:150], {5}
    rows = list(warc.salvaged(io.BytesIO(b"".join(parts))))
    assert [r["page_id"] for r in rows if r["kind"] == "record"] == [i for i in range(6) if i not in lost]
    gaps = [r for r in rows if r["kind"] == "gap"]
    assert len(gaps) == 1 and gaps[0]["reason"]
    assert sum(r["end"] - r["start"] for r in rows) == sum(map(len, parts))


@pytest.mark.parametrize("html, text", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("a < b <3 c", "a < b <3 c"), ("<p>One<p>Two <b>b</b>old", "One\n\nTwo bold"), ("x<br>y<br><br>z", "x\ny\n\nz"),
    ("<ul><li>a<li>b<ol start=3><li>n<li>m</ol><li>c</ul>", "- a\n- b\n  3. n\n  4. m\n- c"), ("<title>t</title><script>if(a<b)</script><style>p</style>in", "in"),
    ("<div hidden>no<p>no</div><div style='color:red;display: none'>no</div>yes<!-- no -->", "yes"), ("<pre>a\n  b</pre>", "a\n  b"),
    ("<table><tr><th>Name<th>N<tr><td>Al<td>12</table>", "Name  N\nAl    12"), ("<table><td>a<td>bb<tr><td colspan=2>wide one<tr><td>ccc<td>d</table>x", "a    bb\nwide one\nccc  d\n\nx"),
    ("<table><tr><td>1<table><tr><td>in<td>ner</table><td>2</table>", "1        2\n\nin  ner"), ("</p></div></table>ok", "ok"), ("<li>lone", "- lone"), ("<script>never closed", ""), ("<a href='x>y'>link</a> \"q", "link \"q"),
])
def test_visible_text(html, text):
    assert pagetext.visible_text(html) == text


def test_visible_text_of_deep_and_long_pages(spark):
    assert pagetext.visible_text("<div>" * 50_000 + "deep") == "deep"
    assert pagetext.visible_text("<p>word " * 50_000).count("word") == 50_000
    rows = spark.createDataFrame([(1, None, "x"), (2, "<p>a", "y"), (2, "<p>a", "y")], "page_id long, html string, text string")
    assert sorted(r[0] for r in rows.select(pagetext.rendered()).collect()) == ["", "a", "a"]
    assert rows.limit(0).select(pagetext.rendered()).count() == 0
