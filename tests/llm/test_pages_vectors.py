"""Operators over pages and embeddings."""

import hashlib
import math
import os
import struct

import numpy as np
import pytest

from sigspark.llm import hnsw, html_text, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad">Buy this, now. Really.</div>
<article><h1>Head &amp; line</h1><p><b>First  paragraph,
with &lt;marks&gt; and caf&eacute;.<br><p>Second <i>paragraph</i>, longer than the first one.</p><form>Your name.</form>
<ul><li>An item, too.</ul></article><aside>Side text, with marks.</aside><div id="comments"><p>A reader says, hello there.</p></div>
<footer>&copy; me &middot; Some words, here.</footer>"""


def test_article_text():
    assert html_text.main_text(PAGE) == "Head & line\nFirst paragraph, with <marks> and café.\nSecond paragraph, longer than the first one.\nAn item, too."


def test_page_without_article_element():
    page = "<body><div class='menu'><a href=x>Home</a> <a href=y>About</a></div><div class='post'><h2>Title here</h2><p>" + "Long text, with commas, and more. " * 5 + "</p><p>Another one, as long as that. It ends here.</p></div><div><a href=z>Imprint</a></div>"
    got = html_text.main_text(page)
    assert got.startswith("Title here\nLong text,") and got.endswith("It ends here.") and "Home" not in got and "Imprint" not in got


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<<<>>>", "<p", "<!--", "<script>alert(1)", "<div><div></div>", "&amp;" * 3, "<style>", "</p></p>", "<a href='"])
def test_broken_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_plain_text_page():
    assert html_text.main_text("a < b &amp; c") == "a < b & c"


def test_long_page():
    page = "<article>" + "<p>One sentence, as it is.</p>" * 20_000 + "</article>"
    assert html_text.main_text(page).count("\n") == 19_999


PAGES = "page_id long, url string, html string, text string, HTML string, digest string, row long"


def test_extract_keeps_rows(spark):
    rows = [(1, "u", PAGE, "x", "y", "z", 1), (1, "u", PAGE, "x", "y", "z", 1), (None, None, None, None, None, None, None), (2, None, "", "", "", "", 2)]
    got = html_text.extract(spark.createDataFrame(rows, PAGES)).collect()
    said = "Head & line\nFirst paragraph, with <marks> and café.\nSecond paragraph, longer than the first one.\nAn item, too."
    assert sorted((str(r["page_id"]), r["url"], r["text"], r["n_chars"]) for r in got) == sorted([("1", "u", said, len(said))] * 2 + [("None", None, "", 0), ("2", None, "", 0)], key=lambda r: (r[0], r[2]))
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def expected_records(rows):
    def digest(h):
        return hashlib.sha256((h or "").encode()).hexdigest()

    first = {}
    for page, _, h in rows:
        first.setdefault(digest(h), []).append(page)
    out = []
    for d, pages in first.items():
        size = next(len((h or "").encode()) for _, _, h in rows if digest(h) == d)
        pages = sorted(pages, key=lambda p: (p is None, p))
        for k, p in enumerate(pages):
            again = size >= 100 and k > 0
            out.append((p, size, d, "revisit" if again else "response", pages[0] if again else None))
    return sorted(map(str, out))


def test_warc_round_trip(spark, tmp_path):
    shared = "<html><p>A payload that occurs often, and is longer than a hundred bytes, so that it is stored only once. Yes.</p>"
    rows = [(i, f"http://a.b/{i}\r\nX: y", f"<html><p>page {i} " + "words and more words, " * (i % 40)) for i in range(400)]
    rows += [(1000 - i, "u", shared) for i in range(20)] + [(500, "u", shared), (500, "u", shared), (None, None, shared), (None, None, None), (501, None, ""), (502, "é", "short"), (503, "é", "short"), (504, "u", "é" * 60_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = str(tmp_path / "archives")
    archives = warc.write(pages, "file://" + folder)
    got = warc.read(archives).collect()
    to_int = lambda x: None if x is None else int(x)
    assert sorted(str((to_int(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], to_int(r["refers_to"]))) for r in got) == expected_records(rows)
    assert sum(r["records"] for r in archives.collect()) == len(rows)
    files = [os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".zst")]
    for path in files:
        with open(path, "rb") as f:
            head = f.read(12)
        assert struct.unpack("<I", head[:4])[0] == warc.DICT_MAGIC and head[8:12] == struct.pack("<I", 0xEC30A437), "a trained dictionary leads the archive"
    ids = [h["WARC-Record-ID"] for p in files for h, _ in warc.read_archive(p)]
    refers = [h["WARC-Refers-To"] for p in files for h, _ in warc.read_archive(p) if "WARC-Refers-To" in h]
    assert set(refers) <= set(ids) and len(set(refers)) == 1


def test_warc_frames_stand_alone(spark, tmp_path):
    import zstandard

    folder = str(tmp_path / "one")
    warc.write(spark.createDataFrame([(i, "u", f"<p>{i} some words that repeat</p>" * 20) for i in range(200)], "page_id long, url string, html string").coalesce(1), folder)
    path = os.path.join(folder, next(f for f in os.listdir(folder) if f.endswith(".zst")))
    data = open(path, "rb").read()
    size = struct.unpack("<I", data[4:8])[0]
    assert zstandard.frame_content_size(data[8 + size :]) > 0
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
    assert one.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\n") and one.unused_data


def test_warc_empty_and_tiny(spark, tmp_path):
    schema = "page_id long, url string, html string"
    assert warc.read(warc.write(spark.createDataFrame([], schema), str(tmp_path / "none"))).count() == 0
    assert warc.read(warc.write(spark.createDataFrame([(1, "u", "x")], schema), str(tmp_path / "few"))).count() == 1


VECTORS = "vec_id long, embedding array<float>, label int, dim int, v string, key long"


def test_hnsw_recall_and_edges(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16)) * 4
    vectors = [(i, (centres[i % 12] + rng.normal(size=16)).astype("float32").tolist()) for i in range(1500)]
    same = vectors[0][1]
    rows = vectors + [(i, same) for i in range(5000, 5400)] + [(6000, None), (6100, [0.0] * 16), (6200, [math.nan] + [1.0] * 15), (6300, [None] + [1.0] * 15), (6400, [math.inf] * 16), (None, same), (6500, []), (6600, [1.0, 2.0]), (6700, [1.0, 2.5])]
    df = spark.createDataFrame([(a, b, 1, 2, "x", 3) for a, b in rows], VECTORS)
    got = hnsw.search(hnsw.build_index(df, shard=300), df.where("vec_id % 100 = 0")).collect()
    good = {a: np.array(b, float) for a, b in rows if a is not None and b and not any(x is None or not math.isfinite(x) for x in b) and any(b)}
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {k for k in good if k % 100 == 0}
    hits = total = 0
    for q, found in by.items():
        found.sort()
        exact = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), k) for k, v in good.items() if k != q and len(v) == len(good[q]))[:10]
        assert [r for r, _, _ in found] == list(range(1, len(exact) + 1))
        assert [(s, k) for _, k, s in found] == sorted((s, k) for _, k, s in found)
        assert all(s == pytest.approx(float(np.sqrt(((good[q] - good[k]) ** 2).sum())), abs=1e-12) for _, k, s in found)
        hits += len({k for _, k in exact} & {k for _, k, _ in found})
        total += len(exact)
    assert hits / total >= 0.95
    assert [k for _, k, _ in sorted(by[0])] == list(range(5000, 5010)), "of equal vectors those with the smallest ids"


def test_hnsw_repeated_ids_are_rows_of_their_own(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(1, 60)]
    a, b = rng.normal(size=8).astype("float32").tolist(), rng.normal(size=8).astype("float32").tolist()
    rows += [(100, a), (100, b), (100, b), (200, a)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = hnsw.search(hnsw.build_index(df), df.where("vec_id % 100 = 0")).collect()
    found = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got)
    vectors = [(k, np.array(v, float)) for k, v in rows]
    expected = []
    for i, (k, v) in enumerate(vectors):
        if k % 100 == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), m) for j, (m, w) in enumerate(vectors) if j != i)[:10]
            expected += [(k, n + 1, m, round(s, 9)) for n, (s, m) in enumerate(near)]
    assert found == sorted(expected)


def test_hnsw_refuses_more_than_the_index_holds(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError):
        hnsw.search(hnsw.build_index(df, keep=5), df, k=5)


@pytest.mark.parametrize("spread", [0.2, 1.0, 100.0])
def test_hnsw_routing_keeps_recall(spark, spread):
    """Clustered vectors need few cells, unstructured ones many: the index finds out."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(20, 12))[rng.integers(0, 20, 3000)] * 3 + rng.normal(size=(3000, 12)) * spread
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    index = hnsw.build_index(df, shard=200)
    got = {}
    for r in hnsw.search(index, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 3000, 100):
        d = ((vectors - vectors[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & got[q])
    assert hits / 300 >= 0.9 and (spread > 0.5 or index.coarse[12][1] <= 4)


def test_hnsw_empty(spark):
    df = spark.createDataFrame([], VECTORS)
    assert hnsw.search(hnsw.build_index(df), df).count() == 0


def test_hnsw_graph_is_layered():
    rng = np.random.default_rng(1)
    graph = hnsw.Graph.build(rng.normal(size=(2000, 8)))
    sizes = [len(n) for n, _ in graph.layers]
    assert sizes[0] == 2000 and len(sizes) >= 3 and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    assert graph.layers[0][1].shape == (2000, 2 * hnsw.LINKS)
    again = hnsw.Graph.unpack(graph.pack())
    assert all((a == b).all() for (_, a), (_, b) in zip(graph.layers, again.layers))


@pytest.mark.parametrize("start, end", [
    ('<body style="overflow:hidden">', "</body>"), ('<article aria-hidden="false">', "</article>"), ('<div data-x="hidden">', "</div>"),
    ('<div class="has-sidebar no-comments">', "</div>"), ("<main hidden>", "</main>"), ('<div class="with-menu">', "</div>"),
])
def test_containers_with_loosely_matching_attributes_stay(start, end):
    said = "One sentence, as it is. And another, longer than that."
    assert html_text.main_text(f"{start}<article><p>{said}</p></article>{end}") == said


@pytest.mark.parametrize("start", ["<div hidden>", "<div hidden=''>", "<div class='x sidebar'>", "<div id=comments>", "<div class='site-footer'>"])
def test_furniture_still_goes(start):
    assert html_text.main_text(f"<body><p>One sentence, as it is.</p>{start}<p>Some other words, here.</p></div>") == "One sentence, as it is."


PROSE = ["The river rose by two metres in the night, and the lower road was closed before dawn.", "Nobody was hurt, the mayor said, but forty houses lost power, some of them until the evening.", "Is that all? It is not: the bridge, built in 1931, has to be looked at first, stone by stone."]
BARE = [
    # A page of plain div elements: a menu, the text, a line of rights.
    ("<body><div>Home</div><div>News</div><div>Sport</div><div>Contact us</div><div><div><p>" + "</p><p>".join(PROSE) + "</p></div></div><div>Copyright 2024 Example</div></body>", PROSE),
    # A short paragraph and an unlinked list between long paragraphs stay.
    ("<body><table><tr><td>Login</td><td>Register</td><td>Help</td></tr></table><section><p>" + PROSE[0] + "</p><p>Yes.</p><ul><li>one</li><li>two</li></ul><p>" + PROSE[1] + "</p></section><div>All rights reserved</div></body>", [PROSE[0], "Yes.", "one", "two", PROSE[1]]),
    # A heading before the text, another over a list of sections.
    ("<body><div><span>Mon 3 May</span></div><div><h1>Flood</h1><p>" + "</p><p>".join(PROSE) + "</p></div><div><h3>More</h3><ul><li>Weather</li><li>Traffic</li><li>Jobs</li></ul></div></body>", ["Flood", *PROSE]),
    # Text without paragraph elements, beside a narrow column of words.
    ("<html><body><table><tr><td>Start<td><dl>" + "".join(f"<dd>Entry {k}" for k in range(20)) + "</dl></table><center><blockquote>" + " ".join(PROSE) + "</blockquote><blockquote>" + PROSE[1] + "</blockquote></center><div>top</div>", [" ".join(PROSE), PROSE[1]]),
]


@pytest.mark.parametrize("page, said", BARE)
def test_ratios_decide_where_no_name_does(page, said, monkeypatch):
    assert html_text.main_text(page) == "\n".join(said)
    monkeypatch.setattr(html_text, "path_scores", lambda nodes, parents: {n[0]: 1.0 for n in nodes})
    assert html_text.main_text(page) != "\n".join(said), "without the ratios furniture comes in"


def test_cards_are_no_articles():
    cards = "".join(f"<article><h3><a href=x>Card {k}</a></h3><p><a href=x>Read</a></p></article>" for k in range(5))
    page = f"<body><main><h1>Flood</h1><article><p>{'</p><p>'.join(PROSE)}</p><p>Yes.</p></article></main>{cards}</body>"
    assert html_text.main_text(page) == "\n".join(["Flood", *PROSE, "Yes."])


@pytest.mark.parametrize("tag", ["div", "article", "section", "p", "li", "b", "table"])
def test_very_deep_pages(tag):
    import time
    import tracemalloc

    page = "<body>" + f"<{tag}>" * 100_000 + PROSE[0] + f"</{tag}>" * 50_000 + "</x>" * 50_000 + "</body>"
    start = time.perf_counter()
    got = html_text.main_text(page)
    seconds = time.perf_counter() - start
    tracemalloc.start()
    html_text.main_text(f"<{tag}>" * 10_000 + PROSE[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == PROSE[0] and seconds < 10 and peak < 20e6
