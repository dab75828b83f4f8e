from __future__ import annotations

import base64
import re
import time
import tracemalloc
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from heliograph.llm import html_extraction as H
from heliograph.llm import jpeg as J
from heliograph.llm import media_columns as M
from heliograph.llm.common import table

PROSE = "This is a paragraph of prose, with commas, clauses, and enough characters to count as text. "
PAGE = f"""<html><head><title> A &amp; B </title><script>var x = "<p>not, this, at, all, never</p>";</script></head><body>
<nav><a href=1>Home</a> <a href=2>About, us, here</a></nav>
<div class="sidebar"><p>{PROSE}</p></div>
<div id="main"><h1>Heading</h1><p>{PROSE * 2}</p><p>Second &lt;one&gt;, {PROSE}<p>Third, unclosed, {PROSE}</div>
<div class="links"><p><a href=3>{PROSE}</a></p></div>
<footer><p>{PROSE}</p></footer></body></html>"""


def test_the_container_of_prose_is_kept():
    title, text, score = H.extract(PAGE)
    assert title == "A & B" and score > 0
    lines = text.split("\n")
    assert lines[0] == "Heading" and len(lines) == 4
    assert lines[2].startswith("Second <one>, ") and lines[3].startswith("Third")
    assert "Home" not in text and "never" not in text


def test_points_by_hand():
    page = f"<div><section><p>{'a' * 30}, {'b' * 80}</p></section></div>"
    # 1 + a comma + 1 for a hundred characters to the section (4), half of it to the div (5)
    assert H.extract(page)[2] == max(4 + 3, 5 + 1.5)
    linked = f"<div><p>{'a' * 30}<a>{'b' * 30}</a></p></div>"
    assert H.extract(linked)[2] == (5 + 1) * 0.5


def test_siblings_of_the_best_container():
    page = f"<body><div class=x><p>{PROSE * 4}</p><p>{PROSE * 3}</p></div><p>{PROSE}</p><p><a>{PROSE}</a></p><div class=x><p>{PROSE}</p></div></body>"
    text = H.extract(page)[1]
    assert text.count("This is") == 4 + 3 + 1 + 1


@pytest.mark.parametrize("page", ["", "plain", "<", "<p", "<p>", "</div></div>", "<div" * 3000, "<div>" * 3000 + "x", "<!-- never closed", "<a href='x>y", "<p>&#x110000;&bogus;</p>", "<script>" * 50])
def test_broken_pages_give_something(page):
    title, text, score = H.extract(page)
    assert isinstance(text, str) and score == 0


CONTROLS = f"<form><p>{PROSE}</p><p>{PROSE}</p><button>Send, all, of, it</button><select><option>one</select></form>"


def test_forms_and_unended_elements_lose_no_text():
    assert H.extract(CONTROLS)[1].count("This is") == 2 and "Send" not in H.extract(CONTROLS)[1]
    for odd in ("<svg width='3'/>", "<button>", "<iframe src=x>", "<TEXTAREA>", "<noscript>"):
        assert H.extract(f"<div>{odd}<p>{PROSE}</p><p>{PROSE}</p></div>")[1].count("This is") == 2
    assert "never" not in H.extract(f"<div><p>{PROSE}</p><script>never</div>")[1]
    assert H.extract(f"<div><p>{PROSE}</p><svg><text>never</text></svg><p>{PROSE}</p><svg></div>")[1].count("This is") == 2


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x" + "</div>" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<p><table>" * 50_000 + "<div>" * 50_000, "<button>" * 100_000, "<svg/>" * 100_000, "<li>" * 100_000, "<td>" * 50_000 + "</p>" * 50_000, "<a b='" * 50_000, "<!--" * 100_000])
def test_time_is_linear_in_depth(page):
    began = time.perf_counter()
    H.extract(page)
    assert time.perf_counter() - began < 20


class _Tree(HTMLParser):
    """A tree of lists [tag, names, parent, children] for the reference scorer below, by the library's parser."""

    def __init__(self, page):
        super().__init__()
        self.root = self.now = ["#root", "", None, []]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        up = self.now
        while up and not (tag == "li" and up[0] in ("ul", "ol")) and up[0] not in ("td", "th", "table"):
            if up[0] == "li" == tag or up[0] == "p" and tag in ("p", "div", "ul", "h1", "h2", "h3", "table", "section", "article", "nav", "footer", "header", "aside", "form", "blockquote", "pre"):
                self.now = up[2]
                break
            up = up[2]
        node = [tag, " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")), self.now, []]
        self.now[3].append(node)
        if tag not in ("br", "hr", "img", "input", "link", "meta", "area", "wbr"):
            self.now = node

    def handle_endtag(self, tag):
        node = self.now
        while node and node[0] != tag:
            node = node[2]
        if node:
            self.now = node[2]

    def handle_data(self, data):
        self.now[3].append(data)


def scored(page):
    """(text, score) by the plain definition: each container's points are summed over all paragraphs of the page, one container at a time."""
    root = _Tree(page).root
    hidden = lambda x: x[0] in H._SKIP | {"script", "style", "button", "select", "textarea", "svg", "noscript", "iframe", "template", "math"} or x[1] and x[0] not in ("html", "body", "article", "main") and H._BAD.search(x[1]) and not H._GOOD.search(x[1])

    def nodes(x):
        yield x
        for y in x[3]:
            if not isinstance(y, str) and not hidden(y):
                yield from nodes(y)

    def text(x, linked=False, within=False):
        within = within or x[0] == "a"
        return "".join((y if within or not linked else "") if isinstance(y, str) else "" if hidden(y) else text(y, linked, within) for y in x[3])

    chars = lambda s: len(re.sub(r"\s", "", s))
    density = lambda x: chars(text(x, True)) / max(1, chars(text(x)))
    inside = list(nodes(root))
    paragraphs = [x for x in inside if x[0] in H._PARAGRAPH and chars(text(x)) >= H.LEAST_PARAGRAPH and not any(not isinstance(y, str) and y[0] in H._PARAGRAPH for y in x[3])]
    best, most = None, 0.0
    for x in inside[1:]:
        points, some = 0.0, False
        for p in paragraphs:
            up, level = p[2], 0
            while up and up is not x:
                up, level = up[2], level + 1
            if up is x and level < H.LEVELS:
                some, t = True, text(p)
                points += (1 + t.count(",") + min(chars(t) // 100, 3)) / (1 if level == 0 else 2 if level == 1 else 3 * level)
        if some:
            points += H._TAG_SCORE.get(x[0], 0) + (25 * bool(H._GOOD.search(x[1])) - 25 * bool(H._BAD.search(x[1])) if x[1] else 0)
            x.append(points * (1 - density(x)))
            if best is None or x[4] > most:
                best, most = x, x[4]
    if best is None:
        return text(root), 0.0
    out = []
    for y in best[2][3]:
        if isinstance(y, str) or hidden(y):
            continue
        t, bonus = text(y), most * H.SIBLING if y[1] and y[1] == best[1] else 0.0
        ends = t.strip()[-1:] in (".", "!", "?") and t.strip()
        prose = y[0] == "p" and (chars(t) > 80 and density(y) < 0.25 or 0 < chars(t) <= 80 and not chars(text(y, True)) and ends)
        if y is best or len(y) > 4 and y[4] + bonus >= max(10.0, most * H.SIBLING) or prose:
            out.append(t)
    return " ".join(out), round(most, 6)


def test_pages_against_a_plain_scorer(spark, sf):
    pages = [r.html for r in table(spark, "/root/testdata/sf0.01", "pages").select("html").collect()]
    pages += [PAGE, CONTROLS, f"<div><p>{PROSE}</p><p>{PROSE}</p></div><div><p>{PROSE}</p><p>{PROSE}</p></div>"]  # a tie: the first one
    plain = lambda t: "".join(t.split())
    other = 0
    for page in pages:
        _, text, score = H.extract(page)
        want = scored(page)
        other += plain(text) != plain(want[0]) or abs(score - want[1]) > 1e-5
    assert other == 0 and len(pages) > 100


def test_pages(spark, sf):
    pages = table(spark, sf, "pages")
    got = H.extract_pages(pages).collect()
    assert len(got) == pages.count()
    assert sum(r.score > 0 and r.n_chars > 0 for r in got) > 0.8 * len(got)
    assert {(r.page_id, r.text) for r in got} == {(r.page_id, H.extract(r.html)[1]) for r in pages.collect()}


def test_pages_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, PAGE, "t"), (1, PAGE, "t"), (None, PAGE, None), (2, None, "t"), (3, "", "t"), (4, "<p>" + PROSE * 20_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, title string").selectExpr("*", "title AS score")
    got = sorted(((str(r.page_id), r.title, r.n_chars) for r in H.extract_pages(pages).collect()), key=str)
    n = len(H.extract(PAGE)[1])
    assert got == sorted([("1", "A & B", n), ("1", "A & B", n), ("None", "A & B", n), ("2", None, None), ("3", None, 0), ("4", None, len(PROSE) * 20_000 - 1)], key=str)
    assert H.extract_pages(pages.limit(0)).count() == 0


def picture(h, w, seed=0):
    y, x = np.mgrid[:h, :w]
    noise = np.random.default_rng(seed).normal(0, 6, (h, w, 3))
    return np.clip(np.stack([128 + 90 * np.sin(x / 9), 128 + 90 * np.cos(y / 7), 2 * x + y], 2) + noise, 0, 255).astype(np.uint8)


@pytest.mark.parametrize("h,w,sub,interval", [(1, 1, 1, 0), (8, 8, 1, 0), (33, 47, 2, 0), (50, 17, 2, 3), (16, 64, 1, 5)])
def test_every_scan_reaches_the_coefficients(h, w, sub, interval):
    rgb, quant = picture(h, w), np.arange(64) // 8 + 1
    data = J.encode(rgb, quant, sub, interval=interval)
    got = J.Decoder(data).coefficients()
    for a, b in zip(got, J.quantised(rgb, quant, sub), strict=True):
        rows, stride = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
        used_y, used_x = -(-h // 8) if a is got[0] else rows, -(-w // 8) if a is got[0] else stride
        assert (a[:used_y, :used_x] == b[:used_y, :used_x]).all(), "exact round trip of quantised coefficients"


def test_pixels_against_a_plain_transform():
    rgb, quant = picture(24, 40), np.full(64, 3)
    out = J.decode(J.encode(rgb, quant, 1))
    assert out.shape == rgb.shape and np.abs(out.astype(int) - rgb).mean() < 4
    y = J.quantised(rgb, quant, 1)[0][1, 2] * quant
    natural = np.zeros(64)
    natural[J.ZIGZAG] = y
    c = lambda u: 2**-0.5 if u == 0 else 1.0
    want = [[sum(c(u) * c(v) / 4 * natural[8 * v + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * r + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) + 128 for x in range(8)] for r in range(8)]
    luma = out[8:16, 16:24].astype(float) @ [0.299, 0.587, 0.114]
    assert np.abs(luma - np.clip(want, 0, 255)).mean() < 3


def test_fewer_scans_give_a_coarser_picture():
    rgb = picture(32, 32)
    data = J.encode(rgb, np.full(64, 2), 1)
    ends = [i for i in range(len(data) - 1) if data[i : i + 2] == b"\xff\xda"]
    off = [np.abs(J.decode(data[:end]).astype(int) - rgb).mean() for end in (*ends[1:], len(data))]
    assert off[-1] < 3 and off[0] > 3 * off[-1] and off[4] < off[0]


#: A 16 x 16 icon as another encoder wrote it (Huffman tables of its own, sequential), and its pixels from a lossless file, packed; both from the test data of CPython.
ICON = "/9j/2wBDAAMCAgICAgMCAgIDAwMDBAYEBAQEBAgGBgUGCQgKCgkICQkKDA8MCgsOCwkJDRENDg8QEBEQCgwSExIQEw8QEBD/2wBDAQMDAwQDBAgEBAgQCwkLEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBD/wAARCAAQABADASIAAhEBAxEB/8QAFgABAQEAAAAAAAAAAAAAAAAABwQF/8QAJBAAAQQBBAICAwAAAAAAAAAAAQIDBAYFBwgSExEiABQJMTL/xAAVAQEBAAAAAAAAAAAAAAAAAAAABv/EACMRAAECBQMFAAAAAAAAAAAAAAECEQMEBQYhABIxFRZhgeH/2gAMAwEAAhEDEQA/ABSm0mobc8HmExLUlRzzEWPkJWW+ulrsaUVAseUgslSlH9LKuPryIKuWPZdskzXmm3fX5m2nF4GlVxx/HOpx4ks51+MiU/Iaad7UcUo4tILoS4kqcWkezS0hO/HvuRp0rO6hWnWO1UisZVuFi4GFeyEpmGepa5S5SWVPuciFKRFLgSrwetnyPIB+Vb4N9mKhQMzo5po9XLdDs9d6ZVix2VEhiL9kuNPxw2gEKcDQ/rs8AuA8VAe0vdl7VOYn+27flGAUgmITjbhSmCg3BYlyeWDkMolvw4KOp1KM6iCNvngZHwetf//Z"
PIXELS = "eNpjYEAAv94DXm27PJq3uNStdahYblM4zzxjGgNu4NO15////6716x0rV9iVLLLKn22WOQWPes/W7W4NG52qV9mVLrYumGueNQ2rer/+Iz5d+z1atznXrrUtWWiZM80sbYJFznSgYkz1QROP+fce9O7YDXJ2LdDZy2yLF1jmzoQohqj//yj0712vn1ftgOyA/sM+nXs8WrZCnA00H+JsCDJKaAepv+f9/5bj36tmQLZv9z6wszfAnD0H4mzTjEkQxW/Ouf6/5fT/mvn/y7pArlf7TvfGTc41q+3LlpplTpY2dEV27aPDrn9vOv6/bgFU/P+8MlDErXETxNlm6ROB3E8P8/6+zPr/LPH/4/D/933/33YCK9b7f17l72lpoALn2nUQZ8sYeX99nP//dc7/53DFzv+vW0IU/z8j8/mgFFC9Q+li2+JFVgVzQP4CKU76/zji/30/mGJ9iGIgOjRLCC1s4YpfHLd9fdTk9SGt1/sUX++WAKJjs4UwIw5mssv/61b/Lxv8v6AKNBZPevh7D6z4htX/K0DFasC0BPEjLvDxgv2vy5Z/L+mDFJ+R+XVc8sB0IQbKAADFMgx+"


def test_a_stream_of_another_encoder():
    want = np.frombuffer(zlib.decompress(base64.b64decode(PIXELS)), np.uint8).reshape(16, 16, 3)
    assert np.abs(J.decode(base64.b64decode(ICON)).astype(int) - want).mean() < 12


def test_large_frames_take_the_memory_of_their_data():
    data = J.encode(picture(40, 40))
    head, dims = data.index(b"\xff\xc2") + 5, (40).to_bytes(2, "big") * 2
    assert data[head : head + 4] == dims
    big = data[:head] + (3000).to_bytes(2, "big") * 2 + data[head + 4 :]
    tracemalloc.start()
    out = J.decode(big)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.shape == (3000, 3000, 3) and (out[200:] == out[-1, -1]).all() and out[:8].std() > 0
    assert peak < 1.3 * 4 * 9e6 * 1.5 + 27e6  # coefficients, of which most are never touched, and the tensor
    with pytest.raises(J.BadJpeg):
        J.decode(big, most_pixels=8_999_999)


def test_a_stream_cut_anywhere_decodes_or_is_rejected():
    rgb = picture(40, 56)
    data = J.encode(rgb, interval=4)
    scan = data.index(b"\xff\xda")
    off = []
    for end in range(scan + 20, len(data), 97):
        off.append(np.abs(J.decode(data[:end]).astype(int) - rgb).mean())
    assert off[-1] < off[len(off) // 2] < off[0]


def test_bad_streams_give_nulls_and_columns_stay(spark):
    good = J.encode(picture(10, 12))
    scan = good.index(b"\xff\xda")
    huge = good.replace(b"\x00\x0a\x00\x0c\x03", b"\xff\xff\xff\xff\x03", 1)
    rows = [(1, good, 5), (1, good, 5), (2, None, 5), (3, b"", None), (4, b"\xff\xd8\xff\xd9", 5), (None, b"GIF89a", 5), (5, good[: scan + 40], 5), (6, huge, 5), (7, good[: scan - 40], 5)]
    df = spark.createDataFrame(rows, "vec_id long, jpeg binary, height int").selectExpr("*", "vec_id AS width", "'x' AS other")
    out = M.decode_column(df)
    assert out.columns == ["vec_id", "other", "height", "width", "channels", "rgb"]
    got = {(r.vec_id, r.height, r.width, r.channels, len(r.rgb) if r.rgb else None) for r in out.collect()}
    assert got == {(1, 10, 12, 3, 360), (5, 10, 12, 3, 360)} | {(i, None, None, None, None) for i in (2, 3, 4, None, 6, 7)}
    assert out.count() == len(rows) and M.decode_column(df.limit(0)).count() == 0


def test_query_decodes_what_was_drawn(spark, sf):
    vectors = {r.vec_id: r.embedding for r in table(spark, sf, "embeddings").collect()}
    for r in M.query(spark, sf).collect():
        want = M.picture(np.array(vectors[r.vec_id]))
        assert np.abs(M.tensor(r.height, r.width, r.channels, r.rgb).astype(int) - want).mean() < 25
