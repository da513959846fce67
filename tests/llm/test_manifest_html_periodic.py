"""Merkle manifest, HTML extraction and periodic runs against brute force and planted cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm import html_text, manifest, periodic

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree string"


def _write(df, path, name):
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


# --- manifest


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row, text):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def _proof(levels, place):
    out = ""
    for level in levels[:-1]:
        run = place - place % 16
        out += "".join(level[run:place] + level[place + 1 : run + 16])
        place //= 16
    return out


def _refold(levels, place, now):
    for level in levels[:-1]:
        run = place - place % 16
        now = _h("".join(level[run:place] + [now] + level[place + 1 : run + 16]))
        place //= 16
    return now


def _expected(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[1])))
        trees[s] = _levels([_leaf(r, r[1]) for r in by_source[s]])
    top = _levels([trees[s][-1][0] for s in sources])
    out = []
    for at, s in enumerate(sources):
        for place, r in enumerate(by_source[s]):
            leaf = trees[s][0][place]
            hit = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = _leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])) if hit else leaf
            folded = _refold(top, at, _refold(trees[s], place, now))
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], _h(_proof(trees[s], place) + _proof(top, at)), folded, folded == top[-1][0]))
    return out


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


def test_manifest_against_whole_hashes(spark, tmp_path):
    rows = [(i, f"Text {i} ÄB" if i % 3 else "lower only", "en" if i % 4 else None, "hot" if i % 3 else f"s{i % 5}", i) for i in range(700)]
    rows += [(None, "A", None, None, None), (None, None, None, None, None), (None, None, None, None, None), (3, None, "de", "", 0), (7, "A1", "x", "alone", 1), (7, "A1", "x", "alone 2", 1), (900, "", "é", "ü", -5)]
    rows += [(5, "Same", "en", "hot", 1)] * 40  # repeated rows are leaves of their own
    df = spark.createDataFrame([(*r, "mine", "own") for r in rows], DOCS).repartition(5)
    got = manifest.op11_manifest(spark, _write(df, tmp_path, "documents")).collect()
    assert _sorted(got) == _sorted(_expected(rows))
    assert not all(r["verified"] for r in got) and any(r["verified"] for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_manifest_of_few_rows(spark, tmp_path, n):
    rows = [(i, f"T{i}", "en", "s", i) for i in range(n)]
    got = manifest.op11_manifest(spark, _write(spark.createDataFrame([(*r, None, None) for r in rows], DOCS), tmp_path, "documents")).collect()
    assert _sorted(got) == _sorted(_expected(rows))


def test_midstates_and_resume_are_sha256():
    r = random.Random(4)
    kids = [[_h(str(r.random())) for _ in range(r.randrange(1, 17))] for _ in range(50)]
    states = manifest.midstates(["".join(k) for k in kids])
    assert [s[-32:].hex() for s in states] == [_h("".join(k)) for k in kids] and [len(s) for s in states] == [32 * len(k) + 32 for k in kids]
    slots = [r.randrange(len(k)) for k in kids]
    new = [_h(str(r.random())) for _ in kids]
    blocks, count = manifest._blocks(["".join(k) for k in kids])
    block = np.frombuffer("".join(new).encode(), ">u4").astype(np.uint32).reshape(-1, 16)
    left = blocks.copy()
    for i, s in enumerate(slots):
        left[i, : s + 1] = 0  # nothing on the left of the slot is read
    folded = manifest.resume(block, np.array(slots), np.arange(50), left, count, manifest._states(states))
    assert [f.astype(">u4").tobytes().hex() for f in folded] == [_h("".join(k[:s] + [n] + k[s + 1 :])) for k, s, n in zip(kids, slots, new)]


# --- HTML


def test_best_region_is_the_best_of_all():
    r = random.Random(2)
    for _ in range(300):
        v = [r.choice([-3, -2, -1, 0, 1, 2, 4]) for _ in range(r.randrange(0, 14))]
        a, b = html_text.best_region(v)
        best = max([0, *(sum(v[i:j]) for i in range(len(v)) for j in range(i + 1, len(v) + 1))])
        assert sum(v[a:b]) == best and (best > 0 or a == b == 0)


_P = "".join(f"<p>Sentence {i} of the story has <b>several</b> words, &amp; some <a href='/x'>links</a> of its own.</p>\n" for i in range(8))
_STORY = "The story " + " ".join(f"Sentence {i} of the story has several words, & some links of its own." for i in range(8))
_NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>'
_COMMENTS = '<section id="comments"><h2>Comments</h2><article class="comment"><p>I liked this story a lot, thank you for all of it.</p></article></section>'


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>No</title><style>p{{a:b}}</style><script>var t='</p><p>no no no</p>';</script></head><body>{_NAV}<article><h1>The story</h1>{_P}</article><footer>&copy; nobody</footer></body></html>",
        f"<body><header><p>Welcome to our site, the best of all sites there are</p></header>{_NAV}<main><article><header><h1>The story</h1></header>{_P}<div class='ad'>Buy this and that and more of it now</div>{_COMMENTS}</article><aside><p>A long text about something else, which nobody reads at all.</p></aside></main></body>",
        f"<body><div class='cookie-notice'><p>We use cookies to make this site work for you and others.</p></div><div id='menu'><a href='/'>Home</a></div><div class='content has-sidebar'><h1>The story</h1>{_P}</div><div class='sidebar'><p>Other things that we wrote about this year.</p></div>{_COMMENTS}<div id='footer'>All rights reserved by nobody at all</div></body>",
        f"<form action='/all'><div class='nav'>a b c</div><div role='main'><h1>The story</h1>{_P}<form><label>Your name</label><input value='x'><button>Send it</button></form></div></form>",
        f"<!DOCTYPE html><!-- <p>old text</p> --><body><p class='newsletter'>Subscribe to our newsletter<div><H1>The&nbsp;story</H1>{_P.replace('</p>', '').replace('<p>', '<P>')}</div><div class='comment-list'><p>What a story that was, I say</div>",
        f"<article><h1>The story</h1>{_P}<p hidden>not for readers</p><div style='display: none'>nor this</div><textarea>type here</textarea><select><option>one<option>two</select></article><div>Short words beside</div><p>And a longer remark that stands beside the article itself.</p>",
    ],
)
def test_main_text_of_layouts(page):
    for known in ({}, html_text.weights(html_text.counted(page))):
        assert html_text.main_text(page, known) == _STORY


def test_main_text_of_odd_pages():
    text = lambda p: html_text.main_text(p, {})
    assert text(None) == text("") == text("<nav>a b</nav>") == text("<script>x") == text("<!-- never ends <p>a b c d e f</p>") == ""
    assert text("<p>1 &lt; 2 and 3 > 2, a < b</p>") == "1 < 2 and 3 > 2, a < b"
    assert text("<article><p>a<br>b<wbr>c</p><ul><li>d<li>e</ul><table><tr><td>f<td>g</table></article>") == "a bc d e f g"
    assert text("<article><p title='>'>quoted</p><p data-x=\"</p>\">twice</article>") == "quoted twice"
    assert len(text("<article>" + "<p>word</p>" * 100_000 + "</article>").split()) == 100_000


def test_html_query(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<body>{_NAV}<article><h1>The story</h1>{_P}</article></body>", "t", 1) for i in range(20)]
    rows += [(None, None, None, None, None), (30, "u", "", "x", 2), (31, None, f"<body>{_NAV}<div><h1>The story</h1>{_P}</div></body>", "x", 3)] + [(32, "u", "<p>One line of words here.</p>", "", 0)] * 2
    columns = "page_id long, url string, html string, text string, n_chars int"
    got = html_text.op12_html(spark, _write(spark.createDataFrame(rows, columns), tmp_path, "pages")).collect()
    want = [(r[0], r[1], _STORY if r[2] and "story" in r[2] else "One line of words here." if r[2] else "") for r in rows]
    assert _sorted(got) == _sorted((*w, len(w[2])) for w in want)
    empty = _write(spark.createDataFrame([], columns), tmp_path / "none", "pages")
    assert html_text.op12_html(spark, empty).collect() == []


def test_fit_is_bounded_and_finds_boilerplate(spark, monkeypatch):
    page = f"<body>{_NAV}<div>Buy this</div><article><h1>The story</h1>{_P}</article></body>"
    pages = spark.createDataFrame([(i, str(i), page) for i in range(60)], "page_id long, url string, html string")
    known = html_text.fit(pages)
    assert known["word p plain middle"] > 0 > known["word li link short"] and known["word div plain short"] < 0 and all(w < 0 for k, w in known.items() if k.startswith("tag"))
    monkeypatch.setattr(html_text, "LABELLED", 10)
    seen = []
    monkeypatch.setattr(html_text, "weights", lambda counts: seen.append(sum(n for (k, i), n in counts.items() if k == "tag h1" and i)) or {})
    html_text.fit(pages)
    assert seen == [20]  # the start and the end tag in each of ten pages
    assert html_text.fit(pages.where("false")) == {}


# --- periodic runs


def _runs(w):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if i > s and n >= max(24, 3 * q) and not any(q % d == 0 and all(w[s + k] == w[s + k + d] for k in range(n - d)) for d in range(1, q)):
                out.append((s, n, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def _periodic_words(r):
    w = []
    while len(w) < r.choice([30, 90, 200]):
        k = r.choice([1, 2, 3, 50])
        unit = [r.randrange(k) for _ in range(r.randrange(1, 30))]
        w += unit if r.random() < 0.4 else (unit * 40)[: r.randrange(3 * len(unit), 60 + 3 * len(unit))]
        if r.random() < 0.2:
            w += w[-r.randrange(1, len(w) + 1) :] * r.choice([1, 2, 3])
    return w


def test_runs_against_brute_force():
    r = random.Random(7)
    texts = [_periodic_words(r) for _ in range(250)] + [[], [1], [1] * 23, [1] * 24, [1, 2] * 12, list(range(8)) * 3, list(range(9)) * 3, list(range(9)) * 2 + list(range(8))]
    want = [_runs(w) for w in texts]
    assert sum(map(len, want)) > 300
    assert [periodic.runs(w) for w in texts] == want
    flat = np.array([x for w in texts for x in w], np.int32)
    assert periodic.texts_runs(flat, np.concatenate([[0], np.cumsum([len(w) for w in texts])])) == want


def test_periodic_query_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, " \n".join(f"w{x}" for x in _periodic_words(r)), "c", 1) for i in range(150)]
    rows += [(200 + i, " ".join(f"x{r.randrange(10**6)}" for _ in range(r.randrange(1, 400))), None, 2) for i in range(150)]
    rows += [(None, "a b " * 30, "x", 0), (None, None, None, None), (1000, "", "x", 1), (1001, " \t\n", "x", 1), (1002, "no " * 5000, "x", 1)] + [(1003, "é ß " * 20 + "end", "x", 1)] * 3
    columns = "doc_id long, text string, collapsed string, runs int"
    got = periodic.op13_periodic(spark, _write(spark.createDataFrame(rows, columns).repartition(3), tmp_path, "documents")).collect()
    want, changed = [], 0
    for doc_id, text, *_ in rows:
        w, n = (text or "").split(), len((text or "").split())
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        found = _runs(w)
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2])) if found else (None, None, None)
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in found)]
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(kept))))
    assert changed > 15 and _sorted(got) == _sorted(want)
    empty = _write(spark.createDataFrame([], columns), tmp_path / "none", "documents")
    assert periodic.op13_periodic(spark, empty).collect() == []


def test_collapse_keeps_one_period(spark):
    docs = spark.createDataFrame([("k", "so it goes " * 9 + "and ends")], "doc_id string, text string")
    row = periodic.collapse(docs).withColumn("n", F.size("runs")).first()
    assert row["doc_id"] == "k" and row["collapsed"] == "so it goes and ends" and [tuple(x) for x in row["runs"]] == [(0, 27, 3)]
