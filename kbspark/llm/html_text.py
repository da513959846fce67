"""Main text of web pages by the maximum-scoring subsequence: words score positive, tags negative, and one scan finds the best region.

Weights are log-odds of pages whose markup itself says where the article is (`article` or `main`): how much more often a
word of a block of some kind, or a tag, stands inside it than outside. They are fitted on a bounded sample of such pages, on top of
fixed counts that stand for pages without that markup.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled pages that the weights are fitted on, at most: those of least hash of page_id and url.
LABELLED = 2_000
#: A tag; `>` may stand in quoted values. Comments, declarations and processing instructions are told apart first.
_MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

# Elements of HTML by what they mean for text.
RAW = frozenset("script style noscript template title textarea xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
ASIDE = frozenset("nav footer aside form menu dialog select button fieldset svg canvas object audio video map".split())
ARTICLE = frozenset("article main".split())
#: Words of class, id or role that name a part of the page other than its article.
OTHER = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners cookie cookies consent gdpr
    notice notices alert popup modal overlay newsletter subscribe subscription signup login register paywall share sharing social follow related recommended recommendations recommend
    trending popular sidebar sidebars widget widgets complementary menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager masthead footer copyright colophon
    contentinfo comment comments commentlist respond replies reply disqus skip""".split()
)
#: Of these, the words that name other articles and readers' articles: the only ones heeded on an `article` or `main`.
OTHER_ARTICLE = frozenset("comment comments reply replies related recommended recommendations trending popular promo promos sponsored ad ads advert advertisement teaser".split())
#: Words before one of them that make it a remark on the page, as in `has-sidebar`.
REMARK = frozenset("has with no without".split())
#: What the start of an element closes, if that is open within the same parent.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "option": {"select"}}


#: Parts of a page: its article, a form (which may hold the whole page), and others.
OWN, FORM, APART = 0, 1, 2
#: Marks of what holds a token, by its markup: `main` or `article`.
MAIN, INNER = 1, 2


def _part(name: str, attributes: str) -> tuple[int, int]:
    """What part of the page an element is, and whether its markup names it as main or article."""
    part = FORM if name == "form" else APART if name in ASIDE else OWN
    marks = {"main": MAIN, "article": INNER}.get(name, 0)
    if name in ("html", "body") or not attributes.strip():
        return part, marks
    named = OTHER_ARTICLE if marks else OTHER
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            part = APART
        elif (key, value) in (("role", "main"), ("role", "article"), ("itemprop", "articleBody")):
            marks |= MAIN if value == "main" else INNER
        elif key in ("class", "id", "role"):
            found = [w.lower() for w in _WORDS.findall(value)]
            if any(w in named and not (i and found[i - 1] in REMARK) for i, w in enumerate(found)):
                part = APART
    return part, 0 if part == APART else marks


class Token:
    """A tag (text None) or a run of text, with the block that holds it and what is around it: a link, another part of the page
    than the article, marks of the article."""

    __slots__ = ("tag", "text", "block", "link", "other", "article", "words")

    def __init__(self, tag, text, block, link, other, article):
        self.tag, self.text, self.block, self.link, self.other, self.article = tag, text, block, link, other, article
        self.words = len(text.split()) if text else 0


def tokens(page: str) -> list[Token]:
    """Tags and texts of a page in order. Comments, scripts, styles and titles give none."""
    out: list[Token] = []
    #: Open elements: name, part and marks with those around it, whether a link is around.
    stack: list[tuple] = [("", OWN, 0, False)]

    def add(text: str) -> None:
        if text:
            _, part, marks, link = stack[-1]
            block = next((e[0] for e in reversed(stack) if e[0] not in INLINE), "")
            out.append(Token(None, html.unescape(text), block, link, part != OWN, marks))

    def close(names, bounds=frozenset()) -> None:
        """Close the innermost open element of these names, and all within it, unless one of the bounds is further in."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in bounds:
                return

    at = 0
    while m := _MARKUP.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        attributes = m[3] or m[6] or ""
        if m[1] or m[4]:
            if name in INLINE:  # an inline element doesn't end what blocks are open in it
                close({name}, frozenset(e[0] for e in stack if e[0] not in INLINE))
            elif name == "p" and not any(e[0] == "p" for e in stack):
                pass
            else:
                close({name}, ARTICLE - {name} if name not in ("body", "html") else frozenset())
            out.append(Token(name, None, "", stack[-1][3], stack[-1][1] != OWN, stack[-1][2]))
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if end is None:
                at = len(page)
                break
            at = (page.find(">", end.start()) + 1) or len(page)
            continue
        if name not in INLINE and not attributes.rstrip().endswith("/"):
            if name in CLOSES:
                close(CLOSES[name], BOUNDS[name])
            elif name not in VOID:
                close({"p"}, frozenset(("td", "th", "table", "button", "object", *ARTICLE, *ASIDE)))
        _, part, marks, link = stack[-1]
        mine, marked = _part(name, attributes)
        if name == "header" and not marks:
            mine = APART
        # An article inside a form is none of the form's fields.
        part = mine if part == FORM and marked else max(part, mine)
        entry = (name, part, marks | marked, link or name == "a")
        out.append(Token(name, None, "", entry[3], part != OWN, entry[2]))
        if name not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(entry)
    else:
        add(page[at:])
    return out


def _long(words: int) -> str:
    return "short" if words < 5 else "middle" if words < 20 else "long"


def blocks_words(found: list[Token]) -> list[int]:
    """For each token the words of its block: of the texts between the block tags around it."""
    out, i = [0] * len(found), 0
    while i < len(found):
        j, n = i, 0
        while j < len(found) and (found[j].text is not None or found[j].tag in INLINE or found[j].tag == "br"):
            n += found[j].words
            j += 1
        out[i:j] = [n] * (j - i)
        i = max(j, i + 1)
    return out


def _kind(t: Token, words: int) -> str:
    return f"word {t.block} {'link' if t.link else 'plain'} {_long(words)}" if t.tag is None else f"tag {t.tag}"


def wanted(found: list[Token]) -> int:
    """The mark that tells a page's article from the rest: the narrowest that holds words, 0 if there is none."""
    held = [t.article for t in found if t.words and not t.other]
    return INNER if any(h & INNER for h in held) else MAIN if any(held) else 0


def counted(page: str) -> Counter:
    """(kind, inside) of a page's words and tags, if its markup says where the article is; empty if it doesn't."""
    found = tokens(page)
    mark = wanted(found)
    out: Counter = Counter()
    if mark:
        for t, n in zip(found, blocks_words(found)):
            out[(_kind(t, n), bool(t.article & mark) and not t.other)] += t.words if t.tag is None else 1
    return out


# Counts (inside, outside) that are added to those of the labelled pages, by part of the kind's name.
PRIOR_BLOCK = {"p": (60, 4), "h1": (20, 2), "h2": (20, 4), "h3": (20, 6), "h4": (16, 6), "blockquote": (20, 2), "pre": (20, 4), "li": (20, 5), "td": (16, 4), "th": (16, 4), "dd": (20, 5), "dt": (20, 5), "figcaption": (12, 3), "caption": (8, 4)}
PRIOR_LENGTH = {"short": (1, 3), "middle": (2, 2), "long": (6, 1)}
#: Least weight of a word in what the markup names as article, weights of a word beside it and of a word of another part.
SURE, BESIDE, APART_WORD = 1.0, -1.0, -0.5
#: Bounds of a word's and of a tag's weight, and a tag's weight in what the markup names as article.
WORD_LEAST, WORD_MOST, TAG_LEAST, TAG_MOST, TAG_SURE = -1.0, 2.0, -2.0, -0.05, -0.001


def word_prior(block: str, link: str, length: str) -> tuple[float, float]:
    inside, outside = PRIOR_BLOCK.get(block, (6, 6))
    a, b = PRIOR_LENGTH[length]
    inside, outside = inside * a, outside * b
    return (inside / 4, outside * 4) if link == "link" and block not in ("p", "h1", "h2", "h3", "blockquote") else (inside, outside)


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of each kind seen in labelled pages, with the fixed counts added; tags are never positive."""
    inside = sum(n for (k, i), n in counts.items() if i) or 1
    outside = sum(n for (k, i), n in counts.items() if not i) or 1
    scale = 1000 / max(inside, outside, 1000)  # so that the fixed counts keep their say, however many pages are labelled
    out = {}
    for kind in {k for k, _ in counts}:
        what, *parts = kind.split(" ")
        a, b = word_prior(*parts) if what == "word" else (2, 4)
        odds = math.log((counts.get((kind, True), 0) * scale + a) / (counts.get((kind, False), 0) * scale + b))
        out[kind] = odds if what == "word" else max(TAG_LEAST, min(TAG_MOST, odds - 0.5))
    return out


def _word_weight(kind: str, known: dict[str, float]) -> float:
    if kind not in known:
        a, b = word_prior(*kind.split(" ")[1:])
        return math.log(a / b)
    return known[kind]


def scores(found: list[Token], known: dict[str, float]) -> list[float]:
    """A score for each token: of its words together, or of the tag."""
    mark, out = wanted(found), []
    for t, n in zip(found, blocks_words(found)):
        inside = bool(t.article & mark)
        if t.tag is not None:
            sure = TAG_SURE if inside else TAG_MOST
            out.append(sure if inside or t.tag in INLINE or t.tag in VOID else known.get(f"tag {t.tag}", TAG_LEAST / 2))
        elif t.other:
            out.append(0.0 if inside else APART_WORD * t.words)
        elif mark and not inside:
            out.append(BESIDE * t.words)
        else:
            each = max(WORD_LEAST, min(WORD_MOST, _word_weight(_kind(t, n), known)))
            out.append((max(SURE, each) if inside else each) * t.words)
    return out


def best_region(values: list[float]) -> tuple[int, int]:
    """(from, to) of the first contiguous stretch of greatest sum, if that is above zero; (0, 0) if not."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, v in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += v
        if total > best:
            best, region = total, (start, i + 1)
    return region


def main_text(page: str | None, known: dict[str, float]) -> str:
    """Text of the best region: its blocks in order, without the parts that are not of the article."""
    found = tokens(page or "")
    a, b = best_region(scores(found, known))
    parts = [t.text if t.tag is None else "" if t.tag in INLINE else " " for t in found[a:b] if not t.other or t.tag is not None]
    return " ".join("".join(parts).split())


def _has_article(column: str = "html"):
    return F.lower(column).rlike(r"<(article|main)[\s>]")


def fit(pages: DataFrame) -> dict[str, float]:
    """Weights from at most LABELLED pages (page_id, url, html) whose markup names the article: those of least hash."""
    marked = pages.where(_has_article()).select(F.xxhash64("page_id", "url").alias("h"))
    bound = marked.orderBy("h").limit(LABELLED).agg(F.max("h")).first()[0]
    if bound is None:
        return {}
    sample = pages.where(_has_article() & (F.xxhash64("page_id", "url") <= bound)).select("html")

    def count(batches):
        for batch in batches:
            total: Counter = Counter()
            for page in batch.column(0).to_pylist():
                total.update(counted(page or ""))
            rows = list(total.items())
            yield pa.RecordBatch.from_arrays([pa.array([k for (k, _), _ in rows], pa.string()), pa.array([i for (_, i), _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())], ["kind", "inside", "n"])

    rows = sample.mapInArrow(count, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    return weights({(r["kind"], r["inside"]): r["n"] for r in rows.collect()})  # kinds of tags of a bounded sample


def extract(pages: DataFrame, known: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text) of pages (page_id, url, html): the main text of each, empty if there is none.

    known are weights, by default fitted on the pages. Null and empty pages have no text; null ids and urls and repeated rows
    give a row each, and an empty table none. Other columns don't matter. Nothing is shuffled; a page is read whole by one task.
    """
    pages = pages.select("page_id", "url", "html")
    known = fit(pages) if known is None else known

    def read(batches):
        for batch in batches:
            texts = [main_text(p, known) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.mapInArrow(read, f"{kinds}, text string")


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page: its main text and the text's length. Null and empty pages have the empty text, repeated rows a row
    each, and an empty table no row."""
    return extract(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
