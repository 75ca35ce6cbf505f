"""Main text of HTML pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by the element that holds them, positive where labelled pages have
such words in their article more often than outside; tags score below zero. Class, id and role names of elements are a
learned feature too: a name whose words labelled pages have mostly outside their article lowers the score of all words
below it. The contiguous run of the highest sum, found in one linear scan, is the content region; words in it below a
name that is STRONG outside are no part of the text. The few names of PRIOR, which stand for reader comments and adverts
even inside an article element, have such a weight from the start, as whole names only; no other is known beforehand. Left out before the scan are only
elements that HTML itself defines as something else (scripts, styles, forms, nav, aside, footer, a header outside an
article, and so on) and those with the attribute hidden.

Labelled pages are those that mark their article themselves (an article element); a bounded sample of distinct ones is
counted. Pages need no such mark to be extracted.

Tags are found in time linear in the page: a tag ends at the first > outside quotes, and one that comes to another <
first is text. Defined results: null or empty html gives an empty text; pages without words too; unclosed elements end
with the page; repeated rows are each extracted; of two regions with one sum the first is taken; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import short_batches

#: Bound on labelled pages for the fit, those of the lowest hashes; equal pages count as one.
SAMPLE_PAGES = 2_000
#: Names are a feature from so many words on; log-odds from which words are no part of the text.
LEAST_WORDS, STRONG = 20, -2.0

# Element names of the HTML standard by their use.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select title head".split())
LEFT_OUT = frozenset("nav footer aside form button menu dialog label input fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())

# Whole names of reader comments and adverts.
PRIOR = tuple("comment comments comment-list commentlist reader-comments user-comments disqus_thread respond ad ads advert advertisement sponsored".split())

_COMMENT_END = re.compile(r"--!?>")
_NAME = re.compile(r"(/?)([A-Za-z][^\s/><]*)")
_BREAK = re.compile(r"[\"'<>]")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NONE = re.compile(r"display\s*:\s*none", re.I)

#: (kind, name or text, attributes): kinds are 0 text, 1 opening tag, 2 closing tag.
Token = tuple[int, str, str]


def _attributes(more: str) -> tuple[bool, list[str]]:
    """Whether attributes hide the element, and the names it has by class, id and role."""
    hidden, names = False, []
    for m in _ATTRIBUTE.finditer(more):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" and value.lower() != "false" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _NONE.search(value):
            hidden = True
        elif key in ("class", "id", "role"):
            names += [x[:48] for x in value.lower().split()[:8]]
    return hidden, names


def _tag_end(html: str, at: int) -> int:
    """Place of the > that ends a tag, or -1 if another < comes first."""
    while m := _BREAK.search(html, at):
        if m[0] == ">":
            return m.start()
        if m[0] == "<":
            return -1
        close = html.find(m[0], m.end())
        if close < 0:
            return html.find(">", m.end())
        at = close + 1
    return -1


def _split(html: str) -> list[Token]:
    """Texts and tags, without comments and what raw elements hold."""
    found: list[Token] = []
    at, start, last = 0, 0, html.rfind(">")
    unclosed: set[str] = set()
    while 0 <= (at := html.find("<", at)) <= last:
        if html.startswith("<!--", at):
            m = _COMMENT_END.search(html, at + 4)
            tag, end = None, m.end() if m else len(html)
        elif html.startswith(("<!", "<?"), at):
            tag, end = None, html.find(">", at) + 1
        else:
            tag = _NAME.match(html, at + 1)
            stop = _tag_end(html, tag.end()) if tag else -1
            if stop < 0:
                at += 1
                continue
            end = stop + 1
        if start < at:
            found.append((0, html[start:at], ""))
        if tag:
            name, more = tag[2].lower(), html[tag.end() : end - 1]
            if tag[1]:
                found.append((2, name, ""))
            elif name in RAW and name != "head" and not more.rstrip().endswith("/"):
                m = None if name in unclosed else re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, end)
                if m is None:
                    unclosed.add(name)
                stop = html.find(">", m.end()) if m else -1
                end = stop + 1 if stop >= 0 else len(html)
            else:
                found.append((1, name, more))
        at = start = end
    if start < len(html):
        found.append((0, html[start:], ""))
    return found


def tokens(html: str) -> list[Token]:
    """Words and tags of a page, without elements that are never content; one of these that never closes loses only its tag."""
    found = _split(html)
    closes = _matching(found)
    out: list[Token] = []
    at, articles = 0, 0
    while at < len(found):
        kind, name, more = found[at]
        if kind == 1 and name not in VOID:
            gone = name in LEFT_OUT or name == "head" or name == "header" and not articles or bool(more) and _attributes(more)[0]
            if gone and name not in ("html", "body"):
                at = closes.get(at, at) + 1
                continue
            articles += name == "article"
        elif kind == 2:
            articles -= name == "article" and articles > 0
        out.append(found[at])
        at += 1
    return out


def _matching(found: list[Token]) -> dict[int, int]:
    """Index of the closing tag of each opening one."""
    open_by: dict[str, list[int]] = {}
    out = {}
    for i, (kind, name, _) in enumerate(found):
        if kind == 1 and name not in VOID:
            open_by.setdefault(name, []).append(i)
        elif kind == 2 and open_by.get(name):
            out[open_by[name].pop()] = i
    return out


Weights = dict[str, float]


def _in_context(found: list[Token], w: Weights | None = None) -> Iterator[tuple[int, str, str, bool, list[str] | float]]:
    """Tokens with the element that words stand in, whether inside an article, and the names of the nearest element that has some.

    With weights, instead of the names the lowest weight of all names that a word is below, 0 if none.
    """
    closes = _matching(found)
    ends: dict[int, list[str] | float] = {}
    block, links, articles = "", 0, 0
    names: list[str] | float = [] if w is None else 0.0
    for i, (kind, name, more) in enumerate(found):
        if kind == 1:
            if name == "a":
                links += 1
            elif name not in INLINE and name not in VOID:
                block = name
            articles += name == "article"
            if more and i in closes and (own := _attributes(more)[1]):
                ends[closes[i]] = names
                names = own if w is None else min(names, min(w.get("c:" + x, 0.0) for x in own))
        elif kind == 2:
            if name == "a":
                links = max(0, links - 1)
            elif name not in INLINE:
                block = f"/{name}"
            articles -= name == "article" and articles > 0
        yield kind, name, f"{block}>a" if links else block, articles > 0, names
        names = ends.pop(i, names)


#: Scores without labelled pages: a word, a word in a link, a tag.
PLAIN: Weights = {"word": 1.0, "link": -0.5, "tag": -0.75} | {"c:" + x: -4.0 for x in PRIOR}


def count_page(html: str) -> Counter:
    """Of a labelled page: words by element and by names, and tags by name, inside (1) and outside (0) its article."""
    out: Counter = Counter()
    for kind, name, where, inside, names in _in_context(tokens(html)):
        if kind == 0:
            if n := len(name.split()):
                inside = inside and not any(x in PRIOR for x in names)
                out["w:" + where, inside] += n
                for x in names:
                    out["c:" + x, inside] += n
        else:
            out["t:" + name, inside or name == "article"] += 1
    return out


def weights(counts: dict[tuple[str, bool], int]) -> Weights:
    """Log-odds of being inside, for words clipped to -2..2 and for names where negative; tags score from -1.5 to -0.1."""
    out = dict(PLAIN)
    for key in {k[0] for k in counts}:
        yes, no = counts.get((key, True), 0), counts.get((key, False), 0)
        odds = math.log((yes + 1) / (no + 1))
        if key[0] == "w" and yes + no >= LEAST_WORDS:
            out[key] = max(-2.0, min(2.0, odds if abs(odds) > 0.1 else 0.1))
        elif key[0] == "c" and yes + no >= LEAST_WORDS and odds < -0.1:
            out[key] = max(-4.0, odds)
        elif key[0] == "t":
            share = (yes + 1) / (yes + no + 2)
            out[key] = -0.1 - 1.4 * (1 - share)
    return out


def extract(html: str | None, w: Weights = PLAIN) -> str:
    """The text of the best contiguous region: blocks in page order, one to a line."""
    found = tokens(html or "")
    best, run, start, region = 0.0, 0.0, 0, (0, 0)
    outside = bytearray(len(found))
    for i, (kind, name, where, _, named) in enumerate(_in_context(found, w)):
        outside[i] = named <= STRONG
        if kind == 0:
            n = len(name.split())
            word = w.get("w:" + where, w["link"] if where.endswith(">a") else w["word"])
            # Words that are no part of the text neither add to a region nor part it.
            score = 0.0 if outside[i] or not n else n * (min(word, named) if named < 0 else word)
        else:
            score = 0.0 if outside[i] else w.get("t:" + name, w["tag"])
        if run <= 0:
            run, start = 0.0, i
        run += score
        if run > best:
            best, region = run, (start, i + 1)
    lines, block = [], []
    for i, (kind, name, _) in enumerate([*found[slice(*region)], (1, "p", "")], region[0]):
        if kind == 0:
            if not outside[i]:
                block.append(name)
        elif name not in INLINE:
            if line := " ".join(unescape("".join(block)).split()):
                lines.append(line)
            block = []
    return "\n".join(lines)


def fit(pages: DataFrame, rows: int = SAMPLE_PAGES, html: str = "html") -> Weights:
    """Weights from at most ``rows`` pages with an article element, those of the lowest hashes; the driver gets sums by element name alone."""
    short_batches(pages.sparkSession)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch["html"]:
                total.update(count_page(page))
            yield pd.DataFrame([(k[:64], i, n) for (k, i), n in total.items()], columns=["key", "inside", "n"])

    labelled = pages.where(F.col(html).rlike("(?i)<article")).select(F.col(html).alias("html"))
    # Hashes alone are ordered, each once; the pages up to the last one follow, one for each hash.
    last = labelled.select(F.xxhash64("html").alias("h")).distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    sample = labelled.where(F.xxhash64("html") <= F.lit(last)) if last is not None else labelled.limit(0)
    sample = sample.groupBy(F.xxhash64("html").alias("h")).agg(F.min("html").alias("html")).select("html")
    sums = sample.mapInPandas(counted, "key string, inside boolean, n long").groupBy("key", "inside").agg(F.sum("n").alias("n"))
    return weights({(r.key, r.inside): r.n for r in sums.orderBy(F.desc("n"), "key", "inside").limit(1000).collect()})


def with_text(pages: DataFrame, w: Weights, into: str = "text", html: str = "html") -> DataFrame:
    """pages with a column of their main text."""
    short_batches(pages.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(x, w) for x in batch], dtype=object)

    return pages.withColumn(into, pandas_udf(run, "string")(F.coalesce(pages[html].cast("string"), F.lit(""))))
