"""Main-text extraction from HTML by consensus host paths.

1. Each page's containers are scored on their own: text of the paragraphs below, full for the parent and half for the one
   above, link text counted against it. Lists and tables are no containers, but parts of the one around them. A container is
   widened to the outermost article around it, else to the nearest main; on pages without these, to the lowest element that
   holds ``MOST_TEXT`` of the page's, so that sections side by side come together, else to the highest element below body with
   paragraphs or headings of its own, and to a body with such text where no element holds half of the page's. All
   containers of positive score vote for their generalised path, which is the chain of tags and classes with numbers blanked.
2. Spark sums the votes by (host, path), with map-side sums, and takes the best path of each host.
3. Every page is read again, and the text of the elements on the winning path is taken, widened as far as an article, a main
   or text beside it tells; a page that has no such element, or no text there, falls back on its own best container. A
   headline (h1) in front of the text comes along where the text holds none.

Boilerplate never counts nor comes out, on the path or below it: menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments, told by tag, role or the words of class and id. Only block containers are judged by
words: headings, paragraphs, list items, cells and inline elements never are, but for paragraphs and items whose class is
that of an advert. Inside an article or main, for ids and for words that also name subjects (``WEAK_WORDS``), a class or id
counts only if all its words are of boilerplate or layout: ``related-posts`` does, ``related-work`` does not; inside an
article an id of weak words alone (``discussion``) does not either. Words alone do not drop an element with
most of the page's text if it is, or holds, an article or main; on pages without these, an element that is named by words of
layout only and holds an h1, if there is one. Words of comments and adverts are overruled by an article with an h1 only. Nor
do words of a header inside an article: there headings stay, as in a header element. A form is dropped like an element named
by words, as some sites put the whole page into one. Where words drop all of a page's text, they are not looked at.

An article (or, without one, a main) with text and an h1, or the only one on a page that has no h1 elsewhere, claims the
page: nothing outside it is scored, however long, and links inside it do not count against it. A page without a container of
positive score, as one of links only, gives all its text outside boilerplate.

A page is read once, from left to right, in time proportional to its length: open elements are found by tag, not by search,
and the path of a deep element is a digest and its last steps, of ``PATH_CHARS`` at most.

Edge cases: null and empty html give an empty text; pages without a host share one group; broken markup (open tags,
stray ends, cut files) is closed as browsers do, and a tag that the file's end cuts is no text; repeated rows are extracted
alike and all vote; equal votes go to the path first in order; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.runtime import prepare
from quillmap.plans.storage import keep, small

# HTML's void, raw-text, inline and paragraph-like elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption summary".split())
PARTS = frozenset("ul ol menu dl table caption colgroup thead tbody tfoot tr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# Boilerplate by element, role and word of a class or id.
DROP_TAGS = frozenset("head nav header footer aside script style noscript template iframe noembed noframes object embed svg canvas button select option textarea input dialog menu title audio video map".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox banner banners promo promos promotion promoted sponsor sponsored sponsors "
    "cookie cookies consent gdpr notice notices alert popup modal overlay paywall sidebar aside widget widgets rail nav navbar navigation menu menus breadcrumb breadcrumbs "
    "pagination pager footer header masthead topbar share sharing social follow related recommended recommendations newsletter subscribe subscription signup login "
    "comment comments commentlist disqus reply replies respond discussion form search toolbar copyright outbrain taboola skiplink hidden".split()
)
#: Words that name subjects as well.
WEAK_WORDS = frozenset("ad ads adv alert aside comment consent copyright discussion follow form header hidden login menu modal notice notices overlay rail related reply replies respond search share sharing signup social subscribe subscription toolbar".split())
#: Those that inside an article say nothing as a class alone; as an id alone no weak word does.
SUBJECT_WORDS = frozenset("discussion follow form search".split())
#: Words that say nothing of their own beside those of boilerplate.
GLUE_WORDS = frozenset(
    "site page main global top bottom left right primary secondary inner outer box bar list area section block wrap wrapper container content item items group row col column "
    "button buttons link links icon icons post posts article articles story stories entry media slot unit space text title head foot thread user your the and by x px id js".split()
)
#: Elements that words may drop, and those that only the class of an advert may.
JUDGED = frozenset("div section ul ol dl table tbody fieldset figure center details article form".split())
AD_JUDGED = frozenset("p li tr td".split())
AD_CLASSES = frozenset("ad ads advert adverts advertisement advertisements adslot ad-slot sponsored".split())
HEADER_WORDS = frozenset("header masthead".split())
LAYOUT_WORDS = HEADER_WORDS | frozenset("sidebar aside widget widgets rail nav navbar navigation menu menus breadcrumb breadcrumbs footer topbar toolbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies ad ads advert sponsored promo promoted related".split())

#: Share of the page's shown text that the lowest common container of its sections holds.
MOST_TEXT = 5 / 6
#: Longest path that is written out; of longer ones the front is a digest.
PATH_CHARS = 400

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_REST = re.compile(r"(?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=(?!\s*[\"']))*+>")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_NEGATED = re.compile(r"^(?:no|has|with|without|not|is)[-_]", re.I)
_NUMBER = re.compile(r"\d+")
_GAP = re.compile(r"\s+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
# Tags that end an open element of the first set, unless one of the second set lies between.
IMPLIED = {name: (own, bar) for own, bar in (("li", "ul ol menu"), ("dt dd", "dl"), ("tr", "table"), ("td th", "tr table"), ("option", "select"), ("a", "")) for name in own.split()}


def tokens(s: str) -> Iterator[tuple[str, str, str]]:
    """``kind, name or text, attributes`` in order; kind is ``text``, ``open`` or ``close``. Each character is read a bounded number of times."""
    at, text, last, quoted = 0, 0, s.rfind(">"), True
    while (at := s.find("<", at)) >= 0:
        follow = s[at + 1 : at + 2]
        closing = follow == "/"
        m = _NAME.match(s, at + 1 + closing)
        if not m and not closing and follow not in ("!", "?"):
            at += 1
            continue
        if at > text:
            yield "text", s[text:at], ""
        if at > last and not s.startswith("<!--", at):
            return  # the file ends inside this tag
        if m:
            rest = _TAG_REST.match(s, m.end()) if quoted else None
            quoted = rest is not None  # after a quote without end, tags end at the next bracket
            end = rest.end() if rest else s.index(">", m.end()) + 1 if m.end() <= last else len(s)
            name = m[0].lower()
            yield "close" if closing else "open", name, s[m.end() : end - 1]
            if name in RAW and not closing:
                over = _RAW_END[name].search(s, end)
                end = over.end() if over else len(s)
        elif s.startswith("<!--", at):
            end = s.find("-->", at + 2) + 3
            end = end if end > 2 else len(s)
        elif s.startswith("<![CDATA[", at):
            end = s.find("]]>", at) + 3
            end = end if end > 2 else len(s)
        else:
            end = s.index(">", at) + 1
        at = text = end
    if text < len(s):
        yield "text", s[text:], ""


def _named(classes: list[str], name: str, strict: bool) -> set[str]:
    """The words of boilerplate by which classes and an id name an element."""
    bad: set[str] = set()
    for k, c in enumerate([*classes, name]):
        words = {w.lower() for w in _WORDS.findall(c)} if not _NEGATED.match(c) else set()
        own = words & DROP_WORDS
        whole = all(w in DROP_WORDS or w in GLUE_WORDS or w.isdigit() for w in words)
        if strict and words <= (WEAK_WORDS - HEADER_WORDS if k == len(classes) else SUBJECT_WORDS):
            continue
        bad |= own if whole else set() if strict or k == len(classes) else own - WEAK_WORDS
    return bad


class Page:
    """The elements and text runs of one page, in order; with ``words`` false, words of classes and ids drop nothing."""

    def __init__(self, source: str, words: bool = True):
        self.parent, self.tag, self.path = [-1], ["#"], [""]
        self.dropped, self.article, self.banner, self.heading = [False], [False], [False], [False]
        self.box = [0]  # the container that text right in an element counts for
        self.words: dict[int, set[str]] = {}  # the words by which alone an element is dropped
        self.barred = [False]  # dropped itself by tag, role or style
        self.runs: list[tuple[int, int, str, bool]] = []  # element, block, text, inside a link
        self.by_words = words
        self._read(source)
        if self.words:
            self._spare()
        self.claimed = self._claim()

    def _read(self, s: str) -> None:
        stack, block = [0], 0
        places: dict[str, list[int]] = {}  # where in the stack each tag is open
        blocks: list[int] = []  # the same for all elements that are not inline

        def cut(depth: int) -> None:
            while len(stack) > depth:
                name = self.tag[stack.pop()]
                places[name].pop()
                if name not in INLINE:
                    blocks.pop()

        def open_at(names: str) -> int:
            return max((places[n][-1] for n in names.split() if places.get(n)), default=0)

        for kind, name, attrs in tokens(s):
            if kind == "text":
                self.runs.append((stack[-1], block, name, bool(places.get("a"))))
                continue
            if kind == "close":
                depth = open_at(name)
                if depth and not (name in INLINE and blocks and blocks[-1] > depth):  # an inline end does not close blocks
                    cut(depth)
                if name not in INLINE:
                    block += 1
                continue
            if name == "br":
                self.runs.append((stack[-1], block, " ", False))
                continue
            if name in CLOSES_P and places.get("p"):
                cut(places["p"][-1])
            elif name in IMPLIED:
                own, bar = IMPLIED[name]
                depth = open_at(own)
                if depth > (open_at(bar) if bar else blocks[-1] if blocks else 0):
                    cut(depth)
            if name not in INLINE:
                block += 1
            node = self._add(stack[-1], name, attrs)
            if name in VOID or name in RAW or attrs.endswith("/") and name in ("svg", "path", "use"):
                continue
            places.setdefault(name, []).append(len(stack))
            if name not in INLINE:
                blocks.append(len(stack))
            stack.append(node)

    def _add(self, parent: int, name: str, attrs: str) -> int:
        found = {}
        if "=" in attrs or "hidden" in attrs:
            for a in _ATTR.finditer(attrs):
                found.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        classes = found.get("class", "").split()
        drop = name in DROP_TAGS or found.get("role", "").lower() in DROP_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        article = self.article[parent] or name in ("article", "main")
        bad: set[str] = set()
        if self.by_words and name in JUDGED:
            bad = _named(classes, found.get("id", ""), self.article[parent])
            bad &= COMMENT_WORDS if name == "article" else DROP_WORDS
        elif self.by_words and name in AD_JUDGED:
            bad = {c.lower() for c in classes} & AD_CLASSES
        if self.by_words and name == "form":
            bad.add("form")
        banner = name == "header"
        if banner and article:
            drop = False  # its headings are the article's own
        elif article and bad and bad <= HEADER_WORDS:
            banner, bad = True, set()
        elif bad and not drop:
            self.words[len(self.parent)] = bad
        self.parent.append(parent)
        self.tag.append(name)
        self.box.append(self.box[parent] if name in INLINE or name in LEAF or name in PARTS else len(self.parent) - 1)
        key = name + "".join("." + _NUMBER.sub("#", c.lower()) for c in sorted(set(classes)))
        path = f"{self.path[parent]}>{key}" if parent else key
        self.path.append(path if len(path) <= PATH_CHARS else "~" + hashlib.blake2b(path.encode("utf-8", "replace"), digest_size=16).hexdigest())
        self.barred.append(drop)
        self.dropped.append(self.dropped[parent] or drop or bool(bad))
        self.article.append(article)
        self.banner.append(self.banner[parent] or banner)
        self.heading.append(self.heading[parent] or name in ("h1", "h2", "h3"))
        return len(self.parent) - 1

    def _spare(self) -> None:
        """Takes back drops by words of elements that hold most of the page's paragraph text."""
        size = len(self.parent)
        hard, loud = [False] * size, [False] * size  # never spared; named by other words than those of layout
        article, head, held = [False] * size, [False] * size, [0] * size
        for k in range(1, size):
            hard[k] = hard[self.parent[k]] or self.barred[k]
            article[k], head[k] = self.tag[k] in ("article", "main") and not hard[k] and k not in self.words, self.tag[k] == "h1" and not hard[k]
        for holds in (article, head):
            for k in range(size - 1, 0, -1):
                holds[self.parent[k]] = holds[self.parent[k]] or holds[k]
        for k in range(1, size):
            up, bad = self.parent[k], self.words.get(k, set())
            # Comments may be articles, but the page's headline is not among them.
            hard[k] = hard[k] or hard[up] or bool(bad & COMMENT_WORDS) and not (article[k] and head[k])
            loud[k] = loud[up] or not bad <= LAYOUT_WORDS
        for node, _, text, link in self.runs:
            if not link and not hard[node]:
                held[node] += len(text) - text.count(" ")
        for k in range(size - 1, 0, -1):
            held[self.parent[k]] += held[k]

        def spared(k: int) -> bool:
            return not hard[k] and 2 * held[k] > held[0] and (article[k] or not article[0] and not loud[k] and (head[k] or not head[0]))

        for k in range(1, size):
            self.dropped[k] = self.dropped[self.parent[k]] or self.barred[k] or k in self.words and not spared(k)

    def _claim(self) -> list[bool] | None:
        """Whether each element lies in the article or main that claims the page; none if nothing does."""
        size = len(self.parent)
        head, first = [0] * size, {name: [0] * size for name in ("article", "main")}
        for k in range(1, size):
            up = self.parent[k]
            head[k] = k if self.tag[k] == "h1" else head[up]
            for name, outer in first.items():
                outer[k] = outer[up] or (k if self.tag[k] == name else 0)
        heads, texts = set(), set()
        for node, _, text, _ in self.runs:
            if self.shown(node) and not text.isspace():
                if head[node]:
                    heads.add(node)
                elif not self.heading[node]:
                    texts.add(node)
        for outer in first.values():
            filled = {outer[k] for k in texts if outer[k]}
            tops = filled & {outer[k] for k in heads} or (filled if len(filled) == 1 and not heads else set())
            if tops:
                return [outer[k] in tops for k in range(size)]
        return None

    def shown(self, node: int) -> bool:
        """Whether text of ``node`` may come out; in an article's header only headings do."""
        return not self.dropped[node] and (self.heading[node] or not self.banner[node])

    def _credit(self) -> dict[int, int]:
        """Letters of the paragraphs right in each container, doubled; those of links are taken off."""
        credit: dict[int, int] = {}
        for node, _, text, link in self.runs:
            if not self.shown(node) or not (n := len(text) - text.count(" ")) or text.isspace():
                continue
            if self.claimed and not self.claimed[node]:
                continue
            box = self.box[node]
            credit[box] = credit.get(box, 0) + (0 if link and self.claimed else -2 * n if link else 2 * n)
        return credit

    def _common(self, credit: dict[int, int]) -> int:
        """The lowest element that holds most of the page's text."""
        held = [max(0, credit.get(k, 0)) for k in range(len(self.parent))]
        for k in range(len(held) - 1, 0, -1):
            held[self.parent[k]] += held[k]
        return max(k for k, n in enumerate(held) if n > MOST_TEXT * held[0] or k == 0)

    def _widened(self, credit: dict[int, int], common: bool) -> list[int]:
        """For each element the one that it is widened to, as far as an article, a main or text beside it tells; with ``common``, sections side by side too."""
        size = len(self.parent)
        article, main, high = [0] * size, [0] * size, [0] * size
        for k in range(1, size):
            up, name = self.parent[k], self.tag[k]
            article[k] = article[up] or (k if name == "article" else 0)
            main[k] = k if name == "main" else main[up]
            high[k] = high[up] or (k if credit.get(k, 0) > 0 and name not in ("html", "body") else 0)
        wide = [article[k] or main[k] or high[k] or k for k in range(size)]
        if common and not any(n > 0 and (article[k] or main[k]) for k, n in credit.items()):
            top = self._common(credit)
            below = [k == top for k in range(size)]
            for k in range(1, size):
                below[k] = below[k] or below[self.parent[k]]
                if below[k] and not (high[top] and high[top] < top):
                    wide[k] = top
        body = next((k for k, n in credit.items() if n > 0 and self.tag[k] in ("#", "html", "body")), None)
        if body is not None:
            held: dict[int, int] = {}
            for k, n in credit.items():
                if n > 0 and k != body:
                    held[wide[k]] = held.get(wide[k], 0) + n
            if held and 2 * max(held.values()) < credit[body] + sum(held.values()):
                below = [k == body for k in range(size)]
                for k in range(1, size):
                    below[k] = below[k] or below[self.parent[k]]
                    if below[k] and not article[k] and not main[k]:
                        wide[k] = body
        return wide

    def scores(self) -> dict[str, int]:
        """A score for each generalised path of widened containers with text."""
        credit = self._credit()
        wide = self._widened(credit, True)
        paths: dict[str, int] = {}
        for node, n in credit.items():
            for k, m in ((node, n), (self.parent[node], n // 2))[: 2 if node > 0 else 1]:
                p = self.path[wide[k]]
                paths[p] = paths.get(p, 0) + m
        return {p: n for p, n in paths.items() if n > 0}

    def best(self) -> str | None:
        found = self.scores()
        return min(found, key=lambda p: (-found[p], p)) if found else None

    def text(self, path: str, own: bool = False) -> str:
        """The blocks of all elements on ``path``, widened, boilerplate left out; ``own`` says that the page itself has chosen the path."""
        wide = self._widened(self._credit(), own)
        tops = {wide[k] for k, p in enumerate(self.path) if p == path and not self.dropped[k]}
        tops = {k for k in tops if not self.claimed or self.claimed[k]}
        size = len(self.parent)
        inside, headline = [False] * size, [0] * size
        for k in range(size):
            inside[k] = self.parent[k] >= 0 and inside[self.parent[k]] or k in tops
            headline[k] = k if self.tag[k] == "h1" else headline[self.parent[k]] if k else 0
        blocks: dict[int, list[str]] = {}
        before, has = {}, False
        for node, block, text, _ in self.runs:
            if not self.shown(node):
                continue
            if inside[node]:
                has = has or headline[node] > 0
                blocks.setdefault(block, []).append(entities.unescape(text))
            elif headline[node] and not blocks and not self.article[node]:
                before = before if before.keys() == {headline[node]} else {headline[node]: []}
                before[headline[node]].append(entities.unescape(text))
        found = [t for b in blocks.values() if (t := _GAP.sub(" ", "".join(b)).strip())]
        if found and not has:
            found = [t for b in before.values() if (t := _GAP.sub(" ", "".join(b)).strip())] + found
        return "\n".join(found)

    def everything(self) -> str:
        """All text outside boilerplate."""
        blocks: dict[int, list[str]] = {}
        for node, block, text, _ in self.runs:
            if self.shown(node) and (not self.claimed or self.claimed[node]):
                blocks.setdefault(block, []).append(entities.unescape(text))
        return "\n".join(t for b in blocks.values() if (t := _GAP.sub(" ", "".join(b)).strip()))

    def has(self, path: str) -> bool:
        return any(p == path and not self.dropped[n] for n, p in enumerate(self.path))


def votes(source: str | None) -> list[tuple[str, int]]:
    """The page's paths of positive score with votes of up to 1000, the best first."""
    page = Page(source or "")
    found = page.scores() or (Page(source or "", False).scores() if page.words else {})
    top = sorted(found.items(), key=lambda x: (-x[1], x[0]))
    return [(p, 1000 * n // top[0][1]) for p, n in top]


def main_text(source: str | None, path: str | None) -> str:
    """The text on the host's path; on the page's own best path where it has no such element or no text there."""
    for words in (True, False):
        page = Page(source or "", words)
        if path is not None and page.has(path) and (found := page.text(path)):
            return found
        best = page.best()
        if best is not None and (found := page.text(best, True)):
            return found
        if found := page.everything():
            return found
        if not page.words:  # nothing was dropped by words
            return ""
    return ""


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(h, p, n) for h, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for p, n in votes(s)]
        host, path, vote = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(vote, pa.int64())], names=["host", "path", "vote"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(s, p) for s, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path``: the winning path of each host; ``pages`` has ``host`` and ``html``."""
    sums = pages.select("host", "html").mapInArrow(_vote, "host string, path string, vote long").groupBy("host", "path").agg(F.sum("vote").alias("votes"))
    return sums.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path")).alias("w")).select("host", "w.path")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row."""
    prepare(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    paths = keep(host_paths(rows), "host-paths")
    joined = rows.join(small(paths, 50_000), "host", "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
