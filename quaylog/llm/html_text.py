"""Main text of web pages by line-block distribution.

Markup is stripped to one line per block, with the length of its text outside links; lines
of menus, headers, footers, sidebars, notices, adverts, forms and reader comments have length
zero. Lengths are summed over windows of three lines. Text begins where the sums surge
above a threshold and ends where they dive to zero; what lies between is kept.

Where articles are declared, each is looked at by itself and the boilerplate inside it is no line,
so its text is one stretch from its first line to its last: there the marks decide, and surge and dive points
change nothing. They decide on pages that declare no article. The page is read once: every step takes time in proportion to it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 90

_TAG, _END = re.compile(r"<[a-zA-Z/!?]"), re.compile("[\"'>]")
_NAME = re.compile(r"</?\s*([a-zA-Z][\w:-]*)")
_MARK = re.compile(r"(?<![\w-])(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Elements whose content is plain characters, up to their end tag or the end of the page.
PLAIN = frozenset("script style textarea title".split())
#: Elements left out up to their end tag; where it is missing, only the tag goes.
ENCLOSED = frozenset("noscript template iframe svg math object select button canvas audio video".split())

#: Elements, and whole classes, ids and roles, whose text is never the article's. Fixed values.
DROPPED = frozenset("nav aside form menu dialog footer fieldset datalist".split())
BOILERPLATE = frozenset(
    "ad ads adv advert advertisement adsense banner sponsor sponsored promo promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer foot masthead "
    "comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay subscribe newsletter signup login "
    "share sharing social related recommended widget pager pagination toolbar search searchbox contentinfo complementary dialog form".split()
)
TALK = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Words that may stand beside those above in a hyphenated class or id.
FRAME = frozenset("area bar block body box container div form global group inner item items li list outer primary reader row secondary section site thread user wrap wrapper".split())
#: Words of those above that name a subject where a word for a text follows them, as in "social-post". Fixed values.
SUBJECTS = frozenset("alert dialog form login menu notice notices search share sharing social toolbar widget".split())
TEXTS = frozenset("article entry post story".split())
HEADERS = frozenset("header topbar banner masthead".split())
CONTENT = frozenset("content article main post entry story text articlebody".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)


def _marks(tag: str, name: str, inside: bool) -> list[list[str]]:
    """The words of each class, id, role, property and label of a tag.

    Inside a declared article the ids of headings, paragraphs and sections are anchors and don't
    count, but for a section of reader comments.
    """
    out = []
    for attribute, *values in _MARK.findall(tag) if "=" in tag else ():
        attribute, value = attribute.lower(), "".join(values).lower()
        for token in [value] if attribute == "aria-label" else value.split():
            words = re.findall("[a-z0-9]+", token)
            if attribute == "id" and inside and (name in ANCHORS or (name == "section" and not TALK.intersection(words) & {"comments", "commentlist", "disqus"})):
                continue
            out.append(words)
    return out


ANCHORS = frozenset("h1 h2 h3 h4 h5 h6 p".split())


def _named(marks: list[list[str]], of: frozenset, beside: frozenset = FRAME) -> bool:
    """Whether a mark is one of some words as a whole, or a compound of them and neutral ones."""
    return any(not of.isdisjoint(words) and all(w in of or w in beside or w.isdigit() for w in words) for words in marks)


def _about(words: list[str]) -> bool:
    """Whether a mark names a text by its subject."""
    return len(words) > 1 and words[-1] in TEXTS and SUBJECTS.issuperset(BOILERPLATE.intersection(words))


def _kind(tag: str, name: str, inside: bool) -> str:
    """'drop' for boilerplate, 'talk' for reader comments, 'article' for a declared article, 'teaser' for one marked as boilerplate, '' otherwise."""
    marks = _marks(tag, name, inside)
    words = {w for m in marks for w in m}
    if name in ("html", "body"):
        return ""
    if words and _named(marks, TALK, FRAME | BOILERPLATE | CONTENT):
        return "talk"
    if name in DROPPED or (name == "header" and not inside) or ["hidden"] in marks:
        return "drop"
    content = words & CONTENT
    boilerplate = bool(words) and _named([m for m in marks if not _about(m)], BOILERPLATE, FRAME | CONTENT)
    if name in ("article", "main"):
        return "teaser" if boilerplate else "article"
    if boilerplate or (words and _named(marks, HEADERS) and not inside and not content):
        return "drop"
    if "articlebody" in words or {"main", "content"} <= words or ("article" in words and name in ("div", "section")):
        return "article"
    return ""


class _Tree:
    """The elements of a page: parent, kind, and number of the declared article they are in, or 0."""

    def __init__(self) -> None:
        self.parent, self.kind, self.article, self.roots = [0], [""], [0], [0]
        self.talk = [False]

    def add(self, parent: int, kind: str) -> int:
        article, talk = self.article[parent], self.talk[parent] or kind == "talk"
        if kind in ("article", "teaser") and not article and not talk:
            article = len(self.roots)
            self.roots.append(len(self.parent))
        self.parent.append(parent)
        self.kind.append(kind)
        self.article.append(article)
        self.talk.append(talk)
        return len(self.parent) - 1

    def dropped(self, lines: list[tuple[str, int, int]]) -> list[bool]:
        """Whether each element's text is left out; never that around the longest declared article, nor the article."""
        roots, n = set(self.roots[1:]), len(self.parent)
        inner, sizes = [False] * n, [0] * len(self.roots)
        for i in range(1, n):
            inner[i] = i not in roots and (inner[self.parent[i]] or self.kind[i] in ("drop", "talk"))
        for text, _, i in lines:
            sizes[self.article[i]] += len(text) if self.article[i] and not inner[i] else 0
        kept = set()
        if max(sizes):
            i = self.roots[sizes.index(max(sizes))]
            while i:
                kept.add(i)
                i = self.parent[i]
        out = [False] * n
        for i in range(1, n):
            out[i] = i not in kept and (out[self.parent[i]] or self.kind[i] in ("drop", "talk") or (self.kind[i] == "teaser" and i in roots))
        return out


class _Ends:
    """Where tags end: at the first '>' outside quotes, or at the first of all where quotes aren't closed.

    What a search has found is kept, so no part of the page is searched twice.
    """

    def __init__(self, page: str):
        self.page, self.after, self.from_to, self.missing = page, {}, (0, -1), set()

    def _next(self, at: int) -> int:
        """The next quote or '>', or the page's end."""
        if not self.from_to[0] <= at <= self.from_to[1]:
            m = _END.search(self.page, at)
            self.from_to = (at, m.start() if m else len(self.page))
        return self.from_to[1]

    def find(self, sign: str, at: int) -> int:
        if sign in self.missing:
            return -1
        found = self.page.find(sign, at)
        if found < 0:
            self.missing.add(sign)
        return found

    def of(self, begin: int) -> int:
        """The place after the tag that begins there, or -1."""
        at, way, end = begin + 1, [], -1
        while at not in self.after:
            way.append(at)
            sign = self._next(at)
            if sign == len(self.page):
                break
            if self.page[sign] == ">":
                end = sign + 1
                break
            closing = self.find(self.page[sign], sign + 1)
            if closing < 0:
                break
            at = closing + 1
        else:
            end = self.after[at]
        self.after.update(dict.fromkeys(way, end))
        return end if end > 0 else self.find(">", begin) + 1 or -1


def _tokens(page: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, tag, element's name or '') of the page's tags, comments and what is left out whole."""
    out: list[tuple[int, int, str, str]] = []
    ends, at, sought = _Ends(page), 0, {}
    while m := _TAG.search(page, at):
        begin = m.start()
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4) + 3
            end = end if end > 2 else len(page)
        elif page.startswith("<![CDATA[", begin) and (end := ends.find("]]>", begin) + 3) > 2:
            pass
        elif (end := ends.of(begin)) < 0:
            break  # no '>' follows
        at, tag = end, page[begin:end]
        named = _NAME.match(tag)
        name = named[1].lower() if named else ""
        if name in PLAIN and tag[1] != "/":
            if name not in sought:
                sought[name] = re.compile(rf"<(/?){name}(?=[\s/>])[^>]*(?:>|\Z)", re.I)
            # '/>' is an empty element only where no end tag follows it before the next begin
            after = sought[name].search(page, at)
            empty = tag.endswith("/>") and not (after and after[1])
            while after and not after[1] and not empty:
                after = sought[name].search(page, after.end())
            if not empty:
                at = after.end() if after else len(page)
            tag, name = "", ""
        out.append((begin, at, tag, name))
    return _without_enclosed(out)


def _without_enclosed(tokens: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The tokens with each element of ENCLOSED, and a head up to its end tag, as one."""
    begun: dict[str, list[int]] = {}
    until: dict[int, int] = {}
    for i, (_, _, tag, name) in enumerate(tokens):
        if name == "body" or name in BLOCKS:
            begun.pop("head", None)  # it ended before, where its end tag is left out
        if name not in ENCLOSED and name != "head":
            continue
        if tag[1] != "/":
            if not tag.endswith("/>"):
                begun.setdefault(name, []).append(i)
        elif begun.get(name):
            until[begun[name].pop()] = i
    if not until:
        return tokens
    out, i = [], 0
    while i < len(tokens):
        begin, end, tag, name = tokens[i]
        if i in until:
            i, tag, name = until[i], "", ""
            end = tokens[i][1]
        out.append((begin, end, tag, name))
        i += 1
    return out


class _Open:
    """The open elements, innermost last, with the places of each name and of blocks."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.nodes: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def inner(self) -> int:
        return self.nodes[-1] if self.nodes else 0

    def push(self, name: str, node: int) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name in BLOCKS:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        while len(self.names) > place:
            name = self.names.pop()
            self.nodes.pop()
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()

    def close(self, name: str) -> None:
        """An end tag: of a block it closes all inside, of others nothing beyond a block."""
        if places := self.places.get(name):
            if name in BLOCKS and name != "p" or not self.blocks or self.blocks[-1] <= places[-1]:
                self.cut(places[-1])

    def block(self, name: str) -> None:
        """A block begins: it closes an open paragraph and what that holds; an item closes its neighbour."""
        if self.blocks:
            last = self.names[self.blocks[-1]]
            if last == "p" or (last == name and name in ("li", "dd", "dt", "td", "th", "tr", "option")):
                self.cut(self.blocks[-1])


def lines_of(page: str) -> list[tuple[str, int, bool, int]]:
    """(text, length outside links, dropped, number of the declared article or 0) of each block."""
    lines: list[tuple[str, int, int]] = []
    tree, open_ = _Tree(), _Open()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            lines.append((text, max(0, len(text) - linked), open_.inner()))
        parts.clear()
        linked = 0

    at = links = 0
    for begin, end, tag, name in _tokens(page):
        if begin > at:
            piece = html.unescape(page[at:begin])  # by itself: no reference goes on behind a tag
            parts.append(piece)
            if links:
                linked += len(" ".join(piece.split()))
        at = end
        if not name:
            if tag.startswith("<![CDATA["):
                parts.append(tag[9:-3])
            elif not tag:
                parts.append(" ")
            continue
        if name in ENCLOSED or name in PLAIN or name == "head":
            parts.append(" ")
            continue
        if name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        if name in BLOCKS:
            flush()
        if tag[1] == "/":
            if name == "a":
                links = 0
            open_.close(name)
            continue
        if name in VOID or tag.endswith("/>"):
            continue
        if name == "a":
            links = 1
            continue
        if name in BLOCKS:
            open_.block(name)
        within = open_.inner()
        open_.push(name, tree.add(within, _kind(tag, name, tree.article[within] > 0)))
    parts.append(html.unescape(page[at:]))
    flush()
    dropped = tree.dropped(lines)
    return [(text, own, dropped[i], tree.article[i]) for text, own, i in lines]


def stretches(lengths: list[int], surge: float, window: int = WINDOW, back: bool = False) -> list[tuple[int, int]]:
    """(begin, end) of lines between surge and dive points.

    The sum of a line is that of the ``window`` lines from it on. A stretch begins at a line with text whose sum
    reaches ``surge``, or with ``back`` at the first of the lines with text that lead up to it,
    and ends after its last line with text before the sums dive to zero.
    """
    out: list[tuple[int, int]] = []
    total, begin, last, lead = sum(lengths[: window - 1]), -1, 0, 0
    for i, length in enumerate(lengths):
        total += lengths[i + window - 1] if i + window - 1 < len(lengths) else 0
        if begin < 0 and length and total >= surge:
            begin = lead if back else i
        if begin >= 0 and not total:
            out.append((begin, last + 1))
            begin = -1
        if length:
            last = i
        else:
            lead = i + 1
        total -= length
    return [*out, (begin, last + 1)] if begin >= 0 else out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text between surge and dive points; empty if there is none.

    The threshold is relative to what is looked at: ``surge`` characters, or an eighth of its largest sum where that
    is less, so that short texts surge as well. Of a page with declared articles each one is looked at by itself, all but
    comments and what is in boilerplate beside the longest one. On other pages lines that are links for the most part neither
    surge nor hold off a dive; those with words of their own that adjoin a stretch belong to it.
    """
    lines = lines_of(page or "")

    def found(lengths: list[int], back: bool) -> list[tuple[int, int]]:
        largest = max((sum(lengths[i : i + window]) for i in range(len(lengths))), default=0)
        return stretches(lengths, min(surge, largest / 8), window, back) if largest else []

    articles = [(text, article) for text, _, dropped, article in lines if article and not dropped]
    if articles:
        runs = [[text for text, _ in run] for _, run in groupby(articles, key=itemgetter(1))]
        return "\n".join(text for run in runs for a, b in found([len(text) for text in run], True) for text in run[a:b])
    kept = [False] * len(lines)
    own_words = [not dropped and own > 1 for _, own, dropped, _ in lines]
    for a, b in found([0 if dropped or 2 * own < len(text) else own for text, own, dropped, _ in lines], False):
        while a and own_words[a - 1] and not kept[a - 1]:
            a -= 1
        while b < len(lines) and own_words[b]:
            b += 1
        kept[a:b] = [True] * (b - a)
    return "\n".join(text for (text, _, dropped, _), keep in zip(lines, kept, strict=True) if keep and not dropped)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without main text, give empty text and 0. Unclosed comments,
    scripts, styles, text areas and titles end with the page; of other unclosed elements that are
    left out only the tag goes. Repeated rows give a row each; further columns are ignored.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, urls, pages_ = batch.columns
            texts = [main_text(p.as_py()) for p in pages_]
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(
        run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long"
    )
