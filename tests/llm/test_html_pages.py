"""The main text of whole pages against a plain reading of them, and of awkward ones against what they say."""

from __future__ import annotations

from html.parser import HTMLParser

import pytest

from quaylog.llm import html_text

BLOCKS = set("html body article main section div p ul ol li h1 h2 h3 h4 h5 h6 header footer nav aside form table tr td th blockquote pre figure figcaption dl dt dd hr".split())
LEFT_OUT = set("nav aside footer form menu dialog script style title noscript template head".split())
VOID = set("br hr img input meta link wbr".split())


class Plain(HTMLParser):
    """Blocks of a page in its order: [text, characters in links, left out, article]. For pages whose tags but those of paragraphs, items and inline marks are closed."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.blocks: list[list] = [["", 0, False, 0]]
        self.articles, self.in_link = 0, False
        self.feed(page)
        self.close()

    def _block(self) -> None:
        names = [n for n, _ in self.open]
        self.blocks.append(["", 0, any(left for _, left in self.open), self.articles if "article" in names else 0])

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.blocks[-1][0] += " "
        if tag == "a":
            self.in_link = True
        if tag in VOID or (tag not in BLOCKS and tag not in LEFT_OUT):
            return
        if self.open and self.open[-1][0] == tag and tag in ("p", "li"):
            self.open.pop()
        if self.open and self.open[-1][0] == "p" and tag in BLOCKS:
            self.open.pop()
        words = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower().replace("-", " ").split()
        inside = any(n == "article" for n, _ in self.open)
        left = tag in LEFT_OUT or (tag == "header" and not inside) or bool(html_text.BOILERPLATE.intersection(words))
        if tag == "article" and not inside:
            self.articles += 1
        self.open.append((tag, left))
        self._block()

    def handle_endtag(self, tag):
        if tag == "a":
            self.in_link = False
        if tag in [n for n, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass
            self._block()

    def handle_data(self, data):
        self.blocks[-1][0] += data
        if self.in_link:
            self.blocks[-1][1] += len(" ".join(data.split()))


def plain_text(page: str) -> str:
    """By all sums: lines from one whose sum reaches the threshold to the last with text before a sum of zero, and what adjoins them."""
    blocks = [(" ".join(t.split()), linked, left, article) for t, linked, left, article in Plain(page).blocks if t.split()]
    declared = [b for b in blocks if b[3] and not b[2]]
    if declared:
        return "\n".join(b[0] for b in declared)
    lengths = [0 if left or 2 * max(0, len(t) - linked) < len(t) else len(t) - linked for t, linked, left, _ in blocks]
    sums = [sum(lengths[i : i + 3]) for i in range(len(lengths))]
    threshold = min(90, max(sums, default=0) / 8)
    kept, inside = set(), False
    for i, total in enumerate(sums):
        inside = total > 0 and (inside or (lengths[i] > 0 and total >= threshold))
        if inside:
            kept.add(i)
    # the lines after the last with text belong to no stretch
    kept = {i for i in kept if any(lengths[j] for j in range(i, len(lengths)) if all(k in kept for k in range(i, j + 1)))}
    own = {i for i, (t, linked, left, _) in enumerate(blocks) if not left and len(t) - linked > 1}
    while more := {j for i in kept for j in (i - 1, i + 1) if j in own} - kept:
        kept |= more
    return "\n".join(b[0] for i, b in enumerate(blocks) if i in kept and not b[2])


@pytest.mark.parametrize("declared", [True, False])
def test_whole_pages_against_plain_reading(spark, declared):
    """All pages as they are, and with their articles declared by nothing, where surge and dive points decide."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    for page in pages:
        if not declared:
            page = page.replace("<article", "<section").replace("</article", "</section").replace("<main", "<div").replace("</main", "</div")
        assert html_text.main_text(page) == plain_text(page), page


def test_short_pages_stay():
    assert html_text.main_text("<p>Hello world, a short article.</p>") == "Hello world, a short article."
    assert html_text.main_text("<h1>Head</h1><p>One two.</p><p>Three four.</p>") == "Head\nOne two.\nThree four."
    long = "A sentence of the text. " * 12
    assert html_text.main_text(f"<article><p>{long}</p></article><p>Between.</p><article>Short.</article>") == f"{long.strip()}\nShort."


def test_leading_paragraph_of_links_stays():
    long = ("A sentence of the text. " * 12).strip()
    menu = "<ul><li><a>Home</a></li><li><a>About us and all</a></li></ul>"
    lead = "<p><a>A long link that opens the whole text</a> says so.</p>"
    assert html_text.main_text(f"{menu}{lead}<p>{long}</p>{lead}{menu}") == f"A long link that opens the whole text says so.\n{long}\nA long link that opens the whole text says so."


def test_references_end_with_their_piece():
    assert html_text.main_text("<article><p>A&am<b>p;</b>B &lt;x&gt; &#233;&nbsp;f&amp;amp;</p></article>") == "A&amp;B <x> é f&amp;"


def test_marks_that_name_a_subject_stay():
    inner = "<p>One.</p><div class='{}'><p>Two.</p></div><p>Three.</p>"
    for mark in ("social-post", "search story", "login-entry"):
        kept = html_text.main_text(f"<article>{inner.format(mark)}</article>")
        assert ("Two." in kept) == (mark != "search story"), mark
    for mark in ("related-post", "post-share", "social-share", "ad-post", "sidebar-content"):
        assert html_text.main_text(f"<article>{inner.format(mark)}</article>") == "One.\nThree.", mark
