"""Main text of web pages by text-to-tag ratios.

A streaming standard-library parser turns a page into lines (blocks) with the
number of tags around each, and into elements that know their parent.
Text-to-tag ratios of the lines are smoothed by a Gaussian and split by a
two-means threshold; lines above it are content lines, and their characters
are an element's *mass*.  Mass chooses the regions:

* An element that looks like furniture (by its tag, role or name) is dropped,
  unless it holds most of the page's mass: names advise, ratios decide.
* What is left is clustered anew.  The region is the article or main elements
  that hold most of the mass (lists of links outside of them do not count), or
  else the innermost element that holds all content lines, with those beside it
  that are no lists of links.
* Every line of the region counts, however short.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import batches_of, stored

# Element names and attribute words of the HTML standard and of common pages.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Never text of the page, whatever they hold.
UNREAD = set("script style template title".split())
#: Furniture by tag, outside and inside the article.
FURNITURE = set(
    "noscript svg iframe object canvas audio video button select option optgroup datalist textarea label fieldset form nav aside footer menu dialog".split()
)
MAIN = set("article main".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo nav navbar breadcrumb breadcrumbs "
    "cookie cookies consent gdpr newsletter subscribe signup login pagination pager masthead popup".split()
)
#: Readers' comments.
READERS = set("comments commentlist respond replies disqus".split())
#: Names that content bears too.
PERHAPS = set(
    "banner promotion navigation menu menubar sidebar side footer notification subscription share sharing social related recommended "
    "comment discussion modal overlay toolbar widget".split()
)
#: Tokens and elements that are page furniture only outside the article.
OUTER = {"header", "topbar", "alert", "notice", "notices"}
NAMES = NOISE | READERS | PERHAPS | OUTER
#: Words that may stand beside one of these in a compound; any other word makes it a name of its own (side-effects, has-sidebar).
BESIDE = set("posts articles links list buttons icons bar area box site page container slot wrapper block unit".split())
#: A compound of a word of each kind names a column at the side.
SIDES, COLUMNS = set("left right".split()), set("col column rail".split())
#: Notices are furniture in the article too; an article of these names is another one's teaser; blocks of these belong to the text under them.
NOTICES, TEASERS, LEADS = set("notice notices".split()), set("teaser teasers related recommended".split()), set("lead intro introduction standfirst abstract".split())
HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
#: Inside the article an id is mostly a section's title; only these are names of furniture there.
IDS_INSIDE = READERS | set("ad ads advert advertisement share sharing social related recommended".split())
UNNAMED = set("html body article main h1 h2 h3 h4 h5 h6".split())
#: A start tag of these ends an open element of those before it.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: What a head may hold; any other tag ends it.
IN_HEAD = set("base link meta noscript script style template title".split())
#: Elements that can be a region of their own.
BOXES = set("div section td table center body html form main article".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
WHITE = re.compile(r"\s+")
CUT_TAG = re.compile(r"<[a-zA-Z/!?]")
SIGMA = 1.0

#: What an element looks like: by name perhaps furniture, by tag or role furniture, by name certainly, by readers, no text at all.
PLAIN, WEAK, STRONG, CERTAIN, SAID, NEVER = range(6)


class Page(HTMLParser):
    """Lines of a page and the elements that hold them, each with its parent.

    Time and memory are in proportion to the page, however deep its markup:
    the last open element of each name is known by its place on the stack.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # elements; number 0 is the page
        self.parent, self.tag, self.looks, self.inside, self.part = [0], ["html"], [PLAIN], [False], [""]
        # lines: text, tags around it, characters in links, element
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.linked: list[int] = []
        self.at: list[int] = []
        self.stack = [0]
        self.places: dict[str, list[int]] = defaultdict(list)  # open elements of a name: places on the stack
        self.blocks = [0]  # places of open blocks
        self.parts: list[str] = []
        self.seen = self.links = 0

    def flush(self) -> None:
        text = WHITE.sub(" ", "".join(self.parts)).strip()
        self.parts.clear()
        if text:
            self.texts.append(text)
            self.tags.append(max(1, self.seen))
            self.linked.append(min(len(text), self.links))
            self.at.append(self.stack[-1])
            self.seen = 0
        self.links = 0

    def pop(self, place: int) -> None:
        """Closes open elements down to a place on the stack."""
        while len(self.stack) > place:
            self.places[self.tag[self.stack.pop()]].pop()
        while self.blocks[-1] >= place:
            self.blocks.pop()

    def look(self, tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> int:
        if tag in UNREAD:
            return NEVER
        looks = STRONG if tag in FURNITURE or tag == "header" and not inside else PLAIN
        for k, v in attrs:
            if k == "hidden" or k == "aria-hidden" and v == "true" or k == "role" and (v or "").lower() in ROLES or k == "style" and HIDDEN.search(v or ""):
                looks = STRONG
        names = self.names(tag, attrs, inside)
        if names & READERS:
            return SAID
        if inside and names & NOTICES:
            looks = max(looks, STRONG)
        return max(looks, CERTAIN if names & NOISE else WEAK if names else PLAIN)

    def names(self, tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> set[str]:
        """The names of furniture that an element bears: whole tokens, or compounds of such names and words of BESIDE."""
        out: set[str] = set()
        for k, v in attrs:
            if k in ("class", "id") and v:
                if tag in UNNAMED:
                    if tag == "article" and k == "class" and "comment" in v.split():
                        out.add("comments")  # an article that is a reader's
                    continue
                known = NAMES - OUTER | NOTICES if inside else NAMES
                if inside and k == "id":
                    known = IDS_INSIDE
                if tag in INLINE:
                    known = known & NOISE
                for token in v.split():
                    words = {w for w in re.split(r"[\W_]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if w}
                    if words <= NAMES | BESIDE:
                        out |= words & known
                    elif words & SIDES and words & COLUMNS and words <= SIDES | COLUMNS | BESIDE:
                        out.add("sidebar")
        return out

    def named(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        """Whether an element is a teaser of another page, or leads the text under it, by a whole token."""
        tokens = {x for k, v in attrs if k in ("class", "id") and v for x in v.lower().split()}
        return "teaser" if tag == "article" and tokens & TEASERS else "lead" if tag not in INLINE and tokens & LEADS else ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.seen += 1
        if self.places["head"] and tag not in IN_HEAD:
            self.flush()
            self.pop(self.places["head"][-1])
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            ends = ENDS.get(tag, {"p"})
            if len(self.blocks) > 1 and self.tag[self.stack[self.blocks[-1]]] in ends:
                self.pop(self.blocks[-1])
        if tag in VOID:
            return
        over = self.stack[-1]
        looks = NEVER if tag == "head" else self.look(tag, attrs, self.inside[over])
        if looks and tag in INLINE:
            self.flush()
        self.parent.append(over)
        self.tag.append(tag)
        self.looks.append(looks)
        self.part.append(self.named(tag, attrs))
        self.inside.append(self.inside[over] or tag in MAIN)
        self.places[tag].append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(len(self.parent) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.seen += 1
        if tag in VOID or not self.places[tag]:
            return
        place = self.places[tag][-1]
        if tag not in INLINE:
            self.flush()
        elif place < self.blocks[-1]:
            return  # an inline end tag does not close blocks
        elif self.looks[self.stack[place]]:
            self.flush()
        self.pop(place)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.places["a"]:
            self.links += len(data)


def parsed(html: str) -> Page:
    """A page's lines and elements.  A tag that the end of the page cuts is no text, as the HTML standard has it."""
    page = Page()
    last = html.rfind(">") + 1
    cut = CUT_TAG.search(html, last)
    page.feed(html[: cut.start()] if cut else html)
    page.close()
    page.flush()
    return page


def smoothed(ratios: np.ndarray) -> np.ndarray:
    x = np.arange(-3, 4)
    kernel = np.exp(-(x**2) / (2 * SIGMA**2))
    return np.convolve(np.pad(ratios, 3, mode="edge"), kernel / kernel.sum(), mode="valid")


def threshold(ratios: np.ndarray) -> float:
    """The two-means threshold of smoothed ratios; 0 for fewer than two."""
    if len(ratios) < 2:
        return 0.0
    smooth = smoothed(ratios)
    low, high = smooth.min(), smooth.max()
    for _ in range(50):
        up = smooth >= (low + high) / 2
        new = smooth[~up].mean() if (~up).any() else low, smooth[up].mean()
        if new == (low, high):
            break
        low, high = new
    return float(low + high) / 2


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Which lines have a smoothed ratio above the two-means threshold."""
    return smoothed(ratios) >= threshold(ratios)


def summed(page: Page, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each element the sum of values over the lines in it."""
    out = np.bincount(at, values, len(page.parent)).tolist()
    parent = page.parent
    for e in range(len(out) - 1, 0, -1):  # parents come before their children
        out[parent[e]] += out[e]
    return np.array(out)


def dropped(page: Page, at: np.ndarray, size: np.ndarray, content: np.ndarray) -> tuple[list[bool], list[bool]]:
    """For each element, whether it is (in) furniture; and whether it is in a spared one, outside of articles.

    What readers say is always dropped.  Other elements that look like
    furniture are spared if no article outside of furniture has text and they
    hold more mass than what is outside of furniture: any more if a name says
    so, three times as much if their tag does; what bears a certain name must
    also hold an article or a first heading.  Within an article, what looks
    like furniture is spared if it holds most of the page's mass, or, by an
    uncertain name, any.
    """
    parent, looks, inside, n = page.parent, page.looks, page.inside, len(page.parent)
    sure, near, lead = [False] * n, [0] * n, [False] * n  # weighs nothing; nearest furniture around or at an element
    for e in range(1, n):
        sure[e] = sure[parent[e]] or looks[e] >= SAID
        near[e] = e if looks[e] and not inside[e] else near[parent[e]]
    for e in range(n - 1, 0, -1):
        lead[parent[e]] |= lead[e] or page.tag[e] in MAIN or page.tag[e] == "h1"
    weighs = ~np.array(sure)[at]
    if not (content & weighs).any():
        content = weighs
    mass = summed(page, at, size * (content & weighs))
    of = np.array(near)[at]
    loose = np.bincount(of, size * (content & weighs), n)
    article = np.bincount(of, size * (weighs & np.array(inside)[at]), n)
    out, spared = [False] * n, [False] * n
    open_, written = loose[0], article[0]
    for e in range(1, n):
        p = parent[e]
        out[e], spared[e] = out[p] or sure[e], spared[p] and not inside[e]
        if out[e] or looks[e] == PLAIN:
            continue
        if inside[e]:
            out[e] = not (mass[e] > 0 if looks[e] == WEAK else 2 * mass[e] > mass[0])
        elif written or mass[e] <= open_ * (1 if looks[e] == WEAK else 3) or looks[e] == CERTAIN and not lead[e]:
            out[e] = True
        else:
            spared[e] = True
            open_, written = open_ + loose[e], written + article[e]
    return out, spared


def region(page: Page, at: np.ndarray, size: np.ndarray, links: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Which of the lines (those outside of furniture) are in the region that the content lines mark."""
    parent, n = page.parent, len(page.parent)
    article = [0] * n  # the outermost article or main element around
    for e in range(1, n):
        article[e] = article[parent[e]] or (e if page.tag[e] in MAIN else 0)
    of = np.array(article)[at]
    mass = size * content
    if of.any() and 4 * mass[of > 0].sum() >= (mass * (2 * links < size))[of == 0].sum():
        best = set(of[(of > 0) & content].tolist()) or set(of[of > 0].tolist())
        best = {e for e in best if page.part[e] != "teaser"} or best
        beside = {parent[e] for e in best}
        return np.array([e in best or e > 0 and parent[e] in beside and page.part[e] != "teaser" for e in of.tolist()])
    lines = summed(page, at, content.astype(float))
    root = int(np.flatnonzero(lines == content.sum())[-1])  # they are nested, the innermost has the largest number
    while root and page.tag[root] not in BOXES:
        root = parent[root]
    whole = page.tag[parent[root]] in ("body", "html")
    under = [0] * n  # the child of the region's parent that holds an element
    for e in range(1, n):
        under[e] = e if parent[e] == parent[root] else under[parent[e]]
    beside = np.array(under)[at]
    inside = beside == root
    if root and (~inside).any():
        # what stands beside the region joins it, but for lists of links; in the body, only headings and what leads the text do
        text, linked = np.bincount(beside, size, n), np.bincount(beside, links, n)
        for e in set(beside[~inside & (beside > 0)].tolist()):
            if 2 * linked[e] < text[e] and (not whole or page.tag[e] in HEADINGS or page.part[e] == "lead"):
                inside |= beside == e
        inside |= (at == parent[root]) & (not whole)
    return inside if root else np.ones(len(at), bool)


def main_text(html: str | None) -> str:
    """The article's blocks, joined by newlines; empty if there is none (see the module's head)."""
    page = parsed(html or "")
    if not page.texts:
        return ""
    at, size = np.array(page.at), np.array([len(t) for t in page.texts], float)
    tags, links = np.array(page.tags, float), np.array(page.linked, float)
    out, spared = dropped(page, at, size, size / tags >= threshold(size / tags))  # a line beside content does not weigh for it
    # a list of links in a menu that was spared, because it was never closed, is furniture still
    left = np.flatnonzero(~np.array(out)[at] & ~(np.array(spared)[at] & (links >= 0.9 * size)))
    if not len(left):
        return ""
    inside = region(page, at[left], size[left], links[left], content_lines(size[left] / tags[left]))
    return "\n".join(page.texts[i] for i in left[inside].tolist())


@F.pandas_udf(T.StringType())
def main_text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([main_text(x) for x in s.tolist()], dtype=object)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: id, url, ``text``, ``n_chars``.

    Null or empty html, and pages without content: empty text, 0.  Whole
    pages are read, in time and memory in proportion to them.  Malformed
    markup is read as far as it goes.  An ``aside`` is a sidebar wherever it
    stands, a notice is none of the article, and hidden elements are not read.  Null ids and urls stay null.  Repeated
    rows are extracted each; other columns are not read, whatever their
    names; empty table: no rows.
    """
    out = pages.select(pages[id_col].alias(id_col), pages[url_col].alias(url_col), main_text_of(pages[html_col]).alias("text"))
    with batches_of(pages.sparkSession, 512):
        return stored(out.withColumn("n_chars", F.length("text").cast("long")), "pages")
