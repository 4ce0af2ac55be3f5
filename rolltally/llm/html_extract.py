"""HTML extraction by two-pass block rules.

Pass 1 cuts a page into blocks and decides each one that can be decided: by the markup it stands in (menus, footers, adverts,
comments and so on are boilerplate; where a page has an article or main element, what stands outside it is too; a class or id alone
can't make a container boilerplate that holds the article or most of the page's long blocks with few links), by link density,
and by length together with stop-word density, inside articles as outside. Stop words count only where they can tell: not on a page none of whose long blocks is rich in the known
ones, not for a block mostly in other scripts than Latin, in pre or in a table; there length, links and markup decide. Pass 2 lets the undecided inherit the label of their nearest decided
neighbour: first long blocks poor in stop words, from blocks of prose only, then short ones and links in an article, from any
(content on a tie inside an article and for long blocks, else boilerplate). On a page without a block that pass 1 takes, shorter prose counts, and without any what isn't a menu.

Defined cases: null or empty html, or a page without content, gives an empty text; unclosed and cut-off tags end with the page; other columns are
ignored; repeated rows are extracted each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

SHORT = 70
LONG = 200
STOP_DENSITY = 0.3
LINK_DENSITY = 0.4

# Frequent function words.
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by can for from had has have he her his i in is it its more not of on one or our she so than that the their
    them there they this to was we were what when which who will with would you
    au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui mais me même mes nous on ou par pas plus pour qu que
    qui sa se ses son sur un une vous y
    aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat ich ihr im in ist ja mit nach nicht
    noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur
    al como con de del el ella en entre era es esta este ha hay la las le lo los más me mi muy no nos o para pero por que se si sin sobre
    son su sus también un una y ya
    che di e il non per sono una dei della nel ao com da do em mais não os um uma na nos het een van niet zijn op te voor dat
    """.split()
)

# Element names by their part in a page.
RAW = frozenset("script style noscript template iframe svg object textarea title".split())
BOILERPLATE = frozenset("nav footer aside form button select head dialog menu".split())
CONTENT = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul
    """.split()
)
# Words in class, id or role that name a part which is not the article.
PARTS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie
    cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices outbrain pager pagination popup promo promoted promotion
    related replies reply respond search share sharing sidebar sidebars signup skyscraper social sponsor sponsored subscribe taboola toolbar topbar
    widget widgets
    """.split()
)

# Parts made of what readers wrote, and words by which a name says something of a part that stands elsewhere.
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
MODIFIERS = frozenset("closed collapsed disabled enabled has hidden hide no not open with without".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Za-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_LETTERS = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[A-Za-z\u00AA\u00BA\u00C0-\u024F\u1E00-\u1EFF]")


def _is_part(name: str, attributes: str, inside: bool) -> tuple[bool, str | None]:
    """Whether an element's markup says that it holds no article text, and the kind of part (``comments``, ``part`` or none) that its class or id names."""
    if name in BOILERPLATE or (name == "header" and not inside):
        return True, None
    if not attributes or attributes.isspace():
        return False, None
    named = None
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDDEN.search(value)):
            return True, None
        if key == "role" and name not in ("html", "body"):
            if value.lower() in ("alert", "alertdialog", "form") or any(w.lower() in PARTS for w in _WORDS.findall(_CAMEL.sub(" ", value))):
                return True, None
        if key in ("class", "id") and name not in ("html", "body"):
            for one in value.split():
                words = {w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", one))}
                if words & PARTS and not words & MODIFIERS:
                    named = "comments" if words & COMMENTS or named == "comments" else "part"
    return False, named


_OUTSIDE = ("", False, False, -1, -1)


class _Blocks:
    """Blocks of one page: text, characters in links, whether in a boilerplate part, whether in an article, whether in pre or a table."""

    def __init__(self) -> None:
        self.found: list[tuple[str, int, bool, bool, bool]] = []
        # Name, boilerplate by markup from here on, article from here on, innermost named part (or -1), innermost article (or -1).
        self.open: list[tuple[str, bool, bool, int, int]] = []
        self.named: list[tuple[int, str]] = []  # parts by class or id: the part around it, kind
        self.articles: list[tuple[str, int]] = []  # name, named part that it stands in or is itself
        self.where: list[tuple[int, int]] = []  # named part and article of each block
        self.pieces: list[str] = []
        self.linked = self.links = 0

    def text(self, raw: str) -> None:
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            self.pieces.append(raw)
            if self.links:
                self.linked += len("".join(raw.split()))

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                _, part, inside, named, article = self.open[-1] if self.open else _OUTSIDE
                self.found.append((text, self.linked, part, inside, any(n in ("pre", "table") for n, *_ in self.open)))
                self.where.append((named, article))
            self.pieces, self.linked = [], 0

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self.flush()
            self.links = 0
        elif name == "br":
            self.pieces.append(" ")
        if name in VOID:
            return
        if name == "a":
            self.links = 1
            return
        if name in CONTENT:  # an article never stands in an unclosed menu, header or the like
            while any(part and n in (*BOILERPLATE, "header") for n, part, *_ in self.open):
                self.open.pop()
        elif name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            if self.open and self.open[-1][0] == name:
                self.open.pop()
        if name in BLOCK or name in BOILERPLATE or attributes.strip():
            _, part, inside, named, article = self.open[-1] if self.open else _OUTSIDE
            hard, kind = _is_part(name, attributes, inside)
            if kind:
                self.named.append((named, kind))
                named = len(self.named) - 1
            if name in CONTENT:
                self.articles.append((name, named))
                article = len(self.articles) - 1
            self.open.append((name, part or hard, inside or name in CONTENT, named, article))

    def end(self, name: str) -> None:
        if name in BLOCK:
            self.flush()
        if name == "a":
            self.links = 0
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                del self.open[i:]
                return
            if self.open[i][0] in ("article", "main", "body", "table"):
                if name not in ("article", "main", "body", "html", "table"):
                    return


    def around(self, named: int) -> list[int]:
        """A named part and those around it, innermost first."""
        out = []
        while named >= 0:
            out.append(named)
            named = self.named[named][0]
        return out

    def judged(self) -> list[tuple[str, int, bool, bool, bool]]:
        """Blocks with named parts taken into account: a part is lifted if it holds an article to be judged afresh or most of the page's long blocks."""
        if not self.named:
            return self.found
        size = [len(text) if len(text) >= LONG and not part and linked <= LINK_DENSITY * (len(text) - text.count(" ")) else 0 for text, linked, part, *_ in self.found]
        around = [self.around(i) for i in range(len(self.named))]
        comments = [any(self.named[j][1] == "comments" for j in x) for x in around]
        held, total, open_text = [0] * len(self.named), sum(size), 0
        filled, long = set(), set()  # articles with any text, and with a long block
        for (named, article), n, (_, _, part, *_) in zip(self.where, size, self.found, strict=True):
            if article >= 0 and not part:
                filled.add(article)
                if n:
                    long.add(article)
            for j in around[named] if named >= 0 else []:
                held[j] += n
            if named < 0 or not comments[named]:
                open_text += n
        plain = any(named < 0 and i in filled for i, (_, named) in enumerate(self.articles))
        lifted = set()
        outside_comments = open_text > 0 or any(i in filled and (named < 0 or not comments[named]) for i, (_, named) in enumerate(self.articles))
        for i, (name, named) in enumerate(self.articles):
            if named >= 0 and i in filled and not comments[named] and (name == "main" or i in long or not plain):
                lifted |= set(around[named])
        for j in range(len(self.named)):
            if held[j] * 2 > total and (not comments[j] or not outside_comments):
                lifted.add(j)
        return [
            (text, linked, part or (named >= 0 and any(j not in lifted for j in around[named])), inside, preset)
            for (text, linked, part, inside, preset), (named, _) in zip(self.found, self.where, strict=True)
        ]


def blocks(page: str) -> list[tuple[str, int, bool, bool, bool]]:
    out, at, size = _Blocks(), 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            out.text(page[at:])
            break
        out.text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
        elif page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
        elif m := _TAG.match(page, lt):
            name, at = m[2].lower(), m.end()
            if m[1]:
                out.end(name)
            elif name in RAW:
                if not m[3].rstrip().endswith("/"):
                    close = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
                    at = close.end() if close else size
            else:
                out.start(name, m[3])
        elif page[lt + 1 : lt + 2].isalpha() or page[lt + 1 : lt + 2] == "/":  # a tag with an open quote, or cut off
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
        else:
            out.text("<")
            at = lt + 1
    out.flush()
    return out.judged()


def stop_density(text: str) -> float:
    words = _LETTERS.findall(text)
    return sum(w.lower() in STOP_WORDS for w in words) / len(words) if words else 0.0


def _other_script(text: str) -> bool:
    """Whether most letters aren't Latin."""
    return not text.isascii() and 2 * len(_LATIN.findall(text)) < sum(map(len, _LETTERS.findall(text)))


def _inherited(decided: list[bool | None], counts: list[bool], asking: list[bool]) -> list[list[tuple[int, bool]]]:
    """For each block that asks: distance and label of the nearest decided block that counts, on either side."""
    near: list[list[tuple[int, bool]]] = [[] for _ in decided]
    for order in (range(len(decided)), range(len(decided) - 1, -1, -1)):
        last: tuple[int, bool] | None = None
        for i in order:
            if asking[i] and last:
                near[i].append((abs(i - last[0]), last[1]))
            if counts[i] and decided[i] is not None:
                last = (i, decided[i])
    return near


def labels(found: list[tuple[str, int, bool, bool, bool]]) -> list[bool]:
    """Content or not, for each block."""
    in_article = any(inside and not part for _, _, part, inside, _ in found)
    own = [not part and (inside or not in_article) for _, _, part, inside, _ in found]
    letters_of = [len(text) - text.count(" ") for text, *_ in found]
    prose = [mine and linked <= LINK_DENSITY * n for mine, (_, linked, *_), n in zip(own, found, letters_of, strict=True)]
    # Density that a block needs on this page: none where no long block has it, less where even the richest has little more.
    richest = max((stop_density(text) for (text, *_), p in zip(found, prose, strict=True) if p and len(text) >= LONG), default=0.0)
    needed = min(STOP_DENSITY, richest / 2) if richest >= STOP_DENSITY else 0.0
    least = SHORT if in_article else LONG

    # Pass 1.
    decided: list[bool | None] = []
    rich = []
    for (text, _, _, _, preset), mine, p in zip(found, own, prose, strict=True):
        rich.append(p and len(text) >= SHORT and (preset or stop_density(text) >= needed or _other_script(text)))
        if not mine or not (p or in_article):  # inside an article a block full of links may be a sentence
            decided.append(False)
        elif rich[-1]:
            decided.append(True if len(text) >= least else None)
        else:
            decided.append(False if p and not in_article and SHORT <= len(text) < LONG else None)
    if True not in decided:  # a page of short blocks: those that read like prose, else whatever isn't a menu
        decided = [True if r else d for r, d in zip(rich, decided, strict=True)]
        if True not in decided:
            decided = [True if d is None else d for d in decided]

    # Pass 2: long blocks first, which only prose can tell about, then the short ones.
    for size in (LONG, 0):
        asking = [d is None and len(text) >= size for d, (text, *_) in zip(decided, found, strict=True)]
        counts = [p and len(text) >= SHORT if size else m or not in_article for p, m, (text, *_) in zip(prose, own, found, strict=True)]
        for i, sides in enumerate(_inherited(decided, counts, asking)):
            if asking[i]:
                nearest = min((d for d, _ in sides), default=0)
                votes = [v for d, v in sides if d == nearest]
                decided[i] = any(votes) if in_article or size else all(votes)
    return [bool(d) for d in decided]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return " ".join(text for (text, *_), keep in zip(found, labels(found), strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [main_text(x.as_py()) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``)."""
    source = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    return source.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op10_html(pages: DataFrame) -> DataFrame:
    return extract(pages)
