"""HTML extraction by two-pass block rules.

A page is cut into blocks of text at block-level tags. First pass: blocks in menus, footers, forms, adverts, comments and so
on are bad by the element that they stand in; the others are good, bad, near or short by stop-word density, length and link
density. Inside the article (an article or main element, or one whose name says so) few stop words leave a block undecided,
and links make it bad only where several blocks of them stand in a row. Second pass: short and near blocks take the label of
the nearest decided neighbours, headings that of what follows.

All of it takes time in proportion to the page: open elements carry what is known about them, and neighbours come from one
sweep in each direction.

Defined cases: a null or empty page gives an empty text; unclosed tags, comments and quotes end at the next tag or the end; of
raw elements only an unclosed script or style takes the rest of the page; buttons, lists of choices and drawings end at the
next block; the text of formulas stays; character references are decoded once, after the tags are gone; repeated rows are pages
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

# Fixed values.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style noscript template textarea title iframe noframes".split())
#: Inline elements whose text is no text of the page: it ends with them, or at the next block.
SILENT_TAGS = frozenset("annotation annotation-xml audio button canvas object select svg video".split())
SECTIONS = frozenset("article main nav aside footer form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What ends an open paragraph.
ITEMS = frozenset("p li dt dd td th tr".split())
#: Blocks of running text: a link that fills one is part of it.
PROSE_TAGS = frozenset("p blockquote pre figcaption caption".split()) | HEADINGS
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog head".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BAD_NAMES = frozenset(
    "ad adbox adbanner ads adsense adslot adunit adv advert adverts advertisement advertising advertorial alert banner breadcrumb breadcrumbs comment commentlist "
    "comments consent cookie cookiebanner cookiebar cookies copyright disqus disclaimer feedback footer gdpr header login masthead mainnav menu menus modal nav "
    "navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion reactions recommended related "
    "replies reply respond search share sharing shoutbox sidebar sidebars sidenav signup skip social sponsor sponsored subnav subscribe subscription teaser "
    "teasers toolbar topbar topnav widget widgets".split()
)
GOOD_NAMES = frozenset("article articlebody body content entry main maincontent post story".split())
#: Words of headings over links to other pages.
MENU_WORDS = frozenset("more related also next previous popular latest recommended trending tags share follow mehr auch ähnliche beliebt plus aussi similaires voir más también relacionados siguiente".split())
#: Names of classes that say what the page has, not what the element is.
ABOUT = ("has-", "with-", "no-", "is-", "show-", "hide-", "js-")
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been before but by can could did do does for from had has have he her his how i if in into is it "
    "its like more most my no not of on one or other our out over said she so some such than that the their them then there these they this to two up was we "
    "were what when which who will with would you your "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son "
    "sont sur un une vous à été être "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer eines er es für hat ich ihr im ist ja kann mit nach "
    "nicht noch nur oder sein sich sie sind so über um und uns vom von vor war was wenn wer wie wir wird zu zum zur "
    "al como con del desde donde e el ella entre era es esta este ha hay la las lo los más me mi muy no nos o para pero por porque que se ser si sin sobre su "
    "sus también te un una y ya".split()
)
SHORT, LONG, MANY_LINKS, MOST_LINKS, FEW_STOPS, MANY_STOPS, FOREIGN = 70, 200, 0.2, 0.5, 0.2, 0.3, 0.05

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?")
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z_:-])([a-zA-Z_:-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[^\W\d_]+")


def _marks(raw: str) -> tuple[bool, bool, bool]:
    """Of an element's attributes: bad for sure, bad by its class or id, holding the article by these."""
    sure, names, good = False, set(), False
    for m in _ATTRIBUTE.finditer(raw):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            for item in value.split():
                if not item.lower().startswith(ABOUT):
                    names |= set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", item).lower()))
        elif key == "role":
            sure, good = sure or value.lower() in BAD_ROLES, good or value.lower() in ("main", "article")
        elif key == "itemprop":
            good = good or value == "articleBody"
        elif key == "style":
            sure = sure or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif key == "aria-hidden":
            sure = sure or value.lower() == "true"
    sure = sure or bool(re.search(r"(?:^|\s)hidden(?:\s|=|$|/)", _ATTRIBUTE.sub(" ", raw)))
    bad = names & BAD_NAMES
    if bad == {"header"} and names & GOOD_NAMES:
        bad = set()  # the head of an article is its own
    return sure, bool(bad), good or (not bad and bool(names & GOOD_NAMES))


class Block:
    """level: 3 inside an article element, 2 inside a main one, 1 inside one whose name says so, 0 else. named: number of the
    innermost element with a bad name, 0 for none. prose: whether its own element is one of running text."""

    __slots__ = ("text", "linked", "sure_bad", "named", "level", "article", "heading", "title", "prose", "label", "first")

    def __init__(self, text: str, linked: int, sure_bad: bool, named: int, level: int, heading: int, prose: bool):
        self.text, self.linked, self.sure_bad, self.named, self.level = text, linked, sure_bad, named, level
        self.heading, self.title, self.prose, self.article = heading > 0, heading == 1, prose, False


class Open:
    """The open elements. Each carries what holds for all that stands in it: (tag, bad for sure, named, level, heading)."""

    def __init__(self) -> None:
        self.items: list[tuple[str, bool, int, int, int]] = []
        self.at: dict[str, list[int]] = {}
        self.sections: list[int] = []

    @property
    def last(self) -> tuple[str, bool, int, int, int]:
        return self.items[-1] if self.items else ("", False, 0, 0, 0)

    def push(self, tag: str, sure: bool, named: int, level: int) -> None:
        _, was_sure, was_named, was_level, was_heading = self.last
        self.at.setdefault(tag, []).append(len(self.items))
        if tag in SECTIONS:
            self.sections.append(len(self.items))
        self.items.append((tag, was_sure or sure, named or was_named, max(was_level, level), was_heading or (int(tag[1]) if tag in HEADINGS else 0)))

    def pop(self) -> None:
        tag = self.items.pop()[0]
        self.at[tag].pop()
        if tag in SECTIONS:
            self.sections.pop()

    def close(self, tag: str) -> None:
        """Up to the innermost element of the kind; a closing tag doesn't reach out of the section that it stands in."""
        where = self.at.get(tag)
        if not where:
            return
        beyond = bool(self.sections) and self.sections[-1] > where[-1]
        if not beyond or tag in SECTIONS or tag in ("body", "html"):
            for _ in range(len(self.items) - where[-1]):
                self.pop()


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """The page's blocks, and for each element with a bad name, numbered from 1, the number of the next one around it."""
    out: list[Block] = []
    around = [0]
    stack = Open()
    parts: list[tuple[str, bool]] = []
    links = 0
    silent, depth = "", 0  # an inline element whose text doesn't count, and how deep in elements of its kind
    endless: set[str] = set()  # raw elements that nothing closes any more

    def flush() -> None:
        if not parts:
            return
        text = " ".join(entities.unescape("".join(p for p, _ in parts)).split())
        if text:
            linked = len(" ".join(entities.unescape("".join(p for p, link in parts if link)).split()))
            tag, sure, named, level, heading = stack.last
            out.append(Block(text, linked, sure, named, level, heading, tag in PROSE_TAGS))
        parts.clear()

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at and not silent:
            parts.append((page[at:lt], links > 0))
        if lt == end:
            break
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE_TAG.match(page, lt)
        if not m:
            if not silent:
                parts.append(("<", links > 0))
            at = lt + 1
            continue
        closing, tag, raw = bool(m[1]), m[2].lower(), m[3]
        at = m.end()
        if tag in RAW_TAGS and not closing:
            if tag in BLOCK_TAGS:
                flush()
            if not raw.endswith("/") and tag not in endless:
                over = _CLOSE[tag].search(page, at)
                if over is not None:
                    at = over.end()
                elif tag in ("script", "style"):
                    at = end
                else:
                    endless.add(tag)
            parts.append((" ", links > 0))
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br":
            parts.append((" ", links > 0))
            continue
        if tag not in BLOCK_TAGS:
            if tag == silent:
                depth += -1 if closing else 1
                silent = silent if depth else ""
            elif not silent and not closing and tag not in VOID_TAGS and not raw.endswith("/") and (tag in SILENT_TAGS or (raw and any(_marks(raw)[:2]))):
                silent, depth = tag, 1
                parts.append((" ", links > 0))
            continue
        flush()
        links, silent = 0, ""
        if tag in VOID_TAGS:
            continue
        if closing:
            stack.close(tag)
            continue
        if tag in ITEMS or tag in HEADINGS:
            # These end an open paragraph, and an element of their own kind in the same list or table.
            while stack.items and (stack.last[0] == "p" or (stack.last[0] == tag and tag not in HEADINGS)):
                stack.pop()
        elif stack.last[0] == "p":
            stack.pop()
        sure, named, good = _marks(raw) if raw else (False, False, False)
        level = 3 if tag == "article" else 2 if tag == "main" else int(good)
        sure = sure or tag in BAD_TAGS or (tag == "header" and stack.last[3] < 2)
        if tag in ("main", "body", "html"):
            sure = named = False
        if named:
            around.append(stack.last[2])
        stack.push(tag, sure, len(around) - 1 if named else 0, 0 if tag in ("body", "html") else level)
    flush()
    return out, around


_CLOSE = {tag: re.compile(rf"</{tag}\s*>|</{tag}(?=[\s>])", re.I) for tag in RAW_TAGS}


def outside_frames(found: list[Block], around: list[int]) -> list[bool]:
    """For each element with a bad name whether it, or one around it, is what its name says. One that holds most of the page and
    its title, or without titles nearly all, isn't an advert or a menu, whatever its name."""
    total = sum(len(b.text) for b in found if not b.sure_bad) or 1
    size, titled = [0] * len(around), [False] * len(around)
    for b in found:
        if not b.sure_bad:
            size[b.named] += len(b.text)
            titled[b.named] |= b.title
    for k in range(len(around) - 1, 0, -1):
        if around[k]:
            size[around[k]] += size[k]
            titled[around[k]] |= titled[k]
    has_title = any(b.title and not b.sure_bad for b in found)
    bad = [False] * len(around)
    for k in range(1, len(around)):
        frame = size[k] > 0.5 * total and titled[k] if has_title else size[k] > 0.97 * total
        bad[k] = bad[around[k]] or not frame
    return bad


def first_pass(found: list[Block], around: list[int]) -> None:
    """Labels good, bad, near and short."""
    bad_name = outside_frames(found, around)
    for b in found:
        b.sure_bad = b.sure_bad or bad_name[b.named]
    # The article is what the strongest mark holds, if that is a fair part of what isn't bad.
    rest = sum(len(b.text) for b in found if not b.sure_bad) or 1
    level = next((n for n in (3, 2, 1) if sum(len(b.text) for b in found if not b.sure_bad and b.level >= n) >= 0.3 * rest), 0)
    counts = [(len(words), sum(w in STOP_WORDS for w in words)) for words in (_WORD.findall(b.text.lower()) for b in found)]
    own = [n for b, n in zip(found, counts, strict=True) if not b.sure_bad]
    # In a language that the list doesn't know, length and link density decide alone.
    foreign = sum(n for _, n in own) < FOREIGN * sum(n for n, _ in own)
    for b, (n_words, n_stops) in zip(found, counts, strict=True):
        b.article = level > 0 and b.level >= level and not b.sure_bad
        stops = 1.0 if foreign else n_stops / max(1, n_words)
        density, length = b.linked / len(b.text), len(b.text)
        if b.sure_bad or (level > 0 and not b.article):
            label = "bad"
        elif b.article:
            label = "links" if density > MOST_LINKS and length < LONG and not b.prose else "short" if length < SHORT or density > MOST_LINKS else "good" if stops >= FEW_STOPS or length > LONG else "near"
        elif density > MANY_LINKS:
            label = "bad"
        elif length < SHORT:
            label = "bad" if b.linked else "short"
        elif stops >= MANY_STOPS:
            label = "good" if length > LONG else "near"
        else:
            label = "near" if stops >= FEW_STOPS else "bad"
        b.label = b.first = label
    # Blocks of links inside the article: several in a row at its edge are a menu, unless a heading announces them that isn't a menu's
    # itself; others are undecided.
    inside = [i for i, b in enumerate(found) if b.article]
    runs = [list(g) for links, g in itertools.groupby(range(len(inside)), lambda k: found[inside[k]].label == "links") if links]
    for run in runs:
        edge, over = run[0] == 0 or run[-1] == len(inside) - 1, found[inside[run[0] - 1]] if run[0] else None
        headed = over is not None and over.heading and not MENU_WORDS & {*_WORD.findall(over.text.lower())}
        for k in run:
            b = found[inside[k]]
            b.label = b.first = "bad" if len(run) > 1 and edge and not headed else "short"


def _decided(firsts: list[str], labels: tuple[str, ...]) -> list[str]:
    """For each block the nearest label before it that is one of these, edge without one."""
    out, last = [], "edge"
    for x in firsts:
        out.append(last)
        if x in labels:
            last = x
    return out


def second_pass(found: list[Block]) -> None:
    """Short and near blocks inherit; a near one that stands by a good one is good."""
    firsts = [b.label for b in found]
    some_good = "good" in firsts
    before, after = (x for x in (_decided(firsts, ("good", "bad")), _decided(firsts[::-1], ("good", "bad"))[::-1]))
    left, right = (x for x in (_decided(firsts, ("good", "bad", "near")), _decided(firsts[::-1], ("good", "bad", "near"))[::-1]))
    # Inside the article only its own blocks count.
    own = [i for i, b in enumerate(found) if b.article]
    own_firsts = [firsts[i] for i in own]
    inside = dict(zip(own, zip(_decided(own_firsts, ("good", "bad")), _decided(own_firsts[::-1], ("good", "bad"))[::-1], [*own_firsts, "edge"][1:], strict=True), strict=True))
    for i, b in enumerate(found):
        if b.label not in ("short", "near") or (b.heading and not b.article):
            continue
        if b.article:
            # Undecided blocks belong to the article unless menus stand on both sides; headings go with what follows.
            one, two, following = inside[i]
            b.label = "bad" if (following == "bad" and not b.title if b.heading else one == two == "bad") else "good"
        elif b.first == "near":
            b.label = "bad" if before[i] in ("bad", "edge") and after[i] in ("bad", "edge") and some_good else "good"
        elif before[i] == after[i] == "good":
            b.label = "good"
        elif "good" in (before[i], after[i]):
            b.label = "good" if left[i] in ("near", "good") and right[i] in ("near", "good") else "bad"
        else:
            b.label = "bad"
    # Outside the article a heading goes with what the next block of another kind has become.
    following = "bad"
    for b in reversed(found):
        if not b.heading:
            following = b.label
        elif not b.article and b.label in ("short", "near"):
            b.label = "good" if following == "good" else "bad"
    if not any(b.label == "good" for b in found):
        # A page of short blocks only: those that aren't bad for sure are all there is.
        for b in found:
            if not b.sure_bad and b.first in ("short", "near"):
                b.label = "good"


def main_text(page: str | None) -> str:
    found, around = blocks(page or "")
    first_pass(found, around)
    second_pass(found)
    return "\n".join(b.text for b in found if b.label == "good")


@tidy
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            texts = [main_text(x.as_py()) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
