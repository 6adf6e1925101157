"""Main text of web pages: the contiguous region with the greatest score.

A page is read once into words and tags, in order. Words score by the context they stand in (heading, paragraph, list item,
table cell, link or other; on a page that marks its article, within or beside it), tags by their name and always below
zero; both weights are log odds counted on labelled pages. A page labels itself where it has an ``article`` or ``main``
element: what lies in it is content, the rest is not. Pages without one use the same weights, and tables without labelled pages the
counts of ``PRIOR`` alone. One scan (Kadane's) finds the region whose scores sum highest; of equal ones the first. Its
blocks are the text.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments are known by element name, role, class or
id. Such a zone has no words, only the score of its tag, so a region may span it and its text never comes out. A header
inside an article keeps its headings.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by a line
feed; nothing else is dropped. Unclosed elements end with the element around them, a paragraph also where the next block
begins; a comment or script that is not closed takes the rest of the page.

Null or empty html, or a page without words of content: the empty text. Null ids and urls stay. Repeated rows each give
their row. Empty table: no rows. Extra columns are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 20_000  # pages that the weights are counted on; those with the least hash of id and url (copies count with them)

# Names of the HTML standard, and words that classes, ids and roles use for parts that are no article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp noembed noframes".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ITEMS = set("li dt dd".split())
CELLS = set("td th caption".split())
BLOCKS = HEADINGS | ITEMS | CELLS | set(
    "address article aside blockquote body br center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr "
    "html main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
ZONES = RAW | set(
    "aside audio button canvas datalist dialog fieldset footer form head input legend map menu meter nav object option "
    "output progress search select svg video".split()
)
ZONE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsors sponsored promo promos promotion banner banners "
    "cookie cookies consent gdpr notice notices alert popup modal overlay paywall newsletter subscribe subscription signup login "
    "menu menus nav navbar navigation breadcrumb breadcrumbs sidebar aside rail footer comment comments commentlist "
    "disqus respond responses feedback talkback guestbook reply replies share sharing social related recommended recommendations search toolbar pagination pager "
    "skip masthead topbar copyright legal disclaimer hidden".split()
)
ZONE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

# Counts inside and outside of content that every weight starts from.
PRIOR = {
    **{f"word:{c}": (8.0, 2.0) for c in ("heading", "block", "cell", "item")}, "word:other": (4.0, 2.0), "word:link": (1.0, 3.0),
    "word:beside": (0.5, 8.0), "word:within": (8.0, 0.5), "within": (8.0, 0.5), "zone": (1.0, 4.0),
    **{t: (1.0, 4.0) for t in ("nav", "header", "footer", "ul", "ol", "a", "body", "html", "article", "main")},
}
OTHER_PRIOR = (4.0, 1.0)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)", re.S)
MAIN_ROLE = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _zone(name: str, rest: str, hints: bool) -> str:
    """What kind of zone an element opens: 'zone', 'header' or none; without ``hints`` by its name alone, and never a form."""
    if name in ZONES and (hints or name != "form"):
        return "zone"
    found = "header" if name == "header" else ""
    if not hints or not rest or ("=" not in rest and "hidden" not in rest):
        return found
    for key, *values in ATTRIBUTE.findall(rest):
        key, value = (key or values[-1]).lower(), "".join(values[:-1])
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and HIDING.search(value)):
            return "zone"
        if key == "role" and value.lower().strip() in ZONE_ROLES:
            return "zone"
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            words = {w.lower() for w in CAMEL.findall(value)}
            if words & ZONE_WORDS:
                return "zone"
            if "header" in words:
                found = "header"
    return found


def _context(stack: list[tuple[str, str, int]]) -> str:
    for name, _, _ in reversed(stack):
        if name == "a":
            return "link"
        if name in HEADINGS:
            return "heading"
        if name in ITEMS:
            return "item"
        if name in CELLS:
            return "cell"
        if name in ("p", "blockquote", "pre", "figcaption"):
            return "block"
        if name in BLOCKS:
            break
    return "other"


class _Page:
    """The open elements of a page while it is read, and what has come out so far."""

    def __init__(self) -> None:
        self.out: list[tuple[str, str, int]] = []
        self.stack: list[tuple[str, str, int]] = []  # name, kind of zone, level of content
        self.zones = 0
        self.seen = False  # whether an article or main element has begun

    def level(self) -> int:
        return max((level for _, _, level in self.stack), default=0)

    def put(self, feature: str, text: str = "") -> None:
        self.out.append((feature, text, self.level()))

    def words(self, text: str) -> None:
        in_header = any(zone == "header" for _, zone, _ in self.stack)
        if self.zones or (in_header and not (self.level() and any(name in HEADINGS for name, _, _ in self.stack))):
            return
        text = html.unescape(text) if "&" in text else text
        if text:
            self.put(f"word:{_context(self.stack)}", text)

    def close(self, place: int) -> None:
        self.zones -= sum(zone == "zone" for _, zone, _ in self.stack[place:])
        del self.stack[place:]

    def end(self, name: str) -> None:
        place = next((n for n in range(len(self.stack) - 1, -1, -1) if self.stack[n][0] == name), None)
        if place is None:
            return
        shown = not self.zones
        if shown and name in BLOCKS:
            self.put("")
        self.close(place)
        if not self.zones:
            if shown:
                self.put(name)
            elif name in BLOCKS:
                self.put("")

    def implied_ends(self, name: str) -> None:
        """A block ends the head and an open paragraph; an item, row or cell its open sibling."""
        for n in range(len(self.stack) - 1, -1, -1):
            own = self.stack[n][0]
            siblings = next((group for group in (ITEMS, CELLS, {"tr"}) if name in group), ())
            if own == "head" or (own == "p" and name != "br") or own in siblings or (own in CELLS and name == "tr"):
                self.close(n)
                return
            if own in BLOCKS:
                return

    def begin(self, name: str, rest: str, hints: bool) -> None:
        if name in BLOCKS:
            self.implied_ends(name)
        level = 2 if name == "article" else 1 if name == "main" or MAIN_ROLE.search(rest) else 0
        if level and not self.seen and self.zones and not any(own in ("aside", "footer") for own, _, _ in self.stack):
            # The first content element: what it stands in is no zone after all, or was not closed.
            self.stack, self.zones = [(own, "", at) for own, _, at in self.stack], 0
        zone = _zone(name, rest, hints)
        if not self.zones:
            if name in BLOCKS:
                self.put("")
            self.put("zone" if zone == "zone" else name)
        if name not in VOID:
            self.seen = self.seen or level > 0
            self.stack.append((name, zone, level))
            self.zones += zone == "zone"


def read(page: str, hints: bool = True) -> list[tuple[str, str, int]]:
    """The page as (feature, text, level): runs of words with their text, tags and block ends with none.

    ``feature`` is ``word:`` and a context, the name of a tag, or ``zone``; an empty feature is the end of a block.
    ``level`` is 2 in an article element, 1 in a main element, else 0. Without ``hints`` roles, classes and ids tell nothing.
    """
    own, at = _Page(), 0
    while found := TOKEN.search(page, at):
        if found.start() > at:
            own.words(page[at : found.start()])
        at = found.end()
        name, rest = (found["name"] or found["name2"] or "").lower(), found["rest"] or found["rest2"] or ""
        if not name:
            continue
        if found["end"] or found["end2"]:
            own.end(name)
        elif name in RAW:
            ending = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = ending.end() if ending else len(page)
        else:
            own.begin(name, rest, hints)
    own.words(page[at:])
    return own.out


def _marked(parts: list[tuple[str, str, int]]) -> int:
    """The highest level that has words: what lies below it is beside the content; 0 if the page marks no content."""
    return max((level for _, text, level in parts if text and not text.isspace()), default=0)


def counts(parts: list[tuple[str, str, int]]) -> Counter[tuple[str, bool]]:
    """How often each feature lies in and outside of the content of a page that marks it; nothing for other pages."""
    found: Counter[tuple[str, bool]] = Counter()
    marked = _marked(parts)
    for feature, text, level in parts if marked else []:
        inside = level >= marked
        if text:
            words = len(text.split())
            found[feature, inside] += words
            found["word:within" if inside else "word:beside", inside] += words
        elif feature:
            found[feature, inside] += 1
            found["within", True] += inside
    return found


def weights(seen: dict[tuple[str, bool], float]) -> dict[str, float]:
    """Log odds of content for words, and for tags the log of the part of them that lies in content: always below zero."""
    names, made = {f for f, _ in seen} | PRIOR.keys() | {""}, {}
    for name in names:
        inside, outside = PRIOR.get(name, OTHER_PRIOR)
        inside, outside = inside + seen.get((name, True), 0), outside + seen.get((name, False), 0)
        made[name] = math.log(inside / outside) if name.startswith("word:") else math.log(inside / (inside + outside))
    return made


def extract(parts: list[tuple[str, str, int]], weight: dict[str, float]) -> str:
    """The blocks of the region with the greatest score, joined by line feeds."""
    marked = _marked(parts)
    best = total = 0.0
    start, region = 0, (0, 0)
    for n, (feature, text, level) in enumerate(parts):
        if text:
            score = weight[feature if not marked else "word:within" if level >= marked else "word:beside"] * len(text.split())
        elif feature:
            score = weight["within"] if marked and level >= marked else weight.get(feature, weight[""])
        else:
            score = 0.0
        if total <= 0:
            total, start = 0.0, n
        total += score
        if total > best:
            best, region = total, (start, n + 1)
    blocks, run = [], []
    for feature, text, level in [*parts[slice(*region)], ("", "", 0)]:
        if text and level >= marked:
            run.append(text)
        elif not text and not feature:
            blocks.append(" ".join("".join(run).split()))
            run = []
    return "\n".join(b for b in blocks if b)


def page_text(page: str | None, weight: dict[str, float]) -> str:
    """The main text of one page. Where its zones leave nothing, they are taken by element name alone."""
    page = page or ""
    return extract(read(page), weight) or extract(read(page, hints=False), weight)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter[tuple[str, bool]] = Counter()
        for page in batch.column("html"):
            found.update(counts(read(page.as_py() or "")))
        names = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in names], pa.string()), pa.array([i for _, i in names], pa.bool_()), pa.array([float(found[n]) for n in names], pa.float64())],
            ["feature", "inside", "n"],
        )


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights counted on at most ``sample_pages`` pages that mark their content."""
    spot = F.xxhash64("page_id", "url")
    # Only hashes are ordered; the pages themselves stay where they are.
    last = pages.select(spot.alias("spot")).orderBy("spot").limit(sample_pages).agg(F.max("spot")).first()[0]
    if last is None:
        return weights({})
    seen = pages.filter(spot <= last).select("html").mapInArrow(_counted, "feature string, inside boolean, n double")
    rows = seen.filter(F.length("feature") <= 40).groupBy("feature", "inside").agg(F.sum("n").alias("n"))
    # Elements may have invented names: those seen most are enough, the others share one weight.
    return weights({(r["feature"], r["inside"]): r["n"] for r in rows.orderBy(F.desc("n"), "feature", "inside").limit(1_000).collect()})


def main_text(pages: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page."""
    weight = fit(pages) if weight is None else weight

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_text(page.as_py(), weight) for page in batch.column("html")]
            made = [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *made], ["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(texts, f"{kinds}, text string, n_chars long")
