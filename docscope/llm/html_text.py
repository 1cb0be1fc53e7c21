"""HTML main text by tag-path ratios.

Each block of text has a root-to-leaf path of tags with their class, id and role names. Per path, text length and
punctuation are averaged over its blocks; both ratios are smoothed along the page, fused into one score, lowered by the
share of link text and by names that mark parts beside the main text, and paths above a threshold are content. They
select the nodes of the result. Short blocks between them (headings, list items, table cells) come along where
the element that holds the content holds them too. Names are a feature of the score and no veto: what they mark on
all of a page's text lowers the threshold as well.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ready, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot "
    "th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold main text.
DROPPED = frozenset(
    "head title nav footer aside form script style noscript template iframe object svg canvas button select textarea input label "
    "menu dialog audio video map search".split()
)
#: Words of class, id and role that mark parts beside the main text.
MARKS = frozenset(
    "nav navigation navbar navi menu menubar submenu topbar breadcrumb breadcrumbs pagination pager paging toc footer foot colophon contentinfo "
    "masthead banner sidebar side aside complementary rail widget widgets ad ads adv advert adverts advertisement advertisements adsense "
    "adbox adslot banner sponsor sponsored sponsors promo promos promoted promotion "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search searchbox "
    "comment comments commentlist respond reply replies discussion disqus related recommended recommendations share sharing social "
    "form hidden skip copyright tags".split()
)
#: With these words an element is not lowered, whatever else its names say.
MAIN = frozenset("article articlebody articlecontent entry post posting story content main body maintext text page wrapper container".split())
#: Of these, words that also name the look of the main text or of its surroundings; they don't outweigh MARKS.
LOOKS = frozenset("body page wrapper container text".split())
#: Of MARKS, words that parts of an article have too: they lower the score less.
DOUBTFUL = frozenset("discussion related notice notices alert side tags form social rail banner skip".split())
#: The state of an element, not what it is.
STATE = re.compile(r"(?:has|no|with|without)[-_]", re.I)
RAW = "script|style|noscript|template|iframe|svg|textarea|title|xmp"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")
#: A start tag closes these open ones, up to the nearest of the stops.
CLOSES = {
    **dict.fromkeys(BLOCK - {"li", "dd", "dt", "tr", "td", "th", "tbody", "thead", "tfoot", "option", "body", "html"}, ({"p"}, {"td", "th", "table", "button", "object", "caption"})),
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt", "p"}, {"dl"}),
    "dt": ({"dd", "dt", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}


#: The score of a path is multiplied by this for each element marked as beside the main text, surely or in doubt.
SURE, DOUBT = 0.1, 0.5


class Element:
    __slots__ = ("tag", "path", "parent", "off", "depth", "main", "factor", "link", "sure")

    def __init__(self, tag: str, parent: Element | None, off: bool, names: str = "", main: bool = False, factor: float = 1.0) -> None:
        self.tag, self.parent, self.off, self.main = tag, parent, off, main
        self.factor = parent.factor * factor if parent else 1.0
        self.sure = bool(parent and parent.sure) or factor == SURE
        self.link = tag == "a" or bool(parent and parent.link)
        # Inline elements are part of their block's path.
        self.path = f"{parent.path}/{tag}{names}" if parent and (tag in BLOCK or tag in DROPPED) else parent.path if parent else tag
        self.depth = parent.depth + 1 if parent else 0


def _marked(attrs: str) -> tuple[bool, bool, float, str]:
    """Of attributes: whether they hide the element, name it as main text, the factor of its marks, and its names."""
    off = main = named = sure = False
    names: list[str] = []
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, False, 1.0, ""
        if name in ("class", "id", "role", "itemprop"):
            for one in value.split():
                if STATE.match(one):
                    continue
                words = {w.lower() for w in WORD.findall(one)}
                names += words
                if words & MARKS:
                    off = True
                    sure |= not words & MARKS <= DOUBTFUL
                elif words & MAIN:
                    named = True
                    main |= not words & MAIN <= LOOKS
    factor = 1.0 if main or not off else SURE if sure else DOUBT
    return False, named and factor == 1.0, factor, "".join(f".{n}" for n in sorted(set(names)))


def text_nodes(page: str) -> list[tuple[Element, int, str]]:
    """(element, block, text) of each text node in page order; nodes of one block have the same number."""
    at = Element("", None, False)
    nodes: list[tuple[Element, int, str]] = []
    block = 0
    for m in TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            nodes.append((at, block, text))
        elif tag := m["tag"]:
            tag = tag.lower()
            if tag in BLOCK:
                block += 1
            if m["close"]:
                e = at
                while e.parent and e.tag != tag:
                    e = e.parent
                if e.parent:
                    at = e.parent
                continue
            if tag == "br":
                nodes.append((at, block, " "))
                continue
            if tag in VOID:
                continue
            closed, stops = CLOSES.get(tag, ((), ()))
            e, found = at, None
            while closed and e.parent and e.tag not in stops:
                if e.tag in closed:
                    found = e
                e = e.parent
            if found:
                at = found.parent
            hidden, main, factor, names = _marked(m["attrs"]) if m["attrs"] else (False, False, 1.0, "")
            off = at.off or tag in DROPPED or hidden
            if tag in ("html", "body", "main", "article"):
                factor = 1.0
            if tag == "header" and not off:
                off = not any(x.tag in ("article", "main") for x in _up(at))
            if not m["attrs"].endswith("/") or tag in BLOCK:
                at = Element(tag, at, off, names, main or tag in ("article", "main"), factor)
    return nodes


def _up(e: Element | None) -> Iterator[Element]:
    while e:
        yield e
        e = e.parent


class Block:
    """The text nodes of one block that are not dropped: their path, length, punctuation and link text."""

    __slots__ = ("at", "texts", "length", "marks", "links")

    def __init__(self, at: Element) -> None:
        self.at, self.texts, self.length, self.marks, self.links = at, [], 0, 0, 0

    def add(self, e: Element, text: str) -> None:
        self.texts.append(text)
        if n := len(text.strip()):
            self.length += n
            self.marks += len(PUNCTUATION.findall(text))
            self.links += n * e.link

    def weak(self) -> bool:
        """Mostly links, or marked as beside the main text."""
        return 2 * self.links > self.length or self.at.sure


def blocks_of(page: str) -> list[Block]:
    blocks: list[Block] = []
    last = None
    for e, number, text in text_nodes(page):
        if e.off:
            continue
        if number != last:
            blocks.append(Block(e))
            last = number
        elif not blocks[-1].length and text.strip():
            blocks[-1].at = e
        blocks[-1].add(e, text)
    return [b for b in blocks if b.length]


def content_paths(blocks: list[Block], threshold: float = 0.35) -> set[str]:
    """Paths whose smoothed and fused ratios of text and punctuation to blocks reach ``threshold`` of the page's level."""
    count: dict[str, int] = {}
    length: dict[str, int] = {}
    marks: dict[str, int] = {}
    links: dict[str, int] = {}
    factor: dict[str, float] = {}
    order = [b.at.path for b in blocks]
    for p, b in zip(order, blocks, strict=True):
        count[p] = count.get(p, 0) + 1
        length[p] = length.get(p, 0) + b.length
        marks[p] = marks.get(p, 0) + b.marks
        links[p] = links.get(p, 0) + b.links
        factor[p] = b.at.factor

    def smooth(total: dict[str, int]) -> dict[str, float]:
        """Binomial weights over each block's path and those of its neighbours, averaged for each path."""
        ratio = {p: total[p] / count[p] for p in count}
        found: dict[str, float] = {}
        last = len(order) - 1
        for i, p in enumerate(order):
            near = 2 * ratio[p] + ratio[order[max(0, i - 1)]] + ratio[order[min(last, i + 1)]]
            found[p] = found.get(p, 0.0) + near / 4
        return {p: t / count[p] for p, t in found.items()}

    texts, puncts = smooth(length), smooth(marks)
    fused = {p: (texts[p] * (1 + puncts[p])) ** 0.5 * (1 - links[p] / length[p]) * factor[p] for p in count}
    # The level of the text that scores high: much text that scores low does not move it.
    level = sum(fused[p] ** 2 * length[p] for p in count) / (sum(fused[p] * length[p] for p in count) or 1.0)
    return {p for p in count if fused[p] >= threshold * level}


def main_text(page: str | None, threshold: float = 0.35) -> str:
    """The article's blocks joined by newlines; empty for a null or empty page, or one without text."""
    if not page or not (blocks := blocks_of(page)):
        return ""
    content = content_paths(blocks, threshold)
    chosen = [b for b in blocks if b.at.path in content]
    held: dict[Element, int] = {}
    for b in chosen:
        for x in _up(b.at):
            held[x] = held.get(x, 0) + b.length
    total = sum(b.length for b in chosen)
    # An article or main with most of the content is the root, the outermost if several are within each other; else
    # the smallest element with all of it.
    articles = [e for e, n in held.items() if e.tag in ("article", "main") and not any(x.tag in ("article", "main") for x in _up(e.parent))]
    if 2 * sum(held[e] for e in articles) >= total:
        roots = set(articles)
    else:
        roots = {max((e for e, n in held.items() if n == total), key=lambda e: e.depth)}
        while (root := next(iter(roots))).parent and (root.tag not in BLOCK or root.tag in HEADINGS | {"p", "li", "td", "tr", "pre", "blockquote"}):
            roots = {root.parent}
    whole = not roots & {e for e in roots if e.tag in ("html", "body", "")}
    inside = [any(x in roots for x in _up(b.at)) for b in blocks]
    hits = [i for i, b in enumerate(blocks) if inside[i] and b.at.path in content]
    lines = []
    for i, b in enumerate(blocks):
        if not inside[i] or _byline(b.at):
            continue
        if b.at.path in content or not b.weak() and (whole or hits[0] <= i <= hits[-1] or any(x.tag in HEADINGS for x in _up(b.at))):
            lines.append(" ".join(html.unescape("".join(b.texts)).split()))
    return "\n".join(x for x in lines if x)


def _byline(e: Element) -> bool:
    """In a header within the article only headings are its text."""
    seen_heading = False
    for x in _up(e):
        seen_heading |= x.tag in HEADINGS
        if x.tag == "header":
            return not seen_heading
    return False


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null, empty or textless page gives an empty text. Repeated rows give repeated results, whatever their ids (null
    too), an empty table no rows; other columns are ignored, whatever their names. Paths that tie at the threshold are
    content. Long pages are read whole. Broken markup is read as browsers do: an end tag closes what it can, else
    nothing.
    """
    ready(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            columns = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op10_html_text": op10_html_text}
SQL: dict[str, str] = {}
