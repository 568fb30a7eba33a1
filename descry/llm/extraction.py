"""Main text of web pages by removing what a site repeats.

Each element's subtree has a hash of its tag, class, id, text and children.  Spark counts in
how many different pages of a host each hash is found; subtrees that many of its pages share
are the site's template and are left out when its pages are read.  An article, what holds
one, and plain paragraphs inside one are never template: copies of an article on a host keep
their text.  Elements that are no text of an article whatever they hold (scripts, forms,
menus, adverts by their class) are left out as well, as a host with few pages repeats nothing.

A page is walked once for its hashes and once for its text; nothing but hashes is shuffled.
The hashes kept for a host are those on a tenth of its pages or more, so there are at most
ten times as many as a page has elements, however many pages the host has.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.functions.text import once
from descry.llm.common import hidden, remove_folder, scratch_folder, text_of, written
from descry.llm.urlfilter import url_parts

#: Pages of a host that share a template's subtree: so many, and so many hundredths.
LEAST_PAGES, LEAST_SHARE = 5, 10

# --- fixed values: elements by what they are to a text --------------------------------------
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Content that is no markup, up to the end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NO_TEXT = frozenset(
    "script style textarea title xmp iframe noembed noframes noscript template head object svg "
    "canvas audio video map form button select option datalist input nav footer aside menu dialog".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that make up an article's text: never template where an article holds them.
FLOW = frozenset(
    "p h1 h2 h3 h4 h5 h6 hgroup blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption figure figcaption address center".split()
)
#: An open element of the first kind is ended by a start tag of the second.
ENDED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]),
    "p": BLOCKS,
}
#: Words of a class or id that name what is no text of an article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor "
    "sponsored promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs topbar "
    "masthead footer sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe signup login comment comments disqus reply replies "
    "respond share sharing social related recommended recommendations pager pagination toolbar "
    "skiplink".split()
)
#: Those of them that no article of the page lies in.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements comment comments disqus reply replies respond "
    "related recommended recommendations promo promos sponsored".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split()
)

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[/A-Za-z][^>]*+\Z",
    re.S,
)
ATTRIBUTE = re.compile(
    r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: A class that tells of another element, as `has-sidebar` does.
ABOUT = re.compile(r"(?:^|[\s])(?:has|no|with|without|is|wp)[-_]\S*", re.I)
_END = None


#: What an element is to the text: part of it, not wanted unless it is around an article, not wanted.
WANTED, AROUND, UNWANTED = range(3)


def _named(classes: str) -> int:
    """What the first or last word of a class or id tells of an element."""
    found = WANTED
    for name in ABOUT.sub(" ", classes).split():
        words = [w.lower() for w in WORD.findall(name)]
        for word in (words[:1] + words[-1:]) if words else ():
            if word in ASIDE_NAMES:
                return UNWANTED
            if word in NAMES:
                found = AROUND
    return found


def _unwanted(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element is no text of an article whatever it holds."""
    if tag in NO_TEXT:
        return AROUND if tag == "form" else UNWANTED
    if tag == "header" and not in_article:
        return AROUND
    if not attributes or tag in ("html", "body"):
        return WANTED
    said = {m.group(1).lower(): (m.group(2) or "").strip("\"'") for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in said or said.get("aria-hidden", "").lower() == "true":
        return UNWANTED
    if "display:none" in said.get("style", "").replace(" ", "").lower():
        return UNWANTED
    if said.get("role", "").lower() in ROLES:
        return AROUND
    return _named(said.get("class", "") + " " + said.get("id", ""))


class _Element:
    """An open element: where its text starts, its hash so far, and what its place tells."""

    __slots__ = ("tag", "start", "said", "hash", "unwanted", "depth", "in_article", "holds_article")

    def __init__(self, tag: str, attributes: str, start: int, said: int, above: _Element | None):
        self.tag, self.start, self.said = tag, start, said
        self.hash = xxhash.xxh64(tag)
        if attributes:
            self.hash.update("\x00".join(m.group(0) for m in ATTRIBUTE.finditer(attributes)))
        inside = above is not None and above.in_article
        self.unwanted = _unwanted(tag, attributes, inside)
        self.in_article = inside or tag in ("article", "main")
        self.depth = max(above.depth if above else 0, {"main": 1, "article": 2}.get(tag, 0))
        self.holds_article = False

    def removed(self) -> bool:
        """Unwanted, and not merely around an article."""
        return self.unwanted == UNWANTED or (self.unwanted == AROUND and not self.holds_article)

    def may_be_template(self) -> bool:
        root = self.holds_article or self.tag in ("article", "main", "body", "html")
        return not root and not (self.in_article and self.tag in FLOW)


def read_page(page: str, template: frozenset[int] = frozenset()) -> tuple[set[int], str]:
    """Hashes of the subtrees that may be a site's template, and the main text.

    Text is taken from articles, else from the main element, else from the whole page,
    whichever comes first with text in it, without unwanted elements and those whose hash is
    in ``template``.  A page that would have no text then is read without the template.
    Elements inside a line are no subtrees of their own, unless they are unwanted.
    """
    hashes: set[int] = set()
    # (depth, text) in page order; an end of a block has no text
    out: list[tuple[int, str | None]] = []
    stack: list[_Element] = []
    opened: Counter[str] = Counter()
    said = 0

    def say(text: str) -> None:
        nonlocal said
        if text:
            if stack:
                stack[-1].hash.update(text)
            out.append((stack[-1].depth if stack else 0, text))
            said += not text.isspace()

    def forget(element: _Element) -> None:
        nonlocal said
        del out[element.start :]
        said = element.said

    def close() -> None:
        element = stack.pop()
        opened[element.tag] -= 1
        if element.tag in BLOCKS:
            out.append((element.depth, _END))
        digest = element.hash.intdigest()
        removed = element.removed()
        if stack:
            stack[-1].hash.update(digest.to_bytes(8, "little"))
            if not removed:
                stack[-1].holds_article |= element.holds_article or element.tag in ("article", "main")
        if removed:
            forget(element)
        elif said > element.said and element.may_be_template():
            signed = digest - (1 << 64) if digest >> 63 else digest
            hashes.add(signed)
            if signed in template:
                forget(element)

    def close_to(place: int) -> None:
        while len(stack) > place:
            close()

    def make_room(tag: str) -> None:
        """Close what the start of a block ends, up to the block around it."""
        place = len(stack) - 1
        while place >= 0:
            if tag in ENDED_BY.get(stack[place].tag, ()):
                close_to(place)
            elif stack[place].tag in BLOCKS:
                break
            place -= 1

    at = 0
    while True:
        found = MARKUP.search(page, at)
        say(html.unescape(page[at : found.start() if found else len(page)]))
        if not found:
            break
        at = found.end()
        tag = (found.group(2) or "").lower()
        if found.group(1):
            if opened[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag in BLOCKS:
            make_room(tag)
            out.append((stack[-1].depth if stack else 0, _END))
        if tag == "br":
            say("\n")
        if not tag or tag in VOID:
            continue
        attributes = found.group(3)
        if tag not in BLOCKS and not _unwanted(tag, attributes, False):
            continue
        stack.append(_Element(tag, attributes, len(out), said, stack[-1] if stack else None))
        opened[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
    close_to(0)
    text = _text_of(out)
    return hashes, text or (read_page(page)[1] if template else "")


def _text_of(out: list[tuple[int, str | None]]) -> str:
    """Blocks of the innermost kind of root that has text, parted by an empty line."""
    depth = max((d for d, text in out if text and not text.isspace()), default=0)
    blocks, block = [], []
    for d, text in [*out, (0, _END)]:
        if text is _END:
            joined = " ".join("".join(block).split())
            if joined:
                blocks.append(joined)
            block = []
        elif d == depth:
            block.append(text)
    return "\n\n".join(blocks)


# --- over all pages ----------------------------------------------------------------------------

SUBTREES = "host string, page long, subtree long"


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page its different subtrees, and a row without one."""
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
            text = page.as_py()
            found = [None, *sorted(read_page(text)[0])]
            key = xxhash.xxh64_intdigest(text.encode(errors="replace")) >> 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([host] * len(found), pa.string()),
                    pa.array([key] * len(found), pa.int64()),
                    pa.array(found, pa.int64()),
                ],
                ["host", "page", "subtree"],
            )


def page_rows(pages: DataFrame) -> DataFrame:
    """Rows, hidden, beside host and html, nulls as empty."""
    host, _ = url_parts(F.col("url").cast("string"))
    return once(hidden(pages, url=F.col("url"), html=text_of("html")), host=host).drop("url")


def site_templates(
    pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: int = LEAST_SHARE
) -> DataFrame:
    """(host, template): hashes of the subtrees that many different pages of a host share.

    Pages of equal html count once.  Pages without a host are no site.
    """
    held = page_rows(pages).filter("host != '' AND html != ''").select("host", "html")
    counts = (
        held.mapInArrow(_subtrees, SUBTREES)
        .distinct()
        .groupBy("host", "subtree")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    folder = scratch_folder(pages.sparkSession, "extraction")
    counts = written(counts.filter(F.col("subtree").isNull() | (F.col("n") >= least_pages)), f"{folder}/counts")
    sizes = counts.filter("subtree IS NULL").select("host", F.col("n").alias("n_pages"))
    shared = counts.filter("subtree IS NOT NULL").join(sizes, "host")
    found = (
        shared.filter(F.col("n") * 100 >= F.col("n_pages") * least_share)
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("subtree")).alias("template"))
    )
    templates = written(found, f"{folder}/templates")
    remove_folder(pages.sparkSession, f"{folder}/counts")
    return templates


def _extracted(place: int):
    """Batches with the text of the html in column ``place`` in its stead."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str | None, frozenset[int]] = {}
            hosts, templates = batch.column("host").to_pylist(), batch.column("template")
            texts = []
            for row, page in enumerate(batch.column("html")):
                host = hosts[row]
                if host not in known:
                    known[host] = frozenset(templates[row].as_py() or ())
                texts.append(read_page(page.as_py(), known[host])[1])
            columns = [*batch.columns[:place], pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:place], "text"])

    return extract


def extracted_pages(pages: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """All columns of ``pages`` but html, hidden, beside text and n_chars.

    A null or empty html has an empty text; so has a page without any text outside unwanted
    elements.  Pages of a null url, or of one without a host, are read without a template.
    Rows are read singly, repeated rows alike; a page of any length is read whole, in time
    that grows with its length.  Unclosed, misnested and cut off markup is read up to the
    end.  An empty table gives an empty one.
    """
    if templates is None:
        templates = site_templates(pages)
    rows = page_rows(pages).join(templates, "host", "left")
    own = [c for c in rows.columns if c.startswith("__") and c != "__html"]
    arranged = rows.select(*[F.col(f"`{c}`") for c in own], "host", "template", "html")
    fields = ", ".join(f"`{c}` {arranged.schema[c].dataType.simpleString()}" for c in own)
    texts = arranged.mapInArrow(_extracted(len(own)), f"{fields}, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
