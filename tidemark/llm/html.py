"""Main text of web pages by removing what a site repeats.

Every element subtree of a page is hashed by its tags and text.  Spark counts
the distinct pages of a host that hold the same subtree; subtrees on many pages
of their host are its template and are deleted with all that is in them.  Many
is a share of the host's distinct pages, and so many at least; pages of equal
text are one page, so that copies do not delete each other.  What remains
loses elements whose tag, role or class says that they are not content (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments, scripts,
styles); of a page that marks its content with ``article`` or ``main``, that
part is taken.  Marked content as a whole is never deleted as a template; blocks
inside it are, if they are on nearly all of the host's pages (a notice, a share box).

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by two newlines in page order.

Defined results: a null or empty page has the text ''; tags that are not closed
end with their parent; a page without a url counts to the host ''; repeated
rows count once for templates and come out once each.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from urllib.parse import urlsplit

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import scratch

#: A subtree is a template if it is on so many distinct pages of a host, and on such a share of them.
LEAST_PAGES, SHARE = 3, 0.25
#: The same for blocks inside marked content.
LEAST_INSIDE, SHARE_INSIDE = 10, 0.8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open element of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An end tag or implied end does not look for its element beyond these.
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"table", "td", "th", "article", "section", "div", "body", "main", "blockquote", "li"}}
JUNK_TAGS = frozenset("head script style noscript template nav header footer aside form button input select textarea svg iframe object canvas dialog menu title".split())
JUNK_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsored promo promotion banner sidebar side-bar nav navbar navigation menu breadcrumb breadcrumbs header masthead footer cookie cookies consent cookie-notice cookie-banner notice notices notification alert comment comments comment-list comments-area respond reader-comments disqus share sharing social related newsletter subscribe signup popup modal widget skip-link".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
CONTENT_TAGS = frozenset(("article", "main"))

_TAG = re.compile(r"<(?:!--(.*?)(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|[!?/][^>]*+>)", re.S)
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Element:
    __slots__ = ("tag", "junk", "content", "parts", "number", "parent")

    def __init__(self, tag: str, junk: bool, content: bool, number: int, parent):
        self.tag, self.junk, self.content, self.number, self.parent, self.parts = tag, junk, content, number, parent, []


def _junk(tag: str, attributes: str) -> bool:
    if tag in JUNK_TAGS:
        return True
    if tag in ("html", "body") or "=" not in attributes:
        return False
    for m in _NAME.finditer(attributes):
        names = (m[2] or m[3] or m[4] or "").lower().split()
        if any(n in (JUNK_ROLES if m[1].lower() == "role" else JUNK_NAMES) for n in names):
            return True
    return False


def parse(page: str):
    """(texts, closed): texts are (element, text or None for a block's end) in page order;
    closed elements are numbered in order of their start tags and have ``parts``."""
    texts, closed = [], []
    root = Element("", False, False, -1, None)
    at, here, count, open_ = 0, root, 0, {}

    def close(to):
        nonlocal here
        while here is not to:
            closed.append(here)
            open_[here.tag] -= 1
            if here.tag in BLOCK:
                texts.append((here, None))
            own = here
            here = here.parent
            digest = hashlib.blake2b(("<" + own.tag + ">" + "".join(own.parts)).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
            own.parts = digest if own.parts else ""
            if own.parts:
                here.parts.append("\x00" + digest)

    def find(tags, stop):
        e = here
        while e is not root and e.tag not in stop:
            if e.tag in tags:
                return e
            e = e.parent
        return e if e is not root and e.tag in tags else None

    def text(piece):
        if piece and not piece.isspace():
            piece = entities.unescape(piece) if "&" in piece else piece
            here.parts.append(" ".join(piece.split()))
            texts.append((here, piece))
        elif piece:
            texts.append((here, " "))

    while True:
        m = _TAG.search(page, at)
        text(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        if m[3] is None:
            continue
        tag, ending = m[3].lower(), bool(m[2])
        if ending:
            if open_.get(tag):
                e = find({tag}, SCOPE.get(tag, ()) if tag != "p" else {"table"})
                if e is not None:
                    close(e.parent)
            continue
        if tag in BLOCK and open_.get("p"):
            e = find({"p"}, SCOPE["p"])
            if e is not None:
                close(e.parent)
        if tag in ENDS and any(open_.get(t) for t in ENDS[tag]):
            e = find(ENDS[tag], SCOPE[tag])
            if e is not None:
                close(e.parent)
        if tag in BLOCK:
            texts.append((here, None))
        if tag in VOID:
            if tag == "br":
                texts.append((here, " "))
            continue
        e = Element(tag, _junk(tag, m[4]), tag in CONTENT_TAGS or "main" in m[4] and bool(re.search(r"role\s*=\s*[\"']?main\b", m[4])), count, here)
        count += 1
        open_[tag] = open_.get(tag, 0) + 1
        here = e
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if end:
                raw = page[at : end.start()]
                at = end.end()
                stop = page.find(">", at)
                at = len(page) if stop < 0 else stop + 1
            else:
                raw, at = page[at:], len(page)
            if raw.strip() and tag in ("title", "textarea"):
                here.parts.append(raw)
            close(e.parent)
    close(root)
    return texts, closed


def _inside_content(e) -> bool:
    while e is not None:
        if e.content:
            return True
        e = e.parent
    return False


def subtrees(closed: list[Element]) -> dict[tuple[bool, str], list[int]]:
    """(inside marked content, digest) of each block's subtree -> numbers of its elements."""
    out: dict[tuple[bool, str], list[int]] = {}
    for e in closed:
        if e.parts and e.tag in BLOCK and e.tag not in ("html", "body") and not e.content:
            out.setdefault((_inside_content(e), e.parts), []).append(e.number)
    return out


def main_text(page: str, template: frozenset[int] = frozenset()) -> str:
    """The text that is left without the numbered template elements and what is not content."""
    return _shown_text(*parse(page), template)


def _shown_text(texts: list, closed: list[Element], template: frozenset[int] = frozenset()) -> str:
    marked = any(e.content for e in closed)
    state: dict[int, bool] = {-1: not marked}

    def shown(e) -> bool:
        got = state.get(e.number)
        if got is None:
            above = e.parent
            inside = shown(above)
            gone = e.junk or (e.number in template) or dead.get(above.number, False)
            dead[e.number] = gone
            got = state[e.number] = not gone and (inside or e.content)
        return got

    dead: dict[int, bool] = {}
    blocks, own = [], []
    for e, piece in texts:
        if piece is None:
            if own:
                blocks.append(" ".join("".join(own).split()))
                own = []
        elif shown(e):
            own.append(piece)
    if own:
        blocks.append(" ".join("".join(own).split()))
    return "\n\n".join(b for b in blocks if b)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _key(host: str, digest: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{host}\n{digest}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _templates(found: DataFrame, least_pages: int) -> DataFrame:
    """The subtrees that are templates of their hosts; a row whose subtree is its host stands for the page."""
    counts = found.groupBy("host", "subtree", "inside", "content").agg(F.count("*").alias("rows"))
    counts = counts.groupBy("host", "subtree", "inside").agg(F.count("*").alias("pages"), F.sum("rows").alias("rows"))
    counts = scratch.saved(counts.where((F.col("subtree") == F.col("host")) | (F.col("rows") >= least_pages)))
    hosts = counts.where("subtree = host").select("host", F.col("pages").alias("all"))
    inside = (F.col("pages") >= LEAST_INSIDE) & (F.col("pages") >= SHARE_INSIDE * F.col("all"))
    outside = (F.col("pages") >= least_pages) & (F.col("pages") >= SHARE * F.col("all"))
    many = F.when(F.col("inside"), inside).otherwise(outside)
    return counts.where("subtree != host").join(hosts, "host").where(many).select("subtree")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages``.

    Only subtree keys meet in the counts; the pages themselves are shuffled
    once, compressed, to meet the numbers of their template elements.
    """
    url, page = F.col(url_col).cast("string"), F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.xxhash64(F.col(id_col), url, page).alias("row_key"), F.col(id_col).cast("long").alias("page_id"), url.alias("url"), page.alias("html"))

    def features(batches):
        for batch in batches:
            out: list[tuple] = []
            for k, u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                host = host_of(u)
                own, (texts, closed) = _key(host, ""), parse(h.as_py())
                content = _key("", _shown_text(texts, closed))
                out.append((k, own, content, own, False, []))
                for (inside, digest), numbers in subtrees(closed).items():
                    out.append((k, own, content, _key(host, ("in " if inside else "") + digest), inside, numbers))
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["row_key", "host", "content", "subtree", "inside", "numbers"])

    kinds = [pa.int64()] * 4 + [pa.bool_(), pa.list_(pa.int32())]
    found = scratch.saved(rows.select("row_key", "url", "html").mapInArrow(features, "row_key long, host long, content long, subtree long, inside boolean, numbers array<int>"))
    template = _templates(found, least_pages)
    deleted = found.join(template, "subtree").groupBy("row_key").agg(F.flatten(F.collect_list("numbers")).alias("numbers"))

    def squeezed(batches):
        for batch in batches:
            pack = zstandard.ZstdCompressor(level=3)
            data = [pack.compress(x.as_buffer()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], ["row_key", "page_id", "url", "page"])

    def finish(batches):
        for batch in batches:
            unpack = zstandard.ZstdDecompressor()
            text = [main_text(unpack.decompress(p.as_buffer()).decode("utf-8", "replace"), frozenset(n or ())) for p, n in zip(batch.column(2), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    packed = rows.mapInArrow(squeezed, "row_key long, page_id long, url string, page binary")
    return packed.join(deleted, "row_key", "left").select("page_id", "url", "page", "numbers").mapInArrow(finish, "page_id long, url string, text string, n_chars long")
