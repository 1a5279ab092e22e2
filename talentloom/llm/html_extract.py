"""Main text of web pages by site template removal.

1. Each page is read once as a tree; every element that could be page furniture (containers, and anything outside the article) gives the hash of its
   subtree: tag, class, text and the hashes of its children.
2. Spark counts per host on how many pages of *different* main text a subtree stands, by partial sums, so a host of any size is no hot
   group. Near copies count by min-hashes of their pairs of words, which alike texts share as often as they are alike.
3. A subtree is a template if it stands on a share of the host's unlike pages and if its pages are unlike (``BARS``). Templates go back to their pages,
   which are read again without them, and without elements whose tag, role or class says that they are no article text.

The text of a page is that of its article elements, else of its main elements, else of what is left of the page. Text blocks
(paragraphs, headings, list items) inside an article are never templates: a passage that many articles share is text.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from talentloom.llm.common import concluded, mixed, releasing, row_key, slices, stored

#: By kind of subtree: pages of different main text on which a template stands at least, and its share of the unlike pages of the host.
OUTSIDE, BLOCK, INSIDE = 0, 1, 2  # container outside an article or main, other element there, container inside
BARS = {OUTSIDE: (3, 0.25), BLOCK: (3, 0.5), INSIDE: (8, 0.5)}
#: Min-hashes of a page; so many of a template's different pages, as a share, are unlike.
LIKE, UNLIKE = 8, 0.5
#: Elements that are never article text.
FURNITURE = frozenset("nav header footer aside form noscript template iframe svg canvas object select button dialog menu head".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start and end a block of text.
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                    "h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul").split())
CONTAINERS = frozenset("div section aside nav header footer form ul ol dl table figure details fieldset center".split())
#: Words of a class, an id or a role that mark page furniture.
MARKS = frozenset(("ad ads advert adverts advertisement advertising sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead "
                   "footer cookie cookies consent notice notices banner alert popup modal newsletter subscribe comment comments replies related share sharing "
                   "social widget contentinfo complementary search form dialog").split())
#: A start tag ends these open elements, up to the nearest container.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIERS = frozenset("article main section div table td th ul ol dl body html nav aside header footer form blockquote figure".split())
_TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$)""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_ENDING: dict[str, re.Pattern] = {}


def _names(attributes: str) -> tuple[str, bool]:
    """Class, id and role of a tag, and whether they mark furniture."""
    if not attributes.strip():
        return "", False
    found, hidden = [], False
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden":
            hidden = True
        else:
            found.append("".join(values).lower())
    return " ".join(found), hidden or not MARKS.isdisjoint(_WORD.findall(" ".join(found)))


class Page:
    """One pass over a page: blocks of text left, and hashes of the subtrees that may be templates."""

    def __init__(self, page: str, host: str = "", templates: frozenset = frozenset()):
        self.hashes: set[tuple[int, int]] = set()
        self._host, self._templates = host, templates
        self._pieces: list[str | None] = []  # text, or None where a block ends
        self._regions: dict[str, list[tuple[int, int]]] = {"article": [], "main": []}
        self._stack: list[list] = []  # tag, class, marked, first piece, digests of children, holds an article, inside an article
        self._read(page)
        while self._stack:
            self._close()

    def _read(self, page: str) -> None:
        at = 0
        while at < len(page):
            tag = _TAG.search(page, at)
            self._text(page[at : tag.start() if tag else len(page)])
            if tag is None:
                break
            at = tag.end()
            name = (tag[2] or tag[5] or "").lower()
            if not name:
                continue
            if tag[1] or tag[4]:
                self._end(name)
                continue
            if name in RAW:
                ending = _ENDING.setdefault(name, re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I))
                stop = ending.search(page, at)
                at = stop.end() if stop else len(page)
                continue
            self._start(name, tag[3] or tag[6] or "")

    def _text(self, text: str) -> None:
        if text:
            self._pieces.append(text)
            if self._stack:
                self._stack[-1][4].append(text)

    def _start(self, name: str, attributes: str) -> None:
        if name in VOID:
            self._pieces.append(None if name == "hr" else " ")
            return
        if name in BLOCKS:
            self._finish({"p"} if name not in _ENDS else _ENDS[name] | {"p"})
            self._pieces.append(None)
        names, marked = _names(attributes)
        inside = bool(self._stack) and (self._stack[-1][6] or self._stack[-1][0] in ("article", "main"))
        self._stack.append([name, names, marked, len(self._pieces), [], False, inside])

    def _finish(self, tags: set[str]) -> None:
        """Close the innermost open element of these tags, if no container lies between."""
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] in tags:
                while len(self._stack) > k:
                    self._close()
                if self._stack and tags - {"p"}:
                    self._finish(tags)
                return
            if self._stack[k][0] in _BARRIERS:
                return

    def _end(self, name: str) -> None:
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] == name:
                while len(self._stack) > k:
                    self._close()
                return

    def _close(self) -> None:
        name, names, marked, first, children, holds, inside = self._stack.pop()
        digest = xxhash.xxh3_64_intdigest("\x00".join([name, names, *[" ".join(c.split()) if isinstance(c, str) else str(c) for c in children]])) - (1 << 63)
        if self._stack:
            self._stack[-1][4].append(digest)
        kind = INSIDE if inside else OUTSIDE if name in CONTAINERS else BLOCK
        if name not in ("html", "body", "article", "main") and not holds and children and (name in CONTAINERS or not inside):
            self.hashes.add((digest, kind))
        if not holds and name not in ("html", "body", "main") and (
                name in FURNITURE or marked or (self._templates and of_site(self._host, digest, kind) in self._templates)):
            del self._pieces[first:]
        elif name in self._regions and not inside:
            self._regions[name].append((first, len(self._pieces)))
            holds = True
        if holds and self._stack:
            self._stack[-1][5] = True
        if name in BLOCKS:
            self._pieces.append(None)

    def text(self) -> str:
        """Blocks in page order, one to a line, white space in them as one space."""
        regions = self._regions["article"] or self._regions["main"] or [(0, len(self._pieces))]
        blocks = []
        for first, last in regions:
            run: list[str] = []
            for piece in [*self._pieces[first:last], None]:
                if piece is not None:
                    run.append(piece)
                elif run:
                    block = " ".join(entities.unescape("".join(run)).split())
                    if block:
                        blocks.append(block)
                    run = []
        return "\n".join(blocks)


def of_site(host: str, digest: int, kind: int) -> int:
    """Hash of a subtree of a kind on a host."""
    return xxhash.xxh3_64_intdigest(f"{host} {digest} {kind}") - (1 << 63)


def likeness(text: str) -> list[int]:
    """Min-hashes of the pairs of neighbouring words."""
    words = text.split()
    pairs = np.array([xxhash.xxh3_64_intdigest(f"{a} {b}") for a, b in zip(words, words[1:] or [""])] or [0], np.uint64)
    return [int(mixed(pairs + np.uint64(k)).min()) - (1 << 63) for k in range(LIKE)]


def _subtrees(batches):
    for batch in slices(batches):
        out, kinds = ([], [], [], [], []), []
        for row, host, page in zip(*[batch.column(c).to_pylist() for c in ("row", "host", "html")]):
            read = Page(page)
            text = read.text()
            content, like, site = xxhash.xxh3_64_intdigest(text) - (1 << 63), likeness(text), xxhash.xxh3_64_intdigest(host) - (1 << 63)
            for digest, kind in [(None, None), *read.hashes]:  # a page without subtrees is a page of its site, too
                subtree = digest is not None  # the min-hashes are kept with the page alone
                for column, value in zip(out, (row, site, content, None if subtree else like, of_site(host, digest, kind) if subtree else None)):
                    column.append(value)
                kinds.append(kind)
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.list_(pa.int64()) if k == 3 else pa.int64()) for k, x in enumerate(out)], pa.array(kinds, pa.int32())],
                                         names=["row", "site", "content", "like", "digest", "kind"])


def _texts(batches):
    for batch in slices(batches):
        rows = zip(*[batch.column(c).to_pylist() for c in ("host", "html", "templates")])
        texts = [Page(page, host, frozenset(templates or ())).text() for host, page, templates in rows]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _unlike(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, n): unlike pages of a key, the mean over the min-hashes of how many different ones there are."""
    each = rows.select(key, F.posexplode("like").alias("k", "value")).groupBy(key, "k", "value").agg(F.lit(1).alias("one"))
    return each.groupBy(key).agg((F.count("*") / F.lit(LIKE)).alias("n"))


def _templates(named: DataFrame) -> DataFrame:
    """Rows (row, templates): the templates that stand on a page, from its key, host and html."""
    trees = stored(named.select("row", "host", "html").mapInArrow(releasing(_subtrees), "row long, site long, content long, like array<long>, digest long, kind int"))
    often = stored(trees.where("digest is not null").groupBy("digest", "content").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("pages"))
                   .where(F.col("pages") >= min(least for least, _ in BARS.values())))
    held = stored(trees.select("row", "site", "digest", "kind").join(often, "digest"))
    whole = trees.where("digest is null")
    unlike = _unlike(held.select("row", "digest").join(whole.select("row", "like").dropDuplicates(["row"]), "row"), "digest").withColumnRenamed("n", "unlike")
    sites = _unlike(whole, "site").withColumnRenamed("n", "of_site")
    found = held.select("digest", "site", "kind", "pages").distinct().join(unlike, "digest").join(sites, "site")
    enough = F.lit(False)
    for kind, (least, share) in BARS.items():
        enough = enough | ((F.col("kind") == kind) & (F.col("pages") >= least) & (F.col("unlike") >= share * F.col("of_site")))
    enough = enough & (F.col("unlike") >= UNLIKE * F.col("pages"))
    return held.select("row", "digest").join(found.where(enough).select("digest"), "digest").groupBy("row").agg(F.collect_set("digest").alias("templates"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars), one per page.

    Null or empty html gives an empty text. Pages without a readable host form a site of their own. Repeated rows come back as often as they came and
    count as one page; character references are decoded as browsers do. Other columns are not read.
    """
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    keyed = read.withColumn("row", row_key("page_id", "url", "html"))
    named = keyed.withColumn("host", host)
    # stored alone: its steps and shuffle files go before the pages are dealt out
    mine = concluded(pages.sparkSession, lambda: _templates(named))
    kind = ", ".join(f"{c} {read.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    found = keyed.join(mine, "row", "left").withColumn("host", host).select("page_id", "url", "host", "html", "templates").mapInArrow(releasing(_texts), f"{kind}, text string")
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
