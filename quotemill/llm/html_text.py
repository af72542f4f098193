"""Main text of web pages by consensus paths per host.

1. Every page's containers are scored: letters of their blocks outside of links, part of what the
   containers inside them score, more for ``article`` and ``main``. Menus, headers, footers, sidebars,
   notices, adverts, forms, scripts, styles and reader comments, known by tag or by a word of class, id or
   role, never count. The best container's generalised path (tags and classes, digits replaced) is the
   page's vote.
2. Spark counts votes per host and path (pre-aggregated, so a host with a third of all pages is no hot
   task); each host's winner is broadcast while there are at most ``MOST_BROADCAST`` hosts, joined by a
   shuffle beyond.
3. Every page is extracted anew from all containers on its host's path; a page without text there falls
   back to its own best container.

White space inside a block becomes one space, character references are decoded, blocks are joined by one
newline in page order.

Cases: NULL or empty html gives an empty text; NULL urls vote as one host without a name; broken markup
(unclosed or stray tags, unfinished comments) is read as far as it goes; ties go to the path that is last
in order; repeated rows get the same answer; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import stored

MOST_BROADCAST = 200_000

# A tag ends at a ">" outside of quotations of any length, or, with a quotation that never ends, at the next ">" before a
# "<". A read that began earlier goes on only while each later "<" lies inside its quotations; quotation marks never
# bring two reads into the same state, so at most three pass any character: broken markup stays linear.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)
                        ((?:[^<>"']|"[^"]*+"|'[^']*+')*+|[^<>]*)>""", re.S | re.X)
_ATTRIBUTE = re.compile(r"([A-Za-z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*.?true", re.I)
_SPACE = re.compile(r"\s+")

#: What HTML calls so. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object title xmp".split())
BLOCKS = frozenset("address blockquote center dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr li ol p "
                   "pre summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("html body div article section main td".split())
DROPPED = frozenset("nav header footer aside form button select menu dialog head label option".split())
#: Words of class, id or role that mark what is not the article.
NOT_ARTICLE = frozenset(
    "nav navbar navigation menu menubar sidebar aside footer header masthead banner cookie cookies consent gdpr notice alert "
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus respond "
    "reply replies share sharing social related recommended breadcrumb breadcrumbs newsletter subscribe subscription popup "
    "modal overlay login signup search toolbar pagination pager widget widgets complementary contentinfo".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"},
           "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}


def _segment(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted(re.sub(r"\d+", "#", c.lower()) for c in attributes.get("class", "").split())
    return ".".join([tag, *classes])


def _step(path: str, segment: str) -> str:
    longer = f"{path}/{segment}"
    return longer if len(longer) <= 400 else f"{xxhash.xxh64_hexdigest(path)}/{segment[-300:]}"


class Page:
    """Blocks of a page with their containers: ``blocks`` holds (container, text, characters in links)."""

    def __init__(self, source: str):
        self.paths, self.parents, self.tags = [""], [-1], [""]
        self.blocks: list[tuple[int, str, int]] = []
        self._text: list[str] = []
        self._linked = 0
        # open elements: (tag, is it dropped, container that holds its content)
        stack: list[tuple[str, bool, int]] = [("", False, 0)]
        links, at, end, lowered, unclosed = 0, 0, len(source), None, set()
        self._open = Counter()
        while at < end:
            m = _TOKEN.search(source, at)
            if not m:
                self._say(source[at:], stack, links)
                break
            if m.start() > at:
                self._say(source[at:m.start()], stack, links)
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if self._open[tag]:
                    if tag in BLOCKS or tag in CONTAINERS or tag in DROPPED:
                        self._break(stack)
                    while True:
                        left = self._pop(stack)
                        links -= left == "a"
                        if left == tag:
                            break
                elif tag == "p":
                    self._break(stack)
                continue
            if tag in RAW:
                if tag in unclosed:
                    continue
                lowered = source.lower() if lowered is None else lowered
                if len(lowered) == len(source):
                    close = lowered.find(f"</{tag}", at)
                else:  # a character changed its length when lowered
                    found = re.compile(f"</{tag}", re.I).search(source, at)
                    close = found.start() if found else -1
                if close < 0:
                    unclosed.add(tag)
                if not m[3].endswith("/"):
                    at = end if close < 0 and tag in ("script", "style") else at if close < 0 else close
                continue
            if tag == "br":
                self._say(" ", stack, links)
                continue
            block = tag in BLOCKS or tag in CONTAINERS or tag in DROPPED
            if block:
                self._break(stack)
                shut = _CLOSES.get(tag, {"p"})
                while stack[-1][0] in shut:
                    self._pop(stack)
            if tag in VOID:
                continue
            attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(m[3])} if m[3] else {}
            _, dropped, holder = stack[-1]
            dropped = dropped or tag in DROPPED or bool(m[3] and _HIDDEN.search(m[3]))
            if not dropped and attributes and tag not in ("html", "body", "article", "main"):
                words = re.split(r"[^a-z]+", " ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower())
                dropped = not NOT_ARTICLE.isdisjoint(words)
            if tag in CONTAINERS:
                self.paths.append(_step(self.paths[holder], _segment(tag, attributes)))
                self.parents.append(holder)
                self.tags.append(tag)
                holder = len(self.paths) - 1
            if not m[3].endswith("/") or block:
                links += tag == "a"
                self._open[tag] += 1
                stack.append((tag, dropped, holder))
        self._break(stack)

    def _pop(self, stack: list) -> str:
        tag = stack.pop()[0]
        self._open[tag] -= 1
        return tag

    def _say(self, text: str, stack: list, links: int) -> None:
        if not stack[-1][1]:
            self._text.append(text)
            if links > 0:
                self._linked += len(text)

    def _break(self, stack: list) -> None:
        if self._text:
            said = "".join(self._text)
            said = _SPACE.sub(" ", entities.unescape(said) if "&" in said else said).strip()
            if said:
                self.blocks.append((stack[-1][2], said, self._linked))
            self._text, self._linked = [], 0

    def best_path(self) -> str | None:
        """Path of the container with the highest score, None without any text."""
        if not self.blocks:
            return None
        own = [0.0] * len(self.paths)
        for holder, text, linked in self.blocks:
            own[holder] += max(0, len(text) - 2 * linked)
        for i in range(len(own) - 1, 0, -1):  # children come after their parents
            own[i] *= {"article": 1.5, "main": 1.2}.get(self.tags[i], 1.0)
            own[self.parents[i]] += 0.7 * own[i] if self.tags[self.parents[i]] not in ("article", "main") else own[i]
        return self.paths[max(range(len(own)), key=lambda i: (own[i], i))]

    def text_at(self, path: str | None) -> str:
        inside = [False] * len(self.paths)
        for i in range(len(self.paths)):
            inside[i] = self.paths[i] == path or (i > 0 and inside[self.parents[i]])
        return "\n".join(text for holder, text, _ in self.blocks if inside[holder])


def main_text(source: str | None, path: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    return (page.text_at(path) if path is not None else "") or page.text_at(page.best_path())


def _host(url: str):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """_host, _path: the container path most of a host's pages vote for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [Page(h.as_py()).best_path() if h.as_py() else None for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["_host", "_path"])

    votes = pages.select(_host(url).alias("_host"), F.col(html).alias("_html")).mapInArrow(run, "_host string, _path string")
    counted = votes.where("_path IS NOT NULL").groupBy("_host", "_path").count()
    return counted.groupBy("_host").agg(F.max_by("_path", F.struct("count", "_path")).alias("_path"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    winners = stored(host_paths(pages, url, html), "host-paths")
    if winners.count() <= MOST_BROADCAST:
        winners = F.broadcast(winners)
    slim = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("_html"),
                        _host(url).alias("_at_host"))
    routed = slim.join(winners, F.col("_at_host") == F.col("_host"), "left").select("page_id", "url", "_html", "_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), p.as_py()) for h, p in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return routed.mapInArrow(run, "page_id long, url string, text string, n_chars long")
