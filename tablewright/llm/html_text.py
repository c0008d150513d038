"""Operator 7, main text of HTML pages by consensus host paths.

Each page scores its containers by the running text directly in them; its best ones vote, as
generalised paths of tags and classes, for their host. The path with the most votes on a host
then says which container is taken from each of its pages; where a page has several at one path, the smallest container
around all of them is meant, so that no part is lost. A page without such a container, or a page whose url has no
host, uses its own best one.

A class or id marks what is not the article if it names nothing else: `related-posts` does, `related-work` does not. Marks count on containers
and lists, never on headings, paragraphs and what is inside a line. Some words (a discussion, what is related) mark a part only if it is short or full of links;
such a part has no vote. If marks leave no running text, the page is read again, and only the words that never mark an article count.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import written

#: Up to so many hosts the winners are broadcast; beyond, they are joined by a shuffle.
BROADCAST_HOSTS = 20_000
#: Longer paths are replaced by a digest, so that deep pages stay small.
LONG_PATH = 2048
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody tfoot thead tr ul".split()
)
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_CONTAINERS = set("article body center div main section table tbody td".split())
_SKIPPED_TAGS = set(
    "aside button canvas datalist dialog footer form head iframe input label menu nav noscript object script select style svg "
    "template textarea title noembed noframes".split()
)
_SKIPPED_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id values that mark what is not the article.
_SKIPPED_WORDS = set(
    "ad ads adbox adslot advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus "
    "discussion footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices outbrain pager pagination "
    "paywall popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription taboola tags teaser toolbar topbar widget widgets".split()
)
#: Of these, the words that mark what is never the article, even where no other text is left.
_ALWAYS_SKIPPED = set(
    "ad ads adbox adslot advert advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus gdpr menu modal nav "
    "navbar navigation newsletter outbrain pager pagination popup replies reply respond share sharing sponsor sponsored taboola".split()
)
#: Words that mark a part only where it has little running text or many links.
_DOUBTFUL = set("discussion recommended related search share skip tags teaser".split())
#: Words that say nothing of their own: with a mark beside them a name is still that mark.
_PLAIN_WORDS = set(
    "area areas article articles aside b bar block blocks body bottom box boxes btn button buttons c cell center col column container content desktop div element entry feed "
    "fixed foot form full g global group head heading holder icon icons id img inner is item items js l large layout left lg line link links list listing logo m main md media "
    "message meta mobile module news o outer overlay page panel post posts primary right row s secondary section sections short site slot small sm sticky stories story strip text "
    "thread title tool tools top u ui unit view wide widget wp wrap wrapper x xl xs zone".split()
)
#: Elements that class words can mark.
_MARKABLE = set("article center details div dl fieldset figure li main menu ol section table ul".split())
#: Words of article and main elements that mark what is not the article.
_SKIPPED_ARTICLES = set("comment comments reply teaser related ad advert sponsored promo".split())
#: A block is running text from so many characters; a page is read again, and a doubtful part kept, for so many characters of it.
RUNNING, RESCUED = 25, 200
#: A doubtful part is dropped if more than this share of its characters is in links.
LINKED = 0.25
#: An open element that an opening tag ends, and the elements beyond which it is not sought.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_P_SCOPE = {"button", "td", "th", "table", "caption", "html"}
_DIGITS = re.compile(r"\d+")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _marks(value: str) -> set[str]:
    """The marks of a class or id value: the words of those of its names that have no other words beside them."""
    out: set[str] = set()
    for name in value.split():
        words = {w for w in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w and not w.isdigit()}
        hit = words & _SKIPPED_WORDS
        if hit and not words - hit - _PLAIN_WORDS:
            out |= hit
    return out


def _is_skipped(tag: str, at: dict[str, str], marks: set[str]) -> tuple[bool, bool]:
    """Whether an element is not the article, and whether it is doubtful."""
    if tag in _SKIPPED_TAGS:
        return True, False
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or "display:none" in at.get("style", "").replace(" ", "").lower():
        return True, False
    if tag in ("html", "body"):
        return False, False
    if at.get("role", "").lower() in _SKIPPED_ROLES:
        return True, False
    if tag not in _MARKABLE or not ("class" in at or "id" in at):
        return False, False
    found = (_marks(at.get("class", "")) | _marks(at.get("id", ""))) & marks
    if tag in ("article", "main"):
        return bool(found & _SKIPPED_ARTICLES), False
    return bool(found - _DOUBTFUL), bool(found)


def _label(tag: str, at: dict[str, str]) -> str:
    classes = sorted({_DIGITS.sub("#", c.lower()) for c in at.get("class", "").split()})
    return ".".join([tag, *classes])


class Page:
    """Blocks of text of one page, with the containers they are in.

    blocks: (text, characters in links, container, in a doubtful part). containers: (parent, path, tag);
    0 is the page itself.
    """

    def __init__(self, source: str | None) -> None:
        self.blocks, self.containers = self._read(source or "", _SKIPPED_WORDS)
        if not self.running():
            # Nothing beside the doubtful parts: they vote after all.
            self.blocks = [(text, linked, c, False) for text, linked, c, _ in self.blocks]
        if not self.running():
            first = self.blocks, self.containers
            self.blocks, self.containers = self._read(source or "", _ALWAYS_SKIPPED)
            self.blocks = [(text, linked, c, False) for text, linked, c, _ in self.blocks]
            if self.running() < RESCUED:
                self.blocks, self.containers = first

    def running(self) -> int:
        """Characters of running text outside links and doubtful parts."""
        return sum(len(text) - linked for text, linked, _, doubtful in self.blocks if len(text) >= RUNNING and not doubtful)

    @staticmethod
    def _read(source: str, marks: set[str]) -> tuple[list[tuple[str, int, int, bool]], list[tuple[int, str, str]]]:
        blocks: list[tuple[str, int, int, int]] = []
        containers: list[tuple[int, str, str]] = [(-1, "", "")]
        #: Doubtful parts: the one around it, characters of running text outside links, characters in links, characters.
        parts: list[list[int]] = [[-1, 0, 0, 0]]
        # An open element: tag, skipped, container, path, in a link, in a header, in a heading, doubtful part.
        stack = [("", False, 0, "", False, False, False, 0)]
        opened: Counter = Counter()
        text: list[str] = []
        linked = at = 0

        def flush() -> None:
            nonlocal linked
            if text:
                joined = " ".join("".join(text).split())
                if joined:
                    top = stack[-1]
                    if not top[5] or top[6]:
                        blocks.append((joined, min(linked, len(joined)), top[2], top[7]))
                text.clear()
            linked = 0

        def add(raw: str) -> None:
            nonlocal linked
            if raw and not stack[-1][1]:
                part = html.unescape(raw) if "&" in raw else raw
                text.append(part)
                if stack[-1][4]:
                    linked += len(part.strip())

        def pop_to(k: int) -> None:
            if any(e[0] in _BLOCKS for e in stack[k:]):
                flush()
            elif any(e[0] in ("td", "th") for e in stack[k:]):
                text.append(" ")
            opened.subtract(e[0] for e in stack[k:])
            del stack[k:]

        while True:
            m = _TOKEN.search(source, at)
            if m is None:
                add(source[at:])
                break
            add(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    add(html.escape(m[0][9 : -3 if m[0].endswith("]]>") else None]))
                continue
            tag = m[2].lower()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                    if stack[k][0] == tag:
                        pop_to(k)
                        break
                continue
            if tag in _BLOCKS and tag not in ("html", "body") and opened["p"] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        pop_to(k)
                        break
                    if stack[k][0] in _P_SCOPE:
                        break
            if tag in _ENDS and any(opened[x] > 0 for x in _ENDS[tag][0]):
                ended, scope = _ENDS[tag]
                hit = 0
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in scope:
                        break
                    if stack[k][0] in ended:
                        hit = k
                if hit:
                    pop_to(hit)
            if tag == "br":
                text.append(" ")
                continue
            if tag in _BLOCKS:
                flush()
            elif tag in ("td", "th"):
                text.append(" ")
            if tag in _VOID:
                continue
            over = stack[-1]
            found = _attributes(m[3]) if m[3].strip() else {}
            skipped, doubtful = (True, False) if over[1] else _is_skipped(tag, found, marks)
            part = over[7]
            if doubtful and not skipped:
                parts.append([part, 0, 0, 0])
                part = len(parts) - 1
            if tag in _RAW:
                end = _RAW[tag].search(source, at)
                at = end.end() if end else len(source)
                continue
            path = f"{over[3]}>{_label(tag, found)}" if tag in _BLOCKS or tag in _CONTAINERS else over[3]
            if len(path) > LONG_PATH:
                path = ">" + hashlib.md5(path.encode("utf-8", "replace")).hexdigest()
            container = over[2]
            if tag in _CONTAINERS and not skipped:
                containers.append((over[2], path, tag))
                container = len(containers) - 1
            in_header = over[5] or tag == "header"
            if skipped and not over[1]:
                # What stands before a skipped element is told apart from what follows it by a space.
                text.append(" ")
            opened[tag] += 1
            stack.append((tag, skipped, container, path, over[4] or tag == "a", in_header, over[6] or tag in _HEADINGS, part))
        flush()
        return Page._settled(blocks, parts), containers

    @staticmethod
    def _settled(blocks: list[tuple[str, int, int, int]], parts: list[list[int]]) -> list[tuple[str, int, int, bool]]:
        """Blocks without those of doubtful parts that have little running text or many links."""
        for text, linked, _, part in blocks:
            parts[part][1] += len(text) - linked if len(text) >= RUNNING else 0
            parts[part][2] += linked
            parts[part][3] += len(text)
        for part in reversed(parts[1:]):
            for k in (1, 2, 3):
                parts[part[0]][k] += part[k]
        kept = [True]
        for around, running, linked, size in parts[1:]:
            kept.append(kept[around] and running >= RESCUED and linked <= LINKED * size)
        return [(text, linked, c, part > 0) for text, linked, c, part in blocks if kept[part]]

    def scores(self) -> list[float]:
        """Characters outside links of each container's own blocks, and half of those one container below."""
        out = [0.0] * len(self.containers)
        for text, linked, c, doubtful in self.blocks:
            value = float(len(text) - linked) if len(text) >= RUNNING and not doubtful else 0.0
            out[c] += value
            if self.containers[c][0] >= 0:
                out[self.containers[c][0]] += value / 2
        return out

    def promoted(self, c: int) -> int:
        """The article or main element around a container, if there is one; else the container."""
        for tag in ("article", "main"):
            k = c
            while k > 0:
                if self.containers[k][2] == tag:
                    return k
                k = self.containers[k][0]
        return c

    def by_path(self) -> dict[str, list[int]]:
        """The containers that have text in them, by path."""
        filled = [False] * len(self.containers)
        for _, _, c, _ in self.blocks:
            filled[c] = True
        for k in range(len(self.containers) - 1, 0, -1):
            if filled[k]:
                filled[self.containers[k][0]] = True
        out: dict[str, list[int]] = {}
        for k, (_, path, _) in enumerate(self.containers):
            if k and filled[k]:
                out.setdefault(path, []).append(k)
        return out

    def around(self, path: str, by_path: dict[str, list[int]]) -> int:
        """The container at path; of several, the smallest one around all of them, whose path no other has."""
        while len(by_path[path]) > 1:
            top, *others = by_path[path]
            for k in others:
                # A container comes after those around it.
                while top != k:
                    if top > k:
                        top = self.containers[top][0]
                    else:
                        k = self.containers[k][0]
            if top == 0:
                return 0
            path = self.containers[top][1]
        return by_path[path][0]

    def best(self, n: int = 3) -> list[tuple[int, int]]:
        """Up to n containers and their shares of the page's score in thousandths, best first."""
        scores = self.scores()
        total = sum(scores)
        if total <= 0:
            return []
        order = sorted(range(len(scores)), key=lambda k: (-scores[k], k))[:n]
        by_path = self.by_path()
        out: dict[int, int] = {}
        for k in order:
            if scores[k] > 0:
                p = self.promoted(k)
                p = self.around(self.containers[p][1], by_path) if p else p
                out[p] = out.get(p, 0) + round(1000 * scores[k] / total)
        return sorted(out.items(), key=lambda x: (-x[1], x[0]))

    def within(self, chosen: int) -> list[str]:
        """Blocks of a container and of those inside it, in page order."""
        inside = [False] * len(self.containers)
        for k, (parent, _, _) in enumerate(self.containers):
            inside[k] = k == chosen or (parent >= 0 and inside[parent])
        return [text for text, _, c, _ in self.blocks if inside[c]]

    def text(self, path: str | None) -> str:
        """The text of the container at path, or around all of those at path; else of the page's best container, else of the page."""
        by_path = self.by_path()
        if path in by_path:
            blocks = self.within(self.around(path, by_path))
        else:
            own = self.best(1)
            blocks = self.within(own[0][0] if own else 0)
        return "\n\n".join(blocks)


def host_of(url: str) -> Column:
    """Lower-case host of a url column; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        votes: Counter = Counter()
        for host, source in zip(part["host"], part["html"], strict=True):
            page = Page(source)
            for k, share in page.best():
                if k:
                    votes[host, page.containers[k][1]] += share
        rows = [(h, p, n) for (h, p), n in votes.items()]
        yield pd.DataFrame(rows, columns=["host", "path", "votes"])


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        texts = [Page(s).text(p) for s, p in zip(part["html"], part["path"], strict=True)]
        yield pd.DataFrame(
            {"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": np.array([len(t) for t in texts], dtype=np.int64)}
        )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages.

    pages has page_id, url and html; other columns are ignored. A null html is empty and gives an empty text.
    A null url, or one without a host, takes no part in a vote. Equal votes go to the path that is last in
    order. Repeated rows vote and are extracted each. An empty table gives an empty result.
    """
    rows = pages.select("page_id", "url", "html").withColumn("host", host_of("url"))
    votes = rows.filter("host != ''").select("host", "html").mapInPandas(_votes, "host string, path string, votes long")
    by_path = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    winners = by_path.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))
    winners = written(winners, "host-paths")
    side = F.broadcast(winners) if winners.count() <= BROADCAST_HOSTS else winners
    joined = rows.join(side, "host", "left").select("page_id", "url", "html", "path")
    kind = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return joined.mapInPandas(_texts, kind)
