"""Operator 4: main text of web pages by consensus paths of their hosts.

Every container of a page is scored by the text that stands in it: its own blocks count whole, those one container
further in half, and so on, less what is link text. The page votes for the generalised path (tags with their classes,
numbers dropped) of its best containers. Votes are summed per host in Spark; each page is then extracted again at the
first of its host's paths that it has, or at its own best container where it has none of them. Article text around that
container (a heading, a lead, a sibling section) belongs to it: see Page.around.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, cut

#: Paths that a page votes for; a host keeps those with this share of its votes, so at most 1 / SHARE.
VOTES, SHARE = 3, 0.02
#: Hosts whose paths may be broadcast: 16 bytes for each path, 800 at most.
BROADCAST_HOSTS = 50_000

CONTAINERS = frozenset("html body div article section main nav header footer aside form ul ol table tbody thead figure blockquote dl fieldset details center menu dialog hgroup search".split())
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre hr figcaption summary caption legend address option".split())
NEVER = frozenset("nav footer aside form menu dialog fieldset search".split())
#: Words of a class, id or role that mark what isn't article text.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice popup promo promoted promotion related recommended respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget copyright pagination pager alert gdpr discussion replies reply skip".split())
#: Those that as an id may as well be the heading of a section of the article.
HEADINGS = frozenset("advertising consent copyright discussion gdpr navigation notice promotion related social subscription".split())
GOOD = frozenset("article body content entry main post story text".split())
#: Words that tell an article's own header from a page's.
OWN = frozenset("article entry post story".split())
#: Elements whose content is never text of the page.
RAW = frozenset("script style template noscript iframe svg textarea title select object button".split())
#: A tag ends before the next "<", which makes the search linear; the last form is a tag that may have one in its quotes.
TAG = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<[!?/][^<>]*>|<(?=/?[a-zA-Z])")
QUOTED = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>")
#: Characters that a tag with "<" in its quotes may have.
WIDE = 1 << 16
ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME = re.compile(r"[a-z]+")


def _attributes(raw: str) -> tuple[list[str], list[str], str, bool]:
    """Class names, words of class and role, the id, and whether the element is hidden."""
    classes, marks, ident, hidden = [], [], "", False
    for m in ATTRIBUTE.finditer(raw):
        key, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "").lower()
        if key == "class":
            classes = value.split()
        if key in ("class", "role"):
            marks += NAME.findall(value)
        elif key == "id":
            ident = value.strip()
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return classes, marks, ident, hidden


def _marked(name: str, marks: list[str], ident: str, inside: bool) -> bool:
    """Whether class, role or id say that this isn't article text.

    Ids of headings and of what stands in an article or main are often made from a heading: the former don't count, the
    latter only as a whole, and a section's not if it may be a heading.
    """
    if not MARKS.isdisjoint(marks):
        # the header of an article, often with its headline, is none of the page's
        if not (inside or not OWN.isdisjoint(marks)) or MARKS.intersection(marks) != {"header"}:
            return True
    if name in BREAKS or inside:
        return not re.fullmatch("h[1-6]", name) and ident in MARKS and not (name == "section" and ident in HEADINGS)
    return not MARKS.isdisjoint(NAME.findall(ident))


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of the tags in order; the name is empty for what is skipped with its content.

    Time is linear in the page: a tag that isn't closed before the next "<" is looked at again, with "<" allowed in
    quotes, only while such tags have taken no more characters than the page has.
    """
    at, spare = 0, len(html)
    while m := TAG.search(html, at):
        start, end, name = m.start(), m.end(), m[2]
        if name is None:
            if m[0] == "<!--":
                end = html.find("-->", end) + 3
                end = end if end > 2 else len(html)
            elif m[0] == "<":
                wide = QUOTED.match(html, start, start + WIDE) if spare > 0 else None
                spare -= wide.end() - start if wide else WIDE
                if not wide:
                    at = end
                    continue
                m, end, name = wide, wide.end(), wide[2]
        if name is None:
            yield start, end, "", False, ""
        else:
            name = name.lower()
            if name in RAW:
                if not m[1] and not (name == "svg" and m[3].endswith("/")):
                    close = re.compile(f"</{name}\\s*>", re.I).search(html, end)
                    end = close.end() if close else len(html)
                yield start, end, "", False, ""
            else:
                yield start, end, name, bool(m[1]), m[3]
        at = end


class Page:
    """Containers and text blocks of one page, read leniently: unclosed and stray tags do no harm.

    Time and memory are linear in the page's length, however deep its containers stand in each other: a path is the
    digest of the path around it and one step, scores are summed from the innermost containers outwards.
    """

    def __init__(self, html: str):
        self.tag, self.path, self.parent, self.bonus, self.out, self.within = [""], [b""], [-1], [1.0], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters of link text
        stack: list[tuple[str, int]] = [("", 0)]
        opened: dict[str, int] = {}
        text: list[str] = []
        links, in_link, skip = 0, False, False

        def close_block():
            nonlocal links
            if text:
                joined = " ".join("".join(text).split())
                if joined and not self.out[stack[-1][1]] and not skip:
                    self.blocks.append((stack[-1][1], joined, min(links, len(joined))))
                text.clear()
            links = 0

        at = 0
        for start, end, name, closing, attributes in tags(html):
            if start > at:
                piece = unescape(html[at:start])
                text.append(piece)
                links += len(piece.strip()) * in_link
            at = end
            if not name:
                continue
            if name == "head":
                close_block()
                skip = not closing
            elif name == "a":
                in_link = not closing
            elif name == "br":
                text.append(" ")
            elif name in CONTAINERS:
                if name == "body":
                    text.clear()
                    skip = False
                close_block()
                skip = False
                if not closing:
                    classes, marks, ident, hidden = _attributes(attributes) if attributes else ((), (), "", False)
                    up = stack[-1][1]
                    inside = self.within[up]
                    plain = name in ("html", "body", "article", "main")
                    out = self.out[up] or hidden or name in NEVER or (name == "header" and not inside) or (not plain and _marked(name, marks, ident, inside))
                    step = " ".join([name, *sorted({re.sub(r"[0-9]+", "#", c) for c in classes})])
                    self.path.append(hashlib.blake2b(self.path[up] + step.encode("utf-8", "replace"), digest_size=16).digest())
                    self.tag.append(name)
                    self.parent.append(up)
                    self.out.append(out)
                    self.within.append(inside or name in ("article", "main"))
                    self.bonus.append(1.5 if name in ("article", "main") else 1.25 if not GOOD.isdisjoint([*marks, *NAME.findall(ident)]) else 1.0)
                    if not (name in ("html", "body") and opened.get(name)):
                        stack.append((name, len(self.path) - 1))
                        opened[name] = opened.get(name, 0) + 1
                elif opened.get(name):
                    while True:
                        last = stack.pop()[0]
                        opened[last] -= 1
                        if last == name:
                            break
            elif name in BREAKS:
                close_block()
                skip = False
                if not closing and attributes:
                    _, marks, ident, hidden = _attributes(attributes)
                    skip = hidden or _marked(name, marks, ident, True)
                in_link = False if name != "li" else in_link
        if at < len(html):
            text.append(unescape(html[at:]))
        close_block()

    def scores(self) -> list[float]:
        """The text of each container less its links, what stands one container further in at half, and so on."""
        out = [0.0] * len(self.path)
        for c, t, links in self.blocks:
            out[c] += max(0.0, len(t) - 1.5 * links)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i] / 2
        return [s * b for s, b in zip(out, self.bonus, strict=True)]

    def votes(self) -> list[tuple[bytes, float]]:
        """Paths of the best containers, with their shares."""
        best: dict[bytes, float] = {}
        for p, s in zip(self.path, self.scores(), strict=True):
            if s > 0:
                best[p] = best.get(p, 0.0) + s
        top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:VOTES]
        whole = sum(s for _, s in top)
        return [(p, s / whole) for p, s in top]

    def _under(self, chosen: set[int]) -> list[bool]:
        """Whether each container is one of those or stands in one."""
        inside = [False] * len(self.path)
        for i, up in enumerate(self.parent):
            inside[i] = i in chosen or (up >= 0 and inside[up])
        return inside

    def around(self) -> list[int]:
        """For each container the one whose text belongs to its article.

        That is the outermost article or main around it, else the outermost one marked as article text, else the div or
        section that it stands in; a list, table or quotation without those belongs to what it stands in.
        """
        article, marked, near = [-1] * len(self.path), [-1] * len(self.path), [0] * len(self.path)
        for i, up in enumerate(self.parent):
            tag = self.tag[i]
            article[i] = article[up] if up >= 0 and article[up] >= 0 else i if tag in ("article", "main") else -1
            marked[i] = marked[up] if up >= 0 and marked[up] >= 0 else i if self.bonus[i] > 1 and tag not in ("html", "body") else -1
            near[i] = i if tag in ("div", "section", "body", "html", "") else near[up]
        out = []
        for i, up in enumerate(self.parent):
            own = self.tag[i] in ("div", "section")
            wide = marked[up] if up >= 0 else -1
            out.append(article[i] if article[i] >= 0 else wide if wide >= 0 else near[i] if not own else up if up >= 0 and self.tag[up] in ("div", "section") else i)
        return out

    def text(self, paths: list[bytes]) -> str:
        """Blocks under the first of the paths that the page has text in, else under its best container, and around it.

        Around it, containers whose own text is mostly links are left out.
        """
        places: dict[bytes, list[int]] = {}
        for i, p in enumerate(self.path):
            places.setdefault(p, []).append(i)
        for p in [*paths, *(p for p, _ in self.votes())]:
            chosen = set(places.get(p, ()))
            if not chosen:
                continue
            inside = self._under(chosen)
            if any(inside[c] for c, _, _ in self.blocks):
                around = self.around()
                wide = self._under({around[c] for c in chosen})
                gain = [0.0] * len(self.path)
                for c, t, links in self.blocks:
                    gain[c] += len(t) - 1.5 * links
                return "\n".join(t for c, t, _ in self.blocks if inside[c] or (wide[c] and gain[c] > 0))
        return ""


def host(url: str = "url"):
    """Host of a url in lower case, without user, port and leading www; a null or odd url has the empty host."""
    h = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(h, r"^www\.", "")


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, paths): the paths with SHARE of the votes of a host's pages, most votes first."""

    def vote(batches):
        for b in batches:
            total: dict[tuple[str, bytes], float] = {}
            for h, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for p, s in Page(page.as_py() or "").votes():
                    total[h, p] = total.get((h, p), 0.0) + s
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in total], pa.string()), pa.array([p for _, p in total], pa.binary()), pa.array(list(total.values()), pa.float64())], ["host", "path", "votes"])

    votes = pages.select(host(url).alias("host"), F.col(html).alias("html")).mapInArrow(vote, "host string, path binary, votes double")
    sums = votes.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    # a host's many rare paths go before its kept ones meet
    whole = sums.groupBy("host").agg(F.sum("votes").alias("all"))
    best = sums.join(whole, "host").where(F.col("votes") >= SHARE * F.col("all"))
    return best.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("place"), "path"))).alias("p")).select("host", F.col("p.path").alias("paths"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty html give the empty text. Blocks are joined by one line end, white space within is one space,
    character references are decoded. Pages of null url share the empty host. Ties go to the path whose digest is
    smaller. A page of any length, with any tags unclosed, takes time and memory linear in its length. Repeated rows give repeated results; an empty table none. Other columns are not looked at.
    """
    paths, _ = cut(host_paths(pages, url, html), "host_paths")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host(url).alias("host"))
    rows = rows.join(F.broadcast(paths) if bounded(paths, BROADCAST_HOSTS) else paths, "host", "left").select("page_id", "url", "html", "paths")

    def run(batches):
        for b in batches:
            got = [Page(h.as_py() or "").text(p or []) for h, p in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(run, schema)
