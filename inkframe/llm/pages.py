"""Main text of HTML pages by consensus host paths.

Pass 1 parses each page, scores its containers and votes, for its host, on the path of the best one:
the tags and classes from the root, digits generalised, by a 64-bit hash. Votes are summed in Spark (in each task first,
so a host with a third of all pages is no hot key). Pass 2 parses again and takes all containers with
the host's winning path, or those with the path of the page's own best where the page has none or where
they hold far less text (`FAR`). There the host's path still wins over a path that usually has text
beside another page's best (`beside`, a side box).

Elements apart from the article (navigation, comments, hidden ones and the like) are known by tag, role
and words of class and id. Their text is kept with a mark and judged at the page's end: an element that
holds the page's article or main, one that other class names call content, and one around nearly all of
a page that has no content elsewhere is not apart; nor is one at the host's winning path.

Null, empty and tagless pages: null and empty give an empty text, tagless ones their whole text.
Pages without host go by their own best. Unclosed elements end with their parent or the page.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, slices, small_batches, stash

#: A `>` inside quotes is of the tag only where they begin a value. Nothing is tried twice.
_TAG = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>?))")
_PLAIN = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*+)([^>]*+)(>?))")
_ATTR = re.compile(r"([A-Za-z-]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_COMMENT_END = re.compile(r"--\s*+>")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title template iframe svg select object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
APART = frozenset("nav header footer aside form button menu dialog fieldset".split())
HOLDERS = frozenset("article main section div body td html".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu form".split())
GOOD = frozenset("article content post entry story main body text".split())
AWAY = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar comment comments discussion disqus reply replies respond nav navbar navigation menu breadcrumb "
    "breadcrumbs footer masthead cookie cookies consent gdpr notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "toolbar pagination pager copyright legal skip".split()
)
WEAK = frozenset("header side meta more widget notice alert banner hidden".split())
FAR = 0.25
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@lru_cache(1 << 16)
def _step(path: int, name: str) -> int:
    """The 64-bit name of a path that goes on by an element."""
    return int.from_bytes(hashlib.blake2b(f"{path}/{name}".encode(), digest_size=8).digest(), "little", signed=True)


class Node:
    __slots__ = ("tag", "name", "path", "up", "own", "away", "depth", "plain", "raw", "kept", "prior", "linked", "block", "open")

    def __init__(self, tag: str, name: str, path: int, up: Node | None, own: int, prior: float, linked: bool):
        self.tag, self.name, self.path, self.up, self.own, self.prior, self.linked = tag, name, path, up, own, prior, linked
        self.away = False
        self.depth = up.depth + 1 if up else 0
        self.plain = self.raw = self.kept = 0  # characters that aren't of a link: its own, all below, those below that aren't apart
        self.block: Node = up.block if up is not None and tag in INLINE else self  # the nearest element that isn't inline
        self.open: dict[str, list[Node]] = {}  # of a block: its open inline elements by tag

    def steps(self) -> str:
        """The path from the root, as text."""
        names, node = [], self
        while node is not None and node.up is not None:
            if node.tag not in INLINE:
                names.append(node.name)
            node = node.up
        return "".join(f"/{n}" for n in reversed(names))


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)}


def _words(name: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(name)}


def _judge(tag: str, rest: str) -> tuple[str, int, float]:
    """`_judged`, remembered for short tags."""
    return _remembered(tag, rest) if len(rest) < 200 else _judged(tag, rest)


def _judged(tag: str, rest: str) -> tuple[str, int, float]:
    """The path step of an element, whether it looks apart from the article (1; 2 where another of its names
    calls it content), and the prior of a container."""
    name, away, named, prior = tag, tag in APART, False, 2.0 if tag == "article" else 1.5 if tag == "main" else 1.0
    if rest.strip(" /\n\t"):
        found = _attributes(rest)
        if cls := found.get("class"):
            name += "." + ".".join(sorted({re.sub(r"\d+", "#", c) for c in cls.split()}))
        names = f"{cls or ''} {found.get('id', '')}"
        words = _words(names)
        if words & GOOD or found.get("itemprop", "").lower() == "articlebody" or found.get("role", "").lower() in ("main", "article"):
            prior *= 1.3
        if tag not in ("html", "body", "article", "main"):
            if words & AWAY:
                named = not away and any(w & GOOD and not w & AWAY for w in map(_words, names.split()))
                away = True
            away |= bool(words & WEAK and not words & GOOD)
        hidden = found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        away, named = away or hidden, named and not hidden
    return name, 2 if named else int(away), prior


_remembered = lru_cache(1 << 14)(_judged)


class Tags:
    """The tags of a page in turn; ``at`` is where the next search begins.

    A tag whose quotes swallow the rest of the page ends at its first `>`; after two such tags quotes count
    no more, so the scan stays linear. Without a further `>` all is text, but an open comment goes on to the end.
    """

    def __init__(self, source: str):
        self.source, self.at, self.last, self.bad = source, 0, source.rfind(">"), 0

    def next(self) -> tuple[int, str | None, bool, str] | None:
        """(start, tag, whether it ends an element, the rest of it); comments and declarations have no tag."""
        source = self.source
        m = (_TAG if self.bad < 2 else _PLAIN).search(source, self.at)
        if m is None:
            return None
        slash, tag, rest, ended = m.groups()
        if ended:
            self.at = m.end()
            return m.start(), tag.lower(), bool(slash), rest
        end = m.end() if tag is None else m.end(2)
        if tag is None and source.startswith("<!--", m.start()):
            closed = _COMMENT_END.search(source, end)
            self.at = closed.end() if closed else len(source)
            return m.start(), None, False, ""
        if end > self.last:
            return None
        until = source.find(">", end)
        self.at = until + 1
        if tag is None:
            return m.start(), None, False, ""
        self.bad += 1
        return m.start(), tag.lower(), bool(slash), source[end:until]

    def skip(self, tag: str) -> None:
        """On behind the end of an element of raw text."""
        closed = _RAW_END[tag].search(self.source, self.at)
        self.at = (self.source.find(">", closed.end()) + 1 if closed else 0) or len(self.source)


class Page:
    """The containers of a page, and its text pieces in order: (node, piece), or (None, "") between blocks."""

    def __init__(self, source: str):
        self.root = Node("", "", 0, None, 0, 1.0, False)
        self.nodes: list[Node] = [self.root]
        self.all: list[Node] = [self.root]  # parents before children
        self.pieces: list[tuple[Node | None, str]] = []
        self.opened: Counter[str] = Counter()  # open elements that aren't inline, by tag
        found, before, here = Tags(source), 0, self.root
        while (met := found.next()) is not None:
            start, tag, ends, rest = met
            if start > before:
                self._text(source[before:start], here)
            if tag is None:
                pass
            elif ends:
                here = self._close(tag, here)
            elif tag == "br":
                self._text(" ", here)
            elif tag in RAW:
                if not rest.endswith("/"):
                    found.skip(tag)
            elif tag not in VOID:
                here = self._open(tag, rest, here)
                self.all.append(here)
            elif tag == "hr":
                self.pieces.append((None, ""))
            before = found.at
        if before < len(source):
            self._text(source[before:], here)
        for node in reversed(self.all):
            node.raw += node.plain
            if node.up is not None:
                node.up.raw += node.raw
        self._survey()
        self._settle(frozenset())

    def _survey(self) -> None:
        """What `_around` asks of the page: the text at each path of elements that look apart but are named content,
        and how many containers of content, below nothing that looks apart, there are, in all and above each node."""
        page = self.root.raw
        self.shares: Counter[int] = Counter()
        self.above: dict[int, int] = {}
        below_own: dict[int, bool] = {}
        self.contents = 0
        holders = set(map(id, self.nodes))
        for node in self.all:
            up = node.up
            if node.own == 2:
                self.shares[node.path] += node.raw
            hidden = below_own[id(node)] = up is not None and (bool(up.own) or below_own[id(up)])
            content = id(node) in holders and node.prior > 1 and not node.own and not hidden and node.raw > 0 and (node.tag in ("article", "main") or 20 * node.raw >= page)
            self.contents += content
            self.above[id(node)] = (self.above[id(up)] if up is not None else 0) + content

    def _settle(self, wanted: frozenset[int]) -> None:
        """Which elements are apart, none of those with the ids ``wanted``, and how much text is kept below each."""
        held: set[int] = set(wanted)
        if any(node.own for node in self.all):
            tops = [n for n in self.all if n.tag in ("article", "main") and n.raw]
            most = max((n.raw for n in tops if n.tag == "article"), default=0)
            for node in (n for n in tops if n.tag == "main" or 2 * n.raw >= most):
                up = node.up
                while up is not None and id(up) not in held:
                    held.add(id(up))
                    up = up.up
        for node in self.all:
            node.kept = 0
            node.away = node.up is not None and id(node) not in wanted and (node.up.away or bool(node.own) and id(node) not in held and not self._around(node))
        for node in reversed(self.all):
            if not node.away:
                node.kept += node.plain
            if node.up is not None:
                node.up.kept += node.kept

    def _around(self, node: Node) -> bool:
        """Whether an element that looks apart is content by its size: with another name that says so and a quarter
        of the page's text (along with others of its path), or around four fifths of it, with no content elsewhere."""
        page = self.root.raw
        if node.own == 2 and 4 * self.shares[node.path] >= page > 0:
            return True
        return 5 * node.raw >= 4 * page > 0 and self.above[id(node)] == self.contents

    def _text(self, text: str, here: Node) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.pieces.append((here, text))
        if not here.linked:
            here.plain += len(text.strip())

    def _leave(self, node: Node) -> None:
        """An element is open no more."""
        if node.tag in INLINE:
            node.block.open[node.tag].pop()
        else:
            self.opened[node.tag] -= 1

    def _up_to(self, here: Node, top: Node) -> Node:
        """Closes all from ``here`` to ``top``; the element that is open then."""
        while here is not top:
            self._leave(here)
            here = here.up
        self._leave(top)
        return top.up

    def _open(self, tag: str, rest: str, here: Node) -> Node:
        if tag in INLINE:
            if not rest and tag != "a":
                child = Node(tag, tag, here.path, here, 0, 1.0, here.linked)
            else:
                _, away, prior = _judge(tag, rest)
                child = Node(tag, tag, here.path, here, away, prior, here.linked or tag == "a")
            child.block.open.setdefault(tag, []).append(child)
            return child
        self.pieces.append((None, ""))
        ends = CLOSES.get(tag, frozenset())
        while (block := here.block).tag == "p" or block.tag in ends:
            here = self._up_to(here, block)
            if not ends or block.tag in ends and tag != "tr":
                break
        name, away, prior = _judge(tag, rest)
        child = Node(tag, name, _step(here.path, name), here, away, prior, here.linked)
        self.opened[tag] += 1
        if tag in HOLDERS:
            self.nodes.append(child)
        return child

    def _close(self, tag: str, here: Node) -> Node:
        """An inline element's end counts inside its block only; one that ends nothing open is ignored."""
        if tag in INLINE:
            own = here.block.open.get(tag)
            return self._up_to(here, own[-1]) if own else here
        if not self.opened[tag]:
            return here
        node = here.block
        while node.tag != tag:
            node = node.up.block
        self.pieces.append((None, ""))
        return self._up_to(here, node)

    def best(self) -> tuple[Node, float]:
        """The first of the containers of one path with the highest score: the plain text of them all together, times
        the container's own prior and a little for its depth; deeper ones win while they hold most of the text."""
        kept: Counter[int] = Counter()
        for node in self.nodes:
            if not node.away:
                kept[node.path] += node.kept
        found, top = self.root, -1.0
        for node in self.nodes:
            score = kept[node.path] * node.prior * (1 + 0.05 * min(node.depth, 10))
            if score > top and not node.away:
                found, top = node, score
        up = found.up
        while up is not None and found.prior < 1.5:  # neither article nor main: nothing of a wrapper that has a good deal more is cut off
            if (up.tag in HOLDERS or up.up is None) and not up.away and kept[found.path] < 0.9 * kept[up.path]:
                found = up
            up = up.up
        return found, max(top, 0.0)

    def at(self, path: int) -> list[Node]:
        """The containers with plain text at ``path``, in page order."""
        there = [n for n in self.nodes if n.path == path and n.raw]
        if there and all(n.away for n in there):
            self._settle(frozenset(map(id, there)))
        return [n for n in there if n.kept and not n.away]

    def chosen(self, path: int | None, beside: frozenset[int]) -> list[Node]:
        """The containers to take where ``path`` is the host's."""
        own = self.best()[0]
        whole = [n for n in self.nodes if n.path == own.path and not n.away and n.kept] or [own]
        there = self.at(path) if path is not None else []
        if not there or sum(n.kept for n in there) < FAR * sum(n.kept for n in whole) and own.path not in beside:
            return whole
        return there

    def text(self, *holders: Node) -> str:
        """The blocks below the holders, but for what is apart, in page order."""
        wanted = set(map(id, holders))
        inside: dict[int, bool] = {}
        for node in self.all:
            inside[id(node)] = id(node) in wanted or node.up is not None and inside[id(node.up)]
        blocks, block = [], []
        for node, piece in [*self.pieces, (None, "")]:
            if node is None:
                blocks.append(" ".join("".join(block).split()))
                block = []
            elif inside[id(node)] and not node.away:
                block.append(piece)
        return "\n\n".join(b for b in blocks if b)


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("host", pa.string()), ("path", pa.int64()), ("votes", pa.float64()), ("seen", pa.float64())])
    votes: Counter[tuple[str, int]] = Counter()
    seen: Counter[tuple[str, int]] = Counter()  # pages with text there

    def flush() -> pa.RecordBatch:
        out = arrow_rows(schema, host=[h for h, _ in seen], path=[p for _, p in seen], votes=[float(votes[k]) for k in seen], seen=list(map(float, seen.values())))
        votes.clear()
        seen.clear()
        return out

    for batch in slices(batches, "html"):
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if host and source:
                page = Page(source)
                node, score = page.best()
                if score:
                    votes[host, node.path] += 1.0
                    seen.update({(host, n.path) for n in page.nodes if n.kept and not n.away} | {(host, node.path)})
        if len(seen) > 20_000:
            yield flush()
    yield flush()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("path", pa.string())])
    for batch in slices(batches, "html"):
        texts, paths = [], []
        for path, beside, source in zip(batch.column("path").to_pylist(), batch.column("beside").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if not source:
                texts.append("")
                paths.append(None)
                continue
            page = Page(source)
            holders = page.chosen(path, frozenset(beside or ()))
            texts.append(page.text(*holders))
            paths.append(holders[0].steps())
        yield arrow_rows(schema, page_id=batch.column("page_id").cast(pa.int64()), url=batch.column("url"), text=texts, n_chars=[len(t) for t in texts], path=paths)


def main_text(pages: DataFrame, broadcast_hosts: int = 50_000) -> DataFrame:
    """(page_id, url, text, n_chars, path) for each row of ``pages`` (page_id, url, html).

    The winning paths, a row a host, are broadcast up to ``broadcast_hosts`` hosts; else they are joined.
    """
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path bigint, votes double, seen double")
    votes = stash(votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("seen").alias("seen")), "host-votes")
    best = votes.filter("votes > 0").groupBy("host").agg(F.max(F.struct("votes", "path"))["path"].alias("path"), F.sum("votes").alias("pages"))
    # at most ten times the paths of a usual page for each host
    aside = votes.filter("votes > 0 AND 2 * votes < seen").join(best.select("host", "pages"), "host").filter("10 * seen >= pages").groupBy("host").agg(F.collect_list("path").alias("beside"))
    winners = stash(best.select("host", "path").join(aside, "host", "left"), "host-paths")
    if winners.count() <= broadcast_hosts:
        winners = F.broadcast(winners)
    return pages.join(winners, "host", "left").select("page_id", "url", "html", "path", "beside").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint, path string")
