"""Main text of web pages by wrapper induction.

A page is read as a tree of block elements and the text segments between their borders.
Pages of a host are aligned with a reference page of that host by simple tree matching
(the largest order-preserving top-down match of two trees; runs of like siblings are one
repeated node, so the number of paragraphs does not matter). Over all different pages of
the host every aligned node then has its texts counted:

* a text that most pages have at a node is template and goes, inside an article too;
* what varies is a slot. The slots decide where the content is: from the root down, the
  container that holds most of the varying text outside links is entered and the containers
  beside it are left out, until none dominates or a marked article is reached that holds a
  fair share. Titles and other text-level elements beside the way down are kept.
* lists of links are left out, and so are elements that HTML itself sets apart (``nav``,
  ``footer``, forms, scripts and so on).

Class and id names are weak evidence: a node named like a sidebar or an advert is left
out unless it holds most of the varying text of its host. They, marked articles and the
density of links are all there is to go by for hosts with fewer than ``LEAST_PAGES``
different pages, for pages that do not fit their host, and for hosts without slots.

The reference of a host is the most usual shape of its pages. Shapes and digests of texts
are made in one scan; counts are added up in tasks before they are shuffled, so a host with
a third of all pages is spread over all tasks; a second scan writes the texts. Copies of a
page count once, and a text inside the content goes only if it stands beside enough
different contents, so that copies of an article do not become template.

Defined results for odd input: a null html is empty and has no text; a null or
unreadable url belongs to the host of no name; repeated rows give equal texts; an empty
table gives an empty result; ties of shapes go to the greater shape; broken or cut markup is
read to the end of the html: an unknown marked section is a comment up to the next ``>``, a
character number too long to read is U+FFFD; nesting may be of any depth. Only the three
named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm.common import by_bytes, checkpointed, tidied

#: Bytes of reference shapes and templates up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: A text is template where so many different pages of a host have the node and this share of them the text.
LEAST_PAGES, STEADY = 3, 0.5
#: Inside the content, so many different contents must stand beside it, and this share of all contents of the host.
LEAST_CONTENTS, STEADY_INSIDE = 6, 0.8
#: A container is entered that holds this share of the varying text; a marked article needs this share of all of it.
DOMINANT, MARKED = 0.6, 0.3
#: Share of text in links from which a node is a menu; share of varying text that outweighs a name.
LINKED, OUTWEIGHS = 0.6, 0.75

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
_NEVER = frozenset(
    "script style noscript template svg math iframe object canvas audio video head title nav footer aside form button select textarea input option menu dialog map".split()
)
_TEXT_LEVEL = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote ul ol li dl dt dd table thead tbody tr td th figure figcaption hgroup".split())
_SCOPE = frozenset("html body article main section div td th table ul ol dl li blockquote aside nav header footer form figure details".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay"
    r"|newsletter|subscribe|signup|login|share|sharing|social|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|topbar"
    r"|related|recommend(?:ed|ations)?|widgets?|toolbar|pagination|pager|skip-link|hidden|sr-only)(?:$|[\s_-])"
)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|repl(?:y|ies)|respond)(?:$|[\s_-])")
#: Names that say nothing against an element inside an article.
_TITLES = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])")
_DIGITS = re.compile(r"[0-9]+")
#: Character references that the parser cannot turn into a number.
_LONG_NUMBER = re.compile(r"&#[0-9]{4000,};?")

#: What is known of a block element by itself; the first three hold for all that is in it.
HIDDEN, NAMED, REPLIES, ARTICLE, TEXTUAL = 1, 2, 4, 8, 16
_INHERITED = HIDDEN | NAMED | REPLIES


class _Builder(HTMLParser):
    """Block elements (sign, parent, flags) in page order, and segments (node, text, characters in links)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.sign, self.parent, self.flags = ["#"], [-1], [0]
        # tag, block node, whether text is hidden here, whether in a link, whether in an article
        self.stack: list[tuple[str, int, bool, bool, bool]] = [("#", 0, False, False, False)]
        self.segments: list[tuple[int, str, int]] = []
        self._text: list[str] = []
        self._linked = 0

    def border(self) -> None:
        if self._text:
            if text := " ".join("".join(self._text).split()):
                self.segments.append((self.stack[-1][1], text, self._linked))
            self._text, self._linked = [], 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _VOID:
            if tag == "hr":
                self.border()
            elif tag not in _INLINE and self._text:
                self._text.append(" ")
            return
        inline = tag in _INLINE
        if not inline:
            self.border()
            self._close_implied(tag)
        _, node, hidden, link, inside = self.stack[-1]
        main, name, classes, flags = tag == "article" or tag == "main", "", "", 0
        if attrs:
            a = {k: (v or "").lower() for k, v in attrs}
            role, classes = a.get("role"), " ".join(a.get("class", "").split())
            main = main or role == "main" or role == "article"
            if role in _ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
                flags |= HIDDEN
            name = f"{classes} {a['id']}" if a.get("id") else classes
            if name and tag not in ("html", "body"):
                name = _TITLES.sub(" ", name) if inside else name
                flags |= NAMED * bool(_NAMES.search(name)) | REPLIES * bool(_COMMENTS.search(name))
        if tag in _NEVER or (tag == "header" and not inside):
            flags |= HIDDEN
        if inline:  # names of inline elements hide them at once: they are too small to be induced
            self.stack.append((tag, node, hidden or bool(flags & _INHERITED), link or tag == "a", inside))
            return
        flags |= self.flags[node] & _INHERITED | TEXTUAL * (tag in _TEXT_LEVEL)
        main = main and not flags & _INHERITED
        self.sign.append(_DIGITS.sub("0", f"{tag}.{classes}") if classes else tag)
        self.parent.append(node)
        self.flags.append(flags | ARTICLE * main)
        self.stack.append((tag, len(self.sign) - 1, hidden or bool(flags & HIDDEN), link, inside or main))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and len(self.stack) > 1 and tag in ("svg", "path", "script"):
            self.handle_endtag(tag)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # as in a browser, a comment up to the next ">"
            return self.rawdata.find(">", i) + 1 or -1

    def _close_implied(self, tag: str) -> None:
        """An open paragraph ends where a block begins; list and table items end at the next one."""
        ends = {"p"} | ({tag} if tag in ("li", "td", "th", "tr", "option") else {"dt", "dd"} if tag in ("dt", "dd") else set())
        for i in range(len(self.stack) - 1, 0, -1):
            t = self.stack[i][0]
            if t in ends:
                del self.stack[i:]
                return
            if t in _SCOPE:
                return

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                if tag not in _INLINE:
                    self.border()
                del self.stack[i:]
                return
            if tag in _INLINE and self.stack[i][0] not in _INLINE:
                return

    def handle_data(self, data: str) -> None:
        _, _, hidden, link, _ = self.stack[-1]
        if not hidden:
            self._text.append(data)
            if link:
                self._linked += len("".join(data.split()))


class Page:
    """A page that was read: its blocks, its segments, and its shape."""

    def __init__(self, html: str):
        builder = _Builder()
        builder.feed(_LONG_NUMBER.sub("�", html))
        builder.close()
        builder.border()
        self.sign, self.parent, self.flags, self.segments = builder.sign, builder.parent, builder.flags, builder.segments

    def folded(self) -> tuple[str, list[int]]:
        """Its shape as text (a line per node: parent, flags, sign), and the node of the shape that each block belongs to.

        Like siblings in a row are one node: of one sign, and with at least half of the signs of their children in common.
        So are the nth runs of like children of merged parents.
        """
        kids: list[list[int]] = [[] for _ in self.sign]
        for i, p in enumerate(self.parent):
            if p >= 0 and not self.flags[i] & HIDDEN:
                kids[p].append(i)
        of, groups, lines = [-1] * len(self.sign), [[0]], ["-1 0 #"]
        of[0] = at = 0
        while at < len(groups):
            found: dict[tuple[str, int], int] = {}
            for member in groups[at]:
                runs, before, inner = defaultdict(int), None, frozenset()
                for k in kids[member]:
                    sign, own = self.sign[k], frozenset(self.sign[x] for x in kids[k])
                    if sign != before or 2 * len(own & inner) < len(own | inner):
                        runs[sign] += 1
                    before, inner = sign, own
                    key = (sign, runs[sign])
                    if key not in found:
                        found[key] = len(groups)
                        groups.append([])
                        lines.append(f"{at} {self.flags[k]} {sign}")
                    groups[found[key]].append(k)
                    of[k] = found[key]
            at += 1
        return "\n".join(lines), of


class Shape:
    """A shape read from its text: parents come before their children."""

    def __init__(self, text: str):
        rows = [line.split(" ", 2) for line in text.split("\n")]
        self.parent, self.flags, self.sign = [int(r[0]) for r in rows], [int(r[1]) for r in rows], [r[2] for r in rows]
        self.kids: list[list[int]] = [[] for _ in rows]
        for i, p in enumerate(self.parent):
            if p >= 0:
                self.kids[p].append(i)
        self.size, self.digest = [1] * len(rows), [0] * len(rows)
        for i in range(len(rows) - 1, -1, -1):
            self.size[i] += sum(self.size[k] for k in self.kids[i])
            self.digest[i] = hash((self.sign[i], tuple(self.digest[k] for k in self.kids[i])))


class Alignment:
    """Simple tree matching of two shapes, without recursion."""

    #: Cells of a table up to which it is kept whole; beyond, children are split in halves.
    CELLS = 1 << 22

    def __init__(self, a: Shape, b: Shape):
        self.a, self.b = a, b
        self.known: dict[tuple[int, int], int] = {}

    def _ends(self, x: int, y: int) -> tuple[list[int], list[int], int]:
        """Children of both without those that are alike at either end, and how many those are at the beginning."""
        ka, kb, da, db = self.a.kids[x], self.b.kids[y], self.a.digest, self.b.digest
        i, n = 0, min(len(ka), len(kb))
        while i < n and da[ka[i]] == db[kb[i]]:
            i += 1
        j = 0
        while j < n - i and da[ka[-1 - j]] == db[kb[-1 - j]]:
            j += 1
        return ka[i : len(ka) - j], kb[i : len(kb) - j], i

    def _row(self, x: int, ys: list[int], places: dict[str, list[int]]) -> np.ndarray:
        row = np.zeros(len(ys), np.int64)
        for j in places.get(self.a.sign[x], ()):
            row[j] = self.known[self.a.digest[x], self.b.digest[ys[j]]]
        return row

    def _places(self, ys: list[int]) -> dict[str, list[int]]:
        places = defaultdict(list)
        for j, y in enumerate(ys):
            places[self.b.sign[y]].append(j)
        return places

    def _rows(self, xs: list[int], ys: list[int], keep: bool = False) -> list[np.ndarray]:
        """Sizes of the best matches of the first children of one with the first of the other; all rows or the last."""
        places, rows = self._places(ys), [np.zeros(len(ys) + 1, np.int64)]
        for x in xs:
            new = np.zeros(len(ys) + 1, np.int64)
            np.maximum.accumulate(np.maximum(rows[-1][1:], rows[-1][:-1] + self._row(x, ys, places)), out=new[1:])
            rows = [*rows, new] if keep else [new]
        return rows

    def weight(self, x: int = 0, y: int = 0) -> int:
        """Size of the largest match below two nodes of like sign, these included."""
        todo = [(x, y)]
        while todo:
            i, j = todo[-1]
            key = (self.a.digest[i], self.b.digest[j])
            if key in self.known:
                todo.pop()
            elif key[0] == key[1]:
                self.known[key] = self.a.size[i]
            else:
                xs, ys, _ = self._ends(i, j)
                places = self._places(ys)
                pairs = [(u, ys[v]) for u in xs for v in places.get(self.a.sign[u], ())]
                missing = [p for p in pairs if (self.a.digest[p[0]], self.b.digest[p[1]]) not in self.known]
                if missing:
                    todo += missing
                else:
                    alike = sum(self.a.size[k] for k in self.a.kids[i]) - sum(self.a.size[k] for k in xs)
                    self.known[key] = 1 + alike + (int(self._rows(xs, ys)[0][-1]) if pairs else 0)
        return self.known[self.a.digest[x], self.b.digest[y]]

    def _matched(self, xs: list[int], ys: list[int]) -> Iterator[tuple[int, int]]:
        """The pairs of a best match of two rows of children."""
        todo = [(xs, ys)]
        while todo:
            xs, ys = todo.pop()
            if not xs or not ys:
                continue
            if len(xs) > 1 and len(xs) * len(ys) > self.CELLS:
                half = len(xs) // 2
                front, places = self._rows(xs[:half], ys)[0], self._places(ys[::-1])
                back = np.zeros(len(ys) + 1, np.int64)
                for x in reversed(xs[half:]):
                    new = np.zeros(len(ys) + 1, np.int64)
                    np.maximum.accumulate(np.maximum(back[1:], back[:-1] + self._row(x, ys[::-1], places)), out=new[1:])
                    back = new
                cut = int(np.argmax(front + back[::-1]))
                todo += [(xs[:half], ys[:cut]), (xs[half:], ys[cut:])]
                continue
            rows = self._rows(xs, ys, True)
            i, j = len(xs), len(ys)
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    yield xs[i], ys[j]

    def places(self) -> list[int]:
        """For each node of the second shape the node of the first that it matches, or -1."""
        out = [-1] * len(self.b.sign)
        if self.a.sign[0] != self.b.sign[0]:
            return out
        self.weight()
        todo = [(0, 0)]
        while todo:
            x, y = todo.pop()
            out[y] = x
            if self.a.digest[x] == self.b.digest[y]:
                todo += zip(self.a.kids[x], self.b.kids[y], strict=True)
                continue
            xs, ys, first = self._ends(x, y)
            todo += zip(self.a.kids[x][:first], self.b.kids[y][:first], strict=True)
            rest = len(self.a.kids[x]) - first - len(xs)
            if rest:
                todo += zip(self.a.kids[x][-rest:], self.b.kids[y][-rest:], strict=True)
            todo += self._matched(xs, ys)
        return out


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def nearest(shape: Shape, places: list[int]) -> list[int]:
    """The reference node of each node of a shape, or that of its nearest ancestor that has one."""
    out = list(places)
    for i in range(1, len(out)):  # parents come first
        if out[i] < 0:
            out[i] = out[shape.parent[i]]
    return out


NO, BESIDE, INSIDE = 0, 1, 2


def content(reference: Shape, varying: dict[int, int], linked: dict[int, int]) -> list[int] | None:
    """Which nodes of the reference hold content (INSIDE) or stand BESIDE the way to it, by the varying characters at each and those of them in links; None without any."""
    n = len(reference.sign)
    own = [max(0, varying.get(i, 0) - linked.get(i, 0)) for i in range(n)]
    total = sum(own)
    named = sum(m for m, f in zip(own, reference.flags, strict=True) if f & NAMED and not f & REPLIES)
    against = REPLIES if total and named >= OUTWEIGHS * total else REPLIES | NAMED
    if all(f & against for m, f in zip(own, reference.flags, strict=True) if m):
        against = 0
    mass, through, links = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        mass[i] += 0 if reference.flags[i] & against else own[i]
        through[i] += varying.get(i, 0)
        links[i] += linked.get(i, 0)
        if (p := reference.parent[i]) >= 0:
            mass[p], through[p], links[p] = mass[p] + mass[i], through[p] + through[i], links[p] + links[i]
    if not mass[0]:
        return None
    kept = [NO] * n

    def keep(top: int, how: int = INSIDE) -> None:
        todo = [top]
        while todo:
            i = todo.pop()
            if reference.flags[i] & against or (i != top and links[i] > LINKED * through[i]):
                continue
            kept[i] = how
            todo += reference.kids[i]

    marked = [i for i in range(n) if reference.flags[i] & ARTICLE and mass[i] >= MARKED * mass[0]]
    if marked:
        top = max(marked, key=lambda i: (mass[i], -i))
        for i in marked:  # parents come first: an article inside a main part is entered
            p = i
            while p > top:
                p = reference.parent[p]
            if p == top and i != top and mass[i] >= DOMINANT * mass[top]:
                top = i
        for i in reference.kids[reference.parent[top]]:
            if i == top or reference.flags[i] & ARTICLE:
                keep(i)
        return kept
    at = 0
    while True:
        inner = [k for k in reference.kids[at] if not reference.flags[k] & (TEXTUAL | against)]
        best = max(inner, key=lambda k: (mass[k], -k), default=None)
        if best is None or mass[best] < DOMINANT * mass[at]:
            keep(at)
            return kept
        kept[at] = BESIDE
        for k in reference.kids[at]:
            if reference.flags[k] & TEXTUAL and not links[k] > LINKED * through[k]:
                keep(k, BESIDE)
        at = best


def _alone(page: Page) -> list[str]:
    """The segments of a page that nothing else is known of."""
    marked = [bool(f & ARTICLE) for f in page.flags]
    if any(marked):
        holds = [False] * len(marked)  # a main part with an article in it gives way to that
        inside = list(marked)
        for i in range(len(marked) - 1, 0, -1):
            holds[page.parent[i]] |= holds[i] or marked[i]
        for i in range(1, len(marked)):
            own = marked[i] and not (page.sign[i].split(".")[0] == "main" and holds[i])
            inside[i] = own or inside[page.parent[i]]
            if marked[i] and not own:
                inside[i] = inside[page.parent[i]]
        return [t for n, t, _ in page.segments if inside[n] and not page.flags[n] & _INHERITED]
    linked, total = [0] * len(marked), [0] * len(marked)
    for n, t, k in page.segments:
        if not page.flags[n] & _INHERITED:
            linked[n], total[n] = linked[n] + k, total[n] + len("".join(t.split()))
    for i in range(len(marked) - 1, 0, -1):
        p = page.parent[i]
        linked[p], total[p] = linked[p] + linked[i], total[p] + total[i]
    menu = [False] * len(marked)
    for i in range(1, len(marked)):
        menu[i] = menu[page.parent[i]] or bool(total[i] and linked[i] > LINKED * total[i])
    return [t for n, t, _ in page.segments if not menu[n] and not page.flags[n] & _INHERITED]


class Host:
    """What is known of a host: its reference shape, which of its nodes are content, and the template texts in these."""

    def __init__(self, reference: str, kept: list[int], template: list[tuple[int, int]]):
        self.shape, self.kept, self.template = Shape(reference), kept, set(template)
        self._places: dict[str, list[int]] = {}

    def places(self, shape: str) -> list[int]:
        """Of each node of a shape the reference node, its own or that of the nearest ancestor."""
        if shape not in self._places:
            if len(self._places) > 512:
                self._places.clear()
            own = Shape(shape)
            self._places[shape] = nearest(own, Alignment(self.shape, own).places())
        return self._places[shape]


def main_text(html: str, host: Host | None = None) -> str:
    page = Page(html)
    out: list[str] = []
    if host is not None and page.segments:
        shape, of = page.folded()
        places = host.places(shape)
        linked, total = defaultdict(int), defaultdict(int)
        for n, t, k in page.segments:
            linked[n], total[n] = linked[n] + k, total[n] + len("".join(t.split()))
        for n, t, _ in page.segments:
            at = places[of[n]]
            if not host.kept[at] or (at, text_hash(t)) in host.template:
                continue
            # where the page differs from the reference, its own names and links count
            strange = page.flags[n] & (NAMED | REPLIES) and not host.shape.flags[at] & (NAMED | REPLIES)
            if not strange and not (linked[n] > LINKED * total[n] and not page.flags[n] & TEXTUAL):
                out.append(t)
    return " ".join(out or _alone(page))


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.rtrim(host).alias("host"))


def _small(df: DataFrame, size, most: int) -> DataFrame:
    """Broadcast only behind a check of its size; otherwise an ordinary join, whose skew Spark splits."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def digests(pages: DataFrame) -> DataFrame:
    """(host, shape, segments): one row per different page of a host; texts are digests with their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("node", pa.int32()), ("hash", pa.int64()), ("chars", pa.int32()), ("linked", pa.int32())]))
        for batch in by_bytes(batches, "html"):
            shapes, keys, found = [], [], []
            for html in _column(batch, "html"):
                page = Page(html)
                shape, of = page.folded()
                shapes.append(shape)
                keys.append(text_hash(html))
                own = [(of[n], text_hash(t), len("".join(t.split())), k) for n, t, k in page.segments if of[n] >= 0]
                found.append([{"node": n, "hash": h, "chars": c, "linked": k} for n, h, c, k in own])
            hosts = batch.column(batch.schema.get_field_index("host"))
            yield pa.RecordBatch.from_arrays([hosts, pa.array(keys, pa.int64()), pa.array(shapes, pa.string()), pa.array(found, kind)], ["host", "page", "shape", "segments"])

    schema = "host string, page long, shape string, segments array<struct<node:int,hash:long,chars:int,linked:int>>"
    return pages.select("host", "html").mapInArrow(tidied(run), schema).dropDuplicates(["host", "page"]).drop("page")


def references(seen: DataFrame) -> DataFrame:
    """(host, reference): the most usual shape of each host with enough different pages."""
    usual = seen.groupBy("host", "shape").agg(F.count("*").alias("n"))
    chosen = usual.groupBy("host").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "shape")).alias("top"))
    return chosen.where(F.col("pages") >= LEAST_PAGES).select("host", F.col("top.shape").alias("reference"))


class _Hosts:
    """Hosts met last, as a worker needs them."""

    def __init__(self):
        self.known: dict[str, Host] = {}

    def get(self, host: str, reference: str | None, kept=(), template=()) -> Host | None:
        if reference is None:
            return None
        if host not in self.known:
            if len(self.known) > 256:
                self.known.clear()
            self.known[host] = Host(reference, list(kept), [(t["node"], t["hash"]) for t in template or ()])
        return self.known[host]


def counted(seen: DataFrame, refs: DataFrame) -> DataFrame:
    """(host, node, hash, n, chars, linked): in how many different pages a reference node has a text; hash is null for the node itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts = _Hosts()
        for batch in batches:
            rows = []
            for host, shape, segments, ref in zip(*(_column(batch, c) for c in ("host", "shape", "segments", "reference")), strict=True):
                places = hosts.get(host, ref).places(shape)
                found: dict[tuple, list[int]] = {}
                for s in segments:
                    at = places[s["node"]]
                    cell = found.setdefault((at, s["hash"]), [0, 0])
                    cell[0] += s["chars"]
                    cell[1] += s["linked"]
                rows += [(host, at, h, c, k) for (at, h), (c, k) in found.items()]
                rows += [(host, at, None, 0, 0) for at in {at for at, _ in found}]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["host", "node", "hash", "chars", "linked"])

    met = seen.join(refs, "host").mapInArrow(tidied(run), "host string, node int, hash long, chars long, linked long")
    return met.groupBy("host", "node", "hash").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))


def contents(texts: DataFrame, refs: DataFrame) -> DataFrame:
    """(host, reference, kept, template): nodes that hold content, and steady texts in them."""
    by_node = texts.groupBy("host", "node").agg(F.sum(F.when(F.col("hash").isNull(), F.col("n"))).alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    often = texts.where(F.col("hash").isNotNull() & (F.col("n") >= LEAST_PAGES)).withColumnsRenamed({"chars": "c", "linked": "l"})
    steady = often.join(by_node.select("host", "node", "pages"), ["host", "node"]).where(F.col("n") >= STEADY * F.col("pages"))
    # few texts of a node can be that frequent, and the nodes are those of one page
    steady = steady.groupBy("host", "node").agg(F.collect_list("hash").alias("hashes"), F.sum("c").alias("c"), F.sum("l").alias("l"))
    nodes = by_node.join(steady, ["host", "node"], "left")
    cell = F.struct("node", (F.col("chars") - F.coalesce("c", F.lit(0))).alias("chars"), (F.col("linked") - F.coalesce("l", F.lit(0))).alias("linked"), "hashes")
    hosts = nodes.groupBy("host").agg(F.collect_list(cell).alias("nodes")).join(refs, "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, refs_, kept, template = [], [], [], []
            for host, ref, nodes in zip(*(_column(batch, c) for c in ("host", "reference", "nodes")), strict=True):
                inside = content(Shape(ref), {x["node"]: x["chars"] for x in nodes}, {x["node"]: x["linked"] for x in nodes})
                if inside is None:
                    continue
                names.append(host)
                refs_.append(ref)
                kept.append(inside)
                template.append([{"node": x["node"], "hash": h} for x in nodes if inside[x["node"]] for h in x["hashes"] or ()])
            kind = pa.list_(pa.struct([("node", pa.int32()), ("hash", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(refs_, pa.string()), pa.array(kept, pa.list_(pa.int8())), pa.array(template, kind)], ["host", "reference", "kept", "template"])

    return hosts.mapInArrow(tidied(run), "host string, reference string, kept array<tinyint>, template array<struct<node:int,hash:long>>")


def confirmed(seen: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, template): steady texts inside the content that stand beside enough different contents.

    The content of a page is the set of its other texts there. Copies of an article have one content between them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Hosts()
        for batch in batches:
            rows = []
            for host, shape, segments, ref, kept, template in zip(*(_column(batch, c) for c in ("host", "shape", "segments", "reference", "kept", "template")), strict=True):
                known = memory.get(host, ref, kept, template)
                places = known.places(shape)
                own = {(places[s["node"]], s["hash"]) for s in segments if known.kept[places[s["node"]]]}
                beside = text_hash(",".join(str(h) for _, h in sorted(own - known.template)))
                rows += [(host, n, h, known.kept[n] == INSIDE, beside) for n, h in own & known.template] + [(host, None, None, None, beside)]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["host", "node", "hash", "inside", "others"])

    met = seen.join(hosts.where(F.size("template") > 0), "host").mapInArrow(tidied(run), "host string, node int, hash long, inside boolean, others long")
    counts = met.distinct().groupBy("host", "node", "hash", "inside").agg(F.count("*").alias("n"))
    all_ = counts.where(F.col("node").isNull()).select("host", F.col("n").alias("contents"))
    least = F.when(F.col("inside"), F.greatest(F.lit(LEAST_CONTENTS), STEADY_INSIDE * F.col("contents"))).otherwise(F.greatest(F.lit(LEAST_PAGES), STEADY * F.col("contents")))
    sure = counts.where(F.col("node").isNotNull()).join(all_, "host").where(F.col("n") >= least)
    return sure.groupBy("host").agg(F.collect_list(F.struct("node", "hash")).alias("template"))  # of the nodes of one page


def induced(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(host, reference, kept, template) of every host with enough different pages, from (page_id, url, html, host)."""
    seen = checkpointed(digests(pages))
    refs = checkpointed(references(seen))
    few = _small(refs, F.octet_length("reference") + F.octet_length("host") + 32, broadcast_bytes)
    texts = checkpointed(counted(seen, few))
    hosts = checkpointed(contents(texts, refs))
    if hosts.where(F.size("template") > 0).isEmpty():
        return hosts
    size = F.octet_length("reference") + F.octet_length("host") + F.size("kept") + 16 * F.size("template") + 32
    template = confirmed(seen, _small(hosts, size, broadcast_bytes))
    return checkpointed(hosts.drop("template").join(template, "host", "left"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    own = _with_host(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")))
    hosts = induced(own, broadcast_bytes)
    size = F.octet_length("reference") + F.octet_length("host") + F.size("kept") + 16 * F.greatest(F.size("template"), F.lit(0)) + 32
    few = _small(hosts, size, broadcast_bytes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Hosts()
        for batch in by_bytes(batches, "html"):
            rows = zip(*(_column(batch, c) for c in ("html", "host", "reference", "kept", "template")), strict=True)
            out = [main_text(markup, memory.get(host, ref, kept or (), template)) for markup, host, ref, kept, template in rows]
            ids = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = [own.schema["page_id"], own.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return own.join(few, "host", "left").mapInArrow(tidied(read), T.StructType(schema))
