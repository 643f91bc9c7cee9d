"""Pages to rows: links, tables, list items, department blocks, as table functions.

No parser fetches anything or raises: a page it can't read gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_BLOCKS = {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol"}


_HEADS = ("h1", "h2", "h3", "h4", "h5", "h6", "strong", "b")


@dataclass
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: Node | None = None

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.walk()

    def find_all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags and n is not self]

    def text(self, breaks: bool = False) -> str:
        parts: list[str] = []

        def take(n: Node) -> None:
            if n.tag in ("script", "style"):
                return
            if breaks and n.tag in _BLOCKS:
                parts.append("\n")
            for c in n.children:
                if isinstance(c, Node):
                    take(c)
                else:
                    parts.append(c)
            if n.tag in ("td", "th", "li"):
                parts.append("\n" if breaks else " ")

        take(self)
        joined = "".join(parts)
        if breaks:
            return "\n".join(x for x in (" ".join(line.split()) for line in joined.split("\n")) if x)
        return " ".join(joined.split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for closing in _CLOSES.get(tag, ()):
            n = self.at
            while n.parent and n.tag not in ("table", "ul", "ol", "dl", "#root"):
                if n.tag == closing:
                    self.at = n.parent
                    break
                n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, parent=self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, parent=self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    """A small element tree; never raises."""
    builder = _Builder()
    try:
        builder.feed(html or "")
        builder.close()
    except Exception:  # noqa: BLE001 - a page that can't be parsed is a page with nothing in it
        return Node("#root")
    return builder.root


#: What recruitment links say, and what links to leave alone say.
RECRUIT = r"(?i)\b(?:recruit\w*|vacanc\w+|advertisement|advt|faculty positions?|career\w*|walk[- ]?in|job opening\w*|notification)\b|भर्ती|रिक्ति"
RECRUIT_URL = r"(?i)/(?:recruit|career|vacanc|jobs?|advt)"
AVOID = r"(?i)^(?:home|about(?: us)?|contact(?: us)?|login|sign in|sitemap|gallery|tenders?|results?|admissions?|syllabus|alumni|back|next|previous)$"
AD_NUMBER = r"(?i)\b(?:advt?\.?|advertisement|notification)\s*(?:no\.?)?\s*[:\-]?\s*([A-Z0-9][A-Z0-9/.\-]{2,40}\d)"


def is_recruitment_link(text: str, href: str, context: str = "") -> bool:
    """A link to a vacancy: not a navigation word, and its text or address says so, or it is a PDF amid such words."""
    if re.match(AVOID, text.strip()):
        return False
    return bool(re.search(RECRUIT, text) or re.search(RECRUIT_URL, href) or (href.lower().split("?")[0].endswith(".pdf") and re.search(RECRUIT, context)))


@udtf(returnType="seq int, url string, text string, context string, is_pdf boolean, recruits boolean")
class PageLinks:
    """The links of a page with absolute addresses; anchors and scripts left out, an address counts once, the first time."""

    def eval(self, html: str | None, base: str | None):
        seen = set()
        for a in tree(html).find_all("a"):
            href = a.attrs.get("href", "").strip()
            text = a.text()
            if not href or not text or href.startswith("#") or href.lower().startswith(("javascript:", "mailto:")):
                continue
            url = urljoin(base or "", href)
            if url in seen:
                continue
            seen.add(url)
            context = (a.parent.text() if a.parent else "")[:500]
            yield len(seen) - 1, url, text[:250], context, url.lower().split("?")[0].endswith(".pdf"), is_recruitment_link(text, href, context)


@udtf(returnType="table_no int, row_no int, cells array<string>, links array<string>, is_head boolean")
class PageTables:
    """The rows of all tables of a page: cell texts and link addresses."""

    def eval(self, html: str | None, base: str | None):
        for t, table in enumerate(tree(html).find_all("table")):
            for r, row in enumerate(table.find_all("tr")):
                cells = row.find_all("td", "th")
                if cells:
                    links = [urljoin(base or "", a.attrs["href"]) for a in row.find_all("a") if a.attrs.get("href")]
                    yield t, r, [c.text() for c in cells], links, all(c.tag == "th" for c in cells)


@udtf(returnType="table_no int, fields map<string,string>")
class LabelledTables:
    """Tables of which each row is a label and a value, as one record each: labels squeezed, in lower case, without a colon; the first value of a label counts."""

    def eval(self, html: str | None):
        for t, table in enumerate(tree(html).find_all("table")):
            fields: dict[str, str] = {}
            for row in table.find_all("tr"):
                cells = row.find_all("td", "th")
                if len(cells) == 2 and (label := cells[0].text().rstrip(": ").lower()):
                    fields.setdefault(label, cells[1].text())
            if fields:
                yield t, fields


@udtf(returnType="seq int, text string, url string")
class PageItems:
    """List items that hold a link."""

    def eval(self, html: str | None, base: str | None):
        k = 0
        for li in tree(html).find_all("li"):
            links = [a for a in li.find_all("a") if a.attrs.get("href")]
            if links:
                yield k, li.text()[:500], urljoin(base or "", links[0].attrs["href"])
                k += 1


@udtf(returnType="seq int, url string, text string, heading string")
class HeadedLinks:
    """Links with the heading that stands before them: the nearest earlier heading or bold text among the siblings of up to six ancestors."""

    def eval(self, html: str | None, base: str | None):
        k = 0
        for a in tree(html).find_all("a"):
            if not a.attrs.get("href"):
                continue
            heading, n, level = None, a, 0
            while n.parent and level < 6 and heading is None:
                for s in reversed(n.parent.children[: n.parent.children.index(n)]):
                    if isinstance(s, Node):
                        found = [s] if s.tag in _HEADS else s.find_all(*_HEADS)
                        if found and found[-1].text():
                            heading = found[-1].text()
                            break
                n, level = n.parent, level + 1
            yield k, urljoin(base or "", a.attrs["href"]), a.text(), heading
            k += 1


@udtf(returnType="seq int, unit string, body string")
class UnitBlocks:
    """'Name: body' blocks of a page's text, a body running to the next name; bodies over 4000 characters end at a word with '…'."""

    def eval(self, html: str | None, known: list[str] | None):
        text = tree(html).text()
        names = [re.escape(n) for n in (known or [])]
        pattern = re.compile("|".join([*[rf"\b{n}\s*:" for n in names], r"\b(?:[A-Z][a-z]+(?:\s+(?:and|of|&)\s+|\s+)){0,4}[A-Z][a-z]+\s*:(?=\s)"]))
        heads = list(pattern.finditer(text))
        for k, m in enumerate(heads):
            body = text[m.end() : heads[k + 1].start() if k + 1 < len(heads) else len(text)].strip()
            if len(body) > 4000:
                body = body[:4000].rsplit(" ", 1)[0] + "…"
            if body:
                yield k, m.group(0).rstrip(": "), body


@udtf(returnType="title string, text string")
class PageText:
    """A page's title and its text by lines."""

    def eval(self, html: str | None):
        root = tree(html)
        titles = root.find_all("title")
        yield titles[0].text() if titles else None, root.text(breaks=True)


def page_title(html: Column) -> Column:
    """The title element's text, without Python."""
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def ad_number(text: Column) -> Column:
    """The number that follows 'advertisement' and the like, without marks at its end; null without one."""
    found = F.regexp_replace(F.regexp_extract(text, AD_NUMBER, 1), r"[./-]+$", "")
    return F.when(found != "", found)


def link_ads(pages: DataFrame) -> DataFrame:
    """Ads from recruitment links of pages (url, html, fetched_at): one for each address, titles from the context where the link only says 'click here'."""
    spark = pages.sparkSession
    spark.udtf.register("noticeworks_links", PageLinks)
    found = spark.sql("SELECT p.url AS page_url, p.fetched_at, l.* FROM {pages} p, LATERAL noticeworks_links(p.html, p.url) l WHERE l.recruits", pages=pages)
    bare = F.col("text").rlike(r"(?i)^(?:click here|here|view|download|details|read more|pdf|apply)\W*$")
    title = F.substring(F.when(bare, F.col("context")).otherwise(F.col("text")), 1, 250)
    return found.select("page_url", "fetched_at", "url", title.alias("title"), ad_number(F.concat_ws(" ", "text", "context")).alias("ad_number"), "is_pdf", F.when(F.col("text").rlike(RECRUIT), 0.5).otherwise(0.4).alias("parse_confidence"))


def table_ads(pages: DataFrame, roles: dict[str, int], least_cells: int = 2) -> DataFrame:
    """Ads from table rows: ``roles`` names the cell (from 0, from the end if negative) of ad_number, title and closing."""
    spark = pages.sparkSession
    spark.udtf.register("noticeworks_tables", PageTables)
    rows = spark.sql("SELECT p.url AS page_url, p.fetched_at, t.* FROM {pages} p, LATERAL noticeworks_tables(p.html, p.url) t WHERE NOT t.is_head", pages=pages).where(F.size("cells") >= least_cells)
    cell = lambda k: F.trim(F.try_element_at("cells", F.lit(k + 1 if k >= 0 else k)))
    pdf = F.filter("links", lambda u: F.lower(u).contains(".pdf"))
    out = rows.select("page_url", "fetched_at", "table_no", "row_no", *[cell(k).alias(n) for n, k in roles.items()], F.coalesce(F.try_element_at(pdf, F.lit(1)), F.try_element_at("links", F.lit(1))).alias("url"))
    return out.where(F.length("title") >= 5)


def parser_for(names: Column, known: list[str], default: str = "generic") -> Column:
    """The parser of a source; unknown names go to the default."""
    return F.when(names.isin(*known), names).otherwise(default)


def first_that_finds(pages: DataFrame, parsers: list[Callable[[DataFrame], DataFrame]], page: str = "page_url") -> DataFrame:
    """The rows of the first parser that finds any on a page: each next parser only sees the pages that are still empty."""
    found, left = None, pages
    for parse in parsers:
        rows = parse(left)
        left = left.join(rows.select(F.col(page).alias("url")).distinct(), "url", "left_anti")
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found
