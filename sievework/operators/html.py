"""HTML pages to documents."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that are no content, that stand on lines of their own, that are cells, and that have no end tag.
NOISE = frozenset("script style noscript nav footer header aside template svg".split())
BLOCKS = frozenset(
    "address article aside blockquote br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(["td", "th"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base link meta noscript script style template title".split())
#: Opening one of these ends an open one of those.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}} | {
    x: {"p"} for x in BLOCKS - {"br", "li", "dt", "dd", "tr", "tbody", "thead", "tfoot", "p"}
}
SCOPE = frozenset("table ul ol dl body html td th tr div section article main".split())

PAGE = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("content", T.StringType()), T.StructField("language", T.StringType()), T.StructField("description", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))]
)


def collapse(text: str) -> str:
    return " ".join(text.split())


class Page(HTMLParser):
    """One pass over the tags: text goes to every candidate for the content's root that is open."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.noise = 0
        self.title_text: list[str] | None = None
        self.titles: list[str] = []
        self.headings: list[list[str]] = []
        self.meta: dict[str, str] = {}
        self.lang: str | None = None
        self.roots: dict[str, list[str]] = {}
        self.inside: list[str] = []
        self.links: dict[str, list[str]] = {}
        self.has_body = False
        self.feed(source)
        self.close()

    def _put(self, text: str) -> None:
        if not self.noise:
            for root in ["", *self.inside]:
                self.roots.setdefault(root, []).append(text)
            if "h1" in self.open and self.headings:
                self.headings[-1].append(text)

    def _pop(self, upto: int) -> None:
        while len(self.open) > upto:
            tag = self.open.pop()
            if tag in BLOCKS:
                self._put("\n")
            if tag in NOISE:
                self.noise -= 1
            if tag == "title" and self.title_text is not None:
                self.titles.append("".join(self.title_text))
                self.title_text = None
            if tag in self.inside and tag not in self.open:
                self.inside.remove(tag)
                self.roots.setdefault(f"done {tag}", [])

    def _begin_root(self, tag: str) -> None:
        if not self.noise and tag not in self.inside and f"done {tag}" not in self.roots:
            self.inside.append(tag)
            self.roots.setdefault(tag, [])

    def handle_starttag(self, tag, attrs):
        found = dict(reversed(attrs))
        if tag == "html" and self.lang is None:
            self.lang = (found.get("lang") or "").strip() or None
        if tag == "meta":
            name = (found.get("name") or found.get("http-equiv") or "").lower()
            kind = "" if found.get("name") else "equiv "
            if value := (found.get("content") or "").strip():
                self.meta.setdefault(kind + name, value)
        if tag not in HEAD and tag not in ("html", "head") and "body" not in self.open and not self.has_body and tag != "body":
            self.handle_starttag("body", [])
        if tag == "body":
            if self.has_body:
                return
            self.has_body = True
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] in ENDS.get(tag, ()):
                self._pop(k)
                break
            if self.open[k] in SCOPE and not (tag in ("td", "th", "tr") and self.open[k] in ("td", "th", "tr")):
                break
        if tag in ("main", "article", "body"):
            self._begin_root(tag)
        if tag in NOISE and tag not in VOID:
            self.noise += 1
        self._put("\n" if tag in BLOCKS else "\t" if tag in CELLS else "")
        if tag == "a" and not self.noise and (href := (found.get("href") or "").strip()):
            for root in ["", *self.inside]:
                self.links.setdefault(root, []).append(href)
        if tag == "title" and self.title_text is None and "svg" not in self.open:
            self.title_text = []
        if tag == "h1" and not self.noise:
            self.headings.append([])
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if "svg" in self.open or "math" in self.open:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("body", "html"):
            return
        if tag in self.open:
            at = len(self.open) - 1 - self.open[::-1].index(tag)
            if tag not in ("p", "a", "span", "b", "i", "em", "strong") or not SCOPE & set(self.open[at + 1 :]):
                self._pop(at)
        elif tag == "p":
            self._put("\n\n")

    def handle_data(self, data):
        if self.title_text is not None:
            self.title_text.append(data)
        else:
            if data.strip() and not self.has_body and not self.noise:
                self.handle_starttag("body", [])
            self._put(data.replace("\n", " ").replace("\r", " "))

    def result(self) -> dict | None:
        root = next((r for r in ("main", "article", "body") if r in self.roots), "")
        lines = ("".join(self.roots.get(root, []))).split("\n")
        cells = ("\t".join(filter(None, map(collapse, line.split("\t")))) for line in lines)
        content = "\n".join(filter(None, cells))
        title = next((t for t in map(collapse, self.titles) if t), None) or next((t for t in (collapse("".join(h)) for h in self.headings) if t), None)
        if not content and title is None:
            return None
        language = self.lang or self.meta.get("language") or self.meta.get("equiv content-language")
        return {"title": title, "content": content, "language": language, "description": self.meta.get("description"), "links": list(dict.fromkeys(self.links.get(root, [])))}


def extract(source: str | None) -> dict | None:
    return None if source is None else Page(source).result()


_META = re.compile(rb"<meta[^>]*charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)


def decode_html(data: bytes, charset: str | None = None) -> str:
    """By byte order mark, as UTF-8 where valid, by the transport's charset, by the one that the first 1024 bytes name, or lossy."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    named = _META.search(data[:1024])
    told = named[1].decode().lower() if named else None
    for name in ("utf-8", charset, None if told and told.startswith("utf-16") else told):
        try:
            if name:
                return data.decode(name, "strict" if name == "utf-8" else "replace")
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("utf-8", "replace")


def documents(data: bytes, charset: str | None = None, extract_links: bool = False, include_meta_description: bool = True) -> list[dict]:
    """A page as a document: its language beside title and content, description and links among the fields."""
    page = extract(decode_html(data, charset))
    if page is None:
        return []
    fields = {"description": page["description"]} if include_meta_description and page["description"] else {}
    if extract_links:
        fields["links"] = page["links"]
    return [{"title": page["title"], "content": page["content"], "language": page["language"], "fields": json.dumps(fields, ensure_ascii=False, separators=(",", ":"), sort_keys=True) if fields else None}]


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds title, content, language, description and links; pages without text and title go."""
    # pickled, a batch is 100 pages of any size (an Arrow batch is 10,000); nondeterministic, else the filter reads every page once more
    once = F.udf(extract, PAGE, useArrow=False).asNondeterministic()
    return pages.withColumn("page", once(F.col(html))).where("page is not null").select(*[c for c in pages.columns if c != html], "page.*")
