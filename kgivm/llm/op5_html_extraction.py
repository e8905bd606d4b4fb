"""Main text of web pages by site template removal.

Every page is parsed into elements whose subtrees (tag, attributes, text,
children) are hashed. Spark counts, per host, on how many pages a subtree
stands; subtrees on many pages of a host are template and are deleted from the
whole page. Only then are the page's articles looked for in what is left (the
whole body on pages without one), and elements that are furniture by their tag,
role or class (menus, forms, comments, adverts ...) go too: that complements the
counts where a host has few pages or a box differs from page to page.

A subtree is template if it stands on ``min_pages`` pages and ``min_percent`` of
its host's; on smaller hosts, on ``FEW_PAGES`` and ``FEW_PERCENT`` of them.

Inside an article, paragraphs, headings, lists, quotes and tables are content
even when many pages carry them (copies of one article on a host are no
template); other boxes there fall under the same counts.

Null and empty pages have an empty text. Counting uses distinct pages by
content, rows are answered one by one, so repeated rows agree and count once.
A page without url belongs to the host ''. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgivm.llm import scratch

MIN_PAGES, MIN_PERCENT = 10, 5
FEW_PAGES, FEW_PERCENT = 3, 60
RAW = "script|style|noscript|template|iframe|object|svg|textarea|select|title"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*+(?:>|\Z).*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|<[!?/](?![A-Za-z])[^>]*+(?:>|\Z)|<![^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))",
    re.S | re.I,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li legend main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption b i em strong a span code sub sup small br img u s q cite mark time abbr".split())
FURNITURE = frozenset("nav footer aside form button head dialog menu input".split())
CLOSES_P = BLOCK - {"br", "body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|notification|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|sidebar|side-bar|widget\w*"
    r"|nav\w*|menu\w*|breadcrumb\w*|pagination|pager|masthead|site-header|page-header|footer|comment\w*|disqus\w*|respond|reply|replies|share\w*|sharing|social|related|recommend\w*|toolbar|skip-link)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())


class Page:
    """Elements and texts of a page in document order; ``end[i]`` is the first index after the subtree of i."""

    def __init__(self, source: str):
        self.tag, self.body, self.end, self.up = ["#root"], [""], [0], [-1]
        open_ = [0]
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self._add("#text", source[at : m.start()], open_)
            at = m.end()
            name = m[3]
            if name is None:
                continue
            name = name.lower()
            if m[2]:
                self._close(name, open_)
                continue
            if not m[4].endswith(">"):
                continue  # the page ends inside a tag
            if name in CLOSES_P:
                self._close("p", open_, "p")
            elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self._close(name, open_, name)
            self._add(name, m[4], open_)
            if name not in VOID and not m[4].endswith("/>"):
                open_.append(len(self.tag) - 1)
        if at < len(source):
            self._add("#text", source[at:], open_)
        for i in open_:
            self.end[i] = len(self.tag)

    def _add(self, tag: str, body: str, open_: list[int]) -> None:
        self.tag.append(tag)
        self.body.append(body)
        self.end.append(len(self.tag))
        self.up.append(open_[-1])

    def _close(self, name: str, open_: list[int], until: str | None = None) -> None:
        """Close the innermost open element of that name; an implied end does not reach through other boxes."""
        for k in range(len(open_) - 1, 0, -1):
            tag = self.tag[open_[k]]
            if tag == name:
                for i in open_[k:]:
                    self.end[i] = len(self.tag)
                del open_[k:]
                return
            if until and tag in BLOCK:
                return

    def furniture(self, i: int, in_article: bool) -> bool:
        tag = self.tag[i]
        if tag in FURNITURE or tag == "header" and not in_article:
            return True
        if "=" not in self.body[i] or tag in ("html", "body"):
            return False
        for m in ATTRIBUTE.finditer(self.body[i]):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id") and MARKED.search(value) or name == "role" and value.lower() in ROLES or name in ("hidden", "aria-hidden") and value.lower() != "false":
                return True
        return False

    def template(self, template: frozenset[int]) -> set[int]:
        """The elements that are template."""
        if not template:
            return set()
        prints = self.prints()
        return {i for i in self.boxes(self.roots(set())) if prints[i] in template}

    def roots(self, gone: set[int]) -> list[int]:
        """The page's articles (else its main part, else all of it), without template and furniture."""
        found: dict[str, list[int]] = {"article": [], "main": []}
        i = 0
        while i < len(self.tag):
            tag = self.tag[i]
            if i in gone or tag[0] != "#" and tag not in ("html", "body") and self.furniture(i, False):
                i = self.end[i]
                continue
            if tag == "article":
                found["article"].append(i)
                i = self.end[i]
                continue
            if tag == "main" or 'role="main"' in self.body[i]:
                found["main"].append(i)
            i += 1
        main = found["main"][:1]
        return found["article"] or main or [0]

    def prints(self) -> list[int]:
        """A 64-bit hash of every subtree, from prefix hashes over the tokens."""
        base, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
        sums, power = [0], [1]
        for i, (tag, body) in enumerate(zip(self.tag, self.body)):
            depth = self.end[i] - i
            h = xxhash.xxh64_intdigest(f"{tag}\x00{depth}\x00{' '.join(body.split())}")
            sums.append((sums[-1] * base + h) & mask)
            power.append((power[-1] * base) & mask)
        return [(sums[e] - sums[i] * power[e - i]) & mask for i, e in enumerate(self.end)]

    def boxes(self, roots: list[int]) -> list[int]:
        """Elements that may be template: all but the roots' ancestors and what is content inside an article."""
        if roots == [0]:
            return [i for i in range(1, len(self.tag)) if self.tag[i][0] != "#" and self.tag[i] not in ("html", "body", "br")]
        keep = set()
        for r in roots:
            while r >= 0:
                keep.add(r)
                r = self.up[r]
        out, i, r = [], 1, 0
        while i < len(self.tag):
            while r < len(roots) and self.end[roots[r]] <= i:
                r += 1
            tag = self.tag[i]
            inside = r < len(roots) and roots[r] < i
            if inside and tag in CONTENT:
                i = self.end[i]
                continue
            if tag[0] != "#" and i not in keep and tag != "br":
                out.append(i)
            i += 1
        return out

    def text(self, template: frozenset[int], lists: bool = True) -> str:
        """What is left without template; ``lists``: and without what only tags, roles and classes tell."""
        return self.rest(self.template(template), lists)

    def rest(self, gone: set[int], lists: bool = True) -> str:
        roots = self.roots(gone) if lists else [0]
        blocks, now = [], []

        def flush():
            if now:
                line = " ".join("".join(now).split())
                if line:
                    blocks.append(line)
                now.clear()

        for root in roots:
            flush()
            i, stop = root, self.end[root]
            closing: list[int] = []
            inside = root != 0
            while i < stop:
                while closing and closing[-1] <= i:
                    closing.pop()
                    flush()
                tag = self.tag[i]
                if tag == "#text":
                    now.append(entities.unescape(self.body[i]) if "&" in self.body[i] else self.body[i])
                elif tag != "#root" and i != root and (i in gone or lists and self.furniture(i, inside)):
                    if tag in BLOCK:
                        flush()
                    i = self.end[i]
                    continue
                elif tag in BLOCK:
                    flush()
                    closing.append(self.end[i])
                i += 1
            flush()
        return "\n".join(blocks)


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def template_counts(pages: DataFrame, *, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_percent: int = MIN_PERCENT) -> tuple[DataFrame, DataFrame]:
    """(content, host, hash) of all distinct pages' elements, and the (host, hash) that are template."""
    src = pages.select(F.xxhash64(url, html).alias("content"), _host(url).alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))

    def hashes(batches):
        for batch in batches:
            out = []
            for source in batch.column(2).to_pylist():
                page = Page(source)
                prints = page.prints()
                out.append(sorted({prints[i] - (1 << 63) for i in page.boxes(page.roots(set()))}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["content", "host", "hashes"])

    found = scratch.saved(src.mapInArrow(hashes, "content long, host string, hashes array<long>"))
    total = found.groupBy("host", "content").count().groupBy("host").agg(F.count("*").alias("pages"))
    stands = found.select("host", "content", F.explode("hashes").alias("hash"))
    # copies of a page (same address and source) count once: rows of one content go together before the count
    per_hash = stands.groupBy("host", "hash").agg(F.count("*").alias("rows"))
    maybe = per_hash.where(F.col("rows") >= min(min_pages, FEW_PAGES))
    exact = stands.join(maybe.select("host", "hash"), ["host", "hash"], "left_semi").distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    often = lambda least, percent: (F.col("n") >= least) & (100 * F.col("n") >= percent * F.col("pages"))
    many = exact.join(total, "host").where(often(min_pages, min_percent) | often(FEW_PAGES, FEW_PERCENT))
    return stands, many.select("host", "hash")


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", **options) -> DataFrame:
    """``key``, ``url``, text, n_chars and n_template (template subtrees deleted) of every row.

    A subtree is template on min_percent of its host's pages at least, so a host
    has no more than 100 / min_percent times its mean number of boxes: one row
    of hashes for each host, which the pages are joined with (Spark sends it to
    the tasks if it is small).
    """
    _, template = template_counts(pages, url=url, html=html, **options)
    lists = scratch.saved(template.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("hashes")))
    src = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"), _host(url).alias("host"))
    kind, url_kind = (src.schema[c].dataType.simpleString() for c in ("k", "u"))
    rows = src.join(lists, "host", "left").select("k", "u", "html", "host", "hashes")

    def read(batches):
        known: dict[str, frozenset[int]] = {}
        for batch in batches:
            out, gone = [], []
            for source, host, hashes in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if host not in known:
                    known[host] = frozenset(h + (1 << 63) for h in hashes or ())
                page = Page(source)
                template = page.template(known[host])
                out.append(page.rest(template))
                gone.append(len(template))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64()), pa.array(gone, pa.int64())], ["k", "u", "text", "n_chars", "n_template"])

    got = rows.mapInArrow(read, f"k {kind}, u {url_kind}, text string, n_chars long, n_template long")
    return got.withColumnsRenamed({"k": key, "u": url})


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
