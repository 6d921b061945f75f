"""Main text of web pages.

A page's candidates are the blocks of its article, if it says where that is (``article``, ``main`` or
role=main), else all its blocks, in both cases without what is marked as menu, header, footer, side matter,
notice, advert, form, script, style or comments. Candidates of each page are one token stream; strings that
recur on unlike pages of a host are found with suffix arrays, and a block that they cover for the greater part
is boilerplate, with one exact check: a block inside a marked article goes only if another page of the host
has it outside of its article. Articles share paragraphs (copies, versions, wire reports), and what only
articles share is text of articles.

Structure finds the candidates because a host's suffix array alone isn't right: boilerplate that is written
anew for each page isn't repeated. Pages with the same candidates are one page, so an article that a host
serves under two addresses isn't boilerplate of itself.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketframe.llm.native import small
from ketframe.llm.suffix_dedup import lost_bytes, met_elsewhere, repeated_runs
from ketframe.session import saved, ship

#: Elements whose content is no text of the page, and those that are no main text (fixed lists of HTML names).
_RAW = {"script", "style", "template", "iframe", "textarea", "title"}
_ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Words of class and id names, and roles, that mark what isn't main text (fixed list).
_MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|sidebar|side-bar|footer|header|masthead|cookie\w*|consent|notice|gdpr|popup|modal|newsletter|subscribe|comments?|commentlist|disqus|replies|reply|respond|toolbar|pagination|pager)(?:$|[\s_-])", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar"}
#: A comment, a declaration, or a tag; attribute values may hold ">".
_MARKUP = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: A start tag of one of these ends an open p; headings and the like (fixed list).
_ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def _unwanted(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    if tag in _ASIDE and not (tag == "header" and in_main):
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in _ROLES:
        return True
    return tag not in ("body", "html", "article", "main") and bool(_MARKED.search(attributes.get("class", "")) or _MARKED.search(attributes.get("id", "")))


def blocks(page: str) -> tuple[bool, list[str]]:
    """Whether the page says where its article is; and the blocks of it, else all that isn't marked as something else."""
    return parted(page)[:2]


def parted(page: str) -> tuple[bool, list[str], list[str]]:
    """The same, and the blocks that are left out."""
    main: list[str] = []
    rest: list[str] = []
    aside: list[str] = []
    words: list[str] = []  # of the block that is open
    others: list[str] = []  # of what is left out
    stack: list[tuple[str, bool, bool]] = []  # tag, unwanted from here, main from here
    out, inside, at, size, found = False, False, 0, len(page), False

    def close() -> None:
        for some, to in ((words, main if inside else rest), (others, aside)):
            if some:
                text = " ".join(html.unescape("".join(some)).split())
                some.clear()
                if text:
                    to.append(text)

    def pop_to(n: int) -> None:
        nonlocal out, inside
        del stack[n:]
        out, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    while at < size:
        m = _MARKUP.search(page, at)
        if m is None or m.end() == m.start():
            (others if out else words).append(page[at:])
            break
        if m.start() > at:
            (others if out else words).append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            n = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag not in _INLINE:
                close()
            # an end tag of inline markup never ends a block around it
            if n is not None and not (tag in _INLINE and any(t not in _INLINE for t, _, _ in stack[n + 1 :])):
                pop_to(n)
            continue
        if tag not in _INLINE or tag == "br":
            close()
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in _ENDS_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            ends = "p" if tag in _ENDS_P else tag
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == ends:
                    pop_to(i)
                    break
                if stack[i][0] not in _INLINE and stack[i][0] != "p":
                    break
        if m[3].rstrip().endswith("/") and tag not in _INLINE and tag not in _ENDS_P:
            continue
        attributes = _attributes(m[3])
        starts = tag in ("article", "main") or attributes.get("role", "").lower() == "main"
        bad = out or _unwanted(tag, attributes, inside)
        found = found or (starts and not bad)
        stack.append((tag, bad, inside or (starts and not bad)))
        out, inside = bad, stack[-1][2]
    close()
    return (True, main, rest + aside) if found else (False, rest, aside)


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def main_text(pages: DataFrame, span: int = 120, gram: int = 40, page_id: str = "page_id", url: str = "url", content: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages``.

    A null or empty page has an empty text. Pages lose blocks that lie for the greater part in strings of
    ``span`` bytes which unlike pages of their host have too; of a marked article only blocks of ``span`` bytes
    or more that another page of the host has outside of its article. Repeated rows each give a row (of one page: they
    aren't boilerplate of each other). Other columns aren't read.
    """
    ship(pages.sparkSession)
    digest = lambda t: hashlib.blake2b(t.encode(), digest_size=16).digest()

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p, u, h in zip(part["page_id"], part["url"], part["html"], strict=True):
                marked, found, others = parted(h or "")
                aside = [digest(t) for t in dict.fromkeys(others) if len(t.encode()) >= span]
                rows.append((None if pd.isna(p) else int(p), u, host_of(u), marked, found, aside))
            out = pd.DataFrame(rows, columns=["page_id", "url", "host", "marked", "blocks", "aside"])
            yield out.astype({"page_id": "Int64", "marked": bool})

    source = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(content).cast("string").alias("html"))
    parsed = source.mapInPandas(read, "page_id long, url string, host string, marked boolean, blocks array<string>, aside array<binary>")
    parsed = saved(parsed.withColumn("row", F.monotonically_increasing_id()), "parsed_pages", "zstd")

    # marked articles are compared with marked ones, other pages with others; pages of one key are one page
    key, scope = ["key_id", "key_text"], F.xxhash64("host", "marked")
    named = parsed.select(scope.alias("key_id"), F.xxhash64("blocks").alias("key_text"), F.xxhash64("host").alias("site"), "*")
    text = F.array_join("blocks", "\n").alias("text")
    copies = saved(named.groupBy(*key).agg(F.count(F.lit(1)).alias("times"), F.min("row").alias("one")).filter("times > 1").drop("times"), "page_copies")
    once = named.join(small(copies, 24), key, "left").filter("one is null or one = row").select(*key, F.col("key_id").alias("scope"), "site", "marked", "blocks", text)
    shared, met = met_elsewhere(once, span, gram)
    some = once.join(small(met, 16), key, "left_semi")
    lost = repeated_runs(some.select(*key, "scope", "text"), span, gram, places=False, shared=shared)

    def covered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, t, site, marked, texts, runs in zip(*(part[c] for c in ("key_id", "key_text", "site", "marked", "blocks", "lost")), strict=True):
                sizes = [len(x.encode()) for x in texts]
                gone, at = lost_bytes(sum(sizes) + len(sizes), [r["a"] for r in runs], [r["b"] for r in runs]), 0
                for place, (x, n) in enumerate(zip(texts, sizes, strict=True)):
                    if 2 * gone[at : at + n].sum() > n:
                        rows.append((k, t, site, marked, place, digest(x)))
                    at += n + 1
            yield pd.DataFrame(rows, columns=[*key, "site", "marked", "place", "digest"])

    found = some.join(small(saved(lost, "lost_pages"), 16 + 16 * F.size("lost")), key).select(*key, "site", "marked", "blocks", "lost").mapInPandas(covered, "key_id long, key_text long, site long, marked boolean, place int, digest binary")
    found = saved(found, "repeated_blocks")
    outside = named.select("site", "key_text", F.explode("aside").alias("digest")).groupBy("site", "digest").agg(F.min("key_text").alias("k0"), F.max("key_text").alias("k1"))
    sure = found.filter("marked").join(outside, ["site", "digest"]).filter("k0 <> key_text or k1 <> key_text")
    gone = found.filter("not marked").select(*key, "place").union(sure.select(*key, "place")).groupBy(*key).agg(F.collect_set("place").alias("places"))
    gone = saved(gone, "boilerplate")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("blocks") - 1), "places"), lambda i: F.get("blocks", i))
    done = named.join(small(gone, 24 + 4 * F.size("places")), key, "left")
    done = done.select("page_id", "url", F.array_join(F.when(F.col("places").isNull(), F.col("blocks")).otherwise(left), " ").alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
