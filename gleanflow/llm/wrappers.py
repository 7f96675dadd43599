"""Main text of HTML pages by wrappers that are inferred per host.

A page is a stream of tags and texts. Texts become slots, and equal neighbouring groups of tags fold into one
repeated group, so pages of one template have few different skeletons. The skeletons of a host are aligned one after
the other: where two differ, what only one of them has becomes an optional group, and a group that one of them repeats
becomes a repeated group. The result is one expression without unions: the host's wrapper. Behind each of its paths
the host's different texts are counted, a text once however many pages have it, so what the template says on every page weighs
next to nothing and what varies counts in full. The region is the deepest path of the wrapper that holds most of the host's
varying text, and the article of a page is what lies there, or the element around it that is named as an article or main part.
A page that lacks the path goes by its own named element or as a whole. Menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and comments of readers are left out wherever they stand.

Pages are reduced to counted skeletons inside tasks. A host's different skeletons are aligned in rounds, in each of which a
task takes a bounded number of them, so a host may own any share of the pages and have any number of skeletons.

Defined cases: a null or empty page has the empty text; a url without host is a host of its own; repeated pages give
repeated rows; markup that is never closed is closed by its parent; an empty table gives no rows; other columns of the input
are not looked at.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanflow.llm.common import staged, table

# Patterns of a host that one task aligns, about.
AT_ONCE = 256
# The share of a host's text that its article region holds at least. Over one half, so that each depth has one such path.
SHARE = 0.7
# Elements below so many open ones belong to the last of these; their breaks between blocks stay.
DEEP = 150
# Cells of an alignment table; longer lists are cut at their common unique marks first.
CELLS = 1_000_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
SPACE = re.compile(r"\s+")

# Fixed values of HTML: elements without content, with raw content, without a line of their own, implied ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLING_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
SCOPES = frozenset("html body article main section div nav aside header footer form ul ol dl table td th blockquote".split())
# What is never part of the article: elements, roles, and words of classes and ids.
LEFT_OUT = frozenset(
    "head nav header footer aside form script style noscript template iframe button select textarea title menu dialog svg math "
    "object embed canvas audio video map fieldset input label".split()
)
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner menu nav navbar "
    "navigation breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay subscribe newsletter signup login share sharing social comment "
    "comments disqus replies respond related recommended pagination pager toolbar skip hidden".split()
)
REGION_ROLES = frozenset(("main", "article"))


class Node:
    """An element with its children in page order; texts are strings."""

    __slots__ = ("tag", "mark", "children", "out", "named", "lent")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.children, self.lent = tag, [], False
        self.mark, self.out, self.named = tag, tag in LEFT_OUT, tag in ("article", "main")
        if attributes and "=" in attributes or " hidden" in attributes:
            found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
            names = [w for key in ("class", "id") for w in re.split(r"[^a-z0-9]+", found.get(key, "").lower()) if w]
            role = found.get("role", "").lower()
            self.named = self.named or role in REGION_ROLES
            self.out = (
                self.out
                or role in LEFT_OUT_ROLES
                or "hidden" in found
                or found.get("aria-hidden", "").lower() == "true"
                or (tag not in ("html", "body", "article", "main") and not LEFT_OUT_WORDS.isdisjoint(names))
            )
            words = [w for w in names if not any(c.isdigit() for c in w)]
            if words:
                self.mark = tag + "." + ".".join(words)


def parsed(page: str) -> Node:
    """The page as a tree."""
    root = Node("", "")
    open_ = [root]
    at, size = 0, len(page)

    def text(raw: str) -> None:
        if raw:
            open_[-1].children.append(raw)

    def close(names, stop=SCOPES) -> None:
        for depth in range(len(open_) - 1, 0, -1):
            if open_[depth].tag in names:
                if open_[depth].lent and open_[depth].tag not in INLINE:
                    open_[depth].children.append(Node("div", ""))
                del open_[depth:]
                return
            if open_[depth].tag in stop:
                return

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            close({tag}, () if tag in SCOPES else SCOPES - {tag})
            continue
        if tag in ENDS_PARAGRAPH:
            close({"p"})
        if tag in SIBLING_ENDS:
            close(SIBLING_ENDS[tag], {"ul", "ol", "dl", "table", "select"})
        node, parent = Node(tag, m[3] or ""), open_[-1]
        node.out = node.out or parent.out
        if len(open_) >= DEEP and (parent.out or not node.out):
            # It keeps its place among the open elements but gives no further level; an empty block marks where it begins and ends.
            node.children, node.lent = parent.children, True
            if tag not in INLINE:
                parent.children.append(Node("div", ""))
        else:
            parent.children.append(node)
        if tag in VOID or (m[3] or "").endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        open_.append(node)
    return root


# --- skeletons ------------------------------------------------------------------------------
# A pattern is a list of items: "#" for a text slot or [mark, kind, inner pattern], where kind is
# "1" (once), "?" (optional), "+" (repeated) or "*" (both).


def repeats(keys: list[int], size: int) -> bool:
    """True if some group of ``size`` is followed by its like."""
    if len(keys) > 64:
        row = np.array(keys)
        same = np.flatnonzero(np.concatenate(([True], row[size:] != row[:-size], [True])))
        return bool((np.diff(same) > size).any())
    run = 0
    for a, b in zip(keys, keys[size:], strict=False):
        run = run + 1 if a == b else 0
        if run == size:
            return True
    return False


def folded(items: list) -> list:
    """Equal neighbouring groups as one repeated group, shortest groups first."""
    known: dict[str, int] = {}
    number = lambda some: [known.setdefault(json.dumps(x), len(known)) for x in some]
    size, keys = 1, number(items)
    while 2 * size <= len(items):
        if not repeats(keys, size):
            size += 1
            continue
        out, at = [], 0
        while at < len(items):
            group = items[at : at + size]
            times = 1
            while len(group) == size and items[at + times * size : at + (times + 1) * size] == group:
                times += 1
            if times > 1 and not (size == 1 and group[0] == "#"):
                out += [[g[0], "+" if g[1] in "1+" else "*", g[2]] if g != "#" else g for g in group]
                at += times * size
            elif times > 1:
                out.append("#")
                at += times
            else:
                out.append(items[at])
                at += 1
        items, keys = out, number(out)
        size += 1
    return items


def skeleton(node: Node) -> list:
    """The pattern of a node's content; inline elements are part of the text around them."""
    items: list = []
    for child in node.children:
        if isinstance(child, str):
            if child.strip() and (not items or items[-1] != "#"):
                items.append("#")
        elif child.tag in INLINE:
            if skeleton(child) and (not items or items[-1] != "#"):
                items.append("#")
        elif child.tag not in RAW and child.tag not in VOID:
            items.append([child.mark, "1", skeleton(child)])
    return folded(items)


def kinds(a: str, b: str) -> str:
    optional, repeated = a in "?*" or b in "?*", a in "+*" or b in "+*"
    return "*" if optional and repeated else "?" if optional else "+" if repeated else "1"


def head(item) -> str:
    return item if item == "#" else item[0]


def optional(item):
    return item if item == "#" else [item[0], kinds(item[1], "?"), item[2]]


def aligned(a: list, b: list) -> list:
    """One pattern for both: a longest common sequence is matched, the rest becomes optional, repeats are kept."""
    if a == b:
        return a
    n, m = len(a), len(b)
    if n * m > CELLS:
        return joined(sum((aligned(x, y) for x, y in cut_at_unique(a, b)), []))
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if head(a[i]) == head(b[j]) else max(best[i + 1][j], best[i][j + 1])
    out: list = []
    i = j = 0
    while i < n and j < m:
        if head(a[i]) == head(b[j]):
            out.append("#" if a[i] == "#" else [a[i][0], kinds(a[i][1], b[j][1]), aligned(a[i][2], b[j][2])])
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    out += [optional(x) for x in [*a[i:], *b[j:]]]
    return joined(out)


def cut_at_unique(a: list, b: list) -> list[tuple[list, list]]:
    """Parts that belong together, cut at marks that either list has once, in an order that both share.

    A pair that has no such mark and is too large for a table is taken to share nothing.
    """
    ones = []
    for heads in ([head(x) for x in some] for some in (a, b)):
        times = Counter(heads)
        ones.append({h: i for i, h in enumerate(heads) if times[h] == 1})
    pairs = sorted((i, ones[1][h]) for h, i in ones[0].items() if h in ones[1])
    # The longest run of pairs that rises on both sides.
    tops, ends, before = [], [], []
    for at, (_, j) in enumerate(pairs):
        place = bisect_left(tops, j)
        before.append(ends[place - 1] if place else -1)
        tops[place : place + 1], ends[place : place + 1] = [j], [at]
    chain, at = [], ends[-1] if ends else -1
    while at >= 0:
        chain.append(pairs[at])
        at = before[at]
    parts, i, j = [], 0, 0
    for x, y in [*reversed(chain), (len(a), len(b))]:
        left, right = a[i:x], b[j:y]
        parts += [(left, [])] + [([], right)] if len(left) * len(right) > CELLS else [(left, right)]
        parts.append((a[x : x + 1], b[y : y + 1]))
        i, j = x + 1, y + 1
    return parts


def joined(items: list) -> list:
    """Neighbours of the same mark become one repeated group."""
    out: list = []
    for item in items:
        if out and head(out[-1]) == head(item):
            if item != "#":
                out[-1] = [item[0], kinds(kinds(out[-1][1], item[1]), "+"), aligned(out[-1][2], item[2])]
        else:
            out.append(item)
    return out


# --- regions --------------------------------------------------------------------------------


def slots(node: Node, path: str = "") -> Iterator[tuple[str, str]]:
    """Texts of the elements that may hold the article, by path of marks."""
    for child in node.children:
        if isinstance(child, str):
            if text := child.strip():
                yield path, text
        elif not child.out:
            yield from slots(child, path if child.tag in INLINE else f"{path}/{child.mark}")


def region_of(wrapper: list, heavy: set[str]) -> str:
    """The path whose content is the article: the deepest one that still holds most of the host's text (is in ``heavy``)."""
    path, items = "", wrapper
    while True:
        item = next((i for i in items if i != "#" and f"{path}/{i[0]}" in heavy), None)
        # A repeated group is a part of the article and not the article.
        if item is None or item[1] in "+*":
            return path
        path, items = f"{path}/{item[0]}", item[2]


# --- text -----------------------------------------------------------------------------------


def blocks(nodes: list) -> list[str]:
    """Texts of the blocks below ``nodes`` in page order, inline parts joined."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(line))).strip()
        line.clear()
        if text:
            out.append(text)

    def walk(node) -> None:
        if isinstance(node, str):
            line.append(node)
        elif node.out:
            if node.tag not in INLINE:
                flush()
        elif node.tag == "br":
            line.append(" ")
        elif node.tag in INLINE:
            for child in node.children:
                walk(child)
        else:
            flush()
            for child in node.children:
                walk(child)
            flush()

    for node in nodes:
        walk(node)
    flush()
    return out


def named_regions(node: Node) -> list[Node]:
    """Outermost articles, or else main parts, outside of what is left out."""
    found: list[Node] = []

    def walk(at: Node, want) -> None:
        for child in at.children:
            if isinstance(child, str) or child.out:
                continue
            if want(child):
                found.append(child)
            else:
                walk(child, want)

    walk(node, lambda n: n.tag == "article")
    if not found:
        walk(node, lambda n: n.named)
    return found


def at_path(node: Node, path: str) -> list[Node]:
    """Elements at a region's path, or the outermost named ones on the way there."""
    found, ends = [node], []
    for mark in path.split("/")[1:]:
        found = [c for n in found for c in n.children if not isinstance(c, str) and c.mark == mark and not c.out]
        ends += [n for n in found if n.named]
        found = [n for n in found if not n.named]
    return ends + found


def article_text(page: str | None, region: str) -> str:
    tree = parsed(page or "")
    found = [b for n in at_path(tree, region) for b in blocks(n.children)] if region else []
    if not found:
        # A page of another build than its host's wrapper.
        found = [b for n in named_regions(tree) or [tree] for b in blocks(n.children)]
    return "\n\n".join(found)


# --- jobs -----------------------------------------------------------------------------------


def host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_facts(pages: DataFrame) -> DataFrame:
    """``host, skeleton, path, text, n``: pages of each skeleton, and the length ``n`` of each text behind a path (skeleton null).

    A text stands for itself by a hash, so it counts once for a path of a host. Equal ones meet inside the batch, then in a
    partial aggregation.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, int] = {}
            for name, page in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                tree = parsed(page or "")
                key = (name, json.dumps(skeleton(tree)), None, None)
                seen[key] = seen.get(key, 0) + 1
                for path, text in slots(tree):
                    seen[name, None, path, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1] = len(text)
            columns = zip(*((*key, n) for key, n in seen.items()), strict=True) if seen else ([],) * 5
            kinds_ = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            names = ["host", "skeleton", "path", "text", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds_, strict=True)], names)

    found = pages.select(host("url").alias("host"), "html").mapInArrow(
        of, "host string, skeleton string, path string, text long, n long"
    )
    total = F.when(F.col("skeleton").isNull(), F.max("n")).otherwise(F.sum("n"))
    return found.groupBy("host", "skeleton", "path", "text").agg(total.alias("n"))


def merged(rows: pa.Table) -> pa.Table:
    """All patterns of a group aligned, those with most pages first."""
    entries = sorted(rows.to_pylist(), key=lambda r: (-r["pages"], r["skeleton"]))
    patterns = [json.loads(skeleton_) for skeleton_ in dict.fromkeys(e["skeleton"] for e in entries)]
    row = {
        "host": entries[0]["host"],
        "skeleton": json.dumps(reduce(aligned, patterns)),
        "pages": sum(e["pages"] for e in entries),
    }
    return pa.Table.from_pylist([row], rows.select(["host", "skeleton", "pages"]).schema)


def host_patterns(rows: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """One row ``host, skeleton, pages`` for each host: in each round a task aligns about ``at_once`` patterns of a host."""
    while True:
        most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        part = F.pmod(F.xxhash64("skeleton"), F.lit(max(1, -(-most // at_once))))
        parts = rows.groupBy("host", part.alias("_part"))
        rows = staged(parts.applyInArrow(merged, "host string, skeleton string, pages long"))
        if most <= at_once:
            return rows


def wrappers(pages: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """``host, wrapper`` (the expression as JSON), ``pages`` and ``region`` for every host of ``url, html``."""
    facts = staged(page_facts(pages))
    patterns = host_patterns(facts.where(F.col("path").isNull()).select("host", "skeleton", F.col("n").alias("pages")), at_once)
    texts = facts.where(F.col("path").isNotNull()).groupBy("host", "path").agg(F.sum("n").alias("n"))
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    sizes = texts.select("host", F.explode(prefixes).alias("path"), "n").groupBy("host", "path").agg(F.sum("n").alias("n"))
    totals = sizes.where("path = ''").select("host", F.col("n").alias("total"))
    # At most one path of each depth holds more than half of the text, so these lists are short.
    heavy = (
        sizes.join(totals, "host").where(F.col("n") >= SHARE * F.col("total")).groupBy("host").agg(F.collect_list("path").alias("paths"))
    )

    @F.pandas_udf("string")
    def region(wrapper: pd.Series, paths: pd.Series) -> pd.Series:
        found = [region_of(json.loads(w), set() if p is None else set(p)) for w, p in zip(wrapper, paths, strict=True)]
        return pd.Series(found, dtype=object)

    return patterns.join(heavy, "host", "left").select(
        "host", F.col("skeleton").alias("wrapper"), "pages", region("skeleton", "paths").alias("region")
    )


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages``."""
    # Hosts share few regions, so these travel as a narrow column and pages of a large host need no place together.
    regions = staged(wrappers(pages).select("host", "region"))

    @F.pandas_udf("string")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, region in batches:
            yield pd.Series([article_text(h, r or "") for h, r in zip(html, region, strict=True)], dtype=object)

    rows = pages.select("page_id", "url", "html", host("url").alias("host")).join(regions, "host", "left")
    return rows.select("page_id", "url", extract("html", "region").alias("text"))


def op9_wrapper_text(spark, sf_dir):
    return main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
