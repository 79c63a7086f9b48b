"""Pages to tables of DOM nodes and text strings: each page is parsed once, in Arrow batches."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
NODES = (
    "page_id long, ord int, parent_ord int, xpath string, tag string, text string, tail string, depth int, ancestor_tags array<string>, "
    "attrs map<string,string>, subtree_hash string, is_leaf boolean"
)


class Tree(HTMLParser):
    """Elements in document order with their own leading text and tails. Comments vanish."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.attrs: list[dict[str, str]] = []
        self.texts: list[list[str]] = []
        self.tails: list[list[str]] = []
        self.children: list[list[int]] = []
        self.stack: list[int] = []
        self.last: list[int] = []  # per open element its last closed child, -1 before the first

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.stack and tag in CLOSED_BY.get(self.tags[self.stack[-1]], ()):
            self._close()
        scope = SCOPES.get(tag)
        if scope and any(self.tags[i] == tag for i in self.stack):
            inner = next((i for i in reversed(self.stack) if self.tags[i] == tag or self.tags[i] in scope), None)
            if inner is not None and self.tags[inner] == tag:
                while self.stack[-1] != inner:
                    self._close()
                self._close()
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self.stack[-1] if self.stack else -1)
        self.attrs.append({k: v or "" for k, v in attrs})
        self.texts.append([])
        self.tails.append([])
        self.children.append([])
        if self.stack:
            self.children[self.stack[-1]].append(node)
        self.stack.append(node)
        self.last.append(-1)
        if tag in VOID:
            self._close()

    def _close(self) -> None:
        node = self.stack.pop()
        self.last.pop()
        if self.last:
            self.last[-1] = node

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID and any(self.tags[i] == tag for i in self.stack):
            while self.tags[self.stack[-1]] != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        if self.stack:
            (self.texts[self.stack[-1]] if self.last[-1] < 0 else self.tails[self.last[-1]]).append(data)


def read_tree(page: str) -> Tree:
    tree = Tree()
    tree.feed(page)
    tree.close()
    return tree


def parse(page: str) -> list[dict]:
    """Nodes of a page in document order; siblings of one tag get an index only if there are several."""
    tree = read_tree(page)
    n, out = len(tree.tags), []
    paths, ancestors, depths = [""] * n, [[] for _ in range(n)], [0] * n
    roots = [i for i in range(n) if tree.parents[i] < 0]
    for siblings in (roots, *tree.children):
        many, seen = Counter(tree.tags[i] for i in siblings), Counter()
        for i in siblings:
            seen[tree.tags[i]] += 1
            paths[i] = "/" + tree.tags[i] + (f"[{seen[tree.tags[i]]}]" if many[tree.tags[i]] > 1 else "")
    for i in range(n):
        if (p := tree.parents[i]) >= 0:
            paths[i], ancestors[i], depths[i] = paths[p] + paths[i], [*ancestors[p], tree.tags[p]], depths[p] + 1
    hashes = [""] * n
    for i in reversed(range(n)):
        body = repr((tree.tags[i], "".join(tree.texts[i]), sorted(tree.attrs[i].items()), [(hashes[c], "".join(tree.tails[c])) for c in tree.children[i]]))
        hashes[i] = hashlib.md5(body.encode("utf-8", "surrogatepass")).hexdigest()
    for i in range(n):
        out.append({
            "ord": i, "parent_ord": tree.parents[i] if tree.parents[i] >= 0 else None, "xpath": paths[i], "tag": tree.tags[i], "text": "".join(tree.texts[i]) or None,
            "tail": "".join(tree.tails[i]) or None, "depth": depths[i], "ancestor_tags": ancestors[i], "attrs": list(tree.attrs[i].items()), "subtree_hash": hashes[i],
            "is_leaf": not tree.children[i]})
    return out


SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("ord", pa.int32()), ("parent_ord", pa.int32()), ("xpath", pa.string()), ("tag", pa.string()), ("text", pa.string()), ("tail", pa.string()),
    ("depth", pa.int32()), ("ancestor_tags", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("subtree_hash", pa.string()), ("is_leaf", pa.bool_())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[dict] = []
        for page_id, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows += [{"page_id": page_id, **node} for node in parse(page)] if page else []
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, SCHEMA)


def nodes(pages: DataFrame) -> DataFrame:
    """Node table of pages (page_id, html); null and empty pages have no nodes. Pages must be distinct."""
    return pages.select("page_id", "html").mapInArrow(_parse, NODES)


def text_nodes(table: DataFrame) -> DataFrame:
    """Elements with own leading text: no style, no path with 'select', no literal 'none'."""
    bare = F.trim(F.regexp_replace("text", r"\s+", " "))
    return table.filter((bare != "") & (F.lower(bare) != "none") & ~F.contains("xpath", F.lit("select")) & (F.col("tag") != "style"))


def text_strings(table: DataFrame) -> DataFrame:
    """(page_id, ord, text): all strings of a page, tails included, without script and style, longer than one character."""
    shown = ~F.col("tag").isin("script", "style")
    both = F.array(F.when(shown, F.col("text")), F.col("tail"))
    inside = ~F.exists("ancestor_tags", lambda t: t.isin("script", "style"))
    rows = table.filter(inside).select("page_id", "ord", F.explode(F.array_compact(both)).alias("text"))
    return rows.select("page_id", "ord", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")).filter(F.length("text") > 1)


def leaves(table: DataFrame) -> DataFrame:
    return table.filter("is_leaf")


def by_name(table: DataFrame, tag: str) -> DataFrame:
    return table.filter(F.col("tag") == tag)


def at_xpath(table: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes at absolute paths (page_id, xpath); other expressions find nothing."""
    return table.join(paths.select("page_id", "xpath").distinct(), ["page_id", "xpath"], "left_semi")


def before(table: DataFrame, anchors: DataFrame, without_ancestors: bool = False) -> DataFrame:
    """Nodes before each anchor (page_id, anchor) in document order with steps back (1 is nearest)."""
    placed = anchors.join(table.select("page_id", F.col("ord").alias("anchor"), F.col("xpath").alias("anchor_xpath")), ["page_id", "anchor"])
    met = placed.join(table, "page_id").filter("ord < anchor")
    if without_ancestors:
        met = met.filter("not startswith(anchor_xpath, concat(xpath, '/'))")
    return met.withColumn("back", F.expr("row_number() over (partition by page_id, anchor order by ord desc)")).drop("anchor_xpath")


def behind(table: DataFrame, anchors: DataFrame) -> DataFrame:
    """Nodes behind each anchor (page_id, anchor) in document order."""
    return anchors.join(table, "page_id").filter("ord > anchor")
