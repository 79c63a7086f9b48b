"""Problem 6: the main body of a page without its furniture.

A page is read once into a tree: containers (div, section, table ...) and, below them, lines
with visible text. The trees, with what labels need of their texts, are stored as whole numbers: repeated lines, labels
and scores come from them without the html. Gradient-boosted trees score every node from its own features, those of
its subtree, its siblings and its parent. Decoding is hierarchical: a node's score is its own
log-odds plus the gains of its children, and a line is kept only if all its ancestors are.

The classifier is fit on every labelled node of all pages, and all pages tell which lines repeat. Labels are
distant: headings, facts of ground_truth and prose in the heading's block against repeated lines, link lists and
other blocks.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblore.llm.boosted_trees import SLICES, BoostedTrees, fit_slices, packed
from weblore.llm.pagelines import body_lines, heading, visible, words
from weblore.llm.repeated_lines import MOST_WORDINGS, frequent_wordings, meet_wordings, tokens_hash
from weblore.session import cut

PAGES_PER_SLICE = 256
CONTAINERS = frozenset("div header aside footer main table section ul ol nav dl article form".split())
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)(?:>|$)")
CLASS = re.compile(r"""\bclass\s*=\s*["']?([^"'\s>]+)""")
ID = re.compile(r"\bid\s*=")
HREF = re.compile(r"""\bhref\s*=\s*["']?([^"'\s>]*)""")
LINK = re.compile(r"<a\b([^<>]*)>(.*?)(?:</a\s*>|$)", re.S | re.I)
LETTER = re.compile(r"\w")
COMMENT = re.compile(r"<!--.*?(?:-->|$)", re.S)
TAG_CODES = {t: i + 1 for i, t in enumerate("h1 h2 h3 h4 p blockquote dt dd tr li b span a div section table ul dl nav header main article aside footer".split())}
FIELDS = ("page", "parent", "depth", "line", "container", "tag", "has_class", "has_id", "class_count", "chars", "words", "links", "link_chars", "href", "seps",
          "ended", "colon", "starts_link", "tags", "has_h1")
TOLD = ("tokens", "fact", "titled")  # of the text: number of words, states a fact of ground_truth, holds the heading
PARENT, WIDTH = FIELDS.index("parent"), len(FIELDS) + len(TOLD)
TREES = "page_id long, template string, nodes binary, hashed array<int>, wordings array<long>"


def _href_family(attrs: str) -> int:
    """Family of a link's target: none, digits, a short section, other."""
    m = HREF.search(attrs)
    if not m:
        return 0
    head = m.group(1).lstrip("/").split("/")[0]
    return 1 if head.isdigit() else 2 + (sum(map(ord, head)) % 6 if head.isalpha() and len(head) <= 2 else 6)


def page_nodes(page: str, page_no: int, base: int, out: dict[str, list]) -> list[str]:
    """Append the page's nodes to the column lists; return the visible texts by node ('' for containers)."""
    lines, first = body_lines(page)
    texts: list[str] = []
    classes: list[str] = []
    start = len(out["page"])
    add = [out[f].append for f in FIELDS]

    def node(parent, depth, line, container, tag, attrs, chars=0, n_words=0, links=0, link_chars=0, href=0, seps=0, ended=0, colon=0, starts_link=0, tags=0, h1=0):
        m = CLASS.search(attrs) if "class" in attrs else None
        classes.append(m.group(1) if m else "")
        row = (page_no, parent, depth, line, container, TAG_CODES.get(tag, 0), 1 if m else 0, 1 if "id" in attrs and ID.search(attrs) else 0, 0, chars, n_words, links,
               link_chars, href, seps, ended, colon, starts_link, tags, h1)
        for f, v in zip(add, row):
            f(v)
        return base + len(classes) - 1

    root = node(-1, 0, 0, 1, "body", "")
    texts.append("")
    stack = [(root, "body", 0)]
    for i in range(first, len(lines)):
        line = lines[i]
        if "<!--" in line:
            line = COMMENT.sub(" ", line)
        marks = TAG.findall(line) if "<" in line else []
        text = visible(line).strip()
        opened = []
        if text:
            lead = next(((t.lower(), a) for close, t, a in marks if not close), ("", "")) if line.lstrip().startswith("<") else ("", "")
            anchors = LINK.findall(line) if "<a" in line else []
            anchor_text = sum(len(visible(t)) for _, t in anchors)
            after = line.lstrip()
            node(stack[-1][0], stack[-1][2] + 1, i + 1, 0, *lead, len(text), text.count(" ") + 1, len(anchors), anchor_text, _href_family(anchors[0][0]) if anchors else 0,
                 text.count(" · ") + text.count(" | ") + 3 * text.count(" © "), 1 if text[-1] in ".!?…" else 0,
                 1 if ":" in text[:40] else 0, 1 if re.match(r"(?:<(?!a\b)[^<>]*>)*<a\b", after) else 0, len(marks), 1 if any(t.lower() == "h1" for _, t, _ in marks) else 0)
            texts.append(text)
        for close, tag, attrs in marks:
            tag = tag.lower()
            if tag not in CONTAINERS:
                continue
            if not close:
                if text:
                    opened.append((tag, attrs))
                else:
                    top = stack[-1]
                    stack.append((node(top[0], top[2] + 1, i + 1, 1, tag, attrs), tag, top[2] + 1))
                    texts.append("")
            elif opened and opened[-1][0] == tag:
                opened.pop()
            elif any(t == tag for _, t, _ in stack[1:]):
                while stack.pop()[1] != tag:
                    pass
        for tag, attrs in opened:  # opened on a line with text and left open
            top = stack[-1]
            stack.append((node(top[0], top[2] + 1, i + 1, 1, tag, attrs), tag, top[2] + 1))
            texts.append("")
    counts = Counter(classes)
    for k, c in enumerate(classes):
        if c:
            out["class_count"][start + k] = counts[c]
    return texts


def features(out: dict[str, list] | dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Feature matrix of all nodes and the node columns as arrays."""
    c = {f: np.asarray(out[f], np.float64) for f in FIELDS}
    parent, depth = c["parent"].astype(np.int64), c["depth"].astype(np.int64)
    n = len(parent)
    sums = {k: c[k].copy() for k in ("chars", "links", "link_chars", "tags", "has_h1")} | {"leaves": 1 - c["container"], "long": ((c["chars"] > 80) & (c["container"] == 0)).astype(float)}
    for d in range(int(depth.max(initial=0)), 0, -1):
        at = np.flatnonzero(depth == d)
        for v in sums.values():
            np.add.at(v, parent[at], v[at])
    up = np.maximum(parent, 0)
    block = np.arange(n)  # the ancestor at depth 1
    for d in range(2, int(depth.max(initial=0)) + 1):
        at = np.flatnonzero(depth == d)
        block[at] = block[parent[at]]
    order = np.lexsort((np.arange(n), parent))
    firsts = np.r_[True, parent[order][1:] != parent[order][:-1]] if n else np.zeros(0, bool)
    group = np.cumsum(firsts) - 1
    sizes = np.bincount(group, minlength=1)
    starts = np.flatnonzero(firsts)
    position, siblings = np.zeros(n), np.zeros(n)
    position[order] = np.arange(n) - starts[group] if n else 0
    siblings[order] = sizes[group] if n else 0
    before, behind = np.zeros(n), np.zeros(n)
    chars_in_order = sums["chars"][order]
    if n:
        before[order[1:]] = np.where(firsts[1:], 0, chars_in_order[:-1])
        behind[order[:-1]] = np.where(firsts[1:], 0, chars_in_order[1:])
    kind = (parent * 64 + c["tag"].astype(np.int64)) * 2 + c["has_class"].astype(np.int64)
    _, inverse, same = np.unique(kind, return_inverse=True, return_counts=True)
    page = c["page"].astype(np.int64)
    class_share = c["class_count"] / np.bincount(page)[page] if n else np.zeros(0)
    h1_line = np.full(int(page.max(initial=0)) + 1, -1.0)
    own_h1 = np.flatnonzero(c["has_h1"] > 0)[::-1]
    h1_line[page[own_h1]] = c["line"][own_h1]
    away = np.where(h1_line[page] < 0, -40, np.clip(c["line"] - h1_line[page], -39, 40))
    density = lambda a, b: a / np.maximum(b, 1)
    x = np.column_stack([
        c["container"], depth, c["tag"], c["has_class"], c["has_id"], class_share, np.log1p(sums["chars"]), c["words"], density(sums["link_chars"], sums["chars"]),
        sums["links"], c["href"], c["seps"], c["ended"], c["colon"], c["starts_link"],
        density(position, siblings), siblings, density(same[inverse], siblings), np.log1p(before), np.log1p(behind), sums["leaves"], density(sums["long"], sums["leaves"]),
        density(sums["chars"], sums["tags"]), density(sums["link_chars"][up], sums["chars"][up]), np.log1p(sums["chars"][up]), c["tag"][up], c["has_class"][up],
        sums["leaves"][up], sums["has_h1"] > 0, sums["has_h1"][up] > 0, (sums["has_h1"][block] > 0) & (depth > 0), away,
        density(sums["link_chars"][block], sums["chars"][block]), density(sums["long"][block], sums["leaves"][block]),
    ])
    return x, c | {"block_h1": (sums["has_h1"][block] > 0) & (depth > 0), "sub_h1": sums["has_h1"] > 0, "link_share": density(sums["link_chars"], sums["chars"])}


def decode(logits: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Best choice of nodes in which every chosen node's ancestors are chosen. Roots (depth 0) always are."""
    score, deepest = logits.copy(), int(depth.max(initial=0))
    levels = [np.flatnonzero(depth == d) for d in range(deepest + 1)]
    for at in reversed(levels[1:]):
        np.add.at(score, parent[at], np.maximum(score[at], 0))
    chosen = depth == 0
    for at in levels[1:]:
        chosen[at] = chosen[parent[at]] & (score[at] > 0)
    return chosen


def _read(pages: list[tuple[int, str]]) -> tuple[dict[str, list], list[str]]:
    out: dict[str, list] = {f: [] for f in FIELDS}
    texts: list[str] = []
    for k, (_, page) in enumerate(pages):
        texts += page_nodes(page, k, len(out["page"]), out)
    return out, texts


def _told(page: str, texts: list[str], ground_truth: str | None) -> tuple[list[tuple[int, bool, bool]], list[int], list[int]]:
    """TOLD of every node; the nodes with a wording and their wordings (`repeated_lines.line_hashes`)."""
    title, facts = words(heading(page)), _facts(ground_truth)
    letters = {k[:1] for k, _ in facts}
    told, hashed, wordings = [], [], []
    for i, text in enumerate(texts):
        if not text:
            told.append((0, False, False))
            continue
        tokens = words(text)
        if (wording := tokens_hash(tokens, title)) is not None:
            hashed.append(i)
            wordings.append(wording)
        lower, fact = text.lower(), False
        if "" in letters or ((m := LETTER.search(lower)) and m.group() in letters):  # how a line with a fact begins
            flat = _clean(lower)
            fact = any(flat.startswith(k) and any(v in flat for v in vs) for k, vs in facts)
        told.append((len(tokens), fact, _contains(tokens, title)))
    return told, hashed, wordings


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """TREES of page_id, html, ground_truth, template."""
    for batch in batches:
        ids, templates = batch.column(0), batch.column(3)
        rows = [(k, page, truth) for k, (page, truth) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())) if page]
        for at in range(0, len(rows), PAGES_PER_SLICE):
            part = rows[at : at + PAGES_PER_SLICE]
            out, texts = _read([(k, page) for k, page, _ in part])
            nodes = np.array([out[f] for f in FIELDS], np.int32)
            ends = np.searchsorted(nodes[0], np.arange(len(part) + 1))
            packed_nodes, hashed, wordings = [], [], []
            for (_, page, truth), a, b in zip(part, ends, ends[1:]):
                told, own_hashed, own_wordings = _told(page, texts[a:b], truth)
                own = np.concatenate([nodes[:, a:b], np.array(told, np.int32).reshape(-1, len(TOLD)).T])
                own[PARENT] -= np.where(own[PARENT] < 0, 0, a)
                packed_nodes.append(int(b - a).to_bytes(4, "little") + pa.compress(own.tobytes(), "zstd", asbytes=True))
                hashed.append(own_hashed)
                wordings.append(own_wordings)
            k = pa.array([k for k, _, _ in part], pa.int64())
            columns = [ids.take(k), templates.take(k), pa.array(packed_nodes, pa.binary()), pa.array(hashed, pa.list_(pa.int32())), pa.array(wordings, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "template", "nodes", "hashed", "wordings"])


def _unpacked(trees: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Node columns of several pages, as `features` takes them, and where each page begins and ends."""
    sizes = [int.from_bytes(tree[:4], "little") for tree in trees]
    parts = [np.frombuffer(pa.decompress(tree[4:], 4 * n * WIDTH, "zstd", asbytes=True), np.int32).reshape(WIDTH, n) for n, tree in zip(sizes, trees)]
    ends = np.r_[0, np.cumsum(sizes)]
    c = dict(zip((*FIELDS, *TOLD), np.concatenate(parts, 1)))
    c["page"] = np.repeat(np.arange(len(trees)), sizes)
    c["parent"] = np.where(c["parent"] < 0, -1, c["parent"] + ends[:-1][c["page"]])
    return c, ends


def _chosen(nodes: dict, model: BoostedTrees) -> tuple[np.ndarray, np.ndarray]:
    """Place of the page and number of each line of the main body."""
    x, c = features(nodes)
    chosen = decode(model.logits(x), c["parent"].astype(np.int64), c["depth"].astype(np.int64)) & (c["container"] == 0)
    return c["page"][chosen].astype(np.int64), c["line"][chosen].astype(np.int64)


def _lines(ids: pa.Array, pages: np.ndarray, lines: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(pages)), pa.array(lines)], names=["page_id", "line_no"])


def _predict(batches: Iterator[pa.RecordBatch], model: BoostedTrees) -> Iterator[pa.RecordBatch]:
    """(page_id, line_no) of pages: page_id, html."""
    for batch in batches:
        pages = [(k, p) for k, p in enumerate(batch.column(1).to_pylist()) if p]
        for at in range(0, len(pages), PAGES_PER_SLICE):
            part = pages[at : at + PAGES_PER_SLICE]
            yield _lines(batch.column(0).take(pa.array([k for k, _ in part])), *_chosen(_read(part)[0], model))


def _predict_trees(batches: Iterator[pa.RecordBatch], model: BoostedTrees) -> Iterator[pa.RecordBatch]:
    """(page_id, line_no) of trees: page_id, nodes."""
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES_PER_SLICE):
            part = batch.slice(at, PAGES_PER_SLICE)
            yield _lines(part.column(0), *_chosen(_unpacked(part.column(1).to_pylist())[0], model))


def _facts(ground_truth: str | None) -> list[tuple[str, list[str]]]:
    try:
        facts = json.loads(ground_truth or "{}")
        return [(k, [v for v in vs if v and isinstance(v, str)]) for k, vs in facts.items() if k != "topic_entity_name" and isinstance(vs, list)]
    except (ValueError, AttributeError, TypeError):
        return []


def _clean(text: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", "", text.lower()).split())


def _contains(tokens: list[str], part: list[str]) -> bool:
    return bool(part) and part[0] in tokens and any(tokens[i : i + len(part)] == part for i in range(len(tokens) - len(part) + 1))


def labels(c: dict[str, np.ndarray], repeated: np.ndarray) -> np.ndarray:
    """1 main body, 0 furniture, -1 unknown for every node of some pages. repeated: the node's wording is frequent in its template."""
    link_share, classed, container, page = c["link_share"], c["has_class"] > 0, c["container"] > 0, c["page"].astype(np.int64)
    rules = [  # of a line, the first that holds
        (c["has_h1"] > 0, 1),
        (repeated | (c["seps"] >= 3) | ~c["block_h1"] | (link_share > 0.98), 0),
        (c["fact"] > 0, 1),
        ((c["tokens"] >= 6) & (link_share > 0.5) & (c["links"] >= 2) & (c["tag"] == TAG_CODES["p"]), 0),
        ((c["tokens"] >= 4) & (link_share <= 0.5) & (c["starts_link"] == 0) & (~classed | (c["titled"] > 0)), 1),
    ]
    y = np.select([rule for rule, _ in rules], [label for _, label in rules], -1)
    y[container] = -1
    bare = np.bincount(page, (y == 1) & classed, int(page.max(initial=0)) + 1) == 0
    y[(y < 0) & classed & ~container & bare[page]] = 0  # the body's own lines bear no class here: others that do are furniture
    inner = container & (c["depth"] > 0)
    y[inner] = np.where(c["sub_h1"], 1, np.where(c["block_h1"], -1, 0))[inner]
    return y


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SLICES of trees: template, nodes, hashed, wordings, frequent wordings of the template."""
    sets: dict[str | None, frozenset[int]] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES_PER_SLICE):
            part = batch.slice(at, PAGES_PER_SLICE)
            templates, trees, hashed, wordings = (part.column(i).to_pylist() for i in range(4))
            nodes, ends = _unpacked(trees)
            repeated = np.zeros(ends[-1], bool)
            for template, frequent, first, own, marks in zip(templates, part.column(4), ends, hashed, wordings):
                if template not in sets:
                    sets[template] = frozenset(frequent.as_py() or ())
                known = sets[template]
                repeated[[first + i for i, w in zip(own, marks) if w in known]] = True
            x, c = features(nodes)
            y = labels(c | {f: nodes[f] for f in TOLD}, repeated)
            for n, codes, vals in packed(x[y >= 0], y[y >= 0]):
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([codes], pa.binary()), pa.array([vals], pa.list_(pa.list_(pa.float64())))], names=["n", "codes", "vals"])


def page_trees(pages: DataFrame) -> DataFrame:
    """The pages as TREES. pages: page_id, template, html, ground_truth.

    Rows that repeat a page count once, different versions of a page all count; only pages that come several times are shuffled.
    """
    pages = pages.select("page_id", "html", "ground_truth", "template")
    several = cut(pages.groupBy("page_id").count().filter("count > 1").select(F.col("page_id").alias("p")))
    several = F.broadcast(several) if several.count() <= MOST_WORDINGS else several
    again = F.col("page_id").eqNullSafe(F.col("p"))
    one = pages.join(several, again, "left_anti").unionByName(pages.join(several, again, "left_semi").dropDuplicates())
    return cut(one.mapInArrow(_trees, TREES))


def training_rows(trees: DataFrame, pages: DataFrame) -> DataFrame:
    """The labelled nodes of all pages as SLICES. trees: their `page_trees`."""
    frequent = cut(frequent_wordings(trees.select("page_id", "template", F.explode("wordings").alias("wording")), pages))
    return meet_wordings(trees, frequent).select("template", "nodes", "hashed", "wordings", "frequent").mapInArrow(_labelled, SLICES)


def train(pages: DataFrame) -> BoostedTrees:
    """The classifier, fit on the labelled nodes of all pages; the same whatever the order of arrival."""
    return fit_slices(training_rows(page_trees(pages), pages))


def main_lines(pages: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    """(page_id, line_no) of the lines of the main body.

    Null, empty and body-less pages give no rows, repeated rows of a page give one. Without a
    single labelled node (an empty table) the model is constant and keeps nothing by chance.
    """
    found = "page_id long, line_no long"
    if model:
        lines = pages.select("page_id", "html").mapInArrow(lambda it: _predict(it, model), found)
    else:
        trees = page_trees(pages)
        fitted = fit_slices(training_rows(trees, pages))
        lines = trees.select("page_id", "nodes").mapInArrow(lambda it: _predict_trees(it, fitted), found)
    return lines.dropDuplicates(["page_id", "line_no"])


def _keep(batches: Iterator[pa.RecordBatch], model: BoostedTrees) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _predict(iter([batch]), model):
            kept: dict[int, list[int]] = {}
            for i, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                kept.setdefault(i, []).append(n)
            pages = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            texts = {i: "\n".join(visible(pages[i].split("\n")[n - 1]).strip() for n in sorted(set(ns))) for i, ns in kept.items()}
            yield pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array(list(texts.values()), pa.string())], names=["page_id", "main_text"])


def main_text(pages: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    """(page_id, main_text): the main body's visible lines; pages without any give no row."""
    model = model or train(pages)
    return pages.select("page_id", "html").mapInArrow(lambda it: _keep(it, model), "page_id long, main_text string").dropDuplicates(["page_id"])
