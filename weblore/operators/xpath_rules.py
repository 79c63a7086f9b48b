"""Induction of paths that find one kind of node on all pages of a template.

Rules are conjunctions of node features. `induce` serves one set of pages and any targets: each level
of the lattice is scored in one job over all pages, the driver only holds the rules of a level.
`best_paths` serves all templates at once with one wanted node a page: the jobs are as many for any
number of templates, and nothing reaches the driver.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblore.session import cut
from weblore.sources import html_nodes

LEVELS = 3
MOST_TEMPLATES = 10_000  # templates whose common features may be broadcast
CHUNK = 4096  # rows of a (kind of node x rule) matrix
HELD = 8 * CHUNK  # kinds of nodes that a task holds before it counts
COUNTED = 1_000_000  # rules of all templates that a task counts at once

Score = tuple[float, float, float, bool]


def node_features(nodes: DataFrame) -> DataFrame:
    """(page_id, ord, feature) of each node: tag, id, class and text of itself and its next ancestors.

    A feature reads kind/distance/value; id and class also give a '*' for their presence.
    nodes: page_id, ord, parent_ord, tag, text, attrs.
    """
    out, up = None, nodes.select("page_id", "ord", F.col("ord").alias("at"))
    for distance in range(LEVELS):
        here = up.join(nodes.select("page_id", F.col("ord").alias("at"), "parent_ord", "tag", "text", "attrs"), ["page_id", "at"])
        name = lambda kind, value, d=distance: F.concat(F.lit(f"{kind}/{d}/"), value)
        attr = lambda k: F.try_element_at(F.col("attrs"), F.lit(k))
        features = F.array_compact(F.array(
            name("tag", F.col("tag")), name("id", attr("id")), name("class", attr("class")), name("text", F.nullif(F.col("text"), F.lit(""))),
            F.when(attr("id").isNotNull(), F.lit(f"id/{distance}/*")), F.when(attr("class").isNotNull(), F.lit(f"class/{distance}/*"))))
        level = here.select("page_id", "ord", F.explode(features).alias("feature"))
        out = level if out is None else out.unionByName(level)
        up = here.filter("parent_ord is not null").select("page_id", "ord", F.col("parent_ord").alias("at"))
    return out.distinct()


def as_xpath(rule: Iterable[str]) -> str:
    """The path of a rule: one step per distance, farthest first; steps without a tag read node()."""
    steps: dict[int, tuple[list[str], list[str]]] = {}
    for feature in sorted(rule):
        kind, distance, value = feature.split("/", 2)
        tags, tests = steps.setdefault(int(distance), ([], []))
        if kind == "tag":
            tags.append(value)
        elif value == "*":
            tests.append(f"@{kind}")
        else:
            tests.append(f'text()="{value}"' if kind == "text" else f'@{kind}="{value}"')
    parts = []
    for distance in range(max(steps, default=-1), -1, -1):
        tags, tests = steps.get(distance, ([], []))
        tag = "invalid_tag" if len(tags) > 1 else tags[0] if tags else "node()"
        parts.append(tag + "".join(f"[{t}]" for t in tests))
    return "//" + "/".join(parts)


def score(rules: list[frozenset[str]], features: DataFrame, targets: DataFrame, n_pages: int) -> dict[frozenset[str], Score]:
    """precision, recall, support and single match of every rule, in one job.

    A rule matches a node that has all its features. precision is 1 without a match; recall is
    the share of target pages with a right match; support the share of pages with a match.
    """
    spark = features.sparkSession
    table = spark.createDataFrame([(i, f, len(r)) for i, r in enumerate(rules) for f in r], "rule int, feature string, size int")
    match = features.join(F.broadcast(table), "feature").groupBy("rule", "page_id", "ord").agg(F.count("*").alias("k"), F.first("size").alias("size")).filter("k = size")
    marked = match.join(targets.withColumn("hit", F.lit(1)), ["page_id", "ord"], "left")
    per_page = marked.groupBy("rule", "page_id").agg(F.count("*").alias("n"), F.count("hit").alias("right"))
    rows = per_page.groupBy("rule").agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.count_if(F.col("right") > 0).alias("pages_right"), F.count("*").alias("pages"), F.max("n").alias("most")).collect()  # one row per rule
    wanted = targets.select("page_id").distinct().count()
    found = {rules[r.rule]: (r.right / r.n, r.pages_right / wanted if wanted else 0.0, r.pages / n_pages if n_pages else 0.0, r.most == 1) for r in rows}
    return {r: found.get(r, (1.0, 0.0, 0.0, True)) for r in rules}


def extend(rules: list[frozenset[str]]) -> list[frozenset[str]]:
    """Rules one feature longer all of whose subsets survive."""
    alive, out = set(rules), set()
    for a, b in combinations(sorted(rules, key=sorted), 2):
        joined = a | b
        if len(joined) == len(a) + 1 and all(joined - {f} in alive for f in joined):
            out.add(joined)
    return sorted(out, key=sorted)


def preference(rule: frozenset[str], scored: Score) -> tuple:
    """Sorts rules best first: complete and exact ones with one match a page, then the most precise, then least far and best supported."""
    precision, recall, support, single = scored
    far = max((int(f.split("/", 2)[1]) for f in rule), default=0)
    return not (recall == 1 and precision == 1 and single), -precision, -recall, far, -support, len(rule), sorted(rule)


def induce(nodes: DataFrame, targets: DataFrame, deepest: int = 3, widest: int = 400) -> list[tuple[str, float, float, float]]:
    """(path, precision, recall, support), best first: complete and exact rules with one match a page, then
    least far and best supported, else the most precise. targets: page_id, ord of the wanted nodes.

    Only features that every target page shows are combined; a level of more than `widest` rules is an error.
    """
    features = cut(node_features(nodes))
    n_pages = nodes.select("page_id").distinct().count()
    pages = targets.select("page_id").distinct().count()
    common = features.join(targets, ["page_id", "ord"]).groupBy("feature").agg(F.countDistinct("page_id").alias("n")).filter(F.col("n") == pages)
    level = [frozenset([r.feature]) for r in common.select("feature").orderBy("feature").limit(widest + 1).collect()]
    scored: dict[frozenset[str], Score] = {}
    for _ in range(deepest):
        if not level:
            break
        if len(level) > widest:
            raise ValueError("too many rules in a level")
        new = score(level, features, targets, n_pages)
        scored |= new
        level = extend([r for r, s in new.items() if s[1] == 1.0 and s[0] < 1.0])
    best = sorted(scored, key=lambda r: preference(r, scored[r]))
    return [(as_xpath(r), *scored[r][:3]) for r in best]


def _own(tree: html_nodes.Tree, node: int) -> list[tuple[str, str]]:
    """Kind and value of a node's own features, as in node_features."""
    out, attrs = [("tag", tree.tags[node])], tree.attrs[node]
    for kind in ("id", "class"):
        if kind in attrs:
            out += [(kind, attrs[kind]), (kind, "*")]
    if text := "".join(tree.texts[node]):
        out.append(("text", text))
    return out


def _page(tree: html_nodes.Tree, tag: str) -> tuple[list[str], list[list[int]], list[int], int]:
    """names of features, kinds of nodes as positions in names, nodes of each kind, and the place of the wanted node, -1 without one.

    The wanted node is the first of this tag and a kind of its own. What all wanted nodes of a template share is
    among the features of each of them, so names are only those; a page without a wanted node names all its features.
    """
    n, parents = len(tree.tags), tree.parents
    own = [_own(tree, i) for i in range(n)]
    wanted = next((i for i in range(n) if tree.tags[i] == tag), -1)
    names: list[str] = []
    bits: list[dict[tuple[str, str], int]] = [{} for _ in range(LEVELS)]
    for i in range(n) if wanted < 0 else (wanted,):
        distance = 0
        while i >= 0 and distance < LEVELS:
            for kind, value in own[i]:
                if (kind, value) not in bits[distance]:
                    bits[distance][kind, value] = 1 << len(names)
                    names.append(f"{kind}/{distance}/{value}")
            i, distance = parents[i], distance + 1
    masks = []
    for at in bits:
        level = []
        for features in own:
            mask = 0
            for f in features:
                mask |= at.get(f, 0)
            level.append(mask)
        masks.append(level)
    counts: Counter[tuple[int, bool]] = Counter()
    for i in range(n):
        j, mask = i, 0
        for level in masks:
            mask |= level[j]
            if (j := parents[j]) < 0:
                break
        counts[mask, i == wanted] += 1
    counts.pop((0, False), None)
    kinds = [[b for b in range(mask.bit_length()) if mask >> b & 1] for mask, _ in counts]
    return names, kinds, list(counts.values()), next((k for k, (_, hit) in enumerate(counts) if hit), -1)


SCAN = pa.schema([("template", pa.string()), ("names", pa.list_(pa.string())), ("kinds", pa.list_(pa.list_(pa.int32()))), ("n", pa.list_(pa.int32())), ("hit", pa.int32())])


def _scan(batches: Iterator[pa.RecordBatch], tag: str) -> Iterator[pa.RecordBatch]:
    """One row for each page (template, html) with nodes, see _page."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            trees = ((t, html_nodes.read_tree(page)) for t, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if page)
            rows = [(t, *_page(x, tag)) for t, x in trees if x.tags]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(SCAN), SCAN)], schema=SCAN)


SIGNATURES = pa.schema([("template", pa.string()), ("common", pa.list_(pa.string())), ("signature", pa.list_(pa.int64()))])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a page shows of its template's common features: mask, number and wantedness of its nodes, one after the other."""
    for batch in batches:
        rows = []
        for t, names, kinds, n, hit, common in zip(*(c.to_pylist() for c in batch.columns)):
            bit = {f: 1 << b for b, f in enumerate(common)}
            value = [bit.get(f, 0) for f in names]
            counts: Counter[tuple[int, bool]] = Counter()
            for k, at in enumerate(kinds):
                if mask := sum([value[i] for i in at]):
                    counts[mask, k == hit] += n[k]
            rows.append((t, common, [x for (mask, wanted), m in sorted(counts.items()) for x in (mask, m, int(wanted))]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(SIGNATURES), SIGNATURES)], schema=SIGNATURES)


@cache
def _rules(size: int, deepest: int) -> list[int]:
    """Masks of all rules of up to `deepest` of `size` features, behind the empty rule."""
    return [sum(1 << b for b in r) for k in range(deepest + 1) for r in combinations(range(size), k)]


COUNTS = pa.schema([("template", pa.string()), ("common", pa.list_(pa.string())), *((c, pa.list_(pa.int64())) for c in ("n", "right", "pages_right", "pages", "most"))])


def _count(rows: list[tuple[list[int], int]], rules: np.ndarray) -> list[np.ndarray]:
    """The counts of score() for every rule over signatures and their numbers of pages; the empty rule counts pages."""
    total = [np.zeros(len(rules), np.int64) for _ in range(5)]
    sizes = np.cumsum([len(s) // 3 for s, _ in rows])
    start = 0
    while start < len(rows):  # a chunk has at least one signature
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + CHUNK, "right")))
        part, start = rows[start:end], end
        kinds = np.array([x for s, _ in part for x in s], np.int64).reshape(-1, 3)
        page = np.repeat(np.arange(len(part)), [len(s) // 3 for s, _ in part])
        pages = np.array([w for _, w in part], np.int64)[:, None]
        match = (kinds[:, :1] & rules) == rules
        n, right = np.zeros((len(part), len(rules)), np.int64), np.zeros((len(part), len(rules)), np.int64)
        if len(kinds):
            first = np.flatnonzero(np.diff(page, prepend=-1))
            n[page[first]] = np.add.reduceat(match * kinds[:, 1:2], first, axis=0)
            right[page[first]] = np.add.reduceat(match * kinds[:, 1:2] * kinds[:, 2:], first, axis=0)
        seen = n > 0
        seen[:, rules == 0] = True
        for i, x in enumerate(((n * pages).sum(0), (right * pages).sum(0), ((right > 0) * pages).sum(0), (seen * pages).sum(0))):
            total[i] += x
        total[4] = np.maximum(total[4], n.max(0))
    return total


def _counts(batches: Iterator[pa.RecordBatch], deepest: int) -> Iterator[pa.RecordBatch]:
    """Counts of all rules over the signatures of a task, one row for each template until HELD or COUNTED is reached."""
    held: dict[tuple[str | None, tuple[str, ...]], list[tuple[list[int], int]]] = defaultdict(list)
    size = rules = 0

    def flush() -> pa.RecordBatch:
        rows = [(t, common, *_count(found, np.array(_rules(len(common), deepest), np.int64))) for (t, common), found in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(COUNTS), COUNTS)], schema=COUNTS)

    for batch in batches:
        for t, common, signature, pages in zip(*(c.to_pylist() for c in batch.columns)):
            found = held[t, tuple(common)]
            rules += 0 if found else len(_rules(len(common), deepest))
            size += len(signature) // 3 + 1
            found.append((signature, pages))
            if size > HELD or rules > COUNTED:
                yield flush()
                size = rules = 0
    yield flush()


BEST = "template string, xpath string, precision double, recall double, support double"


def _best(table: pa.Table, deepest: int) -> pa.Table:
    """The search of `induce` over the counts of one template."""
    common = table.column("common")[0].as_py()
    cells = [np.array(table.column(c).to_pylist(), np.int64) for c in ("n", "right", "pages_right", "pages", "most")]
    n, right, pages_right, pages, most = (*(c.sum(0).tolist() for c in cells[:4]), cells[4].max(0).tolist())
    place, bit = {mask: i for i, mask in enumerate(_rules(len(common), deepest))}, {f: 1 << b for b, f in enumerate(common)}
    scored: dict[frozenset[str], Score] = {}
    level = [frozenset([f]) for f in common]
    for _ in range(deepest):
        at = {r: place[sum(bit[f] for f in r)] for r in level}
        new = {r: (right[i] / n[i], pages_right[i] / pages_right[0], pages[i] / pages[0], most[i] == 1) for r, i in at.items()}
        scored |= new
        level = extend([r for r, s in new.items() if s[1] == 1.0 and s[0] < 1.0])
    best = min(scored, key=lambda r: preference(r, scored[r]))
    return pa.table([pa.array([x], kind) for x, kind in ((table.column("template")[0].as_py(), pa.string()), (as_xpath(best), pa.string()), *((float(x), pa.float64()) for x in scored[best][:3]))], ["template", "xpath", "precision", "recall", "support"])


def best_paths(pages: DataFrame, tag: str, deepest: int = 3) -> DataFrame:
    """(template, xpath, precision, recall, support): for each template the first path of `induce` to the first node of this tag.

    Each page (template, html) is parsed once and must be distinct. A template has at most 6 common features for each of
    LEVELS distances, so every rule of up to `deepest` of them is counted in one pass and the search reads these counts.
    Templates without such a node have no row.
    """
    scanned = cut(pages.select("template", "html").mapInArrow(partial(_scan, tag=tag), "template string, names array<string>, kinds array<array<int>>, n array<int>, hit int"))
    wanted = scanned.filter("hit >= 0")
    shown = wanted.select("template", F.explode("names").alias("name")).groupBy("template", "name").agg(F.count("*").alias("k"))
    targets = wanted.groupBy(F.col("template").alias("_template")).agg(F.count("*").alias("of"))
    common = cut(shown.join(targets, F.col("template").eqNullSafe(F.col("_template"))).filter("k = of").groupBy("_template").agg(F.sort_array(F.collect_list("name")).alias("common")))
    common = F.broadcast(common) if common.count() <= MOST_TEMPLATES else common
    placed = scanned.join(common, F.col("template").eqNullSafe(F.col("_template"))).select("template", "names", "kinds", "n", "hit", "common")
    signatures = placed.mapInArrow(_signatures, "template string, common array<string>, signature array<long>")
    counted = signatures.groupBy("template", "common", "signature").agg(F.count("*").alias("pages")).mapInArrow(
        partial(_counts, deepest=deepest), "template string, common array<string>, n array<long>, right array<long>, pages_right array<long>, pages array<long>, most array<long>")
    return counted.groupBy("template", "common").applyInArrow(lambda group: _best(group, deepest), BEST)
