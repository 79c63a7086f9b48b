"""Problem 9: one mixture of all sources at target shares.

A text may stand in several sources. Texts are aggregated by membership pattern: all their
sources, and only the table of patterns that occur reaches the driver. A min-cost flow routes pattern
tokens to source quotas, the r-th use of a token costing r-1 (convex). The largest total whose quotas
can all be met is found by Newton steps on minimum cuts, each of which lowers the total to what the
violated set of sources can give. The flow of a pattern is a segment of a tape on which its seeded
documents repeat; which uses fall into a segment is decided from prefix sums over hash ranges,
never from one sorted task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weblore.llm.token_sizes import VOCABULARY, with_token_sizes
from weblore.session import cut

HASH_RANGES = 4096
LEVELS = (0.05, 0.1, 0.25, 0.5, 1.0)


class Flow:
    """Maximum flow on integer capacities by blocking flows in a layered network."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.free: list[int] = []

    def arc(self, a: int, b: int, capacity: int) -> int:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += (b, a)
        self.free += (capacity, 0)
        return len(self.to) - 2

    def layers(self, source: int, sink: int) -> list[int]:
        """Distance of every node from the source over arcs with free capacity, -1 if there is no way."""
        far = [-1] * len(self.out)
        far[source], front = 0, [source]
        while front and far[sink] < 0:
            behind = []
            for a in front:
                for e in self.out[a]:
                    b = self.to[e]
                    if self.free[e] and far[b] < 0:
                        far[b] = far[a] + 1
                        behind.append(b)
            front = behind
        return far

    def run(self, source: int, sink: int) -> int:
        """Send as much as possible; returns the amount sent by this call."""
        sent = 0
        while (far := self.layers(source, sink))[sink] >= 0:
            at = [0] * len(self.out)
            path: list[int] = []
            here = source
            while True:
                if here == sink:
                    push = min(self.free[e] for e in path)
                    for e in path:
                        self.free[e] -= push
                        self.free[e ^ 1] += push
                    sent += push
                    keep = next(i for i, e in enumerate(path) if not self.free[e])
                    here = self.to[path[keep] ^ 1]
                    del path[keep:]
                    continue
                arcs = self.out[here]
                while at[here] < len(arcs) and not (self.free[arcs[at[here]]] and far[self.to[arcs[at[here]]]] == far[here] + 1):
                    at[here] += 1
                if at[here] < len(arcs):
                    path.append(arcs[at[here]])
                    here = self.to[path[-1]]
                elif path:
                    here = self.to[path.pop() ^ 1]
                    at[here] += 1
                else:
                    break
        return sent

    def used(self, arc: int) -> int:
        return self.free[arc ^ 1]


def _network(patterns: list, shares: dict[str, float], repeats: dict[str, int], total: int) -> tuple[Flow, dict, dict, list[tuple[int, int, int]], int]:
    """The flow with arcs to the sources and the sink, but none from node 0 yet; those are returned as (node, tokens, uses)."""
    node = {s: 2 + i for i, s in enumerate(sorted(shares))}
    flow = Flow(2 + len(node) + len(patterns))
    quotas = {s: int(shares[s] * total) for s in node}
    for s, at in node.items():
        flow.arc(at, 1, quotas[s])
    arcs, feeds = {}, []
    for p, (members, tokens) in enumerate(patterns):
        here = 2 + len(node) + p
        feeds.append((here, tokens, max(repeats[s] for s in members)))
        for s in members:
            arcs[members, s] = flow.arc(here, node[s], tokens * repeats[s])
    return flow, node, arcs, feeds, sum(quotas.values())


def route(patterns: list[tuple[tuple[str, ...], int]], shares: dict[str, float], repeats: dict[str, int], total: int) -> tuple[bool, dict[tuple[tuple[str, ...], str], int]]:
    """(whether all quotas of `total` are met, tokens per pattern and source), at least cost.

    Only the arcs of node 0 cost something, so shortest paths come in the order of the uses: all
    first uses are sent, then second uses are opened, and so on.
    """
    flow, _, arcs, feeds, wanted = _network(patterns, shares, repeats, total)
    sent = 0
    for r in range(max((uses for _, _, uses in feeds), default=0)):
        for here, tokens, uses in feeds:
            if r < uses:
                flow.arc(0, here, tokens)
        sent += flow.run(0, 1)
        if sent >= wanted:
            break
    return sent >= wanted, {k: used for k, a in arcs.items() if (used := flow.used(a))}


def largest_total(patterns: list, shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The largest total whose quotas can all be met (up to rounding of the quotas to tokens)."""
    total = sum(t * max(repeats[s] for s in m) for m, t in patterns)
    while total > 0:
        flow, node, _, feeds, wanted = _network(patterns, shares, repeats, total)
        for here, tokens, uses in feeds:
            flow.arc(0, here, tokens * uses)
        if flow.run(0, 1) >= wanted:
            return total
        far = flow.layers(0, 1)  # the cut: sources that no free capacity reaches are short
        short = [s for s, at in node.items() if far[at] < 0]
        given = sum(flow.used(e) for s in short for e in flow.out[node[s]] if not e & 1)
        total = min(total - 1, int(given / sum(shares[s] for s in short)))
    return 0


def trade_off(patterns: list, shares: dict[str, float], repeats: dict[str, int], corpus_tokens: int, levels: tuple[float, ...] = LEVELS) -> list[tuple]:
    """What larger totals would cost in shares: (wish, total, reached, used, furthest, exact).

    wish: the share of all tokens asked for, 0 the largest total at exact shares; reached: tokens of the
    mixture; used: share of the corpus's tokens that stand in it at least once; furthest: largest
    distance of a reached from a target share.
    """
    out = []
    for wish in (0.0, *levels):
        total = int(wish * corpus_tokens) if wish else largest_total(patterns, shares, repeats)
        exact, flows = route(patterns, shares, repeats, total)
        by_source, by_pattern = dict.fromkeys(shares, 0), {}
        for (members, s), n in flows.items():
            by_source[s] += n
            by_pattern[members] = by_pattern.get(members, 0) + n
        reached, tokens = sum(by_source.values()), dict(patterns)
        used = sum(min(n, tokens[m]) for m, n in by_pattern.items())
        furthest = max((abs(n / reached - shares[s]) for s, n in by_source.items()), default=0.0) if reached else 0.0
        out.append((wish, total, reached, round(used / max(corpus_tokens, 1), 6), round(furthest, 6), exact))
    return out


@dataclass(frozen=True)
class Supply:
    """What the documents offer: texts (text_key, members, n_tokens, pattern), patterns with their tokens, shares and repeats."""

    texts: DataFrame
    patterns: list[tuple[tuple[str, ...], int]]
    shares: dict[str, float]
    repeats: dict[str, int]


def supply_of(docs: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> Supply | None:
    """Texts by membership pattern; None if no source with a target has tokens. Arguments as in mix."""
    rows = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).filter("source is not null and share > 0 and repeats > 0").limit(5001).collect()
    if len(rows) > 5000:
        raise ValueError("more than 5,000 sources")
    known = F.create_map(*[x for r in rows for x in (F.lit(r.source), F.lit(int(r.repeats)))]) if rows else F.create_map(F.lit(""), F.lit(0))
    sized = with_token_sizes(docs.select("doc_id", "source", F.md5("text").alias("text_key"), "text").filter(F.try_element_at(known, F.col("source")).isNotNull()), path=path)
    members = cut(sized.filter("n_tokens > 0").groupBy("text_key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens")))
    mine = F.sort_array(F.collect_set(F.struct("source", "doc_id")))  # a text stands in at most S sources
    texts = cut(members.groupBy("text_key").agg(mine.alias("members"), F.max("n_tokens").alias("n_tokens")).select("text_key", "members", "n_tokens", F.col("members.source").alias("pattern")))
    patterns = sorted((tuple(r.pattern), int(r.n)) for r in texts.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).collect())
    there = {s for members_, _ in patterns for s in members_}
    held = sum(r.share for r in rows if r.source in there)
    if not there:
        return None
    return Supply(texts, patterns, {r.source: r.share / held for r in rows if r.source in there}, {r.source: int(r.repeats) for r in rows if r.source in there})


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, use_no, n_tokens): the uses of documents in the mixture.

    docs: doc_id, text, source; targets: source, target_share, max_repeats, one row per source
    (at most 5,000 sources). total defaults to the largest total that meets every share; a
    larger one is filled as far as the repeats allow. Sources without tokens or target, null
    sources and texts without tokens stay out, and the shares are taken over the others. A text
    of several documents of one source is one document (the smallest doc_id). Its uses in a
    source never exceed the source's max_repeats, nor in all the largest max_repeats of its
    sources. Ties are broken by the seeded hash of the text.
    """
    supply = supply_of(docs, targets, path)
    if supply is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, source string, use_no int, n_tokens long")
    texts, patterns, shares, repeats = supply.texts, supply.patterns, supply.shares, supply.repeats
    size = largest_total(patterns, shares, repeats) if total is None else total
    flows = route(patterns, shares, repeats, size)[1]
    segments, tokens = [], dict(patterns)
    for pattern in tokens:
        at = 0
        for s in pattern:
            if f := flows.get((pattern, s)):
                segments.append((list(pattern), s, at, at + f, tokens[pattern], max(repeats[x] for x in pattern)))
                at += f
    tape = docs.sparkSession.createDataFrame(segments, "pattern array<string>, source string, low long, high long, period long, rounds int")

    placed = texts.withColumn("h", F.xxhash64(F.lit(seed), "text_key")).withColumn("range", F.shiftrightunsigned("h", 52))
    sums = placed.groupBy("pattern", "range").agg(F.sum("n_tokens").alias("n"))  # at most HASH_RANGES rows a pattern
    starts = sums.select("pattern", "range", (F.sum("n").over(W.partitionBy("pattern").orderBy("range")) - F.col("n")).alias("base"))
    inside = F.sum("n_tokens").over(W.partitionBy("pattern", "range").orderBy("h", "text_key").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    offsets = placed.withColumn("inside", inside).join(starts, ["pattern", "range"]).withColumn("middle", F.col("base") + F.col("inside") + F.col("n_tokens") / 2)
    uses = offsets.join(F.broadcast(tape), "pattern")  # at most one row per pattern and source
    uses = uses.withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1))).withColumn("place", F.col("middle") + F.col("round") * F.col("period"))
    chosen = uses.filter("place >= low and place < high")
    doc = F.element_at(F.filter("members", lambda m: m["source"] == F.col("source")), 1)["doc_id"]
    first = F.ceil((F.col("low") - F.col("middle")) / F.col("period"))  # round of the document's first use in the segment
    return chosen.select(doc.alias("doc_id"), "source", (F.col("round") - F.greatest(first, F.lit(0)) + 1).cast("int").alias("use_no"), "n_tokens")


def choices(docs: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per total that could be chosen: exact shares, or more of the corpus at shares further off (see trade_off)."""
    supply = supply_of(docs, targets, path)
    rows = trade_off(supply.patterns, supply.shares, supply.repeats, sum(t for _, t in supply.patterns)) if supply else []
    return docs.sparkSession.createDataFrame(rows, "wish double, total long, reached long, corpus_used double, furthest_share double, exact boolean")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_uses, most_repeats); sources that give nothing have 0."""
    by = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("uses")).groupBy("source").agg(
        F.sum("n").alias("n_tokens"), F.sum("uses").alias("n_uses"), F.max("uses").alias("most_repeats"))
    all_ = mixed.agg(F.sum("n_tokens").alias("of")).first().of or 0
    zero = lambda c: F.coalesce(c, F.lit(0))
    return targets.groupBy("source").agg(F.max("target_share").alias("target_share")).join(by, "source", "left").select(
        "source", "target_share", F.round(zero("n_tokens") / max(all_, 1), 6).alias("actual_share"), zero("n_tokens").alias("n_tokens"), zero("n_uses").alias("n_uses"), zero("most_repeats").alias("most_repeats"))
