"""Problem 5: records and knowledge-base nodes that name the same thing, without a shared key.

Collective linkage: distinct names and nodes meet in hashed name keys (candidate graph). An edge
weighs the sum over the keys that both share, each by its kind of agreement and the less the more
nodes share it; each name keeps only its heaviest edges (meta-blocking by the best weight of the
name). Then evidence is propagated: a page's topic is supported by the knowledge-base neighbours
that the page's objects name, an object with several candidates by its link to the topic, until no
row changes. Names are matched once per distinct value; values that fill a large share of all
rows are joined back by a broadcast of at most HOT_VALUES values, the others by hash.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weblore.llm.encoding_repair import LOST, PAIR, core, inverse
from weblore.session import cut

HOT_VALUES, MIN_FACTS = 200, 2
MIN_TYPO_LENGTH = 6
# Words around names that are no part of them.
TITLES = frozenset("mr mrs ms dr prof sir".split())
ORG_TAILS = frozenset("gmbh ltd inc llc co corp ag sa plc".split())
ARTICLES = frozenset("a an the la le les el los las un une una uno die der das ein eine".split())
JOINERS = frozenset("and und et y e".split())
LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ı": "i"})
BRACKETS = re.compile(r"\s*[\[(][^\[\]()]*(?:[\])]|$)")
TOKEN = re.compile(r"[^\W_]+|" + LOST)
# Kinds of agreement, strongest first: same name, same without middle initials, same without the letters that an
# encoding may lose, initial for the first name, one slip of the pen.
KINDS = ("name", "core", "lost", "initial", "slip")
WEIGHT = {"name": 1.0, "core": 0.9, "lost": 0.85, "initial": 0.8, "slip": 0.75}


def repaired(text: str) -> str:
    """The text with garbled words restored where the inverse of a misreading exists."""
    if text.isascii() or not PAIR.search(text):
        return text
    out = []
    for word in text.split(" "):
        inner = core(word)
        found = inverse(inner) if inner and PAIR.search(inner) else None
        out.append(word.replace(inner, found[0]) if found else word)
    return " ".join(out)


def ordered(text: str) -> str:
    """The name without bracketed additions, "Last, First" in natural order."""
    bare = BRACKETS.sub("", text).strip()
    if not bare:
        bare = text.strip(" ()[]")
    head, comma, tail = bare.partition(",")
    if comma and head.strip() and tail.strip() and "," not in tail and not set(tail.casefold().replace(".", " ").split()) & ORG_TAILS:
        return f"{tail.strip()} {head.strip()}"
    return bare


def raw_words(text: str) -> list[str]:
    """Words in lower case without accents, titles and company tails; a trailing article comes first."""
    plain = unicodedata.normalize("NFKD", text.casefold().translate(LETTERS))
    words = TOKEN.findall("".join(c for c in plain if not unicodedata.combining(c)))
    while len(words) > 1 and words[0] in TITLES:
        words = words[1:]
    while len(words) > 1 and words[-1] in ORG_TAILS:
        words = words[:-1]
    return words[-1:] + words[:-1] if len(words) > 2 and words[-1] in ARTICLES else words


def folded(text: str) -> list[str]:
    """raw_words without the words for "and" in the middle."""
    words = raw_words(text)
    return [w for i, w in enumerate(words) if w not in JOINERS or i in (0, len(words) - 1)]


def beginning(text: str) -> str:
    """Key of a name that may be cut off behind a word: its words as they stand, bare of lost letters."""
    name = BRACKETS.sub("", repaired(" ".join(text.split()))).strip(" .…")
    plain = unicodedata.normalize("NFKD", name.casefold().translate(LETTERS))
    return " ".join(TOKEN.findall("".join(c for c in plain if not unicodedata.combining(c))))


def name_keys(text: str, is_node: bool) -> list[tuple[str, str]]:
    """(kind, key) pairs under which a name can meet another."""
    name = ordered(repaired(" ".join(text.split())))
    words = folded(name)
    if not words:
        return []
    whole = "".join(words)
    if whole.isdecimal():  # parts of a number are no spelling of another number
        return [("name", " ".join(words))]
    keys = [("name", whole)] if LOST not in whole else []
    short = [w for i, w in enumerate(words) if len(w) > 1 or i in (0, len(words) - 1)]
    letters = sum(c.isalpha() for c in whole)
    if len(words) > 1 and LOST not in whole:
        keys.append(("core", "".join(short)))
    if letters >= MIN_TYPO_LENGTH:
        bare = "".join(folded("".join(c for c in name if c.isascii())))
        if len(bare) >= MIN_TYPO_LENGTH and (not name.isascii() if is_node else LOST in name or name.isascii()):
            keys.append(("lost", bare))
    if len(short) > 1 and (is_node and len(short[0]) > 1 or not is_node and len(short[0]) == 1) and len("".join(short[1:])) >= 4:
        keys.append(("initial", short[0][0] + "".join(short[1:])))
    return keys


def squeezed(word: str) -> str:
    """The word with runs of one letter made a single letter."""
    return re.sub(r"([^\d])\1+", r"\1", word)


def slips(text: str) -> list[tuple[str, str]]:
    """(form, the name it comes from): the folded name, also without the letters an encoding may
    lose, also with doubled letters made single, and all forms with one letter left out. Names that are
    one slip apart share a form."""
    name = ordered(repaired(" ".join(text.split())))
    words = raw_words(name)
    bare = "".join(raw_words("".join(c for c in name if c.isascii())))
    out = []
    plain = "".join(words).replace(LOST, "")
    for whole in {plain, bare, squeezed(plain), squeezed(bare)}:
        if sum(c.isalpha() for c in whole) >= MIN_TYPO_LENGTH:
            out += [(form, whole) for form in {whole, *(whole[:i] + whole[i + 1 :] for i in range(len(whole)))}]
    return out


def one_slip(a: str, b: str) -> bool:
    """Whether two words differ by one letter left out, added, changed or exchanged with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


def _hash(kind: str, key: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind} {key}") - (1 << 63)


def _keys(batches: Iterator[pa.RecordBatch], is_node: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(ident, KINDS.index(kind), _hash(kind, key)) for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for kind, key in name_keys(text, is_node)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int8()), pa.array([r[2] for r in rows], pa.int64())], names=["ident", "kind", "key"])


def _slip_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(ident, key) for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for key in {_hash("slip", form) for form, _ in slips(text)}]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["ident", "key"])


def keyed(rows: DataFrame, is_node: bool) -> DataFrame:
    """(ident, kind, key) of rows (ident, text); kind is the place in KINDS."""
    return rows.mapInArrow(lambda it: _keys(it, is_node), "ident long, kind byte, key long")


def slip_keyed(rows: DataFrame) -> DataFrame:
    """(ident, key) of rows (ident, text) for names one slip apart; only hashes, never texts."""
    return rows.mapInArrow(_slip_keys, "ident long, key long")


def slipped(a: str, b: str) -> bool:
    """Whether some form of one name is one slip away from some form of the other."""
    return any(one_slip(x, y) for x in {w for _, w in slips(a)} for y in {w for _, w in slips(b)})


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [slipped(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def candidates(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """(value_id, node_id, kind, weight): for each value the nodes of its heaviest edges.

    values: (value_id, text); nodes: (node_id, text). Every shared key adds its kind's strength over
    1 + ln(nodes under the key); weight is the largest of these parts. Names one slip apart are looked
    for only where no key is shared. The key tables of values and nodes are joined by hash.
    """
    named = nodes.select(F.col("node_id").alias("ident"), "text")
    node_keys = keyed(named, True).distinct().withColumn("shared", F.count("*").over(W.partitionBy("kind", "key"))).select(F.col("ident").alias("node_id"), "kind", "key", "shared")
    value_rows = values.select(F.col("value_id").alias("ident"), "text")
    strong = cut(keyed(value_rows, False).join(node_keys, ["kind", "key"]).select(F.col("ident").alias("value_id"), "node_id", "kind", "shared"))
    rest = cut(values.join(strong.select("value_id").distinct(), "value_id", "left_anti").select(F.col("value_id").alias("ident"), "text"))
    met = slip_keyed(rest).join(slip_keyed(named).select(F.col("ident").alias("node_id"), "key"), "key").select(F.col("ident").alias("value_id"), "node_id").distinct()
    texts = met.join(rest.select(F.col("ident").alias("value_id"), "text"), "value_id").join(named.select(F.col("ident").alias("node_id"), F.col("text").alias("node_text")), "node_id")
    weak = texts.select("value_id", "node_id", "text", "node_text").mapInArrow(_check, "value_id long, node_id long").distinct()
    weak = weak.select("value_id", "node_id", F.lit(len(KINDS) - 1).cast("byte").alias("kind"), F.count("*").over(W.partitionBy("value_id")).alias("shared"))
    strength = F.element_at(F.array(*(F.lit(WEIGHT[k]) for k in KINDS)), F.col("kind") + 1)
    parts = strong.unionByName(weak).groupBy("value_id", "node_id", "kind").agg(F.min("shared").alias("shared"))
    edges = parts.withColumn("part", strength / (1 + F.log(F.col("shared").cast("double")))).groupBy("value_id", "node_id").agg(
        F.min("kind").alias("kind"), F.max("part").alias("weight"), F.round(F.sum("part"), 9).alias("whole"))
    best = edges.groupBy("value_id").agg(F.max("whole").alias("best"))
    return edges.join(best, "value_id").filter("whole = best").select("value_id", "node_id", "kind", "weight")


def _beginnings(batches: Iterator[pa.RecordBatch], is_node: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for words in {tuple(beginning(t).split()) for t in (text, "".join(c for c in repaired(text) if c.isascii()))}:
                ends = range(2, len(words)) if is_node else [len(words)] if len(words) > 1 else []
                rows += [(ident, _hash("cut", " ".join(words[:k]))) for k in ends]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["ident", "start"])


def cut_off_topics(titled: DataFrame, topics: DataFrame, edges: DataFrame, shown: DataFrame) -> DataFrame:
    """(page_id, node_id, facts) for topics that are the beginning of a node's name.

    Many names begin alike ("University of"), so beginning and fact form one join key: only
    nodes that share a fact with the page are ever met.
    """
    starts = lambda rows, is_node: rows.mapInArrow(lambda it: _beginnings(it, is_node), "ident long, start long").distinct()
    known = starts(topics.select("node_id", "text"), True).join(edges, F.col("ident") == F.col("source_id")).select(F.col("ident").alias("node_id"), "start", "dest_id")
    wanted = starts(titled.select("page_id", "text"), False).join(shown, F.col("ident") == F.col("page_id")).select("page_id", "start", "dest_id")
    return wanted.join(known, ["start", "dest_id"]).groupBy("page_id", "node_id").agg(F.countDistinct("dest_id").alias("facts"))


def join_back(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (…, value_id) joined with found (value_id, …); values of more than a HOT_VALUES-th of the rows by broadcast."""
    counts = rows.groupBy("value_id").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    hot = [r.value_id for r in counts.filter(F.col("n") > max(1000, total // HOT_VALUES)).select("value_id").collect()]  # at most HOT_VALUES
    often = F.col("value_id").isin(hot) if hot else F.lit(False)
    common = rows.filter(often).join(F.broadcast(found.filter(often)), "value_id")
    return rows.filter(~often).join(found.filter(~often), "value_id").unionByName(common)


def link(pairs: DataFrame, pages: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_table, rec_id, node_id, confidence).

    pairs: pair_id, page_id, obj_text; pages: page_id, topic_text; nodes: node_id, node_text;
    edges: source_id, dest_id. Null and blank names match nothing, repeated rows count once.
    webpage: nodes with links whose name agrees with the topic and of whose neighbours at least
    MIN_FACTS are named by objects of the page; of several the best supported (ties: all).
    candidate_pairs: nodes whose name agrees, but for those that only link to others and are never linked to (the
    knowledge base's subjects); of several those linked with the page's topic, and if none is, no node.
    """
    nodes = cut(nodes.filter("node_id is not null and trim(node_text) <> ''").select("node_id", F.col("node_text").alias("text")).distinct())
    edges = cut(edges.filter("source_id is not null and dest_id is not null").select("source_id", "dest_id").distinct())
    subjects = edges.select(F.col("source_id").alias("node_id")).distinct()
    topics = nodes.join(subjects, "node_id", "left_semi")
    things = nodes.join(subjects.join(edges.select(F.col("dest_id").alias("node_id")), "node_id", "left_anti"), "node_id", "left_anti")
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))

    named = pairs.filter("pair_id is not null and obj_text is not null").select("pair_id", "page_id", tidy("obj_text").alias("text")).filter("text <> ''").dropDuplicates(["pair_id"])
    named = cut(named.withColumn("value_id", F.xxhash64("text")))
    values = named.groupBy("value_id").agg(F.min("text").alias("text"))
    objects = cut(join_back(named.select("pair_id", "page_id", "value_id"), cut(candidates(values, things))).select("pair_id", "page_id", "node_id", "weight"))

    titled = pages.filter("page_id is not null and topic_text is not null").select("page_id", tidy("topic_text").alias("text")).filter("text <> ''").distinct()
    titled = cut(titled.withColumn("value_id", F.xxhash64("text")))
    titles = titled.groupBy("value_id").agg(F.min("text").alias("text"))
    headed = cut(join_back(titled.select("page_id", "value_id"), cut(candidates(titles, topics))).groupBy("page_id", "node_id").agg(F.max("weight").alias("weight")))
    facts = cut(headed.join(edges, headed.node_id == edges.source_id).select("page_id", "node_id", "dest_id"))

    def marks(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first())

    alive, before = objects, None
    while True:  # candidates only ever drop out, so this ends
        shown = alive.select("page_id", F.col("node_id").alias("dest_id")).distinct()
        support = facts.join(shown, ["page_id", "dest_id"]).groupBy("page_id", "node_id").agg(F.count("*").alias("facts")).filter(F.col("facts") >= MIN_FACTS)
        whole = support.select("page_id").distinct()
        begun = cut_off_topics(titled.join(whole, "page_id", "left_anti"), topics, edges, shown).filter(F.col("facts") >= MIN_FACTS)
        support = cut(support.unionByName(begun))
        most = support.groupBy("page_id").agg(F.max("facts").alias("most"))
        topic = cut(support.join(most, "page_id").filter("facts = most").select("page_id", "node_id", "facts"))
        linked = topic.join(edges, F.col("node_id") == F.col("source_id")).select("page_id", F.col("dest_id").alias("node_id")).distinct().withColumn("linked", F.lit(1))
        judged = alive.join(linked, ["page_id", "node_id"], "left")
        per = W.partitionBy("pair_id")
        judged = judged.withColumns({"any": F.max("linked").over(per), "of": F.count("*").over(per)})
        alive = cut(judged.filter("linked is not null or any is null").select("pair_id", "page_id", "node_id", "weight", "linked", "of"))
        now = (marks(alive), marks(topic))
        if now == before:
            break
        before = now
        alive = alive.drop("linked", "of")
    pair_links = alive.filter("linked is not null or of = 1").select(
        F.lit("candidate_pairs").alias("src_table"), F.col("pair_id").alias("rec_id"), "node_id", F.least(F.col("weight") + F.when(F.col("linked").isNotNull(), 0.2).otherwise(0.0), F.lit(1.0)).alias("confidence"))
    page_links = topic.join(headed, ["page_id", "node_id"], "left").select(
        F.lit("webpage").alias("src_table"), F.col("page_id").alias("rec_id"), "node_id", F.least(F.coalesce("weight", F.lit(0.5)) * 0.5 + F.col("facts") * 0.15, F.lit(1.0)).alias("confidence"))
    return pair_links.unionByName(page_links)
