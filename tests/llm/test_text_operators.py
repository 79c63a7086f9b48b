"""Corpus operators on small fixtures: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblore.llm import encoding_repair, mixture, packing, repeated_lines, self_repetition, term_counts
from weblore.llm.boosted_trees import fit
from weblore.llm.components import components
from weblore.llm.main_content import decode


def page(*lines):
    return "\n".join(["<html>", "<head></head>", "<body>", "<h1>Some Title</h1>", *lines, "</body>"])


def test_repeated_lines(spark, monkeypatch):
    notice = "<p>Please share this {} page with all your friends</p>"
    rows = [(i, "t", page(notice.format("Some Title"), f"<p>own text number {'x' * i} of this one page here</p>")) for i in range(1, 11)]
    rows += [(1, "t", rows[0][2]), (20, None, page("short")), (21, "t", None), (22, "t", ""), (23, "t", "no body at all")]
    df = spark.createDataFrame(rows, "page_id long, template string, html string").withColumn("wording", F.lit("clash"))
    found = {tuple(r) for r in repeated_lines.repeated_lines(df).collect()}
    assert found == {(i, 5) for i in range(1, 11)}
    for most in (1_000_000, 0):
        monkeypatch.setattr(repeated_lines, "MOST_WORDINGS", most)
        cleaned = {r.page_id: r for r in repeated_lines.remove_repeated_lines(df).collect()}
        assert "share this" not in cleaned[3].html and cleaned[3].n_removed == 1 and cleaned[21].html is None and len(cleaned) == 14
        assert cleaned[1].html == rows[0][2].replace(notice.format("Some Title") + "\n", "") and cleaned[23].html == "no body at all"
    assert repeated_lines.repeated_lines(df.limit(0)).collect() == []


def test_share_threshold_is_inclusive(spark):
    line = "<p>one two three four five six seven</p>"
    rows = [(i, "t", page(line if i < 3 else "<p>x</p>")) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, template string, html string")
    assert len(repeated_lines.repeated_lines(df).collect()) == 3
    more = df.unionByName(spark.createDataFrame([(99, "t", page("<p>y</p>"))], df.schema))
    assert repeated_lines.repeated_lines(more).collect() == []


@pytest.mark.parametrize("chain", ["cp1252", "latin-1", "mac_roman", "cp1251"])
def test_garbled_words_are_restored(spark, chain):
    words = ["Thérèse", "Günter", "rivière", "été", "Señor"]
    clean = [(i, f"{w} walked by") for i, w in enumerate(words * 3)]
    broken = [(100 + i, encoding_repair._to_text(w.encode(), chain)) for i, w in enumerate(words)]
    fine = [(200, "CRIAÇÃO"), (201, "MAÇÃ®"), (202, "“AMANHÃ”"), (203, "Åsa"), (204, None), (205, ""), (206, "IRMÃ’S")]
    df = spark.createDataFrame(clean + broken + fine, "rec_id long, text string")
    garbled = encoding_repair.garbled_records(encoding_repair.scan_tokens(df, "s", False))
    got = {r.rec_id: r.original for r in garbled.collect()}
    assert {k for k in got} == {100 + i for i in range(len(words))}
    assert [got[100 + i] for i in range(len(words))] == words
    restored = {r.rec_id: r.restored for r in encoding_repair.restore(df, garbled, "s", False).collect()}
    assert restored[101] == "Günter"


def test_lost_characters_and_unknown_words(spark):
    clean = [(i, f"höflich Tür für schön {i}") for i in range(5)]
    df = spark.createDataFrame(clean + [(50, "h�flich"), (51, "x�y�z"), (52, "TÃ¼bingen")], "rec_id long, text string")
    got = {r.rec_id: r.original for r in encoding_repair.garbled_records(encoding_repair.scan_tokens(df, "s", False)).collect()}
    assert got == {50: "höflich", 51: None, 52: "Tübingen"}
    assert encoding_repair.garbled_records(encoding_repair.scan_tokens(df.limit(0), "s", False)).collect() == []


def test_all_chains_of_known_words_are_found_and_swapped_at_word_bounds(spark, monkeypatch):
    broken, k = {}, 1000
    for chain in [("cp437",) * 3, ("mac_roman", "cp1250"), ("cp850", "latin-1"), ("koi8_r",)]:
        text = "Thérèse"
        for encoding in chain:
            text = encoding_repair._to_text(text.encode(), encoding)
        broken[k], k = text, k + 1
    rows = [(1, "Thérèse walked"), (2, None)] + [(i, f"({t}), x{t}x {t}") for i, t in broken.items()]
    df = spark.createDataFrame(rows, "rec_id long, text string")
    garbled = encoding_repair.garbled_records(encoding_repair.scan_tokens(df, "s", False))
    want = {i: f"(Thérèse), x{t}x Thérèse" for i, t in broken.items()}
    for most in (200_000, 0):
        monkeypatch.setattr(encoding_repair, "MOST_SWAPS", most)
        restored = {r.rec_id: r.restored for r in encoding_repair.restore(df, garbled.filter(F.col("original") == "Thérèse"), "s", False).collect()}
        assert restored == want
    word = "naïve"
    assert spark.range(1).select(F.xxhash64(F.lit(word))).first()[0] == encoding_repair.form_hash(word)


def test_a_decoded_quote_is_not_decoded_again():
    assert encoding_repair.inverse("dâ€™Ã©tÃ©")[0] == "d’été"


def test_unknown_words_are_found_in_small_and_large_corpora(spark):
    broken = {}
    for i, (word, chain) in enumerate([("Côte", ["cp1252"]), ("Straße", ["cp437"]), ("Où", ["cp850"]), ("гость", ["latin-1"]), ("Ködel", ["cp1252", "mac_roman"]), ("Ďáblice", ["cp1250"])]):
        text = word
        for encoding in chain:
            text = encoding_repair._to_text(text.encode(), encoding)
        broken[900 + i] = (text, word)
    for size in (1, 30000):
        clean = [(10000 + i, f"w{i}é") for i in range(size)] + [(5, "IRMÃ’S"), (6, "síðá")]
        df = spark.createDataFrame(clean + [(k, t) for k, (t, _) in broken.items()], "rec_id long, text string")
        got = {r.rec_id: r.original for r in encoding_repair.garbled_records(encoding_repair.scan_tokens(df, "s", False)).collect()}
        assert got == {k: w for k, (_, w) in broken.items()}


def test_term_counts(spark):
    rows = [(1, ["A  b", "a b", None]), (2, ["a B"]), (2, ["a B"]), (3, None), (4, [""]), *((i, ["z"]) for i in range(10, 14))]
    df = spark.createDataFrame(rows, "id long, vals array<string>").withColumn("val", F.lit("clash"))
    out = {r.val: (r.n_occurrences, r.n_records, r.mark) for r in term_counts.term_counts(term_counts.block_counts(df, "id", {"f": F.col("vals")})).collect()}
    assert out == {"a b": (3, 2, "rare"), "": (1, 1, "rare"), "z": (4, 4, "common")}
    assert term_counts.term_counts(term_counts.block_counts(df.limit(0), "id", {"f": F.col("vals")})).collect() == []


def brute_repeats(words):
    marked, seen = [False] * len(words), set()
    for i in range(len(words) - 5):
        gram = tuple(words[i : i + 6])
        if gram in seen:
            marked[i : i + 6] = [True] * 6
        seen.add(gram)
    for k in range(1, 6):
        for i in range(k, len(words) - k + 1):
            if words[i : i + k] == words[i - k : i]:
                marked[i : i + k] = [True] * k
    return sum(marked)


def test_self_repetition_equals_brute_force():
    draw = random.Random(3)
    texts = [" ".join(draw.choice("abcdefg"[: draw.randint(1, 7)]) for _ in range(draw.randint(0, 60))) for _ in range(300)] + [None, "", "1 2 3", "<b>x</b> y " * 20000]
    words, repeated = self_repetition.repeated_words(texts)
    for t, n, r in zip(texts[:-1], words, repeated):
        tokens = (t or "").split() if not (t or "").startswith("1") else []
        assert (n, r) == (len(tokens), brute_repeats(tokens))
    assert repeated[-1] == words[-1] - 2


def test_a_long_tag_is_markup():
    assert [x.tolist() for x in self_repetition.repeated_words(["<a title='" + "buy this now " * 300 + "'>one two three</a>"])] == [[3], [0]]


@pytest.mark.parametrize("spam", [5, 60, 200])
def test_no_document_above_the_fixed_share_is_missed(spark, spam):
    draw = random.Random(spam)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rows = []
    for i in range(200):  # shares spread over the whole range, whatever the group's quantile
        own, again = [word() for _ in range(40)], draw.randint(7, 39) if i < spam else draw.randint(0, 9)
        rows.append((i, " ".join(own + own[:again]), "en", "s" if i % 3 else "small"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {r.doc_id for r in self_repetition.measured(df).collect() if r.n_repeated * 100 >= 30 * r.n_words}
    assert {r.doc_id for r in self_repetition.repetitive(df).collect()} == want and want
    limits = {(r.lang, r.source): r.threshold for r in self_repetition.thresholds(self_repetition.measured(df), whole_from=0.3).collect()}
    assert all(v <= 0.3 for v in limits.values())


def test_repetitive_documents(spark):
    unique = lambda i: " ".join(chr(97 + i % 26) + chr(97 + k // 26) + chr(97 + k % 26) for k in range(60))
    rows = [(i, unique(i), "en", "s") for i in range(20)] + [(100, "buy now " * 30, None, None), (101, None, "EN", "s"), (102, "", "en-GB", None), (103, "\n" * 100000, "??", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("share", F.lit(1))
    assert [r.doc_id for r in self_repetition.repetitive(df).collect()] == [100]
    assert self_repetition.repetitive(df.limit(0)).collect() == []


@pytest.mark.parametrize("capacity", [10, 50, 512])
def test_windows_hold_every_item_once(capacity):
    draw = random.Random(capacity)
    sizes = [draw.randint(1, capacity) for _ in range(200)]
    found = packing.windows(sizes, capacity)
    assert sorted(i for w in found for i in w) == list(range(200))
    assert max(sum(sizes[i] for i in w) for w in found) <= capacity
    assert packing.windows([], capacity) == [] and packing.windows([capacity], capacity) == [[0]]


def test_pack_splits_only_what_exceeds_the_capacity(spark):
    docs = spark.createDataFrame([(-(1 << 63) + 1, "word " * 1000), (2, "one two"), (2, "one two"), (3, None), (4, ""), ((1 << 62) + 5, "a b c d")], "doc_id long, text string")
    kinds = spark.createDataFrame([("small", 100), ("large", 5000)], "container_kind string, capacity_tokens int")
    rows = packing.pack(docs, kinds).collect()
    for kind, capacity in (("small", 100), ("large", 5000)):
        own = [r for r in rows if r.container_kind == kind]
        per = {}
        for r in own:
            per[r.container_id] = per.get(r.container_id, 0) + r.n_tokens
            assert r.part_no == 0 or r.doc_id == 1 - (1 << 63)
        assert max(per.values()) <= capacity and {r.doc_id for r in own} == {1 - (1 << 63), 2, (1 << 62) + 5}
    assert packing.pack(docs.limit(0), kinds).collect() == []


def test_mixture_meets_shares(spark):
    body = lambda s, i: " ".join(f"{s}{i}{k}" for k in range(20))
    rows = [(i, body("big", i), "big") for i in range(200)] + [(1000 + i, body("tiny", i), "tiny") for i in range(10)]
    rows += [(2000, rows[0][1], "tiny"), (3000, "text", None), (3001, None, "big"), (3002, "text", "unknown")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 3)], "source string, target_share double, max_repeats int")
    out = mixture.mix(docs, targets).collect()
    total = sum(r.n_tokens for r in out)
    assert abs(sum(r.n_tokens for r in out if r.source == "tiny") / total - 0.5) < 0.03
    uses = {}
    for r in out:
        uses[r.doc_id, r.source] = uses.get((r.doc_id, r.source), 0) + 1
    assert max(v for (d, s), v in uses.items() if s == "big") == 1 and max(v for (d, s), v in uses.items() if s == "tiny") == 3
    assert mixture.mix(docs.limit(0), targets).collect() == []


def test_a_source_whose_texts_all_stand_in_scarcer_ones_keeps_its_share(spark):
    body = lambda s, i: " ".join(f"{s}{i}{k}" for k in range(20))
    both = [(s * 1000 + i, body("copied", i), f"s{s}") for s in range(3) for i in range(60)]
    own = [(s * 1000 + 500 + i, body(f"own{s}", i), f"s{s}") for s in (1, 2) for i in range(30 * s)]
    docs = spark.createDataFrame(both + own, "doc_id long, text string, source string")
    # s0 has copies only and the smallest share, so the others are scarcer
    targets = spark.createDataFrame([("s0", 0.1, 1), ("s1", 0.4, 1), ("s2", 0.5, 1)], "source string, target_share double, max_repeats int")
    out = mixture.mix(docs, targets).collect()
    total = sum(r.n_tokens for r in out)
    held = sum({r.doc_id: r.n_tokens for r in out}.values())
    assert total == held and total > 2000
    assert abs(sum(r.n_tokens for r in out if r.source == "s0") / total - 0.1) < 0.03


def test_flow_prefers_few_repeats():
    ok, flows = mixture.route([(("a",), 10), (("a", "b"), 10), (("b",), 10)], {"a": 0.5, "b": 0.5}, {"a": 2, "b": 2}, 30)
    assert ok and sum(flows.values()) == 30 and all(v <= 10 for k, v in flows.items() if len(k[0]) == 1)


def brute_total(patterns, shares, repeats):
    low, high = 0, sum(t * max(repeats[s] for s in m) for m, t in patterns)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mixture.route(patterns, shares, repeats, mid)[0] else (low, mid - 1)
    return low


def test_newton_steps_find_the_largest_total():
    draw = random.Random(4)
    for _ in range(40):
        names = [f"s{i}" for i in range(draw.randint(1, 7))]
        patterns = {tuple(sorted(draw.sample(names, draw.randint(1, len(names))))): draw.randint(1, 5000) for _ in range(draw.randint(1, 12))}
        there = sorted({s for m in patterns for s in m})
        weight = {s: draw.random() + 0.01 for s in there}
        shares, repeats = {s: w / sum(weight.values()) for s, w in weight.items()}, {s: draw.randint(1, 4) for s in there}
        exact = brute_total(sorted(patterns.items()), shares, repeats)
        found = mixture.largest_total(sorted(patterns.items()), shares, repeats)
        assert found <= exact and exact - found <= len(there) / min(shares.values()) + 1
        assert mixture.route(sorted(patterns.items()), shares, repeats, found)[0]


def test_five_hundred_sources_in_seconds():
    draw = random.Random(8)
    names = [f"s{i}" for i in range(500)]
    patterns = {(s,): draw.randint(1000, 10**6) for s in names} | {tuple(sorted(draw.sample(names, draw.randint(2, 5)))): draw.randint(1, 10**5) for _ in range(5000)}
    began = time.time()
    total = mixture.largest_total(sorted(patterns.items()), dict.fromkeys(names, 1 / 500), dict.fromkeys(names, 3))
    assert mixture.route(sorted(patterns.items()), dict.fromkeys(names, 1 / 500), dict.fromkeys(names, 3), total)[0]
    assert time.time() - began < 60


def test_choices(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{'a' if i % 10 else 'b'}{i}x{k}" for k in range(20)), "big" if i % 10 else "tiny") for i in range(100)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 2)], "source string, target_share double, max_repeats int")
    rows = mixture.choices(docs, targets).orderBy("wish").collect()
    assert rows[0].wish == 0 and rows[0].exact and rows[0].furthest_share < 0.01
    assert rows[-1].corpus_used > rows[0].corpus_used and rows[-1].furthest_share > 0.1
    assert mixture.choices(docs.limit(0), targets).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(edges.limit(0)).collect() == []


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = fit(x[:2000], y[:2000], columns=1.0)
    assert ((model.logits(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    assert fit(np.zeros((0, 2)), np.zeros(0)).logits(np.zeros((3, 2))).shape == (3,)


def test_decoding_keeps_ancestors():
    parent, depth = np.array([-1, 0, 1, 1, 0, 4]), np.array([0, 1, 2, 2, 1, 2])
    chosen = decode(np.array([0, -1, 3, -2, -5, 2.0]), parent, depth)
    assert chosen.tolist() == [True, True, True, False, False, False]
