"""Problem 2: text that was decoded with the wrong character encoding.

One scan emits, per input batch, the distinct words with non-ASCII characters (the clean
corpus candidates) and the suspicious tokens of each record: a garbled character always
leaves at least two adjacent non-ASCII characters, or U+FFFD. From then on only small token
tables are shuffled. Garbled forms of every distinct clean word under all chains (every two
encodings, and one encoding up to MAX_ROUNDS times) travel as hashes and are joined with the
distinct suspicious tokens; a match is verified by garbling its word again. A token whose clean
word never occurs in the corpus is decoded by the inverse chain; the result is accepted if the
letter case fits the word and every decoded character is a letter whose bytes leave no doubt or
attested in clean words. Restoring is a second scan that swaps the garbled tokens; texts are
not shuffled but for those of affected records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblore.llm.pagelines import visible
from weblore.session import cut

# Encodings that UTF-8 bytes are commonly misread in.
UTF8_MISREADINGS = ("cp1252", "latin-1", "mac_roman", "cp1251", "cp1250", "iso8859_15", "cp1254", "cp437", "cp850", "koi8_r")
# Fixed values: (written in, read in) of single-byte Cyrillic text.
BYTE_MISREADINGS = (("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"))
MAX_ROUNDS = 3
MOST_SWAPS = 200_000  # distinct garbled tokens that may travel with a scan (some 10 MB)
MIN_WORDS = 2  # a character counts as attested from this many clean words on, whatever the size of the corpus
# Letters of these ranges need no attestation where the bytes leave no doubt: Latin, Greek, Cyrillic.
LATIN, OTHER_LETTERS = re.compile("[A-Za-z\u00c0-\u024f]"), re.compile("[\u0370-\u03ff\u0400-\u045f]")
LOST = "�"
EDGE = "“”«»„‘’…—–¿¡"
BLANKS, WORDS = re.compile(r"[ \t\r\n\f\v]+"), re.compile(r"[^ \t\r\n\f\v]+")
RUN = re.compile(r"[^\x00-\x7f]+")
PAIR = re.compile(r"[^\x00-\x7f]{2}|�")
CONTROL = re.compile("[\u0080-\u009f]")
ASCII_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
QUOTES = {"“": "”", "«": "»", "„": "“"}
SCRIPT = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|$)", re.S | re.I)
TAGS = re.compile(r"<[a-zA-Z/!?][^<>]*(?:>|$)")
COMMENTS = re.compile(r"<!--.*?(?:-->|$)", re.S)


def page_text(page: str) -> str:
    """Visible text of a page, tags replaced by blanks, script and style left out."""
    return visible(TAGS.sub(" ", COMMENTS.sub(" ", SCRIPT.sub(" ", page))))


def _to_bytes(text: str, encoding: str) -> bytes | None:
    """Bytes of the text; code points below 256 that the encoding lacks stand for themselves."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        out = bytearray()
        for c in text:
            try:
                out += c.encode(encoding)
            except UnicodeEncodeError:
                if ord(c) > 255:
                    return None
                out.append(ord(c))
        return bytes(out)


def _to_text(raw: bytes, encoding: str) -> str:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return "".join(_one(b, encoding) for b in raw)


def _one(byte: int, encoding: str) -> str:
    try:
        return bytes((byte,)).decode(encoding)
    except UnicodeDecodeError:
        return chr(byte)


def chains() -> list[tuple[str, ...]]:
    """All chains of misreadings that are tried forward; a later chain never replaces an earlier one's form."""
    rounds = [(e,) * k for k in range(1, MAX_ROUNDS + 1) for e in UTF8_MISREADINGS]
    return rounds + [(a, b) for a in UTF8_MISREADINGS for b in UTF8_MISREADINGS if a != b]


def garbled_forms(word: str) -> dict[str, str]:
    """Garbled form -> chain, for every chain that changes the word."""
    forms: dict[str, str] = {}
    once = {e: _to_text(word.encode("utf-8", "surrogatepass"), e) for e in UTF8_MISREADINGS}
    known: dict[tuple[str, ...], str] = {(e,): t for e, t in once.items()}
    step: dict[tuple[bytes, str], str] = {}
    for chain in chains():
        if chain not in known:
            raw = known[chain[:-1]].encode("utf-8", "surrogatepass")
            known[chain] = step[raw, chain[-1]] if (raw, chain[-1]) in step else step.setdefault((raw, chain[-1]), _to_text(raw, chain[-1]))
        if known[chain] != word:
            forms.setdefault(known[chain], "+".join(chain))
    for written, read in BYTE_MISREADINGS:
        try:
            text = _to_text(word.encode(written), read)
        except UnicodeEncodeError:
            continue
        if text != word:
            forms.setdefault(text, f"{written}>{read}")
    forms.setdefault(RUN.sub(lambda m: LOST * len(m.group()), word), "lost")
    return forms


def core(token: str) -> str:
    """The token without ASCII punctuation at its ends and without a pair of quotes around it."""
    token = token.strip(ASCII_EDGE)
    while len(token) > 2 and QUOTES.get(token[0]) == token[-1]:
        token = token[1:-1].strip(ASCII_EDGE)
    return token


def _step(text: str, encoding: str) -> str | None:
    """The text that was once misread in the encoding, None if it was not."""
    raw = _to_bytes(text, encoding)
    try:
        step = raw.decode("utf-8") if raw is not None else text
    except UnicodeDecodeError:
        return None
    return step if step != text else None


def decode_run(run: str) -> tuple[str, str] | None:
    """(original, chain) of a run of non-ASCII characters that misread UTF-8 explains, else None.

    Any encoding may follow any other: the first that leaves letters only, the one of the round before
    ahead of the others; else the one of the round before, in the first round the first that decodes.
    """
    text, chain = run, []
    while len(chain) < MAX_ROUNDS:
        steps = [(step, encoding) for encoding in (*chain[-1:], *UTF8_MISREADINGS) if (step := _step(text, encoding)) is not None]
        clear = [s for s in steps if all(LATIN.match(c) or OTHER_LETTERS.match(c) for c in s[0])]
        found = clear or [s for s in steps if not chain or s[1] == chain[-1]]
        if not found:
            break
        text, encoding = found[0]
        chain.append(encoding)
    return (text, "+".join(chain)) if chain else None


def certain_letters(run: str, decoded: str, token: str) -> str:
    """The decoded letters that need no attestation: none if the run holds a character that also ends words, and
    none of a script other than Latin inside a word with Latin letters."""
    if any(c in EDGE for c in run):
        return ""
    return "".join(c for c in decoded if c.isalpha() and (LATIN.match(c) or (OTHER_LETTERS.match(c) and not re.search("[A-Za-z]", token))))


def _case_fits(before: str, decoded: str) -> bool:
    """False for a lower-case letter decoded after at least two capitals and no small letter."""
    letters = [c for c in re.split(r"[^\w]|\d", before)[-1] if c.isalpha()]
    return not (decoded[0].islower() and len(letters) >= 2 and all(c.isupper() for c in letters))


def inverse(token: str) -> tuple[str, str, str] | None:
    """(restored token, chain, decoded characters that must be attested) by inverse chains, None if none applies."""
    out, at, chain, decoded = [], 0, "", ""
    for m in RUN.finditer(token):
        run, lead = m.group(), ""
        found = decode_run(run)
        if not found:
            inner = run.strip(EDGE)
            if inner and inner != run and (found := decode_run(inner)):
                lead = run[: run.index(inner)]
                found = (lead + found[0] + run[len(lead) + len(inner) :], found[1])
        if found and _case_fits(token[: m.start()], found[0][len(lead) :]):
            out += [token[at : m.start()], found[0]]
            sure = certain_letters(run, found[0], token)
            at, chain, decoded = m.end(), chain or found[1], decoded + "".join(c for c in found[0] if c not in sure)
    if chain:
        return "".join(out) + token[at:], chain, decoded
    if len(token) >= 3 and all("À" <= c <= "ÿ" for c in token):
        for written, read in BYTE_MISREADINGS[:2]:
            raw = _to_bytes(token, read)
            text = raw.decode(written, "replace") if raw else ""
            if text.isalpha() and all("Ѐ" <= c <= "ӿ" for c in text) and (text.islower() or text.isupper() or text.istitle()):
                return text, f"{written}>{read}", text
    return None


TOKENS = "src_table string, rec_id long, token string"


def _scan(batches: Iterator[pa.RecordBatch], src: str, is_page: bool) -> Iterator[pa.RecordBatch]:
    """Suspicious tokens as (src, record, token); other non-ASCII words, once a batch, with record null."""
    for batch in batches:
        ids, tokens, clean = [], [], set()
        for rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text or (text.isascii() and not (is_page and "&" in text)):
                continue
            text = page_text(text) if is_page else text
            if text.isascii():
                continue
            own = {t for t in BLANKS.split(text) if not t.isascii()}
            for t in own:
                if PAIR.search(t):
                    if c := core(t):
                        ids.append(rec)
                        tokens.append(c)
                clean.add(t)
        words = {w for t in clean for part in t.split("\u00a0") if (w := part.strip(ASCII_EDGE).strip(EDGE)) and not w.isascii()}
        yield pa.RecordBatch.from_arrays(
            [pa.array([src] * (len(ids) + len(words)), pa.string()), pa.array(ids + [None] * len(words), pa.int64()), pa.array(tokens + list(words), pa.string())],
            names=["src_table", "rec_id", "token"],
        )


def _garble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash of the garbled form, clean word) of every form of every word."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        for at in range(0, len(words), 2000):
            rows = [(form_hash(form), word) for word in words[at : at + 2000] for form in garbled_forms(word)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["form", "original"])


def form_hash(form: str) -> int:
    """The engine's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(form.encode("utf-8", "surrogatepass"), seed=42)
    return h - (1 << 64) if h >> 63 else h


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, original, other, chain) of the matches whose word really has the token as a garbled form."""
    for batch in batches:
        out = []
        for token, word, other in zip(*(c.to_pylist() for c in batch.columns)):
            forms = garbled_forms(word)
            if token in forms:
                out.append((token, word if word == other else None, forms[token]))
            elif word != other and token in (forms := garbled_forms(other)):  # the smaller word only shares the hash
                out.append((token, other, forms[token]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], names=["token", "original", "chain"])


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per token its inverse; chain 'unrestorable' where characters are lost or only controls are left."""
    for batch in batches:
        out = []
        for token in batch.column(0).to_pylist():
            found = inverse(token)
            if found:
                out.append((token, found[0], found[1], sorted({c for c in found[2] if c not in EDGE and not c.isspace()})))
            if LOST in token or (not found and CONTROL.search(token)):
                out.append((token, None, "unrestorable", []))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([r[i] for r in out], pa.string()) for i in range(3)), pa.array([r[3] for r in out], pa.list_(pa.string()))],
            names=["token", "original", "chain", "chars"],
        )


def _is_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w in batch.column(0).to_pylist() if LOST not in w and not CONTROL.search(w) and inverse(w) is None], pa.string())], names=["word"]
        )


def scan_tokens(records: DataFrame, src: str, is_page: bool) -> DataFrame:
    """records: (id, text). Null and empty texts give no rows."""
    return records.mapInArrow(lambda it: _scan(it, src, is_page), TOKENS)


def garbled_tokens(scanned: DataFrame) -> DataFrame:
    """(token, original, chain) of every distinct suspicious token that is garbled.

    original is null if it cannot be restored; of several clean words with one garbled form
    the smallest is not chosen: the token then stays garbled with original null.
    """
    words = scanned.filter("rec_id is null").select("token").distinct().mapInArrow(_is_clean, "word string")
    table = words.mapInArrow(_garble, "form long, original string").groupBy("form").agg(F.min("original").alias("original"), F.max("original").alias("other"))
    tokens = cut(scanned.filter("rec_id is not null").select("token").distinct())
    met = tokens.withColumn("form", F.xxhash64("token")).join(table, "form").select("token", "original", "other")
    matched = cut(met.mapInArrow(_verify, "token string, original string, chain string"))
    counts = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("char")).groupBy("char").agg(F.count("*").alias("n"))
    attested = counts.filter(F.col("n") >= MIN_WORDS).select("char")
    inverted = cut(tokens.join(matched.select("token"), "token", "left_anti").mapInArrow(_invert, "token string, original string, chain string, chars array<string>"))
    missing = (
        inverted.select("token", "chain", F.explode("chars").alias("char")).filter(~F.col("char").rlike(r"^[\x00-\x7f]$"))
        .join(attested, "char", "left_anti").select("token", "chain").distinct()
    )
    return matched.unionByName(inverted.join(missing, ["token", "chain"], "left_anti").select("token", "original", "chain"))


def garbled_records(scanned: DataFrame) -> DataFrame:
    """(src_table, rec_id, token, original, chain) of every garbled token of every record."""
    scanned = cut(scanned)
    found = garbled_tokens(scanned)
    return scanned.filter("rec_id is not null").distinct().join(found, "token").select("src_table", "rec_id", "token", "original", "chain")


def swapped(text: str, swaps: dict[str, str]) -> str:
    """The text with every garbled token replaced at its own bounds: whole words between blanks, punctuation and quotes kept."""
    out, at = [], 0
    for m in WORDS.finditer(text):
        word = m.group()
        if not word.isascii() and (inner := core(word)) in swaps:
            begin = word.index(inner)
            out += [text[at : m.start()], word[:begin], swaps[inner], word[begin + len(inner) :]]
            at = m.end()
    return "".join(out) + text[at:] if out else text


def _restore(batches: Iterator[pa.RecordBatch], is_page: bool, swaps: dict[str, str | None]) -> Iterator[pa.RecordBatch]:
    """The affected records of a scan, their garbled tokens swapped; a token with null is affected but stays."""
    usable = {k: v for k, v in swaps.items() if v is not None}
    for batch in batches:
        ids, texts = [], []
        for rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text or (text.isascii() and not (is_page and "&" in text)):
                continue
            text = page_text(text) if is_page else text
            if not text.isascii() and any(not w.isascii() and core(w) in swaps for w in BLANKS.split(text)):
                ids.append(rec)
                texts.append(swapped(text, usable))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["rec_id", "restored"])


def _restore_listed(batches: Iterator[pa.RecordBatch], is_page: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, swaps in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            texts.append(swapped(page_text(text) if is_page and text else text, {s["token"]: s["original"] for s in swaps or ()}))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["rec_id", "restored"])


def restore(records: DataFrame, garbled: DataFrame, src: str, is_page: bool) -> DataFrame:
    """(src_table, rec_id, restored) of the affected records; what cannot be restored stays as it is.

    garbled: as from garbled_records. Up to MOST_SWAPS distinct tokens travel with the scan, so only the affected
    records are shuffled, to drop repeats; beyond that the records meet their own tokens by a join.
    """
    own = garbled.filter(F.col("src_table") == src)
    distinct = cut(own.groupBy("token").agg(F.max("original").alias("original")))
    records = records.toDF("rec_id", "text")
    if distinct.count() <= MOST_SWAPS:
        swaps = {r.token: r.original for r in distinct.collect()}
        found = records.mapInArrow(lambda it: _restore(it, is_page, swaps), "rec_id long, restored string").groupBy("rec_id").agg(F.max("restored").alias("restored"))
    else:
        lists = own.groupBy("rec_id").agg(F.collect_set(F.when(F.col("original").isNotNull(), F.struct("token", "original"))).alias("swaps"))
        found = records.groupBy("rec_id").agg(F.max("text").alias("text")).join(lists, "rec_id").mapInArrow(lambda it: _restore_listed(it, is_page), "rec_id long, restored string")
    return found.select(F.lit(src).alias("src_table"), "rec_id", "restored")
