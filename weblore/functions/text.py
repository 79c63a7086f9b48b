"""Scalar text functions as column expressions: cleaning, comparing, hashing, paths.

Null inputs give null unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weblore.functions.stem import STOP_WORDS, stemmed

# Characters that cleaning deletes, literals that count as true.
DELETED = "\"\\/',;.|-:$"
TRUE_LITERALS = ("true", "1", "t", "y", "yes", "True", "TRUE")
# Thresholds of string equality for short (both under 10 characters) and other strings.
SHORT_LENGTH, SHORT_EQUAL, LONG_EQUAL = 10, 0.85, 0.80


def clean(text: Column) -> Column:
    """Lower case ASCII words: line breaks, tabs and hyphens become blanks, punctuation and all
    non-ASCII characters vanish, blanks are squeezed, everything from '&nbs' on is cut."""
    flat = F.translate(F.lower(text), "-\n\t\r", "    ")
    bare = F.regexp_replace(F.translate(flat, DELETED, ""), r"[^\x20-\x7e]", "")
    return F.regexp_replace(F.regexp_replace(F.trim(bare), " +", " "), "&nbs.*$", "")


def without_brackets(text: Column) -> Column:
    """Without everything from the first opening to the last closing bracket, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?s)\(.*\)", ""))


def similarity(a: Column, b: Column) -> Column:
    """1 minus edit distance over the sum of lengths; null for two empty strings."""
    total = F.length(a) + F.length(b)
    return F.try_divide(total - F.levenshtein(a, b), total)


def alike(a: Column, b: Column) -> Column:
    """Fuzzy equality: brackets are ignored if both strings keep something, empty is never alike."""
    least = F.when((F.length(a) < SHORT_LENGTH) & (F.length(b) < SHORT_LENGTH), SHORT_EQUAL).otherwise(LONG_EQUAL)
    bare_a, bare_b = without_brackets(a), without_brackets(b)
    both = (bare_a != "") & (bare_b != "")
    x, y = F.when(both, bare_a).otherwise(a), F.when(both, bare_b).otherwise(b)
    # the difference of lengths bounds the edit distance from below: most pairs never reach levenshtein
    gap, total = F.abs(F.length(x) - F.length(y)), F.length(x) + F.length(y)
    return F.when((x == "") | (y == ""), F.lit(False)).when(total - gap < least * total, F.lit(False)).otherwise(similarity(x, y) >= least)


def core_words(text: Column, other: Column) -> Column:
    """The text as alike_meaning compares it: brackets left out if both texts keep something, else only the bracket signs;
    cleaned, without stop words, stemmed."""
    bare, bare_other = without_brackets(text), without_brackets(other)
    flat = F.when((bare != "") & (bare_other != ""), bare).otherwise(F.translate(text, "()", ""))
    return stemmed(F.array_join(without_stop_words(words(clean(flat)), list(STOP_WORDS)), " "))


def alike_meaning(a: Column, b: Column) -> Column:
    """Fuzzy equality of two texts without regard to brackets, stop words and endings."""
    return alike(core_words(a, b), core_words(b, a))


def hash_id(text: Column, digits: int = 16) -> Column:
    """SHA-1 of the text as an integer modulo 10^digits (digits up to 16)."""
    value, modulus = F.lit(0).cast("decimal(38,0)"), 10**digits
    for start, width in ((1, 10), (11, 10), (21, 10), (31, 10)):
        part = F.conv(F.substring(F.sha1(F.encode(text, "utf-8")), start, width), 16, 10).cast("decimal(38,0)")
        value = (value * F.lit(16**width).cast("decimal(20,0)") + part) % F.lit(modulus).cast("decimal(20,0)")
        value = value.cast("decimal(18,0)")
    return value.cast("long")


def first_number(text: Column) -> Column:
    """The first run of digits, null without one."""
    return F.nullif(F.regexp_extract(text, r"[0-9]+", 0), F.lit(""))


def truth(text: Column) -> Column:
    """Whether the text is one of seven literals for true."""
    return text.isin(*TRUE_LITERALS)


def insert_after(text: Column, mark: Column, addition: Column) -> Column:
    """The text with the addition behind the first occurrence of the mark; unchanged without one."""
    at = F.call_function("locate", mark, text)
    end = at + F.length(mark)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), end - 1), addition, F.substring(text, end, F.length(text)))).otherwise(text)


def ancestor_paths(xpath: Column) -> Column:
    """Every prefix of an absolute path, the path itself included."""
    steps = F.filter(F.split(xpath, "/"), lambda s: s != "")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(steps, F.lit(1), n), "/")))


def dom_distance(a: Column, b: Column) -> Column:
    """Steps between two nodes of a tree: size of the symmetric difference of their ancestor sets."""
    x, y = ancestor_paths(a), ancestor_paths(b)
    return F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))


def is_below(xpath: Column, top: Column) -> Column:
    """Whether a node lies strictly below another."""
    return F.startswith(xpath, F.concat(top, F.lit("/")))


def tag_of(xpath: Column) -> Column:
    """Last step of a path without its index."""
    return F.regexp_replace(F.element_at(F.split(xpath, "/"), -1), r"\[.*\]", "")


def words(text: Column) -> Column:
    """Words of a cleaned text."""
    return F.filter(F.split(text, " +"), lambda w: w != "")


def without_stop_words(tokens: Column, stop: list[str]) -> Column:
    """Tokens that are not stop words."""
    return F.filter(tokens, lambda w: ~w.isin(*stop))


def vector_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of equal length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, d: s + d))


def short_number(value: Column) -> Column:
    """A count as text, with thousands separators from 10,000 on."""
    return F.when(value >= 10000, F.format_number(value, 0)).otherwise(value.cast("string"))


def duration_text(seconds: Column) -> Column:
    """Whole seconds as days, hours, minutes and seconds, from the first unit that is not zero; -1 is '-'."""
    s = seconds.cast("long")
    units = [(F.floor(s / 86400), "d"), (F.pmod(F.floor(s / 3600), F.lit(24)), "h"), (F.pmod(F.floor(s / 60), F.lit(60)), "m"), (F.pmod(s, F.lit(60)), "s")]
    parts = [F.concat(v.cast("string"), F.lit(u)) for v, u in units]
    text = lambda k: F.concat_ws(":", *parts[k:])
    return F.when(s == -1, "-").when(s >= 86400, text(0)).when(s >= 3600, text(1)).when(s >= 60, text(2)).otherwise(text(3))
