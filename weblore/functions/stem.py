"""English stemming by the published Porter2 rules, as an Arrow function over distinct words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The published word lists of the algorithm.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent",
    "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize",
    "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because "
    "as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don "
    "should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn".split()
)


def _regions(word: str) -> tuple[int, int]:
    """Starts of R1 and R2: behind the first non-vowel that follows a vowel, and again."""
    start = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)

    def after(begin: int) -> int:
        m = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, begin)
        return m.end() if m else len(word)

    r1 = after(0) if start is None else start
    return r1, after(r1)


def _short_syllable(word: str) -> bool:
    return bool(re.search(f"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$", word) or re.fullmatch(f"[{VOWELS}][^{VOWELS}]", word))


def stem(word: str) -> str:
    """Stem of one lower-case word; words of up to two letters are their own stems."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = word.lstrip("'")
    word = re.sub("^y", "Y", word)
    word = re.sub(f"([{VOWELS}])y", r"\1Y", word)
    r1, r2 = _regions(word)
    word = re.sub("('s'|'s|')$", "", word)

    # plural endings
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{VOWELS}]", word[:-2]):
        word = word[:-1]
    if word in KEPT_AFTER_1A:
        return word.lower()

    # past and progressive
    if m := re.search("(eedly|eed)$", word):
        if m.start() >= r1:
            word = word[: m.start()] + "ee"
    elif (m := re.search("(ingly|edly|ing|ed)$", word)) and re.search(f"[{VOWELS}]", word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _short_syllable(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    # derivational endings, longest first
    for end, new in sorted(STEP2.items(), key=lambda e: -len(e[0])):
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                word = word[: -len(end)] + new
            break
    else:
        if word.endswith("ogi"):
            if len(word) - 3 >= r1 and word[-4:-3] == "l":
                word = word[:-1]
        elif word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] in tuple(LI_ENDINGS):
            word = word[:-2]
    for end, new in sorted(STEP3.items(), key=lambda e: -len(e[0])):
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                word = word[: -len(end)] + new
            break
    else:
        if word.endswith("ative") and len(word) - 5 >= r2:
            word = word[:-5]
    for end in STEP4:
        if word.endswith(end):
            if len(word) - len(end) >= r2:
                word = word[: -len(end)]
            break
    else:
        if word.endswith("ion") and len(word) - 3 >= r2 and word[-4:-3] in ("s", "t"):
            word = word[:-3]

    # final e and l
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_syllable(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def stem_sentence(text: str | None) -> str | None:
    """Stems of a cleaned text's words, joined by blanks."""
    return None if text is None else " ".join(stem(w) for w in text.split())


@F.pandas_udf(StringType())
def _stem_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}
    for texts in batches:
        if len(known) > 500_000:
            known = {}
        yield texts.map(lambda t: None if t is None else " ".join(known[w] if w in known else known.setdefault(w, stem(w)) for w in t.split()))


def stemmed(text: Column) -> Column:
    """stem_sentence of a column, in Arrow batches with a bounded cache of words."""
    return _stem_texts(text)
