"""Tokenizers for search: ASCII, Unicode with folded diacritics, English stems, and the search table's own.

``plain`` and ``folded`` are expressions.  The others need a stemmer, written
here from the published English (Porter2) algorithm, and run Arrow-batched.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The English stop words of a public full-text dictionary.
STOPWORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
    has had having do does did doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
    just don should now""".split()
)
MAX_BYTES = 64


def plain(x: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), 1)


def folded(x: Column) -> Column:
    """Runs of Unicode letters and digits, lower-cased, without the diacritics of Latin letters."""
    low = F.translate(F.lower(x), "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")
    return F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}]+)"), 1)


VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Fixed values of the algorithm: words that are stems as they are, or stem in their own way.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
INVARIANT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _region(w: str, start: int) -> int:
    """After the first non-vowel that follows a vowel."""
    for i in range(start + 1, len(w)):
        if w[i] not in VOWELS and w[i - 1] in VOWELS:
            return i + 1
    return len(w)


def _short_end(w: str) -> bool:
    """Ends in a short syllable."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS + "wxY"


def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) <= 2 or not word.isascii():
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.lstrip("'")
    w = ("Y" + w[1:]) if w.startswith("y") else w
    w = re.sub(r"([aeiou])y", r"\1Y", w)
    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = first if first is not None else _region(w, 0)
    r2 = _region(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in INVARIANT:
        return w
    if w.endswith(("eedly", "eed")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                rest = w[: -len(s)]
                if any(c in VOWELS for c in rest):
                    if rest.endswith(("at", "bl", "iz")):
                        w = rest + "e"
                    elif rest.endswith(DOUBLES):
                        w = rest[:-1]
                    elif _short_end(rest) and r1 >= len(rest):
                        w = rest + "e"
                    else:
                        w = rest
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for s in sorted(STEP2, key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + STEP2[s]
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for s in sorted([*STEP3, "ative"], key=len, reverse=True):
        if w.endswith(s):
            if s == "ative":
                w = w[:-5] if len(w) - 5 >= r2 else w
            elif len(w) - len(s) >= r1:
                w = w[: -len(s)] + STEP3[s]
            break
    for s in STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2:
                w = w[: -len(s)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


EMAIL = re.compile(r"^[\w.+-]+@[\w-]+\.[\w.-]+$")
COMPOUND = re.compile(r"^\w+([-_./:#]\w+)+$")


def search_tokens(text: str) -> list[str]:
    """E-mail addresses whole; compound identifiers whole and split; other words lower-cased, without stop words, stemmed."""
    out = []
    for word in text.split():
        core = word.strip(".,;:!?()[]{}\"'").lower()
        if EMAIL.match(core):
            out.append(core)
            continue
        if COMPOUND.match(core):
            out.append(core)
        for part in re.findall(r"[^\W_]+", core):
            if part not in STOPWORDS and len(part.encode()) <= MAX_BYTES:
                out.append(stem(part))
    return [t for t in out if len(t.encode()) <= MAX_BYTES]


@F.pandas_udf(T.ArrayType(T.StringType()))
def search(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else search_tokens(s))


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


@F.pandas_udf(T.ArrayType(T.StringType()))
def porter(x: pd.Series) -> pd.Series:
    """Unicode words, folded and stemmed."""
    return x.map(lambda s: None if s is None else [stem(w) for w in re.findall(r"[^\W_]+", fold(s))])
