"""Text to lower-case ASCII, with Indic scripts romanised and letters of other scripts spelled by sound.

The nine Indic scripts share the layout of one code page, so that one table of offsets serves all blocks; what differs is
kept per script. Cyrillic and Greek have tables; other letters go by their Unicode names, ideographs by their code, so
that no letter ever vanishes and different names don't meet as blanks. Everything here works on Unicode, for which Spark SQL has no functions, hence the Arrow UDF.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDIC = re.compile("[ऀ-ൿ]+")
#: Scripts whose final inherent vowel falls silent; the other four of the nine blocks keep it.
SILENT_FINAL = ("devanagari", "bengali", "gurmukhi", "gujarati", "oriya")
SCRIPTS = SILENT_FINAL + ("tamil", "telugu", "kannada", "malayalam")

# Sounds by offset in a block.
VOWELS = "a a i i u u r l e e e ai o o o au".split()
CONSONANTS = "k kh g gh n c ch j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v s s s h".split()
SIGNS = "a i i u u r r e e e ai o o o au".split()
OTHER = {0x01: "m", 0x02: "m", 0x03: "h", 0x4E: "t", 0x50: "om", 0x60: "r", 0x61: "l", 0x70: "m", 0x7A: "n", 0x7B: "n", 0x7C: "r", 0x7D: "l", 0x7E: "l", 0x7F: "k"}
ASCII_FOLDS = {"œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ß": "ss", "ẞ": "SS", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "ı": "i", "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": ",,", "–": "-", "—": "--", "…": "...", "•": "*", "«": "<<", "»": ">>", "№": "No", "©": "(c)", "®": "(r)", "€": "EUR", "£": "PS", "×": "x", "·": "*", "´": "'", "ŋ": "ng"}


CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґўђјљњћџ", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch ' y ' e iu ia io i yi ie g u dj j lj nj c dz".split()))
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split()))
#: Sounds of two or more letters that the names of letters begin with.
DIGRAPHS = ("tch", "zh", "sh", "ch", "kh", "gh", "th", "ph", "ts", "dz", "dj", "ny", "ng")


@lru_cache(maxsize=100_000)
def letter(c: str) -> str:
    """ASCII spelling of a character that isn't ASCII; marks and symbols give nothing, spaces and punctuation a space."""
    low = c.lower()
    if low in CYRILLIC or low in GREEK:
        return CYRILLIC.get(low) or GREEK[low]
    kind, name = unicodedata.category(c), unicodedata.name(c, "")
    if name.startswith("HANGUL SYLLABLE "):
        return name.rsplit(" ", 1)[1].lower()
    parts = unicodedata.normalize("NFKD", c)
    if parts != c:
        return "".join(x if x.isascii() else letter(x) for x in parts)
    if kind[0] in "ZP":
        return " "
    if kind == "Nd":
        return str(unicodedata.digit(c))
    if kind[0] != "L":
        return ""
    if " LETTER " not in f" {name} " or "IDEOGRAPH" in name:
        return f"u{ord(c):x} "  # a word of its own
    sound = re.sub("^(?:SMALL|CAPITAL|FINAL|MODIFIER|LETTER) ", "", name.split(" LETTER ", 1)[1].split(" WITH ")[0]).replace("SMALL ", "").lower()
    if "KATAKANA" in name or "HIRAGANA" in name:
        return re.sub("[^a-z]", "", sound) or f"u{ord(c):x}"
    return next((d for d in DIGRAPHS if sound.startswith(d)), re.sub("[^a-z]", "", sound)[:1]) or f"u{ord(c):x}"


def romanise(run: str) -> str:
    """Latin spelling of a run of Indic letters; the run's first letter names the script."""
    script = (ord(run[0]) - 0x0900) >> 7
    out: list[str] = []
    open_vowel = False  # a consonant waits for its vowel, "a" unless a sign or the killer follows
    for ch in run:
        at = (ord(ch) - 0x0900) & 0x7F
        if at == 0x3C:  # the dot below
            continue
        if 0x3E <= at <= 0x4C:
            out.append(SIGNS[at - 0x3E])
            open_vowel = False
            continue
        if at == 0x4D:
            open_vowel = False
            continue
        if open_vowel:
            out.append("a")
        open_vowel = False
        if 0x05 <= at <= 0x14:
            out.append(VOWELS[at - 0x05])
        elif 0x15 <= at <= 0x39:
            out.append(CONSONANTS[at - 0x15])
            open_vowel = True
        elif 0x58 <= at <= 0x5F:
            out.append("k kh g j d dh f y".split()[at - 0x58])
            open_vowel = True
        else:
            out.append(OTHER.get(at, ""))
    if open_vowel:
        out.append("a")
    return spoken("".join(out), script < len(SILENT_FINAL))


def spoken(spelling: str, silent: bool) -> str:
    """A romanised word as it sounds: a nasal takes the place of the sound behind it, and where ``silent``, a final vowel
    of longer words falls away unless two consonants before it need one."""
    word = [c for c in spelling if "a" <= c <= "z"]
    for i, behind in enumerate(word[1:]):
        if word[i] == "m" and behind not in "aeioupbm":
            word[i] = "n"
    if silent and len(word) > 3 and word[-1] == "a" and word[-2] not in "aeiou" and (word[-2] not in "ryv" or word[-3] in "aeiou"):
        word.pop()
    return "".join(word)


_romanise = lru_cache(maxsize=100_000)(romanise)


def ascii_lower(text: str | None) -> tuple[str, bool]:
    """Compatibility form, Indic runs romanised, folded to ASCII and lower-cased; and whether there was such a run."""
    if not text:
        return "", False
    if text.isascii():
        return text.lower(), False
    text = unicodedata.normalize("NFKC", text)
    indic = INDIC.search(text) is not None
    if indic:
        text = INDIC.sub(lambda m: _romanise(m[0]), text)
    text = "".join(c if c.isascii() else ASCII_FOLDS[c] if c in ASCII_FOLDS else letter(c) for c in text)
    return text.lower(), indic


FOLDED = T.StructType([T.StructField("text", T.StringType()), T.StructField("indic", T.BooleanType())])


def _fold(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for v in values:
        yield pd.DataFrame([ascii_lower(x) for x in v], columns=["text", "indic"])


def to_ascii_lower(text: Column) -> Column:
    """struct(text, indic) of a string column; null counts as empty."""
    return F.pandas_udf(_fold, FOLDED)(F.coalesce(text, F.lit("")))
