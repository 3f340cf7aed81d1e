"""Text analysis as columns: tokens, stop words, fuzzy weights; and a Porter stemmer."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TOKEN, MAX_TOKEN = 2, 64
#: The stop words of the tokenizer's contract.
STOP_WORDS = frozenset(
    """about after all also an and any are as at be because been before being between both but by can come could did do does done during each
    for from get got had has have he her here him his how if in into is it its just may me more most much my myself no not of on only or other our over
    said she should so some such than that the their then there these they this those to up very was we were what when where which who will with would you
    your a i""".split()
)
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, ASCII_LOWER, ASCII_UPPER)


#: A kept token: a whole run of ASCII word characters, in any case, of 2 to 64, that is
#: no stop word. Without its look-arounds a longer run would give its first 64.
_WORD = "[A-Za-z0-9_]"
TOKEN = f"(?<!{_WORD})(?!(?i:{'|'.join(sorted(STOP_WORDS))})(?!{_WORD})){_WORD}{{{MIN_TOKEN},{MAX_TOKEN}}}+(?!{_WORD})"


def tokens(text: Column) -> Column:
    """Kept tokens in order, in lower case: one JVM regex pass finds them, and as they
    are ASCII alone the whole list is lower-cased at once."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.array_remove(F.split(F.lower(F.array_join(found, " ")), " "), "")


def query_tokens(query: str, keep_stop: bool = False) -> list[str]:
    """Distinct tokens of a query, in order."""
    found = [w for w in re.findall("[a-z0-9_]+", re.sub("[A-Z]", lambda m: m[0].lower(), query)) if MIN_TOKEN <= len(w) <= MAX_TOKEN]
    return list(dict.fromkeys(w for w in found if keep_stop or w not in STOP_WORDS))


def phrase_tokens(phrase: str) -> list[str]:
    """Kept tokens of a phrase, in order, repeats too."""
    found = re.findall("[a-z0-9_]+", re.sub("[A-Z]", lambda m: m[0].lower(), phrase))
    return [w for w in found if MIN_TOKEN <= len(w) <= MAX_TOKEN and w not in STOP_WORDS]


def contains_tokens(text: Column, query: Column) -> Column:
    """The generic match: each white-space-separated token of the query occurs,
    whatever its case, as a substring. Null where either side is null."""
    parts = F.filter(F.split(ascii_lower(query), r"[ \t\r\n]+"), lambda t: t != "")
    low = ascii_lower(text)
    return F.when(text.isNotNull() & query.isNotNull(), F.forall(parts, lambda t: low.contains(t)))


_VOWEL = set("aeiou")


def _consonant(w: str, i: int) -> bool:
    if w[i] in _VOWEL:
        return False
    return not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    shape = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c", shape))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _short_end(w: str) -> bool:
    n = len(w)
    return n >= 3 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def stem(word: str) -> str:
    """Porter's algorithm (1980) for lower-case English words."""
    w = word
    if len(w) <= 2 or not w.isascii():
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if _measure(w[: len(w) - len(end)]) > 0:
                    w = w[: len(w) - len(end)] + new
                break
    for end in sorted(_STEP4, key=lambda x: -len(x)):
        if w.endswith(end):
            base = w[: len(w) - len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def highlight(text: str, terms: list[str], context: int = 80, most: int = 3, merge: int = 40, before: str = "<em>", after: str = "</em>", gap: str = "...", of: Callable[[str], str] | None = None) -> list[str]:
    """Snippets of a text around its query terms: regions of some characters on
    both sides, merged when near, cut at white space, terms marked. With `of`, a word
    is a term's if of(word) is one."""
    wanted = set(terms)
    marks = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9_]+", text) if (of(m[0].lower()) if of else m[0].lower()) in wanted]
    regions: list[list] = []
    for s, e in marks:
        lo, hi = max(0, s - context), min(len(text), e + context)
        if regions and lo <= regions[-1][1] + merge:
            regions[-1][1] = hi
            regions[-1][2].append((s, e))
        else:
            regions.append([lo, hi, [(s, e)]])
    out = []
    for lo, hi, inside in regions[:most]:
        if lo > 0:
            while lo < inside[0][0] and not text[lo - 1].isspace():
                lo += 1
        if hi < len(text):
            while hi > inside[-1][1] and not text[hi].isspace():
                hi -= 1
        parts, at = [], lo
        for s, e in inside:
            parts += [text[at:s], before, text[s:e], after]
            at = e
        parts.append(text[at:hi])
        out.append((gap if lo > 0 else "") + "".join(parts) + (gap if hi < len(text) else ""))
    return out
