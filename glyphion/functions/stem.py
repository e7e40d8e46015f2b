"""The Porter stemmer (M. F. Porter, 1980) as a column function, and folding of accents.

The rules are data. Each step transforms an array of words, since a lambda's variable may be used
many times over without its expression being written out as often.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
ONE_OR_MORE = f"^(?:{_C})?{_V}{_C}"  # the measure of a stem, by expression
EXACTLY_ONE = f"^(?:{_C})?{_V}{_C}(?:{_V})?$"
TWO_OR_MORE = f"^(?:{_C})?{_V}{_C}{_V}{_C}"
HAS_VOWEL = f"^(?:{_C})?[aeiouy]"
SHORT_END = f"^{_C}[aeiouy][^aeiouwxy]$"
DOUBLE = "(?:bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"

# The published rules. Of a step the longest suffix that fits applies.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


@cache
def _accents() -> tuple[str, str]:
    """Latin letters with marks and their bare forms, by canonical decomposition."""
    marked = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


def fold(text: Column) -> Column:
    """Latin letters without their accents."""
    marked, bare = _accents()
    return F.translate(text, marked, bare)


def _cut(w: Column, suffix: str, to: str = "") -> Column:
    """w with as many letters less as suffix has, and `to` after it."""
    kept = F.left(w, F.greatest(F.length(w) - len(suffix), F.lit(0)))
    return F.concat(kept, F.lit(to)) if to else kept


def _longest(w: Column, rules: dict[str, str], measure: str) -> Column:
    """The longest suffix decides; it is replaced if the stem before it has the measure (and, before `ion`, ends in s or t)."""
    out = None
    for suffix in sorted(rules, key=len, reverse=True):
        base = _cut(w, suffix)
        fits = base.rlike(measure) & base.rlike("[st]$") if suffix == "ion" else base.rlike(measure)
        changed = F.when(fits, F.concat(base, F.lit(rules[suffix]))).otherwise(w)
        out = F.when(w.endswith(suffix), changed) if out is None else out.when(w.endswith(suffix), changed)
    return out.otherwise(w)


def _plurals(w: Column) -> Column:
    return F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, "es")).when(w.endswith("ss"), w).when(w.endswith("s"), _cut(w, "s")).otherwise(w)


def _past(w: Column) -> Column:
    """A blank in front says that nothing is to be mended after what was taken off."""
    done = lambda c: F.concat(F.lit(" "), c)
    eed = F.when(_cut(w, "eed").rlike(ONE_OR_MORE), done(_cut(w, "d"))).otherwise(done(w))
    ed, ing = _cut(w, "ed"), _cut(w, "ing")
    return F.when(w.endswith("eed"), eed).when(w.endswith("ed") & ed.rlike(HAS_VOWEL), ed).when(w.endswith("ing") & ing.rlike(HAS_VOWEL), ing).otherwise(done(w))


def _mended(w: Column) -> Column:
    longer = w.endswith("at") | w.endswith("bl") | w.endswith("iz")
    out = F.when(w.startswith(" "), F.substring(w, 2, 1000)).when(longer, F.concat(w, F.lit("e")))
    return out.when(w.rlike(DOUBLE), _cut(w, "x")).when(w.rlike(SHORT_END), F.concat(w, F.lit("e"))).otherwise(w)


def _final_e(w: Column) -> Column:
    base = _cut(w, "e")
    return F.when(w.endswith("e") & (base.rlike(TWO_OR_MORE) | (base.rlike(EXACTLY_ONE) & ~base.rlike(SHORT_END))), base).otherwise(w)


_STEPS = [
    lambda w: F.when(w.startswith("y"), F.concat(F.lit("Y"), F.substring(w, 2, 1000))).otherwise(w), _plurals, _past, _mended,
    lambda w: F.when(w.endswith("y") & _cut(w, "y").rlike(HAS_VOWEL), _cut(w, "y", "i")).otherwise(w),
    lambda w: _longest(w, STEP_2, ONE_OR_MORE), lambda w: _longest(w, STEP_3, ONE_OR_MORE), lambda w: _longest(w, dict.fromkeys(STEP_4, ""), TWO_OR_MORE), _final_e,
    lambda w: F.when(w.endswith("ll") & w.rlike(TWO_OR_MORE), _cut(w, "l")).otherwise(w),
]


def _unless(mark: str, step):
    return lambda w: F.when(w.startswith(mark), w).otherwise(step(w))


def stems(words: Column) -> Column:
    """The stems of an array of lower-case words, in order; words of fewer than three letters stay, and so do nulls."""
    kept = "="  # in front of words that are left alone
    out = F.transform(words, lambda w: F.when(F.length(w) < 3, F.concat(F.lit(kept), w)).otherwise(w))
    for step in _STEPS:
        out = F.transform(out, _unless(kept, step))
    return F.transform(out, lambda w: F.when(w.startswith(kept), F.substring(w, 2, 10)).otherwise(F.lower(w)))
