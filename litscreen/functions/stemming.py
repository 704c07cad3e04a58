"""English (Porter2) stemming as one column expression.

The published rules are written with built-in functions, so stemming needs no Python worker. Each rule reads the word
many times; ``_let`` binds it to a lambda variable first, so the expression grows with the number of rules only and stays
small when the optimizer moves a filter across it. Words never contain an apostrophe here (the word pattern excludes
it), so the rules for it are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from litscreen.functions import fixed

_V = f"[{fixed.STEM_VOWELS}]"
_C = f"[^{fixed.STEM_VOWELS}]"
_SHORT_SYLLABLE = f"({_C}{_V}[^{fixed.STEM_VOWELS}wxY]|^{_V}{_C})$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _region_start(word: Column, offset: Column) -> Column:
    """Characters before the region that follows the first vowel + non-vowel at or after ``offset``."""
    at = F.regexp_instr(F.substring(word, offset + 1, F.length(word)), F.lit(f"{_V}{_C}"))
    return F.when(at > 0, offset + at + 1).otherwise(F.length(word))


def _longest_suffix(word: Column, rules: Mapping[str, Column]) -> Column:
    """Apply the rule of the longest suffix the word ends in."""
    out = F
    for suffix in sorted(rules, key=len, reverse=True):
        out = out.when(word.endswith(suffix), rules[suffix])
    return out.otherwise(word)


def _inside(word: Column, suffix: str, start: Column) -> Column:
    return F.length(word) - len(suffix) >= start


def _swap(word: Column, suffix: str, new: str, condition: Column) -> Column:
    return F.when(condition, F.concat(_cut(word, len(suffix)), F.lit(new))).otherwise(word)


def _plural(w: Column) -> Column:
    ie = F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1))
    s = F.when(w.rlike(f"{_V}.+s$"), _cut(w, 1)).otherwise(w)
    return _longest_suffix(w, {"sses": _cut(w, 2), "ied": ie, "ies": ie, "us": w, "ss": w, "s": s})


def _past(w: Column, r1: Column) -> Column:
    def mended(base: Column) -> Column:
        return (
            F.when(base.rlike("(at|bl|iz)$"), F.concat(base, F.lit("e")))
            .when(base.rlike(f"({'|'.join(fixed.STEM_DOUBLES)})$"), _cut(base, 1))
            .when((F.length(base) <= r1) & base.rlike(_SHORT_SYLLABLE), F.concat(base, F.lit("e")))
            .otherwise(base)
        )

    rules = {s: _swap(w, s, "ee", _inside(w, s, r1)) for s in ("eed", "eedly")}
    for s in ("ed", "edly", "ing", "ingly"):
        rules[s] = F.when(_cut(w, len(s)).rlike(_V), _let(_cut(w, len(s)), mended)).otherwise(w)
    return _longest_suffix(w, rules)


def _final_y(w: Column) -> Column:
    return F.when(w.rlike(f"^.+{_C}[yY]$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _step_2(w: Column, r1: Column) -> Column:
    rules = {s: _swap(w, s, new, _inside(w, s, r1)) for s, new in fixed.STEM_STEP_2.items()}
    rules["ogi"] = _swap(w, "ogi", "og", _inside(w, "ogi", r1) & w.endswith("logi"))
    rules["li"] = _swap(w, "li", "", _inside(w, "li", r1) & w.rlike(f"[{fixed.STEM_LI_LETTERS}]li$"))
    return _longest_suffix(w, rules)


def _step_3(w: Column, r1: Column, r2: Column) -> Column:
    rules = {s: _swap(w, s, new, _inside(w, s, r1)) for s, new in fixed.STEM_STEP_3.items()}
    rules["ative"] = _swap(w, "ative", "", _inside(w, "ative", r2))
    return _longest_suffix(w, rules)


def _step_4(w: Column, r2: Column) -> Column:
    rules = {s: _swap(w, s, "", _inside(w, s, r2)) for s in fixed.STEM_STEP_4}
    rules["ion"] = _swap(w, "ion", "", _inside(w, "ion", r2) & w.rlike("[st]ion$"))
    return _longest_suffix(w, rules)


def _step_5(w: Column, r1: Column, r2: Column) -> Column:
    bare = _cut(w, 1)
    loose_e = _inside(w, "e", r2) | (_inside(w, "e", r1) & ~bare.rlike(_SHORT_SYLLABLE))
    return _longest_suffix(w, {
        "e": F.when(loose_e, bare).otherwise(w),
        "l": F.when(_inside(w, "l", r2) & w.endswith("ll"), bare).otherwise(w),
    })


def _by_rules(marked: Column) -> Column:
    prefix = F.length(F.regexp_extract(marked, f"^({'|'.join(fixed.STEM_R1_PREFIXES)})", 1))
    first = F.when(prefix > 0, prefix).otherwise(_region_start(marked, F.lit(0)))

    def suffixes(plain: Column, r1: Column, r2: Column) -> Column:
        chain = [
            lambda w: _past(w, r1),
            _final_y,
            lambda w: _step_2(w, r1),
            lambda w: _step_3(w, r1, r2),
            lambda w: _step_4(w, r2),
            lambda w: _step_5(w, r1, r2),
        ]
        word = plain
        for rule in chain:
            word = _let(word, rule)
        return F.when(plain.isin(*fixed.STEM_KEPT_AFTER_PLURAL), plain).otherwise(word)

    return _let(first, lambda r1: _let(
        _region_start(marked, r1), lambda r2: _let(_plural(marked), lambda w: suffixes(w, r1, r2))
    ))


def english_stem(token: Column) -> Column:
    """The English stem of a lower-case word."""
    # A consonantal y (first in the word, or after a vowel) is written Y while the rules run.
    marked = F.regexp_replace(F.regexp_replace(token, "^y", "Y"), f"({_V})y", "$1Y")
    stem = _let(marked, lambda w: F.translate(_by_rules(w), "Y", "y"))
    whole = F.create_map(*[F.lit(x) for pair in fixed.STEM_WHOLE_WORDS.items() for x in pair])
    return (
        F.when(F.length(token) <= 2, token)
        .when(token.isin(*fixed.STEM_WHOLE_WORDS), whole[token])
        .otherwise(stem)
    )
