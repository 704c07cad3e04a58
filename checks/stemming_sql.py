"""The published English stemming rules as SQL, one common table per step, over ``vocabulary(token)``."""

from __future__ import annotations

from litscreen.functions import fixed

V, C = f"[{fixed.STEM_VOWELS}]", f"[^{fixed.STEM_VOWELS}]"
SHORT = f"({C}{V}[^{fixed.STEM_VOWELS}wxY]|^{V}{C})$"


def _head(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _region(text: str) -> str:
    found = f"length(regexp_extract({text}, '^.*?{V}{C}'))"
    return f"CASE WHEN {found} > 0 THEN {found} ELSE length({text}) END"


def _case(rules: dict[str, tuple[str, str]]) -> str:
    """``suffix -> (condition, result)``; the longest suffix decides, and a failed condition leaves the word."""
    whens = [
        f"WHEN ends_with(w, '{s}') THEN CASE WHEN {cond} THEN {new} ELSE w END"
        for s, (cond, new) in sorted(rules.items(), key=lambda r: -len(r[0]))
    ]
    return "CASE " + " ".join(whens) + " ELSE w END"


def _within(suffix: str, region: str) -> str:
    return f"length(w) - {len(suffix)} >= {region}"


def _swap(suffix: str, new: str, condition: str) -> tuple[str, str]:
    return condition, f"{_head(len(suffix))} || '{new}'"


def _steps() -> list[str]:
    ie = f"CASE WHEN length(w) > 4 THEN {_head(2)} ELSE {_head(1)} END"
    plural = _case({
        "sses": ("true", _head(2)), "ied": ("true", ie), "ies": ("true", ie), "us": ("false", "w"), "ss": ("false", "w"),
        "s": (f"regexp_matches(w, '{V}.+s$')", _head(1)),
    })
    # A finished word ends in '!', a word that lost its ending in '*'.
    kept = ", ".join(f"'{w}'" for w in fixed.STEM_KEPT_AFTER_PLURAL)
    past = _case(
        {s: _swap(s, "ee", _within(s, "r1")) for s in ("eed", "eedly")}
        | {s: _swap(s, "*", f"regexp_matches({_head(len(s))}, '{V}')") for s in ("ed", "edly", "ing", "ingly")}
    )
    base = _head(1)
    mended = f"""CASE WHEN w NOT LIKE '%*' THEN w
        WHEN regexp_matches({base}, '(at|bl|iz)$') THEN {base} || 'e'
        WHEN regexp_matches({base}, '({'|'.join(fixed.STEM_DOUBLES)})$') THEN {_head(2)}
        WHEN length({base}) <= r1 AND regexp_matches({base}, '{SHORT}') THEN {base} || 'e' ELSE {base} END"""
    two = {s: _swap(s, new, _within(s, "r1")) for s, new in fixed.STEM_STEP_2.items()}
    two["ogi"] = _swap("ogi", "og", _within("ogi", "r1") + " AND ends_with(w, 'logi')")
    two["li"] = _swap("li", "", _within("li", "r1") + f" AND regexp_matches(w, '[{fixed.STEM_LI_LETTERS}]li$')")
    three = {s: _swap(s, new, _within(s, "r1")) for s, new in fixed.STEM_STEP_3.items()}
    three["ative"] = _swap("ative", "", _within("ative", "r2"))
    four = {s: _swap(s, "", _within(s, "r2")) for s in fixed.STEM_STEP_4}
    four["ion"] = _swap("ion", "", _within("ion", "r2") + " AND regexp_matches(w, '[st]ion$')")
    loose = f"{_within('e', 'r2')} OR ({_within('e', 'r1')} AND NOT regexp_matches({base}, '{SHORT}'))"
    five = _case({
        "e": (loose, base), "l": (_within("l", "r2") + " AND ends_with(w, 'll')", base), "!": ("true", base),
    })
    return [
        plural,
        f"CASE WHEN w IN ({kept}) THEN w || '!' ELSE {past} END",
        mended,
        f"CASE WHEN regexp_matches(w, '^.+{C}[yY]$') THEN {base} || 'i' ELSE w END",
        _case(two), _case(three), _case(four), five,
    ]


def stem_tables() -> str:
    """Common tables from ``vocabulary(token)`` to ``stems(token, stem)``."""
    special = f"^({'|'.join(fixed.STEM_R1_PREFIXES)})"
    tables = [
        f"""stem_marked AS (
            SELECT token, regexp_replace(regexp_replace(token, '^y', 'Y'), '({V})y', '\\1Y', 'g') AS w FROM vocabulary)""",
        f"""stem_first AS (
            SELECT token, w, CASE WHEN regexp_matches(w, '{special}') THEN length(regexp_extract(w, '{special}'))
                             ELSE {_region('w')} END AS r1 FROM stem_marked)""",
        f"stem_0 AS (SELECT token, w, r1, r1 + {_region('substr(w, r1 + 1)')} AS r2 FROM stem_first)",
    ]
    steps = _steps()
    for i, step in enumerate(steps):
        tables.append(f"stem_{i + 1} AS (SELECT token, {step} AS w, r1, r2 FROM stem_{i})")
    whole = " ".join(f"WHEN token = '{k}' THEN '{v}'" for k, v in fixed.STEM_WHOLE_WORDS.items())
    tables.append(
        f"""stems AS (SELECT token, CASE WHEN length(token) <= 2 THEN token {whole} ELSE replace(w, 'Y', 'y') END AS stem
            FROM stem_{len(steps)})"""
    )
    return ", ".join(tables)
