"""What the Spark queries and the SQL have in common: features, templates and generated answers."""

from __future__ import annotations

from litscreen.spec import AllowedValue, Example, InputParameter, OutputFeature, ReviewSpec

FEATURES = [
    OutputFeature("verdict", required=False, allowed_values=[
        AllowedValue("unclear", "UN", "nothing can be said"),
        AllowedValue("useful", "US", "worth keeping"),
        AllowedValue("harmful", "HA", "better dropped"),
    ]),
    OutputFeature("evidence", "int", required=False, multiple_values=True),
    OutputFeature("kinds", multiple_values=True, allowed_values=[
        AllowedValue("prose", "PR", "running text"), AllowedValue("listing", "LI", "short lines"),
    ]),
    OutputFeature("note", "str", 200),
    OutputFeature("weight", "float", required=False),
    OutputFeature("flagged", "bool", required=False),
    OutputFeature("analysis", "dict", required=False),
]

# The answer an extractor might give for a labelled text, in SQL that both engines read. The last digit of the id picks
# a well formed answer or one kind of mistake.
_KINDS = """'["' || CASE WHEN quality = 1 THEN 'PR' ELSE 'LI' END || '"]'"""
_VERDICT = "CASE WHEN toxic = 1 THEN 'HA' WHEN quality = 1 THEN 'US' ELSE 'UN' END"
_NOTE = "'text ' || CAST(doc_id AS VARCHAR(20))"


def _answer(verdict=None, evidence=None, kinds=None, note=None, rest=""):
    parts = []
    if verdict is not None:
        parts.append(f"""'"verdict": ' || {verdict}""")
    if evidence is not None:
        parts.append(f"""'"evidence": ' || {evidence}""")
    if kinds is not None:
        parts.append(f"""'"kinds": ' || {kinds}""")
    if note is not None:
        parts.append(f"""'"note": ' || {note}""")
    body = " || ', ' || ".join(parts)
    return f"""'{{' || {body} || '{rest}' || '}}'"""


_GOOD = {
    "verdict": f"""'"' || {_VERDICT} || '"'""",
    "evidence": "'[' || CAST(doc_id AS VARCHAR(20)) || ', 2]'",
    "kinds": _KINDS,
    "note": f"""'"' || {_NOTE} || '"'""",
}
_REST = ', "weight": 0.5, "flagged": true, "analysis": {"section 2": "b", "section 1": "a"}'
ANSWER = f"""CASE doc_id % 10
    WHEN 0 THEN {_answer(**_GOOD, rest=_REST)}
    WHEN 1 THEN CASE doc_id % 40 WHEN 1 THEN '' WHEN 11 THEN 'Here is the JSON:' || chr(10) ELSE '' END
        || '```json' || chr(10) || {_answer(**_GOOD)} || chr(10) || '```'
        || CASE doc_id % 40 WHEN 1 THEN '' WHEN 31 THEN '' ELSE chr(10) || 'Hope this helps.' END
    WHEN 2 THEN '{{"verdict": "US", "kinds": ['
    WHEN 3 THEN '["PR"]'
    WHEN 4 THEN {_answer(verdict=_GOOD["verdict"], evidence=_GOOD["evidence"], kinds=_KINDS)}
    WHEN 5 THEN {_answer(**_GOOD | {"verdict": "'" + '"MAYBE"' + "'"})}
    WHEN 6 THEN {_answer(**_GOOD | {"evidence": "'" + '[1, "x"]' + "'"})}
    WHEN 7 THEN {_answer(**_GOOD | {"verdict": "'null'"}, rest=', "weight": 3')}
    WHEN 8 THEN {_answer(**_GOOD | {"kinds": "'" + '"PR"' + "'"})}
    WHEN 9 THEN CASE doc_id % 20
        WHEN 9 THEN 'Sure: ' || {_answer(**_GOOD | {"note": "'" + '"two' + "' || chr(10) || '" + 'lines"' + "'"})} || ' Done.'
        ELSE {_answer(kinds=_KINDS, note="'7'")} END
END"""

OPENING = "Read the sections and answer in JSON."
BLOCK = 'QUESTION: What is it?\n{"section_1":"A list."}\n{"verdict":"UN"}'

QUESTION_TEMPLATE = "What does {nation} make of {brand}, and why?"
EXTRA_KEYWORDS = "AND (trade OR port)"
EXTRA_GROUPS = [["trade", "port"]]
INPUTS = ["nation", "brand"]

# A review whose only input is the benchmark item.
ITEM_FEATURES = [
    OutputFeature("size_class", allowed_values=[AllowedValue("short", "S"), AllowedValue("long", "L")]),
    OutputFeature("n_chars", "int"),
]
LONG_PROMPT = 1_500
REVIEW_WORDS = ["the", "que"]


# Two worked examples; the number given as text must come out as a number.
EXAMPLES = [
    Example({"item": "one"}, {"section_1": "A list."}, {"size_class": "S", "n_chars": "7"}),
    Example({"item": "two"}, {"section_1": "Text."}, {"size_class": "L", "n_chars": 2_000}),
]


def item_review(features=ITEM_FEATURES, examples=()) -> ReviewSpec:
    return ReviewSpec(
        question="{item}", goal="to sort texts", inputs=[InputParameter("item", [], 20)], features=features, examples=examples
    )

# White space of a text that becomes one space, and characters that XML can't hold.
SPACES = "[\\s\u000b\u00a0\u0001-\u0008\u000e-\u001f]+"
