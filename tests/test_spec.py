import json

import pytest

from litscreen.operators.results import project_columns, result_schema, sql_columns
from litscreen.spec import ReviewSpec, keyword_groups, text_type

SETTINGS = {
    "scholar_search": {"top_sections_per_article": 10, "pubmed": {"top_articles_per_search": 200}},
    "prompt": {
        "research_question": "How does {drug} act on {ion_channel}?",
        "research_goal": "to learn what a drug does",
        "input_parameters": [
            {"name": "ion_channel", "max_length": 10, "value": [
                {"name": "kv1.1", "pubmed_alias": '["kv 1.1", "kcna1"]', "llm_aliases": '["kcna1"]'},
                {"name": "kv1.2", "pubmed_alias": "", "llm_alias": '["kcna2"]'},
            ]},
            {"name": "drug", "max_length": 20, "value": [{"name": "lidocaine", "pubmed_alias": "", "llm_alias": ""}]},
        ],
        "output_features": [
            {"name": "section_analysis", "data_type": "dict", "required": False},
            {"name": "sufficient_sections", "data_type": "int", "required": False, "multiple_values": True},
            {"name": "effect", "max_length": 5, "required": False, "allowed_values": [
                {"name": "none", "alias": "NR", "description": "nothing reported"},
                {"name": "close", "alias": "CLOSE", "description": "closes"},
                {"name": "open", "alias": "OPEN", "description": "opens"},
            ]},
            {"name": "dose_response", "data_type": "str", "max_length": 255},
            {"name": "study_type", "max_length": 6, "multiple_values": True, "allowed_values": [
                {"name": "cell", "alias": "CELL", "description": "in a dish"},
                {"name": "animal", "alias": "ANIMAL", "description": "in an animal"},
            ]},
            {"name": "subject", "data_type": "str", "max_length": 255},
        ],
    },
}


def test_declared_sql_types():
    assert sql_columns(ReviewSpec.from_dict(SETTINGS)) == [
        ("id", "INT"), ("pubmed_id", "LONGTEXT"), ("format", "LONGTEXT"), ("sections", "LONGTEXT"),
        ("ion_channel", "VARCHAR(10)"), ("drug", "VARCHAR(20)"), ("section_analysis", "JSON"),
        ("sufficient_sections", "JSON"), ("effect", "VARCHAR(5)"), ("dose_response", "TINYTEXT"),
        ("study_type", "JSON"), ("subject", "TINYTEXT"),
    ]


def test_both_spellings_of_aliases_are_read():
    channel = ReviewSpec.from_dict(SETTINGS).inputs[0]
    assert [i.question_aliases for i in channel.items] == [["kcna1"], ["kcna2"]]
    assert [i.search_aliases for i in channel.items] == [["kv 1.1", "kcna1"], None]


def test_search_settings_and_schema():
    spec = ReviewSpec.from_dict(SETTINGS)
    assert (spec.top_articles, spec.top_sections, spec.overwrite_existing) == (200, 10, False)
    assert result_schema(spec).fieldNames() == ["id", *spec.columns]
    assert spec.keys == ["ion_channel", "drug", "pubmed_id"]


def changed(path, value):
    settings = json.loads(json.dumps(SETTINGS))
    target = settings
    for step in path[:-1]:
        target = target.setdefault(step, {}) if isinstance(target, dict) else target[step]
    target[path[-1]] = value
    return settings


def test_unknown_type_fails():
    with pytest.raises(ValueError, match="is declared as"):
        ReviewSpec.from_dict(changed(["prompt", "output_features", 3, "data_type"], "date"))


@pytest.mark.parametrize("columns", [["format", "pubmed_id"], [], ["pubmed_id", "colour"]])
def test_article_id_is_the_first_metadata_column(columns):
    with pytest.raises(ValueError):
        ReviewSpec.from_dict(changed(["sql_database", "metadata", "to_save"], columns))


def test_missing_result_column_fails(spark):
    with pytest.raises(ValueError, match="columns missing"):
        project_columns(spark.range(1), ReviewSpec.from_dict(SETTINGS))


def test_format_instructions_name_features_and_choices():
    text = ReviewSpec.from_dict(SETTINGS).format_instructions()
    schema = json.loads(text[text.index("{"):])
    assert schema["required"] == ["dose_response", "study_type", "subject"]
    assert schema["properties"]["study_type"]["items"]["enum"] == ["CELL", "ANIMAL"]


@pytest.mark.parametrize("text, groups", [
    ("", []),
    ("AND (trade OR port)", [["trade", "port"]]),
    ("AND (cortex OR (brain AND region))", [["cortex", "brain"], ["cortex", "region"]]),
    ('"brain stem" AND human cell', [["brain stem"], ["human cell"]]),
])
def test_keyword_text_becomes_groups(text, groups):
    assert keyword_groups(text) == groups


@pytest.mark.parametrize("text", ["AND (a OR", "a NOT b", "OR a", 'a "b', "a ) b"])
def test_unreadable_keywords_raise(text):
    with pytest.raises(ValueError, match="cannot read the search keywords"):
        keyword_groups(text)


@pytest.mark.parametrize("width, name", [(1, "VARCHAR(1)"), (29, "VARCHAR(29)"), (30, "TINYTEXT"), (255, "TINYTEXT"), (256, "LONGTEXT"), (None, "LONGTEXT")])
def test_text_widths(width, name):
    assert text_type(width) == name
