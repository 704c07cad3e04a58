"""What a review asks for: a plain description built from a dictionary (or a YAML file of the same shape)."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from litscreen.functions import fixed

# What each declared type is stored as; text, and every choice, goes by its greatest width instead.
STORED_AS = {"bool": "BOOL", "int": "INT", "float": "FLOAT", "list": "JSON", "dict": "JSON"}
TEXT_WIDTHS = ((29, "VARCHAR({0})"), (255, "TINYTEXT"))
WIDE_TEXT = "LONGTEXT"
SEVERAL_VALUES = STORED_AS["list"]


def text_type(width: int | None) -> str:
    """The narrowest text type that holds ``width`` characters; an unknown width may be any."""
    fitting = (name for most, name in TEXT_WIDTHS if width is not None and width <= most)
    return next(fitting, WIDE_TEXT).format(width)


def _aliases(value: Any) -> list[str] | None:
    """Aliases may be given as JSON text or as a list; empty means none."""
    found = json.loads(value) if isinstance(value, str) and value.strip() else value
    return list(found) if found else None


def keyword_groups(text: str) -> list[list[str]]:
    """Free keywords such as ``AND (cortex OR (brain AND region))`` as OR-groups that must all match.

    ``a OR (b AND c)`` is written out as ``(a OR b) AND (a OR c)``. A term may be several words, quoted or not, but the
    words AND and OR, and brackets, always structure the text. Text that can't be read this way raises, so that no search
    runs without its keywords.
    """
    marks = re.findall(r'"[^"]*"|[()]|[^\s()"]+|"', text)
    if marks and marks[0] == "AND":
        marks = marks[1:]
    where = iter([*marks, None])
    now = next(where)

    def fail():
        raise ValueError(f"cannot read the search keywords {text!r}; use AND, OR, brackets and plain or quoted terms")

    def step():
        nonlocal now
        now = next(where)

    def term() -> list[list[str]]:
        if now == "(":
            step()
            inner = both()
            if now != ")":
                fail()
            step()
            return inner
        words = []
        while now not in (None, "(", ")", "AND", "OR", "NOT", '"'):
            words.append(now.strip('"'))
            step()
        if not "".join(words):
            fail()
        return [[" ".join(words)]]

    def either() -> list[list[str]]:
        groups = term()
        while now == "OR":
            step()
            groups = [[*g, *h] for h in term() for g in groups]
        return groups

    def both() -> list[list[str]]:
        groups = either()
        while now == "AND":
            step()
            groups = groups + either()
        return groups

    if not marks:
        return []
    groups = both()
    if now is not None:
        fail()
    return groups


@dataclass(frozen=True)
class InputItem:
    name: str
    search_aliases: Sequence[str] | None = None
    question_aliases: Sequence[str] | None = None


@dataclass(frozen=True)
class InputParameter:
    name: str
    items: Sequence[InputItem]
    max_length: int | None = None
    description: str = ""

    @property
    def sql_type(self) -> str:
        return text_type(self.max_length)


@dataclass(frozen=True)
class AllowedValue:
    name: str
    alias: str
    description: str = ""


@dataclass(frozen=True)
class OutputFeature:
    name: str
    data_type: str = "str"
    max_length: int | None = None
    required: bool = True
    multiple_values: bool = False
    allowed_values: Sequence[AllowedValue] = ()
    description: str = ""

    @property
    def sql_type(self) -> str:
        if self.data_type != "str" and self.data_type not in STORED_AS:
            raise ValueError(f"{self.name} is declared as {self.data_type!r}; known are str, {', '.join(STORED_AS)}")
        one = text_type(self.max_length) if self.allowed_values else STORED_AS.get(self.data_type) or text_type(self.max_length)
        return SEVERAL_VALUES if self.multiple_values else one

    @property
    def element_type(self) -> T.DataType:
        """Spark type of one value; lists and objects without a declared element stay JSON text."""
        if self.allowed_values:
            return T.StringType()
        plain = {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}
        return plain.get(self.data_type, T.StringType())

    @property
    def spark_type(self) -> T.DataType:
        return T.ArrayType(self.element_type) if self.multiple_values else self.element_type


@dataclass(frozen=True)
class Example:
    inputs: Mapping[str, str]
    sections: Mapping[str, str]
    outputs: Mapping[str, Any]


@dataclass(frozen=True)
class ReviewSpec:
    question: str
    goal: str
    inputs: Sequence[InputParameter]
    features: Sequence[OutputFeature]
    exclude: str = ""
    examples: Sequence[Example] = ()
    extra_keywords: str = ""
    extra_groups: Sequence[Sequence[str]] = ()
    top_articles: int = fixed.TOP_ARTICLES_PER_SEARCH
    top_sections: int = fixed.TOP_SECTIONS_PER_ARTICLE
    overwrite_existing: bool = False
    to_save: Sequence[str] = field(default=fixed.METADATA_COLUMNS)

    def __post_init__(self) -> None:
        if not self.to_save or self.to_save[0] != fixed.ARTICLE_KEY:
            raise ValueError(f"{fixed.ARTICLE_KEY!r} must be the first metadata column")
        unknown = set(self.to_save) - set(fixed.METADATA_COLUMNS)
        if unknown:
            raise ValueError(f"unknown metadata columns: {sorted(unknown)}")
        for column in (*self.inputs, *self.features):
            _ = column.sql_type  # an undeclared type fails here, before any work starts
        _ = self.search_groups  # and so do keywords that can't be read

    @property
    def search_groups(self) -> list[list[str]]:
        """Keyword groups that every search must match besides its inputs: those listed, and those of the keyword text."""
        return [list(g) for g in self.extra_groups] + keyword_groups(self.extra_keywords)

    @property
    def params(self) -> list[str]:
        return [p.name for p in self.inputs]

    @property
    def columns(self) -> list[str]:
        """Result columns after the id: metadata, inputs, features."""
        return [*self.to_save, *self.params, *[f.name for f in self.features]]

    @property
    def keys(self) -> list[str]:
        """What makes a result row unique: every input and the article."""
        return [*self.params, fixed.ARTICLE_KEY]

    @classmethod
    def from_dict(cls, settings: Mapping[str, Any]) -> ReviewSpec:
        """Read settings laid out as ``prompt``, ``scholar_search``, ``sql_database`` and ``data_processing``."""
        prompt = settings["prompt"]
        search = settings.get("scholar_search", {})
        articles = search.get("pubmed", {})
        metadata = settings.get("sql_database", {}).get("metadata", {})
        inputs = [
            InputParameter(
                p["name"],
                [
                    InputItem(
                        v["name"], _aliases(v.get("pubmed_alias")), _aliases(v.get("llm_alias", v.get("llm_aliases")))
                    )
                    for v in p["value"]
                ],
                p.get("max_length"),
                p.get("description", ""),
            )
            for p in prompt["input_parameters"]
        ]
        features = [
            OutputFeature(
                f["name"], f.get("data_type", "str"), f.get("max_length"), f.get("required", True),
                f.get("multiple_values", False),
                [AllowedValue(a["name"], a["alias"], a.get("description", "")) for a in f.get("allowed_values") or ()],
                f.get("description", ""),
            )
            for f in prompt["output_features"]
        ]
        examples = [
            Example(e["input_parameters"], e["sections"], e["output_features"]) for e in prompt.get("examples", ())
        ]
        return cls(
            question=prompt["research_question"],
            goal=prompt["research_goal"],
            inputs=inputs,
            features=features,
            exclude=prompt.get("information_to_exclude", ""),
            examples=examples,
            extra_keywords=articles.get("additional_search_keywords") or "",
            extra_groups=articles.get("additional_search_groups") or (),
            top_articles=articles.get("top_articles_per_search", fixed.TOP_ARTICLES_PER_SEARCH),
            top_sections=search.get("top_sections_per_article", fixed.TOP_SECTIONS_PER_ARTICLE),
            overwrite_existing=settings.get("data_processing", {}).get("overwrite_existing", False),
            to_save=metadata.get("to_save", fixed.METADATA_COLUMNS),
        )

    @classmethod
    def from_yaml(cls, path: str) -> ReviewSpec:
        try:
            import yaml
        except ImportError as error:
            raise ImportError("reading a YAML file needs PyYAML; use ReviewSpec.from_dict instead") from error
        with open(path, encoding="utf-8") as file:
            return cls.from_dict(yaml.safe_load(file) or {})

    def input_rows(self, spark):
        """The dimension table ``(param, pos, name, search_aliases, question_aliases)``."""
        rows = [
            (p.name, i, v.name, v.search_aliases, v.question_aliases) for p in self.inputs for i, v in enumerate(p.items)
        ]
        schema = "param string, pos int, name string, search_aliases array<string>, question_aliases array<string>"
        return spark.createDataFrame(rows, schema)

    def format_instructions(self) -> str:
        """Tells the extractor which JSON object to return."""
        names = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "list": "array", "dict": "object"}
        properties = {}
        for f in self.features:
            one: dict[str, Any] = {"type": names[f.data_type]}
            if f.allowed_values:
                one = {
                    "enum": [a.alias for a in f.allowed_values],
                    "documentation": {a.alias: a.description for a in f.allowed_values},
                }
            properties[f.name] = {"description": f.description} | ({"type": "array", "items": one} if f.multiple_values else one)
        schema = {"properties": properties, "required": [f.name for f in self.features if f.required]}
        return "Answer with one JSON object that fits this JSON schema:\n" + json.dumps(schema, ensure_ascii=False)
