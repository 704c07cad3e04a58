"""Journal XML to articles: the DOI, every abstract paragraph, titled section paragraphs, and the number of sections.

The tags that make up an article's frame are read by ``from_xml`` with a declared schema. What stands inside a paragraph or
a title (emphasis, references, formulas) is set aside as text first, so mixed content is kept whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litscreen.functions.scale import once
from litscreen.sources.markup import _plain

# The tags of the frame, tags whose whole content is no running text, and the attribute that tells a DOI.
FRAME_TAGS = ("article-id", "abstract", "body", "sec", "title", "p")
SET_ASIDE = ("fig", "fig-group", "table-wrap", "table-wrap-group", "supplementary-material", "sub-article", "response")
DOI = "doi"

PART = "struct<p: array<string>, sec: array<struct<title: string, p: array<string>>>>"
FRAME = f"doi string, abstract {PART}, body {PART}"

_INLINE = "\ue000"  # stands for the < of a tag that is no part of the frame
# The sign above and characters that XML can't hold, one by one: a list of them is one lookup, ranges are one after another.
_UNWANTED = "".join(rf"\x{c:02x}" for c in range(0x20) if chr(c) not in "\t\n\r") + r"\ue000\ufffe\uffff"


def _element(xml: Column, tag: str) -> Column:
    """The inside of the first ``tag``, or an empty text."""
    return F.regexp_extract(xml, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)


def _frame(inside: Column) -> Column:
    """Only sections, titles and paragraphs as tags, in one level: a section ends where the next one begins.

    So sections may be nested to any depth and stay in their order; a paragraph ends at the next tag of the frame, so
    paragraphs of a list inside a paragraph are paragraphs too.
    """
    text = F.regexp_replace(inside, r"<(?!/?(?:sec|title|p)(?:\s[^>]*)?/?>)", _INLINE)
    text = F.regexp_replace(text, r"<(sec|title|p)(?:\s[^>]*)?(/?)>", "<$1$2>")
    text = F.regexp_replace(text, r"<(?:(?:sec|p|title)/|/(?:sec|p)\s*)>", "")
    # Loose text between a section's tags is no paragraph.
    text = F.regexp_replace(text, r"<p>([^<]*)", "<p>$1</p>")
    text = F.regexp_replace(text, r"(<(?:/p|/title|sec)>)[^<]+", "$1")

    def piece(s: Column, i: Column) -> Column:
        loose = F.regexp_replace(s, r"^[^<]+|<title>[^<]*</title>", "")
        return F.when(i == 0, loose).otherwise(F.concat(F.lit("<sec>"), s, F.lit("</sec>")))

    # What stands before the first section comes first.
    return F.array_join(F.transform(F.split(text, "<sec>"), piece), "")


def articles_from_journals(df: DataFrame, id_col: str = "article_id", xml_col: str = "xml") -> DataFrame:
    """``article_id, doi, abstract, sections, n_sec``: one row per row of ``df``.

    ``abstract`` has every paragraph of the first abstract, also of a structured one; ``sections`` a (title, text) for each
    paragraph of the first body, with the title of the innermost section, empty before the first; ``n_sec`` counts the body's
    sections, nested ones included. Figures, tables and replies are no text. Character references are decoded once, white
    space is collapsed. A null, empty or broken text gives no doi, no paragraphs and no sections. Other columns aren't kept.
    """
    raw = F.regexp_replace(F.coalesce(F.col(xml_col).cast("string"), F.lit("")), f"[{_UNWANTED}]", " ")
    raw = F.regexp_replace(raw, r"(?s)<(?:!--.*?--|\?.*?\?)>", "")
    raw = F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    raw = F.regexp_replace(raw, rf"(?s)<({'|'.join(SET_ASIDE)})(?:\s[^>]*)?>.*?</\1\s*>", "")
    # References are left to be decoded once, after reading.
    raw = F.replace(raw, F.lit("&"), F.lit("&amp;"))
    # Each step is named once it is worked out; a second use would work out all steps before it again.
    whole = df.select(F.col(id_col).alias("article_id"), once(raw).alias("raw"))
    doi = F.regexp_extract("raw", rf"""(?s)<article-id(?=[^>]*\spub-id-type=["']{DOI}["'])[^>]*>([^<]*)</article-id""", 1)
    parts = F.struct(doi.alias("doi"), _element(F.col("raw"), "abstract").alias("abstract"), _element(F.col("raw"), "body").alias("body"))
    base = whole.select("article_id", once(parts).alias("x"))
    n_sec = F.regexp_count("x.body", F.lit(r"<sec(?=[\s>])")).cast("int")
    frame = F.concat(
        F.lit("<article><doi>"), F.col("x.doi"), F.lit("</doi><abstract>"), _frame(F.col("x.abstract")),
        F.lit("</abstract><body>"), _frame(F.col("x.body")), F.lit("</body></article>"),
    )
    read = base.select("article_id", n_sec.alias("n_sec"), once(F.from_xml(frame, FRAME)).alias("a"))

    def text(value: Column) -> Column:
        return _plain(F.replace(F.coalesce(value, F.lit("")), F.lit(_INLINE), F.lit("<")))

    def paragraphs(values: Column) -> Column:
        return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), text), lambda t: t != "")

    def titled(part: Column) -> Column:
        none = F.array().cast("array<struct<title: string, p: array<string>>>")
        first = F.struct(F.lit("").alias("title"), F.coalesce(part["p"], F.array().cast("array<string>")).alias("p"))
        every = F.concat(F.array(first), F.coalesce(part["sec"], none))
        plain = F.transform(every, lambda s: F.struct(text(s["title"]).alias("title"), paragraphs(s["p"]).alias("p")))
        return F.flatten(F.transform(plain, lambda s: F.transform(s["p"], lambda t: F.struct(s["title"].alias("title"), t.alias("text")))))

    doi_text = F.nullif(text(F.col("a.doi")), F.lit(""))
    return read.select(
        "article_id", doi_text.alias("doi"), F.transform(titled(F.col("a.abstract")), lambda s: s["text"]).alias("abstract"),
        titled(F.col("a.body")).alias("sections"), F.when(F.col("a").isNull(), 0).otherwise(F.col("n_sec")).alias("n_sec"),
    )
