"""Marked-up pages to ordered, titled paragraphs.

Works on text patterns, so pages that are not well formed (unclosed tags, tags inside scripts) are no obstacle. The tag
names are parameters: the defaults read web pages; ``heading_tags=("title",)`` reads journal XML and
``heading_tags=("head",)`` reads converter XML.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litscreen.functions.scale import once

# Tags whose whole content is not article text, tags that start a heading or a paragraph, and tags that
# end one.
DROPPED_TAGS = ("script", "style", "nav", "head")
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
PARAGRAPH_TAGS = ("p",)
BLOCK_TAGS = (
    "article", "aside", "blockquote", "body", "div", "dl", "dt", "dd", "figure", "footer", "form", "header", "hr",
    "html", "li", "main", "ol", "pre", "section", "table", "td", "th", "tr", "ul",
)

_HEADING, _BREAK, _PARAGRAPH = "\x01", "\x02", "\x03"


def _plain(text: Column) -> Column:
    """Inline tags out, entities decoded, white space collapsed."""
    text = decode_entities(F.regexp_replace(text, "<[^>]*>", " "))
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\xa0"), F.lit(" ")), r"\s+", " "))


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal character references to their characters, each once; unknown ones stay."""
    names = F.create_map(*[F.lit(x) for name, point in sorted(name2codepoint.items()) for x in (name, chr(point))])

    def read(piece: Column, i: Column) -> Column:
        name = F.regexp_extract(piece, r"^(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);", 1)
        digits = F.substring(name, 2, 8)
        point = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.rlike("^#"), digits).cast("int")
        valid = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
        char = F.when(name != "", F.coalesce(number, F.try_element_at(names, name)))
        decoded = F.concat(char, F.substr(piece, F.length(name) + 2))
        return F.when(i == 0, piece).otherwise(F.coalesce(decoded, F.concat(F.lit("&"), piece)))

    # Texts without a reference, which most are, skip the work. The one-element array names the text, so that it is worked
    # out once.
    def decoded(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(F.split(t, "&"), read), "")).otherwise(t)

    return F.transform(F.array(text), decoded)[0]


def sections_from_markup(
    pages: DataFrame,
    id_col: str = "page_id",
    markup_col: str = "html",
    dropped_tags: Sequence[str] = DROPPED_TAGS,
    heading_tags: Sequence[str] = HEADING_TAGS,
    paragraph_tags: Sequence[str] = PARAGRAPH_TAGS,
    block_tags: Sequence[str] = BLOCK_TAGS,
) -> DataFrame:
    """One row per page: ``sections`` holds (title, text) in page order; the title is the nearest heading before."""
    text = F.regexp_replace(F.col(markup_col), "[\x01\x02\x03]", " ")
    text = F.regexp_replace(text, "(?s)<!--.*?-->", "")
    for tag in (t for t in dropped_tags if t not in heading_tags):  # a heading is never dropped
        text = F.regexp_replace(text, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", "")
    ends = "|".join([*block_tags, *heading_tags, *paragraph_tags])
    text = F.regexp_replace(text, rf"(?i)<({'|'.join(heading_tags)})(\s[^>]*)?>", _HEADING)
    text = F.regexp_replace(text, rf"(?i)<({'|'.join(paragraph_tags)})(\s[^>]*)?>", _PARAGRAPH)
    text = F.regexp_replace(text, rf"(?i)</?({ends})(\s[^>]*)?/?>", _BREAK)

    # Cut at headings first; in each piece the text before the next mark is the title, paragraphs follow theirs. Each
    # piece is read into its title and texts once, before titles and texts are paired.
    def read(piece: Column, position: Column) -> Column:
        before = F.substring_index(F.replace(piece, F.lit(_PARAGRAPH), F.lit(_BREAK)), _BREAK, 1)
        starts = F.split(piece, _PARAGRAPH)
        texts = F.transform(
            F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda t: _plain(F.substring_index(t, _BREAK, 1))
        )
        title = F.when(position > 0, _plain(before)).otherwise(F.lit(""))
        return F.struct(title.alias("title"), F.filter(texts, lambda t: t != "").alias("texts"))

    def paired(piece: Column) -> Column:
        return F.transform(piece["texts"], lambda t: F.struct(piece["title"].alias("title"), t.alias("text")))

    pieces = F.transform(F.split(text, _HEADING), read)
    return pages.select(F.col(id_col), once(F.flatten(F.transform(pieces, paired))).alias("sections"))


def articles_from_markup(pages: DataFrame, id_col: str = "page_id", markup_col: str = "html", **tags) -> DataFrame:
    """Pages as articles: the first paragraph is the abstract, the others are sections."""
    cut = sections_from_markup(pages, id_col, markup_col, **tags)
    return cut.select(
        F.col(id_col).alias("article_id"),
        F.lit(None).cast("string").alias("doi"),
        F.transform(F.slice("sections", 1, 1), lambda s: s["text"]).alias("abstract"),
        F.slice("sections", 2, F.greatest(F.size("sections"), F.lit(1))).alias("sections"),
    )
