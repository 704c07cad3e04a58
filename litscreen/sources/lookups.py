"""Identifier maps, download locations and what still has to be fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscreen.functions import fixed


def map_external_ids(
    ids: DataFrame, id_map: DataFrame, id_col: str = "article_id", external_col: str = "external_id"
) -> DataFrame:
    """Add the second identifier, null where none is known; of several the smallest is taken."""
    one_each = id_map.groupBy(id_col).agg(F.min(external_col).alias(external_col))
    return ids.join(one_each, id_col, "left")


def explode_locations(
    df: DataFrame, json_col: str, suffix: str = fixed.LOCATION_SUFFIX, field: str = fixed.LOCATION_FIELD
) -> DataFrame:
    """One row per address found under a key that ends in ``suffix``, in key order, numbered from 0."""
    others = [c for c in df.columns if c != json_col]
    keyed = F.map_entries(F.from_json(json_col, "map<string,string>"))
    matching = F.filter(keyed, lambda e: e["key"].endswith(suffix))
    urls = F.filter(
        F.transform(matching, lambda e: F.get_json_object(e["value"], f"$.{field}")), lambda u: u.isNotNull() & (u != "")
    )
    return df.select(*others, F.posexplode(urls).alias("pos", "url"))


def first_valid_candidate(
    candidates: DataFrame,
    min_size: int = fixed.MIN_PDF_BYTES,
    id_col: str = "article_id",
    pos_col: str = "pos",
    size_col: str = "size",
) -> DataFrame:
    """Per article the first candidate, in order, larger than ``min_size``; partial aggregation absorbs hot ids."""
    others = [c for c in candidates.columns if c != id_col]
    best = (
        candidates.filter(F.col(size_col) > min_size)
        .groupBy(id_col)
        .agg(F.min_by(F.struct(*others), F.col(pos_col)).alias("best"))
    )
    return best.select(id_col, *[F.col(f"best.{c}") for c in others])


def pending_fetch(
    requested: DataFrame, landed: DataFrame, id_col: str = "article_id", valid_col: str = "is_valid"
) -> DataFrame:
    """Requested ids that have not landed in valid form."""
    valid = landed.filter(F.col(valid_col)).select(id_col).distinct()
    return requested.join(valid, id_col, "left_anti")
