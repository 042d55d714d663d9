"""JSON of reports and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that adapters leave out of an element's metadata.
DROPPED_KEYS = ("coordinates", "text_as_html", "image_base64")


def to_json(value: Column, pretty: bool = False) -> Column:
    """JSON with explicit nulls."""
    return F.to_json(value, {"ignoreNullFields": "false", "pretty": str(pretty).lower()})


def kept_metadata(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda k, _: ~k.isin(*DROPPED_KEYS))
