"""Optional fields of alignments: their types, and a map column of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import TAG

#: The predefined tags by the kind of their value.
INT_TAGS = "AM AS CM CP FI H0 H1 H2 HI IH MQ NH NM OP PQ SM TC UQ".split()
STRING_TAGS = "BC BQ BZ CB CC CO CQ CR CS CT CY E2 FS LB MC MD MI OA OC OQ OX PG PT PU Q2 QT QX R2 RG RX SA U2".split()
ARRAY_TAGS = "CG FZ".split()
RESERVED_TAGS = "GC GQ GS MF RT S2 SQ".split()
#: The letters of integer types.
INT_TYPES = "cCsSiI"


def tag_types() -> dict[str, str]:
    """The type letter of each predefined tag: i, Z or B."""
    return dict.fromkeys(INT_TAGS, "i") | dict.fromkeys(STRING_TAGS, "Z") | dict.fromkeys(ARRAY_TAGS, "B")


def get_tag(tags: Column, key: str) -> Column:
    """The tag's struct, or null."""
    return F.try_element_at(tags, F.lit(key))


def int_tag(tags: Column, key: str) -> Column:
    return get_tag(tags, key)["i"]


def string_tag(tags: Column, key: str) -> Column:
    return get_tag(tags, key)["s"]


def read_group(tags: Column) -> Column:
    """The record's read group."""
    return string_tag(tags, "RG")


def make_tag(kind: str, value: Column) -> Column:
    """A tag's struct from its type letter and value."""
    place = "i" if kind in INT_TYPES else "f" if kind == "f" else "s" if kind in "AZH" else "ia"
    null = lambda name: F.lit(None).cast({"i": "bigint", "f": "float", "s": "string", "ia": "array<bigint>", "fa": "array<float>"}[name])
    cast = {"i": "bigint", "f": "float", "s": "string", "ia": "array<bigint>"}[place]
    fields = [F.lit(kind).alias("type"), *[(value.cast(cast) if n == place else null(n)).alias(n) for n in ("i", "f", "s", "ia", "fa")]]
    return F.struct(*fields).cast(TAG)


def remove_tag(tags: Column, key: str) -> Column:
    return F.map_filter(tags, lambda k, _: k != key)


def set_tag(tags: Column, key: str, kind: str, value: Column) -> Column:
    """The map with the tag replaced, or added at its end."""
    return F.map_concat(remove_tag(tags, key), F.create_map(F.lit(key), make_tag(kind, value)))
