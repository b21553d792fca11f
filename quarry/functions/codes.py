"""Code -> label maps and numeric bands (C8-C10) as map literals.

A literal map is folded into the generated code of the projection, so
labelling costs no join and no shuffle; a map that lives in a table should
be joined instead (Spark broadcasts it when its size is under the
threshold).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Booking-report country codes.
COUNTRY_LABELS = {1: "CANADA", 2: "USA"}
COUNTRY_DEFAULT = "OTHERS"

# Booking-report vehicle types, code order 0..15
# (10 repeats the name of 2, 11 repeats the name of 8).
RVTYPE_LABELS = {
    0: "Fifth Wheel", 1: "Tent Trailer", 2: "Travel Trailer",
    3: "Vintage Trailer", 4: "Hybrid", 5: "Toy Hauler", 6: "Class A",
    7: "Class B", 8: "Class C", 9: "Vintage Motorhome", 10: "Travel Trailer",
    11: "Class C", 12: "Micro Trailer", 13: "Truck Camper", 14: "Campervan",
    15: "RV Cottage",
}
RVTYPE_DEFAULT = "RV Cottage"

# User age bands (<25, 25..40 inclusive, >40, else OTHERS).
AGE_BANDS = ("BELOW_25", "MIDDLEAGE_25_40", "ABOVE_40", "OTHERS")


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code_label(c: str | Column, labels: Mapping[int, str], default: str | None) -> Column:
    """Look a code up in a literal map; unknown or NULL -> default."""
    m = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    looked = F.try_element_at(m, col_(c).cast("int"))
    return looked if default is None else F.coalesce(looked, F.lit(default))


def country_label(c: str | Column, default: str = COUNTRY_DEFAULT) -> Column:
    return code_label(c, COUNTRY_LABELS, default)


def rvtype_label(c: str | Column, default: str = RVTYPE_DEFAULT) -> Column:
    return code_label(c, RVTYPE_LABELS, default)


def age_band(c: str | Column) -> Column:
    """Banding; NULL falls through to OTHERS."""
    a = col_(c)
    below, middle, above, other = AGE_BANDS
    return (F.when(a < 25, below)
             .when((a >= 25) & (a <= 40), middle)
             .when(a > 40, above)
             .otherwise(other))
