"""Identity evidence of listings: the signature that matching, filters and reports share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SIGNATURE = ["ean_key", "sku_key", "brand_key", "model_tokens", "spec_tokens", "name_tokens", "qualifiers", "kind", "screen_inches", "capacity_gb"]


def signature(listings: DataFrame) -> DataFrame:
    """Adds the SIGNATURE columns to rows with name, ean, sku and brand. Sets are sorted arrays."""
    d = listings.withColumn("_expanded", T.expand_inch_marks(T.fold(F.coalesce("name", F.lit("")))))
    d = d.withColumn("_tokens", T.tokens(F.col("_expanded")))
    d = d.withColumns({"spec_tokens": T.spec_tokens("_tokens"), "model_tokens": T.model_tokens("_tokens"), "name_tokens": T.name_tokens("_tokens"), "qualifiers": T.qualifiers("_expanded", "_tokens")})
    first = F.get("_tokens", F.lit(0))
    d = d.withColumns(
        {
            "ean_key": T.gtin("ean"),
            "sku_key": T.sku(F.col("sku")),
            "brand_key": F.coalesce(T.brand(F.col("brand")), F.when(first.rlike("^[a-z]{3,}$"), first)),
            "kind": T.kind("_expanded", "_tokens", "spec_tokens"),
            "screen_inches": T.largest("spec_tokens", "", "inch", "int"),
            "capacity_gb": T.largest("spec_tokens", "cap:", "gb", "bigint"),
        }
    )
    return d.drop("_expanded", "_tokens")
