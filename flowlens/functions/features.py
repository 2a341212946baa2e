"""Per-packet features and typed access to open feature maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_PORT = -1  # fixed value: packet without a TCP or UDP header

# Variant type names that count as the asked-for type. An integer is not read
# as a double nor a numeric string as a number: a value of another type gives the default.
_VARIANT_TYPES = {
    "bigint": ("BIGINT",),
    "int": ("BIGINT",),
    "double": ("DOUBLE", "FLOAT", "DECIMAL"),
    "string": ("STRING",),
    "boolean": ("BOOLEAN",),
}


def dest_port() -> Column:
    return F.coalesce(F.col("dst_port"), F.lit(NO_PORT))


def typed_value(features: Column, name: str, dtype: str, default) -> Column:
    """Value of ``name`` in a VARIANT object, or ``default`` if missing or of another type."""
    value = F.try_variant_get(features, f"$.{name}", "variant")
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    typed = F.when(kind.isin(*_VARIANT_TYPES[dtype]), F.try_variant_get(features, f"$.{name}", dtype))
    return F.coalesce(typed, F.lit(default).cast(dtype))


def project_features(df: DataFrame, *features: Column) -> DataFrame:
    """Narrow feature rows: only these columns travel through the shuffle that follows."""
    return df.select("flow_key", "ts_ms", "seq", *features)
