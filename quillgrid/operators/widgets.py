"""Widget attributes of field specs, and field types back from widgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import text as T

# Flag bits of multi-line text and of push buttons.
MULTILINE, PUSH_BUTTON = 4096, 65536
SIGNATURE_WORDS = ("signature", "חתימה", "חתום", "חותם")


def attributes(specs: DataFrame) -> DataFrame:
    """`specs` with the attributes that their widgets have: kind, flags, highlight, border, background, states."""
    kind = T.normal_type(F.col("type"))
    image = kind == "image"
    return (
        specs.withColumn("ft", F.when(kind.isin("text", "textarea"), "/Tx").otherwise("/Btn"))
        .withColumn("ff", F.when(kind == "textarea", MULTILINE).when(image, PUSH_BUTTON).otherwise(0))
        .withColumn("highlight", F.when(image, "/P"))
        .withColumn("border", F.when(image, 1).otherwise(0))
        .withColumn("style", F.when(image, "/B"))
        .withColumn("style_width", F.when(image, 1).otherwise(0))
        .withColumn("has_bg", image)
        .withColumn("has_bc", F.lit(False))
        .withColumn("appearances", F.when(kind == "checkbox", F.array(F.lit("/Off"), F.lit("/Yes"))).otherwise(F.array(F.lit(""))))
    )


def inferred(widgets: DataFrame) -> DataFrame:
    """`widgets` (name, ft, ff) with the field type `inferred` from kind, name and flags; null if unknown."""
    low = F.lower("name")
    signed = F.lit(False)
    for word in SIGNATURE_WORDS:
        signed = signed | low.contains(word)
    flag = lambda bit: F.col("ff").bitwiseAND(bit) != 0
    kind = (
        F.when((F.col("ft") == "/Sig") | signed, "image")
        .when(F.col("ft") == "/Tx", F.when(flag(MULTILINE), "textarea").otherwise("text"))
        .when(F.col("ft") == "/Btn", F.when(flag(PUSH_BUTTON), "image").otherwise("checkbox"))
    )
    return widgets.withColumn("inferred", kind)
