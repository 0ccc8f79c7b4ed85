"""Issue taxonomy sources.

The taxonomy is configuration, usually tens to a few thousand phrases; a sheet may be as
long as a table.  Its long form ``(category, cat_ord, phrase, phrase_ord)`` is what the
classifier reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from revlens.fixtures import taxonomy as taxonomy_from_rules
from revlens.functions.text import py_strip
from revlens.operators.sequence import sequence

# Our own built-in taxonomy, used when no taxonomy file is given (category, phrases in order).
FALLBACK_RULES = [
    ("Picture", ["dead pixel", "screen flicker", "backlight bleed", "washed out colors", "lines on screen",
                 "dim picture"]),
    ("Power", ["will not turn on", "turns off by itself", "power cycle", "no power"]),
    ("Audio", ["no sound", "audio delay", "speaker crackle", "sound cuts out"]),
    ("Network", ["wifi disconnects", "cannot connect to network", "slow streaming", "ethernet port"]),
    ("Remote", ["remote not working", "remote pairing", "unresponsive buttons"]),
    ("Software", ["apps crash", "frozen screen", "firmware update failed", "slow menu"]),
    ("Ports", ["hdmi not detected", "hdmi arc", "usb port"]),
    ("Delivery", ["arrived damaged", "cracked screen on arrival", "missing parts", "late delivery"]),
    ("Service", ["customer service", "refund refused", "warranty claim"]),
    ("Other", ["Please add comments"]),
]


def fallback_taxonomy(spark: SparkSession) -> DataFrame:
    """S3: the built-in taxonomy as a long table."""
    return taxonomy_from_rules(spark, FALLBACK_RULES)


def taxonomy_long(wide: DataFrame, row_col: str, spark: SparkSession | None = None) -> DataFrame:
    """A wide sheet (one column per category, phrases down the rows, ``row_col`` = row
    order) to the long table.  Headings and cells are trimmed; blank cells and blank or
    'unnamed...' headings are dropped; an empty result falls back to S3."""
    cats = [c for c in wide.columns if c != row_col]
    keep = [c for c in cats if c.strip() and not c.strip().lower().startswith("unnamed")]
    if not keep:
        return fallback_taxonomy(spark or wide.sparkSession)
    cols = F.array(*[F.struct(F.lit(i).alias("cat_ord"), F.lit(c.strip()).alias("category"),
                              F.col(f"`{c}`").cast("string").alias("phrase")) for i, c in enumerate(keep)])
    long = (wide.select(row_col, F.explode(cols).alias("x"))
            .select(row_col, "x.cat_ord", "x.category", py_strip("x.phrase").alias("phrase"))
            .filter(F.col("phrase").isNotNull() & (F.col("phrase") != "")))
    # phrase order: category by category, rows in order; no window over the whole sheet
    placed = sequence(long, [F.col("cat_ord").asc(), F.col(row_col).asc(), F.col("phrase").asc()], (), "_seq")
    return placed.select("category", F.col("cat_ord").cast("int"), "phrase", (F.col("_seq") - 1).cast("int").alias("phrase_ord"))
