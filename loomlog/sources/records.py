"""Foreign records in the entry schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from loomlog.fixed.levels import DEFAULT_LEVEL, ERROR, LEVELS
from loomlog.functions.levels import level_name, parse_level_token
from loomlog.functions.text import empty_to_null


def _first_filled(df: DataFrame, *names: str) -> Column:
    found = [empty_to_null(F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(""))


def _stated_level(df: DataFrame) -> Column:
    """A whole number must be a level value; anything else is read as a word."""
    levels = []
    for name in ("level", "severity"):
        if name not in df.columns:
            continue
        value = F.col(name)
        if isinstance(df.schema[name].dataType, IntegralType):
            known = F.when(value.isin(list(LEVELS.values())), value.cast("int"))
            levels.append(F.when(value != 0, F.coalesce(known, F.lit(DEFAULT_LEVEL))))
        else:
            text = value.cast("string")
            levels.append(F.when(text != "", parse_level_token(f"CAST({name} AS STRING)")))
    return F.coalesce(*levels, F.lit(DEFAULT_LEVEL))


def normalise_records(df: DataFrame) -> DataFrame:
    """Records with some of ``raw message text source file level severity timestamp ts
    line_number fingerprint`` as entries. They are taken as stated, not classified."""
    raw = _first_filled(df, "raw", "message", "text")
    number = F.col("line_number") if "line_number" in df.columns else F.lit(0)
    staged = df.select(
        raw.alias("raw"),
        _first_filled(df, "source", "file").alias("source"),
        _stated_level(df).alias("level"),
        _first_filled(df, "timestamp", "ts").alias("timestamp"),
        F.coalesce(empty_to_null(_first_filled(df, "message")), raw).alias("message"),
        F.coalesce(number.try_cast("bigint"), F.lit(0)).alias("line_number"),
        _first_filled(df, "fingerprint").alias("fingerprint"),
    )
    return staged.withColumns({
        "level_name": level_name("level"), "is_error": F.col("level") >= ERROR,
    })


def text_records(df: DataFrame, text: str = "value") -> DataFrame:
    """Bare texts as entries at the default level."""
    return normalise_records(df.select(F.col(text).alias("raw"), F.col(text).alias("message")))
