"""Column rules: cleaning, insured values, ratios. All stay in built-in expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskbridge import schema as S

# Texts read as a missing value in a CSV extract.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Texts that become '' after trimming.
BLANK_TEXTS = ["nan", "None"]
# Number texts; keeps suffixed literals such as '1d' out of the cast.
NUMBER_PATTERN = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"
_NUMBERS = "_numbers"
WHITESPACE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def na_to_null(df: DataFrame) -> DataFrame:
    """Turn the NA tokens of a raw extract into nulls."""
    return df.select([F.when(~df[f"`{c}`"].isin(NA_TOKENS), df[f"`{c}`"]).alias(c) for c in df.columns])


def clean_text(c: Column) -> Column:
    text = strip(c)
    return F.when(text.isNull() | text.isin(BLANK_TEXTS), "").otherwise(text)


def _text_number(c: Column) -> Column:
    text = strip(c)
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def clean_number(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.coalesce(_text_number(c), F.lit(0.0))
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def clean_strings(df: DataFrame) -> DataFrame:
    return df.withColumns({c: clean_text(F.col(c).cast("string")) for c in S.TEXT_COLUMNS if c in df.columns})


def clean_numbers(df: DataFrame) -> DataFrame:
    """Numbers of known columns. Texts go through one expression over an array: a method of one rule per column is too long for the JVM to compile."""
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = [c for c in S.NUMBER_COLUMNS if isinstance(types.get(c), T.StringType)]
    others = {c: clean_number(F.col(c), types[c]) for c in S.NUMBER_COLUMNS if c in types and c not in texts}
    if not texts:
        return df.withColumns(others)
    numbers = F.transform(F.array(*[_text_number(F.col(c)) for c in texts]), lambda x: F.coalesce(x, F.lit(0.0)))
    return df.withColumn(_NUMBERS, numbers).withColumns(others | {c: F.col(_NUMBERS)[i] for i, c in enumerate(texts)}).drop(_NUMBERS)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trim headers and give known ones their canonical name, whatever their case."""
    names = [c.strip().upper() if c.strip().upper() in S.CANONICAL else c.strip() for c in df.columns]
    doubled = sorted({n for n in names if names.count(n) > 1})
    if doubled:
        raise ValueError(f"several headers map to one column: {', '.join(doubled)}")
    return df.toDF(*names)


def table_kind(df: DataFrame) -> str:
    return "Location" if "LOCNUM" in df.columns else "Policy"


def _sum_present(df: DataFrame, names: list[str]) -> Column:
    total = F.lit(0.0)
    for c in names:
        if c in df.columns:
            total = total + F.coalesce(F.col(c), F.lit(0.0))
    return total


def add_tiv(df: DataFrame) -> DataFrame:
    """Insured value per peril, and the larger of the two as the total."""
    return df.withColumns({"TIV_WS": _sum_present(df, S.WS_VALUES), "TIV_TO": _sum_present(df, S.TO_VALUES)}).withColumn(
        "TIV_TOTAL",
        F.greatest("TIV_WS", "TIV_TO") if any(c in df.columns for c in S.TO_VALUES) else F.col("TIV_WS"),
    )


def normalize(df: DataFrame) -> DataFrame:
    """Canonical names, clean text and numbers, and insured values on locations."""
    out = clean_numbers(clean_strings(normalize_columns(df)))
    return add_tiv(out) if table_kind(out) == "Location" else out


def conform(df: DataFrame) -> DataFrame:
    """Declared columns first, absent ones as blank, zero or null; unknown columns dropped.

    PERIOD and SEGMENT tags are kept. The account number must be present.
    """
    if "ACCNTNUM" not in df.columns:
        raise ValueError("ACCNTNUM is missing")
    declared = S.LOCATION_SCHEMA if table_kind(df) == "Location" else S.POLICY_SCHEMA
    types = {f.name: f.dataType for f in df.schema.fields}
    tags = [c for c in S.EXTRACT if c in types]
    cols = []
    for f in declared.fields:
        if f.name in types:
            cols.append(f.name if types[f.name] == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name in S.TEXT_COLUMNS:
            cols.append(F.lit("").alias(f.name))
        elif isinstance(f.dataType, T.DoubleType):
            cols.append(F.lit(0.0).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*tags, *cols)


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """num / den * scale, and 0 where the denominator is not positive."""
    return F.when(den > 0, num / den * F.lit(float(scale))).otherwise(F.lit(0.0))


def growth_pct(new: Column, old: Column) -> Column:
    return ratio(new - old, old, 100)


def policy_ratios(df: DataFrame) -> DataFrame:
    """Rate on line and limit to value of policies that hold their account's value."""
    return df.withColumns(
        {
            "RATE_ON_LINE_PCT": ratio(F.col("BLANPREAMT"), F.col("ACCOUNT_TIV"), 100),
            "LIMIT_TO_TIV_RATIO": ratio(F.col("BLANLIMAMT"), F.col("ACCOUNT_TIV")),
        }
    )


def location_ratios(df: DataFrame) -> DataFrame:
    """Value per square foot of locations."""
    return df.withColumn("TIV_PER_SQFT", ratio(F.col("TIV_TOTAL"), F.col("FLOORAREA")))


def band(c: Column, limits: list[tuple[float, str]], above: str) -> Column:
    """Label of the first limit that exceeds the value."""
    out = F.lit(above)
    for limit, label in reversed(limits):
        out = F.when(c < limit, label).otherwise(out)
    return out
