"""Reading location and policy extracts from CSV."""

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StringType, StructField, StructType

from riskbridge import schema as S
from riskbridge.functions.columns import conform, na_to_null, normalize, table_kind


_BROKEN = "_broken_record"


@dataclass(frozen=True)
class Extract:
    """One schedule of one month and segment. `path` may be a file, a folder or a pattern."""

    name: str
    period: str
    segment: str
    path: str
    encoding: str = "UTF-8"
    multi_line: bool = False

    def tag(self, df: DataFrame) -> DataFrame:
        return df.select(F.lit(self.period).alias("PERIOD"), F.lit(self.segment).alias("SEGMENT"), "*")


def read_extract(spark: SparkSession, extract: Extract) -> DataFrame:
    """All columns as text under the file's own header, NA texts as null.

    `multi_line` allows line breaks inside quotes, at the price of one task per file; without it such a break makes two
    short rows. Fields that a short row lacks are null. A row with more fields than the header is an error when it is read.
    """
    options = {
        "header": True, "inferSchema": False, "encoding": extract.encoding, "quote": '"', "escape": '"',
        "multiLine": extract.multi_line, "enforceSchema": False,
    }
    try:
        names = spark.read.csv(extract.path, **options).columns
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"extract '{extract.name}' not found: {extract.path}") from e
        raise
    if not names:
        return na_to_null(spark.read.csv(extract.path, **options))
    schema = StructType([StructField(n, StringType()) for n in [*names, _BROKEN]])
    raw = spark.read.csv(extract.path, schema=schema, columnNameOfCorruptRecord=_BROKEN, **options)
    commas = F.length(F.regexp_replace(F.regexp_replace(_BROKEN, r'"[^"]*+"', ""), "[^,]", ""))
    told = F.concat(F.lit(f"extract '{extract.name}' has a row with more fields than its header: "), F.substring(_BROKEN, 1, 200))
    first = F.when(commas >= len(names), F.raise_error(told)).otherwise(F.col(f"`{names[0]}`"))
    return na_to_null(raw.select(first.alias(names[0]), *[F.col(f"`{n}`") for n in names[1:]]))


def load_catalog(spark: SparkSession, extracts: Iterable[Extract]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Raw and normalised table of each extract by name. Nothing is read before a result is asked for."""
    out = {}
    for x in extracts:
        raw = read_extract(spark, x)
        out[x.name] = (raw, normalize(raw))
    return out


def register(name: str, df: DataFrame) -> DataFrame:
    """Make or replace a view for SQL."""
    df.createOrReplaceTempView(name)
    return df


def stack(extracts: Iterable[Extract], tables: dict[str, DataFrame], kind: str) -> DataFrame:
    """All extracts of a kind under the declared schema, tagged with period and segment."""
    parts = [x.tag(conform(tables[x.name])) for x in extracts if table_kind(tables[x.name]) == kind]
    if not parts:
        raise ValueError(f"no {kind.lower()} extract in the catalog")
    return reduce(DataFrame.unionByName, parts)


def land(df: DataFrame, path: str) -> DataFrame:
    """Write normalised rows as Parquet by period and segment, and read them back.

    CSV is parsed once; later passes prune columns and partitions.
    """
    df.write.mode("overwrite").partitionBy(*S.EXTRACT).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
