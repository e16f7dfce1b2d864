"""Column names and types of the location, policy and merged tables."""

from pyspark.sql import types as T

# Period and segment labels.
PRIOR, CURRENT = "prior", "curr"
COMMERCIAL, STANDARD = "Commercial", "Standard"

#: One account of one extract. Locations and policies meet on these columns.
ACCOUNT = ["PERIOD", "SEGMENT", "ACCNTNUM"]
#: One extract: a month of one segment.
EXTRACT = ["PERIOD", "SEGMENT"]

# Canonical columns of a location schedule.
LOCATION_COLUMNS = """
    ACCNTNUM LOCNUM LOCNAME LATITUDE LONGITUDE STREETNAME CITY STATE STATECODE POSTALCODE COUNTY
    BLDGCLASS OCCTYPE YEARBUILT FLOORAREA NUMSTORIES
    WSCV4LIMIT WSCV4VAL WSCV5LIMIT WSCV5VAL WSCV6LIMIT WSCV6VAL WSCV7LIMIT WSCV7VAL WSSITELIM WSSITEDED
    TOCV4LIMIT TOCV4VAL TOCV5LIMIT TOCV5VAL TOCV6LIMIT TOCV6VAL TOCV7LIMIT TOCV7VAL TOSITELIM
    WSCV4DED WSCV6DED TOCV4DED TOCV6DED
    BLDGSCHEME CNTRYCODE CNTRYSCHEME OCCSCHEME
    ROOFSYS ROOFGEOM ROOFANCH ROOFAGE CLADRATE CLADSYS RESISTOPEN
""".split()

# Canonical columns of a policy schedule.
POLICY_COLUMNS = """
    ACCNTNUM ACCNTNAME PRODNAME CEDANTID CEDANTNAME POLICYNUM LOBNAME POLICYTYPE
    BLANPREAMT BLANPRECUR USERDEF1 USERDEF2 BLANLIMAMT
""".split()

# Text columns that are trimmed, with '' for a missing value.
TEXT_COLUMNS = "ACCNTNUM LOCNUM POLICYNUM STATE BLDGCLASS OCCTYPE LOBNAME CEDANTNAME PRODNAME".split()

#: Number columns, with 0.0 for a missing or unreadable value: every insured value, limit and
#: deductible, and the coordinates, building measures and blanket amounts.
NUMBER_COLUMNS = [
    c for c in LOCATION_COLUMNS + POLICY_COLUMNS if c[:4] in ("WSCV", "TOCV", "WSSI", "TOSI")
] + "LATITUDE LONGITUDE YEARBUILT FLOORAREA NUMSTORIES ROOFAGE BLANPREAMT BLANLIMAMT".split()

WS_VALUES = [f"WSCV{n}VAL" for n in (4, 5, 6, 7)]
TO_VALUES = [f"TOCV{n}VAL" for n in (4, 5, 6, 7)]
TIV_COLUMNS = ["TIV_WS", "TIV_TO", "TIV_TOTAL"]

# What a merged row takes from the policy and from the location.
MERGED_POLICY_COLUMNS = """
    ACCNTNUM ACCNTNAME POLICYNUM PRODNAME CEDANTID CEDANTNAME LOBNAME POLICYTYPE
    BLANPREAMT BLANLIMAMT USERDEF1 USERDEF2
""".split()
MERGED_LOCATION_COLUMNS = """
    LOCNUM LOCNAME LATITUDE LONGITUDE STREETNAME CITY STATE STATECODE POSTALCODE COUNTY BLDGCLASS OCCTYPE
    YEARBUILT FLOORAREA NUMSTORIES WSCV4VAL WSCV5VAL WSCV6VAL WSCV7VAL TIV_WS TIV_TO TIV_TOTAL
    WSSITELIM WSSITEDED ROOFSYS ROOFGEOM ROOFANCH ROOFAGE CLADRATE CLADSYS RESISTOPEN
""".split()

CANONICAL = frozenset(LOCATION_COLUMNS + POLICY_COLUMNS)


def column_type(name: str) -> T.DataType:
    """Double for number and TIV columns, string for the rest."""
    return T.DoubleType() if name in NUMBER_COLUMNS or name in TIV_COLUMNS else T.StringType()


def _struct(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, column_type(n)) for n in names])


LOCATION_SCHEMA = _struct(LOCATION_COLUMNS + TIV_COLUMNS)
POLICY_SCHEMA = _struct(POLICY_COLUMNS)
