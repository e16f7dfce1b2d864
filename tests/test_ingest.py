import pytest
from pyspark.sql import functions as F

from riskbridge.functions.columns import conform, na_to_null, normalize, normalize_columns
from riskbridge.sources.ingest import Extract, load_catalog, read_extract, stack
from riskbridge.sources.sinks import write_audit


def extract(path, text, encoding="utf-8", name="x"):
    path.write_bytes(text.encode(encoding))
    return Extract(name, "curr", "Commercial", str(path), encoding={"utf-8": "UTF-8", "latin-1": "ISO-8859-1"}[encoding])


def test_numbers_headers_and_text(spark, tmp_path):
    text = (
        "AccntNum , LOCNUM,Latitude,WSCV4VAL,xUnknown,City\n"
        '00123, 1 ,12.5,"1,000",a,\n'
        "00124,2,bad, 12 ,b,Rom\n"
        "None,3,1d,1e3,c,NA\n"
        ",4,-.5,nan,d,x\n"
        "nan,5,+3.,,e,x\n"
    )
    raw = read_extract(spark, extract(tmp_path / "l.csv", text))
    df = normalize(raw)
    assert df.columns[:6] == ["ACCNTNUM", "LOCNUM", "LATITUDE", "WSCV4VAL", "xUnknown", "CITY"]
    got = [tuple(r) for r in df.orderBy("LOCNUM").select("ACCNTNUM", "LOCNUM", "LATITUDE", "WSCV4VAL", "CITY").collect()]
    assert got == [
        ("00123", "1", 12.5, 0.0, None),
        ("00124", "2", 0.0, 12.0, "Rom"),
        ("", "3", 0.0, 1000.0, None),
        ("", "4", -0.5, 0.0, "x"),
        ("", "5", 3.0, 0.0, "x"),
    ]
    assert raw.filter(F.col("City").isNull()).count() == 2


def test_infinity_is_a_number(spark):
    df = normalize(spark.createDataFrame([("a", "1", "inf"), ("b", "2", "-Infinity")], "ACCNTNUM string, LOCNUM string, ROOFAGE string"))
    assert [r.ROOFAGE for r in df.orderBy("LOCNUM").collect()] == [float("inf"), float("-inf")]


def test_latin_1_and_quotes(spark, tmp_path):
    x = extract(tmp_path / "p.csv", 'ACCNTNUM,ACCNTNAME\n1,"Café ""A"""\n', "latin-1")
    assert read_extract(spark, x).first().ACCNTNAME == 'Café "A"'


def test_missing_file_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="prior_com_loc"):
        read_extract(spark, Extract("prior_com_loc", "prior", "Commercial", str(tmp_path / "none.csv")))


def test_doubled_headers_are_refused(spark):
    with pytest.raises(ValueError, match="ACCNTNUM"):
        normalize_columns(spark.createDataFrame([("a", "b")], "AccntNum string, ` accntnum` string"))


def test_insured_values(spark):
    both = spark.createDataFrame([("1", "1", "10", "5", "20")], "ACCNTNUM string, LOCNUM string, WSCV4VAL string, WSCV6VAL string, TOCV4VAL string")
    assert tuple(normalize(both).select("TIV_WS", "TIV_TO", "TIV_TOTAL").first()) == (15.0, 20.0, 20.0)
    ws = both.drop("TOCV4VAL")
    assert tuple(normalize(ws).select("TIV_WS", "TIV_TO", "TIV_TOTAL").first()) == (15.0, 0.0, 15.0)
    bare = both.select("ACCNTNUM", "LOCNUM")
    assert tuple(normalize(bare).select("TIV_WS", "TIV_TO", "TIV_TOTAL").first()) == (0.0, 0.0, 0.0)


def test_conform_adds_absent_columns(spark):
    df = conform(normalize(spark.createDataFrame([("1", "2")], "ACCNTNUM string, POLICYNUM string")))
    r = df.first()
    assert (r.LOBNAME, r.BLANPREAMT, r.POLICYTYPE) == ("", 0.0, None) and len(df.columns) == 13


def test_na_tokens(spark):
    df = spark.createDataFrame([("#N/A", "NULL", "n/a", "x")], "a string, `b c` string, c string, d string")
    assert tuple(na_to_null(df).first()) == (None, None, None, "x")


def test_catalog_and_audit(spark, tmp_path):
    a = extract(tmp_path / "a.csv", "ACCNTNUM,LOCNUM\n1,1\n", name="loc")
    b = extract(tmp_path / "b.csv", "ACCNTNUM,POLICYNUM\n1,1\n", name="pol")
    tables = {n: t for n, (_, t) in load_catalog(spark, [a, b]).items()}
    assert stack([a, b], tables, "Location").count() == 1 and stack([a, b], tables, "Policy").count() == 1
    assert write_audit(tables["pol"], str(tmp_path / "out"), skip_empty=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1
    assert not write_audit(tables["pol"].limit(0), str(tmp_path / "none"), skip_empty=True)
    assert not (tmp_path / "none").exists()


def test_rows_of_odd_length(spark, tmp_path):
    """A short row ends in nulls; a quoted comma is no field; a row with surplus fields is an error."""
    path = tmp_path / "odd.csv"
    path.write_text('ACCNTNUM,LOCNUM,NOTE\n1,2\n3,4,"a, b"\n5,6,"say ""x, y"""\n')
    extract = Extract("odd", "prior", "Commercial", str(path))
    assert [tuple(r) for r in read_extract(spark, extract).collect()] == [("1", "2", None), ("3", "4", "a, b"), ("5", "6", 'say "x, y"')]
    path.write_text("ACCNTNUM,LOCNUM,NOTE\n1,2,3\n1,2,3,4\n")
    with pytest.raises(Exception, match="more fields than its header"):
        read_extract(spark, Extract("odd", "prior", "Commercial", str(path))).collect()


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text('ACCNTNUM,NOTE\n1,"a\nb"\n')
    rows = read_extract(spark, Extract("lines", "prior", "Commercial", str(path), multi_line=True)).collect()
    assert [tuple(r) for r in rows] == [("1", "a\nb")]
