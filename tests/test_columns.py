import datetime

from pyspark.sql import functions as F

from scholarlens.functions import columns as C
from scholarlens.functions.stem import stem_words
from scholarlens.operators import growth as G
from scholarlens.session import scratch_path
from scholarlens.sources import readers, writers
from scholarlens.sources.schemas import STUDY


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_dates_and_bad_texts(spark):
    assert one(spark, C.parse_month_day_year(F.lit("7/1/20"))) == datetime.date(2020, 7, 1)
    assert one(spark, C.parse_month_day_year(F.lit("1/1/70"))) == datetime.date(2070, 1, 1)
    assert one(spark, C.parse_month_day_year(F.lit("soon"))) is None


def test_flags_take_null_as_zero(spark):
    rows = spark.createDataFrame([(None,), (0,), (3,)], "n int")
    assert [r[0] for r in rows.select(C.flag_positive("n")).collect()] == [0, 0, 1]
    texts = spark.createDataFrame([(None,), ("a",), ("b",)], "t string")
    assert [r[0] for r in texts.select(C.flag_equals("t", "a")).collect()] == [0, 1, 0]


def test_rounding_paste_and_labels(spark):
    assert one(spark, F.round(F.lit(0.125), 2)) == 0.13
    assert one(spark, F.bround(F.lit(0.125), 2)) == 0.12
    null = F.lit(None).cast("string")
    assert one(spark, C.paste(F.lit("a"), null, F.lit("b"))) == "a. b"
    assert one(spark, C.paste(F.lit("a"), null, na_text="NA")) == "a. NA"
    assert one(spark, C.recycled(("x", "y"), F.lit(3))) == "x"
    assert one(spark, C.contrast_side(F.lit(-0.2))) == "right"
    assert one(spark, C.contrast_side(F.lit(0.1))) == "middle"


def test_unmapped_basis_is_not_the_total_row(spark):
    rows = spark.createDataFrame(
        [("2020-01-01", "OTHER", 3), ("2020-01-01", "UNKNOWN", 4)],
        "d string, basis string, n bigint").withColumn("basis2", C.basis_class("basis"))
    out = {(r.basis2, r.is_total): r.total
           for r in G.totals_and_parts(rows, "d", "basis2", "n").collect()}
    assert out == {(None, 0): 3, ("Unknown", 0): 4, ("total", 1): 7}


def test_stems_of_known_words(spark):
    pairs = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
        "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
        "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky",
        "relational": "relat", "conditional": "condit", "vietnamization": "vietnam",
        "operator": "oper", "hopefulness": "hope", "triplicate": "triplic",
        "electrical": "electr", "goodness": "good", "revival": "reviv", "adjustment": "adjust",
        "adoption": "adopt", "probate": "probat", "rate": "rate", "controlling": "control",
        "species": "speci", "über": "über",
    }
    words = spark.createDataFrame([(w,) for w in pairs], "term string")
    got = {r.term: r.stem for r in stem_words(words).collect()}
    assert got == pairs


def test_csv_keeps_breaks_quotes_and_the_code_na(spark):
    row = tuple(None if f.name not in ("id", "abstract", "countriesOfCoverage") else v
                for f, v in zip(STUDY, ["x", *[None] * 6, 'two\nlines, "quoted"', *[None] * 4,
                                        "NA,US", *[None] * 5]))
    path = scratch_path(spark, "studies")
    spark.createDataFrame([row], STUDY).write.csv(path, header=True, escape='"')
    back = readers.read_studies(spark, path).first()
    assert back.abstract == 'two\nlines, "quoted"'
    assert back.countriesOfCoverage == "NA,US" and back.title is None


def test_map_round_trip(spark):
    rows = [("coverage", 'A"B', 3, 1.5, -2.0, "Land"), ("coverage", "NA", 7, 0.0, 0.0, "Sand")]
    counts = spark.createDataFrame(rows, "layer string, code string, count bigint, lat double, "
                                         "lon double, name string")
    path = scratch_path(spark, "map")
    writers.write_map(counts, path)
    assert sorted(map(tuple, readers.read_map(spark, path).collect())) == sorted(rows)
    assert writers.map_documents(counts).first().all_data.startswith('[["NA",7,0.0,0.0,"Sand"]')
