"""Declared schemas: columns are read by name and type, never inferred or taken by position."""

from pyspark.sql import types as T

STUDY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("authors", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("doi", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("publisher", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("openAccess", T.BooleanType()),
    T.StructField("notes", T.StringType()),
    T.StructField("keywords", T.StringType()),
    T.StructField("countriesOfResearcher", T.StringType()),
    T.StructField("countriesOfCoverage", T.StringType()),
    T.StructField("tracking source", T.StringType()),
    T.StructField("Number of downloads", T.IntegerType()),
    T.StructField("Phyla represented in downloads", T.StringType()),
    T.StructField("Total records in downloads", T.LongType()),
    T.StructField("taxonomic.group", T.StringType()),
])

DATASET_CITATIONS = T.StructType([
    T.StructField("datasetkey", T.StringType()),
    T.StructField("citations", T.LongType()),
])

DATASET_SNAPSHOTS = T.StructType([
    T.StructField("snapshot_date", T.StringType()),
    T.StructField("datasetkey", T.StringType()),
    T.StructField("basis_of_record", T.StringType()),
    T.StructField("tagged_citizen_science", T.BooleanType()),
    T.StructField("occurrence_count", T.LongType()),
])

OCCURRENCE_COUNTS = T.StructType([
    T.StructField("snapshot", T.StringType()),
    T.StructField("kingdom", T.StringType()),
    T.StructField("basisOfRecord", T.StringType()),
    T.StructField("occurrenceCount", T.LongType()),
])

COUNTRY = T.StructType([
    T.StructField("iso2", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])

MAP_DOCUMENT = T.StructType([
    T.StructField("datasets", T.ArrayType(T.StructType([
        T.StructField("version", T.StringType()),
        T.StructField("data", T.StructType([
            T.StructField("id", T.StringType()),
            T.StructField("label", T.StringType()),
            T.StructField("color", T.ArrayType(T.LongType())),
            T.StructField("allData", T.ArrayType(T.ArrayType(T.StringType()))),
            T.StructField("fields", T.ArrayType(T.StructType([
                T.StructField("name", T.StringType()),
                T.StructField("type", T.StringType()),
            ]))),
        ])),
    ]))),
])
