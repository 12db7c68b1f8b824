"""Citation keys of long runs of equal names."""

from pyspark.sql import functions as F

from quirelab.sources import exports


def test_suffixes_stay_different_beyond_a_byte(spark):
    n = [1, 2, 27, 28, 29, 703, 704, 4161, 4162, 26 * (0xD800 - 96) + 1, 26 * (0xD800 - 96) + 2]
    found = [r[0] for r in spark.createDataFrame([(k,) for k in n], "n int").select(exports.suffix(F.col("n"))).collect()]
    assert found == ["", "a", "z", "aa", "ab", "zz", "{a", "ÿz", "Āa", "퟿z".encode("utf-16", "surrogatepass").decode("utf-16"), "a"]


def test_keys_of_one_name_are_unique(spark):
    rows = spark.range(6000).select("id", F.lit("Ōno").alias("s"), F.lit(2020).alias("y"))
    assert exports.bibtex_keys(rows, "id", "s", "y").select("cite_key").distinct().count() == 6000
