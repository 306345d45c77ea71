"""What an index build holds in memory and writes, at the size of a task."""

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quarry.operators import indexing, profiles
from quarry.settings import Settings


def test_profiles_of_a_batch_equal_those_of_each_text():
    texts = ["", " ", "a", "İstanbul x", "aa\x1cbb aa bb", "One two, one TWO three.", "ünï cödé " * 3, "\U0001d11e clef b"]
    got = profiles.profiles(texts, 16).to_pylist()
    for text, row in zip(texts, got, strict=True):
        one = profiles.profile(text, 16)
        for family in ("word", "char"):
            want = dict(zip(one[family + "_ids"].tolist(), one[family + "_tfs"].tolist()))
            assert dict(zip(row[family + "_ids"], row[family + "_tfs"])) == want
            assert row[family + "_ids"] == sorted(want)
        assert row["buckets"] == one["buckets"].tolist()
    assert len(profiles.profiles([], 16)) == 0


def test_grams_are_counted_in_slices_of_rows():
    lows = [f"word{i} other words of row {i}" for i in range(50)]
    for a, b in zip(profiles._char_terms(lows), profiles._char_terms(lows, cells=100), strict=True):
        assert np.array_equal(a, b)


def test_ids_that_repeat_are_written_by_dictionary(spark, tmp_path):
    # 300,000 ids besides 500 common ones: a dictionary of the usual 1 MB holds 131,072 and gives up
    rows = spark.range(0, 1200, 1, 1).select(F.col("id").alias("idx"), F.transform(
        F.sequence(F.lit(0), F.lit(999)), lambda i: F.xxhash64(F.when(i < 500, i).otherwise((F.col("id") % 600) * 500 + i))).alias("char_ids"))
    version = indexing.new_version()
    indexing.save_table(spark, str(tmp_path), version, "profiles", rows, 1, placed=True)
    (file,) = (tmp_path / version / "profiles").glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert all("PLAIN" not in meta.row_group(g).column(1).encodings for g in range(meta.num_row_groups))


def test_buckets_fill_whole_rounds_of_the_cores():
    s = Settings(bucket_target_chars=100)
    assert [indexing.bucket_count(n, 4, s) for n in (0, 1, 400, 401, 2500)] == [4, 4, 4, 8, 28]


def test_catalogue_queries_bound_the_rows_of_a_batch(spark, tmp_path):
    import __spark_entry__ as entry

    seen = []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        read = lambda s, d: seen.append(s.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        entry._prepared(read, entry.BATCH_ROWS)(spark, "")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert seen == ["1024"]
