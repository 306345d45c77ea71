"""Seeded random keys against the randomness battery."""

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import secret_scan
from quarry.llm.common import table


def keys(rng, encoding, length, count):
    return ["".join(rng.choice(list(secret_scan.ALPHABETS[encoding]), length)) for _ in range(count)]


def test_long_base64_keys_are_random_spans(spark):
    rng = np.random.default_rng(11)
    texts = [k for e in ("base64", "base64url") for n in (2000, 5000) for k in keys(rng, e, n, 2)]
    df = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-i - 1, f"key {x} end") for i, x in enumerate(texts)], "doc_id long, text string"))
    got = secret_scan.secret_spans(df).where("doc_id < 0").select("doc_id", secret_scan.joined(F.col("secrets.spans")).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {-i - 1: f"random:4:{4 + len(x)}" for i, x in enumerate(texts)}


def test_detection_rates_by_encoding_and_length(spark):
    """Shares of keys whose p_text is at most 0.01 and whose p_random is kept, under the text of sf0.01."""
    s, rng = secret_scan.BatterySettings(), np.random.default_rng(7)
    moments = secret_scan.text_moments(table(spark, "/root/testdata/sf0.01", "documents"), s)
    least = {20: 0.8, 32: 0.9, 40: 0.95, 64: 0.97}
    rows = [(e, n, k) for e in ("hex", "lower36", "base62", "base64", "base64url") for n in least for k in keys(rng, e, n, 100)]
    df = spark.createDataFrame(rows, "enc string, n long, text string")
    found = df.select("enc", "n", F.explode(secret_scan.battery(secret_scan.matches(F.col("text"), secret_scan.CANDIDATE), s, moments)).alias("c"))
    rates = found.groupBy("enc", "n").agg((F.count_if((F.col("c.p_text") <= 0.01) & (F.col("c.p_random") >= 0.001)) / 100).alias("rate")).collect()
    assert len(rates) == 20
    for r in rates:
        assert r.rate >= (0.35 if (r.enc, r.n) == ("lower36", 20) else least[r.n] - 0.02), r


def test_keys_without_a_digit_count_and_plain_runs_do_not(spark):
    rng = np.random.default_rng(4)
    letters = ["".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), 40)) for _ in range(5)]
    plain = ["-" * 60, "_" * 30, "thesearesomeordinarywordswrittentogetherinonelongrun", "InternationalizationConfigurationProviderFactory", "state-of-the-art-and-other-well-known-words-of-the-language"]
    df = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-i - 1, x) for i, x in enumerate(letters + plain)], "doc_id long, text string"))
    got = secret_scan.secret_spans(df).where("doc_id < 0").select("doc_id", secret_scan.joined(F.col("secrets.spans")).alias("s")).collect()
    assert [r.s for r in sorted(got, key=lambda r: -r.doc_id)] == ["random:0:40"] * 5 + [""] * 5
