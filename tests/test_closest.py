"""The closest entries of a key where one trigram stands in very many entries."""

from notewright.operators import linking


def test_frequent_trigrams_count(spark):
    """Trigrams of more than 8,000 entries were left out, so a key of such trigrams only had no entries."""
    icd = spark.createDataFrame([(f"A{i:05d}", f"aaa{i:05d}", None, f"aaa{i:05d}", "") for i in range(8100)], "code string, vn string, en string, key_vn string, key_en string")
    got = linking.explain(spark.createDataFrame([("aaa",), ("",), (" ",), (None,), ("zz",)], "key string"), icd).collect()
    assert sorted((r.key, r.code, r.name) for r in got) == [("aaa", f"A{i:05d}", f"aaa{i:05d}") for i in range(5)]
