"""Addresses of shards, all of them."""

import __spark_entry__ as entry


def test_every_address_is_located(spark, tmp_path, rows):
    table = [("a", {"s": 3}), ("b", {"s": 1, "t": 4}), ("c", {"t": 2})]
    spark.createDataFrame(table, "shard_id string, source_token_counts map<string,long>").write.parquet(f"{tmp_path}/token_shards.parquet")
    got = rows(entry.queries()["shard_lookup"](spark, str(tmp_path)))
    want = [(s, k) for s, n in (("a", 3), ("b", 5), ("c", 2)) for k in range(n)]
    assert got == sorted([(p, s, k) for p, (s, k) in enumerate(want)], key=repr)
