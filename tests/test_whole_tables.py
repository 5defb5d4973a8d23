"""Queries take the whole of their tables."""

from pyspark.sql import functions as F

from heronry import queries


def test_store_round_trip_adds_every_row(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.withColumn("lang", F.when(F.col("doc_id") % 7 > 0, F.col("lang"))).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (sf_dir, str(tmp_path)):
        found = queries.store_round_trip(spark, folder).first()
        texts = docs.select("text").distinct().count()  # a text is added once; every tenth is removed
        assert found["num_docs"] == texts - -(-texts // 10)


def test_rows_without_the_key_do_not_hide_a_value(spark, tmp_path):
    # rows in the order of the file: else a null key comes last, where the limit happens to cut it
    for key, value in (("spark.sql.codegen.aggregate.map.twolevel.enabled", "false"), ("spark.sql.shuffle.partitions", "1")):
        spark.conf.set(key, value)
    rows = spark.range(1026).select(F.when(F.col("id") > 0, F.concat(F.lit('{"k":"'), "id", F.lit('"}'))).otherwise(F.lit("{}")).alias("props"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    try:
        assert queries.field_degraded(spark, str(tmp_path)).first().degraded
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.codegen.aggregate.map.twolevel.enabled")
