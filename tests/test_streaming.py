from cohortspark.operators.bad_rows import failed_rows, parse_sheet_rows
from cohortspark.streaming.sheets import split_stream


def test_stream_gives_what_a_batch_gives(spark, sf, tmp_path):
    rows, sheets = spark.read.parquet(f"{sf}/sheet_rows.parquet"), spark.read.parquet(f"{sf}/sheets.parquet")
    source = f"{tmp_path}/in"
    first, rest = rows.where("row_id % 2 = 0"), rows.where("row_id % 2 = 1")
    for part in (first, rest):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        for query in split_stream(stream, sheets, f"{tmp_path}/valid", f"{tmp_path}/failed", f"{tmp_path}/checkpoint"):
            query.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/failed").collect()}
    assert got == {tuple(r) for r in failed_rows(parse_sheet_rows(rows, sheets)).collect()}
    assert spark.read.parquet(f"{tmp_path}/valid").count() + len(got) == rows.count()
