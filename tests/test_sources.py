import pytest
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from verdictlake.sources import jsonl as J

SCHEMA = StructType([StructField("a", IntegerType()), StructField("b", StringType())])


def test_rows_and_marks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "line\nbreak")], SCHEMA)
    assert J.write_rows(rows, f"{tmp_path}/rows") == 3
    assert sorted(map(tuple, J.read_rows(spark, f"{tmp_path}/rows", SCHEMA).collect())) == [(1, "x"), (2, None), (3, "line\nbreak")]
    (tmp_path / "cut.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": "y')
    assert [tuple(r) for r in J.read_rows(spark, f"{tmp_path}/cut.jsonl", SCHEMA, tolerant=True).collect()] == [(1, "x")]
    with pytest.raises(Exception, match="MALFORMED|alformed"):
        J.read_rows(spark, f"{tmp_path}/cut.jsonl", SCHEMA).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        J.read_rows(spark, f"{tmp_path}/none", SCHEMA).collect()
    assert J.done_summary(spark, f"{tmp_path}/marks", "one") is None
    J.mark_done(spark, f"{tmp_path}/marks", "one", {"rows": 3})
    assert J.done_summary(spark, f"{tmp_path}/marks", "one") == {"rows": 3}
