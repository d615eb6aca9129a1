from pyspark.sql import functions as F

from stratiform.operators import logs


def test_fields_of_a_result_row_parse_its_cases_once(spark):
    row = '{"error": "top", "test_cases": [{"passed": true, "message": " "}, {"result": "no", "message": "wrong"}]}'
    rows = spark.createDataFrame([(row,), (None,), ('{"cases": [], "soft_score": "0.5", "passed": "yes"}',)], "row string").select(logs.result_fields(F.col("row")).alias("f"))
    assert [tuple(r.f) for r in rows.collect()] == [(False, 0.5, "top; wrong"), (False, None, None), (True, 0.5, None)]
    assert rows._jdf.queryExecution().analyzed().toString().count("from_json(") == 2
