"""Bodies of mutations against what the reference's decoder takes."""

from pyspark.sql import functions as F

from tidewake.operators import validate

GOOD = ['{"value":"x"}', ' {"value":""}\n', '{"value":"x","ttl_ms":5,"context":{"a:1":1}}', '{"value":"x","ttl_ms":null,"context":null}', '{"value":"\\u00e9 } {"}']
BAD = [
    None, "", "5", "null", "[]", "{}", '{"value":null}', '{"value":"x"} {"value":"y"}', '{"value":"x"}{', '{"value":"x"} tail', '{"value":5}', '{"value":"x","ttl_ms":"abc"}', '{"value":"x","ttl_ms":true}', '{"value":"x","ttl_ms":1.5}',
    '{"value":"x","ttl_ms":99999999999999999999}', '{"value":"x","context":5}', '{"value":"x","context":[]}', '{"value":"x","context":{"a":"1"}}', '{"value":"x","context":{"a":null}}', '{"value":"x","context":{"a":-1}}', '{"value":"x","other":1}', '{"value":"x","ttl_ms":NaN}',
]


def test_bodies(spark):
    rows = spark.createDataFrame([(b, s) for s, bodies in ((200, GOOD), (400, BAD)) for b in bodies], "body string, want int")
    got = rows.withColumn("got", validate.mutation_status(F.lit("PUT"), F.col("body"))).collect()
    assert [(r["body"], r["got"]) for r in got] == [(r["body"], r["want"]) for r in got]
