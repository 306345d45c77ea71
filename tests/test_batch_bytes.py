"""What a Python worker of a catalogue query holds at once."""

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__


def test_a_batch_of_long_documents_is_bounded_in_bytes(spark):
    def sizes(spark, d):
        def size(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

        return spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("t")).mapInArrow(size, "n long")

    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(n) for n in names]
    try:
        got = [r.n for r in __spark_entry__._prepared(sizes, __spark_entry__.BATCH_ROWS)(spark, "").collect()]
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert sum(got) > 59_000_000 and max(got) < 20_000_000
