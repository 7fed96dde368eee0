"""Settings shared by the operators that hand whole texts to Python workers."""

from __future__ import annotations

from pyspark.sql import DataFrame

_BATCH = 1_000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose texts now go to workers at most ``_BATCH`` at a time.

    A worker and the JVM beside it both hold a batch, so its size bounds their memory. A
    session that already asks for smaller batches keeps them.
    """
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(_SETTING, "10000")) <= _BATCH:
        conf.set(_SETTING, str(_BATCH))
    return docs
