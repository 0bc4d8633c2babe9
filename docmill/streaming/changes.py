"""Change streams over the change log with Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors.exceptions.base import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docmill import authz
from docmill.authz import Context
from docmill.errors import Forbidden
from docmill.functions import paths
from docmill.operators import predicates
from docmill.plans.model import Where
from docmill.sources.store import CDC_TYPE


def stream(spark: SparkSession, log_path: str, collection: str = "*", where: Iterable[Where] = ()) -> DataFrame:
    """The log as a streaming frame, filtered by collection and by clauses over the change record."""
    df = spark.readStream.schema(CDC_TYPE).parquet(log_path)
    if collection != "*":
        df = df.where(F.col("collection") == collection)
    for w in where:
        w.check()
    kept = predicates.conjunction(tuple(where), lambda p: paths.resolve(df.schema, p))
    return df if kept is None else df.where(kept)


def subscribe(db, collection: str, handler: Callable[[dict], bool | None], checkpoint: str, where: Iterable[Where] = (), context: Context | None = None, follow: bool = False) -> StreamingQuery:
    """Call the handler with every change record, in order of time within a batch; it stops the stream by returning False:
    the query ends, and that batch is delivered again to whoever goes on from the checkpoint.

    The checkpoint folder remembers what was delivered. follow: keep running; else stop at the end of what is there.
    Only internal callers may subscribe to all collections ("*")."""
    context = context or Context()
    if collection == "*":
        if not context.internal:
            raise Forbidden("only internal callers may follow all collections")
    else:
        authz.require(db.schema(collection), "changeStream", context, {"filter": [w.__dict__ for w in where]}, db.library)
    store = db.store(context)
    if not store.files.names(store.cdc_path):
        db.spark.createDataFrame([], CDC_TYPE).write.mode("append").parquet(store.cdc_path)
    done = []

    def batch(df: DataFrame, _: int) -> None:
        for row in df.orderBy("timestamp", "_id").toLocalIterator():
            record = row.asDict(recursive=True)
            record["metadata"] = json.loads(record["metadata"] or "{}")
            if handler(record) is False:
                done.append(True)
                raise StopIteration("stopped by the handler")  # ends the query; the batch does not count as delivered

    writer = stream(db.spark, store.cdc_path, collection, where).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    query = (writer if follow else writer.trigger(availableNow=True)).start()
    if not follow:
        try:
            query.awaitTermination()
        except StreamingQueryException:
            if not done:
                raise
    return query
