"""Times the headline queries and writes at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

QUERIES = ("where_gt", "where_conjunction", "point_get", "agg_multi_key", "agg_expr_key", "agg_having", "join_left_eq", "join_one_to_many", "join_chain3", "agg_join", "limit_topk", "page_2", "where_numeric_string", "mod_case", "fn_hash")

CUSTOMER = {"type": "object", "x-collection": "customer", "required": ["c_custkey"], "properties": {"c_custkey": {"type": "integer", "x-primary": True}, "c_name": {"type": "string"}, "c_mktsegment": {"type": "string"}, "c_acctbal": {"type": "number"}}}
ORDERS = {"type": "object", "x-collection": "orders", "required": ["o_orderkey", "o_custkey"], "properties": {"o_orderkey": {"type": "integer", "x-primary": True}, "o_custkey": {"type": "integer", "x-foreign": {"collection": "customer", "cascade": True}}, "o_totalprice": {"type": "number", "minimum": 0}, "o_orderstatus": {"type": "string", "enum": ["F", "O", "P"]}}}


def main() -> None:
    from pyspark.sql import SparkSession

    from docmill.database import Database
    from docmill.queries import QUERIES as REGISTERED
    from docmill.queries import table

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("docmill-bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def clock(name: str, work) -> None:
        began = time.perf_counter()
        work()
        took[name] = round(time.perf_counter() - began, 4)

    for name in QUERIES:
        run = lambda name=name: REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        run()  # compile and warm the page cache
        clock(name, run)

    folder = tempfile.mkdtemp(prefix="docmill-bench-")
    rates = {}
    try:
        db = Database(spark, f"file://{folder}")
        db.configure([ORDERS, CUSTOMER])
        orders = table(spark, sf_dir, "orders")
        n = orders.count()
        clock("bulk_create_customers", lambda: db.tx(lambda t: t.create_all("customer", table(spark, sf_dir, "customer"))))
        clock("bulk_create_orders_fk_cdc", lambda: db.tx(lambda t: t.create_all("orders", orders)))
        clock("bulk_upsert_orders", lambda: db.tx(lambda t: t.set_all("orders", orders.withColumn("o_totalprice", orders.o_totalprice + 1))))
        clock("get_document", lambda: db.get("orders", 7))
        rates = {k: round(n / took[k]) for k in ("bulk_create_orders_fk_cdc", "bulk_upsert_orders")}
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "total seconds of the headline queries and writes", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows_per_second": rates, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
