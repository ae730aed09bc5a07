"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from evidex.functions.text import request_tokens
    from evidex.operators import search
    from evidex.plans import registry
    from evidex.plans import tables as tb

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, f):
        began = time.time()
        f()
        times[name] = round(time.time() - began, 3)

    spark.range(1000).selectExpr("sum(id)").collect()  # the session's own start is not a query's
    queries = registry.queries()
    timed("index_build", lambda: tb.index(spark, sf))  # written once; the searches below read it and no text
    names = "r10_ranked_search r10_bm25_scores r11_ladder r3_prefix_pass r9_phrase_match c4_line_groups g1_chunks g6_claim_ids j12_disagreements q3_one_call q7_check_claims q8_check_choices q9_check_values j11_audit_matrix"
    for name in f"{names} v4_version_actions v11_project_groups v13_integrity a2_usage_by_agent r20_greedy_fit r_packets_end_to_end".split():
        timed(name, lambda name=name: queries[name](spark, sf).write.format("noop").mode("overwrite").save())
    index, head = tb.index(spark, sf), tb.chunks(spark, sf).drop("text")
    base = tb.table(spark, sf, "benchmark").select(request_tokens(F.col("text")).alias("terms"))
    n_base = base.count()
    for batch in (1, 100, 1000):
        many = base.crossJoin(spark.range(-(-batch // n_base))).limit(batch).withColumn("request_id", F.monotonically_increasing_id()).select("request_id", "terms")
        scope = many.select("request_id").crossJoin(head.select("project_id").distinct()).withColumn("priority", F.lit(0))
        run = lambda many=many, scope=scope: search.ladder(search.scored(many, index), head, scope, 8, many).write.format("noop").mode("overwrite").save()
        timed(f"search_batch_{batch}", run)
        times[f"search_ms_per_request_{batch}"] = round(1000 * times[f"search_batch_{batch}"] / batch, 3)
    total = round(sum(v for k, v in times.items() if "_ms_" not in k), 3)
    print(json.dumps({"metric": "headline queries, total seconds", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
