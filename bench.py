"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql.functions import lit

from tessera.operators.routes import search_batch
from tessera.operators.understanding import assemble_intent
from tessera.plans import fixtures, registry
from tessera.plans.fixtures import sampled
from tessera.session import build_session, materialise

BATCH = 1000

HEADLINE = (
    "c1_count_substance_tree", "c2_count_contains", "c8_count_route", "l2_list_manufacturers", "l3_list_trade_names",
    "l4_list_substance_gp", "l5_list_by_manufacturer", "r1_exact_match_topk", "r2_vector_topk", "r3_fulltext_topk", "r5_traverse",
    "r7_fuse_rrf", "r11_search_general", "l12_search_batch", "m1_ranking_metrics", "m6_acceptance_metrics", "g2_substance_sets",
    "g3_manufacturer_sets", "q5_match_manufacturer", "q17_assemble_intent", "q9_spans_from_bio", "k3_knn_sweep", "t6_bio_align",
    "t12_entity_scores",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("tessera-bench", master=f"local[{cpus}]", partitions=cpus, spark__driver__memory="20g")
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    start = time.perf_counter()
    fixtures.catalogue(spark, sf_dir)
    times["ingest_catalogue"] = round(time.perf_counter() - start, 3)
    n_questions = fixtures.structured(spark, sf_dir).count()
    batch = None
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    if not sys.argv[1:]:
        # A larger batch shows the cost per question once the fixed cost of the plan is shared.
        sample = sampled(fixtures.templated(spark, sf_dir).withColumn("all", lit(1)), ["all"], "query_id", "bench", BATCH).drop("all", "r")
        asked = materialise(assemble_intent(sample, fixtures.manufacturer_dim(spark, sf_dir)), "bench_questions")
        start = time.perf_counter()
        search_batch(asked, fixtures.catalogue(spark, sf_dir), None, with_context=False).seeds.write.format("noop").mode("overwrite").save()
        batch = time.perf_counter() - start
        times[f"search_batch_{BATCH}_questions"] = round(batch, 3)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": cpus, "router_questions": n_questions}
    if batch:
        out["batch_ms_per_question"] = round(1000 * batch / BATCH, 1)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
