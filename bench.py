"""Headline-query benchmark: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is executed in full with the ``noop`` sink (no collect).
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cadenza.plans.registry import load_all  # noqa: E402
from cadenza.session import get_spark  # noqa: E402

HEADLINE = [
    "rec_raw_vector", "join_knn", "man_purity", "man_silhouette", "man_calinski_harabasz",
    "dedup_keep_first", "join_chord_merge", "vec_assemble", "join_lyrics_enrich",
    "rec_item_cf", "eva_compare_models", "rec_similar", "idea_cross_genre", "rec_text_rerank",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", app="cadenza-bench",
                      **{"spark.sql.shuffle.partitions": str(max(8, int(cpus) * 2))})
    reg = load_all()
    names = [n for n in HEADLINE if n in reg]
    # warm-up: JVM, file listing and the Python workers used by the Arrow-batched operators
    reg["agg_genres"].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(8).mapInPandas(lambda it: it, "id long").write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        reg[n].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
