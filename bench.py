"""Benchmark: headline stages at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced end to end with the ``noop`` sink (full computation,
nothing collected to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from noteflare.plans import queries as Q  # noqa: E402
from noteflare.session import build_local  # noqa: E402

# Stages of the reference run (extract, clean + features, label + split,
# vectors, fit, evaluate, score) plus the corpus-scale text work.
HEADLINE = (
    "note_base",          # extract: cohort semi join, 9 left joins, ordered diagnosis aggregation
    "note_features",      # HTML cleaning + F1-F29
    "next_flare_label",   # next-visit window label
    "split_summary",      # patient split + per-split stats
    "note_tfidf",         # vocabulary + TF-IDF on the notes
    "linear_score",       # fit + score the linear model
    "roc_auc",            # exact bucketed ROC-AUC
    "note_risk",          # scoring + explanations
    "patient_rollup",     # patient roll-up
    "doc_tfidf",          # TF-IDF over the whole documents corpus
    "word_freq",          # word frequency over the corpus
    "gbt_train_eval",     # TF-IDF -> SVD -> GBT fit -> test scoring
)


def run(sf_dir: str, cpus: int, names=HEADLINE) -> dict:
    spark = build_local(cpus=cpus, shuffle_partitions=cpus * 2, app="noteflare-bench")
    # Warm the JVM (class loading, codegen) on a tiny job; not part of any query.
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        t0 = time.time()
        df = Q.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    spark.stop()
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    times = run(sf_dir, cpus, names)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
