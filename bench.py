"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from matchlab.catalog import load_all  # noqa: E402
from matchlab.catalog.registry import QUERIES  # noqa: E402
from matchlab.session import get_session  # noqa: E402

HEADLINE = (
    "load_results", "extra_time_correction", "rest_days", "form_aggregates", "form_sequence",
    "elo_ratings", "rating_rps", "derive_context", "score_grid", "derive_markets", "mean_metrics",
    "best_odds", "value_bets", "adjustment_chain", "fold_metrics", "dc_sufficient_stats",
    "feature_matrix", "sequence_tensors", "net_batch_score", "article_body", "team_article_match",
    "odds_join_swapped", "known_team_semijoin", "stream_best_odds",
)

# Slower or iterative queries, timed after the headline and not part of its total.
OTHERS = (
    "dc_fit", "fit_temperature", "isotonic_fit", "fuzzy_name_match", "dedupe_articles", "stream_elo", "stream_odds_snapshot",
)
LARGE = ("orders", "lineitem", "documents", "pages", "events")


def prepared(spark, sf_dir: str, files: int) -> str:
    """The tables with the large ones in several files, as a table of a cluster would be."""
    out = tempfile.mkdtemp(prefix="bench-")
    for name in os.listdir(sf_dir):
        if name.removesuffix(".parquet") in LARGE:
            spark.read.parquet(os.path.join(sf_dir, name)).repartition(files).write.parquet(os.path.join(out, name))
        else:
            os.symlink(os.path.join(sf_dir, name), os.path.join(out, name))
    return out


def timed(spark, sf_dir: str, names: tuple[str, ...]) -> dict[str, float]:
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    return seconds


def warm_up(spark) -> None:
    """Start the executor threads and a Python worker, so the first query is not charged for it."""
    rows = spark.range(100_000).selectExpr("id", "id % 97 as k").repartition(8)
    rows.mapInPandas(lambda batches: batches, "id bigint, k bigint").groupBy("k").count().collect()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session("bench", cpus=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    warm_up(spark)
    tables = prepared(spark, sf_dir, cpus)
    seconds, others = timed(spark, tables, HEADLINE), timed(spark, tables, OTHERS)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "others": others,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
