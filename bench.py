"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanveil.operators import detectors as d
from spanveil.operators.guard import Guard, restore
from spanveil.plans.catalog import KEY, table

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def queries(spark) -> dict:
    """Each reads all documents; a sum over the result stands for writing it."""
    docs = table(spark, SF, "documents").select("doc_id", "text").repartition(2 * int(CPUS)).persist()
    docs.count()
    full = Guard.full(key=KEY)
    natives = Guard((d.phone(), d.inn(), d.snils(), d.bank_card()), key=KEY)
    masked = full.mask(docs, "doc_id").select("doc_id", F.col("masked.text").alias("response"), F.col("masked.tokens").alias("tokens")).persist()
    masked.count()
    found = lambda g: g.detect(docs).agg(F.sum(F.size("detected.findings")))
    return {
        "detect_one_native": lambda: found(Guard((d.bank_card(),), key=KEY)),
        "detect_native": lambda: found(natives),
        "detect_email": lambda: found(Guard((d.email(),), key=KEY)),
        "detect_all": lambda: found(full),
        "mask_all": lambda: full.mask(docs, "doc_id").agg(F.sum(F.length("masked.text")), F.sum(F.size("masked.tokens"))),
        "restore": lambda: restore(masked, "response", "tokens").agg(F.sum(F.length("restored.text"))),
    }


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    taken = {}
    for name, run in queries(spark).items():
        run().collect()
        began = time.perf_counter()
        run().collect()
        taken[name] = round(time.perf_counter() - began, 3)
    n = table(spark, SF, "documents").count()
    rates = {k: round(n / v) for k, v in taken.items()}
    print(json.dumps({"metric": "guard over documents, warm", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "documents_per_second": rates, "documents": n, "sf": SF}))


if __name__ == "__main__":
    main()
