"""python -m tallymark VERB: query, build, crosscheck, evaluate, gate. `gate` exits with 2 where a candidate is refused."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallymark.operators import registry
from tallymark.plans import build, catalog_eval, catalog_plays, catalog_serving

CATALOGS = (catalog_plays, catalog_eval, catalog_serving)


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="tallymark", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, told in (("query", "run a query of the catalogue"), ("build", "write the dataset"), ("crosscheck", "labels against official totals"), ("evaluate", "metrics with intervals"), ("gate", "check candidates")):
        sub = verbs.add_parser(verb, help=told)
        sub.add_argument("--data", required=True, help="directory of the tables")
        sub.add_argument("--out", help="where to write; without it, rows are shown")
        if verb == "query":
            sub.add_argument("name", choices=sorted(n for c in CATALOGS for n in c.QUERIES))
        if verb == "gate":
            sub.add_argument("--min-valid", type=float, default=0.95)
            sub.add_argument("--tolerance", type=float, default=1.0, help="points of a hundred that a bucket may fall")
    told = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"tallymark {told.verb}").getOrCreate()
    code = 0
    if told.verb == "query":
        out = next(c.QUERIES[told.name] for c in CATALOGS if told.name in c.QUERIES)(spark, told.data)
    elif told.verb == "build":
        if not told.out:
            parser.error("build needs --out")
        build.build(spark, told.data, told.out).orderBy("part", "bucket").show(1000, truncate=False)
        return 0
    elif told.verb == "crosscheck":
        out = catalog_plays.reconcile_agreement(spark, told.data)
    elif told.verb == "evaluate":
        out = catalog_eval.cluster_bootstrap_ci(spark, told.data)
    else:
        candidates, now = catalog_eval._models(spark, told.data)
        out = registry.gate(candidates, now, min_valid=told.min_valid, tolerance=told.tolerance)
        code = 0 if registry.decision(out).agg(F.bool_and("promote")).first()[0] else 2
    if told.out:
        out.write.mode("overwrite").parquet(told.out)
    else:
        out.show(100, truncate=False)
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
