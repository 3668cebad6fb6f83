"""Command line: python -m glossmill list | query NAME SF_DIR [-o PATH] | collect CSV OUT | template PLATFORM OUT |
generate OUT [--config YAML] [--samples N] [--judge NAME] | check-weights YAML | capture OUT | configure YAML |
try-provider NAME [--runs N] | fetch-model NAME FOLDER | jobs URL KEY_VARIABLE [--limit N] | models URL KEY_VARIABLE."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="glossmill")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    q = sub.add_parser("query", help="run a query over a folder of tables")
    q.add_argument("name")
    q.add_argument("sf_dir")
    q.add_argument("-o", "--output", help="a folder for the result as Parquet; without it, 20 rows are shown")
    t = sub.add_parser("collect", help="append a CSV of reviews to a folder of JSON lines")
    t.add_argument("csv")
    t.add_argument("output")
    t.add_argument("--source", default="csv")
    t = sub.add_parser("template", help="write the header of a collection template")
    t.add_argument("platform")
    t.add_argument("output")
    t = sub.add_parser("generate", help="generate a dataset in rounds")
    t.add_argument("output")
    t.add_argument("--config")
    t.add_argument("--samples", type=int)
    t.add_argument("--provider", default="offline")
    t.add_argument("--judge", help="the registered provider that judges what passes the gates")
    t = sub.add_parser("check-weights", help="check the weights of a configuration")
    t.add_argument("config")
    t = sub.add_parser("capture", help="type reviews in, appended to a folder of JSON lines")
    t.add_argument("output")
    t = sub.add_parser("configure", help="answer questions and write a configuration")
    t.add_argument("output")
    t = sub.add_parser("try-provider", help="call a registered provider a few times and time it")
    t.add_argument("name")
    t.add_argument("--runs", type=int, default=3)
    t = sub.add_parser("fetch-model", help="load a model's weights into a folder")
    t.add_argument("name")
    t.add_argument("output")
    for name, text in (("jobs", "the latest batch jobs of a service"), ("models", "the models that a service offers")):
        t = sub.add_parser(name, help=text)
        t.add_argument("url")
        t.add_argument("key_variable")
        t.add_argument("--limit", type=int, default=10)
    a = p.parse_args(argv)

    from glossmill.plans.queries import QUERIES
    from glossmill.sources import batch, io, providers

    if a.command == "list":
        print(*sorted(QUERIES), sep="\n")
        return 0
    if a.command == "check-weights":
        c = io.load_config(a.config)  # raises where they don't sum to 1
        for name, weight in (*c.personas, *c.models):
            print(f"{name}: {weight:.1%}")
        return 0
    if a.command == "configure":
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(io.config_yaml(io.asked_config(input)))
        return 0
    if a.command == "try-provider":
        print(*(f"{k}: {v}" for k, v in providers.timed(providers.by_key(a.name), a.runs).items()), sep="\n")
        return 0
    if a.command == "fetch-model":
        print(providers.fetched(a.name, a.output))
        return 0
    if a.command in ("jobs", "models"):
        service = batch.HttpBatchService(a.url, a.key_variable)
        print(
            *(f"{j['id']}: {j['status']}" for j in batch.list_jobs(service, a.limit)) if a.command == "jobs" else batch.list_models(service),
            sep="\n",
        )
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("glossmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "query":
        df = QUERIES[a.name](spark, a.sf_dir)
        df.write.mode("overwrite").parquet(a.output) if a.output else df.show(20, truncate=80)
    elif a.command == "capture":
        if rows := io.captured(input):
            io.append_reviews(spark.createDataFrame(rows, io.REVIEW), a.output)
    elif a.command == "collect":
        io.append_reviews(io.normalise(io.read_review_csv(spark, a.csv), a.source), a.output)
    elif a.command == "template":
        io.write_template(spark, a.output, a.platform)
    else:
        from dataclasses import replace

        from glossmill.plans import rounds

        c = io.load_config(a.config) if a.config else io.Config()
        c = replace(c, target_samples=a.samples) if a.samples else c
        judge = (lambda: providers.by_key(a.judge)) if a.judge else None
        rounds.fill(spark, c, lambda: providers.by_key(a.provider), primary=judge).write.mode("overwrite").json(a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
