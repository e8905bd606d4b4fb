"""``python -m kgivm STORE COMMAND ...``: thin commands over the engine."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from kgivm.engine import Engine
from kgivm.operators import ontology
from kgivm.sources.corpus import read_edits


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kgivm", description=__doc__)
    parser.add_argument("store")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("init", "reset", "counts", "embed", "check", "index"):
        sub.add_parser(name)
    p = sub.add_parser("ingest")
    p.add_argument("path")
    p.add_argument("--relations")
    p.add_argument("--limit", type=int)
    p = sub.add_parser("edit")
    p.add_argument("path")
    p.add_argument("--mode", default="immediate")
    p = sub.add_parser("instruct")
    p.add_argument("doc_id")
    p.add_argument("instruction")
    p.add_argument("--selector", default="evidence")
    p.add_argument("--mode", default="immediate")
    p.add_argument("--dry-run", action="store_true")
    p = sub.add_parser("tick")
    p.add_argument("--only")
    for name in ("graph", "metrics", "deltas", "decisions"):
        p = sub.add_parser(name)
        p.add_argument("--step", type=int)
        p.add_argument("--fresh-only", action="store_true")
    p = sub.add_parser("search")
    p.add_argument("query")
    p.add_argument("--doc-id")
    p.add_argument("--limit", type=int, default=5)
    p.add_argument("--threshold", type=float)
    p = sub.add_parser("match")
    p.add_argument("label")
    p.add_argument("--threshold", type=float, default=ontology.THRESHOLD)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("kgivm").getOrCreate()
    e = Engine(spark, a.store)

    def show(*frames):
        for f in frames:
            for line in f.toJSON().toLocalIterator():
                print(json.dumps(json.loads(line), ensure_ascii=False))

    if a.command == "reset":
        e.reset()
    elif a.command == "counts":
        show(e.counts())
    elif a.command == "embed":
        show(e.embed())
    elif a.command == "index":
        print(e.index())
    elif a.command == "check":
        show(*e.check())
    elif a.command == "ingest":
        print(e.ingest(a.path, a.relations, a.limit))
    elif a.command == "edit":
        r = e.apply(read_edits(spark, a.path), a.mode)
        show(r.edits, r.decisions)
    elif a.command == "instruct":
        rows = spark.createDataFrame([(0, a.doc_id, a.instruction)], "instruction_id long, doc_id string, instruction string")
        r = e.instruct(rows, a.mode, a.dry_run, selector=a.selector)
        show(*([r] if a.dry_run else [r.edits, r.decisions]))
    elif a.command == "tick":
        show(e.refresh(only=a.only).refreshed)
    elif a.command == "graph":
        show(*e.graph(a.fresh_only))
    elif a.command in ("metrics", "deltas", "decisions"):
        show(getattr(e, a.command)(a.step))
    elif a.command == "search":
        rows = spark.createDataFrame([(0, a.query)], "query_id long, query string")
        show(e.search(rows, doc_id=a.doc_id, limit=a.limit, threshold=a.threshold))
    elif a.command == "match":
        rows = spark.createDataFrame([(a.label,)], "source string")
        show(ontology.match(rows, ontology.labels(e.state), a.threshold))


if __name__ == "__main__":
    main()
