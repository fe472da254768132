"""Command line over a store: python -m millrace.cli STORE KEYFILE COMMAND ..."""

import argparse
import json

from pyspark.sql import SparkSession

from .engine import Engine
from .operators.policy import Principal
from .sources import files


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("store")
    p.add_argument("keyfile")
    p.add_argument("--id", default="cli")
    p.add_argument("--tenant", default="tenant:default")
    p.add_argument("--roles", default="")
    p.add_argument("--clearance", default="internal")
    sub = p.add_subparsers(dest="command", required=True)
    for name, *arguments in (("import-markdown", "root"), ("remember", "path"), ("import-links",), ("recall", "cue"), ("explain", "cue"), ("forget", "subject"), ("purge", "record"), ("transition", "record", "state"), ("approve", "record"), ("verify-audit",), ("health",)):
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    with open(a.keyfile, "rb") as f:
        engine = Engine(spark, a.store, f.read())
    who = Principal(a.id, a.tenant, tuple(x for x in a.roles.split(",") if x), {}, a.clearance)
    if a.command == "recall":
        out = [r.asDict() for r in engine.recall(a.cue, who).orderBy("rank").collect()]
    elif a.command == "explain":
        out = engine.explain(a.cue, who)
    elif a.command == "remember":
        out = engine.remember_many(files.read_json_records(spark, a.path).where("error IS NULL"), who)
    elif a.command == "import-markdown":
        out = engine.import_markdown(a.root, who)
    elif a.command == "import-links":
        out = engine.import_links(who)
    elif a.command == "transition":
        out = {"changed": engine.transition(a.record, a.state, who)}
    elif a.command == "approve":
        out = {"changed": engine.approve(a.record, who)}
    elif a.command == "purge":
        out = {"purged": engine.purge(a.record, who)}
    elif a.command == "forget":
        out = engine.forget(a.subject, who)
    else:
        out = engine.verify_audit() if a.command == "verify-audit" else engine.health()
    print(json.dumps(out, indent=2, default=str))
    return int(a.command == "verify-audit" and not out["ok"])


if __name__ == "__main__":
    raise SystemExit(main())
