"""python -m evidex ingest STORE PROJECT ROOT | query STORE TEXT... | fresh STORE ROOT | stats STORE | explain-project STORE PROJECT
| validate STORE CLAIM VALIDATOR RESULT | propose STORE PROJECT BY TEXT...
| doctor STORE [integrity] | space STORE | compact STORE [confirmed] | migrate STORE | rebuild-index STORE

One line of JSON a failure and exit code 2; doctor ends with 1 if the store is not fit to use."""

from __future__ import annotations

import json
import sys
from datetime import datetime, timezone


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import identity, ingest, ledger, maintenance
    from .sources.tree import read_tree
    from .sources.store import Store
    from .streaming.watch import listing

    upkeep = {
        "space": lambda store: [r.asDict() for r in maintenance.space(store).orderBy("folder").collect()],
        "compact": lambda store: maintenance.vacuum(store, args[2:] == ["confirmed"]),
        "migrate": lambda store: {"formats": maintenance.migrate(store)},
        "rebuild-index": lambda store: {"version": ingest.merge_segments(store)},
    }
    if len(args) < 2 or args[0] not in ("ingest", "query", "fresh", "stats", "explain-project", "doctor", "validate", "propose", *upkeep):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("evidex").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    store = Store(spark, args[1])
    show = lambda x: print(json.dumps(x, indent=2, sort_keys=True))
    try:
        if args[0] == "ingest":
            project, root = args[2:4]
            if why := identity.refuse_root(root):
                raise ValueError(f"not a project folder: {why}")
            files = read_tree(spark, root).withColumnRenamed("relative_path", "path").withColumn("mtime", F.unix_micros("modified"))
            show(ingest.ingest(store, project, files.select("path", "text", "content_hash", "size", "mtime")))
        elif args[0] == "query":
            requests = spark.createDataFrame([(1, " ".join(args[2:]))], "request_id long, text string")
            scope = maintenance.projects(store).select(F.lit(1).cast("long").alias("request_id"), "project_id", F.lit(0).alias("priority"))
            show([json.loads(r[0]) for r in ingest.packets(store, requests, scope).select(F.to_json(F.struct("*"))).collect()])
        elif args[0] == "validate":
            show({"version": maintenance.validate(store, *args[2:5], datetime.now(timezone.utc).isoformat())})
        elif args[0] == "propose":
            show({"version": maintenance.propose(store, args[2], " ".join(args[4:]), args[3])})
        elif args[0] == "fresh":
            states = ledger.changes(listing(spark, args[2]), ingest.heads(store))
            show({r["state"]: r["count"] for r in states.groupBy("state").count().collect()} | {"advice": ledger.use_decision(states, True)})
        elif args[0] == "explain-project":
            print(maintenance.page(store, args[2]))
        elif args[0] == "doctor":
            report = maintenance.doctor(store, args[2:] == ["integrity"])
            show(report)
            return 0 if report["ready"] else 1
        elif args[0] in upkeep:
            show(upkeep[args[0]](store))
        else:
            state = store.manifest()
            show({"version": state["version"], "rows": {n: store.read(n).count() for n in state["tables"]}})
    except Exception as error:  # the command's own contract: any failure is one line of JSON
        print(json.dumps({"error": str(error)[:2000]}), file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
