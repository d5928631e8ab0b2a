"""Command line: one command per stage; typed failures become exit codes."""

from __future__ import annotations

import argparse
import sys

from broadsheet.config import credential, load
from broadsheet.errors import EngineError


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="broadsheet")
    p.add_argument("--warehouse", default="warehouse")
    p.add_argument("--config", default="config.json")
    p.add_argument("--env-file")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("init-db")
    probe = commands.add_parser("probe", help="what a search client answers for a topic's first windows; stores nothing")
    probe.add_argument("--topic", required=True)
    probe.add_argument("--client", default="broadsheet.sources.pages:FolderClient")
    probe.add_argument("--argument", default="")
    probe.add_argument("--windows", type=int, default=1)
    for name in ("estimate", "search", "dedup", "fetch", "extract", "extract-prompt", "export", "review-search", "review-dedup", "review-fetch", "reset-analysis"):
        c = commands.add_parser(name)
        c.add_argument("--topic", required=True)
        if name in ("estimate", "search"):
            c.add_argument("--client", default="broadsheet.sources.pages:FolderClient")
            c.add_argument("--argument", default="")
        if name in ("search", "fetch", "extract"):
            c.add_argument("--dry-run", action="store_true")
        if name in ("search", "fetch", "extract"):
            c.add_argument("--limit", type=int)
        if name == "fetch":
            c.add_argument("--raw-html", help="Parquet with story_id, html, http_status, content_type")
            c.add_argument("--live", action="store_true", help="read the pages that are missing from the network")
            c.add_argument("--lanes", type=int, default=1)
        if name == "extract":
            c.add_argument("--base-url-env", default="MODEL_BASE_URL")
            c.add_argument("--key-env", default="MODEL_API_KEY")
        if name == "extract-prompt":
            c.add_argument("--phase", choices=("screening", "extraction"), default="screening")
            c.add_argument("--batch", type=int, default=0)
        if name.startswith("review") or name in ("export", "extract-prompt"):
            c.add_argument("--output", required=True)
        if name == "review-fetch":
            c.add_argument("--limit", type=int, default=100)
    return p


def run(args: argparse.Namespace, spark) -> str:
    from broadsheet.plans import stages
    from broadsheet.sources import pages, web
    from broadsheet.sources.store import Warehouse

    store = Warehouse(spark, args.warehouse, must_exist=args.command.startswith(("review", "export", "extract-prompt")))
    if args.command == "init-db":
        return f"tables: {', '.join(sorted(store.initialise()['tables']))}"
    config = load(args.config)
    topic = args.topic
    if args.command == "probe":
        return "\n".join(stages.probe(store, config, topic, pages.client_from({"client": args.client, "argument": args.argument}), args.windows))
    if args.command == "estimate":
        return str(stages.estimate(store, config, topic, {"client": args.client, "argument": args.argument}))
    if args.command == "search":
        return str(stages.search(store, config, topic, pages.client_from({"client": args.client, "argument": args.argument}), args.limit, args.dry_run))
    if args.command == "dedup":
        return str(stages.dedup(store, config, topic))
    if args.command == "fetch":
        return str(stages.fetch(store, config, topic, spark.read.parquet(args.raw_html) if args.raw_html else None, args.limit, args.dry_run, web.over_http if args.live else None, args.lanes))
    if args.command == "extract" and args.dry_run:
        return "\n".join(str(stages.plan_summary(store, config, topic, phase, args.limit)) for phase in ("screening", "extraction"))
    if args.command == "extract":
        from broadsheet.clients import ChatClient
        from broadsheet.operators.batches import response_schema

        base, key = credential(args.base_url_env, args.env_file), credential(args.key_env, args.env_file)
        answers = []
        for phase in ("screening", "extraction"):
            client = ChatClient(base, key, config.model.model, response_schema(config.topic(topic).fields, phase), stages.system_prompt(phase))
            answers.append(str(stages.answer_phase(store, config, topic, phase, client, args.limit)))
        return "\n".join(answers)
    if args.command == "extract-prompt":
        from pathlib import Path

        Path(args.output).write_text(stages.manual_request(store, config, topic, args.phase, args.batch), encoding="utf-8")
        return args.output
    if args.command == "export":
        return str(stages.export(store, config, topic, args.output))
    if args.command == "reset-analysis":
        stages.reset(store, topic)
        return f"{topic}: answers and cases removed"
    kind = args.command.removeprefix("review-")
    return f"{stages.review_csv(store, topic, kind, args.output, getattr(args, 'limit', 100))} rows"


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _parser().parse_args(argv)
    try:
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("broadsheet").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        print(run(args, spark))
        return 0
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code


if __name__ == "__main__":
    sys.exit(main())
