"""Command line: init, ingest, status, query find|term|get|related, validate, serve."""

from __future__ import annotations

import argparse
import json
import sys

from .facade import KnowledgeGraph, edge_object
from .ingest import coerce_options, run_ingest
from .serve import http_server, serve_lines
from .session import build_session
from .store import GraphStore
from .validate import validate_rules_file


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillgraph")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, group=commands, **options):
        p = group.add_parser(name)
        p.add_argument("--db", required=True, help="folder of the graph store")
        return p

    command("init")
    command("status")
    p = command("ingest")
    p.add_argument("--plugin", required=True)
    p.add_argument("--opt", nargs="*", action="extend", default=[], metavar="key=value")
    p = command("serve")
    p.add_argument("--http", type=int, metavar="PORT", help="over HTTP; else over standard streams")
    p.add_argument("--allow-writes", action="store_true")
    p = command("validate")
    p.add_argument("--file", required=True)
    p.add_argument("--auto-register", action="store_true")
    queries = commands.add_parser("query").add_subparsers(dest="query", required=True)
    p = command("find", queries)
    p.add_argument("text", nargs="+")
    p.add_argument("--type")
    p.add_argument("--limit", default="20")
    p = command("term", queries)
    p.add_argument("term")
    p.add_argument("--type")
    for name in ("get", "related"):
        command(name, queries).add_argument("id")
    return top


def _whole(text: str):
    """A limit as given: what is no whole number stays text and is refused by the search."""
    try:
        return int(text)
    except ValueError:
        return text


def _ask(ref: str) -> bool:
    """Whether a missing object is new: s, si, sí or y accept."""
    return input(f"{ref} is not in the graph. Is it new? (s/n): ").strip().lower() in ("s", "si", "sí", "y")


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _parser().parse_args(argv)
    store = GraphStore(spark or build_session(), args.db)
    kg = KnowledgeGraph(store)
    show = lambda x: print(json.dumps(x, indent=2, ensure_ascii=False, default=str))
    if args.command == "init":
        print(f"[quillgraph] initialized {args.db} - {len(store.migrate())} migration(s) applied.")
    elif args.command == "ingest":
        show(run_ingest(store, args.plugin, coerce_options(args.opt), log=lambda x: print(x, file=sys.stderr)).as_dict())
    elif args.command == "status":
        show(kg.status())
    elif args.command == "serve":
        store.migrate()
        kg = KnowledgeGraph(store, args.allow_writes)
        if args.http is None:
            serve_lines(kg, sys.stdin, sys.stdout)
        else:
            with http_server(kg, args.http) as server:
                print(f"[quillgraph] http://127.0.0.1:{server.server_port}/mcp", file=sys.stderr, flush=True)
                server.serve_forever()
    elif args.command == "validate":
        result = validate_rules_file(store, args.file, args.auto_register, decide=_ask)
        for label, lines in (("warning", result.warnings), ("error", result.errors)):
            for line in lines:
                print(f"{label}: {line}", file=sys.stderr)
        print(json.dumps(result.stats), file=sys.stderr)
        return 0 if result.valid else 1
    elif args.query == "find":
        hits = [r.asDict() for r in kg.find(" ".join(args.text), args.type, _whole(args.limit)).collect()]
        show({"count": len(hits), "hits": hits})
    elif args.query == "term":
        hits = [r.asDict() for r in kg.by_term(args.term, args.type).drop("updated_at").collect()]
        show({"term": args.term, "count": len(hits), "hits": hits})
    elif args.query == "get":
        show(kg.kb_get(args.id))
    else:
        rows = [r.asDict() for r in kg.related(args.id).collect()]
        show({"id": args.id} | {d: [edge_object(r) for r in rows if r["direction"] == d] for d in ("outgoing", "incoming")})
    return 0


if __name__ == "__main__":
    sys.exit(main())
