"""``python -m letterloom.cli ingest|generate|inspect|web``; what has no option comes from the environment, see :class:`Settings`."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.generate import ChatClient
from .plans.http import serve
from .plans.service import Service, Settings
from .sources.pdf import available


def facts_of(pairs: list[str]) -> dict[str, str]:
    """``key=value`` each; the first ``=`` splits, a later key wins, others are reported and left out."""
    out = {}
    for p in pairs:
        key, eq, value = p.partition("=")
        if eq and key.strip():
            out[key.strip()] = value.strip()
        else:
            print(f"ignored: {p!r} is not key=value", file=sys.stderr)
    return out


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="letterloom")
    top.add_argument("--data")
    top.add_argument("--store")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("ingest")
    g = commands.add_parser("generate")
    g.add_argument("request")
    g.add_argument("--department")
    g.add_argument("--letter-type")
    g.add_argument("--fact", action="append", default=[])
    g.add_argument("--top-k", type=int)
    g.add_argument("--host")
    g.add_argument("--docx")
    i = commands.add_parser("inspect")
    i.add_argument("--id")
    i.add_argument("--all", action="store_true")
    w = commands.add_parser("web")
    w.add_argument("--address", default="127.0.0.1")
    w.add_argument("--port", type=int, default=8000)
    args = top.parse_args(argv)
    given = {"data_dir": args.data, "store_dir": args.store, "host": getattr(args, "host", None)}
    settings = replace(Settings.from_env(), **{k: v for k, v in given.items() if v is not None})
    spark = SparkSession.builder.getOrCreate()
    pdf, ocr = available()
    service = Service(spark, settings, chat=ChatClient(settings.host) if args.command in ("generate", "web") else None, pdf=pdf, ocr=ocr)
    if args.command == "web":
        server = serve(service, args.address, args.port)
        print(f"http://{args.address}:{server.server_port}/")
        server.serve_forever()
    elif args.command == "ingest":
        found = service.reindex()
        print(f"{found['letters_found']} letters, {found['letters_indexed']} indexed, {found['needs_review']} to review, {found['files_skipped']} files skipped (PDF without a reader)")
        review = service.store.rows().where("needs_review").orderBy("ord")
        for r in review.select("letter_id", "source_file").limit(20).collect():  # a report of the first 20
            print(f"  {r.letter_id}  {r.source_file}")
        if found["needs_review"] > 20:
            print(f"  … and {found['needs_review'] - 20} more")
    elif args.command == "generate":
        done = service.generate(args.request, args.department, args.letter_type, facts_of(args.fact), args.top_k)
        print(done["draft"])
        if args.docx:
            print(service.export_docx(done["draft"], args.docx))
    else:
        letters = service.letters_from_source()
        letters = letters.where(F.col("letter_id") == args.id) if args.id else letters if args.all else letters.where("segment_index = 0")
        for r in letters.drop("text").toLocalIterator():
            print(r.asDict())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
