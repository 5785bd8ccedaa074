"""Command line: index, search, status, coverage, mdsync, auto, meta, seed, clear, config.

Runs embed through the server that ``SEDGEWORK_EMBED_URL`` names, with
``SEDGEWORK_EMBED_MODEL`` and ``SEDGEWORK_EMBED_DIMENSIONS``; without it they index
for BM25 only, and the first run with it embeds what is missing. Searches ask the same
server for the query's vector and, if ``SEDGEWORK_RERANK_URL`` is set, that one for
scores.
"""

from __future__ import annotations

import argparse
import datetime
import json
import os
import subprocess
from pathlib import Path

from pyspark.sql import SparkSession


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sedgework", description=__doc__)
    p.add_argument("--store", help="folder of the index")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "rebuild"):
        c = sub.add_parser(name)
        c.add_argument("paths", nargs="*")
        c.add_argument("--force", action="store_true")
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("--limit", type=int, default=10)
    c.add_argument("--bm25", action="store_true", help="words only")
    c.add_argument("--rerank", action="store_true")
    c = sub.add_parser("find")
    c.add_argument("pattern")
    for name in ("coverage", "mdsync", "auto", "seed"):
        sub.add_parser(name).add_argument("--dir", default=".")
    c = sub.add_parser("meta")
    c.add_argument("path", nargs="?")
    c.add_argument("tags", nargs="?")
    c = sub.add_parser("exclude")
    c.add_argument("patterns", nargs="*")
    c = sub.add_parser("ext")
    c.add_argument("extensions", nargs="*")
    for name in ("status", "clear", "on", "off", "refresh"):
        sub.add_parser(name)
    return p


def _model() -> str:
    return os.environ.get("SEDGEWORK_EMBED_MODEL", "qwen3-embedding-4b")


def _embedder():
    from sedgework.operators.embedding import http_embedder

    url = os.environ.get("SEDGEWORK_EMBED_URL")
    return http_embedder(url, _model(), int(os.environ.get("SEDGEWORK_EMBED_DIMENSIONS", "1024"))) if url else None


def _scorer():
    from sedgework.operators.embedding import http_scorer

    url = os.environ.get("SEDGEWORK_RERANK_URL")
    return http_scorer(url, os.environ.get("SEDGEWORK_RERANK_MODEL", "qwen3-reranker-0.6b")) if url else None


def _converter(document: str, target: str) -> tuple[bool, str]:
    """``pandoc``, if there is one."""
    try:
        done = subprocess.run(["pandoc", document, "-t", "gfm", "-o", target], capture_output=True, text=True, timeout=600)
        return done.returncode == 0, done.stderr
    except OSError as e:
        return False, str(e)


def main(argv: list[str] | None = None) -> int:
    from sedgework.operators import completion, indexing, metadata, tools
    from sedgework.operators.store import IndexStore
    from sedgework.sources.config import Config, index_directory
    from sedgework.sources.files import collect_files, resolve_extensions

    args = _parser().parse_args(argv)
    home = index_directory(args.store)
    config = Config.load(home / "config.json")
    spark = SparkSession.builder.appName("sedgework").getOrCreate()
    store = IndexStore(spark, str(home / "index"))
    now = datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")

    def show(rows) -> int:
        out = [r.asDict(recursive=True) for r in rows.collect()] if hasattr(rows, "collect") else rows
        print(json.dumps(out, ensure_ascii=False, indent=None if args.json else 2, default=str))
        return 0

    def listing():
        extensions = resolve_extensions(config.extra_extensions, config.exclude_extensions)
        return collect_files(spark, config.tracked_paths, extensions, config.exclude_patterns)

    if args.command in ("index", "rebuild", "refresh"):
        for path in map(str, map(Path.resolve, map(Path, getattr(args, "paths", [])))):
            if path not in config.tracked_paths:
                config.tracked_paths.append(path)
        config.save(home / "config.json")
        run = indexing.rebuild if args.command == "rebuild" else indexing.index_files
        return show(vars(run(store, listing(), _embedder(), now, force=getattr(args, "force", False), model=_model())))
    if args.command == "search":
        embedder = None if args.bm25 else _embedder()
        return show(tools.query(store, args.query, config, args.limit, embedder, _scorer() if args.rerank else None, now))
    if args.command == "find":
        return show(tools.find(store.table("files"), args.pattern, os.getcwd()))
    if args.command == "status":
        return show(indexing.stats(store))
    if args.command == "coverage":
        return show(completion.coverage(spark, store, str(Path(args.dir).resolve()), config.exclude_patterns))
    if args.command == "mdsync":
        return show(completion.conversion_state(spark, str(Path(args.dir).resolve()), config.exclude_patterns))
    if args.command == "auto":
        root = str(Path(args.dir).resolve())
        outcomes, summary, before, after = completion.complete(spark, store, root, now, _converter, embedder=_embedder())
        return show({"outcomes": [vars(o) for o in outcomes], "run": vars(summary), "before": before, "after": after})
    if args.command == "seed":
        root = str(Path(args.dir).resolve())
        return show(metadata.apply_seed(store, f"{root}/{metadata.SEED_NAME}", root))
    if args.command == "meta":
        if args.path:
            row = [(str(Path(args.path).resolve()), args.tags or None)]
            store.set_metadata(spark.createDataFrame(row, "path string, metadata string"))
        return show(store.table("files").where("coalesce(metadata, '') <> ''").select("path", "metadata"))
    if args.command == "clear":
        store.clear()
    elif args.command == "exclude":
        config.exclude_patterns = [*dict.fromkeys([*config.exclude_patterns, *args.patterns])]
    elif args.command == "ext":
        config.extra_extensions = [*dict.fromkeys([*config.extra_extensions, *args.extensions])]
    else:
        config.enabled = args.command == "on"
    config.save(home / "config.json")
    return show(vars(config))


if __name__ == "__main__":
    raise SystemExit(main())
