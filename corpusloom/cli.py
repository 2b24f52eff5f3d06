"""Command line, for ``spark-submit``: clean, frontmatter, tables, chunk, ingest, retry, crawl."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusloom.functions.repair import fix_tables
from corpusloom.operators.chunk import OVERLAP, SIZE, Strategy, chunk_documents
from corpusloom.operators.chunk_store import Settings, chunk_incremental
from corpusloom.operators.clean import clean_documents, clean_stats, process, update_frontmatter
from corpusloom.session import session
from corpusloom.sources.files import read_markdown, read_sites
from corpusloom.streaming.ingest import retry_dead_letters, stream_directory


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom")
    sub = top.add_subparsers(dest="command", required=True)
    clean = sub.add_parser("clean", help="clean Markdown files into a table, and print what was done")
    clean.add_argument("folder")
    clean.add_argument("out")
    clean.add_argument("--flat", action="store_true", help="do not go into subfolders")
    for name in ("boilerplate", "duplicates", "headings"):
        clean.add_argument(f"--keep-{name}", action="store_true")
    chunk = sub.add_parser("chunk", help="chunk Markdown files into a table")
    chunk.add_argument("folder")
    chunk.add_argument("out")
    chunk.add_argument("--strategy", choices=[s.value for s in Strategy], default=Strategy.SIZE.value)
    chunk.add_argument("--size", type=int, default=SIZE)
    chunk.add_argument("--overlap", type=int, default=OVERLAP)
    chunk.add_argument("--no-keywords", action="store_true", help="without keywords of the chunks")
    chunk.add_argument("--store", action="store_true", help="``out`` is a store: only new and changed files are chunked")
    chunk.add_argument("--force", action="store_true", help="with --store: chunk all files anew")
    chunk.add_argument("--drop-deleted", action="store_true", help="with --store: forget files that are gone")
    front = sub.add_parser("frontmatter", help="put the frontmatter of Markdown files in order, into a table")
    front.add_argument("folder")
    front.add_argument("out")
    front.add_argument("--source", help="the source of all files instead of their folders")
    front.add_argument("--add", action="append", default=[], metavar="KEY=VALUE", help="a further entry of all files")
    tables = sub.add_parser("tables", help="mend broken tables of Markdown files made from PDF, into a table")
    tables.add_argument("folder")
    tables.add_argument("out")
    tables.add_argument("--columns", help="names of the columns by commas")
    ingest = sub.add_parser("ingest", help="take new files of a folder into a collection")
    ingest.add_argument("folder")
    ingest.add_argument("root")
    ingest.add_argument("--strategy", choices=[s.value for s in Strategy], default=Strategy.SIZE.value)
    retry = sub.add_parser("retry", help="embed again what failed")
    retry.add_argument("root")
    retry.add_argument("batch", type=int)
    crawl = sub.add_parser("crawl", help="crawl the sites of a configuration")
    crawl.add_argument("config")
    crawl.add_argument("robots", help="a table of robots_url and body")
    crawl.add_argument("root")
    crawl.add_argument("--day", required=True, help="the access date written into pages")
    crawl.add_argument("--max-depth", type=int)
    return top


def written(rows: DataFrame, out: str, counts: dict) -> dict[str, int]:
    """Write ``rows`` and return ``counts`` of them, taken while they are written."""
    seen = Observation()
    rows.observe(seen, *[c.alias(n) for n, c in counts.items()]).write.mode("overwrite").parquet(out)
    return {n: int(v or 0) for n, v in seen.get.items()}


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = session()
    if args.command == "clean":
        files = read_markdown(spark, args.folder, recursive=not args.flat).withColumn("source", F.element_at(F.split("path", "/"), -2))
        options = {n: not getattr(args, f"keep_{n}") for n in ("boilerplate", "duplicates", "headings")} | {"repair": True}
        process(files, **options).write.mode("overwrite").parquet(args.out)
        clean_stats(clean_documents(files, **options)).show(truncate=False)
    elif args.command == "chunk":
        files = read_markdown(spark, args.folder)
        if args.store:
            settings = Settings(args.strategy, args.size, args.overlap, not args.no_keywords)
            print(chunk_incremental(files.withColumn("mtime", F.col("mtime").cast("double")), args.out, settings, args.force, args.drop_deleted))
        else:
            rows = chunk_documents(files, "path", "content", args.strategy, args.size, args.overlap, not args.no_keywords, errors=True)
            print(written(rows, args.out, {"chunks": F.count_if(F.col("error").isNull()), "failed": F.count_if(F.col("error").isNotNull())}))
    elif args.command == "frontmatter":
        files = read_markdown(spark, args.folder).withColumn("source", F.lit(args.source) if args.source else F.element_at(F.split("path", "/"), -2))
        extra = {k: F.lit(v) for k, v in (x.split("=", 1) for x in args.add)}
        print(written(update_frontmatter(files, extra=extra or None), args.out, {"files": F.count(F.lit(1)), "modified": F.count_if("modified")}))
    elif args.command == "tables":
        mended = fix_tables(args.columns.split(",") if args.columns else None)
        rows = read_markdown(spark, args.folder).withColumn("mended", mended("content"))
        print(written(rows, args.out, {"files": F.count(F.lit(1)), "modified": F.count_if(F.col("mended") != F.col("content"))}))
    elif args.command == "ingest":
        stream_directory(spark, args.folder, args.root, args.strategy, told=print).awaitTermination()
    elif args.command == "retry":
        print(retry_dead_letters(spark, args.root, args.batch))
    else:
        from corpusloom.operators.site import crawl_sites

        crawl_sites(read_sites(spark, args.config), spark.read.parquet(args.robots), args.root, args.day, args.max_depth).groupBy("source").count().show()


if __name__ == "__main__":
    main()
