"""python -m paperloom.cli convert|batch|formats: a thin main over the pipeline."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession, functions as F

from paperloom.config import Config
from paperloom.functions import rules
from paperloom.plans.pipeline import convert_files
from paperloom.sinks.files import output_path, save, summary_line
from paperloom.sources.scan import scan


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="paperloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("convert", "batch"):
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("-o", "--output", default="output")
        c.add_argument("--recursive", action="store_true")
        c.add_argument("--tables", action="store_true")
        c.add_argument("--no-images", action="store_true")
        c.add_argument("--keep-artifacts", action="store_true")
        c.add_argument("--llm", metavar="PROVIDER")
        c.add_argument("--model")
        c.add_argument("--host")
        c.add_argument("--api-key")
    sub.add_parser("formats")
    a = p.parse_args(argv)
    if a.command == "formats":
        print("\n".join(f"{e}\t{k}" for e, k in sorted(rules.EXTENSIONS.items())))
        return 0
    spark = SparkSession.builder.appName("paperloom").getOrCreate()
    config = Config(extract_tables=a.tables, extract_images=not a.no_images, remove_artifacts=not a.keep_artifacts, use_llm=bool(a.llm), llm_provider=a.llm or "ollama", llm_model=a.model, llm_host=a.host, llm_api_key=a.api_key)
    folder, name = (a.input, None) if a.command == "batch" else (os.path.dirname(os.path.abspath(a.input)), os.path.basename(a.input))
    done = convert_files(scan(spark, folder, a.recursive, name), config).persist()
    save(done.where("status = 'ok'").select(output_path(F.col("doc_id")).alias("path"), "markdown", "structured", "images"), a.output)
    by = {r["status"]: r for r in done.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.length("markdown")).alias("chars")).collect()}
    counts = F.from_json(F.get_json_object("structured", "$.stats"), "total_sections int, headings int, paragraphs int")
    for r in done.where("status = 'ok'").select("doc_id", summary_line(counts).alias("line")).orderBy("doc_id").toLocalIterator():
        print(f"{r['doc_id']}: {r['line']}")
    for r in done.where("status = 'failed'").select("doc_id", "error").orderBy("doc_id").toLocalIterator():
        print(f"{r['doc_id']}: {r['error']}")
    ok, failed = (by[s]["n"] if s in by else 0 for s in ("ok", "failed"))
    print(f"{ok} converted, {failed} failed, {by['ok']['chars'] if ok else 0} characters of Markdown")
    return 0 if not failed else 1


if __name__ == "__main__":
    raise SystemExit(main())
