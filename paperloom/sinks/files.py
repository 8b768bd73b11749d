"""Sinks: per-document folders, combined Markdown and JSON, archives."""

from __future__ import annotations

import io
import json
import os
import zipfile

from pyspark.sql import Column, DataFrame, functions as F


def combined(results: DataFrame, batch: str, rule: str = "\n\n---\n\n") -> DataFrame:
    """(batch, markdown): the results of each batch, each under its stem, in the order of doc_id.

    One text per batch is what is asked for; for corpora write the parts instead.
    """
    one = F.concat(F.lit("# "), F.col("stem"), F.lit("\n\n"), F.col("markdown"))
    parts = F.array_sort(F.collect_list(F.struct("doc_id", one.alias("t"))))
    return results.groupBy(batch).agg(F.array_join(F.transform(parts, lambda x: x["t"]), rule).alias("markdown"))


def combined_json(results: DataFrame, batch: str) -> DataFrame:
    """(batch, json): {"batch":true,"files":{stem: structured}} in the order of stems; the last of equal stems, by doc_id, wins.

    ``structured`` is JSON and stands in the result as it is, a null one as null.
    """
    last = results.groupBy(batch, "stem").agg(F.max_by(F.struct("structured"), "doc_id").alias("s"))
    name = F.to_json(F.array("stem"))
    one = F.concat(F.expr("substring(k, 2, length(k) - 2)"), F.lit(":"), F.coalesce("s.structured", F.lit("null")))
    files = F.transform(F.array_sort(F.collect_list(F.struct("stem", one.alias("t")))), lambda x: x["t"])
    return last.withColumn("k", name).groupBy(batch).agg(F.concat(F.lit('{"batch":true,"files":{'), F.array_join(files, ","), F.lit("}}")).alias("json"))


def summary_line(stats: Column) -> Column:
    """The first three numbers of a result's statistics, as one line."""
    names = ("total_sections", "headings", "paragraphs")
    return F.concat_ws(" · ", *[F.concat(F.lit(n.replace("_", " ").title() + ": "), stats[n].cast("string")) for n in names])


def output_path(rel_path: Column, keep_suffix: bool = True) -> Column:
    """Where the result of a file goes.  Without its suffix, a.pdf and a.docx would share a folder."""
    bare = F.regexp_replace(rel_path, r"(?<=[^/])\.[^./]+$", "")
    return F.concat(bare, F.regexp_replace(F.regexp_extract(rel_path, r"(?<=[^/])(\.[^./]+)$", 1), r"^\.", "_")) if keep_suffix else bare


def save(results: DataFrame, folder: str) -> None:
    """For each row (path, markdown, structured as JSON text, images) output.md, output.json and images/ under ``folder``.

    Runs on the executors, so ``folder`` must be a file system they share.  A
    row written twice, after a lost task, gives the same files again.
    """

    def write(rows):
        for r in rows:
            to = os.path.join(folder, r["path"])
            os.makedirs(to, exist_ok=True)
            with open(os.path.join(to, "output.md"), "w", encoding="utf-8") as f:
                f.write(r["markdown"] or "")
            with open(os.path.join(to, "output.json"), "w", encoding="utf-8") as f:
                f.write(_pretty(r["structured"]))
            for image in (r["images"] if "images" in r else None) or []:
                os.makedirs(os.path.join(to, "images"), exist_ok=True)
                with open(os.path.join(to, "images", os.path.basename(image["filename"])), "wb") as f:
                    f.write(image["data"] or b"")

    results.foreachPartition(write)


def _pretty(structured: str | None) -> str:
    return json.dumps(json.loads(structured or "{}"), indent=2, ensure_ascii=False, default=str)


def zip_results(results: DataFrame) -> bytes:
    """An archive of stem/stem.md, stem/stem.json and images, or stem/ERROR.txt, for download.

    Rows come one partition at a time; the archive itself is in the driver's
    memory, so this is for a selection of files, not for a corpus.
    """
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in results.toLocalIterator():
            stem = r["stem"]
            if "error" in r and r["error"]:
                z.writestr(f"{stem}/ERROR.txt", r["error"])
                continue
            z.writestr(f"{stem}/{stem}.md", r["markdown"] or "")
            z.writestr(f"{stem}/{stem}.json", _pretty(r["structured"]))
            for image in (r["images"] if "images" in r else None) or []:
                z.writestr(f"{stem}/images/{image['filename']}", image["data"])
    return out.getvalue()
