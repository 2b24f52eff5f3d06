"""The cleaning pipeline over files as rows, with an audit row for each instead of deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import frontmatter as fm
from corpusloom.functions.text import dedupe_lines, is_markdown, reject_reason, remove_boilerplate, standardize_headings, wiki_rename


def clean_documents(files: DataFrame, name: str = "name", size: str = "size", content: str = "content", repair: bool = False, boilerplate: bool = True, duplicates: bool = True, headings: bool = True) -> DataFrame:
    """``files`` with removed, reason, skipped, new_name, cleaned, modified and changes.

    Rejected files and those that aren't Markdown keep their content; nothing
    is deleted. ``repair`` moves misplaced frontmatter delimiters first (an
    Arrow UDF, so it is asked for).
    """
    names = [c for c in files.columns if c not in ("removed", "reason", "skipped", "new_name", "cleaned", "modified", "changes")]
    text = F.coalesce(F.col(content), F.lit(""))
    reason = reject_reason(F.col(name), F.col(size))
    staged = files.select(*names).withColumn("reason", reason).withColumn("skipped", F.when(F.col("reason").isNull() & ~is_markdown(F.col(name)), "Not a markdown file"))
    staged = staged.withColumn("_todo", F.col("reason").isNull() & F.col("skipped").isNull())
    source = F.when(F.startswith(text, F.lit("---")), fm.fix_yaml_delimiters(text)).otherwise(text) if repair else text
    staged = staged.withColumn("_x", fm.parse(source)).withColumn("_body", F.col("_x.body"))
    plain = remove_boilerplate(F.col("_body")) if boilerplate else F.col("_body")
    staged = staged.withColumn("_plain", plain)
    staged = dedupe_lines(staged, "_plain", "_once") if duplicates else staged.withColumn("_once", F.col("_plain"))
    # Line ends are put in order by that step; what counts as a change is a line less.
    staged = staged.withColumn("_heads", standardize_headings(F.col("_once")) if headings else F.col("_once"))
    cleaned = F.when(F.col("_todo"), fm.document(F.col("_x.entries"), F.when(F.size("_x.entries") > 0, F.concat(F.lit("\n"), F.regexp_replace("_heads", r"\A\n", ""))).otherwise(F.col("_heads"))))
    staged = staged.withColumn("cleaned", F.coalesce(cleaned, F.col(content))).withColumn("new_name", F.when(F.col("_todo"), wiki_rename(F.col(name))).otherwise(F.col(name)))

    def change(when: Column, label: str) -> Column:
        return F.when(F.col("_todo") & when, label)

    changes = F.array(
        change(F.col("_plain") != F.col("_body"), "removed_boilerplate"), change(F.rtrim(F.col("_once"), F.lit("\n")) != F.rtrim(F.col("_plain"), F.lit("\n")), "removed_duplicates"),
        change(F.col("_heads") != F.col("_once"), "standardized_headings"), change(F.col("new_name") != F.col(name), "renamed_wiki"),
    )
    return staged.select(
        *names, F.col("reason").isNotNull().alias("removed"), "reason", "skipped", "new_name", "cleaned",
        (F.col("_todo") & (F.col("cleaned") != text)).alias("modified"), F.filter(changes, lambda c: c.isNotNull()).alias("changes"),
    )


def clean_stats(audit: DataFrame) -> DataFrame:
    """One row: total_files, removed, modified, renamed, skipped."""
    count = lambda c: F.count_if(c).cast("long")
    return audit.agg(
        F.count("*").alias("total_files"), count(F.col("removed")).alias("removed"), count(F.col("modified") & ~F.col("removed")).alias("modified"),
        count(F.array_contains("changes", "renamed_wiki")).alias("renamed"), count(F.col("skipped").isNotNull()).alias("skipped"),
    )


def update_frontmatter(files: DataFrame, content: str = "content", source: str = "source", extra: dict[str, Column] | None = None) -> DataFrame:
    """``files`` with ``updated`` (the document with canonical frontmatter), ``updated_fields`` and ``modified``."""
    names = [c for c in files.columns if c not in ("updated", "updated_fields", "modified")]
    staged = files.select(*names).withColumn("_x", fm.parse(F.coalesce(F.col(content), F.lit("")))).withColumn("_new", fm.canonical(F.col("_x.entries"), F.col(source), extra))
    body = F.when(F.startswith(F.col("_x.body"), F.lit("\n")), F.col("_x.body")).otherwise(F.concat(F.lit("\n"), F.col("_x.body")))
    staged = staged.withColumn("updated", fm.document(F.col("_new"), body))
    return staged.select(*names, "updated", fm.changed_keys(F.col("_x.entries"), F.col("_new")).alias("updated_fields"), (F.col("updated") != F.coalesce(F.col(content), F.lit(""))).alias("modified"))


def process(files: DataFrame, **options) -> DataFrame:
    """Clean, leave out what is rejected or skipped, and put the frontmatter in order."""
    kept = clean_documents(files, **options).where("NOT removed AND skipped IS NULL")
    return update_frontmatter(kept.withColumn("content", F.col("cleaned")).drop("modified"))
