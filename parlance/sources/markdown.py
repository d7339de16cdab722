"""Markdown corpora: scanning folders, metadata, typed blocks, sections and entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import columns as C

#: The value of ``app:`` that marks a corpus file; any other file is left alone.
OWNER_MARKER = "call-transcriber"


def scan_corpus(spark: SparkSession, paths: list[str], glob: str = "*.md") -> DataFrame:
    """path, name, mtime, content of all files of the given folders, hidden ones left out; folders are not walked into."""
    rows = spark.read.option("pathGlobFilter", glob).text(paths, wholetext=True)
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    rows = rows.select(F.col("_metadata.file_path").alias("path"), name.alias("name"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("content"))
    return rows.where(~F.col("name").startswith("."))


def front(content: Column) -> Column:
    """The block between ``---`` at the very start and ``---`` or ``...``; null without one."""
    return F.nullif(F.regexp_extract(content, r"(?s)\A[ \t]*---[ \t]*\n(.*?\n)?[ \t]*(?:---|\.\.\.)[ \t]*(?:\n|\z)", 1), F.lit(""))


def body(content: Column) -> Column:
    """The text after the metadata, or the whole text where there is none."""
    return F.regexp_replace(content, r"(?s)\A[ \t]*---[ \t]*\n(.*?\n)?[ \t]*(?:---|\.\.\.)[ \t]*(?:\n|\z)", "")


def field(meta: Column, key: str) -> Column:
    """A scalar of the metadata, "" if absent; single quotes are decoded, double quotes and spaces around it taken off."""
    raw = F.trim(F.regexp_extract(F.coalesce(meta, F.lit("")), rf"(?m)^[ \t]*{key}:(.*)$", 1))
    quoted = raw.rlike(r"^'(?:[^']|'')*'$") & (F.length(raw) >= 2)
    return F.when(quoted, F.replace(F.regexp_replace(raw, "^'|'$", ""), F.lit("''"), F.lit("'"))).otherwise(F.regexp_replace(raw, r'^[ "]+|[ "]+$', ""))


def listing(meta: Column, key: str) -> Column:
    """A flow list ``[a, "b"]`` of the metadata as an array; empty if absent."""
    raw = F.regexp_extract(F.coalesce(meta, F.lit("")), rf"(?m)^[ \t]*{key}:[ \t]*\[(.*)\][ \t]*$", 1)
    items = F.regexp_extract_all(raw, F.lit(r"""\s*"[^"]*"|\s*'(?:[^']|'')*'|[^,]+"""), F.lit(0))
    return F.filter(F.transform(items, lambda x: F.regexp_replace(F.trim(x), r"""^["']|["']$""", "")), lambda x: x != "")


def is_owned(meta: Column, marker: str = OWNER_MARKER) -> Column:
    """Whether the marker stands on a line of its own, quoted or not."""
    return F.coalesce(meta, F.lit("")).rlike(rf"""(?m)^[ \t]*app:[ "']*{marker}[ "']*$""")


def corpus_metadata(files: DataFrame, marker: str = OWNER_MARKER) -> DataFrame:
    """path, title, date, time, duration, grp, participants, tags of the owned files (path, content)."""
    meta = front(F.col("content"))
    rows = files.withColumn("_meta", meta).where(is_owned(F.col("_meta"), marker))
    return rows.select("path", *[field(F.col("_meta"), k).alias(n) for k, n in (("title", "title"), ("date", "date"), ("time", "time"), ("duration", "duration"), ("group", "grp"))], listing(F.col("_meta"), "participants").alias("participants"), listing(F.col("_meta"), "tags").alias("tags"))


def blocks(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Typed blocks of transcript bodies: section, divider, audio, screen, table, paragraph.

    Lines of one table share its first line's number; separator rows are dropped.
    """
    lines = files.select(key, F.posexplode(F.split(body(F.col(content)), "\n")).alias("line_no", "line")).withColumn("line", F.trim(F.translate("line", "\t", " ")))
    in_table = F.col("line").startswith("|")
    w = W.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("_new", (in_table & ~F.coalesce(F.lag(in_table).over(w), F.lit(False))).cast("int"))
    lines = lines.withColumn("_table", F.when(in_table, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))))
    inner = F.regexp_extract("line", r"^\*\*(\[[^\]]*\][^*]*)\*\*", 1)
    rest = F.trim(F.regexp_replace("line", r"^\*\*.*?\*\*", ""))
    label = F.trim(F.regexp_replace(inner, r"^\[[^\]]*\]", ""))
    spoken = inner != ""
    kind = F.when(in_table, "table").when(F.col("line").startswith("## "), "section").when(F.col("line") == "---", "divider").when(spoken & (rest == ""), "screen").when(spoken, "audio").otherwise("paragraph")
    rows = lines.where((F.col("line") != "") & ~F.col("line").startswith("# ") & ~F.col("line").rlike(r"^\|[-:| ]*$"))
    return rows.select(key, "line_no", kind.alias("block_type"), F.when(spoken & ~in_table, F.regexp_extract(inner, r"^(\[[^\]]*\])", 1)).alias("stamp"), F.when(spoken & ~in_table, F.nullif(F.regexp_replace(label, ":$", ""), F.lit(""))).alias("speaker"), F.when(kind == "section", F.substring("line", F.lit(4), F.length("line"))).when(kind == "audio", rest).when(kind.isin("screen", "divider"), F.lit(None)).otherwise(F.col("line")).alias("text"), F.col("_table").alias("table_no"))


def summary_section(content: Column) -> Column:
    """The text under ``## Summary`` up to the next heading or spoken line, as one line."""
    section = F.regexp_extract(content, r"(?s)## Summary[^\n]*\n(.*?)(?:\n[ \t]*(?:#|\*\*\[)|\z)", 1)
    return F.trim(F.regexp_replace(section, r"[ \t]*\n[ \t]*", " "))


def screen_chunks(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One chunk per on-screen entry, with the time of its stamp (0 without one)."""
    section = F.regexp_extract(F.col(content), r"(?s)## Screen Context(.*)\z", 1)
    rows = files.select(key, F.posexplode(F.split(section, "\n\n---\n\n")).alias("entry", "raw")).withColumn("raw", C.trim_all(F.col("raw"))).where("raw <> ''")
    stamp = F.regexp_extract("raw", r"^\*\*\[([^\]]*)\]\*\*", 1)
    ms = F.coalesce(C.stamp_ms(stamp), F.lit(0))
    text = C.trim_all(F.regexp_replace("raw", r"^\*\*\[[^\]]*\]\*\*", ""))
    return rows.select(key, "entry", ms.alias("start_ms"), F.lit("Screen").alias("speaker"), text.alias("text")).where("text <> ''")


def note_entries(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``- **stamp** — text ([[call]])`` lines of notes: stamp, text, linked call (null without one)."""
    lines = files.select(key, F.posexplode(F.split(body(F.col(content)), "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    rows = lines.where(F.col("line").rlike(r"^- \*\*.*?\*\*"))
    rest = F.trim(F.regexp_replace(F.trim(F.regexp_replace("line", r"^- \*\*.*?\*\*", "")), "^—", ""))
    linked = F.nullif(F.regexp_extract(rest, r"^.*\(\[\[(.*)\]\]\)$", 1), F.lit(""))
    text = F.when(linked.isNotNull(), F.trim(F.regexp_replace(rest, r"^(.*)\(\[\[.*\]\]\)$", "$1"))).otherwise(rest)
    return rows.select(key, "line_no", F.regexp_extract("line", r"^- \*\*(.*?)\*\*", 1).alias("stamp"), text.alias("text"), linked.alias("linked_call"))


def wikilinks(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``[[name|shown]]`` occurrences as (source, name, shown)."""
    links = F.regexp_extract_all(F.col(content), F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    rows = files.select(F.col(key).alias("source"), F.posexplode(links).alias("n", "link"))
    part = F.split("link", r"\|", 2)
    return rows.select("source", "n", F.trim(F.get(part, F.lit(0))).alias("name"), F.trim(F.coalesce(F.get(part, F.lit(1)), F.get(part, F.lit(0)))).alias("shown"))


def note_blocks(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Lines of notes with their block: heading (level), bullets, numbered, table, code, rule, paragraph; adjacent lines of one kind are one block."""
    w = W.partitionBy(key).orderBy("line_no")
    lines = files.select(key, F.posexplode(F.split(F.col(content), "\r\n|\n|\r")).alias("line_no", "raw")).withColumn("line", F.trim(F.translate("raw", "\t", " ")))
    fence = F.col("line").startswith("```").cast("int")
    lines = lines.withColumn("_fences", F.sum(fence).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_fence", fence)
    code = (F.col("_fences") % 2 == 1) | (F.col("_fence") == 1)
    separator = lambda c: c.startswith("|") & F.regexp_replace(c, "[ |]", "").rlike(r"^[-:]+$")
    kind = F.when(code, "code").when(F.col("line") == "", "blank").when(F.col("line").startswith("|") & F.coalesce(separator(F.lead("line").over(w)), F.lit(False)), "table_head").when(F.col("line").startswith("|"), "bar").when(F.col("line").startswith("#"), "heading").when(F.col("line").isin("---", "***", "___"), "rule").when(F.col("line").rlike(r"^[-*+] "), "bullets").when(F.col("line").rlike(r"^\p{N}+[.)] "), "numbered").otherwise("paragraph")
    lines = lines.withColumn("kind", kind)
    # Rows of bars belong to a table if the run began with a head, else they are prose.
    run = F.sum((F.col("kind") != "bar").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    lines = lines.withColumn("_run", run).withColumn("kind", F.when((F.col("kind") == "bar") & (F.first("kind").over(W.partitionBy(key, "_run").orderBy("line_no")) == "table_head"), "table").when(F.col("kind") == "bar", "paragraph").when(F.col("kind") == "table_head", "table").otherwise(F.col("kind")))
    opens = (F.col("kind") != F.coalesce(F.lag("kind").over(w), F.lit(""))) | F.col("kind").isin("heading", "rule") | ((F.col("_fence") == 1) & (F.col("_fences") % 2 == 1)) | (F.lead("line").over(w).isNotNull() & separator(F.lead("line").over(w)) & F.col("line").startswith("|"))
    lines = lines.withColumn("block", F.sum(opens.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("kind <> 'blank'")
    level = F.when(F.col("kind") == "heading", F.least(F.length(F.regexp_extract("line", "^(#+)", 1)), F.lit(6)))
    return lines.select(key, "line_no", "block", "kind", level.alias("level"), "line")
