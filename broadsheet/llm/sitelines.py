"""Lines repeated across one site's documents.

Lines are reduced to their letters and hashed (two independent 64-bit hashes); each document
contributes every hash once, so a plain count per (site, hash) is a count of documents and is
combined before the shuffle. Frequent hashes are joined back; the key holds the hash as well as
the site, so a site with a third of all documents spreads over many keys; the other side of that
join is shuffled again on one more key, so that the adaptive join can split a line that hot. Only JVM expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.session import filled, strip_blanks, table

MIN_DOCUMENTS = 4


def letters(line: Column) -> Column:
    """Only the letters of a line, in lower case."""
    return F.lower(F.regexp_replace(line, r"[^\p{L}]+", ""))


def _hashes(line: Column) -> Column:
    text = letters(line)
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"), (text != "").alias("has"))


def documents(rows: DataFrame) -> DataFrame:
    """Distinct (story_id, site, text) with text and a site."""
    site = F.lower(strip_blanks(F.col("domain")))
    return rows.filter(F.col("text").isNotNull() & F.col("story_id").isNotNull() & filled(F.col("domain"))).select("story_id", site.alias("site"), "text").distinct()


def repeated_lines(rows: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = 0.0) -> DataFrame:
    """(story_id, line_no) of lines that stand in ``min_documents`` stories of their site.

    rows: story_id, domain, text. With ``min_share`` a line must also reach that share of the
    site's documents. Lines without letters, stories without a site, null texts and repeated
    rows don't count; lines are numbered from 1 at every line feed. A story with several texts
    counts once per line. Empty input gives an empty table; other columns are ignored.
    """
    return _marked(rows, min_documents, min_share).select("story_id", "line_no").distinct()


def _marked(rows: DataFrame, min_documents: int, min_share: float, *keys: Column) -> DataFrame:
    """story_id, site, ``keys`` (of the text) and line_no of every repeated line of every distinct text."""
    docs = documents(rows)
    lines = docs.select("story_id", "site", *keys, F.posexplode(F.transform(F.split("text", "\n"), _hashes)).alias("pos", "line")).filter("line.has")
    lines = lines.withColumns({"line_no": (F.col("pos") + 1).cast("int"), "h1": F.col("line.h1"), "h2": F.col("line.h2")}).drop("pos", "line")
    once = docs.groupBy("story_id", "site").agg(F.array_distinct(F.flatten(F.collect_list(F.transform(F.split("text", "\n"), _hashes)))).alias("lines"))
    counted = once.select("site", F.inline("lines")).filter("has").groupBy("site", "h1", "h2").agg(F.count("*").alias("n"))
    frequent = counted.filter(F.col("n") >= min_documents)
    if min_share > 0:
        sites = once.groupBy("site").agg(F.count("*").alias("all"))
        frequent = frequent.join(sites, "site").filter(F.col("n") >= min_share * F.col("all"))
    again = F.hash("site", "h1").alias("again")
    return lines.select("*", again).join(frequent.select("site", "h1", "h2", again), ["site", "h1", "h2", "again"]).drop("h1", "h2", "again")


def cleaned(rows: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(story_id, text) without the repeated lines, one row per site and distinct text of a story.

    Each text loses its own lines, known by its digest, whatever a story's other texts hold; texts
    without any repeated line stay as they are.
    """
    digest = F.unhex(F.md5("text")).alias("text_id")
    docs = documents(rows).withColumn("text_id", digest)
    drop = _marked(rows, min_documents, 0.0, digest).groupBy("story_id", "site", "text_id").agg(F.collect_set("line_no").alias("drop"))
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col("drop"), i + 1))
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return docs.join(drop, ["story_id", "site", "text_id"], "left").select("story_id", text.alias("text"))


def found(spark, root: str) -> DataFrame:
    """p7_found."""
    return repeated_lines(table(spark, root, "fetch_review", ["story_id", "domain", "text"]))


def texts(spark, root: str) -> DataFrame:
    return cleaned(table(spark, root, "fetch_review", ["story_id", "domain", "text"]))
