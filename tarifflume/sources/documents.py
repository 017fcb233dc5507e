"""Page text of documents: full text, head text, text lines and routing flags.

Input `pages(doc_id, page_number, text)`; page numbers are positions inside a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def marked_page() -> Column:
    """Page text behind its page marker."""
    return F.concat(F.lit("--- Page "), F.col("page_number").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))


def full_text(pages: DataFrame) -> DataFrame:
    """One string per document: pages in order behind their markers, a blank line between.

    A Spark string holds at most 2 GB; consumers that only need the start use
    `head_text`, and line parsers use `text_lines`, which never builds this string.
    """
    return pages.groupBy("doc_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("page_number", marked_page().alias("t")))), lambda p: p["t"]
            ),
            "\n\n",
        ).alias("full_text")
    )


def head_text(pages: DataFrame, chars: int | None = None) -> DataFrame:
    """The full text as `head`, or its first `chars` characters.

    Every page adds more than 16 characters (its marker), so the first chars/16 pages
    always suffice; the rank limit is applied before the shuffle.
    """
    if chars is None:
        return full_text(pages).withColumnRenamed("full_text", "head")
    enough = chars // 16 + 1
    first = Window.partitionBy("doc_id").orderBy("page_number")
    near = pages.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= enough)
    clipped = near.withColumn("text", F.substring("text", 1, chars))
    return full_text(clipped).select("doc_id", F.substring("full_text", 1, chars).alias("head"))


def text_lines(pages: DataFrame) -> DataFrame:
    """Trimmed non-blank lines (doc_id, page_number, line_no, text), page markers included."""
    # Trimmed before they are rows: a filter on the text would repeat the trimming for each of its tests.
    marked = pages.select("doc_id", "page_number", marked_page().alias("marked"))
    raw = F.when(F.contains("marked", F.lit("\r")), F.split("marked", "\r\n|\n|\r")).otherwise(F.split("marked", "\n"))
    lines = marked.select("doc_id", "page_number", F.posexplode(F.transform(raw, lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")))).alias("line_no", "text"))
    return lines.where("text <> ''")


def needs_ocr(documents: DataFrame, pages: DataFrame, min_chars: int = 50) -> DataFrame:
    """Documents whose pages hold under `min_chars` characters on average, or that have no pages."""
    mean = pages.groupBy("doc_id").agg(F.avg(F.length(F.coalesce("text", F.lit("")))).alias("mean_chars"))
    return documents.select("doc_id").join(mean, "doc_id", "left").select(
        "doc_id", "mean_chars", F.coalesce(F.col("mean_chars") < min_chars, F.lit(True)).alias("needs_ocr")
    )


def reading_method(pages: DataFrame, min_chars: int = 20) -> DataFrame:
    """digital / ocr / mixed by how many pages have enough trimmed text."""
    enough = F.length(F.trim(F.coalesce("text", F.lit("")))) >= min_chars
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(enough).alias("digital_pages"),
        F.when(F.bool_and(enough), "digital").when(F.bool_or(enough), "mixed").otherwise("ocr").alias("method"),
    )
