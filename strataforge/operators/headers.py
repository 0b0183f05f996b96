"""Removal of lines that repeat over the pages of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: A document needs this many pages; a line is noise from this share of pages on, if its fingerprint is longer than that.
PAGES, SHARE, SHORT = 3, 0.6, 5


def join_pages(pages: DataFrame, key: str = "doc_id", number: str = "page_number", text: str = "text") -> DataFrame:
    """(key, pages, text): non-blank pages under their markers, in order; blank pages count."""
    part = F.when(T.strip(F.col(text)) != "", T.page_text(F.col(number), F.col(text)))
    ordered = F.sort_array(F.collect_list(F.struct(F.col(number).alias("n"), part.alias("t"))))
    return pages.groupBy(key).agg(F.count("*").alias("pages"), F.array_join(F.transform(ordered, lambda s: s["t"]), "\n\n").alias("text"))


def without_repeats(text: Column, pages: Column, keep_page_markers: bool = False) -> Column:
    """A text of ``pages`` pages without its noise lines; nothing but its own row is needed.

    In the sorted fingerprints of the lines, one that occurs n times stands n - 1 places after itself.
    """
    lines = F.split(text, "\n", -1)
    prints = F.filter(F.transform(lines, T.line_fingerprint), lambda p: F.length(p) > SHORT)
    if keep_page_markers:
        prints = F.filter(prints, lambda p: p != "[Page #]")
    least = F.ceil(F.lit(SHARE) * pages).cast("int")
    noise = F.transform(F.array(F.array_sort(prints)), lambda s: F.array_distinct(F.filter(s, lambda p, i: F.get(s, i + least - 1) == p)))
    kept = F.transform(noise, lambda n: F.when(F.size(n) > 0, F.array_join(F.filter(lines, lambda x: ~F.array_contains(n, T.line_fingerprint(x))), "\n")).otherwise(text))
    return F.when(pages >= PAGES, F.get(kept, F.lit(0))).otherwise(text)


def remove_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", pages: str = "pages", keep_page_markers: bool = False) -> DataFrame:
    """(key, text) without noise lines. Counts are per line, so a line that repeats on one page counts each time.

    Page markers repeat too and go with the rest, unless ``keep_page_markers``. Documents without noise stay as they are.
    """
    return docs.select(key, without_repeats(F.col(text), F.col(pages), keep_page_markers).alias("text"))
