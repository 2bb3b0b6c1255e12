"""Page-level cleaning: running heads, page numbers, references, whitespace. Pages are rows (doc, page, text)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..functions.udfs import nfkc, ship

ship(__name__)


def lines_of(pages: DataFrame) -> DataFrame:
    """doc, page, line_no, line of every line."""
    return pages.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def repeating_lines(pages: DataFrame, scan: int = 3, share: float = 0.5) -> DataFrame:
    """FLT3: doc, fp, n_pages of the line fingerprints that come back at the edges of at least max(3, half) of a document's pages (three or more)."""
    lines = lines_of(pages).filter(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")
    by = Window.partitionBy("doc", "page")
    edge = lines.withColumn("top", F.row_number().over(by.orderBy("line_no"))).withColumn("end", F.row_number().over(by.orderBy(F.desc("line_no")))).filter((F.col("top") <= scan) | (F.col("end") <= scan))
    seen = edge.select("doc", "page", t.line_fingerprint(F.col("line")).alias("fp")).distinct().groupBy("doc", "fp").agg(F.count("*").alias("n_pages"))
    total = pages.groupBy("doc").agg(F.count("*").alias("pages"))
    least = F.greatest(F.lit(3), F.floor(F.col("pages") * share))
    return seen.join(total, "doc").filter((F.col("pages") >= 3) & (F.col("n_pages") >= least)).select("doc", "fp", "n_pages")


def drop_lines(pages: DataFrame, repeating: DataFrame) -> DataFrame:
    """FLT4: pages without page-number and repeating lines; line order is kept."""
    lines = lines_of(pages).filter(~t.is_page_number(F.col("line"))).withColumn("fp", t.line_fingerprint(F.col("line")))
    left = lines.join(repeating.select("doc", "fp"), ["doc", "fp"], "left_anti")
    joined = left.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return pages.select("doc", "page").join(joined, ["doc", "page"], "left").select("doc", "page", F.coalesce("text", F.lit("")).alias("text"))


_BLANK = r"[\t ]"
_REFERENCES = re.compile(rf"^{_BLANK}*(([0-9]+|[CILVX]+)[.]?{_BLANK}*)?(bibliography|works cited|references){_BLANK}*$", re.I | re.M)
_APPENDIX = re.compile(rf"^{_BLANK}*((?i:supplementary({_BLANK}+(information|material))?|appendix({_BLANK}+[0-9A-Z][ \w-]{{0,40}})?)|[A-H][.]?{_BLANK}+[A-Z][ A-Za-z]{{3,40}}){_BLANK}*$", re.M)


def reference_span(text: str, share: float = 0.3) -> tuple[int, int] | None:
    """FLT5: from the first references heading past `share` of the text to the next appendix heading, or the end."""
    least = len(text) * share
    for m in _REFERENCES.finditer(text):
        if m.start() >= least:
            after = _APPENDIX.search(text, m.end())
            return m.start(), after.start() if after else len(text)
    return None


@F.pandas_udf(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()))
def reference_spans(text: pd.Series) -> pd.DataFrame:
    spans = [reference_span(x) if x else None for x in text]
    return pd.DataFrame({"start": pd.array([s[0] if s else None for s in spans], "Int32"), "end": pd.array([s[1] if s else None for s in spans], "Int32")})


def strip_references(text: str) -> str:
    """FLT6: an appendix after the references stays."""
    span = reference_span(text)
    return text if span is None else text[: span[0]].rstrip() + ("\n\n" + text[span[1] :] if span[1] < len(text) else "")


def page_map(pages: DataFrame, separator: int = 2) -> DataFrame:
    """CHK1: doc, page, start, end of the non-blank pages in the document's joined text."""
    own = pages.filter(F.trim(F.col("text")) != "")
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + separator).over(before), F.lit(0)).cast("int")
    return own.select("doc", "page", start.alias("start"), (start + F.length("text")).alias("end"), "text")


def join_pages(pages: DataFrame) -> DataFrame:
    """CHK1: doc, text, spans: pages joined by a blank line, and where each begins and ends."""
    return page_map(pages).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "start", "end", "text"))).alias("p")).select("doc", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), F.transform("p", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["page"].alias("page"))).alias("spans"))


def cut_references(pages: DataFrame) -> DataFrame:
    """FLT7: pages without the document's reference span, found in the joined text and subtracted page by page."""
    joined = join_pages(pages).select("doc", reference_spans("text").alias("span")).select("doc", F.col("span.start").alias("s"), F.col("span.end").alias("e"))
    at = page_map(pages).join(joined, "doc", "left")
    lo = F.least(F.greatest(F.col("s") - F.col("start"), F.lit(0)), F.length("text"))
    hi = F.least(F.greatest(F.col("e") - F.col("start"), F.lit(0)), F.length("text"))
    cut = F.concat(F.col("text").substr(F.lit(1), lo), F.expr("substring(text, hi + 1)"))
    return at.withColumn("hi", hi).select("doc", "page", F.when(F.col("s").isNull(), F.col("text")).otherwise(cut).alias("text"))


def clean_pages(pages: DataFrame, references: bool = True) -> DataFrame:
    """FLT8, FLT9: NFKC, hyphens, running heads and page numbers, references, whitespace, in this order."""
    step = pages.select("doc", "page", t.dehyphenate(nfkc("text")).alias("text"))
    step = drop_lines(step, repeating_lines(step))
    if references:
        step = cut_references(step)
    return step.select("doc", "page", t.collapse_whitespace(F.col("text")).alias("text"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """SRC3: doc, page, text from positioned blocks (x0, y0, x1, y1, text, kind; page_width): left column before right where a page has two."""
    own = blocks.filter((F.col("kind") == 0) & (F.trim(F.col("text")) != ""))
    narrow = (F.col("x1") - F.col("x0")) <= 0.6 * F.col("page_width")
    centre, middle = (F.col("x0") + F.col("x1")) / 2, F.col("page_width") / 2
    page = Window.partitionBy("doc", "page")
    two = (F.count_if(narrow & (centre < middle)).over(page) >= 2) & (F.count_if(narrow & (centre >= middle)).over(page) >= 2)
    keyed = own.withColumn("two", two).withColumn("k1", F.when(F.col("two"), F.when(narrow & (centre >= middle), 1.0).otherwise(0.0)).otherwise(F.round("y0", 1))).withColumn("k2", F.when(F.col("two"), F.round("y0", 1)).otherwise(F.round("x0", 1)))
    return keyed.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k1", "k2", "x0", "text"))), lambda b: F.trim(b["text"])), "\n\n").alias("text"))
