"""Line dedup by site-relative frequency (native).

A line of a page is a block of its HTML: scripts, styles and comments go, block tags and line breaks separate, other
tags vanish, white space is squeezed. For each host, the share of its pages that contain a line is the number of
pages with the line divided by the host's pages. Lines above the boilerplate ratio are dropped from all pages of the host.

A line must be on ``MIN_HOLDERS`` pages of the host to be dropped, so that a line of one page is never boilerplate (with one page
every line would have share 1). Pages count a line once. Counts by (host, line) are combined map-side, so neither a large host nor
a frequent line gathers rows in one task. A host's boilerplate is at most its lines per page divided by the ratio, so it is
kept as one short list per host. Up to ``FEW_HOSTS`` such lists are broadcast, so pages do not move at all; more are joined
on the host and a salt, so a large host is spread over ``SALTS`` parts at least.

Entities such as ``&amp;`` are not decoded, and a script, style or comment that never ends is text like any other.

Defined cases: null url or a url without host belong to the host ``''``; null html has no lines; repeated
rows are pages of their own; an empty table gives an empty result; other columns are passed on by ``cleaned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcoder.llm.util import cut

RATIO = 0.3
MIN_HOLDERS = 2
#: A list has about lines per page / RATIO marks of 32 bytes; 5000 of 200 marks are 32 MB.
FEW_HOSTS = 5_000
SALTS = 16

#: Fixed patterns, valid for Java and RE2 alike.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
UNSEEN = r"(?is)<script(?:[\s/][^>]*)?>.*?</script\s*>|<style(?:[\s/][^>]*)?>.*?</style\s*>|<!--.*?-->"
BREAK = (r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main"
         r"|nav|ol|p|pre|section|table|tbody|td|th|thead|title|tr|ul)(?:\s[^>]*)?/?>")
TAG = r"<[^>]*>"
SQUEEZE = r"[\x20\x09\x0B-\x0D]+"


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def lines(html: Column) -> Column:
    """Non-empty lines of a page, in order."""
    seen = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "\n")
    text = F.regexp_replace(F.regexp_replace(seen, BREAK, "\n"), TAG, "")
    text = F.regexp_replace(text, SQUEEZE, " ")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_holders: int = MIN_HOLDERS) -> DataFrame:
    """(host, marks): MD5 of the lines above the ratio, of rows (host, lines)."""
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = (pages.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.md5(x)))).alias("mark"))
              .groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_holders))
    return (counts.join(totals, "host").filter(F.col("n") / F.col("pages") > ratio)
            .groupBy("host").agg(F.collect_set("mark").alias("marks")))


def cleaned(df: DataFrame, url: str = "url", html: str = "html", ratio: float = RATIO, min_holders: int = MIN_HOLDERS,
            host_out: str = "host", lines_out: str = "lines", kept_out: str = "kept", few_hosts: int = FEW_HOSTS) -> DataFrame:
    """``df`` with host, all lines and the kept lines of each page (columns so named are replaced)."""
    outs = (host_out, lines_out, kept_out)
    rows = df.select(*[c for c in df.columns if c not in outs], host(F.col(url)).alias("__host"), lines(F.col(html)).alias("__lines"))
    marks = boilerplate(rows.select(F.col("__host").alias("host"), F.col("__lines").alias("lines")), ratio, min_holders)
    marks = cut(marks.select(F.col("host").alias("__of"), F.col("marks").alias("__marks")))
    on = F.col("__host") == F.col("__of")
    if marks.count() <= few_hosts:
        marks = F.broadcast(marks)
    else:
        marks = marks.withColumn("__of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__lines"), F.lit(SALTS)).cast("int"))
        on = on & (F.col("__salt") == F.col("__of_salt"))
    at = rows.join(marks, on, "left")
    kept = F.when(F.col("__marks").isNull(), F.col("__lines")).otherwise(
        F.filter("__lines", lambda x: ~F.array_contains(F.col("__marks"), F.md5(x))))
    return at.select(*[c for c in df.columns if c not in outs], F.col("__host").alias(host_out), F.col("__lines").alias(lines_out),
                     kept.alias(kept_out))
