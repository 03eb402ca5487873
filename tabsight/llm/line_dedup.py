"""Site-relative line dedup: drop lines that a large share of a site's pages carry.

``drop_site_lines`` groups pages by host and, for every line, divides the
number of the host's pages containing it by the host's page total. Lines whose
share exceeds ``ratio`` are boilerplate of that host and are dropped from its
pages. Pages of one host with the same text count as one page, both in the
number and in the total, so a group of exact copies alone is never taken for
boilerplate. The share decides on hosts of every size; a line on fewer than
``min_count`` pages repeats nothing and stays (on a host of under 1 / ratio
pages every line's share is over the ratio). ``min_pages`` leaves hosts with
fewer pages alone where a caller asks for it.

Only built-in expressions are used. Lines are compared by a 64-bit hash within
their host. Each count is an aggregate with a partial step on the map side, so
a hot host shrinks before it is shuffled. A host has at most (mean lines per
page / ratio) boilerplate lines, since their shares add up to the mean number
of lines per page; that short list joins the pages by host, broadcast by
Spark when it is small and split by the adaptive skew join otherwise.

Defined results: a page with a null host or null text is returned unchanged;
blank lines are never judged and stay; equal lines of one page count once and
are dropped together; repeated rows each keep their row; all other columns pass
through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import free_name, write_table


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def site_lines(pages: DataFrame, host: Column, text: Column, ratio: float = 0.1, min_pages: int = 1, min_count: int = 2) -> DataFrame:
    """Boilerplate per host: ``host, n_pages, lines`` (an array of line hashes)."""
    judged = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _hash))
    distinct = (
        pages.select(host.alias("host"), text.alias("text"))
        .where("host IS NOT NULL AND text IS NOT NULL")
        .select("host", F.xxhash64("text").alias("page"), F.length("text").alias("size"), judged.alias("lines"))
        .groupBy("host", "page", "size")
        .agg(F.first("lines").alias("lines"))
    )
    distinct = write_table(distinct, "distinct-pages")  # read twice
    totals = distinct.groupBy("host").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    counts = (
        distinct.select("host", F.explode("lines").alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_count)
    )
    return (
        counts.join(totals, "host")
        .where(F.col("n") / F.col("n_pages") > ratio)
        .groupBy("host")
        .agg(F.first("n_pages").alias("n_pages"), F.collect_set("line").alias("lines"))
    )


def drop_site_lines(
    pages: DataFrame,
    host: Column,
    text: Column,
    out: str = "text",
    ratio: float = 0.1,
    min_pages: int = 1,
    min_count: int = 2,
) -> DataFrame:
    """``pages`` with column ``out`` holding the text without boilerplate lines."""
    # written first: then the join has a plain table on this side, and a hot host's pages can be split
    own_host, own_text, site, drop = (free_name(n, pages.columns, [out]) for n in ("__host", "__text", "__site", "__drop"))
    found = write_table(site_lines(pages, host, text, ratio, min_pages, min_count), "site-lines").select(
        F.col("host").alias(site), F.col("lines").alias(drop)
    )
    kept = F.array_join(F.filter(_lines(F.col(own_text)), lambda x: (F.trim(x) == "") | ~F.array_contains(drop, _hash(x))), "\n")
    return (
        pages.select("*", host.alias(own_host), text.alias(own_text))
        .join(found, F.col(own_host) == F.col(site), "left")
        .withColumn(out, F.when(F.col(drop).isNull(), F.col(own_text)).otherwise(kept))
        .drop(own_host, own_text, site, drop)
    )


#: Tags that end a line of a web page.
BLOCK_TAGS = "p|div|br|li|ul|ol|h[1-6]|nav|article|section|header|footer|title|head|body|table|tr|td|th|main|aside"


def page_lines(html: Column) -> Column:
    """The visible text of a web page, one block element per line."""
    x = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    x = F.regexp_replace(x, rf"(?i)</?({BLOCK_TAGS})(\s[^>]*)?/?>", "\n")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", "")
    x = F.regexp_replace(x, r"[ \t\r]*\n[ \t\r\n]*", "\n")
    return F.regexp_replace(x, r"^\n|\n$", "")


def host_of(url: Column) -> Column:
    """The lower-cased host of an address; null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)", 1))
    return F.when(host != "", host)
