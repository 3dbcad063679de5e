"""Drop a site's boilerplate lines by their relative frequency. DataFrame functions only.

For each host, the pages that contain a line are divided by the pages of the host; lines
above ``ratio`` are boilerplate there and are dropped from all its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import stage

# At sf0.1 no line of over 50 words stands on more than 2 of a host's 500 distinct texts, 0.41%.
RATIO = 0.005
MIN_PAGES = 5
BROADCAST_LINES = 100_000
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _mark(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def boilerplate(
    pages: DataFrame, *, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False
) -> DataFrame:
    """``(host, mark, pages_with, pages)``: the MD5 of each boilerplate line of each host.

    A line counts once a page, without spaces at its ends; blank lines never count. Partial
    counts come before the shuffle and a line travels as 16 bytes, so a hot host or line
    costs one row per task. Lines on fewer than ``min_pages`` pages are no boilerplate. With
    ``copies_once`` pages of a host with the same text are one page, above and below the line.
    """
    marks = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: F.trim(x) != ""), _mark))
    counted_pages = pages.select(F.col(host).alias("host"), marks.alias("marks"))
    if copies_once:
        texts = pages.select(F.col(host).alias("host"), F.md5(F.col(text)).alias("same"), marks.alias("marks"))
        counted_pages = stage(texts.groupBy("host", "same").agg(F.first("marks").alias("marks")), "distinct-pages")
    seen = counted_pages.select("host", F.explode("marks").alias("mark"))
    counted = seen.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("pages_with"))
    totals = counted_pages.groupBy(F.col("host").alias("_host")).agg(F.count(F.lit(1)).alias("pages"))
    frequent = counted.where(F.col("pages_with") >= min_pages).join(totals, F.col("host").eqNullSafe(F.col("_host")))
    return frequent.where(F.col("pages_with") > F.col("pages") * F.lit(ratio)).select("host", "mark", "pages_with", "pages")


def drop_boilerplate(
    pages: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    copies_once: bool = False,
) -> DataFrame:
    """``pages`` with the boilerplate lines out of ``text``, and ``n_lines``, ``n_dropped``.

    All other columns and all rows stay; a page may end up empty. A null text stays null
    with 0 lines and counts as a page of its host; an empty text is one blank line. Null is
    a host like any other. Kept lines are unchanged, in order. Extra columns are carried
    along; names that begin with ``_ld_`` are taken.

    A host has at most (lines of a page / ratio) boilerplate lines. The list per host is
    sent to all tasks only if all hosts together have ``BROADCAST_LINES`` or fewer, by
    count; otherwise pages are salted by their text, so that a hot host is joined in many tasks.
    """
    found = stage(
        boilerplate(pages, host=host, text=text, ratio=ratio, min_pages=min_pages, copies_once=copies_once), "boilerplate"
    )
    lists = found.groupBy(F.col("host").alias("_ld_host")).agg(F.collect_list("mark").alias("_ld_marks"))
    if found.count() <= BROADCAST_LINES:
        joined = pages.join(F.broadcast(lists), pages[host].eqNullSafe(lists["_ld_host"]), "left")
    else:
        salted = lists.withColumn("_ld_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = pages.withColumn("_ld_salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
        same = keyed[host].eqNullSafe(salted["_ld_host"]) & (keyed["_ld_salt"] == salted["_ld_salt2"])
        joined = keyed.join(salted, same, "left")
    lines = _lines(F.col(text))
    marks = F.col("_ld_marks")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(marks, _mark(x)))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    cut = joined.withColumn("_ld_kept", F.when(marks.isNotNull(), kept).otherwise(lines))
    n_kept = F.when(F.col(text).isNull(), 0).otherwise(F.size("_ld_kept")).cast("bigint")
    values = {c: pages[c] for c in pages.columns} | {text: F.array_join("_ld_kept", "\n").alias(text)}
    return cut.select(
        *[F.col(c) if c != text else values[c] for c in pages.columns],
        n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"),
    )
