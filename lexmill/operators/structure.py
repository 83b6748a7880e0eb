"""Order-dependent operators on blocks (doc_id, block_idx, page, bbox, height, text).

Every window is partitioned by doc_id and ordered by block_idx, so that the operators of
one pipeline share a shuffle and a sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from lexmill.functions import extract as X
from lexmill.functions import text as T


def in_order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("block_idx")


def so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def drop_margins(blocks: DataFrame) -> DataFrame:
    """Without blocks in the top 5 % of a page, and flat ones (below a tenth of it) that end in the bottom 5 %."""
    h = F.coalesce("height", F.lit(0.0))
    y0, y1 = F.col("bbox")[1], F.col("bbox")[3]
    return blocks.where(~((y0 < 0.05 * h) | ((y1 > 0.95 * h) & (y1 - y0 < 0.1 * h))))


def drop_short(blocks: DataFrame, least: int = 5) -> DataFrame:
    return blocks.where(F.length("text") >= least)


def detect_headings(blocks: DataFrame, most_specific_first: bool = False) -> DataFrame:
    """blocks with heading_level and heading, null for blocks that begin with none."""
    return blocks.withColumns({"heading_level": X.heading_level(F.col("text"), most_specific_first), "heading": X.heading_text(F.col("text"), most_specific_first)})


def carry_headings(blocks: DataFrame, most_specific_first: bool = False) -> DataFrame:
    """blocks with headers_arr and headers: the headings that a block stands under, by level.

    A heading ends those of its own and all higher levels. Level L's latest heading holds
    unless one of a lower level came after it.
    """
    found = detect_headings(blocks, most_specific_first)
    at = {lv: F.coalesce(F.max(F.when(F.col("heading_level") == lv, F.col("block_idx"))).over(so_far()), F.lit(-1)) for lv in X.LEVELS}
    last = {lv: F.last(F.when(F.col("heading_level") == lv, F.col("heading")), ignorenulls=True).over(so_far()) for lv in X.LEVELS}
    found = found.withColumns({f"at_{lv}": c for lv, c in at.items()} | {f"last_{lv}": c for lv, c in last.items()})
    kept = []
    for lv in X.LEVELS:
        lower = [F.col(f"at_{x}") for x in X.LEVELS if x < lv]
        bound = F.greatest(*lower) if len(lower) > 1 else lower[0] if lower else F.lit(-1)
        kept.append(F.when(F.col(f"at_{lv}") > bound, F.col(f"last_{lv}")))
    found = found.withColumn("headers_arr", F.array_compact(F.array(*kept))).withColumn("headers", F.concat_ws(", ", "headers_arr"))
    return found.drop("heading_level", "heading", *(f"{p}_{lv}" for lv in X.LEVELS for p in ("at", "last")))


def contents_table(blocks: DataFrame) -> DataFrame:
    """(doc_id, toc_idx, page, level, header, title) of the entries after the block that announces them."""
    named = F.lower("text").contains("table of contents")
    # Only announcements and lines that look like entries are shuffled, without their texts.
    rows = blocks.select("doc_id", "block_idx", named.alias("named"), X.contents_entry(F.col("text")).alias("entry")).where("named OR entry IS NOT NULL")
    begun = F.min(F.when(F.col("named"), F.col("block_idx"))).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("begun", begun).where("block_idx > begun AND NOT named")
    return rows.select("doc_id", (F.row_number().over(in_order()) - 1).alias("toc_idx"), "entry.*")


def add_titles(blocks: DataFrame, toc: DataFrame) -> DataFrame:
    """blocks with enriched_headers: every heading followed by its title in the table of contents, the first of equal entries counting."""
    first = toc.select("doc_id", X.contents_key(F.col("header")).alias("key"), "toc_idx", "title").groupBy("doc_id", "key").agg(F.min_by("title", "toc_idx").alias("title"))
    titles = first.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "title"))).alias("titles"))
    out = blocks.join(titles, "doc_id", "left")
    named = F.transform("headers_arr", lambda h: F.coalesce(F.concat(h, F.lit(": "), F.try_element_at(F.col("titles"), X.contents_key(h))), h))
    return out.withColumn("enriched_headers", F.concat_ws(", ", named)).drop("titles")


def merge_after_colon(blocks: DataFrame) -> DataFrame:
    """A block that ends with a colon takes in the next one, and so on; the first one's other columns stay."""
    joined = F.coalesce(F.lag("text").over(in_order()).endswith(":"), F.lit(False))
    rows = blocks.withColumn("grp", F.sum(F.when(joined, 0).otherwise(1)).over(so_far()))
    rest = [c for c in blocks.columns if c not in ("doc_id", "text")]
    text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "text"))), lambda s: s["text"]))
    meta = F.min_by(F.struct(*rest), "block_idx")
    return rows.groupBy("doc_id", "grp").agg(text.alias("text"), meta.alias("meta")).select("doc_id", *(F.col(f"meta.{c}").alias(c) if c != "text" else F.col(c) for c in blocks.columns if c != "doc_id"))


def continues_on_next_page(text, page, next_text, next_page):
    """Whether a block's text goes on in the next block, which begins the next page."""
    a, b = T.strip(text), T.strip(next_text)
    fits = (a != "") & (b != "") & (page + 1 == next_page) & ~T.ends_with_any(a, ".!?:;")
    fits = fits & ~T.is_list_item(b) & ~T.begins_with_keyword(b) & ~T.is_heading_like(b)
    open_end = ~T.ends_with_any(a, ",;:—–") & ~T.begins_upper(b)
    return F.coalesce(fits & (a.endswith("-") | T.begins_lower(b) | open_end), F.lit(False))


def _pairs(rows: DataFrame, flag: str) -> DataFrame:
    """rows with role: 1 for the left and 2 for the right one of a pair, else 0; pairs are taken greedily from the left."""
    rows = rows.withColumn("n", F.row_number().over(in_order()))
    begin = F.max(F.when(~F.col(flag), F.col("n")).otherwise(0)).over(so_far())
    rows = rows.withColumn("left", F.col(flag) & ((F.col("n") - begin) % 2 == 1))
    after = F.coalesce(F.lag("left").over(in_order()), F.lit(False))
    return rows.withColumn("role", F.when(F.col("left"), 1).when(after, 2).otherwise(0)).drop("n", "left")


def reattach_pages(blocks: DataFrame) -> DataFrame:
    """Paragraphs cut by a page break as one block each, with pages; a block joins one other at most."""
    following = {"next_text": F.lead("text").over(in_order()), "next_page": F.lead("page").over(in_order())}
    rows = blocks.withColumns(following)
    rows = rows.withColumn("flag", continues_on_next_page(F.col("text"), F.col("page"), F.col("next_text"), F.col("next_page")))
    rows = _pairs(rows, "flag").where("role < 2")
    merged = F.when(F.col("role") == 1, T.join_halves(F.col("text"), F.col("next_text"))).otherwise(F.col("text"))
    pages = F.when(F.col("role") == 1, F.array("page", "next_page"))
    return rows.withColumns({"text": merged, "pages": pages}).drop("next_text", "next_page", "flag", "role")


def process(blocks: DataFrame, reattach: bool = False) -> DataFrame:
    """Raw blocks made ready for chunking: contents and headings of the raw text, cleaning, filters, merging, titles."""
    toc = contents_table(blocks)
    rows = carry_headings(blocks).withColumn("text", T.clean_text(F.col("text")))
    rows = merge_after_colon(drop_short(drop_margins(rows)))
    rows = add_titles(rows, toc)
    return reattach_pages(rows) if reattach else rows


def page_runs(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) from elements (doc_id, element_idx, page, text): runs of one page, elements without a page going with those before."""
    order = Window.partitionBy("doc_id").orderBy("element_idx")
    rows = elements.withColumn("filled", F.coalesce(F.last("page", ignorenulls=True).over(order), F.lit(1)))
    new = F.coalesce(F.lag("filled").over(order) != F.col("filled"), F.lit(True))
    rows = rows.withColumn("run", F.sum(new.cast("int")).over(order))
    text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("element_idx", "text"))), lambda s: s["text"]))
    return rows.groupBy("doc_id", "run").agg(text.alias("text")).withColumnRenamed("run", "page_no")
