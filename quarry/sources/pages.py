"""Page sources: block trees, page discovery and tables, over DataFrames of pages and blocks. A block's place is its path
of positions, so that order survives any partitioning. Trees are walked a level a round; each level is a join with what
the level before found, written so that no round repeats another, and of any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.text import strip
from quarry.storage import written


def _union(levels: list[DataFrame]) -> DataFrame:
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return whole


def flatten_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of each page in depth-first order: page_id, pos, block_id, type, depth. blocks: page_id, block_id,
    parent_id (null at the top), position, type. Child pages are listed, not entered; rows of a table stay in it."""
    below = blocks.filter("parent_id IS NOT NULL").select("page_id", F.col("parent_id").alias("above"), F.col("block_id").alias("own"), F.col("position").alias("place"), F.col("type").alias("kind"))
    level = blocks.filter("parent_id IS NULL").select("page_id", "block_id", "type", F.lit(0).alias("depth"), F.array("position").alias("path"))
    levels = []
    while not levels or not level.isEmpty():
        level = written(level, "blocks")
        levels.append(level)
        entered = level.filter("type NOT IN ('child_page', 'table')").withColumnRenamed("block_id", "above")
        level = entered.join(below, ["page_id", "above"]).select("page_id", F.col("own").alias("block_id"), F.col("kind").alias("type"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("place")).alias("path"))
    order = W.partitionBy("page_id").orderBy("path")
    return _union(levels).select("page_id", F.row_number().over(order).alias("pos"), "block_id", "type", "depth")


def child_page_ids(blocks: DataFrame) -> DataFrame:
    """parent_id (a page), child_id and pos: the child pages anywhere in a page's blocks, without entering them. blocks as
    for flatten_blocks; a child page's block has the child's page id. Tables are entered here."""
    entered = blocks.withColumn("type", F.when(F.col("type") == "table", "block").otherwise(F.col("type")))
    return flatten_blocks(entered).filter("type = 'child_page'").select(F.col("page_id").alias("parent_id"), F.col("block_id").alias("child_id"), "pos")


def child_pages(roots: DataFrame, children: DataFrame) -> DataFrame:
    """All pages under the roots: page_id, source_id, source_name, depth. A page keeps its first discovery (least depth,
    then path) and inherits the source of the page above. Breadth first: a page that an earlier level has is not entered
    again, so every page and link is met once, however many paths lead there."""
    first = W.partitionBy("page_id").orderBy("path")
    level = roots.select("page_id", "source_id", "source_name", F.lit(0).alias("depth"), F.array("page_id").alias("path"))
    levels: list[DataFrame] = []
    while True:
        level = level.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
        if levels:
            level = level.join(_union([x.select("page_id") for x in levels]), "page_id", "left_anti")
        level = written(level, "pages")
        if levels and level.isEmpty():
            break
        levels.append(level)
        level = level.withColumnRenamed("page_id", "parent_id").join(children.select("parent_id", "child_id"), "parent_id")
        level = level.select(F.col("child_id").alias("page_id"), "source_id", "source_name", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("child_id")).alias("path"))
    return _union(levels).select("page_id", "source_id", "source_name", "depth")


def standalone_pages(pages: DataFrame) -> DataFrame:
    """page_id, parent_type, parent_id of listed pages (id, parent: a map with `type` and, under the type's name, the id).
    The parent's id is null where the map has none."""
    kind = F.try_element_at("parent", F.lit("type"))
    return pages.filter("id IS NOT NULL").select(F.col("id").alias("page_id"), kind.alias("parent_type"), F.try_element_at("parent", kind).alias("parent_id"))


def load_pages(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Discovered pages (page_id, ...) with the columns of pages (page_id, ...); those that cannot be loaded are dropped."""
    return found.join(pages, "page_id")


def first_discovery(*found: DataFrame) -> DataFrame:
    """Union of discoveries (page_id, pos, ...): for each page the first, by the order of the arguments, then pos."""
    whole = None
    for i, df in enumerate(found):
        df = df.withColumn("discovery", F.lit(i))
        whole = df if whole is None else whole.unionByName(df, allowMissingColumns=True)
    order = W.partitionBy("page_id").orderBy("discovery", "pos")
    return whole.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def rich_text(parts: Column) -> Column:
    return strip(F.array_join(parts, ""))


def table_line(cells: Column) -> Column:
    """A row of a table as a pipe line; cells are arrays of text parts."""
    return F.when(F.size(cells) > 0, F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(rich_text(c), F.lit(""))), " | "), F.lit(" |")))


def block_lines(blocks: DataFrame) -> DataFrame:
    """One line a block with text: page_id, pos, line. blocks: page_id, pos, type, text. Numbers of numbered items count
    through the whole page."""
    shown = blocks.withColumn("text", strip(F.col("text"))).filter("text <> ''")
    upto = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    number = F.sum((F.col("type") == "numbered_list_item").cast("int")).over(upto)
    prefix = {"heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "bulleted_list_item": "- ", "quote": "> ", "callout": "💡 "}
    line = F.when(F.col("type") == "numbered_list_item", F.concat(number.cast("string"), F.lit(". "), F.col("text")))
    line = line.when(F.col("type") == "code", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```")))
    for kind, before in prefix.items():
        line = line.when(F.col("type") == kind, F.concat(F.lit(before), F.col("text")))
    return shown.select("page_id", "pos", line.otherwise(F.col("text")).alias("line"))


def markdown(lines: DataFrame) -> DataFrame:
    """page_id and the page's lines joined by line feeds."""
    return lines.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content"))
