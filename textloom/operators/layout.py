"""Page layout: reading order, overlap, roles, merging of text blocks, repeated margins, image regions.

Input rows are blocks: doc_id, page_no, block_no, x0, y0, x1, y1, text, and page_width, page_height where roles are asked.
Everything is keyed by page, so one exchange on (doc_id, page_no) serves a chain of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .lines import ITEM_ROW, page_heading

PAGE = ["doc_id", "page_no"]
BOX = ["x0", "y0", "x1", "y1"]
MARGIN, ROW_HEIGHT, NOISE_CHARS = 0.12, 12.0, 100
LEAST_IMAGE, LEAST_BLANK_IMAGE = 0.01, 0.03
#: Page numbers and ends of complete paragraphs.
PAGE_NUMBER = r"(?i)^(?:page\s*\d+|第\s*\d+\s*页|\d+\s*/\s*\d+)$"
PARAGRAPH_END = "[。！？!?；;：:]$"


def column_order(blocks: DataFrame) -> DataFrame:
    """Adds ``place`` (from 0): left column first, then rows of 12 points, then x; blank blocks last; ties by block_no, then x1 and y1.

    The columns part at the upper median of the centres of non-blank blocks. Pages of blank blocks only are dropped.
    """
    page = Window.partitionBy(*PAGE)
    centre, full = (F.col("x0") + F.col("x1")) / 2, strip(F.col("text")) != ""
    centres = F.array_sort(F.collect_list(F.when(full, centre)).over(page))
    middle = F.element_at(centres, (F.floor(F.size(centres) / 2) + 1).cast("int"))
    kept = blocks.withColumn("middle", F.when(F.size(centres) > 0, middle)).where("middle IS NOT NULL")
    key = [F.when(~full, 99).when(centre <= F.col("middle"), 0).otherwise(1), F.when(full, F.bround(F.col("y0") / ROW_HEIGHT)).otherwise(99), F.when(full, F.col("x0")).otherwise(99)]
    order = Window.partitionBy(*PAGE).orderBy(*key, "block_no", "x1", "y1")
    return kept.withColumn("place", (F.row_number().over(order) - 1).cast("long")).drop("middle")


def overlaps(a: str, b: str) -> Column:
    """Strictly: boxes that only touch do not overlap."""
    c = lambda side, name: F.col(f"{side}.{name}")
    return (c(a, "x0") < c(b, "x1")) & (c(a, "x1") > c(b, "x0")) & (c(a, "y0") < c(b, "y1")) & (c(a, "y1") > c(b, "y0"))


def without_overlap(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks that overlap no table of their page."""
    same = (F.col("b.doc_id") == F.col("t.doc_id")) & (F.col("b.page_no") == F.col("t.page_no"))
    return blocks.alias("b").join(tables.select(*PAGE, *BOX).alias("t"), same & overlaps("b", "t"), "left_anti")


def role(y0: Column, y1: Column, page_height: Column) -> Column:
    return F.when(y1 <= page_height * MARGIN, "header_zone").when(y0 >= page_height * (1 - MARGIN), "footer_zone").otherwise("body")


def is_cjk(char: Column) -> Column:
    return char.between("\u4e00", "\u9fff")


def joined_text(left: Column, right: Column) -> Column:
    """A hyphen before a letter or digit goes, CJK characters meet, others get a blank between them."""
    a, b = F.rtrim(left), F.ltrim(right)
    last, first = F.right(a, F.lit(1)), F.left(b, F.lit(1))
    return (
        F.when(a == "", b).when(b == "", a)
        .when((last == "-") & first.rlike(r"^[\p{L}\p{N}]"), F.concat(F.left(a, F.length(a) - 1), b))
        .when(is_cjk(last) & is_cjk(first), F.concat(a, b))
        .otherwise(F.concat(a, F.lit(" "), b))
    )


def _joins(a: Column, b: Column) -> Column:
    gap = b["y0"] - a["y1"]
    height = F.least(F.greatest(a["y1"] - a["y0"], F.lit(1.0)), F.greatest(b["y1"] - b["y0"], F.lit(1.0)))
    aligned = (F.abs(a["x0"] - b["x0"]) <= 18) | (F.abs(a["x1"] - b["x1"]) <= 48)
    body = (a["node_type"] == "paragraph") & (b["node_type"] == "paragraph") & (a["role"] == "body") & (b["role"] == "body")
    flows = ~b["heading"] & ~b["item"] & ~strip(a["text"]).rlike(PARAGRAPH_END) & (strip(a["text"]) != "") & (strip(b["text"]) != "")
    return body & (gap >= -2) & (gap <= F.greatest(F.lit(18.0), height * 1.6)) & aligned & flows


def merged_paragraphs(nodes: DataFrame) -> DataFrame:
    """Folds each page's nodes (doc_id, page_no, place, node_type, role, box, text): a paragraph takes in the next if it flows on.

    The box of what has been joined grows, so each decision needs the one before: a fold over the page's sorted array.
    """
    node = F.struct("place", "node_type", "role", *BOX, "text", page_heading(F.col("text")).alias("heading"), strip(F.col("text")).rlike(ITEM_ROW).alias("item"))
    pages = nodes.groupBy(*PAGE).agg(F.array_sort(F.collect_list(node)).alias("nodes"))

    def step(done: Column, b: Column) -> Column:
        a = F.element_at(done, -1)
        grown = F.struct(
            a["place"].alias("place"), a["node_type"].alias("node_type"), a["role"].alias("role"),
            F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"),
            joined_text(a["text"], b["text"]).alias("text"), a["heading"].alias("heading"), a["item"].alias("item"),
        )
        return F.when(_joins(a, b), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(b)))

    folded = F.aggregate(F.slice("nodes", 2, F.greatest(F.size("nodes") - 1, F.lit(0))), F.slice("nodes", 1, 1), step)
    return pages.select(*PAGE, F.explode(folded).alias("n")).select(*PAGE, "n.place", "n.node_type", "n.role", *[f"n.{c}" for c in BOX], "n.text")


def without_noise(nodes: DataFrame, role_col: str | None = "role") -> DataFrame:
    """Drops page numbers, and texts of at most 100 characters that a document repeats in its margins (or without a role)."""
    bare = strip(F.col("text"))
    short = (bare != "") & (F.length(bare) <= NOISE_CHARS)
    margin = F.lit(True) if role_col is None else (F.col(role_col).isNull() | F.col(role_col).isin("header_zone", "footer_zone"))
    keyed = nodes.withColumn("noise_key", F.when(short, bare))
    counted = keyed.withColumn("repeats", F.count("noise_key").over(Window.partitionBy("doc_id", "noise_key")))
    return counted.where(~((F.col("repeats") >= 2) & margin)).where(~bare.rlike(PAGE_NUMBER)).drop("noise_key", "repeats")


def area_share() -> Column:
    area = F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(0.0))
    return area / F.greatest(F.col("page_width") * F.col("page_height"), F.lit(1.0))


def image_regions(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, page_no, order, box, strategy: image blocks of at least 1% of the page that are on no table.

    Their order counts from 0 by block_no; blocks with one number go from the top, then from the left, then the smaller first.
    Where a page has none, its blank or ``<image:`` blocks of at least 3%; their order is the block's number.
    """
    typed = without_overlap(blocks.where((F.col("block_type") == 1) & (area_share() >= LEAST_IMAGE)), tables)
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("block_no", "y0", "x0", "y1", "x1")) - 1
    typed = typed.select(*PAGE, order.cast("long").alias("order"), *BOX, F.lit("pdf_image_region").alias("strategy"))
    bare = F.lower(strip(F.coalesce("text", F.lit(""))))
    guess = blocks.where(((bare == "") | bare.startswith("<image:")) & (area_share() >= LEAST_BLANK_IMAGE))
    guess = without_overlap(guess, tables).join(typed.select(*PAGE).distinct(), PAGE, "left_anti")
    return typed.unionByName(guess.select(*PAGE, F.col("block_no").cast("long").alias("order"), *BOX, F.lit("pdf_image_region_heuristic").alias("strategy")))


def reading_order(texts: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """The union of a page's nodes (doc_id, page_no, y0, x0, order, text), sorted by y, x and order; a missing box is last."""
    far = F.lit(1e9)
    parts = [df.select(*PAGE, "y0", "x0", "order", "text", F.lit(k).alias("rank")) for k, df in enumerate((texts, tables, images))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    w = Window.partitionBy(*PAGE).orderBy(F.coalesce("y0", far), F.coalesce("x0", far), F.coalesce("order", F.lit(0)), "rank", "text")
    return rows.withColumn("place", (F.row_number().over(w) - 1).cast("long")).drop("rank")
