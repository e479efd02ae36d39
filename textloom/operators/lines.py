"""Lines of text to typed nodes, relationally: one exchange on the document, gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK, LINE_END, normal_node, strip

#: How rows of the formats begin.
HEADING = rf"^(#{{1,6}}){BLANK}+(.*)$"
LIST_ROW = rf"^{BLANK}*(?:[-*+]|(?U:\d)+[.)]){BLANK}+."
#: List rows and headings of office and page texts.
ITEM_ROW = rf"^{BLANK}*(?:[-*+•●]|(?U:\d)+[.)]|（(?U:\d)+）){BLANK}+"
NUMBERED = r"第[一二三四五六七八九十百千万\d]+[章节部分篇]|[一二三四五六七八九十]+[、.]|(?U:\d)+(?:\.(?U:\d)+){0,3}[、.]?"
SENTENCE_MARKS = "[。！？!?；;，,]"
OFFICE_HEADING_CHARS, PAGE_HEADING_CHARS, BARE_HEADING_CHARS = 24, 28, 12


def pipes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))


def line_class(line: Column) -> Column:
    bare = strip(line)
    return (
        F.when(bare.rlike(HEADING), "title")
        .when(pipes(bare) >= 2, "table")
        .when(bare.rlike(LIST_ROW), "list")
        .when(bare == "", "blank")
        .otherwise("paragraph")
    )


def line_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), raw, class."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, LINE_END)).alias("line_no", "raw"))
    return rows.withColumn("class", line_class(F.col("raw")))


def ordered_text(rows_text: Column, order: Column, joiner: str) -> Column:
    """The texts of a group in their order."""
    ordered = F.array_sort(F.collect_list(F.struct(order.alias("o"), rows_text.alias("t"))))
    return F.array_join(F.transform(ordered, lambda x: x["t"]), joiner)


def islands(lines: DataFrame, class_col: str = "class") -> DataFrame:
    """Numbers the runs of lines of one class; a title is a run of its own; blank lines are dropped."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    before = F.lag(class_col).over(w)
    change = before.isNull() | (before != F.col(class_col)) | (F.col(class_col) == "title")
    return lines.withColumn("run", F.sum(change.cast("int")).over(w)).where(F.col(class_col) != "blank")


def nodes(lines: DataFrame) -> DataFrame:
    """doc_id, node_pos, node_type, level, text: one row per island of lines."""
    runs = islands(lines).groupBy("doc_id", "run").agg(
        F.first("class").alias("node_type"), strip(ordered_text(F.col("raw"), F.col("line_no"), "\n")).alias("body")
    )
    title = F.col("node_type") == "title"
    numbered = F.row_number().over(Window.partitionBy("doc_id").orderBy("run")) - 1
    return runs.select(
        "doc_id",
        numbered.alias("node_pos"),
        "node_type",
        F.when(title, F.length(F.regexp_extract("body", HEADING, 1))).otherwise(0).alias("level"),
        F.when(title, strip(F.regexp_extract("body", HEADING, 2))).otherwise(F.col("body")).alias("text"),
    )


def normalised(nodes_: DataFrame) -> DataFrame:
    """Texts normalised, empty nodes dropped, title levels at least 1; positions keep their order."""
    level = F.when(F.col("node_type") == "title", F.greatest(F.col("level"), F.lit(1))).otherwise(F.col("level"))
    return nodes_.withColumn("text", normal_node(F.col("text"), F.col("node_type"))).withColumn("level", level).where("text <> ''")


# -- other formats' line rules ----------------------------------------------------------------------------------------


def office_heading(text: Column) -> Column:
    """A short line without sentence marks that is one run of characters after an optional number."""
    bare = strip(text)
    short = (F.length(bare) > 0) & (F.length(bare) <= OFFICE_HEADING_CHARS)
    return short & ~bare.rlike(SENTENCE_MARKS) & ~bare.rlike(ITEM_ROW) & bare.rlike(rf"^(?:{NUMBERED})?{BLANK}*\S+$")


def page_heading(text: Column) -> Column:
    """One short line of few words that is no list row, address, amount or sentence, and numbered or very short."""
    bare = strip(text)
    plain = ~bare.rlike(LINE_END) & ~bare.rlike(ITEM_ROW) & ~bare.rlike(r"[@|]|\d{4}\.\d{2}|\d{11}") & ~bare.rlike(SENTENCE_MARKS)
    blanks = F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit("")))
    small = (F.length(bare) > 0) & (F.length(bare) <= PAGE_HEADING_CHARS) & (blanks <= 3)
    return plain & small & (bare.rlike(rf"^(?:{NUMBERED}){BLANK}*\S+") | (F.length(bare) <= BARE_HEADING_CHARS))


def page_node_type(text: Column) -> Column:
    bare = strip(text)
    return F.when(pipes(bare) >= 2, "table").when(bare.rlike(ITEM_ROW), "list").when(page_heading(bare), "title").otherwise("paragraph")


def office_line_class(line: Column) -> Column:
    """Blank before list before heading before paragraph."""
    bare = strip(line)
    return F.when(bare == "", "blank").when(bare.rlike(ITEM_ROW), "list").when(office_heading(bare), "title").otherwise("paragraph")


def office_nodes(lines: DataFrame) -> DataFrame:
    """Nodes of extracted office text: list rows keep their lines, paragraph lines are joined by a blank."""
    classed = lines.withColumn("class", office_line_class(F.col("raw")))
    runs = islands(classed).withColumn("bare", strip(F.col("raw"))).groupBy("doc_id", "run").agg(
        F.first("class").alias("node_type"),
        ordered_text(F.col("bare"), F.col("line_no"), "\n").alias("stacked"),
        ordered_text(F.col("bare"), F.col("line_no"), " ").alias("flowing"),
    )
    numbered = F.row_number().over(Window.partitionBy("doc_id").orderBy("run")) - 1
    return runs.select(
        "doc_id", numbered.alias("node_pos"), "node_type", F.when(F.col("node_type") == "title", 1).otherwise(0).alias("level"),
        F.when(F.col("node_type") == "paragraph", F.col("flowing")).otherwise(F.col("stacked")).alias("text"),
    )
