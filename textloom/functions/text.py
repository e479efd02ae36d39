"""Text expressions that all stages share: white space as Unicode defines it, token estimates, normalisation, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: what Unicode's property says and the four information separators.
BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: White space within a line: ``BLANK`` without the ends of lines.
INLINE = r"[\x09\x1F\x20\xA0\u1680\u2000-\u200A\u202F\u205F\u3000]"
#: Ends of lines.
LINE_END = r"\r\n|[\x0A-\x0D\x1C-\x1E\x85\u2028\u2029]"
PREVIEW_CHARS = 200


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def lines(text: Column) -> Column:
    """The lines without their ends; a last empty one does not count."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def collapsed(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{BLANK}+", " "))


def normal_text(text: Column) -> Column:
    """Every line with single blanks, blank lines dropped. Three passes over the whole text, each linear in its length."""
    single = F.regexp_replace(text, f"{INLINE}+", " ")
    single = F.regexp_replace(single, r"(?: ?[\x0A-\x0D\x1C-\x1E\x85\u2028\u2029])+ ?", "\n")
    return F.regexp_replace(single, r"^[ \n]|[ \n]\z", "")


def normal_table(text: Column) -> Column:
    """Lines trimmed, blank lines dropped, inner spacing kept."""
    return F.array_join(F.filter(F.transform(lines(text), strip), lambda line: line != ""), "\n")


def normal_node(text: Column, node_type: Column) -> Column:
    return F.when(node_type == "table", normal_table(text)).otherwise(normal_text(text))


def token_count(text: Column, trimmed: bool = False) -> Column:
    """A token for every four characters begun; blank texts have none."""
    bare = text if trimmed else strip(text)
    return F.floor((F.length(bare) + 3) / 4).cast("long")


def preview(text: Column) -> Column:
    flat = strip(F.replace(text, F.lit("\n"), F.lit(" ")))
    cut = F.regexp_replace(F.left(flat, F.lit(PREVIEW_CHARS)), f"{BLANK}+$", "")
    return F.when(F.length(flat) > PREVIEW_CHARS, F.concat(cut, F.lit("..."))).otherwise(flat)


def decoded(content: Column) -> Column:
    """UTF-8 with malformed bytes dropped; a genuine U+FFFD goes with them. A byte-order mark stays."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def data_url(mime: Column, content: Column) -> Column:
    # Spark's base64 may break lines; a URL may not
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))
