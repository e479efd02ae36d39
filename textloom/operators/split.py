"""Splitting of long texts: the fixed-pass form in expressions, hard windows, packing of spans and of nodes, overlap."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, token_count
from ..options import ChunkOptions
from . import kernel

SPANS = "array<struct<text:string,start:int,end:int>>"


def _pass(spans: Column, separator: str, most: int) -> Column:
    """Splits every span over the budget at one separator, which stays on the left part."""

    def parts(text: Column) -> Column:
        raw = F.split(text, rf"\Q{separator}\E", -1)
        n = F.size(raw)
        kept = F.transform(raw, lambda part, i: F.when(i < n - 1, F.concat(part, F.lit(separator))).otherwise(part))
        return F.filter(F.transform(kept, strip), lambda part: part != "")

    def one(text: Column) -> Column:
        cut = parts(text)
        return F.when((F.length(text) > 4 * most) & F.contains(text, F.lit(separator)), F.when(F.size(cut) > 1, cut).otherwise(F.array(text))).otherwise(F.array(text))

    return F.flatten(F.transform(spans, one))


def separator_parts(text: Column, most: int) -> Column:
    """Texts of the recursive split as sixteen fixed passes. A text without any separator stays over the budget."""
    spans = F.filter(F.array(strip(text)), lambda t: t != "")
    for separator in kernel.SEPARATORS:
        spans = _pass(spans, separator, most)
    return spans


def split_spans(rows: DataFrame, text: str, options: ChunkOptions = ChunkOptions(), out: str = "spans", stage: str = "overlap", base: str | None = None) -> DataFrame:
    """Adds an array of spans (text, start, end) up to a stage: separate (at separators only), windows (hard ones only), pack or
    overlap. Places count from the column ``base`` where the text begins there. Arrow: the measured hot path."""
    names = rows.columns
    count, most = kernel.estimate, options.max_tokens

    def one(value: str | None, begin: int | None) -> list[dict]:
        value, begin = value or "", begin or 0
        if stage == "windows":
            return [{"text": s.text, "start": begin + s.start, "end": begin + s.end} for s in kernel.hard_windows(value, most, count)]
        spans = kernel.recursive_split(value, most, count, windows=stage != "separate")
        if stage != "separate":
            spans = kernel.packed(spans, most, count)
        if stage == "overlap":
            spans = kernel.overlapped(spans, value, options, count)
        return [{"text": s.text, "start": begin + s.start, "end": begin + s.end} for s in spans]

    kind = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            begins = batch.column(base).to_pylist() if base else [0] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(one, batch.column(text).to_pylist(), begins), kind)], names=[*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{out}` {SPANS}")


def window_widths(length: int, most: int) -> list[int]:
    """Widths of the windows that cut a text without blanks of this length: arithmetic on what remains."""
    widths, left = [], length
    while left > 0:
        widths.append(next(w for w in kernel.shrinking(min(left, max(32, 6 * most))) if w <= 4 * most or w == 1))
        left -= widths[-1]
    return widths


def pack_numbers(sizes: Iterable[int], most: int) -> list[int]:
    """The pack number of every item: a new pack where the running sum would pass ``most``."""
    packs, pack, held = [], -1, 0
    for n in sizes:
        pack, held = (pack, held + n) if pack >= 0 and held + n <= most else (pack + 1, n)
        packs.append(pack)
    return packs


def hard_windows(length: Column, most: int) -> Column:
    """``window_widths`` of each row. Arrow: an expression would copy its result at every window."""

    @F.pandas_udf("array<int>")
    def widths(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda n: window_widths(int(n), most))

    return widths(length)


def pack_groups(sizes: Column, most: int) -> Column:
    """``pack_numbers`` of each row's items. Arrow, for the same reason."""

    @F.pandas_udf("array<int>")
    def packs(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: pack_numbers(map(int, row), most))

    return packs(sizes)


def overlap_chars(text: Column, options: ChunkOptions) -> Column:
    """Characters drawn back from the next span; 0 without overlap."""
    if options.overlap_tokens > 0:
        tokens = F.lit(options.overlap_tokens)
    elif options.overlap_ratio > 0:
        tokens = F.greatest(F.lit(1), F.floor(token_count(text) * options.overlap_ratio))
    else:
        return F.lit(0)
    return F.greatest(F.lit(8), tokens * 4).cast("int")
