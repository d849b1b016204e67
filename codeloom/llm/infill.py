"""Fill-in-middle by a two-pass streaming matcher.

The first pass over a text counts the matches of a unit pattern; the second advances a lazy iterator of matches to both
ranks and stops there. No array of units is stored: beside the text a row needs a counter and a match. Only offsets leave
Python; outputs are put together, and taken apart again, by built-in functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_POINT = "(?s:.)"
MARKS = ("<P>", "<S>", "<M>")  # fixed: before the prefix, the suffix and the middle
PLAIN_FROM = 90  # of 100: from here on texts stay as they are
SPM_BELOW = 20  # of 100: below this the suffix comes first


def count_units(text: str, unit: re.Pattern) -> int:
    n = 0
    for n, _ in enumerate(unit.finditer(text), 1):
        pass
    return n


def cuts(text: str, unit: re.Pattern, low: int, high: int) -> tuple[int, int]:
    """Where units number ``low`` and ``high`` (from 1, low <= high) end; 0 for number 0."""
    found, ends, at = unit.finditer(text), [], 0
    for rank in (low, high):
        step = next(islice(found, rank - at - 1, None)) if rank > at else None
        ends.append(step.end() if step else (ends[-1] if ends else 0))
        at = rank
    return ends[0], ends[1]


def _matcher(pattern: str):
    unit = re.compile(pattern)

    @F.pandas_udf("n long, first_end long, second_end long")
    def match(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, a, b, plain in batches:
            rows = []
            for text, x, y, stays in zip(texts, a, b, plain, strict=True):
                n = count_units(text, unit)
                low, high = sorted((int(x) % (n + 1), int(y) % (n + 1)))
                rows.append((n, *((0, 0) if stays else cuts(text, unit, low, high))))
            yield pd.DataFrame(rows, columns=["n", "first_end", "second_end"])

    return match


def draws(key: Column, seed: str = "1:") -> list[Column]:
    """Four numbers of 32 bits for a row, from the SHA-256 of the seed and the key as text."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, unit: str = CODE_POINT, seed: str = "1:") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of each row of ``docs`` (doc_id, text).

    ``n`` counts matches of ``unit``; the prefix ends with one match and the middle with another, drawn from the row's id. A text
    that is empty or null, or that holds a mark, stays plain, as one in ten does anyway; lengths are code points, null if
    plain. Every row gives one row: repeated rows give equal ones, a null id draws like the empty key, an empty table
    gives an empty one. Other columns are ignored.
    """
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = F.coalesce("text", F.lit(""))
    held = F.lit(False)
    for mark in MARKS:
        held = held | text.contains(mark)
    plain = (text == "") | held | (h3 % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(h4 % 100 < SPM_BELOW, "spm").otherwise("psm")
    rows = docs.select("doc_id", text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    rows = rows.withColumn("m", _matcher(unit)("text", "h1", "h2", F.col("form") == "plain"))
    a, b = F.col("m.first_end").cast("int"), F.col("m.second_end").cast("int")
    prefix, middle, suffix = F.col("text").substr(F.lit(1), a), F.col("text").substr(a + 1, b - a), F.col("text").substr(b + 1, F.length("text"))
    p, s, m = (F.lit(mark) for mark in MARKS)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    shown = lambda c: F.when(F.col("form") != "plain", c)
    return rows.select("doc_id", "m.n", "form", shown(F.col("m.first_end")).alias("prefix_chars"), shown(F.col("m.second_end") - F.col("m.first_end")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A transformed text holds each mark once: it had none, and none can arise where
    a part meets a mark."""
    parts = F.split(output, "|".join(MARKS))
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    whole = lambda f: F.concat(*(F.get(parts, F.lit(i)) for i in order[f]))
    return F.when(form == "psm", whole("psm")).when(form == "spm", whole("spm")).otherwise(output)
