"""Readable rendering of features, and text statistics."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


@dataclass(frozen=True)
class Wording:
    """How a feature reads: its label, the format of its number and a word for each side of a limit.

    Without a format the word stands in place of the number, else in brackets behind it. A value equal to the limit
    takes the ``low`` word where ``low_at_limit`` is set, else the ``high`` one.
    """

    label: str
    number: str | None
    limit: float | None = None
    low: str = ""
    high: str = ""
    low_at_limit: bool = False


# Labels, formats, limits and words of the features that have a wording of their own.
WORDINGS = {
    "iat_cv": Wording("interval CV", ".2f", 0.15, "highly regular", "irregular"),
    "resp_bytes_is_zero": Wording("response bytes", None, 0.5, "nonzero", "0", low_at_limit=True),
    "dest_fanin": Wording("destination fan-in", ".0f"),
    "periodicity_score": Wording("periodicity score", ".2f"),
    "orig_resp_byte_ratio": Wording("upload/download ratio", ".1f"),
}
# Format of all other numbers, separator of the parts.
OTHER_NUMBER = ".3g"
SEPARATOR = " · "


@F.pandas_udf(ArrayType(StringType()))
def numbers(formats: pd.Series, values: pd.Series) -> pd.Series:
    """Each value in its format.

    Python's number formats (significant digits, ties on the binary value) have no counterpart among the built-in
    functions, hence the Arrow UDF; all other text is put together by expressions.
    """
    return pd.Series([[format(x, f) for f, x in zip(row, v)] for row, v in zip(formats, values)], dtype=object)


def _remark(value: Column, wording: Wording) -> Column:
    low = value <= wording.limit if wording.low_at_limit else value < wording.limit
    word = F.when(low, wording.low).otherwise(wording.high)
    return word if wording.number is None else F.concat(F.lit(" ("), word, F.lit(")"))


def _part(name: Column, value: Column, number: Column) -> Column:
    """Label, number and remark of one feature."""
    text = F.concat_ws(" ", F.replace(name, F.lit("_"), F.lit(" ")), number)
    for feature, w in WORDINGS.items():
        pieces = [F.lit(w.label + " ")] + ([number] if w.number else []) + (
            [_remark(value, w)] if w.limit is not None else [])
        text = F.when(name == feature, F.concat(*pieces)).otherwise(text)
    return text


def sentence(names: Column | str, values: Column | str) -> Column:
    """Features and values of each row as one line."""
    names, values = (F.col(c) if isinstance(c, str) else c for c in (names, values))
    known = F.create_map(*[F.lit(x) for feature, w in WORDINGS.items() for x in (feature, w.number or OTHER_NUMBER)])
    formats = F.transform(names, lambda n: F.coalesce(F.element_at(known, n), F.lit(OTHER_NUMBER)))
    entries = F.arrays_zip(names.alias("name"), values.alias("value"), numbers(formats, values).alias("number"))
    return F.array_join(F.transform(entries, lambda e: _part(e["name"], e["value"], e["number"])), SEPARATOR)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; a letter's count is what its removal takes away."""
    size = F.length(text)

    def part(letter: Column) -> Column:
        share = (size - F.length(F.replace(text, letter, F.lit("")))) / size
        return share * F.log2(share)

    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.coalesce(F.when(size > 0, F.aggregate(
        letters, F.lit(0.0), lambda total, c: total - part(c))), F.lit(0.0))
