"""Statement text: comments, normal form, forbidden words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"--|/-|-/|\n|[^-/\n]+|.", re.S)


def blank_comments(text: str | None) -> str | None:
    """Line comments and nested block comments as spaces, line feeds kept, every place unchanged."""
    if text is None or ("--" not in text and "/-" not in text):
        return text
    out, depth, line = [], 0, False
    for token in _TOKEN.findall(text):
        if token == "\n":
            line = False
            out.append(token)
        elif line:
            out.append(" " * len(token))
        elif depth == 0 and token == "--":
            line = True
            out.append("  ")
        elif token == "/-" or (token == "-/" and depth):
            depth += 1 if token == "/-" else -1
            out.append("  ")
        elif depth and token == "--":  # within a block: the second dash may close it
            out.append("  ")
        else:
            out.append(" " * len(token) if depth else token)
    return "".join(out)


def strip_comments(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(blank_comments)

    return F.when(text.contains("--") | text.contains("/-"), run(text)).otherwise(text)


def squeezed(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[ \t\n\r\x0b\x0c]+", " "))


def first_forbidden(text: Column, tokens: list[str]) -> Column:
    """The first of the tokens, in their order, that stands in the text as a whole word."""
    return F.coalesce(*[F.when(text.rlike(rf"(?U)(?<![\w.']){re.escape(t)}(?![\w'])"), F.lit(t)) for t in tokens])


def length_group(lines: Column) -> Column:
    return F.when(lines <= 1, "1").when(lines <= 3, "2-3").when(lines <= 7, "4-7").otherwise("8+")
