"""Text normalization as Column functions.

Everything is native but Unicode normalization, which Spark lacks: `normalize_column`
sends only texts with a character beyond ASCII through an Arrow UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.session import slices

#: Fixed values. White space as Python has it, for Java and RE2 alike; what is removed; quotes that are folded.
WS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
INVISIBLE = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
H_SPACE = rf"[{WS.replace(r'\t-\r', r'\t\x0b-\r')}]+"
BLANK_LINES = rf"\n[{WS}]*\n[{WS}]*\n+"
QUOTES_FROM = "‘’‚‛′“”„‟″"
QUOTES_TO = "'" * 5 + '"' * 5
LETTER = r"\p{L}\p{Nl}\p{No}"
#: The same for Java, which tries the members of a class one by one: a wide range first spares most characters the rest, and what is as it should be is no match.
_REMOVED = rf"[[\x00-\x1f&&[^\t\n\r]]\x7f-\x9f[\x{{200b}}-\x{{feff}}&&{INVISIBLE}]]+"
_SINGLE, _DOUBLE = r"[\x{2018}-\x{201b}\x{2032}]", r"[\x{201c}-\x{201f}\x{2033}]"
_ODD_SPACE = r"\t\x0b-\r\x1c-\x1f[\x85-\x{3000}&&[\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
_H_SPACES = rf" [ {_ODD_SPACE}]++|[{_ODD_SPACE}][ {_ODD_SPACE}]*+"
#: What any step of the chain would change, but for the ends of the text.
_UNTIDY = rf"[[\x00-\x1f&&[^\n]]\x7f-\xa0[\x{{1680}}-\x{{feff}}&&[{INVISIBLE}{_SINGLE}{_DOUBLE}{_ODD_SPACE}]]]| [ \n]|\n(?: |\n\n)"
_LINE_ENDS = r" +\n *|\n +"
_ANY_SPACES = rf" [{WS}]++|[[\t-\r\x1c-\x1f][\x85-\x{{3000}}&&[{WS}]]][{WS}]*+"
NO_LETTERS = r"[\x00-@\[-`{-\xa9[\x{aa}-\x{10ffff}&&\P{L}]]+"
FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def strip_invisible(c: Column) -> Column:
    """Without zero-width, bidi and control characters; tab and line ends stay."""
    return F.regexp_replace(c, _REMOVED, "")


def fold_quotes(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, _SINGLE, "'"), _DOUBLE, '"')


def collapse_whitespace(c: Column) -> Column:
    """One space for each run of horizontal space, one blank line for more; lines and the whole are stripped.

    After the first step the only spaces are U+0020 and line ends, so lines can be
    stripped by pattern.
    """
    c = F.regexp_replace(c, _H_SPACES, " ")
    c = F.regexp_replace(c, BLANK_LINES, "\n\n")
    return F.btrim(F.regexp_replace(c, _LINE_ENDS, "\n"), F.lit(" \n"))


def unicode_form(form: str):
    """Arrow UDF for a Unicode normalization form."""
    if form not in FORMS:
        raise ValueError(f"unknown Unicode form {form!r}; use one of {', '.join(FORMS)}")

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return apply


def normalize_native(c: Column, quotes: bool = True) -> Column:
    """The whole chain but for the Unicode form: exact for texts that are already in it."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c.rlike(_UNTIDY), _tidied(strip_invisible(c), quotes)).otherwise(F.btrim(c, F.lit(" \n")))


def _in_form(df: DataFrame, form: str) -> DataFrame:
    """``df`` with its last column in a Unicode form, some rows of a batch at a time, so that no worker holds a batch's texts twice."""

    def work(batches):
        for batch in slices(batches):
            texts = pa.array([unicodedata.normalize(form, t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], batch.schema.names)

    return df.mapInArrow(work, df.schema)


def _tidied(c: Column, quotes: bool) -> Column:
    return collapse_whitespace(fold_quotes(c) if quotes else c)


def normalize_column(df: DataFrame, text: str = "text", out: str | None = None, form: str = "NFKC", quotes: bool = True) -> DataFrame:
    """``df`` with ``text`` normalized into ``out``.

    A Python UDF inside ``when`` would run for every row, so rows are split: ASCII
    texts are stable under every form and never leave the JVM.
    """
    out = out or text
    if form not in FORMS:
        raise ValueError(f"unknown Unicode form {form!r}; use one of {', '.join(FORMS)}")
    stripped = df.withColumn("__n", strip_invisible(F.coalesce(F.col(text), F.lit(""))))
    ascii_ = F.col("__n").rlike(r"^\p{ASCII}*+$")
    finish = lambda c: F.when(c.rlike(_UNTIDY), _tidied(c, quotes)).otherwise(F.btrim(c, F.lit(" \n")))
    plain = stripped.filter(ascii_).withColumn(out, finish(F.col("__n"))).drop("__n")
    other = _in_form(stripped.filter(~ascii_), form).withColumn(out, finish(F.col("__n"))).drop("__n")
    return plain.unionByName(other)


def casefold(c: Column) -> Column:
    """Case folding for the characters that occur in running text: lower case, sharp s, final sigma."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def one_space(c: Column) -> Column:
    """One space for each run of white space."""
    return F.regexp_replace(c, _ANY_SPACES, " ")


def only_letters(c: Column) -> Column:
    return F.regexp_replace(c, NO_LETTERS, "")


def doc_identity(url: Column) -> Column:
    """Identity of a page: it depends on its url alone, so a page crawled again keeps it."""
    return F.substring(F.sha2(url, 256), 1, 16)


def canonical_url(url: Column) -> Column:
    return F.substring_index(url, "?", 1)
