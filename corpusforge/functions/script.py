"""Dominant writing system of a text, and what it implies for the quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.text import only_letters

SAMPLE = 4096
#: Code point ranges of each script, as a regex class, and traits of scripts.
SCRIPTS = {
    "arabic": r"\x{600}-\x{6ff}\x{750}-\x{77f}",
    "armenian": r"\x{530}-\x{58f}",
    "bengali": r"\x{980}-\x{9ff}",
    "cyrillic": r"\x{400}-\x{52f}",
    "devanagari": r"\x{900}-\x{97f}",
    "ethiopic": r"\x{1200}-\x{137f}",
    "georgian": r"\x{10a0}-\x{10ff}",
    "greek": r"\x{370}-\x{3ff}",
    "han": r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}",
    "hangul": r"\x{ac00}-\x{d7af}",
    "hebrew": r"\x{590}-\x{5ff}",
    "hiragana": r"\x{3040}-\x{309f}",
    "katakana": r"\x{30a0}-\x{30ff}",
    "khmer": r"\x{1780}-\x{17ff}",
    "lao": r"\x{e80}-\x{eff}",
    "latin": r"A-Za-z\x{c0}-\x{24f}",
    "myanmar": r"\x{1000}-\x{109f}",
    "thai": r"\x{e00}-\x{e7f}",
    "tibetan": r"\x{f00}-\x{fff}",
}
UNSPACED = ("han", "hiragana", "katakana", "khmer", "lao", "myanmar", "thai", "tibetan")
UNPUNCTUATED = ("khmer", "lao", "myanmar", "thai", "tibetan")
DENSE = ("bengali", "devanagari", "ethiopic", "hangul", "khmer", "lao", "myanmar", "thai", "tibetan")
KANA_SHARE = 0.05


def with_script(df: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Adds ``script``, ``script_confidence``, ``space_delimited`` and ``script_counts``.

    Counts the letters among the first ``sample`` characters. Kana beside han is
    Japanese; ties go to the script that comes first in the text.
    """
    own = df.columns
    x = df.withColumn("__letters", only_letters(F.substring(F.coalesce(F.col(text), F.lit("")), 1, sample)))
    # No letter is of two scripts, so what is not Latin is all that the others are looked for in.
    x = x.withColumn("__rest", F.regexp_replace("__letters", f"[{SCRIPTS['latin']}]+", ""))
    n = {s: F.length("__rest") - F.length(F.regexp_replace("__rest", f"[{r}]+", "")) for s, r in SCRIPTS.items()}
    n["latin"] = F.length("__letters") - F.length("__rest")
    x = x.select(*own, "__letters", *[v.alias(f"__n_{s}") for s, v in n.items()])
    # Where no letter of a script is, its place decides nothing.
    first = lambda s: F.when(F.col(f"__n_{s}") > 0, F.length(F.regexp_extract("__letters", f"^([^{SCRIPTS[s]}]*)", 1))).otherwise(0)
    ranked = F.array_max(F.array(*[F.struct(F.col(f"__n_{s}").alias("n"), (-first(s)).alias("p"), F.lit(s).alias("s")) for s in SCRIPTS]))
    total = sum((F.col(f"__n_{s}") for s in SCRIPTS), F.lit(0))
    x = x.select(*own, *[f"__n_{s}" for s in SCRIPTS], ranked.alias("__top"), total.alias("__all"))
    kana = F.col("__n_hiragana") + F.col("__n_katakana")
    japanese = (F.col("__all") > 0) & (kana >= KANA_SHARE * F.col("__all")) & (F.col("__n_han") > 0)
    counts = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(s), F.col(f"__n_{s}").alias("n")) for s in SCRIPTS]), lambda e: e["n"] > 0))
    script = F.when(F.col("__all") == 0, "unknown").when(japanese, "japanese").otherwise(F.col("__top.s"))
    share = F.when(japanese, kana + F.col("__n_han")).otherwise(F.col("__top.n")) / F.greatest(F.col("__all"), F.lit(1))
    return x.select(
        *own,
        script.alias("script"),
        F.when(F.col("__all") == 0, F.lit(0.0)).otherwise(share).alias("script_confidence"),
        (~(script.isin(*UNSPACED) | (script == "japanese"))).alias("space_delimited"),
        counts.alias("script_counts"),
    )


def is_undetermined(script: Column) -> Column:
    return script == "unknown"


def uses_terminal_punctuation(script: Column) -> Column:
    return ~script.isin(*UNPUNCTUATED)


def dense_characters(script: Column) -> Column:
    return script.isin(*DENSE)
