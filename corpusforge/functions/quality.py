"""The quality rules: metrics, rule sets by script, and the report.

Every rule is always evaluated, so failures can be counted rule by rule. Metrics are
native expressions over normalized text, where the only spaces are U+0020 and line
ends. Values are reported unrounded; ``rounded`` gives the printed form.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.script import dense_characters, is_undetermined, uses_terminal_punctuation, with_script
from corpusforge.functions.text import LETTER, only_letters

#: Combining marks that belong to words, by code point.
MARKS = (
    r"\x{300}-\x{36f}\x{483}-\x{489}\x{591}-\x{5bd}\x{5bf}\x{5c1}\x{5c2}\x{5c4}\x{5c5}\x{5c7}"
    r"\x{610}-\x{61a}\x{64b}-\x{65f}\x{670}\x{6d6}-\x{6dc}\x{6df}-\x{6e8}"
    r"\x{900}-\x{903}\x{93a}-\x{94f}\x{951}-\x{957}\x{962}\x{963}\x{981}-\x{983}\x{9bc}\x{9be}-\x{9cd}\x{9d7}\x{9e2}\x{9e3}"
    r"\x{a01}-\x{a03}\x{a3c}-\x{a51}\x{b82}\x{bbe}-\x{bcd}\x{bd7}\x{e31}\x{e34}-\x{e3a}\x{e47}-\x{e4e}"
    r"\x{f71}-\x{f84}\x{f86}\x{f87}\x{102b}-\x{103e}"
)
#: One class and possessive loops: alternatives in a repeated group overflow Java's stack on long runs.
WORD = rf"[{LETTER}][{LETTER}{MARKS}]*+(?:['\x{{2019}}-][{LETTER}][{LETTER}{MARKS}]*+)*+"
WORD_RE2 = WORD.replace("*+", "*")
#: The same for Java, which tries the members of a class one by one: ASCII and wide ranges come first.
_LETTERS = rf"[a-zA-Z[\x{{aa}}-\x{{10ffff}}&&[{LETTER}]]]"
_REST = rf"[[a-zA-Z][\x{{aa}}-\x{{10ffff}}&&[{LETTER}[\x{{300}}-\x{{103e}}&&[{MARKS}]]]]]*+"
_WORD = rf"{_LETTERS}{_REST}(?:['\x{{2019}}-]{_LETTERS}{_REST})*+"
#: Bullets, ends of sentences, phrases of page furniture.
BULLETS = ("*", "-", "•", "‣", "⁃", "◦")
TERMINALS = ("!", ".", "?", "։", "۔", "।", "॥", "።", "。", "！", "？")
MARKERS = (
    "403 forbidden", "404 not found", "access denied", "all rights reserved", "cookie policy",
    "enable javascript", "javascript is disabled", "lorem ipsum", "privacy policy", "terms of use",
)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_WORD), F.lit(0))


def count_of(c: Column, s: str) -> Column:
    """Non-overlapping occurrences of ``s``."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))) / len(s)).cast("long")


def symbols(c: Column) -> Column:
    return count_of(c, "#") + count_of(c, "...") + count_of(c, "…")


def share(n: Column, of: Column, empty: float) -> Column:
    return F.when(of > 0, n.cast("double") / of).otherwise(F.lit(empty))


MEASURES = (
    "words", "word_chars", "symbols", "tokens", "alpha_tokens", "lines", "bullets", "ellipses", "ended",
    "line_chars", "distinct_line_chars", "markers", "letters",
)


def measured(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with a column ``__m_<name>`` for each thing the rules need, and those columns by name.

    They are columns and not fields of a struct: the optimizer puts a struct's fields
    in place of every mention of them, so that each would be measured again and again.
    """
    own = df.columns
    t = F.coalesce(F.col(text), F.lit(""))
    tokens = lambda pattern: F.size(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    lines = F.filter(F.transform(F.split(t, "\n", -1), lambda x: F.btrim(x)), lambda x: x != "")
    x = df.select(*own, words(t).alias("__w"), lines.alias("__l"))
    total = lambda c: F.length(F.array_join(c, ""))
    some = lambda f: F.size(F.filter("__l", f))
    last = lambda ln: F.substring(ln, -1, 1)
    m = {
        "words": F.size("__w"),
        "word_chars": total("__w"),
        "symbols": symbols(t),
        "tokens": tokens(r"[^ \n]++"),
        "alpha_tokens": tokens(rf"[^ \n\p{{L}}]*+\p{{L}}[^ \n]*+"),
        "lines": F.size("__l"),
        "bullets": some(lambda ln: F.substring(ln, 1, 1).isin(*BULLETS)),
        "ellipses": some(lambda ln: F.endswith(ln, F.lit("...")) | F.endswith(ln, F.lit("…"))),
        "ended": some(lambda ln: last(ln).isin(*TERMINALS)),
        "line_chars": total("__l"),
        "distinct_line_chars": total(F.array_distinct("__l")),
        "markers": sum((F.contains(F.lower(t), F.lit(k)).cast("int") for k in MARKERS), F.lit(0)),
        "letters": F.length(only_letters(t)),
    }
    return x.select(*own, *[m[k].cast("long").alias(f"__m_{k}") for k in MEASURES]), {k: F.col(f"__m_{k}") for k in MEASURES}


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the struct ``m`` of the measures."""
    x, m = measured(df, text)
    return x.select(*df.columns, F.struct(*[c.alias(k) for k, c in m.items()]).alias("m"))


@dataclass(frozen=True)
class Rule:
    """A rule: a value made of the measures, and the range in which it passes.

    ``metric`` maps the measures, by name, to a Column, so a rule of one's own is one
    more object.
    """

    name: str
    metric: Callable[[Mapping[str, Column] | Column], Column]
    low: float | None = None
    high: float | None = None
    digits: int | None = None

    def build(self, m: Mapping[str, Column] | Column) -> Column:
        v = self.metric(m).cast("double")
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (v >= self.low)
        if self.high is not None:
            ok = ok & (v <= self.high)
        return F.struct(F.lit(self.name).alias("name"), ok.alias("passed"), v.alias("value"), F.lit(float(self.low if self.low is not None else self.high)).alias("threshold"))


WORD_COUNT = Rule("word_count", lambda m: m["words"], 50, 100_000)
MEAN_WORD = Rule("mean_word_length", lambda m: share(m["word_chars"], m["words"], 0.0), 3.0, 10.0, 2)
MEAN_WORD_DENSE = Rule("mean_word_length", MEAN_WORD.metric, 1.8, 10.0, 2)
SYMBOL_WORD = Rule("symbol_to_word_ratio", lambda m: share(m["symbols"], m["words"], 1.0), None, 0.10, 4)
ALPHA_WORD = Rule("alpha_word_ratio", lambda m: share(m["alpha_tokens"], m["tokens"], 0.0), 0.80, None, 4)
BULLET_LINE = Rule("bullet_line_ratio", lambda m: share(m["bullets"], m["lines"], 1.0), None, 0.90, 4)
ELLIPSIS_LINE = Rule("ellipsis_line_ratio", lambda m: share(m["ellipses"], m["lines"], 1.0), None, 0.30, 4)
TERMINAL = Rule("terminal_punctuation_ratio", lambda m: share(m["ended"], m["lines"], 0.0), 0.15, None, 4)
REPETITION = Rule("repetition_ratio", lambda m: F.when(m["lines"] < 2, 0.0).otherwise(share(m["line_chars"] - m["distinct_line_chars"], m["line_chars"], 1.0)), None, 0.30, 4)
BOILERPLATE = Rule("boilerplate_markers", lambda m: m["markers"], None, 2)
CHAR_COUNT = Rule("char_count", lambda m: m["letters"], 80, 400_000)
SYMBOL_CHAR = Rule("symbol_to_char_ratio", lambda m: share(m["symbols"], m["letters"], 1.0), None, 0.05, 4)

_LINE_RULES = (BULLET_LINE, ELLIPSIS_LINE, TERMINAL, REPETITION, BOILERPLATE)
DEFAULT_RULES = (WORD_COUNT, MEAN_WORD, SYMBOL_WORD, ALPHA_WORD, *_LINE_RULES)
NON_SPACE_RULES = (CHAR_COUNT, SYMBOL_CHAR, *_LINE_RULES)


def select_rules(m: Mapping[str, Column] | Column, script: Column, space_delimited: Column) -> Column:
    """Array of rule results for the traits of each row's script."""
    spaced = F.array(*[r.build(m) for r in DEFAULT_RULES])
    dense = F.array(*[(MEAN_WORD_DENSE if r is MEAN_WORD else r).build(m) for r in DEFAULT_RULES])
    other = F.array(*[r.build(m) for r in NON_SPACE_RULES])
    base = F.when(is_undetermined(script), spaced).when(~space_delimited, other).when(dense_characters(script), dense).otherwise(spaced)
    keep = lambda r: uses_terminal_punctuation(script) | (r["name"] != TERMINAL.name)
    return F.filter(base, keep)


def assess(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] | None = None, adapt_to_script: bool = True) -> DataFrame:
    """``df`` with ``quality``: passed, failures, rules (array of results), script, script_confidence, space_delimited.

    With rules given, or adapt_to_script off, the script is null. A ``quality`` that is
    there already is replaced.
    """
    df = df.drop("quality")
    own = df.columns
    x, m = measured(df, text)
    if rules is None and adapt_to_script:
        x = with_script(x, text)
        results = select_rules(m, F.col("script"), F.col("space_delimited"))
        x = x.withColumn("__r", results)
    else:
        x = x.withColumn("__r", F.array(*[r.build(m) for r in rules or DEFAULT_RULES]))
        x = x.withColumns({"script": F.lit(None).cast("string"), "script_confidence": F.lit(None).cast("double"), "space_delimited": F.lit(None).cast("boolean")})
    report = F.struct(
        F.forall("__r", lambda r: r["passed"]).alias("passed"),
        F.transform(F.filter("__r", lambda r: ~r["passed"]), lambda r: r["name"]).alias("failures"),
        F.col("__r").alias("rules"),
        "script",
        "script_confidence",
        "space_delimited",
    )
    return x.select(*own, report.alias("quality"))


DIGITS = {r.name: r.digits for r in (*DEFAULT_RULES, *NON_SPACE_RULES)}
