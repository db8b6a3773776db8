"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every cutoff is read from a KLL sketch of the metric, one sketch for each (language,
source), over the documents that pass the base rules. Sketches merge, so a group with
too few documents falls back to its language's merged sketch, and then to the merged
sketch of the corpus. The cutoff table is joined back to the documents, which it filters.

A metric that spreads on both sides has outer fences, ``FENCE`` interquartile ranges
beyond the quartiles. A metric that is zero for most documents has a high quantile of
its group as its cutoff, but no less than what all but a tenth of the documents of the
corpus have that have any, so that in a group without any the first is no outlier.

Only DataFrame functions are used; one pass over the texts measures, and what it
measured is kept in the shared folder, since the sketches and the filter read it.

Defined results: a null or empty text has no words and fails the base rules; null
``lang`` or ``source`` form groups of their own; repeated rows are judged row by
row; an empty table gives an empty result; other columns pass through untouched
when carried (internal columns are named ``__cf_*``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.session import materialize

SPACE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Sketch accuracy, least documents for a sketch of one's own, fences in interquartile ranges.
SKETCH_K, MIN_GROUP, FENCE = 800, 100, 3.0
#: metric -> (numerator, denominator, quantile that is the cutoff; None for fences on both sides)
RULES = {
    "mean_word_chars": ("word_chars", "n_words", None),
    "symbols_per_word": ("n_symbols", "n_words", 0.95),
    "dup_line_share": ("n_dup_lines", "n_lines", 0.995),
    "repeat_word_share": ("n_repeat_words", "n_words", 0.995),
    "bangs_per_word": ("n_bangs", "n_words", 0.995),
}
#: Quantile of the corpus's values above zero below which no cutoff of the other metrics lies.
LEAST = 0.1


def count_chars(text: Column, chars: str) -> Column:
    """Occurrences of any of the ASCII ``chars``: each replace is one byte scan."""
    left = text
    for c in chars:
        left = F.replace(left, F.lit(c), F.lit(""))
    return F.length(text) - F.length(left)


def covered_words(hashes: Column) -> Column:
    """Words covered by the windows whose hash occurs twice or more."""

    def starts_of(pairs: Column) -> Column:
        m = F.size(pairs)
        same = lambda i, k: F.get(pairs, i)["h"] == F.get(pairs, k)["h"]
        twice = lambda k: ((k > 0) & same(k - 1, k)) | ((k < m - 1) & same(k + 1, k))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), m - 1), twice), lambda k: F.get(pairs, k)["i"]))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # array(x) with one transform binds x once.
    starts = F.element_at(F.transform(F.array(pairs), starts_of), 1)
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("n"))
    return F.aggregate(starts, zero, step, lambda a: a["n"])


def with_windows(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds ``out``: a 64-bit hash for each 8-word window of ``words`` (null if there is at most one).

    Hashes of 1, 2, 4 and then 8 words, each from two of the one before: three
    cheap steps a word where hashing slices would hash every word eight times.
    """
    own = df.columns
    q = lambda cs: [F.col(f"`{c}`") for c in cs]
    df = df.select(*q(own), F.transform(words, lambda w: F.xxhash64(w)).alias("__h1"))
    for k in (1, 2, 4):
        last = f"__h{k}"
        rest = F.slice(last, k + 1, F.greatest(F.size(last) - k, F.lit(0)))
        df = df.select(*q(own), F.zip_with(last, rest, lambda a, b: F.xxhash64(a, b)).alias(f"__h{2 * k}"))
    n = F.size(words)
    return df.select(*q(own), F.when(n > WINDOW, F.slice("__h8", 1, n - (WINDOW - 1))).alias(out))


def with_metrics(docs: DataFrame, text: str = "text", prefix: str = "__cf_") -> DataFrame:
    """``docs`` with the base metrics of ``text`` as long columns ``<prefix><metric>``."""
    p = lambda c: f"{prefix}{c}"
    t = F.coalesce(F.col(text), F.lit(""))
    own = [F.col(f"`{c}`") for c in docs.columns]
    trimmed = F.btrim(t, F.lit(SPACE))
    words = docs.select(*own, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT, -1)).alias(p("words")))
    hashed = with_windows(words, p("words"), p("windows"))
    sized = hashed.select("*", F.size(p("words")).alias(p("n")), F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias(p("lines")))
    out = {
        "n_words": F.col(p("n")),
        "word_chars": F.length(F.array_join(F.col(p("words")), "")),
        "n_symbols": count_chars(t, "#*$%&|<>"),
        "n_bangs": count_chars(t, "!"),
        "n_lines": F.size(p("lines")),
        "n_dup_lines": F.size(p("lines")) - F.size(F.array_distinct(F.col(p("lines")))),
        "n_repeat_words": F.when(F.size(F.array_distinct(p("windows"))) < F.size(p("windows")), covered_words(F.col(p("windows")))).otherwise(F.lit(0)),
    }
    return sized.select(*own, *[v.cast("long").alias(p(k)) for k, v in out.items()])


def base_failed(prefix: str = "__cf_") -> Column:
    n, rep = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 20) | (100 * rep > 30 * n)


def _ratio(num: str, den: str, prefix: str) -> Column:
    return F.col(f"{prefix}{num}").cast("double") / F.greatest(F.col(f"{prefix}{den}"), F.lit(1))


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "__cf_") -> DataFrame:
    """One row for each (language, source): ``<metric>_max``, and ``<metric>_min`` where there are fences.

    A cutoff is null, and rejects nothing, if no document of the corpus has any of the metric.
    """
    quantile = lambda sketch, q: F.kll_sketch_get_quantile_double(sketch, F.lit(q))
    ratio = {m: _ratio(num, den, prefix) for m, (num, den, _) in RULES.items()}
    sparse = [m for m, (*_, q) in RULES.items() if q is not None]
    sketch = lambda c: F.kll_sketch_agg_double(c, SKETCH_K)
    merge = lambda m: F.kll_merge_agg_double(m)
    keys = [F.col(f"`{lang}`").alias("__l"), F.col(f"`{source}`").alias("__s")]
    some = [F.when(ratio[m] > 0, ratio[m]) for m in sparse]
    by_both = measured.filter(~base_failed(prefix)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[sketch(x).alias(m) for m, x in ratio.items()], *[sketch(x).alias(f"{m}_some") for m, x in zip(sparse, some)], *[F.count(x).alias(f"{m}_k") for m, x in zip(sparse, some)]
    )
    by_both = materialize(by_both, "sketches")
    by_lang = by_both.groupBy("__l").agg(F.sum("n").alias("n_l"), *[merge(m).alias(f"{m}_l") for m in RULES])
    of_all = by_both.agg(*[merge(m).alias(f"{m}_a") for m in RULES], *[merge(F.when(F.col(f"{m}_k") > 0, F.col(f"{m}_some"))).alias(f"{m}_some_a") for m in sparse], *[F.sum(f"{m}_k").alias(f"{m}_k_a") for m in sparse])
    of_all = of_all.select(*[f"{m}_a" for m in RULES], *[F.when(F.col(f"{m}_k_a") > 0, quantile(F.col(f"{m}_some_a"), LEAST)).alias(f"{m}_least") for m in sparse])
    joined = by_both.join(by_lang.withColumnRenamed("__l", "__l2"), F.col("__l").eqNullSafe(F.col("__l2"))).join(F.broadcast(of_all))
    cols = []
    for m, (_, _, q) in RULES.items():
        own = F.when(F.col("n") >= MIN_GROUP, F.col(m)).when(F.col("n_l") >= MIN_GROUP, F.col(f"{m}_l")).otherwise(F.col(f"{m}_a"))
        if q is None:
            q1, q3 = quantile(own, 0.25), quantile(own, 0.75)
            cols += [(q3 + FENCE * (q3 - q1)).alias(f"{m}_max"), (q1 - FENCE * (q3 - q1)).alias(f"{m}_min")]
        else:
            least = F.col(f"{m}_least")
            cols.append(F.when(least.isNotNull(), F.greatest(quantile(own, q), least)).alias(f"{m}_max"))
    return joined.select("__l", "__s", F.col("n").alias("__n_group"), *cols)


def apply_quality(docs: DataFrame, carry: list[str] | None = None, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The carried columns of every document with ``__cf_*`` metrics, ``__cf_base_failed``, ``__cf_kept``.

    Groups without a document that passes the base rules have no fences, and need none.
    """
    carry = carry or docs.columns
    slim = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, lang, source, text])])
    measured = with_metrics(slim, text)
    if text not in carry:
        measured = measured.drop(text)
    measured = materialize(measured, "measured")
    cut = thresholds(measured, lang, source)
    cut = cut.select(F.struct(*[c for c in cut.columns if c not in ("__l", "__s")]).alias("__cf_cut"), "__l", "__s")
    joined = measured.join(cut, F.col(lang).eqNullSafe(F.col("__l")) & F.col(source).eqNullSafe(F.col("__s")), "left")
    kept = F.expr("true")
    for m, (num, den, q) in RULES.items():
        kept = kept & F.coalesce(_ratio(num, den, "__cf_") <= F.col(f"__cf_cut.{m}_max"), F.lit(True))
        if q is None:
            kept = kept & F.coalesce(_ratio(num, den, "__cf_") >= F.col(f"__cf_cut.{m}_min"), F.lit(True))
    return joined.withColumn("__cf_base_failed", base_failed()).withColumn("__cf_kept", ~base_failed() & kept).drop("__l", "__s", "__cf_cut")


def op5_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = apply_quality(docs, ["doc_id"])
    long = [F.col(f"__cf_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *long, F.col("__cf_base_failed").alias("base_failed"), F.col("__cf_kept").alias("kept"))


def stage_quality(spark, docs, sf_dir):
    """Documents that pass; all columns of ``docs``."""
    return apply_quality(docs).filter("__cf_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
