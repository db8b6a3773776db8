"""The crawl-to-corpus pipeline as a decision table: one row for each input record, with the one stage that settled it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.quality import DIGITS, assess
from corpusforge.functions.text import doc_identity, normalize_column
from corpusforge.operators.exact import LEVELS, mark_exact, signatures
from corpusforge.operators.extract import MIN_BLOCK_CHARS, extract_html
from corpusforge.operators.minhash import BANDS, NGRAM, NUM_PERM, THRESHOLD, lsh_rows, near_dedup
from corpusforge.session import materialize

STAGES = ("malformed", "empty", "exact_duplicate", "quality", "near_duplicate", "kept")


@dataclass(frozen=True)
class PipelineConfig:
    exact_level: str = "normalized"
    near_dup_threshold: float = THRESHOLD
    num_perm: int = NUM_PERM
    bands: int = BANDS
    ngram: int = NGRAM
    min_block_chars: int = MIN_BLOCK_CHARS
    unicode_form: str = "NFKC"
    run_quality: bool = True
    run_near_dedup: bool = True
    adapt_to_script: bool = True

    def __post_init__(self):
        if self.exact_level not in LEVELS:
            raise ValueError(f"unknown level {self.exact_level!r}: one of {', '.join(LEVELS)}")
        lsh_rows(self.num_perm, self.bands)


def prepare(docs: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Text of each record, extracted where there is html and no text, then normalized. Html is dropped.

    Only records that need the parser reach it: the rows are split and not hidden in a ``when``.
    """
    if "html" in docs.columns:
        need = (F.coalesce("html", F.lit("")) != "") & (F.coalesce("text", F.lit("")) == "")
        pages = extract_html(docs.filter(need), "html", config.min_block_chars)
        title = F.coalesce(F.nullif("title", F.lit("")), F.col("extracted.title")) if "title" in docs.columns else F.col("extracted.title")
        pages = pages.withColumn("text", F.col("extracted.text"))
        pages = pages.withColumn("title", title).drop("extracted", "html")
        plain = docs.filter(~need).drop("html")
        if "title" not in plain.columns:
            plain = plain.withColumn("title", F.lit(None).cast("string"))
        docs = plain.unionByName(pages)
    return normalize_column(docs, "text", form=config.unicode_form)


def decide(prepared: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Adds stage, first_ord, matched_ord, similarity, signatures and quality to prepared records (ord, text, ...).

    Every non-empty record counts for exact dedup, also if quality drops it later. Near
    duplicates are looked for among what is left, the first in input order winning.
    """
    if "malformed" not in prepared.columns:
        prepared = prepared.withColumn("malformed", F.lit(False))
    x = materialize(prepared, "prepared")
    full = x.filter(~F.col("malformed") & (F.col("text") != ""))
    marked = mark_exact(full.select("ord", "text"), level=config.exact_level)
    first = marked.filter("NOT is_duplicate").select("ord", "text")
    if config.run_quality:
        judged = assess(first, adapt_to_script=config.adapt_to_script)
    else:
        judged = first.withColumn("quality", F.lit(None).cast("struct<passed:boolean,failures:array<string>,rules:array<struct<name:string,passed:boolean,value:double,threshold:double>>,script:string,script_confidence:double,space_delimited:boolean>"))
    judged = materialize(judged.withColumn("signatures", signatures(F.col("text"))).drop("text"), "judged")
    passed = judged.filter(F.coalesce("quality.passed", F.lit(True))).select("ord")
    fate = marked.select("ord", "is_duplicate", "first_ord").join(judged, "ord", "left")
    if config.run_near_dedup:
        near = near_dedup(first.join(passed, "ord", "left_semi"), threshold=config.near_dup_threshold, num_perm=config.num_perm, bands=config.bands, ngram=config.ngram)
        fate = fate.join(near.select("ord", F.col("is_duplicate").alias("near"), "matched_ord", "similarity"), "ord", "left")
    else:
        fate = fate.withColumns({"near": F.lit(False), "matched_ord": F.lit(None).cast("long"), "similarity": F.lit(None).cast("double")})
    out = x.join(fate, "ord", "left") if "quality" not in x.columns else x.drop("quality", "signatures").join(fate, "ord", "left")
    stage = (
        F.when(F.col("malformed"), "malformed")
        .when(F.coalesce("text", F.lit("")) == "", "empty")
        .when(F.col("is_duplicate"), "exact_duplicate")
        .when(~F.coalesce("quality.passed", F.lit(True)), "quality")
        .when(F.coalesce("near", F.lit(False)), "near_duplicate")
        .otherwise("kept")
    )
    return out.withColumn("stage", stage).drop("is_duplicate", "near", "malformed")


def kept_records(decided: DataFrame, now: str | None = None) -> DataFrame:
    """Output records: identity, script as language, and a crawl time where there was none."""
    x = decided.filter(F.col("stage") == "kept")
    stamp = F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    for c in ("title", "language", "crawled_at"):
        if c not in x.columns:
            x = x.withColumn(c, F.lit(None).cast("string"))
    x = x.withColumn("crawled_at", F.coalesce(F.nullif("crawled_at", F.lit("")), stamp)).withColumn("language", F.coalesce("quality.script", "language"))
    return x.withColumn("doc_id", doc_identity(F.col("url"))) if "url" in x.columns else x


def stage_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def failure_histogram(reports: DataFrame) -> DataFrame:
    """(rule, n): documents that fail each rule.

    An inner explode has the optimizer infer a filter on the report and copy its
    whole expression tree through every projection below; the outer one has not.
    """
    rules = reports.select(F.explode_outer("quality.failures").alias("rule")).filter(F.col("rule").isNotNull())
    return rules.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def stats(decided: DataFrame) -> dict:
    """Counts of the run; seen = kept + dropped + malformed."""
    n = dict.fromkeys(STAGES, 0) | {r["stage"]: r["n"] for r in stage_counts(decided).collect()}
    seen = sum(n.values())
    drops = {k: n[k] for k in STAGES[1:5]}
    failed = failure_histogram(decided.filter(F.col("stage") == "quality")).collect()
    return {
        "seen": seen,
        "kept": n["kept"],
        "dropped": sum(drops.values()),
        "malformed": n["malformed"],
        "keep_rate": round(n["kept"] / seen, 4) if seen else 0.0,
        "dropped_by_stage": drops,
        "quality_failures": {r["rule"]: r["n"] for r in sorted(failed, key=lambda r: (-r["n"], r["rule"]))},
    }


def render(s: dict) -> str:
    """The run's counts as text: a table of the stages' outcomes, then one of the rules."""
    share = lambda n: f"{100 * n / s['seen']:.1f} %" if s["seen"] else "-"
    fates = [("records seen", s["seen"]), ("malformed", s["malformed"]), *((f"dropped: {k}", n) for k, n in s["dropped_by_stage"].items()), ("dropped in all", s["dropped"]), ("kept", s["kept"])]
    lines = [f"{name:<28}{n:>12}{share(n):>10}" for name, n in fates]
    rules = [f"{name:<28}{n:>12}" for name, n in s["quality_failures"].items()]
    return "\n".join([*lines, *(["", "documents that fail a rule", *rules] if rules else [])])


def report_json(quality: dict) -> dict:
    """The report of one document as it is printed: rules by name, values rounded."""
    value = lambda r: None if r["value"] is None else int(r["value"]) if DIGITS[r["name"]] is None else round(r["value"], DIGITS[r["name"]])
    out = {"passed": quality["passed"], "failures": list(quality["failures"]), "rules": {r["name"]: {"passed": r["passed"], "value": value(r), "threshold": r["threshold"]} for r in quality["rules"]}}
    if quality["script"] is not None:
        out |= {"script": quality["script"], "script_confidence": round(quality["script_confidence"], 4), "space_delimited": quality["space_delimited"]}
    return out


def sample(docs: DataFrame, n: int, seed: int = 0, ord_: str = "ord") -> DataFrame:
    """``n`` rows drawn uniformly, the same for the same seed: those with the smallest hashes of their ordinals."""
    rank = F.md5(F.concat_ws(":", F.lit(seed), F.col(ord_)).cast("binary"))
    return docs.withColumn("__r", rank).orderBy("__r", ord_).limit(n).drop("__r")
