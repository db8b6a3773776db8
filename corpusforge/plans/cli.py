"""Command line: build, assess, dedup, extract."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from corpusforge.functions.quality import assess
from corpusforge.operators.exact import LEVELS
from corpusforge.operators.extract import MIN_BLOCK_CHARS, extract
from corpusforge.operators.minhash import BANDS, NUM_PERM, THRESHOLD, near_dedup
from corpusforge.plans import pipeline as P
from corpusforge.session import build_session
from corpusforge.sources.records import read_jsonl
from corpusforge.sources.shards import SHARD_SIZE, Folder, write_jsonl_shards


def say(text: str) -> None:
    print(text, file=sys.stderr)


def record_lines(kept):
    """(ord, line): output records as JSON, nested fields as objects and not as strings."""
    import pandas as pd

    def work(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                q = None if r.quality is None else json.loads(r.quality)
                rec = {
                    "url": r.url, "text": r.text, "title": r.title, "language": r.language, "crawled_at": r.crawled_at,
                    "quality": P.report_json({"script": None, **q}) if q else {}, "signatures": json.loads(r.signatures),
                    "embedding": None if r.embedding is None else list(r.embedding), "meta": json.loads(r.meta or "{}"), "doc_id": r.doc_id,
                }
                rows.append((r.ord, json.dumps(rec, ensure_ascii=False)))
            yield pd.DataFrame(rows, columns=["ord", "line"])

    x = kept.select("ord", "url", "text", "title", "language", "crawled_at", F.to_json("quality").alias("quality"), F.to_json("signatures").alias("signatures"), "embedding", "meta", "doc_id")
    return x.mapInPandas(work, "ord long, line string")


def build(spark, source: str, out_dir: str, config: P.PipelineConfig = P.PipelineConfig(), shard_size: int = SHARD_SIZE, compress: bool = True) -> dict:
    """The whole pipeline from JSONL to shards; returns and writes {"stats", "manifest"}."""
    decided = P.materialize(P.decide(P.prepare(read_jsonl(spark, source), config), config), "decided")
    manifest = write_jsonl_shards(record_lines(P.kept_records(decided)), out_dir, shard_size, compress=compress, line="line")
    report = {"stats": P.stats(decided), "manifest": manifest}
    Folder(spark, out_dir).write("stats.json", json.dumps(report, indent=2) + "\n")
    return report


def cmd_build(a) -> int:
    config = P.PipelineConfig(a.exact_level, a.threshold, a.num_perm, a.bands, run_quality=not a.no_quality, run_near_dedup=not a.no_dedup)
    report = build(build_session(), a.input, a.output, config, a.shard_size, not a.no_compress)
    bad = report["stats"]["malformed"]
    say(P.render(report["stats"]))
    say(f"\n{report['manifest']['total_records']} records in {report['manifest']['shard_count']} shard(s) under {a.output}")
    limit = 0 if a.strict else a.max_malformed
    if limit is not None and bad > limit:
        say(f"error: {bad} malformed lines, {limit} allowed; stats.json has the counts")
        return 1
    return 0


def cmd_assess(a) -> int:
    spark = build_session()
    docs = read_jsonl(spark, a.input).filter("NOT malformed")
    if a.sample is not None:
        docs = P.sample(docs, a.sample, a.seed)
    judged = P.materialize(assess(P.prepare(docs)).select("ord", "url", "quality"), "assessed")
    total, passed = judged.count(), judged.filter("quality.passed").count()
    if a.verbose:
        for r in judged.filter("NOT quality.passed").orderBy("ord").toLocalIterator():
            print(f"{r['url']}\t{','.join(r['quality']['failures'])}")
    say(f"documents   {total}" + "  (a sample)" * (a.sample is not None))
    say(f"would pass  {passed}" + (f"  ({passed / total:.1%})" if total else ""))
    for r in P.failure_histogram(judged).orderBy(F.desc("n"), "rule").collect():
        say(f"  {r['rule']:<28} {r['n']}")
    return 0


def cmd_dedup(a) -> int:
    docs = P.materialize(P.prepare(read_jsonl(build_session(), a.input).filter("NOT malformed")).select("ord", "url", "text"), "prepared")
    found = near_dedup(docs, threshold=a.threshold, num_perm=a.num_perm, bands=a.bands).join(docs.select("ord", "url"), "ord")
    found = P.materialize(found.join(docs.select(F.col("ord").alias("matched_ord"), F.col("url").alias("of")), "matched_ord", "left"), "found")
    for r in found.filter(F.lit(a.verbose) | F.col("is_duplicate")).orderBy("ord").toLocalIterator():
        print(f"{r['url']}\tDUPLICATE_OF\t{r['of']}\t{r['similarity']:.4f}" if r["is_duplicate"] else f"{r['url']}\tUNIQUE")
    say(f"\n{found.count()} documents, {found.filter('is_duplicate').count()} near-duplicates at threshold {a.threshold}")
    return 0


def cmd_extract(a) -> int:
    source = sys.stdin.read() if a.input == "-" else Path(a.input).read_text(encoding="utf-8", errors="replace")
    text, title = extract(source, a.min_block_chars)
    if a.json:
        print(json.dumps({"title": title, "text": text}, ensure_ascii=False))
    else:
        print(f"# {title}\n\n{text}" if title else text)
    return 0


def positive(s: str) -> int:
    if int(s) < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return int(s)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusforge", description="From a web crawl to a text corpus, on Spark.")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, text, source="JSONL file, or - for standard input"):
        c = sub.add_parser(name, help=text)
        c.add_argument("input", help=source)
        c.set_defaults(run=run)
        return c

    def near(c):
        c.add_argument("--threshold", type=float, default=THRESHOLD)
        c.add_argument("--num-perm", type=int, default=NUM_PERM)
        c.add_argument("--bands", type=int, default=BANDS)

    b = command("build", cmd_build, "whole pipeline to a sharded dataset")
    b.add_argument("-o", "--output", required=True)
    b.add_argument("--shard-size", type=positive, default=SHARD_SIZE)
    b.add_argument("--exact-level", choices=LEVELS, default="normalized")
    for flag in ("--no-quality", "--no-dedup", "--no-compress"):
        b.add_argument(flag, action="store_true")
    limit = b.add_mutually_exclusive_group()
    limit.add_argument("--strict", action="store_true")
    limit.add_argument("--max-malformed", type=positive, metavar="N")
    near(b)
    s = command("assess", cmd_assess, "quality report; drops nothing")
    s.add_argument("-v", "--verbose", action="store_true")
    s.add_argument("--sample", type=positive, metavar="N")
    s.add_argument("--seed", type=int, default=0)
    d = command("dedup", cmd_dedup, "near-duplicates of the input")
    d.add_argument("-v", "--verbose", action="store_true")
    near(d)
    e = command("extract", cmd_extract, "text of one HTML page", "HTML file, or -")
    e.add_argument("--min-block-chars", type=int, default=MIN_BLOCK_CHARS)
    e.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(a)
    except KeyboardInterrupt:
        say("interrupted")
        return 130


if __name__ == "__main__":
    raise SystemExit(main())
