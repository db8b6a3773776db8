"""Secret scan: three patterns, and sliding-window Shannon entropy by character class.

Patterns find assigned secrets, access keys and long hex runs. The entropy method
adds candidate strings (runs of 20 or more token characters with a digit) in which
some window of ``WINDOW`` characters reaches the entropy that its character class
asks for. The window slides with incremental counts: each step changes the count of
the character that enters and of the one that leaves, and with them the sum of
c*log2(c), so the time is linear in a candidate's length. An allow-list suppresses placeholders, and only those the method adds.

Only DataFrame functions are used, and no shuffle: a text is scanned where it is
read, whole. Positions are code points, ends exclusive.

Defined results: a null or empty text has no spans; null ids pass through; repeated
rows are scanned row by row; an empty table gives an empty result; other columns
pass through (internal columns are named ``__cf_*``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: A maximal run of 32 or more: what filtering the matches of [0-9a-f]+ by length leaves.
HEX = r"[0-9a-f]{32,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{TOKEN})(?=[A-Za-z+/_=-]*+[0-9]){TOKEN}{{20,}}+"
WINDOW, BLOCK = 20, 512
#: Least entropy, in bits, of some window, by character class: the first class that holds the whole candidate.
CLASSES = ((r"^[0-9]+$", 3.1), (r"^[0-9a-fA-F-]+$", 3.0), (r"^[A-Z0-9=]+$", 3.6), (r"^[a-z0-9_-]+$", 3.7), (r"^.*$", 3.8))
ALLOW = r"(?i)example|sample|placeholder|dummy|changeme|your[_-]|x{6}|0{8}|(?:0123|1234)567|abcdefg"


def once(c: Column, f) -> Column:
    """``f(c)`` with ``c`` evaluated once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _positions(gaps: Column, hits: Column) -> Column:
    """[(start, end)] of the hits, from what lies between them, in blocks, as an array is copied whenever it grows."""
    size = F.size(hits)
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(BLOCK))
    lengths = F.zip_with(F.slice(gaps, F.lit(1), size), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
    spans = "array<struct<s:int,e:int>>"

    def within(block: Column, at: Column) -> Column:
        zero = F.struct(at.cast("int").alias("at"), F.array().cast(spans).alias("out"))

        def step(a, x):
            e = (a["at"] + x["g"] + x["h"]).cast("int")
            return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).cast("int").alias("s"), e.alias("e")))).alias("out"))

        return F.aggregate(block, zero, step, lambda a: a["out"])

    def whole(x: Column) -> Column:
        blocks = F.transform(starts, lambda i: F.slice(x, i + 1, F.lit(BLOCK)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans}>").alias("out"))

        def step(a, block):
            own = within(block, a["at"])
            end = F.aggregate(block, a["at"], lambda n, y: (n + y["g"] + y["h"]).cast("int"))
            return F.struct(end.alias("at"), F.concat(a["out"], F.array(own)).alias("out"))

        return F.flatten(F.aggregate(blocks, zero, step, lambda a: a["out"]))

    return F.when(size > 0, once(lengths, whole))


def max_window_entropy(s: Column) -> Column:
    """Largest entropy of a window of WINDOW characters of ``s`` (ALPHABET only, at least WINDOW long).

    The counts are a string, a letter for each character of ALPHABET: its code is the
    count above that of ``0``. A step overlays the letter of the character that enters
    and that of the one that leaves.
    """
    f = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]
    table = F.array(*[F.lit(x) for x in f])
    letters = F.array(*[F.lit(chr(48 + c)) for c in range(WINDOW + 2)])
    zero = F.struct(F.lit("0" * len(ALPHABET)).alias("c"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"))

    def step(chars):
        def next_(a, i):
            new, old = F.get(chars, i), F.when(i >= WINDOW, F.get(chars, i - WINDOW))
            count = lambda c, p: F.ascii(F.substring(c, p, F.lit(1))) - 48
            put = lambda c, p, n: F.overlay(c, F.get(letters, n), p)
            up, down = count(a["c"], new), count(a["c"], old)
            more = F.get(table, up + 1) - F.get(table, up)
            less = F.get(table, down - 1) - F.get(table, down)
            # The character that enters and the one that leaves can be the same: then nothing changes.
            total = F.when(old.isNull(), a["sum"] + more).when(new == old, a["sum"]).otherwise(a["sum"] + more + less)
            entered = put(a["c"], new, up + 1)
            counts = F.when(old.isNull(), entered).when(new == old, a["c"]).otherwise(put(entered, old, down - 1))
            return F.struct(counts.alias("c"), total.alias("sum"), F.when(i >= WINDOW - 1, F.least(a["least"], total)).otherwise(a["least"]).alias("least"))

        return next_

    place = lambda c: F.position(c, F.lit(ALPHABET)).cast("int")
    slide = lambda chars: F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), zero, step(chars), lambda a: F.lit(math.log2(WINDOW)) - a["least"] / WINDOW)
    return once(F.transform(F.filter(F.split(s, "", -1), lambda c: c != ""), place), slide)


def is_random(s: Column) -> Column:
    """Does candidate ``s`` reach its class's entropy, and is it not on the allow-list?"""
    least = F.when(F.lit(False), F.lit(0.0))
    for cls, bits in CLASSES:
        least = least.when(F.rlike(s, F.lit(cls)), F.lit(bits))
    return ~F.rlike(s, F.lit(ALLOW)) & (max_window_entropy(s) >= least)


#: kind -> (pattern, what must hold for a match to be possible, does a match count)
SCANS = {
    "assign": (ASSIGN, lambda t: (F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))) & F.rlike(t, F.lit(ASSIGN)), lambda m, g: F.length(g) >= 8),
    "access": (ACCESS, lambda t: F.contains(t, F.lit("AKIA")), lambda m, g: F.length(m) >= 16),
    "hex": (HEX, lambda t: F.rlike(t, F.lit("[0-9a-f]{32}")), lambda m, g: F.lit(True)),
    "entropy": (CANDIDATE, lambda t: F.rlike(t, F.lit("[0-9]")) & F.rlike(t, F.lit(CANDIDATE)), lambda m, g: is_random(m)),
}


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__cf_base`` and ``__cf_spans``: arrays of (s, k, e), sorted by start and kind.

    Matches, what lies between them and their positions are columns of their own,
    one select after another: inside a lambda they would be found anew each time.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    x = docs.select(*own, t.alias("__cf_t")).select(*own, "__cf_t", *[may(F.col("__cf_t")).alias(f"__cf_may_{k}") for k, (_, may, _) in SCANS.items()])
    cols = []
    for k, (pattern, _, _) in SCANS.items():
        group = 2 if k == "assign" else 0
        when = lambda c, k=k: F.when(F.col(f"__cf_may_{k}"), c)
        cols += [
            when(F.regexp_extract_all("__cf_t", F.lit(pattern), F.lit(0))).alias(f"__cf_hits_{k}"),
            when(F.regexp_extract_all("__cf_t", F.lit(pattern), F.lit(group))).alias(f"__cf_group_{k}"),
            when(F.split("__cf_t", pattern, -1)).alias(f"__cf_gaps_{k}"),
        ]
    x = x.select(*own, *cols)
    x = x.select(
        *own,
        *[F.zip_with(f"__cf_hits_{k}", f"__cf_group_{k}", ok).alias(f"__cf_ok_{k}") for k, (_, _, ok) in SCANS.items()],
        *[_positions(F.col(f"__cf_gaps_{k}"), F.col(f"__cf_hits_{k}")).alias(f"__cf_at_{k}") for k in SCANS],
    )

    def spans(k: str) -> Column:
        # Zipped, not looked up: a column that a lambda names once is worked out anew for each element.
        at = F.zip_with(f"__cf_at_{k}", f"__cf_ok_{k}", lambda p, ok: F.struct(p["s"].alias("s"), F.lit(KINDS.index(k)).alias("k"), p["e"].alias("e"), ok.alias("ok")))
        hit = F.transform(F.filter(at, lambda p: p["ok"]), lambda p: F.struct(p["s"], p["k"], p["e"]))
        return F.coalesce(hit, F.array().cast("array<struct<s:int,k:int,e:int>>"))

    found = x.select(*own, F.sort_array(F.concat(*[spans(k) for k in KINDS[:3]])).alias("__cf_base"), spans("entropy").alias("__cf_random"))
    free = lambda r: ~F.exists("__cf_base", lambda b: (b["s"] < r["e"]) & (r["s"] < b["e"]))
    return found.select(*own, "__cf_base", F.sort_array(F.concat("__cf_base", F.filter("__cf_random", free))).alias("__cf_spans"))


def say(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["s"], s["e"])), ",")


def findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each secret: doc_id, kind, start, end and the text found."""
    names = F.array(*[F.lit(k) for k in KINDS])
    x = with_spans(docs, text).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("__t"), F.explode("__cf_spans").alias("p"))
    return x.select("doc_id", F.get(names, F.col("p.k")).alias("kind"), F.col("p.s").alias("start"), F.col("p.e").alias("end"), F.substr("__t", F.col("p.s") + 1, F.col("p.e") - F.col("p.s")).alias("found"))


def op3_secret_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = with_spans(docs)
    count = lambda kind: F.size(F.filter("__cf_base", lambda s: s["k"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return x.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(say(F.col("__cf_base")), 256).alias("base_sha256"), say(F.col("__cf_spans")).alias("spans"))
