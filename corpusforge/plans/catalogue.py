"""Named queries of the engine over the test tables, and their SQL counterparts.

``documents`` lack bullets, ellipses, odd spaces and other scripts, so most queries
read ``variants``: every document, changed in a way that depends on its id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusforge.functions import quality as Q
from corpusforge.functions import script as S
from corpusforge.functions import text as X
from corpusforge.operators import batching, exact, extract, listings, minhash
from corpusforge.plans import pipeline as P
from corpusforge.session import materialize, shared_dir, table
from corpusforge.sources import records, shards

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# Sources of the queries ---------------------------------------------------------

HAN, NAGARI = "我们测试文本处理。" * 12, "यह एक परीक्षण वाक्य है। " * 20
_NL = "chr(10)"
VARIANT_SQL = f"""(SELECT doc_id, lang, source, CASE doc_id % 8
  WHEN 1 THEN '  “' || text || '”' || chr(9) || ' x' || repeat({_NL}, 4) || '‘end’ '
  WHEN 2 THEN '- ' || replace(text, {_NL}, {_NL} || '• ')
  WHEN 3 THEN replace(text, '.', '...')
  WHEN 4 THEN '{HAN}' || {_NL} || '{HAN}'
  WHEN 5 THEN replace(text, ' ', chr(8203) || '  ')
  WHEN 6 THEN '{NAGARI}' || {_NL} || 'privacy policy, Terms of Use, ALL RIGHTS RESERVED'
  ELSE text END AS text FROM documents)"""


def variants(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("__documents")
    return spark.sql(VARIANT_SQL.strip("()").replace("FROM documents", "FROM __documents").replace("chr(8203)", "'​'"))


def normalized(spark, sf_dir) -> DataFrame:
    return variants(spark, sf_dir).withColumn("text", X.normalize_native(F.col("text")))


def documents(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("ord"), "text")


def _re(c: str, pattern: str, to: str) -> str:
    return f"regexp_replace({c}, '{pattern}', '{to}', 'g')"


_STRIPPED = _re(_re("coalesce(text, '')", X.INVISIBLE, ""), X.CONTROL, "")
_FOLDED = f"translate({_STRIPPED}, '{X.QUOTES_FROM}', '{X.QUOTES_TO.replace(chr(39), chr(39) * 2)}')"
_NORMAL = f"trim({_re(_re(_re(_FOLDED, X.H_SPACE, ' '), X.BLANK_LINES, chr(10) * 2), ' *' + chr(10) + ' *', chr(10))}, ' ' || chr(10))"
NORMAL_SQL = f"(SELECT doc_id, lang, source, {_NORMAL} AS text FROM {VARIANT_SQL})"

# Text ---------------------------------------------------------------------------


@query
def doc_identity(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", X.doc_identity(F.col("url")).alias("doc_id"), X.canonical_url(F.col("url")).alias("canonical_url"))


ORACLE_SQL["doc_identity"] = "SELECT page_id, left(sha256(url), 16) AS doc_id, split_part(url, '?', 1) AS canonical_url FROM pages"


@query
def normalize_text(spark, sf_dir):
    return normalized(spark, sf_dir).select("doc_id", "text")


ORACLE_SQL["normalize_text"] = f"SELECT doc_id, text FROM {NORMAL_SQL}"


@query
def normalize_nfkc(spark, sf_dir):
    return X.normalize_column(variants(spark, sf_dir)).select("doc_id", "text")


# Quality ------------------------------------------------------------------------

_W = Q.WORD_RE2.replace("'", "''")
_T = "list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '')"
_L = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_OCC = lambda s: f"((length(text) - length(replace(text, '{s}', ''))) // {len(s)})"
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_LEN = lambda c: f"coalesce(length(array_to_string({c}, '')), 0)"
MEASURES_SQL = f"""(SELECT doc_id, text, CAST(len(w) AS BIGINT) AS words, CAST({_LEN('w')} AS BIGINT) AS word_chars,
  CAST({_OCC('#')} + {_OCC('...')} + {_OCC('…')} AS BIGINT) AS symbols, CAST(len(t) AS BIGINT) AS tokens,
  CAST(len(list_filter(t, lambda x: regexp_matches(x, '\\p{{L}}'))) AS BIGINT) AS alpha_tokens, CAST(len(l) AS BIGINT) AS lines,
  CAST(len(list_filter(l, lambda x: x[1] IN ({_IN(Q.BULLETS)}))) AS BIGINT) AS bullets,
  CAST(len(list_filter(l, lambda x: suffix(x, '...') OR suffix(x, '…'))) AS BIGINT) AS ellipses,
  CAST(len(list_filter(l, lambda x: right(x, 1) IN ({_IN(Q.TERMINALS)}))) AS BIGINT) AS ended,
  CAST({_LEN('l')} AS BIGINT) AS line_chars, CAST({_LEN('list_distinct(l)')} AS BIGINT) AS distinct_line_chars,
  CAST({' + '.join(f"CAST(contains(lower(text), '{k}') AS INT)" for k in Q.MARKERS)} AS BIGINT) AS markers,
  CAST(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS BIGINT) AS letters
  FROM (SELECT doc_id, text, regexp_extract_all(text, '{_W}') AS w, {_T} AS t, {_L} AS l FROM {NORMAL_SQL}))"""


def measures(spark, sf_dir) -> DataFrame:
    return Q.with_measures(normalized(spark, sf_dir)).select("doc_id", "m.*")


def _share(n: str, of: str, empty: float) -> str:
    return f"CASE WHEN {of} > 0 THEN CAST({n} AS DOUBLE) / {of} ELSE {empty} END"


_VALUES = {
    "word_count": "CAST(words AS DOUBLE)",
    "mean_word_length": _share("word_chars", "words", 0.0),
    "symbol_to_word_ratio": _share("symbols", "words", 1.0),
    "alpha_word_ratio": _share("alpha_tokens", "tokens", 0.0),
    "bullet_line_ratio": _share("bullets", "lines", 1.0),
    "ellipsis_line_ratio": _share("ellipses", "lines", 1.0),
    "terminal_punctuation_ratio": _share("ended", "lines", 0.0),
    "repetition_ratio": f"CASE WHEN lines < 2 THEN 0.0 ELSE {_share('(line_chars - distinct_line_chars)', 'line_chars', 1.0)} END",
    "boilerplate_markers": "CAST(markers AS DOUBLE)",
    "char_count": "CAST(letters AS DOUBLE)",
    "symbol_to_char_ratio": _share("symbols", "letters", 1.0),
}
_RULES = {r.name: r for r in (*Q.DEFAULT_RULES, *Q.NON_SPACE_RULES)}


def _rule_query(rule: Q.Rule):
    def run(spark, sf_dir):
        x, m = Q.measured(normalized(spark, sf_dir))
        r = rule.build(m)
        return x.select("doc_id", r["value"].alias("value"), r["passed"].alias("passed"))

    QUERIES[f"rule_{rule.name}"] = run
    ORACLE_SQL[f"rule_{rule.name}"] = f"SELECT doc_id, value, {_ok(rule)} AS passed FROM (SELECT doc_id, CAST({_VALUES[rule.name]} AS DOUBLE) AS value FROM {MEASURES_SQL})"


def _ok(rule: Q.Rule, value: str = "value") -> str:
    return " AND ".join(f"{value} {op} {x}" for op, x in ((">=", rule.low), ("<=", rule.high)) if x is not None)


for _r in _RULES.values():
    _rule_query(_r)


@query
def word_stats(spark, sf_dir):
    return measures(spark, sf_dir)


ORACLE_SQL["word_stats"] = f"SELECT * EXCLUDE (text) FROM {MEASURES_SQL}"

_N = ", ".join(f"length(regexp_replace(a, '[^{r}]', '', 'g')) AS n_{s}" for s, r in S.SCRIPTS.items())
_TOP = ", ".join(f"{{'n': n_{s}, 'p': -length(regexp_extract(a, '^([^{r}]*)', 1)), 's': '{s}'}}" for s, r in S.SCRIPTS.items())
SCRIPT_SQL = f"""(SELECT doc_id, CASE WHEN total = 0 THEN 'unknown' WHEN ja THEN 'japanese' ELSE top.s END AS script,
  CASE WHEN total = 0 THEN 0.0 WHEN ja THEN (kana + n_han) / CAST(total AS DOUBLE) ELSE top.n / CAST(total AS DOUBLE) END AS script_confidence
  FROM (SELECT *, list_aggregate([{_TOP}], 'max') AS top, {' + '.join(f'n_{s}' for s in S.SCRIPTS)} AS total, n_hiragana + n_katakana AS kana,
        kana >= {S.KANA_SHARE} * total AND n_han > 0 AND total > 0 AS ja
        FROM (SELECT doc_id, a, {_N} FROM (SELECT doc_id, regexp_replace(left(text, {S.SAMPLE}), '[^\\p{{L}}]', '', 'g') AS a FROM {NORMAL_SQL}))))"""


@query
def script_profile(spark, sf_dir):
    x = S.with_script(normalized(spark, sf_dir))
    return x.select("doc_id", "script", "script_confidence", "space_delimited")


_SPACED = f"script NOT IN ({_IN(S.UNSPACED)}, 'japanese')"
ORACLE_SQL["script_profile"] = f"SELECT doc_id, script, script_confidence, {_SPACED} AS space_delimited FROM {SCRIPT_SQL}"


def _report(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("quality.passed").alias("passed"), F.array_join("quality.failures", ",").alias("failures"))


def _failures(adaptive: bool) -> str:
    out = []
    for name, rule in _RULES.items():
        when = "TRUE"
        value = f"({_VALUES[name]})"
        if adaptive:
            if name in ("word_count", "symbol_to_word_ratio", "alpha_word_ratio", "mean_word_length"):
                when = "spaced"
            elif name in ("char_count", "symbol_to_char_ratio"):
                when = "NOT spaced"
            elif name == "terminal_punctuation_ratio":
                when = f"script NOT IN ({_IN(S.UNPUNCTUATED)})"
        elif name in ("char_count", "symbol_to_char_ratio"):
            continue
        ok = _ok(rule, value)
        if adaptive and name == "mean_word_length":
            ok = f"{value} >= CASE WHEN script IN ({_IN(S.DENSE)}) THEN 1.8 ELSE 3.0 END AND {value} <= 10.0"
        out.append((name, f"CASE WHEN ({when}) AND NOT ({ok}) THEN '{name}' END"))
    order = [r.name for r in (*Q.DEFAULT_RULES[:4], *Q.NON_SPACE_RULES)]
    return "concat_ws(',', " + ", ".join(x for _, x in sorted(out, key=lambda x: order.index(x[0]))) + ")"


REPORT_SQL = f"(SELECT doc_id, {_failures(True)} AS failures FROM (SELECT *, {_SPACED} AS spaced FROM {MEASURES_SQL} JOIN {SCRIPT_SQL} USING (doc_id)))"


@query
def quality_report(spark, sf_dir):
    return _report(Q.assess(normalized(spark, sf_dir)))


ORACLE_SQL["quality_report"] = f"SELECT doc_id, failures = '' AS passed, failures FROM {REPORT_SQL}"


@query
def quality_non_adaptive(spark, sf_dir):
    return _report(Q.assess(normalized(spark, sf_dir), adapt_to_script=False))


ORACLE_SQL["quality_non_adaptive"] = f"SELECT doc_id, failures = '' AS passed, failures FROM (SELECT doc_id, {_failures(False)} AS failures FROM {MEASURES_SQL})"


@query
def quality_custom_rules(spark, sf_dir):
    digits = Q.Rule("letters_per_token", lambda m: Q.share(m["letters"], m["tokens"], 0.0), 2.5)
    return _report(Q.assess(normalized(spark, sf_dir), rules=(Q.WORD_COUNT, digits)))


ORACLE_SQL["quality_custom_rules"] = f"""SELECT doc_id, failures = '' AS passed, failures FROM (SELECT doc_id, concat_ws(',',
  CASE WHEN NOT (words >= 50 AND words <= 100000) THEN 'word_count' END,
  CASE WHEN NOT ({_share('letters', 'tokens', 0.0)} >= 2.5) THEN 'letters_per_token' END) AS failures FROM {MEASURES_SQL})"""


@query
def quality_failure_histogram(spark, sf_dir):
    return P.failure_histogram(Q.assess(normalized(spark, sf_dir)))


ORACLE_SQL["quality_failure_histogram"] = f"SELECT rule, count(*) AS n FROM (SELECT unnest(string_split(failures, ',')) AS rule FROM {REPORT_SQL} WHERE failures <> '') GROUP BY rule"


@query
def assess_summary(spark, sf_dir):
    q = Q.assess(normalized(spark, sf_dir))
    return q.agg(F.count(F.lit(1)).alias("documents"), F.count_if("quality.passed").alias("would_pass"))


ORACLE_SQL["assess_summary"] = f"SELECT count(*) AS documents, count(*) FILTER (WHERE failures = '') AS would_pass FROM {REPORT_SQL}"

# Exact dedup --------------------------------------------------------------------


def _comparable_sql(level: str) -> str:
    if level == "raw":
        return "text"
    c = _re("translate(replace(lower(text), 'ß', 'ss'), 'ς', 'σ')", exact._PUNCTUATION, " ")
    if level == "structural":
        c = _re(c, r"\p{Nd}+", "0")
    return f"trim({_re(c, f'[{X.WS}]+', ' ')})"


def _exact_query(level: str):
    def run(spark, sf_dir):
        d = documents(spark, sf_dir).withColumn("text", X.normalize_native(F.col("text")))
        return exact.mark_exact(d, level=level).select(F.col("ord").alias("doc_id"), "signature", "is_duplicate", F.col("first_ord").alias("first_id"))

    QUERIES[f"exact_dedup_{level}"] = run
    plain = f"(SELECT doc_id, {_NORMAL} AS text FROM documents)"
    ORACLE_SQL[f"exact_dedup_{level}"] = f"""SELECT doc_id, signature, doc_id <> first_id AS is_duplicate, first_id FROM
      (SELECT doc_id, signature, min(doc_id) OVER (PARTITION BY signature) AS first_id FROM (SELECT doc_id, md5({_comparable_sql(level)}) AS signature FROM {plain}))"""


for _level in exact.LEVELS:
    _exact_query(_level)


@query
def exact_signatures(spark, sf_dir):
    return normalized(spark, sf_dir).select("doc_id", exact.signatures(F.col("text")).alias("s")).select("doc_id", "s.*")


ORACLE_SQL["exact_signatures"] = f"SELECT doc_id, {', '.join(f'md5({_comparable_sql(k)}) AS {k}' for k in exact.LEVELS)} FROM {NORMAL_SQL}"


@query
def exact_dup_classes(spark, sf_dir):
    return exact.duplicate_classes(documents(spark, sf_dir)).filter("copies > 1")


ORACLE_SQL["exact_dup_classes"] = f"SELECT md5({_comparable_sql('normalized')}) AS signature, min(doc_id) AS first_ord, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1"

# Near dedup ---------------------------------------------------------------------

_COEF = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(minhash.coefficients()))


def _shingles_sql(source: str) -> str:
    return f"""(SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {minhash.NGRAM} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {minhash.NGRAM - 2}), lambda i: array_to_string(w[i:i + {minhash.NGRAM - 1}], ' '))) END) AS s
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '{minhash.TOKEN}') AS w FROM {source}))"""


def _minima_sql(source: str) -> str:
    return f"""(SELECT doc_id, i, min((a * h + b) % {minhash.PRIME}) AS v FROM
  (SELECT DISTINCT doc_id, (('0x' || left(md5(s), 8))::BIGINT & {minhash.PRIME}) AS h FROM {_shingles_sql(source)}), (VALUES {_COEF}) p(i, a, b) GROUP BY doc_id, i)"""


SHINGLES_SQL, MINIMA_SQL = _shingles_sql("documents"), _minima_sql("documents")
_ROWS = minhash.lsh_rows()


def _greedy_ctes(source: str) -> str:
    """Common tables up to ``near``: the documents of ``source`` gone through one by one."""
    return f"""g AS MATERIALIZED (SELECT d.doc_id, coalesce(sig, list_transform(range({minhash.NUM_PERM}), lambda x: {minhash.EMPTY}::BIGINT)) AS sig
    FROM {source} d LEFT JOIN (SELECT doc_id, list(v ORDER BY i) AS sig FROM {_minima_sql(source)} GROUP BY doc_id) USING (doc_id)),
  k AS MATERIALIZED (SELECT doc_id, b, sig[b * {_ROWS} + 1:b * {_ROWS} + {_ROWS}] AS part FROM g, range({minhash.BANDS}) r(b)),
  p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y ON x.b = y.b AND x.part = y.part AND x.doc_id < y.doc_id),
  e AS MATERIALIZED (SELECT a, b, sim FROM (SELECT a, b, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / {float(minhash.NUM_PERM)} AS sim
    FROM p JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b) WHERE sim >= {minhash.THRESHOLD}),
  n AS MATERIALIZED (SELECT b, earlier, row_number() OVER (ORDER BY b) AS pos FROM (SELECT b, list(a) AS earlier FROM e GROUP BY b)),
  w AS (SELECT 0::BIGINT AS pos, []::BIGINT[] AS gone UNION ALL
    SELECT n.pos, CASE WHEN list_has_all(w.gone, n.earlier) THEN w.gone ELSE list_append(w.gone, n.b) END FROM w JOIN n ON n.pos = w.pos + 1),
  z AS MATERIALIZED (SELECT unnest(gone) AS b FROM w WHERE pos = (SELECT max(pos) FROM w)),
  m AS (SELECT e.b, a, sim, row_number() OVER (PARTITION BY e.b ORDER BY sim DESC, a) AS q FROM e JOIN z ON z.b = e.b WHERE a NOT IN (SELECT b FROM z)),
  near AS (SELECT g.doc_id, z.b IS NOT NULL AS is_duplicate, m.a AS matched_ord, m.sim AS similarity FROM g LEFT JOIN z ON z.b = g.doc_id LEFT JOIN m ON m.b = g.doc_id AND m.q = 1)"""


@query
def shingle_counts(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select(F.col("ord").alias("doc_id"), F.size(minhash.shingles(F.col("text"))).cast("long").alias("n"))


ORACLE_SQL["shingle_counts"] = f"SELECT d.doc_id, count(s) AS n FROM documents d LEFT JOIN {SHINGLES_SQL} s USING (doc_id) GROUP BY d.doc_id"


@query
def minhash_signatures(spark, sf_dir):
    s = minhash.with_signatures(documents(spark, sf_dir), keep=["ord"])
    return s.select(F.col("ord").alias("doc_id"), F.md5(F.array_join("signature", ",").cast("binary")).alias("signature"))


ORACLE_SQL["minhash_signatures"] = f"""SELECT d.doc_id, md5(coalesce(string_agg(v::VARCHAR, ',' ORDER BY i), '{",".join([str(minhash.EMPTY)] * minhash.NUM_PERM)}')) AS signature
  FROM documents d LEFT JOIN {MINIMA_SQL} m USING (doc_id) GROUP BY d.doc_id"""


def _signed(spark, sf_dir) -> DataFrame:
    return materialize(minhash.with_signatures(documents(spark, sf_dir), keep=["ord"]), "signatures")


@query
def near_dup_pairs(spark, sf_dir):
    """Pairs of distinct signatures, each named by its first document."""
    firsts = materialize(_signed(spark, sf_dir).groupBy("signature").agg(F.min("ord").alias("ord")), "firsts")
    return minhash.near_pairs(firsts)


_SIG = f"(SELECT doc_id, list(v ORDER BY i) AS sig FROM {MINIMA_SQL} GROUP BY doc_id)"
ORACLE_SQL["near_dup_pairs"] = f"""WITH f AS MATERIALIZED (SELECT min(doc_id) AS ord, sig FROM {_SIG} GROUP BY sig),
  k AS MATERIALIZED (SELECT ord, b, sig[b * 4 + 1:b * 4 + 4] AS part FROM f, range({minhash.BANDS}) r(b)),
  p AS (SELECT DISTINCT x.ord AS src, y.ord AS dst FROM k x JOIN k y ON x.b = y.b AND x.part = y.part AND x.ord < y.ord)
  SELECT src, dst, sim FROM (SELECT src, dst, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / {float(minhash.NUM_PERM)} AS sim
  FROM p JOIN f x ON x.ord = src JOIN f y ON y.ord = dst) WHERE sim >= {minhash.THRESHOLD}"""


@query
def lsh_candidates(spark, sf_dir):
    """Pairs of distinct signatures that share a band, each named by its first document."""
    firsts = materialize(_signed(spark, sf_dir).groupBy("signature").agg(F.min("ord").alias("ord")), "firsts")
    return minhash.candidates(firsts)


ORACLE_SQL["lsh_candidates"] = f"""WITH f AS MATERIALIZED (SELECT min(doc_id) AS ord, sig FROM {_SIG} GROUP BY sig),
  k AS MATERIALIZED (SELECT ord, b, sig[b * 4 + 1:b * 4 + 4] AS part FROM f, range({minhash.BANDS}) r(b))
  SELECT DISTINCT x.ord AS src, y.ord AS dst FROM k x JOIN k y ON x.b = y.b AND x.part = y.part AND x.ord < y.ord"""


@query
def near_dedup_greedy(spark, sf_dir):
    x = minhash.near_dedup(documents(spark, sf_dir))
    return x.select(F.col("ord").alias("doc_id"), "is_duplicate", "matched_ord", "similarity")


ORACLE_SQL["near_dedup_greedy"] = f"WITH RECURSIVE {_greedy_ctes('documents')} SELECT * FROM near"


# Extraction ---------------------------------------------------------------------


@query
def html_extract(spark, sf_dir):
    x = extract.extract_html(table(spark, sf_dir, "pages"))
    return x.select("page_id", "extracted.text", "extracted.title")


@query
def html_title(spark, sf_dir):
    x = extract.extract_html(table(spark, sf_dir, "pages"))
    return x.select("page_id", "extracted.title")


_TITLE = "replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '&amp;', '&')"
ORACLE_SQL["html_title"] = f"SELECT page_id, nullif(trim({_re(_TITLE, '[ \\t\\n\\r]+', ' ')}), '') AS title FROM pages"


_LINES = "[x for x in string_split(text, chr(10)) if length(trim(x)) > 0]"


def _lines(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x)) > 0).alias("lines"))


@query
def block_scores(spark, sf_dir):
    """Lines as blocks: those with ``#`` count as headings, digits as link characters."""
    x = _lines(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode("lines").alias("k", "s"))
    digits = F.length(F.regexp_replace("s", "[^0-9]", ""))
    return x.select("doc_id", F.col("k").cast("long").alias("k"), extract.block_scores(F.length("s"), digits, F.contains("s", F.lit("#"))).cast("double").alias("score"))


_SCORES = f"""(SELECT doc_id, k - 1 AS k, CASE WHEN contains(s, '#') THEN 0.5 * n * own ELSE n * own * own END AS score FROM
  (SELECT doc_id, k, s, length(s) AS n, 1.0::DOUBLE - least(CAST(length(regexp_replace(s, '[^0-9]', '', 'g')) AS DOUBLE) / length(s), 1.0::DOUBLE) AS own FROM
  (SELECT doc_id, unnest({_LINES}) AS s, generate_subscripts({_LINES}, 1) AS k FROM documents)))"""
ORACLE_SQL["block_scores"] = f"SELECT doc_id, CAST(k AS BIGINT) AS k, CAST(score AS DOUBLE) AS score FROM {_SCORES}"


@query
def best_run(spark, sf_dir):
    """The best run over whole line lengths, so that sums are exact in any engine."""
    x = _lines(table(spark, sf_dir, "documents")).select("doc_id", F.transform("lines", lambda s: F.length(s).cast("double")).alias("scores"))
    x = x.select("doc_id", extract.best_run_native(F.col("scores")).alias("r"))
    return x.select("doc_id", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("stop"))


#: Every run of every document; sums times twice the number of lines, which are whole.
ORACLE_SQL["best_run"] = f"""WITH l AS (SELECT doc_id, generate_subscripts({_LINES}, 1) - 1 AS k, length(unnest({_LINES})) AS n FROM documents),
  w AS (SELECT doc_id, k, 2 * n * count(*) OVER d - sum(n) OVER d AS w FROM l WINDOW d AS (PARTITION BY doc_id)),
  p AS MATERIALIZED (SELECT doc_id, k, w, sum(w) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM w),
  r AS (SELECT e.doc_id, s.k AS start, e.k + 1 AS stop, e.upto - s.upto + s.w AS gain FROM p e JOIN p s ON s.doc_id = e.doc_id AND s.k <= e.k)
  SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gain DESC, stop, start DESC) AS nth FROM r) WHERE nth = 1
  UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE len({_LINES}) = 0"""


# Pipeline -----------------------------------------------------------------------


@query
def pipeline_decisions(spark, sf_dir):
    d = P.decide(P.prepare(documents(spark, sf_dir)))
    return d.select(F.col("ord").alias("doc_id"), "stage", "first_ord", "matched_ord", "similarity")


@query
def pipeline_stats(spark, sf_dir):
    return P.stage_counts(P.decide(P.prepare(documents(spark, sf_dir))))


_PLAIN = NORMAL_SQL.replace(VARIANT_SQL, "documents")


_JUDGED = f"""(SELECT doc_id, text, {_failures(True)} AS failures FROM (SELECT *, {_SPACED} AS spaced
  FROM {MEASURES_SQL.replace(NORMAL_SQL, _PLAIN)} JOIN {SCRIPT_SQL.replace(NORMAL_SQL, _PLAIN)} USING (doc_id)))"""
ORACLE_SQL["pipeline_decisions"] = f"""WITH RECURSIVE base AS MATERIALIZED (SELECT doc_id, text, failures,
    CASE WHEN text <> '' THEN min(CASE WHEN text <> '' THEN doc_id END) OVER (PARTITION BY md5({_comparable_sql('normalized')})) END AS first_ord FROM {_JUDGED}),
  good AS MATERIALIZED (SELECT doc_id, text FROM base WHERE first_ord = doc_id AND failures = ''), {_greedy_ctes('good')}
  SELECT doc_id, CASE WHEN text = '' THEN 'empty' WHEN first_ord <> doc_id THEN 'exact_duplicate' WHEN failures <> '' THEN 'quality'
    WHEN is_duplicate THEN 'near_duplicate' ELSE 'kept' END AS stage, first_ord, matched_ord, similarity FROM base LEFT JOIN near USING (doc_id)"""
ORACLE_SQL["pipeline_stats"] = f"SELECT stage, count(*) AS n FROM ({ORACLE_SQL['pipeline_decisions']}) GROUP BY stage"


@query
def hash_sample(spark, sf_dir):
    """A sample of 100: the row limit is the feature."""
    return P.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, 7, "doc_id")


ORACLE_SQL["hash_sample"] = "SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100"

# Batches and shards -------------------------------------------------------------


@query
def adaptive_batches(spark, sf_dir):
    """Sequential packing in one partition."""
    return batching.adaptive_batches(documents(spark, sf_dir), partitions=1)


_PACKED = f"""s AS MATERIALIZED (SELECT ord, length, row_number() OVER (ORDER BY length, ord) AS pos FROM (SELECT doc_id AS ord, length(text) AS length FROM documents)),
  r AS (SELECT pos, ord, length, 1 AS n, 0::BIGINT AS batch_id FROM s WHERE pos = 1 UNION ALL
    SELECT pos, ord, length, CASE WHEN full_ THEN 1 ELSE n + 1 END, CASE WHEN full_ THEN batch_id + 1 ELSE batch_id END FROM
    (SELECT s.pos, s.ord, s.length, r.n, r.batch_id, r.n + 1 > {batching.MAX_SIZE} OR s.length * (r.n + 1) > {batching.MAX_TOKENS} AS full_ FROM r JOIN s ON s.pos = r.pos + 1))"""
ORACLE_SQL["adaptive_batches"] = f"WITH RECURSIVE {_PACKED} SELECT ord, length, batch_id FROM r"


@query
def padding_efficiency(spark, sf_dir):
    """Of the sequential packing: with more partitions it depends on their number."""
    return batching.padding_efficiency(batching.adaptive_batches(documents(spark, sf_dir), partitions=1))


ORACLE_SQL["padding_efficiency"] = f"""WITH RECURSIVE {_PACKED} SELECT CAST(sum(real) AS DOUBLE) / CAST(sum(padded) AS DOUBLE) AS padding_efficiency
  FROM (SELECT sum(length) AS real, max(length) * count(*) AS padded FROM r GROUP BY batch_id)"""


@query
def embed_hash(spark, sf_dir):
    return batching.embed_all(documents(spark, sf_dir), batching.HashingEncoder)


@query
def shard_assignment(spark, sf_dir):
    x = shards.assign_shards(documents(spark, sf_dir).select("ord"), 64)
    return x.select(F.col("ord").alias("doc_id"), "position", F.col("shard").cast("long").alias("shard"))


ORACLE_SQL["shard_assignment"] = "SELECT doc_id, position, position // 64 AS shard FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents)"


@query
def shard_sizes(spark, sf_dir):
    x = shards.assign_shards(documents(spark, sf_dir).select("ord"), 64)
    return x.groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("records"))


ORACLE_SQL["shard_sizes"] = "SELECT position // 64 AS shard, count(*) AS records FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents) GROUP BY 1"


def _sink(spark, kind: str) -> str:
    return f"{shared_dir(spark)}/corpusforge/{kind}-{uuid.uuid4().hex}"


@query
def jsonl_round_trip(spark, sf_dir):
    """Documents written as JSON lines in shards and read again by the manifest, with their places."""
    at = _sink(spark, "jsonl")
    shards.write_jsonl_shards(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "doc_id", "text"), at, 64)
    x = shards.read_shards(spark, at).select("position", F.from_json("value", "doc_id long, text string").alias("r"))
    return x.select("position", "r.doc_id", "r.text")


ORACLE_SQL["jsonl_round_trip"] = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id, text FROM documents"


@query
def parquet_round_trip(spark, sf_dir):
    """Documents written as Parquet in shards and read again, each with its shard's name and what the manifest says of it."""
    at = _sink(spark, "parquet")
    manifest = shards.write_parquet_shards(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "doc_id", "lang"), at, 64)
    listed = spark.createDataFrame([(x["path"], x["records"]) for x in manifest["shards"]], "path string, records long")
    rows = spark.read.parquet(*[f"{at}/{x['path']}" for x in manifest["shards"]]).select("doc_id", "lang", F.col("_metadata.file_name").alias("path"))
    return rows.join(listed, "path")


ORACLE_SQL["parquet_round_trip"] = """SELECT doc_id, lang, path, count(*) OVER (PARTITION BY path) AS records FROM
  (SELECT doc_id, lang, 'shard-' || lpad(CAST((row_number() OVER (ORDER BY doc_id) - 1) // 64 AS VARCHAR), 5, '0') || '.parquet' AS path FROM documents)"""


@query
def numbered_scan(spark, sf_dir):
    """Lines of a text file with their numbers: those of the JSON lines that the documents make, read as text."""
    at = _sink(spark, "lines")
    text = table(spark, sf_dir, "documents").orderBy("doc_id").select(F.concat(F.lit("u"), "doc_id", F.lit(" "), "n_chars").alias("value"))
    text.repartitionByRange(1, "value").sortWithinPartitions(F.regexp_extract("value", "[0-9]+", 0).cast("long")).write.text(at)
    return records.numbered_lines(spark, at)


ORACLE_SQL["numbered_scan"] = "SELECT row_number() OVER (ORDER BY doc_id) AS ord, 'u' || doc_id || ' ' || n_chars AS value FROM documents"


@query
def malformed_accounting(spark, sf_dir):
    """JSON lines made from the documents, with faults put in, through the strict scan."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.to_json(F.struct(F.concat(F.lit("u"), "doc_id").alias("url"), "text")).alias("j"))
    k = F.col("ord") % 10
    value = (
        F.when(k == 1, F.substring("j", 1, 20)).when(k == 2, F.concat("j", F.lit(" trailing"))).when(k == 3, "[1]").when(k == 4, "null")
        .when(k == 5, F.lit('{"text": "no url"}')).when(k == 6, F.lit('{"url": 5}')).when(k == 7, F.lit("  ")).otherwise(F.col("j"))
    )
    return records.parse_lines(d.select("ord", value.alias("value"))).groupBy("malformed").agg(F.count(F.lit(1)).alias("n"))


ORACLE_SQL["malformed_accounting"] = "SELECT doc_id % 10 IN (1, 2, 3, 4, 5, 6) AS malformed, count(*) AS n FROM documents WHERE doc_id % 10 <> 7 GROUP BY 1"

# Listings and prices ------------------------------------------------------------

_DAY = "DATE '1997-06-01'"


def raw_listings(spark, sf_dir) -> DataFrame:
    """Orders as scraped listings, with faults by order number."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    price = F.when(k % 11 == 0, "auf Anfrage").when(k % 13 == 0, "").otherwise(F.concat(F.lit("CHF "), F.floor("o_totalprice").cast("string"), F.lit(".—")))
    return o.select(
        F.concat(F.lit("l"), k).alias("url"),
        F.when(k % 7 == 0, F.substring(k.cast("string"), 1, 3)).otherwise(F.lpad((k % 9000 + 1000).cast("string"), 4, "0")).alias("zip"),
        listings.strip_chars(price, "CHF .—").alias("price_chf"),
        F.when(k % 5 == 0, "").otherwise(F.concat((k % 6 + 1).cast("string"))).alias("rooms"),
        F.when(k % 3 == 0, "gross").otherwise((k % 200).cast("string")).alias("area_m2"),
        F.when(k % 4 == 0, "").otherwise("1. OG").alias("floor"),
        F.when(k % 6 == 0, "sofort").otherwise(F.date_format("o_orderdate", "d.M.yyyy")).alias("date_available"),
        F.lit(None).cast("string").alias("utilities_chf"),
    )


@query
def listing_clean(spark, sf_dir):
    x = listings.validate_listings(listings.clean_listings(raw_listings(spark, sf_dir)))
    return x.select("url", "zip", F.col("price_chf").cast("long").alias("price_chf"), "rooms", F.col("area_m2").cast("long").alias("area_m2"), "floor", F.col("date_available").cast("string").alias("date_available"))


ORACLE_SQL["listing_clean"] = """SELECT 'l' || o_orderkey AS url, CAST(o_orderkey % 9000 + 1000 AS VARCHAR) AS zip, CAST(floor(o_totalprice) AS BIGINT) AS price_chf,
  CAST(o_orderkey % 6 + 1 AS VARCHAR) AS rooms, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 200 END AS area_m2,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE '1. OG' END AS floor, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date_available
  FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 5 <> 0 AND (o_orderkey % 7 <> 0 OR FALSE)"""


def _history(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("u"), "user_id").alias("url"), F.col("ts").alias("date"), F.floor(F.col("value")).cast("long").alias("price_chf"), "event_id")


_HIST = "(SELECT 'u' || user_id AS url, ts AS date, CAST(floor(value) AS BIGINT) AS price_chf, event_id FROM events)"
_LATEST = f"(SELECT url, max_by(price_chf, (date, event_id, price_chf)) AS latest_price_chf FROM {_HIST} GROUP BY url)"


@query
def price_latest(spark, sf_dir):
    return listings.latest_prices(_history(spark, sf_dir), tie="event_id")


ORACLE_SQL["price_latest"] = f"SELECT url, latest_price_chf FROM {_LATEST}"


@query
def price_changes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey")).alias("url"), (F.col("c_custkey") % 50).alias("price_chf"))
    return listings.price_changes(c, _history(spark, sf_dir), tie="event_id")


ORACLE_SQL["price_changes"] = f"SELECT c.url, c.price_chf FROM (SELECT 'u' || c_custkey AS url, c_custkey % 50 AS price_chf FROM customer) c LEFT JOIN {_LATEST} USING (url) WHERE c.price_chf IS DISTINCT FROM latest_price_chf"


def _listed(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.concat(F.lit("u"), "o_custkey").alias("url")).agg(F.max("o_orderdate").cast("date").alias("date_last_seen"))


_LISTED = "(SELECT 'u' || o_custkey AS url, CAST(max(o_orderdate) AS DATE) AS date_last_seen FROM orders GROUP BY o_custkey)"


def _links(spark, sf_dir, new: bool) -> DataFrame:
    """Links of the events, with query strings, of which the suppliers' are listed already."""
    links = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id", F.lit("?from="), "event_type").alias("url"))
    listed = table(spark, sf_dir, "supplier").select(F.concat(F.lit("u"), "s_suppkey").alias("url"))
    return listings.split_seen(links, listed)[new].distinct()


@query
def visited_antijoin(spark, sf_dir):
    return _links(spark, sf_dir, True)


@query
def visited_known(spark, sf_dir):
    return _links(spark, sf_dir, False)


ORACLE_SQL["visited_antijoin"] = "SELECT DISTINCT 'u' || user_id AS url FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)"
ORACLE_SQL["visited_known"] = "SELECT DISTINCT 'u' || user_id AS url FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier)"


@query
def touch_last_seen(spark, sf_dir):
    x = listings.touch_last_seen(_listed(spark, sf_dir), _history(spark, sf_dir), F.expr(_DAY))
    return x.select("url", F.col("date_last_seen").cast("string").alias("date_last_seen"))


ORACLE_SQL["touch_last_seen"] = f"SELECT url, CAST(CASE WHEN url IN (SELECT url FROM {_HIST}) THEN {_DAY} ELSE date_last_seen END AS VARCHAR) AS date_last_seen FROM {_LISTED}"


@query
def recheck_due(spark, sf_dir):
    """Each order as a listing seen on its date; some were seen seven days before, which is out."""
    seen = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("url"), F.col("o_orderdate").cast("date").alias("date_last_seen"))
    return listings.due_for_check(seen, F.expr(_DAY))


ORACLE_SQL["recheck_due"] = f"SELECT 'o' || o_orderkey AS url FROM orders WHERE CAST(o_orderdate AS DATE) > {_DAY} - INTERVAL 7 DAY"


@query
def listing_insert(spark, sf_dir):
    """Rows that new items add to the listings and to the prices, in one table."""
    items = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("url"), F.floor("p_retailprice").cast("long").alias("price_chf"))
    rows, prices = listings.insert_listings(items, F.expr(_DAY))
    rows = rows.select(F.lit("listing").alias("kind"), "url", "price_chf", F.col("date_scraped").cast("string").alias("scraped"), F.col("date_last_seen").cast("string").alias("date"))
    return rows.unionByName(prices.select(F.lit("price").alias("kind"), "url", "price_chf", F.lit(None).cast("string").alias("scraped"), F.col("date").cast("string").alias("date")))


ORACLE_SQL["listing_insert"] = f"""SELECT kind, 'p' || p_partkey AS url, CAST(floor(p_retailprice) AS BIGINT) AS price_chf,
  CASE WHEN kind = 'listing' THEN CAST({_DAY} AS VARCHAR) END AS scraped, CAST({_DAY} AS VARCHAR) AS date FROM part, (VALUES ('listing'), ('price')) AS k(kind)"""


@query
def price_append(spark, sf_dir):
    """The price history with a row for each checked price."""
    checked = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey")).alias("url"), (F.col("c_custkey") % 50).alias("price_chf"))
    history = _history(spark, sf_dir).select("url", F.col("date").cast("date").alias("date"), "price_chf")
    return listings.append_prices(history, checked, F.expr(_DAY)).withColumn("date", F.col("date").cast("string"))


ORACLE_SQL["price_append"] = f"""SELECT url, CAST(CAST(date AS DATE) AS VARCHAR) AS date, price_chf FROM {_HIST}
  UNION ALL SELECT 'u' || c_custkey, CAST({_DAY} AS VARCHAR), c_custkey % 50 FROM customer"""


@query
def price_validate(spark, sf_dir):
    """Checked prices as scraped text: what is no whole number goes."""
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, "").when(k % 7 == 0, "12.5").when(k % 3 == 0, F.concat(F.lit(" "), k.cast("string"))).otherwise(k.cast("string"))
    checked = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), k).alias("url"), text.alias("price_chf"))
    return listings.validate_prices(checked).withColumn("price_chf", F.col("price_chf").cast("long"))


ORACLE_SQL["price_validate"] = "SELECT 'u' || c_custkey AS url, c_custkey AS price_chf FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0"


@query
def listing_load(spark, sf_dir):
    """Scraped arrays of strings to fields: the n-th value, stripped; empty is null."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    junk, none = F.lit("x"), F.array().cast("array<string>")
    raw = o.select(
        F.concat(F.lit("l"), k).alias("url"),
        F.array(F.concat(F.lit("Street "), k)).alias("address"),
        F.array(junk, F.lpad(k, 4, "0")).alias("zip"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(junk, junk, junk, F.lit("Town"))).otherwise(none).alias("city"),
        F.array(junk, junk, junk, junk, F.lit("ZH, ")).alias("canton"),
        F.array(F.concat(k, F.lit(" Zimer"))).alias("rooms"),
        F.array(junk, junk, F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.concat(k, F.lit(" m²")))).alias("area_m2"),
        F.array(F.concat(F.lit("CHF "), k, F.lit(".—"))).alias("price_chf"),
    )
    return listings.load_items(raw)


ORACLE_SQL["listing_load"] = """SELECT 'l' || o_orderkey AS url, 'Street ' || o_orderkey AS address, lpad(o_orderkey::VARCHAR, 4, '0') AS zip,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Town' END AS city, 'ZH' AS canton, o_orderkey::VARCHAR AS rooms,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey::VARCHAR END AS area_m2, o_orderkey::VARCHAR AS price_chf FROM orders"""


@query
def result_pages(spark, sf_dir):
    c = table(spark, sf_dir, "nation").select(F.col("n_name").alias("url"), (F.col("n_nationkey") % 7).cast("int").alias("last_page"))
    return listings.result_pages(c).withColumn("page", F.col("page").cast("long"))


ORACLE_SQL["result_pages"] = "SELECT n_name AS url, unnest(range(2, n_nationkey % 7 + 1)) AS page FROM nation"


@query
def arrivals_rank(spark, sf_dir):
    """Order of arrival of each document within its source: what first-wins operators go by."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.row_number().over(W.partitionBy("source").orderBy("doc_id")).cast("long").alias("arrival"))


ORACLE_SQL["arrivals_rank"] = "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS arrival FROM documents"
