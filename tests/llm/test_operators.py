"""Decontamination, license scan, line dedup and the pipeline against plain versions and planted cases."""

import math
import random
import time
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from test_contracts import run, words
from pyspark.sql import functions as F

import corpus_pipeline
from corpusforge.llm import license_scan as L
from corpusforge.llm import line_dedup
from corpusforge.llm.decontaminate import K1, B, OVERLAP, SHINGLE, THRESHOLD, ItemIndex, drop_leaks, find_leaks, split_item

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def low(t):
    return (t or "").encode().lower().split()


# 4 ------------------------------------------------------------------------------


def plain_leaks(docs, items):
    """Every passage against every item, by the formula."""
    items = [(i, t, low(t)) for i, t in items if low(t)]
    df = Counter(x for *_, w in items for x in set(w))
    mean, step = sum(len(w) for *_, w in items) / len(items), max(len(w) for *_, w in items)
    sh = lambda w: {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()

    def parts(w):
        tf = Counter(w)
        return {x: math.log(1 + (len(items) - df[x] + 0.5) / (df[x] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean)) for x, n in tf.items()}

    scored = [(i, t, w, p, sum(p.values()), sh(w)) for i, t, w in items for p in [parts(w)]]
    out = set()
    for d, text in docs:
        w = low(text)
        for p in range(max(1, -(-len(w) // step) - 1)):
            passage = w[p * step : (p + 2) * step]
            have, bag = sh(passage), Counter(passage)
            for i, t, iw, weights, own, ish in scored:
                if sum(s for x, s in weights.items() if x in bag) / own < THRESHOLD:
                    continue
                question, answer = split_item(t)
                share = lambda s: len(s & have) / len(s) if s else 1.0
                a = sum(min(n, bag[x]) for x, n in Counter(answer).items()) / max(1, len(answer))
                if share(ish) >= OVERLAP and max(share(sh(question)), a) >= OVERLAP:
                    out.add((d, i))
    return out


def planted(spark, hard, hard_rows):
    """Items inside long texts, whole, edited and at every offset; halves of items, which do not leak."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{hard}/benchmark.parquet").collect()]
    filler = [f"filler{i % 301}" for i in range(400)]
    rows, leaks = [], set()
    for k, (i, t) in enumerate(items[:24]):
        w = t.split()
        if k % 3 == 1 and len(w) > 60:
            w[len(w) // 2] = "changed"
        if k % 3 == 2:
            w = w[: len(w) // 3]
        else:
            leaks.add((700_000 + k, i))
        rows.append((700_000 + k, " ".join([*filler[: 17 * k], *w, *filler])))
    return items, rows + [(d["doc_id"], d["text"]) for d in hard_rows[:120]] + [(None, None), (700_100, "")], leaks


def test_op4_equals_plain_search_and_finds_planted(spark, hard, hard_rows):
    items, rows, leaks = planted(spark, hard, hard_rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([*items, (9_999, None), (9_998, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, bench).collect()}
    assert got == plain_leaks(rows, items)
    assert leaks <= got
    left = {r["doc_id"] for r in drop_leaks(docs, bench).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in got}


def test_op4_shards_give_the_results_of_one_index(spark, hard, hard_rows, monkeypatch):
    from corpusforge.llm import decontaminate

    items, rows, _ = planted(spark, hard, hard_rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (9_999, None), (9_998, ""), (items[0][0], items[0][1].upper())], "item_id long, text string")
    found = lambda: sorted((r["doc_id"], r["item_id"], round(r["score"], 9), r["item_overlap"], r["question_overlap"], r["answer_overlap"]) for r in find_leaks(docs, bench).collect())
    want = found()
    left = Counter(r["doc_id"] for r in drop_leaks(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", sum(len(t) for _, t in items) // 5)
    assert len(list(decontaminate.shards(bench))) > 3
    assert found() == want and want
    assert Counter(r["doc_id"] for r in drop_leaks(docs, bench).collect()) == left


def test_op4_screen_gathers_few_cells_at_once():
    """Many passages and blocks of items: the matrix of block maxima is gathered for some passages at a time."""
    r = random.Random(4)
    items = [(k, " ".join(f"w{r.randrange(3000)}" for _ in range(12)) + ".") for k in range(2000)]
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(9000)) + " " + items[k][1] for k in (3, 900)]
    index, cells = ItemIndex(items), []

    class Seen:
        shape, own = index.bound.shape, index.bound

        def __getitem__(self, at):
            got = self.own[at]
            cells.append(got.size)
            return got

    index.bound = None
    plain = index.search(texts)
    index.bound = Seen()
    assert index.search(texts) == plain and [[index.ids[k] for k in x] for x in plain] == [[3], [900]]
    assert cells and max(cells) <= 1_000_000


def test_slices_hold_all_rows_in_order_and_few_at_once():
    from corpusforge.session import slices

    batches = [pa.record_batch({"x": list(range(a, b))}) for a, b in ((0, 600), (600, 600), (600, 601))]
    got = list(slices(batches))
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(601)) and max(b.num_rows for b in got) <= 256


def test_op4_wand_equals_full_scores():
    r = random.Random(1)
    vocab = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(r.choices(vocab, k=r.randint(1, 12)))) for i in range(60)]
    index = ItemIndex(items, 0.4)
    for _ in range(100):
        terms = sorted(r.sample(range(len(index.vocab)), r.randint(1, 15)))
        full = defaultdict(float)
        for t in terms:
            for d, s in zip(index.docs[t], index.weights[t]):
                full[d] += s
        got = dict(index.retrieve(terms))
        assert got.keys() == {d for d, s in full.items() if s >= 0.4 - 1e-9}


# 6 ------------------------------------------------------------------------------


def test_op6_longest_increasing_and_alignment():
    r = random.Random(2)
    for _ in range(100):
        seq = r.sample(range(30), r.randint(0, 12))
        got = L.longest_increasing(seq)
        best = [1] * len(seq)
        for i in range(len(seq)):
            best[i] = 1 + max((best[j] for j in range(i) if seq[j] < seq[i]), default=0)
        assert len(got) == max(best, default=0) and [seq[k] for k in got] == sorted(seq[k] for k in got)
        a, b = (r.choices("abcdefgh", k=r.randint(0, 15)) for _ in range(2))
        pairs = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and x < y for (p, x), (q, y) in zip(pairs, pairs[1:]))


@pytest.mark.parametrize("name", sorted(L.TEMPLATES))
def test_op6_finds_edited_templates_and_not_halves(name):
    text = L.TEMPLATES[name]
    scan = L.Scanner().scan
    shown = f"Prose goes before it, quite plainly.\n{text.upper()}\nAnd more prose comes after it."
    hits = scan(shown)
    assert [h[0] for h in hits] == [name] and hits[0][3] == 1.0
    assert shown[hits[0][1] : hits[0][2]].upper() in text.upper() + "."
    w = text.split()
    if len(w) > 30:
        # Whatever the edit hits: each twelfth word gone, or changed, from any offset.
        for off in range(0, 12, 5):
            for new in ("", "edited"):
                hits = scan(" ".join(x if k % 12 != off else new for k, x in enumerate(w)))
                assert hits and hits[0][3] >= L.COVERAGE and set(L.words_of(L.TEMPLATES[hits[0][0]])) & set(L.words_of(text))
                assert hits[0][0] == name or len(set(L.words_of(L.TEMPLATES[hits[0][0]])) ^ set(L.words_of(text))) < 40
        assert name not in [h[0] for h in scan(" ".join(w[: len(w) // 2]))]


def test_op6_alignment_finds_what_brute_force_finds():
    """Random small templates in random text: a hit wherever a window holds enough of a template's words in order, and only there."""
    r = random.Random(9)
    vocab = [f"v{i}" for i in range(30)]
    templates = {f"t{k}": " ".join(r.sample(vocab, r.randint(4, 9))) for k in range(3)}
    scanner = L.Scanner(templates)

    def possible(words, template):
        """Some window of the allowed length has the whole template in order (templates are shorter than SHORT)."""
        n = len(template)
        for a in range(len(words)):
            k = 0
            for w in words[a : a + int(max(L.SLACK * n, n + 2))]:
                k += k < n and w == template[k]
            if k == n and words[a] == template[0]:
                return True
        return False

    found = 0
    for _ in range(400):
        words = r.choices(vocab + [f"x{i}" for i in range(30)], k=r.randint(0, 25))
        for t in r.sample(list(templates.values()), r.randint(0, 2)):
            w = t.split()
            if r.random() < 0.3:
                w[r.randrange(len(w))] = "edit"
            for _ in range(r.randint(0, 2)):
                w.insert(r.randrange(len(w)), "more")
            at = r.randint(0, len(words))
            words[at:at] = w
        hits = scanner.scan(" ".join(words))
        want = {k for k, t in templates.items() if possible(words, t.split())}
        got = {h[0] for h in hits}
        assert got <= want
        spans = [(a, b) for _, a, b, *_ in hits]
        assert all(b <= c or d <= a for k, (a, b) in enumerate(spans) for c, d in spans[k + 1 :])
        # A template is missed only if a longer hit took its words.
        if len(want) == 1:
            found += 1
            assert got == want, (words, templates)
    assert found > 50


def test_op6_query(spark, hard, hard_rows):
    got = Counter((r["doc_id"], r["license"], r["start"], r["end"]) for r in run(spark, "op6_license_scan", hard))
    scan = L.Scanner().scan
    assert got == Counter((d["doc_id"], *h[:3]) for d in hard_rows for h in scan(d["text"]))
    assert scan(None) == scan("") == []


# 10 -----------------------------------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"


def plain_lines(rows, k):
    sites, owner = defaultdict(set), {}
    for d in rows:
        for x in (d["text"] or "").split("\n"):
            if x := x.strip(SPACE):
                sites[x] |= {d["source"]} - {None}
                owner[x] = min((i for i in (owner.get(x), d["doc_id"]) if i is not None), default=None)
    out = Counter()
    for d in rows:
        n, keep, seen, lines = 0, [], set(), (d["text"] or "").split("\n")
        for x in lines:
            bare = x.strip(SPACE)
            n += bool(bare)
            if bare and len(sites[bare]) >= k:
                if owner[bare] != d["doc_id"] or bare in seen:
                    continue
                seen.add(bare)
            keep.append(x)
        out[d["doc_id"], n, len(lines) - len(keep), None if d["text"] is None else "\n".join(keep)] += 1
    return out


@pytest.mark.parametrize("broadcast", [10**6, 0])
@pytest.mark.parametrize("k", [2, line_dedup.MIN_SITES])
def test_op10_both_ways_equal_plain(spark, hard_rows, k, broadcast):
    line = "this line stands on many sites"
    rows = hard_rows + [{"doc_id": 910_000 + i, "text": f"own {i}\n {line}\n\n{line}\nend {i}", "lang": "en", "source": f"s{i % 9}", "n_chars": 1} for i in range(40)]
    rows += [{"doc_id": None, "text": line, "lang": None, "source": None, "n_chars": None}]
    df = spark.createDataFrame([tuple(d[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for d in rows], DOC)
    got = line_dedup.dedup_lines(df.withColumn("__site_", F.lit(1)), min_sites=k, broadcast_lines=broadcast)
    have = Counter((r["doc_id"], r["__cf_n_lines"], r["__cf_n_removed"], r["text"]) for r in got.collect())
    assert have == plain_lines(rows, k)
    assert have[910_000, 4, 1, f"own 0\n {line}\n\nend 0"] == 1 and have[910_001, 4, 2, "own 1\n\nend 1"] == 1


def test_op10_query_equals_sql(spark, hard, hard_rows):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{hard}/documents.parquet/*.parquet'")
    got = Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in run(spark, "op10_line_dedup", hard))
    assert got == Counter(con.execute(f"SELECT doc_id, n_lines, n_removed, text FROM ({line_dedup.ORACLE})").fetchall())
    assert got == plain_lines(hard_rows, line_dedup.MIN_SITES)


# Pipeline -----------------------------------------------------------------------


def grams(t):
    w = low(t)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def near_survivors(rows):
    """Smallest id of each set of texts that are linked by a Jaccard similarity of 0.8 over 5-word shingles."""
    rows = sorted(rows)
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if min(len(x), len(sets[j])) >= 0.8 * max(len(x), len(sets[j])) and len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    first = {}
    for (i, _), r in zip(rows, root):
        first.setdefault(r, i)
    return set(first.values())


def test_pipeline_stages_take_effect(spark, hard, hard_rows):
    """Planted cases among the documents: each stage drops its own and keeps the clean ones."""
    r = random.Random(4)
    vocab = sorted({w for d in hard_rows[:150] for w in words(d["text"]) if w.isalpha()})
    prose = lambda: "\n".join(" ".join(r.choices(vocab, k=30)) + "." for _ in range(6))
    clean = {600_000 + i: prose() for i in range(10)}
    junk = {601_000 + i: "buy now " * 40 for i in range(3)}
    long = " ".join(r.choices(vocab, k=2000))
    copies = {602_000 + i: long + f" tail{i}" for i in range(5)}
    footer = "read the terms of all our many sites before you go on"
    footed = {603_000 + i: prose() + "\n" + footer for i in range(20)}
    item = spark.read.parquet(f"{hard}/benchmark.parquet").first()["text"]
    leaked = {604_000 + i: prose() + "\n" + item for i in range(2)}
    rows = [(i, t, "en", f"src{i % 12}", len(t)) for x in (clean, junk, copies, footed, leaked) for i, t in x.items()]
    docs = spark.read.parquet(f"{hard}/documents.parquet").unionByName(spark.createDataFrame(rows, DOC))
    ids, texts = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, hard), name)
        got = out.collect()
        if name != "mixing":
            assert out.schema == docs.schema
        assert {x["doc_id"] for x in got} <= {x["doc_id"] for x in docs.collect()}
        ids[name], texts[name] = {x["doc_id"] for x in got}, {x["doc_id"]: x["text"] for x in got}
        if name == "near_dedup":
            assert ids[name] == near_survivors([(x["doc_id"], x["text"]) for x in docs.collect()])
        docs = out
    assert not ids["quality_rules"] & junk.keys()
    assert footed.keys() <= ids["line_dedup"] and sum(footer in texts["line_dedup"][i] for i in footed) == 1
    assert ids["near_dedup"] & copies.keys() == {602_000}
    assert leaked.keys() <= ids["near_dedup"] and not ids["decontaminate"] & leaked.keys()
    assert clean.keys() | footed.keys() <= ids["decontaminate"]
    assert ids["mixing"]


def test_near_dedup_drops_near_copies_and_only_those(spark):
    """Copies with changed words are dropped where their exact 5-word Jaccard is 0.8 at least, and no others.

    The grids find a pair at the threshold with probability RECALL; what is dropped is verified, so nothing else goes.
    """
    from corpusforge.llm.near_text import stage_near_dedup

    r = random.Random(11)
    prose = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]

    rows, near = [], 0
    for i in range(300):
        a = prose(200)
        b = list(a)
        for k in range(1 + i % 6):
            b[20 + 30 * k] = f"new{i}x{k}"
        a, b = " ".join(a), " ".join(b)
        x, y = grams(a), grams(b)
        near += len(x & y) >= 0.8 * len(x | y)
        rows += [(2 * i, a), (2 * i + 1, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC).repartition(4)
    kept = Counter((x["doc_id"], x["text"]) for x in stage_near_dedup(spark, docs, "").collect())
    want = Counter()
    for i, t in rows:
        if not i % 2:
            want[i, t] += 1
        else:
            x, y = grams(rows[i - 1][1]), grams(t)
            want[i, t] += len(x & y) < 0.8 * len(x | y)
    want, extra = +want, kept - +want
    assert near >= 150 and not want - kept and extra.total() <= 0.04 * near, (near, extra.total())


def test_near_dedup_joins_a_large_group_of_near_copies(spark, monkeypatch):
    """Hundreds of edited copies of one text, in dense cells, narrow and wide: groups are those of brute force."""
    from corpusforge.llm import near_text

    r = random.Random(13)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(r.randrange(0, 8)):
            w[r.randrange(120)] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC).repartition(4)
    want = near_survivors(rows)
    for wide in (near_text.WIDE, 40):
        monkeypatch.setattr(near_text, "WIDE", wide)
        got = {x["doc_id"] for x in near_text.stage_near_dedup(spark, docs, "").collect()}
        assert want <= got and len(got - want) <= 0.05 * len(rows), (len(want), len(got))


def test_near_dedup_sends_no_texts_that_are_near_no_other(spark):
    """Only the texts of candidate pairs are shuffled, also where their list is too long to be broadcast."""
    from corpusforge.llm.near_text import near_groups

    r = random.Random(14)
    prose = lambda: " ".join(f"{r.randrange(10**9)}" for _ in range(4000))
    rows = [(i, prose()) for i in range(150)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()

    def written():
        sc = spark.sparkContext._jsc.sc()
        for _ in range(3):
            spark.range(1).count()
            time.sleep(0.2)
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        gone, _ = near_groups(docs)
        after = written()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {x["id"] for x in gone.collect()} == {1000 + i for i in range(10)}
    assert 0 < after - before < 0.5 * sum(len(t) for _, t in rows), (after - before, sum(len(t) for _, t in rows))


def test_near_dedup_sends_members_and_not_pairs_of_a_group_below_the_threshold(spark, monkeypatch):
    """Texts of one group, most at some 0.7 and some at 0.8: rows that are verified grow with the texts, and groups are those of brute force."""
    from corpusforge.llm import near_text

    r = random.Random(15)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(160):
        w = list(base) if i % 8 else list(rows[-1][1].split()) if rows else list(base)
        for k in r.sample(range(5, 115), 2 if i % 8 else 1):
            w[k] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC).repartition(4)
    sent, own = [], near_text.verified
    monkeypatch.setattr(near_text, "SMALL", 2)
    monkeypatch.setattr(near_text, "verified", lambda pairs, *a: sent.append(pairs.count()) or own(pairs, *a))
    got = {x["doc_id"] for x in near_text.stage_near_dedup(spark, docs, "").collect()}
    want = near_survivors(rows)
    assert len(want) < len(rows) and want <= got and len(got - want) <= 0.05 * len(rows), (len(want), len(got))
    assert sum(sent) <= 20 * len(rows), sent


def test_near_dedup_keeps_different_texts_under_null_and_repeated_ids(spark):
    from corpusforge.llm.near_text import stage_near_dedup

    r = random.Random(12)
    prose = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(50))
    rows = [(None, prose()) for _ in range(4)] + [(7, prose()) for _ in range(3)] + [(8, prose())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows + [rows[0], rows[4], (9, rows[7][1])]], DOC).repartition(4)
    assert Counter((x["doc_id"], x["text"]) for x in stage_near_dedup(spark, docs, "").collect()) == Counter(rows)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_empty_and_clashing(spark, empty, hard, stage):
    name, f = stage
    none = spark.read.parquet(f"{empty}/documents.parquet")
    assert f(spark, none, empty).collect() == []
    docs = spark.read.parquet(f"{hard}/documents.parquet").withColumns({"n_words": F.lit(1), "fp": F.lit("x"), "size": F.lit(2), "key": F.lit(3), "source_size": F.lit(4)})
    out = f(spark, docs, hard)
    assert set(docs.columns) <= set(out.columns) and out.count()
