"""Extraction, batches, shards, record scan and listings."""

import datetime as dt
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import batching, extract, listings
from corpusforge.sources import records, shards

BODY = "A paragraph of the article that is long enough to count as its body text."
PAGE = f"""<html><head><title>Fish &amp; Chips</title><style>p {{}}</style></head><body><nav><a href=x>Home</a> <a href=y>News</a></nav>
<article><h1>Headline</h1><p>{BODY} With <em>stress</em>ed words.</p><p>{BODY} Again.</p></article>
<script>var x = "<p>no</p>";</script><footer>Imprint and more of it, which is no part of the text.</footer></body></html>"""


def test_extract_page(spark):
    text, title = extract.extract(PAGE)
    assert title == "Fish & Chips"
    assert text.split("\n\n") == ["Headline", f"{BODY} With stressed words.", f"{BODY} Again."]
    df = spark.createDataFrame([(0, PAGE), (1, None), (2, "")], "i int, html string")
    got = {r["i"]: tuple(r["extracted"]) for r in extract.extract_html(df).collect()}
    assert got == {0: (text, title), 1: ("", None), 2: ("", None)}


@pytest.mark.parametrize(
    "html, want",
    [
        ("   ", ("", None)),
        ("<title>T</title><body></body>", ("", "T")),
        (f"<p>{BODY}<p>{BODY}", (f"{BODY}\n\n{BODY}", None)),
        (f"<p>{BODY}</p><embed src=a><p>{BODY}</p>", (BODY, None)),
        (f"<p>{BODY}</p><embed/><p>{BODY}</p>", (f"{BODY}\n\n{BODY}", None)),
        (f"<svg><title>S</title></svg><title>A</title><title>B</title><p>{BODY}", (BODY, "AB")),
        ("<title>1 &amp;lt; 2</title>", ("", "1 < 2")),
    ],
)
def test_extract_edges(html, want):
    assert extract.extract(html) == want


def test_best_run_equals_all_runs(spark):
    r = random.Random(7)
    arrays = [[float(r.randint(0, 20)) for _ in range(r.randint(0, 12))] for _ in range(60)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, s array<double>")
    native = {x["i"]: (x["r"]["start"], x["r"]["end"]) for x in df.select("i", extract.best_run_native(F.col("s")).alias("r")).collect()}
    for i, a in enumerate(arrays):
        assert extract.best_run(a) == native[i]
        if a:
            half = sum(a) / len(a) / 2
            worth = lambda p: sum(a[p[0] : p[1]]) - half * (p[1] - p[0])
            assert worth(native[i]) == pytest.approx(max(worth((x, y)) for x in range(len(a)) for y in range(x + 1, len(a) + 1)))


def test_batches(spark):
    r = random.Random(3)
    texts = ["x" * r.choice([1, 5, 90, 500, 4000, 20_000]) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    one = batching.adaptive_batches(df, partitions=1)
    got = sorted(((x["length"], x["ord"]), x["batch_id"]) for x in one.collect())
    assert [b for _, b in got] == batching.pack(k[0] for k, _ in got)
    for frame in (one, batching.adaptive_batches(df, partitions=4)):
        s = batching.batch_stats(frame).collect()
        assert sum(x["size"] for x in s) == 150
        assert all(x["size"] <= 64 and (x["padded_tokens"] <= 16_384 or x["size"] == 1) for x in s)
    sorted_, plain = (batching.padding_efficiency(batching.adaptive_batches(df, partitions=1, sort_by_length=b)).first()[0] for b in (True, False))
    assert 0 < plain < sorted_ <= 1
    assert batching.padding_efficiency(batching.adaptive_batches(df.limit(0))).first()[0] == 1.0
    with pytest.raises(ValueError):
        batching.adaptive_batches(df, max_size=0)


def test_embed_all(spark):
    df = spark.createDataFrame([(i, f"word{i} " * i) for i in range(70)], "ord long, text string")
    got = {r["ord"]: r["embedding"] for r in batching.embed_all(df, batching.HashingEncoder).collect()}
    want = batching.HashingEncoder().encode([f"word{i} " * i for i in range(70)])
    assert len(got) == 70
    for i in range(70):
        assert got[i] == pytest.approx(want[i], abs=1e-6)

    class Short:
        def encode(self, texts):
            return [[0.0]]

    with pytest.raises(Exception, match="1 vectors for"):
        batching.embed_all(df.coalesce(1), Short).collect()
    assert batching.select_device("cuda") == "cuda" and batching.select_device() in ("cpu", "cuda", "mps")


@pytest.mark.parametrize("compress", [True, False])
def test_jsonl_shards(spark, tmp_path, compress):
    out = str(tmp_path / "o")
    df = spark.createDataFrame([(i * 3, f"téxt {i}") for i in range(25)], "ord long, text string").repartition(4)
    m = shards.write_jsonl_shards(df, out, 6, compress=compress)
    assert [s["records"] for s in m["shards"]] == [6, 6, 6, 6, 1] and m["total_records"] == 25 and m["shard_size"] == 6
    assert m["shards"][0]["path"] == ("shard-00000.jsonl.gz" if compress else "shard-00000.jsonl")
    if compress:
        assert "é" in gzip.open(f"{out}/shard-00000.jsonl.gz", "rt", encoding="utf-8").readline()
    back = shards.read_shards(spark, out).orderBy("position").collect()
    assert [json.loads(r["value"])["text"] for r in back] == [f"téxt {i}" for i in range(25)]
    (tmp_path / "o" / m["shards"][1]["path"]).unlink()
    with pytest.raises(Exception, match="missing"):
        shards.read_shards(spark, out).collect()
    with pytest.raises(Exception, match="manifest"):
        shards.read_shards(spark, str(tmp_path)).collect()


def test_empty_and_parquet_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "ord long, text string").repartition(3)
    assert shards.write_jsonl_shards(df.limit(0), str(tmp_path / "e"), 3)["shards"] == []
    assert shards.read_shards(spark, str(tmp_path / "e")).count() == 0
    m = shards.write_parquet_shards(df, str(tmp_path / "p"), 3)
    assert [s["records"] for s in m["shards"]] == [3, 3, 1] and m["format"] == "parquet" and m["compression"] == "zstd"
    assert [r[0] for r in spark.read.parquet(f"{tmp_path}/p/shard-00001.parquet").collect()] == ["t3", "t4", "t5"]
    with pytest.raises(ValueError):
        shards.assign_shards(df, 0)


def test_record_scan(spark, tmp_path):
    good = ['{"url": "a", "text": "x", "meta": {"k": 1}, "other": 2}', '{"url": "b", "url": "c"}', '{"url": "d", "text": null}']
    bad = ["NOT JSON", '{"url": "a"', '{"text": "x"}', '{"url": "u"} trailing', "{'url': 'u'}", "[1, 2]", "null", "5", '{"url": 5}', '{"url": "u", "text": NaN}']
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join([good[0], "", *bad, "   ", *good[1:]]) + "\n", encoding="utf-8")
    got = records.read_jsonl(spark, str(path)).orderBy("ord").collect()
    assert [r["malformed"] for r in got] == [False] + [True] * len(bad) + [False] * 2
    assert [r["url"] for r in got if not r["malformed"]] == ["a", "c", "d"]
    assert [r["ord"] for r in got] == [1, *range(3, 13), 14, 15] and got[-1]["text"] == "" and json.loads(got[0]["meta"]) == {"k": 1}


def test_listings(spark):
    raw = {
        "address": ["Weg 1"], "zip": ["x", "8001"], "city": ["a", "b", "c", "Zürich"], "canton": ["", "", "", "", "ZH,"],
        "rooms": ["3.5 Zimer"], "area_m2": ["", "", "80 m²"], "price_chf": ["CHF 1200.—"], "date_available": ["", "1.10.2021"], "floor": ["", ""], "utilities_chf": [],
    }
    df = spark.createDataFrame([tuple(raw.values())], ", ".join(f"{k} array<string>" for k in raw))
    r = listings.validate_listings(listings.clean_listings(listings.load_items(df))).first()
    assert (r["zip"], r["city"], r["canton"], r["rooms"], r["area_m2"], r["price_chf"]) == ("8001", "Zürich", "ZH", "3.5", 80, 1200)
    assert r["date_available"] == dt.date(2021, 10, 1) and r["floor"] is None and r["utilities_chf"] is None


def test_price_history_and_due(spark):
    day = lambda d: dt.date(2024, 5, d)
    hist = spark.createDataFrame([("a", day(1), 10), ("a", day(3), 12), ("b", day(2), 5)], "url string, date date, price_chf int")
    now = spark.createDataFrame([("a", 12), ("b", 6), ("new", 1)], "url string, price_chf int")
    assert {r["url"] for r in listings.price_changes(now, hist).collect()} == {"b", "new"}
    seen = spark.createDataFrame([("a", day(1)), ("b", day(8)), ("c", day(9))], "url string, date_last_seen date")
    today = F.lit(day(15))
    assert {r["url"] for r in listings.due_for_check(seen, today).collect()} == {"c"}
    touched = listings.touch_last_seen(seen, spark.createDataFrame([("a",), ("a",)], "url string"), today)
    assert {r["url"]: r["date_last_seen"] for r in touched.collect()} == {"a": day(15), "b": day(8), "c": day(9)}
    known, new = listings.split_seen(spark.createDataFrame([("a?x=1",), ("z",)], "url string"), seen)
    assert [r["url"] for r in known.collect()] == ["a"] and [r["url"] for r in new.collect()] == ["z"]


def test_best_run_of_equal_sums_ends_first(spark):
    """Runs 1 to 6 and 1 to 12 have the same sum, which rounded means told apart."""
    scores = [float(n) for n in [62, 297, 610, 239, 145, 687, 70, 70, 58, 76, 195, 211]]
    twice, total = 2 * len(scores), sum(scores)
    gain = lambda x, y: sum(s * twice - total for s in scores[x:y])
    assert gain(1, 6) == gain(1, 12) == max(gain(x, y) for y in range(len(scores) + 1) for x in range(y))
    assert extract.best_run(scores) == (1, 6)
    got = spark.createDataFrame([(scores,)], "s array<double>").select(extract.best_run_native(F.col("s")).alias("r")).first()["r"]
    assert (got["start"], got["end"]) == (1, 6)


@pytest.mark.parametrize("tokens, size", [(16_384, 64), (50, 3), (7, 5)])
def test_sequential_packing_has_no_task_that_sees_all(spark, monkeypatch, tokens, size):
    r = random.Random(tokens)
    texts = ["x" * r.choice([0, 1, 1, 2, 3, 9, 60, r.randrange(300)]) for _ in range(900)]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, text string").repartition(5)
    parts = []
    write = batching.materialize
    monkeypatch.setattr(batching, "materialize", lambda x, name: parts.append(out := write(x, name)) or out)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = batching.adaptive_batches(df, partitions=1, max_tokens=tokens, max_size=size).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(((x["length"], x["ord"]), x["batch_id"]) for x in rows)
    assert [b for _, b in got] == batching.pack((k[0] for k, _ in got), tokens, size)
    assert parts[0].select("part").distinct().count() > 1


def test_small_shards_are_written_by_many_tasks(spark, tmp_path):
    """Rows of a few bytes, once gathered in one task, which wrote every shard."""
    m = shards.write_parquet_shards(spark.range(400).select(F.col("id").alias("ord"), F.col("id").alias("k")), str(tmp_path / "p"), 10)
    assert [s["records"] for s in m["shards"]] == [10] * 40
    assert all(s["bytes"] == (tmp_path / "p" / s["path"]).stat().st_size for s in m["shards"])
    tasks = set()
    move = shards.Folder.move
    with pytest.MonkeyPatch.context() as mp:
        mp.setattr(shards.Folder, "move", lambda self, name, to: tasks.add(name.split("part-")[1][:5]) or move(self, name, to))
        again = shards.write_parquet_shards(spark.range(400).select(F.col("id").alias("ord"), F.col("id").alias("k")), str(tmp_path / "p"), 10)
    assert again["shards"] == m["shards"] and len(tasks) > 2
    assert sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/p/shard-00007.parquet").collect()) == list(range(70, 80))
