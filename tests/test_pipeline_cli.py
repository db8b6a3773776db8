"""The pipeline's decisions, its counts and the command line, end to end."""

import re
import json

import pytest

from corpusforge.plans import cli
from corpusforge.plans import pipeline as P

GOOD = ("Along the northern shore the wind had been rising since dawn, and the boats stayed in. "
        "Old nets dried on the stones while the children counted gulls. "
        "Nobody spoke of the harvest, which had been poor for three years running. "
        "At noon the bell rang twice, as it did when a ship was seen beyond the point. ")  # fmt: skip


def decide(spark, texts, **config):
    df = spark.createDataFrame([(i, f"http://x/{i}", t) for i, t in enumerate(texts)], "ord long, url string, text string")
    c = P.PipelineConfig(**config)
    return P.materialize(P.decide(P.prepare(df, c), c), "d")


def test_every_stage(spark):
    other = GOOD.replace("northern", "southern").replace("noon", "dusk") * 2
    texts = [GOOD * 2, GOOD * 2, "Home About", "  ", other, "", "home, about!"]
    d = decide(spark, texts, near_dup_threshold=0.3)
    got = {r["ord"]: r["stage"] for r in d.collect()}
    assert got == {0: "kept", 1: "exact_duplicate", 2: "quality", 3: "empty", 4: "near_duplicate", 5: "empty", 6: "exact_duplicate"}
    s = P.stats(d)
    assert s["seen"] == 7 == s["kept"] + s["dropped"] + s["malformed"] and s["keep_rate"] == round(1 / 7, 4)
    assert s["quality_failures"]["word_count"] == 1 and re.search(r"^kept +1 ", P.render(s), re.M)


def test_switches(spark):
    d = decide(spark, ["tiny", "tiny two"], run_quality=False, run_near_dedup=False)
    assert {r["stage"] for r in d.collect()} == {"kept"}
    with pytest.raises(ValueError):
        P.PipelineConfig(exact_level="x")
    with pytest.raises(ValueError):
        P.PipelineConfig(bands=33)


def test_html_and_plain_meet(spark):
    text = GOOD * 2
    df = spark.createDataFrame([(0, "u", text, None, None), (1, "v", "", f"<nav>x</nav><article><p>{text}</p></article><title>T</title>", None), (2, "w", " ", "<p>ignored</p>", "Own")], "ord long, url string, text string, html string, title string")
    d = {r["ord"]: r for r in P.decide(P.prepare(df)).collect()}
    assert [d[i]["stage"] for i in range(3)] == ["kept", "exact_duplicate", "empty"] and d[1]["title"] == "T" and d[2]["title"] == "Own"


@pytest.fixture
def crawl(tmp_path):
    lines = [{"url": "https://example.com/a", "text": GOOD * 2}, {"url": "https://example.com/a?utm=1", "text": GOOD * 2}, {"url": "https://example.com/nav", "text": "Home About Contact"}, {"url": "https://example.com/r", "text": "Click here to win it now.\n" * 12}]
    path = tmp_path / "crawl.jsonl"
    path.write_text("".join(json.dumps(x) + "\n" for x in lines), encoding="utf-8")
    return path


def test_build(spark, crawl, tmp_path):
    out = tmp_path / "out"
    assert cli.main(["build", str(crawl), "-o", str(out)]) == 0
    stats = json.loads((out / "stats.json").read_text())
    s = stats["stats"]
    assert (s["seen"], s["kept"], s["dropped_by_stage"]["exact_duplicate"], s["dropped_by_stage"]["quality"], s["dropped_by_stage"]["near_duplicate"]) == (4, 1, 1, 2, 0)
    assert stats["manifest"]["total_records"] == 1
    from corpusforge.sources.shards import read_shards

    rec = json.loads(read_shards(spark, str(out)).first()["value"])
    assert rec["doc_id"] == "2dce0a4c50441bfc" and rec["language"] == "latin" and rec["quality"]["passed"] and "html" not in rec
    assert set(rec["signatures"]) == {"raw", "normalized", "structural"} and rec["crawled_at"]


def test_malformed_limits(spark, crawl, tmp_path):
    with crawl.open("a") as f:
        f.write("NOT JSON\n{\n")
    run = lambda *a: cli.main(["build", str(crawl), "-o", str(tmp_path / "o"), "--no-dedup", *a])
    assert (run("--strict"), run("--max-malformed", "1"), run("--max-malformed", "2")) == (1, 1, 0)
    assert json.loads((tmp_path / "o" / "stats.json").read_text())["stats"]["malformed"] == 2
    with pytest.raises(SystemExit) as e:
        run("--strict", "--max-malformed", "1")
    assert e.value.code == 2


def test_assess_dedup_extract(spark, crawl, tmp_path, capsys):
    assert cli.main(["assess", str(crawl), "-v"]) == 0
    got = capsys.readouterr()
    assert "would pass  2" in got.err and "https://example.com/nav\t" in got.out
    assert cli.main(["assess", str(crawl), "--sample", "2", "--seed", "3"]) == 0
    one = capsys.readouterr().err
    cli.main(["assess", str(crawl), "--sample", "2", "--seed", "3"])
    assert capsys.readouterr().err == one and "documents   2" in one
    assert cli.main(["dedup", str(crawl), "-v"]) == 0
    out = capsys.readouterr().out
    assert "https://example.com/a?utm=1\tDUPLICATE_OF\thttps://example.com/a\t1.0000" in out and "https://example.com/nav\tUNIQUE" in out
    page = tmp_path / "p.html"
    page.write_text(f"<title>T</title><p>{GOOD}</p>")
    assert cli.main(["extract", str(page), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["title"] == "T"


def test_sample_is_uniform_enough_and_stable(spark):
    df = spark.range(2000).withColumnRenamed("id", "ord")
    a, b = ({r["ord"] for r in P.sample(d, 200, 1).collect()} for d in (df, df.repartition(7)))
    assert a == b and len(a) == 200 and abs(sum(a) / 200 - 1000) < 150
    assert {r["ord"] for r in P.sample(df, 200, 2).collect()} != a
