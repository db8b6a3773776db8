"""Fixture tables: those of sf0.001 with rows that are hard to get right."""

import random

import pytest

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def hard_documents():
    r = random.Random(5)
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    loop = "one two three four five six seven eight nine ten " * 6
    texts = [
        None,
        "",
        " \t\n\x0b\x0c\r ",
        "word",
        "a b c d",
        "Grüße \u00a0 an\u2003alle \U0001f600 ÄÖÜ",
        loop,
        f"é\U0001f600 password = hunter2hunter2 and TOKEN:'abc' api_key=\"{key}\" x",
        f"AKIA{'ABCD1234' * 2} and {'0123456789abcdef' * 2} plus {key} end",
        f"secret: {key}\nsecret: {key}",
        "line\n\n line \nLINE\n" + "x " * 30,
        "## $$ %% && || <> **" * 4,
        " ".join(f"w{i % 977}" for i in range(60_000)),
        "https://example.com/" + "a1" * 40,
    ]
    rows = [(900_000 + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(900_050, "same row twice here", None, None, 19)] * 2
    rows += [(900_060, "no language " * 12, None, "src1", None), (900_061, "no source " * 12, "en", None, None)]
    return rows


@pytest.fixture(scope="session")
def hard(spark, tmp_path_factory):
    """A folder of tables: documents with hard rows, pages with hard urls, and the rest as it is."""
    at = str(tmp_path_factory.mktemp("hard"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.unionByName(spark.createDataFrame(hard_documents(), DOC)).write.parquet(f"{at}/documents.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/en/x?y", "http://example.net/en", "http://a.b.example.com/de/1#t", "http://xexample.com/de/1", "x://y://z/w", "http://q.org?/fr/", "http://q.org/fr/" + "s/" * 40, "ftp://Net/"]
    more = [(800_000 + i, u, None) for i, u in enumerate(urls)] + [(None, "http://null.id/", None)] + [(800_100, "http://dup.net/", None)] * 2
    pages.unionByName(spark.createDataFrame(more, "page_id long, url string, html string")).write.parquet(f"{at}/pages.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{at}/{t}.parquet")
    return at


@pytest.fixture(scope="session")
def hard_rows(spark, hard):
    return [r.asDict() for r in spark.read.parquet(f"{hard}/documents.parquet").collect()]


@pytest.fixture(scope="session")
def empty(spark, hard, tmp_path_factory):
    """The same tables without a row."""
    at = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "pages", "benchmark", "labels"):
        spark.read.parquet(f"{hard}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return at
