"""Scraped-listing cleaning, price history, and the tables behind a re-crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.text import canonical_url

#: Field -> (position of the scraped value, characters to strip)
FIELDS = {
    "address": (0, None),
    "zip": (1, None),
    "city": (3, None),
    "canton": (4, ", "),
    "rooms": (0, " Zimer"),
    "area_m2": (2, " m²"),
    "price_chf": (0, "CHF .—"),
    "date_available": (1, None),
    "floor": (1, None),
    "utilities_chf": (1, "CHF .—"),
}
OPTIONAL = ("area_m2", "floor", "utilities_chf", "date_available")


def strip_chars(c: Column, chars: str) -> Column:
    """Without any of ``chars`` at either end."""
    return F.btrim(c, F.lit(chars))


def nth(values: Column, n: int) -> Column:
    """The n-th value, or the empty string."""
    return F.coalesce(F.get(values, n), F.lit(""))


def load_items(raw: DataFrame) -> DataFrame:
    """Arrays of scraped strings to one string a field; empty is null. Other columns are kept."""
    cols = {}
    for field, (n, chars) in FIELDS.items():
        if field in raw.columns:
            value = nth(F.col(field), n)
            cols[field] = F.nullif(strip_chars(value, chars) if chars else value, F.lit(""))
    return raw.withColumns(cols)


def as_int(c: Column) -> Column:
    """The integer in a string, or null."""
    return c.cast("string").try_cast("int")


def set_defaults(items: DataFrame) -> DataFrame:
    """Optional fields that are missing become null columns."""
    return items.withColumns({c: F.lit(None).cast("string") for c in OPTIONAL if c not in items.columns})


def clean_listings(items: DataFrame) -> DataFrame:
    """Typed listings: rows without an integer price go; optional values that do not parse are null."""
    x = set_defaults(items)
    x = x.withColumns(
        {
            "price_chf": as_int(F.col("price_chf")),
            "area_m2": as_int(F.col("area_m2")),
            "utilities_chf": as_int(F.col("utilities_chf")),
            "floor": F.nullif(F.col("floor"), F.lit("")),
            "date_available": F.try_to_timestamp(F.col("date_available"), F.lit("d.M.yyyy")).cast("date"),
        }
    )
    return x.filter(F.col("price_chf").isNotNull())


def validate_listings(items: DataFrame) -> DataFrame:
    """Rows with a zip of four digits and with rooms."""
    return items.filter(F.coalesce(F.rlike("zip", F.lit(r"^\p{Nd}{4}\z")), F.lit(False)) & (F.coalesce("rooms", F.lit("")) != ""))


def validate_prices(items: DataFrame) -> DataFrame:
    return items.withColumn("price_chf", as_int(F.col("price_chf"))).filter(F.col("price_chf").isNotNull())


def latest_prices(history: DataFrame, url: str = "url", date: str = "date", price: str = "price_chf", tie: str | None = None) -> DataFrame:
    """(url, latest price): by date, and by ``tie`` among equal dates."""
    order = F.struct(date, *([tie] if tie else []), price)
    return history.groupBy(url).agg(F.max_by(F.col(price), order).alias(f"latest_{price}"))


def price_changes(checked: DataFrame, history: DataFrame, url: str = "url", date: str = "date", price: str = "price_chf", tie: str | None = None) -> DataFrame:
    """Checked prices that differ from the latest stored one; a url without history counts as changed."""
    x = checked.join(latest_prices(history, url, date, price, tie), url, "left")
    return x.filter(~F.col(price).eqNullSafe(F.col(f"latest_{price}"))).drop(f"latest_{price}")


def append_prices(prices: DataFrame, items: DataFrame, today: Column | None = None) -> DataFrame:
    """The price table with a row for each item."""
    return prices.unionByName(items.select("url", (today if today is not None else F.current_date()).alias("date"), "price_chf"))


def insert_listings(items: DataFrame, today: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(listing rows, price rows) to append for new items."""
    day = today if today is not None else F.current_date()
    return items.withColumns({"date_scraped": day, "date_last_seen": day}), items.select("url", day.alias("date"), "price_chf")


def touch_last_seen(listings: DataFrame, seen: DataFrame, today: Column | None = None) -> DataFrame:
    """Listings with today's ``date_last_seen`` where the url was seen."""
    day = today if today is not None else F.current_date()
    x = listings.join(seen.select("url").distinct().withColumn("__seen", F.lit(True)), "url", "left")
    return x.withColumn("date_last_seen", F.when(F.col("__seen"), day).otherwise(F.col("date_last_seen"))).select(*listings.columns)


def visited_urls(listings: DataFrame) -> DataFrame:
    return listings.select("url")


def due_for_check(listings: DataFrame, today: Column | None = None, days: int = 7) -> DataFrame:
    """Urls last seen less than ``days`` days ago; the bound itself is out."""
    day = today if today is not None else F.current_date()
    return listings.filter(F.col("date_last_seen") > F.date_sub(day, days)).select("url")


def split_seen(found: DataFrame, listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, new) of the found links, compared without their query strings."""
    x = found.withColumn("url", canonical_url(F.col("url")))
    return x.join(listings.select("url"), "url", "left_semi"), x.join(listings.select("url"), "url", "left_anti")


def result_pages(first: DataFrame, url: str = "url", last_page: str = "last_page") -> DataFrame:
    """(url, page): pages 2 to the last one of each result list."""
    return first.filter(F.col(last_page) >= 2).select(url, F.explode(F.sequence(F.lit(2), F.col(last_page))).alias("page"))
