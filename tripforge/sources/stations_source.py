"""A Python data source of station lists by URL: ``spark.read.format("station_pages")``, one partition a page."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

NAME = "station_pages"
SCHEMA = "station_id string, station_name string, lat double, lng double, page int"


class Page(InputPartition):
    def __init__(self, number: int, url: str):
        self.number, self.url = number, url


def fetch(url: str, tries: int, wait: float, timeout: float) -> list[dict]:
    """The JSON array at a URL. Lost connections, time-outs, broken bodies and answers of 429 or 5xx are tried again, each time after twice as long."""
    for left in range(tries - 1, -1, -1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as error:
            if not left or not (error.code == 429 or error.code >= 500):
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError, json.JSONDecodeError):
            if not left:
                raise
        time.sleep(wait)
        wait *= 2
    raise ValueError("tries must be one or more")


def station(item: dict) -> tuple | None:
    """A station's columns; None if it has no terminal name, the first of which is its id."""
    names = [p.get("value") for p in item.get("additionalProperties") or [] if p.get("key") == "TerminalName"]
    if not names or names[0] is None:
        return None
    number = lambda x: None if x is None else float(x)
    return names[0], item.get("commonName"), number(item.get("lat")), number(item.get("lon"))


class StationReader(DataSourceReader):
    def __init__(self, options: dict):
        template, pages = options["url"], int(options.get("pages", 1))
        self.pages = [Page(k, template.replace("{page}", str(k))) for k in range(1, pages + 1)]
        self.fetching = int(options.get("tries", 4)), float(options.get("wait", 0.2)), float(options.get("timeout", 30))
        self.wanted: list = []

    def pushFilters(self, filters: list[Filter]):
        """Pages that a filter on ``page`` leaves out are not fetched; equality of other columns is tested as rows are read. Spark gets the rest."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("page",):
                self.pages = [p for p in self.pages if p.number == f.value]
            elif isinstance(f, In) and f.attribute == ("page",):
                self.pages = [p for p in self.pages if p.number in f.value]
            elif isinstance(f, EqualTo) and len(f.attribute) == 1:
                self.wanted.append((f.attribute[0], (f.value,)))
            elif isinstance(f, IsNotNull) and f.attribute == ("page",):
                continue
            else:
                yield f

    def partitions(self):
        return self.pages

    def read(self, page: Page):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for item in fetch(page.url, *self.fetching):
            found = station(item)
            if found is None:
                continue
            row = (*found, page.number)
            if all(row[names.index(c)] in values for c, values in self.wanted):
                yield row


class StationPages(DataSource):
    """Options: ``url`` with {page} in it, ``pages``, ``tries``, ``wait`` and ``timeout`` (seconds)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StationReader:
        return StationReader(self.options)


def read_station_pages(spark: SparkSession, url: str, pages: int = 1, **options) -> DataFrame:
    """Stations of all pages of a list; ``{page}`` in the URL is a page's number from 1."""
    spark.dataSource.register(StationPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(NAME).option("url", url).option("pages", pages)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()
