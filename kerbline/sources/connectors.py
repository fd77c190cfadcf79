"""Connectors to public map services, as Python data sources: pages of a layer are partitions.

Register them with register(spark) and read with spark.read.format("arcgis_layer").option("url", ...).
Filters on a layer's columns are pushed to the service, as is a box. All network access is in `fetch`, which
tests replace through the `fetcher` option by the name of a function ("module:function").
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

PAGE = 1000
FEATURE = "geometry string, properties map<string,string>"


#: What a request says it comes from; some services answer browsers only (option agent=browser).
AGENTS = {"library": "kerbline/1.0 (street safety data)", "browser": "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/126.0 Safari/537.36"}


def fetch(url: str, data: bytes | None = None, headers: dict[str, str] | None = None, timeout: float = 120.0) -> bytes:
    request = urllib.request.Request(url, data=data, headers={"User-Agent": AGENTS["library"], **(headers or {})})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read()


def _fetcher(options: dict) -> object:
    name = options.get("fetcher")
    found = fetch
    if name:
        module, function = name.split(":")
        found = getattr(importlib.import_module(module), function)
    agent = options.get("agent")
    if agent is None:
        return found
    return lambda url, data=None, headers=None: found(url, data, {"User-Agent": AGENTS[agent], **(headers or {})})


def _text(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


def _feature(f: dict) -> tuple:
    geometry = f.get("geometry")
    return (None if geometry is None else json.dumps(geometry), {k: _text(v) for k, v in (f.get("properties") or {}).items()})


def _literal(value) -> str:
    return str(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else "'" + str(value).replace("'", "''") + "'"


_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def pushed(filters: list[Filter], known: set[str]) -> tuple[list[str], list[Filter]]:
    """(conditions as text, filters that Spark still has to apply). Filters on properties of the service's own are taken."""
    taken, left = [], []
    for f in filters:
        name = f.attribute[-1] if getattr(f, "attribute", None) else None
        if name in known and type(f) in _SIGNS:
            taken.append(f"{name} {_SIGNS[type(f)]} {_literal(f.value)}")
        elif name in known and isinstance(f, In):
            taken.append(f"{name} IN ({', '.join(map(_literal, f.value))})")
        else:
            left.append(f)
    return taken, left


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class LayerReader(DataSourceReader):
    """A feature layer in pages of 1000. The number of features is asked for first, so pages are read in parallel."""

    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns, self.where = dict(options), columns, []

    def pushFilters(self, filters: list[Filter]):
        self.where, left = pushed(filters, set(self.columns))
        yield from left

    def _params(self, **more) -> dict:
        where = " AND ".join([self.options.get("where", "1=1"), *self.where])
        params = {"where": where, "outFields": "*", "outSR": "4326", "f": "geojson", **more}
        if self.options.get("bbox"):
            params |= {"geometry": self.options["bbox"], "geometryType": "esriGeometryEnvelope", "inSR": "4326", "spatialRel": "esriSpatialRelIntersects"}
        return params

    def _ask(self, **more) -> dict:
        url = f"{self.options['url']}/query?{urllib.parse.urlencode(self._params(**more))}"
        answer = json.loads(_fetcher(self.options)(url))
        if "error" in answer:
            raise RuntimeError(f"{self.options['url']}: {answer['error']}")
        return answer

    def partitions(self):
        total = int(self._ask(returnCountOnly="true", f="json")["count"])
        return [Page(i) for i in range(max(1, -(-total // PAGE)))]

    def read(self, partition: Page) -> Iterator[tuple]:
        page = self._ask(resultOffset=partition.number * PAGE, resultRecordCount=PAGE, orderByFields=self.options.get("key", "OBJECTID"))
        for f in page.get("features", []):
            geometry, properties = _feature(f)
            yield (geometry, properties, *(properties.get(c) for c in self.columns))


class ArcgisLayer(DataSource):
    """Options: url, columns (properties to give as columns of their own), where, bbox (west,south,east,north), key."""

    @classmethod
    def name(cls) -> str:
        return "arcgis_layer"

    def _columns(self) -> list[str]:
        return [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]

    def schema(self) -> str:
        return ", ".join([FEATURE, *(f"{c} string" for c in self._columns())])

    def reader(self, schema) -> DataSourceReader:
        return LayerReader(self.options, self._columns())


class ElementsReader(DataSourceReader):
    """Map elements from the first of several mirrors that answers, each tried twice."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def read(self, partition) -> Iterator[tuple]:
        mirrors = [m.strip() for m in self.options["urls"].split(",")]
        body = urllib.parse.urlencode({"data": self.options["query"]}).encode()
        last: Exception | None = None
        for attempt in range(2):
            for mirror in mirrors:
                try:
                    answer = json.loads(_fetcher(self.options)(mirror, body))
                except (OSError, ValueError) as x:
                    last = x
                    continue
                for e in answer.get("elements", []):
                    centre = e.get("center") or {}
                    yield (e.get("id"), {k: str(v) for k, v in (e.get("tags") or {}).items()}, _float(e.get("lon")), _float(e.get("lat")), (_float(centre.get("lon")), _float(centre.get("lat"))))
                return
            time.sleep(float(self.options.get("pause", "1")))
        raise RuntimeError(f"no mirror answered: {last}")


def _float(v) -> float | None:
    return None if v is None else float(v)


class MapElements(DataSource):
    """Options: urls (comma list of mirrors), query, pause (seconds between rounds)."""

    @classmethod
    def name(cls) -> str:
        return "map_elements"

    def schema(self) -> str:
        return "id long, tags map<string,string>, lon double, lat double, center struct<lon:double,lat:double>"

    def reader(self, schema) -> DataSourceReader:
        return ElementsReader(self.options)


class RowsReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns, self.where = dict(options), columns, []

    def pushFilters(self, filters: list[Filter]):
        self.where, left = pushed(filters, set(self.columns))
        yield from left

    def read(self, partition) -> Iterator[tuple]:
        params = {"$limit": self.options.get("limit", "5000")}
        where = " AND ".join([w for w in [self.options.get("where"), *self.where] if w])
        headers = {}
        if where:
            params["$where"] = where
        if self.options.get("needs_key") == "true":
            if not self.options.get("api_key"):
                raise ValueError("this feed needs an access key: set the option api_key")
            headers["Authorization"] = f"Bearer {self.options['api_key']}"
        answer = json.loads(_fetcher(self.options)(f"{self.options['url']}?{urllib.parse.urlencode(params)}", None, headers) if headers else _fetcher(self.options)(f"{self.options['url']}?{urllib.parse.urlencode(params)}"))
        rows = answer.get("features", []) if isinstance(answer, dict) else answer
        for r in rows:
            yield tuple(_text(r.get(c)) for c in self.columns)


class JsonRows(DataSource):
    """Rows of a JSON endpoint. Options: url, columns, where, limit, needs_key, api_key."""

    @classmethod
    def name(cls) -> str:
        return "json_rows"

    def _columns(self) -> list[str]:
        return [c.strip() for c in self.options["columns"].split(",")]

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in self._columns())

    def reader(self, schema) -> DataSourceReader:
        return RowsReader(self.options, self._columns())


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ArcgisLayer, MapElements, JsonRows):
        spark.dataSource.register(source)
