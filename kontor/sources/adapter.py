"""Suppliers' saved pages as a Spark data source: ``spark.read.format("supplier_pages")`` and ``spark.readStream``.

A supplier is a row of configuration (its selectors and id strategies as JSON), so a new supplier needs no code.  Pages lie
as Parquet files (page_id, url, html) in a folder for each supplier, ``<path>/supplier=<name>/``.  Each file is a
partition of its own, a filter on the supplier reads its files alone, and a stream takes the files that have come since.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import parse_qs, unquote, urljoin, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from .pages import Selector, _steps, found_cards

NAME = "supplier_pages"
SCHEMA = "supplier string, page_id long, url string, position int, source_id string, fields map<string,string>, missing_required array<string>"
#: Pages that a task holds at a time.
PAGES = 64


@dataclass(frozen=True)
class Supplier:
    """Where a supplier's cards are, what is read from them, and how a card is identified, first strategy first.

    Strategies: ("path", pattern) and ("query", name) read the card's link, ("field", name) a field.
    """

    name: str
    card: Selector
    fields: dict[str, Selector]
    ids: tuple[tuple[str, str], ...]
    link: str = "link"

    @staticmethod
    def of(row: dict) -> Supplier:
        own = {n: Selector(**s) for n, s in row["fields"].items()}
        return Supplier(row["supplier"], Selector(**row["card"]), own, tuple((k, w) for k, w in row["ids"]), row.get("link", "link"))

    def listings(self, page: int, url: str | None, html: str | None) -> Iterator[tuple]:
        fields = [(n, s, _steps(s)) for n, s in self.fields.items()]
        for position, (values, lacks) in enumerate(found_cards(html, _steps(self.card), fields)):
            found = {n: v for (n, _, _), v in zip(fields, values, strict=True) if v is not None}
            at = urljoin(url or "", found[self.link]) if self.link in found else None
            yield self.name, page, at, position, self.source_id(at, found), found, lacks

    def source_id(self, url: str | None, found: dict[str, str]) -> str | None:
        for kind, what in self.ids:
            if kind == "field":
                value = found.get(what)
            elif url is None:
                value = None
            elif kind == "path":
                hit = re.search(what, urlsplit(url).path)
                value = hit[1] if hit else None
            elif kind == "query":
                value = next(iter(parse_qs(urlsplit(url).query).get(what, [])), None)
            else:
                raise ValueError(f"unknown strategy {kind}")
            if value:
                return value
        return None


@dataclass
class PageFile(InputPartition):
    supplier: str
    path: str


class _Folder:
    """The files of the configured suppliers, in any store that Arrow reads."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        rows = [Supplier.of(row) for row in json.loads(options["suppliers"])]
        self.suppliers = {s.name: s for s in rows}

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def files(self, names: Iterable[str]) -> list[tuple[int, str, str]]:
        """(time, path, supplier), oldest first."""
        from pyarrow import fs

        store, root = self._store()
        wanted, out = set(names), []
        for folder in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            key, _, value = posixpath.basename(folder.path).partition("=")
            if folder.type == fs.FileType.Directory and key == "supplier" and unquote(value) in wanted:
                for f in store.get_file_info(fs.FileSelector(folder.path, recursive=True)):
                    if f.type == fs.FileType.File and f.path.endswith(".parquet") and not posixpath.basename(f.path).startswith(("_", ".")):
                        out.append((f.mtime_ns or 0, f.path, unquote(value)))
        return sorted(out)

    def read(self, partition: PageFile | None) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        if partition is None:  # what Spark plans where there is no file
            return
        supplier = self.suppliers[partition.supplier]
        with self._store()[0].open_input_file(partition.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(PAGES, columns=["page_id", "url", "html"]):
                for row in batch.to_pylist():
                    yield from supplier.listings(row["page_id"], row["url"], row["html"])


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = _Folder(options)
        self.names = set(self.folder.suppliers)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on the supplier choose files; Spark tests the others."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("supplier",):
                self.names &= {f.value}
            elif isinstance(f, In) and f.attribute == ("supplier",):
                self.names &= set(f.value)
            else:
                yield f

    def partitions(self) -> list[PageFile]:
        return [PageFile(supplier, path) for _, path, supplier in self.folder.files(self.names)]

    def read(self, partition: PageFile) -> Iterator[tuple]:
        return self.folder.read(partition)


class PagesStream(DataSourceStreamReader):
    """Files are taken in the order of their times; a file is written once and not changed."""

    def __init__(self, options: dict[str, str]):
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.folder.files(self.folder.suppliers)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[PageFile]:
        low, high = ((o["time"], o["path"]) for o in (start, end))
        return [PageFile(s, p) for t, p, s in self.folder.files(self.folder.suppliers) if low < (t, p) <= high]

    def read(self, partition: PageFile) -> Iterator[tuple]:
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept here; the checkpoint has the offsets."""


class SupplierPages(DataSource):
    """Options: ``path``, the folder of the pages, and ``suppliers``, a JSON list of configuration rows."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PagesReader:
        return PagesReader(dict(self.options))

    def streamReader(self, schema: StructType) -> PagesStream:
        return PagesStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters pushed to it."""
    spark.dataSource.register(SupplierPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
