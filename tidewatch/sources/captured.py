"""A data source over captured answers of the three collectors: listing pages, archive pages, feeds.

    spark.dataSource.register(CapturedPosts)
    spark.read.format("captured_posts").option("path", folder).option("kind", "listing").load()

One partition per file. Rows have the raw contract's columns that the answer determines; a broken file has none.
"""

from __future__ import annotations

import glob
import json
import os
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "source string, native_id string, url string, title string, text string, author string, published string,"
    " score double, num_comments double, engagement_score double, page string"
)
NAMES = {"listing": "reddit_json", "archive": "arctic_shift_reddit", "feed": "reddit_rss"}


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _seconds(value: object) -> str:
    from datetime import UTC, datetime

    try:
        return datetime.fromtimestamp(float(value), UTC).isoformat() if value else ""
    except (TypeError, ValueError, OverflowError, OSError):
        return ""


def _gone(text: object) -> str:
    text = "" if text is None else str(text)
    return "" if text.strip() in ("[deleted]", "[removed]") else text


def posts_of_json(document: dict, kind: str) -> Iterator[tuple]:
    data = document.get("data") or {}
    items = [c.get("data") or {} for c in data.get("children") or []] if kind == "listing" else data
    for x in items if isinstance(items, list) else []:
        score, comments = float(x.get("score") or 0), float(x.get("num_comments") or 0)
        url = x.get("permalink") or x.get("url") or ""
        yield (
            NAMES[kind], str(x.get("id") or ""), url, str(x.get("title") or ""), _gone(x.get("selftext")), str(x.get("author") or ""),
            _seconds(x.get("created_utc")), score, comments, score + 3 * comments,
        )


def posts_of_feed(text: str) -> Iterator[tuple]:
    """Atom entries, else RSS items; they tell no engagement."""
    root = ET.fromstring(text)
    bare = lambda e: e.tag.rsplit("}", 1)[-1]
    entries = [e for e in root.iter() if bare(e) == "entry"] or [e for e in root.iter() if bare(e) == "item"]
    for e in entries:
        parts = {bare(c): c for c in e}
        said = lambda *names: next((parts[n].text or "" for n in names if n in parts), "")  # noqa: B023, E731
        link = parts.get("link")
        url = (link.get("href") or link.text or "") if link is not None else ""
        author = parts.get("author")
        name = next((c.text or "" for c in author if bare(c) == "name"), author.text or "") if author is not None else ""
        yield (NAMES["feed"], "", url, said("title"), said("content", "description"), name, said("updated", "published", "pubDate"), 0.0, 0.0, 0.0)


class Reader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def partitions(self) -> list[File]:
        found = sorted(glob.glob(os.path.join(self.path, "*"))) if os.path.isdir(self.path) else [self.path]
        return [File(p) for p in found if os.path.isfile(p)]

    def read(self, partition: File) -> Iterator[tuple]:
        try:
            with open(partition.path, encoding="utf-8") as f:
                text = f.read()
            rows = list(posts_of_feed(text) if self.kind == "feed" else posts_of_json(json.loads(text), self.kind))
        except (OSError, ValueError, ET.ParseError, AttributeError):
            return
        for r in rows:
            yield (*r, os.path.basename(partition.path))


class CapturedPosts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured_posts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Reader:
        kind = self.options.get("kind", "listing")
        if kind not in NAMES:
            raise ValueError(f"kind is one of {', '.join(NAMES)}")
        return Reader(self.options["path"], kind)
