"""A data source for live chats: any client that lists messages newest first can be read as a table or a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from chatlake.sources.chat_export import open_input

SCHEMA = "id bigint, date_unixtime bigint, payload string"


def _rows(path: str, start: int, end: int | None = None) -> tuple[list[dict], int]:
    """The stand-in client: rows of a JSON-lines drop file that whatever fetches the chat appends to, from a byte on, and the byte after the last whole line.

    The path may be a URI of any file system that all executors reach; only the bytes from ``start`` are read.
    """
    with open_input(path) as raw:
        raw.seek(start)
        data = raw.read() if end is None else raw.read(end - start)
    whole = data.rfind(b"\n") + 1 if end is None else len(data)
    rest = data[whole:]
    if rest.strip() and end is None:
        try:
            json.loads(rest)
            whole = len(data)
        except ValueError:
            pass
    return [json.loads(line) for line in data[:whole].splitlines() if line.strip()], start + whole


def _recent(rows: list[dict], since: int) -> Iterator[tuple]:
    for row in rows:
        at = int(row.get("date_unixtime") or 0)
        if at >= since and str(row.get("text") or "").strip():
            yield int(row["id"]), at, json.dumps(row, ensure_ascii=False)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.since = options["path"], int(options.get("since", 0))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _recent(_rows(self.path, 0)[0], self.since)


class _StreamReader(SimpleDataSourceStreamReader):
    """Offsets are bytes of the drop file already read, so a batch reads what was appended and nothing else."""

    def __init__(self, options: dict) -> None:
        self.path, self.since = options["path"], int(options.get("since", 0))

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = _rows(self.path, start["byte"])
        return _recent(rows, self.since), {"byte": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return _recent(_rows(self.path, start["byte"], end["byte"])[0], self.since)


class LiveChat(DataSource):
    """format("live_chat"): options path (a JSON-lines drop file, or its URI) and since (epoch seconds); messages without text are skipped."""

    @classmethod
    def name(cls) -> str:
        return "live_chat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)
