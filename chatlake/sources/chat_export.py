"""Chat exports in JSON: one array of messages, or an object that holds one."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_ENDS = frozenset(" \t\r\n,]}")
_BLANK = re.compile(r"[ \t\r\n]*")
CHUNK = 4_000_000
"""Characters of an export that are held at a time, besides the message that is being read."""


def open_input(path: str):
    """A file of bytes: a local path, or a URI of any file system pyarrow knows."""
    from pyarrow import fs

    files, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return files.open_input_file(place)


def elements(path: str, chunk: int = CHUNK) -> Iterator[str]:
    """The JSON texts of the elements of a file's root array, or of its root's ``messages``, read piece by piece.

    A file of any size is read with one chunk and one message in memory. ValueError if the root is neither, or ends too soon.
    """
    decode = json.JSONDecoder().raw_decode
    with open_input(path) as raw:
        reader = codecs.getreader("utf-8-sig")(raw)
        text, at, ended = "", 0, False

        def more() -> None:
            nonlocal text, at, ended
            if ended:
                raise ValueError(f"{path}: the JSON ends too soon")
            fresh = reader.read(chunk)
            ended = not fresh
            text, at = text[at:] + fresh, 0

        def skip() -> str:
            """The next character that is no white space."""
            nonlocal at
            while True:
                at = _BLANK.match(text, at).end()
                if at < len(text):
                    return text[at]
                more()

        def value() -> str:
            nonlocal at
            while True:
                skip()
                try:
                    _, end = decode(text, at)
                except json.JSONDecodeError:
                    more()
                    continue
                if text[end - 1] not in '"}]' and text[end : end + 1] not in _ENDS:
                    more()
                    continue
                found, at = text[at:end], end
                return found

        def array() -> Iterator[str]:
            nonlocal at
            at += 1
            if skip() == "]":
                at += 1
                return
            while True:
                yield value()
                mark = skip()
                at += 1
                if mark == "]":
                    return
                if mark != ",":
                    raise ValueError(f"{path}: the JSON is broken")

        root = skip()
        if root == "[":
            yield from array()
            return
        if root != "{":
            raise ValueError(f"{path}: neither a list nor an object")
        at += 1
        while skip() != "}":
            name = json.loads(value())
            if skip() != ":":
                raise ValueError(f"{path}: the JSON is broken")
            at += 1
            if skip() == "[" and name == "messages":
                yield from array()
                return
            value()
            if skip() == ",":
                at += 1
        raise ValueError(f"{path}: no list of messages")


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files that a path, a folder or a pattern names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(place)
    if not found:
        raise FileNotFoundError(path)
    listed = [f for status in found for f in (files.listStatus(status.getPath()) if status.isDirectory() else [status])]
    return sorted(str(f.getPath()) for f in listed if not f.isDirectory())


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """message (variant): one row per element of the root array or of the root's ``messages`` of each file; files of any size.

    A JSON document can't be split, so one export is read by one task, piece by piece; several exports, or JSON lines
    (``read_lines``), are read in parallel. An export without such a list, or one that is cut off, fails the job.
    """
    names = _files(spark, path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch.file:
                held, size = [], 0
                for text in elements(name):
                    held.append(text)
                    size += len(text)
                    if size >= CHUNK:
                        yield pd.DataFrame({"value": held})
                        held, size = [], 0
                yield pd.DataFrame({"value": pd.Series(held, dtype=object)})

    listed = spark.createDataFrame([(n, name) for n, name in enumerate(names)], "n int, file string").repartition(len(names), "n")
    return listed.mapInPandas(read, "value string").select(F.parse_json("value").alias("message"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """message (variant) of each line of JSON-lines files; broken lines are left out, ``broken_lines`` gives them."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("message")).where("message is not null")


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines, other than blank ones, that ``read_lines`` leaves out."""
    return spark.read.text(path).where((F.trim("value") != "") & F.try_parse_json("value").isNull())


def structure(spark: SparkSession, path: str) -> str:
    """``list`` or ``object``, by the first character that isn't white space; reads no more than it needs."""
    with open_input(_files(spark, path)[0]) as raw:
        reader = codecs.getreader("utf-8-sig")(raw)
        while text := reader.read(4096):
            if text.strip():
                return "list" if text.lstrip()[0] == "[" else "object"
    return "object"


def _text(path: str, column: str = "message") -> Column:
    return F.expr(f"try_variant_get({column}, '$.{path}', 'string')")


def _number(path: str, kind: str = "bigint") -> Column:
    return F.expr(f"try_cast(try_variant_get(message, '$.{path}', 'string') as {kind})")


def _given(path: str) -> Column:
    """A field that is there and neither null, false, 0 nor empty."""
    value = _text(path)
    return F.coalesce(~F.lower(value).isin("", "false", "0", "null"), F.expr(f"schema_of_variant(try_variant_get(message, '$.{path}', 'variant')) like 'OBJECT%'"), F.lit(False))


def flat_text(field: str = "message:text") -> Column:
    """The text of a message: a string as it is, an array joined from its strings and the texts of its objects, anything else empty."""
    got = "try_variant_get(message, '$.text', 'variant')"
    return F.expr(
        f"""case when schema_of_variant({got}) = 'STRING' then cast({got} as string)
        when schema_of_variant({got}) like 'ARRAY%' then array_join(transform(cast({got} as array<variant>),
            e -> case when schema_of_variant(e) = 'STRING' then cast(e as string) else coalesce(try_variant_get(e, '$.text', 'string'), '') end), '')
        else '' end"""
    )


def entity_array() -> Column:
    """array<struct<type,value>> of the entities that aren't plain; a missing type counts as plain, a missing text is empty."""
    return F.expr(
        """coalesce(filter(transform(try_variant_get(message, '$.text_entities', 'array<variant>'),
            e -> named_struct('type', coalesce(try_variant_get(e, '$.type', 'string'), 'plain'), 'value', coalesce(try_variant_get(e, '$.text', 'string'), ''))),
            s -> s.type <> 'plain'), array())"""
    )


def parsed(messages: DataFrame) -> DataFrame:
    """The message table with an entities column, from rows of variants; only rows of type ``message``.

    Absent senders are empty strings, an absent time is 0, numbers may come as strings; what can't be read is null.
    """
    entities = entity_array()
    return messages.where(_text("type") == "message").select(
        _number("id").alias("id"), _text("type").alias("type"), _text("date").alias("date"), F.coalesce(_number("date_unixtime"), F.lit(0)).alias("date_unixtime"),
        F.coalesce(_text("from"), F.lit("")).alias("from_name"), F.coalesce(_text("from_id"), F.lit("")).alias("from_id"), _number("reply_to_message_id").alias("reply_to_message_id"),
        _text("forwarded_from").alias("forwarded_from"), _text("forwarded_from_id").alias("forwarded_from_id"), flat_text().alias("text_plain"), F.length(flat_text()).alias("text_length"),
        (_given("photo") | _given("file") | _given("media_type")).cast("int").alias("has_media"), _given("photo").cast("int").alias("has_photo"),
        F.exists(entities, lambda e: e["type"] == "link").cast("int").alias("has_links"), F.exists(entities, lambda e: e["type"] == "mention").cast("int").alias("has_mentions"),
        _given("edited").cast("int").alias("is_edited"), _number("edited_unixtime").alias("edited_unixtime"), _number("photo_file_size").alias("photo_file_size"),
        _number("width", "int").alias("photo_width"), _number("height", "int").alias("photo_height"), F.to_json("message").alias("raw_json"), entities.alias("entities"),
    )


def entities_of(messages: DataFrame) -> DataFrame:
    """message_id, type, value of parsed messages."""
    return messages.select(F.col("id").alias("message_id"), F.explode("entities").alias("e")).select("message_id", "e.type", "e.value")


def count_messages(messages: DataFrame) -> int:
    return messages.where(_text("type") == "message").count()


def probe(messages: DataFrame, newest: int = 50) -> DataFrame:
    """The newest messages with 80 characters of text: a look at a table."""
    return messages.orderBy(F.desc("date_unixtime"), "id").limit(newest).select("id", "date", "from_name", F.substring("text_plain", 1, 80).alias("text"))
