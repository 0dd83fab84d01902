"""The stored tables: versioned writes, incremental updates, upserts and exports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chatlake.functions.time import at
from chatlake.operators.aggregates import per_user, users_table
from chatlake.operators.dedup import first_copies, unseen
from chatlake.operators.fulltext import Index, OkapiIndex, document_table, mean_idf, mean_totals, okapi_documents, okapi_table, posting_table, term_counts, totals_of, trigram_table
from chatlake.operators.hierarchy import hierarchy
from chatlake.operators.running import ranged_running_sum
from chatlake.operators.threads import reply_edges, thread_rows, with_messages
from chatlake.operators.vectors import encoded, hashing_encoder, missing
from chatlake.session import settle
from chatlake.sources.chat_export import entities_of


class Store:
    """Tables under one folder, each a list of parquet parts. One manifest names the parts of all tables.

    A load writes new parts and then one new manifest, which readers see at once for every table or not at all: a job that
    fails before has changed nothing, and its retry starts from the same state. Loads append; only tables with a row per
    user or per term are rewritten. Two loads at a time can't both publish: the second to name a version fails.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        self._schemas: dict[str, str] = {}

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def manifest(self) -> dict:
        """version, tables (name to parts), their schemas, and numbers of the newest published state."""
        found = self.files.globStatus(self._path("_manifest_*.json"))
        names = sorted(str(p.getPath().getName()) for p in found or [])
        if not names:
            return {"version": 0, "tables": {}, "schemas": {}, "numbers": {}}
        return json.loads(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(self.files.open(self._path(names[-1]))).decode())

    def publish(self, base: dict, changed: dict[str, list[str]], numbers: dict | None = None) -> None:
        """The state after ``base`` with the parts of the changed tables; fails if another load came first."""
        state = {"version": base["version"] + 1, "tables": base["tables"] | changed, "schemas": base["schemas"] | {n: self._schemas[n] for n in changed if n in self._schemas}, "numbers": base["numbers"] | (numbers or {})}
        name = f"_manifest_{state['version']:08d}.json"
        draft = self._path(f"_draft_{uuid.uuid4().hex}")
        out = self.files.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self.files.exists(self._path(name)) or not self.files.rename(draft, self._path(name)):
            raise RuntimeError(f"version {state['version']} was published by another load")

    def part(self, name: str, rows: DataFrame, order: list[str] | None = None, bucketed: bool = False) -> str:
        """Write rows as a new part of a table, which nobody sees before it is published; sorted by ``order`` in ranges."""
        part = f"{name}/{uuid.uuid4().hex[:12]}"
        self._schemas[name] = rows.schema.json()
        if order:
            by = (["bucket"] if bucketed else []) + order
            rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy("bucket") if bucketed else writer).parquet(f"{self.folder}/{part}")
        return part

    def read(self, name: str, state: dict | None = None) -> DataFrame | None:
        """A table as published; of nodes and threads the rows of the last load that touched their tree."""
        state = state or self.manifest()
        parts = state["tables"].get(name)
        if not parts:
            return None
        schema = StructType.fromJson(json.loads(state["schemas"][name]))
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.folder}/{part}") for part in parts])
        touched = state["tables"].get("touched") if name in ("nodes", "threads") else None
        if not touched:
            return rows
        newest = self.read("touched", state).groupBy("root_id").agg(F.max("load").alias("newest"))
        return rows.join(newest, "root_id", "left").where("load >= coalesce(newest, 0)").drop("newest")

    def write(self, name: str, rows: DataFrame, order: list[str] | None = None, bucketed: bool = False) -> None:
        """Publish a whole new content of one table."""
        state = self.manifest()
        self.publish(state, {name: [self.part(name, rows, order, bucketed)]})

    def ensure(self, name: str, build: Callable[[], DataFrame], order: list[str] | None = None, bucketed: bool = False) -> DataFrame:
        """The table, built first if the store lacks it."""
        if name not in self.manifest()["tables"]:
            rows = build()
            self.write(name, rows, order, bucketed)
        return self.read(name)

    def compact(self, name: str, files: int = 8) -> None:
        """Rewrite a table as one part of fewer files."""
        self.write(name, self.read(name).coalesce(files))

    def index(self, parsed: DataFrame) -> dict[str, int]:
        """First load: of each id the first copy, with all tables derived from it; what the store had is replaced."""
        state = self.manifest()
        kept = {k: v for k, v in state["tables"].items() if k in ("participants", "embeddings", "chunks")}
        found = self._add(parsed, state | {"tables": kept, "numbers": {}})
        return {"messages": found["new_messages"], "entities": self.read("entities").count()}

    def update(self, parsed: DataFrame) -> dict[str, int]:
        """Later load: only new ids are added, existing rows win; every table and index grows by the new rows."""
        return self._add(parsed, self.manifest())

    def replace(self, parsed: DataFrame) -> dict[str, int]:
        """Load that wins: messages whose ids the store has are replaced by the new copies, the others stay; all tables are built anew."""
        state = self.manifest()
        old, entities = self.read("messages", state), self.read("entities", state)
        if old is None:
            return self.index(parsed)
        fresh = settle(first_copies(settle(parsed.withColumn("arrival", F.monotonically_increasing_id())), ["id"], [F.col("arrival")]))
        kept = unseen(old, fresh, "id")
        packed = entities.groupBy(F.col("message_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("type", "value"))).alias("entities"))
        none = F.array().cast("array<struct<type:string,value:string>>")
        whole = kept.drop("delivery_id").join(packed, "id", "left").withColumn("entities", F.coalesce("entities", none))
        return self.index(whole.unionByName(fresh.drop("arrival").select(*whole.columns)))

    def _add(self, parsed: DataFrame, state: dict) -> dict[str, int]:
        """Settle the new rows once, write a part of every table, publish them together."""
        numbers = state["numbers"]
        total = parsed.count()
        arrived = settle(parsed.withColumn("arrival", F.monotonically_increasing_id()))
        first = first_copies(arrived, ["id"], [F.col("arrival")])
        old = self.read("messages", state)
        fresh = settle(first if old is None else unseen(first, old, "id"))
        added = fresh.count()
        if old is not None and not added:
            return {"new_messages": 0, "duplicates": total}
        begin = numbers.get("deliveries", 0)
        rows = settle(ranged_running_sum(fresh, [], ["arrival"], {"before": F.lit(1)}).withColumn("delivery_id", (F.col("before") + 1 + begin).cast("long")).drop("before", "arrival"))
        messages = rows.drop("entities")
        new = {"messages": self.part("messages", messages, ["date_unixtime", "id"]), "entities": self.part("entities", entities_of(rows), ["message_id"])}
        new["reply_graph"] = self.part("reply_graph", reply_edges(messages).withColumn("depth", F.lit(1)), ["parent_id"])
        for name, (table, order, bucketed) in INDEXES.items():
            new[name] = self.part(name, table(messages), order, bucketed)
        load = state["version"] + 1
        changed = {name: state["tables"].get(name, []) + [part] for name, part in new.items()} | self._trees(messages, state, load)
        users = users_table(messages).withColumn("first_delivery", F.lit(begin + 1).cast("long"))
        changed["users"] = [self.part("users", merged_users([users, *([self.read("users", state)] if old is not None else [])]))]
        self.publish(state, changed, {"deliveries": begin + added, "loads": load})
        return {"new_messages": added, "duplicates": total - added}

    def _trees(self, messages: DataFrame, state: dict, load: int) -> dict[str, list[str]]:
        """Parts of nodes and threads for the trees that the new messages touch; all other trees stay as they are."""
        own = messages.select(F.col("id").alias("node_id"), "date_unixtime", "from_id", F.lit(1).alias("present"))
        edges = reply_edges(messages)
        old = self.read("nodes", state)
        touched: list[str] = []
        known = own
        if old is not None:
            ends = edges.select(F.explode(F.array("parent_id", "child_id")).alias("node_id")).unionByName(own.select("node_id")).distinct()
            roots = settle(old.join(ends, "node_id", "left_semi").select("root_id").distinct())
            again = settle(old.join(roots, "root_id", "left_semi"))
            edges = edges.unionByName(again.where("parent_id is not null").select("parent_id", F.col("node_id").alias("child_id")))
            known = own.unionByName(again.where("present = 1").select("node_id", "date_unixtime", "from_id", "present"))
            missing = ends.join(again.select("node_id"), "node_id", "left_anti")
            stored = self.read("messages", state).select(F.col("id").alias("node_id"), "date_unixtime", "from_id", F.lit(1).alias("present"))
            known = known.unionByName(stored.join(missing, "node_id", "left_semi"))
            touched = [self.part("touched", roots.withColumn("load", F.lit(load)))]
        nodes = settle(with_messages(hierarchy(edges), known).withColumn("load", F.lit(load)))
        parts = {"nodes": self.part("nodes", nodes, ["root_id", "first", "node_id"]), "threads": self.part("threads", thread_rows(nodes).withColumn("load", F.lit(load)), ["root_id"])}
        found = {name: state["tables"].get(name, []) + [part] for name, part in parts.items()}
        return found | ({"touched": state["tables"].get("touched", []) + touched} if touched else {})

    def fulltext(self) -> Index:
        """The stored full-text index."""
        state = self.manifest()
        return Index(self.read("postings", state), self.read("documents", state), mean_totals(self.read("document_totals", state)))

    def okapi(self) -> OkapiIndex:
        """The stored keyword index."""
        state = self.manifest()
        totals = mean_totals(self.read("okapi_totals", state))
        counts = self.read("okapi_counts", state).groupBy("term").agg(F.sum("n").alias("n"))
        return OkapiIndex(self.read("okapi_terms", state), self.read("okapi_documents", state), totals, mean_idf(counts, totals))

    def ensure_indexes(self, messages: Callable[[], DataFrame], names: list[str]) -> None:
        """Build those of the named index tables that the store lacks, and publish them together."""
        lacking = [n for n in names if n not in self.manifest()["tables"]]
        if lacking:
            rows = messages()
            state = self.manifest()
            self.publish(state, {n: [self.part(n, INDEXES[n][0](rows), *INDEXES[n][1:])] for n in lacking})

    def upsert_participants(self, new: DataFrame) -> None:
        """Of each member the row updated last; at equal times the new one."""
        old = self.read("participants")
        rows = new.withColumn("fresh", F.lit(1))
        if old is not None:
            rows = rows.unionByName(old.withColumn("fresh", F.lit(0)))
        self.write("participants", first_copies(rows, ["user_id"], [F.desc("updated_at"), F.desc("fresh")]).drop("fresh"))

    def append_vectors(self, vectors: DataFrame, key: str = "message_id", name: str = "embeddings") -> int:
        """Add vectors of keys the table lacks, as a new part."""
        state = self.manifest()
        old = self.read(name, state)
        self.publish(state, {name: state["tables"].get(name, []) + [self.part(name, vectors if old is None else unseen(vectors, old, key))]})
        return self.read(name).count()

    def embed(self, messages: DataFrame, encoder: Callable = hashing_encoder, prefix: str = "passage: ") -> int:
        """Add the vectors of messages that have none yet; the number of vectors."""
        store = self.read("embeddings")
        empty = messages.sparkSession.createDataFrame([], "message_id long")
        rows = missing(messages, empty if store is None else store)
        return self.append_vectors(encoded(rows, "text", encoder, prefix).drop("text"))

    def embed_chunks(self, chunks: DataFrame, encoder: Callable = hashing_encoder, prefix: str = "passage: ") -> int:
        """Write chunks with their vectors as the chunk table; the number of chunks."""
        self.write("chunks", encoded(chunks, "text", encoder, prefix))
        return self.read("chunks").count()


def merged_users(parts: list[DataFrame]) -> DataFrame:
    """One row per user from tables of users: the name of the earliest, times and counts over all."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("from_id").agg(
        F.min_by("display_name", F.when(F.col("display_name").isNotNull(), F.col("first_delivery"))).alias("display_name"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("message_count").alias("message_count"), F.min("first_delivery").alias("first_delivery"),
    )


INDEXES = {
    "postings": (posting_table, ["term", "id"], True), "documents": (document_table, ["id"], False), "document_totals": (lambda m: totals_of(document_table(m)), None, False),
    "okapi_terms": (okapi_table, ["term", "id"], True), "okapi_documents": (okapi_documents, ["id"], False), "okapi_totals": (lambda m: totals_of(okapi_documents(m)), None, False),
    "okapi_counts": (lambda m: term_counts(okapi_table(m)), ["term"], False), "trigrams": (trigram_table, ["trigram", "id"], True),
}
"""The index tables of messages: what makes their rows, their order, and whether they lie in buckets."""


def users_export(messages: DataFrame) -> DataFrame:
    """The eight columns of the user export; empty senders stay, sums of nothing are 0, times are ISO in UTC."""
    rows = messages.where("from_id is not null").groupBy("from_id").agg(
        F.max("from_name").alias("name"), F.count("*").alias("messages"), F.coalesce(F.sum("text_length"), F.lit(0)).alias("characters"), F.coalesce(F.sum("has_links"), F.lit(0)).alias("links"),
        F.coalesce(F.sum("has_media"), F.lit(0)).alias("media"), F.min("date_unixtime").alias("first"), F.max("date_unixtime").alias("last"),
    )
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return rows.select("from_id", "name", "messages", "characters", "links", "media", F.date_format(at(F.col("first")), iso).alias("first_message"), F.date_format(at(F.col("last")), iso).alias("last_message"))


def messages_export(messages: DataFrame, limit: int = 10_000) -> DataFrame:
    """The newest messages with 500 characters of text; the limit is the export's feature."""
    return messages.orderBy(F.desc("date_unixtime"), "id").limit(limit).select("id", "date", "from_name", "from_id", F.substring("text_plain", 1, 500).alias("text"), "has_links", "has_media", "reply_to_message_id")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def as_json(rows: DataFrame) -> DataFrame:
    """One column of JSON objects, characters outside ASCII as they are."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


__all__ = ["Store", "as_json", "messages_export", "per_user", "users_export", "write_csv"]
