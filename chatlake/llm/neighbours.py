"""The most similar vectors of every vector: a block matrix join of int8 product tiles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.session import settle

DIMENSION = 64
NEAREST = 5
CELL_ROWS = 2048
"""Rows that are multiplied with each other at a time, on average."""
BLOCK_ROWS = (16_384, 262_144)
"""Rows a block of a schedule has on average: at least and at most; in between a 64th of the table, so the schedules needed grow slowly."""
BLOCK_PARTS = 64
LEAST_SCHEDULES = 6
TABLE_RECALL = 0.99
"""Chance that a pair at the threshold meets in some schedule; the number of schedules follows from it and from the rows."""
CELL_RECALL = 0.97
"""Chance that such a pair meets within a block, from which the number of passes over the block follows."""
CUT_BLOCKS = 4
"""A block of more than this many times its average is cut, and all pairs of its cuts are multiplied."""
BROADCAST_BLOCKS = 100_000
"""Large blocks up to this number are broadcast (two numbers each)."""
BIG_CELL = 4
"""Cells of more than this many times CELL_ROWS are remembered, so later passes multiply only what hasn't met in them."""
DENSE = 256
"""A row with more partners within the error bound in one cell has its cell multiplied in float."""
SLACK = np.float32(1e-5)
"""More than float32 rounds off in 64 products of scaled codes."""


def usable(vectors: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """space, key, unit (float32 bytes) of the vectors with ``dimension`` finite numbers, not all 0; each key once.

    ``vectors`` has space, key and embedding. Null vectors and keys are left out; of a key stored twice the smallest usable
    vector counts.
    """

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            right = np.flatnonzero(pa.compute.equal(pa.compute.list_value_length(column), dimension).fill_null(False).to_numpy(zero_copy_only=False))
            rows = batch.take(pa.array(right))
            flat = rows.column("embedding").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimension)
            sound = np.isfinite(flat).all(1) & (flat != 0).any(1)
            flat, rows = flat[sound], rows.filter(pa.array(sound))
            flat = flat / np.abs(flat).max(1, keepdims=True) if len(flat) else flat
            unit = (flat / np.sqrt((flat * flat).sum(1, keepdims=True))).astype(np.float32)
            binary = _binary(unit)
            yield pa.RecordBatch.from_arrays([rows.column("space"), rows.column("key"), binary], ["space", "key", "unit"])

    source = vectors.where("key is not null and embedding is not null").select("space", "key", "embedding")
    rows = source.mapInArrow(units, "space string, key long, unit binary")
    best = rows.groupBy(F.split("space", "/")[0].alias("store"), "key").agg(F.min(F.struct("space", "unit")).alias("one"))
    return best.select(F.col("one.space").alias("space"), "key", F.col("one.unit").alias("unit"))


def _rotations(cells: float, random: np.random.Generator) -> list[np.ndarray]:
    """Rotations whose largest coordinates name a vector's cell; together about ``cells`` cells."""
    left, parts = float(cells), []
    while left > 1.5:
        wide = int(min(DIMENSION, max(1, round(left / 2))))
        parts.append(np.linalg.qr(random.normal(size=(DIMENSION, DIMENSION)))[0][:, :wide].astype(np.float32))
        left /= 2 * wide
    return parts


def _cell_of(vectors: np.ndarray, parts: list[np.ndarray], start: int = 0) -> np.ndarray:
    code = np.full(len(vectors), start, np.int64)
    for part in parts:
        turned = vectors @ part
        axis = np.abs(turned).argmax(1)
        sign = turned[np.arange(len(vectors)), axis] > 0
        code = code * (2 * part.shape[1]) + 2 * axis + sign
    return code


def meeting(similarity: float, cells: float, tries: int = 6, draws: int = 1500, seed: int = 5) -> float:
    """Chance that two vectors of a cosine fall into one of about ``cells`` cells in one try, by simulation of random pairs."""
    if cells <= 1.5:
        return 1.0
    random = np.random.default_rng(seed)
    x = random.normal(size=(draws, DIMENSION))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = random.normal(size=(draws, DIMENSION))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = (similarity * x + math.sqrt(max(0.0, 1 - similarity * similarity)) * z).astype(np.float32)
    x = x.astype(np.float32)
    met = [float((_cell_of(x, parts) == _cell_of(y, parts)).mean()) for parts in (_rotations(cells, random) for _ in range(tries))]
    return max(sum(met) / tries, 1 / draws)


@dataclass
class Plan:
    """blocks: the rotations of each schedule; cells: those of each pass over a block; block_rows and recall as expected."""

    blocks: list[list[np.ndarray]]
    cells: list[list[np.ndarray]]
    block_rows: int
    recall: float


def plan_for(rows: int, least: float, recall: float = TABLE_RECALL, cell_rows: int = CELL_ROWS, block_rows: tuple[int, int] = BLOCK_ROWS, seed: int = 11) -> Plan:
    """Schedules and passes enough that a pair of cosine ``least`` meets with a chance of ``recall`` in a table of ``rows`` rows, whatever its size.

    A schedule sends each row to one block, by random rotations; only schedules cost shuffle, and there are few since blocks
    are large. Within a block several passes cut it into cells of about ``cell_rows`` rows, in memory.
    """
    random = np.random.default_rng(seed)
    size = int(min(max(rows / BLOCK_PARTS, block_rows[0]), block_rows[1]))
    n_blocks, n_cells = rows / size, min(rows, size) / cell_rows

    def needed(chance: float, wanted: float) -> int:
        return 1 if chance >= wanted else math.ceil(math.log(1 - wanted) / math.log(1 - chance))

    within = meeting(least, n_cells)
    passes = needed(within, CELL_RECALL)
    per_schedule = meeting(least, n_blocks) * (1 - (1 - within) ** passes)
    schedules = 1 if n_blocks <= 1.5 else max(LEAST_SCHEDULES, needed(per_schedule, recall))
    return Plan([_rotations(n_blocks, random) for _ in range(schedules)], [_rotations(n_cells, random) for _ in range(passes)], size, 1 - (1 - per_schedule) ** schedules)


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the length of what the codes leave out (rounded up)."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = np.linalg.norm(unit.astype(np.float64) - codes.astype(np.float64) * scale[:, None], axis=1)
    return codes, scale.astype(np.float32), (rest + 1e-6).astype(np.float32)


def _cell_pairs(scaled: np.ndarray, rest: np.ndarray, rows: np.ndarray, others: np.ndarray, least: float, nearest: int, dense_rows: int = DENSE) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs (row, other) that can be at least ``least`` similar and among the ``nearest`` of the row; whether a row has too many for the bound.

    ``scaled`` are int8 codes times their scales. |x.y - x'.y'| <= rest_x + rest_y * (1 + rest_x), so a product less its bound
    is sure and a product plus its bound is possible; SLACK covers the rounding of the float32 sums.
    """
    found, dense = [], False
    target = np.ascontiguousarray(scaled[others].T)
    widest = float(rest[others].max())
    for begin in range(0, len(rows), 512):
        part = rows[begin : begin + 512]
        product = scaled[part] @ target
        a, b = np.nonzero(product >= (least - SLACK - rest[part] - widest * (1 + rest[part]))[:, None])
        keep = part[a] != others[b]
        a, b = a[keep], b[keep]
        value = product[a, b]
        bound = rest[part[a]] + rest[others[b]] * (1 + rest[part[a]]) + SLACK
        keep = value + bound >= least
        a, b, value, bound = a[keep], b[keep], value[keep], bound[keep]
        counts = np.bincount(a, minlength=len(part))
        many = np.flatnonzero(counts > nearest)
        if len(many):
            order = np.lexsort((bound - value, a))
            ends = np.cumsum(counts)
            sure = np.full(len(part), -9.0, np.float32)
            sure[many] = (value - bound)[order[(ends - counts)[many] + nearest - 1]]
            keep = value + bound >= sure[a]
            a, b = a[keep], b[keep]
            counts = np.bincount(a, minlength=len(part))
        if counts.max(initial=0) > dense_rows:
            dense = True
        found.append((part[a], others[b]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), dense


def _block_pairs(keys: np.ndarray, codes: np.ndarray, scale: np.ndarray, rest: np.ndarray, side: np.ndarray, cells: list[list[np.ndarray]], least: float, nearest: int, cell_rows: int, dense_rows: int = DENSE) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Candidate pairs of keys of one block, and the members of its cells that are too dense for the bound.

    Each pass cuts the block into cells; rows that met in a dense or big cell aren't multiplied with each other again. With
    rows on both sides, only pairs across are wanted.
    """
    scaled = codes.astype(np.float32) * scale[:, None]
    low, high, thick = [], [], []
    met = np.full(len(keys), -1, np.int64)
    marks = 0
    across = bool(side.any())
    for parts in cells:
        cell = _cell_of(scaled, parts)
        order = np.argsort(cell, kind="stable")
        ends = np.flatnonzero(np.r_[cell[order][1:] != cell[order][:-1], True]) + 1
        for begin, end in zip(np.r_[0, ends[:-1]], ends, strict=True):
            members = order[begin:end]
            if len(members) < 2:
                continue
            groups = met[members]
            if groups[0] >= 0 and (groups == groups[0]).all():
                continue
            dense = False
            a, b = [], []
            for group in np.unique(groups):
                own = groups == group
                rows, others = members[own], members if group < 0 else members[~own]
                for here, there in ([(rows[side[rows] == 0], others[side[others] == 1]), (rows[side[rows] == 1], others[side[others] == 0])] if across else [(rows, others)]):
                    if len(here) and len(there):
                        x, y, full = _cell_pairs(scaled, rest, here, there, least, nearest, dense_rows)
                        a.append(x)
                        b.append(y)
                        dense = dense or full
            if dense:
                thick.append(members)
            else:
                low += a
                high += b
            if dense or len(members) > BIG_CELL * cell_rows:
                met[members] = marks
                marks += 1
    x, y = (np.concatenate(part) if part else np.empty(0, np.int64) for part in (low, high))
    pairs = np.unique(np.stack([np.minimum(keys[x], keys[y]), np.maximum(keys[x], keys[y])], 1), axis=0)
    return pairs[:, 0], pairs[:, 1], thick


def _largest(product: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n largest values of each row; equal values by column. Only rows with a tie at the border are sorted."""
    if product.shape[1] <= n:
        return np.argsort(-product, axis=1, kind="stable")
    best = np.argpartition(-product, n - 1, axis=1)[:, :n]
    border = np.take_along_axis(product, best, axis=1).min(1)
    tied = np.flatnonzero((product >= border[:, None]).sum(1) > n)
    best[tied] = np.argsort(-product[tied], axis=1, kind="stable")[:, :n]
    return best


def _float_pairs(keys: np.ndarray, unit: np.ndarray, side: np.ndarray, least: float, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """As _tile_pairs, in float, at most ``nearest`` partners a row: the way for tiles too dense for the bound."""
    alone = not side.any()
    left, right = (np.arange(len(keys)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    found = []
    for rows, others in ((left, right),) if alone else ((left, right), (right, left)):
        by_key = others[np.argsort(keys[others], kind="stable")]
        for begin in range(0, len(rows), 512):
            part = rows[begin : begin + 512]
            product = unit[part].astype(np.float64) @ unit[by_key].astype(np.float64).T
            product[keys[part][:, None] == keys[by_key][None, :]] = -9
            best = _largest(product, nearest)
            a = np.repeat(np.arange(len(part)), best.shape[1])
            b = best.ravel()
            good = product[a, b] >= least
            found.append(np.stack([keys[part[a[good]]], keys[by_key[b[good]]]], 1))
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    return pairs.min(1), pairs.max(1)


def _cut(rows: DataFrame, counts: DataFrame, n_counts: int, most: int) -> DataFrame:
    """Rows with tile (the group to multiply) and side. Blocks of more than ``most`` rows are cut; every pair of cuts is a tile.

    ``counts`` has the settled large blocks; only up to BROADCAST_BLOCKS of them are broadcast.
    """
    if not n_counts:
        return rows.withColumn("tile", F.col("block")).withColumn("side", F.lit(0).cast("byte"))
    if n_counts <= BROADCAST_BLOCKS:
        counts = F.broadcast(counts)
    cut = F.ceil(F.coalesce("n", F.lit(0)) / most).cast("int")
    joined = rows.join(counts, "block", "left").withColumn("cuts", F.greatest(cut, F.lit(1)))
    own = F.pmod(F.xxhash64("key", F.lit(3)), F.col("cuts")).cast("int")
    spread = joined.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return spread.withColumn("tile", F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other"))).withColumn("side", (F.col("own") > F.col("other")).cast("byte")).drop("own", "other", "cuts", "n")


def _bytes_of(column: pa.Array, width: int) -> np.ndarray:
    """The values of a binary column of one width as rows of bytes, without a Python object a value."""
    flat = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.empty(0, np.uint8)
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return flat[start : start + len(column) * width].reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows).view(np.uint8)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _by_tile(work, columns: list[str]):
    """Feed whole tiles, which come sorted and in one piece, to ``work``; a tile may span Arrow batches but is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tile = None

        def whole() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            tiles = batch.column("tile").to_numpy()
            if not len(tiles):
                continue
            begins = np.r_[0, np.flatnonzero(tiles[1:] != tiles[:-1]) + 1, len(tiles)]
            for begin, end in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                if held and tiles[begin] != tile:
                    yield from work(whole())
                    held = []
                tile = tiles[begin]
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from work(whole())

    return run


def similar_pairs(vectors: DataFrame, rows: int, least: float = 0.9, nearest: int = NEAREST, recall: float = TABLE_RECALL, exact: bool = False, cell_rows: int = CELL_ROWS, block_rows: tuple[int, int] = BLOCK_ROWS, dense_rows: int = DENSE, seed: int = 11) -> DataFrame:
    """Pairs of vectors of one space with a cosine of at least ``least`` of which one is among the ``nearest`` of the other.

    ``vectors`` has space (store/model), key and embedding; ``rows`` is about their number. ``plan_for`` chooses how many
    schedules send the vectors to blocks, and how many passes cut a block into cells, so that a pair at the threshold is
    multiplied with a chance of ``recall`` at any number of rows. ``exact`` multiplies every block with every other instead,
    which is quadratic. Products are of int8 codes, with error bounds that tell which pairs can count; these are recomputed in
    float and the best ``nearest`` of each vector merged over all blocks; equal similarities go to the smaller key. Of vectors
    that are equal in every number the seven smallest keys are multiplied; the others' nearest are the smallest keys of their
    group, so a mass of copies costs no more than itself. Result: space, key_a < key_b, similarity.
    """
    unit = settle(usable(vectors))
    prints = unit.select("space", "key", F.xxhash64("unit").alias("print_1"), F.xxhash64(F.lit(1), "unit").alias("print_2"))
    order = Window.partitionBy("space", "print_1", "print_2").orderBy("key")
    counted = prints.withColumn("nth", F.row_number().over(order))
    extra = settle(counted.where(F.col("nth") > nearest + 2).select("space", "key", "print_1", "print_2"))
    copied = not extra.isEmpty()
    lead = counted.where(F.col("nth") <= nearest)
    of_copies = extra.select("space", "print_1", "print_2", F.col("key").alias("key_b")).join(lead.select("space", "print_1", "print_2", F.col("key").alias("key_a")), ["space", "print_1", "print_2"])
    leading = unit.join(extra.select("key", "space"), ["key", "space"], "left_anti") if copied else unit
    plan = Plan([[]], [[]], block_rows[1], 1.0) if exact else plan_for(rows, least, recall, cell_rows, block_rows, seed)
    most = plan.block_rows if exact else CUT_BLOCKS * plan.block_rows

    def blocks_of(batch: pa.RecordBatch, matrix: np.ndarray) -> Iterator[np.ndarray]:
        salt = batch.column("space_code").to_numpy()
        for number, parts in enumerate(plan.blocks):
            yield _cell_of(matrix, parts, number + 1) * 1_000_003 + salt

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _bytes_of(batch.column("unit"), 4 * DIMENSION).view(np.float32)
            if len(matrix):
                codes, scale, rest = quantise(matrix)
                code = _binary(np.concatenate([codes.view(np.uint8), scale[:, None].view(np.uint8), rest[:, None].view(np.uint8)], axis=1))
                for block in blocks_of(batch, matrix):
                    yield pa.RecordBatch.from_arrays([pa.array(block), batch.column("key"), code], ["block", "key", "code"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                for block in blocks_of(batch, _bytes_of(batch.column("unit"), 4 * DIMENSION).view(np.float32)):
                    yield pa.RecordBatch.from_arrays([pa.array(block)], ["block"])

    salted = leading.select("key", F.xxhash64("space").alias("space_code"), "unit")
    large = settle(salted.mapInArrow(named, "block long").groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > most))
    n_large = large.count()

    def multiply(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = _bytes_of(batch.column("code"), DIMENSION + 8)
        codes = raw[:, :DIMENSION].view(np.int8)
        scale, rest = (np.ascontiguousarray(raw[:, at : at + 4]).view(np.float32).ravel() for at in (DIMENSION, DIMENSION + 4))
        keys = batch.column("key").to_numpy()
        low, high, thick = _block_pairs(keys, codes, scale, rest, batch.column("side").to_numpy(), plan.cells, least, nearest, cell_rows, dense_rows)
        none = np.zeros(len(low), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(none)], ["key_a", "key_b", "cell"])
        for members in thick:
            own = np.sort(keys[members])
            name = xxhash.xxh64_intdigest(own.tobytes()) >> 1
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(own), pa.array(np.full(len(own), name | 1, np.int64))], ["key_a", "key_b", "cell"])

    tiles = _cut(salted.mapInArrow(placed, "block long, key long, code binary"), large, n_large, most).select("tile", "side", "key", "code").repartition("tile").sortWithinPartitions("tile")
    multiplied = settle(tiles.mapInArrow(_by_tile(multiply, ["key", "code", "side"]), "key_a long, key_b long, cell long").distinct())
    thick = multiplied.where("cell <> 0").select(F.col("cell").alias("block"), F.col("key_a").alias("key"))
    candidates = [multiplied.where("cell = 0").select("key_a", "key_b")]
    if not thick.isEmpty():
        sizes = settle(thick.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > BIG_CELL * cell_rows))

        def multiply_float(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            a, b = _float_pairs(batch.column("key").to_numpy(), _bytes_of(batch.column("unit"), 4 * DIMENSION).view(np.float32), batch.column("side").to_numpy(), least, nearest)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["key_a", "key_b"])

        again = _cut(thick.join(unit.select("key", "unit"), "key"), sizes, sizes.count(), BIG_CELL * cell_rows).select("tile", "side", "key", "unit").repartition("tile").sortWithinPartitions("tile")
        candidates.append(again.mapInArrow(_by_tile(multiply_float, ["key", "unit", "side"]), "key_a long, key_b long").distinct())
    pairs = reduce(DataFrame.unionByName, candidates)
    ends = unit.select("key", "space", "unit")
    left, right = ends.toDF("key_a", "space", "unit_a"), ends.toDF("key_b", "space_b", "unit_b")

    def recompute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_bytes_of(batch.column(c), 4 * DIMENSION).view(np.float32).astype(np.float64) for c in ("unit_a", "unit_b"))
            yield pa.RecordBatch.from_arrays([batch.column("space"), batch.column("key_a"), batch.column("key_b"), pa.array((a * b).sum(1))], ["space", "key_a", "key_b", "similarity"])

    joined = pairs.join(left, "key_a").join(right, "key_b").where("space = space_b").select("space", "key_a", "key_b", "unit_a", "unit_b")
    sure = joined.mapInArrow(recompute, "space string, key_a long, key_b long, similarity double").where(F.col("similarity") >= least)
    both = sure.withColumn("end", F.explode(F.array(F.struct(F.col("key_a").alias("me"), F.col("key_b").alias("other")), F.struct(F.col("key_b").alias("me"), F.col("key_a").alias("other")))))
    nth = F.row_number().over(Window.partitionBy("space", "end.me").orderBy(F.col("similarity").desc(), "end.other"))
    top = both.withColumn("nth", nth).where(F.col("nth") <= nearest).select("space", "key_a", "key_b", "similarity").distinct()
    if not copied:
        return top
    return top.unionByName(of_copies.select("space", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), F.lit(1.0).alias("similarity")))
