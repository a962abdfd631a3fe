"""Filling fixed-capacity containers: best-fit planned over a length histogram."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from codelode.session import cut_lineage

#: A token is a longest run of letters, digits and underscores, or of other non-blank characters.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85]+"
CAPACITY = 1024
#: Rows of one length that one task numbers at most, on average.
ROWS_PER_CELL = 200_000


def token_count(text: Column) -> Column:
    """Tokens in a text; 0 for null and blank."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def bpe_token_count(text: Column, path: str) -> Column:
    """Tokens of a public byte-level vocabulary file (``tokenizers`` JSON) at ``path``."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for s in batches:
            yield pd.Series([len(x.ids) for x in t.encode_batch(s.fillna("").tolist(), add_special_tokens=False)], dtype="int32")

    return count(text)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns segments ``(length, first_rank, n, per_bin, first_bin)``: of the items of
    ``length``, those ranked ``first_rank`` to ``first_rank + n - 1`` go, ``per_bin`` at
    a time, into the bins from ``first_bin`` on. Bins with equal contents are kept
    as one group ``[first_bin, bins]``, so the work follows the number of distinct lengths,
    never the number of items.
    """
    segments: list[tuple[int, int, int, int, int]] = []
    by_room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    made = 0

    def put(room: int, group: tuple[int, int]) -> None:
        if room <= 0:
            return
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append(group)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if length <= 0 or left <= 0:
            continue
        if length > capacity:
            raise ValueError("cut items above the capacity first")
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                fit = capacity // length
                full, rest = divmod(left, fit)
                for bins, per in ((full, fit), (int(rest > 0), rest)):
                    if bins:
                        segments.append((length, rank, bins * per, per, made))
                        put(capacity - per * length, (made, bins))
                        made, rank = made + bins, rank + bins * per
                left = 0
                break
            room = rooms[i]
            first, bins = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[i]
            fit = room // length
            used = min(bins, left // fit)
            if used:
                segments.append((length, rank, used * fit, fit, first))
                put(room - fit * length, (first, used))
                rank, left = rank + used * fit, left - used * fit
            if used < bins:
                at = first + used
                if left:
                    segments.append((length, rank, left, left, at))
                    put(room - left * length, (at, 1))
                    rank, left, at = rank + left, 0, at + 1
                if at < first + bins:
                    put(room, (at, first + bins - at))
    return segments


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """``(key, piece, n_pieces, piece_size, container_id)``: where each item, or piece of one, goes.

    An item of at most ``capacity`` is one piece. A larger one is cut into full
    containers and a rest, and the rest is packed with the others. The histogram
    has at most ``capacity`` rows, so planning is on the driver at any size.
    Ranks within a length are numbered in cells of about ``rows_per_cell`` rows and
    offset by the cells before, so no length is gathered in one task.

    Null, zero and negative sizes need no room: one row with a null container.
    Repeated keys are separate items. An empty table gives no rows.
    """
    spark = items.sparkSession
    # The sizes are used several times, and finding them may mean reading whole texts.
    sized = cut_lineage(items.select(F.col(key).alias("__k"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__s")))
    n_full = F.floor(F.col("__s") / capacity)
    rest = F.col("__s") - n_full * capacity
    n_pieces = F.greatest(F.lit(1), n_full + (rest > 0).cast("long"))
    hist = {r["__r"]: (r["n"], r["f"]) for r in sized.where("__s > 0").groupBy(rest.alias("__r")).agg(F.count("*").alias("n"), F.sum(n_full).alias("f")).collect()}
    segments = plan_bins({int(k): int(n) for k, (n, _) in hist.items() if k > 0}, capacity)
    n_bins = max((b + (n + per - 1) // per for _, _, n, per, b in segments), default=0)

    # Rests, and items that fit, are ranked within their length by cells.
    cells = {int(k): max(1, -(-int(n) // rows_per_cell)) for k, (n, _) in hist.items() if k > 0}
    cell_count = spark.createDataFrame(sorted(cells.items()) or [(0, 1)], "__r long, __cells long")
    rests = sized.where((F.col("__s") > 0) & (rest > 0)).select("__k", "__s", rest.alias("__r")).join(F.broadcast(cell_count), "__r").withColumn("__cell", F.pmod(F.xxhash64("__k"), F.col("__cells")))
    per_cell = rests.groupBy("__r", "__cell").agg(F.count("*").alias("__n"))
    before = per_cell.select("__r", "__cell", (F.sum("__n").over(Window.partitionBy("__r").orderBy("__cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")).alias("__before"))
    ranked = rests.withColumn("__rank", F.row_number().over(Window.partitionBy("__r", "__cell").orderBy("__k")) - 1)
    if max(cells.values(), default=1) > 1:
        ranked = ranked.join(before, ["__r", "__cell"]).withColumn("__rank", F.col("__rank") + F.col("__before"))

    order = sorted(segments)
    cols = [np.array(x, dtype=np.int64) for x in zip(*order)] if order else [np.zeros(0, np.int64)] * 5
    lengths, firsts, _, pers, bins = cols
    span = np.int64(1) << 40
    starts = lengths * span + firsts

    @F.pandas_udf(T.LongType())
    def slot(length: pd.Series, rank: pd.Series) -> pd.Series:
        r = rank.to_numpy(np.int64)
        at = np.searchsorted(starts, length.to_numpy(np.int64) * span + r, side="right") - 1
        return pd.Series(bins[at] + (r - firsts[at]) // pers[at])

    placed = ranked.select("__k", n_pieces.cast("int").alias("n_pieces"), n_pieces.cast("int").alias("piece"), F.col("__r").cast("int").alias("piece_size"), slot("__r", "__rank").alias("container_id"))
    # Full containers get ids after the planned ones.
    whole = sized.where(F.col("__s") >= capacity).select("__k", "__s", n_full.alias("__f"))
    full = whole.select("__k", n_pieces.cast("int").alias("n_pieces"), F.explode(F.sequence(F.lit(1), F.col("__f").cast("int"))).alias("piece"), F.lit(capacity).alias("piece_size"))
    full = full.withColumn("container_id", F.lit(n_bins).cast("long") + F.monotonically_increasing_id())
    none = sized.where("__s <= 0").select("__k", F.lit(1).alias("n_pieces"), F.lit(1).alias("piece"), F.lit(0).alias("piece_size"), F.lit(None).cast("long").alias("container_id"))
    return placed.unionByName(full.select(placed.columns)).unionByName(none).withColumnRenamed("__k", key)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Documents into context windows, by the token count of their whole text."""
    return pack(documents.select("doc_id", token_count(F.col("text")).alias("n_tokens")), "doc_id", "n_tokens", capacity)


def window_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, pieces, items cut, tokens, unused share."""
    used = packed.where("container_id is not null")
    return used.agg(F.countDistinct("container_id").alias("containers"), F.count("*").alias("pieces"), F.countDistinct(F.when(F.col("n_pieces") > 1, F.struct(packed.columns[0]))).alias("items_cut"), F.sum("piece_size").cast("long").alias("tokens")).withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.lit(capacity)), 6))


def p7_pack(documents: DataFrame) -> DataFrame:
    return pack_documents(documents)


def p7_found(documents: DataFrame) -> DataFrame:
    """Documents that alone exceed a window: those placed in more than one container."""
    placed = pack_documents(documents).where("container_id is not null").groupBy("doc_id").agg(F.count("container_id").alias("n"))
    return placed.where("n > 1").select("doc_id")
