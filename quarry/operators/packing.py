"""Ordered packing of a row's items under a token budget.

A file's hunks (or a document's lines) live inside one input row, so the
greedy, order-dependent packing runs as the ``aggregate`` higher-order
function over that row's array: no shuffle, no grouping of rows, and the
work per row is bounded by the row itself.

Rule (the reference splitter's): walking the items in order, the current
chunk is closed before an item when the chunk is not empty and either the
item starts a logical block or ``header + chunk + item > budget``. A single
item larger than the budget therefore forms a chunk of its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNKS_TYPE = "array<struct<first:int,last:int,tokens:bigint>>"


def _chunk(first: Column, last: Column, tokens: Column) -> Column:
    return F.array(F.struct(first.alias("first"), last.alias("last"), tokens.alias("tokens")))


# Completed chunks are collected in pages of this many; a full page moves
# to the page list, so an append copies at most one page (plus the page list).
PAGE = 256
PAGES_TYPE = f"array<{CHUNKS_TYPE}>"


def pack_chunks(weights: Column, budget: int, header: Column | int = 0,
                blocks: Column | None = None) -> Column:
    """Chunk bounds for one row: ``array<struct<first, last, tokens>>`` with
    0-based inclusive item positions and the chunk's item-token sum.

    ``weights``: ``array<bigint>`` item weights; ``blocks``: optional
    ``array<boolean>`` of the same length (True = item starts a block);
    ``header``: weight added to every chunk (D19: the file header).

    One ``aggregate`` pass over the zipped ``(weight, block)`` items. The
    lambdas read only their own element and the accumulator: an outer array
    referenced inside a lambda would be re-evaluated per element (Catalyst
    inlines single-use projections). The header limit is computed once into
    the accumulator. Completed chunks go to pages of ``PAGE``, so the
    copying stays near linear in the number of chunks.
    """
    hdr = header if isinstance(header, Column) else F.lit(header)
    if blocks is None:
        items = F.transform(weights, lambda w: F.struct(w.cast("bigint").alias("w"),
                                                        F.lit(False).alias("b")))
    else:
        items = F.transform(F.arrays_zip(weights.alias("w"), blocks.alias("b")),
                            lambda z: F.struct(z["w"].cast("bigint").alias("w"),
                                               F.coalesce(z["b"], F.lit(False)).alias("b")))
    init = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"),
                    F.lit(0).cast("bigint").alias("cur"), F.lit(0).alias("n"),
                    (F.lit(budget).cast("bigint") - hdr.cast("bigint")).alias("room"),
                    F.array().cast(CHUNKS_TYPE).alias("page"),
                    F.array().cast(PAGES_TYPE).alias("pages"))

    def step(acc, x):
        i, start, cur, n = acc["i"], acc["start"], acc["cur"], acc["n"]
        w = x["w"]
        emit = (n > 0) & (x["b"] | (cur + w > acc["room"]))
        page = F.when(emit, F.concat(acc["page"], _chunk(start, i - 1, cur))).otherwise(acc["page"])
        full = F.size(page) >= PAGE
        return F.struct(
            (i + 1).alias("i"),
            F.when(emit, i).otherwise(start).alias("start"),
            F.when(emit, w).otherwise(cur + w).alias("cur"),
            F.when(emit, F.lit(1)).otherwise(n + 1).alias("n"),
            acc["room"].alias("room"),
            F.when(full, F.array().cast(CHUNKS_TYPE)).otherwise(page).alias("page"),
            F.when(full, F.concat(acc["pages"], F.array(page))).otherwise(acc["pages"]).alias("pages"))

    def finish(acc):
        last = F.when(acc["n"] > 0, F.concat(acc["page"], _chunk(acc["start"], acc["i"] - 1,
                                                                  acc["cur"]))).otherwise(acc["page"])
        return F.flatten(F.concat(acc["pages"], F.array(last)))

    return F.aggregate(items, init, step, finish)
