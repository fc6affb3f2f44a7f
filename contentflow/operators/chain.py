"""Chains of landed pages as they arrive.

A page names itself (``page_token``) and the page after it (``continuation``). What has landed is kept as pieces: runs of
pages without a gap, with the token a piece begins at and the token it waits for. New pages are pieces of one page; pieces
are joined where one begins with the token that another waits for. Only pieces and new pages take part, never the pages of a
piece, and the rounds follow the logarithm of the pieces joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentflow.session import cut_lineage


def page_pieces(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, head, tail, n_pages): every landed page as a piece. A page without items or without a continuation ends its
    chain: its ``tail`` is null. A page that landed twice counts once."""
    more = F.col("continuation").isNotNull() & (F.col("n_items") > 0)
    return pages.groupBy(*keys, F.coalesce("page_token", F.lit("")).alias("head")).agg(
        F.max(F.when(more, F.col("continuation"))).alias("tail"), F.lit(1).cast("bigint").alias("n_pages"))


def join_pieces(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """The pieces after all that meet are joined.

    Every piece jumps over the one it meets and adds its pages; the jumps double each round until none meets another, which
    takes no more rounds than the logarithm of the pieces. Pieces that only follow each other in a circle begin
    nowhere and are left out."""
    met = pieces.select(*keys, F.col("tail").alias("head")).filter("head is not null").distinct()
    state = cut_lineage(pieces.join(met.withColumn("_met", F.lit(True)), [*keys, "head"], "left")
                        .select(*keys, "head", "tail", "n_pages", F.col("_met").isNull().alias("_begins"), F.lit(True).alias("_moved")))
    for _ in range(max(1, state.count()).bit_length() + 1):
        nxt = state.select(*keys, F.col("head").alias("tail"), F.col("tail").alias("_tail"), F.col("n_pages").alias("_n"))
        jumps = F.col("_n").isNotNull()
        state = cut_lineage(state.join(nxt, [*keys, "tail"], "left").select(
            *keys, "head", F.when(jumps, F.col("_tail")).otherwise(F.col("tail")).alias("tail"),
            (F.col("n_pages") + F.coalesce("_n", F.lit(0))).alias("n_pages"), "_begins", jumps.alias("_moved")))
        if state.filter("_moved and _begins").isEmpty():
            break
    return state.filter("_begins").select(*keys, "head", "tail", "n_pages")


def landed(pieces: DataFrame | None, pages: DataFrame, keys: list[str]) -> DataFrame:
    """State after a batch of ``pages``: the known pieces and the new pages joined. Pages of earlier batches must not come
    again; a stream drops them by their token first."""
    new = page_pieces(pages, keys)
    return join_pieces(new if pieces is None else pieces.unionByName(new), keys)


def chain_status(pieces: DataFrame, keys: list[str], first: str = "") -> DataFrame:
    """(keys, reached, waits_for, complete, n_waiting, waiting_pages): pages reached from the first token, the token whose
    page is missing, and what has landed beyond the gap."""
    at_start = F.col("head") == first
    return pieces.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(at_start, F.col("n_pages"))), F.lit(0)).alias("reached"),
        F.when(F.count_if(at_start) == 0, F.lit(first)).otherwise(F.max(F.when(at_start, F.col("tail")))).alias("waits_for"),
        F.bool_or(at_start & F.col("tail").isNull()).alias("complete"),
        F.count_if(~at_start).alias("n_waiting"), F.coalesce(F.sum(F.when(~at_start, F.col("n_pages"))), F.lit(0)).alias("waiting_pages"))
