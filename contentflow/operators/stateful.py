"""Ordered state machines over logs: window dedup, recheck gate, breaker, token bucket.

Each of them is cut at points where the state does not depend on the past, found
with windows over ranges, so a hot key is worked on in many pieces. The spaced
forms mark a path of pointers; breaker and bucket fold a piece from sorted
partitions as a stream of Arrow batches with constant memory. No group is ever
collected. The same step functions drive the streaming forms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentflow.operators.ordering import carry_max, in_ranges, with_previous
from contentflow.session import cut_lineage

MICROS = 1_000_000


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable,
                outputs: dict[str, str]) -> DataFrame:
    """Adds ``outputs`` by running ``state, values = step(state, row)`` along each key in order.

    ``row`` is a tuple of the frame's columns. The state of the current key crosses Arrow
    batches, so memory does not depend on the number of rows of a key."""
    fields = [f"{n} {t}" for n, t in df.dtypes] + [f"{n} {t}" for n, t in outputs.items()]
    columns, names = df.columns, list(outputs)
    at = [columns.index(k) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            values = []
            for row in pdf.itertuples(index=False, name=None):
                key = tuple(row[i] for i in at)
                if key != current:
                    current, state = key, start(row)
                state, out = step(state, row)
                values.append(out)
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(values, columns=names)], axis=1)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, ", ".join(fields))


# --- accept when the last accepted row is far enough ------------------------------------

def _micros(c):
    return F.unix_micros(c)


def accept_spaced(df: DataFrame, keys: list[str], ts: str, tie: str, gap_seconds: int, strict: bool) -> DataFrame:
    """Adds ``accepted``: the first row of a key, then every row whose distance to the last
    accepted one exceeds the gap (``strict``) or reaches it. Refused rows change nothing.

    A row whose distance to the row before it is already large enough is accepted whatever
    happened earlier, so it starts a piece. Inside a piece, rows close to its start are
    refused at once; where others are left, the accepted ones are the path of a chain of
    pointers, marked by doubling. No piece is stepped through row by row."""
    gap = gap_seconds * MICROS
    far = (lambda d: d > gap) if strict else (lambda d: d >= gap)
    pieces = cut_lineage(_pieces(df, keys, ts, tie, far))
    later = far(_micros(ts) - _micros("_start"))
    settled = F.col("_opens") | ~later
    open_pieces = pieces.filter(~settled).select(*keys, "_start").distinct()
    chained = _chain_spaced(pieces.join(open_pieces, [*keys, "_start"], "left_semi"), keys, ts, tie, gap, strict)
    done = pieces.filter(settled).withColumn("accepted", F.col("_opens")).select(*df.columns, "accepted")
    return done.unionByName(chained.filter(~settled).select(*df.columns, "accepted"))


def _pieces(df: DataFrame, keys: list[str], ts: str, tie: str, far: Callable) -> DataFrame:
    """Adds ``_opens`` (far from the row before) and ``_start``, the time of the latest opening row of the key.

    The rows are dealt into ranges once. A part (the rows of a key in one range) is settled by itself up to its first
    row, whose neighbour lies in an earlier range; one row for each part carries the last time and the last opening over."""
    cut = in_ranges(df, [*keys, ts, tie])
    keyed = [*keys, "_range"]
    inside = Window.partitionBy(*keyed).orderBy("_row")
    near = cut.withColumn("_before", F.lag(ts).over(inside))
    near = near.withColumn("_here", F.when(far(_micros(ts) - _micros("_before")), F.col(ts)))
    near = near.withColumn("_latest", F.max("_here").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    parts = near.groupBy(*keyed).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.max("_here").alias("_open"))
    along = Window.partitionBy(*keys).orderBy("_range")
    parts = parts.withColumn("_past", F.lag("_last").over(along))
    parts = parts.withColumn("_new", F.col("_past").isNull() | far(_micros("_first") - _micros("_past")))
    started = F.coalesce("_open", F.when(F.col("_new"), F.col("_first")))
    parts = parts.withColumn("_carried", F.max(started).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    heads = parts.select(*keyed, "_new", F.when(F.col("_new"), F.col("_first")).otherwise(F.col("_carried")).alias("_head"))
    return near.join(heads, keyed).select(
        *df.columns, F.when(F.col("_before").isNull(), F.col("_new")).otherwise(F.col("_here").isNotNull()).alias("_opens"),
        F.coalesce("_latest", "_head").alias("_start"))


def _chain_spaced(rows: DataFrame, keys: list[str], ts: str, tie: str, gap: int, strict: bool) -> DataFrame:
    """Accepted rows are the path start -> next -> next ... where next is the first time far
    enough away. The pointers are found per time cell and the path is marked by doubling:
    about log2(path length) rounds of equi-joins, each cut by a checkpoint."""
    key = [*keys, "_start"]
    times = rows.select(*key, _micros(ts).alias("t")).distinct()
    shift = gap + (1 if strict else 0)  # the next row lies at t + shift or later
    events = times.select(*key, F.col("t").alias("at"), F.lit(True).alias("is_event"), "t")
    probes = times.select(*key, (F.col("t") + shift).alias("at"), F.lit(False).alias("is_event"), "t")
    both = events.unionByName(probes).withColumn("cell", F.floor(F.col("at") / shift))
    inside = Window.partitionBy(*key, "cell").orderBy(F.col("at").desc(), F.col("is_event").desc())
    hit = F.last(F.when(F.col("is_event"), F.col("t")), ignorenulls=True).over(inside)
    here = both.withColumn("hit", hit).filter(~F.col("is_event"))
    firsts = events.withColumn("cell", F.floor(F.col("at") / shift)).groupBy(*key, "cell").agg(F.min("t").alias("first"))
    # inside a piece no two neighbours are further apart than the gap, so the next cell has a row if any is left
    nexts = here.join(firsts.withColumn("cell", F.col("cell") - 1), [*key, "cell"], "left").select(
        *key, "t", F.coalesce("hit", "first").alias("nxt")).filter(F.col("nxt").isNotNull())
    path = mark_path(rows.select(*key, _micros("_start").alias("t")).distinct(), nexts, key, "t")
    chosen = path.select(*key, F.col("t").alias("_t"), F.lit(True).alias("_on_path"))
    marked = rows.withColumn("_t", _micros(ts)).join(chosen, [*key, "_t"], "left")
    # of several rows at an accepted time the first one is taken
    winners = marked.filter("_on_path").groupBy(*key, "_t").agg(F.min(tie).alias("_win"))
    return (marked.join(winners, [*key, "_t"], "left")
            .withColumn("accepted", F.coalesce(F.col("_on_path") & (F.col(tie) == F.col("_win")), F.lit(False)))
            .drop("_t", "_on_path", "_win"))


def mark_path(starts: DataFrame, pointers: DataFrame, keys: list[str], node: str) -> DataFrame:
    """Nodes reached from ``starts`` along ``pointers(keys, node, nxt)``, one successor per node.

    Doubling: in each round the reached set follows the current pointers and the pointers
    skip twice as far, so a path of n nodes takes about log2(n) equi-joins. Pointers that
    loop are harmless: a round without a new node ends the search."""
    jump, path = cut_lineage(pointers), cut_lineage(starts.distinct())
    reached = path.count()
    while True:
        more = path.join(jump, [*keys, node]).select(*keys, F.col("nxt").alias(node))
        path = cut_lineage(path.unionByName(more).distinct())
        now = path.count()
        if now == reached:
            return path
        reached = now
        hop = jump.select(*keys, F.col(node).alias("nxt"), F.col("nxt").alias("_far"))
        jump = cut_lineage(jump.join(hop, [*keys, "nxt"]).select(*keys, node, F.col("_far").alias("nxt")))


def dedup_in_window(df: DataFrame, key: str, ts: str, tie: str, seconds: int = 3600) -> DataFrame:
    """A repeated key is refused up to ``seconds`` after the last accepted one."""
    return accept_spaced(df, [key], ts, tie, seconds, strict=True)


def recheck_gate(df: DataFrame, feed: str, ts: str, tie: str, seconds: int = 300) -> DataFrame:
    """A feed may be checked again once ``seconds`` have passed since its last allowed check."""
    return accept_spaced(df, [feed], ts, tie, seconds, strict=False)


# --- failure streaks ------------------------------------------------------------------------

def breaker_step(state, t: int, ok: bool, threshold: int, timeout: int):
    """(state, failures, opened at) and the values (state before, allowed, state after)."""
    name, failures, opened = state
    before = name
    if name == "open":
        if t - opened < timeout:
            return state, (before, False, name)
        name = "half-open"
    if ok:
        new = ("closed", 0, opened)
    elif name == "half-open" or failures + 1 >= threshold:
        new = ("open", 0, t)
    else:
        new = ("closed", failures + 1, opened)
    return new, (before, True, new[0])


def breaker_log(attempts: DataFrame, service: str, ts: str, tie: str, ok: str, threshold: int = 3,
                timeout_seconds: int = 60) -> DataFrame:
    """Every attempt with ``state_before``, ``allowed`` and ``state_after``.

    A success without any failure in the preceding timeout closes the breaker whatever its
    state was, so a new piece starts behind it."""
    timeout = timeout_seconds * MICROS
    prior = carry_max(attempts, [service], ts, tie, F.when(~F.col(ok), F.col(ts)), "_last_bad", False)
    calm = F.col(ok) & (F.col("_last_bad").isNull() | (_micros(ts) - _micros("_last_bad") >= timeout))
    cut = prior.withColumn("_calm", calm)
    # the calm row itself ends its piece: the piece is named by the latest calm row before it
    pieces = carry_max(cut, [service], ts, tie, F.when(F.col("_calm"), F.struct(_micros(ts).alias("t"), F.col(tie).alias("i"))), "_p", False)
    work = pieces.withColumns({"_piece_t": F.coalesce("_p.t", F.lit(-1)), "_piece_i": F.coalesce("_p.i", F.lit(-1)), "_t": _micros(ts)}).drop("_p", "_last_bad", "_calm")
    at_t, at_ok = work.columns.index("_t"), work.columns.index(ok)

    def step(state, row):
        return breaker_step(state, row[at_t], bool(row[at_ok]), threshold, timeout)

    out = fold_sorted(work, [service, "_piece_t", "_piece_i"], ["_t", tie], lambda row: ("closed", 0, 0), step,
                      {"state_before": "string", "allowed": "boolean", "state_after": "string"})
    return out.drop("_piece_t", "_piece_i", "_t")


# --- token bucket -----------------------------------------------------------------------------

def bucket_step(state, t: int, rate: float, burst: float, need: float = 1.0):
    """(tokens, last time) and the values (tokens left, throttled, wait seconds)."""
    tokens, last = state
    tokens = min(burst, tokens + (t - last) / MICROS * rate)
    if tokens < need:
        return (tokens, t), (tokens, True, (need - tokens) / rate)
    return (tokens - need, t), (tokens - need, False, 0.0)


def token_bucket_log(calls: DataFrame, endpoint: str, ts: str, tie: str, rate: float, burst: float) -> DataFrame:
    """Every call with ``tokens``, ``throttled`` and ``wait_seconds``.

    After a pause long enough to fill the bucket the past does not matter, so a piece starts there."""
    full = int(burst / rate * MICROS)
    prev = with_previous(calls, [endpoint], ts, tie, "_prev")
    fresh = F.col("_prev").isNull() | (_micros(ts) - _micros("_prev") >= full)
    pieces = carry_max(prev, [endpoint], ts, tie, F.when(fresh, _micros(ts)), "_piece", True).withColumn("_t", _micros(ts)).drop("_prev")
    at_t = pieces.columns.index("_t")

    def step(state, row):
        return bucket_step(state, row[at_t], rate, burst)

    out = fold_sorted(pieces, [endpoint, "_piece"], ["_t", tie], lambda row: (burst, row[at_t]), step,
                      {"tokens": "double", "throttled": "boolean", "wait_seconds": "double"})
    return out.drop("_piece", "_t")
