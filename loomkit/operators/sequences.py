"""Ordered event histories. Each operator takes rows in ``ranges.ranged`` ranges too, and then no task holds all rows of a key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranges import RANGE, STEPS, by, carried, matched, ranged, running_sum, sorted_runs, spread, stepped

STEPS_OF_IMPULSE = 24
#: Frames that one task adds up.
FRAMES = 2_000_000


def collapse_repeats(events: DataFrame, user: str = "user_id", key: str = "event_type", order=("ts", "event_id")) -> DataFrame:
    """``events`` without those that repeat the one just before them."""
    w = W.partitionBy(*by(events, user)).orderBy(*order)
    rows = events.withColumn("_n", F.row_number().over(w)).withColumn("_prev", F.lag(key).over(w))
    if RANGE in events.columns:
        # The first row of a range follows the last of the one before.
        rows = carried(rows, user, {"_last": F.max_by(F.struct(key), F.struct(*order))}, _before=F.last("_last"))
        at_start = (F.col("_n") == 1) & F.col("_before").isNotNull()
        rows = rows.withColumn("_prev", F.when(at_start, F.col(f"_before.{key}")).otherwise(F.col("_prev"))).withColumn("_n", F.when(at_start, 2).otherwise(F.col("_n"))).drop("_before")
    return rows.where((F.col("_n") == 1) | ~F.col(key).eqNullSafe(F.col("_prev"))).drop("_n", "_prev")


def remove_key_and_collapse(events: DataFrame, gone: str, user: str = "user_id", key: str = "event_type", order=("ts", "event_id")) -> DataFrame:
    return collapse_repeats(events.where(~F.col(key).eqNullSafe(F.lit(gone))), user, key, order)


def burst_ratio(events: DataFrame, seconds: float = 0.5, cap: int = 15, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """``events`` with ratio: the events of the key in the window that ends here, both ends counting, over ``cap``, at most 1.

    Of the ranges before, the last ``cap`` times are all that can count.
    """
    micros = int(seconds * 1_000_000)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    n = F.count("*").over(W.partitionBy(*by(events, user)).orderBy(at).rangeBetween(-micros, 0))
    if RANGE not in events.columns:
        return events.withColumn("ratio", F.least(n / float(cap), F.lit(1.0)))
    newest = W.partitionBy(user, RANGE).orderBy(F.desc(ts))
    last = events.select(user, RANGE, F.col(ts).alias("_ts"), F.row_number().over(newest).alias("_n")).where(F.col("_n") <= cap)
    last = last.groupBy(user, RANGE).agg(F.collect_list(F.unix_micros(F.col("_ts").cast("timestamp"))).alias("_times"))
    # A range that has earlier ones of its key holds at least one row, so that so many ranges have all that counts; peers may stand in the next one.
    ordered = W.partitionBy(user).orderBy(RANGE)
    times = last.select(user, RANGE, F.flatten(F.collect_list("_times").over(ordered.rowsBetween(-cap, -1))).alias("_earlier"))
    oldest = W.partitionBy(user, RANGE).orderBy(ts)
    first = events.select(user, RANGE, F.col(ts).alias("_ts"), F.row_number().over(oldest).alias("_n")).where(F.col("_n") <= cap)
    first = first.groupBy(user, RANGE).agg(F.collect_list(F.unix_micros(F.col("_ts").cast("timestamp"))).alias("_times"))
    later = first.select(user, RANGE, F.flatten(F.collect_list("_times").over(ordered.rowsBetween(1, cap))).alias("_later"))
    rows = events.withColumn("_count", n).withColumn("_at", at)
    rows = matched(matched(rows, times.where("size(_earlier) > 0"), user), later.where("size(_later) > 0"), user)
    near = lambda c, test: F.coalesce(F.size(F.filter(c, test)), F.lit(0))
    more = near("_earlier", lambda x: x >= F.col("_at") - micros) + near("_later", lambda x: x == F.col("_at"))
    return rows.withColumn("ratio", F.least((F.col("_count") + more) / float(cap), F.lit(1.0))).drop("_count", "_at", "_earlier", "_later")


def boosted(delta: Column, ratio: Column, step: float = 1.5, acceleration: float = 1.0) -> Column:
    """The distance of an impulse: longer the denser the burst it stands in."""
    return delta * step * (1 + acceleration * ratio)


def kernel(mode: str = "linear", steps: int = STEPS_OF_IMPULSE) -> np.ndarray:
    """The weights of an impulse's frames; they sum to 1, those of the quadratic kernel nearly."""
    m = steps / 2
    x = np.abs(np.arange(steps) - m) / m
    shape = {"constant": np.full(steps, 0.5), "linear": 1 - x, "quadratic": 0.75 * (1 - x * x), "cosine": (1 + np.cos(np.pi * x)) / 2}
    return shape[mode] / m


def spread_impulses(events: DataFrame, key: str, ts: str, delta: str, frame_ms: int = 16, mode: str = "linear", steps: int = STEPS_OF_IMPULSE, whole: bool = False) -> DataFrame:
    """(key, frame, delta): each impulse spread over its frames, overlaps added; ``whole`` rounds each frame, halves to even.

    Impulses go to the task of their key and run of frames (to both tasks, if they reach into the next run) and are spread only there,
    in as many tasks as keep each one's frames at about ``FRAMES``.
    """
    weights = F.array(*[F.lit(float(x)) for x in kernel(mode, steps)])
    total = F.sum(F.col("d") * F.col("w"))
    run = lambda k: F.floor((F.col("frame0") + k) / (10 * steps))
    n = max(events.sparkSession.sparkContext.defaultParallelism, -(-events.count() * steps // FRAMES))
    rows = events.select(key, F.floor(F.unix_millis(F.col(ts).cast("timestamp")) / frame_ms).alias("frame0"), F.col(delta).alias("d"))
    rows = rows.select("*", F.explode(F.array_distinct(F.array(run(F.lit(0)), run(F.lit(steps - 1))))).alias("run")).repartition(n, key, "run")
    rows = rows.select("*", F.posexplode(weights).alias("k", "w")).where(F.col("run").eqNullSafe(run(F.col("k"))))
    each = rows.groupBy(key, "run", (F.col("frame0") + F.col("k")).alias("frame")).agg((F.bround(total) if whole else total).alias("delta"))
    return each.select(key, "frame", "delta")


def _known(positions: DataFrame, session: str, order: list[str], **columns: tuple[str, str]) -> DataFrame:
    """``positions`` with ``columns``, each the last value so far, nulls not counted, of a column among the rows of a track."""
    w = W.partitionBy(*by(positions, session)).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    of = lambda track, c: F.when(F.col("track") == track, F.col(c))
    out = positions.select("*", *[F.last(of(*c), ignorenulls=True).over(w).alias(n) for n, c in columns.items()])
    if RANGE in positions.columns:
        last = {f"_{n}": F.max_by(of(*c), F.when(of(*c).isNotNull(), F.struct(*order))) for n, c in columns.items()}
        out = carried(out, session, last, **{f"_{n}": F.last(f"_{n}", ignorenulls=True) for n in columns})
        out = out.withColumns({n: F.coalesce(n, f"_{n}") for n in columns}).drop(*[f"_{n}" for n in columns])
    return out


def drift_events(positions: DataFrame, threshold: float = 150, session: str = "session_id") -> DataFrame:
    """Rows where the last known positions of main and sub (positions: track, ts, position) lie more than ``threshold`` apart."""
    known = _known(positions, session, ["ts", "event_id"], main=("main", "position"), sub=("sub", "position"))
    return known.where(F.abs(F.col("main") - F.col("sub")) > threshold)


def next_exceeding(v: np.ndarray, threshold: float) -> np.ndarray:
    """For each place the first later one whose value lies more than ``threshold`` away, or the length: a descent over the extremes of runs of 1, 2, 4, ... values."""
    n = len(v)
    levels, size = [(v, v)], 1
    while 2 * size <= n:
        high, low = levels[-1]
        levels.append((np.maximum(high[:-size], high[size:]), np.minimum(low[:-size], low[size:])))
        size *= 2
    at = np.arange(1, n + 1)
    for k in range(len(levels) - 1, -1, -1):
        high, low = levels[k]
        here = np.flatnonzero(at + (1 << k) <= n)
        near = (high[at[here]] - v[here] <= threshold) & (v[here] - low[at[here]] <= threshold)
        at[here[near]] += 1 << k
    return at


def drift_ticks(positions: DataFrame, threshold: float = 150, tick_ms: int = 200, session: str = "session_id", rows: int = STEPS) -> DataFrame:
    """(session, tick, main, sub): ticks of ``tick_ms`` at whose end both tracks play more than ``threshold`` apart; sub is then set to main and stays there until its next row.

    ``positions``: track (main or sub), ts, event_id, position, playing. A tick without rows
    changes nothing, and a correction closes the gap, so such ticks never have one. A session is gone through in
    ranges of ``rows`` rows: whatever sub's place before a range is, main's running extremes tell the first
    correction in it, and pointers from correction to correction tell where sub is after it.
    """
    far = positions.withColumn("tick", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / tick_ms))
    far = ranged(far, session, ["tick"], rows)
    order = ["ts", "event_id"]
    far = _known(far.withColumn("_at", F.struct(*order)), session, order, main=("main", "position"), sub=("sub", "position"), since=("sub", "_at"), main_plays=("main", "playing"), sub_plays=("sub", "playing"))
    # All rows of a tick lie in one range.
    following = F.lead("tick").over(W.partitionBy(*by(far, session)).orderBy(*order))
    ends = far.withColumn("_next", following).where((F.col("_next").isNull() | (F.col("_next") != F.col("tick"))) & F.col("main_plays") & F.col("sub_plays") & F.col("main").isNotNull() & F.col("sub").isNotNull())
    ends = ends.select(session, *[RANGE] * (RANGE in far.columns), "tick", "main", "sub", F.unix_micros(F.col("since.ts").cast("timestamp")).alias("_since"), F.col("since.event_id").alias("_event"))

    def step(state, main, sub, since, event):
        places, gaps = [], []
        mark, at = state or (None, None)
        for m, s, mark_here in zip(main, sub, zip(since, event, strict=True), strict=True):
            if mark_here != mark:
                mark, at = mark_here, s
            gap = abs(m - at) > threshold
            places.append(at)
            gaps.append(gap)
            at = m if gap else at
        return places, gaps

    def summarise(main, sub, since, event):
        marks = list(zip(since, event, strict=True))
        cut = next((k for k, x in enumerate(marks) if x != marks[0]), len(marks))
        out = {"first": marks[0], "sub": sub[0], "last": marks[-1]}
        if cut < len(marks):
            # sub has a row within: what was before does not reach the end.
            k = len(marks) - 1
            while marks[k - 1] == marks[-1]:
                k -= 1
            at = sub[k]
            for m in main[k:]:
                at = m if abs(m - at) > threshold else at
            return out | {"end": at}
        v = np.array(main, float)
        follows = next_exceeding(v, threshold).tolist()
        last = list(range(len(v)))
        for k in range(len(v) - 1, -1, -1):
            if follows[k] < len(v):
                last[k] = last[follows[k]]
        for name, extreme in (("up", np.maximum.accumulate(v)), ("down", np.minimum.accumulate(v))):
            records = np.flatnonzero(np.r_[True, np.diff(extreme) != 0])
            out[name] = [(int(k), main[k], main[last[k]]) for k in records]
        return out

    def fold(state, s):
        if "end" in s:
            return s["last"], s["end"]
        at = state[1] if state and state[0] == s["first"] else s["sub"]
        found = [next((r for r in s[name] if abs(r[1] - at) > threshold and (r[1] > at) == (name == "up")), None) for name in ("up", "down")]
        first = min((r for r in found if r), default=None)
        return s["last"], first[2] if first else at

    number = ends.schema["sub"].dataType
    done = stepped(ends, session, ["tick"], [T.StructField("_place", number), T.StructField("_gap", T.BooleanType())], step, summarise, fold, ["main", "sub", "_since", "_event"])
    return done.where("_gap").select(session, F.col("tick").cast("long"), "main", F.col("_place").alias("sub"))


def clamped_running_product(events: DataFrame, user: str, order: list[str], up: str, low: float = 0.1, high: float = 10.0, chunk: int = 1024) -> DataFrame:
    """(user, zoom): from 1, times 1.25 where ``up`` is true and 0.8 where not, held within the limits at each step.

    Steps in a row are one step of the same form, a factor and two limits, so the events of a user
    are folded in chunks, each of which is one list, and then the chunks.
    """
    inside = lambda z, a, b: F.greatest(a, F.least(b, z))
    lo, hi = F.lit(low), F.lit(high)
    number = F.row_number().over(W.partitionBy(*by(events, user)).orderBy(*order))
    part = F.col(RANGE) if RANGE in events.columns else F.lit(0)
    rows = events.select(user, F.struct(part.alias("range"), F.floor((number - 1) / chunk).alias("n")).alias("chunk"), number.alias("n"), F.when(F.col(up), 1.25).otherwise(0.8).alias("by"))
    listed = rows.groupBy(user, "chunk").agg(F.array_sort(F.collect_list(F.struct("n", "by"))).alias("steps"))
    start = F.struct(F.lit(1.0).alias("by"), lo.alias("lo"), hi.alias("hi"))
    step = lambda s, x: F.struct((s.by * x.by).alias("by"), inside(s.lo * x.by, lo, hi).alias("lo"), inside(s.hi * x.by, lo, hi).alias("hi"))
    folded = listed.select(user, "chunk", F.aggregate("steps", start, step).alias("f"))
    chunks = folded.groupBy(user).agg(F.array_sort(F.collect_list(F.struct("chunk", "f"))).alias("chunks"))
    return chunks.select(user, F.aggregate("chunks", F.lit(1.0), lambda z, x: inside(z * x.f.by, x.f.lo, x.f.hi)).alias("zoom"))


def replay(ops: list[tuple[str, str]], default: str | None = None) -> list[str]:
    """The history that pushes, pops and removals leave; a repeat of the top is ignored, the default at the bottom is never popped nor removed. A drop pops the key if it is on top."""
    out = [] if default is None else [default]
    fixed = len(out)
    for op, key in ops:
        if op == "push":
            if not out or out[-1] != key:
                out.append(key)
        elif op == "pop" or op == "drop":
            if len(out) > fixed and (op == "pop" or out[-1] == key):
                out.pop()
        else:
            kept = out[:fixed] + [x for x in out[fixed:] if x != key]
            out = [x for i, x in enumerate(kept) if i == 0 or kept[i - 1] != x]
    return out


def condensed(ops: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """A shorter list that does the same to any history: first what reaches below these operations' own pushes, then the pushes that stay.

    The lowest push is one that the history's top may make void. Popping it takes the key off
    the top if it was void, and nothing if it was not: that is a drop.
    """
    below, own = [], []
    for op, key in ops:
        if op == "push":
            if not own or own[-1] != key:
                own.append(key)
        elif op in ("pop", "drop") and own:
            if op == "pop" or own[-1] == key:
                top = own.pop()
                if not own:
                    below.append(("drop", top))
        elif op in ("pop", "drop"):
            below.append((op, key))
        else:
            kept = [x for x in own if x != key]
            own = [x for i, x in enumerate(kept) if i == 0 or kept[i - 1] != x]
            if not below or below[-1] != (op, key):
                below.append((op, key))
    return below + [("push", k) for k in own]


def trail(ops: list[tuple[str, str]]) -> list[str]:
    """A breadcrumb: push adds what is not there, select drops all after it, pop drops the last."""
    out: list[str] = []
    for op, key in ops:
        if op == "push" and key not in out:
            out.append(key)
        elif op == "select" and key in out:
            del out[out.index(key) + 1 :]
        elif op == "pop" and out:
            out.pop()
    return out


def settled(ops: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """``ops`` of a trail without those that change nothing whatever trail they find: pushes of what is there for certain, selections of what is last."""
    out, there, last = [], set(), None
    for op, key in ops:
        if op == "push":
            if key in there:
                continue
            there.add(key)
            # Where it was there before, something else may be last.
            last = None
        elif op == "select":
            if last is not None and last == key:
                continue
            there, last = ({key}, key) if key in there else (set(), None)
        else:
            there, last = set(), None
        out.append((op, key))
    return out


def _folded(ops: DataFrame, user: str, whole, shorter, rows: int) -> DataFrame:
    """Users that lie in one range are folded there; of the others each range is made ``shorter``, and what is left is folded."""
    pairs = "array<struct<op: string, key: string>>"
    kind = ops.schema[user].dataType
    history = T.StructType([T.StructField(user, kind), T.StructField("history", T.ArrayType(T.StringType()))])
    ops = ranged(ops.select(user, "seq", "op", "key", *[RANGE] * (RANGE in ops.columns)), user, ["seq"], rows)

    def run(fold, column, kinds):
        def each(t):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            t, runs = sorted_runs(t, user, ["seq"])
            op, key = t["op"].to_pylist(), t["key"].to_pylist()
            found = [fold(list(zip(op[a:b], key[a:b], strict=True))) for a, b in runs]
            schema = to_arrow_schema(kinds)
            columns = {user: t[user].take(pa.array([a for a, _ in runs], pa.int64())), column: pa.array([[{"op": o, "key": k} for o, k in f] if column == "ops" else f for f in found], schema.field(column).type)}
            if RANGE in schema.names:
                columns[RANGE] = t[RANGE].take(pa.array([a for a, _ in runs], pa.int64()))
            return pa.table([columns[c] for c in schema.names], schema=schema)

        return each

    if RANGE not in ops.columns:
        return ops.groupBy().applyInArrow(run(whole, "history", history), history)
    parts = spread(ops, user)
    inside = matched(ops, parts, user, "left_anti").groupBy(RANGE).applyInArrow(run(whole, "history", history), history)
    left = T.StructType([T.StructField(user, kind), T.StructField(RANGE, T.IntegerType()), T.StructField("ops", T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("key", T.StringType())])))])
    short = matched(ops, parts, user, "left_semi").groupBy(user, RANGE).applyInArrow(run(shorter, "ops", left), left)
    short = short.select(user, RANGE, F.posexplode(F.col("ops").cast(pairs)).alias("n", "o")).select(user, (F.col(RANGE).cast("long") * (1 << 32) + F.col("n")).alias("seq"), "o.op", "o.key")
    # A user of whom nothing is left has an empty history.
    across = short.groupBy(user).applyInArrow(run(whole, "history", history), history)
    empty = parts.select(user).distinct().withColumn("history", F.array().cast("array<string>"))
    return inside.unionByName(across).unionByName(empty.join(across.select(F.col(user).alias("_user")), F.col(user).eqNullSafe(F.col("_user")), "left_anti"))


def replay_history(ops: DataFrame, user: str = "user_id", default: str | None = None, rows: int = STEPS) -> DataFrame:
    """(user, history) of ops (user, seq, op, key), in the order of seq, on top of the ``default`` entry if there is one.

    A user with many operations is folded by ranges of about ``rows``: each is ``condensed``, and the shorter lists are replayed one after the other.
    """
    done = _folded(ops, user, lambda x: replay(x, default), condensed, rows)
    return done if default is None else done.withColumn("history", F.when(F.size("history") == 0, F.array(F.lit(default))).otherwise(F.col("history")))


def breadcrumb_trail(ops: DataFrame, user: str = "user_id", rows: int = STEPS) -> DataFrame:
    """(user, history) of ops (user, seq, op: push, select or pop, key): no longer than the user has different keys. Ranges of about ``rows`` are ``settled`` first."""
    return _folded(ops, user, trail, settled, rows)


def pack_rows(items: DataFrame, width: int, spacing: int, row_spacing: int | None = None, rows: int = STEPS) -> DataFrame:
    """``items`` (group_id, pos, size, height) with row, x, y and row_height: an item that would reach beyond ``width`` starts the next row, unless nothing in its row has a height.

    A row is as high as its highest item; rows lie ``row_spacing`` apart, or ``spacing``. Null sizes and heights count as 0,
    sizes are not negative. A group is gone through in ranges of ``rows`` items: of a range it is found in advance where a row that begins at any
    of its first items leads to, so that its last row is known for any row that reaches into it.
    """
    gap = spacing if row_spacing is None else row_spacing
    items = ranged(items.withColumn("_size", F.coalesce("size", F.lit(0)).cast("double")).withColumn("_height", F.coalesce("height", F.lit(0)).cast("double")), "group_id", ["pos"], rows)

    def step(state, size, height):
        row, x, high = state or (0, 0.0, False)
        at, places = [], []
        for w, h in zip(size, height, strict=True):
            if high and x + w > width:
                row, x, high = row + 1, 0.0, False
            at.append(row)
            places.append(x)
            x += w + spacing
            high = high or h > 0
        return at, places

    def summarise(size, height):
        n = len(size)
        # Where each item would end in a row that begins with the first.
        ends = np.cumsum(np.array(size) + spacing)
        starts = ends - np.array(size) - spacing
        highs = np.r_[np.flatnonzero(np.array(height) > 0), n]
        next_high = highs[np.searchsorted(highs, np.arange(n))]
        follows = np.maximum(np.searchsorted(ends - spacing, starts + width, "right"), next_high + 1).clip(max=n).tolist()
        count, last = [1] * n, list(range(n))
        for k in range(n - 1, -1, -1):
            if follows[k] < n:
                count[k], last[k] = 1 + count[follows[k]], last[follows[k]]
        reach = min(follows[0], n - 1) + 1
        out = [(float(ends[k] - spacing), count[k], float(ends[-1] - starts[last[k]]), bool(next_high[last[k]] < n)) for k in range(reach)]
        return {"n": n, "first_high": int(next_high[0]), "all": float(ends[-1]), "from": out}

    def fold(state, s):
        row, x, high = state or (0, 0.0, False)
        least = 0 if high else s["first_high"] + 1
        for k, (end, count, to, then_high) in enumerate(s["from"]):
            if k >= least and x + end > width:
                return row + count, to, then_high
        return row, x + s["all"], high or s["first_high"] < s["n"]

    placed = stepped(items, "group_id", ["pos"], [T.StructField("row", T.LongType()), T.StructField("x", T.DoubleType())], step, summarise, fold, ["_size", "_height"])
    lines = placed.groupBy("group_id", "row").agg(F.max("_height").alias("row_height"))
    lines = ranged(lines, "group_id", ["row"])
    lines = running_sum(lines, "group_id", ["row"], F.col("row_height") + gap, "y").withColumn("y", F.col("y") - F.col("row_height") - gap)
    lines = lines.select(F.col("group_id").alias("_group"), F.col("row").alias("_row"), "row_height", "y")
    return placed.join(lines, F.col("group_id").eqNullSafe(F.col("_group")) & (F.col("row") == F.col("_row"))).drop("_group", "_row", "_size", "_height")
