"""From labelled segments to intervals: time base, smoothing, merging, totals, transitions, cleaning.

Every operator takes and gives DataFrames keyed by user_id, so that one job serves all users. Rows of a
user are ordered by (t_start, ord), ord being any column that tells rows of one moment apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CLASSES, SECONDS, TimelineConfig
from ..session import written


#: Seconds of a user's time, and segments of a run, that one task works on.
BLOCK_S, BLOCK_ROWS = 86_400.0, 20_000


def in_block(*keys: str):
    return Window.partitionBy("user_id", *keys).orderBy("t_start", "ord")


def numbered(rows: DataFrame, name: str, carried: list[str], begins: Callable, place: str | None = None, block_s: float = BLOCK_S) -> DataFrame:
    """Adds `name`, a number that goes up at each row of a user for which begins(before, own) holds; both give a column of the row before and of the row itself. And
    `place`, if it is named: how many rows with the same number come before.

    Blocks of a user's time are numbered apart. What each of them has first and last, and how often its number goes up, is one row; along these, a small
    fraction of all rows, a window finds out what the blocks' first rows do and where their numbers start. So no task holds a user. Rows are
    written with their blocks' numbers, so that what came before is computed once."""
    rows = rows.withColumn("_block", F.floor(F.col("t_start") / block_s).cast("long"))
    w = in_block("_block")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    step = lambda before, own: F.coalesce(begins(before, own).cast("long"), F.lit(0))
    rows = rows.withColumn("_before", F.lag(F.struct(*carried)).over(w)).withColumn("_row", F.row_number().over(w) - 1)
    rows = rows.withColumn("_new", step(lambda c: F.col("_before")[c], F.col))
    rows = rows.withColumn("_in", F.sum("_new").over(so_far)).withColumn("_at", F.max(F.when(F.col("_new") == 1, F.col("_row"))).over(so_far)).drop("_before", "_new")
    rows = written(rows, name.strip("_"))
    own, at = F.struct(*carried), F.struct("t_start", "ord")
    blocks = rows.groupBy("user_id", "_block").agg(F.min_by(own, at).alias("_first"), F.max_by(own, at).alias("_last"), F.max("_in").alias("_n"), F.max("_at").alias("_at"), F.count("*").alias("_rows"))
    u = Window.partitionBy("user_id").orderBy("_block")
    earlier = u.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_own", step(lambda c: F.lag("_last").over(u)[c], lambda c: F.col("_first")[c])).withColumn("_rows_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    # of all the user's rows, the place of the last one where the number went up
    last_new = F.col("_rows_before") + F.coalesce("_at", F.when(F.col("_own") == 1, F.lit(0)))
    blocks = blocks.withColumn("_up", last_new).withColumn("_since", F.when(F.col("_own") == 1, F.col("_rows_before")).otherwise(F.coalesce(F.max("_up").over(earlier), F.lit(0))))
    blocks = blocks.select("user_id", "_block", (F.coalesce(F.sum(F.col("_n") + F.col("_own")).over(earlier), F.lit(0)) + F.col("_own")).alias("_from"), (F.col("_rows_before") - F.col("_since")).alias("_late"))
    out = rows.join(blocks, ["user_id", "_block"]).withColumn(name, (F.col("_from") + F.col("_in")).cast("long"))
    if place:
        out = out.withColumn(place, F.coalesce(F.col("_row") - F.col("_at"), F.col("_row") + F.col("_late")).cast("long"))
    return out.drop("_block", "_row", "_in", "_at", "_from", "_late")


def placed(rows: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """rows with place, each one's place in its user's run from 0, as smoothing_runs gives it; counted here for runs from elsewhere."""
    if "place" in rows.columns:
        return rows
    return numbered(rows, "_run", ["run"], lambda before, own: own("run") != before("run"), "place", block_s).drop("_run")


def in_time(intervals: DataFrame) -> list[str]:
    """What a user's intervals are ordered by. Of those that start at one moment, as segments of one second make them, the one whose first segment (ord) comes first is
    the earlier; intervals from elsewhere, without ord, go by their ends."""
    return ["start_s", "ord"] if "ord" in intervals.columns else ["start_s", "end_s"]


def activity_name(label: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CLASSES)), label.cast("int") + 1)


def time_base(segments: DataFrame, seconds: float = SECONDS) -> DataFrame:
    """Adds t_start and t_end, in seconds from the user's first window: each segment lasts `seconds`."""
    first = segments.groupBy("user_id").agg(F.min("window").alias("_first"))
    start = (F.col("window") - F.col("_first") + F.col("seg_index") * seconds).cast("double")
    out = segments.join(first, "user_id").withColumn("t_start", start).withColumn("t_end", F.col("t_start") + seconds)
    return out.select(*[c for c in segments.columns if c not in ("t_start", "t_end")], "t_start", "t_end")


def smoothing_runs(segments: DataFrame, max_gap_s: float, block_s: float = BLOCK_S) -> DataFrame:
    """Adds run, and each segment's place in it: a new one begins where the start lies more than max_gap_s after the start before."""
    return numbered(segments, "run", ["t_start"], lambda before, own: own("t_start") - before("t_start") > max_gap_s, "place", block_s)


def mode_smooth(segments: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, block_s: float = BLOCK_S) -> DataFrame:
    """Adds y_smooth: the commonest label of the k segments around, within the run. Beyond its ends the run's first or last
    label counts on. Of equally common labels the segment's own is kept, or else the lowest. A run is smoothed in blocks of block_rows segments, each
    with copies of the k // 2 before and behind it."""
    if k <= 1:
        return segments.withColumn("y_smooth", F.col("y"))
    part = F.floor(F.col("place") / block_rows)
    near = lambda d: F.floor((F.col("place") + d) / block_rows)
    spread = placed(segments, block_s).withColumn("_home", part).withColumn("_part", F.explode(F.sequence(F.greatest(near(-(k // 2)), F.lit(0)), near(k // 2))))
    w = in_block("run", "_part")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = []
    for d in range(-(k // 2), k - k // 2):
        edge = F.first("y") if d < 0 else F.last("y")
        near.append(F.col("y") if d == 0 else F.coalesce(F.lag("y", -d).over(w) if d < 0 else F.lead("y", d).over(w), edge.over(whole)))
    out = spread.withColumn("_near", F.array(*near)).where("_part = _home")
    times = lambda c: F.size(F.filter("_near", lambda x: x == c))
    most = F.array_max(F.transform("_near", times))
    lowest = F.array_min(F.filter("_near", lambda x: times(x) == most))
    return out.withColumn("y_smooth", F.when(times(F.col("y")) == most, F.col("y")).otherwise(lowest)).select(*segments.columns, "y_smooth")


def moves(p_stay: float, c: int) -> np.ndarray:
    """Log chances of a state (row) to be followed by another: a state lasts with p_stay, all others are equally likely."""
    return np.where(np.eye(c, dtype=bool), np.log(p_stay), np.log((1 - p_stay) / (c - 1)))


def viterbi(obs: np.ndarray, p_stay: float, entry: int | None = None, exit_: int | None = None) -> np.ndarray:
    """Best state sequence for log evidence obs (steps x states). entry: the state before the first step, where there is one; exit_: the state of the last, where it is known."""
    n, c = obs.shape
    follow = moves(p_stay, c)
    back = np.empty((n, c), np.int64)
    score = obs[0] + (-np.log(c) if entry is None else follow[entry])
    for i in range(1, n):
        reach = score[:, None] + follow
        back[i] = reach.argmax(0)
        score = reach.max(0) + obs[i]
    path = np.empty(n, np.int64)
    path[-1] = score.argmax() if exit_ is None else exit_
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def max_plus(obs: np.ndarray, p_stay: float, first: bool) -> np.ndarray:
    """The best scores of a block's steps from each state before it (row) to each of its last step (column): the product of its steps' matrices where
    products are sums and sums are maxima. A run's first block has one row, from before any state."""
    c = obs.shape[1]
    follow = moves(p_stay, c)
    score = obs[:1] - np.log(c) if first else follow + obs[0]
    for o in obs[1:]:
        score = (score[:, :, None] + follow).max(1) + o
    return score


def ends_of_blocks(blocks: list[np.ndarray]) -> list[int]:
    """The best path's state at the end of each block of a run, from their matrices in order: scores forwards, states backwards."""
    upto, from_ = [blocks[0][0]], []
    for m in blocks[1:]:
        reach = upto[-1][:, None] + m
        from_.append(reach.argmax(0))
        upto.append(reach.max(0))
    ends = [int(upto[-1].argmax())]
    for f in reversed(from_):
        ends.append(int(f[ends[-1]]))
    return ends[::-1]


def stretches(batches: Iterator[pa.RecordBatch], keys: int, many: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where each stretch begins) from rows that are sorted so that those with equal first `keys` columns follow one another: whole
    stretches, about `many` rows at a time, so that a short stretch costs no call of its own."""
    held: list[pa.RecordBatch] = []

    def begins(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in t.columns[:keys]:
            v = c.to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= many:
            t = pa.Table.from_batches(held)
            at = begins(t)
            if len(at) > 1:  # the last stretch may go on
                yield t.slice(0, int(at[-1])), at[:-1]
                held = t.slice(int(at[-1])).to_batches()
    if held and sum(x.num_rows for x in held):
        t = pa.Table.from_batches(held)
        yield t, begins(t)


def viterbi_smooth(segments: DataFrame, emission: list[list[float]] | None, p_stay: float = 0.95, block_rows: int = BLOCK_ROWS, block_s: float = BLOCK_S) -> DataFrame:
    """Adds y_smooth by the most likely sequence of true labels of each run; emission[true][predicted] is what a label says, unless the segments have log_proba
    (an array: the classifier's log posterior of each class), which then says it.

    A run is decoded in blocks of block_rows segments. Where it has more than one, each block's matrix of best scores comes first; along
    a run's matrices goes the scan that finds the best path's states at the blocks' ends, between which each block is then decoded apart. Paths of exactly equal
    scores may differ from those of a decoding in one piece, by rounding."""
    posterior = "log_proba" in segments.columns
    if emission is None and not posterior:
        raise ValueError("decoding needs an emission table, or log_proba of each segment")
    log_e = None if posterior else np.log(np.clip(np.asarray(emission, float), 1e-9, None))
    names = segments.columns
    said = "log_proba" if posterior else "y"
    kinds = dict(segments.dtypes)

    def evidence(column: pa.ChunkedArray) -> np.ndarray:
        if posterior:
            flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
            return flat.reshape(len(column), -1)
        return log_e[:, column.to_numpy()].T

    rows = placed(segments, block_s).withColumn("_part", F.floor(F.col("place") / block_rows).cast("long"))
    keys = ["user_id", "run", "_part"]
    key_kinds = f"user_id {kinds['user_id']}, run {kinds['run']}, _part long"

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin in stretches(batches, 3):
            parts = np.split(evidence(t.column(3)), begin[1:])
            first = (t.column(2).to_numpy()[begin] == 0).tolist()
            made = [max_plus(o, p_stay, f).tobytes() for o, f in zip(parts, first, strict=True)]
            at = pa.array(begin)
            yield pa.RecordBatch.from_arrays([*(t.column(i).combine_chunks().take(at) for i in range(3)), pa.array(made, pa.binary())], [*keys, "m"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin in stretches(batches, 2):
            made = t.column(3).to_pylist()
            entry, exit_ = [], []
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), t.num_rows], strict=True):
                c = len(made[lo]) // 8
                ends = ends_of_blocks([np.frombuffer(m, float).reshape(-1, c) for m in made[lo:hi]])
                entry += [None, *ends[:-1]]
                exit_ += ends
            yield pa.RecordBatch.from_arrays([*(t.column(i).combine_chunks() for i in range(3)), pa.array(entry, pa.int32()), pa.array(exit_, pa.int32())], [*keys, "_entry", "_exit"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin in stretches(batches, 3):
            at = pa.array(begin)
            entry, exit_ = (t.column(c).combine_chunks().take(at).to_pylist() for c in ("_entry", "_exit"))
            parts = np.split(evidence(t.column(said)), begin[1:])
            paths = [viterbi(o, p_stay, a, b) for o, a, b in zip(parts, entry, exit_, strict=True)]
            out = t.drop_columns(["_part", "_entry", "_exit"]).append_column("y_smooth", pa.array(np.concatenate(paths), pa.int32()))
            yield from out.combine_chunks().to_batches()

    long_runs = rows.where(F.col("place") == block_rows).select("user_id", "run")
    blocks = rows.select(*keys, said, "t_start", "ord").join(long_runs, ["user_id", "run"], "left_semi")
    blocks = blocks.repartition(*keys).sortWithinPartitions(*keys, "t_start", "ord").select(*keys, said).mapInArrow(matrices, f"{key_kinds}, m binary")
    ends = blocks.repartition("user_id", "run").sortWithinPartitions(*keys).mapInArrow(scan, f"{key_kinds}, _entry int, _exit int")
    rest = [c for c in names if c not in keys]
    both = rows.join(ends, keys, "left").select(*keys, *rest, "_entry", "_exit").repartition(*keys).sortWithinPartitions(*keys, "t_start", "ord")
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in ("user_id", "run", *rest))
    return both.mapInArrow(decode, f"{schema}, y_smooth int").select(*names, "y_smooth")


def smooth(segments: DataFrame, config: TimelineConfig = TimelineConfig(), emission: list[list[float]] | None = None) -> DataFrame:
    """Adds run and y_smooth as the configuration says: mode, viterbi (from log_proba where the segments have it) or none."""
    if config.smoothing == "none":
        return segments.withColumn("y_smooth", F.col("y"))
    rows = smoothing_runs(segments, config.max_gap_s)
    if config.smoothing == "viterbi":
        return viterbi_smooth(rows, emission, config.p_stay)
    return mode_smooth(rows, config.mode_k)


def islands(segments: DataFrame, max_gap_s: float, label: str = "y_smooth", block_s: float = BLOCK_S) -> DataFrame:
    """Adds _island: a new one begins where the label changes, or where a segment starts more than max_gap_s after the one before ended."""
    begins = lambda before, own: (own(label) != before(label)) | (own("t_start") - before("t_end") > max_gap_s)
    return numbered(segments, "_island", [label, "t_start", "t_end"], begins, None, block_s)


def merge_intervals(segments: DataFrame, max_gap_s: float, label: str = "y_smooth", min_interval_s: float = 0.0, seconds: float = SECONDS, block_s: float = BLOCK_S) -> DataFrame:
    """user_id, label, activity, start_s, end_s, duration_s, observed_s, n_segments, ord of the first segment (and mean confidence if there is one).

    A new interval begins where the label changes, or where a segment starts more than max_gap_s after the one
    before ended. Intervals shorter than min_interval_s are dropped, and their neighbours are not joined."""
    marked = islands(segments, max_gap_s, label, block_s)
    more = [F.avg("confidence").alias("confidence")] if "confidence" in segments.columns else []
    out = marked.groupBy("user_id", "_island").agg(F.min(label).cast("int").alias("label"), F.min("t_start").alias("start_s"), F.max("t_end").alias("end_s"), F.count("*").alias("n_segments"), F.min_by("ord", F.struct("t_start", "ord")).alias("ord"), *more)
    out = out.withColumn("duration_s", F.col("end_s") - F.col("start_s")).withColumn("observed_s", F.col("n_segments") * seconds).withColumn("activity", activity_name(F.col("label")))
    return out.where(F.col("duration_s") >= min_interval_s).select("user_id", "label", "activity", "start_s", "end_s", "duration_s", "observed_s", "n_segments", "ord", *[F.col("confidence") for _ in more])


def totals(intervals: DataFrame) -> DataFrame:
    """total_s, observed_s, n_intervals and first_start of each user's activities."""
    return intervals.groupBy("user_id", "activity").agg(F.round(F.sum("duration_s"), 1).alias("total_s"), F.sum("observed_s").alias("observed_s"), F.count("*").alias("n_intervals"), F.min("start_s").alias("first_start"))


def recording_span(segments: DataFrame) -> DataFrame:
    return segments.groupBy("user_id").agg((F.max("t_end") - F.min("t_start")).alias("span_s"), F.count("*").alias("n_segments"))


def transitions(intervals: DataFrame) -> DataFrame:
    """from_activity, to_activity, at_s: the start of each interval but the user's first."""
    w = Window.partitionBy("user_id").orderBy(*in_time(intervals))
    return intervals.select("user_id", F.col("activity").alias("from_activity"), F.lead("activity").over(w).alias("to_activity"), F.lead("start_s").over(w).alias("at_s")).where("at_s is not null")


def coalesce_intervals(intervals: DataFrame, max_gap_s: float) -> DataFrame:
    """Join neighbours of one activity that lie max_gap_s or less apart; the duration then covers the gap.

    evidence_of says whose evidence the whole has, by the start of the interval that was measured: a part's own (its start, unless a column evidence_of says
    otherwise), if the part is longer than all before it together and has any."""
    order = in_time(intervals)
    w = Window.partitionBy("user_id").orderBy(*order)
    if "evidence_of" not in intervals.columns:
        intervals = intervals.withColumn("evidence_of", F.col("start_s"))
    new = (F.col("activity") != F.lag("activity").over(w)) | (F.col("start_s") - F.lag("end_s").over(w) > max_gap_s)
    marked = intervals.withColumn("_new", F.coalesce(new.cast("int"), F.lit(0))).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("user_id", "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.max("end_s").over(before) - F.min("start_s").over(before)
    marked = marked.withColumn("_own", so_far.isNull() | ((F.col("end_s") - F.col("start_s") > so_far) & F.col("evidence_of").isNotNull()))
    out = marked.groupBy("user_id", "_island").agg(
        F.min_by("label", "start_s").alias("label"), F.min("activity").alias("activity"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sum("observed_s").alias("observed_s"), F.sum("n_segments").alias("n_segments"),
        F.max_by("evidence_of", F.when(F.col("_own"), F.struct(*order))).alias("evidence_of"),
    )
    return out.select("user_id", "label", "activity", "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "observed_s", "n_segments", "evidence_of")


def absorb(label: list, start: list[float], end: list[float], observed: list[float], n_segments: list[int], evidence: list, min_episode_s: float, max_gap_s: float) -> list[int]:
    """Clean one chain of intervals in which no gap is longer than max_gap_s, in place; returns the places of those that are left.

    The shortest interval under min_episode_s (the earliest of equals) takes the label of its longer neighbour
    (the earlier of equals) within max_gap_s and is joined to what it then touches; without a neighbour it goes.
    Of two that are joined the first's evidence stays, unless the second is longer and has any; what changes its label loses its own.
    A heap of short intervals and links between neighbours make that n log n."""
    import heapq

    n = len(label)
    before, after, alive, stamp = [i - 1 for i in range(n)], [*range(1, n), -1], [True] * n, [0] * n
    length = [e - s for s, e in zip(start, end, strict=True)]
    near = lambda a, b: a >= 0 and b >= 0 and start[b] - end[a] <= max_gap_s
    heap: list[tuple[float, float, int, int]] = []

    def push(i: int) -> None:
        if length[i] < min_episode_s:
            heapq.heappush(heap, (length[i], start[i], i, stamp[i]))

    def unlink(i: int) -> None:
        alive[i] = False
        a, b = before[i], after[i]
        if a >= 0:
            after[a] = b
        if b >= 0:
            before[b] = a

    def join(a: int, b: int) -> None:
        if length[b] > length[a] and evidence[b] is not None:
            evidence[a] = evidence[b]
        end[a] = max(end[a], end[b])
        length[a] = end[a] - start[a]
        observed[a] += observed[b]
        n_segments[a] += n_segments[b]
        stamp[a] += 1
        unlink(b)

    def settle(i: int) -> None:
        """Join i with equal neighbours that are near; what is left is measured anew."""
        while near(before[i], i) and label[before[i]] == label[i]:
            i = before[i]
            join(i, after[i])
        while near(i, after[i]) and label[after[i]] == label[i]:
            join(i, after[i])
        push(i)

    i = 0 if n else -1
    while i >= 0:
        if near(i, after[i]) and label[after[i]] == label[i]:
            join(i, after[i])
        else:
            i = after[i]
    for i in range(n):
        if alive[i]:
            push(i)
    while heap:
        _, _, i, s = heapq.heappop(heap)
        if not alive[i] or s != stamp[i]:
            continue
        sides = [j for j in ((before[i],) if near(before[i], i) else ()) + ((after[i],) if near(i, after[i]) else ())]
        if not sides:
            unlink(i)
            continue
        label[i], evidence[i] = label[max(sides, key=length.__getitem__)], None
        stamp[i] += 1
        settle(i)
    return [i for i in range(n) if alive[i]]


CLEANED = "user_id long, label int, activity string, start_s double, end_s double, duration_s double, observed_s double, n_segments long"
#: What cleaning changes of it.
ABSORBED = "user_id long, label int, activity string, start_s double, end_s double, observed_s double, n_segments long, evidence_of double"


def clean_timeline(intervals: DataFrame, min_episode_s: float = 60.0, max_gap_s: float = 120.0) -> DataFrame:
    """Absorb intervals too short to be real into their neighbours. evidence_of says, by its start, which interval's evidence each one has, all of whose
    segments have its label; null if it has none.

    Intervals more than max_gap_s apart never touch each other, so chains of near intervals, not users, are dealt out and cleaned, many in
    one call. Where a chain begins is found by a window over the user's intervals, which a task sorts with spilling."""
    order = in_time(intervals)
    w = Window.partitionBy("user_id").orderBy(*order)
    reach = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    chained = intervals.withColumn("_new", F.coalesce((F.col("start_s") - reach > max_gap_s).cast("int"), F.lit(0))).withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    names = [x.split()[0] for x in ABSORBED.split(", ")]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin in stretches(batches, 2):
            user, cols = t.column(0).to_numpy(), [t.column(n).to_pylist() for n in names[1:]]
            cols[:2] = [list(zip(*cols[:2], strict=True))]  # label and activity are one
            out: list[list] = [[] for _ in names[1:]]
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), t.num_rows], strict=True):
                chain = [c[lo:hi] for c in cols]
                stay = absorb(*chain, min_episode_s, max_gap_s)
                out[0] += [user[lo]] * len(stay)
                for to, values in zip(out[1:], chain, strict=True):
                    to += [values[i] for i in stay]
            label, activity = zip(*out[1], strict=True) if out[1] else ((), ())
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([out[0], label, activity, *out[2:]], kinds, strict=True)], names)

    rows = chained.select(F.col("user_id").cast("long").alias("user_id"), "_chain", F.col("label").cast("int").alias("label"), "activity", "start_s", "end_s", F.col("observed_s").cast("double").alias("observed_s"), F.col("n_segments").cast("long").alias("n_segments"), (F.col("evidence_of") if "evidence_of" in intervals.columns else F.col("start_s")).cast("double").alias("evidence_of"), F.col(order[1]).alias("_next"))
    done = rows.repartition("user_id", "_chain").sortWithinPartitions("user_id", "_chain", "start_s", "_next").drop("_next").mapInArrow(clean, ABSORBED)
    return done.select("user_id", "label", "activity", "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "observed_s", "n_segments", "evidence_of")


def with_evidence(intervals: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds evidence, a struct of what was measured, to intervals with evidence_of; null where nothing was. `evidence`: user_id, label, start_s of the measured interval, and the measurements."""
    keys = ("user_id", "label", "start_s")
    e = evidence.select("user_id", F.col("label").cast("int").alias("label"), F.col("start_s").cast("double").alias("evidence_of"), F.struct(*[c for c in evidence.columns if c not in keys]).alias("evidence"))
    return intervals.join(e, ["user_id", "label", "evidence_of"], "left")


def ranked_spans(intervals: DataFrame, top: int = 3) -> DataFrame:
    """Each user's `top` longest intervals of each activity (the earlier of equals), with their rank."""
    w = Window.partitionBy("user_id", "activity").orderBy(F.desc("duration_s"), "start_s")
    return intervals.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def onsets(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("user_id", "activity").agg(F.min("start_s").alias("onset_s"), F.min_by("end_s", F.struct(*in_time(intervals))).alias("end_s"))


def beside(probes: DataFrame, intervals: DataFrame) -> DataFrame:
    """probes (user_id, time_s, ...) with _next, the first interval of the user that doesn't end before time_s, and _last, the last one that does:
    structs of start_s, end_s, activity, or null.

    Both are laid on one line of time by their ends, and each probe looks ahead and back along it, so there is no join of probes with intervals.
    Intervals of a user must end in the order in which they start, as those of a timeline do. Of those that start and end at one moment the earlier (see in_time) counts."""
    columns = probes.columns
    iv = F.struct("start_s", "end_s", "activity")
    kind = "struct<start_s:double,end_s:double,activity:string>"
    next_to = in_time(intervals)[1]
    place = dict(intervals.dtypes)[next_to]
    own = probes.withColumns({"_at": F.col("time_s").cast("double"), "_probe": F.lit(0), "_s": F.lit(None).cast("double"), "_o": F.lit(None).cast(place), "_iv": F.lit(None).cast(kind)})
    kinds = dict(probes.dtypes)
    ends = intervals.select(*[F.col(c) if c == "user_id" else F.lit(None).cast(kinds[c]).alias(c) for c in columns], F.col("end_s").cast("double").alias("_at"), F.lit(1).alias("_probe"), F.col("start_s").cast("double").alias("_s"), F.col(next_to).alias("_o"), iv.cast(kind).alias("_iv"))
    # of equal ends the earliest start is nearest to the probe on either side
    first_last = (F.desc("_s"), F.desc("_o"))
    back = Window.partitionBy("user_id").orderBy("_at", "_probe", *first_last).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("user_id").orderBy(F.desc("_at"), F.desc("_probe"), *first_last).rowsBetween(Window.unboundedPreceding, -1)
    line = own.unionByName(ends).withColumn("_last", F.last("_iv", True).over(back)).withColumn("_next", F.last("_iv", True).over(ahead))
    return line.where("_probe = 0").select(*columns, "_last", "_next")


def at_time(probes: DataFrame, intervals: DataFrame) -> DataFrame:
    """probes (id, user_id, time_s) with the activity of the first interval that holds time_s, both ends included; null without one."""
    held = F.when(F.col("_next.start_s") <= F.col("time_s"), F.col("_next"))
    return beside(probes, intervals).withColumn("_h", held).select(*probes.columns, F.col("_h.activity").alias("activity"), F.col("_h.start_s").alias("start_s"), F.col("_h.end_s").alias("end_s"))


def nearest_interval(probes: DataFrame, intervals: DataFrame) -> DataFrame:
    """As at_time, but without a holding interval the one with the nearest end counts, the earlier of equals; a user without any has no row."""
    ahead, back = F.greatest(F.lit(0.0), F.col("_next.start_s") - F.col("time_s")), F.col("time_s") - F.col("_last.end_s")
    near = F.when(F.col("_next").isNull() | (F.col("_last").isNotNull() & (ahead > 0) & (back <= ahead)), F.col("_last")).otherwise(F.col("_next"))
    found = beside(probes, intervals).where("_next is not null or _last is not null").withColumn("_h", near)
    return found.select(*probes.columns, F.col("_h.activity").alias("activity"), F.col("_h.start_s").alias("start_s"), F.col("_h.end_s").alias("end_s"))


def nearest(probes: DataFrame, intervals: DataFrame) -> DataFrame:
    return nearest_interval(probes, intervals).select(*probes.columns, "activity")


def held_segments(intervals: DataFrame, segments: DataFrame, width_s: float) -> DataFrame:
    """intervals (user_id, start_s, end_s, ...) joined with the segments (user_id, t_start, t_end, ...) that lie within them. Both meet by user and by
    the stretch of width_s seconds that the segment starts in; an interval is in each stretch that it touches."""
    bins = lambda c: F.floor(F.col(c) / width_s).cast("long")
    iv = intervals.withColumn("_bin", F.explode(F.sequence(bins("start_s"), bins("end_s"))))
    met = iv.join(segments.withColumn("_bin", bins("t_start")), ["user_id", "_bin"])
    return met.where("t_start >= start_s and t_end <= end_s").drop("_bin")


def build(segments: DataFrame, config: TimelineConfig = TimelineConfig(), emission: list[list[float]] | None = None) -> DataFrame:
    """Intervals of labelled segments (user_id, window, seg_index, ord, y)."""
    return merge_intervals(smooth(time_base(segments), config, emission), config.max_gap_s, min_interval_s=config.min_interval_s)


def timeline_documents(intervals: DataFrame) -> DataFrame:
    """One JSON document for each user: intervals, totals, counts and transitions. A user's intervals are hundreds; the
    relational tables, not this, are what queries read."""
    t = totals(intervals).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("activity", "total_s"))).alias("totals_s"), F.map_from_entries(F.collect_list(F.struct("activity", "n_intervals"))).alias("counts"))
    i = intervals.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("start_s", "end_s", "activity", "label", "duration_s", "observed_s", "n_segments"))).alias("intervals"))
    c = transitions(intervals).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at_s", "from_activity", "to_activity"))).alias("transitions"))
    return i.join(t, "user_id").join(c, "user_id", "left").select("user_id", F.to_json(F.struct("user_id", "intervals", "totals_s", "counts", F.coalesce("transitions", F.array().cast("array<struct<at_s:double,from_activity:string,to_activity:string>>")).alias("transitions"))).alias("document"))
