"""P6 - filling containers of fixed capacity with texts measured in tokens.

The plan of a capacity is made from the histogram of piece lengths, one task
for each capacity; it has one entry per length up to the capacity, whatever the
number of documents.  Patterns of up to three length classes that fill a
container are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded, and what is left is packed into the
gaps and into new containers, longest first into the tightest place.  The plan
is a list of segments "of length l, ranks a..b go to containers c.."; every
piece finds its place from its length and its rank among the pieces of that
length, which is computed in shards so that no length, however common, is one
task's work.  The full containers cut from a long text take no part in the
plan: they are numbered by a running sum over texts, not over pieces.

Defined results: null and empty texts have no tokens and get no container; a
text longer than the capacity is cut into full containers and one rest, all
others stay whole; repeated rows are items of their own; a capacity below one
token is refused; an empty table gives an empty plan.
"""

from __future__ import annotations

import base64
import bisect
import os
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .sources import map_rows, spread

#: folder of the public tokenizer files
TOKENIZERS = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: length classes of the fit; a class is ``capacity / CLASSES`` tokens wide
CLASSES = 512
#: fewest shards in which the pieces of one length are ranked, and the texts for which one more is added
SHARDS = 64
SHARD_TEXTS = 200_000

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The byte-level tokenizer in ``path``, loaded once per process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens) of the documents that have any token."""
    path = os.path.join(tokenizers, TOKENIZER)

    def count(cols: dict) -> dict:
        enc = encoder(path)
        return {"doc_id": cols["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) for t in cols["text"]]}

    src = documents.where(F.length("text") > 0).select("doc_id", "text")
    return map_rows(spread(src, "doc_id"), count, "doc_id bigint, n_tokens int")


# ------------------------------------------------------------------ the plan
def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares of a dense matrix."""
    return active_set(a.shape[1], lambda j: a[:, j], lambda r: a.T @ r, b)


def active_set(n: int, column: Callable, transpose: Callable, b: np.ndarray, rounds: int = 5000) -> np.ndarray:
    """Non-negative least squares by the method of Lawson and Hanson.

    The matrix is given by its columns and by its transpose times a vector, so
    a sparse one is never filled.  The normal equations of the active columns
    are kept and extended by a column at a time; a singular system falls back
    to a full solve.
    """
    x = np.zeros(n)
    active: list[int] = []
    matrix = np.zeros((len(b), 0))
    gram, right = np.zeros((0, 0)), np.zeros(0)
    gradient = transpose(b)
    tolerance = 1e-9 * max(1.0, float(np.abs(gradient).max(initial=0.0)))
    for _ in range(rounds):
        gradient[active] = -np.inf
        j = int(gradient.argmax()) if n else 0
        if not n or gradient[j] <= tolerance:
            break
        new = column(j)
        cross = matrix.T @ new
        gram = np.block([[gram, cross[:, None]], [cross[None, :], np.array([[new @ new]])]])
        matrix = np.column_stack([matrix, new])
        right = np.append(right, new @ b)
        active.append(j)
        while active:
            try:
                s = np.linalg.solve(gram, right)
                exact = np.isfinite(s).all() and np.abs(gram @ s - right).max() <= 1e-6 * max(1.0, float(np.abs(right).max()))
            except np.linalg.LinAlgError:
                exact = False
            if not exact:
                s = np.linalg.lstsq(matrix, b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[active] = s
                break
            old = x[active]
            down = s <= 0
            step = (old[down] / np.maximum(old[down] - s[down], 1e-300)).min()
            moved = old + step * (s - old)
            keep = moved > 1e-12
            if keep.all():
                keep = ~down
            x[:] = 0
            x[np.array(active)[keep]] = moved[keep]
            active = [i for i, k in zip(active, keep) if k]
            gram, right, matrix = gram[np.ix_(keep, keep)], right[keep], matrix[:, keep]
        gradient = transpose(b - matrix @ x[active])
    else:
        warnings.warn(f"the fit stopped after {rounds} rounds; what it leaves is packed as residuals", stacklevel=2)
    return x


def patterns(classes: int) -> list[tuple[int, ...]]:
    """Every multiset of one to three classes that fills a container of ``classes`` exactly."""
    out: list[tuple[int, ...]] = [(classes,)]
    out += [(i, classes - i) for i in range(1, classes // 2 + 1)]
    for i in range(1, classes // 3 + 1):
        out += [(i, j, classes - i - j) for j in range(i, (classes - i) // 2 + 1)]
    return out


class Plan:
    """Groups of equal containers: ``count`` containers that hold ``pieces`` (length -> how many) each."""

    def __init__(self, capacity: int, histogram: np.ndarray):
        self.capacity = capacity
        self.left = histogram.astype(np.int64).copy()
        self.groups: list[list] = []  # [count, {length: m}, free]
        self._fit()
        self._residual()

    def _fit(self) -> None:
        width = -(-self.capacity // CLASSES)
        classes = self.capacity // width
        lengths = np.flatnonzero(self.left)
        if not len(lengths):
            return
        cls = -(-lengths // width)
        ok = cls <= classes  # lengths beyond the last whole class are left to the second step
        have = np.bincount(cls[ok], weights=self.left[lengths[ok]], minlength=classes + 1)[: classes + 1]
        pats = patterns(classes)
        # patterns of classes that occur; the others could only take from nothing
        pats = [p for p in pats if all(have[c] > 0 for c in p)]
        if not pats:
            return
        # short pieces find a gap easily, so missing them costs less
        weight = np.where(np.arange(classes + 1) <= classes // 16, 0.1, 1.0)
        weight[0] = 0.0  # fills up the rows of patterns with fewer than three classes
        rows = np.array([(*p, *[0] * (3 - len(p))) for p in pats])

        def column(j: int) -> np.ndarray:
            return np.bincount(rows[j], weights=weight[rows[j]], minlength=classes + 1)

        fitted = active_set(len(pats), column, lambda r: (weight * r)[rows].sum(axis=1), have * weight)
        repeat = np.rint(fitted).astype(np.int64)
        queue = {int(c): [[int(n), int(self.left[n])] for n in lengths[ok][cls[ok] == c][::-1]] for c in np.unique(cls[ok])}
        available = {c: sum(n for _, n in q) for c, q in queue.items()}
        for k in np.argsort(-np.array([max(p) for p in pats]), kind="stable"):
            p = pats[k]
            r = int(min([repeat[k], *(available[c] // p.count(c) for c in set(p))]))
            while r > 0:
                heads = {}
                take = r
                for c in set(p):
                    n, m = queue[c][0]
                    if m < p.count(c):  # fewer than one container needs: join with the next length
                        heads = None
                        break
                    heads[c] = n
                    take = min(take, m // p.count(c))
                if heads is None:
                    take, pieces = 1, {}
                    for c in p:
                        while queue[c][0][1] == 0:
                            queue[c].pop(0)
                        queue[c][0][1] -= 1
                        n = queue[c][0][0]
                        pieces[n] = pieces.get(n, 0) + 1
                else:
                    pieces = {}
                    for c in p:
                        pieces[heads[c]] = pieces.get(heads[c], 0) + 1
                        queue[c][0][1] -= take
                for c in set(p):
                    available[c] -= take * p.count(c)
                    while queue[c] and queue[c][0][1] == 0:
                        queue[c].pop(0)
                for n, m in pieces.items():
                    self.left[n] -= take * m
                self.groups.append([take, pieces, self.capacity - sum(n * m for n, m in pieces.items())])
                r -= take

    def _residual(self) -> None:
        by_free: dict[int, list] = {}
        keys: list[int] = []

        def put(group: list) -> None:
            free = group[2]
            if free not in by_free:
                by_free[free] = []
                bisect.insort(keys, free)
            by_free[free].append(group)

        groups, self.groups = self.groups, []
        for g in groups:
            put(g)
        for length in np.flatnonzero(self.left)[::-1].tolist():
            n = int(self.left[length])
            while n > 0:
                at = bisect.bisect_left(keys, length)
                if at == len(keys):
                    each = self.capacity // length
                    full, rest = divmod(n, each)
                    if full:
                        put([full, {length: each}, self.capacity - each * length])
                    if rest:
                        put([1, {length: rest}, self.capacity - rest * length])
                    break
                free = keys[at]
                group = by_free[free].pop()
                if not by_free[free]:
                    del by_free[free]
                    keys.pop(at)
                each = min(free // length, n)
                take = min(group[0], n // each)
                if take < group[0]:
                    put([group[0] - take, group[1], free])
                put([take, {**group[1], length: group[1].get(length, 0) + each}, free - each * length])
                n -= take * each
            self.left[length] = 0
        self.groups = [g for free in keys for g in by_free[free]]

    @property
    def containers(self) -> int:
        return sum(g[0] for g in self.groups)

    def segments(self) -> tuple[np.ndarray, ...]:
        """Sorted arrays (length, first rank, first container, pieces per container)."""
        seen: dict[int, int] = {}
        rows, base = [], 0
        for count, pieces, _ in self.groups:
            for n, m in pieces.items():
                start = seen.get(n, 0)
                rows.append((n, start, base, m))
                seen[n] = start + count * m
            base += count
        rows.sort()
        out = np.array(rows, np.int64).reshape(-1, 4)
        return out[:, 0], out[:, 1], out[:, 2], out[:, 3]


_RANK = 1 << 40


def _locate(plans: dict[int, tuple[np.ndarray, ...]]):
    """A function from (target, length, rank) columns to containers."""
    keyed = {t: (n * _RANK + s, s, b, m) for t, (n, s, b, m) in plans.items()}

    def place(target: np.ndarray, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(target), np.int64)
        for t in np.unique(target):
            rows = target == t
            keys, start, base, each = keyed[int(t)]
            k = np.searchsorted(keys, length[rows] * _RANK + rank[rows], side="right") - 1
            out[rows] = base[k] + (rank[rows] - start[k]) // each[k]
        return out

    return place


_SEGMENTS = "target_id int, capacity int, containers long, length long, start long, base long, each long"


def _fit(rows):
    """The segments of one capacity from its histogram (``length``, ``n``)."""
    import pandas as pd

    capacity = int(rows["capacity"].iloc[0])
    h = np.zeros(capacity + 1, np.int64)
    h[rows["length"].to_numpy()] = rows["n"].to_numpy()
    plan = Plan(capacity, h)
    length, start, base, each = plan.segments()
    out = {"length": length, "start": start, "base": base, "each": each}
    return pd.DataFrame({"target_id": rows["target_id"].iloc[0], "capacity": capacity, "containers": plan.containers, **out}, index=range(len(length)))


def pack(documents: DataFrame, targets: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(target_id, container_id, doc_id, piece, token_start, n_tokens): where every text goes.

    ``targets`` is a table of a few capacities; it and the segments of each
    plan are all that the driver sees.
    """
    sized = cut(token_counts(documents, tokenizers).where("n_tokens > 0"))
    wanted = [(r["target_id"], r["capacity_tokens"]) for r in targets.select("target_id", "capacity_tokens").distinct().collect()]
    if any(c is None or c < 1 for _, c in wanted):
        raise ValueError("a capacity is below one token")
    spark = documents.sparkSession
    shards = max(SHARDS, -(-sized.count() // SHARD_TEXTS))
    caps = F.array(*[F.struct(F.lit(int(t)).alias("target_id"), F.lit(int(c)).alias("capacity")) for t, c in wanted])
    if not wanted:
        caps = F.lit(None).cast("array<struct<target_id:int,capacity:int>>")
    texts = (
        sized.select("doc_id", "n_tokens", F.inline(caps))
        .withColumn("full", F.expr("n_tokens div capacity").cast("int"))
        .withColumn("length", (F.col("n_tokens") - F.col("full") * F.col("capacity")).cast("int"))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)).cast("int"))
    )
    # every text, or what is left of one beyond its full containers, by the plan
    rests = texts.where("length > 0").select("target_id", "capacity", "length", "shard", "doc_id", F.col("full").alias("piece"))
    counts = cut(rests.groupBy("target_id", "capacity", "length", "shard").agg(F.count("*").alias("n")))
    histogram = counts.groupBy("target_id", "capacity", "length").agg(F.sum("n").alias("n"))
    # a number of its own keeps the few keys apart: adaptive execution would put the small histograms into one task
    apart = histogram.repartition(8 * max(len(wanted), 1), "target_id")
    segments = apart.groupBy("target_id").applyInPandas(_fit, _SEGMENTS).toPandas()
    plans = {}
    planned = {int(t): 0 for t, _ in wanted}
    for t, rows in segments.groupby("target_id"):
        plans[int(t)] = tuple(rows[k].to_numpy() for k in ("length", "start", "base", "each"))
        planned[int(t)] = int(rows["containers"].iloc[0])
    shared = spark.sparkContext.broadcast(plans)
    ahead = Window.partitionBy("target_id", "length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("target_id", "length", "shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("target_id", "length", "shard").orderBy("doc_id", "piece")
    ranked = rests.withColumn("r", F.row_number().over(own)).join(offsets, ["target_id", "length", "shard"])
    start = (F.col("piece") * F.col("capacity")).cast("int").alias("token_start")
    ranked = ranked.select("target_id", "doc_id", "piece", start, "length", (F.col("r") - 1 + F.col("ahead")).alias("rank"))

    def assign(cols: dict) -> dict:
        place = _locate(shared.value)
        containers = place(np.array(cols["target_id"], np.int64), np.array(cols["length"], np.int64), np.array(cols["rank"], np.int64))
        return {
            "target_id": cols["target_id"],
            "container_id": containers.tolist(),
            "doc_id": cols["doc_id"],
            "piece": cols["piece"],
            "token_start": cols["token_start"],
            "n_tokens": cols["length"],
        }

    placed = map_rows(ranked, assign, "target_id int, container_id bigint, doc_id bigint, piece int, token_start int, n_tokens int")
    # full containers: numbered behind the planned ones
    long = texts.where("full > 0").select("target_id", "capacity", "shard", "doc_id", "n_tokens", "full")
    before = Window.partitionBy("target_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = long.groupBy("target_id", "shard").agg(F.sum("full").alias("n")).select("target_id", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("target_id", "shard").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    numbered = long.withColumn("r", F.coalesce(F.sum("full").over(inside), F.lit(0))).join(sums, ["target_id", "shard"])
    base = F.element_at(F.create_map(*[F.lit(x) for pair in planned.items() for x in pair]), F.col("target_id")) if planned else F.lit(0)
    full = numbered.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("full") - 1))).select(
        "target_id",
        (base + F.col("ahead") + F.col("r") + F.col("piece")).cast("bigint").alias("container_id"),
        "doc_id",
        F.col("piece").cast("int").alias("piece"),
        start,
        F.col("capacity").cast("int").alias("n_tokens"),
    )
    return placed.unionByName(full)


def fill(documents: DataFrame, targets: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(target_id, capacity_tokens, containers, items, tokens, unused_share): how full the containers are."""
    packed = pack(documents, targets, tokenizers)
    return (
        packed.groupBy("target_id", "container_id")
        .agg(F.sum("n_tokens").alias("t"), F.count("*").alias("i"))
        .groupBy("target_id")
        .agg(F.count("*").alias("containers"), F.sum("i").alias("items"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
        .join(F.broadcast(targets.select("target_id", "capacity_tokens").distinct()), "target_id")
        .select(
            "target_id", "capacity_tokens", "containers", "items", "tokens", "fullest",
            F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("unused_share"),
        )
    )
