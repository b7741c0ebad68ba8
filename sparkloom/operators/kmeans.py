"""K-means with far-point seeding on ``(id, x)`` tables.

A model is a list of k centroids of d numbers on the driver. Its size follows the
parameters k and d, not the data. Rows are never collected.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import vectors as vx
from sparkloom.functions.distance import as_matrix, closest_index, closest_margin, cluster_sums, nearest, totals
from sparkloom.functions.uniform import draw_key
from sparkloom.session import estimated_bytes, materialise

Centroids = list[list[float]]

SPLIT_BYTES = 128 << 20
TOLERANCE = 1e-9  # of a centroid's largest number; sums of doubles depend on the order of rows
CARRY = 8  # seeds between two writes of the running distances
PACKED_BYTES = 32 << 20  # of a row group of packed vectors
PACKED_NUMBERS = 1 << 15  # in a row of packed vectors
COLLECTED_NUMBERS = 1 << 22  # numbers of all tasks' sums that meet on the driver, 32 MB
MEMORY = 8  # earlier states of a model that a new one is compared with
MARGINS = -1  # in place of a cluster: numbers of rows by margin
OCTAVE, DEPTH, BINS = 4, 44, 256  # bins of margins, from 2^-44 of a model's largest number upwards
NARROW_NUMBERS = 1 << 23  # of the rows of a model that go on alone, 64 MB
MOVED_NUMBERS = 1 << 25  # of such rows of all models, 256 MB
CHUNK_NUMBERS = 1 << 18  # of vectors that are compared with models at a time
REACH = 64  # ways of the last round that centroids may go in rounds over a part of the rows
LEAST_REACH = 3  # below so many ways all rows are read instead


def stored_points(points: DataFrame) -> DataFrame:
    """``(id, x)`` written once for the many passes that follow.

    Inputs too small to have a split per core are spread out first; the rows stay the same.
    """
    points = points.select("id", "x")
    cores = points.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(points) < cores * SPLIT_BYTES:
        points = points.repartition(cores, "id")
    return materialise(points, "points")


def far_point_seeds(points: DataFrame, k: int, seed: int = 42) -> Centroids:
    """First seed: the id with the smallest draw. Then, k − 1 times, the point with the
    largest sum of distances to the seeds so far; points equal to a seed are skipped
    and ties take the lowest id. The seeds for a smaller k are a prefix.

    The sum and the smallest distance so far are stored with the points every ``CARRY`` seeds,
    so a pass measures at most that many distances per row, however many seeds there are.
    """
    first = points.agg(F.min_by("x", F.struct(draw_key(seed, F.col("id")), F.col("id"))).alias("x"))
    seeds = [list(first.first()["x"])]
    if k == 1:
        return seeds
    carried = materialise(points.select("id", "x").mapInArrow(_spread_rows, _spread_schema(points)), "spread")
    stored = 0  # seeds whose distances are in the carried columns
    while len(seeds) < k:
        fresh = seeds[stored:]
        if len(fresh) == CARRY:
            carried = materialise(_carried(carried, fresh), "spread", **{"parquet.block.size": PACKED_BYTES})
            stored, fresh = len(seeds), []
        pick = _lowest(_farthest(carried, fresh, points).toArrow().to_batches())  # one row per task at most
        if pick is None:
            raise ValueError(f"fewer than {k} distinct points")
        seeds.append(pick.column("x")[0].as_py())
    return seeds


def _spread_schema(points: DataFrame) -> str:
    return f"n bigint, id array<{dict(points.dtypes)['id']}>, x binary, total binary, near binary"


def _spread_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(id, x)`` as rows ``(n, id, x, total, near)`` of n vectors each, before the first seed."""
    for batch in batches:
        if batch.num_rows:
            x = as_matrix(batch.column("x")).astype("<f8", copy=False)
            step = max(1, PACKED_NUMBERS // max(1, x.shape[1]))
            for at in range(0, len(x), step):
                part = x[at : at + step]
                yield _spread_row(batch.column("id").slice(at, step), part, np.zeros(len(part)), np.full(len(part), np.inf))


def _spread_row(ids: pa.Array, x: np.ndarray, total: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    cells = [pa.array([c.tobytes()], pa.binary()) for c in (x, total, near)]
    return pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids), *cells], ["n", "id", "x", "total", "near"])


def _spread_parts(batches: Iterator[pa.RecordBatch], model: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors, sums and smallest distances of packed rows, those to ``model`` on top of the stored ones."""
    for batch in batches:
        for row in range(batch.num_rows):
            x, total, near = (np.frombuffer(batch.column(c)[row].as_buffer(), "<f8") for c in ("x", "total", "near"))
            x = x.reshape(len(total), -1)
            if len(model):
                total, near = totals(x, model, total, near)
            yield batch.column("id")[row].values, x, total, near


def _carried(carried: DataFrame, seeds: Centroids) -> DataFrame:
    model = np.asarray(seeds, dtype=float)

    def run(batches):
        for part in _spread_parts(batches, model):
            yield _spread_row(*part)

    return carried.mapInArrow(run, carried.schema)


def _lowest(batches: Sequence[pa.RecordBatch]) -> pa.RecordBatch | None:
    """Of rows ``(id, x, total)`` the one with the largest total, the lowest id on ties."""
    rows = pa.Table.from_batches(batches).combine_chunks() if batches else None
    if not rows:
        return None
    rows = rows.filter(pc.equal(rows["total"], pc.max(rows["total"])))
    return rows.take(pc.sort_indices(rows["id"], null_placement="at_start")[:1]).to_batches()[0]


def _farthest(carried: DataFrame, seeds: Centroids, points: DataFrame) -> DataFrame:
    """``(id, x, total)``: of each task the row that lies farthest, the lowest id on ties, unless all equal a seed."""
    model = np.asarray(seeds, dtype=float)

    def run(batches):
        best = None
        for ids, x, total, near in _spread_parts(batches, model):
            far = np.flatnonzero(near > 0)
            if len(far) and (best is None or total[far].max() >= best.column("total")[0].as_py()):
                far = far[total[far] == total[far].max()]
                rows = [ids.take(pa.array(far)), pa.array(list(x[far]), pa.list_(pa.float64())), pa.array(total[far])]
                rows = pa.RecordBatch.from_arrays(rows, ["id", "x", "total"])
                best = rows if best is None else _lowest([best, rows])
        if best is not None:
            yield _lowest([best])

    kinds = dict(points.dtypes)
    return carried.mapInArrow(run, f"id {kinds['id']}, x array<double>, total double")


def assign(points: DataFrame, centroids: Centroids) -> DataFrame:
    """Add ``cid`` and ``dist``. A narrow projection, no shuffle."""
    best = nearest(F.col("x"), centroids).alias("best")
    return points.select("*", best).select(
        *points.columns, F.col("best.cid").alias("cid"), F.col("best.dist").alias("dist")
    )


def assign_runs(points: DataFrame, models: dict[int, Centroids]) -> DataFrame:
    """Assignments of several models in one scan: one row per point and run."""
    runs = F.array(*[
        F.struct(F.lit(run).alias("run"), nearest(F.col("x"), c).alias("best"))
        for run, c in models.items()
    ])
    return points.select("id", "x", F.explode(runs).alias("r")).select(
        "id", "x", "r.run", F.col("r.best.cid").alias("cid"), F.col("r.best.dist").alias("dist")
    )


def cluster_means(assigned: DataFrame, width: int, keys: Sequence[str] = ("cid",)) -> DataFrame:
    return assigned.groupBy(*keys).agg(vx.mean_vector(F.col("x"), width).alias("c"))


def _packed(points: DataFrame) -> DataFrame:
    """The vectors as rows ``(n, x)``, n vectors at a time as the bytes of their numbers: a round's input is a copy of bytes."""

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                x = as_matrix(batch.column("x")).astype("<f8", copy=False)
                step = max(1, PACKED_NUMBERS // max(1, x.shape[1]))
                parts = [x[at : at + step] for at in range(0, len(x), step)]
                yield pa.RecordBatch.from_arrays([pa.array([len(c) for c in parts]), pa.array([c.tobytes() for c in parts], pa.binary())], ["n", "x"])

    blocks = points.select("x").mapInArrow(pack, "n bigint, x binary")
    return materialise(blocks, "blocks", **{"parquet.block.size": PACKED_BYTES})


class _Means:
    """``(run, cid, n, s, c)`` once collected: sums and new centroids of the clusters that have points; ``margins`` counts rows by margin."""

    def __init__(self, parts: DataFrame):
        self.parts = parts
        self.margins: dict[int, np.ndarray] = {}

    def collect(self) -> list[dict]:
        found: dict[tuple, list] = {}
        for run, cid, n, s in zip(*self.parts.toArrow().to_pydict().values()):
            known = found.setdefault((run, cid), [0, 0.0])
            known[0] += n
            known[1] += np.array(s)
        self.margins = {run: s for (run, cid), (_, s) in found.items() if cid == MARGINS}
        return [{"run": run, "cid": cid, "n": n, "s": s, "c": (s / n).tolist()} for (run, cid), (n, s) in sorted(found.items()) if cid != MARGINS]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The matrices in rows of :func:`_packed`, small ones of a batch together."""
    for batch in batches:
        held: list[np.ndarray] = []
        for n, data in zip(batch.column("n").to_pylist(), batch.column("x")):
            x = np.frombuffer(data.as_buffer(), "<f8").reshape(n, -1)
            if held and (held[0].shape[1] != x.shape[1] or sum(h.size for h in held) + x.size > CHUNK_NUMBERS):
                yield np.concatenate(held)
                held = []
            held.append(x)
        if held:
            yield np.concatenate(held)


def run_sums(blocks: DataFrame, models: dict[int, np.ndarray], part: Callable[[np.ndarray, np.ndarray], dict[int, tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """Rows ``(run, cid, n, s)`` of what ``part`` finds in a block of vectors for a model: a count and a row of numbers per cid.

    A task adds up its rows per run and cluster, so tasks × centroids vectors leave the tasks
    and no row of the points. Beyond ``COLLECTED_NUMBERS`` they are added up by a shuffle first.
    """

    def sums(batches):
        found: dict[tuple[int, int], list] = {}
        for x in _vectors(batches):
            for run, model in models.items():
                for first, (n, s) in part(x, model).items():
                    known = found.setdefault((run, first), [np.zeros_like(n), np.zeros_like(s)])
                    known[0] += n
                    known[1] += s
        for (run, first), (n, s) in found.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({
                "run": pa.array(np.full(len(used), run, "int32")), "cid": pa.array((first + used).astype("int32")),
                "n": pa.array(n[used]), "s": pa.array(list(s[used]), pa.list_(pa.float64())),
            })

    parts = blocks.mapInArrow(sums, "run int, cid int, n bigint, s array<double>")
    # an input file or 32 MB of one gives a task's sums
    tasks = max(len(blocks.inputFiles()), estimated_bytes(blocks) // PACKED_BYTES)
    if tasks * sum(c.size + BINS for c in models.values()) > COLLECTED_NUMBERS:
        cells = parts.select("run", "cid", "n", F.posexplode("s").alias("pos", "value"))
        cells = cells.groupBy("run", "cid", "pos").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda c: c["value"])  # one number per component
        parts = cells.groupBy("run", "cid").agg(F.first("n").alias("n"), ordered.alias("s"))
    return parts


def _unit(model: np.ndarray) -> float:
    return float(np.abs(model).max()) or 1.0


def _run_means(blocks: DataFrame, models: dict[int, Centroids]) -> _Means:
    """The new centroids of all models and how the rows' margins are spread, from one scan."""

    def part(x, model):
        at, margin = closest_margin(x, model)
        found = {0: cluster_sums(x, at, len(model))}
        if len(model) > 1:
            with np.errstate(divide="ignore"):
                place = np.floor(OCTAVE * (np.log2(margin / _unit(model)) + DEPTH))
            spread = np.bincount(np.clip(np.nan_to_num(place), 0, BINS - 1).astype(int), minlength=BINS)
            found[MARGINS] = np.array([len(x)]), spread[None].astype(float)
        return found

    return _Means(run_sums(blocks, {run: np.asarray(c, dtype=float) for run, c in models.items()}, part))


def _moved(a: np.ndarray, b: np.ndarray) -> float:
    """The longest way of a centroid, not less than it is."""
    return float(np.sqrt(((a - b) ** 2).sum(axis=1)).max() * (1 + 1e-9))


def _reach(margins: np.ndarray, unit: float, most: int, moved: float) -> float:
    """The margin below which rows go on alone, 0 if that is not worth it: at most ``most`` rows, and rounds enough."""
    few = np.searchsorted(np.cumsum(margins), most, "right")  # so many bins fit
    if few == 0:
        return 0.0
    edge = unit * 2.0 ** (few / OCTAVE - DEPTH) if few < BINS else np.inf
    reach = min(edge, 2 * REACH * moved)
    return reach if reach > 2 * LEAST_REACH * moved else 0.0


class _Walk:
    """Rounds of one model from here on, with the count and the stop of :func:`lloyd_runs`."""

    def __init__(self, start: np.ndarray, tol: float, rounds: int | None):
        self.now, self.past, self.tol, self.rounds, self.done, self.stopped = start, [start], tol, rounds, 0, False

    @property
    def over(self) -> bool:
        return self.stopped or self.done == self.rounds

    def step(self, count: np.ndarray, total: np.ndarray) -> None:
        """The next state from sums; a cluster without points keeps its centroid."""
        used = count > 0
        new = self.now.copy()
        new[used] = total[used] / count[used, None]
        self.enter(new)

    def enter(self, new: np.ndarray) -> None:
        self.now = new
        self.done += 1
        bound = self.tol * max(1.0, np.abs(new).max())
        self.stopped = any(np.abs(new - c).max() <= bound for c in self.past)
        self.past = [*self.past[1 - MEMORY:], new]


def _rest(count: np.ndarray, total: np.ndarray, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums without those of ``x``."""
    n, s = cluster_sums(x, at, len(count))
    return count - n, np.where((count > n)[:, None], total - s, 0.0)


def _walk_rows(walk: _Walk, x: np.ndarray, count: np.ndarray, total: np.ndarray, origin: np.ndarray, reach: float) -> None:
    """Rounds over the rows ``x`` alone, while no centroid is so far from ``origin`` that other rows may change their cluster.

    ``count`` and ``total`` are the sums of the other rows. Most of ``x`` is set aside in the same way for a
    number of rounds.
    """
    while not walk.over and 2 * _moved(walk.now, origin) < reach:
        at, margin = closest_margin(x, walk.now)
        n, s = cluster_sums(x, at, len(count))
        before = walk.now
        walk.step(count + n, total + s)
        near = 2 * REACH * _moved(walk.now, before)
        few = margin <= near
        if 2 * few.sum() > len(x):
            continue
        few, at = x[few], at[few]
        rest = _rest(count + n, total + s, few, at)
        while not walk.over and 2 * _moved(walk.now, before) < near and 2 * _moved(walk.now, origin) < reach:
            n, s = cluster_sums(few, closest_index(few, walk.now), len(count))
            walk.step(rest[0] + n, rest[1] + s)


def _narrow_rounds(blocks: DataFrame, walks: dict[int, _Walk], origins: dict[int, np.ndarray],
                   sums: dict[int, tuple[np.ndarray, np.ndarray]], reaches: dict[int, float]) -> dict[int, _Walk]:
    """Further rounds of models over the rows that may change their cluster, one task per model.

    ``sums`` are those of all rows under ``origins``. A row with a margin of at least ``reaches`` keeps its
    cluster until a centroid is half of that away from its origin; the others, at most ``NARROW_NUMBERS``
    numbers by the margins counted before, go to the model's task, where rounds need no job.
    """
    def chosen(batches):
        held: dict[int, list] = {run: [] for run in reaches}

        def flushed(run):
            found = np.concatenate(held[run])
            held[run] = []
            return pa.RecordBatch.from_arrays([pa.array([run], pa.int32()), pa.array([len(found)], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["run", "n", "x"])

        for x in _vectors(batches):
            for run, reach in reaches.items():
                found = x[closest_margin(x, origins[run])[1] < reach]
                if len(found):
                    held[run].append(found)
                    if sum(f.size for f in held[run]) >= PACKED_NUMBERS:
                        yield flushed(run)
        for run, some in held.items():
            if some:
                yield flushed(run)

    def walked(group: pa.Table) -> pa.Table:
        run = group["run"][0].as_py()
        x, walk, origin = np.concatenate(list(_vectors(group.to_batches()))), copy.copy(walks[run]), origins[run]
        rest = _rest(*sums[run], x, closest_index(x, origin))
        _walk_rows(walk, x, *rest, origin, reaches[run])
        states = np.stack(walk.past).tobytes()
        return pa.table({"run": pa.array([run], pa.int32()), "done": pa.array([walk.done]), "stopped": [walk.stopped], "states": pa.array([states], pa.binary())})

    rows = blocks.mapInArrow(chosen, "run int, n bigint, x binary").repartition(len(reaches), "run")
    found = rows.groupBy("run").applyInArrow(walked, "run int, done bigint, stopped boolean, states binary").toArrow()
    after = {}
    for run, done, stopped, states in zip(*found.to_pydict().values()):  # one per model
        walk = after[run] = copy.copy(walks[run])
        walk.past = list(np.frombuffer(states).reshape(-1, *walk.now.shape))
        walk.now, walk.done, walk.stopped = walk.past[-1], done, stopped
    return after


def lloyd_runs(
    points: DataFrame, models: dict[int, Centroids], rounds: int | None = None, tol: float = TOLERANCE, blocks: DataFrame | None = None
) -> dict[int, Centroids]:
    """Assign and update all models together until all stand still.

    A cluster that loses all its points keeps its centroid. A run stops when no number
    of a centroid moves by more than ``tol`` times the largest number of the model, or
    1 if that is smaller. It also stops when it comes back, within the same bound, to one of its
    last ``MEMORY`` states, as points midway between centroids can make it do when sums are
    rounded. With ``rounds``, runs still moving after that many are an error.

    A round over all rows is one job. Once centroids move little, only rows about midway between two of them can
    change their cluster, and a model's next rounds are over those, until it has moved too far for that. ``blocks``
    are the points as :func:`_packed` stores them.
    """
    blocks = _packed(points) if blocks is None else blocks
    walks = {run: _Walk(np.asarray(c, dtype=float), tol, rounds) for run, c in models.items()}
    while active := {run: walk for run, walk in walks.items() if not walk.stopped}:
        if late := [run for run, walk in active.items() if walk.done == rounds]:
            raise RuntimeError(f"models {sorted(late)} still move after {rounds} rounds")
        origins = {run: active[run].now for run in sorted(active)}
        now = {run: c.copy() for run, c in origins.items()}
        means = _run_means(blocks, origins)
        rows = means.collect()  # one per centroid at most
        for row in rows:
            now[row["run"]][row["cid"]] = row["c"]
        reaches, most = {}, min(NARROW_NUMBERS, MOVED_NUMBERS // len(active))
        for run, walk in active.items():
            walk.enter(now[run])
            if not walk.over and len(walk.now) > 1:
                moved = _moved(walk.now, origins[run])
                if reach := _reach(means.margins[run], _unit(origins[run]), most // walk.now.shape[1], moved):
                    reaches[run] = reach
        if reaches:
            sums = {run: (np.zeros(len(origins[run]), "int64"), np.zeros_like(origins[run])) for run in reaches}
            for row in rows:
                if row["run"] in sums:
                    sums[row["run"]][0][row["cid"]], sums[row["run"]][1][row["cid"]] = row["n"], row["s"]
            walks.update(_narrow_rounds(blocks, {run: walks[run] for run in reaches}, {run: origins[run] for run in reaches}, sums, reaches))
    return {run: walk.now.tolist() for run, walk in walks.items()}


def fit(points: DataFrame, k: int, rounds: int | None = None, seed: int = 42, tol: float = TOLERANCE) -> Centroids:
    points = stored_points(points)
    return lloyd_runs(points, {k: far_point_seeds(points, k, seed)}, rounds, tol)[k]


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cid").agg(F.count("*").alias("n"))


# choosing k ----------------------------------------------------------------

SWEEP = (1, 2, 4, 8, 16, 32)


def sweep(
    points: DataFrame, seeds: Centroids, ks: Sequence[int], rounds: int | None = None, metric: str = "squared",
    blocks: DataFrame | None = None,
) -> DataFrame:
    """``(k, sil)``: mean silhouette of the model for each k, all k in the same scans."""
    from sparkloom.operators.silhouette import mean_silhouette

    blocks = _packed(points) if blocks is None else blocks
    models = lloyd_runs(points, {k: seeds[:k] for k in ks}, rounds, blocks=blocks)
    return mean_silhouette(points, models, metric, blocks)


def elbow(scores: DataFrame) -> DataFrame:
    """One row ``k``: the successor of the first k > 1 that does not improve.

    If the scores rise throughout, the largest k. ``scores`` has one row per swept k.
    """
    order = Window.orderBy("k")
    ahead = scores.select("k", "sil", F.lead("k").over(order).alias("next_k"),
                          F.lead("sil").over(order).alias("next_sil"))
    stops = (F.col("k") > 1) & (F.col("next_sil") <= F.col("sil"))
    return ahead.agg(
        F.coalesce(F.min_by("next_k", F.when(stops, F.col("k"))), F.max("k")).alias("k")
    )


def best_k(scores: DataFrame) -> DataFrame:
    """One row ``(k, sil)``: the highest score, the smallest k on ties."""
    best = F.min(F.struct((-F.col("sil")).alias("neg"), "k")).alias("b")
    return scores.agg(best).select("b.k", (-F.col("b.neg")).alias("sil"))


def select_k(
    points: DataFrame, rounds: int | None = None, ks: Sequence[int] = SWEEP, seed: int = 42, metric: str = "squared"
) -> DataFrame:
    """``(phase, k, sil)`` of the coarse sweep and of the refinement below its elbow."""
    points = stored_points(points)
    seeds = far_point_seeds(points, max(ks), seed)
    blocks = _packed(points)
    coarse = sweep(points, seeds, ks, rounds, metric, blocks)
    top = elbow(coarse).first()["k"]
    fine = sweep(points, seeds, range(max(top // 4, 1), top + 1), rounds, metric, blocks)
    return coarse.select(F.lit("sweep").alias("phase"), "k", "sil").union(
        fine.select(F.lit("refine").alias("phase"), "k", "sil")
    )


class KMeansJob:
    """Choose k, fit, and report anomalies of a point table."""

    def __init__(self, rounds: int | None = None, seed: int = 42, metric: str = "squared", rule: str = "any"):
        self.rounds, self.seed, self.metric, self.rule = rounds, seed, metric, rule

    def run(self, points: DataFrame) -> DataFrame:
        from sparkloom.operators.anomalies import anomalies

        scores = select_k(points, self.rounds, seed=self.seed, metric=self.metric)
        self.k = best_k(scores.where(F.col("phase") == "refine")).first()["k"]
        self.centroids = fit(points, self.k, self.rounds, self.seed)
        return anomalies(assign(points, self.centroids), self.rule)

    def predict(self, points: DataFrame) -> DataFrame:
        """Points with their cluster under the fitted centroids."""
        return assign(points, self.centroids)

    def save(self, spark: SparkSession, path: str) -> None:
        """Store the fitted centroids as rows ``(cid, c)`` under ``path``, in place of what is there."""
        rows = [(cid, [float(v) for v in c]) for cid, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, "cid int, c array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options) -> "KMeansJob":
        job = cls(**options)
        job.centroids = [r["c"] for r in spark.read.parquet(path).orderBy("cid").collect()]  # one per cluster
        job.k = len(job.centroids)
        return job
