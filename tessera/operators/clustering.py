"""k-means over many row groups, cluster counts and restarts at once.

All fits advance together, several steps in each pass over the rows. A pass assigns every
row to its nearest centre in each fit of its group. As long as no centre has moved farther
than a fit's reach, a row whose second nearest centre is more than twice the reach farther
than its nearest one can't change its cluster: of these rows only sums leave a task. The
others, at most about ``HELD`` numbers, are sent to the task that takes the fit's steps,
until a centre leaves the reach. These are the steps of passes over all rows, without the
passes; in a small group no row is summed and one pass takes all steps.

The driver holds the centres - fits x k vectors, a number given by parameters - and never
a row.
"""

from __future__ import annotations

import warnings
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.agreement import clustering_agreement, mean_std
from tessera.operators.neighbours import silhouettes
from tessera.session import materialize

#: Candidates that each round draws for the largest k of a group, per k, and the rounds.
CANDIDATES, ROUNDS = 4, 4
#: Rows that meet all centres of their group at a time.
SLICE = 1024
#: Numbers of the vectors that a task holds to take steps with.
HELD = 1 << 23
#: Margins are counted in bins of a quarter of an octave, from 2^-40 to 2^40.
BINS, OCTAVE = 320, 4
#: A margin must exceed twice the reach by this share of both distances: rounding.
SLACK = 1e-9


@dataclass
class Fit:
    """One run of k-means: its group, k and number, and the centres it has reached."""

    group: str
    k: int
    attempt: int
    centres: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    cost: float = float("inf")
    moving: bool = True
    steps: int = 0
    #: Rows by margin at the start of the last pass, and how far its last step went.
    margins: np.ndarray | None = None
    shift: float = float("inf")


def _spread_out(pool: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the candidates, each drawn with its weight times the squared distance to those before it."""
    chosen = [int(rng.choice(len(pool), p=weight / weight.sum()))]
    nearest = ((pool - pool[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        share = weight * nearest
        total = share.sum()
        at = int(rng.choice(len(pool), p=share / total)) if total > 0 else int(rng.integers(len(pool)))
        chosen.append(at)
        nearest = np.minimum(nearest, ((pool - pool[at]) ** 2).sum(axis=1))
    return pool[chosen].copy()


def _unit_hash(*parts: Column) -> Column:
    """Uniform in (0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + 0.5) / float(2**53)


def starting_candidates(rows: DataFrame, largest: dict[str, int], seed: int, group: str, identity: str, feature: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per group candidates for centres and the number of rows nearest to each.

    The first round draws rows evenly, each later one with the squared distance to the
    nearest candidate so far. A row's key is -log(u) / distance with a hash u of
    (seed, round, row); the rows with the smallest keys are a draw without replacement,
    and tasks keep only as many as are asked for.
    """
    wanted = {g: CANDIDATES * k for g, k in largest.items()}
    pool: dict[str, np.ndarray] = {}
    keyed = type(rows.schema)([*rows.schema.fields, *rows.select(F.lit(0.0).alias("u"), F.lit(0.0).alias("key")).schema.fields])
    for turn in range(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast((pool, wanted))

        def draw(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, most = shared.value
            held: dict[str, pa.Table] = {}
            for batch in batches:
                for name, place, x in _by_group(batch.select([group, feature]), group, feature):
                    if name not in most:
                        continue
                    gap = _distances(x, known[name]).min(axis=1) if name in known else np.ones(len(x))
                    far = gap > 1e-12
                    key = -np.log(batch.column("u").to_numpy()[place[far]]) / gap[far]
                    own = pa.Table.from_batches([batch.take(pa.array(place[far]))]).append_column("key", pa.array(key))
                    own = pa.concat_tables([held[name], own]) if name in held else own
                    held[name] = own.take(np.argsort(own["key"].to_numpy(), kind="stable")[: most[name]])
            for own in held.values():
                yield from own.combine_chunks().to_batches()

        def nearest_keys(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held: dict[str, pa.Table] = {}
            for batch in batches:
                for name in batch.column(group).unique().to_pylist():
                    own = pa.Table.from_batches([batch.filter(pc.equal(batch.column(group), name))])
                    own = pa.concat_tables([held[name], own]) if name in held else own
                    held[name] = own.sort_by([("key", "ascending"), (identity, "ascending")]).slice(0, shared.value[1][name])
            for own in held.values():
                yield from own.combine_chunks().to_batches()

        drawn = rows.withColumn("u", _unit_hash(F.lit(seed), F.lit(turn), F.col(identity))).mapInArrow(draw, keyed)
        kept = drawn.repartition(min(len(wanted), rows.sparkSession.sparkContext.defaultParallelism), group).mapInArrow(nearest_keys, keyed)
        fresh: dict[str, list] = defaultdict(list)
        for r in sorted(kept.select(group, identity, feature).collect(), key=lambda r: (r[group], r[identity])):
            fresh[r[group]].append(r[feature])
        for name, vectors in fresh.items():
            new = np.array(vectors, np.float64)
            pool[name] = np.concatenate([pool[name], new]) if name in pool else new
    pools = [Fit(name, len(own), 0, own) for name, own in pool.items()]
    counted = _pass(rows, list(enumerate(pools)), {}, 1, 0.0, group, feature)
    return {f.group: (f.centres, counted[n]["counts"].astype(np.float64)) for n, f in enumerate(pools)}


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2.0 * (x @ centres.T), 0.0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre of each row; a row's own square is the same for all."""
    half = x @ centres.T
    half -= (centres * centres).sum(axis=1) / 2
    return half.argmax(axis=1)


def _by_group(batch: pa.RecordBatch, group: str, feature: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(group, places in the batch, vectors) of each group of a batch."""
    vectors = batch.column(feature)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    matrix = flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
    coded = batch.column(group).dictionary_encode()
    code = coded.indices.to_numpy()
    for number, name in enumerate(coded.dictionary.to_pylist()):
        at = np.flatnonzero(code == number)
        yield name, at, matrix[at]


def fit_kmeans(rows: DataFrame, wanted: Sequence[tuple[str, int, int]], seed: int = 0, group: str = "group_id", identity: str = "sample_id", feature: str = "feature", max_passes: int = 300, tolerance: float = 1e-6) -> list[Fit]:
    """Fits of (group, k, attempt) in the order asked for; rows are a written table.

    Starting centres depend on (seed, group, k, attempt) and the rows alone. A centre
    that loses all its rows stays where it is. Fits that still move after ``max_passes``
    steps keep ``moving`` set and are warned of.
    """
    sizes = {r[group]: r["n"] for r in rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    fits = [Fit(*w) for w in wanted]
    largest: dict[str, int] = {}
    for f in fits:
        if f.k > sizes.get(f.group, 0):
            raise ValueError(f"{f.k} clusters asked of the {sizes.get(f.group, 0)} rows of {f.group}")
        largest[f.group] = max(f.k, largest.get(f.group, 0))
    candidates = starting_candidates(rows, largest, seed, group, identity, feature) if fits else {}
    for f in fits:
        f.centres = _spread_out(*candidates[f.group], f.k, np.random.default_rng([seed, zlib.crc32(f.group.encode()), f.k, f.attempt]))

    while any(f.moving and f.steps < max_passes for f in fits):
        _advance(rows, [f for f in fits if f.moving and f.steps < max_passes], sizes, max_passes, tolerance, group, feature)
    if unsettled := sum(f.moving for f in fits):
        warnings.warn(f"{unsettled} of {len(fits)} k-means fits still moved after {max_passes} passes", stacklevel=2)
    return fits


def _reach(fit: Fit, rows: int, together: int) -> float | None:
    """How far the centres may go in the next pass; nothing if it is better to take one step.

    Small groups are held whole. Else as many rows as ``together`` fits may hold each stay
    open, going by the margins of the pass before.
    """
    width = fit.centres.shape[1]
    if rows * width <= HELD:
        return float("inf")
    if fit.margins is None:
        return None
    below = int(np.searchsorted(np.cumsum(fit.margins), HELD // (width * together), "right"))
    reach = 2.0 ** ((below - BINS // 2) / OCTAVE) / 2
    return reach if below and reach >= 4 * fit.shift else None


def _advance(rows: DataFrame, fits: Sequence[Fit], sizes: dict[str, int], limit: float, tolerance: float, group: str, feature: str) -> None:
    """At least one step of each fit, in one pass; none goes on beyond ``limit`` steps."""
    share = _share(rows, len(fits))
    reach = {n: r for n, f in enumerate(fits) if (r := _reach(f, sizes[f.group], share)) is not None}
    for n, found in _pass(rows, list(enumerate(fits)), reach, limit, tolerance, group, feature).items():
        f = fits[n]
        f.centres, f.cost, f.moving, f.shift, f.margins = (found[c] for c in ("centres", "cost", "moving", "shift", "margins"))
        f.steps += found["steps"]


def settle(rows: DataFrame, fits: Sequence[Fit], group: str = "group_id", feature: str = "feature", tolerance: float = 1e-12) -> Sequence[Fit]:
    """The fits, gone on with until no row changes its cluster, however many steps that takes.

    The cost falls with each change, so there is an end. A row that changes moves two
    centres by far more than the tolerance, which is for sums added in another order.
    """
    sizes = {r[group]: r["n"] for r in rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    for f in fits:
        f.moving = True
    while any(f.moving for f in fits):
        _advance(rows, [f for f in fits if f.moving], sizes, float("inf"), tolerance, group, feature)
    return fits


def _share(rows: DataFrame, fits: int) -> int:
    """Fits that one task advances, for two tasks per core."""
    return max(1, -(-fits // (2 * rows.sparkSession.sparkContext.defaultParallelism)))


def _sums(x: np.ndarray, nearest: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each cluster, and the sum of their vectors."""
    member = np.zeros((len(x), k))
    member[np.arange(len(x)), nearest] = 1.0
    return member.sum(axis=0), member.T @ x


def _gaps(distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, and how much farther the second nearest is, less rounding."""
    nearest = distance.argmin(axis=1)
    if distance.shape[1] == 1:
        return nearest, np.full(len(distance), np.inf)
    two = np.sqrt(np.partition(distance, 1, axis=1)[:, :2])
    return nearest, two[:, 1] - two[:, 0] - SLACK * (two[:, 0] + two[:, 1])


def _walk(x: np.ndarray, start: np.ndarray, count: np.ndarray, total: np.ndarray, square: float, reach: float, limit: float, tolerance: float) -> dict:
    """Steps of a fit, until it rests, a centre has left the reach, or there were ``limit``:
    its centres, whether they move, how far the last step went, and of that the cost and
    the rows of each cluster before it.

    ``x`` are the rows that may change their cluster; ``count`` and ``total`` are those of
    the others in each cluster, and ``square`` is the sum of the squares of all rows.
    Seven of eight rows are summed here too, for as long as they can't change.
    """
    centres, steps, shift, eighth, near = start, 0, float("inf"), float("inf"), -1.0
    while True:
        if near < 0 or np.sqrt(((centres - base) ** 2).sum(axis=1).max()) > near:
            base, near, own, own_count, own_total = centres, -1.0, x, count, total
            if len(x) >= SLICE and 2 * shift < eighth:
                nearest, margin = _gaps(_distances(x, centres))
                eighth = float(np.partition(margin, len(margin) // 8)[len(margin) // 8]) / 2
                if 4 * shift < eighth < float("inf"):
                    stay = margin > 2 * eighth
                    more, sums = _sums(x[stay], nearest[stay], len(centres))
                    near, own, nearest, own_count, own_total = eighth, x[~stay], nearest[~stay], count + more, total + sums
            else:
                nearest = _nearest(x, centres)
        else:
            nearest = _nearest(own, centres)
        more, sums = _sums(own, nearest, len(centres))
        n, sums = own_count + more, own_total + sums
        cost = float(square - 2.0 * (centres * sums).sum() + n @ (centres * centres).sum(axis=1))
        after = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        shift = float(np.sqrt(((after - centres) ** 2).sum(axis=1).max()))
        moving = bool(np.abs(after - centres).max() > tolerance)
        centres, steps = after, steps + 1
        if not moving or steps >= limit or np.sqrt(((centres - start) ** 2).sum(axis=1).max()) > reach:
            return {"centres": centres, "counts": n, "cost": max(cost, 0.0), "moving": moving, "steps": steps, "shift": shift}


def _batch(schema: str, rows: list[dict]) -> pa.RecordBatch:
    """Rows as a batch; arrays become bytes."""
    types = {"int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    bytes_of = lambda v: v.tobytes() if isinstance(v, np.ndarray) else v
    return pa.RecordBatch.from_arrays([pa.array([bytes_of(r.get(c)) for r in rows], types[t]) for c, t in fields], names=[c for c, _ in fields])


def _pass(rows: DataFrame, fits: list[tuple[int, Fit]], reach: dict[int, float], limit: float, tolerance: float, group: str, feature: str) -> dict[int, dict]:
    """Per fit what ``_walk`` returns, and its rows by margin before that. Fits without a reach take one step."""
    share, tasks = _share(rows, len(fits)), 0
    of_group: dict[str, list] = defaultdict(list)
    for n, f in fits:
        of_group[f.group].append((n, f))
    # All centres of a group meet a row in one product; starts[i] is where fit i's begin.
    # Fits of a group are dealt to tasks by turns; reach is infinite where rows are not summed.
    stacked, work = {}, {}
    for name, own in of_group.items():
        parts = -(-len(own) // share)
        stacked[name] = (np.cumsum([0, *(len(f.centres) for _, f in own)]), np.concatenate([f.centres for _, f in own]), [reach.get(n, -1.0) for n, _ in own], tasks, parts)
        for part in range(parts):
            work[tasks + part] = [(n, f.centres, reach.get(n, 0.0), limit - f.steps if n in reach else 1) for n, f in own[part::parts]]
        tasks += parts
    shared = rows.sparkSession.sparkContext.broadcast((stacked, work))
    between = "task int, turn int, counts binary, total binary, square double, margins binary, open binary, x binary"
    schema = "fit int, centres binary, counts binary, margins binary, cost double, moving boolean, steps int, shift double"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, _ = shared.value
        held: dict[str, list] = {}
        for batch in batches:
            for name, _, vectors in _by_group(batch, group, feature):
                if name not in groups:
                    continue
                starts, centres, far, first, parts = groups[name]
                if name not in held:
                    held[name] = [[np.zeros(b - a), np.zeros((b - a, centres.shape[1])), np.zeros(BINS, np.int64)] for a, b in zip(starts, starts[1:], strict=False)] + [0.0]
                for at in range(0, len(vectors), SLICE):
                    x = vectors[at : at + SLICE]
                    held[name][-1] += float((x * x).sum())
                    still = np.ones((len(x), len(far)), bool)
                    distance = _distances(x, centres) if min(far) < float("inf") else None
                    for i, own in enumerate(held[name][:-1]):
                        if far[i] == float("inf"):
                            continue
                        nearest, margin = _gaps(distance[:, starts[i] : starts[i + 1]])
                        still[:, i] = (margin <= 2 * far[i]) & (far[i] >= 0)
                        stay = ~still[:, i]
                        more, total = _sums(x[stay], nearest[stay], len(own[0]))
                        bins = np.floor(OCTAVE * np.log2(np.clip(margin, 1e-300, 1e300))) + BINS // 2
                        own[0], own[1], own[2] = own[0] + more, own[1] + total, own[2] + np.bincount(np.clip(bins, 0, BINS - 1).astype(np.int64), minlength=BINS)
                    for part in range(parts):
                        sent = still[:, part::parts].any(axis=1)
                        if sent.any():
                            yield _batch(between, [{"task": first + part, "open": np.packbits(still[sent, part::parts], axis=1), "x": x[sent]}])
        for name, sums in held.items():
            _, _, _, first, parts = groups[name]
            yield _batch(between, [{"task": first + i % parts, "turn": i // parts, "counts": c, "total": t, "margins": m, "square": sums[-1]} for i, (c, t, m) in enumerate(sums[:-1])])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        parts: dict[int, list] = defaultdict(list)
        for r in (r for batch in batches for r in batch.to_pylist()):
            task = r["task"]
            if r["x"] is not None:
                width, bits = shared.value[1][task][0][1].shape[1], -(-len(shared.value[1][task]) // 8)
                parts[task].append((np.frombuffer(r["x"]).reshape(-1, width), np.frombuffer(r["open"], np.uint8).reshape(-1, bits)))
                continue
            more = [np.frombuffer(r["counts"]), np.frombuffer(r["total"]), np.frombuffer(r["margins"], np.int64), r["square"]]
            known = sums.get((task, r["turn"]))
            sums[task, r["turn"]] = more if known is None else [a + b for a, b in zip(known, more, strict=True)]
        for task in dict.fromkeys(t for t, _ in sums):
            own = shared.value[1][task]
            rows, bits = [np.concatenate(c) for c in zip(*parts[task], strict=True)] if task in parts else [np.zeros((0, own[0][1].shape[1])), np.zeros((0, -(-len(own) // 8)), np.uint8)]
            still = np.unpackbits(bits, axis=1, count=len(own)).astype(bool)
            for turn, (n, centres, far, steps) in enumerate(own):
                count, total, margins, square = sums[task, turn]
                x = rows if still[:, turn].all() else rows[still[:, turn]]
                found = _walk(x, centres, count, total.reshape(centres.shape), square, far, steps, tolerance)
                yield _batch(schema, [found | {"fit": n, "margins": margins}])

    dealt = rows.select(group, feature).mapInArrow(assign, between).repartitionById(tasks, "task")
    found = dealt.mapInArrow(walk, schema).collect()  # as many rows as fits
    shape = {n: f.centres.shape for n, f in fits}
    return {
        r["fit"]: r.asDict() | {"centres": np.frombuffer(r["centres"]).reshape(shape[r["fit"]]), "counts": np.frombuffer(r["counts"]), "margins": np.frombuffer(r["margins"], np.int64)}
        for r in found
    }


def best_attempts(fits: Sequence[Fit]) -> list[Fit]:
    """The cheapest attempt of each group and k."""
    best: dict[tuple, Fit] = {}
    for f in fits:
        known = best.get((f.group, f.k))
        if known is None or f.cost < known.cost:
            best[f.group, f.k] = f
    return list(best.values())


def assign_clusters(rows: DataFrame, fits: Sequence[tuple[int, Fit]], group: str = "group_id", feature: str = "feature") -> DataFrame:
    """Rows once per fit of their group, with ``fit`` (the given number) and ``cluster``."""
    of_group: dict[str, list] = defaultdict(list)
    for number, f in fits:
        of_group[f.group].append((number, f.centres))
    shared = rows.sparkSession.sparkContext.broadcast(dict(of_group))
    numbers = rows.select(F.struct(F.lit(0).cast("int").alias("fit"), F.lit(0).cast("int").alias("cluster")).alias("s")).select("s.*").schema

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, x in _by_group(batch, group, feature):
                own = batch.take(pa.array(at))
                for number, centres in shared.value.get(name, ()):
                    nearest = _distances(x, centres).argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array([number] * len(at), pa.int32()), pa.array(nearest, pa.int32())], names=[*own.schema.names, "fit", "cluster"])

    return rows.mapInArrow(assign, type(rows.schema)([*rows.schema.fields, *numbers.fields]))


def cluster_lists(rows: DataFrame, fits: dict[str, list[Fit]], group: str = "group_id", feature: str = "feature") -> DataFrame:
    """Rows of the groups with ``clusters``: one in each fit of their group, in its order."""
    shared = rows.sparkSession.sparkContext.broadcast({name: [f.centres for f in own] for name, own in fits.items()})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, x in _by_group(batch, group, feature):
                if name in shared.value:
                    nearest = np.stack([_distances(x, centres).argmin(axis=1) for centres in shared.value[name]], axis=1).astype(np.int32)
                    lists = pa.ListArray.from_arrays(np.arange(0, nearest.size + 1, nearest.shape[1], dtype=np.int32), nearest.ravel())
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, lists], names=[*batch.schema.names, "clusters"])

    return rows.mapInArrow(assign, type(rows.schema)([*rows.schema.fields, *rows.select(F.array(F.lit(0)).alias("clusters")).schema.fields]))


def best_k_by_silhouette(rows: DataFrame, k_min: int = 2, k_max: int = 10, restarts: int = 10, seed: int = 0, group: str = "group_id", identity: str = "sample_id") -> dict[str, int]:
    """Per group the smallest k of the highest mean silhouette, over all k at once.

    k goes up to one less than the group's rows; a partition that uses one cluster only
    doesn't count, and where none is left ``k_min`` is the answer.
    """
    sizes = {r[group]: r["n"] for r in rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = [(g, k, a) for g, n in sorted(sizes.items()) for k in range(max(2, k_min), min(k_max, n - 1) + 1) for a in range(restarts)]
    best: dict[str, list[Fit]] = defaultdict(list)
    for f in best_attempts(fit_kmeans(rows, wanted, seed, group, identity)):
        best[f.group].append(f)
    answer = dict.fromkeys(sizes, int(k_min))
    if best:
        scores = silhouettes(cluster_lists(rows.select(group, identity, "feature"), best, group), "clusters", keys=[group], id_col=identity, vector="feature", normalize=False)
        high: dict[str, tuple] = {}
        for r in scores.where("used > 1").collect():
            high[r[group]] = max(high.get(r[group], (-2.0, 0)), (r["silhouette"], -best[r[group]][r["place"]].k))
        answer |= {g: -k for g, (_, k) in high.items()}
    return answer


def agreement_of_clusters(rows: DataFrame, ks: dict[str, int], repeats: int, restarts: int, seed: int = 0, group: str = "group_id", identity: str = "sample_id") -> DataFrame:
    """(group, value): label agreement less centre agreement, averaged over repeated fits."""
    # Attempts of one repeat are consecutive numbers; the cheapest of them counts.
    wanted = [(g, k, repeat * restarts + a) for g, k in sorted(ks.items()) for repeat in range(repeats) for a in range(restarts)]
    chosen: dict[tuple, Fit] = {}
    for f in fit_kmeans(rows, wanted, seed + 1, group, identity):
        key = (f.group, f.attempt // restarts)
        if key not in chosen or f.cost < chosen[key].cost:
            chosen[key] = f
    labelled = assign_clusters(rows, list(enumerate(chosen.values())), group)
    scores = clustering_agreement(materialize(labelled.drop("feature"), "clusters"), "cluster", keys=[group, "fit"])
    return mean_std(scores, "score", [group]).select(group, "value")
