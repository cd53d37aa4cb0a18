"""Near-duplicate vectors by sorted passes over random projections.

In every pass the vectors of a label are ordered lexicographically by the signs
of random projections, ties by one more projection, and each is compared with a
bounded number of its neighbours in that order. Close vectors agree in most signs,
so in some pass they stand close together. The union of all passes holds the links.

Recall: at the least cosine the chance that one sign differs is ``acos(c) / pi``,
so two such vectors share the signs that narrow ``n`` vectors down to a window with
probability ``p = (window / n) ** -log2(1 - acos(c) / pi)``. The number of passes
is chosen so that all of them miss with probability ``MISS`` or less.

That holds where vectors are spread. Where they are dense, many share most signs, and a
window ends before signs tell much. So every vector keeps account: if it shares ``m``
signs with the neighbour at the far end of its window, a partner that agrees in ``m + 1``
stands within, which happens with probability ``(1 - acos(c) / pi) ** (m + 1)``. A vector
that all passes together miss with probability ``UNSURE`` or more, by what its windows
were like, or that links with ``CROWD`` or more neighbours on one side in some pass, is
crowded: it leaves the passes and is compared exactly. Crowded vectors gather in cells around pivots; by the
triangle inequality for angles only vectors within the radius of a cell and the angle
of a link can link with its members, and those are compared block by block, in as many
tasks as there are pairs of blocks. The passes then run again over the rest of these
labels, until nothing in them is crowded.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm.common import release, stored
from barograph.llm.components import components

COSINE = 0.93
SIGNS = 48
#: Neighbours on either side, and vectors of one block of the order.
WINDOW = 512
BLOCK = 2048
MISS = 0.002
LEAST_PASSES = 6
#: Links on one side of a vector, in one pass, from which it is compared exactly.
CROWD = WINDOW // 4
#: Chance of missing a partner in all passes from which a vector is compared exactly, too.
UNSURE = 0.02
#: Crowded vectors per pivot, and pivots of a label at most.
CELL = 2048
PIVOTS = 64
#: Allows for the rounding of angles, in radians.
SLACK = 1e-5


def passes_for(largest: int, cosine: float = COSINE, window: int = WINDOW) -> int:
    """Passes that find a pair at the least cosine among ``largest`` vectors of a label."""
    agree = 1 - math.acos(cosine) / math.pi
    together = min(1.0, window / max(largest, 1)) ** -math.log2(agree)
    if together >= 1:
        return LEAST_PASSES
    return max(LEAST_PASSES, math.ceil(math.log(MISS) / math.log1p(-together)))


@functools.lru_cache(256)
def projections(dim: int, number: int) -> np.ndarray:
    """Directions of pass ``number``: one per sign and one for ties."""
    return np.random.default_rng([dim, number]).standard_normal((dim, SIGNS + 1))


def _signs(units: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs of pass ``number`` as one whole number, the first leading, and the projection for ties."""
    y = units @ projections(units.shape[1], number)
    return (y[:, :SIGNS] > 0) @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)), y[:, SIGNS]


def _usable(vectors: DataFrame, columns: tuple[str, str, str]) -> DataFrame:
    vec_id, embedding, label = columns
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).alias("label")
    ).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    )


def _keys(classes: DataFrame, passes: int) -> DataFrame:
    """``(pass, label, dim, signs, tie, rep)``: where each vector stands in every pass."""

    def project(batches):
        for part in batches:
            for dim, rows in part.groupby("dim"):
                x = _units(rows["embedding"].to_numpy())
                for k in range(passes):
                    signs, tie = _signs(x, k)
                    yield pd.DataFrame({"pass": k, "label": rows["label"], "dim": dim, "signs": signs, "tie": tie, "rep": rows["rep"]})

    return classes.select("rep", "label", "dim", "embedding").mapInPandas(
        project, f"pass int, label {dict(classes.dtypes)['label']}, dim int, signs long, tie double, rep long"
    )


def _ranked(keys: DataFrame) -> DataFrame:
    """``(rep, ranks)``: the rank of each vector in the order of all passes, one after the other.

    One range-partitioned sort serves all passes; ranks follow from the row counts
    of its partitions.
    """
    order = ["pass", "label", "dim", "signs", "tie", "rep"]
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = stored(
        ranged.select("pass", "rep", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("at")),
        "ranks",
    )
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    # One row per partition of the sort.
    before = sizes.select("part", F.coalesce(F.expr("sum(rows) over (order by part rows between unbounded preceding and 1 preceding)"), F.lit(0)).alias("before"))
    ranks = placed.join(F.broadcast(before), "part").select("rep", "pass", (F.col("before") + F.col("at")).alias("rank"))
    return ranks.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "rank"))), lambda x: x["rank"]).alias("ranks"))


def _units(embeddings) -> np.ndarray:
    """Vectors of length one; scaled first, so that squares neither overflow nor vanish."""
    x = np.stack(embeddings)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _chance(signs: np.ndarray, ahead: np.ndarray, cosine: float) -> np.ndarray:
    """For vectors in order, the chance that a partner stands within a window that ends before ``ahead`` (-1: with the label)."""
    differ = signs ^ signs[np.maximum(ahead, 0)]
    # Signs shared are the leading zeros of what differs.
    shared = np.where(differ > 0, SIGNS - 1 - np.floor(np.log2(np.maximum(differ, 1))), SIGNS)
    agree = 1 - math.acos(cosine) / math.pi
    return np.where(ahead < 0, 1.0, np.where(shared >= SIGNS, 0.0, agree ** (shared + 1)))


def _compare_block(cosine: float, window: int, block: int, crowd: int):
    def compare(key, rows: pd.DataFrame) -> pd.DataFrame:
        """Links found first in this pass, their number per vector, a tree of them, crowded vectors, and the log of the chance that a partner is missed."""
        number = int(key[0])
        rows = rows.sort_values("rank", kind="stable").reset_index(drop=True)
        n = len(rows)
        rank = rows["rank"].to_numpy()
        ranks = np.stack(rows["ranks"].to_numpy())
        label, dim, copies = rows["label"].to_numpy(), rows["dim"].to_numpy(), rows["copies"].to_numpy()
        reps = rows["rep"].to_numpy()
        links, parent = np.zeros(n, np.int64), np.arange(n)
        after, ahead, missed = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for d in np.unique(dim):
            mine = np.flatnonzero(dim == d)
            x = _units(rows["embedding"].to_numpy()[mine])
            signs = _signs(x, number)[0]
            # The neighbour behind the window, if it is of the same label.
            beyond = np.searchsorted(rank[mine], rank[mine] + window)
            whole = beyond < len(mine)
            beyond = np.where(whole & (label[mine[np.minimum(beyond, len(mine) - 1)]] == label[mine]), beyond, -1)
            own = rank[mine] // block == key[1]
            missed[mine[own]] = np.log1p(-np.minimum(_chance(signs, beyond, cosine)[own], 1 - 1e-12))
            for a in range(0, len(mine), 256):
                left, right = mine[a : a + 256], mine[a:]
                near = np.searchsorted(rank[right], rank[left[-1]] + window, "right")
                right = right[:near]
                cos = x[a : a + len(left)] @ x[a : a + len(right)].T
                i, j = np.nonzero(cos >= cosine)
                gap = rank[right[j]] - rank[left[i]]
                keep = (gap > 0) & (gap <= window) & (rank[left[i]] // block == key[1]) & (label[left[i]] == label[right[j]])
                i, j = left[i[keep]], right[j[keep]]
                np.add.at(after, i, 1)
                np.add.at(ahead, j, 1)
                # An earlier pass that had both in one window has counted the link.
                earlier = np.zeros(len(i), bool)
                for q in range(number):
                    earlier |= np.abs(ranks[i, q] - ranks[j, q]) <= window
                i, j = i[~earlier], j[~earlier]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                for u, v in zip(i.tolist(), j.tolist()):
                    u, v = root(u), root(v)
                    if u != v:
                        parent[max(u, v)] = min(u, v)
        tree = np.array([reps[root(i)] for i in range(n)], np.int64)
        crowded = np.maximum(after, ahead) >= crowd
        some = (links > 0) | (tree != reps) | crowded | (missed < 0)
        return pd.DataFrame({"rep": reps[some], "label": label[some], "links": links[some], "tree": tree[some], "crowded": crowded[some], "missed": missed[some]})

    return compare


def _in_windows(active: DataFrame, cosine: float) -> DataFrame:
    """``(rep, label, links, tree, crowded, missed)``: what all passes over ``active`` find."""
    largest = active.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    ranks = _ranked(_keys(active, passes_for(largest, cosine)))
    # A vector goes to its block in every pass, and as a neighbour to the block before.
    at = F.posexplode("ranks").alias("pass", "rank")
    blocks = active.join(ranks, "rep").select("rep", "label", "dim", "copies", "embedding", "ranks", at)
    block = F.floor(F.col("rank") / BLOCK)
    halo = (F.col("rank") % BLOCK < WINDOW) & (block > 0)
    blocks = blocks.withColumn("block", F.explode(F.when(halo, F.array(block, block - 1)).otherwise(F.array(block))))
    schema = f"rep long, label {dict(active.dtypes)['label']}, links long, tree long, crowded boolean, missed double"
    return stored(blocks.groupBy("pass", "block").applyInPandas(_compare_block(cosine, WINDOW, BLOCK, CROWD), schema), "found")


def _compare_cells(cosine: float):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """All links between the members and the guests of a pair of blocks.

        A member finds all its links in its own cell, so links of two crowded vectors
        are counted for one end in either cell.
        """
        member = rows["member"].to_numpy()
        reps, copies, crowded = (rows[c].to_numpy() for c in ("rep", "copies", "crowded"))
        x = _units(rows["embedding"].to_numpy())
        own, guest = np.flatnonzero(member), np.flatnonzero(~member)
        linked = x[own] @ x[guest].T >= cosine
        other = linked & (reps[own][:, None] != reps[guest][None, :])
        links = np.zeros(len(rows), np.int64)
        links[own] = other @ copies[guest]
        links[guest] = np.where(crowded[guest], 0, copies[own] @ other)
        tree = reps.copy()
        fresh, waiting = np.ones(len(own), bool), np.ones(len(guest), bool)
        for first in range(len(own)):
            if not fresh[first]:
                continue
            fresh[first] = False
            mine, theirs, edge = [first], [], np.array([first])
            while len(edge):
                met = np.flatnonzero(waiting & linked[edge].any(axis=0))
                waiting[met] = False
                theirs.extend(met)
                edge = np.flatnonzero(fresh & linked[:, met].any(axis=1))
                fresh[edge] = False
                mine.extend(edge)
            together = np.concatenate([own[mine], guest[theirs]]).astype(int)
            tree[together] = reps[together].min()
        some = (links > 0) | (tree != reps)
        return pd.DataFrame({"rep": reps[some], "links": links[some], "tree": tree[some]})

    return compare


def _exactly(active: DataFrame, crowded: DataFrame, cosine: float) -> DataFrame:
    """``(rep, links, tree)``: all links of the ``crowded`` (rep) among ``active``."""
    marked = stored(
        active.select("rep", "label", "dim", "copies", "embedding")
        .join(crowded.select("rep", F.lit(True).alias("crowded")), "rep", "left")
        .withColumn("crowded", F.coalesce("crowded", F.lit(False))),
        "marked",
    )
    dense = marked.filter("crowded")
    sizes = dense.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("rows"))
    # Thinned by a hash before they are ranked, so that no task sees a whole crowd.
    wanted = F.least(F.ceil(F.col("rows") / CELL), F.lit(PIVOTS))
    chance = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    thin = dense.join(F.broadcast(sizes), ["label", "dim"]).withColumn("wanted", wanted).filter(chance * F.col("rows") < F.lit(1 << 30) * (F.col("wanted") * 4 + 32))
    at = F.expr("row_number() over (partition by label, dim order by xxhash64(rep), rep)")
    chosen = thin.withColumn("at", at).filter("at <= wanted").select("label", "dim", "embedding").collect()
    pivots: dict = {}
    for number, row in enumerate(chosen):
        numbers, directions = pivots.setdefault((row["label"], row["dim"]), ([], []))
        numbers.append(number)
        directions.append(np.array(row["embedding"]))
    pivots = {k: (np.array(numbers), _units(directions)) for k, (numbers, directions) in pivots.items()}
    shared = marked.sparkSession.sparkContext.broadcast(pivots)

    def angles(part: pd.DataFrame):
        for key, rows in part.groupby(["label", "dim"]):
            if key in shared.value:
                numbers, directions = shared.value[key]
                yield rows, numbers, np.arccos(np.clip(_units(rows["embedding"].to_numpy()) @ directions.T, -1, 1))

    def homes(batches):
        for part in batches:
            for rows, numbers, angle in angles(part):
                nearest = angle.argmin(axis=1)
                yield pd.DataFrame({"rep": rows["rep"], "cell": numbers[nearest], "angle": angle[np.arange(len(rows)), nearest]})

    home = stored(dense.select("rep", "label", "dim", "embedding").mapInPandas(homes, "rep long, cell long, angle double"), "homes")
    cells = home.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("members")).collect()
    reach = np.full(len(chosen), -1.0)
    for row in cells:
        reach[row["cell"]] = row["radius"] + math.acos(cosine) + SLACK

    def visits(batches):
        for part in batches:
            for rows, numbers, angle in angles(part):
                which, cell = np.nonzero(angle <= reach[numbers][None, :])
                yield pd.DataFrame({"rep": rows["rep"].to_numpy()[which], "cell": numbers[cell]})

    guests = stored(marked.select("rep", "label", "dim", "embedding").mapInPandas(visits, "rep long, cell long"), "guests")
    counts = guests.groupBy("cell").agg(F.count(F.lit(1)).alias("guests")).join(home.groupBy("cell").agg(F.count(F.lit(1)).alias("members")), "cell")
    blocks = counts.select("cell", F.ceil(F.col("members") / BLOCK).alias("own"), F.ceil(F.col("guests") / BLOCK).alias("other"))

    def side(rows: DataFrame, member: bool) -> DataFrame:
        mine, theirs = ("own", "other") if member else ("other", "own")
        dealt = rows.join(F.broadcast(blocks), "cell").select("rep", "cell", F.pmod(F.xxhash64("rep"), F.col(mine)).alias(mine), F.explode(F.sequence(F.lit(0).cast("long"), F.col(theirs) - 1)).alias(theirs))
        return dealt.select("rep", "cell", "own", "other", F.lit(member).alias("member"))

    dealt = side(home.select("rep", "cell"), True).union(side(guests, False)).join(marked.select("rep", "copies", "crowded", "embedding"), "rep")
    found = stored(dealt.groupBy("cell", "own", "other").applyInPandas(_compare_cells(cosine), "rep long, links long, tree long"), "exact")
    release(marked, home, guests)
    return found


def near_duplicates(vectors: DataFrame, columns: tuple[str, str, str] = ("vec_id", "embedding", "label"), cosine: float = COSINE) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Vectors are compared when their labels are equal and not null. A vector that
    is null, zero or empty or holds a null or non-finite component links with
    nothing, nor does one without ``vec_id``. Copies (equal vectors of a label) are one class,
    compared once and counted as many; classes are compared within windows of
    ``WINDOW`` neighbours, in crowds exactly. ``n_links`` counts the other vectors found at ``cosine``
    or above, ``component_id`` is the smallest ``vec_id`` reachable. Rows that
    repeat a ``vec_id`` with the same vector count as copies of each other. Other
    columns are not read.
    """
    usable = _usable(vectors, columns)
    hashes = [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), F.col("embedding")).alias("k2")]
    members = stored(usable.select("vec_id", "label", F.size("embedding").alias("dim"), *hashes, "embedding"), "vectors")
    key = ["label", "dim", "k1", "k2"]
    classes = stored(
        members.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")), "classes"
    )
    found, active = None, classes
    while active is not None:
        passed = _in_windows(active, cosine)
        # In a pass a vector accounts once, in its own block.
        account = passed.groupBy("rep").agg(F.first("label").alias("label"), F.max("crowded").alias("crowded"), F.sum("missed").alias("missed"))
        crowded = account.filter(F.col("crowded") | (F.col("missed") > math.log(UNSURE))).select("rep", "label")
        if crowded.isEmpty():
            part, active = passed.select("rep", "links", "tree"), None
        else:
            crowded = stored(crowded, "crowded")
            # Labels without crowds are done; of the others only what the passes can find is left to them.
            again = F.broadcast(crowded.select("label").distinct())
            part = passed.join(again, "label", "left_anti").select("rep", "links", "tree")
            busy = active.join(again, "label", "left_semi")
            part = part.union(_exactly(busy, crowded, cosine))
            active = stored(busy.join(crowded.select("rep"), "rep", "left_anti"), "active")
        found = part if found is None else found.union(part)
    linked = components(found.filter("rep <> tree").select(F.col("rep").alias("a"), F.col("tree").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classed = (
        classes.drop("embedding")
        .join(counts, "rep", "left")
        .join(linked.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            *key,
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    found_rows = members.select("vec_id", *key).join(classed, key).select("vec_id", "n_links", "component_id")
    rest = vectors.select(F.col(columns[0]).cast("long").alias("vec_id"), F.col(columns[1]).alias("embedding"), F.col(columns[2]).alias("label"))
    kept_ids = members.select("vec_id").distinct()
    alone = rest.join(kept_ids, "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found_rows.union(alone).withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))


def query(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
