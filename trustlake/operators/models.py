"""Model comparison from tables of predictions, detections, weights and activations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlake.functions.geometry import centre_size_delta, grid_cell
from trustlake.functions.numeric import clamp, fixed
from trustlake.functions.risk import distance_band
from trustlake.operators.scan import exact_median
from trustlake.session import cut_lineage, sized_broadcast

MIN_CONFIDENCE = 0.25


# --- weights and activations ------------------------------------------------------------------------------------

def layer_stats(weights: DataFrame, by: Sequence[str] = ("model_id", "layer")) -> DataFrame:
    """Mean, population deviation, L2 norm, extremes and share of near-zero weights per layer."""
    v = F.col("value")
    return weights.groupBy(*by).agg(
        F.count("value").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.sqrt(F.sum(v * v)).alias("l2"),
        F.min(v).alias("min"), F.max(v).alias("max"), (F.count_if(F.abs(v) < 1e-7) / F.count(v)).alias("sparsity"),
    )


def compare_layers(candidate: DataFrame, reference: DataFrame, on: Sequence[str] = ("layer",)) -> DataFrame:
    """Reference layers beside the candidate's; ``missing`` when the candidate lacks one."""
    cand = candidate.select(*on, F.col("l2").alias("c_l2"), F.col("mean").alias("c_mean"))
    joined = reference.select(*on, F.col("l2").alias("r_l2"), F.col("mean").alias("r_mean")).join(cand, list(on), "left")
    return joined.select(
        *on, (F.abs(F.col("c_l2") - F.col("r_l2")) / (F.col("r_l2") + 1e-7)).alias("relative_l2"),
        F.abs(F.col("c_mean") - F.col("r_mean")).alias("mean_delta"), F.col("c_l2").isNull().alias("missing"),
    )


def modified_layers(compared: DataFrame, max_l2: float = 0.02, max_mean: float = 0.05) -> DataFrame:
    return compared.where((F.col("relative_l2") > max_l2) | (F.col("mean_delta") > max_mean) | F.col("missing"))


def dead_layers(stats: DataFrame, sparsity: float = 0.95, min_n: int = 10) -> DataFrame:
    return stats.where((F.col("sparsity") > sparsity) & (F.col("n") > min_n))


def dead_neurons(activations: DataFrame, by: Sequence[str] = ("model_id", "layer"), threshold: float = 0.75) -> DataFrame:
    """Share of neurons that are never positive over the probes, per layer, with the verdict."""
    neurons = activations.groupBy(*by, "neuron").agg((F.max("value") <= 0).alias("dead"))
    rows = neurons.groupBy(*by).agg(F.count(F.lit(1)).alias("neurons"), (F.count_if(F.col("dead")) / F.count(F.lit(1))).alias("dead_ratio"))
    return rows.withColumn("flagged", F.col("dead_ratio") >= threshold)


def activation_similarity(candidate: DataFrame, reference: DataFrame, threshold: float = 0.50, by: Sequence[str] = ()) -> DataFrame:
    """Mean cosine similarity per layer over the probes both models saw with the same width; ``by`` separates model pairs."""
    a = candidate.select(*by, "layer", "probe_id", "neuron", F.col("value").alias("a"))
    b = reference.select(*by, "layer", "probe_id", "neuron", F.col("value").alias("b"))
    joined = a.join(b, [*by, "layer", "probe_id", "neuron"], "full_outer")
    both = joined.groupBy(*by, "layer", "probe_id").agg(
        F.sum(F.col("a") * F.col("b")).alias("ab"), F.sqrt(F.sum(F.col("a") ** 2)).alias("na"),
        F.sqrt(F.sum(F.col("b") ** 2)).alias("nb"), F.count("a").alias("ca"), F.count("b").alias("cb"),
    )
    usable = (F.col("ca") == F.col("cb")) & (F.col("na") > 1e-9) & (F.col("nb") > 1e-9)
    sims = both.where((F.col("ca") > 0) & (F.col("cb") > 0)).withColumn(
        "s", F.when(usable, F.col("ab") / (F.col("na") * F.col("nb")))
    )
    rows = sims.groupBy(*by, "layer").agg(F.coalesce(F.avg("s"), F.lit(1.0)).alias("similarity"))
    return rows.withColumn("divergent", F.col("similarity") < threshold)


# --- classification -----------------------------------------------------------------------------------------------

def class_probabilities(predictions: DataFrame) -> DataFrame:
    """Exploded ``top_k`` rounded to six digits; the last entry of a class wins."""
    long = predictions.select("model_id", "probe_id", F.posexplode("top_k").alias("_pos", "k"))
    return long.groupBy("model_id", "probe_id", F.col("k.class_id").alias("class_id")).agg(
        fixed(F.max_by(F.col("k.confidence"), F.col("_pos")), 6).alias("p")
    )


def align_outputs(candidate: DataFrame, reference: DataFrame, on: Sequence[str] = ("probe_id", "class_id")) -> DataFrame:
    """Both models' values at the same position, zero where one is silent."""
    a = candidate.select(*on, F.col("p").alias("a"))
    return a.join(reference.select(*on, F.col("p").alias("b")), list(on), "full_outer").fillna(0.0, ["a", "b"])


def classification_distance(candidate: DataFrame, reference: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cosine distance of the probe-ordered signatures; the vectors themselves are never built."""
    joined = align_outputs(candidate, reference, [*by, "probe_id", "class_id"])
    sums = joined.groupBy(*by).agg(
        F.sum(F.col("a") * F.col("b")).alias("ab"), F.sqrt(F.sum(F.col("a") ** 2)).alias("na"), F.sqrt(F.sum(F.col("b") ** 2)).alias("nb")
    )
    sim = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("ab") / (F.col("na") * F.col("nb"))))
    silent = F.coalesce((F.col("na") <= 1e-9) | (F.col("nb") <= 1e-9), F.lit(True))
    distance = F.when(silent, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - sim))
    return sums.withColumn("_d", distance).select(
        *by, fixed(F.col("_d"), 6).alias("distance"), (F.col("_d") < 1e-4).alias("identical"), distance_band(F.col("_d")).alias("assessment")
    )


# --- detections ---------------------------------------------------------------------------------------------------

def explode_detections(predictions: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rows ``model_id, probe_id, det_no, class_id, confidence, box``."""
    box = [F.col("d.bbox")[i] for i in range(4)]
    long = predictions.select("model_id", "probe_id", F.posexplode("detections").alias("det_no", "d"))
    return long.where(F.col("d.confidence") >= min_confidence).select(
        "model_id", "probe_id", "det_no", "d.class_id", "d.confidence",
        F.struct(*[b.alias(n) for b, n in zip(box, ("x_min", "y_min", "x_max", "y_max"))]).alias("box"),
    )


def detection_signature(detections: DataFrame, classes: int) -> DataFrame:
    """Long signature per model: ``part`` is count, spatial, conf_mean or conf_std; spatial rows carry a cell.

    Every (class, cell) is present, zeros included. Class ids outside the range count as class 0.
    """
    cid = F.when(F.col("class_id").between(0, classes - 1), F.col("class_id")).otherwise(0).cast("int")
    rows = detections.select("model_id", cid.alias("class_id"), grid_cell(F.col("box")).alias("cell"), "confidence")
    cells = rows.groupBy("model_id", "class_id", "cell").agg(F.count(F.lit(1)).alias("n"))
    stats = rows.groupBy("model_id", "class_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean"), F.stddev_pop("confidence").alias("std")
    )
    frame = rows.select("model_id").distinct().withColumn("class_id", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    full = frame.join(stats, ["model_id", "class_id"], "left").fillna(0, ["n"]).fillna(0.0, ["mean", "std"])
    totals = rows.groupBy("model_id").agg(F.count(F.lit(1)).alias("total"))
    part = lambda name, value: F.struct(F.lit(name).alias("part"), F.lit(0).alias("cell"), fixed(value, 6).alias("value"))
    plain = full.join(totals, "model_id").select(
        "model_id", "class_id",
        F.inline(F.array(part("count", F.col("n") / F.col("total")), part("conf_mean", F.col("mean")), part("conf_std", F.col("std")))),
    )
    grid = full.select("model_id", "class_id", F.col("n").alias("_class_n"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("cell"))
    spatial = grid.join(cells, ["model_id", "class_id", "cell"], "left").select(
        "model_id", "class_id", F.lit("spatial").alias("part"), "cell",
        fixed(F.coalesce("n", F.lit(0)) / F.greatest(F.lit(1), F.col("_class_n")), 6).alias("value"),
    )
    return plain.unionByName(spatial)


def _slot(v: Column, side: Column) -> Column:
    return F.greatest(F.lit(0), F.least(side - 1, F.floor(v * side).cast("int")))


def _covered(box: Column, side: Column) -> Column:
    """Grid cells a box touches; a grid of one cell is not computed."""
    span = lambda low, high: F.sequence(_slot(box[low], side), F.greatest(_slot(box[low], side), _slot(box[high], side)))
    cols, rows = span("x_min", "x_max"), span("y_min", "y_max")
    return F.when(side == 1, F.array(F.lit(0))).otherwise(F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: r * side + c))))


def iou_pairs(
    candidate: DataFrame, reference: DataFrame, by: Sequence[str] = ("probe_id",), side: int = 16, crowd: int = 64
) -> DataFrame:
    """Overlapping boxes of the same probe with their IoU.

    In a probe of more than ``crowd`` boxes, boxes meet only in grid cells both touch, and a pair is kept in the
    one cell that holds the corner of its intersection; a crowded image does not pair every box with every other.
    """
    keys = list(by)
    sizes = candidate.select(*by).union(reference.select(*by)).groupBy(*by).count()
    sizes = sizes.select(*by, F.when(F.col("count") > crowd, side).otherwise(1).alias("_side"))
    a = candidate.select(*by, F.col("det_no").alias("c_no"), F.col("class_id").alias("c_class"), F.col("box").alias("c_box"))
    b = reference.select(*by, F.col("det_no").alias("r_no"), F.col("class_id").alias("r_class"), F.col("box").alias("r_box"))
    grid = F.col("_side")
    a = a.join(sizes, keys).withColumn("_cell", F.explode(_covered(F.col("c_box"), grid)))
    b = b.join(sizes, keys).withColumn("_cell", F.explode(_covered(F.col("r_box"), grid))).drop("_side")
    # Staged columns keep each generated method small enough for the JIT.
    edge = lambda pick, side: pick(F.col(f"c_box.{side}"), F.col(f"r_box.{side}"))
    area = lambda box: (F.col(f"{box}.x_max") - F.col(f"{box}.x_min")) * (F.col(f"{box}.y_max") - F.col(f"{box}.y_min"))
    joined = a.join(b, [*keys, "_cell"]).withColumns({"_left": edge(F.greatest, "x_min"), "_top": edge(F.greatest, "y_min")})
    kept = joined.where((grid == 1) | (F.col("_cell") == _slot(F.col("_top"), grid) * grid + _slot(F.col("_left"), grid)))
    kept = kept.withColumns({"_w": edge(F.least, "x_max") - F.col("_left"), "_h": edge(F.least, "y_max") - F.col("_top")})
    kept = kept.where("_w > 0 AND _h > 0").withColumn("_both", F.col("_w") * F.col("_h"))
    kept = kept.withColumn("iou", F.col("_both") / (area("c_box") + area("r_box") - F.col("_both")))
    return kept.drop("_cell", "_side", "_left", "_top", "_w", "_h", "_both")


def _assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment by shortest augmenting paths with row and column potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    rows, cols = c.shape
    u, v = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for start in range(rows):
        reach, parent = np.full(cols, np.inf), np.full(cols, -1)
        done = np.zeros(cols, dtype=bool)
        row, column, base = start, -1, 0.0
        while True:
            slack = base + c[row] - u[row] - v
            better = ~done & (slack < reach)
            reach[better], parent[better] = slack[better], column
            column = int(np.where(done, np.inf, reach).argmin())
            base = reach[column]
            done[column] = True
            if owner[column] < 0:
                break
            row = owner[column]
        u[start] += base
        for j in np.flatnonzero(done):
            if j != column:
                u[owner[j]] += base - reach[j]
                v[j] -= base - reach[j]
        while column >= 0:
            before = parent[column]
            owner[column] = start if before < 0 else owner[before]
            column = before
    pairs = [(int(owner[j]), int(j)) for j in range(cols) if owner[j] >= 0]
    return sorted((j, i) if flip else (i, j) for i, j in pairs)


def match_boxes(
    candidate: DataFrame, reference: DataFrame, max_cost: float = 0.95, by: Sequence[str] = ("probe_id",), crowd: int = 2000
) -> DataFrame:
    """Optimal one-to-one matching per probe: accepted pairs with IoU, class agreement and coordinate delta.

    A box without overlap can never be accepted, so each group of boxes linked by overlap is an independent
    problem. The boxes of a probe of at most ``_CALM`` boxes meet in one row, and many such probes are solved at once.
    Others meet in grid cells, and probes with more than ``crowd`` overlapping pairs are split into their groups first.
    """
    keys = list(by)
    sizes = candidate.select(*by).union(reference.select(*by)).groupBy(*by).count()
    busy = cut_lineage(sizes.where(F.col("count") > _CALM).select(*by))
    if busy.isEmpty():
        return _match_calm(candidate, reference, max_cost, by)
    side = sized_broadcast(busy)
    calm = _match_calm(candidate.join(side, keys, "left_anti"), reference.join(side, keys, "left_anti"), max_cost, by)
    return calm.union(_match_busy(candidate.join(side, keys, "left_semi"), reference.join(side, keys, "left_semi"), max_cost, by, crowd))


_CALM = 64  # boxes of a probe that meet in one row
_EDGE = ("c_no", "r_no", "iou", "same_class", "delta")
_CORNER = ("x_min", "y_min", "x_max", "y_max")
_MARGIN = 1e-9  # overlaps closer than this are left to the assignment


def _match_schema(rows: DataFrame, by: Sequence[str]) -> T.StructType:
    return T.StructType([
        *[rows.schema[b] for b in by], T.StructField("c_no", T.LongType()), T.StructField("r_no", T.LongType()),
        T.StructField("iou", T.DoubleType()), T.StructField("same_class", T.BooleanType()), T.StructField("delta", T.DoubleType()),
    ])


def _match_calm(candidate: DataFrame, reference: DataFrame, max_cost: float, by: Sequence[str]) -> DataFrame:
    def flat(rows: DataFrame, ours: bool) -> DataFrame:
        corner = [F.col(f"box.{n}").cast("double").alias(n) for n in _CORNER]
        return rows.dropna(subset=list(by)).select(*by, F.struct(F.lit(ours).alias("ours"), F.col("det_no").cast("long").alias("no"), "class_id", *corner).alias("_b"))

    rows = flat(candidate, True).union(flat(reference, False))
    fields = ("ours", "no", "class_id", *_CORNER)
    grouped = rows.groupBy(*by).agg(F.collect_list("_b").alias("_b")).where(F.size("_b") > 1)
    grouped = grouped.select(*by, *[F.col(f"_b.{n}").alias(f"_{n}") for n in fields])  # one array a field, which Arrow flattens

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                lists = {n: batch.column(f"_{n}") for n in fields}
                group = np.repeat(np.arange(batch.num_rows), lists["no"].value_lengths().to_numpy(zero_copy_only=False))
                part = {n: x.flatten() for n, x in lists.items()}
                ours = part["ours"].to_numpy(zero_copy_only=False).astype(bool)
                mine, other = np.flatnonzero(ours), np.flatnonzero(~ours)
                met = np.bincount(group[other], minlength=batch.num_rows)
                many = met[group[mine]]
                c = np.repeat(mine, many)
                within = np.arange(len(c)) - np.repeat(np.cumsum(many) - many, many)
                r = other[np.repeat((np.cumsum(met) - met)[group[mine]], many) + within]
                box = {n: part[n].to_numpy(zero_copy_only=False) for n in _CORNER}
                a, b = ({n: box[n][at] for n in _CORNER} for at in (c, r))
                w = np.minimum(a["x_max"], b["x_max"]) - np.maximum(a["x_min"], b["x_min"])
                h = np.minimum(a["y_max"], b["y_max"]) - np.maximum(a["y_min"], b["y_min"])
                both = w * h
                size = [(s["x_max"] - s["x_min"]) * (s["y_max"] - s["y_min"]) for s in (a, b)]
                meets = np.flatnonzero((w > 0) & (h > 0))
                overlap = both[meets] / (size[0][meets] + size[1][meets] - both[meets])
                delta = np.zeros(len(meets))
                for low, high in (("x_min", "x_max"), ("y_min", "y_max")):
                    al, ah, bl, bh = (s[n][meets] for s in (a, b) for n in (low, high))
                    delta = delta + np.abs((al + ah) / 2 - (bl + bh) / 2) + np.abs((ah - al) - (bh - bl))
                c, r = c[meets], r[meets]
                no = part["no"].to_numpy(zero_copy_only=False)
                chosen = _accepted(group[c], no[c], no[r], overlap, max_cost)
                c, r = pa.array(c[chosen]), pa.array(r[chosen])
                keys = [batch.column(n).take(pa.array(group)).take(c) for n in by]
                same = pc.equal(part["class_id"].take(c), part["class_id"].take(r))
                columns = [*keys, part["no"].take(c), part["no"].take(r), pa.array(overlap[chosen]), same, pa.array(delta[chosen])]
                yield pa.RecordBatch.from_arrays(columns, names=[*by, *_EDGE])

    return grouped.mapInArrow(solve, _match_schema(rows, by))


def _match_busy(candidate: DataFrame, reference: DataFrame, max_cost: float, by: Sequence[str], crowd: int) -> DataFrame:
    from trustlake.operators.duplicates import connected_components

    pairs = cut_lineage(iou_pairs(candidate, reference, by))  # read for the sizes and for the groups
    columns = [*by, "component", "c_no", "r_no", "c_class", "r_class", "c_box", "r_box", "iou"]
    crowded = pairs.groupBy(*by).count().where(F.col("count") > crowd).select(*by)
    if crowded.isEmpty():
        edges = pairs.withColumn("component", F.lit("")).select(*columns)
    else:
        node = lambda side, no: F.concat_ws("\x1f", *by, F.lit(side), F.lpad(F.col(no).cast("string"), 20, "0"))
        linked = pairs.join(crowded, list(by), "left_semi").withColumn("a", node("c", "c_no")).withColumn("b", node("r", "r_no"))
        groups = connected_components(linked.select("a", "b")).select(F.col("node").alias("a"), "component")
        calm = pairs.join(crowded, list(by), "left_anti").withColumn("component", F.lit(""))
        edges = linked.join(groups, "a").select(*columns).union(calm.select(*columns))
    delta = centre_size_delta(F.col("c_box"), F.col("r_box"))
    same = (F.col("c_class") == F.col("r_class")).alias("same_class")
    number = lambda c: F.col(c).cast("long").alias(c)
    edge = F.struct(number("c_no"), number("r_no"), "iou", same, delta.alias("delta"))
    grouped = edges.groupBy(*by, "component").agg(F.collect_list(edge).alias("_e"))
    grouped = grouped.select(*by, *[F.col(f"_e.{n}").alias(n) for n in _EDGE])  # one array a field, which Arrow flattens

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(n) for n in _EDGE]
            owner = np.repeat(np.arange(batch.num_rows), lists[0].value_lengths().to_numpy(zero_copy_only=False))
            flat = [x.flatten() for x in lists]
            c_no, r_no, overlap = (x.to_numpy(zero_copy_only=False) for x in flat[:3])
            chosen = _accepted(owner, c_no, r_no, overlap, max_cost)
            keys = [batch.column(b).take(pa.array(owner[chosen])) for b in by]
            yield pa.RecordBatch.from_arrays([*keys, *[x.take(pa.array(chosen)) for x in flat]], names=[*by, *_EDGE])

    return grouped.mapInArrow(solve, _match_schema(edges, by))


def _rival(box: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    """For each edge the largest overlap among the other edges of its box, zero where there is none."""
    order = np.lexsort((-overlap, box))
    of, size = box[order], overlap[order]
    first = np.r_[True, of[1:] != of[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
    after = np.r_[size[1:], 0.0]
    second = np.where(np.r_[of[1:] == of[:-1], False], after, 0.0)
    rival = np.empty(len(of))
    rival[order] = np.where(first, second, size[start])
    return rival


def _accepted(owner: np.ndarray, c_no: np.ndarray, r_no: np.ndarray, overlap: np.ndarray, max_cost: float) -> np.ndarray:
    """Indices of the accepted edges of many overlap groups (``owner``) at once.

    An edge that overlaps more than the best rivals of both its boxes together belongs to every best assignment; such
    edges are taken, and their boxes leave, until none is left. What remains of a group is one assignment problem.
    """
    def numbered(no: np.ndarray) -> np.ndarray:
        order = np.lexsort((no, owner))
        fresh = np.r_[False, (owner[order][1:] != owner[order][:-1]) | (no[order][1:] != no[order][:-1])]
        code = np.empty(len(no), dtype=np.int64)
        code[order] = np.cumsum(fresh)
        return code

    if not len(owner):
        return np.zeros(0, dtype=np.int64)
    c, r = numbered(c_no), numbered(r_no)
    left, chosen = np.arange(len(owner)), []
    while len(left):
        clear = overlap[left] > _rival(c[left], overlap[left]) + _rival(r[left], overlap[left]) + _MARGIN
        if not clear.any():
            break
        taken = left[clear]
        chosen.append(taken)
        gone_c, gone_r = np.zeros(c.max() + 1, dtype=bool), np.zeros(r.max() + 1, dtype=bool)
        gone_c[c[taken]], gone_r[r[taken]] = True, True
        left = left[~gone_c[c[left]] & ~gone_r[r[left]]]
    left = left[np.argsort(owner[left], kind="stable")]
    for part in np.split(left, np.flatnonzero(np.diff(owner[left])) + 1) if len(left) else []:
        rows, at_row = np.unique(c[part], return_inverse=True)
        cols, at_col = np.unique(r[part], return_inverse=True)
        cost, lookup = np.ones((len(rows), len(cols))), np.full((len(rows), len(cols)), -1)
        cost[at_row, at_col], lookup[at_row, at_col] = 1.0 - overlap[part], part
        chosen.append(np.array([lookup[at] for at in _assign(cost) if lookup[at] >= 0], dtype=np.int64))
    picked = np.concatenate(chosen)
    return np.sort(picked[1.0 - overlap[picked] <= max_cost])


def match_metrics(
    matches: DataFrame, candidate: DataFrame, reference: DataFrame, probes: DataFrame, by: Sequence[str] = ("probe_id",)
) -> DataFrame:
    """Per probe: matched count, mean IoU, class agreement, coordinate delta, unmatched boxes."""
    one = F.lit(1)
    c = candidate.groupBy(*by).agg(F.count(one).alias("n_cand"))
    r = reference.groupBy(*by).agg(F.count(one).alias("n_ref"))
    m = matches.groupBy(*by).agg(
        F.count(one).alias("matched"), F.avg("iou").alias("_iou"), (F.count_if(F.col("same_class")) / F.count(one)).alias("_agree"),
        (F.sum("delta") / (F.count(one) * 4.0)).alias("_delta"),
    )
    keys = list(by)
    rows = probes.select(*by).distinct().join(c, keys, "left").join(r, keys, "left").join(m, keys, "left").fillna(0, ["n_cand", "n_ref", "matched"])
    empty = (F.col("n_cand") == 0) & (F.col("n_ref") == 0)
    value = lambda name, when_empty, missing: F.when(empty, when_empty).otherwise(F.coalesce(name, F.lit(missing)))
    return rows.select(
        *by, "matched", value("_iou", 1.0, 0.0).alias("mean_iou"), value("_agree", 1.0, 0.0).alias("class_agreement"),
        value("_delta", 0.0, 1.0).alias("coord_delta"),
        (F.col("n_cand") - F.col("matched")).alias("unmatched_cand"), (F.col("n_ref") - F.col("matched")).alias("unmatched_ref"),
    )


def class_counts_pair(candidate: DataFrame, reference: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., class_id, c_cand, c_ref`` with zeros."""
    a = candidate.groupBy(*by, "class_id").agg(F.count(F.lit(1)).alias("c_cand"))
    b = reference.groupBy(*by, "class_id").agg(F.count(F.lit(1)).alias("c_ref"))
    return a.join(b, [*by, "class_id"], "full_outer").fillna(0, ["c_cand", "c_ref"])


def detection_distance(
    metrics: DataFrame, counts: DataFrame, weights: Sequence[float] = (0.4, 0.4, 0.2), by: Sequence[str] = ()
) -> DataFrame:
    """Distance 0.4(1 - IoU) + 0.4(1 - agreement) + 0.2 drift with its parts: one row, or one per model pair ``by``."""
    means = metrics.groupBy(*by).agg(F.coalesce(F.avg("mean_iou"), F.lit(0.0)).alias("iou"), F.coalesce(F.avg("class_agreement"), F.lit(0.0)).alias("agree"))
    gap = F.sum(F.abs(F.col("c_cand") - F.col("c_ref")))
    drift = counts.groupBy(*by).agg(F.least(F.lit(1.0), F.coalesce(gap / F.greatest(F.lit(1), F.sum("c_ref")), F.lit(0.0))).alias("drift"))
    if by:
        both = means.join(drift, list(by), "left").fillna(0.0, ["drift"])
    else:
        both = means.withColumn("_k", F.lit(1)).join(drift.withColumn("_k", F.lit(1)), "_k")
    w1, w2, w3 = (F.lit(float(w)) for w in weights)
    both = both.withColumn("_d", clamp(w1 * (1 - F.col("iou")) + w2 * (1 - F.col("agree")) + w3 * F.col("drift")))
    return both.select(
        *by, fixed(F.col("_d"), 6).alias("distance"), fixed(F.col("iou"), 4).alias("mean_matched_iou"), fixed(F.col("agree"), 4).alias("class_agreement_rate"),
        fixed(F.col("drift"), 4).alias("count_drift_ratio"), (F.col("_d") < 1e-4).alias("identical"), distance_band(F.col("_d")).alias("assessment"),
    )


def selective_drop(
    counts: DataFrame, by: Sequence[str] = (), scale: Column | None = None, min_count: int = 2,
    drop: float = 0.75, others: float = 0.25, first_only: bool = True,
) -> DataFrame:
    """Classes whose count collapsed while the remaining classes held. Input ``class_id, c_ref, c_cand``.

    ``scale`` maps reference counts to the candidate's number of probes (clean against perturbed probes). The
    average over the other classes is a leave-one-out from group sums.
    """
    expected = F.col("c_ref") * (F.lit(1.0) if scale is None else scale)
    rows = counts.where(F.col("c_ref") >= min_count).withColumn("_e", expected).where("_e > 0")
    rows = rows.withColumn("drop", (F.col("_e") - F.col("c_cand")) / F.col("_e"))
    peer = (F.col("_e") - F.col("c_cand")) / (F.col("_e") if scale is None else F.greatest(F.lit(1.0), F.col("_e")))
    rows = rows.withColumn("_peer", peer)
    keys = list(by) or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("_peer").alias("_s"))
    joined = rows.join(sums, keys)
    rest = F.coalesce(F.try_divide(F.col("_s") - F.col("_peer"), F.col("_n") - 1), F.lit(0.0))
    hit = joined.withColumn("other_drop", rest).where((F.col("drop") > drop) & (F.col("other_drop") < others))
    hit = hit.select(*keys, "class_id", "c_ref", "c_cand", "drop", "other_drop")
    if first_only:
        first = W.partitionBy(*keys).orderBy("class_id")
        hit = hit.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    return hit if by else hit.drop("_all")


def mad_outlier(scores: DataFrame, by: Sequence[str], name: str = "name", value: str = "score", threshold: float = 2.0, min_n: int = 3) -> DataFrame:
    """Low-side outlier per group: (median - min) / (1.4826 MAD), with the name of the smallest score.

    Medians are exact order statistics over buckets, so a group may be of any size.
    """
    keys = list(by)
    v = F.col(value)
    rows = cut_lineage(scores.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).select(*keys, name, value))
    median = cut_lineage(exact_median(rows, keys, value, "median"))
    away = rows.join(median.select(*keys, "median"), keys).withColumn("_away", F.abs(v - F.col("median")))
    mad = exact_median(away, keys, "_away", "mad").select(*keys, "mad")
    low = rows.groupBy(*keys).agg(F.min(value).alias("_min"), F.min_by(name, F.struct(value, name)).alias("suspect"))
    joined = median.join(mad, keys).join(low, keys)
    few = F.col("n") < min_n
    flat = F.col("mad") == 0
    stuck = flat & (F.col("_min") != F.col("median"))
    index = F.when(few | stuck, F.lit(None).cast("double")).when(flat, 0.0).otherwise((F.col("median") - F.col("_min")) / (1.4826 * F.col("mad")))
    return joined.withColumn("_i", fixed(index, 2)).select(
        *keys, "n", F.when(few | stuck, "INSUFFICIENT_EVIDENCE").otherwise("SUCCESS").alias("status"),
        fixed(F.col("median"), 4).alias("median"), fixed(F.col("mad"), 4).alias("mad"), F.col("_i").alias("anomaly_index"),
        F.when(F.col("_i").isNotNull(), F.col("suspect")).alias("suspect"), F.coalesce(F.col("_i") >= threshold, F.lit(False)).alias("flagged"),
    )


def substitution_verdict(distance: Column, digests_match: Column, threshold: float = 0.25) -> Column:
    """MT-1: identical, substituted or undecided."""
    return F.when(digests_match & (distance < 1e-4), "IDENTICAL").when(distance >= threshold, "SUBSTITUTED").otherwise("UNDECIDED")


def drift_verdict(distance: Column, lower: float = 0.08, upper: float = 0.25) -> Column:
    """MT-2 behavioural drift: strictly between equivalent and substituted."""
    return (distance >= lower) & (distance < upper)
