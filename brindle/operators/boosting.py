"""Second-order gradient boosting over sparse long rows, one window a level.

State is (row_id, cls, node, g, h); features (row_id, fid, val), absent means missing. A
level's candidate splits come from one prefix sum over (cls, node, fid, val), after rows of
equal value are combined. Trees are a small table and routing is one join a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import scalar as S

L1, L2 = 1e-5, 1e-5
TREE = "cls int, node bigint, fid int, thr double, nan_right boolean, gain double, sum_h double"


def score(g: Column, h: Column) -> Column:
    """T(G)^2 / (H + lambda)."""
    t = S.soft_threshold(g, L1)
    return t * t / (h + L2)


def leaf_weight(g: Column, h: Column) -> Column:
    return -S.soft_threshold(g, L1) / (h + L2)


def node_totals(state: DataFrame) -> DataFrame:
    return state.groupBy("cls", "node").agg(F.sum("g").alias("G"), F.sum("h").alias("H"), F.count(F.lit(1)).alias("n"))


def split_search(state: DataFrame, feats: DataFrame, min_h: float = 1.0) -> DataFrame:
    """(cls, node, fid, thr, nan_right, gain, G, H): every candidate split and both ways for missing rows.

    Thresholds are midpoints between neighbouring values; both sides need min_h. Rows are
    combined by value first, so a window holds a feature's distinct values in a node.
    """
    by_val = state.join(feats, "row_id").groupBy("cls", "node", "fid", "val").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    group = Window.partitionBy("cls", "node", "fid")
    upto = group.orderBy("val").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = by_val.select(
        "cls", "node", "fid", "val", F.lead("val").over(group.orderBy("val")).alias("next"), F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"),
        F.sum("g").over(group).alias("gf"), F.sum("h").over(group).alias("hf"),
    ).filter("next IS NOT NULL")
    c = w.join(node_totals(state), ["cls", "node"])
    gm, hm = F.col("G") - F.col("gf"), F.col("H") - F.col("hf")
    ways = F.array(
        F.struct(F.lit(True).alias("nan_right"), F.col("gl").alias("a"), F.col("hl").alias("b")),
        F.struct(F.lit(False).alias("nan_right"), (F.col("gl") + gm).alias("a"), (F.col("hl") + hm).alias("b")),
    )
    c = c.select("cls", "node", "fid", ((F.col("val") + F.col("next")) / 2).alias("thr"), "G", "H", F.inline(ways))
    gain = score(F.col("a"), F.col("b")) + score(F.col("G") - F.col("a"), F.col("H") - F.col("b")) - score(F.col("G"), F.col("H"))
    return c.filter((F.col("b") >= min_h) & (F.col("H") - F.col("b") >= min_h)).select("cls", "node", "fid", "thr", "nan_right", gain.alias("gain"), "G", "H")


def best_split(candidates: DataFrame, digits: int = 9) -> DataFrame:
    """The largest gain of each node, ties (at that many digits) to the lowest fid, then threshold, then missing left."""
    best = Window.partitionBy("cls", "node").orderBy(F.desc(F.round("gain", digits)), "fid", "thr", "nan_right")
    return candidates.filter("gain > 1e-9").withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")


def route(state: DataFrame, feats: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows moved to their child: 2 n to the left (value under the threshold), 2 n + 1 to the right; rows of unsplit nodes stay."""
    s = splits.select("cls", "node", "fid", "thr", "nan_right")
    x = state.join(s, ["cls", "node"], "left").join(feats, ["row_id", "fid"], "left")
    right = F.when(F.col("val").isNull(), F.col("nan_right")).otherwise(F.col("val") >= F.col("thr"))
    node = F.when(F.col("thr").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right.cast("int"))
    return x.select("row_id", "cls", node.cast("bigint").alias("node"), "g", "h")


def grow(state: DataFrame, feats: DataFrame, depth: int, min_h: float = 1.0) -> tuple[list[DataFrame], DataFrame]:
    """Splits of each level of one tree a class, and the rows in their leaves."""
    from brindle.session import written

    levels = []
    for _ in range(depth):
        splits = written(best_split(split_search(state, feats, min_h)), "splits")
        if splits.isEmpty():
            break
        levels.append(splits)
        state = written(route(state, feats, splits), "routed")
    return levels, state


def _kept(c: Column, tree: int, share: float) -> Column:
    """Whether a hash of a row or feature and the tree's number draws it into the tree's sample."""
    return F.pmod(F.xxhash64(c, F.lit(tree)), F.lit(1_000_000)) < int(share * 1_000_000)


def train(rows: DataFrame, feats: DataFrame, classes: int, trees: int, depth: int, lr: float = 0.6, row_share: float = 1.0, feature_share: float = 1.0) -> tuple[list[dict], list[float], DataFrame]:
    """Boosting of (row_id, label): per tree its levels and leaf weights, the log-loss before each, and the last margins
    (row_id, label, m ARRAY). One class is a logistic margin of a 0/1 label, several are a softmax.

    Splits and leaf weights of a tree come from row_share of the rows and feature_share of the
    features, drawn by hashes; all rows are then routed through it.
    """
    from brindle.functions import vec as V
    from brindle.session import written

    margins = rows.select("row_id", "label", F.array(*[F.lit(0.0)] * classes).alias("m"))
    out, losses = [], []
    for t in range(trees):
        if classes == 1:
            p = margins.withColumn("p", F.transform("m", S.sigmoid))
            loss, g = S.logistic_nll(F.col("m")[0], F.col("label").cast("double")), F.col("p") - F.col("label")
            h = F.col("p") * (1 - F.col("p"))
        else:
            p = margins.withColumn("p", V.softmax(F.col("m")))
            loss, g = -F.log(F.element_at("p", F.col("label") + 1)), F.col("p") - (F.col("label") == F.col("cls")).cast("double")
            h = 2 * F.col("p") * (1 - F.col("p"))
        losses.append(p.agg(F.avg(loss)).first()[0])
        flat = p.select("row_id", "label", F.posexplode("p").alias("cls", "p"))
        state = written(flat.select("row_id", "cls", F.lit(1).cast("bigint").alias("node"), g.alias("g"), h.alias("h")), "state")
        seen = state.filter(_kept(F.col("row_id"), t, row_share)) if row_share < 1 else state
        known = feats.filter(_kept(F.col("fid"), t, feature_share)) if feature_share < 1 else feats
        levels, leaves = grow(seen, known, depth)
        weights = written(node_totals(leaves).select("cls", "node", (leaf_weight(F.col("G"), F.col("H")) * lr).alias("weight")), "leaves")
        if row_share < 1:
            leaves = state
            for splits in levels:
                leaves = route(leaves, feats, splits)
        add = leaves.join(weights, ["cls", "node"]).groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("cls", "weight"))).alias("w"))
        moved = margins.join(add, "row_id", "left").select("row_id", "label", F.transform("m", lambda v, i: v + F.coalesce(F.col("w")[i], F.lit(0.0))).alias("m"))
        margins = written(moved, "margins")
        out.append({"levels": levels, "leaves": weights})
    return out, losses, margins


def predict(rows: DataFrame, feats: DataFrame, forest: list[dict], classes: int) -> DataFrame:
    """(row_id, m ARRAY): margins of any rows under trained trees."""
    total = None
    for tree in forest:
        state = rows.select("row_id", F.explode(F.array(*[F.lit(c) for c in range(classes)])).alias("cls"), F.lit(1).cast("bigint").alias("node"), F.lit(0.0).alias("g"), F.lit(0.0).alias("h"))
        for splits in tree["levels"]:
            state = route(state, feats, splits)
        w = state.join(tree["leaves"], ["cls", "node"], "left").select("row_id", "cls", F.coalesce("weight", F.lit(0.0)).alias("w"))
        total = w if total is None else total.unionByName(w)
    s = total.groupBy("row_id", "cls").agg(F.sum("w").alias("w"))
    return s.groupBy("row_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("cls", "w"))), lambda t: t["w"]).alias("m"))


def importance(forest: list[dict]) -> DataFrame:
    """(fid, splits): how often each feature splits a node."""
    levels = [lv.select("fid") for t in forest for lv in t["levels"]]
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out.groupBy("fid").agg(F.count(F.lit(1)).alias("splits"))
