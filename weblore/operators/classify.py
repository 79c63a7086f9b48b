"""Label propagation by classification: features, training sets, Gaussian naive Bayes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weblore.functions.text import tag_of
from weblore.operators.similarity import SIDES, gated_clusters, style_key
from weblore.session import cut

# Places of a template's seeded order that a seed looks at before all of them.
LOOK_AHEAD = 64
FEATURES = ("same_dom", "dom_distance", "min_h", "min_v", "above_left", "obj_tag", "pred_tag")


def label_codes(values: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Distinct values with codes 0..n-1 in order, per group `by` if given. Null has no code."""
    keys = [by] if by else []
    distinct = values.filter(F.col(column).isNotNull()).select(*keys, column).distinct()
    if by:
        return distinct.withColumn("code", F.row_number().over(W.partitionBy(by).orderBy(column)) - 1)
    # ranges of values: counted, then numbered inside each range, so no task holds all values
    spread = cut(distinct.repartitionByRange(distinct.sparkSession.sparkContext.defaultParallelism, column).withColumn("part", F.spark_partition_id()))
    starts = spread.groupBy("part").count().select("part", (F.sum("count").over(W.partitionBy(F.lit(0)).orderBy("part")) - F.col("count")).alias("start"))  # one row per range
    own = F.row_number().over(W.partitionBy("part").orderBy(column)) - 1
    return spread.withColumn("own", own).join(F.broadcast(starts), "part").select(column, (F.col("own") + F.col("start")).cast("int").alias("code"))


def largest_offset(pairs: DataFrame) -> DataFrame:
    """(template, largest): the largest absolute offset of a template's pairs (f: feature struct)."""
    every = F.array(*(F.abs(F.col(f"f.distances.{s}.{c}")) for s, names in SIDES.items() for c in names))
    return pairs.filter("f is not null").groupBy("template").agg(F.max(F.array_max(every)).alias("largest"))


def signed_minimum(distances: Column, side: str) -> Column:
    """Smallest signed offset of one side, nulls ignored."""
    return F.array_min(F.array(*(distances[side][c] for c in SIDES[side])))


def feature_vectors(pairs: DataFrame, tags: DataFrame) -> DataFrame:
    """pairs (pair_id, rank, obj_xpath, pred_xpath, obj_dom, f) with the seven features; missing numbers are 0.

    tags: (tag, code) over all pages. Rows without features are left out.
    """
    f = pairs.filter("f is not null")
    raw = f.select(
        *pairs.columns,
        F.coalesce((style_key(F.col("obj_dom")) == style_key(F.col("f.dom"))).cast("int"), F.lit(0)).alias("same_dom"),
        F.coalesce(F.col("f.dom_distance"), F.lit(0)).alias("dom_distance"),
        F.coalesce(signed_minimum(F.col("f.distances"), "horizontal"), F.lit(0.0)).alias("min_h"),
        F.coalesce(signed_minimum(F.col("f.distances"), "vertical"), F.lit(0.0)).alias("min_v"),
        F.coalesce(F.col("f.graphic.is_above_and_on_left").cast("int"), F.lit(0)).alias("above_left"),
        tag_of(F.col("obj_xpath")).alias("_o"), tag_of(F.col("pred_xpath")).alias("_p"),
    )
    code = lambda name, at: tags.select(F.col("tag").alias(at), F.col("code").alias(name))
    return raw.join(code("obj_tag", "_o"), "_o", "left").join(code("pred_tag", "_p"), "_p", "left").fillna(-1, ["obj_tag", "pred_tag"]).drop("_o", "_p")


def training_set(pairs: DataFrame, seeds: DataFrame, negatives: int = 5, seed: int = 17, by: str | None = None) -> DataFrame:
    """pairs with label 1 (seed pairs) and 0 (other candidates of a seed's object, and for each seed
    up to `negatives` pairs of its template with another object and another predicate, drawn by a seeded hash).

    seeds: page_id, obj_xpath, pred_xpath. The pairs of a template stand in a seeded order, numbered by hash
    range; a seed starts at a seeded place and takes the next ones that differ in object and predicate, looking
    LOOK_AHEAD places on, round the end of the order, and the whole template where that gives too few. So no seed meets
    all pairs of a large template and small ones lose none. `by` names a column of seeds: each of its values gets its
    own training set, and no seed pair is drawn for another one's.
    """
    keys, own = ["page_id", "obj_xpath"], [by] if by else []
    chosen = seeds.select(*keys, F.col("pred_xpath").alias("seed_pred"), *own).distinct()
    of_object = pairs.join(chosen, keys)
    near = of_object.withColumn("label", (F.col("pred_xpath") == F.col("seed_pred")).cast("int")).groupBy("pair_id", "rank", *own).agg(F.max("label").alias("label"))
    pool = pairs.select("template", "pair_id", "rank", "obj_xpath", "pred_xpath")
    if by:
        pool = pool.join(near.filter("label = 1").select("pair_id", "rank").distinct(), ["pair_id", "rank"], "left_anti")
    pool = pool.withColumn("h", F.xxhash64(F.lit(seed), "pair_id", "rank")).withColumn("part", F.shiftrightunsigned("h", 56))
    sizes = pool.groupBy("template", "part").agg(F.count("*").alias("n"))  # at most 256 rows a template
    over = W.partitionBy("template")
    starts = sizes.select(F.col("template").alias("t"), F.col("part").alias("p"), (F.sum("n").over(over.orderBy("part")) - F.col("n")).alias("start"), F.sum("n").over(over).alias("of"))
    inside = F.row_number().over(W.partitionBy("template", "part").orderBy("h", "pair_id", "rank")) - 1
    pool = cut(pool.withColumn("inside", inside).join(starts, F.col("template").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p"))).select(
        "template", "pair_id", "rank", "obj_xpath", "pred_xpath", (F.col("start") + F.col("inside")).alias("place"), "of"))
    totals = pool.groupBy("template").agg(F.max("of").alias("of"))
    seeded = of_object.filter("pred_xpath = seed_pred").select("template", F.col("obj_xpath").alias("so"), F.col("pred_xpath").alias("sp"), F.xxhash64("pair_id", "rank").alias("sid"), *own).distinct()
    seeded = seeded.join(totals.withColumnRenamed("template", "t"), F.col("template").eqNullSafe(F.col("t"))).drop("t").withColumn("begin", F.pmod(F.xxhash64(F.lit(seed), "sid"), F.col("of")))

    def drawn(which: DataFrame, far: int | None) -> DataFrame:
        """Of each seed's next `far` places (None: all) the first `negatives` that differ."""
        if far is None:
            met = which.withColumnRenamed("of", "o").join(pool, "template").withColumn("step", F.pmod(F.col("place") - F.col("begin"), F.col("of")))
        else:
            ahead = which.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(far).cast("long"), F.col("of")) - 1)))
            ahead = ahead.withColumn("place", F.pmod(F.col("begin") + F.col("step"), F.col("of"))).drop("of")
            met = ahead.join(pool.drop("of"), ["template", "place"])
        met = met.filter("obj_xpath <> so and pred_xpath <> sp")
        return met.withColumn("n", F.row_number().over(W.partitionBy("sid", *own).orderBy("step", "pair_id", "rank"))).filter(F.col("n") <= negatives)

    first = cut(drawn(seeded, LOOK_AHEAD).select("sid", *own, "pair_id", "rank"))
    enough = first.groupBy("sid", *own).count().filter(F.col("count") >= negatives).select("sid", *own)
    rest = drawn(seeded.filter(F.col("of") > LOOK_AHEAD).join(enough, ["sid", *own], "left_anti"), None).select("sid", *own, "pair_id", "rank")
    far = first.unionByName(rest).select("pair_id", "rank", *own).distinct().withColumn("label", F.lit(0))
    return near.unionByName(far).groupBy("pair_id", "rank", *own).agg(F.max("label").alias("label"))


def propagate(pairs: DataFrame, vectors: DataFrame, seeds: DataFrame, negatives: int = 5, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(clusters, predictions): one model per cluster of a template's unlabelled rows.

    pairs: rows as in flat_candidates; vectors: their feature_vectors; seeds: page_id, obj_xpath, pred_xpath.
    Objects with a seed are taken out, the others clustered by gated similarity. A seed's training
    rows count for the cluster whose layout it is most similar to; rows of a cluster that no seed
    resembles get no prediction. clusters: template, pair_id, rank, cluster; predictions: pair_id, rank, label.
    """
    keys = ["page_id", "obj_xpath"]
    chosen = seeds.select(*keys, "pred_xpath").distinct()
    marked = pairs.join(chosen, [*keys, "pred_xpath"], "left_semi").withColumn("seed", F.lit(True))
    free = pairs.join(chosen.select(*keys).distinct(), keys, "left_anti").withColumn("seed", F.lit(False))
    found = cut(gated_clusters(marked.unionByName(free)).withColumn("model", F.concat_ws(" ", F.coalesce("template", F.lit("")), "cluster")))
    placed = found.filter("seed").select("pair_id", "rank", "model")
    train = training_set(vectors, vectors.join(placed, ["pair_id", "rank"]).select(*keys, "pred_xpath", "model"), negatives, seed, by="model")
    rows = vectors.join(found.filter("not seed").select("pair_id", "rank", "model"), ["pair_id", "rank"])
    return found.filter("not seed").select("template", "pair_id", "rank", "cluster"), naive_bayes(vectors.join(train, ["pair_id", "rank"]), rows, by="model")


def naive_bayes(train: DataFrame, rows: DataFrame, by: str | None = None) -> DataFrame:
    """rows with the predicted label by Gaussian naive Bayes, one model per group `by` if given.

    Means and variances of a class are one aggregation; variances get 1e-9 of the largest
    feature variance. The class of larger posterior wins, ties the larger label; groups without
    training rows keep no row. Prediction is one join with the small table of models.
    """
    name = by or "_g"
    train = train if by else train.withColumn("_g", F.lit(0))
    rows = rows if by else rows.withColumn("_g", F.lit(0))
    stats = [F.avg(c).alias(f"m_{c}") for c in FEATURES] + [F.var_pop(c).alias(f"v_{c}") for c in FEATURES]
    classes = train.groupBy(name, "label").agg(F.count("*").alias("n"), *stats)
    whole = train.groupBy(name).agg(F.count("*").alias("of"), F.greatest(*(F.var_pop(c) for c in FEATURES)).alias("vmax"))
    models = classes.join(whole, name)
    eps = F.col("vmax") * 1e-9 + 1e-12
    density = sum((-0.5 * F.log(2 * 3.141592653589793 * (F.col(f"v_{c}") + eps)) - F.pow(F.col(c) - F.col(f"m_{c}"), F.lit(2.0)) / (2 * (F.col(f"v_{c}") + eps)) for c in FEATURES), F.log(F.col("n") / F.col("of")))
    scored = rows.join(models, name).select("pair_id", "rank", "label", density.alias("score"))
    return scored.groupBy("pair_id", "rank").agg(F.max(F.struct("score", "label")).alias("best")).select("pair_id", "rank", F.col("best.label").alias("label"))


def select_labels(predicted: DataFrame, pairs: DataFrame) -> DataFrame:
    """New labels: of each object's candidates predicted 1 the first by rank."""
    positive = pairs.join(predicted.filter("label = 1").select("pair_id", "rank"), ["pair_id", "rank"])
    order = W.partitionBy("page_id", "obj_xpath").orderBy("rank", "pair_id")
    return positive.withColumn("n", F.row_number().over(order)).filter("n = 1").select("page_id", "template", "pair_id", "obj_xpath", "obj_text", "pred_xpath", "pred_text")
