"""Labels, boxes, overlaps, summaries and splits of signal metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry, rng


def yolo(start: Column, duration: Column, center: Column, width: Column, sample_rate: Column) -> dict[str, Column]:
    """Box centre and size as fractions of the picture; the highest frequency is at the top."""
    return {"cx": start + duration / 2, "cy": 1 - F.try_divide(sample_rate / 2 + center, sample_rate), "w": duration, "h": F.try_divide(width, sample_rate)}


def collected(df: DataFrame, by: list[str], order: str, label: Column) -> DataFrame:
    """(by, labels): the labels of a sample's components in order, missing ones left out; samples without labels keep an empty list."""
    s = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), label.alias("v"))))
    return df.groupBy(*by).agg(s.alias("s")).select(*by, F.filter(F.transform("s", lambda x: x["v"]), lambda v: v.isNotNull()).alias("labels"))


def unwrapped(labels: Column, single: bool) -> Column:
    """A scalar when samples hold one signal and there is one label, else null (the list stays)."""
    return F.when(F.lit(single) & (F.size(labels) == 1), F.get(labels, F.lit(0)))


def padded_batches(df: DataFrame, batch: Column, labels: str = "labels", fill: float = 0.0) -> DataFrame:
    """Ragged label lists padded to the longest of their batch."""
    d = df.withColumn("batch", batch)
    longest = F.max(F.size(labels)).over(Window.partitionBy("batch"))
    return d.withColumn(labels, F.concat(F.col(labels), F.array_repeat(F.lit(fill), longest - F.size(labels))))


def overlap_pairs(boxes: DataFrame, by: list[str], number: str, tile: float, literal: bool = True) -> DataFrame:
    """(by, a, b): pairs of boxes of one sample that overlap, a before b.

    Boxes are put into time tiles and meet only in tiles they share; a pair counts in the tile in which
    the later of the two begins, so nothing has to be removed again and no sample is a cross product.
    Null corners never overlap.  literal: by crossing sides or containment, else by shared points.
    """
    t = lambda c: F.floor(F.col(c) / tile)
    d = boxes.where(F.col("x0").isNotNull() & F.col("x1").isNotNull() & F.col("y0").isNotNull() & F.col("y1").isNotNull())
    d = d.select(*by, number, "x0", "y0", "x1", "y1", t("x0").alias("t0"), F.explode(F.sequence(t("x0"), F.greatest(t("x0"), t("x1")))).alias("tile"))
    a, b = d.alias("a"), d.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*by, "tile"]]
    box = lambda s: {c: F.col(f"{s}.{c}") for c in ("x0", "y0", "x1", "y1")}
    cond = (F.col(f"a.{number}") < F.col(f"b.{number}")) & geometry.closed_overlap(box("a"), box("b")) & (F.col("a.tile") == F.greatest("a.t0", "b.t0"))
    if literal:
        cond = cond & geometry.side_overlap(box("a"), box("b"))
    for o in on:
        cond = cond & o
    return a.join(b, cond).select(*[F.col(f"a.{k}").alias(k) for k in by], F.col(f"a.{number}").alias("a"), F.col(f"b.{number}").alias("b"))


def without_earlier_overlap(boxes: DataFrame, by: list[str], number: str, tile: float) -> DataFrame:
    """Boxes that no earlier box of their sample overlaps."""
    hit = overlap_pairs(boxes, by, number, tile).select(*by, F.col("b").alias(number)).distinct()
    return boxes.join(hit, [*by, number], "left_anti")


def class_table(names: DataFrame, name: str = "class_name") -> DataFrame:
    """(class_index, class_name): classes in alphabetical order, numbered from 0."""
    d = names.where(F.col(name).isNotNull()).select(F.lower(F.trim(name)).alias("class_name")).distinct()
    # the classes, not the rows, are ordered here
    return d.select((F.row_number().over(Window.orderBy("class_name")) - 1).alias("class_index"), "class_name")


def probabilities(generators: DataFrame, likelihood: str = "likelihood", order: str = "generator_id") -> DataFrame:
    """Adds p = likelihood / sum and the interval [low, high) of the cumulative probability."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = generators.join(F.broadcast(generators.agg(F.sum(likelihood).alias("_all")))).withColumn("p", F.col(likelihood) / F.col("_all")).drop("_all")
    return d.withColumn("high", F.sum("p").over(w)).withColumn("low", F.col("high") - F.col("p"))


def draw_generator(rows: DataFrame, generators: DataFrame, key: str, seed: int = 0, order: str = "generator_id") -> DataFrame:
    """Each row with the generator whose interval its draw falls into.

    Intervals and draws meet in cells of the unit range, an equi-join: an interval has a row in each cell it touches, so the
    generators grow by at most ``cells`` rows and a row meets only the intervals of its cell.
    """
    cells = 4096
    g = probabilities(generators, order=order)
    top = g.agg(F.max("high").alias("_top"))
    at = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1)).cast("int")
    g = g.withColumn("_cell", F.explode(F.sequence(at(F.col("low")), at(F.col("high")))))
    d = rows.withColumn("_u", rng.uniform(seed, "generator", key)).join(F.broadcast(top)).withColumn("_u", F.least("_u", F.col("_top") * (1 - 1e-15))).withColumn("_cell", at(F.col("_u")))
    return d.join(g, "_cell").where((F.col("_u") >= F.col("low")) & (F.col("_u") < F.col("high"))).drop("_u", "_top", "_cell")


def inherit(child: DataFrame, parents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """child with missing values of ``columns`` taken from its parent row (parents: key and the same columns)."""
    p = parents.select(key, *[F.col(c).alias(f"_p_{c}") for c in columns])
    d = child.join(p, key, "left")
    return d.withColumns({c: F.coalesce(c, f"_p_{c}") for c in columns}).drop(*[f"_p_{c}" for c in columns])


def class_counts(df: DataFrame, name: str = "class_name") -> DataFrame:
    """(class_name, n); missing names are a class of their own (null)."""
    return df.groupBy(F.lower(F.trim(name)).alias("class_name")).agg(F.count(F.lit(1)).alias("n"))


def rollup_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n): counts at every level of the columns, from all of them down to the whole."""
    return df.rollup(*by).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, n) of equal-width bins between minimum and maximum, the last one closed; empty bins have no row.

    If all values are equal the range is the value +- 0.5.  Null, NaN and infinite values are left out.
    The limits are one row, broadcast; counts are combined before the shuffle.
    """
    x = F.col(column).cast("double")
    d = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < F.lit(float("inf"))))
    lim = d.agg(F.min("x").alias("a"), F.max("x").alias("b")).select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"))
    at = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    d = d.join(F.broadcast(lim)).groupBy(at.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    edge = lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / bins
    return d.select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), "n")


def summary(df: DataFrame, by: str = "sample_id", bins: int | dict = 50, metrics=("center_freq", "bandwidth", "duration", "snr_db")) -> dict[str, DataFrame]:
    """Class counts, a histogram a metric and the signals per sample; an empty dataset raises ValueError."""
    if not df.limit(1).count():
        raise ValueError("the dataset is empty")
    out = {"class_counts": class_counts(df)}
    for m in metrics:
        out[m] = histogram(df, m, bins.get(m, 50) if isinstance(bins, dict) else bins)
    out["signals_per_sample"] = signals_per_sample(df, by)
    return out


def signals_per_sample(df: DataFrame, by: str = "sample_id") -> DataFrame:
    """(n_signals, n_samples)"""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_signals")).groupBy("n_signals").agg(F.count(F.lit(1)).alias("n_samples"))


def split(df: DataFrame, key: str, fractions: dict[str, float], seed: int = 0) -> DataFrame:
    """Adds ``part``: a reproducible split by a hash of the key; fractions must sum to 1."""
    if abs(sum(fractions.values()) - 1) > 1e-9:
        raise ValueError("fractions must sum to 1")
    u, out, edge = rng.uniform(seed, "split", key), None, 0.0
    for name, f in list(fractions.items())[:-1]:
        edge += f
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    last = list(fractions)[-1]
    return df.withColumn("part", F.lit(last) if out is None else out.otherwise(last))
