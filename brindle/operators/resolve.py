"""Which catalogue product a review means: by id, by canonical key, by a model key of one product, else by similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import identity as idn


def similar(asked: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(asked, cid, s): for each distinct text asked the name (cid, name) that is most like it, if its ratio is `least` or more; ties by cid.

    Two texts of five letters or more together whose ratio is over .8 share two neighbouring letters: were all
    matching blocks single letters, there would be more gaps between them than letters that don't match. So only texts with a
    pair of letters in common are compared, whatever their brands, and only those whose lengths allow the ratio.
    """
    if least <= 0.8:
        raise ValueError("a ratio of .8 or less can't be found by pairs of letters")
    n = F.col("n")
    pairs = F.when(F.char_length(n) < 2, F.array(n)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(n) - 1, F.lit(1))), lambda i: F.substr(n, i, F.lit(2)))))
    a = asked.where("asked is not null").distinct().withColumn("n", idn.name(F.col("asked"))).where("n <> ''").select("asked", n.alias("left"), F.explode(pairs).alias("pair"))
    b = names.where("name is not null").withColumn("n", idn.name(F.col("name"))).where("n <> ''").select("cid", n.alias("right"), F.explode(pairs).alias("pair"))
    x, y = F.char_length("left"), F.char_length("right")
    met = a.join(b, "pair").where(2 * F.least(x, y) >= least * (x + y)).select("asked", "left", "cid", "right").distinct()
    scored = met.select("asked", "cid", idn.ratio("left", "right").alias("s")).where(F.col("s") >= least)
    best = F.row_number().over(W.partitionBy("asked").orderBy(F.desc("s"), "cid"))
    return scored.withColumn("k", best).where("k = 1").drop("k")


def resolve(rows: DataFrame, catalogue: DataFrame, least: float = 0.82, name: str = "product_name", brand: str = "brand", given: str = "product_id") -> DataFrame:
    """Adds resolved_id, match_kind and match_score.

    Only names that no equi join resolves are compared by similarity, each distinct name once. A catalogue id that repeats counts once.
    """
    cat = catalogue.select(F.col("product_id").alias("cid"), "product_name", "brand").dropDuplicates(["cid", "product_name", "brand"])
    cat = idn.with_identity(cat, "product_name", "brand", out="i").select("cid", "i.brand", "i.model_key", "i.canonical_key")
    r = idn.with_identity(rows, name, brand, out="__i")
    by_id = cat.select(F.col("cid").alias("id_hit")).distinct()
    by_key = cat.groupBy("canonical_key").agg(F.min("cid").alias("key_hit"))
    by_model = cat.where(F.col("model_key") != "unknown_model").groupBy("model_key").agg(F.min("cid").alias("model_hit"), F.countDistinct("cid").alias("n")).where("n = 1").drop("n")
    r = r.join(by_id, r[given] == by_id.id_hit, "left").join(by_key, F.col("__i.canonical_key") == by_key.canonical_key, "left").join(by_model, F.col("__i.model_key") == by_model.model_key, "left").drop("canonical_key", "model_key")
    hit = F.coalesce("id_hit", "key_hit", "model_hit")
    best = similar(r.where(hit.isNull()).select(F.col("__i.canonical_key").alias("asked")), cat.select("cid", F.col("canonical_key").alias("name")), least).withColumnRenamed("cid", "near_hit")
    r = r.join(best, F.col("__i.canonical_key") == best.asked, "left").drop("asked")
    kind = F.when(F.col("id_hit").isNotNull(), "id").when(F.col("key_hit").isNotNull(), "canonical_key").when(F.col("model_hit").isNotNull(), "model_key").when(F.col("near_hit").isNotNull(), "similarity").otherwise("unresolved")
    score = F.when(hit.isNotNull(), 1.0).otherwise(F.col("s"))
    return r.withColumn("resolved_id", F.coalesce(hit, F.col("near_hit"))).withColumn("match_kind", kind).withColumn("match_score", score).drop("__i", "id_hit", "key_hit", "model_hit", "near_hit", "s")
