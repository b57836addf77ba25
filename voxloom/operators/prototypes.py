"""Class prototypes, nearest-prototype prediction and episode losses."""

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.vectors import as_double, dot, l2_normalize, let, score

#: Bytes of one group's prototypes that a task may hold next to its rows.
PROTOTYPE_BYTES = 256 << 20


def class_prototypes(df: DataFrame, label: str, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """Element-wise mean vector per class, per episode when ``by`` names one."""
    v = array_to_vector(as_double(F.col(vector)))
    return df.groupBy(*by, label).agg(
        vector_to_array(Summarizer.mean(v)).alias("prototype"), F.count(F.lit(1)).alias("support")
    )


def prototype_list(prototypes: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Prototypes of a group as one sorted array.

    Its size is the class vocabulary times the dimension; beyond ``PROTOTYPE_BYTES`` the job
    fails rather than ship such an array to every task.
    """
    listed = F.sort_array(F.collect_list(F.struct(F.col(label).alias("class"), F.col("prototype"), l2_normalize(F.col("prototype")).alias("unit"))))
    grouped = prototypes.groupBy(*by).agg(listed.alias("prototypes"))
    width = F.coalesce(F.size(F.element_at("prototypes", 1)["prototype"]), F.lit(0)).cast("bigint")
    fits = F.when(F.size("prototypes") * width * 8 <= PROTOTYPE_BYTES, True).otherwise(
        F.raise_error(f"prototypes of more than {PROTOTYPE_BYTES} bytes").cast("boolean")
    )
    return grouped.where(fits)


def attach_prototypes(
    queries: DataFrame, prototypes: DataFrame, label: str, by: Sequence[str] = (),
) -> DataFrame:
    """Put the prototypes a query is compared with next to it.

    Without ``by`` they are one scalar subquery (classes x dimension values), so the
    query side is neither shuffled nor multiplied; with ``by`` it is an equi-join on the
    episode.
    """
    listed = prototype_list(prototypes, label, by)
    if by:
        return queries.join(listed, list(by))
    return queries.withColumn("prototypes", listed.scalar())


def logits(vector: Column, distance: str = "cosine", temperature: float = 0.1) -> Column:
    """Array of ``(logit, class)`` against the attached prototypes, in class order.

    For the cosine both sides come at unit length (see :func:`attach_prototypes`), so a
    pair costs one product.
    """
    if distance == "cosine":
        if temperature <= 0:
            raise ValueError("temperature must be positive")
        return let(
            l2_normalize(vector),
            lambda q: F.transform(
                F.col("prototypes"),
                lambda p: F.struct((dot(q, p["unit"]) / F.lit(float(temperature))).alias("logit"), p["class"].alias("class")),
            ),
        )
    return F.transform(
        F.col("prototypes"),
        lambda p: F.struct(score(vector, p["prototype"], distance, temperature).alias("logit"), p["class"].alias("class")),
    )


def argmax_class(scored: Column) -> Column:
    """Class of the highest logit; ties go to the lowest class."""
    best = F.array_max(F.transform(scored, lambda s: F.struct(s["logit"], (-s["class"]).alias("c"))))
    return -best["c"]


def nearest_prototype(
    queries: DataFrame, prototypes: DataFrame, label: str, vector: str,
    by: Sequence[str] = (), distance: str = "cosine", temperature: float = 0.1,
) -> DataFrame:
    """Queries with ``prediction`` and the cross-entropy ``loss`` of their own label."""
    attached = attach_prototypes(queries, prototypes, label, by)
    scored = attached.withColumn("_scored", logits(F.col(vector), distance, temperature))
    values = F.transform("_scored", lambda s: s["logit"])
    own = F.element_at(F.filter("_scored", lambda s: s["class"] == F.col(label)), 1)["logit"]
    checked = F.when(
        F.exists("_scored", lambda s: s["class"] == F.col(label)), log_sum_exp(values) - own
    )
    return scored.withColumn("prediction", argmax_class(F.col("_scored"))).withColumn(
        "loss", checked
    ).drop("_scored", "prototypes")


def log_sum_exp(values: Column) -> Column:
    return let(
        F.array_max(values),
        lambda m: m + F.log(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))),
    )


def prototype_loss(predicted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean cross-entropy; a query class without support fails the job."""
    loss = F.when(F.col("loss").isNotNull(), F.col("loss")).otherwise(
        F.raise_error("query class is absent from the support set").cast("double")
    )
    return predicted.groupBy(*by).agg(F.avg(loss).alias("prototype_loss"), F.count(F.lit(1)).alias("queries"))


def contrastive_anchors(
    members: DataFrame, episode: str, sample_id: str, label: str, vector: str, temperature: float,
) -> DataFrame:
    """Supervised contrastive terms per anchor of an episode.

    An episode has n_way * (k + q) members by construction, so each anchor carries its
    episode's members as one short array; pairs are never emitted as rows.
    """
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    unit = members.select(
        episode, sample_id, label, l2_normalize(as_double(F.col(vector))).alias("_u")
    )
    grouped = unit.groupBy(episode).agg(
        F.collect_list(F.struct(F.col(sample_id).alias("id"), F.col(label).alias("y"), F.col("_u").alias("u"))).alias("_all")
    )
    anchors = unit.join(grouped, episode)
    sims = F.transform(
        "_all",
        lambda m: F.struct(
            (dot(F.col("_u"), m["u"]) / F.lit(float(temperature))).alias("s"),
            (m["id"] != F.col(sample_id)).alias("other"),
            (m["y"] == F.col(label)).alias("same"),
        ),
    )
    scored = anchors.select(episode, sample_id, label, sims.alias("_s"))
    scored = scored.withColumn("_m", F.array_max(F.transform("_s", lambda x: x["s"])))
    denom = F.aggregate(
        "_s", F.lit(0.0),
        lambda acc, x: acc + F.when(x["other"], F.exp(x["s"] - F.col("_m"))).otherwise(0.0),
    )
    positives = F.filter("_s", lambda x: x["other"] & x["same"])
    scored = scored.withColumn("_d", F.log(F.greatest(denom, F.lit(1e-12)))).withColumn("_p", positives)
    total = F.aggregate("_p", F.lit(0.0), lambda acc, x: acc + (x["s"] - F.col("_m") - F.col("_d")))
    best = F.array_max(F.transform(F.filter("_s", lambda x: x["other"]), lambda x: x["s"]))
    return scored.select(
        episode, sample_id, label,
        (F.size("_s") - 1).alias("others"), F.size("_p").alias("positives"),
        (best * F.lit(float(temperature))).alias("max_similarity"),
        F.when(F.size("_p") > 0, total / F.size("_p")).alias("mean_log_prob"),
    )


def contrastive_loss(anchors: DataFrame, episode: str) -> DataFrame:
    """Mean over anchors that have a positive; zero when none has."""
    return anchors.groupBy(episode).agg(
        F.coalesce(-F.avg("mean_log_prob"), F.lit(0.0)).alias("contrastive_loss"),
        F.count_if(F.col("positives") > 0).alias("valid_anchors"),
    )
