"""Counts, contingency, association and interval statistics."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct counts of several columns, one row each.

    Values are unpivoted and de-duplicated before counting, so no task ever holds all
    distinct values of a column.
    """
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    unique = df.select(F.explode(entries).alias("e")).select("e.*").where("value is not null").distinct()
    return unique.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def contingency(df: DataFrame, sections: Mapping[str, Sequence[str]]) -> DataFrame:
    """Several count tables ``(section, key1, key2, n)`` in one scan and one shuffle."""
    null = F.lit(None).cast("string")
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("section"),
                F.col(cols[0]).cast("string").alias("key1"),
                (F.col(cols[1]).cast("string") if len(cols) > 1 else null).alias("key2"),
            )
            for name, cols in sections.items()
        ]
    )
    return (
        df.select(F.explode(entries).alias("e"))
        .groupBy("e.section", "e.key1", "e.key2")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def split_audit(assigned: DataFrame, group: str, stratum: str) -> DataFrame:
    """Members per split and stratum: count plus smallest and largest member."""
    return assigned.groupBy("split", stratum).agg(
        F.count_distinct(group).alias("groups"),
        F.min(group).alias("first_group"),
        F.max(group).alias("last_group"),
    )


def majority_agreement(votes: DataFrame, record: str, vote: str, finals: DataFrame, final: str) -> DataFrame:
    """Share of records whose final label ties for the most votes.

    ``finals`` has one row per record; records without votes are skipped.
    """
    per_label = votes.where(F.col(vote).isNotNull()).groupBy(record, vote).agg(F.count(F.lit(1)).alias("n"))
    best = per_label.groupBy(record).agg(F.max("n").alias("best"))
    mine = (
        finals.select(record, F.col(final).alias(vote)).join(per_label, [record, vote], "left")
        .select(record, F.col("n").alias("mine"))
    )
    joined = best.join(mine, record)
    agree = F.coalesce(F.col("mine") == F.col("best"), F.lit(False))
    n, hits = F.count(F.lit(1)), F.count_if(agree)
    return joined.agg(
        n.alias("records_with_votes"), hits.alias("in_majority"),
        F.try_divide(hits.cast("double"), n.cast("double")).alias("rate"),
    )


def association_audit(df: DataFrame, row: str, col: str, split: str) -> DataFrame:
    """Chi-square, Cramer's V and mutual information of two attributes.

    Empty cells contribute exactly their expected count to chi-square, and all expected
    counts sum to n; so the zero cells add n minus the expected counts of the cells that
    occur, and the full grid is never built.
    """
    base = df.select(F.col(row).alias("r"), F.col(col).alias("c"), F.col(split).alias("s"))
    cells = base.groupBy("r", "c", "s").agg(F.count(F.lit(1)).alias("o"))
    labelled = (
        cells.where(F.coalesce(F.col("c") != "", F.lit(False))).groupBy("r", "c").agg(F.sum("o").alias("o"))
    )
    rows = labelled.groupBy("r").agg(F.sum("o").alias("rt"))
    cols = labelled.groupBy("c").agg(F.sum("o").alias("ct"))
    total = labelled.agg(F.sum("o").cast("double").alias("n"))
    joined = labelled.join(rows, "r").join(cols, "c").withColumn("n", total.scalar())
    o, n = F.col("o").cast("double"), F.col("n")
    product = F.col("rt").cast("double") * F.col("ct").cast("double")
    expected = product / n
    sums = joined.agg(
        F.sum((o - expected) * (o - expected) / expected).alias("seen"),
        F.sum(expected).alias("covered"),
        F.sum(o / n * F.log(o * n / product)).alias("nats"),
        F.max("n").alias("n"),
    )
    prompts = cells.groupBy("r").agg(
        F.sum("o").alias("rows"),
        F.min(F.nullif(F.col("s"), F.lit(""))).alias("first_split"),
        F.max(F.nullif(F.col("s"), F.lit(""))).alias("last_split"),
    ).agg(
        F.sum("rows").alias("sample_count"),
        F.count(F.lit(1)).alias("unique_rows"),
        F.count_if(F.col("first_split") != F.col("last_split")).alias("rows_spanning_splits"),
    )
    labels = cols.agg(F.count(F.lit(1)).alias("k"))
    chi2 = F.coalesce(F.col("seen") + (F.col("n") - F.col("covered")), F.lit(0.0))
    side = F.least(F.col("unique_rows") - 1, F.col("k") - 1)
    return (
        prompts.withColumn("_s", sums.select(F.struct("*")).scalar())
        .withColumn("k", labels.scalar())
        .select("sample_count", "unique_rows", "rows_spanning_splits", "k", "_s.*")
        .select(
            "sample_count", "unique_rows", "rows_spanning_splits",
            chi2.alias("chi_square"),
            F.when((side > 0) & (F.col("n") > 0), F.sqrt(chi2 / (F.col("n") * side)))
            .otherwise(0.0).alias("cramers_v"),
            (F.coalesce("nats", F.lit(0.0)) / F.log(F.lit(2.0))).alias("mutual_information_bits"),
        )
    )


def prompt_profile(df: DataFrame, row: str, attributes: Sequence[str]) -> DataFrame:
    """Counts of each attribute value per prompt ``(prompt, attribute, value, n)``."""
    entries = F.array(
        *[
            F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value"))
            for a in attributes
        ]
    )
    return (
        df.select(F.col(row).alias("prompt"), F.explode(entries).alias("e"))
        .where(F.coalesce(F.col("e.value") != "", F.lit(False)))
        .groupBy("prompt", "e.attribute", "e.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def mean_ci95(value: Column, clamp: bool = True) -> list[Column]:
    """Mean, sample deviation (0 for one value) and normal 95 % interval."""
    mean, n = F.avg(value), F.count(value).cast("double")
    std = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    half = F.lit(1.96) * std / F.sqrt(n)
    low, high = mean - half, mean + half
    if clamp:
        low, high = F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)
    return [
        F.count(value).alias("n"), mean.alias("mean"), std.alias("std"),
        low.alias("ci95_low"), high.alias("ci95_high"),
    ]


def _single(column: str, what: str) -> Column:
    """The one value of a column, or a failed job when several are mixed."""
    return F.when(
        F.min(column) != F.max(column), F.raise_error(f"cannot mix several values of {what}").cast("string")
    ).otherwise(F.min(column))


def seed_aggregate(runs: DataFrame, experiment: str, metrics: Sequence[str]) -> DataFrame:
    """Aggregate compatible seed runs per experiment.

    Needs ``protocol``, ``training_mode`` and ``paper_ready`` columns; mixing protocols or
    modes inside an experiment fails the job.
    """
    entries = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    )
    long = runs.select(
        experiment, F.coalesce("protocol", F.lit("unspecified")).alias("protocol"),
        F.coalesce("training_mode", F.lit("supervised")).alias("training_mode"),
        F.coalesce("paper_ready", F.lit(False)).alias("paper_ready"), F.explode(entries).alias("_e"),
    ).select(experiment, "protocol", "training_mode", "paper_ready", "_e.*")
    required = F.count_if(F.col("value").isNull())
    checked = F.when(required > 0, F.raise_error("a run lacks a metric").cast("boolean")).otherwise(
        (F.count(F.lit(1)) >= 3) & F.bool_and("paper_ready")
    )
    return long.groupBy(experiment, "metric").agg(
        _single("protocol", "protocol").alias("protocol"),
        _single("training_mode", "training_mode").alias("training_mode"),
        checked.alias("paper_ready"),
        *mean_ci95(F.col("value")),
    )


def run_aggregate(
    runs: DataFrame, run: str, protocol_override: str | None = None,
) -> DataFrame:
    """Aggregate long run records ``(run, protocol, synthetic, paper_ready, k, metric, value)``.

    ``k`` is NULL for the headline metrics and the shot count for few-shot ones.  An override
    may name runs without a protocol but never contradict an explicit one.  Runs of several
    protocols or training modes, and runs with different sets of shot counts, are refused;
    ``complete`` tells whether every run reports the metric.
    """
    if protocol_override is not None and not protocol_override.strip():
        raise ValueError("protocol override must not be blank")
    protocol = F.coalesce("protocol", F.lit("unspecified"))
    if protocol_override is not None:
        wanted = protocol_override.strip()
        clash = (protocol != "unspecified") & (protocol != wanted)
        protocol = F.when(
            clash, F.raise_error("protocol override conflicts with an explicit protocol").cast("string")
        ).otherwise(wanted)
    mode = F.col("training_mode") if "training_mode" in runs.columns else F.lit(None).cast("string")
    data = runs.withColumn("protocol", protocol).withColumn("_mode", F.coalesce(mode, F.lit("supervised")))
    per_run = data.groupBy(run).agg(
        F.min("protocol").alias("p0"), F.max("protocol").alias("p1"), F.min("_mode").alias("m0"), F.max("_mode").alias("m1"),
        F.array_join(F.array_sort(F.collect_set("k")), ",").alias("shots"),
    )
    total = per_run.agg(
        F.count(F.lit(1)).alias("runs"), (F.min("p0") == F.max("p1")).alias("one_protocol"),
        (F.min("m0") == F.max("m1")).alias("one_mode"), (F.min("shots") == F.max("shots")).alias("one_set"),
    )
    facts = total.select(F.struct("*").alias("f")).scalar()
    refused = F.lit(None).cast("string")
    for flag, what in (("one_set", "shot counts"), ("one_mode", "training_mode"), ("one_protocol", "protocol")):
        refused = F.when(~F.col("_f")[flag], F.raise_error(f"cannot mix several values of {what}").cast("string")).otherwise(refused)
    data = data.withColumn("_f", facts).withColumn("protocol", F.coalesce(refused, F.col("protocol")))
    summary = data.groupBy("k", "metric").agg(
        F.min("protocol").alias("protocol"), F.max("_f.runs").alias("_runs"),
        F.bool_and(F.coalesce("synthetic", F.lit(False))).alias("synthetic"),
        F.bool_and(F.coalesce("paper_ready", F.lit(False))).alias("paper_ready"),
        *mean_ci95(F.col("value")),
    )
    return summary.withColumn("complete", F.col("n") == F.col("_runs")).drop("_runs")


def early_stopping(history: DataFrame, run: str, epoch: str, score: str, patience: int) -> DataFrame:
    """Best epoch and stopping epoch per run; an improvement is strictly greater."""
    if patience <= 0:
        raise ValueError("patience must be positive")
    before = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    marked = history.withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy(epoch)))
    marked = marked.withColumn(
        "_improves", F.coalesce(F.col(score) > F.max(score).over(before), F.lit(True))
    )
    marked = marked.withColumn("_last", F.max(F.when(F.col("_improves"), F.col("_n"))).over(upto))
    stops = marked.withColumn("_stop", F.when(F.col("_n") - F.col("_last") >= patience, F.col("_n")))
    first_stop = F.min("_stop").over(Window.partitionBy(run))
    kept = stops.withColumn("_end", first_stop).where(
        F.col("_end").isNull() | (F.col("_n") <= F.col("_end"))
    )
    improving = F.when(F.col("_improves"), F.col("_n"))
    return kept.groupBy(run).agg(
        F.max_by(epoch, improving).alias("best_epoch"),
        F.max_by(score, improving).alias("best_score"),
        F.max(epoch).alias("last_epoch"),
        F.max(F.col("_end").isNotNull()).alias("stopped_early"),
    )


def limitations(df: DataFrame, pilot: bool, few_transcripts: int = 20) -> DataFrame:
    """Limitations of a corpus as codes with the value that shows them, one row each."""
    facts = df.agg(
        F.min("language").alias("lang_lo"), F.max("language").alias("lang_hi"),
        F.min("corpus").alias("corpus_lo"), F.max("corpus").alias("corpus_hi"),
    )
    hashes = df.where("transcript <> ''").select(F.sha2("transcript", 256).alias("h")).distinct()
    unique = hashes.agg(F.count(F.lit(1)).alias("n"))
    note = lambda code, value=None: F.struct(
        F.lit(code).alias("limitation"), (F.lit(None) if value is None else value).cast("string").alias("value")
    )
    notes = F.array_compact(
        F.array(
            F.when(F.col("lang_lo") == F.col("lang_hi"), note("one_language", F.col("lang_lo"))),
            F.when(F.col("corpus_lo") == F.col("corpus_hi"), note("one_corpus", F.col("corpus_lo"))),
            F.when(F.lit(pilot), note("pilot")),
            note("one_seed"),
            F.when(F.col("n") <= few_transcripts, note("few_transcripts", F.col("n"))),
            note("not_paper_ready"),
        )
    )
    return facts.withColumn("n", unique.scalar()).select(F.explode(notes).alias("_l")).select("_l.*")


def domain_overlap(df: DataFrame, domain: str, require_unseen: bool = False) -> DataFrame:
    """Per domain the splits it occurs in, and whether the test domains are unseen."""
    per = df.groupBy(domain).agg(
        F.bool_or(F.col("split") == "train").alias("in_train"),
        F.bool_or(F.col("split") == "validation").alias("in_validation"),
        F.bool_or(F.col("split") == "test").alias("in_test"),
    )
    unseen = per.agg(
        (F.bool_or("in_train") & F.bool_or("in_test") & ~F.bool_or(F.col("in_train") & F.col("in_test"))).alias("u")
    )
    flag = F.coalesce(F.col("unseen_test_verified"), F.lit(False))
    if require_unseen:
        flag = F.when(flag, flag).otherwise(
            F.raise_error("train and test domains must be non-empty and disjoint").cast("boolean")
        )
    return per.withColumn("unseen_test_verified", unseen.scalar()).select(
        domain, "in_train", "in_validation", "in_test",
        (F.col("in_train") & F.col("in_validation")).alias("train_validation"),
        (F.col("in_train") & F.col("in_test")).alias("train_test"),
        (F.col("in_validation") & F.col("in_test")).alias("validation_test"),
        flag.alias("unseen_test_verified"),
    )
