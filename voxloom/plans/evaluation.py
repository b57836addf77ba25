"""Queries on classification metrics, episodes, run aggregation and classifiers."""

from pyspark.sql import functions as F

from voxloom.operators import assemble, episodes, metrics, pooling, prototypes, stats
from voxloom.operators.classifier import conditioned_features as conditioned
from voxloom.operators.classifier import train_classifier
from voxloom.plans.bindings import manifest, table, vector_examples
from voxloom.plans.registry import query
from voxloom.plans.sql import EXAMPLES, LONG, M, PREDICTIONS, ci95, hash_int, metrics_sql, ordinary_slots, r6
from voxloom.plans.vectors import BLOCK_DIMS, CLASSES, masked_blocks, predictions, with_weights, _SOFT_SQL
from voxloom.schemas import EMOTION_LABELS, MODALITIES

R = F.round
_CI = ("mean", "std", "ci95_low", "ci95_high")
_RATES = ("recall", "precision", "f1")
_SCORES = ("uar", "macro_f1", "accuracy")


def _rounded(df, keep, rounded):
    return df.select(*keep, *[R(c, 6).alias(c) for c in rounded])


# ---- classification metrics ------------------------------------------------------------


@query(
    "confusion_matrix",
    f"""WITH {PREDICTIONS}, g AS (SELECT t::INT AS target, p::INT AS prediction FROM range({CLASSES}) a(t), range({CLASSES}) b(p))
    SELECT g.target, g.prediction, count(preds.sample_id) AS n FROM g LEFT JOIN preds ON preds.label = g.target AND preds.prediction = g.prediction GROUP BY 1, 2""",
)
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(predictions(spark, d), "label", "prediction", CLASSES)


@query(
    "per_class_metrics",
    f"""WITH {PREDICTIONS}, {metrics_sql('preds', [], CLASSES)} SELECT class, support, predicted, tp, {r6('recall')} AS recall,
      {r6('precision')} AS precision, {r6('f1')} AS f1 FROM per_class""",
)
def per_class_metrics(spark, d):
    out = metrics.per_class_metrics(predictions(spark, d), "label", "prediction", CLASSES)
    return _rounded(out, ["class", "support", "predicted", "tp"], _RATES)


_SCORES_SQL = f"{r6('avg(recall)')} AS uar, {r6('avg(f1)')} AS macro_f1, {r6('sum(tp)::DOUBLE / sum(support)')} AS accuracy, sum(support)::BIGINT AS n"


@query("classification_metrics", f"WITH {PREDICTIONS}, {metrics_sql('preds', [], CLASSES)} SELECT {_SCORES_SQL} FROM per_class")
def classification_metrics(spark, d):
    return _rounded(metrics.classification_metrics(predictions(spark, d), "label", "prediction", CLASSES), ["n"], _SCORES)


_SLICED_SQL = """sl AS (SELECT 'language' AS slice_dim, language AS slice_value, label, prediction FROM preds
    UNION ALL SELECT 'speaker', speaker_id, label, prediction FROM preds
    UNION ALL SELECT 'country', 'unknown', label, prediction FROM preds)"""


@query(
    "sliced_metrics",
    f"""WITH {PREDICTIONS}, {_SLICED_SQL}, {metrics_sql('sl', ['slice_dim', 'slice_value'], CLASSES)}
    SELECT slice_dim, slice_value, {_SCORES_SQL} FROM per_class GROUP BY 1, 2""",
)
def sliced_metrics(spark, d):
    dims = {"language": F.col("language"), "speaker": F.col("speaker_id"), "country": F.lit(None).cast("string")}
    out = metrics.sliced_metrics(predictions(spark, d), "label", "prediction", CLASSES, dims)
    return _rounded(out, ["slice_dim", "slice_value", "n"], _SCORES)


@query(
    "diagnostic_flags",
    f"""WITH {PREDICTIONS}, {metrics_sql('preds', [], CLASSES)}, s AS (SELECT sample_id, [1.0::DOUBLE, (sample_id % 2)::DOUBLE / 100, (sample_id % 3)::DOUBLE / 100] AS w FROM ex),
    g AS (SELECT avg(w[1] / list_sum(w)) AS wa FROM s)
    SELECT 'zero_recall_class' AS flag, class::VARCHAR AS value, 0.0::DOUBLE AS measure FROM per_class WHERE recall = 0
    UNION ALL SELECT 'dominant_modality', 'audio', {r6('wa')} FROM g WHERE wa > 0.7""",
)
def diagnostic_flags(spark, d):
    per_class = metrics.per_class_metrics(predictions(spark, d), "label", "prediction", CLASSES)
    k = F.col("sample_id")
    raw = [F.lit(1.0), (k % 2).cast("double") / 100, (k % 3).cast("double") / 100]
    total = raw[0] + raw[1] + raw[2]
    weights = vector_examples(spark, d).agg(*[F.avg(w / total).alias(f"w_{m}") for w, m in zip(raw, MODALITIES)])
    out = metrics.diagnostic_flags(per_class, weights, MODALITIES)
    return out.select("flag", "value", R("measure", 6).alias("measure"))


# ---- stress evaluation -----------------------------------------------------------------

_SCENARIOS = [("all", MODALITIES)] + [("+".join(s), s) for s in assemble.stress_scenarios(MODALITIES)]


def _scenario_rows():
    rows = ", ".join(
        "('" + name + "', [" + ", ".join(str(int(m in s)) for m in MODALITIES) + "])" for name, s in _SCENARIOS
    )
    return f"(VALUES {rows}) sc(scenario, allowed)"


@query(
    "modality_stress",
    f"""WITH {EXAMPLES}, {LONG},
    mk AS (SELECT sample_id, label, split, [[1,1,1],[1,1,0],[1,0,1],[0,1,1],[1,0,0],[0,1,0],[0,0,1]][sample_id % 7 + 1] AS mask FROM ex),
    b AS (SELECT l.*, CASE WHEN pos < 32 THEN 1 WHEN pos < 48 THEN 2 ELSE 3 END AS b FROM long l),
    f AS (SELECT b.*, CASE WHEN mask[b.b] = 1 THEN x ELSE 0 END AS fx FROM b JOIN mk USING (sample_id)),
    proto AS (SELECT label AS cls, pos, avg(fx) AS m FROM f WHERE split = 'train' GROUP BY 1, 2),
    pn AS (SELECT cls, greatest(sqrt(sum(m * m)), 1e-12) AS pn FROM proto GROUP BY 1),
    sc AS (SELECT * FROM {_scenario_rows()}),
    act AS (SELECT scenario, sample_id, label, [mask[1] * allowed[1], mask[2] * allowed[2], mask[3] * allowed[3]] AS am FROM mk, sc WHERE split = 'test'),
    live AS (SELECT * FROM act WHERE list_sum(am) > 0),
    q AS (SELECT scenario, live.sample_id, live.label, pos, CASE WHEN am[b.b] = 1 THEN x ELSE 0 END AS fx FROM live JOIN b ON b.sample_id = live.sample_id),
    qn AS (SELECT scenario, sample_id, greatest(sqrt(sum(fx * fx)), 1e-12) AS qn FROM q GROUP BY 1, 2),
    s AS (SELECT scenario, sample_id, any_value(label) AS label, cls, sum(fx * m) AS d FROM q JOIN proto USING (pos) GROUP BY 1, 2, 4),
    pr AS (SELECT s.scenario, s.sample_id, any_value(s.label) AS label, arg_max(s.cls, d / (qn * pn)) AS prediction FROM s JOIN pn USING (cls) JOIN qn USING (scenario, sample_id) GROUP BY 1, 2),
    {metrics_sql('pr', ['scenario'], CLASSES)},
    gone AS (SELECT scenario, count(*) FILTER (WHERE list_sum(am) = 0) AS without_input FROM act GROUP BY 1)
    SELECT scenario, {_SCORES_SQL}, any_value(without_input) AS without_input FROM per_class JOIN gone USING (scenario) GROUP BY 1""",
)
def modality_stress(spark, d):
    ex = masked_blocks(vector_examples(spark, d).withColumnRenamed("vector", "v"), "sample_id")
    blocks = [F.col(c) for c in ("b_audio", "b_text", "b_visual")]
    train = ex.where("split = 'train'").select(
        "label", pooling.masked_concat(blocks, F.col("modality_mask"), BLOCK_DIMS).alias("vector")
    )
    protos = prototypes.class_prototypes(train, "label", "vector")
    scenarios = F.array(
        *[
            F.struct(F.lit(name).alias("scenario"), assemble.modality_subset(F.col("modality_mask"), s).alias("mask"))
            for name, s in _SCENARIOS
        ]
    )
    forced = ex.where("split = 'test'").select("sample_id", "label", "b_audio", "b_text", "b_visual", F.explode(scenarios).alias("s"))
    forced = forced.select("*", "s.scenario", "s.mask").withColumn("active", F.exists("mask", lambda m: m))
    fused = forced.where("active").withColumn("vector", pooling.masked_concat(blocks, F.col("mask"), BLOCK_DIMS))
    preds = prototypes.nearest_prototype(fused, protos, "label", "vector")
    scores = metrics.classification_metrics(preds, "label", "prediction", CLASSES, ["scenario"])
    lost = forced.groupBy("scenario").agg(F.count_if(~F.col("active")).alias("without_input"))
    return _rounded(scores.join(lost, "scenario"), ["scenario", "n", "without_input"], _SCORES)


# ---- episodes --------------------------------------------------------------------------


def _emotion_examples(spark, d, task="language"):
    from voxloom.operators.labels import label_index

    m = label_index(manifest(spark, d), "emotion", EMOTION_LABELS, "label")
    return m.select(episodes.task_key(task).alias("task"), "label", "speaker_id", "sample_id")


_EXS = """exs AS (SELECT language AS task, CASE emotion WHEN 'angry' THEN 0 WHEN 'happy' THEN 1 WHEN 'neutral' THEN 2 ELSE 3 END AS label, speaker_id, sample_id FROM m)"""
_ORDINARY = f"{M}, {_EXS}, {ordinary_slots(3, 2, 3, 30)}"


@query("episodes_ordinary", f"WITH {_ORDINARY} SELECT episode, task, label, role, sample_id, speaker_id FROM mem")
def episodes_ordinary(spark, d):
    out = episodes.ordinary_episodes(_emotion_examples(spark, d), 3, 2, 3, 30)
    return out.select("episode", "task", "label", "role", "sample_id", "speaker_id")


def _disjoint_sql(n_way=2, k=1, q=2, total=30, seed=17):
    masks = episodes._class_masks(4, n_way)
    values = ", ".join(f"({m})" for m in masks)

    def h(*parts):
        return hash_int(f"'{seed}:' || " + " || ':' || ".join(parts))

    def slots(n, m, most):
        key = ("episode::VARCHAR", "label::VARCHAR", "role")
        return f"1 + ({h(*key, chr(39) + 'start' + chr(39))} % {n} + slot * (1 + {h(*key, chr(39) + 'stride' + chr(39))} % greatest(1, ({n} - 1) // {most}))) % {n}"

    return f"""{M}, {_EXS.replace('language AS task', 'corpus AS task')},
    c AS (SELECT task, speaker_id, label, count(*) AS n FROM exs GROUP BY 1, 2, 3),
    sm AS (SELECT task, speaker_id, sum(CASE WHEN n >= {k} THEN 1 << label ELSE 0 END)::BIGINT AS s_mask, sum(CASE WHEN n >= {q} THEN 1 << label ELSE 0 END)::BIGINT AS q_mask FROM c GROUP BY 1, 2),
    sets AS (SELECT v AS class_set FROM (VALUES {values}) t(v)),
    cand AS (SELECT task, class_set, speaker_id, (s_mask & class_set) = class_set AS s, (q_mask & class_set) = class_set AS q FROM sm, sets),
    st AS (SELECT task, class_set, count(*) FILTER (WHERE s) AS n_s, count(*) FILTER (WHERE q) AS n_q, count(*) FILTER (WHERE s AND q) AS n_b FROM cand GROUP BY 1, 2),
    elig AS (SELECT * FROM st WHERE n_s > 0 AND n_q > 0 AND NOT (n_s = 1 AND n_q = 1 AND n_b = 1)),
    setno AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY class_set) - 1 AS set_no, count(*) OVER (PARTITION BY task) AS n_sets FROM elig),
    tasks AS (SELECT task, row_number() OVER (ORDER BY sha256('{seed}:' || task), task) AS task_no FROM (SELECT DISTINCT task FROM elig)),
    epi AS (SELECT i AS episode, 1 + {h("i::VARCHAR", "'task'")} % (SELECT count(*) FROM tasks) AS task_no FROM range({total}) t(i)),
    chosen AS (SELECT e.episode, s.task, s.class_set, s.n_s, s.n_q FROM epi e JOIN tasks USING (task_no) JOIN setno s USING (task)
      WHERE s.set_no = {h("e.episode::VARCHAR", "'classes'")} % s.n_sets),
    sr AS (SELECT task, class_set, speaker_id, row_number() OVER (PARTITION BY task, class_set ORDER BY sha256('{seed}:' || speaker_id || ':s_rank'), speaker_id) AS s_rank FROM cand WHERE s),
    qr AS (SELECT task, class_set, speaker_id, row_number() OVER (PARTITION BY task, class_set ORDER BY sha256('{seed}:' || speaker_id || ':q_rank'), speaker_id) AS q_rank FROM cand WHERE q),
    rk AS (SELECT * FROM sr FULL JOIN qr USING (task, class_set, speaker_id)),
    a1 AS (SELECT c.*, r.speaker_id AS s_speaker, r.q_rank AS skip FROM chosen c JOIN rk r ON r.task = c.task AND r.class_set = c.class_set
      AND r.s_rank = 1 + {h("c.episode::VARCHAR", "'s'")} % c.n_s WHERE c.n_q > 1),
    a2 AS (SELECT *, 1 + {h("episode::VARCHAR", "'q'")} % (n_q - (skip IS NOT NULL)::INT) AS p FROM a1),
    a3 AS (SELECT a2.*, r.speaker_id AS q_speaker FROM a2 JOIN rk r ON r.task = a2.task AND r.class_set = a2.class_set AND r.q_rank = p + coalesce((p >= skip)::INT, 0)),
    b1 AS (SELECT c.*, r.speaker_id AS q_speaker, r.s_rank AS skip FROM chosen c JOIN rk r ON r.task = c.task AND r.class_set = c.class_set AND r.q_rank = 1 WHERE c.n_q = 1),
    b2 AS (SELECT *, 1 + {h("episode::VARCHAR", "'s'")} % (n_s - (skip IS NOT NULL)::INT) AS p FROM b1),
    b3 AS (SELECT b2.*, r.speaker_id AS s_speaker FROM b2 JOIN rk r ON r.task = b2.task AND r.class_set = b2.class_set AND r.s_rank = p + coalesce((p >= skip)::INT, 0)),
    pairs AS (SELECT episode, task, class_set, s_speaker, q_speaker FROM a3 UNION ALL SELECT episode, task, class_set, s_speaker, q_speaker FROM b3),
    asks AS (SELECT episode, task, l AS label, s_speaker AS speaker_id, 'support' AS role, {k} AS m FROM pairs, range(4) t(l) WHERE (class_set & (1 << l)) <> 0
      UNION ALL SELECT episode, task, l, q_speaker, 'query', {q} FROM pairs, range(4) t(l) WHERE (class_set & (1 << l)) <> 0),
    wanted AS (SELECT a.episode, a.task, a.speaker_id, a.label, a.role, {slots('c.n', 'a.m', max(k, q) - 1).replace('episode::', 'a.episode::').replace('label::', 'a.label::').replace("|| role", "|| a.role")} AS rn
      FROM asks a JOIN c ON c.task = a.task AND c.speaker_id = a.speaker_id AND c.label = a.label, range({max(k, q)}) s(slot) WHERE slot < a.m),
    rank_ AS (SELECT *, row_number() OVER (PARTITION BY task, speaker_id, label ORDER BY sha256('{seed}:' || sample_id), sample_id) AS rn FROM exs),
    mem AS (SELECT w.episode, r.task, r.label, w.role, r.sample_id, r.speaker_id FROM wanted w JOIN rank_ r ON r.task = w.task AND r.speaker_id = w.speaker_id AND r.label = w.label AND r.rn = w.rn)"""


@query("episodes_disjoint", f"WITH {_disjoint_sql()} SELECT episode, task, label, role, sample_id, speaker_id FROM mem")
def episodes_disjoint(spark, d):
    out = episodes.disjoint_episodes(_emotion_examples(spark, d, "corpus"), 4, 2, 1, 2, 30)
    return out.select("episode", "task", "label", "role", "sample_id", "speaker_id")


@query(
    "eligible_tasks",
    f"""WITH {_disjoint_sql()}, o AS (SELECT task, label FROM exs GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT 'ordinary' AS mode, task, count(*) AS choices FROM o GROUP BY 2 HAVING count(*) >= 2
    UNION ALL SELECT 'speaker_disjoint', task, count(*) FROM elig GROUP BY 2""",
)
def eligible_tasks(spark, d):
    ex = _emotion_examples(spark, d, "corpus")
    plain = episodes.eligible_tasks(ex, 2, 1, 2).select(
        F.lit("ordinary").alias("mode"), "task", F.size("classes").cast("bigint").alias("choices")
    )
    sets = episodes.eligible_class_sets(ex, 4, 2, 1, 2).groupBy("task").agg(F.count(F.lit(1)).alias("choices"))
    return plain.unionByName(sets.select(F.lit("speaker_disjoint").alias("mode"), "task", "choices"))


@query(
    "episode_audit",
    f"""WITH {_ORDINARY}, s AS (SELECT episode, sample_id, count(*) FILTER (WHERE role = 'support') AS s, count(*) FILTER (WHERE role = 'query') AS q FROM mem GROUP BY 1, 2),
    p AS (SELECT episode, speaker_id, bool_or(role = 'support') AND bool_or(role = 'query') AS b FROM mem GROUP BY 1, 2),
    c AS (SELECT episode, label, count(*) FILTER (WHERE role = 'support') AS s, count(*) FILTER (WHERE role = 'query') AS q FROM mem GROUP BY 1, 2),
    s2 AS (SELECT episode, count(*) FILTER (WHERE s > 0 AND q > 0) AS sample_overlap, count(*) FILTER (WHERE s > 1 OR q > 1) AS repeated_samples FROM s GROUP BY 1),
    p2 AS (SELECT episode, count(*) FILTER (WHERE b) AS speaker_overlap FROM p GROUP BY 1),
    c2 AS (SELECT episode, count(*) AS classes, count(*) FILTER (WHERE s <> 2 OR q <> 3) AS unbalanced_classes FROM c GROUP BY 1)
    SELECT *, classes = 3 AND unbalanced_classes = 0 AND sample_overlap = 0 AND repeated_samples = 0 AS valid FROM s2 JOIN p2 USING (episode) JOIN c2 USING (episode)""",
)
def episode_audit(spark, d):
    return episodes.episode_audit(episodes.ordinary_episodes(_emotion_examples(spark, d), 3, 2, 3, 30), 3, 2, 3)


SHOTS, N_WAY, QUERY_SIZE, EPISODES = (1, 5, 10), 5, 5, 20


def _vector_episodes(spark, d, shots):
    ex = vector_examples(spark, d).withColumn("task", F.lit("global"))
    return episodes.episode_sweep(ex.select("task", "label", "sample_id", "vector", "speaker_id"), N_WAY, list(shots), QUERY_SIZE, EPISODES)


def _few_shot_sql():
    parts = [ordinary_slots(N_WAY, k, QUERY_SIZE, EPISODES, tag=f"_{k}") for k in SHOTS]
    union = " UNION ALL ".join(f"SELECT * FROM mem_{k}" for k in SHOTS)
    return f"""{EXAMPLES}, exs AS (SELECT 'global' AS task, label, sample_id, vector, speaker_id FROM ex), {', '.join(parts)},
    mem AS ({union}),
    mv AS (SELECT k_shot, episode, role, label, sample_id, generate_subscripts(vector, 1) AS pos, unnest(vector) AS x FROM mem),
    pr AS (SELECT k_shot, episode, label AS cls, pos, avg(x) AS m FROM mv WHERE role = 'support' GROUP BY ALL),
    pn AS (SELECT k_shot, episode, cls, greatest(sqrt(sum(m * m)), 1e-12) AS pn FROM pr GROUP BY ALL),
    qn AS (SELECT k_shot, episode, sample_id, any_value(label) AS label, greatest(sqrt(sum(x * x)), 1e-12) AS qn FROM mv WHERE role = 'query' GROUP BY 1, 2, 3),
    sc AS (SELECT q.k_shot, q.episode, q.sample_id, p.cls, sum(q.x * p.m) AS d FROM mv q JOIN pr p ON p.k_shot = q.k_shot AND p.episode = q.episode AND p.pos = q.pos
      WHERE q.role = 'query' GROUP BY ALL),
    lg AS (SELECT sc.*, qn.label, d / (qn * pn) / 0.1::DOUBLE AS logit FROM sc JOIN pn USING (k_shot, episode, cls) JOIN qn USING (k_shot, episode, sample_id)),
    pd AS (SELECT k_shot, episode, sample_id, any_value(label) AS label, arg_max(cls, logit) AS prediction, ln(sum(exp(logit))) - max(CASE WHEN cls = label THEN logit END) AS loss FROM lg GROUP BY 1, 2, 3),
    {metrics_sql('pd', ['k_shot', 'episode'], CLASSES)},
    em AS (SELECT k_shot, episode, avg(recall) AS uar, avg(f1) AS macro_f1, sum(tp)::DOUBLE / sum(support) AS accuracy FROM per_class GROUP BY 1, 2),
    el AS (SELECT k_shot, episode, avg(loss) AS prototype_loss FROM pd GROUP BY 1, 2),
    lf AS (SELECT k_shot, 'uar' AS metric, uar AS v FROM em UNION ALL SELECT k_shot, 'macro_f1', macro_f1 FROM em
      UNION ALL SELECT k_shot, 'accuracy', accuracy FROM em UNION ALL SELECT k_shot, 'prototype_loss', prototype_loss FROM el)
    SELECT k_shot, metric, {ci95('v')} FROM lf GROUP BY 1, 2"""


@query("few_shot_eval", f"WITH {_few_shot_sql()}")
def few_shot_eval(spark, d):
    """All shot counts in one job; the interval is clamped to [0, 1] for every metric."""
    members = _vector_episodes(spark, d, SHOTS)
    by = ["k_shot", "episode"]
    protos = prototypes.class_prototypes(members.where("role = 'support'"), "label", "vector", by)
    preds = prototypes.nearest_prototype(members.where("role = 'query'"), protos, "label", "vector", by)
    # Prototypes of one episode differ from its queries by key only, so both are joined once.
    scored = metrics.classification_metrics(preds, "label", "prediction", CLASSES, by).drop("n")
    losses = prototypes.prototype_loss(preds, by).drop("queries")
    long = scored.join(losses, by).unpivot(by, ["uar", "macro_f1", "accuracy", "prototype_loss"], "metric", "v")
    return _rounded(long.groupBy("k_shot", "metric").agg(*stats.mean_ci95(F.col("v"))), ["k_shot", "metric", "n"], _CI)


_PAIR_SQL = f"""{EXAMPLES}, exs AS (SELECT 'global' AS task, label, sample_id, vector, speaker_id FROM ex), {ordinary_slots(N_WAY, 5, QUERY_SIZE, EPISODES)},
  a AS (SELECT x.episode, x.sample_id, x.label, y.sample_id AS other, y.label = x.label AS same, list_cosine_similarity(x.vector, y.vector) AS s
    FROM mem x JOIN mem y ON y.episode = x.episode),
  mx AS (SELECT episode, sample_id, max(s) / 0.1::DOUBLE AS m FROM a GROUP BY 1, 2),
  t AS (SELECT a.episode, a.sample_id, any_value(label) AS label, any_value(m) AS m, count(*) - 1 AS others, count(*) FILTER (WHERE same AND other <> a.sample_id) AS positives,
    max(s) FILTER (WHERE other <> a.sample_id) AS max_similarity, ln(greatest(sum(CASE WHEN other <> a.sample_id THEN exp(s / 0.1::DOUBLE - m) ELSE 0 END), 1e-12)) AS den,
    avg(s / 0.1::DOUBLE) FILTER (WHERE same AND other <> a.sample_id) AS ps FROM a JOIN mx USING (episode, sample_id) GROUP BY 1, 2)"""


def _anchors(spark, d):
    members = _vector_episodes(spark, d, [5])
    return prototypes.contrastive_anchors(members, "episode", "sample_id", "label", "vector", 0.1)


@query(
    "contrastive_pairs",
    f"""WITH {_PAIR_SQL} SELECT episode, sample_id, label, others::INT AS others, positives::INT AS positives, {r6('max_similarity')} AS max_similarity, {r6('ps - m - den')} AS mean_log_prob FROM t""",
)
def contrastive_pairs(spark, d):
    return _rounded(_anchors(spark, d), ["episode", "sample_id", "label", "others", "positives"], ["max_similarity", "mean_log_prob"])


@query(
    "contrastive_loss",
    f"WITH {_PAIR_SQL} SELECT episode, {r6('-avg(ps - m - den)')} AS contrastive_loss, count(*) FILTER (WHERE positives > 0) AS valid_anchors FROM t GROUP BY 1",
)
def contrastive_loss(spark, d):
    return _rounded(prototypes.contrastive_loss(_anchors(spark, d), "episode"), ["episode", "valid_anchors"], ["contrastive_loss"])


# ---- aggregation over runs -------------------------------------------------------------


@query("mean_ci95", f"SELECT user_id, {ci95('least(value, 100.0::DOUBLE) / 100.0::DOUBLE')} FROM events GROUP BY 1")
def mean_ci95(spark, d):
    v = F.least(F.col("value"), F.lit(100.0)) / F.lit(100.0)
    return _rounded(table(spark, d, "events").groupBy("user_id").agg(*stats.mean_ci95(v)), ["user_id", "n"], _CI)


_RUN_SQL = """run AS (SELECT event_type, user_id, avg(least(value, 100.0::DOUBLE) / 100.0::DOUBLE) AS uar, min(least(value, 100.0::DOUBLE) / 100.0::DOUBLE) AS macro_f1,
  max(least(value, 100.0::DOUBLE) / 100.0::DOUBLE) AS accuracy FROM events GROUP BY 1, 2)"""


def _runs(spark, d):
    v = F.least(F.col("value"), F.lit(100.0)) / F.lit(100.0)
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(
        F.avg(v).alias("uar"), F.min(v).alias("macro_f1"), F.max(v).alias("accuracy")
    )


@query(
    "seed_aggregate",
    f"""WITH {_RUN_SQL}, l AS (SELECT event_type, 'uar' AS metric, uar AS v FROM run UNION ALL SELECT event_type, 'macro_f1', macro_f1 FROM run UNION ALL SELECT event_type, 'accuracy', accuracy FROM run)
    SELECT event_type, metric, 'protocol-' || event_type AS protocol, 'supervised' AS training_mode, count(*) >= 3 AND event_type <> 'error' AS paper_ready, {ci95('v')} FROM l GROUP BY 1, 2""",
)
def seed_aggregate(spark, d):
    runs = _runs(spark, d).withColumns(
        {
            "protocol": F.concat(F.lit("protocol-"), "event_type"), "training_mode": F.lit(None).cast("string"),
            "paper_ready": F.col("event_type") != "error",
        }
    )
    out = stats.seed_aggregate(runs, "event_type", ["uar", "macro_f1", "accuracy"])
    return _rounded(out, ["event_type", "metric", "protocol", "training_mode", "paper_ready", "n"], _CI)


@query(
    "run_aggregate",
    f"""WITH e AS (SELECT user_id % 7 AS run, CASE (props->>'k')::INT % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 5 ELSE 10 END AS k, event_type AS metric,
      least(value, 100.0::DOUBLE) / 100.0::DOUBLE AS v FROM events),
    r AS (SELECT run, k, metric, avg(v) AS v FROM e GROUP BY ALL)
    SELECT k, metric, 'override' AS protocol, FALSE AS synthetic, TRUE AS paper_ready, {ci95('v')}, count(*) = (SELECT count(DISTINCT run) FROM r) AS complete FROM r GROUP BY 1, 2""",
)
def run_aggregate(spark, d):
    e = table(spark, d, "events")
    m = F.get_json_object("props", "$.k").cast("int") % 4
    k = F.when(m == 1, 1).when(m == 2, 5).when(m == 3, 10)
    v = F.least(F.col("value"), F.lit(100.0)) / F.lit(100.0)
    runs = e.groupBy((F.col("user_id") % 7).alias("run"), k.alias("k"), F.col("event_type").alias("metric")).agg(F.avg(v).alias("value"))
    runs = runs.withColumns(
        {"protocol": F.lit(None).cast("string"), "synthetic": F.col("run") == 0, "paper_ready": F.lit(True)}
    )
    out = stats.run_aggregate(runs, "run", protocol_override="override")
    return _rounded(out, ["k", "metric", "protocol", "synthetic", "paper_ready", "n", "complete"], _CI)


@query(
    "early_stopping",
    f"""WITH h AS (SELECT event_type, datediff('day', DATE '2024-01-01', ts::DATE)::INT AS epoch, round(avg(value), 6) AS score FROM events GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY epoch) AS n,
      coalesce(score > max(score) OVER (PARTITION BY event_type ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS imp FROM h),
    l AS (SELECT *, max(CASE WHEN imp THEN n END) OVER (PARTITION BY event_type ORDER BY epoch) AS last_n FROM n),
    s AS (SELECT *, min(CASE WHEN n - last_n >= 5 THEN n END) OVER (PARTITION BY event_type) AS stop FROM l)
    SELECT event_type, arg_max(epoch, n) FILTER (WHERE imp) AS best_epoch, {r6('arg_max(score, n) FILTER (WHERE imp)')} AS best_score, max(epoch) AS last_epoch, bool_or(stop IS NOT NULL) AS stopped_early
    FROM s WHERE stop IS NULL OR n <= stop GROUP BY 1""",
)
def early_stopping(spark, d):
    history = table(spark, d, "events").groupBy(
        "event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("epoch")
    ).agg(R(F.avg("value"), 6).alias("score"))
    out = stats.early_stopping(history, "event_type", "epoch", "score", 5)
    return out.select("event_type", "best_epoch", R("best_score", 6).alias("best_score"), "last_epoch", "stopped_early")


# ---- Spark ML --------------------------------------------------------------------------


@query("classifier_eval")
def classifier_eval(spark, d):
    """Test metrics of the classifier chosen on the validation split."""
    from pyspark.ml.functions import array_to_vector

    ex = vector_examples(spark, d).withColumn("features", array_to_vector("vector"))
    model, _ = train_classifier(ex, "features", "label", range(CLASSES))
    preds = model.transform(ex.where("split = 'test'"))
    dims = {"language": F.col("language"), "all": F.lit("all")}
    return _rounded(metrics.sliced_metrics(preds, "label", "prediction", CLASSES, dims), ["slice_dim", "slice_value", "n"], _SCORES)


_ROUTE = "CASE WHEN language IN ('en','fr') THEN language ELSE 'unknown' END"


@query(
    "conditioned_features",
    f"""WITH {EXAMPLES}, {LONG}, r AS (SELECT sample_id, pos, x, {_ROUTE} AS route FROM long)
    SELECT sample_id, pos::INT AS pos, {r6('x')} AS value FROM r WHERE x <> 0
    UNION ALL SELECT sample_id, (64 + 64 * (CASE route WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END) + pos)::INT, {r6('x')} FROM r WHERE x <> 0""",
)
def conditioned_features(spark, d):
    from pyspark.ml.functions import vector_to_array

    routed = conditioned(vector_examples(spark, d), "vector", {"language": ["en", "fr"]}, routed=True)
    long = routed.select("sample_id", F.posexplode(vector_to_array("features")).alias("pos", "x")).where("x <> 0")
    return long.select("sample_id", "pos", R("x", 6).alias("value"))


@query(
    "fusion_weights_by_split",
    f"""{_SOFT_SQL} SELECT split, {r6('avg(w_audio)')} AS w_audio, {r6('avg(w_text)')} AS w_text, {r6('avg(w_visual)')} AS w_visual FROM w GROUP BY 1""",
)
def fusion_weights_by_split(spark, d):
    return with_weights(spark, d).groupBy("split").agg(*[R(F.avg(f"w_{m}"), 6).alias(f"w_{m}") for m in MODALITIES])
