"""Queries on validation rules, leakage, splits and graphs."""

from pyspark.sql import functions as F

from voxloom.operators import graph, joins, rules, splits, stats
from voxloom.operators.neardup import near_duplicates
from voxloom.plans.bindings import grouped_manifest, manifest, raw_records, table
from voxloom.plans.registry import query
from voxloom.plans.sql import M, RAW, SPEAKERS, norm_text, r6, row_split, split_by_rank
from voxloom.schemas import ANNOTATION_LABELS

R = F.round
LABELS = list(ANNOTATION_LABELS)


# ---- rules -----------------------------------------------------------------------------

# The manifest with defects planted by row number, so that every row rule has hits.
_DEFECTS_SQL = f"""{M}, bad AS (SELECT * REPLACE (
    CASE WHEN doc_id % 41 = 0 THEN ' ' ELSE speaker_id END AS speaker_id,
    CASE WHEN doc_id % 43 = 0 THEN 'dev' ELSE split END AS split,
    CASE WHEN doc_id % 29 = 0 THEN 'calm' ELSE emotion END AS emotion,
    CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 37 = 0 THEN FALSE ELSE audio_available END AS audio_available,
    CASE WHEN doc_id % 37 = 0 THEN FALSE ELSE text_available END AS text_available,
    CASE WHEN doc_id % 37 = 0 THEN FALSE ELSE visual_available END AS visual_available,
    CASE WHEN doc_id % 23 = 0 THEN NULL ELSE audio_path END AS audio_path,
    CASE WHEN doc_id % 19 = 0 THEN '' ELSE video_path END AS video_path,
    CASE WHEN doc_id % 17 = 0 THEN '  ' ELSE transcript END AS transcript,
    CASE WHEN doc_id % 13 = 0 THEN 1.5::DOUBLE ELSE asr_confidence END AS asr_confidence,
    CASE WHEN doc_id % 47 = 0 THEN 0.0::DOUBLE ELSE duration END AS duration) FROM m)"""


def defective_manifest(spark, d):
    k, c = F.col("doc_id"), F.col
    return manifest(spark, d).withColumns(
        {
            "speaker_id": F.when(k % 41 == 0, " ").otherwise(c("speaker_id")),
            "split": F.when(k % 43 == 0, "dev").otherwise(c("split")),
            "emotion": F.when(k % 29 == 0, "calm").otherwise(c("emotion")),
            "audio_available": F.when(k % 31 == 0, F.lit(None).cast("boolean")).when(k % 37 == 0, False).otherwise(c("audio_available")),
            "text_available": F.when(k % 37 == 0, False).otherwise(c("text_available")),
            "visual_available": F.when(k % 37 == 0, False).otherwise(c("visual_available")),
            "audio_path": F.when(k % 23 != 0, c("audio_path")),
            "video_path": F.when(k % 19 == 0, "").otherwise(c("video_path")),
            "transcript": F.when(k % 17 == 0, "  ").otherwise(c("transcript")),
            "asr_confidence": F.when(k % 13 == 0, 1.5).otherwise(c("asr_confidence")),
            "duration": F.when(k % 47 == 0, 0.0).otherwise(c("duration")),
        }
    )


def _row_rules_sql(source):
    arms = [("missing_required_value", c, f"coalesce(trim({c}) = '', TRUE)") for c in ("sample_id", "speaker_id", "language", "corpus", "split")]
    arms += [
        ("invalid_split", "split", "NOT coalesce(split IN ('train','validation','test'), FALSE)"),
        ("unsupported_label", "emotion", "NOT coalesce(emotion IN ('angry','happy','neutral','sad'), FALSE)"),
        ("missing_availability_metadata", "availability", "audio_available IS NULL OR text_available IS NULL OR visual_available IS NULL"),
        ("no_available_modality", "availability", "NOT (coalesce(audio_available, FALSE) OR coalesce(text_available, FALSE) OR coalesce(visual_available, FALSE))"),
        ("availability_path_mismatch", "audio_path", "coalesce(audio_available, FALSE) AND coalesce(audio_path = '', TRUE)"),
        ("availability_path_mismatch", "video_path", "coalesce(visual_available, FALSE) AND coalesce(video_path = '', TRUE)"),
        ("availability_text_mismatch", "transcript", "coalesce(text_available, FALSE) AND coalesce(trim(transcript) = '', TRUE)"),
        ("invalid_asr_confidence", "asr_confidence", "asr_confidence IS NOT NULL AND NOT asr_confidence BETWEEN 0 AND 1"),
        ("invalid_duration", "duration", "coalesce(duration <= 0, FALSE)"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{code}' AS code, 'error' AS severity, '{subject}' AS subject, sample_id FROM {source} WHERE {cond}"
        for code, subject, cond in arms
    )


def _span_sql(source, key, code, fold=False, having="count(DISTINCT s) > 1", severity="error"):
    split = "lower(split)" if fold else "split"
    return f"""SELECT '{code}' AS code, '{severity}' AS severity, {key} AS subject, sample_id FROM {source}
      WHERE {key} IN (SELECT k FROM (SELECT {key} AS k, {split} AS s FROM {source} WHERE {key} IS NOT NULL AND {key} <> '')
        GROUP BY k HAVING {having})"""


def _group_rules_sql(source):
    both = "count(*) FILTER (WHERE s = 'train') > 0 AND count(*) FILTER (WHERE s = 'test') > 0"
    within = "count(DISTINCT s) = 1 AND count(*) > 1"
    text = f"(SELECT sample_id, split, CASE WHEN {norm_text('transcript')} <> '' THEN sha256({norm_text('transcript')}) END AS text_key FROM {source})"
    return " UNION ALL ".join(
        [
            _span_sql(source, "audio_path", "duplicate_audio_across_splits"),
            _span_sql(source, "audio_path", "duplicate_audio", having=within, severity="warning"),
            _span_sql(source, "video_path", "duplicate_video_across_splits"),
            _span_sql(source, "video_path", "duplicate_video", having=within, severity="warning"),
            _span_sql(source, "speaker_id", "speaker_split_overlap", fold=True),
            _span_sql(source, "speaker_id", "speaker_train_test_overlap", fold=True, having=both),
            _span_sql(source, "source_video_id", "source_video_split_overlap"),
            _span_sql(text, "text_key", "duplicate_transcript_across_splits", severity="warning"),
            f"SELECT 'duplicate_sample_id', 'error', sample_id, sample_id FROM {source} GROUP BY sample_id HAVING count(*) > 1",
        ]
    )


def _dataset_rules_sql(source):
    return f"""SELECT 'class_imbalance' AS code, 'warning' AS severity, 'dataset' AS subject, NULL::VARCHAR AS sample_id
      FROM (SELECT max(n)::DOUBLE / min(n) AS r FROM (SELECT count(*) AS n FROM {source} GROUP BY emotion)) WHERE r >= 3
    UNION ALL SELECT 'language_corpus_confounding', 'warning', 'dataset', NULL FROM (
      SELECT count(*) AS l, max(c) AS m FROM (SELECT language, count(DISTINCT corpus) AS c FROM {source} GROUP BY 1)) WHERE l > 1 AND m = 1"""


@query("row_rules", f"WITH {_DEFECTS_SQL} {_row_rules_sql('bad')}")
def row_rules(spark, d):
    return rules.row_rules(defective_manifest(spark, d), LABELS)


_ISSUES_SQL = f"{_row_rules_sql('bad')} UNION ALL {_group_rules_sql('bad')} UNION ALL {_dataset_rules_sql('bad')}"


@query("issue_report", f"WITH {_DEFECTS_SQL} {_ISSUES_SQL}")
def issue_report(spark, d):
    return rules.validate(defective_manifest(spark, d), LABELS)


@query(
    "issue_counts",
    f"""WITH {_DEFECTS_SQL}, i AS ({_ISSUES_SQL}), s AS (SELECT code, severity, subject, count(*) AS n FROM i GROUP BY ALL)
    SELECT code, severity, count(*) AS subjects, sum(n)::BIGINT AS rows FROM s GROUP BY ALL""",
)
def issue_counts(spark, d):
    return rules.issue_counts(rules.validate(defective_manifest(spark, d), LABELS))


@query(
    "issue_counts_grouped_split",
    f"""WITH {M}, {SPEAKERS}, g AS (SELECT m.* REPLACE (spk.split_grp AS split) FROM m JOIN spk USING (speaker_id)),
    i AS ({_row_rules_sql('g')} UNION ALL {_group_rules_sql('g')} UNION ALL {_dataset_rules_sql('g')}),
    s AS (SELECT code, severity, subject, count(*) AS n FROM i GROUP BY ALL)
    SELECT code, severity, count(*) AS subjects, sum(n)::BIGINT AS rows FROM s GROUP BY ALL""",
)
def issue_counts_grouped_split(spark, d):
    return rules.issue_counts(rules.validate(grouped_manifest(spark, d), LABELS))


@query(
    "duplicate_ids",
    "SELECT sha256(text) AS sample_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_ids(spark, d):
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("sample_id"), F.lit("train").alias("split"))
    return rules.group_profile(docs, ["sample_id"]).where("n > 1").select(F.col("key").alias("sample_id"), "n")


@query(
    "shared_path_leakage",
    f"WITH {M} " + _span_sql("m", "audio_path", "duplicate_audio_across_splits") + " UNION ALL "
    + _span_sql("m", "audio_path", "duplicate_audio", having="count(DISTINCT s) = 1 AND count(*) > 1", severity="warning"),
)
def shared_path_leakage(spark, d):
    return rules.group_issues(manifest(spark, d), ["audio", "video"])


@query(
    "speaker_leakage",
    f"""WITH {RAW} SELECT speaker_id, count(*) AS n, count(DISTINCT split) > 1 AS overlap,
      bool_or(split = 'train') AND bool_or(split = 'test') AS train_test FROM raw GROUP BY 1""",
)
def speaker_leakage(spark, d):
    p = rules.group_profile(raw_records(spark, d), ["speaker"])
    return p.select(
        F.col("key").alias("speaker_id"), "n", F.col("spans_folded").alias("overlap"),
        (F.col("in_train") & F.col("in_test")).alias("train_test"),
    )


@query(
    "source_leakage",
    f"""WITH {RAW} SELECT source_video_id, count(*) AS n, concat_ws(',', CASE WHEN bool_or(split = 'train') THEN 'train' END,
      CASE WHEN bool_or(split = 'validation') THEN 'validation' END, CASE WHEN bool_or(split = 'test') THEN 'test' END) AS splits
    FROM raw GROUP BY 1 HAVING count(DISTINCT split) > 1""",
)
def source_leakage(spark, d):
    p = rules.group_profile(raw_records(spark, d), ["source"]).where("spans")
    names = F.concat_ws(",", *[F.when(F.col(f"in_{s}"), s) for s in ("train", "validation", "test")])
    return p.select(F.col("key").alias("source_video_id"), "n", names.alias("splits"))


@query(
    "text_dup_across_splits",
    f"""WITH {RAW} SELECT sha256({norm_text('transcript')}) AS text_key, count(*) AS n FROM raw WHERE {norm_text('transcript')} <> ''
    GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT split) > 1""",
)
def text_dup_across_splits(spark, d):
    p = rules.group_profile(raw_records(spark, d), ["text"]).where("spans and n > 1")
    return p.select(F.col("key").alias("text_key"), "n")


@query(
    "class_imbalance",
    f"""SELECT max(n) AS largest, min(n) AS smallest, {r6('max(n)::DOUBLE / min(n)')} AS ratio, max(n)::DOUBLE / min(n) >= 3 AS imbalanced
    FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)""",
)
def class_imbalance(spark, d):
    out = rules.class_imbalance(table(spark, d, "orders"), "o_orderpriority")
    return out.select("largest", "smallest", R("ratio", 6).alias("ratio"), "imbalanced")


@query(
    "confounding",
    f"""WITH {RAW} SELECT count(*) AS languages, count(*) FILTER (WHERE c = 1) AS single_corpus_languages, count(*) > 1 AND max(c) = 1 AS confounded
    FROM (SELECT language, count(DISTINCT corpus) AS c FROM raw GROUP BY 1)""",
)
def confounding(spark, d):
    return rules.confounding(raw_records(spark, d), "language", "corpus")


@query(
    "domain_overlap",
    f"""WITH {M}, p AS (SELECT corpus, bool_or(split = 'train') AS a, bool_or(split = 'validation') AS b, bool_or(split = 'test') AS c FROM m GROUP BY 1)
    SELECT corpus, a AS in_train, b AS in_validation, c AS in_test, a AND b AS train_validation, a AND c AS train_test, b AND c AS validation_test,
      (SELECT bool_or(a) AND bool_or(c) AND NOT bool_or(a AND c) FROM p) AS unseen_test_verified FROM p""",
)
def domain_overlap(spark, d):
    return stats.domain_overlap(manifest(spark, d).select("corpus", "split"), "corpus")


@query("near_duplicates")
def near_duplicate_pairs(spark, d):
    pairs = near_duplicates(raw_records(spark, d))
    return pairs.select("left_id", "right_id", R("ratio", 6).alias("ratio"))


# ---- splits and subsets ----------------------------------------------------------------

_GROUPS_SQL = f"""ranked AS (SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment,
    row_number() OVER (PARTITION BY lower(c_mktsegment) ORDER BY sha256('17:' || c_custkey::VARCHAR), c_custkey) AS rn,
    count(*) OVER (PARTITION BY lower(c_mktsegment)) AS n FROM customer),
  assigned AS (SELECT c_custkey, c_mktsegment, {split_by_rank('rn', 'n')} AS split FROM ranked)"""
_PILOT_SQL = f"""{_GROUPS_SQL},
  sized AS (SELECT *, count(*) OVER (PARTITION BY split, c_mktsegment) AS size,
    row_number() OVER (PARTITION BY split, c_mktsegment ORDER BY sha256('1017:' || c_custkey::VARCHAR), c_custkey) AS turn FROM assigned),
  picked AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY turn, size DESC, c_mktsegment) AS pick FROM sized),
  pilot AS (SELECT c_custkey, c_mktsegment, split, pick::INT AS pick FROM picked WHERE pick <= CASE split WHEN 'train' THEN 8 ELSE 2 END)"""
PILOT_COUNTS = {"train": 8, "validation": 2, "test": 2}


def _assigned(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return splits.stratified_group_split(customer, "c_custkey", "c_mktsegment")


@query("stratified_group_split", f"WITH {_GROUPS_SQL} SELECT * FROM assigned")
def stratified_group_split(spark, d):
    return _assigned(spark, d)


@query(
    "split_audit",
    f"""WITH {_GROUPS_SQL} SELECT split, c_mktsegment, count(*) AS groups, min(c_custkey) AS first_group, max(c_custkey) AS last_group
    FROM assigned GROUP BY ALL""",
)
def split_audit(spark, d):
    return stats.split_audit(_assigned(spark, d), "c_custkey", "c_mktsegment")


@query("balanced_pilot", f"WITH {_PILOT_SQL} SELECT * FROM pilot")
def balanced_pilot(spark, d):
    return splits.balanced_pilot(_assigned(spark, d), "c_custkey", "c_mktsegment", PILOT_COUNTS)


@query(
    "pilot_semi",
    f"WITH {_PILOT_SQL} SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM pilot)",
)
def pilot_semi(spark, d):
    pilot = splits.balanced_pilot(_assigned(spark, d), "c_custkey", "c_mktsegment", PILOT_COUNTS)
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return joins.semi_subset(orders, pilot.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")


@query(
    "hash_topk_per_class",
    f"""WITH {M} SELECT split, emotion, sample_id, rank::INT AS rank FROM (SELECT split, emotion, sample_id,
      row_number() OVER (PARTITION BY split, emotion ORDER BY sha256('17:' || sample_id), sample_id) AS rank FROM m) WHERE rank <= 8""",
)
def hash_topk_per_class(spark, d):
    m = manifest(spark, d).select("split", "emotion", "sample_id")
    return splits.hash_topk(m, ["split", "emotion"], "sample_id", 8)


_COMP_LABELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _component_sql():
    counts = ", ".join(f"count(*) FILTER (WHERE c_mktsegment = '{v}') AS n_{i}" for i, v in enumerate(_COMP_LABELS))
    sums = ", ".join(f"sum(n_{i}) AS n_{i}" for i in range(5))
    split_cells = ", ".join(f"sum(CASE WHEN digit = {s} THEN n_{j} ELSE 0 END) AS c{s}_{j}" for s in range(3) for j in range(5))
    speakers = ", ".join(f"sum(CASE WHEN digit = {s} THEN speakers ELSE 0 END) AS s{s}" for s in range(3))
    tot = [" + ".join(f"c{s}_{j}" for j in range(5)) for s in range(3)]
    t = ("0.7", "0.15", "0.15")
    sample = " + ".join(f"pow(n{s}::DOUBLE / tn - {t[s]}::DOUBLE, 2)" for s in range(3))
    people = " + ".join(f"pow(s{s}::DOUBLE / ts - {t[s]}::DOUBLE, 2)" for s in range(3))
    classes = " + ".join(
        f"pow(c{s}_{j}::DOUBLE / n{s} - (c0_{j} + c1_{j} + c2_{j})::DOUBLE / tn, 2)" for s in range(3) for j in range(5)
    )
    every = " AND ".join(f"c{s}_{j} > 0" for s in range(3) for j in range(5))
    return f"""WITH member AS (SELECT r_name AS component, n_name AS speaker, c_mktsegment FROM customer
        JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
      sp AS (SELECT component, speaker, {counts} FROM member GROUP BY 1, 2),
      comp AS (SELECT *, row_number() OVER (ORDER BY speakers DESC, first_speaker) - 1 AS i, count(*) OVER () AS k FROM (
        SELECT component, count(*) AS speakers, min(speaker) AS first_speaker, {sums} FROM sp GROUP BY 1)),
      ids AS (SELECT unnest(range(pow(3, (SELECT count(*) FROM comp))::INT)) AS id),
      cells AS (SELECT id, (id // pow(3, k - 1 - i)::BIGINT) % 3 AS digit, comp.* FROM ids, comp),
      sums AS (SELECT id, max(CASE WHEN i = 0 THEN digit END) AS d0, count(DISTINCT digit) AS used, {speakers}, {split_cells} FROM cells GROUP BY 1),
      tot AS (SELECT *, {tot[0]} AS n0, {tot[1]} AS n1, {tot[2]} AS n2, s0 + s1 + s2 AS ts FROM sums),
      tot2 AS (SELECT *, n0 + n1 + n2 AS tn FROM tot),
      ok AS (SELECT id, round({sample} + 0.05::DOUBLE * ({classes}) + 0.01::DOUBLE * ({people}), 15) AS score FROM tot2
        WHERE d0 = 0 AND used = 3 AND n0 >= greatest(n1, n2) AND {every}),
      best AS (SELECT id, score FROM ok ORDER BY score, id LIMIT 1)
    SELECT component, ['train','validation','test'][(best.id // pow(3, k - 1 - i)::BIGINT) % 3 + 1] AS split, {r6('best.score')} AS score, 'exact' AS method
    FROM comp, best"""


@query("component_split", _component_sql())
def component_split(spark, d):
    region = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("component"))
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("speaker"), F.col("n_regionkey").alias("r_regionkey"))
    people = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    members = people.join(nation, "n_nationkey").join(region, "r_regionkey")
    comps = splits.component_table(members, "component", "speaker", "c_mktsegment", _COMP_LABELS)
    return splits.component_split(comps, "component", len(_COMP_LABELS)).withColumn("score", R("score", 6))


# ---- graphs ----------------------------------------------------------------------------


@query(
    "cooccurrence_edges",
    """WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), c AS (SELECT l_orderkey, min(l_suppkey) AS dst FROM m GROUP BY 1)
    SELECT DISTINCT l_suppkey AS src, dst FROM m JOIN c USING (l_orderkey) WHERE l_suppkey <> dst""",
)
def cooccurrence_edges(spark, d):
    return graph.cooccurrence_edges(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey")


_LINKS_SQL = f"""link AS (SELECT doc_id, sha256({norm_text('text')}) AS ctx FROM documents
    UNION ALL SELECT doc_id, lang || '/' || n_chars::VARCHAR FROM documents),
  centre AS (SELECT ctx, min(doc_id) AS dst FROM link GROUP BY 1),
  edge AS (SELECT DISTINCT doc_id AS src, dst FROM link JOIN centre USING (ctx) WHERE doc_id <> dst),
  both_ AS (SELECT src AS a, dst AS b FROM edge UNION SELECT dst, src FROM edge),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON e.a = r.b),
  comp AS (SELECT a AS doc_id, min(b) AS component FROM reach GROUP BY 1)"""


def _document_components(spark, d):
    """Documents linked by equal normalised text or by equal language and length."""
    from voxloom.functions.text import normalize_text

    docs = table(spark, d, "documents")
    contexts = F.array(
        F.sha2(normalize_text(F.col("text")), 256), F.concat("lang", F.lit("/"), F.col("n_chars").cast("string"))
    )
    links = docs.select("doc_id", F.explode(contexts).alias("ctx"))
    return graph.connected_components(docs, graph.cooccurrence_edges(links, "doc_id", "ctx"), "doc_id")


@query("connected_components", f"WITH RECURSIVE {_LINKS_SQL} SELECT * FROM comp")
def connected_components(spark, d):
    return _document_components(spark, d)


@query(
    "connected_components_nations",
    """WITH n AS (SELECT 'c' || c_custkey::VARCHAR AS node, c_nationkey AS k FROM customer
      UNION ALL SELECT 's' || s_suppkey::VARCHAR, s_nationkey FROM supplier)
    SELECT node, min(node) OVER (PARTITION BY k) AS component FROM n""",
)
def connected_components_nations(spark, d):
    people = table(spark, d, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_nationkey").alias("ctx")
    ).unionByName(
        table(spark, d, "supplier").select(
            F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.col("s_nationkey").alias("ctx")
        )
    )
    return graph.connected_components(people, graph.cooccurrence_edges(people, "node", "ctx"), "node")


@query(
    "component_summary",
    f"""WITH RECURSIVE {_LINKS_SQL}, r AS (SELECT component, d.*, {row_split('d.doc_id')} AS split FROM documents d JOIN comp USING (doc_id))
    SELECT component, 'lang' AS attribute, lang AS value, count(*) AS n FROM r GROUP BY ALL
    UNION ALL SELECT component, 'source', source, count(*) FROM r GROUP BY ALL
    UNION ALL SELECT component, 'split', split, count(*) FROM r GROUP BY ALL""",
)
def component_summary(spark, d):
    from voxloom.plans.bindings import row_split as split_of

    docs = table(spark, d, "documents").withColumn("split", split_of(F.col("doc_id")))
    return graph.component_summary(docs, _document_components(spark, d), "doc_id", ["lang", "source", "split"])
