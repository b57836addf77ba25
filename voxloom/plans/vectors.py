"""Queries on embeddings: store, assembly, pooling, fusion, prototypes."""

from pyspark.sql import functions as F

from voxloom.functions import vectors as V
from voxloom.functions.text import zero_padded
from voxloom.operators import assemble, metrics, pooling, prototypes, records, store
from voxloom.plans.bindings import manifest, table, vector_examples
from voxloom.plans.corpus import QUALITY_SQL, with_quality
from voxloom.plans.registry import query
from voxloom.plans.sql import EXAMPLES, LONG, M, PREDICTIONS, padded, r6, row_split, uniform
from voxloom.schemas import EMOTION_LABELS, MODALITIES
from voxloom.scratch import new_folder
from voxloom.sources import tables

R = F.round
CLASSES = 10
VEC = """vec AS (SELECT vec_id, label, len(embedding) AS d, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"""


def _embeddings(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", V.as_double(F.col("embedding")).alias("v"))


def _long(df, keys, column, name="value"):
    """Array column to rows (keys, pos, value rounded)."""
    return df.select(*keys, F.posexplode(column).alias("pos", "_x")).select(*keys, "pos", R("_x", 6).alias(name))


# ---- store and assembly ----------------------------------------------------------------


@query(
    "embedding_scan_validated",
    """SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN 63 ELSE 64 END AS dim,
      CASE vec_id % 9 WHEN 0 THEN 'wrong_dimension' WHEN 1 THEN 'non_finite' WHEN 2 THEN 'non_finite' ELSE 'ok' END AS status FROM embeddings""",
)
def embedding_scan_validated(spark, d):
    k, v = F.col("vec_id") % 9, F.col("embedding")
    nan, inf = F.lit(float("nan")).cast("float"), F.lit(float("inf")).cast("float")
    broken = (
        F.when(k == 0, F.slice(v, 1, 63)).when(k == 1, F.concat(F.slice(v, 1, 63), F.array(nan)))
        .when(k == 2, F.concat(F.array(inf), F.slice(v, 2, 63))).otherwise(v)
    )
    path = new_folder(spark, "vectors")
    table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("key_hash"), broken.alias("embedding"), F.lit("audio").alias("modality"),
        F.lit("c1").alias("contract_sha256"),
    ).write.partitionBy("modality", "contract_sha256").parquet(path)
    checked = store.validate_embeddings(tables.read_embeddings(spark, path, "audio", "c1"), "embedding", 64)
    return checked.select(F.col("key_hash").cast("bigint").alias("vec_id"), F.size("embedding").alias("dim"), "status")


@query("dimension_check", "SELECT len(embedding)::INT AS dimension, count(*) AS n, len(embedding) = 64 AS expected FROM embeddings GROUP BY ALL")
def dimension_check(spark, d):
    return store.dimension_check(table(spark, d, "embeddings"), "embedding", 64)


_RUNS = """SELECT doc_id, sha256(text) AS key_hash, 32 AS embedding_dimension FROM documents"""


@query("cache_index", _RUNS)
def cache_index(spark, d):
    docs = table(spark, d, "documents")
    path = new_folder(spark, "store")
    store.materialize_embeddings(docs, "text", path, "c1", 32)
    stored = tables.read_embeddings(spark, path, "text", "c1")
    return store.cache_index(docs, "text", stored, "doc_id", 32)


@query(
    "cache_materialize",
    """WITH u AS (SELECT sha256(text) AS h, bool_or(lang = 'en') AS en FROM documents GROUP BY 1),
      c AS (SELECT count(*) AS rows_, count(*) FILTER (WHERE lang = 'en') AS en_rows FROM documents),
      k AS (SELECT count(*) AS uniq, count(*) FILTER (WHERE en) AS en FROM u)
    SELECT 1 AS run, en_rows AS selected, en AS unique_payloads, 0::BIGINT AS skipped, en AS processed, en_rows - en AS calls_saved, en AS stored FROM c, k
    UNION ALL SELECT 2, rows_, uniq, en, uniq - en, rows_ - uniq, uniq FROM c, k
    UNION ALL SELECT 3, rows_, uniq, uniq, 0, rows_ - uniq, uniq FROM c, k""",
)
def cache_materialize(spark, d):
    """English first, then everything, then everything again; the last run encodes nothing."""
    docs = table(spark, d, "documents")
    contract = store.settings_hash(spark, {"encoder": "hashing", "dimension": 32, "normalized": True})
    path = new_folder(spark, "store")
    rows = []
    for run, inputs in enumerate([docs.where("lang = 'en'"), docs, docs], start=1):
        counters = store.materialize_embeddings(inputs, "text", path, contract, 32)
        stored = tables.read_embeddings(spark, path, "text", contract).count()
        rows.append((run, *[counters[c] for c in ("selected", "unique_payloads", "skipped", "processed", "calls_saved")], stored))
    return spark.createDataFrame(
        rows, "run int, selected long, unique_payloads long, skipped long, processed long, calls_saved long, stored long"
    )


@query(
    "incremental_cache",
    "SELECT sha256(text) AS key_hash, count(*) > 1 AS repeated, 16 AS embedding_dimension, 1::BIGINT AS copies FROM documents GROUP BY 1",
)
def incremental_cache(spark, d):
    """English documents arrive first, then all of them; every text is stored once."""
    from voxloom.streaming.incremental import incremental_cache as run, read_new_files

    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    root = new_folder(spark, "stream")
    incoming, path, checkpoint = f"{root}/in", f"{root}/store", f"{root}/checkpoint"
    for part in (docs.where("lang = 'en'").drop("lang"), docs.drop("lang")):
        part.write.mode("append").parquet(incoming)
        run(read_new_files(spark, incoming, part.schema, 4), "text", path, checkpoint, "c1", 16).awaitTermination()
    stored = tables.read_embeddings(spark, path, "text", "c1").groupBy("key_hash").agg(
        F.count(F.lit(1)).alias("copies"), F.max(F.size("embedding")).alias("embedding_dimension")
    )
    uses = docs.groupBy(F.sha2("text", 256).alias("key_hash")).agg((F.count(F.lit(1)) > 1).alias("repeated"))
    return stored.join(uses, "key_hash", "full").select("key_hash", "repeated", "embedding_dimension", "copies")


@query(
    "index_alignment",
    f"""WITH {M}, i AS (SELECT 'doc-' || {padded('vec_id', 8)} AS sample_id FROM embeddings),
    a AS (SELECT sample_id FROM m WHERE text_available),
    d AS (SELECT 'missing' AS side, sample_id FROM a WHERE sample_id NOT IN (SELECT sample_id FROM i)
      UNION ALL SELECT 'extra', sample_id FROM i WHERE sample_id NOT IN (SELECT sample_id FROM a)),
    r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY sample_id) AS rn FROM d)
    SELECT side, count(*) AS n, string_agg(sample_id, ',' ORDER BY sample_id) FILTER (WHERE rn <= 5) AS first_ids FROM r GROUP BY 1""",
)
def index_alignment(spark, d):
    index = table(spark, d, "embeddings").select(
        F.concat(F.lit("doc-"), zero_padded(F.col("vec_id"), 8)).alias("sample_id")
    )
    return assemble.index_alignment(manifest(spark, d), index, "text_available")


_PATTERN = """CASE WHEN audio_available THEN 'A' ELSE '' END || CASE WHEN text_available THEN 'T' ELSE '' END || CASE WHEN visual_available THEN 'V' ELSE '' END"""


def _sources(spark, d):
    sid = lambda c: F.concat(F.lit("doc-"), zero_padded(F.col(c), 8)).alias("sample_id")
    audio = table(spark, d, "embeddings").select(
        sid("vec_id"), F.col("embedding").alias("vector"), ((F.col("vec_id") % 10).cast("double") / 8.0).alias("clipping_fraction")
    )
    text = table(spark, d, "documents").where(F.length(F.trim("text")) > 0).select(
        sid("doc_id"), F.array(F.col("n_chars").cast("double"), F.octet_length("text").cast("double"), F.lit(1.0)).alias("vector")
    )
    visual = table(spark, d, "labels").select(
        sid("doc_id"), F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("vector"),
        (F.col("doc_id") % 11).cast("int").alias("valid_frame_count"),
    )
    return {"audio": audio, "text": text, "visual": visual}


@query(
    "assemble_examples",
    f"""WITH {M}, {QUALITY_SQL}
    SELECT sample_id, split, CASE emotion WHEN 'angry' THEN 0 WHEN 'happy' THEN 1 WHEN 'neutral' THEN 2 ELSE 3 END AS label, language, speaker_id,
      {_PATTERN} AS pattern, {r6('q_audio')} AS q_audio, {r6('q_text')} AS q_text, {r6('q_visual')} AS q_visual,
      {r6('CASE WHEN audio_available THEN list_sum(e.embedding::DOUBLE[]) ELSE 0 END')} AS audio_sum,
      {r6('CASE WHEN text_available THEN d.n_chars + strlen(d.text) + 1 ELSE 0 END')} AS text_sum,
      {r6('CASE WHEN visual_available THEN l.quality + l.toxic ELSE 0 END')} AS visual_sum, 69 AS dims,
      transcript_source, source_video_id
    FROM qq LEFT JOIN embeddings e ON e.vec_id = qq.doc_id LEFT JOIN documents d ON d.doc_id = qq.doc_id LEFT JOIN labels l ON l.doc_id = qq.doc_id""",
)
def assemble_examples(spark, d):
    dims = {"audio": 64, "text": 3, "visual": 2}
    ex = assemble.assemble_examples(manifest(spark, d), _sources(spark, d), dims, EMOTION_LABELS)
    return ex.select(
        "sample_id", "split", "label", "language", "speaker_id", records.modality_pattern(F.col("modality_mask")).alias("pattern"),
        *[R(F.get("quality", F.lit(i)), 6).alias(f"q_{m}") for i, m in enumerate(MODALITIES)],
        *[R(V.vsum(F.col(f"{m}_vector")), 6).alias(f"{m}_sum") for m in MODALITIES],
        (F.size("audio_vector") + F.size("text_vector") + F.size("visual_vector")).alias("dims"),
        F.try_element_at("metadata", F.lit("transcript_source")).alias("transcript_source"),
        F.try_element_at("metadata", F.lit("source_video_id")).alias("source_video_id"),
    )


@query(
    "versioned_examples",
    f"""SELECT 'v' || vec_id::VARCHAR AS sample_id, (1 + vec_id % 4)::INT AS schema_version,
      CASE WHEN vec_id % 4 = 0 OR vec_id % 20 = 13 THEN 'unknown' ELSE 'spk' || (vec_id % 7)::VARCHAR END AS speaker_id,
      CASE WHEN vec_id % 4 = 0 OR vec_id % 20 = 13 THEN 'unknown' ELSE {row_split('vec_id')} END AS split,
      CASE WHEN vec_id % 4 = 3 THEN 'gold' END AS transcript_source,
      CASE WHEN vec_id % 20 = 13 THEN 'field_set' WHEN vec_id % 28 = 9 THEN 'temporal_matrix_not_allowed' END AS violation FROM embeddings""",
)
def versioned_examples(spark, d):
    from voxloom.plans.bindings import row_split as split_of

    path = new_folder(spark, "examples")
    k = F.col("vec_id")
    base = table(spark, d, "embeddings").select(
        "vec_id", F.concat(F.lit("v"), k.cast("string")).alias("sample_id"), (F.lit(1) + k % 4).cast("int").alias("version"),
        V.as_double(F.col("embedding")).alias("embedding"),
        F.array(F.lit(True), F.lit(False), F.lit(False)).alias("modality_mask"),
        F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("quality"),
        F.when(k % 28 == 9, 2).otherwise(0).alias("steps"),
        F.when(k % 20 != 13, F.concat(F.lit("spk"), (k % 7).cast("string"))).alias("speaker_id"),
        F.when(k % 20 != 13, split_of(k)).alias("split"),
        F.create_map(F.lit("transcript_source"), F.lit("gold")).alias("metadata"),
    )
    for version in (1, 2, 3, 4):
        absent = ["speaker_id", "split"] if version == 1 else []
        absent += ["metadata"] if version < 4 else []
        base.where(F.col("version") == version).drop("version", "vec_id", *absent).write.parquet(f"{path}/schema_version={version}")
    checked = assemble.versioned_examples(tables.read_versioned_examples(spark, path))
    return checked.select(
        "sample_id", "schema_version", "speaker_id", "split",
        F.try_element_at("metadata", F.lit("transcript_source")).alias("transcript_source"), "violation",
    )


_SYN_DIMS = {"audio": 12, "text": 10, "visual": 8}


def _synthetic_sql():
    arms = []
    for n, (m, dim) in enumerate(_SYN_DIMS.items()):
        u1 = f"(1.0::DOUBLE - {uniform(f"'17:' || i::VARCHAR || ':{m}:' || p::VARCHAR || ':r'")})"
        u2 = uniform(f"'17:' || i::VARCHAR || ':{m}:' || p::VARCHAR || ':a'")
        value = (
            f"0.20::DOUBLE * sqrt(-2.0::DOUBLE * ln({u1})) * cos(6.283185307179586::DOUBLE * {u2})"
            f" + CASE WHEN p = label % {dim} THEN 1.5::DOUBLE ELSE 0 END"
            f" + CASE WHEN p = (label + 4) % {dim} THEN CASE WHEN language = 'zh' THEN 0.3::DOUBLE ELSE -0.3::DOUBLE END ELSE 0 END"
            f" + CASE WHEN p = (label + 7) % {dim} THEN CASE WHEN corpus = 'synthetic_b' THEN 0.2::DOUBLE ELSE -0.2::DOUBLE END ELSE 0 END"
        )
        q = f"0.25::DOUBLE + 0.75::DOUBLE * {uniform(f"'17:' || i::VARCHAR || ':{m}:quality'")}"
        arms.append(
            f"SELECT sample_id, label, speaker_id, '{m}' AS modality, p::INT AS pos, "
            f"{r6(f'CASE WHEN mask[{n + 1}] = 1 THEN {value} ELSE 0 END')} AS value, "
            f"{r6(f'CASE WHEN mask[{n + 1}] = 1 THEN {q} ELSE 0 END')} AS quality FROM b, range({dim}) t(p)"
        )
    return "WITH b AS (SELECT doc_id AS i, 'synthetic-17-' || " + padded("doc_id", 10) + """ AS sample_id, (doc_id % 4)::INT AS label,
        ['en','zh','unknown'][doc_id % 3 + 1] AS language, ['synthetic_a','synthetic_b','unknown'][(doc_id // 3) % 3 + 1] AS corpus,
        [[1,1,1],[1,1,0],[1,0,1],[0,1,1],[1,0,0],[0,1,0],[0,0,1]][doc_id % 7 + 1] AS mask,
        'synthetic-speaker-' || """ + padded("(doc_id // 4)", 10) + """ AS speaker_id FROM documents) """ + " UNION ALL ".join(arms)


@query("synthetic_examples", _synthetic_sql())
def synthetic_examples(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    ex = assemble.synthetic_examples(docs, "doc_id", _SYN_DIMS)
    entries = F.array(
        *[
            F.struct(F.lit(m).alias("modality"), F.col(f"{m}_vector").alias("v"), R(F.get("quality", F.lit(i)), 6).alias("quality"))
            for i, m in enumerate(_SYN_DIMS)
        ]
    )
    long = ex.select("sample_id", "label", "speaker_id", F.explode(entries).alias("e")).select("sample_id", "label", "speaker_id", "e.*")
    return _long(long, ["sample_id", "label", "speaker_id", "modality", "quality"], "v")


# ---- masks -----------------------------------------------------------------------------


def _mask_arms():
    return "[coalesce(audio_available, FALSE), coalesce(text_available, FALSE), coalesce(visual_available, FALSE)]"


@query(
    "modality_dropout",
    f"""WITH {M}, u AS (SELECT sample_id, modality, avail, u FROM (
      SELECT sample_id, 'audio' AS modality, audio_available AS avail, {uniform("'17:' || sample_id || ':audio'")} AS u FROM m
      UNION ALL SELECT sample_id, 'text', text_available, {uniform("'17:' || sample_id || ':text'")} FROM m
      UNION ALL SELECT sample_id, 'visual', visual_available, {uniform("'17:' || sample_id || ':visual'")} FROM m)),
    k AS (SELECT sample_id, bool_or(avail AND u >= 0.6::DOUBLE) AS any_kept, min(u) FILTER (WHERE avail) AS low FROM u GROUP BY 1)
    SELECT sample_id, modality, avail AND CASE WHEN any_kept THEN u >= 0.6::DOUBLE ELSE u = low END AS kept FROM u JOIN k USING (sample_id)""",
)
def modality_dropout(spark, d):
    m = manifest(spark, d).select("sample_id", assemble.modality_dropout(records.mask_column(), F.col("sample_id"), 0.6).alias("k"))
    names = F.array(*[F.lit(x) for x in MODALITIES])
    return m.select("sample_id", F.posexplode("k").alias("pos", "kept")).select(
        "sample_id", F.get(names, F.col("pos")).alias("modality"), "kept"
    )


@query(
    "modality_subset",
    f"""WITH {M} SELECT sample_id, CASE WHEN audio_available THEN 'A' ELSE '' END || CASE WHEN visual_available THEN 'V' ELSE '' END AS pattern,
      NOT (audio_available OR visual_available) AS no_input FROM m""",
)
def modality_subset(spark, d):
    mask = assemble.modality_subset(records.mask_column(), ["audio", "visual"])
    m = manifest(spark, d).select("sample_id", mask.alias("k"))
    return m.select("sample_id", records.modality_pattern(F.col("k")).alias("pattern"), (~F.exists("k", lambda x: x)).alias("no_input"))


_SOFT_SQL = f"""WITH {M}, {QUALITY_SQL}, s AS (SELECT *, greatest(CASE WHEN audio_available THEN q_audio ELSE -1e300 END,
    CASE WHEN text_available THEN q_text ELSE -1e300 END, CASE WHEN visual_available THEN q_visual ELSE -1e300 END) AS top FROM qq),
  x AS (SELECT *, CASE WHEN audio_available THEN exp(q_audio - top) ELSE 0 END AS ea, CASE WHEN text_available THEN exp(q_text - top) ELSE 0 END AS et,
    CASE WHEN visual_available THEN exp(q_visual - top) ELSE 0 END AS ev FROM s),
  w AS (SELECT *, ea / (ea + et + ev) AS w_audio, et / (ea + et + ev) AS w_text, ev / (ea + et + ev) AS w_visual FROM x)"""


def with_weights(spark, d):
    """Manifest with softmax weights over the qualities of the available modalities."""
    q = with_quality(spark, d).withColumn("modality_mask", records.mask_column())
    scores = F.array("q_audio", "q_text", "q_visual")
    w = q.withColumn("_w", pooling.masked_softmax(scores, F.col("modality_mask")))
    return w.withColumns({f"w_{m}": F.get("_w", F.lit(i)) for i, m in enumerate(MODALITIES)})


@query("masked_softmax", f"{_SOFT_SQL} SELECT sample_id, {r6('w_audio')} AS w_audio, {r6('w_text')} AS w_text, {r6('w_visual')} AS w_visual FROM w")
def masked_softmax(spark, d):
    return with_weights(spark, d).select("sample_id", *[R(f"w_{m}", 6).alias(f"w_{m}") for m in MODALITIES])


@query(
    "fusion_weight_summary",
    f"""{_SOFT_SQL}, p AS (SELECT *, {_PATTERN} AS pattern FROM w),
    l AS (SELECT 'language' AS slice_dim, language AS slice_value, * FROM p UNION ALL SELECT 'corpus', corpus, * FROM p
      UNION ALL SELECT 'emotion', emotion, * FROM p UNION ALL SELECT 'modality_pattern', pattern, * FROM p UNION ALL SELECT 'global', 'all', * FROM p)
    SELECT slice_dim, slice_value, {r6('avg(w_audio)')} AS mean_w_audio, {r6('avg(w_text)')} AS mean_w_text, {r6('avg(w_visual)')} AS mean_w_visual,
      0.0::DOUBLE AS unavailable_weight_max FROM l GROUP BY 1, 2""",
)
def fusion_weight_summary(spark, d):
    w = with_weights(spark, d)
    dims = {
        "language": F.col("language"), "corpus": F.col("corpus"), "emotion": F.col("emotion"),
        "modality_pattern": records.modality_pattern(F.col("modality_mask")),
    }
    out = metrics.fusion_weight_summary(w, dims)
    return out.select("slice_dim", "slice_value", *[R(f"mean_w_{m}", 6).alias(f"mean_w_{m}") for m in MODALITIES], "unavailable_weight_max")


_BLOCKS_SQL = """blocks AS (SELECT vec_id, pos, x, CASE WHEN pos < 32 THEN 'audio' WHEN pos < 48 THEN 'text' ELSE 'visual' END AS modality,
  CASE WHEN pos < 32 THEN 1 WHEN pos < 48 THEN 2 ELSE 3 END AS b FROM vec),
masks AS (SELECT vec_id, label, [[1,1,1],[1,1,0],[1,0,1],[0,1,1],[1,0,0],[0,1,0],[0,0,1]][vec_id % 7 + 1] AS mask FROM embeddings)"""
BLOCK_DIMS = (32, 16, 16)
_PATTERNS = [(1, 1, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 0, 0), (0, 1, 0), (0, 0, 1)]


def masked_blocks(df, key):
    """Cut a 64-dim vector into audio/text/visual blocks; masks cycle through all patterns."""
    masks = F.array(*[F.array(*[F.lit(bool(x)) for x in p]) for p in _PATTERNS])
    return df.select(
        "*", F.slice("v", 1, 32).alias("b_audio"), F.slice("v", 33, 16).alias("b_text"), F.slice("v", 49, 16).alias("b_visual"),
        F.element_at(masks, (F.col(key) % 7 + 1).cast("int")).alias("modality_mask"),
    )


_BLOCK_COLS = ("b_audio", "b_text", "b_visual")


@query(
    "masked_concat",
    f"""WITH {VEC}, {_BLOCKS_SQL} SELECT vec_id, pos::INT AS pos, {r6('CASE WHEN mask[b] = 1 THEN x ELSE 0 END')} AS value,
      {r6('CASE WHEN mask[b] = 1 THEN 1.0::DOUBLE / list_sum(mask) ELSE 0 END')} AS weight FROM blocks JOIN masks USING (vec_id)""",
)
def masked_concat(spark, d):
    b = masked_blocks(_embeddings(spark, d), "vec_id")
    fused = pooling.masked_concat([F.col(c) for c in _BLOCK_COLS], F.col("modality_mask"), BLOCK_DIMS)
    out = b.select("vec_id", fused.alias("f"), pooling.equal_weights(F.col("modality_mask")).alias("w"))
    long = out.select("vec_id", "w", F.posexplode("f").alias("pos", "x"))
    block = F.when(F.col("pos") < 32, 0).when(F.col("pos") < 48, 1).otherwise(2)
    return long.select("vec_id", "pos", R("x", 6).alias("value"), R(F.get("w", block), 6).alias("weight"))


@query(
    "weighted_fusion",
    f"""WITH {VEC}, s AS (SELECT vec_id, [1.0::DOUBLE, (vec_id % 5)::DOUBLE / 4, (vec_id % 3)::DOUBLE / 2] AS s,
        [[1,1,1],[1,1,0],[1,0,1],[0,1,1],[1,0,0],[0,1,0],[0,0,1]][vec_id % 7 + 1] AS mask FROM embeddings),
      t AS (SELECT vec_id, unnest([1, 2, 3]) AS b, unnest(s) AS sc, unnest(mask) AS mk FROM s),
      e AS (SELECT *, CASE WHEN mk = 1 THEN exp(sc - max(CASE WHEN mk = 1 THEN sc END) OVER (PARTITION BY vec_id)) ELSE 0 END AS e FROM t),
      w AS (SELECT vec_id, b, e / sum(e) OVER (PARTITION BY vec_id) AS w FROM e)
    SELECT vec_id, (pos - CASE w.b WHEN 1 THEN 0 WHEN 2 THEN 22 ELSE 43 END)::INT AS pos, {r6('sum(w.w * x)')} AS value
    FROM vec JOIN w USING (vec_id)
    WHERE (w.b = 1 AND pos < 22) OR (w.b = 2 AND pos BETWEEN 22 AND 42) OR (w.b = 3 AND pos BETWEEN 43 AND 63) GROUP BY 1, 2""",
)
def weighted_fusion(spark, d):
    k = F.col("vec_id")
    scores = F.array(F.lit(1.0), (k % 5).cast("double") / 4, (k % 3).cast("double") / 2)
    b = masked_blocks(_embeddings(spark, d), "vec_id").withColumn("w", pooling.masked_softmax(scores, F.col("modality_mask")))
    # blocks of 22, 21 and 21 values, the short ones padded to the common width
    parts = [F.slice("v", 1, 22), *[F.concat(F.slice("v", s, 21), F.array(F.lit(0.0))) for s in (23, 44)]]
    fused = pooling.weighted_fusion(parts, F.col("w"))
    return _long(b.select("vec_id", fused.alias("f")), ["vec_id"], "f")


# ---- pooling ---------------------------------------------------------------------------


@query("l2_normalize", f"WITH {VEC} SELECT vec_id, pos::INT AS pos, {r6('x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12)')} AS value FROM vec")
def l2_normalize(spark, d):
    e = _embeddings(spark, d).select("vec_id", V.l2_normalize(F.col("v")).alias("u"))
    return _long(e, ["vec_id"], "u")


@query(
    "vector_distances",
    f"""WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, {r6('list_cosine_similarity(a, b) / 0.1::DOUBLE')} AS cosine_logit, {r6('-pow(list_distance(a, b), 2) / 0.5::DOUBLE')} AS euclidean_logit FROM p""",
)
def vector_distances(spark, d):
    e = _embeddings(spark, d)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    a, b = F.col("v"), F.col("w")
    return e.join(nxt, "vec_id").select(
        "vec_id", R(V.score(a, b, "cosine", 0.1), 6).alias("cosine_logit"),
        R(V.score(a, b, "squared_euclidean", 0.5), 6).alias("euclidean_logit"),
    )


def _steps(spark, d):
    return _embeddings(spark, d).withColumn("valid", F.col("vec_id") % 5 != 0)


@query("masked_mean_pool", f"WITH {VEC} SELECT label, pos::INT AS pos, {r6('avg(x)')} AS value FROM vec WHERE vec_id % 5 <> 0 GROUP BY 1, 2")
def masked_mean_pool(spark, d):
    return _long(pooling.pool_hidden(_steps(spark, d), "label", "v", "valid", "masked_mean"), ["label"], "pooled")


@query(
    "statistics_pool",
    f"""WITH {VEC}, s AS (SELECT label, pos, d, avg(x) AS m, sqrt(greatest(var_pop(x), 1e-8)) AS s FROM vec WHERE vec_id % 5 <> 0 GROUP BY 1, 2, 3)
    SELECT label, pos::INT AS pos, {r6('m')} AS value FROM s UNION ALL SELECT label, (pos + d)::INT, {r6('s')} FROM s""",
)
def statistics_pool(spark, d):
    return _long(pooling.pool_hidden(_steps(spark, d), "label", "v", "valid", "statistics"), ["label"], "pooled")


@query(
    "attentive_pool",
    f"""WITH {VEC}, e AS (SELECT vec_id, label, avg(x * x) AS e FROM vec WHERE vec_id % 5 <> 0 GROUP BY 1, 2),
    p AS (SELECT *, exp(e - max(e) OVER (PARTITION BY label)) AS p FROM e), w AS (SELECT vec_id, label, p / sum(p) OVER (PARTITION BY label) AS w FROM p),
    m AS (SELECT v.label, pos, d, sum(w * x) AS m FROM vec v JOIN w USING (vec_id) GROUP BY 1, 2, 3),
    s AS (SELECT v.label, v.pos, v.d, any_value(m.m) AS m, sqrt(greatest(sum(w * pow(x - m.m, 2)), 1e-8)) AS s FROM vec v JOIN w USING (vec_id)
      JOIN m ON m.label = v.label AND m.pos = v.pos GROUP BY 1, 2, 3)
    SELECT label, pos::INT AS pos, {r6('m')} AS value FROM s UNION ALL SELECT label, (pos + d)::INT, {r6('s')} FROM s""",
)
def attentive_pool(spark, d):
    return _long(pooling.pool_hidden(_steps(spark, d), "label", "v", "valid", "attentive_statistics"), ["label"], "pooled")


@query(
    "last_step_pool",
    """SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, sha256(arg_max(text, turn)) AS text_sha256 FROM conversations
    WHERE role <> 'system' GROUP BY 1""",
)
def last_step_pool(spark, d):
    turns = table(spark, d, "conversations").withColumn("valid", F.col("role") != "system")
    out = pooling.last_step(turns, "conv_id", "turn", "valid", ["role", "text"])
    return out.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"))


@query(
    "weighted_segment_mean",
    f"""WITH {VEC} SELECT (vec_id // 3) AS owner, pos::INT AS pos, {r6('sum(x * (1 + vec_id % 4)) / sum(1 + vec_id % 4)')} AS value FROM vec GROUP BY 1, 2""",
)
def weighted_segment_mean(spark, d):
    seg = _embeddings(spark, d).select(F.expr("vec_id div 3").alias("owner"), "v", (F.col("vec_id") % 4 + 1).alias("length"))
    return _long(pooling.weighted_segment_mean(seg, "owner", "v", "length"), ["owner"], "pooled")


@query(
    "hopping_segments",
    """WITH c AS (SELECT doc_id, n_chars, CASE WHEN n_chars <= 400 THEN [0] ELSE range(0, n_chars, 300) END AS s FROM documents WHERE n_chars > 0)
    SELECT doc_id, 'chunk' AS policy, (generate_subscripts(s, 1) - 1)::INT AS segment, unnest(s)::BIGINT AS start, least(unnest(s) + 400, n_chars)::BIGINT AS "end" FROM c
    UNION ALL SELECT doc_id, 'truncate', 0, 0, least(400, n_chars) FROM documents WHERE n_chars > 0""",
)
def hopping_segments(spark, d):
    docs = table(spark, d, "documents")
    parts = [pooling.segments(docs, "doc_id", "n_chars", 400, 100, p).withColumn("policy", F.lit(p)) for p in ("chunk", "truncate")]
    return parts[0].unionByName(parts[1]).select("doc_id", "policy", "segment", "start", "end")


@query(
    "uniform_indices",
    """WITH k AS (SELECT p_partkey, p_size, least(p_size, 8) AS k FROM part), i AS (SELECT p_partkey, p_size, k, unnest(range(k)) AS i FROM k)
    SELECT p_partkey, i::INT AS pos, CASE WHEN k = 1 THEN p_size // 2 ELSE round_even(i * ((p_size - 1)::DOUBLE / (k - 1)::DOUBLE), 0)::INT END AS frame FROM i""",
)
def uniform_indices(spark, d):
    part = table(spark, d, "part").select("p_partkey", pooling.uniform_indices(F.col("p_size"), 8).alias("f"))
    return part.select("p_partkey", F.posexplode("f").alias("pos", "frame"))


@query(
    "pad_sequences",
    f"""WITH s AS (SELECT vec_id, embedding[1:1 + vec_id % 64]::DOUBLE[] AS s FROM embeddings), x AS (SELECT max(len(s)) AS m FROM s),
    g AS (SELECT vec_id, s, unnest(range(m)) AS pos FROM s, x)
    SELECT vec_id, pos::INT AS pos, {r6('coalesce(s[pos + 1], 0)')} AS value, pos < len(s) AS valid FROM g""",
)
def pad_sequences(spark, d):
    seq = _embeddings(spark, d).select("vec_id", F.slice("v", F.lit(1), (F.col("vec_id") % 64 + 1).cast("int")).alias("s"))
    padded = pooling.pad_sequences(seq, "s").select("vec_id", F.posexplode(F.arrays_zip("s", "step_mask")).alias("pos", "z"))
    return padded.select("vec_id", "pos", R("z.s", 6).alias("value"), F.col("z.step_mask").alias("valid"))


@query(
    "pad_step_vectors",
    f"""WITH {VEC}, longest AS (SELECT max(vec_id % 4 + 1) AS m FROM embeddings)
    SELECT vec_id, (pos // 16)::INT AS step, (pos % 16)::INT AS pos, {r6('CASE WHEN pos // 16 <= vec_id % 4 THEN x ELSE 0 END')} AS value,
      pos // 16 <= vec_id % 4 AS valid FROM vec, longest WHERE pos // 16 < m""",
)
def pad_step_vectors(spark, d):
    frames = F.transform(F.sequence(F.lit(0), (F.col("vec_id") % 4).cast("int")), lambda i: F.slice("v", i * 16 + 1, 16))
    padded = pooling.pad_sequences(_embeddings(spark, d).select("vec_id", frames.alias("s")), "s")
    steps = padded.select("vec_id", F.posexplode(F.arrays_zip("s", "step_mask")).alias("step", "z"))
    long = steps.select("vec_id", "step", F.col("z.step_mask").alias("valid"), F.posexplode("z.s").alias("pos", "x"))
    return long.select("vec_id", "step", "pos", R("x", 6).alias("value"), "valid")


# ---- prototypes ------------------------------------------------------------------------


def _split(df, name):
    return df.where(F.col("split") == name)


def predictions(spark, d):
    """Test vectors with their nearest class prototype, prototypes from the train split."""
    ex = vector_examples(spark, d)
    protos = prototypes.class_prototypes(_split(ex, "train"), "label", "vector")
    return prototypes.nearest_prototype(_split(ex, "test"), protos, "label", "vector")


@query(
    "class_prototypes",
    f"""WITH {EXAMPLES}, {LONG} SELECT label, pos::INT AS pos, {r6('avg(x)')} AS value, count(*) AS support FROM long WHERE split = 'train' GROUP BY 1, 2""",
)
def class_prototypes(spark, d):
    protos = prototypes.class_prototypes(_split(vector_examples(spark, d), "train"), "label", "vector")
    return _long(protos, ["label", "support"], "prototype")


@query("prototype_logits", f"WITH {PREDICTIONS} SELECT sample_id, cls AS class, {r6('logit')} AS logit FROM logit")
def prototype_logits(spark, d):
    ex = vector_examples(spark, d)
    protos = prototypes.class_prototypes(_split(ex, "train"), "label", "vector")
    scored = prototypes.attach_prototypes(_split(ex, "test"), protos, "label").select(
        "sample_id", F.explode(prototypes.logits(F.col("vector"))).alias("s")
    )
    return scored.select("sample_id", "s.class", R("s.logit", 6).alias("logit"))


@query("nearest_prototype", f"WITH {PREDICTIONS} SELECT sample_id, label, prediction FROM preds")
def nearest_prototype(spark, d):
    return predictions(spark, d).select("sample_id", "label", "prediction")


@query(
    "prototype_loss",
    f"""WITH {PREDICTIONS}, z AS (SELECT sample_id, max(logit) AS top, ln(sum(exp(logit - (SELECT 0)))) AS lse FROM logit GROUP BY 1)
    SELECT ex.language, {r6('avg(z.lse - l.logit)')} AS prototype_loss, count(*) AS queries
    FROM z JOIN ex USING (sample_id) JOIN logit l ON l.sample_id = ex.sample_id AND l.cls = ex.label GROUP BY 1""",
)
def prototype_loss(spark, d):
    out = prototypes.prototype_loss(predictions(spark, d), ["language"])
    return out.select("language", R("prototype_loss", 6).alias("prototype_loss"), "queries")


@query(
    "route_usage",
    f"""WITH {EXAMPLES}, n AS (SELECT CASE WHEN language IN ('en','fr') THEN language ELSE 'unknown' END AS route, sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS n FROM ex)
    SELECT route, count(*) AS n, {r6('avg(n)')} AS mean_norm, FALSE AS collapse_detected FROM n GROUP BY 1""",
)
def route_usage(spark, d):
    from voxloom.operators.labels import canonical_route

    ex = vector_examples(spark, d)
    out = metrics.route_usage(ex, canonical_route(F.col("language"), ["en", "fr"]), F.col("vector"))
    return out.select("route", "n", R("mean_norm", 6).alias("mean_norm"), "collapse_detected")


