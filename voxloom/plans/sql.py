"""Building blocks of the comparison SQL (DuckDB dialect)."""

from voxloom.functions.text import FOLD_MORE, FOLD_ONE


def hex_digits(expr: str, digits: int) -> str:
    return f"('0x' || substr(sha256({expr}), 1, {digits}))::UBIGINT"


def padded(expr: str, width: int) -> str:
    """At least ``width`` digits; a longer number is never cut."""
    return f"lpad({expr}::VARCHAR, greatest({width}, length({expr}::VARCHAR))::INT, '0')"


def hash_int(expr: str) -> str:
    return f"({hex_digits(expr, 15)})::BIGINT"


def uniform(expr: str) -> str:
    return f"(({hex_digits(expr, 13)})::DOUBLE / 4503599627370496.0::DOUBLE)"


def row_split(key: str) -> str:
    u = uniform(f"'17:' || {key}::VARCHAR")
    return f"CASE WHEN {u} < 0.70::DOUBLE THEN 'train' WHEN {u} < 0.85::DOUBLE THEN 'validation' ELSE 'test' END"


def norm_text(expr: str) -> str:
    folded = f"translate(lower({expr}), '{''.join(FOLD_ONE)}', '{''.join(FOLD_ONE.values())}')"
    for c, several in FOLD_MORE.items():
        folded = f"replace({folded}, '{c}', '{several}')"
    return rf"regexp_replace({folded}, '[^\p{{L}}\p{{N}}_]+', '', 'g')"


def r6(expr: str) -> str:
    """Rounded double without negative zero."""
    return f"(round(({expr})::DOUBLE, 6) + 0.0::DOUBLE)"


def split_by_rank(rank: str, n: str) -> str:
    """Largest-remainder 70/15/15 cut of a rank."""
    s = [f"({n}::DOUBLE * {r}::DOUBLE)" for r in ("0.7", "0.15", "0.15")]
    f = [f"floor({x})" for x in s]
    d = [f"({x} - {y})" for x, y in zip(s, f)]
    left = f"({n} - {f[0]} - {f[1]} - {f[2]})"
    a0 = f"(({d[1]} > {d[0]})::INT + ({d[2]} > {d[0]})::INT)"
    a1 = f"(({d[0]} >= {d[1]})::INT + ({d[2]} > {d[1]})::INT)"
    train = f"({f[0]} + ({a0} < {left})::INT)"
    validation = f"({f[1]} + ({a1} < {left})::INT)"
    return (
        f"CASE WHEN {rank} <= {train} THEN 'train' "
        f"WHEN {rank} <= {train} + {validation} THEN 'validation' ELSE 'test' END"
    )


RAW = f"""
raw AS (
  SELECT d.doc_id,
    'doc-' || {padded('d.doc_id', 8)} AS sample_id,
    CASE WHEN e.vec_id IS NOT NULL THEN 'audio/' || sha256(d.text) || '.wav' END AS audio_path,
    CASE WHEN l.doc_id IS NOT NULL THEN 'video/' || d.doc_id::VARCHAR || '.mp4' END AS video_path,
    d.text AS transcript,
    ['angry','happy','neutral','sad','fearful','disgusted','surprised'][(d.doc_id % 7 + 1)] AS source_emotion,
    d.source AS speaker_id, d.lang AS language,
    'corpus' || (substr(d.source, 4)::INT % 4)::VARCHAR AS corpus,
    {row_split('d.doc_id')} AS split,
    d.n_chars::DOUBLE / 15.0::DOUBLE AS duration,
    CASE d.doc_id % 3 WHEN 0 THEN 'gold' WHEN 1 THEN 'asr' END AS transcript_source,
    (l.quality + l.toxic)::DOUBLE / 2.0::DOUBLE AS asr_confidence,
    e.vec_id IS NOT NULL AS audio_available,
    length(trim(d.text)) > 0 AS text_available,
    l.doc_id IS NOT NULL AS visual_available,
    NULL::VARCHAR AS country, NULL::VARCHAR AS region, NULL::VARCHAR AS accent,
    d.source || '-' || (d.doc_id // 10)::VARCHAR AS source_video_id,
    NULL::VARCHAR AS sentence_code, NULL::VARCHAR AS intensity
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""

M = f"""{RAW},
m AS (SELECT *, source_emotion AS emotion FROM raw WHERE source_emotion IN ('angry','happy','neutral','sad'))"""

SPEAKERS = f"""
spk AS (
  SELECT speaker_id, {split_by_rank('rn', 'n')} AS split_grp FROM (
    SELECT speaker_id, row_number() OVER (ORDER BY sha256('17:' || speaker_id), speaker_id) AS rn, count(*) OVER () AS n
    FROM (SELECT DISTINCT source AS speaker_id FROM documents))
)"""

EXAMPLES = f"""
ex AS (
  SELECT e.vec_id AS sample_id, e.label, e.embedding::DOUBLE[] AS vector, {row_split('e.vec_id')} AS split,
    coalesce(d.lang, 'unknown') AS language, coalesce(d.source, 'unknown') AS speaker_id
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id
)"""

LONG = """
long AS (
  SELECT sample_id, label, split, language, speaker_id,
    generate_subscripts(vector, 1) - 1 AS pos, unnest(vector) AS x FROM ex
)"""

# Nearest prototype of every test vector, prototypes from the train split.
PREDICTIONS = f"""{EXAMPLES},{LONG},
proto AS (SELECT label AS cls, pos, avg(x) AS m FROM long WHERE split = 'train' GROUP BY 1, 2),
pnorm AS (SELECT cls, sqrt(sum(m * m)) AS pn FROM proto GROUP BY 1),
qnorm AS (SELECT sample_id, sqrt(sum(x * x)) AS qn FROM long WHERE split = 'test' GROUP BY 1),
dots AS (SELECT l.sample_id, p.cls, sum(l.x * p.m) AS d FROM long l JOIN proto p ON p.pos = l.pos
  WHERE l.split = 'test' GROUP BY 1, 2),
logit AS (SELECT d.sample_id, d.cls, d.d / (greatest(qn, 1e-12) * greatest(pn, 1e-12)) / 0.1::DOUBLE AS logit
  FROM dots d JOIN pnorm USING (cls) JOIN qnorm USING (sample_id)),
pred AS (SELECT sample_id, arg_max(cls, logit) AS prediction, max(logit) AS top FROM logit GROUP BY 1),
preds AS (SELECT ex.sample_id, ex.label, ex.language, ex.speaker_id, pred.prediction FROM pred JOIN ex USING (sample_id))"""


def metrics_sql(source: str, by: list[str], k: int) -> str:
    """CTEs ending in ``per_class``: every class of every slice of ``source``."""
    keys = "".join(f"{b}, " for b in by)
    on = " AND ".join([f"a.{b} = s.{b}" for b in by] + ["TRUE"])
    own = "".join(f"s.{b}, " for b in by)
    slices = f"SELECT DISTINCT {', '.join(by)} FROM {source}" if by else "SELECT 1 AS one"
    return f"""
slice AS ({slices}),
grid AS (SELECT s.*, c.class FROM slice s, (SELECT unnest(range({k}))::INT AS class) c),
tallies AS (
  SELECT {own} s.class,
    count(CASE WHEN a.label = s.class THEN 1 END) AS support,
    count(CASE WHEN a.prediction = s.class THEN 1 END) AS predicted,
    count(CASE WHEN a.label = s.class AND a.prediction = s.class THEN 1 END) AS tp
  FROM grid s JOIN {source} a ON {on} GROUP BY {own} s.class),
rates AS (
  SELECT *, CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0.0::DOUBLE END AS recall,
    CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0.0::DOUBLE END AS prec FROM tallies),
per_class AS (
  SELECT {keys} class, support, predicted, tp, recall, prec AS precision,
    CASE WHEN prec + recall > 0 THEN 2 * prec * recall / (prec + recall) ELSE 0.0::DOUBLE END AS f1 FROM rates)"""


def ci95(value: str, clamp: bool = True) -> str:
    half = f"(1.96::DOUBLE * coalesce(stddev_samp({value}), 0.0) / sqrt(count({value})))"
    low, high = f"avg({value}) - {half}", f"avg({value}) + {half}"
    if clamp:
        low, high = f"greatest(0.0::DOUBLE, {low})", f"least(1.0::DOUBLE, {high})"
    return (
        f"count({value}) AS n, {r6(f'avg({value})')} AS mean, {r6(f'coalesce(stddev_samp({value}), 0.0)')} AS std, "
        f"{r6(low)} AS ci95_low, {r6(high)} AS ci95_high"
    )


def ordinary_slots(n_way: int, k: int, q: int, episodes: int, seed: int = 17, tag: str = "") -> str:
    """CTEs over ``exs(task, label, sample_id, ...)`` ending in ``mem{tag}``."""
    size = k + q
    e = "p.episode::VARCHAR"
    start = hash_int(f"'{seed}:' || {e} || ':' || p.label::VARCHAR || ':start'")
    stride = hash_int(f"'{seed}:' || {e} || ':' || p.label::VARCHAR || ':stride'")
    return f"""
cnt{tag} AS (SELECT task, label, count(*) AS n FROM exs GROUP BY 1, 2 HAVING count(*) >= {size}),
elig{tag} AS (SELECT task, row_number() OVER (ORDER BY sha256('{seed}:' || task), task) AS task_no
  FROM (SELECT task FROM cnt{tag} GROUP BY 1 HAVING count(*) >= {n_way})),
epi{tag} AS (SELECT i AS episode, 1 + {hash_int(f"'{seed}:' || i::VARCHAR || ':task'")} % (SELECT count(*) FROM elig{tag}) AS task_no
  FROM range({episodes}) t(i)),
pick{tag} AS (SELECT * FROM (
  SELECT ep.episode, el.task, c.label, c.n,
    row_number() OVER (PARTITION BY ep.episode ORDER BY sha256('{seed}:' || ep.episode::VARCHAR || ':' || c.label::VARCHAR)) AS o
  FROM epi{tag} ep JOIN elig{tag} el USING (task_no) JOIN cnt{tag} c USING (task)) WHERE o <= {n_way}),
want{tag} AS (SELECT p.episode, p.task, p.label, s.slot,
    1 + ({start} % p.n + s.slot * (1 + {stride} % greatest(1, (p.n - 1) // {max(size - 1, 1)}))) % p.n AS rn
  FROM pick{tag} p, (SELECT unnest(range({size})) AS slot) s),
rank{tag} AS (SELECT *, row_number() OVER (PARTITION BY task, label ORDER BY sha256('{seed}:' || sample_id::VARCHAR), sample_id) AS rn FROM exs),
mem{tag} AS (SELECT w.episode, {k} AS k_shot, r.* EXCLUDE (rn), CASE WHEN w.slot < {k} THEN 'support' ELSE 'query' END AS role
  FROM want{tag} w JOIN rank{tag} r USING (task, label, rn))"""
