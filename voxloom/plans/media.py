"""Queries on media payloads that Spark derives from the tables (binaryFile layout)."""

from pyspark.sql import Column, functions as F

from voxloom.plans.bindings import manifest, table
from voxloom.plans.registry import query
from voxloom.plans.sql import M, r6
from voxloom.sources import media

R = F.round


def _le(value: Column, size: int) -> Column:
    """Little-endian hex digits of a non-negative (or two's complement) integer."""
    n = value.cast("bigint")
    return F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)])


def wav_files(spark, d):
    """A WAV per embedding: its values as PCM16 samples, mono or stereo, at three rates.

    Every eleventh file is empty, has a foreign magic number or holds no samples.
    """
    k = F.col("vec_id")
    channels = (k % 2 + 1).cast("int")
    rate = F.when(k % 3 == 0, 16000).when(k % 3 == 1, 44100).otherwise(8000)
    pcm = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda x: F.least(F.lit(32767), F.greatest(F.lit(-32768), F.round(x * F.lit(120000.0)).cast("int"))),
    )
    body = F.when(k % 11 == 2, "").otherwise(F.array_join(F.transform(pcm, lambda v: _le(v, 2)), ""))
    size = (F.length("_body") / 2).cast("int")
    magic = F.when(k % 11 == 1, "52494658").otherwise("52494646")
    header = F.concat(
        magic, _le(size + 36, 4), F.lit("57415645666D7420"), _le(F.lit(16), 4), _le(F.lit(1), 2), _le(channels, 2),
        _le(rate, 4), _le(rate * channels * 2, 4), _le(channels * 2, 2), _le(F.lit(16), 2), F.lit("64617461"), _le(size, 4),
    )
    content = F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(header, "_body"))
    made = table(spark, d, "embeddings").withColumn("_body", body).select(
        F.concat(F.lit("audio/"), k.cast("string"), F.lit(".wav")).alias("path"), F.unhex(content).alias("content")
    )
    return made.select("path", F.octet_length("content").cast("bigint").alias("length"), "content")


_WAV_SQL = """w AS (SELECT vec_id, 'audio/' || vec_id::VARCHAR || '.wav' AS path, vec_id % 11 AS k, vec_id % 2 + 1 AS ch,
  CASE vec_id % 3 WHEN 0 THEN 16000 WHEN 1 THEN 44100 ELSE 8000 END AS rate, CASE WHEN vec_id % 11 = 2 THEN 0 ELSE len(embedding) END AS n,
  list_transform(embedding, lambda x: least(32767, greatest(-32768, round(x::DOUBLE * 120000.0::DOUBLE)::INT))) AS s FROM embeddings)"""


@query(
    "wav_profile",
    f"""WITH {_WAV_SQL} SELECT path, CASE WHEN k = 0 THEN 0 ELSE 44 + 2 * n END::BIGINT AS length, k > 1 AS decodable,
      CASE WHEN k > 1 THEN ch END::BIGINT AS channels, CASE WHEN k > 1 THEN rate END::BIGINT AS sample_rate, CASE WHEN k > 1 THEN 2 END::BIGINT AS sample_width,
      CASE WHEN k > 1 THEN n // ch END::BIGINT AS frames, CASE WHEN k > 1 THEN {r6('(n // ch)::DOUBLE / rate')} END AS duration FROM w""",
)
def wav_profile(spark, d):
    return media.wav_header(wav_files(spark, d)).select(
        "path", "length", "decodable", "channels", "sample_rate", "sample_width", "frames", R("duration", 6).alias("duration")
    )


@query(
    "wav_problems",
    f"""WITH {_WAV_SQL} SELECT path, CASE WHEN k = 0 THEN 'empty' WHEN k IN (1, 2) THEN 'corrupt' END AS problem FROM w""",
)
def wav_problems(spark, d):
    return media.media_problem(wav_files(spark, d), "audio").select("path", "problem")


@query(
    "audio_profile",
    f"""WITH {_WAV_SQL},
    mono AS (SELECT path, ch, rate, n // ch AS n, CASE WHEN ch = 1 THEN list_transform(s, lambda v: v / 32768.0::DOUBLE)
      ELSE list_transform(range(n // 2), lambda i: (s[2 * i + 1] + s[2 * i + 2]) / 65536.0::DOUBLE) END AS m FROM w WHERE k > 2),
    t AS (SELECT *, CASE WHEN rate = 16000 THEN n ELSE greatest(1, round_even(n * 16000.0::DOUBLE / rate, 0)::INT) END AS t FROM mono),
    i AS (SELECT *, unnest(range(t)) AS i FROM t),
    p AS (SELECT *, CASE WHEN t = 1 THEN 0 WHEN i = t - 1 THEN n - 1 ELSE i * ((n - 1)::DOUBLE / (t - 1)::DOUBLE) END::DOUBLE AS pos FROM i),
    v AS (SELECT path, ch, rate, t, CASE WHEN floor(pos) >= n - 1 THEN m[n] ELSE (m[floor(pos)::INT + 2] - m[floor(pos)::INT + 1]) * (pos - floor(pos)) + m[floor(pos)::INT + 1] END::FLOAT::DOUBLE AS v FROM p)
    SELECT path, rate::INT AS source_sample_rate, ch::INT AS source_channels, t::INT AS samples, {r6('t::DOUBLE / 16000')} AS duration, {r6('sqrt(avg(v * v))')} AS rms,
      {r6('max(abs(v))')} AS peak, {r6('avg((abs(v) >= 32767.0::DOUBLE / 32768.0::DOUBLE)::INT)')} AS clipping_fraction, FALSE AS failed FROM v GROUP BY ALL
    UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, NULL, NULL, TRUE FROM w WHERE k <= 2""",
)
def audio_profile(spark, d):
    out = media.audio_profile(wav_files(spark, d))
    return out.select(
        "path", "source_sample_rate", "source_channels", "samples",
        *[R(c, 6).alias(c) for c in ("duration", "rms", "peak", "clipping_fraction")], F.col("error").isNotNull().alias("failed"),
    )


_SUFFIXES = (".mp4", ".mov", ".avi", ".flv", ".mkv", ".webm", ".wmv")
_MAGIC = ("0000001866747970", "0000001466747970", "524946460000000041564920", "464C5601", "1A45DFA3", "1A45DFA3", "3026B275")


@query(
    "container_check",
    """SELECT 'video/' || page_id::VARCHAR || ['.mp4','.mov','.avi','.flv','.mkv','.webm','.wmv'][page_id % 7 + 1] AS path,
      CASE WHEN page_id % 9 = 0 THEN 'empty' WHEN page_id % 7 = 6 THEN 'unsupported_container' WHEN page_id % 5 = 0 THEN 'corrupt' END AS problem FROM pages""",
)
def container_check(spark, d):
    k = F.col("page_id")
    pick = (k % 7 + 1).cast("int")
    suffix = F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), pick)
    magic = F.when(k % 5 == 0, "").otherwise(F.element_at(F.array(*[F.lit(s) for s in _MAGIC]), pick))
    content = F.unhex(F.when(k % 9 == 0, "").otherwise(F.concat(magic, F.hex("html"))))
    files = table(spark, d, "pages").select(
        F.concat(F.lit("video/"), k.cast("string"), suffix).alias("path"), content.alias("content")
    ).select("path", F.octet_length("content").cast("bigint").alias("length"), "content")
    return media.media_problem(files, "video").select("path", "problem")


@query(
    "media_inventory",
    "SELECT 'pages/' || page_id::VARCHAR AS path, strlen(html)::BIGINT AS length, strlen(html) > 256 AS present, sha256(html) AS file_sha256 FROM pages",
)
def media_inventory(spark, d):
    files = table(spark, d, "pages").select(
        F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"),
        F.octet_length("html").cast("bigint").alias("length"), F.encode("html", "UTF-8").alias("content"),
    )
    return media.inventory(files)


@query(
    "media_issues",
    f"""WITH {M}, v AS (SELECT sample_id, video_path, CASE WHEN l.quality = 0 THEN 'missing' WHEN l.toxic = 1 THEN 'empty' WHEN language <> 'en' THEN 'corrupt' END AS p
      FROM m JOIN labels l USING (doc_id) WHERE visual_available)
    SELECT p || '_video' AS code, 'error' AS severity, video_path AS subject, sample_id FROM v WHERE p IS NOT NULL""",
)
def media_issues(spark, d):
    """Files exist for documents of quality 1; toxic ones are empty, foreign ones broken."""
    payload = F.concat(F.when(F.col("lang") != "en", "00").otherwise("0000001866747970"), F.hex("text"))
    rated = table(spark, d, "labels").where("quality = 1")
    files = table(spark, d, "documents").join(rated, "doc_id").select(
        F.concat(F.lit("video/"), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("path"),
        F.unhex(F.when(F.col("toxic") == 1, "").otherwise(payload)).alias("content"),
    ).select("path", F.octet_length("content").cast("bigint").alias("length"), "content")
    return media.media_issues(manifest(spark, d), media.media_problem(files, "video"), "video")


_W, _H = 4, 2


@query(
    "frame_profile",
    f"""WITH f AS (SELECT doc_id, i AS frame, sha256(text || ':' || i::VARCHAR) AS h FROM documents, range(3) t(i)),
    g AS (SELECT doc_id, frame, p, (('0x' || substr(h, 6 * p + 1, 2))::INT + ('0x' || substr(h, 6 * p + 3, 2))::INT + ('0x' || substr(h, 6 * p + 5, 2))::INT) / 3.0::DOUBLE / 255.0::DOUBLE AS g
      FROM f, range({_W * _H}) t(p)),
    b AS (SELECT doc_id, frame, avg(g) AS b FROM g GROUP BY 1, 2),
    v AS (SELECT a.doc_id, a.frame, avg(pow(b.g - a.g, 2)) AS e FROM g a JOIN g b ON b.doc_id = a.doc_id AND b.frame = a.frame AND b.p = a.p + {_W} GROUP BY 1, 2),
    h AS (SELECT a.doc_id, a.frame, avg(pow(b.g - a.g, 2)) AS e FROM g a JOIN g b ON b.doc_id = a.doc_id AND b.frame = a.frame AND b.p = a.p + 1 AND a.p % {_W} < {_W - 1} GROUP BY 1, 2)
    SELECT doc_id::VARCHAR AS clip, count(*) AS frames, {r6('avg(b)')} AS mean_brightness, {r6('avg(v.e + h.e)')} AS mean_gradient_energy
    FROM b JOIN v USING (doc_id, frame) JOIN h USING (doc_id, frame) GROUP BY 1""",
)
def frame_profile(spark, d):
    frames = table(spark, d, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("frame"))
    digest = F.sha2(F.concat("text", F.lit(":"), F.col("frame").cast("string")), 256)
    made = frames.select(
        F.col("doc_id").cast("string").alias("clip"), "frame", F.lit(_W).alias("width"), F.lit(_H).alias("height"),
        F.unhex(F.substring(digest, 1, 6 * _W * _H)).alias("rgb"),
    )
    out = media.frame_profile(made)
    return out.select("clip", "frames", R("mean_brightness", 6).alias("mean_brightness"), R("mean_gradient_energy", 6).alias("mean_gradient_energy"))
