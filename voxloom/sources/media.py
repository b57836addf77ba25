"""Media payloads in the layout of Spark's ``binaryFile`` source (path, length, content)."""

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from voxloom.schemas import VIDEO_SUFFIXES


def read_media(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern).load(path).select("path", "length", "content")
    )


def stat_files(paths: DataFrame, column: str, root: str) -> DataFrame:
    """Size of each path below the root, NULL when there is no such file.

    Spark's file sources leave out empty files, so they need a look at the file system;
    tasks ask for their own rows only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            found = system.get_file_info([f"{base.rstrip('/')}/{p}" for p in batch[column]])
            sizes = [i.size if i.type == fs.FileType.File else None for i in found]
            yield batch.assign(size=pd.array(sizes, dtype="Int64"))

    schema = T.StructType([*paths.schema.fields, T.StructField("size", T.LongType())])
    return paths.mapInPandas(run, schema)


def inventory(media: DataFrame, minimum: int = 256) -> DataFrame:
    """Size check and content digest per file."""
    return media.select(
        "path", "length", (F.col("length") > minimum).alias("present"), F.sha2("content", 256).alias("file_sha256")
    )


HEADER = (
    "path string, length long, decodable boolean, channels int, sample_rate int, sample_width int, "
    "frames long, duration double"
)
PCM, EXTENSIBLE = 1, 0xFFFE


def wav_facts(head: bytes, length: int) -> dict:
    """Format and frames of a WAV file from its first bytes, chunk by chunk.

    Extensible files carry their real format in the first two bytes of the sub-format.
    """
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return {"decodable": False}
    at, facts = 12, None
    while at + 8 <= len(head):
        name, size = head[at : at + 4], int.from_bytes(head[at + 4 : at + 8], "little")
        body = head[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if tag == EXTENSIBLE and len(body) >= 26:
                tag = int.from_bytes(body[24:26], "little")
            facts = (tag, channels, rate, -(-bits // 8))
        elif name == b"data":
            if facts is None:
                break
            tag, channels, rate, width = facts
            frames = min(size, max(0, length - at - 8)) // (channels * width) if channels * width else 0
            return {
                "decodable": tag == PCM and channels * width * rate > 0, "channels": channels, "sample_rate": rate,
                "sample_width": width, "frames": frames, "duration": frames / rate if rate else None, "start": at + 8,
            }
        at += 8 + size + size % 2
    return {"decodable": False}


def wav_header(media: DataFrame) -> DataFrame:
    """Channels, rate, width, frames and duration per WAV file; ``decodable`` is false for
    anything but uncompressed PCM with a format chunk before its data."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in HEADER.split(", ")]
        for batch in batches:
            rows = [
                {"path": p, "length": n, **wav_facts(bytes(c if c is not None else b""), n)}
                for p, n, c in zip(batch["path"], batch["length"], batch["content"])
            ]
            frame = pd.DataFrame(rows, columns=names)
            for c in ("channels", "sample_rate", "sample_width", "frames"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    return media.select("path", "length", "content").mapInPandas(run, HEADER)


def media_problem(media: DataFrame, kind: str) -> DataFrame:
    """``problem`` per file: empty, corrupt, unsupported_container or NULL.

    Audio problems come from the WAV header, video problems from suffix and magic bytes.
    """
    c, path = F.col("content"), F.lower("path")
    head = lambda start, size: F.hex(F.substring(c, start, size))
    if kind == "audio":
        checked = wav_header(media)
        bad = ~F.col("decodable") | ~F.coalesce((F.col("frames") > 0) & (F.col("sample_rate") > 0), F.lit(False))
        problem = F.when(F.col("length") == 0, "empty").when(path.endswith(".wav") & bad, "corrupt")
        return checked.select("path", "length", problem.alias("problem"))
    if kind != "video":
        raise ValueError(f"unsupported media kind: {kind}")
    supported = F.lit(False)
    for suffix in VIDEO_SUFFIXES:
        supported = supported | path.endswith(suffix)
    boxed = (path.endswith(".mp4") | path.endswith(".mov")) & (head(5, 4) == "66747970")
    avi = path.endswith(".avi") & (head(1, 4) == "52494646") & (head(9, 4) == "41564920")
    flv = path.endswith(".flv") & (head(1, 3) == "464C56")
    matroska = (path.endswith(".mkv") | path.endswith(".webm")) & (head(1, 4) == "1A45DFA3")
    problem = (
        F.when(F.col("length") == 0, "empty").when(~supported, "unsupported_container")
        .when(~(boxed | avi | flv | matroska), "corrupt")
    )
    return media.select("path", "length", problem.alias("problem"))


def media_issues(
    manifest: DataFrame, problems: DataFrame, kind: str, root: str | None = None,
) -> DataFrame:
    """Issue rows of available media that are missing, empty or broken.

    ``problems`` comes from :func:`media_problem`, its ``path`` relative to the root.  With
    ``root`` given, files that were not read are looked up to tell empty from missing.
    """
    from voxloom.operators.rules import severity

    flag, column = {"audio": ("audio_available", "audio_path"), "video": ("visual_available", "video_path")}[kind]
    wanted = manifest.where(F.col(flag) & (F.col(column) != "")).select("sample_id", F.col(column).alias("path"))
    joined = wanted.join(problems.select("path", "problem", F.lit(True).alias("_f")), "path", "left")
    broken = joined.where("_f is null or problem is not null")
    if root is not None:
        absent = stat_files(broken.where("_f is null").select("sample_id", "path"), "path", root)
        broken = broken.where("_f is not null").unionByName(
            absent.select(
                "sample_id", "path", F.when(F.col("size") == 0, "empty").otherwise("missing").alias("problem"),
                F.lit(True).alias("_f"),
            )
        )
    code = F.concat(F.when(F.col("_f").isNull(), "missing").otherwise(F.col("problem")), F.lit(f"_{kind}"))
    return broken.select(
        code.alias("code"), severity(code).alias("severity"), F.col("path").alias("subject"), "sample_id"
    )


PROFILE = (
    "path string, source_sample_rate int, source_channels int, samples int, duration double, rms double, "
    "peak double, clipping_fraction double, error string"
)


def pcm16(payload: bytes) -> tuple[np.ndarray, int]:
    """Samples (frames x channels, -1 to 1) and rate of a 16-bit PCM file."""
    facts = wav_facts(payload, len(payload))
    if not facts["decodable"] or facts["sample_width"] != 2:
        raise ValueError("not uncompressed PCM16")
    channels, frames = facts["channels"], facts["frames"]
    if not frames:
        raise ValueError("no samples")
    values = np.frombuffer(payload, "<i2", frames * channels, facts["start"])
    return values.reshape(frames, channels) / np.float32(32768), facts["sample_rate"]


def resampled(signal: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    """Linear resampling: each target place mixes its two neighbours by its distance."""
    if rate == wanted:
        return signal
    count = max(1, round(len(signal) * wanted / rate))
    place = np.arange(count) * ((len(signal) - 1) / max(count - 1, 1))
    left = place.astype(np.int64)
    right, weight = np.minimum(left + 1, len(signal) - 1), place - left
    return (signal[left] * (1 - weight) + signal[right] * weight).astype(np.float32)


def clip_statistics(payload: bytes, wanted: int) -> dict:
    samples, rate = pcm16(payload)
    level = np.abs(resampled(samples.mean(axis=1, dtype=np.float32), rate, wanted))
    return {
        "source_sample_rate": rate, "source_channels": samples.shape[1], "samples": len(level),
        "duration": len(level) / wanted, "rms": float(np.sqrt(np.square(level, dtype=np.float64).mean())),
        "peak": float(level.max()), "clipping_fraction": float((level >= 32767 / 32768).mean()),
    }


def audio_profile(media: DataFrame, rate: int = 16_000) -> DataFrame:
    """Mono, resampled PCM16 statistics per clip; undecodable clips carry ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in PROFILE.split(", ")]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows.append({"path": path, **clip_statistics(bytes(content), rate), "error": None})
                except ValueError as exc:
                    rows.append({"path": path, "error": str(exc) or type(exc).__name__})
            frame = pd.DataFrame(rows, columns=columns)
            for c in ("source_sample_rate", "source_channels", "samples"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    return media.select("path", "content").mapInPandas(run, PROFILE)


def frame_profile(frames: DataFrame) -> DataFrame:
    """Mean brightness and gradient energy per clip from ``(clip, frame, width, height, rgb)``.

    Frames are measured one by one in Arrow batches; the mean over a clip is an ordinary
    aggregation, so a long clip is never gathered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bright, energy = [], []
            for w, h, rgb in zip(batch["width"], batch["height"], batch["rgb"]):
                pixels = np.frombuffer(bytes(rgb), dtype=np.uint8).reshape(h, w, 3)
                gray = pixels.astype(np.float64).mean(axis=2) / 255.0
                steps = [np.diff(gray, axis=0), np.diff(gray, axis=1)]
                bright.append(float(gray.mean()))
                energy.append(float(sum(np.mean(np.square(s)) for s in steps)))
            yield pd.DataFrame({"clip": batch["clip"], "brightness": bright, "gradient_energy": energy})

    measured = frames.select("clip", "width", "height", "rgb").mapInPandas(
        run, "clip string, brightness double, gradient_energy double"
    )
    return measured.groupBy("clip").agg(
        F.count(F.lit(1)).alias("frames"), F.avg("brightness").alias("mean_brightness"),
        F.avg("gradient_energy").alias("mean_gradient_energy"),
    )
