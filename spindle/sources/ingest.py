"""Scanning, probing and de-duplicating media, and the small text inputs of a project."""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import IO
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Suffixes by kind and folders that a scan passes over.
SUFFIXES = {"video": ("mov", "mp4", "m4v"), "photo": ("jpg", "jpeg", "heic", "png", "dng"), "music": ("mp3", "wav", "m4a")}
SKIP = (".venv", "venv", "node_modules", "__pycache__", ".git", "output")
PROBE = "struct<streams:array<struct<codec_type:string,width:int,height:int,r_frame_rate:string>>,format:struct<duration:string,tags:map<string,string>>>"
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXX")
#: Bytes of a file read at once when it is hashed, and up to which Spark's own reader hashes it whole.
CHUNK, WHOLE = 8 << 20, 32 << 20
#: Seconds that a tool may take to say its version, to describe a file and to make a proxy.
VERSION_S, PROBE_S, PROXY_S = 10, 30, 60


def called(*command: str, seconds: int) -> subprocess.CompletedProcess | None:
    """A tool's result; None where it is not there or takes longer."""
    try:
        return subprocess.run(command, capture_output=True, timeout=seconds)
    except (FileNotFoundError, subprocess.TimeoutExpired):
        return None


def tools(names: Sequence[str] = ("ffmpeg", "exiftool")) -> dict[str, bool]:
    """Which of the driver's tools for decoding answer."""
    return {n: called(n, "-version", seconds=VERSION_S) is not None for n in names}


def ffprobe(path: str) -> str:
    """A file's description as JSON, ``{}`` where the tool is not there, fails or is too slow."""
    done = called("ffprobe", "-v", "quiet", "-print_format", "json", "-show_format", "-show_streams", path.removeprefix("file:"), seconds=PROBE_S)
    return done.stdout.decode("utf-8", "replace") if done is not None and done.returncode == 0 else "{}"


def jpeg_proxy(path: str, folder: str) -> str | None:
    """A JPEG for a raw photo below ``folder``, one that is there or made by ffmpeg or from the preview in it; None if none can be made."""
    path = path.removeprefix("file:")
    out = Path(folder) / f"{Path(path).stem}.jpg"
    there = lambda: out.exists() and out.stat().st_size > 1000
    out.parent.mkdir(parents=True, exist_ok=True)
    if not there():
        called("ffmpeg", "-y", "-i", path, "-vf", "scale=1920:-1", "-q:v", "2", str(out), seconds=PROXY_S)
    if not there():
        preview = called("exiftool", "-b", "-JpgFromRaw", path, seconds=PROBE_S)
        if preview is not None and preview.returncode == 0 and len(preview.stdout) > 1000:
            out.write_bytes(preview.stdout)
    return str(out) if there() else None


def with_proxies(media: DataFrame, folder: str, make: Callable[[str, str], str | None] = jpeg_proxy) -> DataFrame:
    """``media`` with proxy_path of raw photos; ``folder`` is one that the executors share."""

    @F.pandas_udf("string")
    def proxies(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: None if p is None else make(p, folder))

    return media.withColumn("proxy_path", proxies(F.when(suffix(F.col("media_path")) == "dng", F.col("media_path"))))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def media_kind(path: Column) -> Column:
    """video, photo or music by the suffix, else null."""
    kind = F.lit(None).cast("string")
    for name, ends in SUFFIXES.items():
        kind = F.when(suffix(path).isin(*ends), name).otherwise(kind)
    return kind


def allowed(path: Column) -> Column:
    """No part of the path is a folder to pass over."""
    return ~F.arrays_overlap(F.split(path, "/"), F.lit(list(SKIP)))


def below(path: Column, root: str) -> Column:
    """The part of a path below a folder."""
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 2**31 - 1)).otherwise(path)


def opened(path: str) -> IO[bytes]:
    """A file to be read from its start, in whatever store its path names."""
    if "://" not in path or path.startswith("file:"):
        return open(re.sub("^file:/*", "/", path), "rb")
    system, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_stream(inner)


def file_hash(path: str, chunk: int = CHUNK) -> str:
    """MD5 of a file of any size, ``chunk`` bytes of which are in memory at a time."""
    done = hashlib.md5(usedforsecurity=False)
    with opened(path) as file:
        while part := file.read(chunk):
            done.update(part)
    return done.hexdigest()


@F.pandas_udf(T.StringType())
def hash_in_chunks(paths: pd.Series) -> pd.Series:
    return paths.map(file_hash)


def with_hashes(files: DataFrame) -> DataFrame:
    """``files`` of the reader of binary files (path, length, content), with the MD5 of each in place of its content.

    Small files are hashed where Spark reads them. Of others the content is not
    read as a value, which would hold it in memory and ends at 2 GB: the executor
    that has the row streams the file.
    """
    small = files.filter(F.col("length") <= WHOLE).select("path", "length", F.md5("content").alias("file_hash"))
    large = files.filter(F.col("length") > WHOLE).select("path", "length").withColumn("file_hash", hash_in_chunks("path"))
    return small.unionByName(large)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files of known kinds below a folder, with size and MD5 of their content; only folders within it can be passed over.

    Files are listed as rows, and each is its own unit of work, of whatever size. Files without content are passed over.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    inner = below(F.regexp_replace("path", "^file:/+", "file:/"), root.replace("file:///", "file:/"))
    found = with_hashes(files.filter(media_kind(F.col("path")).isNotNull() & allowed(inner)))
    return found.select(F.col("path").alias("media_path"), media_kind(F.col("path")).alias("media_type"), "file_hash", F.col("length").alias("file_size"))


def probed(files: DataFrame, probe: Callable[[str], str], path: str = "media_path") -> DataFrame:
    """A JSON description of each file by a pluggable probe, in batches; ``{}`` where it fails."""
    @F.pandas_udf("string")
    def run(paths: pd.Series) -> pd.Series:
        def one(p: str) -> str:
            try:
                return probe(p)
            except Exception:  # a file that can't be read is described by nothing
                return "{}"

        return paths.map(one)

    return files.withColumn("probe", run(F.col(path)))


def metadata(probe: Column) -> Column:
    """Duration, time, size, rate and place from a probe's JSON."""
    j = F.from_json(probe, PROBE)
    tags = j["format"]["tags"]
    video = F.get(F.filter(j["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    rate = F.split(video["r_frame_rate"], "/")
    place = F.coalesce(tags["com.apple.quicktime.location.ISO6709"], F.lit(""))
    bare = F.replace(place, F.lit("/"), F.lit(""))
    several = F.size(F.filter(F.split(bare, r"\+"), lambda p: p != "")) >= 2
    pattern = r"^([+-][0-9.]+)([+-][0-9.]+)"
    latitude, longitude = (F.when(several, F.regexp_extract(bare, pattern, i).try_cast("double")) for i in (1, 2))
    return F.struct(
        F.coalesce(j["format"]["duration"].cast("double"), F.lit(0.0)).alias("duration_sec"),
        F.coalesce(tags["creation_time"], tags["com.apple.quicktime.creationdate"], F.lit("")).alias("creation_time"),
        F.coalesce(video["width"], F.lit(0)).alias("width"), F.coalesce(video["height"], F.lit(0)).alias("height"),
        F.coalesce(F.try_divide(F.get(rate, F.lit(0)).try_cast("double"), F.get(rate, F.lit(1)).try_cast("double")), F.lit(0.0)).alias("fps"),
        latitude.alias("gps_lat"), F.when(latitude.isNotNull(), longitude).alias("gps_lon"),
    )


def creation_time(text: Column) -> Column:
    """The first of TIME_FORMATS that reads it, in UTC; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS])


def dedup_first(rows: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each group of equal keys."""
    named = {f"__k{i}": k for i, k in enumerate(keys)}
    w = Window.partitionBy(*named).orderBy(*order)
    return rows.withColumns(named).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", *named)


def deduplicate(media: DataFrame) -> DataFrame:
    """One file for equal content, size and duration to a tenth: the first path, compared part by part."""
    return dedup_first(media, [F.col("file_hash"), F.col("file_size"), F.bround("duration_sec", 1)], [F.split("media_path", "/")])


def usable(media: DataFrame) -> DataFrame:
    """Without raw photos that have no proxy."""
    return media.filter(~((suffix(F.col("media_path")) == "dng") & F.col("proxy_path").isNull()))


class MusicNotFound(Exception):
    """A profile names a music file that is not there."""


def music_path(media: DataFrame, folder: str, named: str = "") -> str | None:
    """The named music file, in the input folder or by its own path, else the first one scanned."""
    if named:
        for path in (Path(folder.removeprefix("file:")) / named, Path(named)):
            if path.exists():
                return str(path)
        raise MusicNotFound(f"music file not found: {named!r}, in {folder!r} or by itself")
    first = first_music(media).first()
    return None if first is None else first["media_path"].removeprefix("file:")


def first_music(media: DataFrame) -> DataFrame:
    return media.filter("media_type = 'music'").orderBy(F.split("media_path", "/")).limit(1)


def list_entries(lines: Column) -> Column:
    """A line of a favourites or exclusion list as struct (event_id, name); null for blanks, comments and bad ids."""
    text = F.trim(lines)
    number = F.regexp_extract(text, r"^event:\s*(\S+)", 1).try_cast("bigint")
    entry = F.when(text.startswith("event:"), F.when(number.isNotNull(), F.struct(number.alias("event_id"), F.lit(None).cast("string").alias("name"))))
    return F.when((text == "") | text.startswith("#"), F.lit(None)).otherwise(F.coalesce(entry, F.when(~text.startswith("event:"), F.struct(F.lit(None).cast("bigint").alias("event_id"), text.alias("name")))))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, name) of a list file."""
    rows = spark.read.text(path).select(list_entries(F.col("value")).alias("e")).filter("e IS NOT NULL")
    return rows.select("e.*")


PROFILE = "face_bias double, motion_bias double, stability_bias double, sharpness_bias double, role_bias map<string,double>, preferred_events array<bigint>, avoided_events array<bigint>, photo_bias double, sample_count bigint"


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """A saved profile, missing fields at their defaults."""
    rows = spark.read.schema(PROFILE).json(path, multiLine=True)
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("face_bias", "motion_bias", "stability_bias", "sharpness_bias", "photo_bias")}
    return rows.withColumns(zero | {"sample_count": F.coalesce("sample_count", F.lit(0).cast("bigint")), "role_bias": F.coalesce("role_bias", F.create_map().cast("map<string,double>")), "preferred_events": F.coalesce("preferred_events", F.array().cast("array<bigint>")), "avoided_events": F.coalesce("avoided_events", F.array().cast("array<bigint>"))})


def load_profile_row(spark: SparkSession, path: str):
    """A saved profile as a row; None where the file is missing or no JSON object."""
    try:
        text = Path(path).read_text(encoding="utf-8")
        if not isinstance(json.loads(text), dict):
            return None
    except (OSError, ValueError):
        return None
    return read_profile(spark, path).first()
