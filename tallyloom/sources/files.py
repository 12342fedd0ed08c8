"""Directory trees, digests, checksum manifests, archives and images."""

from __future__ import annotations

import hashlib
import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a path that are no payload. Fixed values.
EXCLUDED = (".git", ".cache", "__pycache__", ".pytest_cache", ".DS_Store")
PNG = "89504E470D0A1A0A"


def list_files(spark: SparkSession, root: str, *, glob: str = "*", content: bool = False) -> DataFrame:
    """path (below root), bytes, and content if asked for, of a recursive walk without excluded parts and .pyc files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/") + "/"
    rel = F.element_at(F.split("path", r"\Q" + base + r"\E", 2), -1)
    out = raw.select(rel.alias("path"), F.col("length").alias("bytes"), *(["content"] if content else []))
    skip = F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in EXCLUDED])) | F.col("path").endswith(".pyc")
    return out.where(~skip)


def attempt_dirs(files: DataFrame) -> DataFrame:
    """attempt, files: numeric first parts of paths, in number order."""
    first = F.substring_index("path", "/", 1)
    return files.where(first.rlike("^[0-9]+$")).groupBy(first.cast("int").alias("attempt")).agg(F.count("*").alias("files")).orderBy("attempt")


def digests(files_with_content: DataFrame) -> DataFrame:
    return files_with_content.select("path", "bytes", F.sha2("content", 256).alias("sha256"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """sha256, path of `<hex>  <path>` lines; absolute, escaping and repeated paths and other lines raise."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    got = lines.select(F.lower(F.regexp_extract("value", r"^([0-9a-fA-F]{64})\s+\*?(.+)$", 1)).alias("sha256"), F.regexp_extract("value", r"^[0-9a-fA-F]{64}\s+\*?(.+)$", 1).alias("path"))
    counted = got.groupBy("path").agg(F.first("sha256").alias("sha256"), F.count("*").alias("_n"))
    bad = (F.col("sha256") == "") | F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..") | (F.col("_n") > 1)
    return counted.where(F.when(bad, F.raise_error(F.concat(F.lit("bad manifest entry: "), F.col("path")))).otherwise(F.lit(True))).select("sha256", "path")


def manifest_differences(manifest: DataFrame, actual: DataFrame, *, subset: bool = False) -> DataFrame:
    """path, problem (missing, unlisted, digest): none means that both sides are equal; subset allows unlisted files."""
    a = actual.select("path", F.col("sha256").alias("_real"))
    both = manifest.join(a, "path", "full_outer")
    problem = F.when(F.col("_real").isNull(), "missing").when(F.col("sha256").isNull(), F.lit(None) if subset else F.lit("unlisted")).when(F.col("sha256") != F.col("_real"), "digest")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def manifest_totals(actual: DataFrame) -> DataFrame:
    return actual.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))


def credential_hits(files_with_content: DataFrame, families: dict[str, str]) -> DataFrame:
    """path, family for payload bytes that match a credential pattern."""
    text = F.decode("content", "ISO-8859-1")
    hit = F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in families.items()]), lambda x: x.isNotNull())
    return files_with_content.select("path", F.explode(hit).alias("family"))


def data_urls(files_with_content: DataFrame) -> DataFrame:
    """path, url of PNG files; other content raises."""
    png = F.hex(F.substring("content", 1, 8)) == PNG
    fine = F.when(~png, F.raise_error(F.concat(F.lit("not a PNG: "), F.col("path")))).otherwise(F.lit(True))
    return files_with_content.where(fine).select("path", F.concat(F.lit("data:image/png;base64,"), F.base64("content")).alias("url"))


def archive_members(spark: SparkSession, path: str, *, manifest: str | None = "PACKAGE_MANIFEST.sha256") -> DataFrame:
    """archive, name, content, sha256 of ZIP members; members that a manifest lists must have its digests."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        for batch in batches:
            for where, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if not n.endswith("/")]
                    found = {n: hashlib.sha256(z.read(n)).hexdigest() for n in names}
                    listed = [n for n in names if manifest and n.rsplit("/", 1)[-1] == manifest]
                    for line in (x for n in listed for x in z.read(n).decode().splitlines() if x.strip()):
                        digest, name = line.split(maxsplit=1)
                        if found.get(name) != digest.lower():
                            raise ValueError(f"{name} in {where} doesn't have its digest")
                    for n in names:
                        yield pd.DataFrame({"archive": [where], "name": [n], "content": [z.read(n)], "sha256": [found[n]]})

    return raw.mapInPandas(run, "archive string, name string, content binary, sha256 string")
