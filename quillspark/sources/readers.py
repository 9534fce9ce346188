"""Readers of source catalogues and landed texts. Networks are out of scope: files are landed first, then read."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with quoted commas, doubled quotes and quoted line breaks; values that don't fit the schema are null."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")


def read_json_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one array of works."""
    return spark.read.schema(schema).json(path, multiLine=True)


def exported_as(rows: DataFrame, kind: str) -> DataFrame:
    """Works of which an entry of the nested `export` has this type."""
    return rows.where(F.exists("export", lambda e: e["type"] == kind))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, text; strict UTF-8, or Latin-1 where a file isn't UTF-8."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.select("path", decoded(F.col("content")).alias("text"))


def decoded(content: Column) -> Column:
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


@F.udtf(returnType="name string, content binary")
class Unzip:
    """The members of a zip archive; none of what is no archive."""

    def eval(self, content: bytes) -> Iterator[tuple[str, bytes]]:
        if content and bytes(content[:4]) == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                for name in archive.namelist():
                    yield name, archive.read(name)


def key_values(text: Column) -> Column:
    """Map of a file of `key: value` lines; a key that comes again has its last value."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))

    def last(own: Column) -> Column:
        return F.filter(own, lambda x, i: ~F.exists(F.slice(own, i + 2, F.size(own)), lambda y: y["key"] == x["key"]))

    return F.map_from_entries(F.get(F.transform(F.array(pairs), last), F.lit(0)))


def assembled(parts: DataFrame, key: str, order: str, separator: str = "\n\n") -> DataFrame:
    """Texts of works put together from their parts in order."""
    piece = F.struct(order, "text")
    return parts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["text"]), separator).alias("text"))


def links(html: Column, deny: str = r"^(#|mailto:|javascript:|https?:)") -> Column:
    """Relative links of a page in order, each once."""
    return F.array_distinct(F.filter(F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]+)"'), 1), lambda h: ~h.rlike(deny)))


def write_manifest(works: DataFrame, path: str, dry: bool = False) -> int:
    """Write works as JSON lines, or count them only; duplicate ids are an error."""
    repeated = works.groupBy("id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("title")).alias("titles")).where("n > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"ids used more than once: {[(r['id'], r['titles']) for r in repeated]}")
    if not dry:
        works.write.mode("overwrite").json(path)
    return works.count()
