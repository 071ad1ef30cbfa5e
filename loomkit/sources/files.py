"""Media, image, settings and translation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The extensions of each kind of media.
IMAGES, VIDEOS = ("png", "jpg", "jpeg", "bmp", "gif"), ("mp4", "avi", "mov", "mkv")
BINARY = "path string, modificationTime timestamp, length long, content binary"


def media_kind(path: Column) -> Column:
    end = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(end.isin(*IMAGES), "image").when(end.isin(*VIDEOS), "video").otherwise("other")


def _glob(kinds: tuple[str, ...]) -> str:
    """The file names of these kinds, whatever the case: what else lies there is never opened."""
    if "other" in kinds:
        return "*"
    ends = [e for kind, of in (("image", IMAGES), ("video", VIDEOS)) if kind in kinds for e in of]
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in ends) + "}"


def outermost(paths: list[str]) -> list[str]:
    """The paths without repeats and without those inside another one, for folders are read with all that is in them."""
    clean = sorted({p.rstrip("/") or "/" for p in paths})
    return [p for p in clean if not any(p.startswith(q.rstrip("/") + "/") for q in clean if q != p)]


def read_media(spark: SparkSession, paths: list[str], kinds: tuple[str, ...] = ("image", "video")) -> DataFrame:
    """The files at or under ``paths`` of the given kinds (image, video, other), each once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(kinds)).load(outermost(paths))
    return files.withColumn("kind", media_kind(F.col("path"))).where(F.col("kind").isin(*kinds))


def stream_media(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("image", "video")) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(kinds)).load(folder)
    return files.withColumn("kind", media_kind(F.col("path"))).where(F.col("kind").isin(*kinds))


def read_images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(image_id, width, height, channels, data, error): decoded RGB images; what can't be decoded has an error and no data."""
    import pandas as pd

    raw = spark.read.format("image").option("recursiveFileLookup", "true").load(paths).select("image.*")

    def flip(batches):
        import numpy as np

        for b in batches:
            data = [
                None if h < 0 else np.frombuffer(d, np.uint8).reshape(h, w, c)[:, :, [2, 1, 0, 3][:c] if c > 1 else [0]].tobytes()
                for d, h, w, c in zip(b["data"], b["height"], b["width"], b["nChannels"], strict=True)]
            yield pd.DataFrame({"image_id": b["origin"], "width": b["width"], "height": b["height"], "channels": b["nChannels"], "data": data, "error": [None if d is not None else "not an image" for d in data]})

    return raw.mapInPandas(flip, "image_id string, width int, height int, channels int, data binary, error string")


def read_settings(docs: DataFrame) -> DataFrame:
    """(entity_id, key, value) of documents (entity_id, json) of one or two levels; what is no JSON object gives no rows.

    Whether a value is a group is told by its kind, so that a text which looks like an object stays a text. Of repeated keys the first one's kind counts.
    """
    kinds = F.from_json("json", "map<string,variant>")
    top = docs.select("entity_id", kinds.alias("kinds"), F.explode(F.from_json("json", "map<string,string>")).alias("grp", "body"))
    top = top.select("entity_id", "grp", "body", F.coalesce(F.schema_of_variant(F.col("kinds")[F.col("grp")]).startswith("OBJECT"), F.lit(False)).alias("group"))
    flat = top.where(~F.col("group")).select("entity_id", F.col("grp").alias("key"), F.col("body").alias("value"))
    deep = top.where("group").select("entity_id", "grp", F.explode(F.from_json("body", "map<string,string>")).alias("name", "value"))
    return flat.union(deep.select("entity_id", F.concat_ws(".", "grp", "name"), "value"))


def write_settings(values: DataFrame) -> DataFrame:
    """(entity_id, json): one document for each entity, in the order of its keys; a key without a dot stands at the top, unless a group has its name."""
    part = F.split("key", r"\.", 2)
    named = values.select("entity_id", part[0].alias("grp"), F.when(F.size(part) == 2, part[1]).alias("name"), "value")
    inner = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value")))))
    groups = named.groupBy("entity_id", "grp").agg(inner.alias("m"), F.max(F.when(F.col("name").isNull(), F.col("value"))).alias("flat"))
    body = F.when(F.size("m") > 0, F.to_json(F.create_map("grp", "m"))).otherwise(F.to_json(F.create_map("grp", "flat")))
    rows = groups.withColumn("body", body).groupBy("entity_id").agg(
        F.array_sort(F.collect_list(F.struct("grp", F.expr("substring(body, 2, char_length(body) - 2)").alias("body")))).alias("g"))
    return rows.select("entity_id", F.concat(F.lit("{"), F.array_join(F.transform("g", lambda x: x.body), ","), F.lit("}")).alias("json"))


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """(locale, context, source, translation) of XML catalogues; the locale stands before the extension in the name of the file, or of the folder that holds a catalogue's parts."""
    schema = "name string, message array<struct<source: string, translation: string>>"
    rows = spark.read.format("xml").option("rowTag", "context").schema(schema).load(path)
    rows = rows.select(F.regexp_extract(F.input_file_name(), r"\.([A-Za-z_]+)\.ts(?:/[^/]*)?$", 1).alias("locale"), F.col("name").alias("context"), F.explode("message").alias("m"))
    return rows.select("locale", "context", "m.source", F.nullif("m.translation", F.lit("")).alias("translation"))


def write_translations(catalogue: DataFrame, path: str) -> None:
    """An XML catalogue of (context, source, translation) in parts, in the folder ``path``."""
    message = F.struct("source", F.coalesce("translation", F.lit("")).alias("translation"))
    rows = catalogue.groupBy(F.col("context").alias("name")).agg(F.array_sort(F.collect_list(message)).alias("message"))
    rows.write.format("xml").option("rootTag", "TS").option("rowTag", "context").save(path)
