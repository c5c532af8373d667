"""Uploads and manifests: chunk completeness, content sniffing, item inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.media import extension_of_mime


def staged_files(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files as rows: path, length, content hash. Spark's file sources leave out empty files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def rejected(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Announced uploads (file_name) of which no file with content was staged, as error items."""
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name")).distinct()
    return expected.join(named, "file_name", "left_anti").withColumn("status", F.lit("error"))


def incomplete(chunks: DataFrame) -> DataFrame:
    """Uploads that lack parts, with the missing indices. chunks: upload_id, idx, total."""
    have = chunks.groupBy("upload_id").agg(F.max("total").alias("total"), F.collect_set(F.col("idx").cast("int")).alias("have"))
    missing = F.array_except(F.sequence(F.lit(0), F.col("total").cast("int") - 1), F.col("have"))
    return have.where("total > 0").select("upload_id", "total", F.array_sort(missing).alias("missing")).where(F.size("missing") > 0)


def body_kind(content_type: Column, body: Column, length: Column) -> Column:
    """What an upload's body is: commit, link, manifest or binary."""
    text = F.btrim(body)
    link = F.coalesce(*[F.get_json_object(text, f"$.{k}") for k in ("url", "link", "target")])
    is_json = F.lower(content_type).contains("json") & text.startswith("{")
    return (
        F.when(is_json & (F.get_json_object(text, "$.action") == "commit"), "commit")
        .when(is_json & link.isNotNull(), "link")
        .when((length < 2048) & (F.lower(content_type).startswith("text/") | text.startswith("http")) & text.rlike("^https?://"), "link")
        .otherwise("binary")
    )


def manifest_items(manifests: DataFrame, body: str = "body") -> DataFrame:
    """Items of direct manifests; caption, place and tags come from the post where the item has none."""
    item = "struct<url:string,media_type:string,mime_type:string,caption:string,tags:array<string>,latitude:double,longitude:double>"
    schema = f"platform string, author string, folder string, caption string, tags array<string>, latitude double, longitude double, items array<{item}>"
    rows = manifests.withColumn("_m", F.from_json(body, schema)).select(*[c for c in manifests.columns if c != body], "_m", F.posexplode("_m.items").alias("item_index", "_i"))
    either = lambda name: F.coalesce(F.col(f"_i.{name}"), F.col(f"_m.{name}"))
    video = F.col("_i.media_type") == "video"
    mime = F.coalesce("_i.mime_type", F.when(video, "video/mp4").otherwise("image/jpeg"))
    return rows.select(
        *[c for c in manifests.columns if c != body],
        "item_index",
        F.col("_i.url").alias("url"),
        mime.alias("mime_type"),
        extension_of_mime(mime, video).alias("ext"),
        either("caption").alias("caption"),
        F.when(F.size("_i.tags") > 0, F.col("_i.tags")).otherwise(F.col("_m.tags")).alias("tags"),
        either("latitude").alias("latitude"),
        either("longitude").alias("longitude"),
        F.coalesce("_m.folder", F.concat_ws("/", "_m.platform", "_m.author")).alias("folder"),
    )


def probe(info: Column) -> Column:
    """From a media probe's JSON: size as shown, duration and creation time of the first stream with a size."""
    schema = "streams array<struct<width:int,height:int,tags:map<string,string>,side_data_list:array<struct<rotation:int>>>>, format struct<duration:string,tags:map<string,string>>"
    parsed = F.from_json(info, schema)
    stream = F.get(F.filter(parsed["streams"], lambda s: (s["width"] > 0) & (s["height"] > 0)), F.lit(0))
    turn = F.coalesce(F.get(stream["side_data_list"], F.lit(0))["rotation"], stream["tags"]["rotate"].try_cast("int"), F.lit(0))
    swap = F.abs(turn).isin(90, 270)
    when_made = F.coalesce(parsed["format"]["tags"]["creation_time"], parsed["format"]["tags"]["com.apple.quicktime.creationdate"])
    return F.struct(
        F.when(swap, stream["height"]).otherwise(stream["width"]).alias("width"),
        F.when(swap, stream["width"]).otherwise(stream["height"]).alias("height"),
        parsed["format"]["duration"].try_cast("double").alias("duration"),
        when_made.alias("created"),
    )


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Tag vocabulary from CSV: name with spaces for _, category 0 if it is no number; rows under three columns are dropped."""
    rows = spark.read.schema("a string, b string, c string").option("mode", "PERMISSIVE").csv(path).where("c is not null")
    return rows.select(F.replace("a", F.lit("_"), F.lit(" ")).alias("name"), F.coalesce(F.col("b").try_cast("int"), F.lit(0)).alias("category"))


def range_size(content_range: Column, content_length: Column) -> Column:
    """Size of a file from the total of Content-Range, else Content-Length."""
    return F.coalesce(F.nullif(F.regexp_extract(content_range, r"/(\d+)$", 1), F.lit("")).cast("long"), content_length.try_cast("long"))
