"""The archive: editions and editorials as JSON files or partitioned tables, summary state, logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SOURCES = "array<struct<name:string,url:string>>"
_STORY = (
    "clusterId:string,slug:string,titulo:string,resumo:string,porQueImporta:string,categoria:string,categoriaSlug:string,"
    f"sources:{_SOURCES},imageUrl:string,updatedAt:string"
)
_SECTION = f"struct<slug:string,label:string,stories:array<struct<{_STORY}>>>"
EDITION = (f"date string, generatedAt string, home array<struct<{_STORY}>>, categorias string, _corrupt_record string")
EDITORIAL = (
    "date string, generatedAt string, titulo string, linhaFina string, paragrafos array<string>, destaques array<struct<slug:string,titulo:string,categoria:string>>, _corrupt_record string"
)


def _story(section: F.Column, label: F.Column, section_rank: F.Column) -> list[F.Column]:
    s = F.col("story")
    return [
        F.to_date("date").alias("date"), F.try_to_timestamp("generatedAt").alias("generated_at"), section.alias("section"), label.alias("section_label"), section_rank.alias("section_rank"),
        (F.col("at") + 1).alias("story_rank"), s["clusterId"].alias("cluster_id"), F.coalesce(s["slug"], s["clusterId"]).alias("slug"), s["titulo"].alias("titulo"),
        s["resumo"].alias("resumo"), s["porQueImporta"].alias("por_que_importa"), s["categoria"].alias("categoria"), s["categoriaSlug"].alias("categoria_slug"),
        s["sources"].alias("sources"), s["imageUrl"].alias("image_url"), F.try_to_timestamp(s["updatedAt"]).alias("updated_at"),
    ]


def read_editions(spark: SparkSession, path: str) -> DataFrame:
    """Edition rows from JSON files: home and sections, one row per story. Files that don't parse are left out;
    `categorias` may be an array of sections or an object from slug to stories."""
    raw = spark.read.schema(EDITION).option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("_corrupt_record is null and date is not null")
    home = raw.select("date", "generatedAt", F.posexplode("home").alias("at", "story")).select(*_story(F.lit("home"), F.lit(None).cast("string"), F.lit(0)))
    # the object form has no order of its own: by slug
    as_list = F.from_json("categorias", f"array<{_SECTION}>")
    as_map = F.from_json("categorias", f"map<string,array<struct<{_STORY}>>>")
    listed = F.transform(F.array_sort(F.map_entries(as_map)), lambda e: F.struct(e["key"].alias("slug"), F.get(e["value"], F.lit(0))["categoria"].alias("label"), e["value"].alias("stories")))
    both = F.when(F.ltrim("categorias").startswith("["), as_list).otherwise(listed)
    per = raw.select("date", "generatedAt", F.posexplode(both).alias("n", "s")).select("date", "generatedAt", "n", F.col("s.slug").alias("sec"), F.col("s.label").alias("lab"), F.posexplode("s.stories").alias("at", "story"))
    return home.unionByName(per.select(*_story(F.col("sec"), F.col("lab"), F.col("n") + 1)))


def read_editorials(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(EDITORIAL).option("multiLine", True).json(path).where("_corrupt_record is null and date is not null")
    return raw.select(F.to_date("date").alias("date"), F.try_to_timestamp("generatedAt").alias("generated_at"), "titulo", F.col("linhaFina").alias("linha_fina"), "paragrafos", "destaques")


def write_editions(rows: DataFrame, path: str) -> None:
    """One partition per edition day; a day written again replaces the day alone. Editions without a home are not written."""
    from newsdesk.operators.editions import complete_editions

    whole = complete_editions(rows).repartition("date")
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def edition_json(rows: DataFrame) -> DataFrame:
    """(date, json): the nested form of each edition, for a JSON sink."""
    story = F.struct(
        F.col("cluster_id").alias("clusterId"), "slug", "titulo", "resumo", F.col("por_que_importa").alias("porQueImporta"), "categoria", F.col("categoria_slug").alias("categoriaSlug"),
        "sources", F.col("image_url").alias("imageUrl"), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updatedAt"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("story_rank", story.alias("story")))), lambda x: x["story"])
    per = rows.groupBy("date", "section").agg(F.first("section_label").alias("label"), F.first("section_rank").alias("n"), listed.alias("stories"))
    section = F.struct("n", F.struct(F.col("section").alias("slug"), "label", "stories").alias("s"))
    whole = per.groupBy("date").agg(F.array_sort(F.collect_list(section)).alias("all"))
    home = F.get(F.filter("all", lambda x: x["s"]["slug"] == "home"), F.lit(0))["s"]["stories"]
    rest = F.transform(F.filter("all", lambda x: x["s"]["slug"] != "home"), lambda x: x["s"])
    return whole.select("date", F.to_json(F.struct(F.col("date").cast("string").alias("date"), home.alias("home"), rest.alias("categorias"))).alias("json"))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state or log table; empty where nothing was written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


class Versions:
    """A table of which each batch writes a whole new version, and a manifest of the complete ones.

    The manifest has a file a version, written after its rows, with what the writer notes (JSON). A batch reads the newest
    version below its own number, so a batch that is run again reads and writes what it did before. Versions that more
    than `keep` newer ones follow are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 10):
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, keep
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict[int, dict]:
        """What was noted of the versions that are there: at most `keep` + 1."""
        at = self._hadoop.Path(f"{self.path}/manifest")
        if not self._fs.exists(at):
            return {}
        notes = self.spark.read.schema("version long, note string").json(f"{self.path}/manifest/*").collect()
        return {r.version: json.loads(r.note) for r in notes}

    def before(self, number: int) -> tuple[DataFrame, dict]:
        """The newest version below `number`, and its note; no rows where there is none."""
        known = {n: note for n, note in self.manifest().items() if n < number}
        if not known:
            return self.spark.createDataFrame([], self.schema), {}
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version/{max(known)}"), known[max(known)]

    def write(self, rows: DataFrame, number: int, note: dict) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/version/{number}")
        entry = self.spark.createDataFrame([(number, json.dumps(note))], "version long, note string")
        entry.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{number}")
        for old in sorted(n for n in self.manifest() if n < number)[: -self.keep]:
            for kind in ("manifest", "version"):
                self._fs.delete(self._hadoop.Path(f"{self.path}/{kind}/{old}"), True)
