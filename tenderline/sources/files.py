"""Reading and writing the files of the quoting domain: masters, drawing specs, requests, recorded model outputs, logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tenderline.sources import scratch

MASTERS = {
    "materials": "code string, mat_group string, density double, price_eur_kg double, machinability double, aliases string",
    "plants": "code string, overhead_pct double, logistics_pct double, base_weeks int, ord int",
    "work_centers": "code string, plant string, rate_eur_h double",
    "services": "code string, price_eur_kg double, lot_min_eur double",
    "standard_parts": "ord long, part_number string, unit_price double, match_tokens string",
}
SPEC = "part_id long, spec struct<title_block:struct<material:string,general_tolerance:string>,heat_treatment:string,surface_treatment:string,notes:array<string>>"
REQUEST = "rfq_id long, customer string, items array<struct<line_no:int,quantity:int>>"
RECORDED = "request_meta struct<task:string,key:string,latency_ms:long>, parsed string, usage struct<input_tokens:int,output_tokens:int>"


def write_files(rows: DataFrame, path: str, by: list[str]) -> None:
    """Texts (value) as a file for each value of `by`, in folders named by them. Files are what takes time, not bytes: a small table would be one task, so rows are dealt out by
    their folder, and each task commits the files it has written instead of the driver moving all of them one by one."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(tasks, *by).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*by).text(path)


def write_masters(tables: dict[str, DataFrame], folder: str) -> None:
    """Masters as CSV with a header, each replaced as a whole; arrays are JSON texts in their cells."""
    for name, df in tables.items():
        arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
        df.withColumns({c: F.to_json(c) for c in arrays}).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")


def read_masters(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """IO-01, IO-02: the five masters by their declared schemas; array cells decoded, missing aliases as no aliases."""
    out = {name: spark.read.schema(schema).option("header", True).option("escape", '"').csv(f"{folder}/{name}") for name, schema in MASTERS.items()}
    out["materials"] = out["materials"].withColumn("aliases", F.coalesce(text_array("aliases"), F.array().cast("array<string>")))
    out["standard_parts"] = out["standard_parts"].withColumn("match_tokens", text_array("match_tokens"))
    return out


def text_array(column: str) -> Column:
    return F.from_json(column, "array<string>")


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """IO-03: drawing specs, a JSON object a line, by their declared schema."""
    return spark.read.schema(SPEC).json(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """IO-04: one pretty-printed JSON object a file, with `folder`, the last folder of its path (name=value gives the value)."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return rows.withColumn("folder", F.regexp_extract(F.input_file_name(), r"/(?:[^/=]+=)?([^/]+)/[^/]+$", 1))


def read_recorded(spark: SparkSession, path: str) -> DataFrame:
    """IO-05: recorded model outputs below <path>/task=<task>/stem=<stem>/: task and stem from the path; rows stay whose key begins with their stem."""
    rows = spark.read.schema(RECORDED).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    name = F.input_file_name()
    rows = rows.withColumns({"task": F.regexp_extract(name, "/task=([^/]+)/", 1), "stem": F.regexp_extract(name, "/stem=([^/]+)/", 1)})
    return rows.where(F.startswith(F.col("request_meta.key"), F.col("stem")))


def inventory(spark: SparkSession, emails: str, drawings: str, expected: str) -> DataFrame:
    """IO-06: rfq_id, subject (first `Subject:` header, any case; empty without one), drawings (file names in order) and has_reference.

    E-mails are read as whole texts; drawings and expected results are listed without reading them.
    """
    key = lambda c: F.regexp_extract(c, r"/rfq=([^/]+)/", 1)
    listed = lambda path: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    texts = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(emails)
    mail = texts.select(key(F.input_file_name()).alias("rfq_id"), F.trim(F.regexp_extract("value", r"(?im)^subject:(.*)$", 1)).alias("subject"))
    files = listed(drawings).select(key("path").alias("rfq_id"), F.regexp_extract("path", r"/name=([^/]+)/", 1).alias("name")).distinct()
    files = files.groupBy("rfq_id").agg(F.array_sort(F.collect_list("name")).alias("drawings"))
    gold = listed(expected).select(key("path").alias("rfq_id")).distinct().withColumn("has_reference", F.lit(True))
    out = mail.join(files, "rfq_id", "left").join(gold, "rfq_id", "left")
    return out.select("rfq_id", "subject", F.coalesce("drawings", F.array().cast("array<string>")).alias("drawings"), F.coalesce("has_reference", F.lit(False)).alias("has_reference"))


def check_contract(raw: DataFrame, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """IO-07: (good, quarantined) of texts (id, value): good rows have the parsed `data`, the others keep the text with an `error`.

    Code fences and prose round one object are cut off (from the first { to the last }); the object must parse by the schema and have all required fields.
    """
    body = F.regexp_extract("value", r"(?s)(\{.*\})", 1)
    full = f"{schema}, _corrupt string"
    x = raw.withColumn("data", F.from_json(body, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    lacking = F.array_compact(F.array(*[F.when(F.col("data")[c].isNull(), F.lit(c)) for c in required]))
    error = F.when(body == "", "no object").when(F.col("data._corrupt").isNotNull(), "not as declared").when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ", ")))
    x = x.withColumn("error", error)
    return x.where("error is null").withColumn("data", F.col("data").dropFields("_corrupt")).drop("error", "value"), x.where("error is not null").select("id", "value", "error")


#: Parts that a store of quotes is cut into, by the hash of its key.
BUCKETS = 64


def _bucketed(rows: DataFrame, key: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def create_store(rows: DataFrame, key: list[str], path: str, buckets: int = BUCKETS) -> DataFrame:
    """A store of rows, one for each key, in `buckets` partitions by the hash of the key; read back."""
    _bucketed(rows, key, buckets).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(path)
    return read_store(rows, path)


def read_store(like: DataFrame, path: str) -> DataFrame:
    """The rows of the store at path, with the columns of `like`."""
    return _stored(like, path).drop("bucket")


def _stored(like: DataFrame, path: str) -> DataFrame:
    return like.sparkSession.read.schema(T.StructType([*like.schema, T.StructField("bucket", T.IntegerType())])).parquet(path)


def upsert_store(path: str, new: DataFrame, key: list[str], order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """IO-09: inserts or replaces rows of the store at path by key; of new rows of one key the last in `order` counts. Read back.

    Only partitions that new rows fall into are read and written again; files of all others stay as they are. The merged partitions are written apart
    first, so that a failure leaves the store whole until they replace the old ones.
    """
    last = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    rows = scratch.written(_bucketed(new, key, buckets).withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k"), "upserts")
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # BUCKETS numbers at most
    old = _stored(new, path).where(F.col("bucket").isin(touched))
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    kept = old.alias("o").join(rows.select("bucket", *key).alias("n"), reduce(lambda a, b: a & b, same, F.col("o.bucket") == F.col("n.bucket")), "left_anti")
    merged = scratch.written(kept.unionByName(rows), "merged")
    merged.repartition(buckets, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return read_store(new, path)


def append_log(rows: DataFrame, path: str) -> DataFrame:
    """IO-10: appends rows to the log at path and reads it whole, in the order of (ts, id)."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).orderBy("ts", "id")
