"""Files: markdown with frontmatter, JSON and JSONL records, query lists, edge proposals, anchor logs, bundles."""

import json
import re
import uuid

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scalar(value: str):
    """Value of a frontmatter scalar: quoted text, null, boolean, inline list, number, or the text itself."""
    value = value.strip()
    if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
        return value[1:-1]
    words = {"null": None, "none": None, "~": None, "true": True, "yes": True, "on": True, "false": False, "no": False, "off": False}
    if value.lower() in words:
        return words[value.lower()]
    if value.startswith("[") and value.endswith("]"):
        return [scalar(x) for x in value[1:-1].split(",")] if value[1:-1].strip() else []
    for kind in (int, float):
        try:
            return kind(value) if kind is int or "." in value else value
        except ValueError:
            pass
    return value


def frontmatter(text: str) -> tuple[dict, str]:
    """Fields between two lines of --- at the start, and the rest; without both lines no fields."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None) if lines[0].strip() == "---" else None
    if end is None:
        return {}, "\n".join(lines)
    out, key = {}, None
    for line in lines[1:end]:
        bare = line.strip()
        if key is not None and bare.startswith("- "):
            out[key].append(scalar(bare[2:]))
            continue
        if not bare:
            continue
        key = None
        if bare.startswith("#") or ":" not in line:
            continue
        name, value = line.split(":", 1)
        if value.strip():
            out[name.strip()] = scalar(value)
        else:
            key = name.strip()
            out[key] = []
    return out, "\n".join(lines[end + 1 :])


def _as_text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value).lower()
    return ",".join(map(str, value)) if isinstance(value, list) else str(value)


def with_frontmatter(files: DataFrame) -> DataFrame:
    """Adds `fields` (lists comma-separated) and `body` to whole files of text."""

    @F.pandas_udf("struct<fields:map<string,string>,body:string>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = [frontmatter(t or "") for t in texts]
        return pd.DataFrame({"fields": [{k: _as_text(v) for k, v in f.items()} for f, _ in rows], "body": [b for _, b in rows]})

    return files.withColumn("_p", parse("text")).select(*files.columns, "_p.fields", "_p.body")


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """path, relative_path, text of all *.md files under root, but hidden ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape("/" + root.split("://")[-1].strip("/") + "/"), "")
    rows = files.select("path", relative.alias("relative_path"), F.decode("content", "UTF-8").alias("text"))
    return rows.where(~F.col("relative_path").rlike(r"(^|/)\."))


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a .json file (a list, or an object with `records`) or of JSONL, as maps of strings: line, fields, error."""
    if not path.endswith(".json"):
        lines = spark.read.text(path).withColumn("line", F.row_number().over(Window.partitionBy(F.input_file_name()).orderBy(F.monotonically_increasing_id())))
        lines = lines.where(F.trim("value") != "")
    else:
        whole = spark.read.text(path, wholetext=True)
        listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.from_json(F.get_json_object("value", "$.records"), "array<string>"))
        lines = whole.select(F.posexplode(listed).alias("line", "value")).withColumn("line", F.col("line") + 1)
    parsed = F.from_json("value", "map<string,string>")
    return lines.select("line", parsed.alias("fields"), F.when(parsed.isNull(), "not a JSON object").alias("error"))


def queries_of(lines: DataFrame) -> DataFrame:
    """Cues of query lines: JSON objects with query or cue, or plain lines; empty ones are dropped."""
    told = F.coalesce(F.get_json_object("value", "$.query"), F.get_json_object("value", "$.cue"))
    cue = F.trim(F.when(F.ltrim("value").startswith("{"), told).otherwise(F.col("value")))
    return lines.select(cue.alias("cue")).where("cue <> ''")


def edge_proposals(fields: Column) -> Column:
    """Struct (child, parent, kind) of a proposal map, under its aliases."""
    has = lambda *names: F.coalesce(*(fields[n] for n in names))
    return F.struct(has("src_id", "child").alias("child"), has("dst_id", "parent").alias("parent"), F.coalesce(has("type", "kind"), F.lit("related_to")).alias("kind"))


def write_anchors(anchors: DataFrame, path: str) -> None:
    """Anchors as JSON lines, keys in order."""
    columns = sorted(anchors.columns)
    anchors.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("append").text(path)


def read_anchors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Anchors of a log; a line that does not parse is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_bundle(rows: DataFrame, manifest: DataFrame, path: str) -> None:
    rows.write.parquet(f"{path}/rows")
    manifest.write.parquet(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/manifest")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none where it does not exist."""
    path, fs = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def removed(spark: SparkSession, name: str) -> None:
    path, fs = _path(spark, name)
    fs.delete(path, True)


def write_bytes(spark: SparkSession, name: str, content: bytes) -> None:
    path, fs = _path(spark, name)
    out = fs.create(path)
    out.write(bytearray(content))
    out.close()


def published(spark: SparkSession, draft: str, final: str) -> bool:
    """Renames a draft, a file or a folder; where the name is taken the draft is removed and the answer is False.

    The file system's rename must refuse a taken name, as those of HDFS and local disks do.
    """
    (source, fs), (target, _) = _path(spark, draft), _path(spark, final)
    kinds = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri() if source.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        fs.mkdirs(target.getParent())
        context.rename(source, target, how)
    except Py4JJavaError:
        fs.delete(source, True)
        if fs.exists(target):
            return False
        raise
    return True


def publish_tables(spark: SparkSession, tables: dict[str, DataFrame], manifest: dict, path: str) -> bool:
    """Writes tables and manifest.json aside and shows them under `path` at once; False where something stands there."""
    draft = f"{path.rstrip('/')}.draft-{uuid.uuid4().hex}"
    try:
        for name, rows in tables.items():
            rows.write.parquet(f"{draft}/{name}")
        write_bytes(spark, f"{draft}/manifest.json", json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode())
        return published(spark, draft, path)
    finally:
        removed(spark, draft)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()["value"])
