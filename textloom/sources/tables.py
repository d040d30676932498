"""Where documents come from, and where chunks go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

_NOISE = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->"
_BLOCK = r"(?s)<h[1-6](?: [^>]*)?>.*?</h[1-6]>|<p(?: [^>]*)?>.*?</p>"
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
STRUCTURED = "source_file string, filename string, read_error string, paragraphs array<struct<paragraph_index:int,text:string,outline_level:int,style_name:string>>"


def text_files(spark: SparkSession, path: str, glob: str = "*.txt", limit: int | None = None) -> DataFrame:
    """source_file, filename and text of each file that is not an editor's lock file; ``limit`` keeps the first by path."""
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))
    files = files.where(~F.col("filename").startswith("~$"))
    return files.orderBy("source_file").limit(limit) if limit else files


def structured_files(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Documents that another tool has taken apart, one JSON object a line, with their file's path as ``path``; a broken line is a row with a read_error."""
    rows = spark.read.schema(STRUCTURED + ", _broken string").option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", glob).json(path).withColumn("path", F.col("_metadata.file_path"))
    return rows.withColumn("read_error", F.coalesce("read_error", F.when(F.col("_broken").isNotNull(), "not a document"))).drop("_broken")


def structured_paragraphs(docs: DataFrame, doc_key: str = "source_file") -> DataFrame:
    """Raw paragraphs of structured documents that were read without error."""
    each = docs.where("read_error IS NULL").select(F.col(doc_key).alias("doc_key"), F.posexplode("paragraphs").alias("ord", "p"))
    return each.select("doc_key", "ord", F.col("p.text").alias("raw"), F.coalesce("p.outline_level", F.lit(10)).alias("outline_level"), F.coalesce("p.style_name", F.lit("")).alias("style_name"))


def plain_html(html: Column) -> Column:
    """Text of an HTML fragment: tags go, common entities become characters."""
    out = F.regexp_replace(html, r"<[^>]+>", "")
    for entity, char in _ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def html_paragraphs(pages: DataFrame, doc_key: str = "page_id", html_col: str = "html") -> DataFrame:
    """Raw paragraphs of web pages: headings with their level, and p elements, in order."""
    blocks = F.regexp_extract_all(F.regexp_replace(F.col(html_col), _NOISE, ""), F.lit(_BLOCK), 0)
    each = pages.select(F.col(doc_key).alias("doc_key"), F.posexplode(blocks).alias("ord", "block"))
    level = F.when(F.substring("block", 2, 1) == "h", F.substring("block", 3, 1).cast("int")).otherwise(10)
    return each.select("doc_key", "ord", plain_html(F.col("block")).alias("raw"), level.alias("outline_level"), F.lit("").alias("style_name"))


def turn_paragraphs(conversations: DataFrame) -> DataFrame:
    """Raw paragraphs of conversations: system turns are headings of level 1, user turns of level 2."""
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(10)
    return conversations.select(F.col("conv_id").alias("doc_key"), F.col("turn").alias("ord"), F.col("text").alias("raw"), level.alias("outline_level"), F.lit("").alias("style_name"))


def size_diverse_sample(docs: DataFrame, count: int = 10, *, id_col: str = "doc_id", size_col: str = "n_chars") -> DataFrame:
    """(id, size, place): ``count`` documents evenly spread over the order by size, then id; all if there are no more.

    Rows are counted by size first, so the only unpartitioned window runs over distinct sizes; rows are numbered just
    within the few sizes that are hit.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(size_col).alias("size"))
    sizes = rows.groupBy("size").count()
    order = Window.orderBy("size")
    ends = sizes.withColumns({"upto": F.sum("count").over(order), "n": F.sum("count").over(Window.partitionBy())}).withColumn("before", F.col("upto") - F.col("count"))
    step = F.greatest(F.least(F.lit(count), F.col("n")) - 1, F.lit(1))
    wanted = ends.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(count), F.col("n")) - 1))).withColumn("at", F.floor(F.col("k") * (F.col("n") - 1) / step))
    hit = wanted.where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("upto"))).select("size", F.col("k").alias("place"), (F.col("at") - F.col("before") + 1).alias("nth"))
    inside = rows.join(hit.select("size").distinct(), "size", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("size").orderBy("id")))
    return inside.join(hit, ["size", "nth"]).select("id", "size", "place")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session may do without: it gets a temporary folder, which on a cluster no other machine could read."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="textloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet, for what reads it many times: each reader takes just its columns."""
    path = f"{checkpoint_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines at ``path``, in place of what is there.

    They are written beside it, whole, before the old table moves away and goes: a failed write leaves the old one, and
    what ``rows`` reads may be the old one itself.
    """
    spark, beside = rows.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows.write.json(f"{beside}.new")
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(place(path)) and not fs.rename(place(path), place(f"{beside}.old")):
        raise OSError(f"cannot move {path} away; the new table is at {beside}.new")
    if not fs.rename(place(f"{beside}.new"), place(path)):
        raise OSError(f"cannot move {beside}.new to {path}; the old table is at {beside}.old")
    fs.delete(place(f"{beside}.old"), True)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines: schema_version, chunk_id, text and all other columns as payload."""
    rest = [c for c in chunks.columns if c not in ("schema_version", "chunk_id", "text")]
    version = F.col("schema_version") if "schema_version" in chunks.columns else F.lit("chunks_v1")
    replace_json(chunks.select(version.alias("schema_version"), "chunk_id", "text", F.struct(*rest).alias("payload")), path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with flat columns: what ``write_chunks`` wrote, or files that end in .json with an array of chunks or an object with ``chunks``.

    A file of another shape is an error. Payload columns win over columns of the chunk itself, as do those of a chunk
    without payload.
    """
    rows = spark.read.option("multiLine", path.endswith(".json")).option("mode", "FAILFAST").json(path)
    if "chunks" in rows.columns:
        if not isinstance(rows.schema["chunks"].dataType, ArrayType):
            raise ValueError(f"no chunks in {path}")
        rows = rows.select(F.explode("chunks").alias("c")).select("c.*")
    if not {"chunk_id", "text"} & set(rows.columns):
        raise ValueError(f"no chunks in {path}")
    inner = rows.schema["payload"].dataType.fieldNames() if "payload" in rows.columns else []
    outer = [c for c in rows.columns if c != "payload" and c not in inner]
    return rows.select(*(F.col(f"`{c}`") for c in outer), *(F.col(f"payload.`{c}`") for c in inner))


ENTRY = "catalog_id string, doc_name string, filename string, doc_id string, aliases array<string>, order_numbers array<string>"
_BUNDLE = """documents array<struct<doc_id:string,doc_name:string,annotation:string>>, abbreviations array<struct<abbreviation:string,expansion:string>>, terms array<struct<id:string,label:string>>,
graph_abbreviations array<struct<id:string,label:string>>, topic_aliases array<struct<phrase:string,doc_name_substrings:array<string>,negative_doc_name_substrings:array<string>>>"""
_QUESTION = "id string, name string, query string, filters map<string,string>, limit int, profile string, mode string, trace_id string, expected struct<doc_name:string,point_number:string,chunk_id:string>, best_pipeline string"


def there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def write_catalog(entries: DataFrame, path: str) -> None:
    """Catalog entries as JSON lines."""
    kinds = dict(x.strip().split(" ") for x in ENTRY.split(","))
    replace_json(entries.select(*((F.col(c) if c in entries.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items())), path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Entries that have a name, from JSON lines of entries or one object with ``entries``; a missing path has none. Nulls become empty."""
    kinds = dict(x.strip().split(" ") for x in ENTRY.split(","))
    if not there(spark, path):
        return spark.createDataFrame([], ENTRY)
    inner = ", ".join(f"{c}:{k}" for c, k in kinds.items())
    rows = spark.read.schema(f"{ENTRY}, entries array<struct<{inner.replace(', ', ',')}>>").option("multiLine", path.endswith(".json")).json(path)
    each = rows.select(F.explode(F.coalesce("entries", F.array(F.struct(*kinds)))).alias("e")).select("e.*").where(F.coalesce("doc_name", F.lit("")) != "")
    return each.select(*(F.coalesce(c, F.lit("") if k == "string" else F.array().cast(k)).alias(c) for c, k in kinds.items()))


def read_knowledge(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a knowledge bundle, one JSON object: documents with an id, abbreviations, terms, graph_abbreviations and topics, each with its ``position``; a missing path has empty ones."""
    bundle = spark.read.schema(_BUNDLE).option("multiLine", True).json(path) if there(spark, path) else spark.createDataFrame([], _BUNDLE)
    table = lambda c: bundle.select(F.posexplode(c).alias("position", "r")).select("position", "r.*")
    none = F.array().cast("array<string>")
    topics = table("topic_aliases").select("position", "phrase", F.coalesce("doc_name_substrings", none).alias("doc_names"), F.coalesce("negative_doc_name_substrings", none).alias("not_doc_names"))
    return {"documents": table("documents").where(F.coalesce("doc_id", F.lit("")) != ""), "abbreviations": table("abbreviations"), "terms": table("terms"), "graph_abbreviations": table("graph_abbreviations"), "topics": topics}


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON array (or JSON lines), with qid and filters as lists; what is not a question is an error when it is read."""
    rows = spark.read.schema(_QUESTION).option("multiLine", True).option("mode", "FAILFAST").json(path)
    # Numbered in a column of its own: inside coalesce, only the rows that get there would be counted.
    rows = rows.withColumn("place", F.monotonically_increasing_id() + 1)
    named = F.coalesce(F.nullif("id", F.lit("")), F.nullif("name", F.lit("")), F.concat(F.lit("q"), "place"))
    # A value that is a list comes as its JSON text.
    values = F.transform_values("filters", lambda _, v: F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v)))
    return rows.select(named.alias("qid"), *rows.columns).withColumn("filters", values).drop("place")


def manifest(metadata: DataFrame) -> DataFrame:
    """(manifest_kind, filename, line): rows of the two tables of documents whose metadata want a look, as Markdown.

    Cells have no line ends or bars and 120 characters at most, the last of which is then an ellipsis.
    """

    def cell(c: str) -> Column:
        t = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("/"))
        return F.when(F.length(t) > 120, F.concat(F.substring(t, 1, 119), F.lit("…"))).otherwise(t)

    cells = [cell(c) for c in ("filename", "manifest_kind", "metadata_source", "doc_title_full", "doc_reg", "doc_date", "authority")]
    return metadata.where("manifest_kind <> ''").select("manifest_kind", "filename", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
