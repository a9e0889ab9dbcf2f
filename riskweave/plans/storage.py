"""Files written to the shared folder and read back: nothing is lost on the way."""

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import files
from .registry import query

# Every seventh value is missing and every eleventh is empty; quotes and line breaks come with the texts.
HOLES = "CASE WHEN {key} % 7 = 0 THEN NULL WHEN {key} % 11 = 0 THEN '' ELSE {value} END"


def with_holes(key: str, value: str):
    return F.expr(HOLES.format(key=key, value=value)).alias(value)


def place(t, kind: str) -> str:
    return f"{shared_dir(t.spark)}/{kind}-{uuid.uuid4().hex}"


@query("csv_round_trip", f"SELECT c_custkey, {HOLES.format(key='c_custkey', value='c_name')} AS c_name, c_acctbal FROM customer")
def csv_round_trip(t):
    rows = t.customer.select("c_custkey", with_holes("c_custkey", "c_name"), "c_acctbal")
    files.write_csv(rows, path := place(t, "csv"))
    return files.normalize_columns(files.read_csv(t.spark, path, rows.schema))


@query("multiline_csv_round_trip", f"SELECT doc_id, {HOLES.format(key='doc_id', value='text')} AS text, lang FROM documents")
def multiline_csv_round_trip(t):
    rows = t.documents.select("doc_id", with_holes("doc_id", "text"), "lang")
    files.write_csv(rows, path := place(t, "csv"))
    return files.read_csv_multiline(t.spark, path, rows.schema)


@query("json_round_trip", f"SELECT conv_id, turn, role, {HOLES.format(key='(conv_id + turn)', value='text')} AS text FROM conversations")
def json_round_trip(t):
    rows = t.conversations.select("conv_id", "turn", "role", with_holes("(conv_id + turn)", "text"))
    files.write_json(rows, path := place(t, "json"))
    return t.spark.read.schema(rows.schema).json(path)


@query("json_with_nulls", f"""
SELECT c_custkey, '{{"c_custkey":' || c_custkey || ',"c_mktsegment":' ||
       coalesce('"' || ({HOLES.format(key='c_custkey', value='c_mktsegment')}) || '"', 'null') || '}}' AS record FROM customer
""")
def json_with_nulls(t):
    rows = t.customer.select("c_custkey", with_holes("c_custkey", "c_mktsegment"))
    return files.as_json(rows).select(F.get_json_object("record", "$.c_custkey").cast("long").alias("c_custkey"), "record")


@query("folder_files", """
SELECT 'p' || (page_id % 5) AS folder, count(*) AS n_pages, sum(octet_length(encode(url)) + 1)::BIGINT AS n_bytes FROM pages GROUP BY 1
""")
def folder_files(t):
    """Addresses written as lines into labelled folders; every file is listed with its folder and content again."""
    path = place(t, "folders")
    rows = t.pages.select(F.concat(F.lit("p"), (F.col("page_id") % 5).cast("string")).alias("folder"), "url")
    rows.write.partitionBy("folder").text(path)
    found = files.labelled_files(t.spark, path).where(F.col("path").endswith(".txt"))
    lines = F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1
    return found.groupBy(F.regexp_extract("folder", r"folder=(p\d)", 1).alias("folder")).agg(
        F.sum(lines).alias("n_pages"), F.sum(F.octet_length("content")).alias("n_bytes"))
