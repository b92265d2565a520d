"""PDF files as a DataFrame: one pass over the bytes, then plain tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.text import is_pdf, pdf_date, pdf_version
from ..kernel.extract import parse
from ..options import ParseOptions
from ..session import importable

VALUE = "struct<kind:string,text:string,bool:boolean,choices:array<string>>"
SPAN = "struct<text:string,x:float,y:float,width:float,font_size:float,font_name:string>"
LINE = "struct<text:string,x:float,y:float,font_size:float,bold:boolean>"
TABLE = "struct<top:float,bottom:float,left:float,right:float,columns:array<float>,cells:array<array<string>>,confidence:float>"
IMAGE = "struct<name:string,data:binary,mime:string,width:int,height:int,bits:int,color_space:string,large:boolean>"
DOCUMENT = (
    "struct<title:string,author:string,subject:string,keywords:string,creator:string,producer:string,created:string,modified:string,pdf_version:string,page_count:int,encrypted:boolean,"
    "tagged:boolean,outline:array<struct<item_id:int,parent_id:int,ord:int,level:int,title:string,page:int>>,"
    f"fields:array<struct<name:string,type:string,value:{VALUE},default:{VALUE}>>>"
)
PAGE = (
    "struct<width:float,height:float,text_op_count:bigint,image_op_count:bigint,page_image:boolean,shown_chars:bigint,unseen_chars:bigint,ocr_text_suppressed:boolean,"
    f"spans:array<{SPAN}>,lines:array<{LINE}>,sizes:array<float>,tables:array<{TABLE}>,images:array<{IMAGE}>,fallback:string>"
)
SCHEMA = f"doc_id string, kind string, page int, document {DOCUMENT}, content {PAGE}, error struct<class:string,message:string>"
FILES_A_BATCH = 16


def binary_files(spark: SparkSession, path: str, glob: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """(doc_id, content) of the files below a path, read by Spark's own binary source."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(F.col("path").alias("doc_id"), "content")


def detect(files: DataFrame, content: str = "content") -> DataFrame:
    """files plus format (struct of version and linearized) and is_pdf, by the header alone."""
    version = pdf_version(F.col(content))
    return files.withColumn("is_pdf", version.isNotNull()).withColumn("format", F.when(version.isNotNull(), F.struct(version.alias("version"), F.lit(False).alias("linearized"))))


def parse_files(files: DataFrame, options: ParseOptions | None = None, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """The tagged rows of all files: kind is document, page or error.

    Files without the header become error rows before any Python sees them. The rest goes through one Arrow stage that
    never raises in lenient mode; page selection and image extraction act inside it, so nothing unwanted is decoded.
    Write the result or cache it if several of the tables below are needed.
    """
    options = options or ParseOptions()
    importable(files.sparkSession)
    files = files.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(content).alias("content"))
    schema = T._parse_datatype_string(SCHEMA)
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            names = batch.column("doc_id")
            for lo in range(0, batch.num_rows, FILES_A_BATCH):
                rows = []
                for k in range(lo, min(lo + FILES_A_BATCH, batch.num_rows)):
                    for row in parse(batch.column("content")[k].as_buffer().to_pybytes(), options):
                        rows.append({"doc_id": names[k].as_py()} | row)
                yield pa.RecordBatch.from_pylist(rows, shape)

    good = is_pdf(F.col("content"))
    parsed = files.where(good).mapInArrow(run, schema)
    bad = files.where(~F.coalesce(good, F.lit(False))).select(
        "doc_id", F.lit("error").alias("kind"), F.lit(0).alias("page"), F.lit(None).cast(DOCUMENT).alias("document"), F.lit(None).cast(PAGE).alias("content"),
        F.struct(F.lit("NotPdf").alias("class"), F.lit("no %PDF header").alias("message")).alias("error"))
    out = parsed.unionByName(bad)
    if not options.lenient:
        failed = F.raise_error(F.concat(F.lit("cannot parse "), "doc_id", F.lit(": "), F.col("error.message")))
        out = out.withColumn("error", F.when(F.col("error").isNotNull(), failed.cast("struct<class:string,message:string>")))
    return out


def metadata(parsed: DataFrame) -> DataFrame:
    d = F.col("document")
    plain = [d[c].alias(c) for c in ("title", "author", "subject", "keywords", "creator", "producer", "pdf_version", "page_count", "encrypted", "tagged")]
    return parsed.where("kind = 'document'").select("doc_id", *plain, pdf_date(d["created"]).alias("created"), pdf_date(d["modified"]).alias("modified"))


def pages(parsed: DataFrame) -> DataFrame:
    c = F.col("content")
    return parsed.where("kind = 'page'").select("doc_id", "page", *[c[x].alias(x) for x in ("width", "height", "text_op_count", "image_op_count", "page_image", "shown_chars", "unseen_chars", "ocr_text_suppressed")], F.lit(0).alias("rotation"))


def spans(parsed: DataFrame) -> DataFrame:
    out = parsed.where("kind = 'page'").select("doc_id", "page", F.posexplode("content.spans").alias("span_ord", "s")).select("doc_id", "page", "span_ord", "s.*")
    name = F.lower("font_name")
    return out.withColumn("is_bold", name.rlike("bold|black|heavy")).withColumn("is_italic", name.rlike("italic|oblique"))


def images(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'page'").select("doc_id", "page", F.posexplode("content.images").alias("ord", "i")).select("doc_id", "page", "ord", "i.*")


def outline(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'document'").select("doc_id", F.explode("document.outline").alias("o")).select("doc_id", "o.*")


def display(field: Column) -> Column:
    """A field's value, else its default; boxes as [x] or [ ], choices joined by a comma."""
    v = F.coalesce(field["value"], field["default"])
    shown = F.when(v["kind"] == "boolean", F.when(v["bool"], "[x]").otherwise("[ ]")).when(v["kind"] == "choices", F.array_join(v["choices"], ", ")).otherwise(v["text"])
    return F.coalesce(shown, F.lit(""))


def form_fields(parsed: DataFrame) -> DataFrame:
    """A row for each field, with its display value."""
    out = parsed.where("kind = 'document'").select("doc_id", F.posexplode("document.fields").alias("ord", "f"))
    return out.select("doc_id", "ord", "f.*", display(F.col("f")).alias("display"))


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'error'").select("doc_id", "page", F.col("error.class").alias("error_class"), F.col("error.message").alias("error_message"))
