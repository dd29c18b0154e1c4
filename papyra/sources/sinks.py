"""Report sinks: flat CSV cells with German headers, and JSON with its metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StructType

# German headers.
HEADERS = {
    "document_id": "Dokument-ID", "title": "Titel", "correspondent": "Korrespondent", "correspondent_name": "Korrespondent",
    "document_type": "Dokumenttyp", "document_type_name": "Dokumenttyp", "created": "Erstellt", "modified": "Geändert",
    "tags": "Tags", "has_ocr": "OCR vorhanden", "issue_type": "Problem-Typ", "severity": "Schweregrad",
    "description": "Beschreibung", "file_size": "Dateigröße", "page_count": "Seitenanzahl",
    "archive_serial_number": "Archivnummer"}
BOM = "\ufeff"


def cell(df: DataFrame, name: str) -> Column:
    """Lists joined, records as JSON, booleans as Ja or Nein, null as empty."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, ArrayType):
        c = F.array_join(F.transform(c, lambda x: x.cast("string")), ", ") if not isinstance(kind.elementType, StructType) else F.to_json(c)
    elif isinstance(kind, (MapType, StructType)):
        c = F.to_json(c)
    elif isinstance(kind, BooleanType):
        c = F.when(c, "Ja").when(~c, "Nein")
    return F.coalesce(c.cast("string"), F.lit(""))


def flat(df: DataFrame, german: bool = False) -> DataFrame:
    return df.select(*[cell(df, n).alias(HEADERS.get(n, n) if german else n) for n in df.columns])


def csv_lines(df: DataFrame) -> DataFrame:
    """``line``: the flat cells of each row as a CSV line, quoted where needed."""
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    d = flat(df, False)
    return d.select(F.concat_ws(",", *[quoted(F.col(n)) for n in d.columns]).alias("line"))


def header(df: DataFrame, german: bool = True) -> str:
    return ",".join(HEADERS.get(n, n) if german else n for n in df.columns)


def write_csv(df: DataFrame, path: str, german: bool = True) -> None:
    """A folder of CSV parts, the first with a byte order mark and the header, the others without: joined in the order of
    their names they are one file. No rows, no header."""
    head = BOM + header(df, german)
    lines = csv_lines(df).withColumn("n", F.monotonically_increasing_id())
    least = lines.agg(F.min("n")).first()[0]
    lines.select(F.when(F.col("n") == F.lit(least), F.concat(F.lit(head + "\n"), "line")).otherwise(F.col("line")).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_json(df: DataFrame, path: str, generated_at: str, version: str = "1.0.0") -> None:
    """``data``, a folder of JSON lines, and ``metadata``, one line of when, by what and how many."""
    df.write.mode("overwrite").json(f"{path}/data")
    meta = df.agg(F.count("*").alias("record_count")).select(F.lit(generated_at).alias("generated_at"), F.lit("papyra").alias("generator"), F.lit(version).alias("version"), "record_count")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def write_quality_report(found: DataFrame, path: str, kind: str, generated_at: str = "") -> None:
    """Issues as CSV (five columns) or JSON; another kind is an error."""
    cols = [c for c in ("document_id", "issue_type", "severity", "description", "timestamp") if c in found.columns]
    if kind == "csv":
        write_csv(found.select(*cols), path)
    elif kind == "json":
        write_json(found, path, generated_at)
    else:
        raise ValueError(f"unknown format {kind}")


def write_statistics(parts: dict[str, DataFrame], path: str, kind: str, generated_at: str = "") -> None:
    """Named tables of statistics as JSON, a folder each; CSV is an error."""
    if kind != "json":
        raise ValueError(f"unknown format {kind}")
    for name, df in parts.items():
        write_json(df, f"{path}/{name}", generated_at)


def sidecar(df: DataFrame, name: str = "filename") -> DataFrame:
    """``path, value``: a JSON record beside each file, without its content."""
    rest = [c for c in df.columns if c != "content"]
    return df.select(F.concat(F.col(name), F.lit(".json")).alias("path"), F.to_json(F.struct(*rest)).alias("value"))


def save_ledger(ledger: DataFrame, path: str) -> None:
    ledger.write.mode("overwrite").json(path)


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A saved ledger; zeros in total where none was saved."""
    kinds = "model string, cost double, tokens long, requests long, alert boolean"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([(None, 0.0, 0, 0, False)], kinds)
    return spark.read.schema(kinds).json(path)
