"""Loose CSV, TSV, JSON and JSONL records."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import row_numbers

TRUE_WORDS = ("1", "true", "t", "yes", "y")
FALSE_WORDS = ("0", "false", "f", "no", "n")


def json_records(doc: Column) -> Column:
    """One JSON text as array<map<string,string>>.

    A list gives its objects (a scalar item becomes ``{"value": item}``), an
    object of objects gives the inner ones with ``_json_key``, any other
    object is one record, and a bare scalar is wrapped.
    """
    doc = F.trim(doc)
    as_map = lambda s: F.from_json(s, "map<string,string>")
    wrap = lambda s: F.create_map(F.lit("value"), s)
    is_obj = lambda s: F.startswith(s, F.lit("{"))
    items = F.transform(
        F.from_json(doc, "array<string>"), lambda e: F.when(is_obj(e), as_map(e)).otherwise(wrap(e))
    )
    outer = F.map_entries(as_map(doc))
    keyed = F.transform(
        outer,
        lambda e: F.map_concat(
            F.map_filter(as_map(e["value"]), lambda k, _: k != "_json_key"),
            F.create_map(F.lit("_json_key"), e["key"]),
        ),
    )
    nested = (F.size(outer) > 0) & F.forall(outer, lambda e: F.coalesce(is_obj(e["value"]), F.lit(False)))
    return (
        F.when(F.startswith(doc, F.lit("[")), items)
        .when(is_obj(doc), F.when(nested, keyed).otherwise(F.array(as_map(doc))))
        .otherwise(F.array(wrap(F.regexp_replace(doc, '^"|"$', ""))))
    )


def tolerant_bool(col: Column) -> Column:
    """yes/no, true/false, 1/0 in any case; anything else is null."""
    word = F.lower(F.trim(col.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def tolerant_number(col: Column, kind: str = "double") -> Column:
    """Blank or unreadable numbers are null."""
    return F.trim(col.cast("string")).try_cast(kind)


def read_csv_required(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """All-string CSV (plain or gzip); missing required columns are an error."""
    df = spark.read.csv(path, header=True, multiLine=False, escape='"')
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{path}: missing columns {', '.join(missing)}")
    return df


def read_csv_records(
    spark: SparkSession, path: str, header_words: Sequence[str], fallback: Sequence[str]
) -> DataFrame:
    """CSV files that may or may not start with a header.

    A file whose first row holds one of ``header_words`` is read by its own
    header, any other by ``fallback`` names.  Gives (file, record_number,
    record map); numbering runs over the whole file without one big task.
    """
    raw = spark.read.csv(path, header=False, escape='"').select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    data = [c for c in raw.columns if not c.startswith("_file") and c not in ("_block", "_id")]
    cells = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in data])
    numbered = row_numbers(
        raw.select("_file", "_block", "_id", cells.alias("cells")), ["_file"], ["_block", "_id"], "_rn"
    )
    words = F.array(*[F.lit(w.lower()) for w in header_words])
    is_header = F.arrays_overlap(F.transform("cells", lambda c: F.lower(F.trim(c))), words)
    heads = numbered.where((F.col("_rn") == 1) & is_header).select("_file", F.col("cells").alias("names"))
    default = F.array(*[F.lit(f) for f in fallback])
    joined = numbered.join(heads, "_file", "left")
    has = F.col("names").isNotNull()
    return (
        joined.where(~has | (F.col("_rn") > 1))
        .select(
            F.element_at(F.split("_file", "/"), -1).alias("file"),
            (F.col("_rn") - F.when(has, 1).otherwise(0)).alias("record_number"),
            F.map_filter(
                F.map_from_entries(
                    F.filter(
                        F.arrays_zip(F.coalesce("names", default).alias("k"), F.col("cells").alias("v")),
                        lambda e: e["k"].isNotNull() & (e["k"] != ""),
                    )
                ),
                lambda _, v: v.isNotNull(),
            ).alias("record"),
        )
    )


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one per file, as numbered records."""
    docs = spark.read.text(path, wholetext=True).select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"),
        F.posexplode(json_records(F.col("value"))).alias("p", "record"),
    )
    return docs.select("file", (F.col("p") + 1).cast("long").alias("record_number"), "record")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the CSV and JSON members of zip archives.

    A zip cannot be split, so an archive is one task; its members are streamed
    row by row and leave in batches.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(z.namelist()):
                        kind = member.rsplit(".", 1)[-1].lower()
                        if kind not in ("csv", "json"):
                            continue
                        rows = []
                        with z.open(member) as fh:
                            if kind == "csv":
                                reader = csv.DictReader(io.TextIOWrapper(fh, "utf-8-sig", newline=""))
                                texts = (json.dumps(r, ensure_ascii=False) for r in reader)
                            else:
                                texts = iter([fh.read().decode("utf-8-sig")])
                            for number, text in enumerate(texts, 1):
                                rows.append((archive, member, kind, number, text))
                                if len(rows) == 5000:
                                    yield pd.DataFrame(rows, columns=["archive", "member", "format", "n", "doc"])
                                    rows = []
                        if rows:
                            yield pd.DataFrame(rows, columns=["archive", "member", "format", "n", "doc"])

    docs = (
        spark.read.format("binaryFile").load(path).select("path", "content")
        .mapInPandas(unpack, "archive string, member string, format string, n long, doc string")
    )
    return docs.select(
        "archive", "member", "format", "n", F.posexplode(json_records(F.col("doc"))).alias("p", "record")
    ).select(
        "archive",
        "member",
        "format",
        F.when(F.col("format") == "csv", F.col("n")).otherwise(F.col("p") + 1).cast("long").alias("record_number"),
        "record",
    )


def variant_counts(cell: Column) -> Column:
    """``Foo (2); Bar (3)`` to array<struct<variant,n>>."""
    pattern = r"^(.+) \((\d+)\)$"
    return F.transform(
        F.filter(F.split(cell, "; "), lambda p: p != ""),
        lambda p: F.struct(
            F.regexp_extract(p, pattern, 1).alias("variant"),
            F.regexp_extract(p, pattern, 2).try_cast("long").alias("n"),
        ),
    )


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with the raw text kept, so bad lines are not lost."""
    return spark.read.text(path).where(F.trim("value") != "").select(
        "value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("record")
    )
