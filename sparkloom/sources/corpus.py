"""Documents tables from Parquet tables: the same analysis as for files."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fingerprint, meta
from ..functions.text import normalize, snippet

#: The moment at which the requests over generated tables are made.
AS_OF = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def analysed(parsed: DataFrame, hashes: bool = True) -> DataFrame:
    """Adds what requests need to rows with path and text; columns that a request doesn't use are never computed."""
    text, path = F.col("text"), F.col("path")
    columns = {"norm": normalize(text), "snippet": snippet(text), "doc_type": meta.doc_type(text, path), "dates": meta.dates(text), "amounts": meta.amounts(text), "emails": meta.emails(text), "entities": meta.entities(text)}
    return parsed.withColumns(columns | ({"simhash": fingerprint.simhash(text)} if hashes else {}))


def mtime_of(key: Column) -> Column:
    """A day of the two years before AS_OF, by a key."""
    return F.timestamp_seconds(F.lit(int(AS_OF.timestamp())) - key % 730 * 86_400)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated documents, with a path by source and a time of modification by id."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    placed = rows.select(
        "doc_id",
        F.concat(F.lit("/corpus/"), "source", F.lit("/doc_"), "doc_id", F.lit(".txt")).alias("path"),
        F.lit("text").alias("kind"),
        F.lit(None).cast("string").alias("language"),
        mtime_of(F.col("doc_id")).alias("mtime"),
        F.lit(None).cast("string").alias("title"),
        "text",
    )
    return analysed(placed)


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A letter for each order, with a type, a date in one of four forms, amounts, an address and a name."""
    orders, customers = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    day, k = F.col("o_orderdate"), F.col("o_orderkey")
    forms = [F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "MM/dd/yyyy"), F.date_format(day, "dd MMMM yyyy"), F.date_format(day, "MMMM dd, yyyy")]
    date = F.when(k % 4 == 0, forms[0]).when(k % 4 == 1, forms[1]).when(k % 4 == 2, forms[2]).otherwise(forms[3])
    kind = F.when(k % 3 == 0, "Invoice number ").when(k % 3 == 1, "This agreement has the number ").otherwise("Note ")
    text = F.concat(
        kind, k.cast("string"), F.lit(" dated "), date, F.lit(". The sum is $"), F.format_number(F.round("o_totalprice", 2), 2), F.lit(" for Mister Customer Number, limit $"),
        (k % 50 + 1).cast("string"), F.lit("K. Write to Desk"), (F.col("o_custkey") % 100).cast("string"), F.lit("@Example.com or office@example.org."),
    )
    placed = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        k.alias("doc_id"),
        F.concat(F.lit("/orders/"), F.col("o_orderpriority").substr(1, 1), F.lit("/letter_"), k.cast("string"), F.lit(".txt")).alias("path"),
        F.lit("text").alias("kind"),
        F.lit(None).cast("string").alias("language"),
        mtime_of(k).alias("mtime"),
        F.concat(F.lit("Letter "), k.cast("string")).alias("title"),
        text.alias("text"),
    )
    return analysed(placed)
