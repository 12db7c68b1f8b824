"""Rows and files of the export formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Columns of the library's CSV, in order. Fixed values.
CSV_COLUMNS = ("title", "authors", "year", "venue", "arxiv_id", "doi", "status", "priority", "deadline", "tags", "quality", "added_at", "finished_at", "reading_hours", "comprehension", "importance")


def library_csv(items: DataFrame) -> DataFrame:
    """CSV_COLUMNS as strings; a column that items lacks is empty, reading_hours come from `seconds`."""
    hours = items.withColumn("reading_hours", (F.coalesce("seconds", F.lit(0)) / 3600).cast("double"))
    return csv_rows(hours.select(*(F.col(c) if c in hours.columns else F.lit(None).cast("string").alias(c) for c in CSV_COLUMNS)))


def csv_rows(items: DataFrame) -> DataFrame:
    """Export columns as strings: lists joined by "; ", hours with two decimals, nulls empty."""
    out = []
    for f in items.schema.fields:
        c = F.col(f.name)
        kind = f.dataType.typeName()
        text = F.array_join(c, "; ") if kind == "array" else F.format_string("%.2f", c) if kind in ("double", "decimal", "float") else c.cast("string")
        out.append(F.coalesce(text, F.lit("")).alias(f.name))
    return items.select(*out)


def write_csv(items: DataFrame, path: str) -> None:
    """CSV files with a header; the first column's name begins with a byte order mark, so that spreadsheets read UTF-8."""
    rows = csv_rows(items)
    first = rows.columns[0]
    rows.withColumnRenamed(first, "﻿" + first).write.option("header", True).option("quoteAll", True).mode("overwrite").csv(path)


def ascii_slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits; letters with accents lose them."""
    return F.regexp_replace(F.lower(F.translate(text, "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿ", "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyy")), "[^a-z0-9]", "")


def character(code: Column) -> Column:
    """The character of a Unicode code point (`char` takes it modulo 256); surrogates, which are no characters, are passed over."""
    code = F.when(code >= 0xD800, code + 0x800).otherwise(code)
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def suffix(n: Column) -> Column:
    """Nothing for 1, then a to z, then aa, ab …"""
    k = n - 2
    letter = lambda x: character(F.lit(97) + x.cast("int"))
    return F.when(n <= 1, "").when(k < 26, letter(k)).otherwise(F.concat(letter(F.floor(k / 26) - 1), letter(k % 26)))


def bibtex_keys(papers: DataFrame, id_col: str, surname: str, year: str) -> DataFrame:
    """cite_key: surname and year, with a suffix where papers before it (by id) have the same."""
    slug = ascii_slug(F.col(surname))
    base = F.concat(F.when(slug == "", "paper").otherwise(F.coalesce(slug, F.lit("paper"))), F.coalesce(F.col(year).cast("string"), F.lit("nd")))
    w = Window.partitionBy("_base").orderBy(id_col)
    return papers.withColumn("_base", base).withColumn("cite_key", F.concat("_base", suffix(F.row_number().over(w)))).drop("_base")


def bibtex_entry(key: Column, kind: Column, fields: dict[str, Column]) -> Column:
    escaped = lambda c: F.replace(F.replace(c, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"  {name} = {{"), escaped(c), F.lit("}"))) for name, c in fields.items()]
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def tsv_field(text: Column) -> Column:
    """A field of tab-separated values: line breaks as <br>, tabs as spaces, HTML escaped."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(safe, F.lit("\t"), F.lit(" ")), F.lit("\n"), F.lit("<br>"))


def markdown_notes(notes: DataFrame, group: str, order: str, author: str, text: str) -> DataFrame:
    """(group, markdown): a list item for each note, in order."""
    item = F.concat(F.lit("- **"), F.col(author), F.lit("**: "), F.regexp_replace(text, r"\s+", " "))
    rows = notes.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("t")))).alias("r"))
    return rows.select(group, F.array_join(F.transform("r", lambda x: x["t"]), "\n").alias("markdown"))


def interleaved_pages(source: DataFrame, translated: DataFrame, page: str) -> DataFrame:
    """(page, side) in reading order: source 1, translated 1, source 2 …; a side that is missing is skipped."""
    both = source.select(page, F.lit(0).alias("side")).union(translated.select(page, F.lit(1).alias("side")))
    return both.distinct()


def dump(tables: dict[str, DataFrame], path: str, user_col: str = "user_id") -> None:
    """One folder of JSON lines a table, partitioned by user where the table has users."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(user_col) if user_col in df.columns else writer).json(f"{path}/{name}")


def restore(existing: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """(status, n): what an idempotent import of given rows does: created, skipped (the key is there), failed (no key)."""
    known = existing.select(*keys).distinct().withColumn("_known", F.lit(True))
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | F.col(k).isNull()
    status = F.when(keyless, "failed").when(F.col("_known"), "skipped").otherwise("created")
    return given.join(known, keys, "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def manifest(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, sha256, size) of each asset, the first of equal keys; null contents are left out."""
    return files.where(F.col(content).isNotNull()).groupBy(key).agg(F.min(content).alias("c")).select(key, F.sha2(F.col("c").cast("binary"), 256).alias("sha256"), F.octet_length("c").cast("long").alias("size"))
