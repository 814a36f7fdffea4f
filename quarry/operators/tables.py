"""Tables found on pages: continued tables, repeated headers, shapes, titles and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import clean_cell, collapsed, token_count

# Fixed value: headers of the table that lists services by category.
EXPECTED_HEADERS = ["category", "aws service"]


def normalised(cells: str | Column) -> Column:
    return F.transform(cells, collapsed)


def shape(headers: str | Column) -> Column:
    return F.when(normalised(headers) == F.array(*map(F.lit, EXPECTED_HEADERS)), "category_aws_service").otherwise("unrecognized_table")


def body_rows(rows: str | Column, headers: str | Column) -> Column:
    """Rows (arrays of cells) that are neither blank nor the headers again."""
    head = normalised(headers)
    return F.filter(rows, lambda r: (normalised(r) != head) & F.exists(normalised(r), lambda c: c != ""))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, clean_cell), " | "), F.lit(" |"))


def markdown(headers: str | Column, rows: str | Column) -> Column:
    """A Markdown table: header, separator, a line for each row."""
    headers = F.col(headers) if isinstance(headers, str) else headers
    rows = F.col(rows) if isinstance(rows, str) else rows
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(markdown_row(headers), rule), F.transform(rows, markdown_row)), "\n")


def continued(tables: DataFrame, document: str = "document", order: str = "table_id") -> DataFrame:
    """Tables (document, table_id, title, page_start, page_end, headers, rows) joined with those that go on from them.

    A table goes on where it begins on the page after the one before it ends, with the same
    headers; these are islands in the order of tables, their rows follow one another.
    """
    by = Window.partitionBy(document).orderBy(order)
    same = (F.col("page_start") == F.lag("page_end").over(by) + 1) & (normalised("headers") == F.lag(normalised("headers")).over(by))
    marked = tables.withColumn("begins", (~F.coalesce(same, F.lit(False))).cast("long")).withColumn("island", F.sum("begins").over(by))
    part = F.array_sort(F.collect_list(F.struct(order, "title", "headers", "rows", "page_start", "page_end")))
    merged = marked.groupBy(document, "island").agg(part.alias("p"))
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    return merged.select(
        document, first[order].alias(order), first["title"].alias("title"), first["page_start"].alias("page_start"), last["page_end"].alias("page_end"),
        first["headers"].alias("headers"), F.flatten(F.transform("p", lambda x: x["rows"])).alias("rows"), F.size("p").alias("parts"))


def extracted(found: DataFrame, document: str = "document") -> DataFrame:
    """found (document, page, headers, rows, error) as tables: with cleaned headers, body rows and shape.

    Where no header was found the first row is the header. Rows of a page that could not be read (error not null) are no tables; `extraction_report` has them.
    """
    clean = lambda cells: F.transform(cells, lambda c: F.btrim(F.coalesce(c, F.lit(""))))
    rows = F.transform(F.coalesce("rows", F.array().cast("array<array<string>>")), clean)
    held = found.filter("error IS NULL").withColumn("_rows", rows).withColumn("_head", clean(F.coalesce("headers", F.array().cast("array<string>"))))
    lacks = (F.size("_head") == 0) & (F.size("_rows") > 0)
    held = held.withColumn("headers", F.when(lacks, F.get("_rows", F.lit(0))).otherwise(F.col("_head")))
    held = held.withColumn("rows", F.when(lacks, F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(1)))).otherwise(F.col("_rows")))
    return held.withColumn("rows", body_rows("rows", "headers")).withColumn("shape", shape("headers")).drop("_rows", "_head", "error")


def extraction_report(found: DataFrame, document: str = "document") -> DataFrame:
    """(document, page, headers, reason): pages that could not be read, and tables whose header is not the expected one."""
    failed = found.filter("error IS NOT NULL").select(document, "page", F.lit(None).cast("array<string>").alias("headers"), F.concat(F.lit("tables not read: "), "error").alias("reason"))
    other = extracted(found, document).filter("shape = 'unrecognized_table'").select(document, "page", "headers", F.lit("unexpected header").alias("reason"))
    return failed.unionByName(other)


def nearest_title(tables: DataFrame, lines: DataFrame, document: str = "document") -> DataFrame:
    """tables (document, table_id, page, y0, headers) with title: the nearest line above with `compare` in it, else the headers joined by ` | `."""
    above = lines.filter(F.lower("text").contains("compare")).select(F.col(document).alias("l_document"), F.col("page").alias("l_page"), F.col("y1").alias("l_y1"), F.col("text").alias("l_text"))
    met = tables.select(document, "table_id", "page", "y0").join(above, (F.col(document) == F.col("l_document")) & (F.col("page") == F.col("l_page")) & (F.col("l_y1") <= F.col("y0")))
    best = met.groupBy(document, "table_id").agg(F.min(F.struct((F.col("y0") - F.col("l_y1")).alias("d"), "l_text")).alias("b")).select(document, "table_id", F.col("b.l_text").alias("found"))
    return tables.join(best, [document, "table_id"], "left").withColumn("title", F.coalesce("found", F.array_join("headers", " | "))).drop("found")


def row_groups(rows: DataFrame, budget: int, key: str = "table_id", order: str = "row_no", size: str = "size") -> DataFrame:
    """rows with group_no: rows in order, a new group where one more row would exceed the budget.

    A group holds one row at least. Tables are folded each in one expression, so a table's rows
    must fit a task.
    """
    gathered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, size))).alias("r"))
    start = F.struct(F.lit(1).alias("g"), F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<struct<place:bigint,g:int>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        over = (acc["used"] > 0) & (acc["used"] + x[size] > budget)
        g = (acc["g"] + over.cast("int")).cast("int")
        used = F.when(over, F.lit(0)).otherwise(acc["used"]).cast("long") + x[size].cast("long")
        return F.struct(g.alias("g"), used.alias("used"), F.concat(acc["out"], F.array(F.struct(x[order].cast("long").alias("place"), g.alias("g")))).alias("out"))

    folded = gathered.select(key, F.explode(F.aggregate("r", start, step)["out"]).alias("o"))
    folded = folded.select(F.col(key).alias("g_key"), F.col("o.place").alias("g_place"), F.col("o.g").alias("group_no"))
    return rows.join(folded, (rows[key] == folded["g_key"]) & (rows[order] == folded["g_place"])).drop("g_key", "g_place")


def table_parts(tables: DataFrame, max_tokens: int) -> DataFrame:
    """tables once for each part, with part (from 1), parts and text: title and Markdown, cut between rows so that a part has at most max_tokens tokens where its rows allow it; the header is repeated.

    A table is folded where it lies; nothing is shuffled. A table without rows has no parts.
    """
    head = token_count(F.concat_ws("\n\n", "title", markdown("headers", F.array().cast("array<array<string>>"))))
    sized = F.transform("rows", lambda r: F.struct(r.alias("row"), token_count(markdown_row(r)).cast("long").alias("size")))
    start = F.struct(F.lit(1).alias("g"), F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<struct<g:int,row:array<string>>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        # The header's share is off the budget of every part.
        over = (acc["used"] > 0) & (acc["used"] + x["size"] > F.lit(max_tokens) - F.col("_head"))
        g = (acc["g"] + over.cast("int")).cast("int")
        used = F.when(over, F.lit(0)).otherwise(acc["used"]).cast("long") + x["size"]
        return F.struct(g.alias("g"), used.alias("used"), F.concat(acc["out"], F.array(F.struct(g.alias("g"), x["row"].alias("row")))).alias("out"))

    folded = tables.filter(F.size("rows") > 0).withColumn("_head", head).withColumn("_fold", F.aggregate(sized, start, step))
    parts = F.transform(F.sequence(F.lit(1), F.col("_fold.g")), lambda i: F.transform(F.filter("_fold.out", lambda o: o["g"] == i), lambda o: o["row"]))
    cut = folded.select(*tables.columns, F.col("_fold.g").alias("parts"), F.posexplode(parts).alias("_at", "_rows"))
    return cut.select(*tables.columns, (F.col("_at") + 1).alias("part"), "parts", F.concat_ws("\n\n", F.btrim("title"), markdown("headers", "_rows")).alias("text"))
