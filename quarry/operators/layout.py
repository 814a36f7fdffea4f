"""Page layout: running matter, heading styles, heading state, nearest headings, links and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import scan
from quarry.sources.sinks import stored

# Lines of the upper margin, categories that hold concepts, least image side.
PUBLICATION_LINES = ["overview of amazon web services", "aws whitepaper"]
CONCEPT_GROUPS = ["Deployment models", "Security"]
MIN_IMAGE_SIDE = 150
MAX_HEADING_CHARS = 120


def overlap(a: str, b: str) -> Column:
    """Whether the boxes <a>_x0 .. <a>_y1 and <b>_x0 .. <b>_y1 share some area."""
    c = F.col
    return (c(f"{a}_x0") < c(f"{b}_x1")) & (c(f"{b}_x0") < c(f"{a}_x1")) & (c(f"{a}_y0") < c(f"{b}_y1")) & (c(f"{b}_y0") < c(f"{a}_y1"))


def running_matter(lines: DataFrame, page_height: float | Column, document: str = "document") -> DataFrame:
    """lines (document, line_id, page, text, y0, y1) with is_running: headers and footers. page_height may be a column.

    A publication line in the upper 5 % is a header. A footer is a row near the lower edge,
    lines within 3 units, that holds a standalone number and beside it a line of up to 120 characters that is
    none. Pages are few lines each, so the rows meet by a join on the document's page.
    """
    height = F.lit(page_height) if isinstance(page_height, float) else page_height
    top, bottom = height * 0.05, height - F.greatest(height * 0.05, F.lit(64.0))
    number = F.col("text").rlike(r"^\d+$")
    low = lines.filter(F.col("y0") >= bottom)
    numbers = low.filter(number).select(F.col(document).alias("n_document"), F.col("page").alias("n_page"), F.col("line_id").alias("number_id"), F.col("y0").alias("number_y"))
    rows = low.join(numbers, (F.col(document) == F.col("n_document")) & (F.col("page") == F.col("n_page")) & (F.abs(F.col("y0") - F.col("number_y")) <= 3))
    titled = rows.groupBy("n_document", "number_id").agg(F.max((~number & (F.length("text") <= 120)).cast("int")).alias("titled")).filter("titled = 1").select("n_document", "number_id")
    footers = rows.join(titled, ["n_document", "number_id"], "left_semi").select(F.col("n_document").alias("footer_document"), F.col("line_id").alias("footer_id")).distinct()
    marked = lines.join(footers, (F.col(document) == F.col("footer_document")) & (F.col("line_id") == F.col("footer_id")), "left").drop("footer_document")
    header = (F.col("y1") <= top) & F.lower("text").isin(PUBLICATION_LINES)
    return marked.withColumn("is_running", header | F.col("footer_id").isNotNull()).drop("footer_id")


def style_counts(lines: DataFrame) -> DataFrame:
    """(size, n) of bold lines of 1 to 120 characters by size to one decimal."""
    return lines.filter(F.col("bold") & F.length("text").between(1, MAX_HEADING_CHARS)).groupBy(F.bround("size", 1).alias("size")).agg(F.count("*").alias("n"))


def style_profile(lines: DataFrame, tolerance: float = 0.35) -> DataFrame:
    """One row: service_size, the most frequent recurring size (the smaller of equals), and category_size, the next recurring size above it from 16 on.

    Recurring sizes occur at least 3 times and measure 10 or more. Either is null where there is none.
    """
    recurring = style_counts(lines).filter("n >= 3 AND size >= 10")
    service = recurring.agg(F.max(F.struct("n", (-F.col("size")).alias("s"))).alias("best")).select((-F.col("best.s")).alias("service_size"))
    above = recurring.join(F.broadcast(service), (F.col("size") > F.col("service_size")) & (F.col("size") >= 16))  # one row
    category = above.agg(F.min("size").alias("category_size"), F.max("service_size").alias("s"))
    return service.join(F.broadcast(category), F.lit(True)).select("category_size", "service_size", F.lit(tolerance).alias("tolerance"))


def matches_style(size: float | Column, tolerance: float = 0.35) -> Column:
    return F.col("bold") & (F.abs(F.col("size") - size) <= tolerance) & (F.length("text") <= MAX_HEADING_CHARS)


def heading_state(lines: DataFrame, category_size: float, service_size: float, document: str = "document", order: str = "line_id") -> DataFrame:
    """Each line's category and service: the latest headings above it; a category heading ends its predecessor's service.

    kind says what the line is: category, service, body (of a service) or none.
    """
    is_category, is_service = matches_style(category_size), matches_style(service_size)
    by = Window.partitionBy(document).orderBy(order)
    numbered = lines.withColumn("category_no", F.sum(is_category.cast("long")).over(by))
    inner = Window.partitionBy(document, "category_no").orderBy(order)
    numbered = numbered.withColumn("category", F.first(F.when(is_category, F.col("text")), ignorenulls=True).over(inner))
    service = F.when((F.col("category_no") > 0) & ~is_category & is_service, F.col("text"))
    numbered = numbered.withColumn("service", F.last(service, ignorenulls=True).over(inner))
    kind = F.when(is_category, "category").when(F.col("category_no") == 0, "none").when(is_service, "service").when(F.col("service").isNotNull(), "body").otherwise("none")
    return numbered.withColumn("kind", kind)


def heading_state_of_long(lines: DataFrame, category_size: float, service_size: float, document: str = "document", order: str = "line_id", partitions: int | None = None) -> DataFrame:
    """`heading_state` for documents of any length: a document's lines may lie in many tasks. Documents may not be null.

    Categories are counted and carried over pieces; a category's services likewise, by its number.
    """
    is_category, is_service = matches_style(category_size), matches_style(service_size)
    cut = scan.pieces(lines, [document], [order], partitions)
    numbered = scan.running(cut, [document], [order], {"category_no": is_category.cast("long")}, {"category": F.when(is_category, F.col("text"))})
    service = F.when((F.col("category_no") > 0) & ~is_category & is_service, F.col("text"))
    numbered = scan.running(stored(numbered, "numbered"), [document, "category_no"], [order], {}, {"service": service})
    kind = F.when(is_category, "category").when(F.col("category_no") == 0, "none").when(is_service, "service").when(F.col("service").isNotNull(), "body").otherwise("none")
    return numbered.withColumn("kind", kind).drop("piece")


def nearest_heading_of_long(images: DataFrame, headings: DataFrame, document: str = "document", partitions: int | None = None) -> DataFrame:
    """`nearest_heading` for documents of any length: headings and images of one may lie in many tasks. Documents may not be null."""
    rows = headings.select(document, "page", "y", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("image_id"), "category")
    rows = rows.unionByName(images.select(document, "page", "y", F.lit(1).alias("kind"), F.col("image_id").cast("long"), F.lit(None).cast("string").alias("category")))
    rows, order = rows.withColumnRenamed("category", "heading"), ["page", "y", "kind", F.coalesce("heading", F.lit(""))]
    found = scan.running(scan.pieces(rows, [document], order, partitions), [document], order, {}, {"category": F.col("heading")})
    return found.filter("kind = 1").select(document, "image_id", "page", "y", "category")


def service_records(state: DataFrame, document: str = "document", order: str = "line_id") -> DataFrame:
    """(document, category, name, description, page_start, page_end) of the services that have a description."""
    by = Window.partitionBy(document, "category_no").orderBy(order)
    numbered = state.filter(F.col("kind").isin("service", "body")).withColumn("service_no", F.sum((F.col("kind") == "service").cast("long")).over(by))
    body = F.array_sort(F.collect_list(F.when(F.col("kind") == "body", F.struct(order, "text"))))
    out = numbered.groupBy(document, "category_no", "service_no").agg(
        F.first("category").alias("category"), F.first("service").alias("name"), body.alias("lines"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    text = F.btrim(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))
    return out.withColumn("description", text).filter("description <> ''").drop("lines")


def concepts_and_services(services: DataFrame, groups: list[str] = CONCEPT_GROUPS) -> DataFrame:
    """services with record_type and concept_group: entries of the concept groups are no services."""
    concept = F.col("category").isin(groups)
    return services.withColumn("record_type", F.when(concept, "concept").otherwise("service")).withColumn("concept_group", F.when(concept, F.col("category")))


def matter_ranges(categories: DataFrame, documents: DataFrame, document: str = "document") -> DataFrame:
    """(document, kind, page_start, page_end): pages before the first and after the last category, or the whole document where there is none.

    documents has page_count; categories has page_start and page_end.
    """
    span = categories.groupBy(document).agg(F.min("page_start").alias("first"), F.max("page_end").alias("last"))
    both = documents.join(span, document, "left")
    part = lambda ok, kind, a, b: F.when(ok, F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("page_start"), b.cast("int").alias("page_end")))
    none = F.col("first").isNull()
    ranges = F.array(
        part(none, "unparsed_document", F.lit(1), F.col("page_count")),
        part(~none & (F.col("first") > 1), "front_matter", F.lit(1), F.col("first") - 1),
        part(~none & (F.col("last") < F.col("page_count")), "back_matter", F.col("last") + 1, F.col("page_count")),
    )
    return both.select(document, F.explode(F.array_compact(ranges)).alias("r")).select(document, "r.*")


def nearest_heading(images: DataFrame, headings: DataFrame, document: str = "document") -> DataFrame:
    """images (document, image_id, page, y) with category: the last heading (document, page, y, category) at or above them, null for none.

    An as-of join without a join: headings and images run in one order, a heading before an
    image at its place, and each image takes the last heading so far.
    """
    rows = headings.select(document, "page", "y", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("image_id"), "category")
    rows = rows.unionByName(images.select(document, "page", "y", F.lit(1).alias("kind"), F.col("image_id").cast("long"), F.lit(None).cast("string").alias("category")))
    by = Window.partitionBy(document).orderBy("page", "y", "kind", F.asc_nulls_first("category"))
    found = rows.withColumn("category", F.last("category", ignorenulls=True).over(by))
    return found.filter("kind = 1").select(document, "image_id", "page", "y", "category")


def _same_page(other: DataFrame, document: str) -> tuple[DataFrame, Column]:
    """other with its document and page renamed, and the condition that they are a row's own."""
    renamed = other.withColumnRenamed(document, "other_document").withColumnRenamed("page", "other_page")
    return renamed, (F.col(document) == F.col("other_document")) & (F.col("page") == F.col("other_page"))


def overlapping_links(boxes: DataFrame, links: DataFrame, document: str = "document") -> DataFrame:
    """(document, owner, source_urls): the different links, in order, whose box on the page overlaps one of the owner's boxes.

    boxes has document, owner, page and box_x0 .. box_y1; links has document, page, uri and link_x0 .. link_y1.
    """
    other, here = _same_page(links, document)
    return boxes.join(other, here & overlap("box", "link")).groupBy(document, "owner").agg(F.sort_array(F.collect_set("uri")).alias("source_urls"))


def outside_regions(lines: DataFrame, regions: DataFrame, document: str = "document") -> DataFrame:
    """Lines (document, page, line_x0 .. line_y1) that overlap no table region (document, page, region_x0 .. region_y1)."""
    other, here = _same_page(regions, document)
    return lines.join(other, here & overlap("line", "region"), "left_anti")


def record_lines(lines: DataFrame, regions: DataFrame, document: str = "document") -> DataFrame:
    """Lines outside table regions with their white space collapsed, empty ones gone, numbered (line_no) in reading order within the document."""
    kept = outside_regions(lines, regions, document).withColumn("text", F.btrim(F.regexp_replace("text", r"\s+", " "))).filter("text <> ''")
    return kept.withColumn("line_no", F.row_number().over(Window.partitionBy(document).orderBy("page", "line_y0", "line_x0", "text")))


def image_routes(images: DataFrame, captioned: DataFrame, document: str = "document") -> DataFrame:
    """images with route: decorative_size, outside_catalog_category, already_captioned or captioned; the first that holds.

    captioned has document, category and page of what an earlier run has done.
    """
    done = captioned.select(F.col(document).alias("done_document"), F.col("category").alias("done_category"), F.col("page").alias("done_page")).distinct()
    both = images.join(done, (F.col(document) == F.col("done_document")) & (F.col("category") == F.col("done_category")) & (F.col("page") == F.col("done_page")), "left")
    small = F.least("pixel_width", "pixel_height", "render_width", "render_height") < MIN_IMAGE_SIDE
    route = F.when(small, "decorative_size").when(F.col("category").isNull(), "outside_catalog_category")
    route = route.when(F.col("done_page").isNotNull(), "already_captioned").otherwise("captioned")
    return both.withColumn("route", route).drop("done_document", "done_category", "done_page")


def with_captions(categories: DataFrame, captions: DataFrame, document: str = "document") -> DataFrame:
    """categories (document, name) with image_captions: the captions (document, category, page, image_path, caption) of each, in order of page and path; earlier ones go."""
    found = captions.groupBy(document, F.col("category").alias("name")).agg(F.array_sort(F.collect_list(F.struct("page", "image_path", "caption"))).alias("image_captions"))
    return categories.drop("image_captions").join(found, [document, "name"], "left")


def joined_spans(spans: DataFrame, gap: float = 0.75) -> DataFrame:
    """(line_id, text): spans (line_id, place, text, x0, x1) of a line in order, a blank between two with a gap of `gap` units and no white space at the seam. Empty spans go."""
    by = Window.partitionBy("line_id").orderBy("place")
    full = spans.filter("text <> ''").withColumn("before", F.lag("text").over(by)).withColumn("end", F.lag("x1").over(by))
    seam = F.col("before").isNotNull() & ~F.col("before").rlike(r"\s$") & ~F.col("text").rlike(r"^\s") & (F.col("x0") - F.col("end") >= gap)
    pieces = full.select("line_id", F.struct("place", F.concat(F.when(seam, " ").otherwise(""), "text").alias("t")).alias("p"))
    return pieces.groupBy("line_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"]), "").alias("text"))
