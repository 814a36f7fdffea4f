"""Chunking: Markdown sections, recursive character splits, parents and children, catalog chunks."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import clean_markdown, header_metadata, slug
from quarry.operators import tables as T
from quarry.sources.readers import small_batches, tidy

# Sizes in characters and separators of parents and children.
PARENT_SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
CHILD_SEPARATORS = ["\n\n", "\n|", "\n- ", "\n", ". ", " "]
THRESHOLD, PARENT_SIZE, PARENT_OVERLAP, CHILD_SIZE, CHILD_OVERLAP = 2500, 2000, 200, 900, 120
#: Chunk kinds in the order in which their chunks follow one another.
KINDS = ["service", "concept", "table", "notice", "image_caption"]

_HEADING = re.compile(r"^(#{1,5})\s+(.*?)\s*#*\s*$")


def sections(text: str) -> list[tuple[list[str | None], str]]:
    """(headings of levels 1 to 5, text with its heading line) of a Markdown text; fenced code holds no headings."""
    out: list[tuple[list[str | None], str]] = []
    state: list[str | None] = [None] * 5
    lines: list[str] = []
    fence = ""
    for line in text.split("\n"):
        mark = line.strip()[:3]
        if fence:
            fence = "" if mark == fence else fence
        elif mark in ("```", "~~~"):
            fence = mark
        found = None if fence else _HEADING.match(line)
        if found:
            if "\n".join(lines).strip():
                out.append((list(state), "\n".join(lines).strip()))
            level = len(found[1])
            state = [*state[: level - 1], found[2], *[None] * (5 - level)]
            lines = []
        lines.append(line)
    if "\n".join(lines).strip():
        out.append((list(state), "\n".join(lines).strip()))
    return out


def _cut(text: str, separator: str) -> list[str]:
    """text cut before each separator, which stays at the head of what follows."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in [first, *(separator + r for r in rest)] if p]


def _merged(parts: list[str], size: int, overlap: int, length) -> list[str]:
    """Parts in a row joined up to size; each text begins with up to `overlap` of the one before."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for part in parts:
        n = length(part)
        if held and total + n > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + n > size):
                total -= length(held.pop(0))
        held.append(part)
        total += n
    out.append("".join(held).strip())
    return [t for t in out if t]


def split_text(text: str, size: int, overlap: int, separators: list[str], length=len) -> list[str]:
    """Recursive split: cut at the first separator that occurs, split what is still too long at the later ones, join greedily."""
    separator, later = separators[-1], []
    for i, s in enumerate(separators):
        if not s or s in text:
            separator, later = s, separators[i + 1 :]
            break
    out: list[str] = []
    small: list[str] = []
    for part in _cut(text, separator):
        if length(part) < size:
            small.append(part)
            continue
        if small:
            out += _merged(small, size, overlap, length)
            small = []
        out += split_text(part, size, overlap, later, length) if later else [part.strip()]
    if small:
        out += _merged(small, size, overlap, length)
    return [t for t in out if t]


def _is_row(line: str) -> bool:
    line = line.strip()
    return len(line) > 1 and line[0] == line[-1] == "|"


def _is_rule(line: str) -> bool:
    """Whether a line is the one between a table's header and its rows: cells of dashes and colons."""
    return _is_row(line) and all(cell and not cell.strip("-:") for cell in map(str.strip, line.strip()[1:-1].split("|")))


def table_head(text: str) -> str | None:
    """Header and rule of the first Markdown table of a text."""
    lines = text.split("\n")
    for above, below in zip(lines, lines[1:]):
        if _is_row(above) and _is_rule(below):
            return f"{above.strip()}\n{below.strip()}"
    return None


def with_table_heads(parent: str, children: list[str]) -> list[str]:
    """Children that hold rows of a table but no rule begin with the head of the parent's first table."""
    head = table_head(parent)

    def headless(child: str) -> bool:
        lines = child.split("\n")
        return any(map(_is_row, lines)) and not any(map(_is_rule, lines))

    return [f"{head}\n{c}" if head and headless(c) else c for c in children]


def split_rows(rows: DataFrame, text: str, size: int, overlap: int, separators: list[str], by_words: bool = False) -> DataFrame:
    """rows once for each part of their text, which takes the text's place, with part (from 1) and parts, their number; by_words measures in runs of non-blanks.

    A row's other columns go with each part, so no join brings them together again. A text without parts drops its row.
    """
    length = (lambda s: len(s.split())) if by_words else len
    names, at = rows.columns, rows.columns.index(text)

    def run(batches):
        for b in batches:
            found = [split_text(t, size, overlap, separators, length) if t else [] for t in b.column(at).to_pylist()]
            place = pa.array([i for i, parts in enumerate(found) for _ in parts], pa.int64())
            columns = [pa.array([p for parts in found for p in parts], pa.string()) if i == at else c.take(place) for i, c in enumerate(b.columns)]
            numbers = [n for parts in found for n in range(1, len(parts) + 1)]
            counts = [len(parts) for parts in found for _ in parts]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int32()), pa.array(counts, pa.int32())], [*names, "part", "parts"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    small_batches(rows.sparkSession)
    return rows.mapInArrow(tidy(run), f"{schema}, part int, parts int")


def parent_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, size: int = PARENT_SIZE, overlap: int = PARENT_OVERLAP) -> DataFrame:
    """(source, ordinal, doc_id, category, service_name, header_path, chunk_type, text_content): the parents of each document.

    Sections of up to `threshold` characters are parents whole. doc_id comes from source and
    ordinal, so that a rebuild gives the same ids.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = 0
                for heads, body in sections(t or ""):
                    for part in [body] if len(body) <= threshold else split_text(body, size, overlap, PARENT_SEPARATORS):
                        if part.strip():
                            n += 1
                            rows.append((k, n, *heads, part.strip()))
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [b.schema.field(0).type, pa.int32(), *[pa.string()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds)], names)

    names = ["source", "ordinal", "h1", "h2", "h3", "h4", "h5", "text_content"]
    cleaned = docs.select(key, clean_markdown(F.col(text)).alias("text"))
    small_batches(docs.sparkSession)
    found = cleaned.mapInArrow(tidy(run), f"source {kind}, ordinal int, h1 string, h2 string, h3 string, h4 string, h5 string, text_content string")
    category, service, path = header_metadata(*(F.col(f"h{i}") for i in range(1, 6)))
    id_ = F.sha2(F.concat_ws("|", F.lit("parent"), "source", "ordinal"), 256)
    return found.select("source", "ordinal", id_.alias("doc_id"), category.alias("category"), service.alias("service_name"), path.alias("header_path"), F.lit("parent").alias("chunk_type"), "text_content")


def child_chunks(parents: DataFrame, size: int = CHILD_SIZE, overlap: int = CHILD_OVERLAP) -> DataFrame:
    """(doc_id, parent_id, ordinal, category, service_name, header_path, chunk_type, text_content): each parent's children, with their place in the document before the text."""

    def run(batches):
        for b in batches:
            rows = []
            for parent, *rest, text in zip(*(c.to_pylist() for c in b.columns)):
                for n, child in enumerate(with_table_heads(text, split_text(text, size, overlap, CHILD_SEPARATORS)), start=1):
                    if child.strip():
                        id_ = hashlib.sha256(f"child|{parent}|{n}".encode()).hexdigest()
                        rows.append((id_, parent, n, *rest, child.strip()))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds)], ["doc_id", "parent_id", "ordinal", "category", "service_name", "header_path", "text"])

    found = parents.select("doc_id", "category", "service_name", "header_path", "text_content")
    small_batches(parents.sparkSession)
    found = found.mapInArrow(tidy(run), "doc_id string, parent_id string, ordinal int, category string, service_name string, header_path string, text string")
    text = F.concat(F.lit("[Context: "), "header_path", F.lit("]\n\n"), "text")
    return found.select("doc_id", "parent_id", "ordinal", "category", "service_name", "header_path", F.lit("child").alias("chunk_type"), text.alias("text_content"))


#: A chunk is known by its document and its id; ids repeat across documents. Inputs without a column `document` are of one document, which is null.
CHUNK_COLUMNS = ["document", "id", "text", "chunk_type", "category", "service_name", "concept_group", "page_start", "page_end", "source_urls"]


def _chunk(rows: DataFrame, id_: Column, text: Column, kind: str, category: Column | None = None, service: Column | None = None, group: Column | None = None, urls: Column | None = None) -> DataFrame:
    category, service, group = (F.lit(None).cast("string") if c is None else c for c in (category, service, group))
    urls = F.coalesce(F.col("source_urls"), F.array().cast("array<string>")) if urls is None else urls
    document = F.col("document").cast("string") if "document" in rows.columns else F.lit(None).cast("string")
    return rows.select(document.alias("document"), id_.alias("id"), text.alias("text"), F.lit(kind).alias("chunk_type"), category.alias("category"), service.alias("service_name"), group.alias("concept_group"), F.col("page_start").cast("int").alias("page_start"), F.col("page_end").cast("int").alias("page_end"), urls.alias("source_urls"))


def _entry_text() -> Column:
    return F.btrim(F.concat_ws("\n\n", "name", F.nullif("description", F.lit(""))))


def service_chunks(services: DataFrame, max_tokens: int = 400) -> DataFrame:
    """A chunk for each service (category, name, description, page_start, page_end, source_urls), in parts where it has more than max_tokens words."""
    base = F.concat(F.lit("service:"), slug(F.col("category")), F.lit(":"), slug(F.col("name")))
    keep = [c for c in ("document", "category", "name", "page_start", "page_end", "source_urls") if c in services.columns]
    rows = services.select(*keep, base.alias("base"), _entry_text().alias("whole"))
    long = F.regexp_count("whole", F.lit(r"\S+")) > max_tokens
    several = split_rows(rows.filter(long), "whole", max_tokens, 0, PARENT_SEPARATORS, by_words=True).withColumn("base", F.concat("base", F.lit(":part-"), "part"))
    both = rows.filter(~long).unionByName(several.drop("part", "parts"))
    return _chunk(both, F.col("base"), F.col("whole"), "service", F.col("category"), F.col("name"))


def concept_chunks(concepts: DataFrame) -> DataFrame:
    id_ = F.concat(F.lit("concept:"), slug(F.col("concept_group")), F.lit(":"), slug(F.col("name")))
    return _chunk(concepts, id_, _entry_text(), "concept", group=F.col("concept_group"))


def table_chunks(tables: DataFrame, max_tokens: int = 400) -> DataFrame:
    """Chunks of the comparison tables (title `Compare AWS .. services`), cut between rows."""
    chosen = tables.filter(F.btrim("title").rlike(r"^Compare AWS .+ services$"))
    rows = T.table_parts(chosen, max_tokens)
    id_ = F.concat(F.lit("table:"), slug(F.col("title")), F.lit(":p"), F.col("page_start"), F.when(F.col("parts") > 1, F.concat(F.lit(":part-"), "part")).otherwise(""))
    return _chunk(rows, id_, F.col("text"), "table", urls=F.array().cast("array<string>"))


def notice_context(notices: DataFrame, services: DataFrame, document: str = "document") -> DataFrame:
    """notices (document, notice_id, text, page_start) with category, service_name and source_urls of the one service of the document that spans the page and whose name is in the text; nulls and [] where none or several do.

    Names meet the pieces of a notice's text that are as long as some name by equality, so no notice is held against every service of its page. The services are spread
    over their pages, as a service spans few; those of one page and name are one row with their number.
    """
    name = F.lower("name")
    spanned = services.filter("page_start <= page_end AND name IS NOT NULL").select(F.col(document).alias("s_document"), F.explode(F.sequence("page_start", "page_end")).alias("s_page"), name.alias("s_key"), F.struct("category", F.col("name").alias("service_name"), "source_urls").alias("s"))
    names = spanned.groupBy("s_document", "s_page", "s_key").agg(F.count("*").alias("n"), F.first("s").alias("s"))
    # One row: as many lengths as names differ in.
    lengths = services.agg(F.collect_set(F.length(name)).alias("lengths"))
    text = notices.select(document, "notice_id", "page_start", F.lower("text").alias("text")).filter("text IS NOT NULL")
    # A small file gives one task; a notice has many pieces, so the notices are dealt out first.
    text = text.repartition("notice_id").crossJoin(F.broadcast(lengths))
    fitting = F.filter("lengths", lambda n: n <= F.length("text"))
    pieces = F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(0), F.length("text") - n), lambda i: F.substring(F.col("text"), i + 1, n))))
    keys = text.select(document, "notice_id", "page_start", F.explode(F.array_distinct(pieces)).alias("key"))
    met = keys.join(names, (F.col(document) == F.col("s_document")) & (F.col("page_start") == F.col("s_page")) & (F.col("key") == F.col("s_key")))
    one = met.groupBy(document, "notice_id").agg(F.sum("n").alias("n"), F.first("s").alias("s")).filter("n = 1").select(document, "notice_id", "s.*")
    return notices.join(one, [document, "notice_id"], "left").withColumn("source_urls", F.coalesce("source_urls", F.array().cast("array<string>")))


def notices(tables: DataFrame, skipped: DataFrame, document: str = "document") -> DataFrame:
    """(document, notice_id, text, page_start, page_end) of unrecognised tables without a title, outside the document's skipped page ranges, that have text."""
    cells = F.flatten("rows")
    text = F.array_join(F.filter(F.transform(cells, lambda c: F.btrim(F.regexp_replace(c, r"\s+", " "))), lambda c: c != ""), "\n\n")
    plain = tables.filter((F.col("shape") == "unrecognized_table") & F.col("title").rlike(r"^[ |\t\n]*$"))
    ranges = skipped.select(F.col(document).alias("k_document"), F.col("page_start").alias("k_start"), F.col("page_end").alias("k_end"))
    kept = plain.join(ranges, (F.col(document) == F.col("k_document")) & F.col("page_start").between(F.col("k_start"), F.col("k_end")), "left_anti")
    return kept.select(document, F.col("table_id").alias("notice_id"), text.alias("text"), "page_start", "page_end").filter("text <> ''")


def notice_chunks(tables: DataFrame, skipped: DataFrame, services: DataFrame) -> DataFrame:
    rows = notice_context(notices(tables, skipped), services)
    return _chunk(rows, F.concat(F.lit("notice:p"), "page_start"), F.col("text"), "notice", F.col("category"), F.col("service_name"))


def caption_chunks(categories: DataFrame) -> DataFrame:
    """A chunk for each image caption (name, image_captions of page, image_path, caption) of a category."""
    own = [c for c in ("document", "name") if c in categories.columns]
    rows = categories.select(*own, F.posexplode("image_captions").alias("n", "c")).select(*own, "n", "c.*")
    rows = rows.withColumn("page_start", F.col("page")).withColumn("page_end", F.col("page"))
    id_ = F.concat(F.lit("image-caption:"), slug(F.col("name")), F.lit(":p"), "page", F.lit(":part-"), F.col("n") + 1)
    return _chunk(rows, id_, F.btrim("caption"), "image_caption", F.col("name"), urls=F.array().cast("array<string>"))


def together(*kinds: DataFrame) -> DataFrame:
    """Chunks of all kinds with kind_no, their kind's place."""
    out = kinds[0].select(*CHUNK_COLUMNS)
    for k in kinds[1:]:
        out = out.unionByName(k.select(*CHUNK_COLUMNS))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("chunk_type")) - 1
    return out.withColumn("kind_no", order)


def children_of(chunks: DataFrame, size: int = CHILD_SIZE, overlap: int = CHILD_OVERLAP) -> DataFrame:
    """Catalog chunks cut into children: a single one keeps its parent's id, several get `:c<n>`; all else is inherited."""
    rows = split_rows(chunks.withColumn("parent_id", F.col("id")), "text", size, overlap, PARENT_SEPARATORS)
    return rows.withColumn("id", F.when(F.col("parts") == 1, F.col("id")).otherwise(F.concat("id", F.lit(":c"), "part"))).drop("part", "parts")


def verified(chunks: DataFrame) -> DataFrame:
    """(check, n): chunks, chunks of each kind, ids that are not unique in their document, empty texts, page ranges that run backwards."""
    known = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("document", "id") if c in chunks.columns))
    kinds = chunks.groupBy("chunk_type").agg(F.count("*").alias("n")).select(F.concat(F.lit("kind:"), "chunk_type").alias("check"), "n")
    whole = chunks.agg(
        F.count("*").alias("chunks"), (F.count("*") - F.countDistinct(known)).alias("repeated_ids"),
        F.count_if(F.btrim("text") == "").alias("empty_texts"), F.count_if(F.col("page_start") > F.col("page_end")).alias("backward_pages"))
    names = ["chunks", "repeated_ids", "empty_texts", "backward_pages"]
    rows = whole.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("n")) for n in names))).alias("r")).select("r.*")
    return kinds.unionByName(rows)


def uncovered(categories: DataFrame, chunks: DataFrame) -> DataFrame:
    """(category): names of categories that no chunk has."""
    return categories.select(F.col("name").alias("category")).distinct().join(chunks.select("category").distinct(), "category", "left_anti")


def as_documents(chunks: DataFrame) -> DataFrame:
    """(id, page_content, metadata) of chunks: null names are empty, pages whole numbers, links a JSON list."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("chunk_type", "category", "service_name", "concept_group")}
    pages = {c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("page_start", "page_end")}
    urls = F.to_json(F.coalesce("source_urls", F.array().cast("array<string>")))
    metadata = F.struct(F.col("id"), *(v.alias(k) for k, v in (text | pages).items()), urls.alias("source_urls"))
    return chunks.select("id", F.coalesce("text", F.lit("")).alias("page_content"), metadata.alias("metadata"))


def parsing_report(services: DataFrame, document: str = "document") -> DataFrame:
    """(document, categories, services, concepts, without_links, without_description) of parsed records (category, record_type, description, source_urls)."""
    return services.groupBy(document).agg(
        F.countDistinct(F.when(F.col("record_type") == "service", F.col("category"))).alias("categories"),
        F.count_if(F.col("record_type") == "service").alias("services"), F.count_if(F.col("record_type") == "concept").alias("concepts"),
        F.count_if(F.coalesce(F.size("source_urls"), F.lit(0)) <= 0).alias("without_links"), F.count_if(F.coalesce(F.btrim("description"), F.lit("")) == "").alias("without_description"))


def require_unique(chunks: DataFrame, key: str = "id") -> DataFrame:
    """chunks, or a ValueError that names some ids that occur more than once in a document."""
    by = [c for c in ("document", key) if c in chunks.columns]
    again = [r[key] for r in chunks.groupBy(*by).count().filter("count > 1").orderBy(key).limit(5).collect()]
    if again:
        raise ValueError(f"ids are not unique: {again}")
    return chunks
