"""Scalar text functions as column expressions."""

from __future__ import annotations

import ast
import json
import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Running titles of the source document, dropped wherever a line is just one of them.
PAGE_TITLES = ["Overview of Amazon Web Services", "AWS Whitepaper", "Overview of Amazon Web Services AWS Whitepaper"]
MARKDOWN_TITLES = [*PAGE_TITLES, "Overview of Amazon Web Services  AWS Whitepaper"]
# Image kinds.
MIME_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}
# What UTF-8 read as cp1252 leaves behind.
MOJIBAKE = ["â€", "Ã", "Â", "ï¬"]

#: A word: letters, digits and underscore of any script; the frequent ones first, as that is where a search looks first.
TOKEN = r"([a-z0-9_\p{L}\p{N}]+)"


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def collapsed(c: Column) -> Column:
    """Lower case, with every run of white space one blank and none at the ends."""
    return F.lower(F.btrim(F.regexp_replace(c, r"\s+", " ")))


def clean_cell(c: Column) -> Column:
    """A table cell as one Markdown line."""
    return F.replace(F.regexp_replace(stripped(c), r"\s*\n\s*", "<br>"), F.lit("|"), F.lit("\\|"))


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def clean_header(c: Column) -> Column:
    """A heading without underline tags and emphasis marks; null gives the empty string."""
    return F.coalesce(stripped(F.regexp_replace(F.regexp_replace(c, "</?u>", ""), r"[*_]{1,3}", "")), F.lit(""))


def approx_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def mime_type(extension: Column) -> Column:
    out = F.lit("image/png")
    for ext, kind in MIME_TYPES.items():
        out = F.when(F.lower(extension) == ext, kind).otherwise(out)
    return out


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(1))


def without_running_lines(c: Column, titles: list[str] = PAGE_TITLES) -> Column:
    """The text without title, copyright and page-number lines."""

    def stays(line: Column) -> Column:
        s = stripped(line)
        notice = s.rlike(r"(?i)Copyright\s+©\s+\d{4}.*Amazon Web Services") | s.startswith("Copyright ©") | s.startswith("©")
        return ~(s.isin(titles) | notice | s.rlike(r"^\d+$"))

    # Each such line holds a title or the sign, or begins with a digit: a line or a text without these is not looked at closer.
    telling = lambda x: reduce(or_, (x.contains(t) for t in [*titles, "©"]))
    suspect = lambda line: telling(line) | line.rlike(r"^\s*\d")
    kept = F.array_join(F.filter(F.split(c, "\n"), lambda line: ~suspect(line) | stays(line)), "\n")
    return F.when(telling(c) | c.rlike(r"(?:^|\n)[ \t\x0B\f\r]*\d"), kept).otherwise(c)


def clean_page(c: Column) -> Column:
    return without_running_lines(c)


def clean_markdown(c: Column) -> Column:
    # A text without a mark's letters goes by without a search for the mark.
    plain = F.when(c.contains("u>"), F.regexp_replace(c, "</?u>", "")).otherwise(c)
    plain = F.when(plain.contains("<!--"), F.regexp_replace(plain, r"<!--\s*PAGE_\d+\s*-->", "")).otherwise(plain)
    return without_running_lines(plain, MARKDOWN_TITLES)


def header_metadata(h1: Column, h2: Column, h3: Column, h4: Column, h5: Column) -> tuple[Column, Column, Column]:
    """(category, service_name, header_path) of a section from its headings."""
    h1, h2, h3, h4, h5 = (F.nullif(clean_header(h), F.lit("")) for h in (h1, h2, h3, h4, h5))
    category = F.coalesce(h3, h2, F.lit("General"))
    service = F.when(h4.isNotNull(), F.concat_ws(" > ", h4, h5)).otherwise(F.coalesce(h5, category))
    path = F.concat_ws(" > ", F.when(category != "General", category), F.when(service != category, service))
    return category, service, F.coalesce(F.nullif(path, F.lit("")), h2, h1, F.lit("General"))


def repaired(text: str | None) -> str | None:
    """Mojibake undone where it can be, then compatibility characters folded (NFKC)."""
    if text is None:
        return None
    if any(m in text for m in MOJIBAKE):
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    return unicodedata.normalize("NFKC", text)


def nfkc(c: str | Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return F.pandas_udf(run, "string")(c)


def repair(c: str | Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(repaired, na_action="ignore")

    return F.pandas_udf(run, "string")(c)


def plain_text(reply: object) -> str:
    """The text alone of a reply: a string itself, of a list its parts', of a block what stands under `text`; all else is left out."""
    if isinstance(reply, str):
        return reply
    if isinstance(reply, (list, tuple)):
        return "".join(map(plain_text, reply))
    if isinstance(reply, dict):
        return plain_text(reply.get("text", ""))
    return ""


def nested_text(c: str | Column) -> Column:
    """plain_text of replies kept as JSON or as Python literals, however deep; other strings stay as they are."""

    def one(value: str) -> str:
        if value.lstrip()[:1] in ("[", "{"):
            for read in (json.loads, ast.literal_eval):
                try:
                    return plain_text(read(value)).strip()
                except (ValueError, SyntaxError, MemoryError, RecursionError):
                    pass
        return value.strip()

    def run(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return F.pandas_udf(run, "string")(c)


def response_text(c: Column) -> Column:
    """The plain text of a model's reply: itself, or the text of a JSON list of strings and blocks."""
    blocks = F.from_json(c, "array<string>")
    text = F.transform(blocks, lambda b: F.when(b.startswith("{"), F.coalesce(F.get_json_object(b, "$.text"), F.lit(""))).otherwise(b))
    return stripped(F.when(c.startswith("[") & blocks.isNotNull(), F.array_join(text, "")).when(c.startswith("{"), F.coalesce(F.get_json_object(c, "$.text"), c)).otherwise(c))


def lowercase_runs(c: Column, least: int = 12) -> Column:
    """Words of at least `least` letters, all a to z: they may be several words run together."""
    return F.filter(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(1)), lambda w: w.rlike(rf"^[a-z]{{{least},}}$"))
