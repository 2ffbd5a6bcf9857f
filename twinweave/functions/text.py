"""Label, URI, JSON and number functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinweave.config import DEFAULT_RELATION, RAW_NAMESPACE


def strip(c: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_for_uri(c: Column) -> Column:
    """Spaces become underscores; all but ASCII letters, digits, _, ' and - goes."""
    return F.regexp_replace(F.replace(c, F.lit(" "), F.lit("_")), r"[^a-zA-Z0-9_'\-]", "")


def relation_uri(c: Column, namespace: str = RAW_NAMESPACE) -> Column:
    """The raw-namespace URI of a relation; a blank one is related_to."""
    return F.concat(F.lit(namespace), F.coalesce(F.nullif(clean_for_uri(c), F.lit("")), F.lit(DEFAULT_RELATION)))


def clean_relation_label(c: Column) -> Column:
    """Lower-case snake form of a relation; a blank one is related_to."""
    snake = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(snake, "^_|_$", ""), F.lit("")), F.lit(DEFAULT_RELATION))


def local_name(uri: Column) -> Column:
    """Label of a URI: after the last # and then the last /, underscores as spaces."""
    return F.replace(F.regexp_replace(F.regexp_replace(uri, "(?s)^.*#", ""), "(?s)^.*/", ""), F.lit("_"), F.lit(" "))


def stripped_local_name(uri: Column) -> Column:
    """local_name without white space at both ends."""
    return strip(local_name(uri))


def path_name(uri: Column) -> Column:
    """Label after the last / only; a fragment stays."""
    return F.replace(F.regexp_replace(uri, "(?s)^.*/", ""), F.lit("_"), F.lit(" "))


def fragment_or_tail(uri: Column) -> Column:
    """After the last # if there is one, else after the last /; underscores stay."""
    return F.when(uri.contains("#"), F.regexp_replace(uri, "(?s)^.*#", "")).otherwise(F.regexp_replace(uri, "(?s)^.*/", ""))


def tail_then_fragment(uri: Column) -> Column:
    """After the last /, then after the last #; underscores stay."""
    return F.regexp_replace(F.regexp_replace(uri, "(?s)^.*/", ""), "(?s)^.*#", "")


def normalize_label(c: Column) -> Column:
    """Lower case, all white space collapsed to single spaces."""
    return F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " ")))


def strip_lower(c: Column) -> Column:
    """Stripped lower case, inner white space kept; null becomes empty."""
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def relation_key(c: Column) -> Column:
    """Stripped lower case with underscores for spaces."""
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))


def sanitize_filename(c: Column, fallback: str = "document") -> Column:
    """A safe file name: white space and other characters become underscores."""
    safe = F.regexp_replace(F.regexp_replace(strip(c), r"(?U)\s+", "_"), "[^A-Za-z0-9._-]", "_")
    return F.coalesce(F.nullif(F.regexp_replace(safe, "^[._]+|[._]+$", ""), F.lit("")), F.lit(fallback))


def sanitize_name(c: Column, fallback: str = "graph") -> Column:
    """A safe graph name; letters and digits of any script stay."""
    return F.coalesce(F.nullif(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_"), F.lit("")), F.lit(fallback))


def url_tail(c: Column) -> Column:
    """The identifier after the last /abs/, else the last path segment."""
    return F.when(c.contains("/abs/"), F.regexp_replace(c, "(?s)^.*/abs/", "")).otherwise(F.regexp_replace(c, "(?s)^.*/", ""))


def extract_json(c: Column) -> Column:
    """The JSON object in a model's answer: bare, fenced, or from the first { to the last }."""
    bare = strip(c)
    fenced = strip(F.regexp_extract(c, r"(?s)```(?:json)?(.*?)```", 1))
    loose = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.coalesce(F.when(bare.startswith("{") & bare.endswith("}"), bare), F.nullif(fenced, F.lit("")), F.nullif(loose, F.lit("")))


def error_details(body: Column) -> Column:
    """(code, message) of a service's error body: of its error object, else of itself, else the body as message; null has neither."""
    kind = "code string, message string"
    inner, outer = F.from_json(F.get_json_object(body, "$.error"), kind), F.from_json(body, kind)
    is_object = F.coalesce(strip(F.get_json_object(body, "$")).startswith("{"), F.lit(False))
    has_inner = F.coalesce(strip(F.get_json_object(body, "$.error")).startswith("{"), F.lit(False))
    plain = F.struct(F.lit(None).cast("string").alias("code"), body.alias("message"))
    return F.when(has_inner, inner).when(is_object, outer).otherwise(plain)


def fold_lines(c: Column) -> Column:
    """Line feeds as spaces."""
    return F.replace(c, F.lit("\n"), F.lit(" "))


def safe_float(c: Column) -> Column:
    """A double, or null where the text is none."""
    return c.try_cast("double")


def preview(c: Column, width: int = 80) -> Column:
    """White space collapsed, cut to width with three dots; blank documents are named so."""
    flat = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.when(flat == "", "<empty document>").when(F.length(flat) > width, F.concat(F.left(flat, F.lit(width)), F.lit("..."))).otherwise(flat)


def node_text(label: Column, description: Column) -> Column:
    """label, or ``label. description``."""
    return F.concat_ws(". ", label, F.nullif(description, F.lit("")))


def pair_label(left: Column, right: Column) -> Column:
    return F.concat_ws(" ↔ ", left, right)


def display_number(c: Column) -> Column:
    """Three decimals; a dash for null."""
    return F.when(c.isNull(), "-").otherwise(F.format_string("%.3f", c))


def prompt(template: str, text: Column, source_id: Column, index: Column, total: Column) -> Column:
    """A chunk's prompt: its header, and the template with {text} filled in."""
    head = F.concat(F.lit("Source: "), source_id, F.lit(" (chunk "), index.cast("string"), F.lit("/"), total.cast("string"), F.lit(")\n"))
    return F.concat(head, F.replace(F.lit(template), F.lit("{text}"), text))
