"""Texts and maps of log lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspark.functions.patterns import extracted, found, globbed, replaced

def empty_map() -> Column:
    return F.from_json(F.lit("{}"), "map<string,string>")


def one_line(c: Column, n: int) -> Column:
    """Line ends as spaces, the first n characters."""
    return F.substring(F.translate(c, "\n\r", "  "), 1, n)


def decode_lenient(c: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(c.cast("string"))


def clean_truncated(c: Column) -> Column:
    """Takes half a character away before a `... (N more bytes)` mark. c: binary."""
    return F.regexp_replace(decode_lenient(c), "�+(?=\\.\\.\\. \\(\\d+ more bytes\\))", "")


_TOKEN = re.compile(r"\$(?:\{([^}]+)\}|([A-Za-z_][A-Za-z0-9_]*))")


def substitute(template: str, values: Column) -> Column:
    """A template's ${name} and $name from a map; names that the map lacks stay as they are."""
    parts, at = [], 0
    for m in _TOKEN.finditer(template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(F.try_element_at(values, F.lit(m[1] or m[2])), F.lit(m[0]))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def substitute_column(template: Column, values: Column) -> Column:
    """The same with a template for each row (${name} only)."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("${"), e["key"], F.lit("}")), e["value"]))


def sorted_fields(values: Column) -> Column:
    """` k=json` of all entries, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(F.lit(" "), e["key"], F.lit("="), json_text(e["value"]))), "")


def json_text(c: Column) -> Column:
    """A text as a JSON string."""
    quoted = F.to_json(F.struct(c.alias("v")))
    return F.coalesce(F.substring(quoted, F.lit(6), F.length(quoted) - 6), F.lit("null"))


def format_details(message: Column, fields: Column, raw: bool = False, detect_escaped: bool = False) -> Column:
    """`details <json>` and the fields sorted by key; raw: the message as it is; detect_escaped: values in quotes stay."""
    head = message if raw else F.concat(F.lit("details "), json_text(message))
    if not detect_escaped:
        return F.concat(head, sorted_fields(fields))
    value = lambda e: F.when(e["value"].rlike(r'(?s)^".*"$'), e["value"]).otherwise(json_text(e["value"]))
    return F.concat(head, F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(F.lit(" "), e["key"], F.lit("="), value(e))), ""))


def merge_attrs(base: Column, own: Column, overwrite: bool = True) -> Column:
    """Both maps' entries; a key in both has its own value, or the base's if overwrite is False. Null maps are empty."""
    base, own = F.coalesce(base, empty_map()), F.coalesce(own, empty_map())
    first, second = (base, own) if overwrite else (own, base)
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def diff_attrs(own: Column, parent: Column) -> Column:
    """The entries that the parent lacks or has otherwise."""
    return F.map_filter(F.coalesce(own, empty_map()), lambda k, v: ~F.try_element_at(F.coalesce(parent, empty_map()), k).eqNullSafe(v))


def pick_fields(values: Column, names: dict[str, str], fixed: dict[str, str] | None = None) -> Column:
    """The mapped keys of a map under their new names, and fixed entries."""
    pairs = F.array(*(F.struct(F.lit(new).alias("key"), F.try_element_at(values, F.lit(old)).alias("value")) for old, new in names.items()))
    picked = F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))
    return merge_attrs(F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv]), picked) if fixed else picked


def label_filter(labels: Column, include: list[str], exclude: list[str], prefix: str = "") -> Column:
    """The labels whose keys pass the globs, with a prefix."""
    kept = F.map_filter(F.coalesce(labels, empty_map()), lambda k, _: globbed(k, include, exclude))
    return F.transform_keys(kept, lambda k, _: F.concat(F.lit(prefix), k)) if prefix else kept


def labels_csv(labels: Column, include: list[str] = ("*",), exclude: list[str] = ()) -> Column:
    """k=v,k=v of the labels that pass, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(label_filter(labels, include, exclude))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def row_digest(*columns: Column) -> Column:
    """An MD5 of columns, maps by sorted keys: tells whether a row changed."""
    return F.md5(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))), {"ignoreNullFields": "false"}).cast("binary"))


def sorted_map(c: Column) -> Column:
    """A map as its sorted entries, which can be compared and grouped on."""
    return F.array_sort(F.map_entries(F.coalesce(c, empty_map())))


def summarise_output(c: Column, extract: str | None = None, all_lines: bool = False, max_chars: int = 200) -> Column:
    """struct(output, output_chars): group 1 of a pattern that is found, else the first line (or all), cut to max_chars and three points."""
    plain = c if all_lines else F.substring_index(F.ltrim(c), "\n", 1)
    text = F.trim(plain)
    if extract:
        text = F.when(found(c, extract), extracted(c, extract)).otherwise(text)
    cut = F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit("..."))).otherwise(text)
    return F.struct(cut.alias("output"), F.length(text).cast("long").alias("output_chars"))


def rename_log(df, template: str | None = None, match: str | None = None, replacement: str = "", path: str = "log_path"):
    """Adds logfile, and original_file where the name changed: by a template of PATH1.., BASENAME, BASENAME_NO_EXT, or by a pattern. A template with an unknown name changes nothing."""
    c = F.col(path)
    if template is not None:
        parts = F.filter(F.split(c, "/"), lambda p: p != "")
        base = F.element_at(parts, -1)
        made, at = [], 0
        for m in _TOKEN.finditer(template):
            name = m[1] or m[2]
            value = base if name == "BASENAME" else F.regexp_replace(base, r"\.[^.]*$", "") if name == "BASENAME_NO_EXT" else F.get(parts, F.lit(int(name[4:]) - 1)) if re.fullmatch(r"PATH\d+", name) else F.lit(None).cast("string")
            made += [F.lit(template[at : m.start()]), value]
            at = m.end()
        new = F.concat(*made, F.lit(template[at:]))
    else:
        new = replaced(c, match, replacement)
    df = df.withColumn("logfile", F.coalesce(new, c))
    return df.withColumn("original_file", F.when(F.col("logfile") != c, c))
