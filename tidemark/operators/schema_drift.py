"""Delimited files whose fields drift, read as one table, with a list of every change.

The lines of all files are one table; a file is never gathered. Each file's header is found by an aggregation and
joined back to its lines: broadcast if the files are counted to be few, else in pieces of PIECE lines, so that a giant
file is spread. A line stays one row of values until its fields are fused, per file and field and partially aggregated,
into a tagged union: for every field the set of alternatives (integer, decimal, text) that occur. Each cell keeps its
own branch of the union besides one canonical amount. Files are compared with the one before; a new and a gone name are
the same field if they hold the same amounts on the days found in both. Only these names' cells are compared, and all
else about changes is worked out on one row a file.

Defined cases: blank lines and lines that begin with # are no data; a file without any other line has no schema.
Repeated lines and days count once (the first line), a repeated header is no data. Missing values (empty, NA, null, -) have no alternative; a
field of missing values only has no kind and is never retyped. Short lines lack their last fields, further values of
long lines are dropped. A name that a header repeats counts once (the first). A quote that is never closed is a character
like others. Null lines and null file numbers are left out. Amounts written to few digits (12.3M, 1.234E+07) equal all
amounts that round to them. Empty tables give an empty table and no changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import BROADCAST_ROWS, cut, maybe_broadcast

#: What stands for a missing value.
MISSING = ("", "NA", "null", "-")
DELIMITERS = (",", ";", "|", "\t")
#: Factors of suffixes.
SUFFIXES = {"k": 1e3, "m": 1e6, "b": 1e9, "bn": 1e9, "mn": 1e6, "lakh": 1e5, "cr": 1e7}
PIECE = 20_000
KINDS = ("integer", "decimal", "text")
FILE = ["index_symbol", "file_no"]
LINE = [*FILE, "received_at", "line_no", "raw_line"]


def _split(line: Column, by: Column) -> Column:
    """Fields between delimiters that stand outside double quotes, quotes and blanks included; each character is looked
    at once."""
    out = F.array(line)
    for d in DELIMITERS:
        quoted = F.regexp_extract_all(F.concat(line, F.lit(d)), F.lit(f'((?:[^{d}"]++|"[^"]*+"|")*+)[{d}]'), F.lit(1))
        plain = F.split(line, "\\|" if d == "|" else d, -1)  # one plain character: split without a pattern
        out = F.when(by == d, F.when(F.contains(line, F.lit('"')), quoted).otherwise(plain)).otherwise(out)
    return out


def _unquoted(v: Column) -> Column:
    t = F.trim(v)
    inside = F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"')) & (F.length(t) >= 2)
    return F.when(inside, F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"'))).otherwise(t)


def _clean_name(v: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(F.regexp_replace(v, "﻿", "")), '^"+|"+$', "")))


def _headers(lines: DataFrame) -> DataFrame:
    """(index_symbol, file_no, received_at, header_no, header, delimiter, names, pieces, fields): one row a file."""
    at = F.struct("line_no", "raw_line")
    data = F.when((F.trim(F.regexp_replace("raw_line", "[\t\ufeff]", " ")) != "") & ~F.col("raw_line").rlike("^[\ufeff\\s]*#"), at)
    h = lines.select(*LINE).filter("raw_line is not null and file_no is not null").groupBy(*FILE).agg(F.min(data).alias("h"), F.max("line_no").alias("last"), F.max("received_at").alias("received_at")).filter("h is not null")
    line = F.col("h.raw_line")
    outside = F.regexp_replace(line, '"[^"]*"', "")
    counts = F.array(*[F.struct((F.length(outside) - F.length(F.replace(outside, F.lit(d), F.lit("")))).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    by = F.array_max(counts)["d"]
    x = h.select(*FILE, "received_at", F.col("h.line_no").alias("header_no"), line.alias("header"), by.alias("delimiter"), F.transform(_split(line, by), _clean_name).alias("names"), F.floor(F.col("last") / PIECE).alias("pieces"))
    return x.withColumn("fields", F.filter(F.array_distinct("names"), lambda n: ~n.isin("", "date")))


def schemas(lines: DataFrame) -> DataFrame:
    """(index_symbol, file_no, received_at, header_no, header, delimiter, names, pieces, fields, was, new, gone, next_pairs).

    One row a file: names by position, fields the distinct names of values; against the file before, `was` (its fields;
    null: there is none), `new` and `gone`; and whether the next file has both new and gone names (next_pairs).
    """
    heads = cut(_headers(lines))  # used three times
    key = lambda shift, *more: heads.select(F.col("index_symbol").alias("_i"), (F.col("file_no") + shift).alias("_f"), *more)
    same = lambda x, y: x.join(y, F.col("index_symbol").eqNullSafe(F.col("_i")) & (F.col("file_no") == F.col("_f")), "left").drop("_i", "_f")
    x = same(heads, key(1, F.col("fields").alias("was")))
    x = same(x, key(-1, F.col("fields").alias("_next")))
    both = (F.size(F.array_except("_next", "fields")) > 0) & (F.size(F.array_except("fields", "_next")) > 0)
    return x.withColumns({"new": F.array_except("fields", "was"), "gone": F.array_except("was", "fields"), "next_pairs": F.coalesce(both, F.lit(False))}).drop("_next")


def cells(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """(index_symbol, on_day, file_no, r): of each file and day the first line, its cells in one row: r holds names, new,
    gone, next_pairs and the values v by position, as written."""
    cols = ["header_no", "header", "delimiter", "names", "new", "gone", "next_pairs"]
    x = lines.select(*LINE).filter("raw_line is not null and file_no is not null and trim(raw_line) != '' and not startswith(ltrim(raw_line), '#')")
    h = heads.select(F.col("index_symbol").alias("_i"), F.col("file_no").alias("_f"), "pieces", *cols)
    on = F.col("index_symbol").eqNullSafe(F.col("_i")) & (F.col("file_no") == F.col("_f"))
    if heads.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        x = x.join(F.broadcast(h), on)
    else:
        h = h.withColumn("_p", F.explode(F.sequence(F.floor(F.col("header_no") / PIECE), "pieces")))
        x = x.join(h, on & (F.floor(F.col("line_no") / PIECE) == F.col("_p")))
    x = x.filter("line_no > header_no and raw_line != header")
    # the generator is a barrier: what uses the values would otherwise repeat the split
    x = x.withColumn("v", F.explode(F.array(_split(F.rtrim(F.col("raw_line"), F.lit("\r\n")), F.col("delimiter")))))
    day_at = F.array_position("names", F.lit("date"))
    x = x.withColumn("on_day", F.when(day_at > 0, _unquoted(F.get("v", (day_at - 1).cast("int"))))).filter("on_day is not null and on_day != ''")
    keep = F.struct("line_no", "names", "new", "gone", "next_pairs", "v")
    return x.groupBy("index_symbol", "on_day", "file_no").agg(F.min(keep).alias("r"))


def _present(written: Column) -> Column:
    """A value; null if it is missing."""
    x = _unquoted(written)
    return F.when(~x.isin(*MISSING), x)


def exploded(rows: DataFrame) -> DataFrame:
    """(index_symbol, on_day, file_no, name, value): a row per file, day and field; value null: missing."""
    x = rows.select("index_symbol", "on_day", "file_no", "r", F.posexplode("r.names").alias("pos", "name"))
    # a name that the header repeats counts where it comes first
    x = x.filter((F.col("name") != "date") & (F.col("name") != "") & (F.array_position("r.names", F.col("name")) == F.col("pos") + 1))
    return x.select("index_symbol", "on_day", "file_no", "name", _present(F.get("r.v", F.col("pos"))).alias("value"))


def kind_of(v: Column) -> Column:
    """The alternative of the union that a written value belongs to; null: missing."""
    return F.when(v.rlike("^-?[0-9]+[.]?[0-9]*$"), F.when(F.contains(v, F.lit(".")), "decimal").otherwise("integer")).when(v.isNotNull(), "text")


def amount_of(v: Column) -> Column:
    """struct(amount, slack): the number however written, and half a unit of its last digit where it was rounded."""
    t = F.lower(F.trim(v))
    negative = t.rlike(r"^\(.*\)$") | t.rlike("^(?:rs[.]? ?)?-")
    t = F.regexp_replace(t, r"^\(|\)$|,|%$|x$|^rs[.]? ?|^[$€£₹] ?|\s", "")
    t = F.regexp_replace(t, r"^[+-]|^rs[.]?", "")
    digits = F.regexp_extract(t, r"^([0-9]*[.]?[0-9]*)(?:e[+-]?[0-9]+)?([a-z]*)$", 1)
    power = F.coalesce(F.nullif(F.regexp_extract(t, r"^[0-9.]+e([+-]?[0-9]+)[a-z]*$", 1), F.lit("")).try_cast("int"), F.lit(0))
    suffix = F.regexp_extract(t, r"^[0-9.]+(?:e[+-]?[0-9]+)?([a-z]*)$", 1)
    factor = F.when(suffix == "", 1.0)
    for k, f in SUFFIXES.items():
        factor = factor.when(suffix == k, f)
    scale = factor * F.pow(F.lit(10.0), power)
    n = F.nullif(digits, F.lit("")).try_cast("double") * scale
    places = F.length(F.regexp_extract(digits, r"[.]([0-9]*)$", 1))
    slack = F.when((suffix != "") | (power != 0), 0.5001 * scale * F.pow(F.lit(10.0), -places)).otherwise(0.0)
    return F.when(n.isNotNull(), F.struct(F.when(negative, -n).otherwise(n).alias("amount"), slack.alias("slack")))


def fused(rows: DataFrame) -> DataFrame:
    """(index_symbol, file_no, kinds, pairs): one row a file.

    kinds: of each field the tagged union as (name, alternatives, kind); pairs: new and gone names that hold the same
    amounts on the days of both files, as (n, old, name) with the number of days. Only rows of files with new and gone
    names take part in these.
    """
    kind = kind_of(F.col("value"))
    has = [F.max(F.coalesce(kind == n, F.lit(False))).alias(n) for n in KINDS]
    u = exploded(rows).groupBy(*FILE, "name").agg(*has)
    union = F.struct("name", F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in KINDS])).alias("alternatives"), F.when(F.col("text"), "text").when(F.col("decimal"), "decimal").when(F.col("integer"), "integer").alias("kind"))
    prev = rows.filter("r.next_pairs").select(F.col("index_symbol").alias("_i"), F.col("on_day").alias("_d"), (F.col("file_no") + 1).alias("_f"), F.col("r.names").alias("was_names"), F.col("r.v").alias("was_v"))
    x = rows.filter((F.size("r.new") > 0) & (F.size("r.gone") > 0)).join(prev, F.col("index_symbol").eqNullSafe(F.col("_i")) & (F.col("on_day") == F.col("_d")) & (F.col("file_no") == F.col("_f")))
    x = x.select(*FILE, "r", "was_names", "was_v", F.explode("r.new").alias("name")).withColumn("old", F.explode("r.gone"))
    at = lambda names, v, n: _present(F.get(v, (F.array_position(names, F.col(n)) - 1).cast("int")))
    x = x.select(*FILE, "name", "old", at(F.col("r.names"), F.col("r.v"), "name").alias("a"), at(F.col("was_names"), F.col("was_v"), "old").alias("b"))
    x = x.withColumns({"x": amount_of(F.col("a")), "y": amount_of(F.col("b"))})
    near = F.abs(F.col("x.amount") - F.col("y.amount")) <= F.col("x.slack") + F.col("y.slack") + 1e-9 * F.abs(F.col("x.amount"))
    equal = F.when(F.col("a").isNull() | F.col("b").isNull(), F.col("a").isNull() & F.col("b").isNull()).when(F.col("x").isNull() | F.col("y").isNull(), F.col("a") == F.col("b")).otherwise(near)
    g = x.groupBy(*FILE, "name", "old").agg(F.min(equal).alias("all"), F.sum((equal & F.col("a").isNotNull()).cast("int")).alias("n")).filter("all and n > 0")
    same = F.struct(F.col("n").cast("int").alias("n"), "old", "name")
    both = u.select(*FILE, union.alias("u"), F.lit(None).cast("struct<n:int,old:string,name:string>").alias("p")).unionByName(g.select(*FILE, F.lit(None).cast("struct<name:string,alternatives:array<string>,kind:string>").alias("u"), same.alias("p")))
    # per file: bounded by its header
    return both.groupBy(*FILE).agg(F.collect_list("u").alias("kinds"), F.collect_list("p").alias("pairs"))


def _best(pairs: Column, tie: str) -> Column:
    """The pair of the most days, ties by name."""
    less = lambda a, b: F.when(a["n"] != b["n"], b["n"] - a["n"]).when(a[tie] < b[tie], -1).when(a[tie] > b[tie], 1).otherwise(0).cast("int")
    return F.get(F.array_sort(pairs, less), F.lit(0))


def changes(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """(index_symbol, file_no, field_name, drift, was_name, appearing): each file against the one before it.

    heads: schemas(), rows: cells().
    """
    f = cut(fused(rows))  # a row a file
    empty = F.array().cast(f.schema["kinds"].dataType)
    key = lambda shift, *more: f.select(F.col("index_symbol").alias("_i"), (F.col("file_no") + shift).alias("_f"), *more)
    same = lambda x, y: x.join(y, F.col("index_symbol").eqNullSafe(F.col("_i")) & (F.col("file_no") == F.col("_f")), "left").drop("_i", "_f")
    x = same(heads.filter("was is not null").select(*FILE, "fields", "new", "gone"), key(0, "kinds", "pairs"))
    x = same(x, key(1, F.col("kinds").alias("was_kinds")))
    # one old name for each new one and the other way round: most days first, then by name
    x = x.withColumn("pairs", F.array_compact(F.transform("new", lambda n: _best(F.filter("pairs", lambda p: p["name"] == n), "old"))))
    x = x.withColumn("pairs", F.filter("pairs", lambda p: _best(F.filter("pairs", lambda q: q["old"] == p["old"]), "name")["name"] == p["name"]))
    x = x.withColumns({"kinds": F.coalesce("kinds", empty), "was_kinds": F.coalesce("was_kinds", empty), "from": F.transform("pairs", lambda p: p["name"]), "to": F.transform("pairs", lambda p: p["old"])})
    prior = lambda n: F.coalesce(F.get(F.filter("pairs", lambda p: p["name"] == n), F.lit(0))["old"], n)
    kinds = lambda c, n: F.get(F.filter(c, lambda k: k["name"] == n), F.lit(0))
    was = F.lit(None).cast("string")
    item = lambda n, drift, old, seen: F.struct(n.alias("field_name"), F.lit(drift).alias("drift"), old.alias("was_name"), seen.alias("appearing"))
    nothing = F.array().cast("array<string>")
    seen = lambda n: F.array_except(kinds("kinds", n)["alternatives"], F.coalesce(kinds("was_kinds", prior(n))["alternatives"], nothing))
    renamed = F.transform("pairs", lambda p: item(p["name"], "renamed", p["old"], seen(p["name"])))
    added = F.transform(F.array_except("new", "from"), lambda n: item(n, "added", was, kinds("kinds", n)["alternatives"]))
    removed = F.transform(F.array_except("gone", "to"), lambda n: item(n, "removed", n, nothing))
    retyped = F.transform(F.filter("fields", lambda n: kinds("kinds", n)["kind"] != kinds("was_kinds", prior(n))["kind"]), lambda n: item(n, "retyped", prior(n), seen(n)))
    return x.select("index_symbol", F.col("file_no").cast("long").alias("file_no"), F.inline(F.concat(renamed, added, removed, retyped)))


def canonical_names(found: DataFrame) -> DataFrame:
    """(name, canonical): names linked by any rename, as the smallest of them.

    The distinct pairs of names are a table of the size of the vocabulary of headers: linked on the driver if they are
    counted to be few, else by label propagation.
    """
    e = found.filter("drift = 'renamed'").select(F.col("was_name").alias("a"), F.col("field_name").alias("b")).distinct()
    e = cut(e.union(e.select("b", "a")).distinct())
    few = e.limit(BROADCAST_ROWS + 1).collect()
    if len(few) <= BROADCAST_ROWS:
        label: dict[str, str] = {r.a: r.a for r in few}
        moved = True
        while moved:
            moved = False
            for r in few:
                if label[r.b] < label[r.a]:
                    label[r.a], moved = label[r.b], True
        return found.sparkSession.createDataFrame(sorted(label.items()), "name string, canonical string")
    lab = cut(e.select(F.col("a").alias("name")).distinct().withColumn("canonical", F.col("name")))
    while True:
        near = e.join(lab, e.b == lab.name).groupBy("a").agg(F.min("canonical").alias("m"))
        new = cut(lab.join(near, lab.name == near.a).select("name", F.least("canonical", "m").alias("canonical"), (F.col("m") < F.col("canonical")).alias("moved")))
        lab = new.select("name", "canonical")
        if not new.filter("moved").limit(1).count():
            return lab


def one_table(rows: DataFrame, found: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(index_symbol, on_day, file_no, fields): one row per index and day; file_no: the latest file that holds the day.

    fields maps each canonical name to its union: the branch as_integer, as_decimal or as_text holds the value in its
    own type, amount the canonical number. A field comes from the latest file that has a value for it on the day
    (from_file), so what a newer file lacks or holds as missing stays as the older one has it. A field missing in all
    files of the day has no branch. Names of one file that are one canonical field stay apart on its days, under their
    own names; so no row has a name twice. rows: cells().
    """
    names = canonical_names(found) if names is None else names
    v, k = F.col("value"), kind_of(F.col("value"))
    x = exploded(rows).join(maybe_broadcast(names), "name", "left").withColumn("canonical", F.coalesce("canonical", "name"))
    # per index, day and field the names in use, each with its latest value: one name, but for renames on the day
    keys = ["index_symbol", "on_day"]
    latest = F.max(F.struct(v.isNotNull().alias("has"), F.col("file_no").alias("from_file"), v)).alias("r")
    named = x.groupBy(*keys, "canonical", "name").agg(latest, F.collect_set("file_no").alias("files"), F.max("file_no").alias("file_no"))
    each = F.struct("r.has", "r.from_file", "name", "r.value")
    one = named.groupBy(*keys, "canonical").agg(F.collect_list(each).alias("each"), F.flatten(F.collect_list("files")).alias("files"), F.max("file_no").alias("file_no"))
    apart = F.size("files") > F.size(F.array_distinct("files"))
    cell = lambda field, e: F.struct(field.alias("field"), e["from_file"].cast("long").alias("from_file"), e["name"].alias("name"), e["value"].alias("value"))
    one = one.select(*keys, "file_no", F.inline(F.when(apart, F.transform("each", lambda e: cell(e["name"], e))).otherwise(F.array(cell(F.col("canonical"), F.array_max("each"))))))
    union = F.struct(
        "from_file",
        F.col("name").alias("written_as"),
        F.when(k == "integer", v.try_cast("long")).alias("as_integer"),
        F.when(k == "decimal", v.try_cast("double")).alias("as_decimal"),
        F.when(k == "text", v).alias("as_text"),
        amount_of(v)["amount"].alias("amount"),
    )
    # a row's fields: bounded by the headers of the day's files
    whole = one.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("field", union.alias("union")))).alias("f"), F.max("file_no").alias("file_no"))
    return whole.select(*keys, F.col("file_no").cast("long").alias("file_no"), F.map_from_entries("f").alias("fields"))
