"""Mixed timestamp texts to instants in UTC.

All formats are one regular expression of alternatives with named groups. It runs once per row, inside the JVM: the
match is rewritten to its components between separators, which are split off, checked against the calendar and
assembled by integer day arithmetic, clock changes included (functions.zones). A zone, an offset or UTC/GMT in the
text holds before the source's zone; other zone abbreviations mean the source's own zone, also numeric ones like -03
that agree with the zone at that time.

Defined cases: surrounding white space is ignored. Null, empty and unknown forms, dates and times of day that do
not exist, and local times that the clock skipped have no instant (null). A local time that occurs twice is the
earlier instant. Digits beyond the microsecond are cut off; numbers of 10, 13, 16 and 19 digits are seconds, milli-,
micro- and nanoseconds since 1970. Without a known source zone only texts with their own zone have an instant, and
all-number dates that need a day order have none. A zone name that the driver's zone database lacks is unknown. Before
1900 and after 2100 a zone keeps the offset it has there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import zones
from tidemark.functions.times import DAY_US
from tidemark.runtime import maybe_broadcast

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_FULL = ("uary", "ruary", "ch", "il", "", "e", "y", "ust", "tember", "ober", "ember", "ember")

#: Building blocks; @ is replaced by the alternative's number, as group names must be unique.
_MONTH = "(?<mon@>" + "|".join(f"{m}(?:{rest})?" if rest else m for m, rest in zip(MONTHS, _FULL, strict=True)) + "|sept)[.]?"
_TIME = r"(?<h@>\d{1,2}):(?<mi@>\d{2})(?::(?<s@>\d{2})(?:[.,](?<f@>\d+))?)?(?:\s?(?<ap@>[ap])[.]?m[.]?)?"
_ZONE = r"(?:\s?(?:(?<off@>[+-]\d{2}(?::?\d{2})?)|(?<z@>[A-Za-z]{1,5})))?"
_TAIL = rf"(?:(?:t|\s+|,\s*){_TIME}{_ZONE})?"
_DAY_NAME = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"
FORMATS = (
    rf"(?<y@>\d{{4}})(?<sep@>[-/.])(?<mo@>\d{{1,2}})\k<sep@>(?<d@>\d{{1,2}}){_TAIL}",  # year first
    rf"(?<y@>\d{{4}})(?<mo@>\d{{2}})(?<d@>\d{{2}})(?:[t\s](?<h@>\d{{2}}):?(?<mi@>\d{{2}})(?::?(?<s@>\d{{2}})(?:[.,](?<f@>\d+))?)?{_ZONE})?",  # compact
    rf"(?<y@>\d{{4}})(?<mo@>\d{{2}})(?<d@>\d{{2}})(?<h@>\d{{2}})(?<mi@>\d{{2}})(?<s@>\d{{2}})",
    rf"(?<a@>\d{{1,2}})(?<sep@>[-/.])(?<b@>\d{{1,2}})\k<sep@>(?<y@>\d{{4}}|\d{{2}}){_TAIL}",  # all numbers, the source's order
    rf"{_DAY_NAME}(?<d@>\d{{1,2}})(?:st|nd|rd|th)?[\s-]+{_MONTH}[\s,-]+(?<y@>\d{{4}}|\d{{2}}){_TAIL}",
    rf"{_DAY_NAME}{_MONTH}\s+(?<d@>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?<y@>\d{{4}}){_TAIL}",
    r"(?<e@>\d{10}|\d{13}|\d{16}|\d{19})(?:[.]\d*)?",
)
#: Components in the order in which the match is rewritten.
PARTS = ("y", "mo", "mon", "d", "a", "b", "h", "mi", "s", "f", "ap", "off", "z", "e")
_SEP = "\u0001"


def compile_formats(formats: tuple[str, ...] = FORMATS) -> tuple[str, str]:
    """(pattern, replacement) of all formats as one alternation."""
    pattern = r"(?i)^\s*(?:" + "|".join(f.replace("@", str(i)) for i, f in enumerate(formats)) + r")\s*$"
    has = {p: [i for i, f in enumerate(formats) if f"(?<{p}@>" in f] for p in PARTS}
    return pattern, _SEP.join("".join(f"${{{p}{i}}}" for i in has[p]) for p in PARTS) + _SEP


def new_stage(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions, but a further stage of generated code: one method for a long chain of
    expressions is too large to be compiled to machine code. (A merge of partitions to more than there are does nothing.)"""
    return df.coalesce(1 << 20)


def with_days(df: DataFrame, y: str, m: str, d: str, out: str) -> DataFrame:
    """Adds the days since 1970-01-01 of proleptic Gregorian dates from year 1 on, in whole numbers: March-based years of
    400-year eras. In steps, so that what is used again is a column and the generated code stays small."""
    x = df.withColumns({"__y2": F.col(y) - F.when(F.col(m) <= 2, 1).otherwise(0), "__doy": F.expr(f"(153 * pmod(`{m}` + 9, 12) + 2) div 5 + `{d}` - 1")})
    x = x.withColumn("__era", F.expr("__y2 div 400"))
    x = x.withColumn("__yoe", F.col("__y2") - F.col("__era") * 400)
    return x.withColumn(out, F.expr("__era * 146097 + __yoe * 365 + __yoe div 4 - __yoe div 100 + __doy - 719468")).drop("__y2", "__doy", "__era", "__yoe")


def parse_instants(df: DataFrame, text: str, zone: str | None, order: str | None, out: str = "utc_us", zone_names: DataFrame | None = None) -> DataFrame:
    """Adds `out` (long, microseconds; null: no instant). zone, order: columns with an IANA name and 'dmy' or 'mdy'.

    zone_names: a smaller table with the same column of zones (else they are looked up in df).
    """
    pattern, replacement = compile_formats()
    # the generator is a barrier: each use of a component would otherwise run the expression again
    x = df.withColumn("__m", F.explode(F.array(F.split(F.regexp_replace(F.col(text), F.lit(pattern), F.lit(replacement)), _SEP))))
    n = len(PARTS)
    at = lambda p: F.when(F.size("__m") == n + 1, F.nullif(F.element_at("__m", PARTS.index(p) + 1), F.lit("")))
    num = lambda p: at(p).try_cast("int")
    x = x.withColumns({f"__{p}": at(p) for p in ("mon", "f", "ap", "off", "z", "e", "y")} | {f"__{p}": num(p) for p in ("mo", "d", "a", "b", "h", "mi", "s")})
    x = new_stage(x)
    mdy, dmy = (F.lower(F.trim(F.col(order))) == o if order else F.lit(None).cast("boolean") for o in ("mdy", "dmy"))
    name = F.lower(F.substring("__mon", 1, 3))
    named = F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")
    y = F.col("__y").try_cast("int") + F.when(F.length("__y") == 2, 2000).otherwise(0)
    mo = F.coalesce(F.col("__mo"), F.when(name.isNotNull(), named), F.when(mdy, F.col("__a")).when(dmy, F.col("__b")))
    d = F.coalesce(F.col("__d"), F.when(mdy, F.col("__b")).when(dmy, F.col("__a")))
    x = x.withColumns({"__yy": y, "__mm": mo, "__dd": d})
    yy, mm, dd = F.col("__yy"), F.col("__mm"), F.col("__dd")
    leap = ((yy % 4 == 0) & (yy % 100 != 0)) | (yy % 400 == 0)
    last = F.when(mm == 2, F.when(leap, 29).otherwise(28)).when(mm.isin(4, 6, 9, 11), 30).otherwise(31)
    h0 = F.coalesce("__h", F.lit(0))
    h = F.when(F.col("__ap").isNull(), h0).when(h0.between(1, 12), h0 % 12 + F.when(F.lower("__ap") == "p", 12).otherwise(0))
    x = x.withColumns({"__last": last, "__hh": h, "__mi": F.coalesce("__mi", F.lit(0)), "__s": F.coalesce("__s", F.lit(0)), "__off": F.regexp_replace("__off", ":", "")})
    micro = F.coalesce(F.rpad(F.substring("__f", 1, 6), 6, "0").try_cast("int"), F.lit(0))
    valid = yy.between(1, 9999) & mm.between(1, 12) & dd.between(1, F.col("__last")) & F.col("__hh").between(0, 23) & (F.col("__mi") <= 59) & (F.col("__s") <= 59)
    clock = ((F.col("__hh") * 60 + F.col("__mi")) * 60 + F.col("__s")).cast("long") * 1_000_000
    x = with_days(x.withColumns({"__clock": F.when(valid, clock + micro), "__off_h": F.substring("__off", 2, 2).try_cast("int"), "__off_m": F.coalesce(F.nullif(F.substring("__off", 4, 2), F.lit("")).try_cast("int"), F.lit(0))}), "__yy", "__mm", "__dd", "__days")
    minutes = F.when((F.col("__off_h") <= 18) & (F.col("__off_m") <= 59), F.col("__off_h") * 60 + F.col("__off_m"))
    x = x.withColumns({"__local": F.col("__days") * DAY_US + F.col("__clock"), "__offset": minutes.cast("long") * F.when(F.startswith("__off", F.lit("-")), -60_000_000).otherwise(60_000_000)})
    x = new_stage(x)
    utc_name = F.upper(F.coalesce("__z", F.lit(""))).isin("Z", "UTC", "GMT")
    known = F.col("__local").isNotNull() & ~utc_name
    if zone:
        names = zones.known_zones(df if zone_names is None else zone_names, zone)
        rules, slots = zones.rules_table(df.sparkSession, names)  # bounded by the zone database
        year = F.when(known, F.least(F.greatest("__yy", F.lit(zones.FIRST_YEAR)), F.lit(zones.LAST_YEAR)))
        x = x.withColumn("__year", year).join(F.broadcast(rules.withColumnsRenamed({"zone": "__rule_zone", "year": "__rule_year"})), (F.col(zone) == F.col("__rule_zone")) & (F.col("__year") == F.col("__rule_year")), "left")
        own = F.when(F.col("off0").isNotNull(), zones.earliest_instant(F.col("__local"), slots, F.col("__h").isNull()))  # a date is the start of its day
        x = x.withColumns({"__own": own, "__late": zones.latest_instant(F.col("__local"), slots)})
    else:
        x = x.withColumns(dict.fromkeys(("__own", "__late"), F.lit(None).cast("long")))
    own, late = F.col("__own"), F.col("__late")
    given = F.col("__local") - F.col("__offset")
    # an hour without minutes is how the zone database abbreviates many zones: the zone's own then, if it agrees
    given = F.when((F.length("__off") == 3) & (given == late), F.coalesce(own, given)).otherwise(given)
    e, k = F.col("__e").try_cast("long"), F.length("__e")
    epoch = F.when(k == 10, e * 1_000_000).when(k == 13, e * 1000).when(k == 16, e).when(k == 19, F.substring("__e", 1, 16).try_cast("long"))
    result = F.when(F.col("__e").isNotNull(), epoch).when(F.col("__off").isNotNull(), given).when(utc_name, F.col("__local")).otherwise(own)
    # The generator is a barrier: a filter on the result pushed below would repeat the whole chain of expressions.
    return x.select(*[c for c in df.columns if c != out], F.explode(F.array(result)).alias(out))


def normalise_instants(rows: DataFrame, sources: DataFrame, text: str = "date", source: str = "feed", zone: str = "tz_name", order: str = "day_order") -> DataFrame:
    """rows with `utc_us`; the source's zone and day order are looked up without regard to case and outer blanks.

    The table of sources is broadcast if it is counted to be small; else it is an ordinary join, whose other side
    Spark splits where a source is hot. A source listed twice counts once (the smallest row).
    """
    key = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    s = sources.select(key(F.col(source)).alias("__source"), F.struct(F.col(zone).alias("zone"), F.col(order).alias("order")).alias("__s")).filter("__source is not null").groupBy("__source").agg(F.min("__s").alias("__s"))
    s = s.select("__source", F.col("__s.zone").alias("__tz"), F.col("__s.order").alias("__order"))
    x = rows.withColumn("__source", key(F.col(source))).join(maybe_broadcast(s), "__source", "left").withColumnsRenamed({"__tz": "_source_tz", "__order": "_source_order"}).drop("__source")
    return parse_instants(x, text, "_source_tz", "_source_order", zone_names=s.select(F.col("__tz").alias("_source_tz"))).drop("_source_tz", "_source_order")
