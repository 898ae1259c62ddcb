"""Times in text columns: which column holds them, in which shapes, and their values.

A time is one of a few families of dates, followed by an optional clock and zone. How often each
family occurs in a column, and whether the day or the month comes first, is counted over all rows
by one aggregate; no leading rows decide for the table. Everything is built-in expressions, and no
text is tried against a format it cannot have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?"
    "|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +)?"
_ZONE = r"(?: ?(?<z>z|utc|gmt|[+-]\d{1,2}(?::?\d{2})?))?"
_CLOCK = (
    r"(?:(?:t|[ ,]+)(?<h>\d{1,2}):(?<n>\d{1,2})(?::(?<s>\d{1,2})(?:[.,](?<f>\d{1,9}))?)?"
    r"(?: ?(?<p>[ap])\.?m\.?)?" + _ZONE + ")?"
)

#: Families of dates: year ``y``, month ``m``, day ``d`` and, ``x``, what only this family has. Month and day
#: stand as in day-first writing where only numbers tell them apart.
FAMILIES = {
    "year first": r"(?<ya>\d{4})(?<xa>[-/.])(?<ma>\d{1,2})\k<xa>(?<da>\d{1,2})",
    "year last": r"(?<db>\d{1,2})(?<xb>[-/.])(?<mb>\d{1,2})\k<xb>(?<yb>\d{4})",
    "short year": r"(?<dc>\d{1,2})(?<xc>[-/])(?<mc>\d{1,2})\k<xc>(?<yc>\d{2})",
    "day and month name": rf"{_WEEKDAY}(?<dd>\d{{1,2}})(?:st|nd|rd|th)?(?<xd>[ -])(?<md>{_MONTH})\.?[ ,-]+(?<yd>\d{{4}}|\d{{2}})",
    "month name and day": rf"{_WEEKDAY}(?<me>{_MONTH})\.?(?<xe> +)(?<de>\d{{1,2}})(?:st|nd|rd|th)?,? +(?<ye>\d{{4}})",
}
#: Families in which the order of day and month must be told by the column.
OPEN_ORDER = ("year last", "short year")
#: Short years from here on are of the twentieth century.
PIVOT = 69
#: A column found by its look holds times in this share of its values at least.
LEAST_SHARE = 0.5

_BREAK = "\x01"
_PATTERN = f"(?i)^(?:{'|'.join(FAMILIES.values())}){_CLOCK}$"
_LETTERS = "abcde"
#: A family that does not match leaves its groups empty, so the groups of all families side by side are
#: those of the one that does.
_PARTS = _BREAK.join(
    [
        *["".join(f"${{{part}{k}}}" for k in _LETTERS) for part in "ymd"],
        *[f"${{{part}}}" for part in "hnsfpz"],
        *[f"${{x{k}}}" for k in _LETTERS],
    ]
)
_COUNT = 9 + len(FAMILIES)
_HELD = ("__parts", "__n", "__month_at", "__ahead", "__year", "__month", "__day", "__hour", "__minute", "__second")


def parts_of(text: Column) -> Column:
    """Year, month, day, hour, minute, second, fraction, half of the day and zone of a text, then one
    mark per family, all as texts; a text of no family gives one part only."""
    trimmed = F.btrim(F.translate(text.cast("string"), _BREAK, ""), F.lit(" \t\n\r\x0b\x0c"))
    return F.split(F.regexp_replace(trimmed, _PATTERN, _PARTS), _BREAK, -1)


def _marked(parts: Column, family: str) -> Column:
    return F.get(parts, F.lit(9 + list(FAMILIES).index(family))) != ""


def _family(parts: Column) -> Column:
    chain = None
    for name in FAMILIES:
        chain = F.when(_marked(parts, name), name) if chain is None else chain.when(_marked(parts, name), name)
    return F.when(F.size(parts) == _COUNT, chain)


def _number(text: Column) -> Column:
    """Digits as a number, anything else as NULL; a failed cast would cost an exception per row."""
    return F.when(text.between("0", "9999"), text).cast("int")


def time_votes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, family, n, day_first, month_first)`` per text column and family of dates in it.

    ``n`` counts the values, ``day_first`` and ``month_first`` those that can be read in that order
    only. Values of no family are counted under a NULL family; NULL and blank ones are not counted. One pass over
    all rows and the named columns (default: every text column), combined before the shuffle.
    """
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        schema = "column string, family string, n long, day_first long, month_first long"
        return df.sparkSession.createDataFrame([], schema)
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("text")) for c in names])
    values = df.select(F.explode(entries).alias("v")).select("v.column", "v.text").where("trim(text) <> ''")
    parts = F.col("parts")
    split = values.select("column", parts_of(F.col("text")).alias("parts")).withColumn("family", _family(parts))
    either = F.col("family").isin(*OPEN_ORDER)
    placed = split.withColumns({"first": F.when(either, _number(F.get(parts, F.lit(2)))), "second": F.when(either, _number(F.get(parts, F.lit(1))))})
    return (
        placed.groupBy("column", "family")
        .agg(
            F.count("*").alias("n"),
            F.count_if((F.col("first") > 12) & (F.col("second") <= 12)).alias("day_first"),
            F.count_if((F.col("first") <= 12) & (F.col("second") > 12)).alias("month_first"),
        )
    )


def month_comes_first(df: DataFrame, column: str) -> bool:
    """Whether more values of the column are month-first for certain than day-first; one narrow pass.

    Without evidence, or with as much for either, the day comes first. A stream cannot be counted
    beforehand and is read day-first.
    """
    if df.isStreaming:
        return False
    votes = time_votes(df, [column]).where(F.col("family").isin(*OPEN_ORDER))
    seen = votes.agg(F.sum("month_first").alias("month"), F.sum("day_first").alias("day")).first()
    return (seen["month"] or 0) > (seen["day"] or 0)


def with_time(df: DataFrame, column: str, out: str, month_first: bool | None = None) -> DataFrame:
    """``out``: the zone-less time that the text column tells, NULL where it tells none.

    Clocks may have 12 or 24 hours; a zone is taken off, so that times are UTC; two-digit years are
    1969 to 2068. ``month_first`` settles the order of day and month where only numbers tell them
    apart (default: by the evidence of the whole column); values that do not fit it are no times.
    """
    month_first = month_comes_first(df, column) if month_first is None else month_first
    # What a later step needs more than once is computed once, in a step of its own.
    df = df.withColumn("__parts", parts_of(F.col(f"`{column}`")))
    df = df.withColumn("__parts", F.when(F.size("__parts") == _COUNT, F.col("__parts")))
    parts = [F.get("__parts", F.lit(k)) for k in range(9)]
    zone = F.regexp_replace(parts[8], "[^0-9]", "")
    open_order = _marked(F.col("__parts"), OPEN_ORDER[0]) | _marked(F.col("__parts"), OPEN_ORDER[1])
    df = df.withColumns(
        {
            "__n": F.array(*[_number(parts[k]) for k in range(5)]),
            "__month_at": F.when(open_order & F.lit(month_first), 2).otherwise(1),
            "__ahead": F.concat(F.substring(parts[8], 1, 1), F.rpad(F.when(F.length(zone) % 2 == 1, F.concat(F.lit("0"), zone)).otherwise(zone), 4, "0")),
        }
    )
    n = [F.get("__n", F.lit(k)) for k in range(5)]
    named = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.substring(parts[1], 1, 3))).cast("int")
    century = F.when(F.length(parts[0]) == 4, 0).when(n[0] >= PIVOT, 1900).otherwise(2000)
    second = F.concat(F.lpad(parts[5], 2, "0"), F.lit("."), F.rpad(F.substring(parts[6], 1, 6), 6, "0"))
    # Twelve o'clock opens a half; a half has no hours before 1 or after 12.
    half = F.lower(parts[7])
    in_half = F.when(n[3].between(1, 12), n[3] % 12 + F.when(half == "p", 12).otherwise(0))
    df = df.withColumns(
        {
            "__year": n[0] + century,
            "__month": F.coalesce(F.get("__n", F.col("__month_at")), named),
            "__day": F.get("__n", 3 - F.col("__month_at")),
            "__hour": F.when(half == "", F.coalesce(n[3], F.lit(0))).otherwise(in_half),
            "__minute": F.coalesce(n[4], F.lit(0)),
            "__second": second.cast("decimal(16,6)"),
        }
    )
    local = F.try_make_timestamp_ntz("__year", "__month", "__day", "__hour", "__minute", "__second")
    signed = F.col("__ahead").rlike(r"^[+-]\d{4}$")
    hours = F.when(signed, F.substring("__ahead", 1, 3)).cast("int")
    minutes = F.when(signed, F.concat(F.substring("__ahead", 1, 1), F.substring("__ahead", 4, 2))).cast("int")
    zoned = local - F.make_dt_interval(hours=hours, mins=minutes)
    return df.withColumn(out, F.when(signed, zoned).otherwise(local)).drop(*_HELD)


def time_column(df: DataFrame, names: tuple[str, ...] = ()) -> str | None:
    """The column that holds the times: by name, else the one with most of them.

    By look, all values of every text column are counted; at least ``LEAST_SHARE`` of the column's
    values must be written as times, and the first of equal columns wins. Typed times win without a
    look.
    """
    for name in df.columns:
        if name.lower() in names:
            return name
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return field.name
    shares = (
        time_votes(df)
        .groupBy("column")
        .agg(F.sum(F.when(F.col("family").isNotNull(), F.col("n")).otherwise(0)).alias("hits"), F.sum("n").alias("n"))
        .where((F.col("hits") > 0) & (F.col("hits") >= F.col("n") * LEAST_SHARE))
        .collect()
    )
    place = {c: k for k, c in enumerate(df.columns)}
    best = max(shares, key=lambda r: (r["hits"] / r["n"], r["hits"], -place[r["column"]]), default=None)
    return best["column"] if best else None


def read_times(df: DataFrame, column: str, rejects: Observation | None = None) -> DataFrame:
    """``raw_timestamp`` instead of ``column``, without the rows whose time cannot be read.

    ``rejects`` gets ``rows``, ``missing`` (no text at all) and ``unreadable`` as the result is used.
    """
    typed = isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    source = F.col(f"`{column}`")
    if typed:
        timed = df.withColumn("__time", source.cast("timestamp_ntz"))
    else:
        timed = with_time(df, column, "__time")
    if rejects is not None:
        lost = F.col("__time").isNull()
        timed = timed.observe(
            rejects,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(source.isNull()).alias("missing"),
            F.count_if(lost & source.isNotNull()).alias("unreadable"),
        )
    # A filter is moved below the steps that make what it tests, and would carry all of them with it,
    # many times over. It cannot pass a row number that it reads itself.
    numbered = timed.withColumn(column, F.col("__time")).withColumn("__row", F.monotonically_increasing_id())
    kept = numbered.where(F.col("__time").isNotNull() & (F.col("__row") >= 0))
    return kept.drop("__time", "__row").withColumnRenamed(column, "raw_timestamp")
