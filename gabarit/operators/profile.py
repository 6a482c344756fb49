"""Column profiles of loads, with column expressions induced by minimum description length.

Every distinct text is generalised to a shape (digit runs by length, letters kept), shapes to a form (digit runs of any length)
and forms to a frame (letter runs of any content). Bottom up, an expression replaces the finer ones below it where that takes
fewer bits: the bits of the expression plus those of every distinct value given the expression. A value whose best expression is
no shorter than the values themselves is an exception, and its rows are nonconforming.

What is readable follows from the expressions: the rows of those that admit readable texts are readable as far as an exact check confirms
each text (an instant must exist). Coverage by readable expressions is what is compared between loads; where no expression reads, there are no readable
rows, and neither range nor median.

All passes over the rows are aggregates with map-side combining; only shapes and loads, never values, meet in one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gabarit.session import materialize, small

#: Fixed values of the profile's definition.
RANGE_MAX = {"max_height": 50.0, "max_width": 50.0, "max_length": 50.0, "max_gross_weight": 200.0, "max_axle_weight": 200.0}
DATE_MIN, DATE_MAX = "2015-01-01", "2040-01-01"
SHARE_LIMIT_QUARTERS = 1  # a share departs if it differs by more than this many quarters
MEDIAN_FACTOR = 2.0
MEDIAN_DAYS = 365
NUMBER_FORM = r"^[0-9]+([.,][0-9]+)?$"
INSTANT_FORM = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})Z$"
#: Induced expressions that admit readable texts.
_RUN, _TWO = r"\[0-9\](\+|\{[0-9]+\})?", r"\[0-9\](\+|\{2\})"
NUMBER_EXPRESSION = rf"^{_RUN}((\\\.|,){_RUN})?$"
INSTANT_EXPRESSION = rf"^\[0-9\](\+|\{{4\}})-{_TWO}-{_TWO}(T|\\p\{{L\}}\+){_TWO}:{_TWO}:{_TWO}(Z|\\p\{{L\}}\+)$"
BITS_CHAR, BITS_DIGIT, BITS_LETTER = 8.0, 3.3219280948873623, 5.700439718141092


def blank_trimmed(text: Column) -> Column:
    """text without blanks (any white space, no-break spaces too) at both ends."""
    return F.regexp_replace(text, r"^[\s\u00a0\u202f]+|[\s\u00a0\u202f]+$", "")


def readable_number(text: Column) -> Column:
    """The number of digits with at most one decimal part after a point or comma; null for any other text."""
    return F.when(text.rlike(NUMBER_FORM), F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))


def readable_instant(text: Column) -> Column:
    """Seconds since 1970 of YYYY-MM-DDTHH:MM:SSZ; null if the text has another form or the instant does not exist."""
    day = F.substring(text, 1, 10).try_cast("date")
    h, m, s = (F.substring(text, at, 2).try_cast("long") for at in (12, 15, 18))
    return F.when(
        text.rlike(INSTANT_FORM) & (h < 24) & (m < 60) & (s < 60),
        F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + h * 3600 + m * 60 + s,
    )


def shape_of(text: Column) -> Column:
    """Digits as 9, one for one; all else as it stands."""
    return F.regexp_replace(text, "[0-9]", "9")


def form_of(shape: Column) -> Column:
    return F.regexp_replace(shape, "9+", "9")


def frame_of(form: Column) -> Column:
    return F.regexp_replace(form, r"\p{L}+", "a")


def value_counts(loads: DataFrame) -> DataFrame:
    """(load_id, column_name, text, num, rows, out_of_range, typed): each load's distinct texts with their counts.

    text is trimmed and null where not filled; a readable instant has only its num, which stands for its text one to one. typed:
    rows that count for the median (max_height, or any date). This is the only shuffle of rows, and it is combined map-side.
    """
    value, due = blank_trimmed(F.col("value_raw")), blank_trimmed(F.col("review_due_at_raw"))
    limit = F.create_map(*[F.lit(x) for kv in RANGE_MAX.items() for x in kv])[F.coalesce(F.col("restriction_type"), F.lit(""))]
    day = lambda d: F.datediff(F.lit(d).cast("date"), F.lit("1970-01-01").cast("date")).cast("double") * 86400
    base = loads.select("load_id", "restriction_type", F.nullif(value, F.lit("")).alias("v"), F.nullif(due, F.lit("")).alias("d"))
    base = base.withColumn("vn", readable_number(F.col("v"))).withColumn("dn", readable_instant(F.col("d")).cast("double"))
    pair = F.array(
        F.struct(
            F.lit("value_raw").alias("column_name"),
            F.col("v").alias("text"),
            F.col("vn").alias("num"),
            F.when(F.col("vn").isNotNull() & limit.isNotNull() & ~((F.col("vn") > 0) & (F.col("vn") <= limit)), 1).otherwise(0).alias("oor"),
            F.when(F.col("vn").isNotNull() & (F.col("restriction_type") == "max_height"), 1).otherwise(0).alias("typed"),
        ),
        F.struct(
            F.lit("review_due_at_raw").alias("column_name"),
            F.when(F.col("dn").isNull(), F.col("d")).alias("text"),
            F.col("dn").alias("num"),
            F.when(F.col("dn").isNotNull() & ~((F.col("dn") >= day(DATE_MIN)) & (F.col("dn") < day(DATE_MAX))), 1).otherwise(0).alias("oor"),
            F.when(F.col("dn").isNotNull(), 1).otherwise(0).alias("typed"),
        ),
    )
    rows = base.select("load_id", F.inline(pair))
    return rows.groupBy("load_id", "column_name", "text", "num").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("oor").alias("out_of_range"), F.sum("typed").alias("typed")
    )


def shape_counts(counts: DataFrame) -> DataFrame:
    """(load_id, column_name, shape, rows, exact, distincts, chars): filled rows by shape; exact: those that are readable; chars: of the distinct texts."""
    shape = F.when((F.col("column_name") == "review_due_at_raw") & F.col("num").isNotNull(), F.lit("9999-99-99T99:99:99Z")).otherwise(shape_of(F.col("text")))
    return (
        counts.filter(F.col("text").isNotNull() | F.col("num").isNotNull())
        .withColumn("shape", shape)
        .groupBy("load_id", "column_name", "shape")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum(F.when(F.col("num").isNotNull(), F.col("rows")).otherwise(0)).alias("exact"),
            F.count(F.lit(1)).alias("distincts"),
        )
    )


def _bits_each(shape: Column, digits_free: bool, letters_free: bool) -> Column:
    """Bits of one value of this shape, given an expression that leaves open what is free; runs of open length cost their length too."""
    digits = F.length(F.regexp_replace(shape, "[^9]", ""))
    letters = F.length(F.regexp_replace(shape, r"[^\p{L}]", ""))
    runs = lambda one, text: F.length(F.regexp_replace(F.regexp_replace(text, f"{one}+", "\u0001"), "[^\u0001]", ""))
    bits = digits * BITS_DIGIT
    if digits_free:
        bits = bits + runs("9", shape) * 3.0
    if letters_free:
        bits = bits + letters * BITS_LETTER + runs(r"\p{L}", shape) * 4.0
    return bits


def induce_expressions(shapes: DataFrame) -> DataFrame:
    """(column_name, shape, expression, conforming): for each shape the expression that the description length chooses.

    shapes: as shape_counts gives them, over all loads. Ties keep the finer expression. An empty table has no expressions.
    """
    by = (
        shapes.groupBy("column_name", "shape")
        .agg(F.sum("distincts").alias("n"))
        .withColumn("form", form_of(F.col("shape")))
        .withColumn("frame", frame_of(F.col("form")))
        .withColumn("b0", F.length("shape") * BITS_CHAR + F.col("n") * _bits_each(F.col("shape"), False, False))
        .withColumn("e1", F.col("n") * _bits_each(F.col("shape"), True, False))
        .withColumn("e2", F.col("n") * _bits_each(F.col("shape"), True, True))
        .withColumn("raw", F.col("n") * F.length("shape") * BITS_CHAR)
    )
    forms = by.groupBy("column_name", "frame", "form").agg(
        F.sum("b0").alias("as_shapes"), (F.sum("e1") + (F.length("form") + 2) * BITS_CHAR).alias("as_form"), F.sum("e2").alias("e2"), F.sum("raw").alias("raw")
    )
    forms = forms.withColumn("best1", F.least("as_shapes", "as_form"))
    frames = forms.groupBy("column_name", "frame").agg(
        F.sum("best1").alias("as_forms"), (F.sum("e2") + (F.length("frame") + 4) * BITS_CHAR).alias("as_frame")
    )
    chosen = by.join(forms.select("column_name", "frame", "form", "as_shapes", "as_form"), ["column_name", "frame", "form"]).join(frames, ["column_name", "frame"])
    escaped = lambda c: F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    run = lambda t: F.when(t == "9", "[0-9]").when(t.startswith("9"), F.concat(F.lit("[0-9]{"), F.length(t), F.lit("}"))).otherwise(escaped(t))
    fixed = F.array_join(F.transform(F.regexp_extract_all(F.col("shape"), F.lit("(9+|[^9]+)"), F.lit(1)), run), "")
    open_digits = F.regexp_replace(escaped(F.col("form")), "9", r"[0-9]+")
    open_all = F.regexp_replace(F.regexp_replace(escaped(F.col("frame")), "9", r"[0-9]+"), r"\p{L}+", r"\\p{L}+")
    level = F.when(F.col("as_frame") < F.col("as_forms"), 2).when(F.col("as_form") < F.col("as_shapes"), 1).otherwise(0)
    cost = F.when(level == 2, F.col("as_frame")).when(level == 1, F.col("as_form")).otherwise(F.col("b0"))
    raw = F.when(level == 2, F.sum("raw").over(Window.partitionBy("column_name", "frame"))).when(
        level == 1, F.sum("raw").over(Window.partitionBy("column_name", "frame", "form"))
    ).otherwise(F.col("raw"))
    return chosen.select(
        "column_name", "shape", "form",
        F.when(level == 2, open_all).when(level == 1, open_digits).otherwise(fixed).alias("expression"),
        (cost < raw).alias("conforming"),
    )


def expression_coverage(shapes: DataFrame, expressions: DataFrame) -> DataFrame:
    """(load_id, column_name, expression, conforming, readable_form, rows, exact): rows of each load that each induced expression covers."""
    readable = F.when(F.col("column_name") == "value_raw", F.col("expression").rlike(NUMBER_EXPRESSION)).otherwise(F.col("expression").rlike(INSTANT_EXPRESSION))
    return (
        shapes.join(expressions, ["column_name", "shape"])
        .groupBy("load_id", "column_name", "expression", "conforming", readable.alias("readable_form"))
        .agg(F.sum("rows").alias("rows"), F.sum("exact").alias("exact"))
    )


def coverage_changes(coverage: DataFrame, loads: DataFrame) -> DataFrame:
    """(load_id, column_name, expression, conforming, rows, rows_before, filled, filled_before, nonconforming, nonconforming_before, change): each load's coverage against the load before.

    coverage: as expression_coverage gives it. An expression that only the load before has counts 0 rows. filled, nonconforming: of the
    load and column. change: of the expression's share of the filled rows, null if either share is undefined. What regards the load
    before (the same feed's next lower load_no, ties by load_id) is null where there is none.
    """
    keys = ["load_id", "column_name", "expression", "conforming"]
    known = loads.filter("load_id IS NOT NULL").groupBy("load_id").agg(F.min("feed_name").alias("feed_name"), F.min("load_no").alias("load_no")).filter("feed_name IS NOT NULL AND load_no IS NOT NULL")
    before = known.select("load_id", F.lag("load_id").over(Window.partitionBy("feed_name").orderBy("load_no", "load_id")).alias("before")).filter("before IS NOT NULL")
    before = materialize(before, "loads-before")
    now = materialize(coverage.groupBy(*keys).agg(F.sum("rows").alias("rows")), "coverage")
    past = now.select(F.col("load_id").alias("before"), *keys[1:], F.lit(0).cast("long").alias("rows"), F.col("rows").alias("rows_before")).join(small(before), "before").drop("before")
    both = now.withColumn("rows_before", F.lit(0).cast("long")).unionByName(past).groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum("rows_before").alias("rows_before"))
    both = both.join(small(before), "load_id", "left")
    of_load = lambda c: F.sum(c).over(Window.partitionBy("load_id", "column_name"))
    open_rows = lambda c: F.when(F.col("conforming"), 0).otherwise(F.col(c))
    for c in ("rows", "rows_before"):
        both = both.withColumn(c.replace("rows", "filled"), of_load(F.col(c))).withColumn(c.replace("rows", "nonconforming"), of_load(open_rows(c)))
    last = lambda c: F.when(F.col("before").isNotNull(), F.col(c)).alias(c)
    share = lambda part, whole: F.try_divide(F.col(part), F.col(whole))
    change = F.when(F.col("before").isNotNull(), share("rows", "filled") - share("rows_before", "filled_before"))
    return both.select(*keys, "rows", last("rows_before"), "filled", last("filled_before"), "nonconforming", last("nonconforming_before"), change.alias("change"))


def exact_medians(counts: DataFrame) -> DataFrame:
    """(load_id, column_name, median): exact, the mean of the middle two if even.

    Whole numbers (days for dates) are counted first; only the texts in the bucket of a middle rank are sorted, so no task sorts a load.
    """
    typed = counts.filter(F.col("typed") > 0)
    width = F.when(F.col("column_name") == "value_raw", 1.0).otherwise(86400.0)
    typed = typed.withColumn("bucket", F.floor(F.col("num") / width))
    keys = ["load_id", "column_name"]
    run = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    buckets = typed.groupBy(*keys, "bucket").agg(F.sum("typed").alias("n"))
    buckets = buckets.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(all_))
    lo, hi = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    buckets = buckets.filter((F.col("upto") >= lo) & (F.col("upto") - F.col("n") < hi))
    buckets = materialize(buckets.select(*keys, "bucket", (F.col("upto") - F.col("n")).alias("before"), "total"), "median-buckets")
    within = Window.partitionBy(*keys, "bucket").orderBy("num").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        typed.join(small(buckets), [*keys, "bucket"])
        .groupBy(*keys, "bucket", "before", "total", "num")
        .agg(F.sum("typed").alias("n"))
        .withColumn("upto", F.col("before") + F.sum("n").over(within))
    )
    hit = lambda rank: (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
    return picked.groupBy(*keys).agg(((F.max(F.when(hit(lo), F.col("num"))) + F.max(F.when(hit(hi), F.col("num")))) / 2).alias("median"))


def load_profile(loads: DataFrame) -> DataFrame:
    """One row per load and column, with counts, coverage, range, median, most frequent text, and the same of the load before.

    loads: load_id, feed_name, load_no, restriction_type, value_raw, review_due_at_raw; further columns are ignored. A load is a
    load_id; if its rows disagree about feed or number, the smallest holds. Rows without load_id are left out. Shares with an empty
    denominator are null. The load before is that of the same feed with the next lower load_no (ties by load_id); null for the first.
    """
    loads = loads.filter(F.col("load_id").isNotNull())
    counts = materialize(value_counts(loads), "value-counts")
    shapes = materialize(shape_counts(counts), "shape-counts")
    expressions = materialize(induce_expressions(shapes), "expressions")
    coverage = expression_coverage(shapes, small(expressions))
    keys = ["load_id", "column_name"]
    covered = coverage.groupBy(*keys).agg(
        F.sum(F.when(F.col("readable_form"), F.col("exact")).otherwise(0)).alias("readable"),
        F.sum(F.when(F.col("conforming"), 0).otherwise(F.col("rows"))).alias("nonconforming"),
        F.max_by("expression", F.struct("rows", "expression")).alias("expression"),
        F.max("rows").alias("expression_rows"),
    )
    filled = F.col("text").isNotNull() | F.col("num").isNotNull()
    shown = F.coalesce(F.col("text"), F.date_format(F.timestamp_seconds("num"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    basic = counts.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        F.coalesce(F.sum(F.when(filled, F.col("rows"))), F.lit(0)).alias("filled"),
        F.count(F.when(filled, 1)).alias("distincts"),
        F.coalesce(F.max(F.when(filled, F.col("rows"))), F.lit(0)).alias("top"),
        F.max(F.when(filled, F.struct("rows", shown.alias("text")))).getField("text").alias("top_text"),
        F.sum("out_of_range").alias("out_of_range"),
        F.min("num").alias("min_num"), F.max("num").alias("max_num"),
    )
    meta = loads.groupBy("load_id").agg(F.min("feed_name").alias("feed_name"), F.min("load_no").alias("load_no"))
    out = basic.join(covered, keys, "left").join(exact_medians(counts), keys, "left").join(meta, "load_id")
    out = out.withColumn("readable", F.coalesce("readable", F.lit(0))).withColumn("nonconforming", F.coalesce("nonconforming", F.lit(0)))
    for c in ("out_of_range", "median", "min_num", "max_num"):  # of readable rows
        out = out.withColumn(c, F.when(F.col("readable") > 0, F.col(c)).otherwise(F.lit(0) if c == "out_of_range" else F.lit(None)))
    before = Window.partitionBy("feed_name", "column_name").orderBy("load_no", "load_id")
    kept = ["rows", "filled", "distincts", "top", "readable", "out_of_range", "median"]
    known = F.col("feed_name").isNotNull() & F.col("load_no").isNotNull()
    return out.select("*", *[F.when(known, F.lag(c).over(before)).alias(f"{c}_before") for c in kept])


def profile_columns(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, column_name, rows, nulls, distincts, min_text, max_text, top_rows, expression, nonconforming): a profile of any columns, for each value of by.

    Every column is read as text, trimmed; empty texts are nulls. Expressions are induced over all values of a column; expression: that of most rows,
    nonconforming: rows that none covers in fewer bits than their own. A null by is a value of its own; a column without any text has a null expression.
    """
    names = F.array(*[F.struct(F.lit(c).alias("column_name"), F.nullif(blank_trimmed(F.col(c).cast("string")), F.lit("")).alias("text")) for c in columns])
    counts = df.select(F.col(by).alias("by"), F.inline(names)).groupBy("by", "column_name", "text").agg(F.count(F.lit(1)).alias("rows"))
    counts = materialize(counts.withColumn("shape", shape_of(F.col("text"))), "column-values")
    # distinct values over the table: a value that several groups have is described once
    values = counts.filter("text IS NOT NULL").groupBy("column_name", "text", "shape").agg(F.lit(1).alias("one"))
    expressions = materialize(induce_expressions(values.groupBy("column_name", "shape").agg(F.sum("one").alias("distincts"))), "column-expressions")
    covered = counts.filter("text IS NOT NULL").groupBy("by", "column_name", "shape").agg(F.sum("rows").alias("rows")).join(small(expressions), ["column_name", "shape"])
    covered = covered.groupBy("by", "column_name", "expression", "conforming").agg(F.sum("rows").alias("rows"))
    covered = covered.groupBy("by", "column_name").agg(F.max_by("expression", F.struct("rows", "expression")).alias("expression"), F.sum(F.when(F.col("conforming"), 0).otherwise(F.col("rows"))).alias("nonconforming"))
    basic = counts.groupBy("by", "column_name").agg(
        F.sum("rows").alias("rows"), F.coalesce(F.sum(F.when(F.col("text").isNull(), F.col("rows"))), F.lit(0)).alias("nulls"), F.count("text").alias("distincts"),
        F.min("text").alias("min_text"), F.max("text").alias("max_text"), F.coalesce(F.max(F.when(F.col("text").isNotNull(), F.col("rows"))), F.lit(0)).alias("top_rows"),
    )
    covered = covered.select(F.col("by").alias("b"), F.col("column_name").alias("c"), "expression", "nonconforming")
    out = basic.join(covered, F.col("by").eqNullSafe(F.col("b")) & (F.col("column_name") == F.col("c")), "left").drop("b", "c")
    return out.withColumn("nonconforming", F.coalesce("nonconforming", F.lit(0))).withColumnRenamed("by", by)


def _departs(part: Column, whole: Column, part0: Column, whole0: Column) -> Column:
    """|part/whole - part0/whole0| > a quarter, in whole numbers; false if either share is undefined."""
    d = lambda c: c.cast("decimal(18,0)")
    diff = F.abs(d(part) * d(whole0) - d(part0) * d(whole))
    return F.coalesce((whole > 0) & (whole0 > 0) & (diff * 4 > d(whole) * d(whole0) * SHARE_LIMIT_QUARTERS), F.lit(False))


def load_findings(profile: DataFrame) -> DataFrame:
    """(load_id, column_name, finding): where a load departs from the one before it; profile as load_profile gives it."""
    c = lambda n: F.col(n)
    m, m0 = c("median"), c("median_before")
    jump = F.when(c("column_name") == "value_raw", (m > m0 * MEDIAN_FACTOR) | (m * MEDIAN_FACTOR < m0)).otherwise(F.abs(m - m0) > MEDIAN_DAYS * 86400)
    cases = {
        "null_share": _departs(c("rows") - c("filled"), c("rows"), c("rows_before") - c("filled_before"), c("rows_before")),
        "unreadable_share": _departs(c("filled") - c("readable"), c("filled"), c("filled_before") - c("readable_before"), c("filled_before")),
        "range_share": _departs(c("out_of_range"), c("readable"), c("out_of_range_before"), c("readable_before")),
        "distinct_share": _departs(c("distincts"), c("filled"), c("distincts_before"), c("filled_before")),
        "top_share": _departs(c("top"), c("filled"), c("top_before"), c("filled_before")),
        "median": F.coalesce(jump, F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in cases.items()]))
    return profile.filter(c("rows_before").isNotNull()).select("load_id", "column_name", F.explode(found).alias("finding"))
