"""Quantities in different units, brought to millimetres and kilograms.

A notation is where and how a unit is written: in the value, in the unit column or in the remark, with its letters. Records of one
entity link the notations they use. For every pair of notations the robust scale (centre of the narrowest interval that holds half of the
log ratios) and offset (what is left between the middle values) are estimated; a scale is snapped to a known conversion, and conversions are
propagated through the graph of notations, from plain metres and tonnes until no more become known, and then to notations of the same letters.

The links decide: a notation has the unit that its links give, whatever its letters say. Only where links are few (under OVERRULE_LINKS
against the words, under MIN_LINKS at all), disagree, or leave an offset that no unit explains, do the words of the label decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gabarit.session import materialize, small

#: Known conversions to millimetres and kilograms.
LENGTH_UNITS = {"mm": "1", "cm": "10", "in": "25.4", "ft": "304.8", "yd": "914.4", "m": "1000"}
WEIGHT_UNITS = {"kg": "1", "lb": "0.45359237", "short ton": "907.18474", "t": "1000"}
#: Words for units, lower case, letters only.
UNIT_WORDS = {
    "mm": ["mm", "millim", "millimetre", "millimetres", "millimeter", "millimeters", "millimètres"],
    "cm": ["cm", "centimetre", "centimetres", "centimeter", "centimeters", "zentimeter", "centimètres"],
    "in": ["in", "inch", "inches", "zoll", "pouces", "ftin"],
    "ft": ["ft", "foot", "feet", "fuß", "pieds"],
    "yd": ["yd", "yds", "yard", "yards"],
    "m": ["m", "metre", "metres", "meter", "meters", "mètre", "mètres"],
    "kg": ["kg", "kgs", "kilogram", "kilograms", "kilogramm", "kilogrammes", "kilo", "kilos"],
    "lb": ["lb", "lbs", "pound", "pounds"],
    "short ton": ["shorttons", "shortton", "shtn", "ustons", "uston"],
    "t": ["t", "tonne", "tonnes", "to", "tonnen"],
}
BASE = ("m", "t")
WEIGHT_TYPES = ("max_gross_weight", "max_axle_weight")
LENGTH_TYPES = ("max_height", "max_width", "max_length")
SNAP_LOG = math.log(1.045)  # half the distance of a yard from a metre
MIN_LINKS = 5
OVERRULE_LINKS = 20  # from which links hold against words that name another unit
MAX_OFFSET = 0.1  # of the middle value, beyond which a notation is no plain unit
TWENTIETHS = [k / 20 for k in range(1, 20)]

_SPACE = r"[\s\u00a0\u202f\u2009]"
_FEET = r"(?:'|’|′|ft\.?|feet|foot)"
_INCH = r"(?:\"|”|″|''|in\.?|inch|inches)"
FT_IN = rf"^([0-9]+){_SPACE}*{_FEET}{_SPACE}*-?{_SPACE}*([0-9]+(?:[.,][0-9]+)?){_SPACE}*{_INCH}?$"
FT_ONLY = rf"^([0-9]+(?:[.,][0-9]+)?){_SPACE}*(?:'|’|′)$"
NUMBER_UNIT = rf"^([0-9]{{1,3}}(?:{_SPACE}[0-9]{{3}})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)*){_SPACE}*(\p{{L}}[\p{{L}}.]*(?:{_SPACE}\p{{L}}+)*\.?)?$"


def plain_number(text: Column) -> Column:
    """Decimal of a number in text: a comma before exactly three final digits groups thousands, otherwise it is a decimal mark; blanks group."""
    t = F.regexp_replace(text, _SPACE, "")
    t = F.when(t.rlike(r"^[0-9]{1,3}(,[0-9]{3})*,[0-9]{3}$"), F.regexp_replace(t, ",", "")).otherwise(F.regexp_replace(t, ",", "."))
    return t.try_cast("decimal(24,6)")


def _letters(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}]", ""))


def _word_map() -> Column:
    return F.create_map(*[F.lit(x) for unit, words in UNIT_WORDS.items() for w in words for x in (w, unit)])


def units_of_words(kind: Column, text: Column) -> Column:
    """The units of this kind that a label or remark names, in the order of its words (two neighbours may be one unit); "in" counts last, as it may be a preposition."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    twos = F.transform(words, lambda w, i: F.concat(w, F.coalesce(F.get(words, i + 1), F.lit(""))))
    of = lambda w: F.try_element_at(_word_map(), w)
    fits = lambda u: u.isNotNull() & F.when(kind == "weight", u.isin(*WEIGHT_UNITS)).otherwise(u.isin(*LENGTH_UNITS))
    plain = F.concat(F.array(_letters(text)), twos, F.filter(words, lambda w: w != "in"), F.filter(words, lambda w: w == "in"))
    return F.array_distinct(F.filter(F.transform(plain, of), fits))


def stated(loads: DataFrame) -> DataFrame:
    """(v, u, r, kind, slot, token, notation, number, n): the distinct forms of loads that hold a number, parsed once each, with their rows.

    v, u, r: value_raw, unit_raw and remark, trimmed, empty where null; kind: length or weight, by restriction_type (rows of other
    types are left out). slot: value, unit, remark or none, with token its letters (of a remark, all its words); notation: a number for
    kind, slot and token. number: feet and inches together count in inches. A value that is no number (words, signs, blank) is left out.
    """
    low = F.lower(F.col("v"))
    unit, remark = _letters(F.col("u")), F.lower(F.col("r"))
    feet = lambda g: plain_number(F.regexp_extract(F.col("low"), FT_IN, g))
    forms = keyed(loads).groupBy("v", "u", "r", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("low", low)
    forms = forms.withColumn("ftin", F.col("low").rlike(FT_IN)).withColumn("ft", F.col("low").rlike(FT_ONLY)).withColumn("num", F.col("low").rlike(NUMBER_UNIT))
    forms = forms.withColumn("tail", _letters(F.regexp_extract("low", NUMBER_UNIT, 2)))
    number = (
        F.when(F.col("ftin"), (feet(1) * 12 + feet(2)).cast("decimal(24,6)"))
        .when(F.col("ft"), plain_number(F.regexp_extract("low", FT_ONLY, 1)))
        .when(F.col("num"), plain_number(F.regexp_extract("low", NUMBER_UNIT, 1)))
    )
    slot = F.when(F.col("ftin") | F.col("ft") | (F.col("tail") != ""), "value").when(unit != "", "unit").when(remark != "", "remark").otherwise("none")
    token = F.when(F.col("ftin"), "ftin").when(F.col("ft"), "ft").when(F.col("tail") != "", F.col("tail")).when(unit != "", unit).otherwise(remark)
    out = forms.select("v", "u", "r", "kind", "n", slot.alias("slot"), token.alias("token"), number.alias("number")).filter(F.col("number") > 0)
    return out.withColumn("notation", F.xxhash64("kind", "slot", "token"))


def keyed(loads: DataFrame) -> DataFrame:
    """load_row_id, record_id, v, u, r, kind: what stated() groups by."""
    bare = lambda c: F.coalesce(F.regexp_replace(F.col(c), rf"^{_SPACE}+|{_SPACE}+$", ""), F.lit(""))
    kind = F.when(F.col("restriction_type").isin(*WEIGHT_TYPES), "weight").when(F.col("restriction_type").isin(*LENGTH_TYPES), "length")
    rows = loads.filter(F.col("value_raw").isNotNull()).select("load_row_id", "record_id", bare("value_raw").alias("v"), bare("unit_raw").alias("u"), bare("remark").alias("r"), kind.alias("kind"))
    return rows.filter(F.col("kind").isNotNull())


FORM = ["v", "u", "r", "kind"]


def _snap(kind: Column, log_ratio: Column) -> Column:
    """The known unit nearest to a log scale, within SNAP_LOG; else null."""
    options = [(k, u, math.log(float(f))) for k, us in (("length", LENGTH_UNITS), ("weight", WEIGHT_UNITS)) for u, f in us.items()]
    best = F.array_min(F.array(*[F.struct(F.when(kind == k, F.abs(log_ratio - x)).otherwise(99.0).alias("d"), F.lit(u).alias("u")) for k, u, x in options]))
    return F.when(best.getField("d") <= SNAP_LOG, best.getField("u"))


def _factor(unit: Column, as_type: str = "double") -> Column:
    return F.create_map(*[F.lit(x) for u, f in (LENGTH_UNITS | WEIGHT_UNITS).items() for x in (u, f)])[unit].cast(as_type)


def _narrowest_half(q: Column) -> Column:
    """struct(width, centre) of the narrowest interval between TWENTIETHS that holds half of the values."""
    half = 10
    return F.array_min(F.array(*[F.struct((q[k + half] - q[k]).alias("width"), q[k + half // 2].alias("centre")) for k in range(len(TWENTIETHS) - half)]))


def notation_links(loads: DataFrame, forms: DataFrame, total: DataFrame) -> DataFrame:
    """(notation, kind, to_notation, links, scale, spread, mid, to_mid): robust log scales between the notations of the same records.

    Entities are pre-aggregated to one mean per notation, and each is linked to its record's most common notation only (plain metres or tonnes
    first), so that an entity of many rows makes no more links than it has notations.
    """
    rows = keyed(loads).filter(F.col("record_id").isNotNull()).join(small(forms.select(*FORM, "notation", F.col("number").cast("double").alias("x"))), FORM)
    per = rows.groupBy("record_id", "notation").agg(F.avg("x").alias("v"))
    per = per.join(small(total.select("notation", "kind", "n", "base")), "notation")
    per = per.withColumn("to", F.max(F.struct("base", "n", "notation", "v")).over(Window.partitionBy("record_id", "kind")))
    edges = per.filter(F.col("notation") != F.col("to.notation")).groupBy("notation", "kind", F.col("to.notation").alias("to_notation"))
    edges = edges.agg(
        F.count(F.lit(1)).alias("links"), F.percentile_approx(F.log(F.col("to.v") / F.col("v")), TWENTIETHS, 1000).alias("q"),
        F.percentile_approx("v", 0.5, 1000).alias("mid"), F.percentile_approx(F.col("to.v"), 0.5, 1000).alias("to_mid"),
    )
    edges = edges.filter(F.col("links") >= MIN_LINKS).withColumn("h", _narrowest_half(F.col("q")))
    return edges.select("notation", "kind", "to_notation", "links", F.col("h.centre").alias("scale"), F.col("h.width").alias("spread"), "mid", "to_mid")


def propagated(edges: DataFrame, bases: DataFrame) -> DataFrame:
    """(notation, kind, links, log_scale, offset, spread, learned): units of notations through the graph of their links, until no more become known.

    bases: (notation, at), the log of the millimetres or kilograms of one, for notations that are known beforehand. learned: null where the links
    disagree (spread beyond SNAP_LOG), leave an offset beyond MAX_OFFSET, or fit no known conversion.
    """
    known, n = bases, -1
    while True:
        step = edges.join(known.select(F.col("notation").alias("to_notation"), "at"), "to_notation").withColumn("log_scale", F.col("scale") + F.col("at"))
        step = step.withColumn("offset", F.col("to_mid") - F.exp(F.col("scale")) * F.col("mid"))
        best = step.groupBy("notation", "kind").agg(F.max_by(F.struct("links", "log_scale", "offset", "spread", "to_mid"), F.struct("links", "log_scale")).alias("b"))
        plain = (F.col("b.spread") <= SNAP_LOG) & (F.abs("b.offset") <= MAX_OFFSET * F.col("b.to_mid"))
        best = materialize(best.withColumn("learned", F.when(plain, _snap(F.col("kind"), F.col("b.log_scale")))).select("notation", "kind", "b.links", "b.log_scale", "b.offset", "b.spread", "learned"), "learned-units")
        more = best.filter("learned IS NOT NULL").select("notation", F.log(_factor(F.col("learned"))).alias("at")).join(bases.select("notation"), "notation", "left_anti")
        known, before, n = bases.unionByName(more), n, more.count()
        if n <= before:
            return best


def learned_units(loads: DataFrame, forms: DataFrame) -> DataFrame:
    """(notation, kind, slot, token, n, links, log_scale, offset, spread, learned, alike, worded, unit): the notations of forms and the unit of each.

    forms: stated(loads), written. learned: by links through the graph; alike: that of the notation of the same letters, elsewhere, with the most
    links; worded: the first unit in its words. unit: learned, unless its words name another unit and links are under OVERRULE_LINKS; else
    alike; else worded. A notation with none of them has no unit.
    """
    total = forms.groupBy("notation", "kind", "slot", "token").agg(F.sum("n").alias("n"))
    total = total.withColumn("words", F.when(F.col("slot") != "none", units_of_words(F.col("kind"), F.col("token"))))
    total = total.withColumn("worded", F.get("words", F.lit(0)))
    total = materialize(total.withColumn("base", (F.col("slot") == "none") | F.coalesce(F.col("worded").isin(*BASE), F.lit(False))), "notations")
    edges = materialize(notation_links(loads, forms, total), "notation-links")
    # metres and tonnes stand at log 1000 of millimetres and kilograms
    best = propagated(edges, total.filter("base").select("notation", F.lit(math.log(1000.0)).alias("at")))
    base = F.when(F.col("base"), F.when(F.col("kind") == "weight", "t").otherwise("m"))
    out = total.join(best, ["notation", "kind"], "left").withColumn("learned", F.coalesce(base, "learned"))
    label = F.col("slot").isin("value", "unit")
    best_of = F.max_by("learned", F.struct(F.coalesce("links", F.lit(0)), "learned"))
    alike = out.filter(label & F.col("learned").isNotNull()).groupBy(F.col("kind").alias("k"), F.col("token").alias("t")).agg(best_of.alias("alike"))
    out = out.join(alike, (F.col("kind") == F.col("k")) & (F.col("token") == F.col("t")) & label, "left")
    named = F.array_contains("words", F.col("learned"))  # a remark may name several units: one of them confirms
    held = F.when(F.col("base") | F.col("worded").isNull() | named | (F.col("links") >= OVERRULE_LINKS), F.col("learned"))
    return out.withColumn("unit", F.coalesce(held, "alike", "worded")).select("notation", "kind", "slot", "token", "n", "links", "log_scale", "offset", "spread", "learned", "alike", "worded", "unit")


def converted(loads: DataFrame) -> DataFrame:
    """(load_row_id, std_unit, std_value, unit, slot): every row of loads with a quantity, in whole millimetres or kilograms, rounded half up.

    loads: load_row_id, record_id, restriction_type, value_raw, unit_raw, remark. A quantity without a label, or with a remark that gives no unit, counts as
    metres or tonnes; a label of which neither links nor words tell the unit gives a null std_value and unit. Values without a quantity, and types that are no length or weight, give no row; repeated rows are kept.
    """
    forms = materialize(stated(loads), "forms")
    units = learned_units(loads, forms).select("notation", "unit")
    values = materialize(forms.join(units, "notation").select(*FORM, "slot", "number", "unit"), "values")
    out = keyed(loads).join(small(values), FORM)
    unit = F.coalesce("unit", F.when(F.col("slot").isin("none", "remark"), F.when(F.col("kind") == "weight", "t").otherwise("m")))
    exact = F.col("number") * _factor(unit, "decimal(13,8)")
    return out.select(
        "load_row_id",
        F.when(F.col("kind") == "weight", "kg").otherwise("mm").alias("std_unit"),
        F.floor(exact + F.lit("0.5").cast("decimal(2,1)")).cast("long").alias("std_value"),
        unit.alias("unit"), "slot",
    )
