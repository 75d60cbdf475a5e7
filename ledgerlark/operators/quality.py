"""Record quality: rule deductions, repairs that must not lower the score, audits and spot checks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from string import ascii_letters

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import textkeys as T
from ledgerlark.operators.aggregates import count_where
from ledgerlark.operators.sequences import missing_numbers


@dataclass
class Rule:
    """A deduction. Of the rules of one group only the first that holds counts."""

    name: str
    points: int
    holds: Column
    group: str = ""


def hits(rules: list[Rule], exempt: Column | None = None) -> Column:
    """Names of the rules that hold, in order; none for exempt rows."""
    found, earlier = [], {}
    for r in rules:
        holds = F.coalesce(r.holds, F.lit(False))
        mine = holds & ~earlier[r.group] if r.group in earlier else holds
        if r.group:
            earlier[r.group] = earlier[r.group] | holds if r.group in earlier else holds
        found.append(F.when(mine, r.name))
    names = F.array_compact(F.array(*found))
    return names if exempt is None else F.when(F.coalesce(exempt, F.lit(False)), F.array().cast("array<string>")).otherwise(names)


def points(defects: Column, rules: list[Rule]) -> Column:
    """The score from 100 down to 0 that a record with these defects has."""
    lost = F.aggregate(defects, F.lit(0), lambda sum_, name: sum_ + F.coalesce(*[F.when(name == r.name, r.points) for r in rules], F.lit(0)))
    return F.greatest(F.lit(100) - lost, F.lit(0))


def score(rules: list[Rule], exempt: Column | None = None) -> tuple[Column, Column]:
    """(score, names of the rules that hold) as two columns that don't share their work; see with_quality() for both at once."""
    names = hits(rules, exempt)
    return points(names, rules), names


def is_perfect(points: Column, defects: Column) -> Column:
    return (points >= 95) & (F.size(defects) == 0)


# Signs that no name has; labels that stand before a name or a relation; words of a house number that was not read.
SYMBOLS = "|!~*_\\/^;:+?=<>{}[]\"'`,"
NAME_LABELS = ("नाम", "निर्वाचक", "पुत्र", "पत्नी")
RELATION_LABELS = ("पिता", "पति", "माता", "अन्य")
UNREAD_HOUSE = ("उपलब्ध", "धर", "फोटो", "om", "००")


def has_latin(text: Column) -> Column:
    """Whether an ASCII letter is in it."""
    return F.translate(text, ascii_letters, "") != text


def has_symbol(text: Column) -> Column:
    return F.translate(text, SYMBOLS, "") != text


def begins_with_label(text: Column, labels: tuple[str, ...]) -> Column:
    words = F.split(T.collapse(text), " ")
    return words[0].isin(*labels)


def unread_house(house: Column) -> Column:
    low = F.lower(house)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in UNREAD_HOUSE])


def lone_zero(name: Column) -> Column:
    """A 0 that touches no consonant."""
    consonant = lambda c: c.between("क", "ह")
    letters = F.split(F.concat(F.lit(" "), name, F.lit(" ")), "")
    at = F.transform(letters, lambda c, i: F.when(c == "0", i))
    return F.exists(at, lambda i: i.isNotNull() & ~consonant(F.get(letters, i - 1)) & ~consonant(F.get(letters, i + 1)))


def registry_rules(markers: tuple[str, ...] = ()) -> list[Rule]:
    """Rules of a registry record (name, relation_name, relation_type, gender, code, age, house). markers: name words (the caller's)
    that contradict the default gender label."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    name, rel, house, gender = text("name"), text("relation_name"), text("house"), T.gender_label(F.col("gender"))
    marked = F.arrays_overlap(F.split(name, " "), F.array(*[F.lit(m) for m in markers])) if markers else F.lit(False)
    return [
        Rule("name_missing", 30, F.length(name) < 2, "name"), Rule("name_latin", 25, has_latin(name), "name"),
        Rule("name_symbols", 15, has_symbol(name), "name"), Rule("name_label", 20, begins_with_label(name, NAME_LABELS), "name"),
        Rule("name_zero", 10, lone_zero(name), "name"),
        Rule("relation_missing", 25, F.length(rel) < 2, "rel"), Rule("relation_latin", 20, has_latin(rel), "rel"),
        Rule("relation_symbols", 10, has_symbol(rel), "rel"),
        Rule("relation_label", 15, begins_with_label(rel, RELATION_LABELS) | T.collapse(rel).startswith("का नाम"), "rel"),
        Rule("gender_relation", 30, (T.relation_label(F.col("relation_type")) == "पति") & (gender == "पुरुष")),
        Rule("gender_marker", 25, marked & (gender == "पुरुष")), Rule("code_format", 25, ~T.id_defect(F.col("code"))["valid"]),
        Rule("age_range", 20, F.coalesce(~F.col("age").between(18, 115), F.lit(True))),
        Rule("house_noise", 15, unread_house(house)),
    ]


def with_quality(df: DataFrame, rules: list[Rule], exempt: Column | None = None) -> DataFrame:
    """``df`` with defects, score and perfect; each rule is evaluated once."""
    done = df.withColumn("defects", hits(rules, exempt)).withColumn("score", points(F.col("defects"), rules))
    return done.withColumn("perfect", is_perfect(F.col("score"), F.col("defects"))).select(*df.columns, "score", "defects", "perfect")


def repairs(markers: tuple[str, ...] = ()) -> dict[str, Column]:
    """New values of the fields of a registry record; a repair that leaves too little keeps the old value."""

    def name(column: str, labels: tuple[str, ...]) -> Column:
        """Words without signs and Latin letters; labels before and zeros after the name are no words of it."""
        words = F.filter(F.split(T.collapse(F.translate(F.regexp_replace(T.clean_text(F.col(column)), "[A-Za-z]", ""), SYMBOLS, "")), " "), lambda w: w != "")
        label = lambda w: F.regexp_replace(w, "[-—]$", "").isin(*labels, "का", "नाम", "-", "—")
        at = F.array_position(F.transform(words, lambda w: ~label(w)), F.lit(True)).cast("int")
        rest = F.when(at > 0, F.slice(words, at, F.size(words))).otherwise(F.array().cast("array<string>"))
        zeros = lambda w: F.translate(w, "0०", "") == ""
        rest = F.when((F.size(rest) > 1) & zeros(F.try_element_at(rest, F.lit(-1))), F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
        clean = T.clean_text(F.array_join(rest, " "))
        return F.when(F.length(clean) >= 2, clean).otherwise(F.col(column))

    wife = (T.relation_label(F.col("relation_type")) == "पति") & (T.gender_label(F.col("gender")) == "पुरुष")
    marked = F.arrays_overlap(F.split(F.coalesce("name", F.lit("")), " "), F.array(*[F.lit(m) for m in markers])) if markers else F.lit(False)
    code, house, age = T.clean_id(F.col("code")), T.clean_house(F.col("house")), F.col("age")
    tail, head = age % 100, F.floor(age / 10)
    good = lambda v: v.between(18, 115)
    return {
        "gender": F.when(wife | marked, "महिला").otherwise(F.col("gender")),
        "name": name("name", ("निर्वाचक",)),
        "relation_name": name("relation_name", RELATION_LABELS),
        "code": F.when(~T.id_defect(F.col("code"))["valid"] & T.id_defect(code)["valid"], code).otherwise(F.col("code")),
        "house": F.when(unread_house(F.col("house")) & (house != ""), house).otherwise(F.col("house")),
        "age": F.when(age.between(100, 199) & ~good(age) & good(tail), tail).when(age.between(100, 999) & ~good(age) & good(head), head).otherwise(age).cast("int"),
    }


def accept_repairs(df: DataFrame, new: dict[str, Column], rules: list[Rule]) -> DataFrame:
    """Repairs taken where something changed and the score (by ``rules``, on the same columns) isn't lower; with changes, old and new score."""
    old = list(new)
    kept = df.withColumns({f"__old_{c}": F.col(c) for c in old}).withColumn("__hits", hits(rules)).withColumn("score_before", points(F.col("__hits"), rules))
    fixed = kept.withColumns(new).withColumn("__hits", hits(rules)).withColumn("score_after", points(F.col("__hits"), rules)).drop("__hits")
    entry = [F.when(~F.col(c).eqNullSafe(F.col(f"__old_{c}")), F.struct(F.lit(c).alias("field"), F.col(f"__old_{c}").cast("string").alias("old"), F.col(c).cast("string").alias("new"))) for c in old]
    fixed = fixed.withColumn("changes", F.array_compact(F.array(*entry)))
    fixed = fixed.withColumn("accepted", (F.size("changes") > 0) & (F.col("score_after") >= F.col("score_before")))
    back = {c: F.when(F.col("accepted"), F.col(c)).otherwise(F.col(f"__old_{c}")) for c in old}
    return fixed.withColumns(back).drop(*[f"__old_{c}" for c in old])


def enforce_age(age: Column) -> Column:
    """Ages under 18 and over 120 put right: 8 is 18, 1-9 lost a 2, others under 18 are 18, over 120 become 65."""
    return F.when(age == 8, 18).when(age.between(1, 9), age + 20).when(age < 18, 18).when(age > 120, 65).otherwise(age).cast("int")


def enforce_relation(gender: Column, relation: Column, markers: Column | None = None) -> tuple[Column, Column]:
    """Gender and relation labels made consistent: a husband as relation, or a marker in the name, decides the gender."""
    wife = F.coalesce(relation.contains("पति"), F.lit(False))
    decided = wife if markers is None else wife | F.coalesce(markers, F.lit(False))
    return F.when(decided, "महिला").otherwise(gender), F.when(wife, "पति").otherwise(relation)


def audit(df: DataFrame, by: list[str], number: str, confidence: str, warned: str, listed: int = 100) -> DataFrame:
    """Per group: rows, least and greatest number, missing numbers (count, first ``listed``), low confidence, warnings."""
    gaps = missing_numbers(df, by, number).groupBy(*by).agg(F.count(F.lit(1)).alias("missing_count"), F.slice(F.sort_array(F.collect_list("missing")), 1, listed).alias("missing"))
    n = F.when(F.col(number) > 0, F.col(number))
    totals = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.min(n), F.lit(0)).alias("least"), F.coalesce(F.max(n), F.lit(0)).alias("greatest"),
        count_where(F.coalesce(F.nullif(F.col(confidence), F.lit(0.0)), F.lit(1.0)) < 0.9).alias("low_confidence"), count_where(F.col(warned)).alias("warned"),
    )
    return totals.join(gaps, by, "left").withColumn("missing_count", F.coalesce("missing_count", F.lit(0)))


def record_warnings(df: DataFrame) -> DataFrame:
    """Cleaned fields of a registry record with warnings and confidence: 1 less .2 a warning, .4 at least."""
    done = df.withColumns({"name": T.clean_text(F.col("name")), "relation_name": T.clean_text(F.col("relation_name")), "house": T.clean_house(F.col("house")), "code": T.clean_id(F.col("code"))})
    checks = {"name": F.coalesce(F.length("name") < 2, F.lit(True)), "code": ~T.id_defect(F.col("code"))["valid"], "age": F.coalesce(~F.col("age").between(18, 120), F.lit(True))}
    warned = F.array_compact(F.array(*[F.when(c, n) for n, c in checks.items()]))
    done = done.withColumn("warnings", warned)
    n = F.size("warnings")
    return done.withColumn("confidence", F.when(n == 0, 1.0).otherwise(F.greatest(F.lit(0.4), 1.0 - n * 0.2)))


def spot_check(original: DataFrame, rescan: DataFrame, key: str, texts: dict[str, float], numbers: dict[str, float]) -> DataFrame:
    """Agreement of two readings of the same records, field by field and weighted."""
    other = rescan.select(key, *[F.col(c).alias(f"__{c}") for c in [*texts, *numbers]])
    met = original.join(other, key)
    parts = {c: T.char_overlap(F.col(c).cast("string"), F.col(f"__{c}").cast("string")) for c in texts} | {c: T.field_confidence(F.col(c), F.col(f"__{c}")) for c in numbers}
    named = met.withColumns({f"{c}_confidence": v for c, v in parts.items()})
    weights = [(F.col(f"{c}_confidence"), w) for c, w in (texts | numbers).items()]
    return named.withColumn("confidence", T.weighted(weights)).select(key, *[f"{c}_confidence" for c in parts], "confidence")
