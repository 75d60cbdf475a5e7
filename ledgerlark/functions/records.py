"""Record-level functions: fields of a record's text, identity of two records, names from households, tagged JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlark.functions import textkeys as T

# Labels before a field in a record's text. Of relations, in order of priority, with the label they stand for.
NAME_LABEL = r"(?:निर्वाचक\s+का\s+नाम|नाम|Name)"
RELATION_LABELS = (("पति", r"(?:पति|Husband)"), ("पिता", r"(?:पिता|Father)"), ("माता", r"(?:माता|Mother)"), ("अन्य", r"(?:अन्य|Other)"))
HOUSE_LABEL = r"(?:मकान|गृह|House)\s*(?:संख्या|सं०|नं०|No\.?|Number)?"
GENDER_LABEL = r"(?:लिंग|Gender|Sex)"
# Fixed value: names that say there is none.
NO_NAME = ("?", "-", "NA", "उपलब्ध नहीं")


def _after(text: Column, label: str) -> Column:
    """What follows a label up to the line's end; null without it."""
    return F.nullif(T.clean_text(F.regexp_extract(text, rf"(?im)^\s*(?:\d{{1,4}}\s+)?{label}(?:\s*का\s+नाम|'s\s+Name)?\s*[:\-–=]+\s*(.+)$", 1)), F.lit(""))


def parse_record(text: Column, place: Column) -> Column:
    """struct of a record's fields from its text, or null where the text is under 10 characters and not marked deleted.

    serial: 1-4 digits the text starts with, else ``place``. Relation: the first label by priority (husband, father, mother,
    other). Gender: the label's, female where the relation is a husband. Deleted records without a name get a placeholder.
    """
    deleted = T.is_marked_deleted(text)
    serial = F.coalesce(F.regexp_extract(text, r"^\s*(\d{1,4})\b", 1).try_cast("int"), place.cast("int"))
    names = [(label, _after(text, p)) for label, p in RELATION_LABELS]
    kind = F.lit(None).cast("string")
    for label, value in reversed(names):
        kind = F.when(value.isNotNull(), label).otherwise(kind)
    gender = F.when(kind == "पति", "महिला").otherwise(T.gender_label(_after(text, GENDER_LABEL)))
    name = F.coalesce(_after(text, NAME_LABEL), F.when(deleted, "विलोपित"))
    fields = F.struct(
        serial.alias("serial_no"), name.alias("name"), kind.alias("relation_type"), F.coalesce(*[v for _, v in names]).alias("relation_name"),
        T.clean_house(_after(text, HOUSE_LABEL)).alias("house_no"), T.age_in(text).alias("age"), gender.alias("gender"),
        T.clean_id(text).alias("code"), deleted.alias("is_deleted"),
    )
    return F.when((F.length(F.trim(text)) >= 10) | deleted, fields)


def same_identity(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Whether two records (name, relation, house, code) can be one person's, so that the new may replace the old."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    on, nn = text(old["name"]), text(new["name"])
    fo, fn = T.fold_devanagari(on), T.fold_devanagari(nn)
    within = lambda a, b: F.coalesce(a.contains(b) | b.contains(a), F.lit(False))
    ro, rn = T.fold_devanagari(text(old["relation"])), T.fold_devanagari(text(new["relation"]))
    co, cn = F.upper(text(old["code"])), F.upper(text(new["code"]))
    ho, hn = text(old["house"]), text(new["house"])
    return (
        (on == "") | on.isin(*NO_NAME) | ((co == cn) & (F.length(co) >= 6)) | (fo == fn) | (within(fo, fn) & (F.least(F.length(fo), F.length(fn)) >= 3))
        | ((ro != "") & (rn != "") & within(ro, rn)) | ((ho != "") & (ho == hn) & ~T.is_generic_house(ho) & (T.phonetic_key(on) == T.phonetic_key(nn)))
    )


def owner_name(members: Column, linked_id: Column, *fallbacks: Column) -> Column:
    """A household's owner: the linked member, else the given columns in order, else a member flagged owner, else self or head."""
    first = lambda test: F.try_element_at(F.filter(members, test), F.lit(1))["name"]
    named = [F.nullif(F.trim(c), F.lit("")) for c in fallbacks]
    head = first(lambda m: F.lower(m["relationship"]).isin("self", "head"))
    return F.coalesce(first(lambda m: m["memberId"] == linked_id), *named, first(lambda m: m["isOwner"]), head)


def relative_name(members: Column, at: Column, head: Column, head_relation: Column) -> Column:
    """The parent's or spouse's name of member ``at`` (from 1) by its relationship to the head; what it states itself where no rule fits.

    Children have the head (a woman's: the head too), a wife the head, siblings and the head the head's relation; a daughter-in-law
    what she states, else the nearest son before her, then after her.
    """
    me = F.element_at(members, at)
    kind = F.lower(F.coalesce(me["relationship"], F.lit("")))
    stated = F.nullif(F.trim(me["fatherHusbandName"]), F.lit(""))
    sons = F.filter(F.transform(members, lambda m, i: F.struct((i + 1).alias("i"), m["name"].alias("name"), F.lower(m["relationship"]).alias("k"))), lambda m: m["k"] == "son")
    before, after = F.filter(sons, lambda s: s["i"] < at), F.filter(sons, lambda s: s["i"] > at)
    son = F.coalesce(F.try_element_at(before, F.lit(-1))["name"], F.try_element_at(after, F.lit(1))["name"])
    return (
        F.when(kind.isin("son", "daughter", "child", "wife"), head)
        .when(kind.isin("self", "head", "brother", "sister"), F.coalesce(head_relation, stated))
        .when(kind == "daughter-in-law", F.coalesce(stated, son))
        .otherwise(stated)
    )


def tagged_value(json: Column) -> Column:
    """The value of a type-tagged JSON object as text: {"stringValue": ..}, {"integerValue": ..}, ...; objects and arrays stay JSON."""
    tags = ("stringValue", "integerValue", "doubleValue", "booleanValue", "timestampValue", "mapValue.fields", "arrayValue.values")
    return F.coalesce(*[F.get_json_object(json, f"$.{t}") for t in tags])
