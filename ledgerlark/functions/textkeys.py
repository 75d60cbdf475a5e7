"""Scalar text functions as Column builders: folding, phonetic keys, field cleaning and validation.

All are built-in expressions, so they stay inside whole-stage code generation and can be pushed below shuffles. Null input
gives null unless a docstring says otherwise.
"""

from __future__ import annotations

import itertools
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Devanagari digits and their ASCII counterparts.
DEVANAGARI_DIGITS = "०१२३४५६७८९"
ASCII_DIGITS = "0123456789"

# Letters and vowel signs that are read alike, the second of each pair stands for both.
ALIKE_SIGNS = {"ू": "ु", "ि": "ी", "ै": "े", "ौ": "ो", "ऊ": "उ", "इ": "ई", "ऐ": "ए", "औ": "ओ", "ँ": "ं"}
ALIKE_CONSONANTS = {"ण": "न", "श": "स", "ष": "स", "ब": "व", "\u0958": "क", "\u0959": "ख", "\u095a": "ग", "\u095b": "ज", "\u095c": "ड", "\u095d": "ढ", "\u095e": "फ", "\u0931": "र"}
# Signs that are dropped (visarga, nukta, zero-width characters).
DROPPED_SIGNS = "\u0903\u093c\u200c\u200d\ufeff"
# Conjuncts and how they are spelt instead, in order.
CONJUNCTS = (("ज्ञ", "ग्य"), ("क्ष", "छ"), ("ऋ", "रि"))

# The Latin letter a Devanagari character sounds like.
SOUNDS = {
    "क": "k", "ख": "k", "ग": "g", "घ": "g", "ङ": "n", "ज": "j", "झ": "j", "ञ": "n", "ट": "t", "ठ": "t", "ड": "d", "ढ": "d", "ण": "n",
    "त": "t", "थ": "t", "द": "d", "ध": "d", "न": "n", "प": "p", "फ": "p", "ब": "b", "भ": "b", "म": "m", "य": "y", "र": "r", "ल": "l",
    "व": "v", "श": "s", "ष": "s", "स": "s", "ह": "h", "ं": "n", "ँ": "n", "अ": "a", "आ": "a", "ा": "a", "इ": "i", "ई": "i", "ि": "i",
    "ी": "i", "उ": "u", "ऊ": "u", "ु": "u", "ू": "u", "ए": "e", "ऐ": "e", "े": "e", "ै": "e", "ओ": "o", "औ": "o", "ौ": "o", "ो": "o",
}
# Pairs of Latin letters that sound like one, in order.
DIGRAPHS = (("ee", "i"), ("oo", "u"), ("aa", "a"), ("sh", "s"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("ph", "p"), ("kh", "k"), ("gh", "h"), ("ch", "c"))
# Consonants of one sound class.
SOUND_CLASSES = {"S": "sz", "B": "bvwp", "K": "kcqg", "D": "td", "N": "nm", "R": "r", "L": "l", "H": "h", "J": "j"}

# Words that tell the gender or relation label, first match counts; the last label is the default.
GENDER_WORDS = (("महिला", ("महिला", "स्त्री", "f", "औरत", "म०")), ("अन्य", ("अन्य", "तृतीय", "t", "o")), ("पुरुष", ()))
RELATION_WORDS = (
    ("पति", ("पति", "husband", "Husband", "हसबैंड")),
    ("माता", ("माता", "mother", "Mother", "माँ")),
    ("अन्य", ("संरक्षक", "अभिभावक", "guardian", "Guardian", "अन्य")),
    ("पिता", ()),
)
# Texts that stand for an id that is not there.
ID_PLACEHOLDERS = (
    "DELETED", "PHOTO", "UNKNOWN", "AVAILABLE", "NOEPIC", "PENDING", "ABSENT", "SHIFTED", "VILOPIT", "DUPLICATE", "NOTAVAILABLE", "NIL",
)
# House numbers that say nothing.
GENERIC_HOUSES = ("", "0", "00", "000", "0000", "--", "-", "na", "n/a", "unknown", "०", "००", "उपलब्ध", "नहीं", "none", "null", "nd")
# Titles before a name.
HONORIFICS = ("श्री", "श्रीमती", "कु०", "कु0", "कुमारी", "मो०", "मो0", "मोहम्मद", "डॉ०", "डा०", "डा0", "डॉ0", "स्व०", "स्व0", "ला०", "ला0")
# Format of an id: three letters and seven digits, or parts with slashes.
MODERN_ID = r"^[A-Z]{3}[0-9]{7}$"
SLASH_ID = r"^[A-Z]{2}/\d{1,3}/\d{1,4}/\d{3,8}$"
# Words that mark a deleted record, found with spaces between their letters too.
DELETION_WORDS = ("deleted", "deleto", "delet", "विलोपित", "विलेपित", "निरस्त")
# Words that mark one where they stand alone.
LONE_DELETION_WORDS = ("belete", "beleted", "pelete", "peleted", "vilopit", "cancel", "cancelled")
# Characters that are noise at either end of a name.
EDGE_NOISE = r"[\s:\-–—.*|]+"


def _fold(text: Column, rules) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), rules, text)


def collapse(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def digits_to_ascii(text: Column) -> Column:
    return F.translate(text, DEVANAGARI_DIGITS, ASCII_DIGITS)


def fold_devanagari(text: Column) -> Column:
    """Spelling-tolerant form: signs and consonants that are read alike become one. Input in composed form (NFC)."""
    pairs = ALIKE_SIGNS | ALIKE_CONSONANTS
    # the dropped signs have no counterpart, so translate() deletes them
    folded = F.translate(text, "".join(pairs) + DROPPED_SIGNS, "".join(pairs.values()))
    return collapse(reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), CONJUNCTS, folded))


def phonetic_key(text: Column) -> Column:
    """Sound classes of each word, separated by spaces: the first sound, then consonant classes without repeats."""
    latin = F.translate(F.lower(text), "".join(SOUNDS), "".join(SOUNDS.values()))
    latin = F.regexp_replace(F.regexp_replace(F.regexp_replace(latin, "[चछ]", "ch"), "ऋ", "ri"), r"[^a-z\s]", "")
    words = F.filter(F.split(F.trim(F.regexp_replace(latin, r"\s+", " ")), " "), lambda w: w != "")
    return F.array_join(F.filter(F.transform(words, _word_key), lambda k: k.isNotNull()), " ")


def _word_key(word: Column) -> Column:
    letters = "".join(SOUND_CLASSES.values())
    classes = "".join(k * len(v) for k, v in SOUND_CLASSES.items())
    w = F.regexp_replace(_fold(word, DIGRAPHS), "^[aeiouy]", "A")
    w = F.translate(w, letters + "aeiouyfx", classes + "VVVVVV")
    w = F.regexp_replace(w, r"(.)\1+", "$1")
    return F.concat(F.substring(w, 1, 1), F.replace(F.substring(w, 2, 1_000_000), F.lit("V"), F.lit("")))


def clean_text(text: Column) -> Column:
    """Noise signs cut from both ends, white space collapsed."""
    return collapse(_fold(text, ((r"[\r\n\t]+", " "), (f"^{EDGE_NOISE}", ""), (f"{EDGE_NOISE}$", ""))))


def _label(text: Column, words, default: str) -> Column:
    out = F.lit(default)
    for label, own in reversed([w for w in words if w[1]]):
        out = F.when(reduce(lambda a, b: a | b, [text.contains(w) for w in own]), label).otherwise(out)
    return out


def gender_label(text: Column) -> Column:
    """One of three labels by the first vocabulary that the text contains; null and unknown texts take the last."""
    return _label(F.coalesce(F.lower(clean_text(text)), F.lit("")), GENDER_WORDS, GENDER_WORDS[-1][0])


def relation_label(text: Column) -> Column:
    return _label(F.coalesce(clean_text(text), F.lit("")), RELATION_WORDS, RELATION_WORDS[-1][0])


def id_defect(text: Column) -> Column:
    """struct<valid, type, length> of an id: which format it has, or the first thing wrong with it."""
    t = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    n = F.length(t)
    kind = (
        F.when(n == 0, "MISSING")
        .when(t.contains("/"), F.when(t.rlike(SLASH_ID), "LEGACY_VALID").otherwise("INVALID_SLASH"))
        .when(t.rlike("[^A-Z0-9]"), "NOISE_SYMBOLS")
        .when(n < 10, "TOO_SHORT")
        .when(n > 10, "TOO_LONG")
        .when(~t.rlike("^[A-Z]{3}"), "INVALID_PREFIX")
        .when(~t.rlike("[0-9]{7}$"), "INVALID_DIGITS")
        .otherwise("STANDARD_VALID")
    )
    return F.struct(kind.isin("LEGACY_VALID", "STANDARD_VALID").alias("valid"), kind.alias("type"), n.alias("length"))


# The head of a slashed id whose own is unreadable; digits that letters are misread for, in the digits and as a fourth letter.
DEFAULT_HEAD = "UP"
READ_AS_DIGITS = ("OIL|", "0111")
FOURTH_AS_DIGIT = ("OILZBSG", "0112856")


def clean_id(text: Column, known_prefixes: tuple[str, ...] = ()) -> Column:
    """The id in a noisy text; empty if there is none.

    In this order: three letters and seven digits as a word; four parts with slashes (bars, colons and backslashes count as such, but
    then and where the first part isn't two letters the head is DEFAULT_HEAD); two to four letters and digits some of which are misread.
    Of four letters the fourth is a digit if that makes seven, and the first is noise if the rest is one of known_prefixes.
    """
    raw = F.upper(F.coalesce(text, F.lit("")))
    bare = F.translate(raw, "¥'`\" ~", "Y")
    word = F.regexp_extract_all(raw, F.lit(r"(?<![A-Z0-9_])[A-Z]{3}[\s_-]*[0-9]{7}(?![A-Z0-9_])"), F.lit(0))
    plain = F.regexp_replace(F.try_element_at(word, F.lit(1)), r"[\s_-]", "")

    def slashed(t: Column, own_head: bool) -> Column:
        runs = F.transform(F.regexp_extract_all(t, F.lit(r"[A-Z0-9]+(?:/[0-9]+){3}"), F.lit(0)), lambda r: F.split(r, "/"))
        fits = lambda p: (F.length(p[1]) <= 4) & (F.length(p[2]) <= 4) & F.length(p[3]).between(3, 8)
        two = lambda p: F.regexp_extract(p[0], "[A-Z]{2}$", 0)
        if own_head:
            runs = F.filter(runs, lambda p: fits(p) & (two(p) != "") & (F.length(p[1]) <= 3))
        else:
            runs = F.filter(runs, fits)
        p = F.try_element_at(runs, F.lit(1))
        head = two(p) if own_head else F.lit(DEFAULT_HEAD)
        return F.concat_ws("/", head, p[1], p[2], F.substring(p[3], 1, 8)), p.isNotNull()

    pieces = F.regexp_extract_all(F.regexp_replace(bare, r"[._-]", ""), F.lit(r"[A-Z]{2,4}[0-9OIL|]{5,9}"), F.lit(0))
    piece = F.try_element_at(pieces, F.lit(1))
    letters = F.regexp_extract(piece, r"^[A-Z]{2,4}(?=[0-9OIL|]{5})", 0)
    digits = F.translate(F.rtrim(F.substr(piece, F.length(letters) + 1), F.lit("|")), *READ_AS_DIGITS)
    first, fourth = F.substring(letters, 1, 3), F.translate(F.substring(letters, 4, 1), *FOURTH_AS_DIGIT)
    four = F.length(letters) == 4
    known = four & F.substring(letters, 2, 3).isin(*known_prefixes) if known_prefixes else F.lit(False)
    misread = F.when(known, F.concat(F.substring(letters, 2, 3), digits)).when(four & fourth.between("0", "9") & (F.length(digits) == 6), F.concat(first, fourth, digits))
    (own, has_own), (other, has_other) = slashed(bare, True), slashed(F.translate(bare, "|\\:", "///"), False)
    return F.coalesce(plain, F.when(has_own, own), F.when(has_other, other), misread, F.concat(letters, digits), F.lit(""))


def has_real_id(text: Column) -> Column:
    """Long enough, no placeholder, with a digit and a letter; null is false."""
    t = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    return (F.length(t) >= 6) & ~t.isin(*ID_PLACEHOLDERS) & t.rlike(r"\p{Nd}") & t.rlike(r"\p{L}")


# Signs that a digit 1 is misread for in house numbers and ages.
BARS = "।॥|!][Il(){}"
# Words after which nothing belongs to the house number.
HOUSE_STOPS = (
    "आयु", "उम्र", "age", "लिंग", "gender", "mohalla", "ward", "मोहल्ला", "वार्ड", "कॉलोनी", "मार्ग", "गली", "रोड", "सड़क", "नगर", "पोस्ट", "मंदिर", "भवन", "निवास",
)
# Fixed values: "son of" and the like, which leak into the field.
LEAKED_RELATIONS = ("s/o", "w/o", "d/o", "c/o", "एस/ओ", "डब्ल्यू/ओ", "डी/ओ")


def clean_house(text: Column) -> Column:
    """A house number; empty where no digit is left or a relation leaked in. '--' is kept.

    The text is read token by token: digit runs lose leading zeros, and one of zeros only after a number is padding; two numbers in
    a row are parted by a slash; a bar is the digit 1 at the start and after a number, but a slash between two numbers; words
    before the number are labels; a letter or Latin word after it is its part, a longer word ends it, and so do HOUSE_STOPS.
    """
    raw = digits_to_ascii(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "[\u200c\u200d\ufeff]", ""))
    tokens = F.regexp_extract_all(raw, F.lit(r"[0-9]+|[Il]+(?![A-Za-z])|[A-Za-z]+|[\u0904-\u0963\u0970-\u097F]+|[/–-]|[।॥|!\]\[(){}]+"), F.lit(0))
    first, between, end = "\u0001", "\u0002", "\u0003"

    def read(so_far: Column, t: Column) -> Column:
        number = t.rlike("^[0-9]")
        value = F.regexp_replace(F.regexp_replace(t, "^0+(?=[0-9])", ""), "(?<=[1-9])0{3,}$", "")
        bar = F.translate(t, BARS, "") == ""
        after_number, after_sign = so_far.rlike("[0-9]$"), so_far.rlike("[/-]$")
        stop = F.lower(t).isin(*HOUSE_STOPS)
        letter = (F.length(t) == 1) | t.rlike("^[A-Za-z]")
        return (
            F.when(so_far.endswith(end), so_far)
            .when(stop | (~number & ~bar & ~letter & so_far.rlike("[0-9]")), F.concat(so_far, F.lit(end)))
            .when(number & (value == "0") & so_far.rlike("[0-9]"), F.regexp_replace(so_far, "[/-]$", ""))
            .when(number, F.concat(so_far, F.when(after_number, "/").otherwise(""), value))
            .when(t.isin("/", "-", "–"), F.when(after_number | so_far.rlike(r"\p{L}$"), F.concat(so_far, F.translate(t, "–", "-"))).otherwise(so_far))
            .when(bar, F.when(so_far == "", first).when(after_number, F.concat(so_far, F.lit(between))).otherwise(so_far))
            .when(letter & (after_number | after_sign | so_far.endswith(between)), F.concat(so_far, t))
            .otherwise(so_far)
        )

    whole = F.aggregate(tokens, F.lit(""), read)
    whole = F.regexp_replace(F.regexp_replace(whole, f"{between}(?=[0-9])", "/"), f"[{first}{between}]", "1")
    done = F.regexp_replace(whole, f"[/-]*{end}?$", "")
    closed = F.regexp_replace(F.lower(raw), r"\s*/\s*", "/")
    leaked = F.arrays_overlap(F.regexp_extract_all(closed, F.lit(r"[\p{L}\p{M}]+/[\p{L}\p{M}]+"), F.lit(0)), F.array(*[F.lit(w) for w in LEAKED_RELATIONS]))
    return F.when(raw.isin("--", "-", "—", "–"), "--").when(leaked | ~done.rlike("[0-9]"), "").otherwise(done)


def house_key(text: Column) -> Column:
    """What houses are compared by: upper case, ASCII digits, no noise, no leading zeros, no hyphen before a letter."""
    t = digits_to_ascii(F.upper(F.trim(F.coalesce(text, F.lit("")))))
    return _fold(t, ((r"[><+~*|!।॥”\"“'`#?@^&;_\s]+", ""), (r"^0+(?=[1-9])", ""), (r"[-–](?=[A-Z\u0900-\u097F])", "")))


def is_generic_house(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"^[,\s\-–:]+|[,\s\-–:]+$", "")
    return t.isin(*GENERIC_HOUSES) | t.rlike("^0+$")


def serial_number(text: Column) -> Column:
    """All digits of a text as a number; null without any."""
    digits = F.regexp_replace(digits_to_ascii(text.cast("string")), r"\D", "")
    return F.when(digits != "", digits.try_cast("long"))


def compact_house(text: Column) -> Column:
    """Letters, digits, / and - only, ASCII digits, lower case."""
    return F.lower(digits_to_ascii(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}_/\-]", "")))


def join_signs(text: Column) -> Column:
    """Spaces that a scan put around vowel signs removed."""
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), f"[{DROPPED_SIGNS[1:]}]", "")
    return collapse(_fold(t, ((r"\s+([\u093e-\u094f])", "$1"), (r"([\u093e-\u094f])\s+", "$1"))))


def core_first_name(text: Column, titles: tuple[str, ...] = HONORIFICS) -> Column:
    """The first word that is no title; empty if there is none."""
    words = F.split(collapse(F.coalesce(text, F.lit(""))), " ")
    return F.coalesce(F.try_element_at(F.filter(words, lambda w: (w != "") & ~w.isin(*titles)), F.lit(1)), F.lit(""))


def person_name(text: Column, titles: tuple[str, ...] = HONORIFICS) -> Column:
    """A name without signs that are no letters and without titles before it."""
    words = F.split(collapse(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), DROPPED_SIGNS[1:], ""), r"[^\p{L}\p{M}\p{N}_\s]", " ")), " ")
    first = F.coalesce(F.array_position(F.transform(words, lambda w: w.isin(*titles)), F.lit(False)), F.lit(0))
    return F.when(first == 0, "").otherwise(F.array_join(F.slice(words, F.greatest(first.cast("int"), F.lit(1)), F.greatest(F.size(words), F.lit(1))), " "))


def same_person_name(a: Column, b: Column) -> Column:
    """Names equal with titles off, with spaces off, or but for the last word of either; no fuzzy match."""
    x, y = person_name(a), person_name(b)
    bare = lambda t: F.replace(t, F.lit(" "), F.lit(""))
    core = lambda t: F.when(t.contains(" "), F.regexp_replace(t, r"\s+\S+$", "")).otherwise(t)
    same = (x == y) | (bare(x) == bare(y)) | ((x == core(y)) & core(y).contains(" ")) | ((core(x) == y) & core(x).contains(" "))
    return F.coalesce((x != "") & (y != "") & same, F.lit(False))


def are_kin(name_a: Column, rel_a: Column, kind_a: Column, name_b: Column, rel_b: Column, kind_b: Column) -> Column:
    """One names the other as relation, or both name the same parent or spouse. No trait of a person takes part."""
    parent = lambda k: F.when(k.contains("माता"), "m").when(k.contains("पति"), "h").when(k.contains("पिता"), "f")
    shared = same_person_name(rel_a, rel_b)
    pa, pb = parent(F.coalesce(kind_a, F.lit("पिता"))), parent(F.coalesce(kind_b, F.lit("पिता")))
    fits = (pa == pb) | ((pa == "h") & (pb == "f")) | ((pa == "f") & (pb == "h"))
    return same_person_name(rel_a, name_b) | same_person_name(rel_b, name_a) | F.coalesce(shared & fits, F.lit(False))


# Labels before an age, two of them misread; words that follow one.
AGE_LABELS = ("आयु", "उम्र", "age", "arg", "org")
AFTER_AGE = ("लिंग", "gender", "fer", "fem", "male", "pur", "mah")


def age_in(text: Column) -> Column:
    """The age (18-120) a text states: after a label, or two digits before a gender word; bars and letters in it are read as digits.

    Above 120 a closing 11 is a bar read twice. Single digits lost their second: 9 is 19, 2 to 8 end in 1.
    """
    low = F.lower(text)
    labelled = F.regexp_extract(low, f"(?:{'|'.join(AGE_LABELS)})\\W{{0,3}}?([0-9०-९।॥|!/\\]\\[li()o.]+)", 1)
    followed = F.regexp_extract(low, f"(?<![0-9])([1-9][0-9])\\s*(?:{'|'.join(AFTER_AGE)})", 1)
    stated = F.coalesce(F.nullif(labelled, F.lit("")), F.nullif(followed, F.lit("")))
    read = F.translate(digits_to_ascii(F.replace(stated, F.lit("॥"), F.lit("11"))), "।|!/][li()o", "11111111110")
    n = F.try_element_at(F.regexp_extract_all(read, F.lit("[0-9]+"), F.lit(0)), F.lit(1)).try_cast("int")
    n = F.when((n > 120) & (n % 100 == 11), F.floor(n / 10).cast("int")).otherwise(n)
    return F.when(n.between(18, 120), n).when(n == 9, 19).when(n.between(2, 8), n * 10 + 1).cast("int")


def is_marked_deleted(text: Column) -> Column:
    """Whether a word of the lists above is in the text, however it is spaced or cased."""
    low = F.lower(text)
    closed = F.regexp_replace(low, r"\s+", "")
    spaced = reduce(lambda a, b: a | b, [closed.contains(w) for w in DELETION_WORDS])
    alone = F.arrays_overlap(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0)), F.array(*[F.lit(w) for w in LONE_DELETION_WORDS]))
    return F.coalesce(spaced | alone, F.lit(False))


def leading_int(text: Column) -> Column:
    """Number at the start of a text, 0 without one, as loosely typed databases cast it."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def natural_key(text: Column) -> Column:
    """Sort key in which runs of digits compare as numbers (up to 20 digits)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 20, "0")).otherwise(r)), "\u0001")


def char_overlap(a: Column, b: Column) -> Column:
    """Share of the characters of ``a`` that ``b`` has, of the longer text's length."""
    x, y = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    common = F.size(F.filter(F.split(x, ""), lambda c: (c != "") & (F.instr(y, c) > 0)))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 1.0).when((F.length(x) == 0) | (F.length(y) == 0), 0.3).when(x == y, 1.0).otherwise(common / longest)


def field_confidence(a: Column, b: Column) -> Column:
    """Agreement of two numbers: 1 if equal, .9 if one apart, else falling by .05 a unit; .3 if one is missing."""
    apart = F.abs(a - b)
    return (
        F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.3).when(apart == 0, 1.0).when(apart <= 1, 0.9).otherwise(F.greatest(F.lit(0.1), 1.0 - apart * 0.05))
    )


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of confidences; weights needn't sum to one."""
    return reduce(lambda x, y: x + y, [c * F.lit(w) for c, w in parts]) / F.lit(sum(w for _, w in parts))


def rewrite(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Ordered pattern replacements, then clean_text()."""
    return clean_text(_fold(text, rules))


def duration_label(seconds: Column, second: str = "s", minute: str = "min") -> Column:
    """Seconds under a minute (one decimal unless whole), minutes and seconds above."""
    s = F.greatest(F.coalesce(seconds.cast("double"), F.lit(0.0)), F.lit(0.0))
    tenth = F.floor(s * 10 + 0.5) / 10
    whole = F.floor(tenth).cast("long")
    short = F.when(tenth == whole, F.format_string(f"%d {second}", whole)).otherwise(F.format_string(f"%.1f {second}", tenth))
    total = F.floor(tenth + 0.5).cast("long")
    m, rest = F.floor(total / 60).cast("long"), total % 60
    long_ = F.when(rest > 0, F.format_string(f"%d {minute} %d {second}", m, rest)).otherwise(F.format_string(f"%d {minute}", m))
    return F.when(tenth < 60, short).otherwise(long_)


def name_parts(text: Column) -> Column:
    """struct<given, family>: the last word of several is the family part; lexicons are the caller's."""
    words = F.split(collapse(text), " ")
    return F.struct(F.element_at(words, 1).alias("given"), F.when(F.size(words) > 1, F.element_at(words, -1)).alias("family"))


# Devanagari signs of Latin letters; vowels as they stand alone and after a consonant.
LATIN_CONSONANTS = {
    "ksh": "क्ष", "gya": "ज्ञ", "gy": "ज्ञ", "sh": "श", "ch": "च", "th": "थ", "dh": "ध", "bh": "भ", "ph": "फ", "kh": "ख", "gh": "घ", "jh": "झ", "tr": "त्र",
    "k": "क", "g": "ग", "c": "क", "j": "ज", "t": "त", "d": "द", "n": "न", "p": "प", "b": "ब", "m": "म", "y": "य", "r": "र", "l": "ल", "v": "व", "w": "व",
    "s": "स", "h": "ह", "z": "ज", "f": "फ",
}
LATIN_VOWELS = {
    "aa": ("आ", "ा"), "ai": ("ऐ", "ै"), "au": ("औ", "ौ"), "ee": ("ई", "ी"), "oo": ("ऊ", "ू"),
    "a": ("अ", ""), "i": ("इ", "ि"), "u": ("उ", "ु"), "e": ("ए", "े"), "o": ("ओ", "ो"),
}
LATIN_SYLLABLE = re.compile(f"({'|'.join(LATIN_CONSONANTS)})?({'|'.join(LATIN_VOWELS)})?")


def word_in_devanagari(word: str, spellings: dict[str, list[str]]) -> list[str]:
    """Devanagari spellings of a Latin word: those known, then the one by sound, and that with the other n where it ends in one. Other words stay."""
    low = word.lower()
    if not re.fullmatch("[a-z]+", low):
        return [word]
    sound, at = "", 0
    while at < len(low):
        found = LATIN_SYLLABLE.match(low, at)
        consonant, vowel = found.groups()
        if consonant:
            sound += LATIN_CONSONANTS[consonant] + (LATIN_VOWELS[vowel][1] if vowel else "")
        elif vowel and at == 0:
            sound += LATIN_VOWELS[vowel][0]
        at = found.end() if consonant or at == 0 and vowel else at + 1
    known = list(spellings.get(low, []))
    if not sound or sound in known:
        return known
    return [*known, sound, *([sound[:-1] + "ण"] if sound[-1] == "न" else [])]


def in_devanagari(term: str, spellings: dict[str, list[str]] | None = None) -> list[str]:
    """Devanagari forms a Latin search term is looked up by too: all of one word, of several words at most five combinations of two a word.

    spellings: known spellings of names in lower case, the caller's. Terms without a Latin letter have none.
    """
    words = term.split()
    if not re.search("[A-Za-z]", term):
        return []
    options = [word_in_devanagari(w, spellings or {}) for w in words]
    if len(words) == 1:
        return options[0]
    return [" ".join(x) for x in itertools.islice(itertools.product(*(o[:2] for o in options if o)), 5)]


def expand_term(term: str) -> dict[str, Column]:
    """Literal columns of the forms a search term is looked up by; evaluated once by the optimizer."""
    return {"exact": F.lit(term), "folded": fold_devanagari(F.lit(term)), "phonetic": phonetic_key(F.lit(term))}
