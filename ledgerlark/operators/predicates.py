"""Search predicates, ranking and paging as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.textkeys import clean_text, expand_term, fold_devanagari, in_devanagari


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def like_folded(column: Column, term: str) -> Column:
    """Substring match without regard to case in which % and _ of the term are wildcards."""
    return column.ilike(f"%{term}%")


def tolerant(term: str, exact: list[Column], folded: list[Column] = (), phonetic: list[Column] = (), codes: list[Column] = ()) -> Column:
    """A term found in a text as it is, in its folded form, by its phonetic key, or in a code without regard to case."""
    forms = expand_term(term)
    tests = [like_folded(c, term) for c in exact]
    tests += [(forms["folded"] != "") & F.coalesce(c.contains(forms["folded"]), F.lit(False)) for c in folded]
    tests += [(forms["phonetic"] != "") & F.coalesce(c == forms["phonetic"], F.lit(False)) for c in phonetic]
    tests += [F.upper(c).contains(term.upper()) for c in codes]
    return any_of([F.coalesce(t, F.lit(False)) for t in tests])


def tri_state(flag: Column, want: str) -> Column:
    """Rows by a flag whose null is false; want: all, active or deleted."""
    marked = F.coalesce(flag.cast("boolean"), F.lit(False))
    return {"all": F.lit(True), "active": ~marked, "deleted": marked}[want]


@dataclass
class SearchSpec:
    """Optional criteria, AND-ed; None, blank and "all" are no filter; range ends count only above zero."""

    equals: dict[str, object] = field(default_factory=dict)
    contains: dict[str, str] = field(default_factory=dict)
    codes: dict[str, str] = field(default_factory=dict)
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    flag: tuple[str, str] | None = None
    extra: list[Column] = field(default_factory=list)

    @staticmethod
    def _is_set(value) -> bool:
        return value is not None and str(value).strip() not in ("", "all")

    def conditions(self) -> list[Column]:
        out = [F.col(c) == v for c, v in self.equals.items() if self._is_set(v)]
        out += [like_folded(F.col(c), v) for c, v in self.contains.items() if self._is_set(v)]
        out += [F.upper(c).contains(v.upper()) for c, v in self.codes.items() if self._is_set(v)]
        for c, (low, high) in self.ranges.items():
            out += [F.col(c) >= low] * bool(low and low > 0) + [F.col(c) <= high] * bool(high and high > 0)
        return out + ([tri_state(F.col(self.flag[0]), self.flag[1])] if self.flag else []) + list(self.extra)

    def column(self) -> Column:
        return all_of(self.conditions())

    def apply(self, df: DataFrame, need_criteria: bool = False) -> DataFrame:
        """Rows that meet the criteria; with ``need_criteria`` none where there is no criterion (public search)."""
        return df.where(F.lit(False) if need_criteria and not self.conditions() else self.column())

    def complement(self, df: DataFrame) -> DataFrame:
        """Rows a delete by these criteria leaves: null counts as not met."""
        return df.where(~F.coalesce(self.column(), F.lit(False)))


def relevance(tests: list[Column]) -> Column:
    """1 for the first test met, 2 for the second, ...; one more than their number if none is."""
    out = F.lit(len(tests) + 1)
    for k, test in reversed(list(enumerate(tests, 1))):
        out = F.when(F.coalesce(test, F.lit(False)), k).otherwise(out)
    return out


def candidate_search(
    people: DataFrame, term: str = "", name: str = "", relation: str = "", code: str = "", spec: SearchSpec | None = None, mapped: DataFrame | None = None, most: int = 40,
    spellings: dict[str, list[str]] | None = None,
) -> DataFrame:
    """The first ``most`` candidates for a mapping, best first: the columns of ``people`` with rank, match_tag and is_mapped.

    people: id, name, relation, code, house, station, part, serial, deleted and the four search keys. term is looked for in all
    fields, name and relation in their own, each as it is, in Devanagari (spellings: see in_devanagari()), folded and by sound, code in codes; these and ``spec`` are AND-ed, and
    without any of them nothing is found. Deleted rows are none. mapped: id of rows that have a mapping; null ids match nothing.

    rank: 1 equal code, 2 name, 3 folded name, 4 sound, 5 part of the code, 6 any other way. match_tag names the way, where a part of
    the code counts before the name and an equal house before "broad"; "filter" where no term, name or code is asked for.
    """
    term, name, relation, code = (x.strip() for x in (term, name, relation, code))
    asked, spec = term or name or code, spec or SearchSpec()
    known = lambda test: F.coalesce(test, F.lit(False))
    holds = lambda c, form: known((form != "") & F.col(c).contains(form))

    def sounds_like(text: str, fields: list[tuple[str, str, str]]) -> Column:
        forms = expand_term(text)
        spelt = in_devanagari(text, spellings)
        variants = lambda c, n: [t for v in spelt for t in (known(F.col(c).contains(v)), holds(n, fold_devanagari(F.lit(v))))]
        return any_of([t for c, n, p in fields for t in (known(like_folded(F.col(c), text)), holds(n, forms["folded"]), holds(p, forms["phonetic"]), *variants(c, n))])

    own, kin = ("name", "name_normalized", "name_phonetic"), ("relation", "rel_normalized", "rel_phonetic")
    criteria = list(spec.conditions())
    if term:
        other = [known(F.upper("code").contains(term.upper())), *(known(like_folded(F.col(c), term)) for c in ("house", "station", "part"))]
        serial = [known(F.col("serial") == F.lit(term).try_cast("long"))] * term.isdecimal()
        criteria.append(any_of([sounds_like(term, [own, kin]), *other, *serial]))
    criteria += [sounds_like(x, [f]) for x, f in ((name, own), (relation, kin)) if x]
    criteria += [F.upper("code").contains(code.upper())] * bool(code)
    found = people.where(~known(F.col("deleted")) & (all_of(criteria) if criteria else F.lit(False)))
    if asked:
        forms = expand_term(asked)
        in_code, named = known(F.upper("code").contains(asked.upper())), known(like_folded(F.col("name"), asked))
        folded, sound = holds("name_normalized", forms["folded"]), holds("name_phonetic", forms["phonetic"])
        rank = relevance([F.upper("code") == asked.upper(), named, folded, sound, in_code])
        ways = [(in_code, "code"), (known(F.col("name").contains(asked)), "name"), (folded, "folded"), (sound, "sound"), (known(F.col("house") == asked), "house")]
        tag = F.coalesce(*[F.when(test, way) for test, way in ways], F.lit("broad"))
    else:
        rank, tag = F.lit(6), F.lit("filter")
    found = found.withColumns({"rank": rank, "match_tag": tag})
    if mapped is None:
        found = found.withColumn("is_mapped", F.lit(False))
    else:
        marks = mapped.select("id").distinct().withColumn("is_mapped", F.lit(True))
        found = found.join(marks, "id", "left").withColumn("is_mapped", known(F.col("is_mapped")))
    return found.orderBy("rank", F.expr("try_cast(part AS long)"), "serial", "id").limit(most)


def page(df: DataFrame, order: list[Column], number: int, size: int, most: int = 5000) -> DataFrame:
    """One page in a total order; the size is clamped to 1..most. End ``order`` with a key."""
    size = max(1, min(size, most))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def deep_page(df: DataFrame, by: str, tie: str, number: int, size: int, descending: bool = False, slack: float = 0.002) -> DataFrame:
    """The rows page() would give for a numeric key ``by`` (null keys last) and a unique ``tie``, reading one range of the key.

    Two approximate quantiles bracket the page's places; the rows below the bracket are counted, so its place is exact, and only the
    bracket is sorted. If the page isn't wholly inside, the bracket is widened, at last to all rows.
    """
    offset, total = (max(1, number) - 1) * max(1, size), df.count()
    known = df.where(F.col(by).isNotNull())
    order = [F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last(), F.col(tie).asc()]
    while offset < total and slack < 1:
        ends = [max(0.0, offset / total - slack), min(1.0, (offset + size) / total + slack)]
        low, high = known.approxQuantile(by, sorted(1 - e for e in ends) if descending else ends, slack / 2) or (None, None)
        if low is None:
            break
        before = F.col(by) > high if descending else F.col(by) < low
        skipped, inside = known.agg(F.count_if(before), F.count_if(F.col(by).between(low, high))).first()
        if skipped <= offset and offset + size <= skipped + inside:
            return known.where(F.col(by).between(low, high)).orderBy(*order).offset(offset - skipped).limit(size)
        slack *= 8
    return df.orderBy(*order).offset(offset).limit(size)


def page_count(total: int, size: int) -> int:
    return max(1, -(-total // size))


def sort_columns(keys: dict[str, list[Column]], key: str, descending: bool, default: str, tie: str) -> list[Column]:
    """Columns of a sort key chosen by name, the default's for unknown ones, with the tie-break last."""
    chosen = keys.get(key, keys[default])
    return [c.desc() if descending else c.asc() for c in chosen] + [F.col(tie).asc()]


def redact(df: DataFrame, columns: list[str], allowed: bool) -> DataFrame:
    """The same columns, nulled unless the reader may see them."""
    return df if allowed else df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in columns})


def without_blocked(df: DataFrame, blocked: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is on no blocklist."""
    return df.join(blocked.select(*on).distinct(), on, "left_anti")


def block_impact(df: DataFrame, blocked: DataFrame, on: list[str]) -> DataFrame:
    """Rows each blocked key hides (0 included)."""
    return blocked.select(*on).distinct().join(df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")), on, "left").na.fill(0, ["n"])


def review_filter(df: DataFrame, warned: str, confidence: str, least: float = 0.9) -> DataFrame:
    return df.where(F.coalesce(F.col(warned), F.lit(False)) | (F.col(confidence) < least))


def is_genuine(name: Column, code: Column, relation: Column, age: Column, house: Column, deleted: Column) -> Column:
    """A real record: marked deleted, or a name with two Devanagari characters and any supporting field."""
    script = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), "[^ऀ-ॿ]", ""))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    support = (F.length(text(code)) >= 5) | (script(relation) >= 2) | F.coalesce(age.between(18, 120), F.lit(False)) | ~text(house).isin("", "--", "-", "—", "0")
    return F.coalesce(deleted, F.lit(False)) | ((script(name) >= 2) & support)


def keyword_class(text: Column, by_name: dict[str, list[str]], least: int = 2, default: str = "other") -> Column:
    """The first class of which a text holds at least ``least`` keywords."""
    low, out = F.lower(text), F.lit(default)
    for name, words in reversed(by_name.items()):
        hits = F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w)))
        out = F.when(hits >= least, name).otherwise(out)
    return out


def purge_reloaded(df: DataFrame, name: str, serial: str, group: list[str], counts: DataFrame) -> DataFrame:
    """After a reload: rows with blank names and rows with a serial above their group's new row count (``counts``: group, n) go."""
    joined = df.join(counts.select(*group, F.col("n").alias("__n")), group, "left")
    keep = (clean_text(F.coalesce(F.col(name), F.lit(""))) != "") & ~F.coalesce(F.col(serial) > F.col("__n"), F.lit(False))
    return joined.where(keep).drop("__n")
