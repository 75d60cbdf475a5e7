"""Writes as snapshots: upserts, overlays, bulk updates, deletes, pending edits. Each returns the new state; sinks write it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import textkeys as T
from ledgerlark.operators.resolve import cut


def upsert(current: DataFrame, delta: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the delta's last by ``order`` if it has the key, else the current one (insert ... on conflict do update)."""
    columns = current.columns
    both = current.select(*columns, F.lit(0).alias("__new"), F.lit(None).cast(delta.schema[order].dataType).alias("__at"))
    both = both.unionByName(delta.select(*columns, F.lit(1).alias("__new"), F.col(order).alias("__at")))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc("__at")))
    return both.withColumn("__n", n).where("__n = 1").select(*columns)


def identity_matches(current: DataFrame, batch: DataFrame, current_id: str, batch_id: str, rules: list[tuple[list[tuple[Column, Column]], Column | None]]) -> DataFrame:
    """Which current row each batch row is: batch_id, current_id, rule (from 1).

    The rules are applied one after the other to the batch rows and current rows that are left: each batch row names the least current
    id that fits, and of several that name one the least batch id gets it. A batch row that loses a target goes on to the next rule,
    and is an insert after the last.
    """
    done = None
    for k, (keys, more) in enumerate(rules, 1):
        free, open_ = (current, batch) if done is None else (current.join(done.select(current_id), current_id, "left_anti"), batch.join(done.select(batch_id), batch_id, "left_anti"))
        on = reduce(lambda a, b: a & b, [a == b for a, b in keys])
        named = open_.join(free, on if more is None else on & more).groupBy(batch_id).agg(F.min(current_id).alias(current_id))
        won = named.groupBy(current_id).agg(F.min(batch_id).alias(batch_id)).select(batch_id, current_id, F.lit(k).alias("rule"))
        done = won if done is None else done.unionByName(won)
    return done


def merge_columns(new: Column, old: Column, policy: str) -> Column:
    """A column's value after an update. keep: new unless null; sticky: a flag once set stays; protect: old unless null; replace: new."""
    return {
        "keep": F.coalesce(new, old), "sticky": F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False)), "protect": F.coalesce(old, new), "replace": new,
    }[policy]


def apply_matches(current: DataFrame, batch: DataFrame, matches: DataFrame, current_id: str, batch_id: str, policies: dict[str, str]) -> DataFrame:
    """The new state: matched rows updated column by column by their policy, unmatched batch rows inserted.

    An inserted row's id is the greatest current id plus its batch id (a positive number), so no task has to count all inserts.
    """
    columns = list(policies)
    src = batch.join(matches, batch_id, "left").select(current_id, F.lit(True).alias("__hit"), F.col(batch_id).alias("__b"), *[F.col(c).alias(f"__n_{c}") for c in columns])
    updated = current.join(src.where(F.col(current_id).isNotNull()), current_id, "left")
    hit = F.coalesce("__hit", F.lit(False))
    updated = updated.select(current_id, *[F.when(hit, merge_columns(F.col(f"__n_{c}"), F.col(c), p)).otherwise(F.col(c)).alias(c) for c, p in policies.items()])
    last = current.agg(F.coalesce(F.max(current_id), F.lit(0)).alias("__last"))
    fresh = src.where(F.col(current_id).isNull()).join(F.broadcast(last))  # one row
    new_id = (F.col("__last") + F.col("__b")).cast("long").alias(current_id)
    return updated.unionByName(fresh.select(new_id, *[F.col(f"__n_{c}").alias(c) for c in columns]))


def bulk_update(df: DataFrame, condition: Column | None, values: dict[str, Column], allowed: set[str]) -> DataFrame:
    """Values set where the condition holds; only allowed columns, and never without a condition."""
    if condition is None or not set(values) <= allowed:
        raise ValueError("a bulk update needs a condition and may set allowed columns only")
    met = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(met, v).otherwise(F.col(c)) for c, v in values.items()})


def update_by_file(df: DataFrame, file: str, name: str, group: Column, values: dict[str, Column]) -> DataFrame:
    """Update of a file's rows (by name or its ending); only if there are none, of the group's rows."""
    mine = (F.col(file) == name) | F.col(file).endswith(name)
    return bulk_update(df, mine if not df.where(mine).isEmpty() else group, values, set(values))


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")


def replace_by(df: DataFrame, fresh: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the keys that ``fresh`` has are replaced by it (reload of a source file)."""
    return df.join(fresh.select(*by).distinct(), by, "left_anti").unionByName(fresh)


def backfill(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in values.items()})


def with_search_keys(df: DataFrame, name: str, relation: str) -> DataFrame:
    """Derived search columns recomputed from the names."""
    n, r = T.fold_devanagari(F.col(name)), T.fold_devanagari(F.col(relation))
    return df.withColumns({"name_normalized": n, "name_phonetic": T.phonetic_key(n), "rel_normalized": r, "rel_phonetic": T.phonetic_key(r)})


def set_metadata(df: DataFrame, values: dict[str, str | None], may_blank: set[str] = frozenset()) -> DataFrame:
    """Columns set for all rows; blank values only where that is allowed, null never."""
    return df.withColumns({c: F.lit(v) for c, v in values.items() if v is not None and (v.strip() or c in may_blank)})


def field_diff(old: Column, new: Column) -> Column:
    """map<field, struct<old, new>> of the fields two maps differ in."""
    keys = F.array_union(F.map_keys(old), F.map_keys(new))
    changed = F.filter(keys, lambda k: ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k)))
    return F.map_from_entries(F.transform(changed, lambda k: F.struct(k, F.struct(F.try_element_at(old, k).alias("old"), F.try_element_at(new, k).alias("new")))))


def apply_pending(df: DataFrame, edits: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Approved edits (edit_id, action, target_id, proposed map<string,string>) applied: the latest update or delete of a target, then adds."""
    approved = edits.where("status = 'approved'")
    last = approved.where("action IN ('UPDATE', 'DELETE')").groupBy("target_id").agg(F.max_by(F.struct("action", "proposed"), "edit_id").alias("e"))
    met = df.join(last, F.col(key) == F.col("target_id"), "left").where(F.coalesce(F.col("e.action"), F.lit("")) != "DELETE")
    kinds = {c: df.schema[c].dataType for c in columns}
    done = met.withColumns({c: F.coalesce(F.try_element_at("e.proposed", F.lit(c)).try_cast(k), F.col(c)) for c, k in kinds.items()}).select(*df.columns)
    adds = approved.where("action = 'ADD'").select(*[F.try_element_at("proposed", F.lit(c)).try_cast(df.schema[c].dataType).alias(c) for c in df.columns])
    return done.unionByName(adds)


def _proposed(entries: Column, field: str) -> Column:
    return F.get(F.filter(entries, lambda p: p["key"] == field), F.lit(0))["value"]


def _predicate_paths(starts: DataFrame, bulk: DataFrame, match_on: str) -> DataFrame:
    """part, since, log: the predicate edits that a row which has ``part`` from edit ``since`` on runs into, in order, as edits rename its part.

    Rows don't come into it, only their distinct starts. A round follows all paths up to their next rename.
    """
    logs = bulk.groupBy("match").agg(F.sort_array(F.collect_list(F.struct("edit_id", "proposed_"))).alias("all"))
    front, parts = starts.select("part", "since", F.col("part").alias("now"), F.col("since").alias("at")), []
    while True:
        renames = lambda x: F.coalesce(_proposed(x["proposed_"], match_on) != F.col("now"), F.lit(False))
        met = front.join(logs, F.col("now") == F.col("match")).withColumn("later", F.filter("all", lambda x: x["edit_id"] > F.col("at")))
        met = met.withColumn("upto", F.array_position(F.transform("later", renames), True))
        met = met.withColumn("run", F.when(F.col("upto") > 0, F.slice("later", F.lit(1), F.col("upto").cast("int"))).otherwise(F.col("later")))
        step = cut(met.where(F.size("run") > 0).select("part", "since", "run", (F.col("upto") > 0).alias("renamed")), "edit-paths")
        parts.append(step.select("part", "since", F.explode("run").alias("e")))
        last = F.element_at("run", -1)
        front = step.where("renamed").select("part", "since", _proposed(last["proposed_"], match_on).alias("now"), last["edit_id"].alias("at"))
        if front.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts).groupBy("part", "since").agg(F.sort_array(F.collect_list("e")).alias("log"))


def replay_edits(df: DataFrame, edits: DataFrame, key: str, match_on: str, columns: list[str]) -> DataFrame:
    """``df`` after all approved edits, as if each had been applied to the rows as they were then, in the order of edit_id.

    edits: edit_id (unique, but for a BULK edit, which comes before the other edits of its number), action, target_id, match, proposed (map of texts), status. UPDATE sets the proposed fields of its target, null too;
    DELETE removes it for good; ADD inserts a row of the proposed fields; BULK sets the proposed fields, blank ones aside, of all rows whose
    ``match_on`` equals ``match`` at that time, rows added before included, and may change ``match_on`` itself. Values that don't fit their column's type become null.
    Only ``columns`` change, ``match_on`` should be among them. Added rows are met by BULK edits only. ``key`` is unique; unknown targets are ignored.

    No edit is applied row by row: each field takes its last writer among the edits of its key and the predicate edits on its way. That way is the same for
    all rows that start with one value, so it is followed once for each, and again from each edit of a key that sets ``match_on``.
    """
    approved = edits.where("status = 'approved'")
    filled = F.filter(F.map_entries("proposed"), lambda p: p["key"].isin(*columns) & (F.trim(p["value"]) != ""))
    bulk = approved.where("action = 'BULK'").select("edit_id", F.col("match").cast("string").alias("match"), filled.alias("proposed_"))
    sets = approved.where("action = 'UPDATE'").select("target_id", "edit_id", F.explode("proposed").alias("field", "value")).where(F.col("field").isin(*columns))
    turns = sets.where(F.col("field") == match_on).select("target_id", F.col("value").alias("part"), F.col("edit_id").alias("since"))
    turns = turns.withColumn("until", F.lead("since").over(Window.partitionBy("target_id").orderBy("since")))
    adds = approved.where("action = 'ADD'")
    added = adds.select(*[F.try_element_at("proposed", F.lit(c)).try_cast(df.schema[c].dataType).alias(c) for c in df.columns], F.col("edit_id").alias("__since"))
    gone = approved.where("action = 'DELETE'").select(F.col("target_id").alias(key)).distinct()
    rows = df.join(gone, key, "left_anti").withColumn("__since", F.lit(0).cast("long")).withColumn("__key", F.col(key))
    rows = rows.unionByName(added.withColumn("__key", F.lit(None).cast(df.schema[key].dataType)))
    part = F.col(match_on).cast("string")
    starts = rows.select(part.alias("part"), F.col("__since").alias("since")).unionByName(turns.select("part", "since")).where("part IS NOT NULL").distinct()
    paths = cut(_predicate_paths(cut(starts, "edit-starts"), cut(bulk, "bulk-edits"), match_on), "edit-logs")
    later = turns.join(paths, ["part", "since"]).select("target_id", "until", F.explode("log").alias("e")).where(F.col("until").isNull() | (F.col("e.edit_id") <= F.col("until")))
    later = later.select("target_id", F.col("e.edit_id").alias("edit_id"), F.inline("e.proposed_").alias("field", "value"))
    both = sets.withColumn("own", F.lit(True)).unionByName(later.withColumn("own", F.lit(False)))
    last = both.groupBy("target_id", "field").agg(F.max(F.struct("edit_id", "own", "value")).alias("w"))
    by_key = last.groupBy(F.col("target_id").alias("__key")).agg(F.map_from_entries(F.collect_list(F.struct("field", "w"))).alias("__last"))
    by_key = by_key.join(turns.groupBy(F.col("target_id").alias("__key")).agg(F.min("since").alias("__turn")), "__key", "left")
    met = rows.join(by_key, "__key", "left").join(paths.withColumnsRenamed({"part": "__part", "since": "__from", "log": "__log"}), (part == F.col("__part")) & (F.col("__since") == F.col("__from")), "left")
    met = met.withColumn("__log", F.filter("__log", lambda e: F.col("__turn").isNull() | (e["edit_id"] <= F.col("__turn"))))

    def newest(column: str) -> Column:
        wrote = F.filter(F.transform("__log", lambda e: F.struct(e["edit_id"].alias("edit_id"), _proposed(e["proposed_"], column).alias("value"))), lambda e: e["value"].isNotNull())
        way = F.try_element_at(wrote, F.lit(-1))
        own = F.try_element_at("__last", F.lit(column))
        mine = F.coalesce(own["edit_id"] >= way["edit_id"], own.isNotNull())
        value = F.when(mine, own["value"]).otherwise(way["value"])
        return F.when(own.isNull() & way.isNull(), F.col(column)).otherwise(value.try_cast(df.schema[column].dataType))

    return met.withColumns({c: newest(c) for c in columns}).select(*df.columns)


def pending_counts(edits: DataFrame) -> DataFrame:
    return edits.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "approved", "rejected")])


def with_pending_adds(df: DataFrame, adds: DataFrame, key: str) -> DataFrame:
    """An operator's pending adds shown as rows with the id pending_<id>."""
    shown = adds.withColumn(key, F.concat(F.lit("pending_"), F.col(key).cast("string")))
    return df.withColumn(key, F.col(key).cast("string")).unionByName(shown, allowMissingColumns=True)


def route(changes: DataFrame, role: str = "role") -> tuple[DataFrame, DataFrame]:
    """Changes by who makes them: (applied at once: administrators', kept pending: everyone else's)."""
    admin = F.coalesce(F.col(role) == "admin", F.lit(False))
    return changes.where(admin), changes.where(~admin)


def link_key(family: Column, member: Column) -> Column:
    return F.concat_ws("_", family, member)


def patch_array(array: Column, match, change) -> Column:
    """An array of structs in which those that ``match`` are changed."""
    return F.transform(array, lambda m: F.when(match(m), change(m)).otherwise(m))
