"""Entity resolution: tiered duplicate links, transitive clusters, household-anchored matching, label propagation."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.functions import matchers
from ledgerlark.functions import textkeys as T
from ledgerlark.operators.joins import blocked_pairs
from ledgerlark.operators.nearjoin import alike_pairs

# Confidence of a duplicate link by tier, and the greatest age difference of tiers 2 to 4.
TIER_CONFIDENCE = {1: 100, 2: 98, 3: 95, 4: 88}
TIER_AGE = {2: 4, 3: 4, 4: 3}
# Points of the household-anchored match.
NAME_POINTS = {"equal": 100, "bare": 95, "first": 90, "fuzzy": 85, "sound": 80}
GENDER_POINTS, HOUSE_POINTS, AGE_POINTS = (10, -30), 20, ((3, 15), (6, 8), (10, 0), (15, -15))
FAR_AGE, ACCEPT, EXACT = -35, 68, 100


@cache
def local_scratch() -> str:
    return "file://" + tempfile.mkdtemp(prefix="ledgerlark-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that doesn't exist yet, under the shared checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = local_scratch()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: lineage ends there and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """node, label (least node reachable) of the nodes of ``edges`` (a, b): large-star and small-star rounds until nothing changes."""
    links = cut(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), "links")
    before = None
    while True:
        around = links.unionByName(links.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        top = around.groupBy("lo").agg(F.least(F.min("hi"), F.col("lo")).alias("root"))
        large = around.join(top, "lo").where("hi > lo AND root < hi").select(F.col("root").alias("lo"), "hi").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("root"))
        small = large.join(low, "hi")
        stars = small.select(F.col("root").alias("lo"), "hi").unionByName(small.where("root < lo").select(F.col("root").alias("lo"), F.col("lo").alias("hi")))
        links = cut(stars.distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi"))).collect()[0]
        if now == before:
            break
        before = now
    flat = links.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    return flat.unionByName(flat.select(F.col("label").alias("node"), "label").distinct())


def star_links(df: DataFrame, key: str, block: list[str], tier: int) -> DataFrame:
    """Rows that agree on ``block`` linked to the least key of their block: as many links as rows."""
    least = df.groupBy(*block).agg(F.min(key).alias("a"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return df.join(least, block).where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"), F.lit(tier).alias("tier"))


def value_links(df: DataFrame, key: str, values: list[str], tier: int) -> tuple[DataFrame, DataFrame]:
    """Distinct ``values`` with the least ``key`` that has them, and links of the others to it: copies never make pairs among themselves."""
    reps = df.groupBy(*values).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("__copies"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"d.{c}")) for c in values]
    least = reps.where("__copies > 1").select(F.col(key).alias("a"), *values)
    links = df.alias("d").join(least.alias("r"), reduce(lambda x, y: x & y, same)).where(F.col(f"d.{key}") != F.col("a"))
    return reps.drop("__copies"), links.select("a", F.col(f"d.{key}").alias("b"), F.lit(tier).alias("tier"))


def similar_first_names(names: DataFrame) -> DataFrame:
    """f, g: ordered pairs of different first names (one column, distinct) of a sequence similarity of FIRST_NAME and lengths at most 2 apart."""
    column = names.columns[0]
    near = alike_pairs(names, column, [], matchers.FIRST_NAME, 2, lambda x, y: F.greatest(matchers.similarity_udf(x, y), matchers.similarity_udf(y, x)))
    x, y = F.col(f"x_{column}"), F.col(f"y_{column}")
    both = near.select(x.alias("f"), y.alias("g")).unionByName(near.select(y.alias("f"), x.alias("g")))
    return both.where(matchers.similarity_udf("f", "g") >= matchers.FIRST_NAME)


def duplicate_links(people: DataFrame) -> DataFrame:
    """a, b, tier of duplicate pairs of ``people`` (id, code, name, relation, house, age, gender, place).

    Tier 1: same id. Tier 2: same place and house, similar name and relation, ages near. Tier 3: same
    folded name and relation, ages near. Tier 4: same phonetic keys, similar first name, ages nearer. Genders may not contradict
    (tiers 2 to 4); an age of null or 0 is near any, a null gender agrees with any, null places are one.

    Rows of equal values are linked to the one of the least id, which meets others in their place; a pair is judged in the order of
    these ids. Tier 2 doesn't compare all rows of a house: similar first names are found among the distinct first names of all (segment
    index, see nearjoin), and rows meet by house and first name, a similar first name, or its phonetic key.
    """
    p = people.withColumns({
        "__n": T.fold_devanagari("name"), "__r": T.fold_devanagari("relation"), "__c": F.upper(F.trim("code")), "__h": T.compact_house(F.col("house")),
        "place": F.coalesce("place", F.lit("")),
    })
    p = p.withColumns({"__np": T.phonetic_key(F.col("__n")), "__rp": T.phonetic_key(F.col("__r")), "__f": F.replace(T.core_first_name(F.col("__n")), F.lit(" "), F.lit(""))})
    p = p.withColumn("__fp", T.phonetic_key(F.col("__f")))
    near = lambda t: ~F.coalesce((F.col("x_age") > 0) & (F.col("y_age") > 0) & (F.abs(F.col("x_age") - F.col("y_age")) > TIER_AGE[t]), F.lit(False))
    gender = F.col("x_gender").isNull() | F.col("y_gender").isNull() | (F.col("x_gender") == F.col("y_gender"))
    first = matchers.first_names_match_udf("x___f", "y___f", "x___fp", "y___fp")
    names = matchers.names_match_udf("x___n", "y___n", "x___np", "y___np")
    relations = matchers.relations_match_udf("x___r", "y___r", "x___rp", "y___rp")
    ends = [F.col("x_id").alias("a"), F.col("y_id").alias("b")]
    parts = [star_links(p.where(F.length("__c") >= 5), "id", ["__c"], 1)]

    own = ["age", "gender", "__n", "__r", "__np", "__rp", "__f", "__fp"]
    housed = p.where(~F.col("__h").isin("", "0", "00", "-", "na") & (F.col("__f") != ""))
    reps, copies = value_links(housed, "id", ["place", "__h", *own], 2)
    reps = cut(reps, "housed")
    similar = similar_first_names(reps.select("__f").distinct())
    sided = lambda side: reps.select("place", "__h", *[F.col(c).alias(f"{side}_{c}") for c in ["id", *own]])
    x, y = sided("x"), sided("y")
    keyed = x.where(F.length("x___fp") >= matchers.LEAST_KEY)
    met = [
        x.withColumn("y___f", F.col("x___f")).join(y, ["place", "__h", "y___f"]),
        x.join(similar.select(F.col("f").alias("x___f"), F.col("g").alias("y___f")), "x___f").join(y, ["place", "__h", "y___f"]),
        keyed.withColumn("y___fp", F.col("x___fp")).join(y, ["place", "__h", "y___fp"]),
    ]
    columns = [f"{side}_{c}" for side in "xy" for c in ["id", *own]]
    pairs = reduce(DataFrame.unionByName, [m.where((F.col("x_id") < F.col("y_id")) & near(2) & gender).select(*columns) for m in met]).dropDuplicates(["x_id", "y_id"])
    parts += [copies, pairs.where(first & names & relations).select(*ends, F.lit(2).alias("tier"))]

    named = p.where((F.col("__n") != "") & (F.length("__r") >= 2) & (F.col("__f") != ""))
    reps, copies = value_links(named, "id", ["place", "__n", "__r", "age", "gender"], 3)
    parts += [copies, blocked_pairs(reps, "id", ["place", "__n", "__r"], ["age", "gender"], near(3) & gender).select(*ends, F.lit(3).alias("tier"))]

    sounding = p.where((F.col("__np") != "") & (F.length("__rp") >= 2) & (F.col("__f") != ""))
    block = ["place", "__np", "__rp"]
    reps, copies = value_links(sounding, "id", [*block, "__f", "__fp", "age", "gender"], 4)
    parts += [copies, blocked_pairs(reps, "id", block, ["age", "gender", "__f", "__fp"], near(4) & gender).where(first).select(*ends, F.lit(4).alias("tier"))]
    return reduce(DataFrame.unionByName, parts)


def clusters(links: DataFrame, strongest: bool = True) -> DataFrame:
    """id, cluster, tier, confidence, size of every linked row. Pairs found in several tiers count as the strongest one
    (strongest=False: as the last one, for parity with systems that overwrite); a cluster's tier is the strongest of its links."""
    pick = F.min if strongest else F.max
    pairs = cut(links.groupBy("a", "b").agg(pick("tier").alias("tier")), "pairs")
    nodes = components(pairs)
    tiers = pairs.join(nodes, pairs["a"] == nodes["node"]).groupBy("label").agg(F.min("tier").alias("tier"))
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    points = F.create_map(*[F.lit(v) for kv in TIER_CONFIDENCE.items() for v in kv])
    return nodes.join(tiers, "label").join(sizes, "label").select(
        F.col("node").alias("id"), F.col("label").alias("cluster"), "tier", points[F.col("tier")].alias("confidence"), "size"
    )


def tier_counts(found: DataFrame, tier: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Clusters (of one tier, if given) and the count of clusters of every tier, which no tier filter changes."""
    counts = found.select("cluster", "tier").distinct().groupBy("tier").agg(F.count(F.lit(1)).alias("clusters"))
    return (found if tier is None else found.where(F.col("tier") == tier)), counts


def compare_lists(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` (p_id, p_code, p_name, p_relation, p_age) found in ``right`` (v_...): by id, else folded names, else phonetic
    keys with ages at most 4 apart; score 100, 95, 85."""
    from ledgerlark.operators.joins import cascade

    def keyed(df: DataFrame, p: str) -> DataFrame:
        n, r = T.fold_devanagari(F.col(f"{p}name")), T.fold_devanagari(F.col(f"{p}relation"))
        return df.withColumns({f"{p}k": F.upper(F.trim(F.col(f"{p}code"))), f"{p}n": n, f"{p}r": r, f"{p}np": T.phonetic_key(n), f"{p}rp": T.phonetic_key(r)})

    x, y = keyed(left, "p_"), keyed(right, "v_")
    on = lambda *names: [(F.col(f"p_{n}"), F.col(f"v_{n}")) for n in names]
    ages = (F.col("p_age") > 0) & (F.col("v_age") > 0) & (F.abs(F.col("p_age") - F.col("v_age")) <= 4)
    return cascade(x, y, "p_id", "v_id", [
        (100, on("k"), F.length("p_k") >= 5), (95, on("n", "r"), F.length("p_r") >= 3), (85, on("np", "rp"), (F.col("p_np") != "") & ages),
    ])


def match_share(matches: DataFrame, left: DataFrame) -> DataFrame:
    """matched, total, percent of all left rows, by pass totals too."""
    total = left.agg(F.count(F.lit(1)).alias("total"))
    found = matches.agg(F.count(F.lit(1)).alias("matched"))
    return found.join(total).withColumn("percent", F.when(F.col("total") > 0, F.col("matched") * 100.0 / F.col("total")).otherwise(0.0))


def _name_points(a: str, b: str) -> Column:
    x, y = F.col(a), F.col(b)
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    first = lambda c: F.split(c, " ")[0]
    return (
        F.when(x == y, NAME_POINTS["equal"]).when(bare(x) == bare(y), NAME_POINTS["bare"]).when(first(x) == first(y), NAME_POINTS["first"])
        .when(matchers.similarity_udf(x, y) >= matchers.FIRST_NAME, NAME_POINTS["fuzzy"]).when(T.phonetic_key(x) == T.phonetic_key(y), NAME_POINTS["sound"])
    )


def household_matches(members: DataFrame, registry: DataFrame, rounds: int = 2) -> DataFrame:
    """The best registry row of every survey member: m_id, v_id, score, kind.

    members: m_id, m_home, m_name, m_relation, m_gender, m_age, m_house, m_part; registry: the same with v_ and v_serial. Candidates
    share a blocking key (bare name, a word, sound key). Each round's matches anchor the next: kin of an anchored
    household within 25 serials of an anchor are accepted at once. Rounds are batches, so the order of members doesn't matter.
    """
    m = members.withColumns({"mn": T.fold_devanagari("m_name"), "mr": T.fold_devanagari("m_relation")})
    v = registry.withColumns({"vn": T.fold_devanagari("v_name"), "vr": T.fold_devanagari("v_relation")})
    keys = lambda c: F.filter(F.concat(F.array(F.replace(F.col(c), F.lit(" "), F.lit("")), T.phonetic_key(F.col(c))), F.split(F.col(c), " ")), lambda k: F.length(k) >= 2)
    from ledgerlark.operators.joins import multi_key_candidates

    pairs = multi_key_candidates(m, v, "m_id", "v_id", keys("mn"), keys("vn")).join(m, "m_id").join(v, "v_id")
    apart = F.abs(F.col("m_age") - F.col("v_age"))
    age = F.lit(FAR_AGE)
    for most, points in reversed(AGE_POINTS):
        age = F.when(apart <= most, points).otherwise(age)
    scored = pairs.withColumns({"pn": _name_points("mn", "vn"), "pr": F.when(F.coalesce(F.col("mr"), F.lit("")) == "", 60).otherwise(_name_points("mr", "vr"))})
    score = F.floor((F.col("pn") + F.col("pr")) / 2)
    score += F.when(F.col("m_gender").isNull() | F.col("v_gender").isNull(), 0).when(F.col("m_gender") == F.col("v_gender"), GENDER_POINTS[0]).otherwise(GENDER_POINTS[1])
    score += F.when(apart.isNull(), 0).otherwise(age) + F.when(F.col("m_house") == F.col("v_house"), HOUSE_POINTS).otherwise(0)
    scored = cut(scored.withColumn("score", score).where(F.col("pn").isNotNull()), "scored")
    best = Window.partitionBy("m_id").orderBy(F.desc("score"), "v_id")
    take = lambda df: df.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    columns = ["m_id", "v_id", "score", "kind"]
    found = take(scored.where(F.col("score") >= ACCEPT)).withColumn("kind", F.when(F.col("score") >= EXACT, "exact").otherwise("scored"))
    found = cut(found.select(*columns), "found")
    for _ in range(rounds - 1):
        anchors = found.join(m.select("m_id", "m_home"), "m_id").join(v.select("v_id", F.col("v_part").alias("part"), F.col("v_serial").alias("at"), "vn", "vr"), "v_id")
        span = anchors.groupBy("m_home", "part").agg(F.sort_array(F.collect_set("at")).alias("ats"), F.collect_set("vn").alias("names"), F.collect_set("vr").alias("rels"))
        open_ = scored.join(found.select("m_id"), "m_id", "left_anti").join(span, ["m_home"]).where("v_part = part")
        close = F.exists("ats", lambda a: F.abs(F.col("v_serial") - a) <= 25)
        kin = F.array_contains("names", F.col("vr")) | F.array_contains("rels", F.col("vn")) | F.array_contains("rels", F.col("vr"))
        genders = F.col("m_gender").isNull() | F.col("v_gender").isNull() | (F.col("m_gender") == F.col("v_gender"))
        ages = apart.isNull() | (apart <= 12)
        more = take(open_.where(close & kin & genders & ages)).withColumn("kind", F.lit("anchored")).select(*columns)
        found = cut(found.unionByName(more), "found")
    return found


def propagate_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, label, hops: labels of ``nodes`` (id, label or null) spread over ``links`` (a, b), one step a round, until no label arrives; of
    several that arrive at once the least counts. Sources are fixed at the start of a round. Only neutral labels are meant.

    Each round joins only the labels that the last one brought, since those before have nothing new to tell their neighbours.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "both-ways")
    state = cut(nodes.select("id", "label", F.when(F.col("label").isNotNull(), 0).alias("hops")), "labels")
    front, step = state.where("label IS NOT NULL").select("id", "label"), 0
    while not front.isEmpty():
        step += 1
        arriving = both.join(front, both["a"] == front["id"]).groupBy(F.col("b").alias("id")).agg(F.min("label").alias("__l"))
        front = cut(state.where("label IS NULL").select("id").join(arriving, "id"), "front")
        joined = state.join(front, "id", "left")
        state = cut(joined.select("id", F.coalesce("label", "__l").alias("label"), F.coalesce("hops", F.when(F.col("__l").isNotNull(), step)).alias("hops")), "labels")
        front = front.select("id", F.col("__l").alias("label"))
    return state
