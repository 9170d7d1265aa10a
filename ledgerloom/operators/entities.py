"""Organisation identities across sources: comparing names and locations, finding candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import address_key, jaro_winkler_similarity, link_key, name_profile, sequence_ratio, zip5, zip_score
from ..session import cut, table
from .likenames import contained_names, like_names
from .relational import first_per_group

#: Scores that a conflict of regions, a one-sided region, or a conflict of locations leaves at most.
REGION_CONFLICT, ONE_REGION, PLACE_CONFLICT = 0.84, 0.89, 0.84


def profiled(observations: DataFrame) -> DataFrame:
    """Observations with the profile of their name (``p``) and the parts of their address (``a``)."""
    return observations.withColumn("p", name_profile(F.col("observed_name"))).withColumn("a", address_key(F.col("address"), F.col("city"), F.col("state"), F.col("zip_code")))


def compared_names(df: DataFrame, left: str, right: str) -> DataFrame:
    """``df`` with name_score and relationship of the profiles in columns ``left`` and ``right``.

    The score is the better of the whole-name similarity and 0.6 core similarity + 0.4 overlap of core words.
    """
    p, q = F.col(left), F.col(right)
    core = lambda x: F.when(F.size(x["core"]) > 0, F.array_join(x["core"], " ")).otherwise(x["normalized"])
    anchor = lambda x: F.array_distinct(F.when(F.size(x["core"]) > 0, x["core"]).otherwise(x["tokens"]))
    # without regions the two are the same
    full = lambda x: F.when((core(p) != p["normalized"]) | (core(q) != q["normalized"]), x["normalized"])
    df = df.withColumn("__core", sequence_ratio(core(p), core(q))).withColumn("__full", F.coalesce(sequence_ratio(full(p), full(q)), "__core"))
    shared = F.size(F.array_intersect(anchor(p), anchor(q)))
    jaccard = F.coalesce(F.try_divide(shared, F.size(F.array_union(anchor(p), anchor(q)))), F.lit(0.0))
    contained = F.coalesce(F.try_divide(shared, F.least(F.size(anchor(p)), F.size(anchor(q)))), F.lit(0.0))
    score = F.greatest("__full", 0.6 * F.col("__core") + 0.4 * jaccard)
    regions = lambda x: F.array_sort(F.array_distinct(x["qualifiers"]))
    conflict = (F.size(p["qualifiers"]) > 0) & (F.size(q["qualifiers"]) > 0) & (regions(p) != regions(q))
    missing = (p["normalized"] == "") | (q["normalized"] == "")
    one = p["qualifiers"] != q["qualifiers"]
    relation = (
        F.when(missing, "insufficient_evidence").when(conflict, "possible_regional_affiliate").when(one, "possible_parent_or_subsidiary")
        .when(p["normalized"] == q["normalized"], "same_normalized_name").when((contained >= 0.8) & (F.col("__core") >= 0.8), "likely_alias").otherwise("similar_name")
    )
    capped = F.when(missing, 0.0).when(conflict, F.least(score, F.lit(REGION_CONFLICT))).when(one, F.least(score, F.lit(ONE_REGION))).otherwise(score)
    return df.withColumn("relationship", relation).withColumn("name_score", F.round(capped, 6)).drop("__core", "__full")


def compared_places(left: Column, right: Column) -> Column:
    """struct(location, location_score) of two address keys; NULL score where nothing can be compared."""
    both = lambda f: (left[f] != "") & (right[f] != "")
    same = lambda f: left[f] == right[f]
    state = F.when(both("state"), same("state"))
    postal = F.when(both("zip_code"), same("zip_code"))
    fields = ("address", "city", "state", "zip_code")
    exact = both("address") & both("city") & both("state") & both("zip_code")
    for f in fields:
        exact = exact & same(f)
    kind = (
        F.when(exact, "exact_address").when(both("address") & F.coalesce(postal & state, F.lit(False)), "same_postal_address")
        .when(both("city") & F.coalesce(state, F.lit(False)) & same("city"), "same_city_state").when(state, "same_state")
        .when(~state | ~postal, "conflicting_location").otherwise("location_unavailable")
    )
    score = F.create_map(*[F.lit(x) for kv in {"exact_address": 1.0, "same_postal_address": 0.85, "same_city_state": 0.6, "same_state": 0.25, "conflicting_location": 0.0}.items() for x in kv])[kind]
    return F.struct(kind.alias("location"), score.alias("location_score"))


def compared(df: DataFrame) -> DataFrame:
    """Pairs (lp, la, rp, ra: profiles and address keys) with score, relationship, location and evidence tier."""
    return located(compared_names(df, "lp", "rp"))


def located(df: DataFrame) -> DataFrame:
    """Pairs with the name_score and relationship of their names, and la, ra, with score, location and evidence tier."""
    df = df.withColumn("l", compared_places(F.col("la"), F.col("ra")))
    near = F.col("l.location").isin("exact_address", "same_postal_address")
    score = F.when(F.col("l.location") == "conflicting_location", F.least("name_score", F.lit(PLACE_CONFLICT))).when(near, 0.8 * F.col("name_score") + 0.2 * F.col("l.location_score")).otherwise(F.col("name_score"))
    tier = F.when(F.col("l.location") == "conflicting_location", "conflicting_location").when(near, "corroborated").when(F.col("l.location").isin("same_city_state", "same_state"), "location_supported").otherwise("name_only")
    return df.withColumn("score", F.round(score, 6)).withColumn("location", F.col("l.location")).withColumn("tier", tier).drop("l")


def _sides(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    o = cut(profiled(observations).select("observation_id", "source_system", "p", "a"))
    side = lambda s, c: o.where(c).select(F.col("observation_id").alias(f"{s}_id"), F.col("p").alias(f"{s}p"), F.col("a").alias(f"{s}a"))
    return side("l", F.col("source_system") == "IRS990"), side("r", F.col("source_system") != "IRS990")


def exact_candidates(observations: DataFrame, least_tokens: int = 2) -> DataFrame:
    """(l_id, r_id, score, relationship, location, tier) of filers and outside records with the same normalized name of some words."""
    left, right = _sides(observations)
    key = lambda df, s: df.withColumn("k", F.col(f"{s}p")["normalized"]).where(F.size(F.split("k", " ")) >= least_tokens)
    return compared(key(left, "l").join(key(right, "r"), "k")).select("l_id", "r_id", "score", "relationship", "location", "tier")


def _best_pairs(observations: DataFrame, words, least_score: float, alike: str, top: int) -> DataFrame:
    """Comparison of filers and outside records that share a word and reach ``least_score``, names of equal words apart: the best ``top`` of each filer record, ties by the outside one.

    ``alike`` is that of ``like_names``; "other" also takes aliases, and leaves out names that are just alike.
    Names are profiled and compared once however many records bear them, and only those that can reach the score (``likenames``); locations once for all records of one name and address.
    A location near by adds up to 0.2 to 0.8 of a name's score, so a name may be that much below.
    """
    least = min(least_score, (least_score - 0.2) / 0.8) - 1e-6
    place = address_key(F.col("address"), F.col("city"), F.col("state"), F.col("zip_code"))
    o = cut(observations.select("observation_id", "source_system", "observed_name", F.xxhash64("observed_name").alias("name"), place.alias("a")))
    side = lambda s, c: o.where(c).select(F.col("observation_id").alias(f"{s}_id"), F.col("name").alias(f"{s}_name"), F.xxhash64("name", "a").alias(f"{s}_at"), F.col("a").alias(f"{s}a"))
    named = lambda s, c: cut(o.where(c & F.col("observed_name").isNotNull()).select("name", "observed_name").distinct().select(F.col("name").alias(f"{s}_name"), name_profile(F.col("observed_name")).alias(f"{s}p")))
    l, r = side("l", F.col("source_system") == "IRS990"), side("r", F.col("source_system") != "IRS990")  # noqa: E741
    a, b = named("l", F.col("source_system") == "IRS990"), named("r", F.col("source_system") != "IRS990")
    core = lambda p: F.when(F.size(p["core"]) > 0, F.array_join(p["core"], " ")).otherwise(p["normalized"])
    anchor = lambda p: F.array_distinct(F.when(F.size(p["core"]) > 0, p["core"]).otherwise(p["tokens"]))
    of = lambda df, s: df.where(F.col(f"{s}p")["normalized"] != "").select(
        F.col(f"{s}_name").alias("id"), F.array_distinct(words(F.col(f"{s}p"))).alias("words"), F.col(f"{s}p")["normalized"].alias("full"),
        core(F.col(f"{s}p")).alias("core"), anchor(F.col(f"{s}p")).alias("anchor"), F.array_join(F.col(f"{s}p")["qualifiers"], " ").alias("kind"),
    )
    pairs = like_names(of(a, "l"), of(b, "r"), least, alike)
    if alike == "other":
        pairs = pairs.unionByName(contained_names(of(a, "l"), of(b, "r")))
    pairs = cut(pairs.select(F.col("l_id").alias("l_name"), F.col("r_id").alias("r_name"))).join(a, "l_name").join(b, "r_name").where("lp.normalized <> rp.normalized")
    names = compared_names(pairs, "lp", "rp").where((F.col("name_score") >= least) & (F.lit(alike != "other") | (F.col("relationship") != "similar_name")))
    names = cut(names.select("l_name", "r_name", "name_score", "relationship"))
    # records of one name and address have one score, so no more than ``top`` of the right ones count, and the left ones have the same candidates
    firsts = first_per_group(r.select("r_id", "r_name", "r_at", "ra").join(names.select("r_name").distinct(), "r_name"), ["r_at"], [F.asc("r_id")], top)
    places = l.select("l_name", "l_at", "la").join(names.select("l_name").distinct(), "l_name").dropDuplicates(["l_at"])
    both = located(names.join(places, "l_name").join(firsts, "r_name")).where(F.col("score") >= least_score)
    best = first_per_group(both, ["l_at"], [F.desc("score"), F.asc("r_id")], top)
    return best.join(l.select("l_id", "l_at"), "l_at").select("l_id", "r_id", "score", "relationship", "location", "tier")


def token_candidates(observations: DataFrame, least_score: float = 0.92, least_letters: int = 5, top: int = 25) -> DataFrame:
    """Candidates that share a long word but not the whole name: the best ``top`` of each filer record, ties by the outside record."""
    long = lambda p: F.filter(F.split(p["normalized"], " "), lambda w: F.length(w) >= least_letters)
    # names of other regions are capped below what a near location could make up for
    return _best_pairs(observations, long, least_score, "same" if 0.8 * ONE_REGION + 0.2 < least_score else "any", top)


def relationship_candidates(observations: DataFrame, least_score: float = 0.78, top: int = 25) -> DataFrame:
    """Candidates that share a core word and look like affiliates, parents or aliases rather than just alike."""
    core = lambda p: F.when(F.size(p["core"]) > 0, p["core"]).otherwise(p["tokens"])
    return _best_pairs(observations, core, least_score, "other", top)


def ordered_candidates(found: DataFrame, matcher: str) -> DataFrame:
    """(left_observation_id, right_observation_id, matcher_name, score), the smaller id on the left, each pair once with its best score."""
    pairs = found.select(F.least("l_id", "r_id").alias("left_observation_id"), F.greatest("l_id", "r_id").alias("right_observation_id"), F.lit(matcher).alias("matcher_name"), "score")
    return pairs.groupBy("left_observation_id", "right_observation_id", "matcher_name").agg(F.max("score").alias("score"))


def prefix_candidates(filers: DataFrame, clients: DataFrame, least: float = 0.85, prefix: int = 8, length_ratio: float = 0.6) -> DataFrame:
    """(ein, client_key, similarity, state_agrees, zip_score): near names with the same first letters and like lengths, by Jaro-Winkler.

    ``filers``: ein, name, state, zip; ``clients``: client_key, name, state, zip.
    """
    f = filers.select("ein", link_key(F.col("name")).alias("a"), F.col("state").alias("fs"), zip5(F.col("zip")).alias("fz")).where("a <> ''").distinct()
    c = clients.select("client_key", link_key(F.col("name")).alias("b"), F.col("state").alias("cs"), zip5(F.col("zip")).alias("cz")).where("b <> ''").distinct()
    names = f.select("a").distinct().withColumn("k", F.substring("a", 1, prefix)).join(c.select("b").distinct().withColumn("k", F.substring("b", 1, prefix)), "k")
    names = names.where((F.least(F.length("a"), F.length("b")) / F.greatest(F.length("a"), F.length("b")) >= length_ratio) & (F.col("a") != F.col("b")))
    names = cut(names.select("a", "b", jaro_winkler_similarity("a", "b").alias("similarity")).where(F.col("similarity") >= least))
    df = f.join(names, "a").join(c, "b")
    return df.select("ein", "client_key", F.round("similarity", 6).alias("similarity"), F.coalesce(F.col("fs") == F.col("cs"), F.lit(False)).alias("state_agrees"), zip_score(F.col("fz"), F.col("cz")).alias("zip_score"))


def best_links(candidates: DataFrame, key: str = "client_key") -> DataFrame:
    """One candidate per key: the best ZIP score, then similarity, then EIN, then the same state."""
    return first_per_group(candidates, [key], [F.desc("zip_score"), F.desc("similarity"), F.asc("ein"), F.desc("state_agrees")])


def _filers_and_clients(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = table(spark, sf_dir, "irs990_filings").where("ein IS NOT NULL").select("ein", F.col("filer_name").alias("name"), F.col("filer_state").alias("state"), F.col("filer_zip_code").alias("zip"))
    c = table(spark, sf_dir, "lda_filings").where("client_id IS NOT NULL").select(F.col("client_id").alias("client_key"), F.col("client_name").alias("name"), F.col("client_state").alias("state"), F.col("client_zip_code").alias("zip"))
    return f, c


def exact_name_candidates(spark, sf_dir: str) -> DataFrame:
    return exact_candidates(table(spark, sf_dir, "entity_observations"))


def fuzzy_name_candidates(spark, sf_dir: str) -> DataFrame:
    return token_candidates(table(spark, sf_dir, "entity_observations"))


def affiliate_candidates(spark, sf_dir: str) -> DataFrame:
    return ordered_candidates(relationship_candidates(table(spark, sf_dir, "entity_observations")), "relationship_similarity_v1")


def near_name_links(spark, sf_dir: str) -> DataFrame:
    return prefix_candidates(*_filers_and_clients(spark, sf_dir))


def best_near_links(spark, sf_dir: str) -> DataFrame:
    return best_links(near_name_links(spark, sf_dir))


def exact_pairs(spark, sf_dir: str) -> DataFrame:
    """Filer and outside observations with the same link key and at least two words."""
    o = table(spark, sf_dir, "entity_observations").select("observation_id", "source_system", link_key(F.col("observed_name")).alias("k")).where(F.col("k").contains(" "))
    left = o.where("source_system = 'IRS990'").select(F.col("observation_id").alias("l_id"), "k")
    return left.join(o.where("source_system <> 'IRS990'").select(F.col("observation_id").alias("r_id"), "k"), "k").select("l_id", "r_id", "k")


QUERIES = {f.__name__: f for f in (exact_name_candidates, fuzzy_name_candidates, affiliate_candidates, near_name_links, best_near_links, exact_pairs)}

_DROP = "('inc','incorporated','llc','lp','llp','corp','corporation','the','of','and','for','a','an','pac','cmte','association','committee','fund','foundation','trust','club','')"
_KEY = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w NOT IN " + _DROP + "), ' ')"
_NEAR = f"""SELECT ein, client_key, round(jaro_winkler_similarity(a, b), 6) AS similarity, coalesce(fs = cs, false) AS state_agrees,
 CASE WHEN fz = cz THEN 100 WHEN left(fz, 4) = left(cz, 4) THEN 90 WHEN left(fz, 3) = left(cz, 3) THEN 80 ELSE 0 END AS zip_score
 FROM (SELECT DISTINCT ein, {_KEY.format("filer_name")} AS a, filer_state AS fs, nullif(regexp_extract(filer_zip_code, '([0-9]{{5}})', 1), '') AS fz FROM irs990_filings WHERE ein IS NOT NULL) f
 JOIN (SELECT DISTINCT client_id AS client_key, {_KEY.format("client_name")} AS b, client_state AS cs, nullif(regexp_extract(client_zip_code, '([0-9]{{5}})', 1), '') AS cz FROM lda_filings WHERE client_id IS NOT NULL) c
 ON left(a, 8) = left(b, 8) AND a <> b AND least(length(a), length(b)) / greatest(length(a), length(b)) >= 0.6 WHERE a <> '' AND b <> '' AND jaro_winkler_similarity(a, b) >= 0.85"""
SQL = {
    "best_near_links": f"SELECT * FROM ({_NEAR}) QUALIFY row_number() OVER (PARTITION BY client_key ORDER BY zip_score DESC, similarity DESC, ein, state_agrees DESC) = 1",
    "near_name_links": _NEAR,
    "exact_pairs": f"""WITH o AS (SELECT observation_id, source_system, {_KEY.format("observed_name")} AS k FROM entity_observations)
 SELECT l.observation_id AS l_id, r.observation_id AS r_id, l.k FROM o l JOIN o r ON l.k = r.k AND l.source_system = 'IRS990' AND r.source_system <> 'IRS990' WHERE contains(l.k, ' ')""",
}
