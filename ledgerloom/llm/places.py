"""Problem 5: one postal address written differently, matched down the hierarchy of its parts.

An address is taken apart into region, locality, street, number and unit. Matching goes level by
level: spellings of localities are settled within their region and ZIP codes, spellings of streets
within their locality and number. A level that a record lacks inherits what the levels around it
allow: if that is one candidate, the record takes it; if it is several, the record stays ambiguous,
says at which level and among how many, and is linked to none of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import null_safe_join, shuffled
from ..operators.skew import lookup
from ..session import cut, table
from .names import ACCENTED, PLAIN, followed, one_error, one_out

# Postal abbreviations.
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "DISTRICT OF COLUMBIA": "DC",
    "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME",
    "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV",
    "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR",
    "PENNSYLVANIA": "PA", "PUERTO RICO": "PR", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT",
    "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
}
SUFFIXES = {
    "ALLEY": "ALY", "AVENUE": "AVE", "AV": "AVE", "AVN": "AVE", "BOULEVARD": "BLVD", "BOUL": "BLVD", "BLV": "BLVD", "CIRCLE": "CIR", "CIRC": "CIR", "COURT": "CT", "CRT": "CT", "DRIVE": "DR", "DRV": "DR",
    "LANE": "LN", "LA": "LN", "PARKWAY": "PKWY", "PKY": "PKWY", "PLACE": "PL", "PLAZA": "PLZ", "ROAD": "RD", "SQUARE": "SQ", "STREET": "ST", "STR": "ST", "TERRACE": "TER", "TERR": "TER", "TRAIL": "TRL", "TR": "TRL", "WY": "WAY",
}
DIRECTIONS = {"NORTH": "N", "NO": "N", "SOUTH": "S", "SO": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW"}
ORDINALS = {"FIRST": "1ST", "SECOND": "2ND", "THIRD": "3RD", "FOURTH": "4TH", "FIFTH": "5TH", "SIXTH": "6TH", "SEVENTH": "7TH", "EIGHTH": "8TH", "NINTH": "9TH", "TENTH": "10TH", "ELEVENTH": "11TH", "TWELFTH": "12TH"}
NUMBERS = {"ONE": "1", "TWO": "2", "THREE": "3", "FOUR": "4", "FIVE": "5", "SIX": "6", "SEVEN": "7", "EIGHT": "8", "NINE": "9", "TEN": "10", "ELEVEN": "11", "TWELVE": "12"}
TOWNS = {"ST": "SAINT", "MT": "MOUNT", "FT": "FORT", "N": "NORTH", "NO": "NORTH", "S": "SOUTH", "SO": "SOUTH", "E": "EAST", "W": "WEST", "HTS": "HEIGHTS", "HGTS": "HEIGHTS"}
SUFFIX_WORDS = ["AVENUE", "BOULEVARD", "CIRCLE", "COURT", "DRIVE", "LANE", "PARKWAY", "PLACE", "ROAD", "STREET", "TERRACE", "TRAIL"]
UNIT = r"(?:SUITE|STE|UNIT|APARTMENT|APT|ROOM|RM|FLOOR|FLR|FL)"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _tokens(text: Column, pairs: dict[str, str]) -> Column:
    m = _map(pairs)
    return F.transform(F.split(text, " "), lambda t: F.coalesce(m[t], t))


def tidy(text: Column) -> Column:
    """Upper case, blanks as one, outer blanks gone; blank as NULL."""
    t = F.trim(F.regexp_replace(F.upper(text), r"\s+", " "))
    return F.when(t != "", t)


def taken_apart(writings: DataFrame) -> DataFrame:
    """(id, n, region, town, zip5, number, street, before, suffix, unit) of ``writings`` (id, n, address, city, state, zip; tidy).

    A part that the text lacks is NULL. ``street`` is the name without direction and suffix; for a
    post-office box, and for a text in which no street is found, it is the whole of what is left.
    """
    bare = F.translate(F.regexp_replace("address", r"\.", ""), ACCENTED, PLAIN)
    df = writings.withColumn("t", bare)
    df = df.withColumn("box", F.nullif(F.regexp_extract("t", r"(?:\bP ?O ?BOX|\bPOST OFFICE BOX|\bPOB|\bP ?O DRAWER|^BOX|, ?BOX)\s*#?\s*(\d+)", 1), F.lit("")))
    found = F.coalesce(
        F.nullif(F.regexp_extract("t", r"\b(\d+)(?:ST|ND|RD|TH) (?:FLOOR|FLR|FL)\b", 1), F.lit("")),
        F.nullif(F.regexp_extract("t", r"\b" + UNIT + r"\s*#?\s*(\d+[A-Z]?)\b", 1), F.lit("")),
        F.nullif(F.regexp_extract("t", r"#\s*(\d+[A-Z]?)\b", 1), F.lit("")),
    )
    df = df.withColumn("unit", F.when(F.col("box").isNull(), found))
    street = F.regexp_replace("t", r"\b\d+(?:ST|ND|RD|TH) (?:FLOOR|FLR|FL)\b|\b" + UNIT + r"\s*#?\s*\d+[A-Z]?\b|#\s*\d+[A-Z]?\b", ",")
    words = "|".join(NUMBERS)
    df = df.withColumn("parts", F.transform(F.split(street, ","), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"[^A-Z0-9 ]", " "), r"\s+", " "))))
    main = F.filter("parts", lambda p: p.rlike(rf"^(?:\d+[A-Z]?|{words}) [A-Z0-9]"))
    df = df.withColumn("main", F.element_at(F.when(F.size(main) > 0, main), 1))
    first = F.element_at(F.split("main", " "), 1)
    df = df.withColumn("number", F.coalesce(F.col("box"), _map(NUMBERS)[first], first))
    rest = F.regexp_replace("main", r"^\S+ ", "")
    rest = F.regexp_replace(rest, r"\b(?:COUNTY (?:ROAD|RD)|CTY (?:ROAD|RD)|CO (?:ROAD|RD)|CNTY (?:ROAD|RD)|CR)\b ?(\d)", "CR $1")
    rest = F.regexp_replace(rest, r"\b(?:(?:STATE|ST|US) )?(?:HIGHWAY|HWY|ROUTE|RTE|RT|SH|SR)\b ?(\d)", "HWY $1")
    df = df.withColumn("w", _tokens(rest, DIRECTIONS | ORDINALS))
    size = F.size("w")
    compass = ["N", "S", "E", "W", "NE", "NW", "SE", "SW"]
    ahead = F.when((size > 1) & F.element_at("w", 1).isin(compass), F.element_at("w", 1))
    behind = F.when((size > 1) & F.element_at("w", -1).isin(compass), F.element_at("w", -1))
    df = df.withColumn("before", F.coalesce(ahead, behind)).withColumn("w", F.when(ahead.isNotNull(), F.slice("w", 2, size - 1)).when(behind.isNotNull(), F.slice("w", F.lit(1), size - 1)).otherwise(F.col("w")))
    size = F.size("w")
    last = F.element_at("w", -1)
    suffix = F.coalesce(_map(SUFFIXES)[last], F.when(last.isin(sorted(set(SUFFIXES.values()))), last))
    # a list column, so that the edit distances are taken once, and only for words that no table knows
    mistyped = suffix.isNull() & (size > 1) & (F.length(last) > 3)
    df = df.withColumn("near", F.when(mistyped, F.filter(F.array(*[F.lit(x) for x in SUFFIX_WORDS]), lambda x: one_error(last, x))))
    suffix = F.coalesce(suffix, F.when(F.size("near") == 1, _map(SUFFIXES)[F.get("near", F.lit(0))]))
    df = df.withColumn("suffix", F.when(size > 1, suffix)).withColumn("w", F.when(F.col("suffix").isNotNull(), F.slice("w", F.lit(1), size - 1)).otherwise(F.col("w")))
    name = F.regexp_replace(F.array_join("w", " "), r"^(?:SAINT|ST) ", "SAINT ")
    df = df.withColumn("street", F.when(F.col("box").isNotNull(), "BOX").otherwise(F.coalesce(F.nullif(name, F.lit("")), F.array_join("parts", " "))))
    df = df.withColumn("number", F.coalesce("number", F.lit("")))
    df = df.withColumn("before", F.when(F.col("box").isNull(), F.col("before"))).withColumn("suffix", F.when(F.col("box").isNull(), F.col("suffix")))
    town = lambda c: F.array_join(_tokens(F.trim(F.regexp_replace(F.translate(F.regexp_replace(c, r"[.']", ""), ACCENTED, PLAIN), r"[^A-Z0-9]+", " ")), TOWNS), " ")
    tail = F.filter("parts", lambda p: ~p.rlike(r"\d|^(?:ATTN|C O|ANNEX|TREASURER|FINANCE)|^[A-Z]{2}$|BUILDING|^$"))
    tail = F.element_at(F.when((F.size(tail) > 0) & (F.col("main").isNotNull() | F.col("box").isNotNull()), tail), -1)
    tail = F.when(F.coalesce(tail != F.col("main"), F.lit(True)), tail)
    region = F.coalesce(_map(STATES)[F.col("state")], F.when(F.length("state") == 2, F.col("state")))
    end = F.element_at("parts", -1)
    region = F.coalesce(region, F.when(end.isin(sorted(STATES.values())), end))
    digits = F.regexp_replace("zip", r"[^0-9]", "")
    zip5 = F.when(F.length(digits) >= 5, F.substring(digits, 1, 5)).when(F.length(digits) == 4, F.lpad(digits, 5, "0"))
    return df.withColumns({"region": region, "town": F.coalesce(F.nullif(town(F.col("city")), F.lit("")), town(tail)), "zip5": zip5}).select("id", "n", "region", "town", "zip5", "number", "street", "before", "suffix", "unit")


def settle(df: DataFrame, word: str, within: list[str], factor: int) -> DataFrame:
    """(``within``, ``word``, to): spellings of ``word`` that are one error away from one at least ``factor`` times as frequent in the same ``within``.

    Every spelling meets all others that share a form with one letter left out; distinct words that do are bounded in
    number by the alphabet. Of several targets the most frequent counts, and corrections are followed to their ends.
    """
    spots = cut(df.where((F.length(word) > 3) & F.col(word).isNotNull()).groupBy(*within, word).agg(F.sum("n").alias("n")))
    return followed(corrections(spots, word, within, factor), word, within)


def corrections(spots: DataFrame, word: str, within: list[str], factor: int) -> DataFrame:
    """(``within``, ``word``, to): the first step of ``settle`` from spellings and how often each stands (``n``)."""
    several = spots.groupBy(*within).agg(F.count("*").alias("words")).where("words > 1").select(*within)
    parts = spots.join(shuffled(several), within, "left_semi").select("*", F.explode(one_out(F.col(word))).alias("part"))
    other = parts.select(*within, "part", F.col(word).alias("to"), F.col("n").alias("m"))
    better = parts.join(shuffled(other), [*within, "part"]).where((F.col("m") >= factor * F.col("n")) & ((F.col("m") > F.col("n")) | (F.col("to") > F.col(word))) & (F.col("to") != F.col(word)))
    better = better.where(one_error(F.col(word), F.col("to")))
    return better.groupBy(*within, word).agg(F.max(F.struct("m", "to"))["to"].alias("to"))


def localities(df: DataFrame) -> DataFrame:
    """``df`` with ``place``: town and region, from the record or from its ZIP code if that has one town; NULL if these leave it open."""
    known = cut(df.groupBy("region", "town", "zip5").agg(F.sum("n").alias("n")))
    fixes = settle(known.where("region IS NOT NULL"), "town", ["region"], 3).withColumnRenamed("to", "by_region")
    by_zip = settle(known.where("zip5 IS NOT NULL"), "town", ["zip5"], 1).withColumnRenamed("to", "by_zip")
    right = known.join(shuffled(fixes), ["region", "town"], "left").join(shuffled(by_zip), ["zip5", "town"], "left").withColumn("name", F.coalesce("by_region", "by_zip", "town"))
    right = cut(right.select("region", "town", "zip5", "name", "n"))
    full = right.where("name IS NOT NULL AND region IS NOT NULL")
    of_zip = full.where("zip5 IS NOT NULL").groupBy("zip5").agg(F.min(F.struct("region", "name")).alias("z"), F.max(F.struct("region", "name")).alias("y"), F.max_by("region", "n").alias("zip_region"))
    of_zip = of_zip.select("zip5", "zip_region", F.when(F.col("z") == F.col("y"), F.col("z.name")).alias("zip_name"))
    of_town = full.groupBy("name").agg(F.min("region").alias("one_region"), F.count_distinct("region").alias("k")).where("k = 1").drop("k")
    right = right.join(shuffled(of_zip), "zip5", "left").join(shuffled(of_town), "name", "left")
    name = F.coalesce("name", "zip_name")
    region = F.coalesce("region", "zip_region", "one_region")
    right = right.select("region", "town", "zip5", F.when(name.isNotNull() & region.isNotNull(), F.concat_ws("|", region, name)).alias("place"))
    return null_safe_join(df, shuffled(right), ["region", "town", "zip5"])


def homes(placed: DataFrame) -> DataFrame:
    """(number, street, scope, place): where a number and street are found; scope = its ZIP code, its ZIP code and region, its region, or ``*``.

    Records whose place is open look here under the narrowest scope that they give, so no record meets another.
    """
    region = F.split_part("place", F.lit("|"), F.lit(1))
    by_zip = F.when(F.col("zip5").isNotNull(), F.array(F.concat(F.lit("z"), "zip5"), F.concat(F.lit("z"), "zip5", F.lit("|"), region))).otherwise(F.array().cast("array<string>"))
    scopes = F.concat(by_zip, F.array(F.concat(F.lit("r"), region), F.lit("*")))
    return placed.where("number <> ''").select("number", "street", "place", F.explode(scopes).alias("scope")).distinct()


def settled_places(open_: DataFrame, placed: DataFrame) -> DataFrame:
    """``open_`` with ``place``, the number of ``candidates`` for it, and their ``scope``: candidates under the record's ZIP code, if it has any, else in its region, else anywhere.

    One candidate is taken over. With several, or none, the record keeps its ZIP code in place of a locality, and
    with several its ambiguity stays on record.
    """
    wanted = open_.where("number <> ''").select("number", "street").distinct()
    found = homes(placed.join(shuffled(wanted), ["number", "street"], "left_semi")).groupBy("number", "street", "scope").agg(F.min("place").alias("one"), F.count("*").alias("k"))
    near = F.when(F.col("zip5").isNotNull(), F.concat(F.lit("z"), "zip5", F.coalesce(F.concat(F.lit("|"), "region"), F.lit(""))))
    wide = F.coalesce(F.concat(F.lit("r"), "region"), F.lit("*"))
    df = open_.withColumns({"near": near, "wide": wide})
    for side in ("near", "wide"):
        df = df.join(shuffled(found.select("number", "street", F.col("scope").alias(side), F.col("one").alias(f"{side}_one"), F.col("k").alias(f"{side}_k"))), ["number", "street", side], "left")
    by = F.col("near_k").isNotNull()
    k = F.coalesce(F.col("near_k"), F.col("wide_k"), F.lit(0))
    alone = F.when(F.col("zip5").isNotNull(), F.concat_ws("|", F.coalesce("region", F.lit("")), F.concat(F.lit("="), "zip5")))
    place = F.coalesce(F.when(k == 1, F.when(by, F.col("near_one")).otherwise(F.col("wide_one"))), alone)
    return df.withColumns({"place": place, "candidates": k, "scope": F.when(k > 1, F.when(by, F.col("near")).otherwise(F.col("wide")))}).drop("near", "wide", *[f"{s}_{c}" for s in ("near", "wide") for c in ("one", "k")])


def matched(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` (from ``localities``) with its ``spot``, and the candidates of ambiguous localities.

    ``spot`` = place, number, street, direction and suffix, NULL if the locality is open and no ZIP code stands in for it. ``open_level`` is
    the highest level that stays open (locality, direction, suffix; NULL if none) and ``candidates`` counts what it could be (0: nothing known).
    """
    level = ["place", "number"]
    placed = df.where("place IS NOT NULL")
    fixes = settle(placed.where("street <> 'BOX'"), "street", level, 1)
    placed = cut(placed.join(shuffled(fixes), [*level, "street"], "left").withColumn("street", F.coalesce("to", "street")).drop("to"))
    late = settled_places(df.where("place IS NULL").drop("place"), placed)
    both = placed.withColumns({"candidates": F.lit(1).cast("long"), "scope": F.lit(None).cast("string")}).unionByName(late)
    road = [*level, "street"]
    ways = placed.groupBy(*road).agg(*[f(c).alias(f"{k}_{c}") for c in ("before", "suffix") for k, f in (("a", F.min), ("z", F.max))])
    both = both.join(shuffled(ways), road, "left")
    level_of = F.when((F.col("candidates") != 1), F.lit("locality"))
    for c, name in (("before", "direction"), ("suffix", "suffix")):
        several = F.col(c).isNull() & (F.col(f"a_{c}") != F.col(f"z_{c}"))
        level_of = F.coalesce(level_of, F.when(several, F.lit(name)))
        both = both.withColumn(f"own_{c}", F.coalesce(c, F.when(F.col(f"a_{c}") == F.col(f"z_{c}"), F.col(f"a_{c}")), F.lit("")))
    spot = F.when(F.col("place").isNotNull(), F.concat_ws("|", "place", "number", "street", "own_before", "own_suffix"))
    both = both.withColumns({"spot": spot, "open_level": level_of, "candidates": F.when(level_of.isin("direction", "suffix"), 2).otherwise(F.col("candidates"))})
    asked = late.where("scope IS NOT NULL").select("number", "street", "scope").distinct()
    return both.drop(*[f"{k}_{c}" for c in ("before", "suffix") for k in ("a", "z", "own")]), homes(placed).join(shuffled(asked), ["number", "street", "scope"], "left_semi")


def address_records(spark, sf_dir: str) -> DataFrame:
    """(record_key, written, address, city, state, zip) of the three tables, tidy; records without an address are left out."""
    f, r, o = (table(spark, sf_dir, t) for t in ("irs990_filings", "lda_registrant_sample_100", "entity_observations"))
    none = F.lit(None).cast("string")
    parts = [
        f.where("filer_address IS NOT NULL").select(F.concat(F.lit("irs990_filings:"), "filing_id").alias("record_key"), F.col("filer_address").alias("a1"), none.alias("a2"), F.col("filer_city").alias("city"), F.col("filer_state").alias("state"), F.col("filer_zip_code").alias("zip")),
        r.where("address_1 IS NOT NULL").select(F.concat(F.lit("lda_registrant_sample_100:"), "row_no").alias("record_key"), F.col("address_1").alias("a1"), F.col("address_2").alias("a2"), "city", "state", "zip"),
        o.where("address IS NOT NULL").select(F.concat(F.lit("entity_observations:"), "observation_id").alias("record_key"), F.col("address").alias("a1"), none.alias("a2"), "city", "state", F.col("zip_code").alias("zip")),
    ]
    fields = ["a1", "a2", "city", "state", "zip"]
    rows = reduce(DataFrame.unionByName, parts).select("record_key", *[tidy(F.col(c)).alias(c) for c in fields])
    return rows.select("record_key", F.concat_ws(" ", *fields).alias("written"), F.nullif(F.concat_ws(", ", "a1", "a2"), F.lit("")).alias("address"), "city", "state", "zip")


def spots(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record_key, w, spot, unit, open_level, candidates, scope, number, street) of the records with an address, and the candidates (number, street, scope, place).

    ``w`` is a hash of the whole address as written. Records are read once; every way of writing is taken apart once and
    goes through the levels under a digest instead of its text.
    """
    fields = ["address", "city", "state", "zip"]
    digest = F.unhex(F.md5(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x00")) for c in ("written", *fields)])))
    members = cut(records.where("address IS NOT NULL").select("record_key", digest.alias("id"), F.xxhash64("written").alias("w"), *fields))
    writings = cut(taken_apart(members.groupBy("id", *fields).agg(F.count("*").alias("n"))))
    found, candidates = matched(localities(writings))
    keep = ["spot", "unit", "open_level", "candidates", "scope", "number", "street"]
    # a digest that many records bear is joined without bringing these together
    out = lookup(members.select("record_key", "id", "w"), "id", found.select("id", "n", *keep), "n", members.count())
    return cut(out.select("record_key", "w", *keep)), candidates


def same_place_pairs(found: DataFrame) -> DataFrame:
    """(left_key, right_key): records at one spot, in the same unit where both give one, that are not written alike.

    Ways of writing are paired first, then their records, so records written alike never meet.
    """
    found = found.where("spot IS NOT NULL")
    # the street number beside the hash: places whose hashes are the same by chance hardly share it
    rows = found.select("record_key", "w", F.xxhash64("spot").alias("s"), F.split_part("spot", F.lit("|"), F.lit(3)).alias("number"), F.coalesce("unit", F.lit("")).alias("unit"))
    at = ["s", "number"]
    ways = rows.select(*at, "unit", "w").distinct()
    several = ways.groupBy(*at).agg(F.count("*").alias("k")).where("k > 1").select(*at)
    ways = cut(ways.join(shuffled(several), at, "left_semi"))
    a, b = ways.withColumnRenamed("w", "a"), ways.withColumnRenamed("w", "b")
    same = a.join(shuffled(b), [*at, "unit"]).where("a < b").withColumn("unit_b", F.col("unit"))
    none = a.where("unit = ''").join(shuffled(b.where("unit <> ''").withColumnRenamed("unit", "unit_b")), at).where("a <> b")
    pairs = same.unionByName(none)
    one = pairs.join(shuffled(rows.select(*at, "unit", F.col("w").alias("a"), F.col("record_key").alias("ka"))), [*at, "unit", "a"])
    two = one.join(shuffled(rows.select(*at, F.col("unit").alias("unit_b"), F.col("w").alias("b"), F.col("record_key").alias("kb"))), [*at, "unit_b", "b"])
    return two.select(F.least("ka", "kb").alias("left_key"), F.greatest("ka", "kb").alias("right_key"))


def p5_spots(spark, sf_dir: str) -> DataFrame:
    """Membership: the place of each record, and what stays ambiguous about it."""
    return spots(address_records(spark, sf_dir))[0].select("record_key", "spot", "unit", "open_level", "candidates", "scope")


def p5_candidates(spark, sf_dir: str) -> DataFrame:
    """What ambiguous records could denote: (number, street, scope, place), one row per candidate, however many records ask."""
    return spots(address_records(spark, sf_dir))[1]


def p5_found(spark, sf_dir: str) -> DataFrame:
    return same_place_pairs(spots(address_records(spark, sf_dir))[0])
