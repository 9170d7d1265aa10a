"""Problem 7: matching organisations across sources without shared keys, by walks, vectors and hashing.

Observations become records of a graph record - attribute value - token: names as canonical words and
hashed letter triples, states, ZIP codes, native identifiers. Random walks over it train skip-gram
vectors; a name's vector is made of those of its tokens, a place's of those of its state and ZIP area. Names
are blocked by state, by the common words that must agree, and by several tables of hyperplane signs; a name
that several organisations bear meets itself there. Candidates are reranked by the exact cosine of name and
place, and cosines are calibrated to confidences on candidates within one source, where native identifiers tell
the truth. What the confidence finds likely is taken if it also passes an exact check of the words that tell
organisations apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Word2Vec
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..session import cut, table
from .names import DESIGNATIONS, FORMS, cleaned, initials, name_keys, one_error, written

#: Letter triples are hashed to this many nodes, so the vocabulary has a fixed bound.
TRIPLES = 1 << 13
DIMENSIONS, WINDOW, HOPS = 32, 4, 2
#: A value's records are dealt to so many on average in a part; a walk picks a part, then a record of it, so it can reach all.
IN_A_PART = 16
#: Sentences in a partition of the training, whatever the cluster.
SENTENCES = 20_000
#: Weight of the place beside the name.
PLACE = 0.4
#: Two names at this cosine meet in a slot with probability RECALL at least; candidates below it are not looked at further.
LEAST_COSINE, RECALL = 0.5, 0.9
#: Pairs below this confidence are not taken. It is low since an exact check follows.
LEAST_CONFIDENCE = 0.1
#: A block of names gets so many hyperplanes that a slot holds about this many of them; blocks no larger are compared whole.
PER_SLOT = 64
#: Sources in which different identifiers mean different organisations, for calibration.
SURE_SOURCES = ("IRS990", "FEC")
SEED = 7


def observations(df: DataFrame) -> DataFrame:
    """(id, source, entity, clean, state, zip3): one row per observation that has a name or a usable identifier.

    ``entity`` stands for the organisation as its own source knows it: the native identifier, unless it
    is missing or a filler of one repeated digit, else the observation itself. Committee words go.
    """
    digits = F.regexp_replace("native_identifier", r"\D", "")
    usable = F.col("native_identifier").isNotNull() & ~digits.rlike(r"^(\d)\1*$") & (F.length(F.trim("native_identifier")) > 0)
    name = F.coalesce(F.nullif(F.trim("observed_name"), F.lit("")), F.nullif(F.trim("normalized_name"), F.lit("")))
    bare = F.regexp_replace(cleaned(written(name)), r"\b(?:POLITICAL ACTION COMMITTEE|POLITICAL ACTION CMTE|POLITICAL ACTION COMM|PAC)\b", " ")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    state = F.upper(F.trim("state"))
    return df.select(
        F.col("observation_id").alias("id"),
        F.col("source_system").alias("source"),
        F.when(usable, F.concat_ws(":", "source_system", F.upper(F.trim("native_identifier")))).otherwise(F.concat_ws(":", F.lit("observation"), "observation_id")).alias("entity"),
        F.nullif(bare, F.lit("")).alias("clean"),
        F.when(F.length(state) == 2, state).otherwise(_state_code(state)).alias("state"),
        F.substring(F.regexp_replace("zip_code", r"\D", ""), 1, 3).alias("zip3"),
    ).where("source IS NOT NULL")


def _state_code(name: Column) -> Column:
    from .places import STATES

    return F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[name]


def triples(word: Column) -> Column:
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.concat(F.lit("g"), F.pmod(F.xxhash64(F.substring(padded, i, F.lit(3))), F.lit(TRIPLES))))


def profiles(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pid, rare, bag, words, grams) of the distinct canonical names, and (clean, pid): the canonical readings of each cleaned name."""
    clean = cut(obs.where("clean IS NOT NULL").select("clean").distinct())
    keys = cut(name_keys(clean, clean.count()).where("NOT spare").select("clean", "rare", "bag").distinct())
    df = keys.select("rare", "bag").distinct()
    df = df.select("rare", "bag", F.transform("bag", lambda w: F.concat(F.lit("w"), w)).alias("words"), F.when(F.col("rare") != "", triples(F.col("rare"))).otherwise(F.array().cast("array<string>")).alias("grams"))
    prof = cut(df.withColumn("pid", F.monotonically_increasing_id()))
    return prof, cut(keys.join(prof.select("rare", "bag", "pid"), ["rare", "bag"]).select("clean", "pid"))


def walks(obs: DataFrame, prof: DataFrame, readings: DataFrame) -> DataFrame:
    """(sentence): for each record a random walk over attribute values to other records, as tokens of the records it passes."""
    records = obs.where("clean IS NOT NULL").groupBy("entity", "clean", "state", "zip3").agg(F.min("id").alias("rid"))
    records = records.join(readings.groupBy("clean").agg(F.min("pid").alias("pid")), "clean").join(prof.select("pid", "rare", "words", "grams"), "pid")
    records = cut(records.select("rid", "entity", "state", "zip3", "rare", "words", "grams"))
    values = records.select("rid", F.explode(F.filter(F.array(F.concat(F.lit("r"), F.nullif("rare", F.lit(""))), F.concat(F.lit("e"), "entity"), F.concat(F.lit("z"), "zip3")), lambda v: v.isNotNull())).alias("value"))
    values = cut(values)
    # a value that many records share is in many parts, so it is neither one list nor one key of a join
    sizes = values.groupBy("value").agg(F.ceil(F.count("*") / IN_A_PART).alias("parts"))
    values = cut(lookup(values, "value", sizes.withColumn("n", F.col("parts") * IN_A_PART), "n", values.count() + IN_A_PART * 1000))
    at = values.groupBy("value", F.pmod(F.xxhash64("rid", "value", F.lit(SEED)), "parts").alias("part")).agg(F.array_sort(F.collect_list("rid")).alias("near"))
    ends = values.withColumn("h", F.xxhash64("rid", "value", F.lit(SEED + 1))).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("h", "value", "parts"))).alias("v"))
    pick = lambda a, *salt: F.element_at(a, (F.pmod(F.xxhash64(*salt), F.size(a)) + 1).cast("int"))
    path = records.select(F.col("rid").alias("start"), F.col("rid").alias("here"), F.array(F.col("rid")).alias("path"))
    for hop in range(HOPS):
        path = path.join(ends.withColumnRenamed("rid", "here"), "here").withColumn("to", pick(F.col("v"), F.col("start"), F.lit(hop)))
        path = path.select("start", "path", "to.value", F.pmod(F.xxhash64("start", F.lit(hop + 20)), "to.parts").alias("part"))
        # a part without records (hashing may leave one out) keeps the walk where it is
        path = path.join(at, ["value", "part"], "left").withColumn("here", F.coalesce(pick(F.col("near"), F.col("start"), F.lit(hop + 50)), F.element_at("path", -1))).drop("near", "value", "part")
        path = path.withColumn("path", F.concat("path", F.array("here")))
    some = lambda a, n, salt: F.slice(F.shuffle(a, F.lit(SEED + salt)), 1, n)
    own = F.concat(F.array_compact(F.array(F.concat(F.lit("s"), "state"), F.concat(F.lit("z"), "zip3"))), some(F.col("words"), 3, 1), some(F.col("grams"), 6, 2))
    spoken = records.select(F.col("rid").alias("here"), own.alias("tokens"))
    steps = path.select("start", F.posexplode("path").alias("n", "here")).join(spoken, "here")
    return steps.groupBy("start").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "tokens"))), lambda s: s["tokens"])).alias("sentence")).select("sentence")


def token_vectors(sentences: DataFrame) -> dict[str, np.ndarray]:
    """Skip-gram vectors of the tokens: letter triples, common words, states and ZIP areas, all bounded in number."""
    sentences = cut(sentences.where(F.size("sentence") > 0))
    parts = math.ceil(sentences.count() / SENTENCES)
    if not parts:
        return {}
    model = Word2Vec(vectorSize=DIMENSIONS, windowSize=WINDOW, minCount=1, numPartitions=parts, maxIter=1, stepSize=0.05, seed=SEED, inputCol="sentence", outputCol="v").fit(sentences.repartition(parts))
    return {r.word: r.vector.toArray() for r in model.getVectors().collect()}


def vectors(prof: DataFrame, of: dict[str, np.ndarray]) -> DataFrame:
    """(pid, v): unit vectors of the names: their letter triples and their common words, half each, without the mean."""
    index = {w: n for n, w in enumerate(of)}
    matrix = np.array(list(of.values()), np.float32).reshape(-1, DIMENSIONS)
    if len(matrix):
        for kind in ("g", "w"):
            rows = [n for w, n in index.items() if w.startswith(kind)]
            if rows:
                matrix[rows] -= matrix[rows].mean(0)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)

    def side(column: pa.ListArray) -> np.ndarray:
        out = np.zeros((len(column), DIMENSIONS), np.float32)
        for n, tokens in enumerate(column.to_pylist()):
            at = [index[t] for t in tokens if t in index]
            if at:
                out[n] = matrix[at].sum(0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, w = side(b.column(1)), side(b.column(2))
            v = np.concatenate([g, 0.7 * w], 1)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(0, v.size + 1, 2 * DIMENSIONS, dtype=np.int32), v.ravel())], ["pid", "v"])

    return prof.select("pid", "grams", F.filter("words", lambda w: ~F.substring(w, 2, 99).isin(FORMS)).alias("words")).mapInArrow(make, "pid long, v array<float>")


def tables_of(planes: int) -> int:
    """Hash tables of so many signs each, for two names at LEAST_COSINE to meet in one of them with probability RECALL."""
    if not planes:
        return 1
    return math.ceil(math.log(1 - RECALL) / math.log1p(-((1 - math.acos(LEAST_COSINE) / math.pi) ** planes)))


def hashed(vecs: DataFrame) -> DataFrame:
    """(pid, block, slot) of (pid, block, planes, v): one slot (table and signs) per hash table of the block's number of planes."""

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals: dict[int, np.ndarray] = {}
        for b in batches:
            pid, block, sizes = (b.column(n).to_numpy() for n in range(3))
            v = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * DIMENSIONS)
            for size in map(int, np.unique(sizes)):
                tables = tables_of(size)
                if size not in normals:
                    normals[size] = np.random.default_rng((SEED, size)).normal(size=(2 * DIMENSIONS, tables * size)).astype(np.float32)
                at = np.flatnonzero(sizes == size)
                for own in np.array_split(at, max(1, math.ceil(len(at) * tables * max(1, size) / (1 << 22)))):
                    bits = (v[own] @ normals[size] > 0).reshape(len(own), tables, size) @ (1 << np.arange(size, dtype=np.int64)) + (np.arange(tables, dtype=np.int64) << size)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(pid[own], tables)), pa.array(np.repeat(block[own], tables)), pa.array(bits.ravel())], ["pid", "block", "slot"])

    return vecs.select("pid", "block", "planes", "v").mapInArrow(signs, "pid long, block long, slot long")


def stem(bag: Column) -> Column:
    """What ``same_words`` wants alike in two bags, whatever else they hold: all words but organisational forms, first names as initials."""
    return F.array_join(F.array_sort(F.array_distinct(initials(F.array_except(bag, F.array(*[F.lit(w) for w in FORMS]))))), " ")


def letters(word: Column) -> Column:
    """The letters of a word as bits: one wrong letter turns two at most, a missing one one."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda s, c: s.bitwiseOR(bit(c)))


def same_words(a: str, b: str) -> Column:
    """The exact check of two names (columns ``a`` and ``b`` with rare and bag): nothing that tells organisations apart differs.

    Rare parts are the same but for one typing error (long ones: one in each); common words are the same but for one
    organisational form that one name lacks, or a first name given as initial. Designations of a body
    of its own must be the same.
    """
    ra, rb = F.col(f"{a}.rare"), F.col(f"{b}.rare")
    rare = (ra == rb) | (F.length(ra) > 4) & one_error(ra, rb) | (F.least(F.length(ra), F.length(rb)) > 8) & (F.levenshtein(ra, rb, 2) >= 0)
    x, y = F.col(f"{a}.bag"), F.col(f"{b}.bag")
    marks = F.array(*[F.lit(d) for d in DESIGNATIONS])
    forms = F.array(*[F.lit(d) for d in FORMS])
    own = F.array_sort(F.array_intersect(x, marks)) == F.array_sort(F.array_intersect(y, marks))
    more, less = F.array_except(x, y), F.array_except(y, x)
    lacks = (F.size(more) + F.size(less) <= 1) & (F.size(F.array_except(F.concat(more, less), forms)) == 0) & (F.abs(F.size(x) - F.size(y)) <= 1)
    # a body with a designation of its own has no form to lack, and a name can't consist of its form alone
    lacks = lacks & ((F.size(more) + F.size(less) == 0) | ~F.arrays_overlap(F.concat(x, y), marks))
    short = (F.exists(x, lambda t: t.startswith("=")) | F.exists(y, lambda t: t.startswith("="))) & (initials(x) == initials(y))
    return rare & own & (lacks | short) & (F.length(f"{a}.rare") > 0)


def calibrated(pairs: DataFrame) -> tuple[float, float]:
    """Slope and offset of log-odds over cosine, fitted to pairs of one source (cosine, same); from counts in 200 bins."""
    bins = pairs.groupBy(F.floor(F.col("cosine") * 200).alias("b")).agg(F.sum(F.col("same").cast("double")).alias("y"), F.count("*").alias("n")).toPandas()
    x, y, n = (bins.b.to_numpy() + 0.5) / 200, bins.y.to_numpy(float), bins.n.to_numpy(float)
    if not len(x) or y.sum() in (0, n.sum()):
        return 20.0, -17.0
    w = np.array([10.0, -8.0])
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (y - n * p) - 1e-3 * w
        curve = a.T @ (a * (n * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(curve, gradient), -5, 5)
    return float(w[0]), float(w[1])


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def candidate_names(of_state: DataFrame, prof: DataFrame, vecs: DataFrame) -> DataFrame:
    """(pa, pb, name_cosine, passes), pa <= pb: pairs of names that meet in a hash table within a state (``of_state``: pid, state), with exact cosines.

    Names seen only without a state meet those of all states, and every name meets itself. ``passes`` says whether the exact
    check takes the two. Only names with the same ``stem`` meet, and whose letters differ by no more than the check allows.
    """
    keys = prof.select("pid", stem(F.col("bag")).alias("stem"), F.length("rare").alias("len"), letters(F.col("rare")).alias("letters"))
    members = cut(of_state.join(keys, "pid"))
    told = ["pid", "len", "letters"]
    home = members.where("state IS NOT NULL").select(*told, F.xxhash64("state", "stem").alias("block"), F.lit(True).alias("asks"))
    # in the blocks over all states only names without a state look for others
    lone = members.where("state IS NULL").select("pid", "stem")
    wide = members.select(*told, "stem").distinct().join(lone.select("stem").distinct(), "stem").join(lone.select("pid", F.lit(True).alias("asks")), "pid", "left")
    rows = cut(home.unionByName(wide.select(*told, F.xxhash64(F.lit("*"), "stem").alias("block"), F.coalesce("asks", F.lit(False)).alias("asks"))))
    sizes = rows.groupBy("block").agg(F.count("*").alias("n")).select("block", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / PER_SLOT))).cast("int").alias("planes"))
    slots = hashed(rows.select("pid", "block").join(sizes, "block").join(vecs, "pid"))
    slots = cut(slots.join(rows, ["pid", "block"]).select(*told, "asks", F.xxhash64("block", "slot").alias("slot")))
    a = slots.where("asks").select("slot", F.col("pid").alias("pa"), F.col("letters").alias("ta"), F.col("len").alias("na"))
    b = slots.select("slot", F.col("pid").alias("pb"), F.col("letters").alias("tb"), F.col("len").alias("nb"), "asks")
    wrong, longer = F.bit_count(F.col("ta").bitwiseXOR(F.col("tb"))), F.abs(F.col("na") - F.col("nb"))
    near = (wrong <= 2) & (longer <= 1) | (F.least("na", "nb") > 8) & (wrong <= 4) & (longer <= 2)
    pairs = a.join(b, "slot").where("pa <= pb OR pa > pb AND NOT asks").where(near).select(F.least("pa", "pb").alias("pa"), F.greatest("pa", "pb").alias("pb")).distinct()
    key = prof.select("pid", F.struct("rare", "bag").alias("k")).join(vecs, "pid")
    both = pairs.join(key.toDF("pa", "ka", "va"), "pa").join(key.toDF("pb", "kb", "vb"), "pb")
    same = (F.col("pa") == F.col("pb")) | same_words("ka", "kb")
    return both.select("pa", "pb", dot("va", "vb").alias("name_cosine"), F.coalesce(same, F.lit(False)).alias("passes")).where(F.col("name_cosine") >= LEAST_COSINE)


def reranked(pairs: DataFrame, of: dict[str, np.ndarray]) -> DataFrame:
    """``pairs`` (name_cosine, a_state, a_zip3, b_state, b_zip3) with ``cosine`` of name and place, of the name alone where a side has no place.

    Place tokens are bounded in number (states and three-digit areas), so their vectors travel with the task.
    """
    places = {t: v for t, v in of.items() if t[:1] in ("s", "z")}
    mean = np.mean(list(places.values()), 0) if places else np.zeros(DIMENSIONS)
    places = {t: (v - mean) / max(np.linalg.norm(v - mean), 1e-9) for t, v in places.items()}

    def side(state: pa.Array, area: pa.Array) -> np.ndarray:
        none = np.zeros(DIMENSIONS)
        v = np.array([places.get(f"s{s}", none) + places.get(f"z{z}", none) for s, z in zip(state.to_pylist(), area.to_pylist(), strict=True)]).reshape(-1, DIMENSIONS)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (side(b.column(f"{e}_state"), b.column(f"{e}_zip3")) for e in "ab")
            name = b.column("name_cosine").to_numpy()
            known = (np.abs(x).sum(1) > 0) & (np.abs(y).sum(1) > 0)
            cosine = np.where(known, (name + PLACE**2 * (x * y).sum(1)) / (1 + PLACE**2), name)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cosine)], [*b.schema.names, "cosine"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", cosine double"
    return pairs.mapInArrow(rerank, schema)


def scored_entities(df: DataFrame) -> tuple[DataFrame, DataFrame, float, float]:
    """Observations, (left_entity, right_entity, ls, rs, passes, cosine, confidence) of all candidates within and across sources, and slope and offset of the log-odds."""
    obs = cut(observations(df))
    prof, readings = profiles(obs)
    of = token_vectors(walks(obs, prof, readings))
    vecs = cut(vectors(prof, of))
    bearers = obs.where("clean IS NOT NULL").join(readings, "clean").groupBy("entity", "source", "pid")
    named = cut(bearers.agg(F.mode("state").alias("state"), F.mode("zip3").alias("zip3")))
    of_state = cut(obs.where("clean IS NOT NULL").join(readings, "clean").select("pid", "state").distinct())
    names = cut(candidate_names(of_state, prof, vecs))
    turned = names.where("pa < pb").select(F.col("pb").alias("pa"), F.col("pa").alias("pb"), "name_cosine", "passes")
    a = named.select(F.col("entity").alias("left_entity"), F.col("source").alias("ls"), F.col("pid").alias("pa"), F.col("state").alias("a_state"), F.col("zip3").alias("a_zip3"))
    b = named.select(F.col("entity").alias("right_entity"), F.col("source").alias("rs"), F.col("pid").alias("pb"), F.col("state").alias("b_state"), F.col("zip3").alias("b_zip3"))
    met = a.join(names.unionByName(turned), "pa").join(b, "pb").where("ls < rs OR ls = rs AND (left_entity < right_entity OR left_entity = right_entity AND pa < pb)").drop("pa", "pb")
    scored = cut(reranked(met, of).select("left_entity", "right_entity", "ls", "rs", "passes", "cosine"))
    known = ~F.col("left_entity").startswith("observation:") & ~F.col("right_entity").startswith("observation:")
    within = scored.where((F.col("ls") == F.col("rs")) & F.col("ls").isin(*SURE_SOURCES) & known)
    slope, offset = calibrated(within.select("cosine", (F.col("left_entity") == F.col("right_entity")).alias("same")))
    confidence = F.round(1 / (1 + F.exp(-(F.lit(slope) * F.col("cosine") + F.lit(offset)))), 6)
    return obs, scored.withColumn("confidence", confidence), slope, offset


def matches(df: DataFrame) -> DataFrame:
    """(left_entity, right_entity, cosine, confidence): organisations as two different sources know them that are the same.

    Two such entities match if names and places of theirs give a confidence of ``LEAST_CONFIDENCE`` at least, pass the exact check, and they share a state. An
    entity without any state matches only if all it could be are in one state.
    """
    obs, scored, _, _ = scored_entities(df)
    likely = scored.where((F.col("ls") < F.col("rs")) & F.col("passes") & (F.col("confidence") >= LEAST_CONFIDENCE))
    pairs = likely.groupBy("left_entity", "right_entity").agg(F.max("cosine").alias("cosine"), F.max("confidence").alias("confidence"))
    states = cut(obs.where("state IS NOT NULL").select("entity", "state").distinct())
    home = states.groupBy("entity").agg(F.min("state").alias("home"))
    pairs = cut(pairs.join(home.select(F.col("entity").alias("left_entity"), F.col("home").alias("lh")), "left_entity", "left").join(home.select(F.col("entity").alias("right_entity"), F.col("home").alias("rh")), "right_entity", "left"))
    shared = pairs.where("lh IS NOT NULL AND rh IS NOT NULL").join(states.select(F.col("entity").alias("left_entity"), "state"), "left_entity")
    shared = shared.join(states.select(F.col("entity").alias("right_entity"), "state"), ["right_entity", "state"]).drop("state").distinct()
    bare = pairs.where("lh IS NULL OR rh IS NULL")
    lone = F.when(F.col("lh").isNull(), F.col("left_entity")).otherwise(F.col("right_entity"))
    bare = bare.withColumn("lone", lone).withColumn("there", F.coalesce("rh", "lh"))
    one = bare.groupBy("lone").agg(F.min("there").alias("x"), F.max("there").alias("y")).where("x IS NULL OR x = y").select("lone")
    kept = shared.unionByName(bare.join(one, "lone", "left_semi").drop("lone", "there"))
    return kept.select("left_entity", "right_entity", F.round("cosine", 6).alias("cosine"), "confidence")


def reliability(df: DataFrame) -> DataFrame:
    """(decile, pairs, expected, observed): confidences against the truth, on candidates within sources of the half of the organisations that a second fit has not seen."""
    _, scored, _, _ = scored_entities(df)
    known = ~F.col("left_entity").startswith("observation:") & ~F.col("right_entity").startswith("observation:")
    within = scored.where((F.col("ls") == F.col("rs")) & F.col("ls").isin(*SURE_SOURCES) & known).select("cosine", (F.col("left_entity") == F.col("right_entity")).alias("same"), (F.pmod(F.xxhash64("left_entity"), F.lit(2)) == 1).alias("held"))
    within = cut(within)
    slope, offset = calibrated(within.where("NOT held"))
    p = 1 / (1 + F.exp(-(F.lit(slope) * F.col("cosine") + F.lit(offset))))
    return within.where("held").groupBy(F.least(F.floor(p * 10), F.lit(9)).alias("decile")).agg(F.count("*").alias("pairs"), F.round(F.avg(p), 4).alias("expected"), F.round(F.avg(F.col("same").cast("double")), 4).alias("observed"))


def observation_pairs(df: DataFrame, matched: DataFrame) -> DataFrame:
    """(left_observation_id, right_observation_id, confidence), left < right: matches spread to the observations of both sides."""
    obs = observations(df).select("id", "entity", "source")
    a = obs.select(F.col("id").alias("x"), F.col("entity").alias("left_entity"), F.col("source").alias("sx"))
    b = obs.select(F.col("id").alias("y"), F.col("entity").alias("right_entity"), F.col("source").alias("sy"))
    pairs = a.join(matched, "left_entity").join(b, "right_entity").where("sx <> sy")
    return pairs.select(F.least("x", "y").alias("left_observation_id"), F.greatest("x", "y").alias("right_observation_id"), "confidence").distinct()


def p7_reliability(spark, sf_dir: str) -> DataFrame:
    """How far the confidences hold on organisations that the fit has not seen."""
    return reliability(table(spark, sf_dir, "entity_observations"))


def p7_matches(spark, sf_dir: str) -> DataFrame:
    """Matches between organisations as the sources know them, with confidences."""
    return matches(table(spark, sf_dir, "entity_observations"))


def p7_members(spark, sf_dir: str) -> DataFrame:
    """Membership: the organisation, as its source knows it, of each observation; ``p7_matches`` links these."""
    return observations(table(spark, sf_dir, "entity_observations")).select(F.col("id").alias("observation_id"), "source", "entity")


def p7_found(spark, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "entity_observations")
    return observation_pairs(df, matches(df)).select("left_observation_id", "right_observation_id").distinct()
