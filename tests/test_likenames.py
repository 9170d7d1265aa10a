"""Names that can be alike are found without comparing all that share a word."""

import random
from difflib import SequenceMatcher

from ledgerloom.operators import entities, likenames
from pyspark.sql import functions as F


def _observations(spark, n):
    rng = random.Random(7)
    part = lambda: "".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(4, 9)))
    names = []
    for k in range(n):
        words = [part(), part(), "community", rng.choice(["foundation", "council"])] + rng.choice([[], [], ["pacific"], ["europe"]])
        near = list(words)
        near[rng.randrange(2)] = near[rng.randrange(2)][:-1] + "x"
        rng.shuffle(near) if rng.random() < 0.3 else None
        names += [("IRS990", " ".join(words)), ("LDA", " ".join(near if rng.random() < 0.8 else [*near, "japan"]))]
    names += [("IRS990", "very long community name " * 4), ("LDA", "very long community names " * 4), ("IRS990", None), ("LDA", "")]
    rows = [(k, s, name, f"{k // 2} main street", "x", "NY", "10001") for k, (s, name) in enumerate(names)]
    return spark.createDataFrame(rows, "observation_id long, source_system string, observed_name string, address string, city string, state string, zip_code string")


def test_no_pair_that_reaches_the_score_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(likenames, "BLOCK", 7)
    monkeypatch.setattr(likenames, "AT_ONCE", 100)
    o = _observations(spark, 60)
    left, right = entities._sides(o)
    core = lambda p: F.when(F.size(p["core"]) > 0, p["core"]).otherwise(p["tokens"])
    long = lambda p: F.filter(F.split(p["normalized"], " "), lambda w: F.length(w) >= 5)
    for words, least, more, got in (
        (core, 0.78, "relationship <> 'similar_name'", entities.relationship_candidates(o)),
        (long, 0.92, "true", entities.token_candidates(o)),
        (long, 0.8, "true", entities.token_candidates(o, 0.8)),
    ):
        every = entities.compared(left.crossJoin(right)).where((F.col("score") >= least) & F.expr(more) & (F.col("lp.normalized") != F.col("rp.normalized")))
        want = {(r.l_id, r.r_id, r.score) for r in every.where(F.arrays_overlap(words(F.col("lp")), words(F.col("rp")))).collect()}
        assert {(r.l_id, r.r_id, r.score) for r in got.collect()} == want and want


def test_common_words_bring_few_pairs(spark):
    left, right = entities._sides(_observations(spark, 300))
    of = lambda df, s: df.where(f"{s}p.normalized <> ''").select(F.col(f"{s}_id").alias("id"), f"{s}p.core", F.col(f"{s}p.normalized").alias("full"))
    a, b = (of(df, s).select("id", F.array_distinct("core").alias("words"), "full", F.array_join("core", " ").alias("core"), F.array_distinct("core").alias("anchor"), F.lit("").alias("kind")) for df, s in ((left, "l"), (right, "r")))
    got = {tuple(r) for r in likenames.like_names(a, b, 0.9, "any").collect()}
    names = {r.id: r.full for r in a.unionByName(b).collect()}
    alike = {(x.id, y.id) for x in a.collect() for y in b.collect() if SequenceMatcher(None, names[x.id], names[y.id]).ratio() >= 0.9}
    assert alike <= got and len(got) < 3000


def test_names_of_one_kind_meet_by_two_rare_words_only(spark):
    """Aliases are found without pairing all names that share a common word."""
    places, things = ["forks", "harbor", "meadows", "ridge"], ["dental hygienists", "food bank", "credit unions"]
    rng = random.Random(3)
    stem = lambda: "".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(6, 9)))
    a, b = [("foundation", "")], [("foundation", ""), ("foundation fund", ""), ("foundation pacific", "pacific")]
    for _ in range(120):
        words = [stem(), rng.choice(places), *rng.choice(things).split(), "foundation"]
        near = [words[0][:-1] + "1" if rng.random() < 0.5 else words[0], *words[1:]]
        a.append((" ".join(words), ""))
        b += [(" ".join([*near, "charitable"]), ""), (" ".join(near[:4]), ""), (" ".join([*near, "of", "many", "further", "small", "trusts"]), "")]
    of = lambda rows: spark.createDataFrame([(n, t.split(), t, t, list(dict.fromkeys(t.split())), k) for n, (t, k) in enumerate(rows)], "id long, words array<string>, full string, core string, anchor array<string>, kind string")
    left, right = of(a), of(b)
    want = set()
    for i, (x, k) in enumerate(a):
        for j, (y, q) in enumerate(b):
            p, r = set(x.split()), set(y.split())
            if k == q and len(p & r) >= 0.8 * min(len(p), len(r)) and SequenceMatcher(None, x, y).ratio() >= 0.8:
                want.add((i, j))
    got = {tuple(r) for r in likenames.contained_names(left, right).collect()}
    assert want <= got and len(got) < 2 * len(want) and (0, 0) in want
    other = likenames.like_names(left, right, 0.5, "other").collect()
    assert {(r.l_id, r.r_id) for r in other} >= {(0, 2)} and all(r.r_id == 2 for r in other)
