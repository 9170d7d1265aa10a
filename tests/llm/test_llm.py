import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import components, crossmatch, mixing, names, packing, places, residue, topn
from ledgerloom.llm.tokens import token_counts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# groups


def brute_groups(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return sorted((x, root(x)) for x in parent)


def test_groups_against_brute_force(spark):
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(220)]
    pairs += [("hub", f"x{k}") for k in range(200)] + [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(60)] + pairs[:20]
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "a string, b string, group string")
    assert rows(components.components(df, "a", "b")) == brute_groups(pairs)


def test_groups_of_nothing_and_of_nulls(spark):
    empty = spark.createDataFrame([], "a string, b string")
    assert components.components(empty, "a", "b").count() == 0
    df = spark.createDataFrame([("a", None), (None, None), ("b", "b")], "a string, b string")
    assert rows(components.components(df, "a", "b")) == [("b", "b")]


def test_counted_links(spark):
    links = spark.createDataFrame(
        [("12-3456789", "LDA", " AbC ", 1), (" 3456789", "FEC", "C1", 2), (None, "FEC", "C1", 1), ("1", None, "z", 1), ("1", "FEC", "  ", 1), ("5", "FEC", "C9", 3)],
        "ein string, external_source_system string, external_source_record_id string, candidate_id long",
    )
    current = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, None)], "candidate_id long, is_current long")
    assert rows(components.counted_links(links, current)) == [("ein:003456789", "fec:c1"), ("ein:123456789", "lda:abc")]


# top n


def test_top_n_ties_nulls_and_repeats(spark):
    df = spark.createDataFrame([("a", "2020", 1), ("a", "2020", 2), ("a", None, 9), ("a", "2021", 3), (None, "2022", 4), ("b", None, 5), ("b", None, 5)], "g string, s string, id int")
    assert rows(topn.top_n(df, "g", ["s"], "id", 3)) == [("a", 1, 3), ("a", 2, 2), ("a", 3, 1), ("b", 5, 1), ("b", 5, 2)]
    assert topn.top_n(df.limit(0), "g", ["s"], "id", 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, "g", ["s"], "id", 0)


def test_top_n_in_a_hot_group(spark):
    df = spark.range(100_000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 100_003).alias("s"), "id", F.lit(1).alias("item"))
    want = [r.id for r in df.orderBy(F.desc("s"), F.desc("id")).limit(5).collect()]
    assert [r.id for r in topn.top_n(df, "g", ["s"], "id", 5).orderBy("rank").collect()] == want


# names

FIELDS = "name string, entity string"


def test_spellings_of_one_name(spark):
    full = "Brexplempgrave Plateau Public Broadcasting Coalition"
    same = [full, full.upper() + "  ", "Public Broadcasting Coaln of Brexplempgrave Plateau", "Brexplempgrve Plateau Public Broadcasting Coalition, Inc.", "The Brexplempgrave Plateau Public Broadcasting Coalition (BPPBC)", "Some Agents LLC ON BEHALF OF " + full, "Bréxplempgrave Plateau Public Broadcasting Coalition", "Brexplempgrave Plateau Public Broadcasting"]
    other = ["Brexplempgrave Plateau Public Broadcasting Auxiliary", "Robert Vane Memorial Fund", "Bob Vane Mem. Fund", "R. Vane Memorial Fund", "Susan Vane Memorial Fund", None, "", "   ", "x" * 50_000]
    # the common words must be common: fill up with other names of the kind
    rest = [f"Qor{a}{b}vik Plateau Public Broadcasting {w}" for a in "bcdfgh" for b in "klmnpr" for w in ("Coalition", "Auxiliary")]
    df = spark.createDataFrame([(n, "e") for n in same + other + rest + same[:2]], FIELDS)
    found = {r.name: r.entity for r in names.linked_names(df).collect()}
    written = lambda n: " ".join(n.upper().split())
    assert len({found[written(n)] for n in same}) == 1
    assert found[written(other[0])] != found[written(full)]
    assert found["ROBERT VANE MEMORIAL FUND"] == found["BOB VANE MEM. FUND"] == found["R. VANE MEMORIAL FUND"] != found["SUSAN VANE MEMORIAL FUND"]
    assert "" not in found
    pairs = rows(names.name_pairs(names.linked_names(df)))
    assert ("BOB VANE MEM. FUND", "ROBERT VANE MEMORIAL FUND") in pairs and all(a < b for a, b in pairs)


def test_orders_initials_and_long_names(spark):
    long = "".join(random.Random(6).choice("BCDFGHJKLMNPQRSTVWXZ") for _ in range(300))
    same = [("Garcia Lopez Foundation", "Lopez Garcia Foundation"), ("Kowalczyk Brennan Trust", "Brennan Kowalczyk Trust"), ("J Smithers", "John Smithers"), ("Zelda Dunmore Trust", "Dunmore, Zelda Trust"), ("Zelda Dunmore Trust", "Z Dunmore Trust"), (long, long[:100] + long[101:]), (long, long[:250] + "Y" + long[250:])]
    df = spark.createDataFrame([(n,) for p in same for n in p], "name string")
    found = {r.name: (r.entity, r.score) for r in names.linked_names(df).collect()}
    for a, b in same:
        assert found[a.upper()][0] == found[b.upper()][0], (a, b)
    assert all(0 < s <= 1 for _, s in found.values())
    # an initial of two different persons tells nothing
    two = spark.createDataFrame([("J Smithers",), ("John Smithers",), ("James Smithers",)], "name string")
    found = {r.name: r.entity for r in names.linked_names(two).collect()}
    assert len(set(found.values())) == 3


@pytest.mark.parametrize("length", [5, 119, 120, 121, 122, 200])
def test_words_one_error_apart_share_a_form(spark, length):
    rng = random.Random(length)
    word = "".join(rng.choice("ABCDEFGH") for _ in range(length))
    others = set()
    for i in range(0, length, max(1, length // 12)):
        others |= {word[:i] + "Z" + word[i:], word[:i] + word[i + 1 :], word[:i] + "Z" + word[i + 1 :], word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :]}
    df = spark.createDataFrame([(word, o) for o in others], "a string, b string")
    assert df.where(~F.arrays_overlap(names.one_out(F.col("a")), names.one_out(F.col("b")))).count() == 0


def test_no_names(spark):
    assert names.linked_names(spark.createDataFrame([], "name string")).count() == 0


# places

RECORD = "record_key string, written string, address string, city string, state string, zip string"


def records(spark, data):
    full = [(k, " ".join(" ".join(x for x in r if x).upper().split()), *[x.upper() if x else x for x in r]) for k, *r in data]
    return spark.createDataFrame(full, RECORD)


def test_one_place_written_in_many_ways(spark):
    data = [
        ("a1", "250 W Harbor Street Suite 500", "Saint Brook", "NY", "12345"),
        ("a2", "250 West Harbor St. #500", "St. Brook", "New York", "12345-6789"),
        ("a3", "Ste 500, 250 W. Harbor Str", "Saint Brok", "NY", "12345"),
        ("a4", "Attn: Finance, 250 W Harbor St, Saint Brook, NY", "Saint Brook", None, "12345"),
        ("a5", "250 W Harbor St Suite 600", "Saint Brook", "NY", "12345"),
        ("a6", "250 W Harbor Avenue Suite 500", "Saint Brook", "NY", "12345"),
        ("b1", "PO Box 77", "Saint Brook", "NY", "12345"),
        ("b2", "P.O.Box #77", "SAINT BROOK", "NY", None),
        ("c1", "", None, None, None),
        ("d1", "One Fifth Ave", "Saint Brook", "NY", "12345"),
        ("d2", "1 5th Avenue", None, "NY", "12345"),
    ]
    got = {tuple(r) for r in places.same_place_pairs(places.spots(records(spark, data))[0]).collect()}
    assert {("a1", "a2"), ("a1", "a3"), ("a2", "a3"), ("a1", "a4"), ("a4", "a5"), ("b1", "b2"), ("d1", "d2")} <= got
    assert not any("a6" in p for p in got) and ("a1", "a5") not in got and not any("c1" in p for p in got)


def test_records_written_alike_are_no_pair(spark):
    same = ("250 W Harbor Street", "Saint Brook", "NY", "12345")
    assert places.same_place_pairs(places.spots(records(spark, [("a", *same), ("b", *same)]))[0]).count() == 0
    assert places.spots(records(spark, [("x", None, None, None, None)]))[0].count() == 0


def test_ambiguous_places_stay_explicit(spark):
    data = [("a", "7 Main St", "Ashby", "OH", "44001"), ("b", "7 Main St", "Dover", "OH", "44002"), ("c", "7 Main St", None, "OH", None), ("d", "9 Lake Rd", "Ashby", "OH", "44001"), ("e", "9 Lake Road", None, "OH", None)]
    found, candidates = places.spots(records(spark, data))
    got = {r.record_key: r for r in found.collect()}
    assert (got["c"].open_level, got["c"].candidates, got["c"].spot) == ("locality", 2, None)
    assert got["e"].open_level is None and got["e"].spot == got["d"].spot
    assert {r.place for r in candidates.collect()} == {"OH|ASHBY", "OH|DOVER"}


# residue


def corpus(spark, extra):
    rng = random.Random(8)
    prose = ["The committee heard testimony on river cleanups from ferry crews.", "Volunteers gave many hours to the audit committee.", "Line 8 [as amended] and item {8} remain in force.", "Grants under $700 are listed in total.", "The draft left the word \"household\" undefined, and staff asked for a fix."]
    labels = ["first name", "county", "grant amount", "board chair", "fiscal year"]
    forms = ["{{%s}}", "${%s}", "<%% %s %%>", "[INSERT %s]", "@@%s@@", "{%s}"]  # the last form is not trusted
    errors = ["Page not found", "Access denied", "Bad gateway", "The request took too long", "Rate limit reached, slow down"]
    frames = ['{"status": 404, "error": "%s"}', "Error 500 - %s", "Sorry! %s (code 403)\nHome | About | Donate", "HTTP 502: %s"]
    frames = [f"{f}{tail}" for f in frames for tail in (" please refresh or come back later", " try searching instead or contact the webmaster", "")]
    rows = [" ".join(rng.choice(prose) for _ in range(6)) for _ in range(600)]
    rows += [rng.choice(prose) + " The office in " + rng.choice(forms) % rng.choice(labels).replace(" ", "_") + " is open." for _ in range(400)]
    rows += [rng.choice(frames) % rng.choice(errors) for _ in range(500)]
    rows += ["lorem ipsum " + " ".join(rng.choice(["dolor", "amet", "sit", "velunta"]) for _ in range(12)) for _ in range(30)]
    data = [*extra, *((1000 + k, t) for k, t in enumerate(rows))]
    return spark.createDataFrame(data, "doc_id long, text string").withColumn("kind", F.lit(0)).withColumn("odds", F.lit(1)), prose


def test_residue_and_its_mentions(spark):
    prose = "The committee heard testimony on river cleanups from ferry crews. Volunteers gave many hours to the audit committee."
    # forms and wordings that are nowhere trusted: learned from what they share with the trusted ones
    bad = {1: "Dear {{first_name}}, thank you.", 2: "Access denied\nHome | About | Donate", 3: "Lorem ipsum dolor sit amet velunta.", 4: prose + " The office in {county} is open.", 5: "The request took too long please refresh or come back later", 6: "asdf asdf asdf asdf asdf", 7: "Ipsum velunta dolor amet sit amet dolor amet sit velunta dolor.", 8: "HTTP 429: rate limit reached, slow down"}
    good = {20: prose, 21: prose + "\nBest viewed with JavaScript enabled.", 22: 'Staff removes tokens such as "{{first_name}}" from the file.', 23: None, 24: "", 25: "   ", 26: "Line 8 [as amended] and item {8} remain in force.", 27: prose * 3000, 28: 'The draft left the word "household" undefined, and staff asked for a fix.'}
    df, _ = corpus(spark, [*bad.items(), *good.items()])
    got = {r.doc_id for r in residue.residue(df).collect()}
    assert {k for k in got if k < 1000} == set(bad)


def test_without_the_model_there_is_no_residue(spark, monkeypatch):
    df, _ = corpus(spark, [])
    assert residue.residue(df).count() > 200
    flat = residue.Model(np.zeros((residue.BUCKETS, 5)), np.log([0.9, 0.1, 0.9, 0.05, 0.05]))
    monkeypatch.setattr(residue, "learn", lambda feats, rounds=0: flat)
    assert residue.residue(df).count() == 0


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert residue.residue(empty).count() == 0


# packing


def test_patterns_use_every_item():
    rng = random.Random(2)
    for capacity in (10, 64, 512):
        lengths = {rng.randrange(1, capacity + 1): rng.randrange(1, 50) for _ in range(30)}
        used = {}
        for t, times, use in packing.patterns(lengths, capacity):
            assert all(packing.tier(n, capacity) >= t for n, _ in use)
            assert times >= 1 and sum(n * k for n, k in use) <= capacity
            for n, k in use:
                used[n] = used.get(n, 0) + n * 0 + k * times
        assert used == lengths
    assert packing.patterns({}, 8) == [] and packing.patterns({0: 5, 9: 1}, 8) == []


def test_packing(spark):
    rng = random.Random(3)
    data = [(k, rng.choice([1, 2, 3, 5, 7, 11, 20, 64, 64, 150])) for k in range(2000)] + [(5000, None), (5001, 0), (5002, 64), (5002, 64)]
    df = spark.createDataFrame(data, "doc_id long, n_tokens int").withColumn("part", F.lit("x"))
    got = packing.pack(df, 64).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r.n_tokens)
    assert {k: sum(v) for k, v in pieces.items()} == {k: (128 if k == 5002 else n) for k, n in data if n}
    assert all(len(v) == -(-dict(data)[k] // 64) for k, v in pieces.items() if k != 5002)
    boxes = {}
    for r in got:
        boxes.setdefault(r.container, []).append((r.starts_at, r.n_tokens, r.step_group))
    for items in boxes.values():
        end = 0
        for at, n, _ in sorted(items):
            assert at == end
            end += n
        assert end <= 64 and len({g for _, _, g in items}) == 1
    total = sum(r.n_tokens for r in got)
    assert total / (64 * len(boxes)) > 0.98
    assert packing.pack(df.limit(0), 64).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "a " * 100_000)], "doc_id long, text string")
    got = dict(rows(token_counts(df)))
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 100_000


# mixing


def test_mix_meets_targets_within_caps(spark):
    words = {"a": "river water cleanup", "b": "tax budget revenue", "c": "music youth theater"}
    data = [(n, f"{words[s]} {n}" * (1 + n % 5), s) for n, s in enumerate(["a"] * 600 + ["b"] * 300 + ["c"] * 20)] + [(9001, None, "a"), (9002, "", "b"), (9003, "river water", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("p", F.lit(1))
    targets = spark.createDataFrame([("m", "a", 0.5, 1, 0.5), ("m", "b", 0.4, 2, 0.5), ("m", "c", 0.1, 2, 0.5), ("m", "zz", 0.0, 1, 0.5), (None, "a", 0.5, 1, 0.5)], "mix_name string, source string, target_share double, max_repeats int, budget_share double")
    taken = mixing.mixed(docs, targets)
    got = {r.source: r for r in mixing.shares(taken, targets.where("mix_name IS NOT NULL"), token_counts(docs)).collect()}
    for s in "ab":
        assert got[s].actual_tokens == pytest.approx(got[s].target_tokens, rel=0.03)
    assert got["c"].most_copies == 2 and got["c"].actual_tokens < got["c"].target_tokens
    assert got["zz"].actual_tokens == 0
    assert taken.where("copies < 1").count() == 0
    assert mixing.mixed(docs.limit(0), targets).count() == 0


def test_mix_counts_documents_without_source(spark):
    words = {"a": "river water cleanup", "b": "tax budget revenue"}
    data = [(n, f"{words[s]} {n}" * (1 + n % 5), s if n % 3 else None) for n, s in enumerate(["a"] * 600 + ["b"] * 300)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "a", 0.6, 1, 0.4), ("m", "b", 0.4, 1, 0.4)], "mix_name string, source string, target_share double, max_repeats int, budget_share double")
    taken = mixing.mixed(docs, targets)
    got = {r.source: r for r in mixing.shares(taken, targets, token_counts(docs)).collect()}
    all_ = taken.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0]
    assert all_ == sum(r.actual_tokens for r in got.values())
    for s in "ab":
        assert got[s].actual_tokens == pytest.approx(got[s].target_tokens, rel=0.03)


def test_mix_rates_are_fitted_by_document(spark):
    """Documents of one source have rates by their own membership, and expected totals meet the targets."""
    data = [(n, [0.5 + n / 400, 0.5 - n / 400], 10 + n % 7, 0) for n in range(200)] + [(n, [0.1, 0.9], 10, 1) for n in range(200, 400)]
    df = spark.createDataFrame(data, "k long, p array<float>, n_tokens int, own int")
    share, cap = np.array([[0.3, 0.1]]), np.array([[2.0, 2.0]])
    rates = mixing.fitted(df, share, cap)
    p, t, own = np.array([r[1] for r in data]), np.array([r[2] for r in data]), np.array([r[3] for r in data])
    got = rates.of(p, own)[:, 0]
    assert len({round(x, 6) for x in got[:200]}) == 200
    assert (got >= 0).all() and (got <= 2).all()
    assert (got * t) @ p / t.sum() == pytest.approx(share[0], rel=0.05)


# matching across sources

OBS = "observation_id long, source_system string, native_identifier string, observed_name string, normalized_name string, state string, zip_code string"


def test_matches_across_sources(spark):
    rng = random.Random(4)
    part = lambda: "".join(rng.choice(["bra", "kol", "ven", "dus", "mip", "tar", "fex", "gol"]) for _ in range(4))
    data, n = [], 0
    for _ in range(60):
        p = part().title()
        for source, name in (("IRS990", f"{p} Valley Food Bank Network"), ("LDA", f"FOOD BANK NETWORK OF {p.upper()} VALLEY"), ("FEC", f"{p} Valley Food Bank Network PAC")):
            data.append((n, source, f"{source}{n}", name, None, "NY", "10001"))
            n += 1
    data += [(900, "IRS990", "x1", "Kolvendus Valley Food Bank Network", None, "CA", None), (901, "LDA", "y1", "KOLVENDUS VALLEY FOOD BANK NETWORK", None, "TX", None), (902, "FEC", None, None, None, None, None)]
    df = spark.createDataFrame(data, OBS).withColumn("id", F.lit(0)).withColumn("entity", F.lit(0))
    matched = crossmatch.matches(df)
    got = {(r.left_observation_id, r.right_observation_id) for r in crossmatch.observation_pairs(df, matched).collect()}
    want = {(3 * k + a, 3 * k + b) for k in range(60) for a, b in ((0, 1), (0, 2), (1, 2))}
    assert len(want & got) >= 0.98 * len(want)
    assert not any(900 in p or 901 in p or 902 in p for p in got)
    assert all(0 <= r.confidence <= 1 for r in matched.collect())


def test_nothing_to_match(spark):
    df = spark.createDataFrame([(1, "LDA", None, None, None, None, None)], OBS)
    assert crossmatch.observation_pairs(df, crossmatch.matches(df)).count() == 0


def test_near_names_meet_down_to_the_least_cosine(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("BCDFGHJKLMNPQRSTVWXZ"), 9)) for _ in range(400)]
    one = rng.normal(size=(400, 2 * crossmatch.DIMENSIONS))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    off = rng.normal(size=one.shape)
    off -= (off * one).sum(1, keepdims=True) * one
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    both = np.stack([one, 0.6 * one + 0.8 * off], 1).reshape(800, -1)
    rares = [r for w in words for r in (w, w[:4] + "A" + w[5:])]
    prof = spark.createDataFrame([(k, r, r, ["FUND"]) for k, r in enumerate(rares)], "pid long, clean string, rare string, bag array<string>")
    vecs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(both)], "pid long, v array<float>")
    of_state = spark.createDataFrame([(k, "OH" if k % 3 else None) for k in range(len(rares))], "pid long, state string")
    found = crossmatch.candidate_names(of_state, prof, vecs).collect()
    assert {r.pa for r in found if r.pa == r.pb} == set(range(len(rares)))  # every name meets itself
    got = {(r.pa, r.pb) for r in found if r.passes and r.pa < r.pb}
    # of the names without a state each meets all; the others meet within the state
    want = {(2 * k, 2 * k + 1) for k in range(400)}
    assert len(got & want) >= 0.9 * len(want)
    assert got <= want
