"""Problem 1: variant spellings of names typed by people, by canonical rewritings and equi-joins.

A name is rewritten step by step: accents, agents and brackets go; every token becomes its canonical
reading (abbreviation, nickname, one typing error away from a common word, cut-off last word); legal
forms and token order are dropped. What is left is a key: the distinguishing tokens, which are rare
in the data, and a bag of common words. Keys are then joined by the forms that rewriting rules
produce (one letter of the rare part left out, rare tokens in alphabetical order, organisational form
left out, first name or any rare token as initial), and a form counts by its rarity: one over the number
of different keys that have it. A rewriting that several different keys share links nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import shuffled
from ..session import cut, discard, table

# Spellings and their readings.
ABBREVIATIONS = {
    "ADV": "ADVISED", "ALL": "ALLIANCE", "ASSN": "ASSOCIATION", "ASSOC": "ASSOCIATION", "AUX": "AUXILIARY", "CENT": "CENTRAL", "CENTRE": "CENTER", "CHAR": "CHARITABLE",
    "CMTE": "COMMITTEE", "CMTY": "COMMUNITY", "CNCL": "COUNCIL", "CNTY": "COUNTY", "COAL": "COALITION", "COALN": "COALITION", "COMM": "COMMITTEE", "COMMTY": "COMMUNITY",
    "CONSV": "CONSERVATION", "COOP": "COOPERATIVE", "CORP": "CORPORATION", "COUN": "COUNCIL", "CTR": "CENTER", "DEV": "DEVELOPMENT", "DEVEL": "DEVELOPMENT",
    "ED": "EDUCATION", "EDUC": "EDUCATION", "ENDOW": "ENDOWMENT", "FAM": "FAMILY", "FDN": "FOUNDATION", "FED": "FEDERATION", "FEDN": "FEDERATION", "FND": "FUND", "FNDTN": "FOUNDATION", "INTL": "INTERNATIONAL",
    "FOUND": "FOUNDATION", "HIST": "HISTORICAL", "HLTH": "HEALTH", "HOSP": "HOSPITAL", "HRTG": "HERITAGE", "INST": "INSTITUTE", "JCT": "JUNCTION", "LG": "LEAGUE",
    "MEM": "MEMORIAL", "METRO": "METROPOLITAN", "MFRS": "MANUFACTURERS", "NATL": "NATIONAL", "NO": "NORTHERN", "NTWK": "NETWORK", "PENIN": "PENINSULA", "PTNRSHP": "PARTNERSHIP",
    "PUB": "PUBLIC", "SCHOL": "SCHOLARSHIP", "SCHS": "SCHOOLS", "SCI": "SCIENCE", "SO": "SOUTHERN", "SOC": "SOCIETY", "SVC": "SERVICES", "SVCS": "SERVICES", "SYS": "SYSTEMS",
    "TR": "TRUST", "TWP": "TOWNSHIP", "VETS": "VETERANS", "VLY": "VALLEY", "WKFCE": "WORKFORCE",
}
KNOWN = ["ADVISED", "AMERICAN", "DONOR", "GIFT", "INTERNATIONAL", "LODGE", "NATIONAL", "UNITED"]
DIRECTIONS = {"E": "EASTERN", "N": "NORTHERN", "S": "SOUTHERN", "W": "WESTERN"}
NICKNAMES = {
    "ABIGAIL": "ABBY ABBIE GAIL", "ALEXANDER": "ALEX ALEC", "ANDREW": "ANDY DREW", "ANTHONY": "TONY", "BARBARA": "BARB BARBIE BABS", "BENJAMIN": "BEN BENNY", "CATHERINE": "CATHY",
    "CHARLES": "CHUCK CHARLIE CHAS", "CHRISTOPHER": "CHRIS KIT", "DANIEL": "DAN DANNY", "DAVID": "DAVE DAVEY", "DEBORAH": "DEB DEBBIE", "DONALD": "DON DONNIE", "DOROTHY": "DOT DOTTIE",
    "EDWARD": "EDDIE NED", "ELIZABETH": "LIZ BETH BETTY BETSY LIZZIE ELIZA LIBBY", "FRANCES": "FRAN FRANKIE FANNY", "FRANCIS": "FRANK", "GERALD": "GERRY JERRY", "GREGORY": "GREG",
    "HAROLD": "HAL HARRY", "HENRY": "HANK", "JACOB": "JAKE", "JAMES": "JIM JIMMY JAMIE JAS", "JENNIFER": "JEN JENNY", "JESSICA": "JESS JESSIE", "JOHN": "JACK JOHNNY", "JOSEPH": "JOE JOEY",
    "JUDITH": "JUDY", "KATHERINE": "KATE KATHY KATIE KAY", "KENNETH": "KEN KENNY", "LAWRENCE": "LARRY LAURIE LARS", "LEONARD": "LEN LENNY", "MARGARET": "MEG MAGGIE PEGGY MARGE PEG",
    "MATTHEW": "MATT", "MICHAEL": "MIKE MICK MICKEY", "NICHOLAS": "NICK", "PAMELA": "PAM", "PATRICIA": "PAT PATTY TRISH PATTI TRICIA", "PETER": "PETE", "PHILIP": "PHIL", "REBECCA": "BECKY BECCA",
    "RICHARD": "RICK DICK RICH RICKY", "ROBERT": "BOB ROB BOBBY ROBBIE BERT ROBT", "RONALD": "RON RONNIE", "SAMUEL": "SAM SAMMY", "STEPHEN": "STEVE", "STEVEN": "STEVIE", "SUSAN": "SUE SUSIE SUZIE SUZY",
    "THEODORE": "TED TEDDY THEO", "THOMAS": "TOM TOMMY", "TIMOTHY": "TIM TIMMY", "VICTORIA": "VICKY TORI", "VIRGINIA": "GINNY", "WILLIAM": "BILL BILLY WILL WILLY WILLIE LIAM WM",
}
FORMS = ["ALLIANCE", "ASSOCIATION", "CENTER", "COALITION", "COMMITTEE", "CORPORATION", "COUNCIL", "FEDERATION", "FOUNDATION", "INSTITUTE", "LEAGUE", "NETWORK", "PARTNERSHIP", "SERVICE", "SOCIETY", "TRUST"]
#: Words with which a body of its own beside the main one calls itself.
DESIGNATIONS = ["ACTION", "AUXILIARY", "ENDOWMENT", "FUND", "PAC", "POLITICAL"]
PERSONAL = ["CHARITABLE", "CONSULTING", "FAMILY", "FOUNDATION", "MEMORIAL", "TRUST"]
LEGAL = ["CO", "INC", "INCORPORATED", "LLC", "LLP", "LTD", "LIMITED", "PLLC"]
FILLERS = ["A", "AN", "AND", "DR", "FOR", "IN", "MR", "MRS", "MS", "OF", "THE"]
ACCENTED = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUNCY"
#: A token is common if it stands in at least this share of all cleaned names, beyond doubt (DOUBT standard errors: what few names
#: show by chance does not count). So common words are at most some thousands, and the same ones in tables of any size.
COMMON, DOUBT = 0.002, 3.0
#: Words of more letters have two halves instead of forms with one letter out.
LONG = 120


def written(name: Column) -> Column:
    """A name as names are compared: upper case, outer blanks gone, runs of blanks as one."""
    return F.trim(F.regexp_replace(F.upper(name), r"\s+", " "))


def cleaned(name: Column) -> Column:
    """Accents, agents, bracketed initials, punctuation and ``& FAMILY`` gone; split words that belong together joined."""
    t = F.translate(name, ACCENTED, PLAIN)
    t = F.regexp_replace(t, r"^.*\b(?:ON BEHALF OF|O/B/O|OBO|C/O) ", "")
    t = F.regexp_replace(t, r"\s*\([^)]*\)\s*$", "")
    t = F.regexp_replace(t, r" (?:&|AND) FAM(?:ILY\b|\.|\b)", "")
    t = F.regexp_replace(t, r"['.’\-]", "")
    t = F.regexp_replace(t, r"[^A-Z0-9À-ÿ]+", " ")
    t = F.regexp_replace(t, r"\bDAF\b", "DONOR ADVISED")
    t = F.regexp_replace(t, r"\b(BI) (STATE)\b|\b(TRI) (COUNTY)\b|\b(CO) (OP)\b", "$1$2$3$4$5$6")
    return F.trim(t)


def singular(token: Column) -> Column:
    return F.when((F.length(token) > 3) & token.endswith("S") & ~token.endswith("SS"), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def one_out(word: Column) -> Column:
    """Forms of a word such that two words one typing error apart share one: all that is left of it with one letter out.

    For long words, whose forms would grow as the square of their length, a first and a second half: the error is in one of them only.
    A word has those halves for its own length and its neighbours', since the other may be one letter longer or shorter.
    """
    length = F.length(word)
    parts = F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, length)))))
    half = lambda n: F.floor(n / 2).cast("int")
    head = lambda n: F.concat_ws(":", F.lit("<"), n.cast("string"), F.substring(word, F.lit(1), half(n) - 1))
    tail = lambda n: F.concat_ws(":", F.lit(">"), n.cast("string"), F.substring(word, length - (n - half(n) - 2) + 1, n))
    halves = F.flatten(F.transform(F.sequence(length - 1, length + 1), lambda n: F.array(head(n), tail(n))))
    return F.when(length < LONG, parts).when(length == LONG, F.concat(parts, halves)).otherwise(halves)


def one_error(a: Column, b: Column) -> Column:
    """At most one letter wrong, missing, too many, or two neighbours exchanged."""
    d = F.levenshtein(a, b, 2)
    return (d >= 0) & (d <= 1) | (d == 2) & (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))


def followed(step: DataFrame, word: str, within: list[str]) -> DataFrame:
    """(``within``, ``word``, to) with every correction followed to its end, two, four, eight ... steps at a time.

    A correction leads to a more frequent (or as frequent and later) spelling, so there are no circles.
    """
    last = None
    while True:
        on = step.select(*within, F.col(word).alias("to"), F.col("to").alias("further"))
        far = cut(step.join(shuffled(on), [*within, "to"], "left").select(*within, word, F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        if last is not None:
            discard(last)
        step, last = far.drop("moved"), far
        if far.where("moved").isEmpty():
            return step


def token_readings(clean: DataFrame, n: int) -> DataFrame:
    """(token, reading, whole): the canonical reading of each token of ``clean``; ``whole`` = false if it only fits as a cut-off last word.

    Tokens without a row are rare: they tell one name from another.
    """
    session = clean.sparkSession
    counts = cut(clean.select(F.explode(F.array_distinct(F.split("clean", " "))).alias("token")).groupBy("token").agg(F.count("*").alias("n")))
    fixed = dict(ABBREVIATIONS) | {w: k for k, v in NICKNAMES.items() for w in [k, *v.split()]}
    fixed = session.createDataFrame(sorted(fixed.items()), "token string, reading string").withColumn("reading", singular(F.col("reading")))
    common = counts.where((F.col("n") - DOUBT * F.sqrt("n") >= F.lit(COMMON * n)) & (F.length("token") > 2)).select("token", singular(F.col("token")).alias("reading"), "n")
    common = cut(common.join(F.broadcast(fixed.select("token")), "token", "left_anti"))
    known = session.createDataFrame([(k,) for k in sorted({*NICKNAMES, *FORMS, *DESIGNATIONS, *KNOWN, *ABBREVIATIONS.values()})], "token string").select("token", singular(F.col("token")).alias("reading"), F.lit(0).alias("n"))
    words = common.unionByName(known).groupBy("token").agg(F.first("reading").alias("reading"), F.max("n").alias("n"))
    rest = counts.join(F.broadcast(words.select("token")), "token", "left_anti").join(F.broadcast(fixed.select("token")), "token", "left_anti").select("token")
    long = rest.where(F.length("token") > 2).withColumn("part", F.explode(one_out(F.col("token"))))
    parts = words.where(F.length("token") > 3).select(F.col("token").alias("word"), "reading", "n", F.explode(one_out(F.col("token"))).alias("part"))
    near = long.join(F.broadcast(parts), "part").where(one_error(F.col("token"), F.col("word")))
    near = cut(near.groupBy("token").agg(F.max_by("reading", F.struct("n", "reading")).alias("reading")))
    heads = words.select("reading", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda k: F.substring(F.col("token"), F.lit(1), k))).alias("token"))
    heads = heads.groupBy("token").agg(F.when(F.count_distinct("reading") == 1, F.min("reading")).otherwise("").alias("reading"))
    head = rest.join(near.select("token"), "token", "left_anti").join(heads, "token")
    ruled = fixed.join(F.broadcast(words.select("token")), "token", "left_anti")
    return reduce(DataFrame.unionByName, [ruled.withColumn("whole", F.lit(True)), words.select("token", "reading", F.lit(True).alias("whole")), near.withColumn("whole", F.lit(True)), head.withColumn("whole", F.lit(False))])


def name_keys(clean: DataFrame, n: int) -> DataFrame:
    """(clean, rare, parts, bag, spare): the rare tokens of each cleaned name joined in their order, the same apart, and its sorted common words.

    A name without a first name that has a single letter gives one row per reading of it: as an initial (``=X`` in the
    bag) and as a direction. ``spare`` readings are initials of names that do not look personal: they count only if a
    rewriting leads on from them.
    """
    tokens = clean.select("clean", F.posexplode(F.split("clean", " ")).alias("at", "token"), F.size(F.split("clean", " ")).alias("size"))
    tokens = tokens.withColumn("token", F.when((F.col("token") == "CO") & (F.col("at") < F.col("size") - 1), "COUNTY").otherwise(F.col("token")))
    last = F.col("at") == F.col("size") - 1
    tokens = tokens.withColumn("token", F.when(last & (F.col("token") == "CENT"), "CENTER").otherwise(F.col("token"))).where(~(last & (F.length("token") == 1) & (F.col("size") > 3)))
    tokens = tokens.where(~F.col("token").isin(*LEGAL, *FILLERS) | (F.length("token") == 1))
    read = tokens.join(token_readings(clean, n), "token", "left")
    single = F.length("token") == 1
    reading = F.when(single, F.concat(F.lit("="), "token")).when(F.col("whole") | (F.col("at") == F.col("size") - 1), F.col("reading"))
    read = read.select("clean", F.struct("at", "token", reading.alias("reading")).alias("t"))
    keys = read.groupBy("clean").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    parts = F.transform(F.filter("ts", lambda t: t["reading"].isNull()), lambda t: t["token"])
    bag = F.array_sort(F.transform(F.filter("ts", lambda t: t["reading"] != ""), lambda t: t["reading"]))
    keys = keys.select("clean", parts.alias("parts"), bag.alias("bag"))
    keys = keys.select("clean", singular(F.array_join("parts", "")).alias("rare"), "parts", "bag")
    letters = F.filter("bag", lambda t: t.startswith("="))
    firsts = F.array(*[F.lit(singular_text(k)) for k in NICKNAMES])
    words = F.filter("bag", lambda t: ~t.startswith("="))
    map_ = F.create_map(*[F.lit(x) for kv in DIRECTIONS.items() for x in kv])
    turned = F.array_sort(F.concat(words, F.filter(F.transform(letters, lambda t: map_[F.substring(t, 2, 1)]), lambda t: t.isNotNull())))
    kept = F.array_sort(F.concat(words, F.slice(letters, 1, 1)))
    turns = F.exists(letters, lambda t: map_[F.substring(t, 2, 1)].isNotNull())
    way = lambda bag, spare: F.struct(bag.alias("bag"), F.lit(spare).alias("spare"))
    personal = F.arrays_overlap(words, F.array(*[F.lit(x) for x in PERSONAL]))
    ways = F.when(F.arrays_overlap(words, firsts) | (F.size(letters) == 0), F.array(way(words, False)))
    ways = ways.when(personal & turns, F.array(way(kept, False), way(turned, False))).when(personal, F.array(way(kept, False))).otherwise(F.array(way(turned, False), way(kept, True)))
    return keys.select("clean", "rare", "parts", F.explode(F.array_distinct(ways)).alias("way")).select("clean", "rare", "parts", "way.bag", "way.spare")


def singular_text(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("S") and not word.endswith("SS") else word


def _without(bag: Column, words: list[str]) -> Column:
    return F.array_except(bag, F.array(*[F.lit(w) for w in words]))


def initials(bag: Column) -> Column:
    """The bag with first names as initials."""
    firsts = F.array(*[F.lit(singular_text(k)) for k in NICKNAMES])
    return F.array_sort(F.transform(bag, lambda t: F.when(F.array_contains(firsts, t), F.concat(F.lit("="), F.substring(t, 1, 1))).otherwise(t)))


def settle_rare(keys: DataFrame) -> DataFrame:
    """``keys`` with a typing error or another order of the rare part put right, and ``score`` = 1 / number of spellings it could be put right to.

    A spelling (its rare tokens as written, and in alphabetical order) becomes the most frequent one at most one error
    away, among names with the same other words. All spellings that share a form are compared, corrections are followed to their ends.
    """
    stem = F.array_join(_without(initials(F.col("bag")), [*FORMS, *DESIGNATIONS]), " ")
    keys = keys.withColumn("stem", stem)
    sorted_ = F.array_join(F.array_sort(F.transform("parts", singular)), "")
    spots = keys.where(F.length("rare") > 4).groupBy("rare", "stem", sorted_.alias("sorted")).agg(F.sum("n").alias("n"))
    counts = spots.groupBy("rare", "stem").agg(F.sum("n").alias("n"), F.collect_set("sorted").alias("orders"))
    counts = cut(counts.select("rare", "stem", "n", F.array_distinct(F.concat(F.array("rare"), "orders")).alias("spelt")))
    forms = counts.select("rare", "stem", "n", F.explode("spelt").alias("spelling")).select("*", F.explode(one_out(F.col("spelling"))).alias("part"))
    forms = forms.withColumn("h", F.xxhash64("part", "stem"))
    other = forms.select("h", F.col("rare").alias("to"), F.col("stem").alias("stem_to"), F.col("n").alias("m"), F.col("spelling").alias("like"))
    better = forms.join(other, "h").where("stem = stem_to AND rare <> to AND (m > n OR m = n AND to > rare)").where(one_error(F.col("spelling"), F.col("like")))
    best = cut(better.groupBy("rare", "stem").agg(F.max(F.struct("m", "to"))["to"].alias("to"), (1 / F.count_distinct("to")).alias("score")))
    ends = followed(best.select("rare", "stem", "to"), "rare", ["stem"])
    fixed = ends.join(best.drop("to"), ["rare", "stem"])
    return keys.join(fixed, ["rare", "stem"], "left").withColumns({"right": F.coalesce("to", "rare"), "score": F.coalesce("score", F.lit(1.0)), "asis": F.col("to").isNull()}).drop("to", "stem", "rare").withColumnRenamed("right", "rare")


def rewritten(keys: DataFrame) -> DataFrame:
    """For each key (rare, bag) that is a rewriting of just one fuller key: (rare, bag, full = its rare part and bag).

    The fuller key's rewritings are: one organisational form left out (not from bodies with a designation of their own),
    a listed first name as an initial, and one of several rare tokens as an initial. Rarity of a rewriting = 1 / number
    of different keys that have it; below 1 it tells nothing for certain and links nothing.
    """
    there = keys.select("rare", "bag").distinct().where("rare <> ''")
    full = keys.where("NOT spare AND rare <> ''").select("rare", "bag").distinct()
    own = ~F.arrays_overlap("bag", F.array(*[F.lit(w) for w in DESIGNATIONS]))
    dropped = F.when(own, F.transform(F.array_intersect("bag", F.array(*[F.lit(w) for w in FORMS])), lambda f: F.when(F.size(F.filter("bag", lambda t: t == f)) > 1, F.array_distinct("bag")).otherwise(F.filter("bag", lambda t: t != f))))
    plain = ~F.exists("bag", lambda t: t.startswith("="))
    short = F.when(plain, F.array(initials(F.col("bag"))))
    none = F.array().cast("array<array<string>>")
    me = F.struct("rare", "bag").alias("full")
    made = full.select(me, "rare", F.explode(F.array_distinct(F.concat(F.coalesce(dropped, none), F.coalesce(short, none)))).alias("bag")).where("bag <> full.bag AND size(bag) > 0")
    several = keys.where("asis AND NOT spare AND size(parts) > 1").where(plain).select("rare", "bag", "parts").distinct()
    one = several.select(me, "bag", "parts", F.posexplode("parts").alias("at", "token")).where(F.length("token") > 1)
    rest = F.array_join(F.filter("parts", lambda t, n: n != F.col("at")), "")
    one = one.select("full", singular(rest).alias("rare"), F.array_sort(F.concat("bag", F.array(F.concat(F.lit("="), F.substring("token", 1, 1))))).alias("bag"))
    made = made.unionByName(one).distinct().join(there, ["rare", "bag"], "left_semi")
    return made.groupBy("rare", "bag").agg(F.min("full").alias("full"), (1 / F.count("*")).alias("rarity")).where("rarity = 1").drop("rarity")


def linked_names(names: DataFrame) -> DataFrame:
    """(name, entity, score): every name of column ``name`` with the identity that it is a spelling of, and the rarity of the rewriting that led there.

    Names compare as ``written`` gives them; NULL and blank names are left out, repeated ones count
    once. A name of common words only is linked by those words alone.
    """
    counted = names.select(written(F.col("name")).alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n"))
    counted = cut(counted.withColumn("clean", cleaned(F.col("name"))))
    clean = cut(counted.groupBy("clean").agg(F.sum("n").alias("n")).where("clean <> ''"))
    keys = cut(name_keys(clean, clean.count()).join(clean, "clean"))
    keys = cut(settle_rare(keys))
    up = cut(rewritten(keys))
    step = keys
    for n in (1, 2):
        step = step.join(up, ["rare", "bag"], "left").withColumn(f"moved{n}", F.col("full").isNotNull())
        step = step.withColumns({"bag": F.coalesce("full.bag", "bag"), "rare": F.coalesce("full.rare", "rare")}).drop("full")
    step = cut(step.where("NOT spare OR moved1").select("clean", "rare", F.array_join("bag", " ").alias("bag"), "score"))
    # of the readings of one name, the one that other names share
    sizes = step.groupBy("rare", "bag").agg(F.count_distinct("clean").alias("k"))
    one = step.join(sizes, ["rare", "bag"]).groupBy("clean").agg(F.max(F.struct("k", "rare", "bag", "score")).alias("e"))
    entity = F.concat_ws("|", "e.rare", "e.bag")
    alone = counted.where("clean = ''").select("name", F.concat(F.lit("?"), "name").alias("entity"), F.lit(1.0).alias("score"))
    return counted.join(one, "clean").select("name", entity.alias("entity"), F.round("e.score", 6).alias("score")).unionByName(alone)


def name_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: all pairs of different names of one entity."""
    a, b = linked.select("entity", F.col("name").alias("name_a")), linked.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")


def p1_names(spark, sf_dir: str) -> DataFrame:
    fields = (("lda_filing_clients_sample_100", "name"), ("irs990_filings", "filer_name"), ("irs990_filing_grants", "grantee_name"))
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).select(F.col(c).alias("name")) for t, c in fields])


def p1_found(spark, sf_dir: str) -> DataFrame:
    return name_pairs(linked_names(p1_names(spark, sf_dir)))


def p1_entities(spark, sf_dir: str) -> DataFrame:
    """Membership: each name with the identity that it is a spelling of."""
    return linked_names(p1_names(spark, sf_dir))
