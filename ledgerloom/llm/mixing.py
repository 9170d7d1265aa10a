"""Problem 9: mixing sources to target weights, by soft membership.

A classifier learned from the labelled table gives each document a posterior over the domains that the
targets name, and one for all others. Documents are judged by a model learned from the other half of the table; the recorded
source is evidence beside the text, of weight ``TRUST``. Each document has nonnegative rates of its own, at most the allowed repeats,
fitted by projected-gradient least squares so that the expected domain totals meet the targets: a pass over all documents a
step. Rates become whole copies by a hash of the document, with one
threshold per mix and source that makes the copies sum up to what the rates promise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, table
from .tokens import TOKENIZER, token_counts

BUCKETS = 1 << 15
#: All sources that no target names.
REST = "\x00rest"
#: How much the recorded source is trusted against the text. Shares are asked for by source, and where texts of all sources are alike (see ``accuracy``) less trust would move documents away from what they are recorded as.
TRUST = 0.9999
#: Words of all documents that every domain is taken to have said besides its own.
SHRINK = 5000.0
#: Steps between whole copies at which a threshold may lie, and values of the hash of a document.
PARTS, HASHES = 1024, 1 << 20
#: Passes of the fit at most, and the share of the squared misses by which a pass must lower them, or which are nothing beside the targets.
ROUNDS, LEAST_GAIN, NOTHING = 20, 1e-3, 1e-9
#: Steps of the sketch that the fit sets out from, and steps of confidence that it tells apart.
SKETCH_ROUNDS, STEPS = 2000, 10


def posteriors(documents: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text", label: str = "source", trust: float = TRUST, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, label, n_tokens, p, guess): the posterior of each document over ``domains``, from multinomial naive Bayes on hashed words and its label; ``guess`` = the domain likeliest by text alone.

    The model that judges a document has not seen it: documents are halved by a hash of their key. Documents without a
    label have the classifier's posterior; those without text the label's. Labels outside ``domains`` count as the last of these.
    """
    w = F.regexp_extract_all(F.lower(F.coalesce(documents[text], F.lit(""))), F.lit(r"\p{L}+"), 0)
    hashed = F.transform(F.array_distinct(w), lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"))
    texts = documents.select(documents[key].alias("k"), documents[label].alias("s"), hashed.alias("h"), documents[text].alias("t"))
    df = cut(token_counts(texts, "k", "t", ("s", "h"), tokenizer))
    df = df.withColumn("half", F.pmod(F.xxhash64("k", F.lit(3)), F.lit(2)).cast("int"))
    index = {d: n for n, d in enumerate(domains)}
    size = len(domains)

    def labels(column: pa.Array) -> np.ndarray:
        return np.array([-1 if s is None else index.get(s, size - 1) for s in column.to_pylist()], int)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2 * size, BUCKETS + 1))
        for b in batches:
            d = labels(b.column(0))
            d = np.where(d >= 0, d + size * b.column(2).to_numpy(), -1)
            h = b.column(1)
            at = h.values.to_numpy()[h.offsets[0].as_py() : h.offsets[-1].as_py()]
            each = np.repeat(d, np.diff(h.offsets.to_numpy()))
            np.add.at(sums, (each[each >= 0], at[each >= 0]), 1)
            np.add.at(sums, (d[d >= 0], BUCKETS), 1)
        some = np.argwhere(sums > 0)
        yield pa.RecordBatch.from_arrays([pa.array(some[:, 0], pa.int32()), pa.array(some[:, 1], pa.int32()), pa.array(sums[some[:, 0], some[:, 1]])], ["d", "b", "n"])

    sums = df.select("s", "h", "half").mapInArrow(count, "d int, b int, n double").groupBy("d", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2 * size, BUCKETS + 1))
    counts[sums.d, sums.b] = sums.n
    # of each half the model learned from the other
    counts = counts.reshape(2, size, BUCKETS + 1)[::-1]
    docs = counts[:, :, BUCKETS]
    # a domain's words are shrunk to those of all, so that a small domain's unseen words tell nothing
    all_ = counts[:, :, :BUCKETS].sum(1, keepdims=True) + 0.1
    words = counts[:, :, :BUCKETS] + SHRINK * all_ / all_.sum(2, keepdims=True)
    likely = (np.log(words) - np.log(words.sum(2, keepdims=True))).astype(np.float32)
    prior = np.log((docs + 1) / (docs.sum(1, keepdims=True) + size))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, half = b.column(2), b.column(4).to_numpy()
            offsets = h.offsets.to_numpy()
            n = np.diff(offsets)
            at = h.values.to_numpy()[offsets[0] : offsets[-1]]
            start = offsets - offsets[0]
            odds = np.zeros((len(n), size))
            for one in (0, 1):
                sums = np.vstack([np.zeros(size), np.cumsum(likely[one][:, at].T.astype(np.float64), 0)]) if len(at) else np.zeros((1, size))
                # words of one text hang together: they count as the square root of their number
                mine = prior[one] + (sums[start[1:]] - sums[start[:-1]]) / np.sqrt(np.maximum(n, 1))[:, None]
                odds = np.where((half == one)[:, None], mine, odds)
            guess = odds.argmax(1)
            d = labels(b.column(1))
            known = np.flatnonzero(d >= 0)
            if size > 1:
                seen = np.zeros_like(odds)
                seen[known] = np.log((1 - trust) / (size - 1))
                seen[known, d[known]] = np.log(trust)
                odds = odds + seen
            p = np.exp(odds - odds.max(1, keepdims=True))
            p = (p / p.sum(1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.ListArray.from_arrays(np.arange(0, p.size + 1, size, dtype=np.int32), p.ravel()), pa.array(guess, pa.int32())], ["k", "s", "n_tokens", "p", "guess"])

    kind = documents.schema[key].dataType.simpleString()
    return df.select("k", "s", "h", "n_tokens", "half").mapInArrow(judge, f"k {kind}, s string, n_tokens int, p array<float>, guess int").select(F.col("k").alias(key), F.col("s").alias(label), "n_tokens", "p", "guess")


class Rates:
    """Rates of documents in each mix after some steps of projected gradient: from a start that their memberships give, each step clipped to 0 and ``cap`` (mixes x domains)."""

    def __init__(self, start: np.ndarray, cap: np.ndarray):
        self.steps, self.cap = [start], cap

    def of(self, p: np.ndarray, own: np.ndarray) -> np.ndarray:
        """(documents x mixes) of documents with memberships ``p`` that count as ``own``."""
        cap = self.cap[:, own].T
        rates = np.zeros((len(p), len(self.cap)))
        for step in self.steps:
            rates = np.clip(rates + p @ step.T, 0, cap)
        return rates


def _members(b: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Memberships, tokens and own domains of a batch with p, n_tokens, own."""
    p, tokens, own = (b.column(b.schema.get_field_index(c)) for c in ("p", "n_tokens", "own"))
    return p.flatten().to_numpy().astype(float).reshape(-1, size), tokens.to_numpy().astype(float), own.to_numpy()


def _summed(df: DataFrame, f, shape: tuple[int, ...], size: int) -> np.ndarray:
    """The sum of the arrays of ``shape`` that ``f`` gives of the memberships, tokens and own domains of each batch."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            total += f(*_members(b, size))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at])], ["at", "x"])

    out = np.zeros(int(np.prod(shape)))
    for r in df.mapInArrow(add, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r.x
    return out.reshape(shape)


def sketched(df: DataFrame, share: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """The sum of the steps (mixes x domains) that the fit takes on documents merged by own and likeliest domain and confidence; only where the fit by document sets out from."""
    size = share.shape[1]
    most = F.array_max("p")
    cell = (F.col("own") * size + F.array_position("p", most).cast("int") - 1) * STEPS + F.least(F.floor(most * STEPS), F.lit(STEPS - 1)).cast("int")
    sums = df.groupBy(cell.alias("cell")).agg(*[F.sum(F.col("n_tokens") * F.col("p")[n]).alias(f"m{n}") for n in range(size)]).orderBy("cell").toPandas()
    mass = sums[[f"m{n}" for n in range(size)]].to_numpy(float).reshape(-1, size)
    top = cap[:, sums.cell.to_numpy(int) // (size * STEPS)]
    weight, target = np.maximum(mass.sum(0), 1.0), share * mass.sum()
    member = mass / np.maximum(mass.sum(1), 1e-9)[:, None]
    steps = target / weight
    rates = np.clip(steps @ member.T, 0, top)
    for _ in range(SKETCH_ROUNDS):
        step = (target - rates @ mass) / weight
        new = np.clip(rates + step @ member.T, 0, top)
        if np.abs(new - rates).max(initial=0) < 1e-9:
            break
        rates, steps = new, steps + step
    return steps


def fitted(df: DataFrame, share: np.ndarray, cap: np.ndarray) -> Rates:
    """Rates between 0 and ``cap`` of the documents of ``df`` (p, n_tokens, own) whose expected totals (rate x tokens x membership) are nearest to ``share`` (mixes x domains) of all tokens.

    Projected gradient of the squared misses, each over the size of its domain, for each document by its own membership whatever its length;
    memberships sum to 1, so a step of 1 never overshoots. The first rates come of a sketch, since rare domains take many steps. The state of the fit are its steps (mixes x domains), so nothing is kept per document.
    """
    size = share.shape[1]
    mass = _summed(df, lambda p, t, own: t @ p, (size,), size)
    target, weight = share * mass.sum(), np.maximum(mass, 1.0)
    rates = Rates(sketched(df, share, cap), cap)
    last = np.inf
    for _ in range(ROUNDS):
        miss = _summed(df, lambda p, t, own: rates.of(p, own).T @ (p * t[:, None]), share.shape, size) - target
        loss = float((miss**2 / weight).sum())
        if last - loss <= LEAST_GAIN * loss or loss <= NOTHING * float((target**2 / weight).sum()):
            break
        last = loss
        rates.steps.append(-miss / weight)
    return rates


def mixed(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """(mix_name, key, source, n_tokens, rate, copies, domain, p) of the documents taken into each mix.

    ``domain`` is what a document counts under: its source, or without one its likeliest domain; ``p`` its membership in the domains, in order of
    name, with all that no target names last.

    A document is repeated at most ``max_repeats`` times; a source that is too small, or missing, falls short of
    its share and nothing takes its place. Repeated rows are documents of their own. Documents without tokens are never taken. Rows of ``targets`` with a
    NULL share, repeats or budget ask for nothing.
    """
    rows = [r for r in targets.select("mix_name", "source", "target_share", "max_repeats", "budget_share").distinct().collect() if None not in tuple(r)]
    domains = [*sorted({r.source for r in rows}), REST]
    names = sorted({r.mix_name for r in rows})
    size = len(domains)
    kind = documents.schema[key].dataType.simpleString()
    member = posteriors(documents, domains, key, text, source, tokenizer=tokenizer)
    likeliest = F.array_position("p", F.array_max("p")).cast("int") - 1
    index = F.create_map(*[F.lit(x) for n, d in enumerate(domains) for x in (d, n)])
    own = F.when(F.col("s").isNull(), likeliest).otherwise(F.coalesce(index[F.col("s")], F.lit(size - 1)))
    df = member.where("n_tokens > 0").select(F.col(key).alias("k"), F.col(source).alias("s"), "n_tokens", "p", F.pmod(F.xxhash64(key), F.lit(HASHES)).cast("int").alias("part"))
    df = cut(df.withColumn("own", own.cast("int")))
    share, cap = np.zeros((len(names), size)), np.zeros((len(names), size))
    for r in rows:
        m, d = names.index(r.mix_name), domains.index(r.source)
        share[m, d] = r.target_share * r.budget_share
        cap[m, d] = r.max_repeats
    rates = fitted(df.select("p", "n_tokens", "own"), share, cap)

    def at(rate: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Where a document lies between whole copies, in ``PARTS`` of one."""
        return np.floor((rate - ((part + 0.5) / HASHES)[:, None]) * PARTS).astype(np.int64)

    # tokens by place between copies, and tokens that the rates promise, of each mix and domain; one table of bounded size
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, t, d = _members(b, size)
            r = rates.of(p, d)
            x = at(r, b.column(3).to_numpy())
            n, m = np.nonzero(cap[:, d].T > 0)
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(d[n], pa.int32()), pa.array(x[n, m]), pa.array(t[n]), pa.array(t[n] * r[n, m])], ["m", "d", "x", "t", "goal"])

    sums = df.select("p", "n_tokens", "own", "part").mapInArrow(place, "m int, d int, x long, t double, goal double").groupBy("m", "d", "x").agg(F.sum("t").alias("t"), F.sum("goal").alias("goal")).toPandas()
    edges = np.zeros((len(names), size), np.int64)
    for (m, d), held in sums.groupby(["m", "d"]):
        x, t, goal = held.x.to_numpy(), held.t.to_numpy(), float(held.goal.sum())
        off = lambda e: float((np.clip((x + e) // PARTS, 0, cap[m, d]) * t).sum()) - goal  # noqa: B023, E731
        low, high = 0, 2 * PARTS
        while goal and high - low > 1:
            edge = (low + high) // 2
            low, high = (edge, high) if off(edge) < 0 else (low, edge)
        # the documents at one step may make the difference between the two: the nearer to the goal counts
        edges[m, d] = low if not goal or abs(off(low)) < abs(off(high)) else high

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, _, d = _members(b, size)
            rate = rates.of(p, d)
            x = at(rate, b.column(4).to_numpy())
            for m, name in enumerate(names):
                c = np.clip((x[:, m] + edges[m, d]) // PARTS, 0, cap[m, d]).astype(int)
                on = np.flatnonzero(c > 0)
                rows_ = pa.array(on)
                under = pa.array([domains[x] for x in d[on]], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(on), pa.string()), b.column(0).take(rows_), b.column(1).take(rows_), b.column(2).take(rows_), pa.array(rate[on, m]), pa.array(c[on], pa.int32()), under, b.column(3).take(rows_)], ["mix_name", "k", "s", "n_tokens", "rate", "copies", "domain", "p"])

    out = df.mapInArrow(take, f"mix_name string, k {kind}, s string, n_tokens int, rate double, copies int, domain string, p array<float>")
    return out.withColumnsRenamed({"k": key, "s": source})


def shares(taken: DataFrame, targets: DataFrame, total: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, actual_share, expected_share, target_tokens, actual_tokens, documents, most_copies) of each target.

    ``actual_share`` counts by recorded source (documents without one under their likeliest domain), ``expected_share`` by membership.
    """
    got = taken.groupBy("mix_name", F.col("domain").alias("source")).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    index = F.create_map(*[F.lit(x) for n, r in enumerate(sorted({r.source for r in targets.select("source").distinct().collect() if r.source is not None})) for x in (r, n)])
    soft = taken.select("mix_name", F.posexplode("p").alias("at", "q"), (F.col("n_tokens") * F.col("copies")).alias("t")).groupBy("mix_name", "at").agg(F.sum(F.col("q") * F.col("t")).alias("expected"))
    wanted = targets.crossJoin(F.broadcast(total.agg(F.sum("n_tokens").alias("all_tokens")))).withColumn("at", index[F.col("source")])
    df = wanted.join(got, ["mix_name", "source"], "left").join(soft, ["mix_name", "at"], "left").na.fill(0, ["actual_tokens", "documents", "most_copies", "expected"])
    whole = taken.groupBy("mix_name").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"))
    df = df.join(whole, "mix_name", "left").withColumn("target_tokens", F.round(F.col("target_share") * F.col("budget_share") * F.col("all_tokens"), 1))
    return df.select("mix_name", "source", "target_share", F.round(F.try_divide("actual_tokens", "mix_tokens"), 6).alias("actual_share"), F.round(F.try_divide("expected", "mix_tokens"), 6).alias("expected_share"), "target_tokens", "actual_tokens", "documents", "most_copies")


def accuracy(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(source, documents, found): of the documents of each source with text, the share whose source the text alone tells; models judge documents that they have not seen."""
    named = documents.where(F.col(source).isNotNull() & (F.trim(text) != ""))
    domains = sorted(r.s for r in named.select(F.col(source).alias("s")).distinct().collect())
    if not domains:
        return named.select(source).withColumns({"documents": F.lit(0), "found": F.lit(0.0)})
    judged = posteriors(named, domains, key, text, source)
    right = (F.element_at(F.array(*[F.lit(d) for d in domains]), F.col("guess") + 1) == F.col(source)).cast("double")
    return judged.groupBy(source).agg(F.count("*").alias("documents"), F.round(F.avg(right), 4).alias("found"))


def p9_mix(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).drop("domain", "p")


def p9_shares(spark, sf_dir: str) -> DataFrame:
    documents, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    return shares(cut(mixed(documents, targets)), targets, token_counts(documents))


def p9_accuracy(spark, sf_dir: str) -> DataFrame:
    return accuracy(table(spark, sf_dir, "documents"))


def p9_limits(spark, sf_dir: str) -> DataFrame:
    """What must hold of every mix: (mix_name, over_cap, unknown) = documents repeated too often, and documents of sources it does not ask for."""
    targets = table(spark, sf_dir, "mix_targets")
    taken = mixed(table(spark, sf_dir, "documents"), targets)
    asked = targets.select("mix_name", F.col("source").alias("domain"), "max_repeats")
    held = taken.join(F.broadcast(asked), ["mix_name", "domain"], "left")
    counts = held.groupBy("mix_name").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("over_cap"), F.count_if(F.col("max_repeats").isNull()).alias("unknown"))
    return targets.select("mix_name").distinct().join(counts, "mix_name", "left").na.fill(0)


SQL = {"p9_limits": "SELECT DISTINCT mix_name, 0::BIGINT AS over_cap, 0::BIGINT AS unknown FROM mix_targets"}
