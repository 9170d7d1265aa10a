"""Problem 10: template residue and error-page text, by positive-unlabelled naive Bayes.

A text becomes units: its lines and sentences, and every span between paired delimiters ({..}, [[..]], %..%
and the like). A few trusted units (slots of template languages, a few filler and error phrases in
otherwise short records) are positive, all others unlabelled; expectation-maximization re-estimates a naive
Bayes model of four classes (other, slot, filler, error) over hashed features. Part of the trusted units go in
without the words that made them trusted, so that the words around them are learned. Units are then
scored by their odds alone, and the decisions of a record's units put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, table

#: Hashed features; the model is four vectors of this length at any size of the data.
BUCKETS = 1 << 16
ROUNDS = 10
#: What every feature is seen besides. Unlabelled lines start as no residue; of unlabelled spans, which are few and often
#: slots, these shares are taken for such at first (of bare words, of others).
SMOOTH, BARE_SLOTS, SLOTS = 0.1, 0.5, 0.02
#: Spans are slots or not; lines are filler, error or neither.
SPAN_OTHER, SLOT, OTHER, FILLER, ERROR = range(5)

# Delimiters in pairs. Between the symmetric ones of the second line stands one word.
PAIRS = [("{{", "}}"), ("{%", "%}"), ("<%", "%>"), ("${", "}"), ("#{", "}"), ("[[", "]]"), ("<<", ">>"), ("&lt;", "&gt;"), ("{", "}"), ("[", "]"), ("<", ">"), ("(", ")")]
WORDS_ONLY = [("*|", "|*"), ("@@", "@@"), ("__", "__"), ("%", "%")]
#: Values that programs print for nothing, and signs struck over and over.
BARE = r"\bundefined\b|\b[xX]{5,}\b"
SPAN = re.compile("|".join([*(rf"{re.escape(a)}[^{{}}\[\]<>()\n\"]*?{re.escape(b)}" for a, b in PAIRS), *(rf"{re.escape(a)}[A-Za-z][A-Za-z_]*?{re.escape(b)}" for a, b in WORDS_ONLY), BARE]))
SPAN_HINT = re.compile(r"[{\[<(%@*&]|__|undefined|[xX]{5}")
#: What is trusted: slots of these languages, spans that tell one to fill them in, and a few phrases. All other wordings are learned.
TRUSTED_SLOTS = re.compile(r"\{\{|\{%|<%|\$\{|#\{|\[\[|<<|\*\||@@|%|__|\{0\}|\[object Object\]|[\[(<](?:insert|enter|your|tbd|todo)\b|\[[^\[\]]* here\]", re.I)
TRUSTED_FILLER = re.compile(r"^\W*(?:lorem ipsum\b|this is sample text\b|click to edit\b|placeholder (?:copy|text)\b|under construction\W*$)", re.I)
#: Reason phrases of HTTP, and what scripts are needed for.
TRUSTED_ERROR = re.compile(r"\bpage not found\b|\b(?:404|error\W+404)\W+not found\b|\baccess denied\b|\b403\W+forbidden\b|\binternal server error\b|\bbad gateway\b|\bservice (?:temporarily )?unavailable\b|\bgateway time-?out\b|\btoo many requests\b|\b(?:enable|requires) javascript\b|\bjavascript (?:is )?(?:disabled|required)\b|\bnot support javascript\b", re.I)
#: A record of more signs than this is not trusted to be nothing but an error page; any record can be found to be one.
SHORT = 300

MARKUP = re.compile(r"</?(?:p|div|h\d|span|br|b|i|em|strong|a|li|ul|td|tr|table|body|html|main|section)(?: [^<>]*)?/?>", re.I)
BREAK = re.compile(r"\n+|(?<=[.!?])\s+(?=[^\Wa-z_]|[\[({<$%#*@\"'_])")
DIGITS = re.compile(r"\d+")
WORD = re.compile(r"[^\W\d_]+|\d+")
INNER = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")
QUOTES = "\"“”'‘’`"
#: Page furniture by its form: menus, copyright lines, titles.
MENU_TAIL = re.compile(r"\s(?=\w+(?: \| \w[\w ]*)+$)")
MENU_HINT = re.compile(r"\||[©(]|opyright|ights|IGHTS|OPYRIGHT")
MENU = re.compile(r"^[^|]{1,60}(?: \| [^|]{1,60})+$|^\W*(?:\(c\)|©|copyright)|all rights reserved", re.I)


def shape(span: str) -> tuple[str, list[str]]:
    """The form of a span, its delimiters and the case of what they hold, and the words that it holds."""
    a = next((o for o, c in [*PAIRS, *WORDS_ONLY] if span.startswith(o) and span.endswith(c) and len(span) >= len(o) + len(c)), "")
    held = span[len(a) : -len(a)] if a in ("@@", "__", "%", "*|") else span.strip("{}[]<>()%$#") if a and a != "&lt;" else span[4:-4] if a else span
    words = [w.lower() for w in INNER.findall(held)]
    case = "9" if held.isdigit() else "_" if "_" in held.strip() else "A" if held.isupper() else "aA" if re.search("[a-z][A-Z]", held) else "Aa" if held.istitle() else "a"
    return f"{a or 'w'}{case}", words


def is_title(line: str, words: list[str]) -> bool:
    """A heading: few words, all long ones with a capital, no end of a sentence."""
    return len(words) <= 12 and bool(line) and line[-1] not in ".!?" and not any(w[0].islower() and len(w) > 2 for w in WORD.findall(line) if w[0].isalpha())


def lines(text: str) -> Iterator[str]:
    """Lines and sentences with blanks as one; a menu at the end of a line is a line of its own."""
    for whole in BREAK.split(text):
        line = " ".join(whole.split())
        if " | " in line:
            yield from filter(None, map(str.strip, MENU_TAIL.split(line, maxsplit=1)))
        elif line:
            yield line


def units(text: str) -> list[tuple[int, str, int, list[str]]]:
    """(trusted class or -1, kind, features to leave out when learning, features) of each unit of a text; kind = span, line, menu or title."""
    out = []
    t = MARKUP.sub("\n", text).replace(" ", " ")
    whole = len(t.strip())
    spans_trusted = fillers = errors = 0
    for line in lines(t):
        rest = line
        if SPAN_HINT.search(line):
            pieces, at = [], 0
            for m in SPAN.finditer(line):
                before, after = line[: m.start()], line[m.end() :]
                if before and after and before[-1] in QUOTES and after[0] in QUOTES:
                    continue
                form, inner = shape(m[0])
                if form[0] == "w" and before.rstrip()[-1:] in QUOTES and before.rstrip():
                    continue  # said of a quoted word
                left, right = WORD.findall(before[-30:])[-1:], WORD.findall(after[:30])[:1]
                sure = SLOT if TRUSTED_SLOTS.match(m[0]) else -1
                spans_trusted += sure == SLOT
                feats = [f"s:{form}", *(f"i:{w}" for w in inner)]
                if form[0] == "w":  # a bare word tells nothing without its neighbours
                    feats += [*(f"l:{w.lower()}" for w in left), *(f"r:{w.lower()}" for w in right)]
                out.append([sure, line, feats, form])
                if form[0] != "(":  # what stands in round brackets is text too
                    pieces.append(line[at : m.start()])
                    at = m.end()
            pieces.append(line[at:])
            rest = " ".join(pieces)
        low = rest.lower()
        words = WORD.findall(DIGITS.sub("9", low))
        if not words:
            continue
        sure, seed = -1, None
        if (m := TRUSTED_FILLER.match(rest)) or any(len(words) >= 3 * p and words[p] == words[0] and words[p:] == words[:-p] for p in (1, 2, 3, 4)):
            sure, seed = FILLER, m
            fillers += 1
        elif whole <= SHORT and (m := TRUSTED_ERROR.search(rest)):
            sure, seed = ERROR, m
            errors += 1
        out.append([sure, "menu" if MENU_HINT.search(line) and MENU.search(line) else "title" if is_title(rest.strip(), words) else "", words, WORD.findall(seed[0].lower()) if seed else []])
    done = []
    for sure, furniture, feats, extra in out:
        if isinstance(extra, str):
            # half of the trusted slots are learned from without what made them trusted, their form
            skip = 1 if sure == SLOT and hash_(furniture + feats[0]) % 2 else 0
            done.append((sure, "span", skip, [*feats, f"rec:slot{min(spans_trusted - (sure == SLOT), 1)}"]))
            continue
        pairs = [f"{a} {b}" for a, b in zip(feats, feats[1:], strict=False)]
        more = [f"n:{len(feats).bit_length()}"]
        # what stands beside a heading says nothing about it
        if furniture != "title":
            more += [f"rec:fill{min(fillers - (sure == FILLER), 1)}", f"rec:err{min(errors - (sure == ERROR), 1)}", f"short{whole <= SHORT}"]
        if len(feats) > 5 and len(set(feats)) * 3 <= len(feats):
            more.append("n:repeats")
        every = feats + pairs + more
        skip = 0
        if extra and hash_(" ".join(feats)) % 2:
            seen = [x for x in every if any(w in extra for w in x.split(" "))]
            if len(seen) < len(every):
                every, skip = seen + [x for x in every if not any(w in extra for w in x.split(" "))], len(seen)
        done.append((sure, furniture or "line", skip, every))
    return done


def hash_(text: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"))


KINDS = ("span", "line", "menu", "title")


def features(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sure, kind, bare, skip, h): the units of all texts with hashed features; NULL and blank texts have none."""
    name = documents.schema[key].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            keys, sure, kind, bare, skip, h, ends = [], [], [], [], [], [], [0]

            def done():
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int32())), pa.array(sure, pa.int8()), pa.array(kind, pa.int8()), pa.array(bare, pa.bool_()), pa.array(skip, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h, pa.int32()))], ["k", "sure", "kind", "bare", "skip", "h"])  # noqa: B023

            for n, t in enumerate(b.column(1).to_pylist()):
                for s, f, left_out, words in units(t) if t else ():
                    keys.append(n)
                    sure.append(s)
                    kind.append(KINDS.index(f))
                    bare.append(f == "span" and words[0].startswith("s:w"))
                    skip.append(left_out)
                    for w in words:
                        if (x := known.get(w)) is None:
                            if len(known) > 500_000:
                                known.clear()
                            x = known[w] = hash_(w) % BUCKETS
                        h.append(x)
                    ends.append(len(h))
                if len(h) > 2_000_000:
                    yield done()
                    keys, sure, kind, bare, skip, h, ends = [], [], [], [], [], [], [0]
            yield done()

    return documents.select(documents[key].alias("k"), documents[text].alias("t")).mapInArrow(make, f"k {name}, sure tinyint, kind tinyint, bare boolean, skip int, h array<int>").withColumnRenamed("k", key)


class Model:
    """Log-probabilities of the features by class, and of the classes; without them the first guess of ``learn``."""

    def __init__(self, weights: np.ndarray | None = None, prior: np.ndarray | None = None):
        self.weights, self.prior = weights, prior

    def odds(self, kind: np.ndarray, h: pa.ListArray) -> np.ndarray:
        """By unit and class; classes that a unit can't have are at minus infinity."""
        offsets = h.offsets.to_numpy()
        values = h.values.to_numpy()[offsets[0] : offsets[-1]]
        sums = np.vstack([np.zeros(5), np.cumsum(self.weights[values], 0)])
        offsets = offsets - offsets[0]
        span = (kind == KINDS.index("span"))[:, None]
        can = np.where(span, np.arange(5) <= SLOT, np.arange(5) >= OTHER)
        return np.where(can, self.prior + sums[offsets[1:]] - sums[offsets[:-1]], -np.inf)

    def shares(self, kind: np.ndarray, bare: np.ndarray, h: pa.ListArray) -> np.ndarray:
        if self.weights is None:
            q = np.zeros((len(kind), 5))
            span = kind == KINDS.index("span")
            slots = np.where(bare, BARE_SLOTS, SLOTS)
            q[span, SLOT], q[span, SPAN_OTHER], q[~span, OTHER] = slots[span], 1 - slots[span], 1
            return q
        o = self.odds(kind, h)
        q = np.exp(o - o.max(1, keepdims=True))
        return q / q.sum(1, keepdims=True)


def learn(feats: DataFrame, rounds: int = ROUNDS) -> Model | None:
    """The model, by expectation-maximization over all units; None if no unit is trusted.

    A round is one pass in which each task sums its expected counts of features; the driver gets
    the sums of at most ``BUCKETS`` buckets.
    """
    model = Model()
    for _ in range(rounds):
        now = model

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, seen = np.zeros((BUCKETS, 5)), np.zeros(6)
            for b in batches:
                sure, kind, bare, skip = (b.column(n).to_numpy(zero_copy_only=False) for n in range(4))
                h = b.column(4)
                q = now.shares(kind, bare, h)
                on = np.flatnonzero(sure >= 0)
                q[on] = 0
                q[on, sure[on]] = 1
                offsets = h.offsets.to_numpy()
                sizes = np.diff(offsets)
                unit = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(unit)) - np.repeat(offsets[:-1] - offsets[0], sizes)
                use = place >= skip[unit]
                at, unit = h.values.to_numpy()[offsets[0] : offsets[-1]][use], unit[use]
                for k in range(5):
                    sums[:, k] += np.bincount(at, q[unit, k], BUCKETS)
                seen += (*q.sum(0), len(on))
            some = np.flatnonzero(sums.sum(1))
            rows = np.append(some, [-1, -2])
            extra = np.vstack([seen[:5], [seen[5], 0, 0, 0, 0]])
            both = np.vstack([sums[some], extra])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(both[:, k]) for k in range(5))], ["b", *(f"c{k}" for k in range(5))])

        got = feats.select("sure", "kind", "bare", "skip", "h").mapInArrow(expect, "b int, c0 double, c1 double, c2 double, c3 double, c4 double")
        got = got.groupBy("b").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(5)]).toPandas()
        if not float(got.loc[got.b == -2, "c0"].sum()):
            return None
        seen = got.loc[got.b == -1, [f"c{k}" for k in range(5)]].to_numpy()[0]
        words = got[got.b >= 0]
        counts = np.full((BUCKETS, 5), SMOOTH)
        counts[words.b] += words[[f"c{k}" for k in range(5)]].to_numpy()
        model = Model(np.log(counts) - np.log(counts.sum(0)), np.log(np.maximum(seen, SMOOTH) / seen.sum()))
    return model


def scored(feats: DataFrame, key: str, model: Model) -> DataFrame:
    """(key, kind, class): the likeliest class of each unit, by its odds alone."""
    name = feats.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.column(1).to_numpy(zero_copy_only=False)
            best = model.odds(kind, b.column(2)).argmax(1) if len(kind) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.int8())], ["k", "kind", "class"])

    return feats.select(F.col(key).alias("k"), "kind", "h").mapInArrow(score, f"k {name}, kind tinyint, class tinyint").withColumnRenamed("k", key)


def residue(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, slots, fillers, errors, content): counts of each kind of unit in the records that have any residue to drop.

    Slots and filler anywhere make a record residue. Error messages and script notices do so only
    where nothing but page furniture stands beside them. NULL, blank and empty texts never do.
    """
    feats = cut(features(documents, key, text))
    model = learn(feats)
    if model is None:
        return feats.where("false").select(key, *[F.lit(0).cast("long").alias(c) for c in ("slots", "fillers", "errors", "content")])
    found = scored(feats, key, model)
    is_, line = lambda c: F.col("class") == c, F.col("kind") == KINDS.index("line")
    menu = F.col("kind") == KINDS.index("menu")
    counts = found.groupBy(key).agg(F.count_if(is_(SLOT)).alias("slots"), F.count_if(is_(FILLER) & ~menu).alias("fillers"), F.count_if(is_(ERROR) & ~menu).alias("errors"), F.count_if(is_(OTHER) & line).alias("content"))
    return counts.where("slots > 0 OR fillers > 0 OR errors > 0 AND content = 0")


def p10_found(spark, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_units(spark, sf_dir: str) -> DataFrame:
    """How many units of each kind the model puts into each class."""
    feats = cut(features(table(spark, sf_dir, "documents")))
    model = learn(feats)
    return (scored(feats, "doc_id", model) if model else feats.selectExpr("doc_id", "kind", "kind AS class").where("false")).groupBy("kind", "class").agg(F.count("*").alias("units"))
