"""Problem 2: nested JSON records as an adjacency table of nodes, and flat tables pivoted from it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, table

NODES = "source_table string, parent_key string, node int, parent int, label string, ordinal int, kind string, scalar string, path string, positions array<string>"


#: Stands between the keys of a path inside the adjacency table, so that keys may hold dots.
SEPARATOR = "\x1f"
_PIECE = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))')


def _constant(name: str):
    raise ValueError(name)  # NaN and Infinity are not JSON


def _plain(s: str) -> str:
    return s if s.isascii() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def deeply_nested(text: str):
    """What ``json.loads`` gives, for texts nested deeper than it can follow: open containers are kept in a list."""
    root: list = []
    held: list = [root]
    keys: list = []
    expect, at, end = "value", 0, len(text.rstrip(" \t\n\r"))
    while at < end:
        if not (m := _PIECE.match(text, at)):
            raise ValueError("no JSON")
        at = m.end()
        mark, scalar = m.groups()
        if expect == "done":
            raise ValueError("more than one value")
        if mark in ("]", "}"):
            if expect not in ("comma", "first") or isinstance(held[-1], dict) != (mark == "}") or len(held) == 1:
                raise ValueError("closed out of turn")
            held.pop()
        elif mark == ",":
            if expect != "comma":
                raise ValueError("comma out of turn")
            expect = "key" if isinstance(held[-1], dict) else "value"
            continue
        elif isinstance(held[-1], dict) and expect in ("key", "first"):
            if not scalar or scalar[0] != '"':
                raise ValueError("key expected")
            keys.append(json.loads(scalar))
            expect = "colon"
            continue
        elif mark == ":":
            if expect != "colon":
                raise ValueError("colon out of turn")
            expect = "value"
            continue
        else:
            if expect not in ("value", "first"):
                raise ValueError("value out of turn")
            value = {} if mark == "{" else [] if mark == "[" else json.loads(scalar)
            if isinstance(held[-1], dict):
                held[-1][keys.pop()] = value
            else:
                held[-1].append(value)
            if mark:
                held.append(value)
                expect = "first"
                continue
        expect = "done" if len(held) == 1 else "comma"
    if expect != "done":
        raise ValueError("cut off")
    return root[0]


def payload(text: str | None):
    """The object or array that a text holds, read through any layers of JSON strings; None if there is none."""
    value = text
    while isinstance(value, str):
        try:
            value = json.loads(value, parse_constant=_constant)
        except RecursionError:
            try:
                value = deeply_nested(value)
            except ValueError:
                return None
        except ValueError:
            return None
    return value if isinstance(value, dict | list) else None


def walk(value) -> Iterator[tuple]:
    """Nodes in document order: (node, parent, label, ordinal, kind, scalar, path, positions).

    ``ordinal`` is the place in the parent: from 1 in an array, from 1 by appearance in an object.
    ``path`` holds the keys from the root, joined by ``SEPARATOR``. ``positions`` has an entry for each key of
    the path: the places in the arrays below that key, joined by dots, or NULL if no array is there.
    """
    stack = [(value, -1, None, 1, None, [])]
    node = 0
    while stack:
        v, parent, label, ordinal, path, positions = stack.pop()
        me, node = node, node + 1
        if isinstance(v, dict):
            yield me, parent, label, ordinal, "object", None, path, positions
            stack.extend([(x, me, k, n, k if path is None else f"{path}{SEPARATOR}{k}", [*positions, None]) for n, (k, x) in enumerate(((_plain(k), x) for k, x in v.items()), 1)][::-1])
        elif isinstance(v, list):
            yield me, parent, label, ordinal, "array", None, path, positions
            outer = positions[-1] if positions else None
            rest = positions[:-1]
            stack.extend([(x, me, None, n, path, [*rest, str(n) if outer is None else f"{outer}.{n}"]) for n, x in enumerate(v, 1)][::-1])
        elif isinstance(v, bool):
            yield me, parent, label, ordinal, "boolean", str(v).lower(), path, positions
        elif v is None:
            yield me, parent, label, ordinal, "null", None, path, positions
        elif isinstance(v, str):
            yield me, parent, label, ordinal, "string", _plain(v), path, positions
        else:
            yield me, parent, label, ordinal, "number", json.dumps(v), path, positions


def shred(df: DataFrame, source_table: str, key: str, text: str) -> DataFrame:
    """The adjacency table (columns of ``NODES``) of the JSON texts in column ``text``.

    A text that is NULL, empty, no complete JSON, or a lone scalar gives no nodes; one that is a JSON
    string is read as its content, however often it was wrapped. NULL keys stay NULL. Of a repeated
    key in one object the last value counts. Other columns are ignored, whatever their names.
    """
    schema = pa.schema([("source_table", pa.string()), ("parent_key", pa.string()), ("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string()), ("path", pa.string()), ("positions", pa.list_(pa.string()))])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(9)]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (value := payload(t)) is not None:
                    for row in walk(value):
                        for c, x in zip(columns, (k, *row), strict=True):
                            c.append(x)
                    if len(columns[0]) > 100_000:
                        yield _batch(columns, schema, source_table)
                        columns = [[] for _ in range(9)]
            yield _batch(columns, schema, source_table)

    return df.select(df[key].cast("string").alias("k"), df[text].alias("t")).mapInArrow(nodes, NODES)


def _batch(columns: list[list], schema: pa.Schema, source_table: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([[source_table] * len(columns[0]), *columns], schema, strict=True)], schema=schema)


def child_objects(nodes: DataFrame) -> DataFrame:
    """One row (source_table, parent_key, child_path, position_path, node) per object that is an element of an array.

    An object that lies where other records of its table have an array is an array of one, for
    itself and for all below it. Which places these are is settled once per shape (table, path and
    which keys lead to no array), of which there are as many as the schema has, not the data.
    """
    mask = F.array_join(F.transform("positions", lambda p: F.when(p.isNull(), "0").otherwise("1")), "")
    containers = nodes.where("kind IN ('object', 'array')").withColumn("path", F.coalesce("path", F.lit("")))
    containers = cut(containers.select("source_table", "parent_key", "node", "kind", "path", "positions", mask.alias("mask")))
    arrays = containers.where("kind = 'array'").select("source_table", F.col("path").alias("prefix")).distinct()
    objects = containers.where("kind = 'object'")
    shapes = objects.groupBy("source_table", "path", "mask").agg(F.count("*").alias("n"))
    steps = shapes.select("source_table", "path", "mask", F.posexplode(F.split("path", SEPARATOR)).alias("k", "_")).where("path <> ''")
    steps = steps.withColumn("prefix", F.array_join(F.slice(F.split("path", SEPARATOR), F.lit(1), F.col("k") + 1), SEPARATOR))
    implied = steps.join(arrays, ["source_table", "prefix"], "left_semi").groupBy("source_table", "path", "mask").agg(F.collect_set("k").alias("implied"))
    shapes = shapes.drop("n").join(implied, ["source_table", "path", "mask"], "left").withColumn("implied", F.coalesce("implied", F.array().cast("array<int>")))
    places = F.transform("positions", lambda p, k: F.coalesce(p, F.when(F.array_contains("implied", k), "1")))
    return (
        objects.join(shapes, ["source_table", "path", "mask"])
        .withColumn("places", places)
        .where(F.element_at(F.when(F.size("places") > 0, F.col("places")), -1).isNotNull())
        .select("source_table", "parent_key", F.translate("path", SEPARATOR, ".").alias("child_path"), F.array_join("places", ".").alias("position_path"), "node")
    )


def entity_table(nodes: DataFrame, path: str, columns: dict[str, str]) -> DataFrame:
    """The objects at ``path`` as a flat table: source_table, parent_key, node, parent, and ``columns`` (name -> dotted label below the object).

    Object nodes are joined with their scalar children, which are pivoted; a label of several parts
    passes through lone inner objects. Missing fields and JSON nulls are NULL.
    """
    objects = nodes.where((F.col("path") == path.replace(".", SEPARATOR)) & (F.col("kind") == "object")).select("source_table", "parent_key", "node", "parent")
    scalars = nodes.where("kind NOT IN ('object', 'array')").select("source_table", "parent_key", F.col("parent").alias("owner"), "label", "scalar")
    inner = nodes.where("kind = 'object' AND label IS NOT NULL").select("source_table", "parent_key", F.col("node").alias("owner"), F.col("parent").alias("above"), F.col("label").alias("step"))
    own = scalars.where(F.col("label").isin([x for x in columns.values() if "." not in x]))
    below = [x.split(".") for x in columns.values() if "." in x]
    for first, last in below:
        at = scalars.where(F.col("label") == last).join(inner.where(F.col("step") == first), ["source_table", "parent_key", "owner"])
        own = own.unionByName(at.select("source_table", "parent_key", F.col("above").alias("owner"), F.lit(f"{first}.{last}").alias("label"), "scalar"))
    joined = objects.join(own.withColumnRenamed("owner", "node"), ["source_table", "parent_key", "node"], "left")
    return joined.groupBy("source_table", "parent_key", "node", "parent").agg(*[F.max(F.when(F.col("label") == x, F.col("scalar"))).alias(c) for c, x in columns.items()])


def shredded(spark, sf_dir: str) -> DataFrame:
    lda = shred(table(spark, sf_dir, "lda_filings"), "lda_filings", "filing_uuid", "raw_json")
    return lda.unionByName(shred(table(spark, sf_dir, "bills"), "bills", "bill_id", "raw_json"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    return child_objects(shredded(spark, sf_dir)).drop("node")


def _with_place(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """``entities`` (of ``entity_table``) with ``position_path``: their place in the arrays of their record."""
    places = child_objects(nodes).select("source_table", "parent_key", "node", "position_path")
    return entities.join(places, ["source_table", "parent_key", "node"])


def p2_lobbyists(spark, sf_dir: str) -> DataFrame:
    """A flat child table of the filings: who lobbied, on which activity (first number of the position), with the link to the filing."""
    nodes = cut(shred(table(spark, sf_dir, "lda_filings"), "lda_filings", "filing_uuid", "raw_json"))
    people = entity_table(nodes, "lobbying_activities.lobbyists", {"lobbyist_id": "lobbyist.id", "first_name": "lobbyist.first_name", "last_name": "lobbyist.last_name", "covered_position": "covered_position", "is_new": "new"})
    return _with_place(nodes, people).select(F.col("parent_key").alias("filing_uuid"), "position_path", "lobbyist_id", "first_name", "last_name", "covered_position", "is_new")


def p2_cosponsors(spark, sf_dir: str) -> DataFrame:
    nodes = cut(shred(table(spark, sf_dir, "bills"), "bills", "bill_id", "raw_json"))
    people = entity_table(nodes, "cosponsors", {"bioguide_id": "bioguideId", "is_original": "isOriginal"})
    return _with_place(nodes, people).select(F.col("parent_key").alias("bill_id"), "position_path", "bioguide_id", "is_original")


P2_FOUND_SQL = """
WITH RECURSIVE raw AS (
  SELECT 'lda_filings' AS tab, filing_uuid AS pk, raw_json AS j FROM lda_filings WHERE json_valid(raw_json)
  UNION ALL SELECT 'bills', bill_id, raw_json FROM bills WHERE json_valid(raw_json)
), docs AS (
  SELECT tab, pk, CASE WHEN json_type(j) = 'VARCHAR' THEN j::JSON ->> '$' ELSE j END AS j FROM raw
), walk(tab, pk, path, mask, val) AS (
  SELECT tab, pk, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), j::JSON FROM docs WHERE json_valid(j)
  UNION ALL
  SELECT w.tab, w.pk,
         CASE WHEN json_type(w.val) = 'OBJECT' THEN list_append(w.path, e.key) ELSE w.path END,
         CASE WHEN json_type(w.val) = 'OBJECT' THEN list_append(w.mask, NULL)
              ELSE list_append(w.mask[1:len(w.mask) - 1], coalesce(w.mask[len(w.mask)] || '.', '') || CAST(e.rowid + 1 AS VARCHAR)) END,
         e.value
  FROM walk w, json_each(w.val) e WHERE json_type(w.val) IN ('OBJECT', 'ARRAY')
), arrays AS (SELECT DISTINCT tab, array_to_string(path, '.') AS p FROM walk WHERE json_type(val) = 'ARRAY'),
objects AS (SELECT row_number() OVER () AS id, tab, pk, path, mask, val FROM walk WHERE json_type(val) = 'OBJECT' AND len(path) > 0),
steps AS (
  SELECT o.id, s.k, coalesce(o.mask[s.k], CASE WHEN a.p IS NOT NULL THEN '1' END) AS place
  FROM objects o, unnest(range(1, len(o.path) + 1)) AS s(k)
  LEFT JOIN arrays a ON a.tab = o.tab AND a.p = array_to_string(o.path[1:s.k], '.')
), placed AS (SELECT id, list(place ORDER BY k) AS places FROM steps GROUP BY id)
SELECT o.tab AS source_table, o.pk AS parent_key, array_to_string(o.path, '.') AS child_path,
       array_to_string(list_filter(p.places, lambda x: x IS NOT NULL), '.') AS position_path
FROM objects o JOIN placed p USING (id) WHERE p.places[len(p.places)] IS NOT NULL
"""
_CHILDREN_SQL = P2_FOUND_SQL.rsplit("SELECT o.tab AS source_table", 1)[0]
_PLACE_SQL = "array_to_string(list_filter(p.places, lambda x: x IS NOT NULL), '.') AS position_path"
SQL = {
    "p2_found": P2_FOUND_SQL,
    "p2_lobbyists": _CHILDREN_SQL
    + f"""SELECT o.pk AS filing_uuid, {_PLACE_SQL}, val ->> '$.lobbyist.id' AS lobbyist_id, val ->> '$.lobbyist.first_name' AS first_name, val ->> '$.lobbyist.last_name' AS last_name, val ->> '$.covered_position' AS covered_position, val ->> '$.new' AS is_new
 FROM objects o JOIN placed p USING (id) WHERE o.tab = 'lda_filings' AND o.path = ['lobbying_activities', 'lobbyists'] AND p.places[len(p.places)] IS NOT NULL""",
    "p2_cosponsors": _CHILDREN_SQL
    + f"""SELECT o.pk AS bill_id, {_PLACE_SQL}, val ->> '$.bioguideId' AS bioguide_id, val ->> '$.isOriginal' AS is_original
 FROM objects o JOIN placed p USING (id) WHERE o.tab = 'bills' AND o.path = ['cosponsors'] AND p.places[len(p.places)] IS NOT NULL""",
}
