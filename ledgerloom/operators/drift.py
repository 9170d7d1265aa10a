"""Problem 6: files whose fields are added, renamed, removed or change type, read into one table.

Every record becomes a map of top-level key to raw value and raw JSON type (``path_types`` has the types at any
depth). Statistics of keys and types by file give the changes from each file to the next; a renamed key is found by its content in
the filings that both files hold. The typed table follows the renames back to one name and reports
every value that cannot be cast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import bounded, cut, table
from .shred import SEPARATOR, shred

#: Target columns of the consistent table.
TARGET = {
    "ein": "string", "tax_year": "bigint", "tax_period_end_date": "date", "form_type": "string", "filer_name": "string", "filer_state": "string",
    "total_revenue": "double", "total_expenses": "double", "program_services_amt": "double", "grants_and_contributions": "double", "fundraising_expenses": "double",
    "management_and_general_amt": "double", "total_volunteers": "bigint", "political_activity_flag": "boolean", "website": "string",
}
#: Names that say the same as a target column but share no words with it; renames within a stream need no such list.
SYNONYMS = {"employer id": "ein", "filer ein": "ein", "org name": "filer_name", "period year": "tax_year", "return year": "tax_year", "tax yr": "tax_year"}


def values(batches: DataFrame) -> DataFrame:
    """One row per record and top-level key: stream_name, file_seq, file_name, line_no, filing_id, key, type, raw.

    ``type`` is number, string, boolean, array or object, NULL for a JSON null; ``raw`` is the value as it stands (texts
    without their quotes, arrays and objects as JSON). Texts that are no JSON object give no rows.
    """
    records = batches.select("stream_name", "file_seq", "file_name", "line_no", F.try_parse_json("record_json").alias("v"))
    records = records.withColumn("filing_id", F.try_variant_get("v", "$.filing_id", "bigint")).where("schema_of_variant(v) LIKE 'OBJECT%'")
    exploded = records.lateralJoin(batches.sparkSession.tvf.variant_explode(F.col("v").outer()))
    schema = F.schema_of_variant("value")
    kind = (
        F.when(schema.isNull() | (schema == "VOID"), None)
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .otherwise("number")
    )
    raw = F.when(kind.isin("array", "object"), F.to_json("value")).otherwise(F.try_variant_get("value", "$", "string"))
    return exploded.select("stream_name", "file_seq", "file_name", "line_no", "filing_id", "key", kind.alias("type"), raw.alias("raw"))


def inner(kind: Column, raw: Column) -> Column:
    """What a value holds: of an array of one its element, of an object its ``value``, else the value itself."""
    v = F.try_parse_json(raw)
    one = F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "string"))
    return F.coalesce(F.when(kind == "array", one), F.when(kind == "object", F.try_variant_get(v, "$.value", "string")), raw)


def number_text(text: Column) -> Column:
    """A number as text without currency signs, grouping commas, leading and trailing zeros; NULL for other texts."""
    t = F.regexp_replace(F.trim(text), r"[$,]", "")
    t = F.when(t.rlike(r"^-?\d+(\.\d+)?$"), F.regexp_replace(t, r"^(-?)0+(?=\d)", "$1"))
    return F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def plain(text: Column) -> Column:
    """A value in the form in which values are compared: case, outer blanks, ways of writing numbers and dashes of dates don't matter."""
    t = F.lower(F.trim(text))
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.regexp_replace(t, "-", ""))
    return F.coalesce(number_text(t), day, t)


def file_order(batches: DataFrame) -> DataFrame:
    """One row per file with the file before it in its stream (``before``, NULL for the first)."""
    files = batches.select("stream_name", "file_seq", "file_name").distinct()
    return files.withColumn("before", F.lag("file_seq").over(Window.partitionBy("stream_name").orderBy("file_seq", "file_name")))


def key_types(vals: DataFrame) -> DataFrame:
    """Statistics by file and key: the type of most non-null values (ties: the first by name), NULL if all are null."""
    counts = vals.groupBy("stream_name", "file_seq", "key", "type").agg(F.count("*").alias("n"))
    most = F.min(F.when(F.col("type").isNotNull(), F.struct((-F.col("n")).alias("n"), "type")))
    return counts.groupBy("stream_name", "file_seq", "key").agg(most["type"].alias("type"), F.sum("n").alias("n_values"))


def words(key: str | Column) -> Column:
    """The words of a key in one order: case, camel case, underscores and a current-year prefix don't matter."""
    spaced = F.lower(F.regexp_replace(F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1 $2"), "_+", " "))
    return F.array_join(F.array_sort(F.filter(F.split(spaced, " "), lambda w: ~w.isin("cy", ""))), " ")


def changes(batches: DataFrame, vals: DataFrame | None = None) -> DataFrame:
    """(stream_name, file_seq, file_name, change_kind, old_name, new_name) of each file against the one before it.

    A key gone and a key new are one renamed key if, in at least half of the filings in which both files give
    the keys a value, the values say the same, and neither has a better partner (then: more such filings, then
    like names). If no filing has both, keys made of the same words are taken for one. Repeated lines count once.
    ``vals`` spares reading the records again: a table of their ``values``.
    """
    vals = cut(values(batches)) if vals is None else vals
    files = cut(file_order(batches))
    types = cut(key_types(vals))
    later = types.join(files, ["stream_name", "file_seq"]).where("before IS NOT NULL")
    earlier = types.select("stream_name", F.col("file_seq").alias("before"), "key", F.col("type").alias("old_type"))
    nexts = files.where("before IS NOT NULL")
    both = nexts.join(earlier, ["stream_name", "before"]).join(types.select("stream_name", "file_seq", "key", "type", F.lit(True).alias("there")), ["stream_name", "file_seq", "key"], "left")
    gone = cut(both.where("there IS NULL").select("stream_name", "file_seq", "before", "file_name", F.col("key").alias("old_name"), "old_type"))
    new = later.join(earlier.select("stream_name", "before", "key", F.lit(True).alias("there")), ["stream_name", "before", "key"], "left").where("there IS NULL")
    new = cut(new.select("stream_name", "file_seq", F.col("key").alias("new_name"), "type"))
    pairs = gone.join(new, ["stream_name", "file_seq"])
    # only values of keys that came or went are compared; these are few beside all, and a table of them is joined as its size allows
    asked = gone.select("stream_name", F.col("before").alias("held"), F.col("old_name").alias("key"), "file_seq", F.lit(True).alias("old"))
    asked = bounded(asked.unionByName(new.select("stream_name", F.col("file_seq").alias("held"), F.col("new_name").alias("key"), "file_seq", F.lit(False).alias("old"))))
    given = vals.where("raw IS NOT NULL AND type IS NOT NULL AND filing_id IS NOT NULL").withColumnRenamed("file_seq", "held").join(asked, ["stream_name", "held", "key"])
    filled = cut(given.select("stream_name", "file_seq", "filing_id", "old", "key", F.xxhash64(plain(inner(F.col("type"), F.col("raw")))).alias("content")).distinct())
    old = filled.where("old").select("stream_name", "file_seq", "filing_id", F.col("key").alias("old_name"), F.col("content").alias("a"))
    cur = filled.where("NOT old").select("stream_name", "file_seq", "filing_id", F.col("key").alias("new_name"), F.col("content").alias("b"))
    compared = old.join(cur, ["stream_name", "file_seq", "filing_id"])
    compared = compared.groupBy("stream_name", "file_seq", "old_name", "new_name", "filing_id").agg(F.max((F.col("a") == F.col("b")).cast("int")).alias("same"))
    compared = compared.groupBy("stream_name", "file_seq", "old_name", "new_name").agg(F.sum("same").alias("same"), F.count("*").alias("seen"))
    scored = pairs.join(compared, ["stream_name", "file_seq", "old_name", "new_name"], "left").withColumn("alike", (words(F.col("old_name")) == words(F.col("new_name"))).cast("int"))
    scored = scored.where((F.col("same") * 2 >= F.col("seen")) & (F.col("same") > 0) | F.col("seen").isNull() & (F.col("alike") == 1))
    best = F.struct((F.coalesce("same", F.lit(0)) / F.coalesce("seen", F.lit(1))).alias("share"), F.coalesce("same", F.lit(0)).alias("same"), "alike", (-F.levenshtein(F.lower("old_name"), F.lower("new_name"))).alias("near"), "old_name", "new_name")
    renamed = scored.withColumn("score", best)
    for side in ("old_name", "new_name"):
        renamed = renamed.withColumn("top", F.max("score").over(Window.partitionBy("stream_name", "file_seq", side))).where("score = top").drop("top")
    renamed = cut(renamed.select("stream_name", "file_seq", "file_name", "old_name", "new_name", "old_type", "type"))
    head = ["stream_name", "file_seq", "file_name"]
    kept = both.where("there").select(*head, F.col("key").alias("new_name"), "old_type", "type")
    retyped = kept.unionByName(renamed.drop("old_name")).where("old_type <> type")
    none = F.lit("")
    parts = [
        renamed.select(*head, F.lit("renamed").alias("change_kind"), "old_name", "new_name"),
        gone.join(renamed.select("stream_name", "file_seq", "old_name"), ["stream_name", "file_seq", "old_name"], "left_anti").select(*head, F.lit("removed").alias("change_kind"), "old_name", none.alias("new_name")),
        new.join(renamed.select("stream_name", "file_seq", "new_name"), ["stream_name", "file_seq", "new_name"], "left_anti").join(nexts.drop("before"), ["stream_name", "file_seq"]).select(*head, F.lit("added").alias("change_kind"), none.alias("old_name"), "new_name"),
        retyped.select(*head, F.lit("retyped").alias("change_kind"), F.col("new_name").alias("old_name"), "new_name"),
    ]
    return reduce(DataFrame.unionByName, parts)


def origins(changed: DataFrame) -> DataFrame:
    """For each key that a stream came to by renaming: (stream_name, key, origin), origin = its first name.

    Names are followed back two, four, eight ... renames at a time until nothing moves any more.
    """
    step = changed.where("change_kind = 'renamed'").groupBy("stream_name", F.col("new_name").alias("key")).agg(F.min_by("old_name", "file_seq").alias("origin"))
    for _ in range(16):
        step = cut(step)
        on = step.select("stream_name", F.col("key").alias("origin"), F.col("origin").alias("further"))
        moved = step.join(on, ["stream_name", "origin"]).where("further <> key AND further <> origin")
        if moved.isEmpty():
            break
        step = step.join(on, ["stream_name", "origin"], "left").select("stream_name", "key", F.when(F.col("further") != F.col("key"), F.col("further")).otherwise(F.col("origin")).alias("origin"))
    return step


def target_column(name: Column, target: dict[str, str]) -> Column:
    """The target column that has the same words as ``name``; NULL if none has."""
    known = {" ".join(sorted(t.split("_"))): t for t in target} | {" ".join(sorted(k.split())): v for k, v in SYNONYMS.items() if v in target}
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return pairs[words(name)]


def cast_to(kind: str, name: str, text: Column) -> Column:
    """``text`` as a value of the target column; NULL where it can't be. Only numbers and dates are rewritten, texts stay as they stand."""
    if kind == "date":
        return F.coalesce(F.try_to_date(F.trim(text), "yyyy-MM-dd"), F.try_to_date(F.trim(text), "yyyyMMdd"))
    if kind in ("double", "bigint"):
        return number_text(text).try_cast(kind)
    if kind == "boolean":
        return F.lower(F.trim(text)).try_cast(kind)
    if name == "ein":
        return F.when(F.length(text) < 9, F.lpad(text, 9, "0")).otherwise(text)
    return text


def placed(vals: DataFrame, changed: DataFrame, target: dict[str, str] = TARGET) -> DataFrame:
    """The values ``vals`` with their target column (``field``, NULL if there is none) and the ``text`` that they hold."""
    vals = vals.join(bounded(origins(changed)), ["stream_name", "key"], "left")
    field = F.coalesce(target_column(F.col("key"), target), target_column(F.col("origin"), target))
    return vals.withColumn("field", field).withColumn("text", inner(F.col("type"), F.col("raw")))


def consistent(batches: DataFrame, target: dict[str, str] = TARGET) -> DataFrame:
    """One row per line of every file with the typed target columns; a value that can't be cast is NULL."""
    vals = cut(values(batches))
    vals = placed(vals, cut(changes(batches, vals)), target)
    columns = [cast_to(kind, name, F.max(F.when(F.col("field") == name, F.col("text")))).alias(name) for name, kind in target.items()]
    return vals.groupBy("stream_name", "file_name", "file_seq", "line_no", "filing_id").agg(*columns)


def failed_casts(batches: DataFrame, target: dict[str, str] = TARGET) -> DataFrame:
    """Non-null values that don't fit their target column, counted by file, key and raw type, with one example."""
    vals = cut(values(batches))
    vals = placed(vals, cut(changes(batches, vals)), target).where("field IS NOT NULL AND type IS NOT NULL")
    fits = F.lit(False)
    for name, kind in target.items():
        fits = F.when(F.col("field") == name, cast_to(kind, name, F.col("text")).isNotNull()).otherwise(fits)
    return vals.where(~fits).groupBy("stream_name", "file_name", "key", "field", "type").agg(F.count("*").alias("n"), F.min("text").alias("example"))


def path_types(batches: DataFrame) -> DataFrame:
    """(stream_name, file_name, path, type, n): how often each path inside the records, at any depth, holds a value of each type; elements of arrays are ``[]``."""
    nodes = shred(batches.select("*", F.to_json(F.struct("stream_name", "file_name", "line_no")).alias("record")), "", "record", "record_json")
    at = F.from_json("parent_key", "stream_name string, file_name string, line_no int")
    path = F.concat_ws(".", *[F.lit("$")], F.array_join(F.zip_with(F.split(F.coalesce("path", F.lit("")), SEPARATOR), "positions", lambda k, p: F.when(p.isNull(), k).otherwise(F.concat(k, F.lit("[]")))), "."))
    return nodes.where("parent >= 0").select(at.alias("f"), path.alias("path"), "kind").groupBy("f.stream_name", "f.file_name", "path", F.col("kind").alias("type")).agg(F.count("*").alias("n"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    return changes(table(spark, sf_dir, "irs990_raw_batches")).select("file_name", "change_kind", "old_name", "new_name")


def p6_table(spark, sf_dir: str) -> DataFrame:
    return consistent(table(spark, sf_dir, "irs990_raw_batches"))


def p6_failed_casts(spark, sf_dir: str) -> DataFrame:
    return failed_casts(table(spark, sf_dir, "irs990_raw_batches"))


def p6_paths(spark, sf_dir: str) -> DataFrame:
    """Statistics of types by file and path, below the top level too."""
    return path_types(table(spark, sf_dir, "irs990_raw_batches"))


# What all comparisons share: values of the records, statistics by file and key, and renames.
_BASE_SQL = r"""
WITH rec AS (SELECT stream_name, file_seq, file_name, line_no, record_json::JSON AS j FROM irs990_raw_batches WHERE json_valid(record_json) AND json_type(record_json) = 'OBJECT'),
vals AS (SELECT stream_name, file_seq, file_name, line_no, TRY_CAST(j ->> '$.filing_id' AS BIGINT) AS filing_id, e.key AS k,
  CASE e.type WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS t,
  CASE WHEN e.type = 'ARRAY' AND json_array_length(e.value) = 1 THEN e.value ->> '$[0]' WHEN e.type = 'OBJECT' THEN coalesce(e.value ->> '$.value', e.value::VARCHAR) WHEN e.type = 'ARRAY' THEN e.value::VARCHAR ELSE e.value ->> '$' END AS txt
  FROM rec, json_each(j) e),
num AS (SELECT *, replace(replace(trim(txt), '$', ''), ',', '') AS bare FROM vals),
said AS (SELECT *, CASE WHEN regexp_full_match(bare, '-?\d+(\.\d+)?') THEN regexp_replace(regexp_replace(regexp_replace(bare, '^(-?)0+(\d)', '\1\2'), '(\.\d*?)0+$', '\1'), '\.$', '') END AS n FROM num),
files AS (SELECT *, lag(file_seq) OVER (PARTITION BY stream_name ORDER BY file_seq, file_name) AS before FROM (SELECT DISTINCT stream_name, file_seq, file_name FROM irs990_raw_batches)),
kinds AS (SELECT stream_name, file_seq, k, t FROM (SELECT *, row_number() OVER (PARTITION BY stream_name, file_seq, k ORDER BY t IS NULL, c DESC, t) AS rn FROM (SELECT stream_name, file_seq, k, t, count(*) AS c FROM vals GROUP BY ALL)) WHERE rn = 1),
gone AS (SELECT f.stream_name, f.file_seq, f.before, f.file_name, o.k AS old_name, o.t AS old_t FROM files f JOIN kinds o ON o.stream_name = f.stream_name AND o.file_seq = f.before LEFT JOIN kinds n ON n.stream_name = f.stream_name AND n.file_seq = f.file_seq AND n.k = o.k WHERE n.k IS NULL),
fresh AS (SELECT f.stream_name, f.file_seq, f.file_name, n.k AS new_name, n.t AS new_t FROM files f JOIN kinds n ON n.stream_name = f.stream_name AND n.file_seq = f.file_seq LEFT JOIN kinds o ON o.stream_name = f.stream_name AND o.file_seq = f.before AND o.k = n.k WHERE f.before IS NOT NULL AND o.k IS NULL),
plain AS (SELECT DISTINCT stream_name, file_seq, filing_id, k, coalesce(n, CASE WHEN regexp_full_match(trim(txt), '\d{4}-\d{2}-\d{2}') THEN replace(trim(txt), '-', '') END, lower(trim(txt))) AS v FROM said WHERE t IS NOT NULL AND txt IS NOT NULL AND filing_id IS NOT NULL),
each_ AS (SELECT g.stream_name, g.file_seq, g.old_name, h.new_name, a.filing_id, max((a.v = b.v)::INT) AS same FROM gone g JOIN fresh h USING (stream_name, file_seq)
  JOIN plain a ON a.stream_name = g.stream_name AND a.file_seq = g.before AND a.k = g.old_name JOIN plain b ON b.stream_name = g.stream_name AND b.file_seq = g.file_seq AND b.k = h.new_name AND b.filing_id = a.filing_id GROUP BY ALL),
seen AS (SELECT stream_name, file_seq, old_name, new_name, sum(same) AS same, count(*) AS seen FROM each_ GROUP BY ALL),
spelt AS (SELECT g.*, h.new_name, h.new_t, s.same, s.seen, (list_sort(list_filter(string_split(lower(regexp_replace(regexp_replace(old_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_+', ' ', 'g')), ' '), lambda w: w NOT IN ('cy', '')))
  = list_sort(list_filter(string_split(lower(regexp_replace(regexp_replace(h.new_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_+', ' ', 'g')), ' '), lambda w: w NOT IN ('cy', ''))))::INT AS alike
  FROM gone g JOIN fresh h USING (stream_name, file_seq) LEFT JOIN seen s USING (stream_name, file_seq, old_name, new_name)),
scored AS (SELECT *, coalesce(same, 0) / coalesce(seen, 1) AS share, -levenshtein(lower(old_name), lower(new_name)) AS near FROM spelt WHERE same * 2 >= seen AND same > 0 OR seen IS NULL AND alike = 1),
one AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY stream_name, file_seq, old_name ORDER BY share DESC, same DESC NULLS LAST, alike DESC, near DESC, old_name DESC, new_name DESC) = 1),
renamed AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY stream_name, file_seq, new_name ORDER BY share DESC, same DESC NULLS LAST, alike DESC, near DESC, old_name DESC, new_name DESC) = 1)
"""
P6_FOUND_SQL = (
    _BASE_SQL
    + """SELECT file_name, 'renamed' AS change_kind, old_name, new_name FROM renamed
UNION ALL SELECT file_name, 'removed', old_name, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.stream_name = g.stream_name AND r.file_seq = g.file_seq AND r.old_name = g.old_name)
UNION ALL SELECT file_name, 'added', '', new_name FROM fresh h WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.stream_name = h.stream_name AND r.file_seq = h.file_seq AND r.new_name = h.new_name)
UNION ALL SELECT file_name, 'retyped', new_name, new_name FROM renamed WHERE old_t <> new_t
UNION ALL SELECT f.file_name, 'retyped', n.k, n.k FROM files f JOIN kinds o ON o.stream_name = f.stream_name AND o.file_seq = f.before JOIN kinds n ON n.stream_name = f.stream_name AND n.file_seq = f.file_seq AND n.k = o.k WHERE o.t <> n.t"""
)
_FIELDS_SQL = ", ".join(f"('{k}', '{v}')" for k, v in ({" ".join(sorted(t.split("_"))): t for t in TARGET} | {" ".join(sorted(k.split())): v for k, v in SYNONYMS.items()}).items())
_PLACED_SQL = (
    _BASE_SQL.replace("WITH rec", "WITH RECURSIVE rec", 1)
    + r""", back AS (SELECT stream_name, new_name AS k, arg_min(old_name, file_seq) AS origin FROM renamed GROUP BY ALL),
chain AS (SELECT stream_name, k, origin, 1 AS depth FROM back UNION ALL SELECT c.stream_name, c.k, b.origin, depth + 1 FROM chain c JOIN back b ON b.stream_name = c.stream_name AND b.k = c.origin WHERE b.origin <> c.k AND depth < 20),
origins AS (SELECT stream_name, k, arg_max(origin, depth) AS origin FROM chain GROUP BY ALL),
fields(w, field) AS (VALUES """
    + _FIELDS_SQL
    + r"""),
named AS (SELECT s.*, o.origin FROM said s LEFT JOIN origins o USING (stream_name, k)),
put AS (SELECT named.*, coalesce(a.field, b.field) AS field FROM named
  LEFT JOIN fields a ON a.w = array_to_string(list_sort(list_filter(string_split(lower(regexp_replace(regexp_replace(k, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_+', ' ', 'g')), ' '), lambda w: w NOT IN ('cy', ''))), ' ')
  LEFT JOIN fields b ON b.w = array_to_string(list_sort(list_filter(string_split(lower(regexp_replace(regexp_replace(origin, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_+', ' ', 'g')), ' '), lambda w: w NOT IN ('cy', ''))), ' '))
"""
)
_CAST_SQL = {
    "date": "coalesce(TRY_CAST(try_strptime(trim(txt), '%Y-%m-%d') AS DATE), TRY_CAST(try_strptime(trim(txt), '%Y%m%d') AS DATE))",
    "double": "TRY_CAST(n AS DOUBLE)",
    "bigint": "CASE WHEN n NOT LIKE '%.%' THEN TRY_CAST(n AS BIGINT) END",
    "boolean": "CASE WHEN lower(trim(txt)) IN ('t', 'true', 'y', 'yes', '1') THEN true WHEN lower(trim(txt)) IN ('f', 'false', 'n', 'no', '0') THEN false END",
    "string": "txt",
}
_TYPED_SQL = ", ".join(f"max(CASE WHEN field = '{c}' THEN {'CASE WHEN length(txt) < 9 THEN lpad(txt, 9, chr(48)) ELSE txt END' if c == 'ein' else _CAST_SQL[k]} END) AS {c}" for c, k in TARGET.items())
_FITS_SQL = " ".join(f"WHEN '{c}' THEN {_CAST_SQL[k]} IS NOT NULL" for c, k in TARGET.items())
SQL = {
    "p6_found": P6_FOUND_SQL,
    "p6_table": _PLACED_SQL + f"SELECT stream_name, file_name, file_seq, line_no, filing_id, {_TYPED_SQL} FROM put GROUP BY ALL",
    "p6_failed_casts": _PLACED_SQL + f"SELECT stream_name, file_name, k AS key, field, t AS type, count(*) AS n, min(txt) AS example FROM put WHERE field IS NOT NULL AND t IS NOT NULL AND NOT CASE field {_FITS_SQL} END GROUP BY ALL",
}
