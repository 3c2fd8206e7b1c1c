"""Schemas that drift between files: one consistent table, and a report of every change.

Headers are read in parallel (Parquet footers, or the keys of JSON lines), folded through a
lattice of type promotions, and the files are cast to the folded schema.

The lattice: null is below everything; integer < decimal < text; boolean < text; timestamp <
text. The fold of any set of types is their least upper bound, so its order doesn't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costplan.operators.ordered import numbered
from costplan.session import written

#: Spark's type of each kind, in the order of the lattice.
SPARK_TYPE = {"null": "string", "boolean": "boolean", "integer": "bigint", "decimal": "double", "timestamp": "timestamp_ntz", "text": "string"}


def promote(a: str, b: str) -> str:
    """Least upper bound of two kinds."""
    for kind in (a, b):
        if kind not in SPARK_TYPE:
            raise ValueError(f"unknown kind {kind}")
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    return "decimal" if {a, b} == {"integer", "decimal"} else "text"


def promoted(a: Column, b: Column) -> Column:
    """promote() of two columns of kinds; a null is the kind of nulls."""
    x, y = (F.coalesce(c, F.lit("null")) for c in (a, b))
    both = lambda *kinds: x.isin(*kinds) & y.isin(*kinds)
    return F.when(x == y, x).when(x == "null", y).when(y == "null", x).when(both("integer", "decimal"), F.lit("decimal")).otherwise(F.lit("text"))


def fold(kinds: Iterable[str]) -> str:
    """The kind that holds all of the given ones; null of none."""
    result = "null"
    for kind in kinds:
        result = promote(result, kind)
    return result


def read_headers(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(file, position, field, kind) of Parquet files, their footers read by the executors."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        def kind(t) -> str:
            is_ = pa.types
            if is_.is_null(t):
                return "null"
            if is_.is_boolean(t):
                return "boolean"
            if is_.is_integer(t):
                return "integer"
            if is_.is_floating(t) or is_.is_decimal(t):
                return "decimal"
            return "timestamp" if is_.is_temporal(t) else "text"

        for batch in batches:
            for path in batch["file"]:
                system, inner = fs.FileSystem.from_uri(path)
                schema = pq.read_schema(system.open_input_file(inner))
                yield pd.DataFrame([(path, i, f.name, kind(f.type)) for i, f in enumerate(schema)], columns=["file", "position", "field", "kind"]).astype({"file": object, "field": object, "kind": object})

    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 10_000)))
    return listed.mapInPandas(scan, "file string, position int, field string, kind string")


def _kind(value: Column) -> Column:
    """Kind of a variant: a whole number that JSON writes with a point is a decimal."""
    name = F.schema_of_variant(value)
    wide = F.regexp_extract(name, r"^DECIMAL\((\d+),0\)", 1)
    return (
        F.when(name == "VOID", None)
        .when(name == "STRING", "text")
        .when(name == "BIGINT", "integer")
        .when(name == "BOOLEAN", "boolean")
        .when((wide != "") & (wide.try_cast("int") > 18), "integer")
        .when(name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT"), "decimal")
        .otherwise("text")
    )


def _readable(lines: DataFrame) -> DataFrame:
    """lines that look like objects, with the parsed payload __v; null where it can't be read.

    No condition is put on __v, as Spark would then parse it once for the filter and once more.
    """
    return lines.where(F.col("payload").rlike(r"^\s*\{")).withColumn("__v", F.try_parse_json("payload")).drop("payload")


def _explode(view: DataFrame) -> DataFrame:
    return view.sparkSession.tvf.variant_explode(F.col("__v").outer())


def content_kind(kind: Column, text: Column) -> Column:
    """The kind of a value by what it says: a text that spells a number is a number."""
    text = F.trim(text)
    said = (
        F.when(text.rlike(r"^[+-]?\d{1,18}$"), "integer")
        .when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "decimal")
        .when(F.lower(text).isin("true", "false"), "boolean")
        .when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d"), "timestamp")
        .otherwise("text")
    )
    return F.when(kind == "text", said).otherwise(kind)


def parsed(lines: DataFrame, record: str = "run_id") -> DataFrame:
    """(file_id, record, key, kind, value): the cells of the readable lines, value as lower-case text.

    Readable is a line that is a JSON object of distinct keys. Arrays, bare values, broken and
    null lines have no fields.
    """
    named = F.try_variant_get(F.col("__v"), f"$['{record}']", "string").alias("record")
    view = _readable(lines.select("file_id", "payload")).select("file_id", named, "__v")
    cells = view.lateralJoin(_explode(view)).where(F.col("key").isNotNull())
    return cells.select("file_id", "record", "key", _kind(F.col("value")).alias("kind"), F.lower(F.col("value").cast("string")).alias("value"))


def file_fields(cells: DataFrame, by_content: bool = False) -> DataFrame:
    """(file_id, key, kind, n): counts of the kinds of each key's values in parsed() lines; kind null for nulls.

    by_content takes texts for what they spell, which lets the union keep numbers as numbers
    where some files write them as texts.
    """
    kind = content_kind(F.col("kind"), F.col("value")) if by_content else F.col("kind")
    return cells.groupBy("file_id", "key", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def majority(counts: DataFrame) -> DataFrame:
    """(file_id, key, kind): the kind of most non-null values; ties go to the wider kind."""
    rank = F.when(F.col("kind") == "text", 3).when(F.col("kind") == "decimal", 2).when(F.col("kind") == "integer", 1).otherwise(0)
    top = F.max(F.when(F.col("kind").isNotNull(), F.struct("n", rank.alias("r"), "kind")))
    return counts.groupBy("file_id", "key").agg(top.getField("kind").alias("kind"))


def _tokens(name: Column) -> Column:
    words = F.split(F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, "s$", "")), lambda w: w != "")


def _related(a: Column, b: Column) -> Column:
    """Whether two names share a word, or one abbreviates the other."""
    plain_a, plain_b = F.array_join(_tokens(a), ""), F.array_join(_tokens(b), "")
    return F.arrays_overlap(_tokens(a), _tokens(b)) | plain_a.startswith(plain_b) | plain_b.startswith(plain_a)


#: Ratios between units of time or size, a fixed list.
UNITS = (60.0, 1000.0, 1024.0, 3600.0, 1e6, 1e9)


def _renames(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """(file_id, old, new) for fields whose values in repeated records carry on those of a gone field.

    cells are parsed() lines; pairs has (file_id, previous, old, old_kind, new, new_kind), every
    gone field of a file beside every new one. Values are compared as the promoted kind of both.
    """
    wanted = pairs.select("file_id", F.col("new").alias("key"), F.col("file_id").alias("owner"), F.lit("new").alias("side")).union(pairs.select("previous", "old", "file_id", F.lit("old"))).distinct()
    known = cells.where(F.col("record").isNotNull() & F.col("value").isNotNull()).select("file_id", "record", "key", "value")
    # One pass over the cells for both sides.
    values = written(known.join(wanted, ["file_id", "key"]).select("owner", "record", "key", "side", "value").distinct(), "values")
    of = lambda side: values.where(F.col("side") == side).select(F.col("owner").alias("file_id"), "record", F.col("key").alias(side), F.col("value").alias(f"{side}_value"))
    both = of("new").join(of("old"), ["file_id", "record"])
    x, y = F.col("old_value").try_cast("double"), F.col("new_value").try_cast("double")
    equal = F.coalesce(F.abs(x - y) <= 1e-9 * F.greatest(F.abs(x), F.abs(y)), F.col("old_value") == F.col("new_value"))
    ratio = F.when((x != 0) & (y != 0), F.greatest(F.abs(x), F.abs(y)) / F.least(F.abs(x), F.abs(y)))
    in_unit = F.coalesce(F.array_max(F.array(*[F.when(F.abs(ratio / u - 1) < 0.05, u).otherwise(0.0) for u in UNITS])), F.lit(0.0))
    seen = both.groupBy("file_id", "old", "new").agg(
        F.count(F.lit(1)).alias("n"), F.sum(equal.cast("int")).alias("n_equal"), F.approx_count_distinct("old_value").alias("n_distinct"), F.min(in_unit).alias("unit_min"), F.max(in_unit).alias("unit_max")
    )
    scored = pairs.join(seen, ["file_id", "old", "new"], "left").withColumn("related", _related(F.col("old"), F.col("new")))
    is_bool = (F.col("old_kind") == "boolean") & (F.col("new_kind") == "boolean")
    share = F.coalesce(F.col("n_equal") / F.col("n"), F.lit(0.0))
    by_value = (share >= 0.8) & (F.col("related") | (~F.coalesce(is_bool, F.lit(False)) & ((F.col("n_distinct") >= 2) | (F.col("n") >= 2))) | ((F.col("n") >= 8) & (F.col("n_distinct") >= 2)))
    by_unit = (F.col("n") >= 2) & (F.col("n_distinct") >= 2) & (F.col("unit_min") > 0) & (F.col("unit_min") == F.col("unit_max")) & F.col("related")
    unseen = F.col("n").isNull() & (F.array_join(_tokens(F.col("old")), "") == F.array_join(_tokens(F.col("new")), ""))
    good = scored.where(F.coalesce(by_value | by_unit, F.lit(False)) | unseen)
    # One to one: a pair that is the best of both its fields.
    order = [share.desc(), F.col("related").desc(), F.col("n_distinct").desc_nulls_last(), F.col("n").desc_nulls_last(), "old", "new"]
    ranked = good.withColumns({"of_new": F.row_number().over(Window.partitionBy("file_id", "new").orderBy(*order)), "of_old": F.row_number().over(Window.partitionBy("file_id", "old").orderBy(*order))})
    return ranked.where("of_new = 1 and of_old = 1").select("file_id", "old", "new")


def changes(lines: DataFrame, record: str = "run_id", cells: DataFrame | None = None) -> DataFrame:
    """(feed, position, file_id, previous, field_name, old_name, change_kind, old_kind, new_kind, union_kind).

    lines has file_id, feed, written_at and payload, a JSON object per line. A file is compared
    with the one written before it in its feed (ties by file_id; a null written_at comes first;
    a null feed is a feed). change_kind is added, removed, renamed or retyped; a field both
    renamed and retyped gives two rows. A file without readable lines is left out of the chain.
    union_kind is the promotion of both kinds, in which the two files can be read as one. cells
    are the parsed() lines where they are at hand. Rows are distinct by file, field and kind of
    change. Repeated lines and the order of lines and keys don't matter; an empty table gives no
    rows.
    """
    cells = written(parsed(lines, record), "cells") if cells is None else cells
    # Files are many fewer than lines; a feed's files are numbered without gathering them.
    fields = written(majority(file_fields(cells)), "kinds")
    heads = lines.groupBy("file_id").agg(F.min("feed").alias("feed"), F.min("written_at").alias("written_at")).join(fields.select("file_id").distinct(), "file_id", "left_semi")
    files = written(numbered(heads, ["feed"], ["written_at", "file_id"], F.struct(F.to_date("written_at"), F.when(F.col("written_at").isNull(), F.floor(F.col("file_id") / 4096)))), "files")
    one, two = files.alias("a"), files.alias("b")
    chain = one.join(two, F.col("a.feed").eqNullSafe(F.col("b.feed")) & (F.col("a.position") == F.col("b.position") + 1))
    chain = written(chain.select("a.feed", "a.position", "a.file_id", F.col("b.file_id").alias("previous")), "chain")
    now = fields.join(chain, "file_id").select("file_id", "key", F.lit(1).alias("now"), F.col("kind").alias("new_kind"), F.lit(None).cast("int").alias("then"), F.lit(None).cast("string").alias("old_kind"))
    then = fields.withColumnRenamed("file_id", "previous").join(chain, "previous").select("file_id", "key", F.lit(None).cast("int").alias("now"), F.lit(None).cast("string").alias("new_kind"), F.lit(1).alias("then"), F.col("kind").alias("old_kind"))
    beside = now.union(then).groupBy("file_id", "key").agg(*[F.max(c).alias(c) for c in ("now", "new_kind", "then", "old_kind")])
    # A kind changed if the lattice needs a wider one than either file's; the kind of nulls is below all, so it never does.
    wider = promoted(F.col("old_kind"), F.col("new_kind"))
    beside = beside.withColumn("retyped", (wider != F.coalesce("old_kind", wider)) | (wider != F.coalesce("new_kind", wider)))
    beside = written(beside.where(F.col("now").isNull() | F.col("then").isNull() | F.col("retyped")), "beside")
    new = beside.where("then is null").select("file_id", F.col("key").alias("new"), "new_kind")
    old = beside.where("now is null").select("file_id", F.col("key").alias("old"), "old_kind")
    pairs = written(new.join(old, "file_id").join(chain.select("file_id", "previous"), "file_id"), "pairs")
    renamed = written(_renames(cells, pairs), "renamed")
    both = renamed.join(pairs, ["file_id", "old", "new"])
    none = F.lit(None).cast("string")
    rows = [
        new.join(renamed, ["file_id", "new"], "left_anti").select("file_id", F.col("new").alias("field_name"), none.alias("old_name"), F.lit("added").alias("change_kind"), none.alias("old_kind"), "new_kind"),
        old.join(renamed, ["file_id", "old"], "left_anti").select("file_id", F.col("old"), none, F.lit("removed"), "old_kind", none),
        both.select("file_id", "new", "old", F.lit("renamed"), "old_kind", "new_kind"),
        both.where((wider != F.coalesce("old_kind", wider)) | (wider != F.coalesce("new_kind", wider))).select("file_id", "new", "old", F.lit("retyped"), "old_kind", "new_kind"),
        beside.where("now is not null and then is not null and retyped").select("file_id", "key", none, F.lit("retyped"), "old_kind", "new_kind"),
    ]
    log = rows[0]
    for r in rows[1:]:
        log = log.union(r)
    return log.join(chain, "file_id").select("feed", "position", "file_id", "previous", "field_name", "old_name", "change_kind", "old_kind", "new_kind", promoted(F.col("old_kind"), F.col("new_kind")).alias("union_kind"))


def canonical_names(links: Iterable[tuple[str, str]], preferred: Sequence[str]) -> dict[str, str]:
    """One name for all names tied by links: the first preferred one, else the least.

    links are distinct pairs of field names, so they are bounded by the names in use.
    """
    up: dict[str, str] = {}

    def root(x: str) -> str:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        up[root(a)] = root(b)
    place = {n: i for i, n in reversed(list(enumerate(preferred)))}
    best: dict[str, str] = {}
    for name in list(up):
        r = root(name)
        best[r] = min(best.get(r, name), name, key=lambda n: (place.get(n, len(preferred)), n))
    return {name: best[root(name)] for name in up}


def to_kind(text: Column, kind: str) -> Column:
    """A text as the kind's Spark type; null where it isn't one."""
    if kind == "integer":
        return F.coalesce(text.try_cast("bigint"), F.when(text.try_cast("double") == F.floor(text.try_cast("double")), text.try_cast("double").try_cast("bigint")))
    if kind == "timestamp":
        return F.to_utc_timestamp(text.try_cast("timestamp"), "UTC").try_cast("timestamp_ntz")
    return text.try_cast(SPARK_TYPE[kind])


def cast_lines(lines: DataFrame, schema: Mapping[str, str], names: Mapping[str, Sequence[str]]) -> DataFrame:
    """lines as rows of schema (field to kind); names gives each field's spellings, first found wins.

    Values that aren't of the field's kind (strays) are null there and kept as text in the map
    column strays. Unreadable lines are left out.
    """
    v = F.col("__v")
    texts = {c: F.coalesce(*[F.try_variant_get(v, f"$['{n}']", "string") for n in names.get(c, [c])]) for c in schema}
    rows = _readable(lines).where(F.col("__v").isNotNull())
    rows = rows.withColumns({f"__t_{c}": t for c, t in texts.items()})
    cast = {c: to_kind(F.col(f"__t_{c}"), k) for c, k in schema.items()}
    strays = F.map_from_entries(F.array_compact(F.array(*[F.when(F.col(f"__t_{c}").isNotNull() & x.isNull(), F.struct(F.lit(c).alias("k"), F.col(f"__t_{c}").alias("v"))) for c, x in cast.items()])))
    kept = [c for c in lines.columns if c != "payload"]
    return rows.select(*kept, *[x.alias(c) for c, x in cast.items()], F.when(F.size(strays) > 0, strays).alias("strays"))


def unit_steps(rows: DataFrame, fields: Sequence[str], record: str = "run_id") -> DataFrame:
    """(feed, field, written_at, file_id, step): fields whose values in repeated records are `step` times those of the file before.

    rows has feed, written_at, file_id, line_no, record and fields (numbers). As for renames, at
    least two records with distinct values must agree on the unit, and none may contradict.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in fields])).alias("e")
    long = rows.where(F.col(record).isNotNull()).select("feed", "written_at", "file_id", "line_no", F.col(record).alias("record"), pairs).where("e.v is not null")
    cells = long.groupBy("feed", "record", "e.field", "written_at", "file_id").agg(F.max_by("e.v", "line_no").alias("v"))
    w = Window.partitionBy("feed", "record", "field").orderBy("written_at", "file_id")
    ratio = F.when((F.col("v") > 0) & (F.col("then") > 0), F.col("v") / F.col("then"))
    units = [x for u in UNITS for x in (u, 1 / u)]
    near = F.array_min(F.array(*[F.struct(F.abs(ratio / u - 1).alias("off"), F.lit(u).alias("u")) for u in units]))
    step = F.when(near["off"] < 0.05, near["u"]).when((ratio > 0) | (F.col("v") != F.col("then")), 1.0)
    both = cells.withColumn("then", F.lag("v").over(w)).where("then is not null").withColumn("step", step).where("step is not null")
    found = both.groupBy("feed", "field", "written_at", "file_id").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("then").alias("n_distinct"), F.min("step").alias("step"), F.max("step").alias("most"))
    return found.where("n >= 2 and n_distinct >= 2 and step = most and step <> 1").select("feed", "field", "written_at", "file_id", "step")


def in_one_unit(rows: DataFrame, steps: DataFrame, fields: Sequence[str]) -> DataFrame:
    """rows with fields in the unit of their feed's first file; a step holds for its file and all later ones."""
    at = lambda a: F.struct(F.col(f"{a}.written_at").alias("w"), F.col(f"{a}.file_id").alias("f"))
    files = rows.select("feed", "written_at", "file_id").distinct()
    after = files.alias("f").join(steps.alias("s"), F.col("f.feed").eqNullSafe(F.col("s.feed")) & (at("s") <= at("f")))
    factors = after.groupBy("f.file_id", "s.field").agg(F.product("step").alias("factor"))
    by_file = factors.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "factor"))).alias("__factors"))
    return rows.join(by_file, "file_id", "left").withColumns({c: F.col(c) / F.coalesce(F.col("__factors")[c], F.lit(1.0)) for c in fields}).drop("__factors")


def latest(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per keys: each field's value written last, nulls aside, and all strays, of a field the one written last."""
    order = F.struct("written_at", "file_id", "line_no")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in fields if c not in keys]
    listed = F.sort_array(F.collect_list(F.when(F.col("strays").isNotNull(), F.struct("written_at", "file_id", "line_no", F.map_entries("strays").alias("s")))))
    none = F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))
    merged = F.aggregate(listed, none, lambda a, x: F.map_zip_with(a, F.map_from_entries(x["s"]), lambda _, old, new: F.coalesce(new, old)))
    return rows.groupBy(*keys).agg(*last, merged.alias("strays")).withColumn("strays", F.when(F.size("strays") > 0, F.col("strays")))


def cast_table(df: DataFrame, schema: Mapping[str, str], names: Mapping[str, Sequence[str]]) -> DataFrame:
    """df's columns as schema; fields it lacks are null. Casting to a wider kind loses nothing; texts not of the field's kind go to strays."""
    out, strays = [], []
    for c, kind in schema.items():
        found = [F.col(f"`{n}`") for n in names.get(c, [c]) if n in df.columns]
        text_to = kind != "text" and found and dict(df.dtypes)[next(n for n in names.get(c, [c]) if n in df.columns)] == "string"
        x = F.coalesce(*found) if found else F.lit(None)
        out.append((to_kind(x, kind) if text_to else x.cast(SPARK_TYPE[kind])).alias(c))
        if text_to:
            strays.append(F.when(x.isNotNull() & to_kind(x, kind).isNull(), F.struct(F.lit(c).alias("k"), x.cast("string").alias("v"))))
    kept = F.map_from_entries(F.array_compact(F.array(*strays))) if strays else F.lit(None).cast("map<string,string>")
    return df.select(*out, F.when(F.size(kept) > 0, kept).alias("strays"))
