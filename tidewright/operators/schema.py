"""Schemas of records: inference, merging, versions, validation, coercion, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types in the order that breaks ties, and how many records inference looks at. (fixed values)
LATTICE = ("int", "float", "bool", "datetime", "str")
SAMPLE, SAMPLES = 100, 5
SPARK_TYPES = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "datetime": T.TimestampNTZType(), "json": T.VariantType(), "list": T.ArrayType(T.VariantType()), "dict": T.MapType(T.StringType(), T.VariantType())}
PROFILE = "name string, inferred_type string, nullable boolean, sample_values array<string>, confidence double"


def detect_type(value: Column) -> Column:
    """Type a text looks like: bool (also 1 and 0), int, float, datetime or str; null for null."""
    v = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    low = F.lower(v)
    return (
        F.when(value.isNull(), None)
        .when(low.isin("true", "false", "yes", "no", "1", "0"), "bool")
        .when(v.rlike(r"^[+-]?\d+(_\d+)*$"), "int")
        .when(v.rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$") | low.rlike(r"^[+-]?(inf|infinity|nan)$"), "float")
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}$") | v.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}") | v.rlike(r"^\d{2}/\d{2}/\d{4}$") | v.rlike(r"^\d{2}-\d{2}-\d{4}$"), "datetime")
        .otherwise("str")
    )


def detect_cell_type(v: Column) -> Column:
    """Type of a VARIANT value: typed values by their type, text by what it looks like, nested ones str."""
    k = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (k == "VOID"), None)
        .when(k == "BOOLEAN", "bool")
        .when(k == "BIGINT", "int")
        .when((k == "DOUBLE") | k.startswith("DECIMAL"), "float")
        .when(k == "STRING", detect_type(F.try_variant_get(v, "$", "string")))
        .otherwise("str")
    )


def detect_excel_type(v: Column) -> Column:
    """As :func:`detect_cell_type`, but text is a datetime if it has a ``T`` or is ten long with two dashes, else str."""
    k, t = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    date = F.contains(t, F.lit("T")) | ((F.length(t) == 10) & (F.length(F.replace(t, F.lit("-"), F.lit(""))) == 8))
    return F.when(v.isNull() | (k == "VOID"), None).when(k == "BOOLEAN", "bool").when(k == "BIGINT", "int").when((k == "DOUBLE") | k.startswith("DECIMAL"), "float").when(date, "datetime").otherwise("str")


def cells_of_columns(df: DataFrame, order: Column, columns: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """(ord, name, value) of the first ``sample`` rows by ``order``, values as text."""
    cols = columns or df.columns
    rows = df.orderBy(order).limit(sample).select(F.row_number().over(Window.orderBy(order)).alias("ord"), *cols)
    return rows.select("ord", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols])).alias("c")).select("ord", "c.*")


def cells_of_json(df: DataFrame, data: str, order: Column, sample: int = SAMPLE) -> DataFrame:
    """(ord, name, value VARIANT) of the first ``sample`` records; a field absent from a record is null there."""
    v = F.try_parse_json(data)
    rows = df.where(F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))).orderBy(order).limit(sample).select(F.row_number().over(Window.orderBy(order)).alias("ord"), F.try_variant_get(v, "$", "map<string,variant>").alias("m"))
    names = rows.select(F.explode(F.map_keys("m")).alias("name")).distinct()
    # Records of the sample times its names: both bounded by the sample.
    return rows.join(F.broadcast(names), F.lit(True)).select("ord", "name", F.col("m")[F.col("name")].alias("value"))


def infer(cells: DataFrame, kind: str = "text") -> DataFrame:
    """Profile of fields from sampled cells (ord, name, value): the type most values have and its share.

    Ties go by the lattice; a field without values is str with 0.5.  ``kind``:
    text, json or excel.
    """
    v = F.col("value")
    typ = {"text": detect_type, "json": detect_cell_type, "excel": detect_excel_type}[kind](v)
    txt = v if kind == "text" else F.try_variant_get(v, "$", "string")
    empty = txt.isNull() if kind == "excel" else txt.isNull() | (txt == "")
    rows = cells.select("ord", "name", typ.alias("t"), txt.alias("txt"), empty.alias("empty"))
    votes = rows.where("t is not null").groupBy("name", "t").agg(F.count("*").alias("n"))
    rank = reduce(lambda a, p: F.when(F.col("t") == p[1], F.lit(-p[0])).otherwise(a), enumerate(LATTICE), F.lit(-9))
    best = votes.groupBy("name").agg(F.max_by("t", F.struct("n", rank)).alias("t"), F.max("n").alias("top"), F.sum("n").alias("all"))
    first = F.array_sort(F.collect_list(F.when(~F.col("empty"), F.struct("ord", "txt")) if kind == "excel" else F.when(F.col("ord") <= SAMPLES, F.struct("ord", "txt", "empty"))))
    info = rows.groupBy("name").agg(F.bool_or("empty").alias("nullable"), first.alias("s"))
    if kind == "excel":
        samples = F.transform(F.slice("s", 1, SAMPLES), lambda x: x["txt"])
    else:
        samples = F.transform(F.filter("s", lambda x: ~x["empty"]), lambda x: x["txt"])
    out = info.join(best, "name", "left")
    return out.select("name", F.coalesce("t", F.lit("str")).alias("inferred_type"), "nullable", samples.alias("sample_values"), F.coalesce(F.col("top") / F.col("all"), F.lit(0.5)).alias("confidence"))


def confidence(profile: DataFrame) -> DataFrame:
    return profile.agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))


def merge(profiles: DataFrame) -> DataFrame:
    """One profile from several (with ``seq``): types weighted by confidence (a tie goes to the first seen), mean confidence, nullable if any is, first five distinct samples."""
    votes = profiles.groupBy("name", "inferred_type").agg(F.sum("confidence").alias("w"), F.min("seq").alias("first"))
    best = votes.groupBy("name").agg(F.min_by("inferred_type", F.struct(-F.round("w", 9), "first")).alias("inferred_type"))
    rest = profiles.groupBy("name").agg(F.avg("confidence").alias("confidence"), F.bool_or("nullable").alias("nullable"), F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "sample_values"))), lambda x: x["sample_values"]))), 1, SAMPLES).alias("sample_values"))
    return best.join(rest, "name").select("name", "inferred_type", "nullable", "sample_values", "confidence")


def struct_type(profile: DataFrame) -> T.StructType:
    """A Spark schema from a profile (one row per field)."""
    return T.StructType([T.StructField(r["name"], SPARK_TYPES.get(r["inferred_type"], T.StringType()), r["nullable"]) for r in profile.orderBy("name").collect()])


def latest(schemas: DataFrame, by: tuple[str, ...] = ("workspace_id", "name")) -> DataFrame:
    """The highest version of every name."""
    cols = [c for c in schemas.columns if c not in by]
    return schemas.groupBy(*by).agg(F.max_by(F.struct(*cols), F.struct("version", "id")).alias("w")).select(*by, "w.*")


def create(schemas: DataFrame, new: DataFrame) -> DataFrame:
    """Drafts for ``new`` (workspace_id, name, fields): each one version after the latest of its name; ids follow from content."""
    top = schemas.groupBy("workspace_id", "name").agg(F.max("version").alias("top"))
    n = new.join(top, ["workspace_id", "name"], "left").withColumn("version", F.coalesce(F.col("top"), F.lit(0)) + 1)
    return n.select(F.sha2(F.concat_ws("|", "workspace_id", "name", F.col("version").cast("string"), "fields"), 256).alias("id"), "workspace_id", "name", "version", F.lit("draft").alias("status"), "fields")


def delete(schemas: DataFrame, gone: DataFrame) -> DataFrame:
    """Schemas without those of the ids in ``gone`` (id)."""
    return schemas.join(gone.select("id").distinct(), "id", "left_anti").select(*schemas.columns)


def from_inferred(schemas: DataFrame, profile: DataFrame, workspace_id: str, name: str) -> DataFrame:
    """A draft after an inferred profile: its fields without default and description, as JSON by name; one row."""
    field = F.struct("name", F.col("inferred_type").alias("field_type"), "nullable", F.lit(None).cast("string").alias("default"), F.lit(None).cast("string").alias("description"))
    fields = F.to_json(F.array_sort(F.collect_list(field)), {"ignoreNullFields": "false"})
    return create(schemas, profile.agg(F.lit(workspace_id).alias("workspace_id"), F.lit(name).alias("name"), fields.alias("fields")))


def update_fields(schemas: DataFrame, changes: DataFrame) -> DataFrame:
    """Schemas after new fields for some ids (id, fields): the old row is deprecated and a new version follows it."""
    old = schemas.join(changes.select("id", F.col("fields").alias("_f")), "id", "left")
    kept = old.withColumn("status", F.when(F.col("_f").isNotNull(), "deprecated").otherwise(F.col("status"))).drop("_f")
    top = schemas.groupBy("workspace_id", "name").agg(F.max("version").alias("_top"))
    fresh = old.where("_f is not null").join(top, ["workspace_id", "name"])
    fresh = fresh.withColumns({"version": (F.col("_top") + 1).cast("int"), "status": F.lit("active"), "fields": F.col("_f"), "id": F.sha2(F.concat_ws("|", "id", F.col("_f")), 256)}).select(*schemas.columns)
    return kept.select(*schemas.columns).unionByName(fresh)


def validate(data: Column, fields: list[tuple[str, bool]]) -> Column:
    """Errors of a JSON record against (name, nullable) fields: required ones missing or null; extra fields are fine."""
    m = F.try_variant_get(F.try_parse_json(data), "$", "map<string,variant>")
    out = []
    for name, nullable in fields:
        if nullable:
            continue
        v = m[name]
        out.append(F.when(m.isNull() | ~F.map_contains_key(m, F.lit(name)), f"Missing required field: {name}").when(v.isNull() | (F.schema_of_variant(v) == "VOID"), f"Field '{name}' cannot be null"))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def coerce(value: Column, target: str) -> Column:
    """Text of a value coerced to a type; what can't be coerced stays as it was."""
    v = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    if target == "int":
        return F.coalesce(F.when(v.rlike(r"^[+-]?\d+$"), v.try_cast("bigint").cast("string")), value)
    if target == "float":
        return F.coalesce(F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v.try_cast("double").cast("string")), value)
    if target == "bool":
        return F.when(value.isNotNull(), F.lower(value).isin("true", "yes", "1").cast("string"))
    return value


def apply_rules(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Transformation rules in order: rename (to), cast (type), format (pattern), extract (pattern, group)."""
    for r in rules:
        c, kind = r["field"], r["rule"]
        if kind == "rename":
            df = df.withColumnRenamed(c, r["to"])
        elif kind == "cast":
            df = df.withColumn(c, F.col(c).try_cast(SPARK_TYPES.get(r["type"], T.StringType()).simpleString()))
        elif kind == "format":
            df = df.withColumn(r.get("to", c), F.date_format(c, r["pattern"]) if r.get("date") else F.format_string(r["pattern"], F.col(c)))
        elif kind == "extract":
            df = df.withColumn(r.get("to", c), F.nullif(F.regexp_extract(c, r["pattern"], r.get("group", 0)), F.lit("")))
        else:
            raise ValueError(f"unknown rule {kind!r}")
    return df
