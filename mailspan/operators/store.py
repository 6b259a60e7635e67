"""Changes to the tables, as functions from tables to tables. (`mailspan.sources.buckets` makes them on stored tables.)

A second insert of a key replaces the row and, as it deletes it first, takes the replaced row's children with it;
an update does not. Clocks and ids are arguments, so that a rerun gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspan.functions.scalars import blank_to_null, stable_id
from mailspan.functions.text import blank, utrim
from mailspan.sources.schemas import CASCADES, KEYS, SCHEMAS


def latest(df: DataFrame, *keys: str, order: str) -> DataFrame:
    """The last row of each key by `order`, of equal ones an arbitrary but whole one."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def upsert(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """`table` with `rows` (unique by key) inserted, in the place of rows with their keys."""
    return table.join(rows.select(*keys), list(keys), "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def upsert_batch(table: DataFrame, rows: DataFrame, *keys: str, order: str) -> DataFrame:
    """The same with `rows` that may repeat a key: the last by `order` stays, as if they came one after another. `order` is a
    column of `rows` alone."""
    return upsert(table, latest(rows, *keys, order=order), *keys)


def replaced(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that an upsert replaces."""
    return table.join(rows.select(*keys), list(keys), "left_semi").select(*keys)


def insert_cascading(tables: dict[str, DataFrame], name: str, rows: DataFrame) -> dict[str, DataFrame]:
    """All tables after an insert of `rows` into `name`: rows of equal keys are deleted first, with what hangs on them."""
    keys = KEYS[name]
    out = dict(tables)
    if keys == ("id",) and name in CASCADES:
        out |= _without_children(tables, name, replaced(tables[name], rows, "id"))
    out[name] = upsert(tables[name], rows, *keys)
    return out


def update(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """`table` with whole rows updated by key; rows whose key is not there are ignored."""
    new = rows.select(F.col(key).alias("_key"), F.struct(*[F.col(c) for c in table.columns]).alias("_new"))
    w = table.join(new, table[key] == F.col("_key"), "left")
    return w.select(*[F.when(F.col("_key").isNotNull(), F.col("_new")[c]).otherwise(table[c]).alias(c) for c in table.columns])


def _where(table: DataFrame, key: str, changes: dict[str, Column], column: str = "id") -> DataFrame:
    hit = F.col(column) == key
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)).alias(c) for c, v in changes.items()})


def toggle_favourite(documents: DataFrame, key: str) -> DataFrame:
    return _where(documents, key, {"isFavorite": ~F.col("isFavorite")})


def set_status(documents: DataFrame, key: str, status: str, now: int) -> DataFrame:
    return _where(documents, key, {"status": F.lit(status), "modifiedAt": F.lit(now).cast("long")})


def confirm_field(fields: DataFrame, key: str) -> DataFrame:
    return _where(fields, key, {"isConfirmed": F.lit(True)})


def edit_field(fields: DataFrame, key: str, name: str, value: str) -> DataFrame:
    return _where(fields, key, {"fieldName": F.lit(name), "fieldValue": F.lit(value)})


def delete_field(fields: DataFrame, key: str) -> DataFrame:
    return fields.filter(F.col("id") != key)


def delete_fields_of(fields: DataFrame, documents: DataFrame) -> DataFrame:
    """Without all fields of these documents, confirmed and manual ones included."""
    return fields.join(documents.select("documentId"), "documentId", "left_anti").select(*fields.columns)


def delete_link(links: DataFrame, document: str, profile: str) -> DataFrame:
    return links.filter(~((F.col("documentId") == document) & (F.col("profileId") == profile)))


def add_field(fields: DataFrame, document: str, name: str, value: str, kind: str = "OTHER") -> DataFrame:
    """`fields` with a field from a form: certain and confirmed; nothing where name or value is blank."""
    n, v = name.strip(), value.strip()
    if not n or not v:
        return fields
    columns = {"id": stable_id(F.lit(document), F.lit(n), F.lit(v)), "documentId": F.lit(document), "fieldName": F.lit(n), "fieldValue": F.lit(v), "fieldType": F.lit(kind), "confidence": F.lit(1.0).cast("float"), "isConfirmed": F.lit(True)}
    row = fields.sparkSession.range(1).select(*[columns.get(c, F.lit(None).cast(fields.schema[c].dataType)).alias(c) for c in fields.columns])
    return upsert(fields, row, "id")


def form_profiles(forms: DataFrame) -> DataFrame:
    """Profiles from forms: blank optional values are null, a blank name is the organization's, the country Germany by default."""
    out = forms.withColumns({c: F.expr(blank_to_null(c)) for c in ("organization", "department", "street", "city", "postalCode", "phone", "email", "website", "reference", "notes") if c in forms.columns})
    name = F.when(F.expr(f"coalesce({blank('name')}, true)"), F.coalesce(F.col("organization"), F.lit(""))).otherwise(F.expr(utrim("name")))
    return out.withColumn("name", name).withColumn("country", F.coalesce(F.expr(blank_to_null("country")), F.lit("Germany")))


def _without_children(tables: dict[str, DataFrame], parent: str, gone: DataFrame) -> dict[str, DataFrame]:
    out: dict[str, DataFrame] = {}
    for child, column in CASCADES[parent]:
        if child in tables:
            rows = out.get(child, tables[child])
            out[child] = rows.join(gone.select(F.col("id").alias(column)), column, "left_anti").select(*rows.columns)
    return out


def delete_cascading(tables: dict[str, DataFrame], name: str, gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of `name` whose id is in `gone`, and without what hangs on them."""
    rows = tables[name]
    return dict(tables) | {name: rows.join(gone.select("id"), "id", "left_anti").select(*rows.columns)} | _without_children(tables, name, gone)


def append_events(events: DataFrame, new: DataFrame) -> DataFrame:
    """A log in which an event's id occurs once: the newer row stays."""
    own = W.partitionBy("id").orderBy(F.desc("_new"))
    both = events.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_r", F.row_number().over(own)).filter("_r = 1").select(*events.columns)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])
