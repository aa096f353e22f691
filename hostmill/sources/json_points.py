"""JSON payloads: an object or array of {key, data} items.

One bad item rejects its whole payload. A payload is parsed once, into variants; the types and
the numbers of its values are read from them. Names that repeat keep their last value, inside
value objects too, whose fields are found whatever their case (of names that differ in case
alone, the one in lower case counts).

Variants refuse repeated names unless spark.sql.variant.allowDuplicateKeys is set: these
functions set it in their session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_percent_name, kind_is_percent, strip

MAX_BYTES = 16 * 1024 * 1024

_ITEM = "struct<key:variant,data:map<string,variant>>"
_OPTIONS = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_NUMBER = "^(?:TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def with_items(df: DataFrame, payload: str) -> DataFrame:
    """Adds ``items`` (key and data of each), null where the payload is no object or array of
    objects or is too large.

    The text is parsed inside brackets of our own, so that anything after it shows as an error
    or as a second element.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = strip(F.coalesce(payload, F.lit("")))
    fits = F.octet_length(F.coalesce(payload, F.lit(""))) <= MAX_BYTES
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    one = F.when(fits & text.startswith("{"), F.from_json(wrapped, f"array<{_ITEM}>", _OPTIONS))
    many = F.when(fits & text.startswith("["), F.from_json(wrapped, f"array<array<{_ITEM}>>", _OPTIONS))
    d = df.withColumns({"one": one, "many": many})
    items = F.when(F.size("one") == 1, F.col("one")).when(F.size("many") == 1, F.col("many")[0])
    return d.withColumn("items", items).drop("one", "many")


def _type(value: Column) -> Column:
    return F.schema_of_variant(value)


def _within(parts: Column, name: str) -> Column:
    """A field of an object's sorted entries, whatever its case; upper case comes first."""
    own = F.filter(parts, lambda e: F.lower(e["key"]) == name)
    return F.try_element_at(F.transform(own, lambda e: e["value"]), F.lit(-1))


def _last_of_each(entries: Column, name: str) -> Column:
    """The entries without those whose name comes again later."""
    names = F.transform(entries, lambda e: e[name])
    backwards = F.reverse(names)
    last = F.filter(entries, lambda e, k: F.array_position(backwards, e[name]) == F.size(names) - k)
    return F.when(F.size(F.array_distinct(names)) < F.size(names), last).otherwise(entries)


def _cells(data: Column) -> Column:
    """(var, raw, is_percent) of each value; raw or is_percent is null where the contract is broken.

    Three passes, so that each value's type and parts are read once.
    """
    typed = F.transform(_last_of_each(F.map_entries(data), "key"), lambda e: F.struct(strip(e["key"]).alias("var"), e["value"].alias("v"), _type(e["value"]).alias("t")))

    def opened(c: Column) -> Column:
        has_parts = c["t"].startswith("OBJECT")
        parts = F.when(has_parts, F.map_entries(F.try_variant_get(c["v"], "$", "map<string,variant>")))
        number = F.when(has_parts, F.coalesce(_within(parts, "value"), _within(parts, "last"))).otherwise(c["v"])
        return F.struct(c["var"].alias("var"), c["t"].alias("t"), number.alias("n"), _within(parts, "kind").alias("kind"))

    def read(c: Column) -> Column:
        is_flag = c["t"] == "BOOLEAN"
        flag = F.try_variant_get(c["n"], "$", "boolean").cast("double")
        number = F.when(_type(c["n"]).rlike(_NUMBER), F.try_variant_get(c["n"], "$", "double"))
        named = F.when(_type(c["kind"]) == "STRING", kind_is_percent(F.try_variant_get(c["kind"], "$", "string")))
        percent = F.when(is_flag, False).when(c["kind"].isNull(), is_percent_name(c["var"])).otherwise(named)
        return F.struct(c["var"].alias("var"), F.when(is_flag, flag).otherwise(number).alias("raw"), percent.alias("is_percent"))

    return F.transform(F.transform(typed, opened), read)


def _parsed(df: DataFrame, payload: str) -> DataFrame:
    """Adds ``point_sets`` (per item: key and cells) and ``good``."""
    d = with_items(df, payload)
    keyed = F.transform("items", lambda m: F.struct(_type(m["key"]).alias("t"), F.try_variant_get(m["key"], "$", "string").alias("key"), _cells(m["data"]).alias("cells")))
    # A row of one element, made by a generator: no filter moves below it, so nothing is parsed again.
    d = d.select(*df.columns, F.explode_outer(F.array(keyed)).alias("point_sets"))

    def holds(c: Column) -> Column:
        return (c["var"] != "") & (F.abs(c["raw"]) < float("inf")) & c["is_percent"].isNotNull()

    def whole(p: Column) -> Column:
        return F.coalesce((p["t"] == "STRING") & (strip(p["key"]) != "") & (F.size(p["cells"]) > 0) & F.forall(p["cells"], lambda c: F.coalesce(holds(c), F.lit(False))), F.lit(False))

    return d.withColumn("good", F.coalesce(F.forall("point_sets", whole), F.lit(False)))


def points_from_json(df: DataFrame, payload: str) -> DataFrame:
    """The other columns with key, var, raw and is_percent, for every good payload."""
    rest = [c for c in df.columns if c != payload]
    d = _parsed(df, payload).filter("good").select(*rest, F.explode("point_sets").alias("p"))
    d = d.select(*rest, strip(F.col("p.key")).alias("key"), F.explode(_last_of_each(F.col("p.cells"), "var")).alias("c"))
    return d.select(*rest, "key", "c.var", "c.raw", "c.is_percent")


def json_rejects(df: DataFrame, payload: str) -> DataFrame:
    """The rows whose payload is rejected."""
    return _parsed(df, payload).filter("NOT good").select(*df.columns)
