"""Validation of mutation requests and records as columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.operators import cluster

#: The longest TTL in milliseconds: the largest signed 64-bit number of nanoseconds.
MAX_TTL_MS = 9223372036854
ALLOWED = ("value", "ttl_ms", "context")


def _object(body: str | None) -> str | None:
    """A body's object as JSON if it is one object of ALLOWED fields of the right types and nothing else, or else None.
    Null stands for an absent field; numbers are whole and of 64 bits, without fraction or exponent; counts aren't negative."""
    import json

    def refuse(_):
        raise ValueError("number")

    def whole(x):
        return isinstance(x, int) and not isinstance(x, bool)

    try:
        # Only JSON's white space may surround it, and json.loads takes nothing after it.
        r = json.loads(body.lstrip(" \t\r\n"), parse_float=refuse, parse_constant=refuse)
    except (ValueError, TypeError, AttributeError, RecursionError):
        return None
    if not isinstance(r, dict) or not set(r) <= set(ALLOWED):
        return None
    value, ttl, context = (r.get(k) for k in ALLOWED)
    if value is not None and not isinstance(value, str) or ttl is not None and not (whole(ttl) and -(1 << 63) <= ttl < 1 << 63):
        return None
    if context is not None and not (isinstance(context, dict) and all(n is None or whole(n) and 0 <= n < 1 << 64 for n in context.values())):
        return None
    # A flag for the value, which may be long, and counts as Spark's longs hold them.
    own = {"has_value": value is not None, "ttl_ms": ttl or 0, "context": {k: min(n or 0, 2) for k, n in (context or {}).items()}}
    return json.dumps(own)


def mutation_status(method: Column, body: Column) -> Column:
    """400 for a body that isn't one object of known fields of the right types, a PUT without value, a TTL out of range
    or a context with an empty id or a count other than 1; else 200."""
    # A body over the limit is not decoded.
    small = F.when(F.octet_length(body) <= 8 << 20, body)
    parsed = F.from_json(F.udf(_object, "string")(small), "has_value boolean, ttl_ms long, context map<string,long>")
    bad_context = F.exists(F.map_entries(parsed["context"]), lambda e: (e["key"] == "") | (e["value"] != 1))
    missing = (method == "PUT") & ~parsed["has_value"]
    good = parsed["has_value"].isNotNull() & ~missing & parsed["ttl_ms"].between(0, MAX_TTL_MS) & ~bad_context
    return F.when(F.coalesce(good, F.lit(False)), 200).otherwise(400)


def mutation(body: Column) -> Column:
    """The fields of a valid body: value, ttl_ms, context (sorted ids; null if absent or null, which {} is not)."""
    r = F.from_json(body, "value string, ttl_ms long, context map<string,long>")
    return F.struct(r["value"].alias("value"), r["ttl_ms"].alias("ttl_ms"), F.array_sort(F.map_keys(r["context"])).alias("context"))


def record_faults(records: DataFrame) -> DataFrame:
    """Records with what is wrong with them: an id that is empty or not in the clock, a tombstone with a value or an
    expiry, a clock with an empty id."""
    fault = cluster.record_fault(*[F.col(c) for c in ("id", "clock", "value", "deleted", "expires_us")])
    return records.withColumn("fault", fault).where("fault is not null")


def unversioned(entries: DataFrame) -> DataFrame:
    """Entries without siblings: a store that has any isn't one of a replica."""
    return entries.where(F.col("siblings").isNull() | (F.size("siblings") == 0))
