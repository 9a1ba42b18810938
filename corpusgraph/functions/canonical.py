"""JSON whose text doesn't depend on the order of keys, and strict key sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """The same value with keys in order at every depth and no blanks; null for text that is no JSON."""
    return F.to_json(F.try_parse_json(text))


def json_hash(*parts: Column) -> Column:
    """A digest of several JSON values, as an array of their canonical forms."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(canonical_json(p), F.lit("null")) for p in parts]), F.lit("]")), 256))


def key_problem(text: Column, keys: list[str]) -> Column:
    """What is wrong with an object that must have just these keys: `no object`, `missing: a,b`, `unknown: c`, or null."""
    have = F.json_object_keys(text)
    want = F.array(*[F.lit(k) for k in sorted(keys)]).cast("array<string>")
    missing, unknown = F.array_sort(F.array_except(want, have)), F.array_sort(F.array_except(have, want))
    problem = F.when(F.try_parse_json(text).isNull() | have.isNull(), "no object").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ",")))
    return problem.when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(unknown, ",")))


def field(text: Column, path: str, kind: str) -> Column:
    """A field of a JSON text at a path such as `$.a[0].b`; null if it is absent or of another type."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)
