"""Pseudonyms and redacted views of records for a public release."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import redact

#: Our salt. Whoever releases data sets their own.
SALT = "changeloom-release-v1"


def uuid5(value: Column, salt: str = SALT) -> Column:
    """Version 5 UUID of a text in the namespace that the salt names."""
    space = hashlib.sha256(salt.encode()).hexdigest()[:32]
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(value, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63)).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def digest(value: Column, prefix: str, salt: str = SALT) -> Column:
    """Short pseudonym: the prefix and 12 digits of a SHA-256."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat(F.lit(f"{salt}:{prefix}:"), value), 256), 1, 12))


def modification_id(value: Column, salt: str = SALT) -> Column:
    """Pseudonym of an id of three parts; any other is left as it is."""
    return F.when(F.size(F.split(value, "::")) == 3, uuid5(value, salt)).otherwise(value)


def redact_all(c: Column, kind: T.DataType) -> Column:
    """Redact every text within a value of any shape, the shape kept."""
    if isinstance(kind, T.StringType):
        return redact(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: redact_all(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: redact_all(v, kind.valueType))
    if isinstance(kind, T.StructType):
        made = F.struct(*[redact_all(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), made)
    return c


def _redacted(df: DataFrame) -> DataFrame:
    return df.select(*[redact_all(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def instance_view(df: DataFrame, salt: str = SALT) -> DataFrame:
    """Instances, redacted, with pseudonymous ids."""
    return _redacted(df).withColumn("modification_id", modification_id(F.col("modification_id"), salt))


def _digested(c: Column, prefix: str, salt: str) -> Column:
    """Pseudonym of a value that is there and not empty."""
    return F.when(c != "", digest(c, prefix, salt)).otherwise(c)


def diff_view(df: DataFrame, salt: str = SALT) -> DataFrame:
    """Diffs, redacted, with pseudonyms for the owner and for every commit's hash."""
    out = _redacted(df).withColumn("fork_owner", _digested(F.col("fork_owner"), "fork-owner", salt))
    for c in ("merge_base_sha", "head_sha"):
        if c in df.columns:
            out = out.withColumn(c, _digested(F.col(c), "sha", salt))
    if "commits" in df.columns:
        out = out.withColumn("commits", F.transform("commits", lambda x: x.withField("sha", _digested(x["sha"], "sha", salt))))
    return out


def _replace_first(c: Column, old: Column, new: Column) -> Column:
    at = F.instr(c, old)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), new, F.substring(c, at + F.length(old), F.length(c)))).otherwise(c)


def fork_view(df: DataFrame, salt: str = SALT) -> DataFrame:
    """Forks, redacted, with a pseudonym for the owner, in the full name and the clone URL too."""
    out = _redacted(df).withColumn("_new", _digested(F.col("owner"), "fork-owner", salt))
    out = out.withColumn("full_name", _replace_first(F.col("full_name"), F.col("owner"), F.col("_new")))
    out = out.withColumn("clone_url", _replace_first(F.col("clone_url"), F.concat(F.lit("/"), F.col("owner"), F.lit("/")), F.concat(F.lit("/"), F.col("_new"), F.lit("/"))))
    return out.withColumn("owner", F.col("_new")).drop("_new")


VIEWS = {"instances": instance_view, "diffs": diff_view, "forks": fork_view}


def release(df: DataFrame, kind: str, path: str, salt: str = SALT) -> int:
    """Write the public view of a kind as lines of JSON and return the number of rows."""
    from pyspark.sql import Observation

    seen = Observation()
    VIEWS[kind](df, salt).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").json(path)
    return seen.get["rows"]
