"""The layered catalog: domains, concepts and fixed vocabularies, merged by key; and the regulator registry."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausemill import schemas

# Vocabularies that no layer overrides, and what stands in where no value fits.
OBLIGATIONS = [
    "Record Retention", "Reporting", "Disclosure", "Prohibition", "Permission / Authorization", "Notification", "Registration",
    "Compliance Monitoring", "Customer Protection / Redressal", "Penalty / Enforcement", "Other",
]
ACTIONS = [
    "RETAIN", "REPORT", "DISCLOSE", "MAINTAIN", "VERIFY", "SUBMIT", "NOTIFY", "PROHIBIT", "PERMIT", "RESTRICT", "MONITOR",
    "REGISTER", "REVIEW", "ESTABLISH", "IMPLEMENT", "OTHER",
]
MODALITIES = ["Mandatory", "Discretionary", "Conditional", "Not Applicable"]
ESCAPE = {"domain": "Other", "action": "OTHER", "obligation_type": "Other", "mandatory_flag": "Not Applicable"}


def merge_by_key(base: DataFrame, extra: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of both layers: an extra row replaces the base row of its key and keeps that row's position; new keys follow.

    Within a layer the last row of a key counts, at the first one's position.
    """
    both = base.withColumn("__layer", F.lit(0)).unionByName(extra.withColumn("__layer", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.desc("__layer"), F.desc(position))
    first = Window.partitionBy(key).orderBy("__layer", position)
    x = both.withColumns({"__pick": F.row_number().over(last), "__at": F.first(F.struct("__layer", F.col(position).alias("p"))).over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return x.filter("__pick = 1").select(*base.columns, F.col("__at").alias("merged_position"))


def registry_pack(docs: DataFrame, registry: DataFrame, default: str | None = None, column: str = "regulator") -> DataFrame:
    """Adds pack: the code for exactly this regulator (ends trimmed), else the default."""
    codes = registry.select(F.col("regulator").alias("__regulator"), F.col("code").alias("__code"))
    x = docs.join(codes, F.trim(F.col(column)) == F.col("__regulator"), "left")
    return x.withColumn("pack", F.coalesce("__code", F.lit(default).cast("string"))).drop("__regulator", "__code")


def config_root(explicit: str | None, working: str, packaged: str, variable: str = "CLAUSEMILL_CONFIG") -> Path:
    """First of: the argument, the environment, <working>/config if it exists, the packaged folder."""
    for found in (explicit, os.environ.get(variable)):
        if found:
            return Path(found)
    own = Path(working) / "config"
    return own if own.is_dir() else Path(packaged)


def read_yaml(spark: SparkSession, path: str, key: str, schema: str, position: str | None = None) -> DataFrame:
    """The list under `key` of a small YAML file, read on the driver; position numbers the rows."""
    import yaml

    rows = yaml.safe_load(Path(path).read_text(encoding="utf-8")).get(key) or []
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return spark.createDataFrame([tuple(k if n == position else x.get(n) for n in names) for k, x in enumerate(rows)], schema)


def load_catalog(spark: SparkSession, root: str, pack: str | None = None) -> dict[str, DataFrame]:
    """domains and concepts of the global layer and one pack, merged.  A pack that is named but missing is an error."""
    base = Path(root) / "ontology"
    layers = [base / "global"] + ([base / "jurisdictions" / pack] if pack else [])
    if not layers[-1].is_dir():
        raise FileNotFoundError(f"no such layer: {layers[-1]}")
    out = {}
    for name, key, schema in (("domains", "token", f"position int, {schemas.DOMAINS}"), ("concepts", "canonical_id", schemas.CONCEPTS)):
        position = "position" if name == "domains" else "cat_ord"
        found = [read_yaml(spark, str(x / f"{name}.yaml"), name, schema, position) for x in layers if (x / f"{name}.yaml").exists()]
        merged = merge_by_key(found[0], found[1] if len(found) > 1 else found[0].limit(0), key, position)
        order = F.row_number().over(Window.orderBy("merged_position")) - 1  # a catalog is one small table
        out[name] = merged.withColumn(position, order).drop("merged_position")
    return out


def schema_rules(schema: dict, columns: list[str] | None = None, at: str = "") -> dict[str, Column]:
    """Rules for violations() from a JSON schema of an object, or of an array of objects: name -> condition on columns.

    Read are required, properties, nested objects, additionalProperties (against `columns`), and of a property type, enum, const,
    minimum, maximum, minLength, maxLength, pattern and the enum of an array's items.  Null passes where the type has null
    or the property is not required.
    """
    if schema.get("type") == "array":
        return schema_rules(schema["items"], columns, at)
    rules: dict[str, Column] = {}
    for name, spec in schema.get("properties", {}).items():
        c, types = F.col(f"{at}{name}"), spec.get("type", [])
        types = [types] if isinstance(types, str) else types
        if name in schema.get("required", []) and "null" not in types:
            rules[f"{at}{name}: required"] = c.isNotNull()
        if "object" in types:
            rules |= schema_rules(spec, None, f"{at}{name}.")
            continue
        number = c.try_cast("double")
        checks = {
            "enum": lambda v, c=c: c.isin([x for x in v if x is not None]),
            "const": lambda v, c=c: c == F.lit(v),
            "minimum": lambda v, n=number: n >= v,
            "maximum": lambda v, n=number: n <= v,
            "minLength": lambda v, c=c: F.length(c) >= v,
            "maxLength": lambda v, c=c: F.length(c) <= v,
            "pattern": lambda v, c=c: c.rlike(v),
            "items": lambda v, c=c: F.forall(c, lambda x: x.isin(v["enum"])) if "enum" in v else F.lit(True),
        }
        if {"integer", "number"} & {*types}:
            whole = number.isNotNull() & (number == F.floor(number)) if "number" not in types else number.isNotNull()
            rules[f"{at}{name}: type"] = c.isNull() | whole
        rules |= {f"{at}{name}: {k}": c.isNull() | F.coalesce(check(spec[k]), F.lit(False)) for k, check in checks.items() if k in spec}
    if columns is not None and schema.get("additionalProperties") is False:
        rules |= {f"{name}: not in the schema": F.lit(False) for name in columns if name not in schema.get("properties", {})}
    return rules


def violations(rows: DataFrame, rules: dict[str, object], keep: int = 5) -> DataFrame:
    """Adds violations (the first `keep` names of rules that do not hold) and n_violations.  rules: name -> condition."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(condition, F.lit(False)), F.lit(name)) for name, condition in rules.items())))
    return rows.withColumn("__failed", failed).withColumns({"violations": F.slice("__failed", 1, keep), "n_violations": F.size("__failed")}).drop("__failed")
