"""Declared schemas: loading, inheritance, merging, policies, editing and generation.

The catalogue is small; it lives on the driver, and declared() gives it as a table for joins.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types that a field can be declared with (fixed values).
FIELD_TYPES = ("string", "number", "date", "boolean", "enum", "reference", "list<string>", "list<reference>")


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    type: str
    required: bool = False
    default: Any = None
    values: tuple[str, ...] = ()
    target: str | None = None
    canonical: str | None = None


@dataclass
class Schema:
    name: str
    fields: dict[str, Field] = field(default_factory=dict)
    extends: str | None = None
    display_name: str | None = None
    icon: str | None = None
    template: str | None = None
    order: list[str] = field(default_factory=list)
    computed: dict[str, Any] = field(default_factory=dict)
    ancestors: list[str] = field(default_factory=list)


@dataclass
class Merged:
    fields: dict[str, Field]
    #: (field, ((schema, type), ...)); an unknown type has an empty field name
    conflicts: list[tuple[str, tuple[tuple[str, str], ...]]]


def _field(raw: dict) -> Field:
    kind = raw.get("type", "string")
    if kind not in FIELD_TYPES:
        raise SchemaError(f"unknown field type {kind}")
    return Field(kind, bool(raw.get("required", False)), raw.get("default"), tuple(map(str, raw.get("values") or ())), raw.get("target_schema"), raw.get("canonical_name"))


def load_yaml(path: Path) -> Any:
    try:
        import yaml
    except ImportError as e:  # schemas as JSON need no further package
        if path.suffix == ".json":
            return json.loads(path.read_text())
        raise SchemaError("YAML files need the package yaml; schemas may also be JSON") from e
    return yaml.safe_load(path.read_text())


def load(folder: str) -> dict[str, Schema]:
    """The schemas of .yaml, .yml and .json files of a folder, but those that begin with `_`, with
    the fields they inherit. A schema without a name, a name that stands twice, an unknown parent
    and a circle of parents are errors."""
    files = sorted(p for p in Path(folder).glob("*") if p.suffix in (".yaml", ".yml", ".json") and not p.name.startswith("_")) if Path(folder).is_dir() else []
    return from_definitions([load_yaml(p) or {} for p in files])


def from_definitions(raws: list[dict]) -> dict[str, Schema]:
    own: dict[str, Schema] = {}
    for raw in raws:
        name = raw.get("name")
        if not name:
            raise SchemaError("a schema has no name")
        if name in own:
            raise SchemaError(f"two schemas are called {name}")
        ser = raw.get("serialization") or {}
        own[name] = Schema(name, {k: _field(v or {}) for k, v in (raw.get("fields") or {}).items()}, raw.get("extends"), raw.get("display_name"), raw.get("icon"), ser.get("filename_template"), list(ser.get("frontmatter_fields") or ()), raw.get("computed") or {})
    done: dict[str, Schema] = {}

    def resolve(name: str, path: tuple[str, ...]) -> Schema:
        if name in path:
            raise SchemaError(" -> ".join([*path, name]) + " is a circle")
        if name not in done:
            s = own[name]
            if s.extends:
                if s.extends not in own:
                    raise SchemaError(f"{name} extends {s.extends}, which is unknown")
                parent = resolve(s.extends, (*path, name))
                s = replace(s, fields=parent.fields | s.fields, ancestors=[*parent.ancestors, s.extends])
            done[name] = s
        return done[name]

    for name in own:
        resolve(name, ())
    return dict(sorted(done.items()))


def load_globals(folder: str) -> dict[str, Field]:
    """Fields of `_global.yaml`, which hold for notes of any type."""
    for suffix in (".yaml", ".yml", ".json"):
        p = Path(folder) / f"_global{suffix}"
        if p.exists():
            return {k: _field(v or {}) for k, v in ((load_yaml(p) or {}).get("fields") or {}).items()}
    return {}


def merge(schemas: dict[str, Schema], types: list[str]) -> Merged:
    """The fields of a note of several types, taken in alphabetical order: of one type, enum values
    are united, required by one is required, the first default holds; with different types or
    targets the field goes and a conflict is noted (a later type can bring it back)."""
    out: dict[str, Field] = {}
    origin: dict[str, str] = {}
    conflicts = []
    for t in sorted(types):
        if t not in schemas:
            conflicts.append(("", ((t, ""),)))
            continue
        for key, f in schemas[t].fields.items():
            had = out.get(key)
            if had is None:
                out[key], origin[key] = f, t
            elif had.type != f.type or (had.target or None) != (f.target or None):
                conflicts.append((key, ((origin[key], had.type), (t, f.type))))
                del out[key]
            else:
                values = tuple(dict.fromkeys([*had.values, *f.values]))
                out[key] = replace(had, values=values, required=had.required or f.required, default=had.default if had.default is not None else f.default)
    return Merged(out, conflicts)


def field_order(schemas: dict[str, Schema], types: list[str]) -> list[str]:
    return list(dict.fromkeys(k for t in sorted(types) if t in schemas for k in schemas[t].order))


def declared(spark: SparkSession, schemas: dict[str, Schema]) -> DataFrame:
    """(schema_type, key, field_type, required, values) of all schemas."""
    rows = [(s.name, k, f.type, f.required, list(f.values)) for s in schemas.values() for k, f in s.fields.items()]
    return spark.createDataFrame(rows, "schema_type string, key string, field_type string, required boolean, values array<string>")


def declarations(spark: SparkSession, schemas: dict[str, Schema]) -> DataFrame:
    """(schema_type, key, field_type, target, required, values): declared() with the targets of references."""
    rows = [(s.name, k, f.type, f.target, f.required, list(f.values)) for s in schemas.values() for k, f in s.fields.items()]
    return spark.createDataFrame(rows, "schema_type string, key string, field_type string, target string, required boolean, values array<string>")


def merged_sets(sets: DataFrame, declared_: DataFrame) -> DataFrame:
    """(types, key, field_type, required, values, conflict): merge() of each set of types (types, an
    array in order) as one plan, from declarations(). field_type is null where the field went in a conflict."""
    each = sets.select("types", F.posexplode("types").alias("pos", "schema_type")).join(declared_, "schema_type")
    one = F.struct("pos", "field_type", F.coalesce("target", F.lit("")).alias("target"), "required", "values")
    fields = each.groupBy("types", "key").agg(F.array_sort(F.collect_list(one)).alias("d"))
    fold = """aggregate(d, named_struct('t', cast(null as string), 'g', '', 'r', false, 'v', cast(array() as array<string>), 'c', false), (a, x) ->
        if(a.t is null, named_struct('t', x.field_type, 'g', x.target, 'r', x.required, 'v', x.values, 'c', a.c),
        if(a.t <> x.field_type or a.g <> x.target, named_struct('t', cast(null as string), 'g', '', 'r', false, 'v', cast(array() as array<string>), 'c', true),
        named_struct('t', a.t, 'g', a.g, 'r', a.r or x.required, 'v', array_distinct(concat(a.v, x.values)), 'c', a.c))))"""
    return fields.withColumn("m", F.expr(fold)).select("types", "key", F.col("m.t").alias("field_type"), F.col("m.r").alias("required"), F.col("m.v").alias("values"), F.col("m.c").alias("conflict"))


def listing(spark: SparkSession, schemas: dict[str, Schema]) -> DataFrame:
    """(name, display_name, extends, ancestors, field_count) ordered by name."""
    rows = [(s.name, s.display_name, s.extends, ",".join(s.ancestors), len(s.fields)) for _, s in sorted(schemas.items())]
    return spark.createDataFrame(rows, "name string, display_name string, extends string, ancestors string, field_count int")


def describe(spark: SparkSession, schemas: dict[str, Schema], name: str) -> DataFrame:
    if name not in schemas:
        raise SchemaError(f"no schema {name}")
    return declared(spark, {name: schemas[name]})


# ---- policies -------------------------------------------------------------------------------

#: Policies from the mildest to the strictest, and the default of each (fixed values).
POLICIES = {"normalize_on_index": ("off", "warn", "fix"), "unknown_fields": ("warn", "strip", "reject"), "enum_validation": ("coerce", "warn", "reject")}
DEFAULTS = {"normalize_on_index": "warn", "unknown_fields": "warn", "enum_validation": "coerce"}


def load_policies(path: str) -> dict[str, tuple[str, dict[str, str]]]:
    """(default, by type) of each policy; a file that can't be read and values that aren't known
    leave the defaults."""
    try:
        raw = load_yaml(Path(path))
    except Exception:
        raw = None
    return read_policies(raw)


def read_policies(raw: Any) -> dict[str, tuple[str, dict[str, str]]]:
    raw = raw if isinstance(raw, dict) else {}
    inner = raw.get("enforcement", raw)
    inner = inner if isinstance(inner, dict) else {}
    out = {}
    for name, known in POLICIES.items():
        section = inner.get(name)
        section = section if isinstance(section, dict) else {}
        default = section.get("default") if section.get("default") in known else DEFAULTS[name]
        per = section.get("per_type")
        out[name] = (default, {t: v for t, v in (per if isinstance(per, dict) else {}).items() if v in known})
    return out


def policy_of(policies: dict[str, tuple[str, dict[str, str]]], name: str, types: list[str]) -> str:
    """The strictest of what holds for the types of a note."""
    default, per = policies[name]
    known = POLICIES[name]
    return max((per.get(t, default) for t in types), key=known.index, default=default)


def load_embedding_config(path: str) -> dict[str, Any] | None:
    """The section `embeddings` of a JSON file, or None."""
    p = Path(path)
    return json.loads(p.read_text()).get("embeddings") if p.exists() else None


# ---- editing and generation -----------------------------------------------------------------

METADATA = ("display_name", "icon", "extends", "computed")


def update(definition: dict, operations: list[dict]) -> dict:
    """A definition after add_field, remove_field, rename_field, update_field and set_metadata, in
    order. Names, types and the values of enums are checked; the input is not changed."""
    out = json.loads(json.dumps(definition))
    fields = out.setdefault("fields", {})

    def checked(f: dict) -> dict:
        _field(f)
        if f.get("type") == "enum" and not f.get("values"):
            raise SchemaError("an enum needs values")
        return f

    for op in operations:
        action, key = op["action"], op.get("field")
        if action == "add_field":
            if key in fields:
                raise SchemaError(f"field {key} exists")
            fields[key] = checked(op["definition"])
        elif action in ("remove_field", "update_field", "rename_field") and key not in fields:
            raise SchemaError(f"no field {key}")
        elif action == "remove_field":
            del fields[key]
        elif action == "update_field":
            fields[key] = checked(fields[key] | op["definition"])
        elif action == "rename_field":
            if op["to"] in fields:
                raise SchemaError(f"field {op['to']} exists")
            out["fields"] = fields = {op["to"] if k == key else k: v for k, v in fields.items()}
        elif action == "set_metadata":
            if op["key"] not in METADATA:
                raise SchemaError(f"{op['key']} can't be set")
            out[op["key"]] = op["value"]
        else:
            raise SchemaError(f"unknown action {action}")
    return out


def update_file(folder: str, name: str, operations: list[dict]) -> dict[str, Schema]:
    """Edit the file of a schema and load the folder again; if that fails, the file is as it was."""
    for p in sorted(Path(folder).glob("*")):
        if p.suffix in (".yaml", ".yml", ".json") and not p.name.startswith("_") and (raw := load_yaml(p) or {}).get("name") == name:
            before = p.read_text()
            try:
                new = update(raw, operations)
                p.write_text(json.dumps(new, indent=2) + "\n")  # JSON is YAML, too
                return load(folder)
            except Exception:
                p.write_text(before)
                raise
    raise SchemaError(f"no file of schema {name}")


def generate(inferred: list[tuple[str, str, str, float, list[str]]], templates: dict[str, str | None], mode: str = "merge", existing: dict[str, Schema] | None = None) -> dict[str, dict]:
    """Definitions from (type, key, field type, frequency, enum values). With mode merge, fields of
    existing schemas stay as they are, but enum values are united; overwrite replaces them; report
    gives the same as merge, to be looked at."""
    if mode not in ("report", "merge", "overwrite"):
        raise SchemaError(f"unknown mode {mode}")
    out: dict[str, dict] = {}
    for t, key, kind, frequency, values in sorted(inferred, key=lambda r: (r[0], r[1])):
        d = out.setdefault(t, {"name": t, "display_name": " ".join(w[:1].upper() + w[1:] for w in t.split("-")), "fields": {}})
        f: dict[str, Any] = {"type": kind}
        if frequency >= 1:
            f["required"] = True
        if kind == "enum":
            f["values"] = sorted(values)
        d["fields"][key] = f
    for t, d in out.items():
        if templates.get(t):
            d["serialization"] = {"filename_template": templates[t]}
        if mode != "overwrite" and existing and t in existing:
            old = existing[t]
            for key, f in old.fields.items():
                keep = {k: v for k, v in (("type", f.type), ("required", f.required), ("default", f.default), ("target_schema", f.target)) if v}
                if f.values or f.type == "enum":
                    keep["values"] = list(dict.fromkeys([*f.values, *d["fields"].get(key, {}).get("values", [])]))
                d["fields"][key] = keep
            d |= {k: v for k, v in (("extends", old.extends), ("icon", old.icon), ("computed", old.computed)) if v}
            d["display_name"] = old.display_name or d["display_name"]
            if old.template:
                d["serialization"] = {"filename_template": old.template}
    return out


def write(folder: str, definitions: dict[str, dict]) -> list[str]:
    """A file for each definition; the names of the files."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    names = []
    for name, d in sorted(definitions.items()):
        try:
            import yaml

            text, suffix = yaml.safe_dump(d, sort_keys=False, allow_unicode=True), ".yaml"
        except ImportError:
            text, suffix = json.dumps(d, indent=2) + "\n", ".json"
        (Path(folder) / f"{name}{suffix}").write_text(text)
        names.append(f"{name}{suffix}")
    return names


def as_json(s: Schema) -> str:
    return json.dumps(asdict(s), sort_keys=True)
