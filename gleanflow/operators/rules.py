"""Data-quality rules over JSON columns: the capture contract and declared option rules.

A rule set is walked once on the driver and becomes one Column expression per row, so checking
is a projection without shuffle. Undefined (missing) and null are different: a missing key is
a SQL null, a JSON null is a variant null.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanflow.contract import CAPTURE_RULES, CAPTURE_VERSION, DEFAULT_TIMEOUT_MS, FILE_LEVELS, PRIVACY_LEVELS, PUSH_LEVELS, TARGET_KINDS
from gleanflow.functions.text import blank_to_null, trim_blanks, utf16_length
from gleanflow.functions.urls import is_absolute_uri, is_web_url
from gleanflow.operators.layout import computed

_ERRORS = "array<string>"
# Variant type names and the JSON type they stand for.
_JSON_TYPES = {
    "OBJECT": "object",
    "ARRAY": "array",
    "STRING": "string",
    "BOOLEAN": "boolean",
    "VOID": "null",
    "BIGINT": "number",
    "DECIMAL": "number",
    "DOUBLE": "number",
    "FLOAT": "number",
    "INT": "number",
    "SMALLINT": "number",
    "TINYINT": "number",
}


# --- variant helpers ---------------------------------------------------------------


def json_class(value: Column) -> Column:
    """``object, array, string, number, boolean, null`` of a variant; null when missing."""
    names = F.create_map(*[F.lit(text) for pair in _JSON_TYPES.items() for text in pair])
    name = F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)
    return F.try_element_at(names, name)


def member(value: Column, key: str) -> Column:
    """Member of an object variant: SQL null when missing or when the value is no object."""
    escaped = key.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(value, f"$['{escaped}']", "variant")


def as_text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def as_number(value: Column) -> Column:
    return F.when(json_class(value) == "number", F.try_variant_get(value, "$", "double"))


def as_boolean(value: Column) -> Column:
    return F.when(json_class(value) == "boolean", F.try_variant_get(value, "$", "boolean"))


def object_keys(value: Column) -> Column:
    return F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast(_ERRORS))


def elements(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def is_truthy(value: Column) -> Column:
    kind = json_class(value)
    return F.coalesce(
        F.when(kind.isin("object", "array"), True)
        .when(kind == "string", as_text(value) != "")
        .when(kind == "number", as_number(value) != 0)
        .when(kind == "boolean", as_boolean(value)),
        F.lit(False),
    )


# --- option rules ----------------------------------------------------------------------


def suggestion(key: Column, known: list[str]) -> Column:
    """Closest declared name as a hint; the first declared one wins ties."""
    if not known:
        return F.lit("")
    ranked = F.array(
        *[
            F.struct(
                F.levenshtein(key, F.lit(name)).alias("distance"),
                F.lit(position).alias("position"),
                F.lit(name).alias("name"),
            )
            for position, name in enumerate(known)
        ]
    )
    best = F.array_min(ranked)
    limit = F.greatest(F.lit(2), F.floor(utf16_length(key) / 3))
    return F.when(
        best["distance"] <= limit, F.concat(F.lit(' (did you mean "'), best["name"], F.lit('"?)'))
    ).otherwise("")


def _equals(value: Column, allowed: object) -> Column:
    if isinstance(allowed, bool) or allowed is None or isinstance(allowed, str):
        return F.to_json(value) == json.dumps(allowed, ensure_ascii=False)
    if isinstance(allowed, (int, float)):
        return F.coalesce(as_number(value) == float(allowed), F.lit(False))
    return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(allowed))))


def _is_type(value: Column, name: str) -> Column:
    if name in ("object", "array", "string", "number", "boolean", "null"):
        return json_class(value) == name
    if name == "integer":
        return F.coalesce(as_number(value) == F.floor(as_number(value)), F.lit(False))
    return F.lit(True)  # unknown type names accept everything


def _no_errors() -> Column:
    return F.array().cast(_ERRORS)


def _one(condition: Column, message: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(message)).otherwise(_no_errors())


def _flat(parts: list[Column]) -> Column:
    if not parts:
        return _no_errors()
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def option_errors(value: Column, schema: object, path: str = "", label: Column | None = None) -> Column:
    """All violations of ``schema`` by a variant, as an array of messages.

    Keywords: ``type``, ``required``, ``properties``, ``additionalProperties: false``, ``items``,
    ``enum``, ``format: uri``, ``minLength``, ``minItems``; others are ignored.
    """
    if not isinstance(schema, dict):
        return _no_errors()
    name = label if label is not None else F.lit(path or "config")
    inner = label if label is not None else (F.lit(path) if path else None)

    def child(key: str) -> Column:
        return F.concat(inner, F.lit(f".{key}")) if inner is not None else F.lit(key)

    checks: list[Column] = []

    # objects
    properties = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
    object_checks: list[Column] = []
    for key in schema.get("required") or []:
        if isinstance(key, str):
            object_checks.append(
                _one(
                    member(value, key).isNull(),
                    F.concat(F.lit("config."), child(key), F.lit(" is required")),
                )
            )
    if schema.get("additionalProperties") is False:
        known = list(properties)
        prefix = F.concat(F.lit("config."), inner, F.lit(".")) if inner is not None else F.lit("config.")
        object_checks.append(
            F.transform(
                F.array_except(object_keys(value), F.array(*[F.lit(k) for k in known]).cast(_ERRORS)),
                lambda key: F.concat(prefix, key, F.lit(" is not a recognized option"), suggestion(key, known)),
            )
        )
    for key, rule in properties.items():
        nested = option_errors(
            member(value, key), rule, f"{path}.{key}" if path else key, child(key) if label is not None else None
        )
        object_checks.append(F.when(member(value, key).isNotNull(), nested).otherwise(_no_errors()))
    if object_checks:
        checks.append(F.when(json_class(value) == "object", _flat(object_checks)).otherwise(_no_errors()))

    # arrays
    array_checks: list[Column] = []
    minimum = schema.get("minItems")
    if isinstance(minimum, (int, float)) and not isinstance(minimum, bool):
        array_checks.append(
            _one(
                F.size(elements(value)) < minimum,
                F.concat(name, F.lit(f" must contain at least {minimum} item(s)")),
            )
        )
    if isinstance(schema.get("items"), dict):
        array_checks.append(
            F.flatten(
                F.transform(
                    elements(value),
                    lambda item, i: option_errors(
                        item,
                        schema["items"],
                        label=F.concat(name, F.lit("["), i.cast("string"), F.lit("]")),
                    ),
                )
            )
        )
    if array_checks:
        checks.append(F.when(json_class(value) == "array", _flat(array_checks)).otherwise(_no_errors()))

    # strings
    string_checks: list[Column] = []
    shortest = schema.get("minLength")
    if isinstance(shortest, (int, float)) and not isinstance(shortest, bool):
        string_checks.append(
            _one(
                utf16_length(as_text(value)) < shortest,
                F.concat(name, F.lit(f" must be at least {shortest} character(s)")),
            )
        )
    if schema.get("format") == "uri":
        string_checks.append(
            _one(~is_absolute_uri(as_text(value)), F.concat(name, F.lit(" must be a valid absolute URI")))
        )
    if string_checks:
        checks.append(F.when(json_class(value) == "string", _flat(string_checks)).otherwise(_no_errors()))

    result = _flat(checks)

    declared = schema.get("type")
    types = [declared] if isinstance(declared, str) else [t for t in declared or [] if isinstance(t, str)]
    if types:
        fits = _is_type(value, types[0])
        for other in types[1:]:
            fits = fits | _is_type(value, other)
        wrong = F.concat(
            name,
            F.lit(f" must be {' or '.join(types)}, received "),
            F.coalesce(json_class(value), F.lit("nothing")),
        )
        result = F.when(F.coalesce(fits, F.lit(False)), result).otherwise(F.array(wrong))

    allowed = schema.get("enum")
    if isinstance(allowed, list):
        hit = F.lit(False)
        for candidate in allowed:
            hit = hit | _equals(value, candidate)
        listed = ", ".join(json.dumps(item, ensure_ascii=False, separators=(",", ":")) for item in allowed)
        result = F.when(F.coalesce(hit, F.lit(False)), result).otherwise(
            F.array(F.concat(name, F.lit(f" must be one of {listed}")))
        )
    return result


def config_errors(configs: DataFrame, schema: dict, key: str, config: str = "config") -> DataFrame:
    """Rows ``(key, error)``: one per violation of the declared rules by a JSON text column."""
    parsed = configs.select(key, F.try_parse_json(F.col(config)).alias("_value"))
    errors = F.when(F.col("_value").isNull(), F.array(F.lit("config must be valid JSON"))).otherwise(
        option_errors(F.col("_value"), schema)
    )
    return parsed.select(key, F.explode(errors).alias("error"))


# --- capture contract -------------------------------------------------------------------


_MEMBERS = ("subject", "payload", "privacy", "tags", "metadata")


def with_capture_problem(rows: DataFrame, capture: str, version: str = CAPTURE_VERSION) -> DataFrame:
    """Adds ``problem``: what keeps a variant column from being JSON or a valid capture, the first broken rule; null for a valid one.

    Members and their types are found out once per row, before the rules ask for them.
    """
    value, part = F.col(capture), lambda name: F.col(f"_part_{name}")
    found = computed(rows, *[member(value, name).alias(f"_part_{name}") for name in _MEMBERS])
    inner = {"kind": ("subject", "payload"), "level": ("privacy",)}
    leaves = [member(part(owner), name).alias(f"_part_{owner}_{name}") for name, owners in inner.items() for owner in owners]
    found = computed(found, *leaves)
    problem = F.when(value.isNull(), "not valid JSON").otherwise(_capture_problem(value, part, version))
    return computed(found, problem.alias("problem")).select(*rows.columns, "problem")


def _capture_problem(value: Column, part: Callable[[str], Column], version: str) -> Column:
    filled = lambda key: F.coalesce(as_text(member(value, key)) != "", F.lit(False))
    nested = lambda column: json_class(column).isin("object", "array")

    return first_broken(
        object=nested(value),
        schema=as_text(member(value, "schema_version")) == version,
        keys=filled("id") & filled("connector") & filled("observed_at") & filled("captured_at"),
        subject=nested(part("subject"))
        & is_truthy(part("subject_kind"))
        & F.coalesce(as_text(member(part("subject"), "uri")) != "", F.lit(False)),
        payload=nested(part("payload")) & is_truthy(part("payload_kind")),
        privacy=nested(part("privacy")) & is_truthy(part("privacy_level")),
        level=as_text(part("privacy_level")).isin(*PRIVACY_LEVELS),
        tags=(json_class(part("tags")) == "array")
        & F.forall(F.coalesce(elements(part("tags")), F.array().cast("array<variant>")), lambda t: json_class(t) == "string"),
        metadata=json_class(part("metadata")) == "object",
    )


def first_broken(**holds: Column) -> Column:
    """Message of the first rule of the contract that does not hold (null counts as not), null if all hold."""
    return F.coalesce(
        *[F.when(~F.coalesce(holds[rule], F.lit(False)), message) for rule, message in CAPTURE_RULES.items() if rule in holds]
    )


def row_problem(version: str = CAPTURE_VERSION) -> Column:
    """The problem of :func:`with_capture_problem` for a typed capture row; its types already say that it is an object."""
    filled = lambda name: F.col(name) != ""
    return first_broken(
        schema=F.col("schema_version") == version,
        keys=filled("id") & filled("connector") & filled("observed_at") & filled("captured_at"),
        subject=filled("subject.kind") & filled("subject.uri"),
        payload=filled("payload.kind"),
        privacy=filled("privacy.level"),
        level=F.col("privacy.level").isin(*PRIVACY_LEVELS),
        tags=~F.exists("tags", lambda t: t.isNull()),
        metadata=json_class(F.try_parse_json("metadata")) == "object",
    )


def capture_rejects(documents: DataFrame, key: str, capture: str, version: str = CAPTURE_VERSION) -> DataFrame:
    """Rows ``(key, problem)`` of JSON texts that are no valid capture."""
    parsed = computed(documents.select(key, capture), F.try_parse_json(F.col(capture)).alias("_value"))
    return with_capture_problem(parsed, "_value", version).select(key, "problem").where(F.col("problem").isNotNull())


# --- instance and target rows ---------------------------------------------------------------


def normalize_instances(rows: DataFrame, json_text: str = "value", label: str = "connector instance") -> DataFrame:
    """Typed instance rows with defaults, and ``problem`` where a field has the wrong type.

    Wrong types are errors and never coerced; only missing fields take defaults.
    """
    v = rows.withColumn("_v", F.try_parse_json(F.col(json_text)))
    value = F.col("_v")
    get = lambda key: member(value, key)
    raw_id = as_text(get("id"))
    has = lambda c: F.coalesce(trim_blanks(c) != "", F.lit(False))
    named = lambda text: F.concat(F.lit(f'{label} "'), raw_id, F.lit(f'" {text}'))
    missing_or = lambda key, *kinds: get(key).isNull() | json_class(get(key)).isin(*kinds)
    problem = F.coalesce(
        F.when(value.isNull() | (json_class(value) != "object"), f"{label} must be an object"),
        F.when(~has(raw_id), f"{label} requires a non-empty id"),
        F.when(~has(as_text(get("connector"))), named("requires a connector id")),
        F.when(~missing_or("enabled", "boolean"), named("has a non-boolean enabled")),
        F.when(~missing_or("schedule", "string", "null"), named("has a non-string schedule")),
        F.when(~missing_or("config", "object"), named("has a non-object config")),
        F.when(~missing_or("checkpoint", "object", "null"), named("has a non-object checkpoint")),
    )
    checked = computed(v, problem.alias("problem"))
    good = lambda c: F.when(F.col("problem").isNull(), c)
    return checked.select(
        *rows.columns,
        "problem",
        good(trim_blanks(raw_id)).alias("id"),
        good(trim_blanks(as_text(get("connector")))).alias("connector"),
        good(F.coalesce(as_boolean(get("enabled")), F.lit(True))).alias("enabled"),
        good(as_text(get("schedule"))).alias("schedule"),
        good(F.coalesce(F.to_json(get("config")), F.lit("{}"))).alias("config"),
        good(
            F.when(json_class(get("checkpoint")) == "object", F.to_json(get("checkpoint")))
        ).alias("checkpoint"),
    )


def target_levels(kind: Column, include: Column) -> Column:
    """Accepted privacy levels: known names of the list, or the default of the kind when none is left."""
    default = F.when(kind == "file", F.array(*[F.lit(x) for x in FILE_LEVELS])).otherwise(
        F.array(*[F.lit(x) for x in PUSH_LEVELS])
    )
    known = F.filter(F.transform(elements(include), as_text), lambda x: x.isin(*PRIVACY_LEVELS))
    return F.when((json_class(include) == "array") & (F.size(known) > 0), known).otherwise(default)


def normalize_targets(rows: DataFrame, json_text: str = "value") -> DataFrame:
    """Typed target rows with effective settings, and ``problem`` for unusable ones."""
    v = rows.withColumn("_v", F.try_parse_json(F.col(json_text)))
    value = F.col("_v")
    get = lambda key: member(value, key)
    config = get("config")
    option = lambda key: member(config, key)
    raw_id, kind = as_text(get("id")), as_text(get("kind"))
    has = lambda c: F.coalesce(trim_blanks(c) != "", F.lit(False))
    named = lambda text: F.concat(F.lit('delivery target "'), raw_id, F.lit(f'" {text}'))
    problem = F.coalesce(
        F.when(value.isNull() | (json_class(value) != "object"), "delivery target must be an object"),
        F.when(~has(raw_id), "delivery target requires a non-empty id"),
        F.when(
            ~F.coalesce(kind.isin(*TARGET_KINDS), F.lit(False)),
            named(f"has an unknown kind; supported kinds are {', '.join(TARGET_KINDS)}"),
        ),
        F.when(config.isNotNull() & (json_class(config) != "object"), named("has a non-object config")),
        F.when((kind == "file") & ~has(as_text(option("directory"))), "file target requires config.directory"),
        F.when(
            (kind == "webhook") & ~F.coalesce(is_web_url(as_text(option("url"))), F.lit(False)),
            "webhook target requires an http(s) config.url",
        ),
    )
    checked = computed(v, problem.alias("problem"))
    good = lambda c: F.when(F.col("problem").isNull(), c)
    push = kind == "webhook"
    headers = F.map_filter(
        F.try_variant_get(option("headers"), "$", "map<string,variant>"), lambda k, h: json_class(h) == "string"
    )
    plain = F.transform_values(headers, lambda k, h: F.try_variant_get(h, "$", "string"))
    return checked.select(
        *rows.columns,
        "problem",
        good(trim_blanks(raw_id)).alias("id"),
        good(kind).alias("kind"),
        good(F.when(kind == "file", trim_blanks(as_text(option("directory"))))).alias("directory"),
        good(F.when(push, trim_blanks(as_text(option("url"))))).alias("url"),
        good(F.when(push, blank_to_null(as_text(option("token_env"))))).alias("token_env"),
        good(F.when(push & (json_class(option("headers")) == "object"), plain)).alias("headers"),
        good(
            F.when(push, F.coalesce(as_number(option("timeout_ms")), F.lit(float(DEFAULT_TIMEOUT_MS))))
        ).alias("timeout_ms"),
        good(target_levels(kind, option("include_privacy_levels"))).alias("levels"),
    )


# The options delivery targets accept.
_LEVELS_RULE = {"type": "array", "items": {"type": "string", "enum": list(PRIVACY_LEVELS)}}
TARGET_SCHEMAS = {
    "file": {
        "type": "object",
        "required": ["directory"],
        "additionalProperties": False,
        "properties": {
            "directory": {"type": "string", "minLength": 1},
            "include_privacy_levels": _LEVELS_RULE,
        },
    },
    "webhook": {
        "type": "object",
        "required": ["url"],
        "additionalProperties": False,
        "properties": {
            "url": {"type": "string", "format": "uri"},
            "token_env": {"type": "string"},
            "headers": {"type": "object"},
            "include_privacy_levels": _LEVELS_RULE,
            "timeout_ms": {"type": "integer"},
        },
    },
}
