"""Recorded model responses: from free text to a checked label, in native columns.

`normalise` takes a table of responses through named steps (fences, parse, quote repair,
salvage, rules). Every step is an expression of the scan stage; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstate.functions.text import strip
from turnstate.schemas import CONFIDENCE, FIELDS, LEVELS, SPAN, allowed_values

FENCE = "```"

# Members are read as VARIANT so that the type of each JSON value stays visible.
_PAYLOAD_DDL = ", ".join(
    f"{name} VARIANT"
    for name in (*FIELDS, "confidence", "evidence_spans", "observer_notes", "observer_confidence")
)
_STRICT = {
    "columnNameOfCorruptRecord": "_bad",
    "allowSingleQuotes": "false",
    "mode": "PERMISSIVE",
}
NUMBER_TYPE = "^(BIGINT|DOUBLE|DECIMAL.*)$"
PLACEHOLDER = "salvaged_evidence"


def strip_code_fences(text: Column) -> Column:
    """Drop an opening fence line and a closing line of three backticks."""
    trimmed = strip(text)
    body = F.regexp_replace(trimmed, r"^[^\r\n]*(\r\n|\r|\n|$)", "")
    body = F.regexp_replace(body, r"(^|\r\n|\r|\n)[^\S\r\n]*`{3}[^\S\r\n]*$", "")
    return F.when(F.startswith(trimmed, F.lit(FENCE)), strip(body)).otherwise(trimmed)


def first_json_object(text: Column) -> Column:
    """Text of the first balanced `{...}`, braces inside strings ignored; NULL if none.

    Escapes, quotes, braces and plain runs are folded with the depth, whether a string is
    open, and the characters passed; `end` is set where the object closes.
    """
    rest = F.substr(text, F.greatest(F.locate("{", text), F.lit(1)))
    pieces = F.regexp_extract_all(rest, F.lit(r'(?s)\\.|["{}\\]|[^"\\{}]++'), F.lit(0))
    zero = F.lit(0)
    begin = F.struct(
        zero.alias("depth"), F.lit(False).alias("quoted"), zero.alias("at"), zero.alias("end")
    )

    def step(state: Column, piece: Column) -> Column:
        quoted = state["quoted"]
        at = state["at"] + F.length(piece)
        depth = state["depth"] + F.when(~quoted & (piece == "{"), 1).when(
            ~quoted & (piece == "}"), -1
        ).otherwise(0)
        closed = ~quoted & (piece == "}") & (depth == 0) & (state["end"] == 0)
        return F.struct(
            depth.alias("depth"),
            (quoted != (piece == '"')).alias("quoted"),
            at.alias("at"),
            F.when(closed, at).otherwise(state["end"]).alias("end"),
        )

    end = F.aggregate(pieces, begin, step)["end"]
    return F.when(F.contains(text, F.lit("{")), F.substr(rest, F.lit(1), F.nullif(end, zero)))


def top_level_objects(text: Column) -> Column:
    """All outermost `{...}` groups by brace count alone, in order of their end."""
    pieces = F.regexp_extract_all(text, F.lit(r"[{}]|[^{}]++"), F.lit(0))
    zero = F.lit(0)
    begin = F.struct(
        zero.alias("depth"), zero.alias("at"), zero.alias("start"),
        F.array().cast("array<struct<s:int,n:int>>").alias("found"),
    )

    def step(state: Column, piece: Column) -> Column:
        opens, closes = piece == "{", (piece == "}") & (state["depth"] > 0)
        at = state["at"] + F.length(piece)
        start = F.when(opens & (state["depth"] == 0), at).otherwise(state["start"])
        group = F.struct(start.alias("s"), (at - start + 1).alias("n"))
        return F.struct(
            (state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            at.alias("at"),
            start.alias("start"),
            F.when(closes & (state["depth"] == 1), F.concat(state["found"], F.array(group)))
            .otherwise(state["found"])
            .alias("found"),
        )

    found = F.aggregate(pieces, begin, step)["found"]
    return F.transform(found, lambda g: F.substr(text, g["s"], g["n"]))


def first_object(text: Column) -> Column:
    """The first of the whole text and its outermost groups that parses to an object."""
    candidates = F.concat(F.array(strip(text)), top_level_objects(text))
    parsed = F.transform(candidates, lambda c: F.try_parse_json(c))
    is_object = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    return F.get(F.filter(parsed, is_object), F.lit(0))


def salvage_member(text: Column, key: str) -> Column:
    """One string member cut from broken JSON, escapes decoded; NULL when absent."""
    tail = F.regexp_extract(text, rf'(?s)"{key}"\s*:\s*"(.*)', 1)
    pieces = F.regexp_extract_all(tail, F.lit(r'(?s)\\.|["\\]|[^"\\]++'), F.lit(0))
    begin = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("end"))
    end = F.aggregate(
        pieces,
        begin,
        lambda s, p: F.struct(
            (s["at"] + F.length(p)).alias("at"),
            F.when((p == '"') & (s["end"] < 0), s["at"]).otherwise(s["end"]).alias("end"),
        ),
    )["end"]
    value = F.substr(tail, F.lit(1), F.when(end >= 0, end))
    return F.from_json(F.concat(F.lit('{"v":"'), value, F.lit('"}')), "v STRING")["v"]


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "“”‘’", "\"\"''")


def _parse(text: Column) -> Column:
    return F.from_json(text, f"{_PAYLOAD_DDL}, _bad STRING", _STRICT)


def _type(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("MISSING"))


def _text(value: Column) -> Column:
    """A JSON string's content; NULL for every other type."""
    return F.when(
        F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")
    )


# What counts as a string and as a number in a response that is not JSON.
LOOSE_STRING, LOOSE_NUMBER = '"([^"]+)"', "([0-9.]+)"


def _spaced(*marks: str) -> str:
    """A pattern of marks with any white space between them."""
    return r"\s*".join(marks)


def _loose_value(text: Column, key: str, value: str = LOOSE_STRING) -> Column:
    """The first value of that form behind the key; empty when there is none."""
    return F.regexp_extract(text, _spaced(f'"{key}"', ":", value), 1)


def _behind(text: Column, *marks: str) -> Column:
    """What follows the first place with these marks, or NULL."""
    return F.get(F.split(text, _spaced(*marks), 2), F.lit(1))


def _ahead_of(text: Column, *marks: str) -> Column:
    """What comes before the first place with these marks, or NULL without one."""
    parts = F.split(text, _spaced(*marks), 2)
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(0)))


def _typed_payload(payload: Column) -> Column:
    """Members of a parsed object with the type facts that the rules need."""
    member = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")
    notes, number = payload["observer_notes"], payload["observer_confidence"]
    return F.struct(
        *[_text(payload[f]).alias(f) for f in FIELDS],
        F.startswith(_type(payload["confidence"]), F.lit("OBJECT")).alias("has_levels"),
        F.struct(*[_text(member(payload["confidence"], f)).alias(f) for f in FIELDS]).alias("levels"),
        F.regexp_extract(_type(payload["evidence_spans"]), "^[A-Z]+", 0).alias("spans_type"),
        F.transform(
            F.try_variant_get(payload["evidence_spans"], "$", "array<variant>"),
            lambda s: F.struct(
                F.startswith(_type(s), F.lit("OBJECT")).alias("is_object"),
                _text(member(s, "text")).alias("text"),
                _text(member(s, "category")).alias("category"),
                F.nullif(_text(member(s, "note")), F.lit("")).alias("note"),
            ),
        ).alias("spans"),
        _type(notes).alias("notes_type"),
        _text(notes).alias("notes"),
        # Falsy values that are no strings count as empty notes.
        F.coalesce(
            F.try_variant_get(notes, "$", "boolean").cast("double"),
            F.try_variant_get(notes, "$", "double"),
        ).alias("notes_number"),
        _type(number).alias("number_type"),
        # JSON true and false count as 1 and 0.
        F.coalesce(
            F.when(F.schema_of_variant(number) == "BOOLEAN", F.try_variant_get(number, "$", "boolean").cast("double")),
            F.try_variant_get(number, "$", "double"),
        ).alias("number"),
    )


def _first_failure(p: Column) -> Column:
    """Name of the first rule, in order, that a typed payload breaks."""
    wrong = lambda v, allowed: ~F.coalesce(v.isin(allowed), F.lit(False))
    blank = lambda v: F.coalesce(v, F.lit("")) == ""
    numeric = F.rlike(p["number_type"], F.lit(NUMBER_TYPE)) | (p["number_type"] == "BOOLEAN")
    falsy = p["notes_type"].isin("MISSING", "VOID", "ARRAY<VOID>", "OBJECT<>") | (
        (F.rlike(p["notes_type"], F.lit(NUMBER_TYPE)) | (p["notes_type"] == "BOOLEAN"))
        & (p["notes_number"] == 0)
    )
    rules = [
        *[(f"invalid_{f}", wrong(p[f], allowed_values(f))) for f in FIELDS],
        ("confidence_not_object", ~p["has_levels"]),
        *[(f"invalid_confidence_{f}", wrong(p["levels"][f], LEVELS)) for f in FIELDS],
        ("evidence_not_array", ~p["spans_type"].isin("MISSING", "ARRAY")),
        ("span_invalid", F.exists(p["spans"], lambda s: ~s["is_object"] | blank(s["text"]) | blank(s["category"]))),
        ("no_evidence", F.coalesce(F.size(p["spans"]), F.lit(0)) < 1),
        ("observer_notes_invalid", (p["notes_type"] != "STRING") & ~falsy),
        (
            "observer_confidence_invalid",
            ~p["number_type"].isin("MISSING", "VOID")
            & ~(numeric & F.coalesce(p["number"].between(0.0, 1.0), F.lit(False))),
        ),
    ]
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules])


def _salvaged(text: Column) -> Column:
    """Labels and levels cut from broken JSON; NULL unless all eight are valid.

    Levels are looked for behind the opening of the confidence object, the span's text between
    its opening and the category that follows it.
    """
    opened = _behind(text, '"confidence"', ":", r"\{")
    found = {f: (_loose_value(text, f), _loose_value(opened, f)) for f in FIELDS}
    checks = [label.isin(allowed_values(f)) & level.isin(LEVELS) for f, (label, level) in found.items()]
    span = _behind(text, '"evidence_spans"', ":", r"\[", r"\{", '"text"', ":", '"')
    filled = lambda v: F.coalesce(F.nullif(strip(v), F.lit("")), F.lit(PLACEHOLDER))
    return F.when(
        F.forall(F.array(*checks), lambda ok: F.coalesce(ok, F.lit(False))),
        F.struct(
            *[label.alias(f) for f, (label, _) in found.items()],
            F.struct(*[level.alias(f) for f, (_, level) in found.items()]).alias("levels"),
            filled(_ahead_of(span, '"', ",", '"category"')).alias("span_text"),
            filled(_loose_value(text, "category")).alias("span_category"),
            _loose_value(text, "observer_notes").alias("notes"),
            _loose_value(text, "observer_confidence", LOOSE_NUMBER).alias("number"),
        ),
    )


def normalise(df: DataFrame, text: str = "response_text", *, out: str = "parsed") -> DataFrame:
    """Add a struct: `reason` is NULL for an accepted response and otherwise names the first
    rule that failed; the other members hold the label and whether it was salvaged."""
    keep = df.columns
    steps = df.withColumn("_body", strip_code_fences(F.col(text)))
    has_brace = F.contains("_body", F.lit("{"))
    steps = steps.withColumn("_direct", _parse(F.substr("_body", F.greatest(F.locate("{", F.col("_body")), F.lit(1)))))
    direct_ok = has_brace & F.col("_direct._bad").isNull()
    # Only texts that failed to parse pay for the exact search of the balanced object.
    steps = steps.withColumn(
        "_candidate", F.when(~direct_ok, F.coalesce(first_json_object(F.col("_body")), F.col("_body")))
    ).withColumn("_repaired", straight_quotes(F.col("_candidate")))
    steps = steps.withColumn(
        "_second", F.when(has_brace & (F.col("_repaired") != F.col("_candidate")), _parse(F.col("_repaired")))
    )
    second_ok = F.col("_second").isNotNull() & F.col("_second._bad").isNull()
    steps = steps.withColumn(
        "_payload", F.when(direct_ok, F.col("_direct")).when(second_ok, F.col("_second"))
    )
    steps = steps.withColumn("_p", F.when(F.col("_payload").isNotNull(), _typed_payload(F.col("_payload"))))
    steps = steps.withColumn("_s", F.when(F.col("_payload").isNull(), _salvaged(F.col("_repaired"))))
    p, s = F.col("_p"), F.col("_s")
    certainty = F.nullif(s["number"], F.lit("")).try_cast("double")
    bad_number = (s["number"] != "") & ~F.coalesce(certainty.between(0.0, 1.0), F.lit(False))
    other_json = ~has_brace & F.try_parse_json("_body").isNotNull()
    reason = (
        F.when(p.isNotNull(), _first_failure(p))
        .when(s.isNotNull(), F.when(bad_number, "observer_confidence_invalid"))
        .when(other_json, "not_an_object")
        .otherwise("invalid_json")
    )
    span = lambda t, c, n: F.struct(t.alias("text"), c.alias("category"), n.alias("note"))
    none = F.lit(None).cast("string")
    label = F.struct(
        reason.alias("reason"),
        *[F.coalesce(p[f], s[f]).alias(f) for f in FIELDS],
        F.coalesce(p["levels"], s["levels"]).cast(CONFIDENCE).alias("confidence"),
        F.when(p.isNotNull(), F.transform(p["spans"], lambda x: span(x["text"], x["category"], x["note"])))
        .when(s.isNotNull(), F.array(span(s["span_text"], s["span_category"], none)))
        .cast(T.ArrayType(SPAN))
        .alias("evidence_spans"),
        F.when(p.isNotNull(), F.coalesce(p["notes"], F.lit(""))).otherwise(s["notes"]).alias("observer_notes"),
        F.when(p.isNotNull(), p["number"]).otherwise(certainty).alias("observer_confidence"),
        s.isNotNull().alias("salvaged"),
    )
    return steps.select(*keep, label.alias(out))
