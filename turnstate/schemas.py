"""Fixed values of the data model and explicit Spark schemas."""

from pyspark.sql import types as T

# Field names, label values in ordinal order, levels and contexts.
FIELDS = (
    "judgment_holder",
    "delegation_awareness",
    "cognitive_engagement",
    "information_seeking",
)
ORDINAL_VALUES = {
    "judgment_holder": ["Human", "Shared", "AI"],
    "delegation_awareness": ["Explicit", "Implicit", "Absent"],
    "cognitive_engagement": ["Active", "Reactive", "Passive"],
    "information_seeking": ["Active", "Passive", "None"],
}
UNORDERED_VALUES = {"judgment_holder": ["Undefined"]}
LEVELS = ["high", "medium", "low"]
CONTEXTS = ["general", "mental_health", "policy_admin", "financial", "education"]


def allowed_values(field: str) -> list[str]:
    return ORDINAL_VALUES[field] + UNORDERED_VALUES.get(field, [])


_labels = [T.StructField(f, T.StringType()) for f in FIELDS]

CONFIDENCE = T.StructType(list(_labels))

HINT = T.StructType(
    _labels
    + [
        T.StructField("confidence", CONFIDENCE),
        T.StructField("extensions", T.MapType(T.StringType(), T.StringType())),
    ]
)

SPAN = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("note", T.StringType()),
    ]
)

# `jsv_hint` is the key under which input documents embed a label.
TURN_META = T.StructType(
    [T.StructField("timestamp", T.StringType()), T.StructField("jsv_hint", HINT)]
)

TURN = T.StructType(
    [
        T.StructField("turn_number", T.IntegerType()),
        T.StructField("human_input", T.StringType()),
        T.StructField("ai_response", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("meta", TURN_META),
    ]
)

INTERACTION = T.StructType(
    [
        T.StructField("interaction_id", T.StringType()),
        T.StructField("context_module", T.StringType()),
        T.StructField(
            "participants",
            T.StructType(
                [T.StructField("human_id", T.StringType()), T.StructField("ai_id", T.StringType())]
            ),
        ),
        T.StructField("turns", T.ArrayType(TURN)),
    ]
)

TEMPLATE = T.StructType(
    [
        T.StructField("turn_number", T.IntegerType()),
        T.StructField("human_input", T.StringType()),
        T.StructField("human_input_options", T.ArrayType(T.StringType())),
        T.StructField("ai_response", T.StringType()),
        T.StructField("ai_response_options", T.ArrayType(T.StringType())),
        T.StructField("meta", TURN_META),
    ]
)

SCENARIO = T.StructType(
    [
        T.StructField("scenario_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("context_module", T.StringType()),
        T.StructField(
            "participants",
            T.StructType(
                [T.StructField("human_id", T.StringType()), T.StructField("ai_id", T.StringType())]
            ),
        ),
        T.StructField("slot_options", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("turn_templates", T.ArrayType(TEMPLATE)),
        T.StructField(
            "blueprints",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("blueprint_id", T.StringType()),
                        T.StructField("turn_templates", T.ArrayType(TEMPLATE)),
                    ]
                )
            ),
        ),
    ]
)

SCENARIO_PACK = T.StructType(
    [
        T.StructField("scenario_pack_id", T.StringType()),
        T.StructField("context_module", T.StringType()),
        T.StructField("scenarios", T.ArrayType(SCENARIO)),
    ]
)

EXAMPLE = T.StructType(
    [
        T.StructField("interaction_id", T.StringType()),
        T.StructField("turn_number", T.IntegerType()),
        T.StructField("context_module", T.StringType()),
        T.StructField("human_input", T.StringType()),
        T.StructField("ai_response", T.StringType()),
        T.StructField("jsv_hint", HINT),
        T.StructField("evidence_spans", T.ArrayType(SPAN)),
        T.StructField("observer_notes", T.StringType()),
    ]
)

EXAMPLE_PACK = T.StructType(
    [
        T.StructField("source_run_id", T.StringType()),
        T.StructField("source_track_name", T.StringType()),
        T.StructField("interaction_id", T.StringType()),
        T.StructField("examples", T.ArrayType(EXAMPLE)),
    ]
)

DATASET_ITEM = T.StructType(
    [
        T.StructField("interaction_id", T.StringType()),
        T.StructField("scenario_id", T.StringType()),
        T.StructField("scenario_title", T.StringType()),
        T.StructField("context_module", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("turn_count", T.IntegerType()),
        T.StructField("slot_values", T.MapType(T.StringType(), T.StringType())),
        T.StructField("blueprint_id", T.StringType()),
    ]
)

DATASET_MANIFEST = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("dataset_version", T.StringType()),
        T.StructField("dataset_kind", T.StringType()),
        T.StructField("context_module", T.StringType()),
        T.StructField("items", T.ArrayType(DATASET_ITEM)),
    ]
)

RUN_ITEM = T.StructType(
    [
        T.StructField("interaction_id", T.StringType()),
        T.StructField("scenario_id", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("model_id", T.StringType()),
        T.StructField("prompt_version", T.StringType()),
        T.StructField("run_dir", T.StringType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ]
)

RUN_SUMMARY = T.StructType(
    [
        T.StructField("dataset_run_id", T.StringType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("track_name", T.StringType()),
        T.StructField("items", T.ArrayType(RUN_ITEM)),
    ]
)

EXTRACT = T.StructType(
    [
        T.StructField("interaction_id", T.StringType()),
        T.StructField("turn_number", T.IntegerType()),
        T.StructField("track_name", T.StringType()),
        T.StructField("context_module", T.StringType()),
        T.StructField("human_input", T.StringType()),
        T.StructField("ai_response", T.StringType()),
        T.StructField("jsv_hint", HINT),
        T.StructField(
            "overlay", T.StructType([T.StructField("evidence_spans", T.ArrayType(SPAN))])
        ),
        T.StructField(
            "track_metadata",
            T.StructType(
                [
                    T.StructField("track_id", T.StringType()),
                    T.StructField("model_id", T.StringType()),
                    T.StructField("prompt_version", T.StringType()),
                    T.StructField("observer_confidence", T.DoubleType()),
                    T.StructField("observer_notes", T.StringType()),
                ]
            ),
        ),
        T.StructField("stored_at", T.StringType()),
    ]
)
