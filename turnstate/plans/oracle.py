"""SQL equivalents of the registered queries, written for DuckDB over the same tables."""

from __future__ import annotations

from turnstate.operators import prompts as P
from turnstate.plans import inputs as IN
from turnstate.schemas import CONTEXTS, FIELDS, LEVELS, ORDINAL_VALUES, allowed_values

H, D, E, S = FIELDS


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def dg(index: int, size: int, digest: str = "d") -> str:
    return f"(('0x' || substr({digest}, {1 + 2 * index}, 2))::BIGINT % {size})"


def md5(prefix: str, *parts: str) -> str:
    return "md5(" + " || ':' || ".join([_q(prefix), *parts]) + ")"


def ctx(number: str) -> str:
    return f"{_list(CONTEXTS)}[({number}) % 5 + 1]"


def pick(values, index: str) -> str:
    return f"{_list(values)}[{index} + 1]"


def cols(pattern: str, sep: str = ", ") -> str:
    return sep.join(pattern.replace("@", f) for f in FIELDS)


def labels_sql(d: str = "d") -> str:
    return ", ".join(
        f"{pick(allowed_values(f), dg(i, len(allowed_values(f)), d))} AS {f}" for i, f in enumerate(FIELDS)
    )


def levels_sql(d: str = "d") -> str:
    return ", ".join(f"{pick(LEVELS, dg(4 + i, 3, d))} AS l_{f}" for i, f in enumerate(FIELDS))


LEVEL_TEXT = " || '|' || ".join(f"l_{f}" for f in FIELDS)

TURNS = f"""turns AS (
  SELECT 'c-' || conv_id AS interaction_id, {ctx('conv_id')} AS context_module, pos,
    pos AS turn_number, human_input, ai_response
  FROM (
    SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS pos,
      coalesce(text, '') AS human_input,
      CASE WHEN lead(role) OVER w = 'assistant' THEN coalesce(lead(text) OVER w, '') ELSE '' END AS ai_response
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
  ) WHERE role = 'user')"""

INTER = f"""inter AS (
  SELECT 'c-' || conv_id AS interaction_id,
    CASE WHEN {dg(0, 16)} = 0 THEN 'travel' ELSE {ctx('conv_id')} END AS context_module,
    CASE WHEN {dg(1, 16)} = 0 THEN '' ELSE 'human-1' END AS human_id
  FROM (SELECT DISTINCT conv_id, {md5('doc', 'conv_id')} AS d FROM conversations))"""

HINTED = f"""hinted AS (
  SELECT *, {dg(8, 8)} <> 0 AS has_hint, {labels_sql()}, {levels_sql()}
  FROM (SELECT *, {md5('hint', 'interaction_id', 'turn_number')} AS d FROM turns))"""


def _hit(group: str, text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(p)})" for p in IN.RULE_PHRASES[group]) + ")"


def rules_sql(source: str, text: str = "human_input") -> str:
    """The rule track over `source`, all its columns kept."""
    low = f"lower({text})"
    return f"""(
  SELECT *, CASE WHEN hedged THEN 'Reactive' ELSE eng0 END AS {E},
    CASE WHEN hedged THEN greatest(conf0, 0.72::DOUBLE) ELSE conf0 END AS observer_confidence,
    concat_ws('|', CASE WHEN m1 THEN 'decision_support_signal' END, CASE WHEN m2 THEN 'exploration_signal' END,
      CASE WHEN m3 THEN 'delegation_signal' END, CASE WHEN m4 THEN 'retention_signal' END,
      CASE WHEN hedged THEN 'hedging_signal' END, CASE WHEN NOT hit THEN 'default_excerpt' END) AS categories,
    concat_ws('; ', CASE WHEN m1 THEN 'Detected human-led decision support request' END,
      CASE WHEN m2 THEN 'Detected option exploration' END, CASE WHEN m3 THEN 'Detected direct delegation request' END,
      CASE WHEN m4 THEN 'Detected retained human judgment' END, CASE WHEN hedged THEN 'Detected hedging language' END,
      CASE WHEN NOT hit THEN 'Default baseline assignment' END) AS observer_notes
  FROM (
    SELECT *, m5 AND eng0 = 'Active' AS hedged, m1 OR m2 OR m3 OR m4 AS hit FROM (
      SELECT *, CASE WHEN m4 THEN 'Human' WHEN m3 THEN 'AI' WHEN m2 THEN 'Shared' WHEN m1 THEN 'Human' ELSE 'Undefined' END AS {H},
        CASE WHEN m1 OR m2 OR m3 OR m4 THEN 'Explicit' ELSE 'Absent' END AS {D},
        CASE WHEN m4 THEN 'Active' WHEN m3 THEN 'Reactive' WHEN m2 OR m1 THEN 'Active' ELSE 'Passive' END AS eng0,
        CASE WHEN m4 THEN 'Passive' WHEN m3 THEN 'Passive' WHEN m2 OR m1 THEN 'Active' ELSE 'None' END AS {S},
        CASE WHEN m4 THEN 0.82::DOUBLE WHEN m3 THEN 0.82::DOUBLE WHEN m2 THEN 0.76::DOUBLE WHEN m1 THEN 0.8::DOUBLE ELSE 0.68::DOUBLE END AS conf0
      FROM (SELECT *, {_hit('human_led', low)} AS m1, {_hit('exploration', low)} AS m2, {_hit('delegation', low)} AS m3,
        {_hit('retention', low)} AS m4, {_hit('hedging', low)} AS m5 FROM {source}))))"""


RULES = f"rules AS (SELECT * FROM {rules_sql('turns')})"


def ordinal(field: str, value: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} = '{v}' THEN {i}" for i, v in enumerate(ORDINAL_VALUES[field])) + " END"


def step(field: str) -> str:
    return f"(({ordinal(field, field)}) - ({ordinal(field, 'p_' + field)})) / 2.0::DOUBLE AS delta_{field}"


DELTAS = f"""deltas AS (
  SELECT interaction_id, pos, from_turn, turn_number AS to_turn, {', '.join(step(f) for f in FIELDS)}, context_module
  FROM (SELECT *, lag(turn_number) OVER w AS from_turn, {', '.join(f'lag({f}) OVER w AS p_{f}' for f in FIELDS)}
    FROM rules WINDOW w AS (PARTITION BY interaction_id ORDER BY pos)) WHERE from_turn IS NOT NULL)"""

BASE = f"WITH {TURNS}"
WITH_RULES = f"{BASE}, {RULES}"
WITH_DELTAS = f"{WITH_RULES}, {DELTAS}"
WITH_HINTS = f"{BASE}, {HINTED}"

# --- recorded responses: outcome of every case, derived from the digest alone

RESP = f"""resp AS (
  SELECT *, CASE k WHEN 2 THEN 'invalid_{H}' WHEN 3 THEN 'no_evidence' WHEN 4 THEN 'invalid_confidence_{D}'
      WHEN 5 THEN 'observer_confidence_invalid' WHEN 7 THEN 'invalid_json' WHEN 9 THEN 'invalid_json'
      WHEN 10 THEN 'not_an_object' END AS reason,
    k IN (6, 11) AS salvaged
  FROM (SELECT *, {dg(8, 16)} AS k, {labels_sql()}, {levels_sql()} FROM (
    SELECT interaction_id, turn_number, human_input, model_id, attempt,
      {md5('resp', 'model_id', 'interaction_id', 'turn_number', 'attempt')} AS d
    FROM turns, unnest({_list(IN.MODELS)}) AS m(model_id), unnest(range({IN.ATTEMPTS})) AS a(attempt))))"""

FIRST = """firsts AS (
  SELECT model_id, interaction_id, turn_number, min(attempt) FILTER (reason IS NULL) AS attempt,
    count(*) AS tried, arg_max(reason, attempt) AS last_reason_any,
    max(CASE WHEN attempt = 2 THEN coalesce(reason, '-') END) AS last_reason
  FROM resp GROUP BY ALL)"""

MODEL_LABELS = f"""model_labels AS (
  SELECT r.* FROM resp r JOIN firsts f USING (model_id, interaction_id, turn_number)
  WHERE r.attempt = f.attempt)"""

WITH_RESP = f"{BASE}, {RESP}, {FIRST}, {MODEL_LABELS}"

# --- comparison rows of three runs, last row per turn

COMPARED = f"""rows_all AS (
  SELECT 'rules' AS run_key, interaction_id, turn_number, 0 AS seq, {', '.join(FIELDS)}, {', '.join(f"'low' AS l_{f}" for f in FIELDS)} FROM rules
  UNION ALL SELECT 'hints', interaction_id, turn_number, 0, {', '.join(FIELDS)}, {', '.join(f'l_{f}' for f in FIELDS)} FROM hinted WHERE has_hint
  UNION ALL SELECT 'hints', interaction_id, turn_number, 1, 'AI', {', '.join(FIELDS[1:])}, {', '.join(f'l_{f}' for f in FIELDS)} FROM hinted
    WHERE has_hint AND {dg(0, 5, md5('again', 'interaction_id', 'turn_number'))} = 0
  UNION ALL SELECT 'model-a', interaction_id, turn_number, 0, {', '.join(FIELDS)}, {', '.join(f'l_{f}' for f in FIELDS)} FROM model_labels WHERE model_id = 'model-a'),
compared AS (SELECT * FROM rows_all QUALIFY row_number() OVER (PARTITION BY run_key, interaction_id, turn_number ORDER BY seq DESC) = 1)"""

BY_TURN = f"""by_turn AS (
  SELECT interaction_id, turn_number, count(*) AS present, string_agg(run_key, '|' ORDER BY run_key) AS runs_present,
    {', '.join(f'(count(DISTINCT {f}) > 1)::INT AS differs_{f}' for f in FIELDS)}
  FROM compared GROUP BY ALL)"""

SUMMARY = f"""summary AS (
  SELECT interaction_id, count(*) FILTER (present >= 2) AS turns_compared, count(*) AS turns_total,
    count(*) FILTER (present < 2) AS turns_skipped,
    coalesce(sum({' + '.join(f'differs_{f}' for f in FIELDS)}) FILTER (present >= 2) / nullif(4.0::DOUBLE * count(*) FILTER (present >= 2), 0), 0) AS rate,
    {', '.join(f'coalesce(sum(differs_{f}) FILTER (present >= 2) / nullif(count(*) FILTER (present >= 2), 0)::DOUBLE, 0) AS rate_{f}' for f in FIELDS)}
  FROM by_turn GROUP BY ALL)"""

ITEMS = f"""items AS (
  SELECT *, 's-' || (n % 7) AS scenario_id, {ctx('n')} AS context_module, n % 4 AS example_count
  FROM (SELECT *, substr(interaction_id, 3)::BIGINT AS n FROM summary))"""

WITH_CMP = f"{BASE}, {RULES}, {HINTED}, {RESP}, {FIRST}, {MODEL_LABELS}, {COMPARED}, {BY_TURN}, {SUMMARY}, {ITEMS}"
RATE = lambda f: f"round({f}, 9) AS {f}"
RATES = ", ".join(RATE(f"rate_{f}") for f in FIELDS)


def _majority(value: str, alias: str) -> str:
    return f"""{alias}_t AS (SELECT interaction_id, turn_number, v AS {alias} FROM (
      SELECT interaction_id, turn_number, {value} AS v, count(*) AS c FROM compared GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY interaction_id, turn_number ORDER BY c DESC, v) = 1)"""


ENSEMBLE_PARTS = [(f, f"ensemble_{f}") for f in FIELDS] + [(f"l_{f}", f"ensemble_confidence_{f}") for f in FIELDS]

PAIRS = f"""pairs AS (
  SELECT label, interaction_id, count(b_turn) AS turns_compared,
    {', '.join(f'coalesce(avg(x_{f}), 0) AS rate_{f}' for f in FIELDS)},
    ({' + '.join(f'coalesce(avg(x_{f}), 0)' for f in FIELDS)}) / 4.0::DOUBLE AS rate
  FROM (SELECT o.run_key AS label, o.interaction_id, b.turn_number AS b_turn,
      {', '.join(f'(o.{f} <> b.{f})::INT::DOUBLE AS x_{f}' for f in FIELDS)}
    FROM (SELECT * FROM compared WHERE run_key <> 'rules') o
    LEFT JOIN (SELECT * FROM compared WHERE run_key = 'rules') b USING (interaction_id, turn_number)
    WHERE o.interaction_id IN (SELECT interaction_id FROM compared WHERE run_key = 'rules'))
  GROUP BY ALL)"""

# --- documents as Naive Bayes input

DOC_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9'']+')"
NB = f"""train AS (
  SELECT doc_id, text, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic FROM documents JOIN labels USING (doc_id)
  WHERE {dg(0, 2, md5('train', 'doc_id'))} = 0),
ex AS (SELECT doc_id, 'quality' AS field, quality AS label, {DOC_TOKENS} AS w FROM train
  UNION ALL SELECT doc_id, 'toxic', toxic, {DOC_TOKENS} FROM train),
tok AS (SELECT field, label, token, count(*) AS cnt FROM (SELECT field, label, unnest(w) AS token FROM ex) GROUP BY ALL),
cls AS (SELECT field, label, count(*) AS doc_count, sum(len(w))::BIGINT AS total_tokens, min(doc_id) AS first_seq FROM ex GROUP BY ALL),
voc AS (SELECT field, count(DISTINCT token) AS vocabulary_size FROM tok GROUP BY ALL)"""

NB_SCORE = f"""{NB},
rest AS (SELECT doc_id, {DOC_TOKENS} AS w FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM train)),
tf AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(w) AS token FROM rest) GROUP BY ALL),
hit AS (SELECT doc_id, field, label, sum(n * ln(cnt + 1.0::DOUBLE)) AS s FROM tf JOIN tok USING (token) GROUP BY ALL),
sc AS (SELECT rest.doc_id, len(w) AS token_count, c.field, c.label, first_seq,
    round(ln(doc_count::DOUBLE / sum(doc_count) OVER (PARTITION BY rest.doc_id, c.field)) + coalesce(s, 0)
      - len(w) * ln((total_tokens + greatest(vocabulary_size, 1))::DOUBLE), 9) AS score
  FROM rest CROSS JOIN cls c JOIN voc USING (field) LEFT JOIN hit h ON h.doc_id = rest.doc_id AND h.field = c.field AND h.label = c.label),
rk AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS next_score FROM sc
  WINDOW w AS (PARTITION BY doc_id, field ORDER BY score DESC, first_seq))"""


def level_of(margin: str) -> str:
    return f"CASE WHEN {margin} >= 1.5 THEN 'high' WHEN {margin} >= 0.75 THEN 'medium' ELSE 'low' END"


def _turn_nb() -> str:
    parts = []
    words = "regexp_extract_all(lower(human_input || ' ' || ai_response), '[a-z0-9'']+')"
    ex = " UNION ALL ".join(
        f"SELECT substr(interaction_id, 3)::BIGINT * 1000000 + pos AS seq, '{f}' AS field, {f} AS label, {words} AS w FROM hinted"
        f" WHERE has_hint AND {dg(0, 2, md5('train', 'interaction_id', 'turn_number'))} = 0"
        for f in FIELDS
    )
    parts.append(f"ex AS ({ex})")
    parts.append("tok AS (SELECT field, label, token, count(*) AS cnt FROM (SELECT field, label, unnest(w) AS token FROM ex) GROUP BY ALL)")
    parts.append("cls AS (SELECT field, label, count(*) AS doc_count, sum(len(w))::BIGINT AS total_tokens, min(seq) AS first_seq FROM ex GROUP BY ALL)")
    parts.append("voc AS (SELECT field, count(DISTINCT token) AS vs FROM tok GROUP BY ALL)")
    parts.append(f"rest AS (SELECT interaction_id, turn_number, human_input, {words} AS w FROM turns)")
    parts.append("hit AS (SELECT interaction_id, turn_number, field, label, sum(ln(cnt + 1.0::DOUBLE)) AS s FROM (SELECT interaction_id, turn_number, unnest(w) AS token FROM rest) JOIN tok USING (token) GROUP BY ALL)")
    parts.append(
        "sc AS (SELECT r.interaction_id, r.turn_number, c.field, c.label, first_seq,"
        " round(ln(doc_count::DOUBLE / sum(doc_count) OVER (PARTITION BY r.interaction_id, r.turn_number, c.field)) + coalesce(s, 0)"
        " - len(w) * ln((total_tokens + greatest(vs, 1))::DOUBLE), 9) AS score FROM rest r CROSS JOIN cls c JOIN voc USING (field)"
        " LEFT JOIN hit h ON h.interaction_id = r.interaction_id AND h.turn_number = r.turn_number AND h.field = c.field AND h.label = c.label)"
    )
    parts.append(
        f"rk AS (SELECT interaction_id, turn_number, field, label, {level_of('round(coalesce(score - next_score, 1.0), 9)')} AS level FROM ("
        "SELECT *, row_number() OVER w AS r, lead(score) OVER w AS next_score FROM sc"
        " WINDOW w AS (PARTITION BY interaction_id, turn_number, field ORDER BY score DESC, first_seq)) WHERE r = 1)"
    )
    picks = ", ".join(f"max(CASE WHEN field = '{f}' THEN label END) AS {f}" for f in FIELDS)
    lv = " || '|' || ".join(f"max(CASE WHEN field = '{f}' THEN level END)" for f in FIELDS)
    return (
        f"{WITH_HINTS}, {', '.join(parts)} SELECT interaction_id, turn_number, {picks}, {lv} AS levels,"
        " any_value(CASE WHEN len(w) > 0 THEN array_to_string(w[1:4], ' ') ELSE substr(human_input, 1, 160) END) AS evidence,"
        " 0.55::DOUBLE AS observer_confidence FROM rk JOIN rest USING (interaction_id, turn_number) GROUP BY ALL"
    )


# --- few-shot examples

EXAMPLES = """ex AS (
  SELECT substr(interaction_id, 3)::BIGINT * 1000000 + pos AS seq, * FROM hinted WHERE has_hint)"""


def _round_robin(examples: str, targets: str, n: int) -> str:
    return f"""rr AS (SELECT target, seq, rank FROM (
      SELECT target, seq, row_number() OVER (PARTITION BY target ORDER BY rn, bucket) AS rank FROM (
        SELECT t.interaction_id AS target, e.seq, e.{H} AS bucket,
          row_number() OVER (PARTITION BY t.interaction_id, e.{H} ORDER BY e.seq) AS rn
        FROM {targets} t JOIN {examples} e ON e.context_module = t.context_module AND e.interaction_id <> t.interaction_id))
      WHERE rank <= {n})"""


TARGETS = "targets AS (SELECT DISTINCT interaction_id, context_module FROM turns)"
PACK = """pack{n} AS (SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY context_module ORDER BY seq) <= {n})"""


def splits_sql(source: str, key: str, seed: int) -> str:
    return f"""splits AS (SELECT *, CASE WHEN r <= floor(n * 0.6) THEN 'train'
      WHEN r <= floor(n * 0.6) + floor(n * 0.2) THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || {key}), {key}) AS r, (count(*) OVER ())::DOUBLE AS n FROM {source}))"""


# --- prompts

HISTORY = f"""framed AS (
  SELECT *, list(struct_pack(t := turn_number, h := substr(human_input, 1, 300), a := substr(ai_response, 1, 300)))
    OVER (PARTITION BY interaction_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS history
  FROM turns),
prompted AS (
  SELECT *, 'interaction_id: ' || interaction_id || chr(10) || 'context_module: ' || context_module || chr(10)
    || 'turn_number: ' || turn_number || chr(10) || chr(10)
    || CASE WHEN coalesce(len(history), 0) > 0 THEN 'conversation_history:' || chr(10) || array_to_string(list_transform(history,
        lambda x: '[turn ' || x.t || '] Human: ' || x.h || chr(10) || '[turn ' || x.t || '] AI: ' || x.a), chr(10)) || chr(10) || chr(10) ELSE '' END
    || 'current_turn_human: ' || human_input || chr(10) || 'current_turn_ai: ' || ai_response || chr(10) AS prompt
  FROM framed)"""


def json_text(value: str) -> str:
    return f"to_json({value})::VARCHAR"


def _response_text() -> str:
    """The recorded response of a row of `resp`, built from the same digits."""
    h = f"CASE WHEN k = 2 THEN 'Robot' ELSE {H} END"
    head = "'{' || " + " || ".join(f"'\"{f}\": \"' || {v} || '\", '" for f, v in [(H, h), (D, D), (E, E), (S, S)])
    level = ", ".join(
        (f"CASE WHEN k <> 4 THEN '\"{f}\": \"' || l_{f} || '\"' END" if i == 1 else f"'\"{f}\": \"' || l_{f} || '\"'")
        for i, f in enumerate(FIELDS)
    )
    conf = f"'\"confidence\": {{' || concat_ws(', ', {level}) || '}}'"
    span = f"'{{\"text\": ' || {json_text('substr(human_input, 1, 40)')} || ', \"category\": \"quoted\"}}'"
    spans = f"'\"evidence_spans\": [' || CASE WHEN k = 3 THEN '' ELSE {span} END || ']'"
    number = "CASE k WHEN 5 THEN '1.2' WHEN 12 THEN 'true' ELSE '0.5' END"
    whole = f"({head} || {conf} || ', ' || {spans} || CASE WHEN k = 11 THEN ' ' ELSE ', ' END || '\"observer_notes\": \"noted\", \"observer_confidence\": ' || {number} || '}}')"
    return f"""CASE k WHEN 0 THEN '```json' || chr(10) || {whole} || chr(10) || '```'
      WHEN 1 THEN 'Here it is: ' || {whole} || ' Anything {{else}}?'
      WHEN 6 THEN {head} || {conf} || ', "evidence_spans": [{{"text": "cut'
      WHEN 7 THEN {head} || '"confidence": {{"judgment_holder": "hi'
      WHEN 8 THEN replace({whole}, '"', '“') WHEN 9 THEN 'I would rather not answer.' WHEN 10 THEN '[1, 2, 3]' ELSE {whole} END"""


# --- generation

def idx(key: str, size) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT % {size})"


def _generation() -> str:
    key = "('7:' || scenario_id || ':' || sample_index || '|"
    item = f"[p_name, p_brand][{idx(key + 'slot:item' + chr(39) + ')', 2)} + 1]"
    kind = f"[p_type, lower(p_type), 'plain'][{idx(key + 'slot:kind' + chr(39) + ')', 3)} + 1]"
    bp = idx(key + "blueprint" + chr(39) + ")", 2)

    def fill(t: str) -> str:
        t = _q(t)
        return f"replace(replace(replace(replace({t}, '{{{{', '{{'), '}}}}', '}}'), '{{item}}', slot_item), '{{kind}}', slot_kind)"

    def side(value, name, i):
        if not isinstance(value, list):
            return fill(value), "'-'"
        at = idx(key + f"{name}:{i}" + chr(39) + ")", len(value))
        return f"[{', '.join(fill(v) for v in value)}][{at} + 1]", f"({at})::VARCHAR"

    def turns_of(templates):
        texts, variants = [], []
        for i, (n, h, r) in enumerate(templates):
            ht, hv = side(h, "human_input", i)
            rt, rv = side(r, "ai_response", i)
            texts.append(f"'{n}/' || {ht} || '/' || {rt}")
            variants.append(f"{hv} || ',' || {rv}")
        return " || '|' || ".join(texts), " || '|' || ".join(variants)

    plain, short, long = turns_of(IN.PLAIN_TEMPLATES), turns_of(IN.BLUEPRINTS[0][1]), turns_of(IN.BLUEPRINTS[1][1])
    which = lambda i: f"CASE WHEN bp IS NULL THEN {plain[i]} WHEN bp = 0 THEN {short[i]} ELSE {long[i]} END"
    return f"""scen AS (SELECT *, 'part-' || p_partkey AS scenario_id, {ctx('p_size')} AS context_module FROM part),
plan AS (SELECT *, scenario_id || ':' || lpad(sample_index::VARCHAR, 3, '0') AS item_id,
    'demo-' || scenario_id || '-' || lpad(sample_index::VARCHAR, 3, '0') AS interaction_id
  FROM scen, unnest(range(3)) AS s(sample_index)),
chosen AS (SELECT *, {item} AS slot_item, {kind} AS slot_kind, CASE WHEN p_size % 3 = 0 THEN {bp} END AS bp FROM plan),
built AS (SELECT *, 'interactions/' || interaction_id || '.json' AS relative_path,
    CASE bp WHEN 0 THEN 'short' WHEN 1 THEN 'long' END AS blueprint_id,
    CASE WHEN bp = 1 THEN 3 ELSE 2 END AS turn_count, {which(0)} AS turns, {which(1)} AS variants,
    CASE WHEN bp = 1 THEN 'unknown_slot' END AS error,
    CASE WHEN bp = 1 THEN 'failed' ELSE 'accepted' END AS status, 'g-' || (p_partkey % 5) AS generation_run_id
  FROM chosen)"""


def _template_rows() -> str:
    """One VALUES row per turn template: kind of scenario, blueprint, position and texts."""
    groups = [("plain", None, IN.PLAIN_TEMPLATES), *[("other", b, t) for b, t in IN.BLUEPRINTS]]
    rows = []
    for kind, blueprint, templates in groups:
        for i, (number, human, _) in enumerate(templates):
            several = isinstance(human, list)
            rows.append(
                f"('{kind}', {_q(blueprint) if blueprint else 'NULL::VARCHAR'}, {i}, {number}, "
                f"{'NULL::VARCHAR' if several else _q(human)}, {len(human) if several else 0})"
            )
    return ", ".join(rows)


GEN = f"WITH {_generation()}"
GEN_RUNS = """gruns AS (SELECT generation_run_id, 600::BIGINT AS target_item_count, count(*) FILTER (status = 'accepted') AS accepted_count,
    count(*) FILTER (status <> 'accepted') AS failed_count, greatest(0, 600 - count(*))::BIGINT AS pending_count,
    count(*) FILTER (status = 'accepted') = 600 AS is_complete FROM built GROUP BY ALL),
glist AS (SELECT generation_run_id, accepted_count, failed_count, CASE WHEN is_complete THEN 'completed' ELSE 'partial' END AS status,
    '/data/' || generation_run_id AS dataset_root, '2026-01-0' || substr(generation_run_id, 3, 1) AS updated_at FROM gruns)"""

# --- catalog

LOG = """log AS (
  SELECT CASE WHEN o_orderkey % 100 < 3 THEN base ELSE base || '-retry-' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') END AS run_id,
    'i-' || (o_orderkey % 300) AS interaction_id, CASE WHEN o_orderkey % 7 <> 0 THEN 'd-' || (o_custkey % 3) END AS dataset_id,
    'dr-' || (o_custkey % 50) AS dataset_run_id,
    CASE WHEN o_orderkey % 2 = 0 THEN 'heuristic_baseline' ELSE 'fixture_hint' END AS track_name,
    '/in/' || o_orderkey AS input_path,
    CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'running' ELSE 'completed' END AS status,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS updated_at, o_orderkey AS seq, base
  FROM (SELECT *, 'r-' || (o_custkey % 20) AS base FROM orders)),
runs AS (SELECT *, created FROM (SELECT *, min(updated_at) OVER (PARTITION BY run_id) AS created,
    row_number() OVER (PARTITION BY run_id ORDER BY updated_at DESC, seq DESC) AS r FROM log) WHERE r = 1),
ditems AS (SELECT 'd-' || (c_custkey % 4) AS dataset_id, 'i-' || (c_custkey % 350) AS interaction_id,
    min(c_mktsegment) AS scenario_id, min(c_name) AS blueprint_id FROM customer GROUP BY ALL),
joined AS (SELECT r.*, d.scenario_id AS catalog_scenario_id, d.blueprint_id AS catalog_blueprint_id FROM runs r
  LEFT JOIN ditems d ON d.interaction_id = r.interaction_id AND (r.dataset_id IS NULL OR d.dataset_id = r.dataset_id))"""

DRUNS = """druns AS (SELECT dataset_run_id, count(*) AS item_count, count(*) FILTER (status = 'completed') AS completed_count,
    count(*) FILTER (status = 'failed') AS failed_count,
    CASE WHEN count(*) = 0 THEN 'no_items_matched' WHEN count(*) FILTER (status = 'failed') = 0 THEN 'completed'
      WHEN count(*) FILTER (status = 'completed') = 0 THEN 'failed' ELSE 'partial' END AS status,
    max(updated_at) AS updated_at FROM log GROUP BY ALL)"""

STORED = f"""marked0 AS (SELECT t.*, {dg(0, 4, md5('stored', 'interaction_id', 'turn_number'))} <> 0
    AND {dg(1, 4, md5('stored', 'interaction_id', 'turn_number'))} <> 0 AS reusable FROM turns t),
marked AS (SELECT *, reusable OR {dg(0, 3, md5('done', 'interaction_id', 'turn_number'))} <> 0 AS done FROM marked0)"""

_gap = dg(0, 5, md5("gap", "interaction_id", "to_turn"))
_case = lambda prefix, key, n: dg(0, n, md5(prefix, key))
_js = "('{\"human_input\":' || to_json(text)::VARCHAR || '}')"

ORACLE: dict[str, str] = {
    "turns_from_chat": f"{BASE} SELECT * FROM turns",
    "rule_states": f"""{WITH_RULES} SELECT interaction_id, context_module, turn_number, {', '.join(FIELDS)}, observer_confidence,
      observer_notes, 'low|low|low|low' AS levels, categories, substr(human_input, 1, 160) AS span_text FROM rules""",
    "rule_states_on_documents": f"""SELECT interaction_id, {', '.join(FIELDS)}, observer_confidence
      FROM {rules_sql("(SELECT doc_id::VARCHAR AS interaction_id, text FROM documents)", 'text')}""",
    "hint_states": f"""{WITH_HINTS} SELECT interaction_id, turn_number, '{IN.RUN_CLOCK}' AS timestamp,
      {cols('CASE WHEN has_hint THEN @ END AS @')}, context_module, CASE WHEN has_hint THEN {LEVEL_TEXT} END AS levels,
      CASE WHEN context_module <> 'general' THEN 'hint' END AS extension, CASE WHEN NOT has_hint THEN 'missing_hint' END AS error FROM hinted""",
    "overlay_rows": f"""{WITH_RULES} SELECT interaction_id, turn_number, 'heuristic_baseline' AS track_id, 'rule-based' AS model_id,
      'heuristic-v1' AS prompt_version, {H}, observer_confidence, observer_notes, len(string_split(categories, '|')) AS spans FROM rules""",
    "extract_rows": f"""{WITH_RULES} SELECT interaction_id, turn_number, 'heuristic_baseline' AS track_name, context_module,
      md5(human_input) AS human_md5, md5(ai_response) AS reply_md5, {S}, 'rule-based' AS model_id,
      len(string_split(categories, '|')) AS spans, '{IN.RUN_CLOCK}' AS stored_at FROM rules""",
    "state_deltas": f"{WITH_DELTAS} SELECT * EXCLUDE (pos), NULL::VARCHAR AS error FROM deltas",
    "delta_profile": f"""{WITH_DELTAS} SELECT interaction_id, count(*) AS deltas, {cols('round(avg(delta_@), 9) AS mean_@')},
      count(*) FILTER (delta_{H} IS NULL) AS undefined_holder FROM deltas GROUP BY ALL""",
    "event_deltas": """SELECT user_id, from_event_id, event_id AS to_event_id, (o - po) / 2.0::DOUBLE AS delta FROM (
      SELECT *, lag(event_id) OVER w AS from_event_id, lag(o) OVER w AS po FROM (
        SELECT *, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS o FROM events)
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE from_event_id IS NOT NULL""",
    "trajectory_continuity": f"""{WITH_DELTAS}, {INTER}, kept AS (SELECT * FROM deltas WHERE {_gap} <> 0),
      seen AS (SELECT *, CASE WHEN from_turn >= to_turn THEN 'non_increasing'
        WHEN from_turn <> lag(to_turn) OVER (PARTITION BY interaction_id ORDER BY pos) THEN 'broken' END AS problem FROM kept),
      worst AS (SELECT interaction_id, count(*) AS vectors, arg_min(problem, pos) FILTER (problem IS NOT NULL) AS problem FROM seen GROUP BY ALL)
      SELECT interaction_id, coalesce(vectors, 0) AS vectors, CASE WHEN vectors IS NULL THEN 'empty' ELSE problem END AS problem
      FROM inter LEFT JOIN worst USING (interaction_id)""",
    "trajectory_nested": f"""{WITH_DELTAS} SELECT interaction_id, 0 AS part, count(*) AS vectors,
      string_agg(from_turn || ':' || to_turn || ':' || coalesce(delta_{E}::VARCHAR, '-'), '|' ORDER BY pos) AS steps,
      '' AS violations FROM deltas GROUP BY interaction_id""",
    "contract_violations": f"""{BASE}, {INTER}, spoilt AS (SELECT *, {dg(0, 16)} = 0 AS neg, {dg(1, 16)} = 0 AS gone
        FROM (SELECT *, {md5('bad', 'interaction_id', 'turn_number')} AS d FROM turns)),
      agg AS (SELECT interaction_id, count(*) AS n, bool_or(neg) AS neg, bool_or(gone) AS gone FROM spoilt GROUP BY ALL)
      SELECT interaction_id, coalesce(n, 0) AS turn_count, concat_ws('|', CASE WHEN context_module = 'travel' THEN 'context_module_unknown' END,
        CASE WHEN human_id = '' THEN 'human_id_empty' END, CASE WHEN coalesce(n, 0) < 2 THEN 'too_few_turns' END,
        CASE WHEN neg THEN 'turn_number_negative' END, CASE WHEN gone THEN 'human_input_missing' END) AS violations
      FROM inter LEFT JOIN agg USING (interaction_id)""",
    "document_contract": f"""WITH q AS (SELECT *, {md5('json', 'doc_id')} AS d, len(string_split(text, chr(10))) AS k FROM documents)
      SELECT 'doc-' || doc_id AS interaction_id, ceil(k / 2.0)::BIGINT AS turn_count, concat_ws('|',
        CASE WHEN {dg(2, 16)} = 0 THEN 'context_module_unknown' END, CASE WHEN {dg(3, 16)} = 0 THEN 'human_id_empty' END,
        CASE WHEN ceil(k / 2.0) < 2 THEN 'too_few_turns' END, CASE WHEN {dg(0, 16)} = 0 THEN 'turn_number_negative' END,
        CASE WHEN {dg(1, 16)} = 0 OR {dg(4, 16)} = 0 THEN 'unknown_key' END) AS violations FROM q""",
    "state_contract": f"""{WITH_HINTS}, q AS (SELECT *, {md5('state', 'interaction_id', 'turn_number')} AS e FROM hinted)
      SELECT interaction_id, turn_number, concat_ws('|', CASE WHEN {dg(0, 8, 'e')} = 0 THEN 'timestamp_invalid' END,
        CASE WHEN context_module <> 'general' AND {dg(1, 4, 'e')} = 0 THEN 'extensions_missing' END,
        {cols("CASE WHEN NOT has_hint THEN 'invalid_@' END")}) AS violations FROM q""",
    "delta_contract": f"""{WITH_DELTAS}, q AS (SELECT *, {md5('scale', 'interaction_id', 'to_turn')} AS d FROM deltas)
      SELECT interaction_id, from_turn, to_turn, concat_ws('|',
        CASE WHEN {dg(0, 4)} = 0 AND abs(delta_{E}) * 3 > 1 THEN 'delta_{E}_out_of_range' END,
        CASE WHEN {dg(0, 4)} = 1 THEN 'delta_{E}_missing' END) AS violations FROM q""",
    "overlay_contract": f"""{WITH_RULES}, q AS (SELECT *, {md5('overlay', 'interaction_id', 'turn_number')} AS d FROM rules)
      SELECT interaction_id, turn_number, concat_ws('|', CASE WHEN human_input = '' THEN 'span_text_empty' END,
        CASE WHEN {dg(1, 8)} = 0 THEN 'span_category_empty' END,
        CASE WHEN {dg(0, 8)} = 0 THEN 'observer_confidence_out_of_range' END) AS violations FROM q""",
    "first_error_per_interaction": f"""{WITH_HINTS} SELECT interaction_id, 'missing_hint' AS error, min(pos) AS pos, count(*) AS failed_turns
      FROM hinted WHERE NOT has_hint GROUP BY ALL""",
    "all_or_nothing": f"""{WITH_HINTS} SELECT interaction_id, turn_number, {', '.join(FIELDS)} FROM hinted
      WHERE interaction_id NOT IN (SELECT interaction_id FROM hinted WHERE NOT has_hint)""",
    "extraction_outcome": f"""{BASE}, {INTER}, agg AS (SELECT interaction_id, count(*) AS n FROM turns GROUP BY ALL),
      q AS (SELECT interaction_id, coalesce(n, 0) AS n, concat_ws(',', CASE WHEN context_module = 'travel' THEN 'context_module_unknown' END,
        CASE WHEN human_id = '' THEN 'human_id_empty' END, CASE WHEN coalesce(n, 0) < 2 THEN 'too_few_turns' END) AS v,
        coalesce(context_module, 'general') <> 'general' AS bare FROM inter LEFT JOIN agg USING (interaction_id)),
      e AS (SELECT *, CASE WHEN v <> '' THEN 'contract:' || v WHEN bare THEN 'state:extensions_missing' END AS error FROM q)
      SELECT interaction_id, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, CASE WHEN error IS NULL THEN n ELSE 0 END AS state_count,
        CASE WHEN error IS NULL THEN n - 1 ELSE 0 END AS delta_count, error FROM e""",
    "history_frame": f"""{BASE}, {HISTORY} SELECT interaction_id, turn_number, pos AS context_turn_count,
      coalesce(array_to_string(list_transform(history, lambda x: x.t::VARCHAR), '|'), '') AS history_turns,
      md5(coalesce(array_to_string(list_transform(history, lambda x: x.h || '/' || x.a), '|'), '')) AS history_md5 FROM framed""",
    "observer_prompt": f"{BASE}, {HISTORY} SELECT interaction_id, turn_number, length(prompt) AS prompt_length, md5(prompt) AS prompt_md5 FROM prompted",
    "response_normalise": f"""{WITH_RESP} SELECT model_id, interaction_id, turn_number, attempt, reason,
      {cols('CASE WHEN reason IS NULL THEN @ END AS @')}, CASE WHEN reason IS NULL THEN {LEVEL_TEXT} END AS levels,
      CASE WHEN reason IS NULL THEN CASE k WHEN 6 THEN 'salvaged_evidence'
        WHEN 11 THEN trim(replace(substr(human_input, 1, 40), chr(10), '\\n'), ' ') ELSE substr(human_input, 1, 40) END END AS span_text,
      CASE WHEN reason IS NULL THEN CASE WHEN k = 6 THEN 'salvaged_evidence' ELSE 'quoted' END END AS span_category,
      CASE WHEN reason IS NULL THEN CASE WHEN k = 6 THEN '' ELSE 'noted' END END AS observer_notes,
      CASE WHEN reason IS NULL THEN CASE k WHEN 6 THEN NULL WHEN 12 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END END AS observer_confidence, salvaged FROM resp""",
    "response_first_valid": f"""{WITH_RESP} SELECT model_id, interaction_id, turn_number, f.attempt, m.{H}, tried,
      CASE WHEN f.attempt IS NULL THEN last_reason END AS error FROM firsts f LEFT JOIN model_labels m USING (model_id, interaction_id, turn_number)""",
    "response_fallback_lookup": f"""{WITH_RESP}, texts AS (SELECT interaction_id, turn_number, {_response_text()} AS t FROM resp
        WHERE model_id = 'model-a' AND attempt = 0 AND {dg(0, 3, md5('known', 'interaction_id', 'turn_number'))} = 0),
      by_n AS (SELECT turn_number, 'turn response ' || turn_number || ' of ' || count(*) AS t FROM turns WHERE turn_number % 2 = 0 GROUP BY turn_number)
      SELECT t.interaction_id, t.turn_number, CASE WHEN x.t IS NOT NULL THEN 'key' WHEN b.t IS NOT NULL THEN 'turn' ELSE 'default' END AS response_source,
        md5(coalesce(x.t, b.t, 'default response')) AS response_md5
      FROM turns t LEFT JOIN texts x USING (interaction_id, turn_number) LEFT JOIN by_n b ON b.turn_number = t.turn_number""",
    "observer_label_rows": f"""{WITH_RESP} SELECT interaction_id, turn_number, 'llm_observer' AS track_name, 'model-b' AS model_id,
      {cols('m.@')}, CASE m.k WHEN 6 THEN NULL WHEN 12 THEN 1.0::DOUBLE ELSE CASE WHEN m.k IS NOT NULL THEN 0.5::DOUBLE END END AS observer_confidence,
      CASE WHEN f.attempt IS NULL THEN last_reason END AS error, tried AS attempts
      FROM (SELECT * FROM firsts WHERE model_id = 'model-b') f LEFT JOIN model_labels m USING (model_id, interaction_id, turn_number)""",
    "repair_worklist": f"""{WITH_RESP}, {HISTORY}, lasts AS (SELECT model_id, interaction_id, turn_number, {_response_text()} AS t FROM resp WHERE attempt = 2)
      SELECT model_id, interaction_id, turn_number, 3 AS next_attempt,
        md5(prompt || chr(10) || replace({_q(P.REPAIR_TEXT.replace(chr(10), '~'))}, '~', chr(10)) || t || chr(10)) AS prompt_md5
      FROM firsts JOIN lasts USING (model_id, interaction_id, turn_number) JOIN prompted USING (interaction_id, turn_number) WHERE firsts.attempt IS NULL""",
    "response_objects": f"""WITH q AS (SELECT doc_id, text, {_case('gen', 'doc_id', 8)} AS k FROM documents)
      SELECT doc_id, k NOT IN (3, 4, 5) AS found, CASE WHEN k NOT IN (0, 3, 4, 5) THEN md5(text) WHEN k = 0 THEN md5(text) END AS value_md5 FROM q""",
    "response_scalar": f"""SELECT doc_id, CASE WHEN {_case('gen', 'doc_id', 8)} <> 5 THEN md5(text) END AS value_md5 FROM documents""",
    "response_shape": f"""WITH q AS (SELECT doc_id, text, {_case('shape', 'doc_id', 8)} AS k FROM documents)
      SELECT doc_id, CASE k WHEN 0 THEN 'turn_list_invalid' WHEN 1 THEN 'turn_numbering' WHEN 2 THEN 'human_input_empty'
        WHEN 3 THEN 'ai_response_empty' ELSE '' END AS violations FROM q""",
    "turn_guidance": f"""{WITH_HINTS} SELECT interaction_id, turn_number,
      CASE WHEN has_hint AND {H} = 'AI' THEN {_q(P.GUIDANCE['AI'][0])} WHEN has_hint AND {H} = 'Shared' THEN {_q(P.GUIDANCE['Shared'][0])} ELSE {_q(P.GUIDANCE['Human'][0])} END AS human_guidance,
      CASE WHEN has_hint AND {H} = 'AI' THEN {_q(P.GUIDANCE['AI'][1])} WHEN has_hint AND {H} = 'Shared' THEN {_q(P.GUIDANCE['Shared'][1])} ELSE {_q(P.GUIDANCE['Human'][1])} END AS assistant_guidance FROM hinted""",
    "turn_comparison": f"""{WITH_CMP} SELECT interaction_id, turn_number, present, runs_present,
      array_to_string(list_filter({_list(IN.RUNS)}, lambda x: NOT list_contains(string_split(runs_present, '|'), x)), '|') AS runs_missing,
      concat_ws('|', {cols("CASE WHEN differs_@ = 1 THEN '@' END")}) AS disagreement_fields,
      ({cols('differs_@', ' + ')}) / 4.0::DOUBLE AS disagreement_score FROM by_turn""",
    "ensemble_majority": f"""{WITH_CMP}, {', '.join(_majority(v, a) for v, a in ENSEMBLE_PARTS)}
      SELECT interaction_id, turn_number, {', '.join(a for _, a in ENSEMBLE_PARTS)} FROM by_turn
      {' '.join(f'JOIN {a}_t USING (interaction_id, turn_number)' for _, a in ENSEMBLE_PARTS)} WHERE present >= 2""",
    "run_values": f"""{WITH_CMP} SELECT interaction_id, turn_number,
      string_agg(run_key || ',' || {cols('@', " || ',' || ")}, '|' ORDER BY run_key) AS run_values FROM compared GROUP BY ALL""",
    "disagreement_summary": f"{WITH_CMP} SELECT interaction_id, turns_compared, turns_total, turns_skipped, {RATE('rate')}, {RATES} FROM summary",
    "disagreement_breakdown": f"""{WITH_CMP}, long AS (
        SELECT 'scenario_id' AS scope, scenario_id AS "group", * FROM items UNION ALL SELECT 'context_module', context_module, * FROM items
        UNION ALL SELECT 'overall', 'all', * FROM items)
      SELECT scope, "group", count(*) AS item_count, round(avg(rate), 9) AS average_rate, round(avg(example_count), 9) AS average_example_count,
        {cols('round(avg(rate_@), 9) AS average_rate_@')} FROM long GROUP BY scope, "group" """,
    "benchmark_overall": f"""{WITH_CMP} SELECT count(*) AS item_count, round(coalesce(avg(example_count), 0), 9) AS average_example_count,
      round(coalesce(avg(rate), 0), 9) AS average_rate, round(coalesce(min(rate), 0), 9) AS min_rate, round(coalesce(max(rate), 0), 9) AS max_rate,
      count(*) FILTER (rate = 0) AS zero_disagreement_items, {cols('round(coalesce(avg(rate_@), 0), 9) AS average_rate_@')} FROM items""",
    "threshold_gate": f"""{WITH_CMP} SELECT metric, round(value, 9) AS value, 0.75::DOUBLE AS "limit", NOT (value > 0.75) AS passed FROM (
      SELECT 'average_field_disagreement_rate' AS metric, coalesce(avg(rate), 0) AS value FROM items
      UNION ALL SELECT 'max_field_disagreement_rate', coalesce(max(rate), 0) FROM items)""",
    "matrix_pairs": f"{WITH_CMP}, {PAIRS} SELECT label, interaction_id, turns_compared, {RATE('rate')}, {RATES} FROM pairs",
    "matrix_vs_baseline": f"""{WITH_CMP}, {PAIRS} SELECT label, count(*) AS item_count, round(avg(rate), 9) AS average_rate,
      round(max(rate), 9) AS max_rate FROM pairs GROUP BY ALL""",
    "matrix_run_list": f"""{WITH_CMP} SELECT DISTINCT interaction_id, '/runs/' || run_key AS run_dir, run_key <> 'rules' AS later,
      list_position({_list(IN.RUNS)}, run_key)::BIGINT AS position FROM compared""",
    "comparison_identity_check": f"""{WITH_CMP} SELECT turn_number AS comparison_id, count(DISTINCT interaction_id) AS interactions,
      CASE WHEN count(DISTINCT interaction_id) <> 1 THEN 'mixed_interactions' END AS error FROM compared GROUP BY ALL""",
    "model_pair_sample": f"""{WITH_CMP}, sampled AS (SELECT interaction_id FROM (SELECT DISTINCT interaction_id FROM turns) ORDER BY md5('42:' || interaction_id) LIMIT 30),
      bt AS (SELECT interaction_id, turn_number, count(*) AS present, {', '.join(f'(count(DISTINCT {f}) > 1)::INT AS differs_{f}' for f in FIELDS)}
        FROM compared WHERE run_key IN ('model-a', 'hints') AND interaction_id IN (SELECT * FROM sampled) GROUP BY ALL),
      per AS (SELECT interaction_id, coalesce(sum({cols('differs_@', ' + ')}) FILTER (present >= 2) / nullif(4.0::DOUBLE * count(*) FILTER (present >= 2), 0), 0) AS rate,
        {cols('coalesce(sum(differs_@) FILTER (present >= 2) / nullif(count(*) FILTER (present >= 2), 0)::DOUBLE, 0) AS rate_@')} FROM bt GROUP BY ALL)
      SELECT count(*) AS item_count, 0.0::DOUBLE AS average_example_count, round(coalesce(avg(rate), 0), 9) AS average_rate,
        round(coalesce(min(rate), 0), 9) AS min_rate, round(coalesce(max(rate), 0), 9) AS max_rate, count(*) FILTER (rate = 0) AS zero_disagreement_items,
        {cols('round(coalesce(avg(rate_@), 0), 9) AS average_rate_@')} FROM per""",
    "regression_top_fields": f"""{WITH_CMP} SELECT field, round(rate, 9) AS rate FROM (
      {' UNION ALL '.join(f"SELECT '{f}' AS field, coalesce(avg(rate_{f}), 0) AS rate FROM items" for f in FIELDS)}) ORDER BY rate DESC, field LIMIT 3""",
    "regression_top_items": f"{WITH_CMP} SELECT interaction_id, scenario_id, round(rate, 9) AS rate FROM items ORDER BY items.rate DESC, interaction_id LIMIT 3",
    "token_profile": f"""WITH q AS (SELECT doc_id, {DOC_TOKENS} AS w, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM documents)
      SELECT doc_id, len(w) AS tokens, round(len(list_distinct(w)) / nullif(len(w), 0)::DOUBLE, 9) AS diversity, array_to_string(w[1:4], ' ') AS first_tokens,
        length(s) AS stripped_length, md5(substr(s, 1, 160)) AS excerpt_md5 FROM q""",
    "nb_train": f"WITH {NB} SELECT field, label, token, cnt FROM tok",
    "nb_classes": f"WITH {NB} SELECT field, label, doc_count, total_tokens, first_seq, vocabulary_size FROM cls JOIN voc USING (field)",
    "nb_score": f"""WITH {NB_SCORE} SELECT doc_id, field, token_count, label, round(round(coalesce(score - next_score, 1.0), 9), 4) AS margin,
      {level_of('round(coalesce(score - next_score, 1.0), 9)')} AS level FROM rk WHERE r = 1""",
    "nb_turn_labels": _turn_nb(),
    "nb_model_fields": f"SELECT array_to_string(list_sort({_list(FIELDS)}), '|') AS missing, false AS untrained",
    "fewshot_pack": f"""{WITH_HINTS}, {EXAMPLES}, {PACK.format(n=8)} SELECT 'run-' || context_module AS pack_id, seq, interaction_id, turn_number, context_module,
      md5(human_input) AS human_md5, {H}, 1 AS spans, 'Canonical fixture hint' AS observer_notes FROM pack8""",
    "fewshot_round_robin": f"""{WITH_HINTS}, {EXAMPLES}, {TARGETS}, {_round_robin('ex', 'targets', 5)}
      SELECT target AS interaction_id, rank, ex.interaction_id AS example_id, ex.turn_number AS example_turn FROM rr JOIN ex USING (seq)""",
    "fewshot_plan": f"""{WITH_HINTS}, {EXAMPLES}, {TARGETS}, {PACK.format(n=1)}, {splits_sql('targets', 'interaction_id', 8)}, {_round_robin('pack1', 'targets', 3)}
      SELECT s.interaction_id, s.context_module, s.split, count(rr.seq) AS example_count, count(rr.seq) = 0 AS zero_shot_fallback
      FROM splits s LEFT JOIN rr ON rr.target = s.interaction_id WHERE s.split = 'train' GROUP BY ALL""",
    "fewshot_prompts": f"""{WITH_HINTS}, {EXAMPLES}, {TARGETS}, {PACK.format(n=8)}, {_round_robin('pack8', 'targets', 8)}, {HISTORY},
      lines AS (SELECT target, string_agg('{{"input": {{"interaction_id": ' || {json_text('interaction_id')} || ', "turn_number": ' || turn_number
          || ', "context_module": ' || {json_text('context_module')} || ', "human_input": ' || {json_text('human_input')} || ', "ai_response": ' || {json_text('ai_response')}
          || '}}, "output": {{' || {cols("""'"@": "' || @ || '", '""", ' || ')} || '"confidence": {{' || {cols("""'"@": "' || l_@ || '"'""", " || ', ' || ")}
          || '}}, "evidence_spans": [{{"text": ' || {json_text('substr(human_input, 1, 160)')} || ', "category": "fixture_hint_source"}}], "observer_notes": "Canonical fixture hint"}}}}',
          chr(10) ORDER BY rank) AS block FROM rr JOIN ex USING (seq) GROUP BY ALL),
      texts AS (SELECT interaction_id, turn_number, 'fewshot_pack_id: pack-1' || chr(10) || 'fewshot_examples:' || chr(10) || coalesce(block, '')
        || chr(10) || chr(10) || 'target_turn:' || chr(10) || prompt AS t FROM prompted LEFT JOIN lines ON lines.target = prompted.interaction_id)
      SELECT interaction_id, turn_number, length(t) AS prompt_length, md5(t) AS prompt_md5 FROM texts""",
    "quality_gate_reasons": f"""{WITH_HINTS}, {INTER}, q AS (SELECT interaction_id, CASE WHEN has_hint THEN {H} ELSE '' END AS holder,
        regexp_replace(CASE {dg(0, 8, 'e')} WHEN 0 THEN human_input || ' Just decide' WHEN 1 THEN 'What would you pick?' ELSE human_input END, '^\\s+|\\s+$', '', 'g') AS h,
        regexp_replace(CASE WHEN {dg(0, 8, 'e')} = 1 THEN 'As an AI I cannot.' ELSE ai_response END, '^\\s+|\\s+$', '', 'g') AS a
        FROM (SELECT *, {md5('say', 'interaction_id', 'turn_number')} AS e FROM hinted)),
      agg AS (SELECT interaction_id, flatten(list(list_concat(regexp_extract_all(lower(h), '[a-z0-9'']+'), regexp_extract_all(lower(a), '[a-z0-9'']+')))) AS w,
        bool_or(regexp_matches(lower(h), '(as an ai|language model|i cannot|i can''t provide)') OR regexp_matches(lower(a), '(as an ai|language model|i cannot|i can''t provide)')) AS meta,
        bool_or(holder = 'AI' AND NOT regexp_matches(lower(h), '(recommend|choose|pick|what would you|your recommendation|just tell me|if you had to pick)')) AS weak,
        bool_or(holder = 'Human' AND regexp_matches(lower(h), '(just decide|you choose|pick for me)')) AS over,
        count(*) > count(DISTINCT lower(h || ' || ' || a)) AS dup FROM q GROUP BY ALL)
      SELECT interaction_id, coalesce(len(w), 0) AS token_count, coalesce(len(list_distinct(w)), 0) AS distinct_tokens,
        CASE WHEN w IS NULL THEN 'missing_turns' ELSE concat_ws('|', CASE WHEN dup THEN 'duplicate_turn_pair' END, CASE WHEN over THEN 'human_turn_overdelegates' END,
          CASE WHEN len(w) > 0 AND len(list_distinct(w)) / len(w)::DOUBLE < 0.32 THEN 'low_lexical_diversity' END, CASE WHEN meta THEN 'meta_ai_phrase' END,
          CASE WHEN len(w) < 30 THEN 'too_short_tokens' END, CASE WHEN weak THEN 'weak_ai_delegation_signal' END) END AS reasons
      FROM inter LEFT JOIN agg USING (interaction_id)""",
    "template_generate": f"""{GEN} SELECT item_id, interaction_id, relative_path, blueprint_id, context_module, turn_count, slot_item, slot_kind, turns, variants, error FROM built""",
    "scenario_templates": f"""SELECT 'part-' || p_partkey AS scenario_id, blueprint_id, position, turn_number, human_input, human_options
      FROM part JOIN (VALUES {_template_rows()}) AS t(kind, blueprint_id, position, turn_number, human_input, human_options)
        ON kind = CASE WHEN p_size % 3 = 0 THEN 'other' ELSE 'plain' END""",
    "generation_items": f"""{GEN} SELECT item_id, scenario_id, sample_index, status, 1 AS attempt_count, error AS error_message,
      CASE WHEN error IS NULL THEN interaction_id END AS payload_id FROM built""",
    "generation_progress": f"{GEN}, {GEN_RUNS} SELECT * FROM gruns",
    "generation_pending": f"""{GEN}, known AS (SELECT item_id, status FROM built WHERE {dg(0, 4, md5('lost', 'item_id'))} <> 0),
      more AS (SELECT scenario_id || ':' || lpad(sample_index::VARCHAR, 3, '0') AS item_id, sample_index FROM scen, unnest(range(4)) AS s(sample_index))
      SELECT item_id, sample_index, CASE WHEN k.item_id IS NULL THEN 1 ELSE 2 END AS attempt_count FROM more LEFT JOIN known k USING (item_id)
      WHERE coalesce(k.status, '') <> 'accepted'""",
    "split_assign": f"WITH o AS (SELECT 'o-' || o_orderkey AS id, * FROM orders), {splits_sql('o', 'id', 8)} SELECT id AS interaction_id, split FROM splits",
    "split_counts": f"WITH o AS (SELECT 'o-' || o_orderkey AS id, * FROM orders), {splits_sql('o', 'id', 8)} SELECT split, count(*) AS item_count FROM splits GROUP BY ALL",
    "split_slice_counts": f"""WITH o AS (SELECT 'o-' || o_orderkey AS id, * FROM orders), {splits_sql('o', 'id', 8)}
      SELECT o_orderpriority, count(*) AS item_count FROM splits WHERE split = 'validation' GROUP BY ALL""",
    "dataset_preview": f"""{BASE} SELECT interaction_id, substr(interaction_id, 3)::BIGINT AS seq, count(*) AS turn_count, 0 AS part,
      md5(string_agg(concat_ws('/', turn_number::VARCHAR, human_input, ai_response), '|' ORDER BY pos)) AS turns_md5
      FROM turns GROUP BY interaction_id ORDER BY seq LIMIT 6""",
    "upsert_latest": f"WITH {LOG} SELECT run_id, interaction_id, dataset_id, status, created AS created_at, updated_at, seq FROM runs",
    "fetch_run": f"WITH {LOG} SELECT run_id, status, updated_at, seq FROM runs WHERE run_id = 'r-7'",
    "runs_left_join_items": f"WITH {LOG} SELECT run_id, interaction_id, dataset_id, catalog_scenario_id, catalog_blueprint_id FROM joined",
    "runs_by_scenario": f"""WITH {LOG} SELECT coalesce(catalog_scenario_id, 'unknown') AS scenario_id, status, count(*) AS run_count
      FROM joined GROUP BY ALL ORDER BY run_count DESC, scenario_id""",
    "runs_topk": f"""WITH {LOG} SELECT run_id, updated_at, catalog_scenario_id FROM joined WHERE status = 'failed' AND track_name = 'heuristic_baseline'
      ORDER BY updated_at DESC, run_id, catalog_scenario_id NULLS FIRST, catalog_blueprint_id NULLS FIRST LIMIT 20""",
    "dataset_run_counts": f"WITH {LOG}, {DRUNS} SELECT * EXCLUDE (updated_at) FROM druns",
    "dataset_runs_list": f"WITH {LOG}, {DRUNS} SELECT * FROM druns WHERE status = 'partial' ORDER BY updated_at DESC, dataset_run_id LIMIT 15",
    "run_status": """SELECT c_custkey, CASE WHEN i = 0 THEN 'no_items_matched' WHEN f = 0 THEN 'completed' WHEN c = 0 THEN 'failed' ELSE 'partial' END AS status
      FROM (SELECT c_custkey, c_custkey % 4 AS i, c_custkey % 3 AS c, greatest(c_custkey % 4 - c_custkey % 3, 0) AS f FROM customer)""",
    "run_identity_hash": """SELECT c_custkey, 'dsr-' || CASE WHEN c_custkey % 5 = 0 THEN 'run' ELSE 'heuristic_baseline' END
        || CASE WHEN c_custkey % 3 = 0 THEN '-train' ELSE '' END || '-' || substr(sha256(concat_ws(':', '/out/' || c_mktsegment,
          CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'heuristic_baseline' END, CASE WHEN c_custkey % 3 = 0 THEN 'train' END,
          CASE WHEN c_custkey % 4 = 0 THEN 'scenario=' || c_name END, CASE WHEN c_custkey % 2 = 0 THEN 'max=' || (c_custkey % 10) END)), 1, 12) AS dataset_run_id,
      concat_ws('::', '/out/' || c_mktsegment, 'template', CASE WHEN c_custkey % 2 = 0 THEN 'seed=' || (c_custkey % 10) END,
        CASE WHEN c_custkey % 3 = 0 THEN 'count=' || (c_custkey % 7) END) AS generation_run_id FROM customer""",
    "generation_item_list": f"""{GEN} SELECT generation_run_id, item_id, scenario_id, sample_index, status FROM built
      WHERE generation_run_id = 'g-2' ORDER BY scenario_id, sample_index""",
    "generation_failed_items": f"""{GEN} SELECT item_id, scenario_id, sample_index, status, error AS error_message FROM built
      WHERE generation_run_id = 'g-2' AND status IN ('failed', 'rejected') ORDER BY scenario_id, sample_index LIMIT 12""",
    "generation_runs_list": f"{GEN}, {GEN_RUNS} SELECT * FROM glist WHERE status = 'partial' ORDER BY updated_at DESC, generation_run_id LIMIT 3",
    "generation_partial_report": f"""{GEN}, {GEN_RUNS}, f AS (SELECT * FROM built WHERE generation_run_id = 'g-2' AND status IN ('failed', 'rejected')
        ORDER BY scenario_id, sample_index LIMIT 10)
      SELECT generation_run_id, g.status, accepted_count, failed_count, dataset_root,
        (SELECT string_agg(item_id, '|' ORDER BY scenario_id, sample_index) FROM f) AS failed_items FROM glist g WHERE generation_run_id = 'g-2'""",
    "completed_run_items": f"""WITH {LOG} SELECT dataset_run_id, interaction_id, run_id, seq FROM log WHERE status = 'completed'
      QUALIFY row_number() OVER (PARTITION BY dataset_run_id, interaction_id ORDER BY seq DESC) = 1""",
    "retry_ids": f"""WITH RECURSIVE {LOG}, used AS (SELECT base, list(DISTINCT substr(run_id, length(base) + 8)::BIGINT) AS u FROM runs
        WHERE run_id <> base GROUP BY base),
      failing AS (SELECT run_id, base, row_number() OVER (ORDER BY updated_at DESC, run_id) AS position FROM runs WHERE status = 'failed'),
      ordered AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY position) AS k FROM failing),
      walk(base, k, run_id, position, slot) AS (
        SELECT o.base, o.k, o.run_id, o.position, list_filter(range(o.position, o.position + 200), lambda x: NOT list_contains(coalesce(u, []), x))[1]
        FROM ordered o LEFT JOIN used USING (base) WHERE k = 1
        UNION ALL SELECT o.base, o.k, o.run_id, o.position,
          list_filter(range(greatest(o.position, w.slot + 1), greatest(o.position, w.slot + 1) + 200), lambda x: NOT list_contains(coalesce(u, []), x))[1]
        FROM walk w JOIN ordered o ON o.base = w.base AND o.k = w.k + 1 LEFT JOIN used ON used.base = o.base)
      SELECT run_id, position, base || '-retry-' || lpad(slot::VARCHAR, greatest(2, length(slot::VARCHAR))::INT, '0') AS retry_run_id FROM walk""",
    "retry_worklist": f"""WITH {LOG} SELECT row_number() OVER (ORDER BY updated_at DESC, run_id, catalog_scenario_id NULLS FIRST, catalog_blueprint_id NULLS FIRST) AS position,
      run_id AS original_run_id, run_id AS retry_run_id, track_name, input_path FROM joined WHERE status = 'failed' AND dataset_id = 'd-1'""",
    "matrix_plan": f"""{BASE}, {TARGETS}, {splits_sql('targets', 'interaction_id', 8)} SELECT label, track_name, interaction_id, params
      FROM splits, (VALUES ('zero', 'llm_observer', 1), ('rules', 'heuristic_baseline', 0)) AS c(label, track_name, params) WHERE split = 'train'""",
    "resume_reuse": f"{BASE}, {STORED} SELECT interaction_id, turn_number FROM marked WHERE reusable",
    "resume_redo": f"{BASE}, {STORED} SELECT interaction_id, turn_number FROM marked WHERE NOT reusable",
    "run_progress": f"""{BASE}, {STORED} SELECT interaction_id, count(*) AS total_turns, count(*) FILTER (done) AS completed_turns,
      count(*) FILTER (done AND reusable) AS resumed_count, count(*) FILTER (done AND NOT reusable) AS written_count,
      CASE WHEN bool_and(done) THEN 'completed' ELSE 'running' END AS status FROM marked GROUP BY ALL""",
    "progress_turns": f"""{BASE}, {STORED} SELECT interaction_id, 0 AS part,
      coalesce(string_agg(CASE WHEN done AND reusable THEN turn_number::VARCHAR END, '|' ORDER BY turn_number), '') AS resumed_turns,
      coalesce(string_agg(CASE WHEN done AND NOT reusable THEN turn_number::VARCHAR END, '|' ORDER BY turn_number), '') AS written_turns
      FROM marked GROUP BY interaction_id""",
}
ORACLE["event_delta_profile"] = f"""SELECT user_id, count(*) AS steps, count(delta) AS defined, round(avg(delta), 9) AS mean_delta
  FROM ({ORACLE['event_deltas']}) GROUP BY ALL"""
ORACLE["stream_event_deltas"] = ORACLE["event_deltas"]
ORACLE["stream_resume_labels"] = f"""{WITH_RULES}, {STORED}
  SELECT interaction_id, turn_number, {', '.join(f'r.{f}' for f in FIELDS)}, CASE WHEN reusable THEN 0 ELSE 1 END AS batch
  FROM rules r JOIN marked USING (interaction_id, turn_number)"""
# The next free index for every run of a base: running figures over used indexes and positions.
_slots = """slots AS (
  SELECT o.*, o.rank + coalesce(g.n, 0) AS slot FROM (
    SELECT *, k + max(position - below - k) OVER (PARTITION BY base ORDER BY position) AS rank FROM (
      SELECT f.*, coalesce(u.n, 0) AS below, row_number() OVER (PARTITION BY f.base ORDER BY f.position) AS k
      FROM failing f ASOF LEFT JOIN numbered u ON f.base = u.base AND f.position > u.u)) o
  ASOF LEFT JOIN (SELECT base, u - n + 1 AS gap, max(n) AS n FROM numbered GROUP BY ALL) g ON o.base = g.base AND o.rank >= g.gap)"""
_numbered = "numbered AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY u) AS n FROM used)"
_retry = "base || '-retry-' || lpad(slot::VARCHAR, greatest(2, length(slot::VARCHAR))::INT, '0') AS retry_run_id"
ORACLE["retry_ids_hot_base"] = f"""WITH all_runs AS (
    SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'r-hot' ELSE 'r-' || o_custkey END AS base,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS updated_at FROM orders),
  used AS (SELECT DISTINCT base, o_orderkey::BIGINT AS u FROM all_runs WHERE o_orderstatus <> 'F'), {_numbered},
  named AS (SELECT *, base || regexp_replace(lpad(o_orderkey::VARCHAR, 12, '0'), '(..)', '-retry-\\1', 'g') AS run_id
    FROM all_runs WHERE o_orderstatus = 'F'),
  failing AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC, run_id) AS position FROM named), {_slots}
  SELECT run_id, position, {_retry} FROM slots"""
ORACLE["retry_worklist_new_ids"] = f"""WITH {LOG},
  used AS (SELECT DISTINCT base, substr(run_id, length(base) + 8)::BIGINT AS u FROM runs WHERE run_id <> base), {_numbered},
  failing AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC, run_id, catalog_scenario_id NULLS FIRST, catalog_blueprint_id NULLS FIRST) AS position
    FROM joined WHERE status = 'failed' AND dataset_id = 'd-1'), {_slots}
  SELECT position, run_id AS original_run_id, {_retry}, track_name, input_path FROM slots"""


# --- evaluation against the embedded labels

VERSUS = f"""versus AS (SELECT c.run_key, c.interaction_id, c.turn_number, {', '.join(f'c.{f}, t.{f} AS true_{f}' for f in FIELDS)}
  FROM compared c JOIN compared t USING (interaction_id, turn_number) WHERE t.run_key = 'hints' AND c.run_key <> 'hints')"""
SAME = {f: f"CASE WHEN {f} IS NOT DISTINCT FROM true_{f} THEN 1 ELSE 0 END" for f in FIELDS}
SCORES = f"""scores AS (SELECT run_key, count(*) AS turns, {', '.join(f'avg({SAME[f]}) AS a_{f}' for f in FIELDS)} FROM versus GROUP BY ALL)"""
MEAN = "(" + " + ".join(f"a_{f}" for f in FIELDS) + ") / 4"
MATRIX = "matrix AS (" + " UNION ALL ".join(
    f"SELECT run_key, '{f}' AS field, true_{f} AS true_label, {f} AS label, count(*) AS turns FROM versus GROUP BY ALL" for f in FIELDS
) + ")"


def _vote(field: str) -> str:
    level = f"CASE coalesce(l_{field}, 'medium') WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END"
    return f"""v_{field} AS (SELECT interaction_id, turn_number, {field} FROM
      (SELECT interaction_id, turn_number, {field}, sum({level}) AS w FROM compared GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY interaction_id, turn_number ORDER BY w DESC, {field}) = 1)"""


def _distance(field: str) -> str:
    return f"round(avg(abs(({ordinal(field, field)}) - ({ordinal(field, 'true_' + field)})) / 2.0::DOUBLE), 9) AS distance_{field}"


# A state's contract asks for extensions outside the general context; these run in the general one.
OUTCOME = f"""{{}}, {INTER}, agg AS (SELECT interaction_id, count(*) AS n, {{}} AS wrong FROM {{}} GROUP BY ALL),
  q AS (SELECT interaction_id, coalesce(n, 0) AS n, coalesce(wrong, 0) AS wrong, concat_ws(',', CASE WHEN human_id = '' THEN 'human_id_empty' END,
    CASE WHEN coalesce(n, 0) < 2 THEN 'too_few_turns' END) AS v FROM inter LEFT JOIN agg USING (interaction_id)),
  outcome AS (SELECT *, CASE WHEN v <> '' THEN 'contract:' || v WHEN wrong > 0 THEN 'missing_hint' END AS error FROM q)"""

ORACLE |= {
    "hint_accuracy": f"""{WITH_CMP}, {VERSUS}, {SCORES} SELECT run_key, turns, {', '.join(f'round(a_{f}, 9) AS accuracy_{f}' for f in FIELDS)},
      round({MEAN}, 9) AS accuracy FROM scores""",
    "confusion_matrix": f"{WITH_CMP}, {VERSUS}, {MATRIX} SELECT * FROM matrix",
    "confusion_kappa": f"""{WITH_CMP}, {VERSUS}, {MATRIX}, r AS (SELECT run_key, field, true_label AS v, sum(turns) AS a FROM matrix GROUP BY ALL),
      c AS (SELECT run_key, field, label AS v, sum(turns) AS b FROM matrix GROUP BY ALL),
      e AS (SELECT run_key, field, sum(a::DOUBLE * b) AS chance FROM r JOIN c USING (run_key, field, v) GROUP BY ALL),
      t AS (SELECT run_key, field, sum(turns) AS n, coalesce(sum(turns) FILTER (WHERE true_label = label), 0) AS same FROM matrix GROUP BY ALL),
      k AS (SELECT run_key, field, n::BIGINT AS turns, same / n AS observed, coalesce(chance, 0) / n / n AS expected FROM t LEFT JOIN e USING (run_key, field))
      SELECT run_key, field, turns, round(observed, 9) AS observed, round(expected, 9) AS expected,
        round(CASE WHEN expected >= 1 THEN 1.0::DOUBLE ELSE (observed - expected) / (1 - expected) END, 9) AS kappa FROM k""",
    "bootstrap_ci": f"""{WITH_CMP}, {VERSUS}, items_b AS (SELECT run_key, interaction_id, sum({' + '.join(SAME.values())}) AS same, count(*) * 4 AS n
        FROM versus GROUP BY ALL),
      drawn AS (SELECT *, {dg(0, 256, "md5('resample:' || b || ':' || interaction_id)")} AS u FROM items_b, (SELECT unnest(range(1, 41)) AS b)),
      weighed AS (SELECT *, (u >= 94)::INT + (u >= 188)::INT + (u >= 235)::INT + (u >= 251)::INT + (u >= 255)::INT AS w FROM drawn),
      rates AS (SELECT run_key, b, sum(same * w) / sum(n * w) AS rate FROM weighed GROUP BY ALL HAVING sum(n * w) > 0),
      ends AS (SELECT run_key, quantile_cont(rate, 0.025) AS low, quantile_cont(rate, 0.975) AS high FROM rates GROUP BY ALL),
      whole AS (SELECT run_key, sum(same) / sum(n) AS accuracy FROM items_b GROUP BY ALL)
      SELECT run_key, round(accuracy, 9) AS accuracy, round(low, 9) AS low, round(high, 9) AS high FROM whole LEFT JOIN ends USING (run_key)""",
    "weighted_vote": f"""{WITH_CMP}, {', '.join(_vote(f) for f in FIELDS)}
      SELECT * FROM {' JOIN '.join(f'v_{f}' + (' USING (interaction_id, turn_number)' if k else '') for k, f in enumerate(FIELDS))}""",
    "ordinal_distance": f"{WITH_CMP}, {VERSUS} SELECT run_key, {', '.join(_distance(f) for f in FIELDS)} FROM versus GROUP BY ALL",
    "model_leaderboard": f"""{WITH_CMP}, {VERSUS}, {SCORES} SELECT run_key, round({MEAN}, 9) AS accuracy,
      rank() OVER (ORDER BY {MEAN} DESC) AS rank FROM scores""",
    "stuck_runs": f"""WITH {LOG}, aged AS (SELECT *, datediff('day', substr(updated_at, 1, 10)::DATE, DATE '1998-12-31') AS age_days FROM runs)
      SELECT run_id, updated_at, age_days FROM aged WHERE status = 'running' AND age_days > 90""",
    "label_contradictions": f"""{WITH_CMP} SELECT run_key, interaction_id, turn_number, 'judgment_holder=AI,delegation_awareness=Absent' AS contradiction
      FROM compared WHERE {H} = 'AI' AND {D} = 'Absent'""",
    "training_rows": f"""{WITH_HINTS}, labelled AS (SELECT * FROM hinted WHERE has_hint), ids AS (SELECT DISTINCT interaction_id FROM labelled),
      {splits_sql('ids', 'interaction_id', 8)}
      SELECT interaction_id, turn_number, md5(concat_ws(' ', human_input, ai_response)) AS text_md5, {', '.join(FIELDS)}, split
      FROM labelled JOIN splits USING (interaction_id)""",
    "extraction_outcome_hints": OUTCOME.format(WITH_HINTS, "count(*) FILTER (WHERE NOT has_hint)", "hinted") + """
      SELECT interaction_id, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, CASE WHEN error IS NULL THEN n ELSE 0 END AS state_count,
        CASE WHEN error IS NULL THEN n - 1 ELSE 0 END AS delta_count, error FROM outcome""",
    "extraction_states": OUTCOME.format(WITH_RULES, "0", "turns") + f"""
      SELECT interaction_id, turn_number, CASE WHEN pos % 2 = 0 THEN '2026-02-01T00:00:' || lpad((pos % 60)::VARCHAR, 2, '0') || 'Z'
        ELSE '{IN.RUN_CLOCK}' END AS timestamp, {', '.join(FIELDS)} FROM rules JOIN outcome USING (interaction_id) WHERE error IS NULL""",
    "matrix_all_labels": ORACLE["matrix_vs_baseline"] + " UNION ALL SELECT 'apart', 0, 0.0::DOUBLE, 0.0::DOUBLE",
    "split_assign_null_keys": f"""WITH o AS (SELECT CASE WHEN o_orderkey % 9 <> 0 THEN 'o-' || o_orderkey ELSE '' END AS id FROM orders),
      {splits_sql('o', 'id', 8)} SELECT split, count(*) AS item_count FROM splits GROUP BY ALL""",
}
_ended = """SELECT interaction_id, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, CASE WHEN error IS NULL THEN n ELSE 0 END AS state_count,
  CASE WHEN error IS NULL THEN n - 1 ELSE 0 END AS delta_count, error FROM outcome"""
ORACLE["matrix_run"] = f"""SELECT 'rules' AS label, * FROM ({OUTCOME.format(BASE, '0', 'turns')} {_ended})
  UNION ALL SELECT 'hints' AS label, * FROM ({ORACLE['extraction_outcome_hints']})"""
ORACLE["dataset_run_catalog"] = f"""SELECT 'rules-' || interaction_id AS run_id, interaction_id, 'rules' AS track_name, status, error AS error_message
  FROM ({ORACLE['extraction_outcome']})"""
