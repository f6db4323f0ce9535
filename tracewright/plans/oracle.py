"""The same queries as SQL for DuckDB, over whole tables."""

from __future__ import annotations

from ..functions import fixed
from ..operators import parent_map as pm
from . import inputs

CONTROL = r"^[\x00-\x20]+|[\x00-\x20]+$"
PLAIN_NUMBER = r"^[+-]?(Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)$"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '{CONTROL}', '', 'g')"


def _is_number(x: str) -> str:
    return f"regexp_matches({_trim(x)}, '{fixed.NUMBER}')"


def _number(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({_trim(x)}, '{PLAIN_NUMBER}') "
        f"THEN TRY_CAST({_trim(x)} AS DOUBLE) END"
    )


def _numeric(x: str) -> str:
    return (
        f"CASE lower({_trim(x)}) WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 "
        f"ELSE {_number(x)} END"
    )


def _binary(x: str) -> str:
    return f"CASE WHEN {_trim(f'lower({x})')} IN ('1', 'true', 'pass') THEN 1 ELSE 0 END"


def _with(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n"


# --- traces ---------------------------------------------------------------------------

TRACE = r"""
status AS (
  SELECT user_id AS run_id, max(event_id) + 1 AS seq,
         arg_max(CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT), event_id) % 2 AS good
  FROM events GROUP BY user_id),
trace AS (
  SELECT user_id AS run_id, event_id AS seq,
         printf('%s = %.2f', CASE event_type WHEN 'view' THEN 'temp_view'
                WHEN 'error' THEN 'error_debug' ELSE event_type END, value) AS line
  FROM events
  UNION ALL
  SELECT run_id, seq, 'Outcome = ' || CAST(good AS VARCHAR) FROM status)"""

ASSIGNMENTS = f"""
assignments AS (
  SELECT run_id, seq, {_trim("substr(line, 1, instr(line, '=') - 1)")} AS var,
         {_trim("substr(line, instr(line, '=') + 1)")} AS value
  FROM trace
  WHERE instr(line, '=') > 0 AND NOT starts_with({_trim('line')}, '-----'))"""

#: Runs as four sources log them: numbered by source, lines counted from 1.
LIVE_TRACE = TRACE.replace("trace AS (", "whole AS (") + """,
trace AS (
  SELECT (run_id % 4) || '-' || (dense_rank() OVER (PARTITION BY run_id % 4 ORDER BY run_id) - 1) AS run_id,
         row_number() OVER (PARTITION BY run_id ORDER BY seq) AS seq, line
  FROM whole)"""

CORE = "NOT starts_with(var, 'temp') AND NOT ends_with(var, '_debug')"

LAST = """
last_values AS (
  SELECT run_id, var, arg_max(value, seq) AS value, min(seq) AS first_seq
  FROM assignments GROUP BY run_id, var)"""

PARENTS = "parents(var, pos, parent) AS (VALUES " + ", ".join(
    f"('{v}', {p}, '{q}')" for v, p, q in inputs.PARENTS
) + ")"

LOOKUP = f"""
lookup AS (
  SELECT l.run_id, l.var, p.pos, p.parent, coalesce(k.value, 'N/A') AS value
  FROM last_values l JOIN parents p ON p.var = l.var
  LEFT JOIN last_values k ON k.run_id = l.run_id AND k.var = p.parent
  WHERE {CORE.replace('var', 'l.var')})"""

OUTCOMES = f"""
outcome_lines AS (
  SELECT run_id, arg_min(line, seq) AS line FROM trace
  WHERE starts_with(line, 'Outcome') AND instr(line, '=') > 0 GROUP BY run_id),
outcomes AS (
  SELECT r.run_id, coalesce(TRY_CAST({_trim("substr(o.line, instr(o.line, '=') + 1)")} AS INT), 0)
         AS outcome
  FROM (SELECT DISTINCT run_id FROM trace) r LEFT JOIN outcome_lines o USING (run_id))"""

RECORD_ROWS = f"""SELECT l.run_id, l.first_seq, CAST(l.run_id AS VARCHAR) AS "TestArgs",
  coalesce(b.bag, '') AS "Covariates", l.var AS "TreatmentVar", l.value AS "TreatmentVal",
  CAST(o.outcome AS VARCHAR) AS "Outcome"
FROM last_values l JOIN outcomes o ON o.run_id = l.run_id
LEFT JOIN (SELECT run_id, var, string_agg(parent || '=' || value, ';' ORDER BY pos) AS bag
           FROM lookup GROUP BY run_id, var) b ON b.run_id = l.run_id AND b.var = l.var
WHERE {CORE.replace('var', 'l.var')}"""

# --- deep graphs: what follows from how their edges are laid ---------------------------

DEEP = """
placed AS (
  SELECT event_id, event_type, p, graph_id,
         least(999, (SELECT max(event_id) FROM events) - (event_id - p)) AS final
  FROM (SELECT event_id, event_type, event_id % 1000 AS p, CAST(event_id // 1000 AS VARCHAR) AS graph_id FROM events)),
ways AS (
  SELECT graph_id, p, p + 1 AS q FROM placed WHERE p < final
  UNION SELECT graph_id, p, p + 4 FROM placed WHERE p % 10 = 3 AND p + 4 <= final
  UNION SELECT graph_id, p, p - p % 10 FROM placed WHERE event_type = 'error' AND p % 10 > 0
  UNION SELECT graph_id, p, p - p % 100 FROM placed WHERE event_type = 'refund' AND p % 100 > 0),
after AS (
  SELECT graph_id, event_id, p, CASE
           WHEN p = final THEN NULL
           WHEN p - p % 10 + 7 <= final AND (p % 10 = 3 OR p % 10 IN (4, 5, 6) AND event_type IN ('error', 'refund'))
             THEN p - p % 10 + 7
           ELSE p + 1 END AS next
  FROM placed)"""

DEEP_WALKS = """
branches AS (
  SELECT graph_id, p FROM ways GROUP BY graph_id, p HAVING count(*) > 1),
walks AS (
  SELECT w.graph_id, w.p, w.q AS place, a.next AS until
  FROM ways w JOIN branches USING (graph_id, p) JOIN after a USING (graph_id, p)
  WHERE w.q <> a.next
  UNION
  SELECT w.graph_id, w.p, a.next, w.until
  FROM walks w JOIN after a ON a.graph_id = w.graph_id AND a.p = w.place
  WHERE a.next <> w.until AND a.next <> w.p),
controlled AS (SELECT DISTINCT graph_id, p, place FROM walks)"""

# --- records --------------------------------------------------------------------------

RECORDS = """
o AS (
  SELECT o_orderkey * 5 AS base, o_custkey AS cust, o_orderstatus AS st, o_orderpriority AS pr,
         CAST(month(o_orderdate) AS VARCHAR) AS mo, printf('%.2f', o_totalprice) AS tot
  FROM orders),
shaped AS (
  SELECT *, CASE WHEN cust % 5 = 0 THEN 'N/A' ELSE tot END AS shown,
         '[' || cust || ', ' || (cust % 7) || ']' AS args,
         CASE cust % 3 WHEN 0 THEN CASE WHEN st = 'F' THEN 'pass' ELSE 'fail' END
                       WHEN 1 THEN CASE WHEN st = 'F' THEN '1' ELSE '0' END
                       ELSE CASE WHEN st = 'F' THEN ' TRUE ' ELSE 'False' END END AS word
  FROM o),
records AS (
  SELECT base AS row_id, args AS "TestArgs", 'priority=' || pr || ';month=' || mo AS "Covariates",
         'status' AS "TreatmentVar", st AS "TreatmentVal", word AS "Outcome" FROM shaped
  UNION ALL
  SELECT base + 1, args, 'month=' || mo || ';total=' || shown, 'priority', pr, word FROM shaped
  UNION ALL
  SELECT base + 2, args, ' status = ' || st || ' ;priority=' || pr ||
         CASE WHEN cust % 3 = 0 THEN ';priority=N/A' ELSE '' END, 'total',
         CASE WHEN cust % 11 = 0 THEN 'NaN' ELSE tot END, word FROM shaped
  UNION ALL
  SELECT base + 3, args, '', 'Outcome', CASE WHEN st = 'F' THEN '1' ELSE '0' END, word FROM shaped
  UNION ALL
  SELECT base + 4, args, 'total=' || shown || '=;=x;bad;a==b;c=;cust=' || (cust % 7), 'month',
         mo || ' ', word FROM shaped)"""

ENTRIES = f"""
pieces AS (
  SELECT row_id, unnest(string_split("Covariates", ';')) AS piece,
         generate_subscripts(string_split("Covariates", ';'), 1) AS pos
  FROM records),
parts AS (
  SELECT row_id, pos, string_split(regexp_replace({_trim('piece')}, '=+$', ''), '=') AS kv
  FROM pieces),
entries AS (
  SELECT row_id, pos, 'cov_' || {_trim('kv[1]')} AS key, {_trim('kv[2]')} AS value
  FROM parts WHERE len(kv) = 2),
kept AS (
  SELECT row_id, key, arg_max(value, pos) AS value FROM entries GROUP BY row_id, key)"""

TYPES = f"""
types AS (
  SELECT key, arg_min({_is_number('value')}, row_id * 1000 + pos) AS is_numeric
  FROM entries GROUP BY key)"""

CODES = """
codes AS (
  SELECT key, value,
         CAST(row_number() OVER (PARTITION BY key ORDER BY min(row_id)) - 1 AS INT) AS code
  FROM kept JOIN types USING (key) WHERE NOT is_numeric GROUP BY key, value)"""

MEDIANS = f"""
medians AS (
  SELECT key, median({_number('value')}) AS med FROM kept JOIN types USING (key)
  WHERE is_numeric GROUP BY key)"""

TREATMENTS = f"""
var_types AS (
  SELECT "TreatmentVar", coalesce(bool_and({_is_number('"TreatmentVal"')}), FALSE) AS is_numeric,
         count(*) - count({_number('"TreatmentVal"')}) AS missing,
         median({_number('"TreatmentVal"')}) AS med
  FROM records GROUP BY "TreatmentVar"),
var_codes AS (
  SELECT "TreatmentVar", "TreatmentVal",
         row_number() OVER (PARTITION BY "TreatmentVar" ORDER BY min(row_id)) - 1 AS code
  FROM records JOIN var_types USING ("TreatmentVar") WHERE NOT is_numeric
  GROUP BY "TreatmentVar", "TreatmentVal"),
valued AS (
  SELECT r.*, CASE WHEN t.is_numeric THEN coalesce({_number('r."TreatmentVal"')}, t.med)
              ELSE CAST(coalesce(c.code, -1) AS DOUBLE) END AS value
  FROM records r JOIN var_types t USING ("TreatmentVar")
  LEFT JOIN var_codes c ON c."TreatmentVar" = r."TreatmentVar"
       AND c."TreatmentVal" = r."TreatmentVal")"""

COVARIATE_KEYS = ["cov_", "cov_cust", "cov_month", "cov_priority", "cov_status", "cov_total"]


def _wide(cell: str) -> str:
    return ", ".join(
        f"max(CASE WHEN g.key = '{k}' THEN {cell} END) AS \"{k}\"" for k in COVARIATE_KEYS
    )


GRID = """
g AS (
  SELECT r.row_id, t.key, t.is_numeric, k.value, c.code, m.med
  FROM records r CROSS JOIN types t
  LEFT JOIN kept k ON k.row_id = r.row_id AND k.key = t.key
  LEFT JOIN codes c ON c.key = t.key AND c.value = k.value
  LEFT JOIN medians m ON m.key = t.key)"""

DATASET_CELL = (
    f"CASE WHEN g.is_numeric THEN coalesce({_number('g.value')}, g.med) "
    "ELSE CAST(coalesce(g.code, -1) AS DOUBLE) END"
)
COV_LIST = ", ".join(f'round("{k}", 6) AS "{k}"' for k in COVARIATE_KEYS)

DATASET = f"""
wide AS (SELECT row_id, {_wide(DATASET_CELL)} FROM g GROUP BY row_id),
dataset AS (
  SELECT v.row_id, v."TestArgs", {COV_LIST}, v."TreatmentVar",
         round(v.value, 6) AS "TreatmentVal", {_binary('v."Outcome"')} AS "Outcome"
  FROM valued v JOIN wide w ON w.row_id = v.row_id)"""

ALL_DATASET = [RECORDS, ENTRIES, TYPES, CODES, MEDIANS, TREATMENTS, GRID, DATASET]

UNTIDY = f"""
records AS (
  SELECT event_id AS row_id, CAST(user_id AS VARCHAR) AS "TestArgs",
         'n' || (event_id % 3000) || '=' || CASE WHEN event_id >= 3000 AND event_id % 11 = 0 THEN 'N/A'
                                             ELSE CAST(event_id % 7 AS VARCHAR) END
         || ';N' || (event_id % 3000) || '=c' || (event_id // 3000 % 3) AS "Covariates",
         CASE event_type WHEN 'view' THEN 'Price' WHEN 'click' THEN 'price' WHEN 'error' THEN NULL ELSE event_type END AS "TreatmentVar",
         CASE WHEN event_type = 'click' THEN 'c' || (event_id % 5) WHEN event_id % 13 <> 0 THEN printf('%.2f', value) END AS "TreatmentVal",
         CAST(event_id % 2 AS VARCHAR) AS "Outcome"
  FROM events),
cells AS (
  SELECT row_id, 'cov_n' || (row_id % 3000) AS key,
         {_number("split_part(split_part(\"Covariates\", ';', 1), '=', 2)")} AS number, NULL AS word FROM records
  UNION ALL
  SELECT row_id, 'cov_N' || (row_id % 3000), NULL, split_part(split_part("Covariates", ';', 2), '=', 2) FROM records),
firsts AS (
  SELECT *, min(row_id) OVER (PARTITION BY key, word) AS first, median(number) OVER (PARTITION BY key) AS med FROM cells),
filled AS (
  SELECT row_id, key, CASE WHEN word IS NULL THEN coalesce(number, med)
         ELSE CAST(dense_rank() OVER (PARTITION BY key ORDER BY first) - 1 AS DOUBLE) END AS value
  FROM firsts),
treated AS (
  SELECT *, TRY_CAST("TreatmentVal" AS DOUBLE) AS number,
         min(row_id) OVER (PARTITION BY "TreatmentVar", "TreatmentVal") AS first FROM records),
treatments AS (
  SELECT row_id, "TreatmentVar", CAST("Outcome" AS INT) AS "Outcome", round(CASE WHEN "TreatmentVar" = 'price'
           THEN dense_rank() OVER (PARTITION BY "TreatmentVar" ORDER BY first) - 1
           ELSE coalesce(number, median(number) OVER (PARTITION BY "TreatmentVar")) END, 6) AS "TreatmentVal"
  FROM treated)"""

# --- numeric dataset and linear scoring -------------------------------------------------

NAMES = ["quantity", "discount", "tax", "extendedprice"]


def _numeric_part(var: str) -> str:
    covs = ", ".join(
        (f"CAST(NULL AS DOUBLE) AS cov_{n}" if n == var else f"l_{n} AS cov_{n}")
        for n in sorted(NAMES)
    )
    return (
        f"SELECT CAST(l_orderkey AS VARCHAR) AS \"TestArgs\", {covs}, '{var}' AS \"TreatmentVar\", "
        f"l_{var} AS \"TreatmentVal\", CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS \"Outcome\" "
        "FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
    )


NUMERIC = "numeric AS (\n" + "\nUNION ALL\n".join(_numeric_part(n) for n in NAMES) + ")"

REPS = """
vals AS (SELECT DISTINCT "TreatmentVar" AS treatment_var, "TreatmentVal" AS v FROM numeric),
placed AS (
  SELECT treatment_var, v, row_number() OVER (PARTITION BY treatment_var ORDER BY v) AS place,
         count(*) OVER (PARTITION BY treatment_var) AS n,
         bool_and(v IN (0, 1)) OVER (PARTITION BY treatment_var) AS switch
  FROM vals),
reps AS (
  SELECT treatment_var, v AS rep FROM placed
  WHERE NOT switch AND (n < 3 OR place IN (1, n // 2 + 1, n))
  UNION ALL
  SELECT DISTINCT treatment_var, unnest([0.0::DOUBLE, 1.0::DOUBLE]) FROM placed WHERE switch)"""

COV_NAMES = [f"cov_{n}" for n in sorted(NAMES)]

MEANS = (
    'means AS (SELECT "TreatmentVar" AS treatment_var, '
    + ", ".join(f"coalesce(avg({c}), 0.0) AS {c}" for c in COV_NAMES)
    + " FROM numeric GROUP BY 1)"
)


def _predicted() -> str:
    cases = []
    for var, kind, const, _, coef, intercept in inputs.LINEAR_MODELS:
        if kind == "constant":
            cases.append(f"WHEN '{var}' THEN {float(const == 1)}::DOUBLE")
            continue
        score = f"({intercept!r}::DOUBLE)"
        for c, w in zip(COV_NAMES, coef):
            score += f" + ({w!r}::DOUBLE) * coalesce(d.{c}, m.{c}, 0.0)"
        score += f" + ({coef[-1]!r}::DOUBLE) * r.rep"
        cases.append(f"WHEN '{var}' THEN CASE WHEN {score} >= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")
    return "CASE d.\"TreatmentVar\" " + " ".join(cases) + " END"


MODELLED = ", ".join(f"'{m[0]}'" for m in inputs.LINEAR_MODELS)
PREDICTED = f"""
grid AS (
  SELECT d."TestArgs", d."TreatmentVar", d."TreatmentVal", r.rep, {_predicted()} AS predicted
  FROM numeric d JOIN reps r ON r.treatment_var = d."TreatmentVar"
  JOIN means m ON m.treatment_var = d."TreatmentVar"
  WHERE d."TreatmentVar" IN ({MODELLED})),
averages AS (
  SELECT "TreatmentVar" AS treatment_var, rep, avg(predicted) AS avg_outcome
  FROM grid GROUP BY 1, 2),
scores AS (
  SELECT treatment_var, max(avg_outcome) - min(avg_outcome) AS score
  FROM averages GROUP BY treatment_var)"""

SCORED = [NUMERIC, REPS, MEANS, PREDICTED]

# --- graphs ---------------------------------------------------------------------------

GRAPHS = """
sessions AS (
  SELECT user_id || '-' || ((CAST(ts AS DATE) - DATE '1970-01-01') // 2) AS graph_id,
         event_id, event_type AS node
  FROM events),
steps AS (
  SELECT graph_id, node AS src,
         lead(node) OVER (PARTITION BY graph_id ORDER BY event_id) AS after,
         lag(node) OVER (PARTITION BY graph_id ORDER BY event_id) AS before
  FROM sessions),
edges AS (
  SELECT graph_id, src, coalesce(after, 'end') AS dst FROM steps
  UNION
  SELECT graph_id, 'start', src FROM steps WHERE before IS NULL),
ranked AS (
  SELECT graph_id, node, count(*) AS m,
         row_number() OVER (PARTITION BY graph_id ORDER BY min(event_id)) AS r
  FROM sessions GROUP BY graph_id, node),
nodes AS (
  SELECT graph_id, node, CASE node
           WHEN 'view' THEN printf('for-cond: page_%d <= page_%d', r, m)
           WHEN 'click' THEN printf('page_%d = click(page_%d)', r, m)
           WHEN 'signup' THEN printf('account_%d = signup(account_%d, page_%d)', r, m, r)
           WHEN 'purchase' THEN printf('Return purchase(account_%d)', r)
           ELSE printf('throw "error_%d"', m) END AS label, r AS ord
  FROM ranked
  UNION ALL
  SELECT DISTINCT graph_id, 'start', 'Method Start: main', 0 FROM ranked
  UNION ALL
  SELECT DISTINCT graph_id, 'end', 'Method End: main', 1000000 FROM ranked)"""

# d dominates n when n cannot be reached once d is taken out
DOMINATORS = """
alive AS (
  SELECT s.graph_id, d.node AS gone, 'start' AS node
  FROM (SELECT DISTINCT graph_id FROM nodes) s JOIN nodes d ON d.graph_id = s.graph_id
  WHERE d.node <> 'start'
  UNION
  SELECT a.graph_id, a.gone, e.dst FROM alive a
  JOIN edges e ON e.graph_id = a.graph_id AND e.src = a.node WHERE e.dst <> a.gone),
dominators AS (
  SELECT n.graph_id, n.node, d.node AS dom FROM nodes n JOIN nodes d ON d.graph_id = n.graph_id
  LEFT JOIN alive a ON a.graph_id = n.graph_id AND a.gone = d.node AND a.node = n.node
  WHERE a.node IS NULL)"""

# p postdominates n when n reaches no sink once p is taken out
POSTDOMINATORS = """
sinks AS (
  SELECT graph_id, node FROM nodes n WHERE label LIKE 'Method End:%'
     OR NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.src = n.node)),
onward AS (
  SELECT e.* FROM edges e WHERE e.src <> 'end'),
alive AS (
  SELECT s.graph_id, p.node AS gone, s.node FROM sinks s JOIN nodes p ON p.graph_id = s.graph_id
  WHERE p.node <> s.node
  UNION
  SELECT a.graph_id, a.gone, e.src FROM alive a
  JOIN onward e ON e.graph_id = a.graph_id AND e.dst = a.node WHERE e.src <> a.gone),
postdominators AS (
  SELECT n.graph_id, n.node, p.node AS dom FROM nodes n JOIN nodes p ON p.graph_id = n.graph_id
  LEFT JOIN alive a ON a.graph_id = n.graph_id AND a.gone = p.node AND a.node = n.node
  WHERE a.node IS NULL)"""


def _immediate(pairs: str, name: str) -> str:
    """The strict dominator that no other strict dominator is dominated by."""
    return f"""
{name} AS (
  SELECT n.graph_id, n.node, min(c.dom) AS idom FROM nodes n
  LEFT JOIN (
    SELECT c.* FROM {pairs} c WHERE c.dom <> c.node AND NOT EXISTS (
      SELECT 1 FROM {pairs} o JOIN {pairs} x
        ON x.graph_id = o.graph_id AND x.node = o.dom AND x.dom = c.dom
      WHERE o.graph_id = c.graph_id AND o.node = c.node AND o.dom <> c.node AND o.dom <> c.dom)
  ) c ON c.graph_id = n.graph_id AND c.node = n.node
  GROUP BY n.graph_id, n.node)"""


CONTROL_DEPENDENCE = """
branches AS (
  SELECT graph_id, src FROM edges GROUP BY graph_id, src HAVING count(*) >= 2),
walk AS (
  SELECT e.graph_id, e.src AS x, e.dst AS w, i.idom AS stop
  FROM edges e JOIN branches b ON b.graph_id = e.graph_id AND b.src = e.src
  JOIN ipdom i ON i.graph_id = e.graph_id AND i.node = e.src
  WHERE e.dst <> e.src AND (i.idom IS NULL OR e.dst <> i.idom)
  UNION
  SELECT k.graph_id, k.x, n.idom, k.stop FROM walk k
  JOIN ipdom n ON n.graph_id = k.graph_id AND n.node = k.w
  WHERE n.idom IS NOT NULL AND n.idom <> k.x AND (k.stop IS NULL OR n.idom <> k.stop)),
controlled AS (
  SELECT graph_id, x AS controller, w AS dependent FROM walk
  UNION
  SELECT e.graph_id, e.src, e.dst FROM edges e
  JOIN branches b ON b.graph_id = e.graph_id AND b.src = e.src
  JOIN ipdom i ON i.graph_id = e.graph_id AND i.node = e.src AND i.idom = e.dst
  JOIN nodes n ON n.graph_id = e.graph_id AND n.node = e.src AND n.label LIKE 'for-cond:%')"""

VERSIONS = r"""
versions AS (
  SELECT DISTINCT graph_id, node, var, CAST(version AS BIGINT) AS version FROM (
    SELECT graph_id, node, unnest(regexp_extract_all(label, '([a-zA-Z]+)_([0-9]+)', 1)) AS var,
           unnest(regexp_extract_all(label, '([a-zA-Z]+)_([0-9]+)', 2)) AS version
    FROM nodes WHERE contains(label, '=')))"""

REACHING = """
bounds AS (SELECT graph_id, node, var, max(version) AS bound FROM versions GROUP BY ALL),
reaching AS (
  SELECT graph_id, node, var, version FROM versions
  UNION
  SELECT r.graph_id, e.dst, r.var, r.version FROM reaching r
  JOIN edges e ON e.graph_id = r.graph_id AND e.src = r.node
  LEFT JOIN bounds b ON b.graph_id = r.graph_id AND b.node = e.dst AND b.var = r.var
  WHERE b.bound IS NULL OR r.version >= b.bound)"""

# --- texts ----------------------------------------------------------------------------

TEXTS = """
texts AS (
  SELECT 'doc-' || doc_id AS file, text FROM documents
  UNION ALL SELECT 'page-' || page_id, html FROM pages)"""

_A = _lit(pm.ASSIGNMENT)
_WORDS = ", ".join(f"'{w}'" for w in pm.KEYWORDS)
OCCURRENCES = f"""
code_lines AS (
  SELECT file, unnest(string_split(text, chr(10))) AS code,
         generate_subscripts(string_split(text, chr(10)), 1) AS line
  FROM texts),
hits AS (
  SELECT file, line, unnest(regexp_extract_all(code, {_A}, 1)) AS kind,
         unnest(regexp_extract_all(code, {_A}, 2)) AS var,
         unnest(regexp_extract_all(code, {_A}, 3)) AS rhs,
         generate_subscripts(regexp_extract_all(code, {_A}, 0), 1) AS col
  FROM code_lines WHERE contains(code, '=')),
names AS (
  SELECT file, line, col, unnest(found) AS name, generate_subscripts(found, 1) AS place, var
  FROM (SELECT *, regexp_extract_all(regexp_replace(rhs, {_lit(pm.QUOTED)}, ' ', 'g'),
                                     {_lit(pm.NAME)}) AS found FROM hits)),
firsts AS (
  SELECT file, line, col, name, min(place) AS place FROM (
    SELECT file, line, col, var, place, rtrim(replace(name, chr(9), ' ')) AS name FROM names
    WHERE NOT starts_with(name, '.') AND NOT ends_with(name, '('))
  WHERE name <> var AND name NOT IN ({_WORDS}) GROUP BY ALL),
occurrences AS (
  SELECT h.file, h.line, h.col, h.var,
         CASE WHEN coalesce(trim(h.kind), '') = '' THEN 'assign' ELSE 'declare' END AS kind,
         coalesce(r.refs, []) AS refs
  FROM hits h LEFT JOIN (
    SELECT file, line, col, list(name ORDER BY place) AS refs FROM firsts GROUP BY file, line, col
  ) r ON r.file = h.file AND r.line = h.line AND r.col = h.col),
parent_map AS (
  SELECT file, var, refs FROM occurrences
  QUALIFY row_number() OVER (PARTITION BY file, var ORDER BY line, col, kind) = 1)"""

VERSIONED = """
names AS (
  SELECT DISTINCT l_orderkey AS file, CASE WHEN l_partkey % 2 = 0
         THEN l_returnflag || '_' || l_linenumber
         ELSE l_returnflag || '_' || l_linenumber || '_' || (l_suppkey % 10) END AS name
  FROM lineitem)"""


def _draw(what: str, sides: int) -> str:
    return (
        f"(CAST('0x' || substr(md5('0:' || c_custkey || ':' || {what}), 1, 8) AS BIGINT) % {sides})"
    )


def oracle_sql() -> dict[str, str]:
    trace = [TRACE, ASSIGNMENTS]
    spread = (
        "spread AS (SELECT c_nationkey || '/' || c_mktsegment AS treatment_var, "
        "max(c_acctbal / 10000) - min(c_acctbal / 10000) AS score FROM customer GROUP BY 1)"
    )
    idom = _immediate("dominators", "idom")
    ipdom = _immediate("postdominators", "ipdom")
    return {
        "trace_scan": _with(TRACE)
        + "SELECT dense_rank() OVER (ORDER BY run_id) - 1 AS run_id, "
        "row_number() OVER (ORDER BY run_id, seq) "
        "+ dense_rank() OVER (ORDER BY run_id) - 1 AS seq, line FROM trace",
        "parse_assignments": _with(*trace) + "SELECT * FROM assignments",
        "core_assignments": _with(*trace) + f"SELECT * FROM assignments WHERE {CORE}",
        "final_assignments": _with(*trace, LAST) + f"SELECT * FROM last_values WHERE {CORE}",
        "covariate_lookup": _with(*trace, LAST, PARENTS, LOOKUP) + "SELECT * FROM lookup",
        "run_outcomes": _with(TRACE, OUTCOMES) + "SELECT * FROM outcomes",
        "execution_records": _with(*trace, LAST, PARENTS, LOOKUP, OUTCOMES) + RECORD_ROWS,
        "deep_dominator_tree": _with(DEEP)
        + "SELECT graph_id, 'e' || event_id AS node, CASE WHEN p = 0 THEN NULL WHEN p % 10 = 7 THEN 'e' || (event_id - 4) "
        "ELSE 'e' || (event_id - 1) END AS idom FROM placed",
        "deep_postdominator_tree": _with(DEEP)
        + "SELECT graph_id, 'e' || event_id AS node, 'e' || (event_id - p + next) AS idom FROM after",
        "deep_control_dependence": _with(DEEP, DEEP_WALKS, recursive=True)
        + """SELECT graph_id, 'e' || (CAST(graph_id AS BIGINT) * 1000 + p) AS controller,
  'e' || (CAST(graph_id AS BIGINT) * 1000 + place) AS dependent FROM controlled
UNION ALL
SELECT graph_id, 'e' || (event_id - p), 'e' || event_id FROM placed
WHERE p > 0 AND NOT EXISTS (SELECT 1 FROM controlled c WHERE c.graph_id = placed.graph_id AND c.place = placed.p)""",
        "dataset_untidy_names": _with(UNTIDY) + "SELECT * FROM treatments JOIN filled USING (row_id)",
        "live_runs": _with(LIVE_TRACE, ASSIGNMENTS, LAST, PARENTS, LOOKUP, OUTCOMES) + RECORD_ROWS,
        "live_last_values": _with(*trace)
        + "SELECT run_id, var, arg_max(value, seq) AS value, max(seq) AS seq FROM assignments GROUP BY run_id, var",
        "assignment_versions": _with(*trace)
        + "SELECT *, var || '_' || version AS versioned FROM (SELECT *, row_number() OVER "
        "(PARTITION BY run_id, var ORDER BY seq) AS version FROM assignments)",
        "success_rate": _with(TRACE, OUTCOMES)
        + "SELECT total, ok, total - ok AS failed, CAST((ok * 10000 // total) / 100.0 AS DOUBLE) "
        "AS rate FROM "
        "(SELECT count(*) AS total, count(*) FILTER (outcome = 1) AS ok FROM outcomes)",
        "records_scan": _with(RECORDS)
        + 'SELECT row_number() OVER (ORDER BY row_id) AS row_id, "TestArgs", '
        + ", ".join(
            f'{_trim(chr(34) + c + chr(34))} AS "{c}"'
            for c in ("Covariates", "TreatmentVar", "TreatmentVal", "Outcome")
        )
        + " FROM records",
        "parents_scan": _with(TEXTS, OCCURRENCES)
        + "SELECT var, unnest(refs) AS parent, "
        "CAST(generate_subscripts(refs, 1) - 1 AS INT) AS pos FROM parent_map",
        "random_inputs": "SELECT c_custkey AS id, array_to_string(list_transform(range(1, "
        f"{fixed.INPUT_MIN_LENGTH + 1} + "
        f"{_draw(_lit('length'), fixed.INPUT_MAX_LENGTH - fixed.INPUT_MIN_LENGTH + 1)}), "
        f"lambda i: substr('{fixed.INPUT_LETTERS}', "
        f"{_draw('i', len(fixed.INPUT_LETTERS))} + 1, 1)), '') AS arg FROM customer",
        "parse_numeric": _with(RECORDS)
        + f'SELECT row_id, {_numeric(chr(34) + "TreatmentVal" + chr(34))} AS value, '
        f'{_numeric(chr(34) + "Outcome" + chr(34))} AS outcome FROM records',
        "binarize_outcome": _with(RECORDS)
        + f'SELECT row_id, {_binary(chr(34) + "Outcome" + chr(34))} AS outcome FROM records',
        "csv_escape": _with(TEXTS)
        + "SELECT file, CASE WHEN regexp_matches(text, '[,\"\\n]') "
        "THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS field FROM texts",
        "args_string": "SELECT c_custkey, '[' || c_name || ', ' || c_mktsegment || ']' AS args "
        "FROM customer",
        "parse_covariates": _with(RECORDS, ENTRIES) + "SELECT * FROM kept",
        "covariate_types": _with(RECORDS, ENTRIES, TYPES) + "SELECT * FROM types",
        "expand_covariates": _with(RECORDS, ENTRIES, TYPES)
        + ", g AS (SELECT r.row_id, t.key, t.is_numeric, k.value FROM records r "
        "CROSS JOIN types t LEFT JOIN kept k ON k.row_id = r.row_id AND k.key = t.key) "
        + f"SELECT row_id, key, CASE WHEN is_numeric THEN {_number('value')} END AS num, "
        "CASE WHEN NOT is_numeric THEN value END AS text FROM g",
        "label_encode": _with(RECORDS, ENTRIES, TYPES, CODES) + "SELECT * FROM codes",
        "median_impute": _with(RECORDS, ENTRIES, TYPES)
        + f""", vals AS (
  SELECT r.row_id, CASE WHEN "TreatmentVar" IN ('status', 'total') THEN 'a' ELSE 'b' END AS grp, t.key,
         {_number('k.value')} AS value
  FROM records r CROSS JOIN types t LEFT JOIN kept k ON k.row_id = r.row_id AND k.key = t.key
  WHERE t.is_numeric)
SELECT row_id, key, coalesce(value, med) AS value
FROM vals JOIN (SELECT grp, key, median(value) AS med FROM vals GROUP BY grp, key) USING (grp, key)""",
        "treatment_types": _with(RECORDS, TREATMENTS)
        + 'SELECT "TreatmentVar", is_numeric, missing FROM var_types',
        "treatment_values": _with(RECORDS, TREATMENTS)
        + 'SELECT row_id, "TreatmentVar", round(value, 6) AS value FROM valued',
        "training_dataset": _with(*ALL_DATASET) + "SELECT * FROM dataset",
        "dataset_sink": _with(*ALL_DATASET) + "SELECT * EXCLUDE (row_id) FROM dataset",
        "records_sink": _with(RECORDS)
        + """SELECT '"' || "TestArgs" || '",' || trim("Covariates") || ',' || "TreatmentVar" || ',' || trim("TreatmentVal")
       || ',' || trim("Outcome") AS value, 2 * count(*) AS n FROM records GROUP BY 1""",
        "parents_sink": _with(TEXTS, OCCURRENCES)
        + """SELECT '{' || string_agg('"' || var || '":[' || coalesce(array_to_string(list_transform(refs, lambda r: '"' || r || '"'), ','), '')
       || ']', ',' ORDER BY var) || '}' AS value FROM parent_map GROUP BY file""",
        "preview": _with(RECORDS) + "SELECT * FROM records ORDER BY row_id LIMIT 5",
        "dataset_profile": _with(RECORDS, ENTRIES, TYPES, TREATMENTS)
        + """SELECT 'rows' AS kind, count(*) AS n, '' AS names FROM records
UNION ALL
SELECT kind, count(*), string_agg(name, ',' ORDER BY name) FROM (
  SELECT CASE WHEN is_numeric THEN 'numeric covariate' ELSE 'categorical covariate' END AS kind,
         key AS name FROM types
  UNION ALL
  SELECT CASE WHEN is_numeric THEN 'numeric treatment' ELSE 'categorical treatment' END,
         "TreatmentVar" FROM var_types) GROUP BY kind""",
        "per_test_aggregate": _with(RECORDS, ENTRIES)
        + f""", candidates AS (SELECT * FROM records WHERE "TreatmentVar" <> 'Outcome'),
first_outcomes AS (
  SELECT "TestArgs", arg_min({_binary('"TreatmentVal"')}, row_id) AS outcome
  FROM records WHERE "TreatmentVar" = 'Outcome' GROUP BY 1),
pairs AS (
  SELECT DISTINCT "TestArgs", "TreatmentVar", substr(key, 5) || '=' || value AS pair
  FROM candidates JOIN kept USING (row_id)),
others AS (
  SELECT c."TestArgs", c."TreatmentVar", string_agg(DISTINCT p.pair, ';' ORDER BY p.pair) AS bag
  FROM (SELECT DISTINCT "TestArgs", "TreatmentVar" FROM candidates) c
  JOIN pairs p ON p."TestArgs" = c."TestArgs"
  WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q."TestArgs" = c."TestArgs"
                    AND q."TreatmentVar" = c."TreatmentVar" AND q.pair = p.pair)
  GROUP BY 1, 2)
SELECT c."TestArgs", coalesce(any_value(x.bag), '') AS "Covariates", c."TreatmentVar",
       round(avg({_number('c."TreatmentVal"')}), 6) AS "TreatmentVal",
       coalesce(any_value(f.outcome), 0) AS "Outcome"
FROM candidates c LEFT JOIN others x USING ("TestArgs", "TreatmentVar")
LEFT JOIN first_outcomes f USING ("TestArgs") GROUP BY c."TestArgs", c."TreatmentVar\"""",
        "treatment_vars": _with(NUMERIC) + 'SELECT DISTINCT "TreatmentVar" AS treatment_var FROM numeric',
        "treatment_counts": _with(NUMERIC)
        + 'SELECT "TreatmentVar" AS treatment_var, count(*) AS n FROM numeric GROUP BY 1',
        "class_cardinality": _with(*ALL_DATASET)
        + 'SELECT "TreatmentVar" AS treatment_var, CAST(count(DISTINCT "Outcome") AS INT) AS n_classes, '
        'min("Outcome") AS min_class FROM dataset GROUP BY 1',
        "constant_models": _with(RECORDS)
        + "SELECT \"TreatmentVar\" || '=' || \"TreatmentVal\" AS treatment_var, 'constant' AS kind, "
        f"min({_binary(chr(34) + 'Outcome' + chr(34))}) AS const_class FROM records GROUP BY 1 "
        f"HAVING count(DISTINCT {_binary(chr(34) + 'Outcome' + chr(34))}) = 1",
        "fitted_models": _with(NUMERIC)
        + "SELECT \"TreatmentVar\" AS treatment_var, "
        + "CASE WHEN min(\"Outcome\") = max(\"Outcome\") THEN 'constant' ELSE 'logistic' END AS kind, "
        + "CASE WHEN min(\"Outcome\") = max(\"Outcome\") THEN min(\"Outcome\") END AS const_class, "
        + f"'{','.join([*COV_NAMES, 'TreatmentVal'])}' AS features, "
        + "CASE WHEN min(\"Outcome\") < max(\"Outcome\") THEN 0.0::DOUBLE END AS residual, "
        + "CASE WHEN min(\"Outcome\") < max(\"Outcome\") THEN round(avg(\"Outcome\"), 6) END AS mean_score "
        + "FROM numeric GROUP BY 1",
        "models_missing": _with(NUMERIC)
        + f'SELECT DISTINCT "TreatmentVar" AS treatment_var FROM numeric '
        f'WHERE "TreatmentVar" NOT IN ({MODELLED})',
        "coerce_rows": _with(RECORDS)
        + 'SELECT row_id, "TreatmentVar", '
        + ", ".join(
            f"{_numeric(chr(34) + c + chr(34))} AS \"{c}\"" for c in ("TreatmentVal", "Outcome")
        )
        + "".join(
            ", " + _numeric("split_part(split_part(\"Covariates\", ';', %d), '=', 2)" % at) + f" AS cov_{name}"
            for at, name in ((1, "first"), (2, "second"))
        )
        + " FROM records",
        "covariate_means": _with(NUMERIC, MEANS)
        + "SELECT treatment_var, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in COV_NAMES)
        + " FROM means",
        "fill_covariates": _with(RECORDS, ENTRIES, TYPES)
        + f""", vals AS (
  SELECT r.row_id, r."TreatmentVar", t.key, {_number('k.value')} AS v
  FROM records r CROSS JOIN types t LEFT JOIN kept k ON k.row_id = r.row_id AND k.key = t.key
  WHERE t.is_numeric)
SELECT row_id, "TreatmentVar", key, round(coalesce(v, mean, 0.0), 6) AS value FROM vals
JOIN (SELECT "TreatmentVar", key, avg(v) AS mean FROM vals GROUP BY 1, 2) USING ("TreatmentVar", key)""",
        "representative_values": _with(NUMERIC, REPS) + "SELECT * FROM reps",
        "counterfactual_grid": _with(NUMERIC, REPS)
        + 'SELECT d."TestArgs", d."TreatmentVar", d."TreatmentVal", r.rep FROM numeric d '
        'JOIN reps r ON r.treatment_var = d."TreatmentVar"',
        "predict_grid_linear": _with(*SCORED) + "SELECT * FROM grid",
        "avg_outcome_by_rep": _with(*SCORED)
        + "SELECT treatment_var, rep, round(avg_outcome, 6) AS avg_outcome FROM averages",
        "suspiciousness_linear": _with(*SCORED)
        + "SELECT treatment_var, round(score, 6) AS score FROM scores",
        "ranking": _with(*SCORED)
        + "SELECT treatment_var, round(score, 6) AS score FROM scores "
        "ORDER BY scores.score DESC, treatment_var",
        "ranking_top10": _with(spread)
        + "SELECT treatment_var, round(score, 6) AS score FROM spread "
        "ORDER BY spread.score DESC, treatment_var LIMIT 10",
        "ranking_format": _with(*SCORED)
        + "SELECT treatment_var, printf('%.5f', score) AS score FROM scores "
        "ORDER BY scores.score DESC, treatment_var",
        "edges_distinct": _with(GRAPHS) + "SELECT * FROM edges",
        "adjacency": _with(GRAPHS)
        + """SELECT n.graph_id, n.node, coalesce(p.names, '') AS predecessors,
       coalesce(s.names, '') AS successors
FROM nodes n
LEFT JOIN (SELECT graph_id, dst AS node, string_agg(src, ',' ORDER BY src) AS names
           FROM edges GROUP BY 1, 2) p USING (graph_id, node)
LEFT JOIN (SELECT graph_id, src AS node, string_agg(dst, ',' ORDER BY dst) AS names
           FROM edges GROUP BY 1, 2) s USING (graph_id, node)""",
        "branch_nodes": _with(GRAPHS)
        + "SELECT graph_id, src AS node, count(*) AS n_successors FROM edges "
        "GROUP BY 1, 2 HAVING count(*) >= 2",
        "terminal_nodes": _with(GRAPHS)
        + """SELECT graph_id, node, label FROM nodes n
WHERE regexp_matches(lower(trim(label)), '^(return|throw)')
   OR NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.src = n.node)""",
        "virtual_entry": _with(GRAPHS)
        + "SELECT * FROM edges UNION SELECT graph_id, 'virtualEntry', node FROM nodes "
        "WHERE label LIKE 'Method Start:%'",
        "call_site_edges": _with(GRAPHS)
        + """, program AS (
  SELECT * FROM nodes
  UNION ALL SELECT DISTINCT graph_id, 'm_click', 'Method Start: click', 1000001 FROM nodes
  UNION ALL SELECT DISTINCT graph_id, 'm_refund', 'Method Start: refund', 1000002 FROM nodes),
methods AS (
  SELECT graph_id, node, trim(substr(label, 14)) AS name FROM program
  WHERE label LIKE 'Method Start:%')
SELECT m.graph_id, CASE WHEN m.name = 'main' THEN 'virtualEntry'
       ELSE coalesce(arg_min(p.node, p.ord), 'virtualEntry') END AS src, m.node AS dst
FROM methods m LEFT JOIN program p
  ON p.graph_id = m.graph_id AND contains(p.label, m.name || '(')
GROUP BY m.graph_id, m.node, m.name""",
        "subgraph_edges": _with(GRAPHS)
        + """, members AS (
  SELECT graph_id, node FROM nodes n WHERE NOT regexp_matches(lower(trim(label)), '^(return|throw)')
  AND EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.src = n.node))
SELECT e.* FROM edges e JOIN members a ON a.graph_id = e.graph_id AND a.node = e.src
JOIN members b ON b.graph_id = e.graph_id AND b.node = e.dst""",
        "dot_lines": _with(GRAPHS)
        + r"""SELECT DISTINCT graph_id, 0 AS section, 'digraph CFG {' AS line FROM nodes
UNION ALL
SELECT graph_id, 1, '  "' || node || '" [label="' ||
       regexp_replace(label, '(["()])', '\\\1', 'g') || '"];' FROM nodes
UNION ALL SELECT graph_id, 2, '  "' || src || '" -> "' || dst || '";' FROM edges
UNION ALL SELECT DISTINCT graph_id, 3, '}' FROM nodes""",
        "reachable": _with(
            GRAPHS,
            "reach AS (SELECT graph_id, node FROM nodes WHERE ord = 1 UNION "
            "SELECT r.graph_id, e.dst FROM reach r JOIN edges e "
            "ON e.graph_id = r.graph_id AND e.src = r.node)",
            recursive=True,
        )
        + "SELECT * FROM reach",
        "dominators": _with(GRAPHS, DOMINATORS, recursive=True) + "SELECT * FROM dominators",
        "immediate_dominators": _with(GRAPHS, DOMINATORS, idom, recursive=True)
        + "SELECT * FROM idom",
        "dominator_tree": _with(GRAPHS, DOMINATORS, idom, recursive=True)
        + "SELECT graph_id, idom AS src, node AS dst FROM idom WHERE idom IS NOT NULL",
        "dominator_listing": _with(GRAPHS, DOMINATORS, recursive=True)
        + "SELECT graph_id, node, node || ' is dominated by: ' || "
        "string_agg(dom, ' ' ORDER BY dom) AS line FROM dominators GROUP BY 1, 2",
        "postdominators": _with(GRAPHS, POSTDOMINATORS, recursive=True)
        + "SELECT * FROM postdominators",
        "immediate_postdominators": _with(GRAPHS, POSTDOMINATORS, ipdom, recursive=True)
        + "SELECT * FROM ipdom",
        "control_dependence": _with(
            GRAPHS, POSTDOMINATORS, ipdom, CONTROL_DEPENDENCE, recursive=True
        )
        + """SELECT * FROM controlled UNION
SELECT graph_id, 'start', node FROM nodes n WHERE node <> 'start' AND NOT EXISTS (
  SELECT 1 FROM controlled c WHERE c.graph_id = n.graph_id AND c.dependent = n.node)""",
        "label_versions": _with(GRAPHS, VERSIONS) + "SELECT * FROM versions",
        "gen_kill": _with(GRAPHS, VERSIONS)
        + "SELECT graph_id, node, var, string_agg(version, ',' ORDER BY version) AS gen, "
        "max(version) AS kill_below FROM versions GROUP BY 1, 2, 3",
        "reaching_definitions": _with(GRAPHS, VERSIONS, REACHING, recursive=True)
        + "SELECT * FROM reaching",
        "base_names": _with(VERSIONED)
        + "SELECT DISTINCT name, regexp_replace(name, '_[0-9]+$', '') AS base FROM names",
        "max_versions": _with(VERSIONED)
        + """, versions AS (
  SELECT file, regexp_extract(name, '^(.*)_([0-9]+)$', 1) AS var, regexp_extract(name, '^(.*)_([0-9]+)$', 2) AS version FROM names
  UNION ALL
  SELECT file, regexp_extract(name, '^(.*)_([0-9]+)_[0-9]+$', 1), regexp_extract(name, '^(.*)_([0-9]+)_[0-9]+$', 2) FROM names),
flags(flag) AS (VALUES ('A'), ('N'), ('R')),
wanted AS (
  SELECT o_orderkey AS file, flag || CASE WHEN n = 0 THEN '' ELSE '_' || n END AS var
  FROM orders CROSS JOIN flags CROSS JOIN range(8) t(n))
SELECT w.file, w.var, coalesce(max(CAST(nullif(v.version, '') AS BIGINT)), 0) AS version
FROM wanted w LEFT JOIN versions v ON v.file = w.file AND v.var = w.var GROUP BY w.file, w.var""",
        "assignment_refs": _with(TEXTS, OCCURRENCES)
        + "SELECT file, CAST(line AS INT) AS line, CAST(col AS INT) AS col, kind, var, "
        "array_to_string(refs, ',') AS refs FROM occurrences",
        "parent_map": _with(TEXTS, OCCURRENCES)
        + "SELECT file, var, array_to_string(refs, ',') AS refs FROM parent_map",
    }
