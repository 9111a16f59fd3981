"""Independent SQL for the named queries, for an engine other than Spark."""

from __future__ import annotations

from ledgerloom.operators.learning import FEATURE_SETS
from ledgerloom.operators.neighbors import patterned_scorer
from ledgerloom.operators.training import NODE_FEATURES
from ledgerloom.plans.queries import SUBSET

RAW = """raw AS (
SELECT CAST(1 + (datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 744) // 2500 AS INTEGER) AS step,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'TRANSFER' WHEN '2-HIGH' THEN 'CASH_OUT' WHEN '3-MEDIUM' THEN 'PAYMENT'
       WHEN '4-NOT SPECIFIED' THEN 'CASH_IN' ELSE 'DEBIT' END AS type,
  l_extendedprice AS amount,
  'C' || CAST(o_custkey AS VARCHAR) AS nameOrig,
  CASE WHEN c_acctbal < 0 THEN 0.0e0 ELSE o_totalprice END AS oldbalanceOrg,
  CASE WHEN c_acctbal < 0 THEN 0.0e0 ELSE round(greatest(o_totalprice - l_extendedprice, 0), 2) END AS newbalanceOrig,
  CASE WHEN l_returnflag = 'R' THEN 'M' || CAST(l_suppkey AS VARCHAR)
       ELSE 'C' || CAST(2 * (l_partkey // 2) AS VARCHAR) END AS nameDest,
  CASE WHEN l_returnflag = 'R' THEN 0.0e0 ELSE round(p_retailprice * l_quantity, 2) END AS oldbalanceDest,
  CASE WHEN l_returnflag = 'R' THEN 0.0e0
       ELSE round(round(p_retailprice * l_quantity, 2) + l_extendedprice, 2) END AS newbalanceDest,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') AND c_acctbal >= 0
        AND l_extendedprice >= o_totalprice THEN 1 ELSE 0 END AS isFraud,
  CASE WHEN o_orderpriority = '1-URGENT' AND c_acctbal >= 0
        AND l_extendedprice >= o_totalprice AND l_extendedprice > 50000 THEN 1 ELSE 0 END AS isFlaggedFraud
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""

COLUMNS = [
    "step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig",
    "nameDest", "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud",
]
MONEY = {"amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"}
_CELLS = ", ".join(
    f"coalesce(CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR), 'NULL')" if c in MONEY else f"coalesce(CAST({c} AS VARCHAR), 'NULL')"
    for c in COLUMNS
)
TX = f"tx AS MATERIALIZED (SELECT sha256(concat_ws('||', {_CELLS})) AS txn_id, * FROM raw)"
EDGES = "edges AS (SELECT txn_id, nameOrig AS src, nameDest AS dst, * EXCLUDE (txn_id, nameOrig, nameDest) FROM tx)"
TRAIN_LINKS = "links AS MATERIALIZED (SELECT nameOrig AS src, nameDest AS dst FROM tx WHERE step <= 480)"
SCORED = """scored AS MATERIALIZED (
SELECT *, 1 / (1 + exp(-z)) AS p FROM (
  SELECT *, -4.0e0 + 4.0e0 * CAST(oldbalanceOrg > 0 AND newbalanceOrig = 0 AS INTEGER)
    + 1.0e0 * CAST(type IN ('TRANSFER', 'CASH_OUT') AS INTEGER) + 0.5e0 * (step % 3)
    + CASE WHEN type = 'DEBIT' THEN 0.0e0 ELSE floor(amount / 50.0e0) * 0.001e0 END AS z FROM tx))"""
SPLIT = "CASE WHEN step <= 480 THEN 'train' WHEN step <= 600 THEN 'val' ELSE 'test' END"
ATTRIBUTES = """ln(1 + amount) AS log_amount, newbalanceOrig + amount - oldbalanceOrg AS errorBalanceOrig,
  oldbalanceDest + amount - newbalanceDest AS errorBalanceDest, CAST(type = 'TRANSFER' AS INTEGER) AS is_transfer"""
ATTRS = ["log_amount", "errorBalanceOrig", "errorBalanceDest", "is_transfer"]


def sql(*steps: str) -> str:
    """CTEs over the sample tables, then the final select."""
    *ctes, final = steps
    return "WITH " + ",\n".join([RAW, *ctes]) + "\n" + final


def over_tx(*steps: str) -> str:
    return sql(TX, *steps)


def near(expr: str, places: int, name: str | None = None) -> str:
    """Rounded value without a negative zero."""
    return f"round({expr}, {places}) + 0 AS {name or expr}"


def number(value: float) -> str:
    return f"CAST('{float(value)!r}' AS DOUBLE)"


# --- ranks ---------------------------------------------------------------------


def rank_steps(links: str, rounds: int, weighted: bool) -> list[str]:
    """Power iteration unrolled into one CTE per round."""
    weight = "count(*)" if weighted else "1"
    steps = [
        f"pairs AS MATERIALIZED (SELECT src, dst, CAST({weight} AS DOUBLE) AS w FROM {links} GROUP BY src, dst)",
        "outs AS MATERIALIZED (SELECT src, sum(w) AS out_w FROM pairs GROUP BY src)",
        "verts AS MATERIALIZED (SELECT src AS id FROM pairs UNION SELECT dst FROM pairs)",
        "size AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM verts)",
        "r0 AS MATERIALIZED (SELECT id, 1 / n AS rank FROM verts, size)",
    ]
    for k in range(1, rounds + 1):
        steps.append(
            f"""r{k} AS MATERIALIZED (
SELECT v.id, 0.15e0 / n + 0.85e0 * coalesce(lost.mass, 0) / n + 0.85e0 * coalesce(s.got, 0) AS rank
FROM verts v CROSS JOIN size CROSS JOIN
  (SELECT sum(rank) AS mass FROM r{k - 1} WHERE id NOT IN (SELECT src FROM outs)) lost
LEFT JOIN (SELECT dst, sum(w / out_w * rank) AS got FROM pairs JOIN outs USING (src) JOIN r{k - 1} ON src = id GROUP BY dst) s
  ON s.dst = v.id)"""
        )
    return steps


def delta_steps(rounds: int) -> list[str]:
    parts = [
        f"SELECT {k} AS round, sum(abs(a.rank - b.rank)) AS l1_delta FROM r{k} a JOIN r{k - 1} b USING (id)"
        for k in range(1, rounds + 1)
    ]
    return ["deltas AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"]


WEIGHTED = [TRAIN_LINKS, *rank_steps("links", 10, True)]
# Rounds unrolled for the tolerance variant; the first that meets the rule is taken.
UNROLLED = 30
UNWEIGHTED = [
    *rank_steps("risk_links", UNROLLED, False),
    *delta_steps(UNROLLED),
    "stop AS (SELECT min(round) AS k FROM deltas, size WHERE l1_delta < n * 1e-6)",
    "ranks AS MATERIALIZED ("
    + " UNION ALL ".join(f"SELECT id, rank FROM r{k}, stop WHERE k = {k}" for k in range(1, UNROLLED + 1))
    + ")",
]
RISK = "risk AS MATERIALIZED (SELECT * FROM tx WHERE type IN ('TRANSFER', 'CASH_OUT'))"
RISK_LINKS = "risk_links AS (SELECT nameOrig AS src, nameDest AS dst FROM risk)"

# --- ids and node features --------------------------------------------------------

IDS = """ids AS MATERIALIZED (
SELECT account, row_number() OVER (ORDER BY first) - 1 AS node_id FROM (
  SELECT account, min(first) AS first FROM (
    SELECT nameOrig AS account, printf('0|%06d|%s', step, txn_id) AS first FROM risk
    UNION ALL SELECT nameDest, printf('1|%06d|%s', step, txn_id) FROM risk) GROUP BY account))"""
MAPPED = """mapped AS MATERIALIZED (
SELECT r.*, o.node_id AS orig_id, d.node_id AS dest_id
FROM risk r JOIN ids o ON o.account = nameOrig JOIN ids d ON d.account = nameDest)"""
NODES_RAW = """nodes_raw AS MATERIALIZED (
SELECT i.node_id, i.account, coalesce(out_degree, 0) AS out_degree, coalesce(out_total_amt, 0) AS out_total_amt,
  coalesce(in_degree, 0) AS in_degree, coalesce(in_total_amt, 0) AS in_total_amt, coalesce(rank, 0) AS pagerank
FROM ids i
LEFT JOIN (SELECT orig_id, count(*) AS out_degree, sum(amount) AS out_total_amt FROM mapped GROUP BY 1) o ON o.orig_id = i.node_id
LEFT JOIN (SELECT dest_id, count(*) AS in_degree, sum(amount) AS in_total_amt FROM mapped GROUP BY 1) d ON d.dest_id = i.node_id
LEFT JOIN ranks ON ranks.id = i.account)"""
NODES = (
    "nodes AS MATERIALIZED (SELECT node_id, account, "
    + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in NODE_FEATURES)
    + " FROM nodes_raw)"
)
ID_STEPS = [RISK, IDS, MAPPED]
NODE_STEPS = [*ID_STEPS, RISK_LINKS, *UNWEIGHTED, NODES_RAW, NODES]
EDGE_ATTRS = f"edge_attrs AS MATERIALIZED (SELECT txn_id, step, orig_id, dest_id, isFraud, {ATTRIBUTES} FROM mapped)"
EDGE_STATS = (
    "edge_stats AS (SELECT "
    + ", ".join(f"avg({c}) AS {c}_m, greatest(stddev_samp({c}), 1e-6) AS {c}_s" for c in ATTRS)
    + " FROM edge_attrs WHERE step <= 480)"
)
EDGE_NORM = (
    "edge_norm AS MATERIALIZED (SELECT txn_id, step, orig_id, dest_id, "
    + ", ".join(f"({c} - {c}_m) / {c}_s AS {c}" for c in ATTRS)
    + " FROM edge_attrs, edge_stats)"
)


def mean_step(name: str, nodes: str, columns: list[str], where: str = "") -> str:
    """Mean over incoming edges of the senders' columns, zeros without any."""
    sums = ", ".join(f"avg(s.{c}) AS {c}" for c in columns)
    cells = ", ".join(f"coalesce(m.{c}, 0) AS {c}" for c in columns)
    return (
        f"{name} AS MATERIALIZED (SELECT n.node_id, {cells} FROM nodes n LEFT JOIN "
        f"(SELECT dest_id, {sums} FROM mapped JOIN {nodes} s ON s.node_id = orig_id {where} GROUP BY dest_id) m "
        "ON m.dest_id = n.node_id)"
    )


def linear(weights, cells: list[str]) -> str:
    return " + ".join(f"{number(w)} * {c}" for w, c in zip(weights, cells, strict=True))


SCORER = patterned_scorer()


def sage_layer(layer: int, mean: list[str] | None, own: list[str]) -> list[str]:
    """Hidden units of a layer as SQL, from cells holding the mean and the own vector."""
    neighbor, bias, self_weight = (
        (SCORER.neighbor_1, SCORER.bias_1, SCORER.own_1) if layer == 1 else (SCORER.neighbor_2, SCORER.bias_2, SCORER.own_2)
    )
    units = []
    for j in range(SCORER.hidden):
        heard = f"{linear(neighbor[j], mean)} + " if mean else ""
        units.append(f"greatest({heard}{number(bias[j])} + {linear(self_weight[j], own)}, 0)")
    return units


def classifier(cells: list[str]) -> str:
    hidden = [
        f"greatest({linear(SCORER.dense_1[j], cells)} + {number(SCORER.dense_bias_1[j])}, 0)" for j in range(SCORER.hidden)
    ]
    return f"{linear(SCORER.dense_2[0], hidden)} + {number(SCORER.dense_bias_2[0])}"


def sage_steps() -> list[str]:
    first = sage_layer(1, [f"m.{c}" for c in NODE_FEATURES], [f"n.{c}" for c in NODE_FEATURES])
    second = sage_layer(2, ["m.h0", "m.h1"], ["n.h0", "n.h1"])
    cells = ["a.h0", "a.h1", "b.h0", "b.h1", *[f"e.{c}" for c in ATTRS]]
    return [
        mean_step("m1", "nodes", NODE_FEATURES),
        f"g1 AS MATERIALIZED (SELECT n.node_id, {first[0]} AS h0, {first[1]} AS h1 FROM nodes n JOIN m1 m USING (node_id))",
        mean_step("m2", "g1", ["h0", "h1"]),
        f"g2 AS MATERIALIZED (SELECT n.node_id, {second[0]} AS h0, {second[1]} AS h1 FROM g1 n JOIN m2 m USING (node_id))",
        f"SELECT e.txn_id, {near(classifier(cells), 6, 'logit')} FROM edge_norm e "
        "JOIN g2 a ON a.node_id = orig_id JOIN g2 b ON b.node_id = dest_id",
    ]


def pair_steps(source: str) -> list[str]:
    """Two-node scoring of rows with src_* and dst_* features and attributes."""
    src, dst = ([f"{s}_{c}" for c in NODE_FEATURES] for s in ("src", "dst"))
    s1, d1 = sage_layer(1, None, src), sage_layer(1, src, dst)
    s2, d2 = sage_layer(2, None, ["s0", "s1"]), sage_layer(2, ["s0", "s1"], ["d0", "d1"])
    return [
        f"p1 AS (SELECT *, {s1[0]} AS s0, {s1[1]} AS s1, {d1[0]} AS d0, {d1[1]} AS d1 FROM {source})",
        f"p2 AS (SELECT *, {s2[0]} AS t0, {s2[1]} AS t1, {d2[0]} AS u0, {d2[1]} AS u1 FROM p1)",
        f"logits AS (SELECT txn_id, {classifier(['t0', 't1', 'u0', 'u1', *ATTRS])} AS logit FROM p2)",
    ]


def _ends(src: str, dst: str) -> str:
    return ", ".join(f"coalesce({t}.{c}, 0) AS {s}_{c}" for s, t in (("src", src), ("dst", dst)) for c in NODE_FEATURES)


PAIR_ROWS = f"""pair_rows AS (SELECT e.txn_id, {", ".join(f"e.{c}" for c in ATTRS)}, {_ends("a", "b")}
FROM edge_norm e JOIN nodes a ON a.node_id = orig_id JOIN nodes b ON b.node_id = dest_id)"""
REQUEST_ROWS = f"""request_rows AS (SELECT t.txn_id, {", ".join(f"(t.{c} - {c}_m) / {c}_s AS {c}" for c in ATTRS)}, {_ends("a", "b")},
  a.account IS NULL AS src_is_new, b.account IS NULL AS dst_is_new, t.nameOrig, t.nameDest
FROM (SELECT *, {ATTRIBUTES} FROM tx) t CROSS JOIN edge_stats
LEFT JOIN nodes a ON a.account = nameOrig LEFT JOIN nodes b ON b.account = nameDest)"""
REQUEST_STEPS = [*NODE_STEPS, EDGE_ATTRS, EDGE_STATS, REQUEST_ROWS]
DECISIONS = """SELECT txn_id AS transaction_id, round(1 / (1 + exp(-logit)), 4) AS fraud_probability,
  CASE WHEN 1 / (1 + exp(-logit)) > 0.85 THEN 'BLOCK' ELSE 'ALLOW' END AS action, 'success' AS status FROM logits"""

# --- features ------------------------------------------------------------------------

TABULAR = """txn_id, step, type, amount, oldbalanceOrg, newbalanceOrig, oldbalanceDest, newbalanceDest, isFraud,
  oldbalanceOrg - newbalanceOrig AS deltaOrig, newbalanceDest - oldbalanceDest AS deltaDest,
  CASE WHEN oldbalanceOrg = 0 THEN 1 ELSE 0 END AS orig_zero_before_txn,
  CASE WHEN oldbalanceDest = 0 THEN 1 ELSE 0 END AS dest_zero_before_txn,
  CASE WHEN oldbalanceOrg > 0 THEN amount / oldbalanceOrg ELSE 0.0e0 END AS "amount_to_oldbalanceOrg_ratio",
  CASE WHEN oldbalanceDest > 0 THEN amount / oldbalanceDest ELSE 0.0e0 END AS "amount_to_oldbalanceDest_ratio\""""
DEGREES = """count(*) OVER (PARTITION BY nameOrig) AS src_total_out_degree,
  count(*) OVER (PARTITION BY nameDest) AS dst_total_in_degree,
  count(*) OVER (PARTITION BY nameOrig, step) AS src_step_txn_count,
  count(*) OVER (PARTITION BY nameDest, step) AS dst_step_txn_count,
  count(*) OVER (PARTITION BY nameOrig ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src_prev_steps_out_count,
  count(*) OVER (PARTITION BY nameDest ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dst_prev_steps_in_count"""
TX_RANKS = "LEFT JOIN r10 a ON a.id = nameOrig LEFT JOIN r10 b ON b.id = nameDest"
RANK_CELLS = "round(coalesce(a.rank, 0), 10) AS src_pagerank, round(coalesce(b.rank, 0), 10) AS dst_pagerank"
TRAINING_ROWS = over_tx(*WEIGHTED, f"SELECT {TABULAR}, {DEGREES}, {RANK_CELLS} FROM tx {TX_RANKS}")


def step_counts(account: str, side: str) -> str:
    return f"SELECT {account} AS account, step, count(*) AS n, '{side}' AS side FROM tx GROUP BY {account}, step"


def history(account: str, name: str) -> str:
    return over_tx(
        f"c AS (SELECT {account} AS account, step, count(*) AS n FROM tx GROUP BY ALL)",
        f"SELECT account, step, CAST(coalesce(sum(n) OVER (PARTITION BY account ORDER BY step "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS {name} FROM c",
    )


# --- exploration ----------------------------------------------------------------------

TYPED = {c: "string" if c in ("txn_id", "type", "nameOrig", "nameDest") else "double" if c in MONEY else "int" for c in ["txn_id", *COLUMNS]}
NUMERIC = [c for c, t in TYPED.items() if t != "string"]


def union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def describe_part(column: str, source: str, name: str, places: int) -> str:
    x = f"CAST({column} AS DOUBLE)"
    quart = ", ".join(f"round(quantile_cont({x}, 0.{q}), {places}) AS q{q}" for q in (25, 50, 75))
    return (
        f"SELECT '{name}' AS \"column\", count({column}) AS \"count\", round(avg({x}), {places}) AS mean, "
        f"round(stddev_samp({x}), {places}) AS std, round(min({x}), {places}) AS min, {quart}, "
        f"round(max({x}), {places}) AS max FROM {source}"
    )


def histogram(values: str) -> str:
    """50 bins over ``values``, a subquery with column x."""
    return over_tx(
        f"v AS MATERIALIZED ({values})",
        "span AS (SELECT min(x) AS lo, (max(x) - min(x)) / 50 AS w FROM v)",
        "filled AS (SELECT least(CAST(floor((x - lo) / w) AS BIGINT), 49) AS bin, count(*) AS n FROM v, span GROUP BY 1)",
        "SELECT CAST(b.range AS INTEGER) AS bin, round(lo + b.range * w, 6) AS lo, round(lo + (b.range + 1) * w, 6) AS hi, "
        "coalesce(n, 0) AS n FROM range(50) b CROSS JOIN span LEFT JOIN filled ON filled.bin = b.range",
    )


def box(value: str, places: int) -> str:
    quart = ", ".join(f"quantile_cont(x, 0.{q}) AS q{q}" for q in (25, 50, 75))
    return over_tx(
        f"v AS MATERIALIZED (SELECT isFraud, {value} AS x FROM tx)",
        f"q AS (SELECT isFraud, {quart} FROM v GROUP BY 1)",
        "j AS (SELECT *, x BETWEEN q25 - (q75 - q25) * 1.5e0 AND q75 + (q75 - q25) * 1.5e0 AS inside FROM v JOIN q USING (isFraud))",
        "SELECT isFraud, " + ", ".join(f"round(any_value({c}), {places}) AS {c}" for c in ("q25", "q50", "q75"))
        + f", round(min(x) FILTER (inside), {places}) AS whisker_low, round(max(x) FILTER (inside), {places}) AS whisker_high, "
        "count(*) FILTER (NOT inside) AS n_outliers FROM j GROUP BY isFraud",
    )


EDA_COLUMNS = [*NUMERIC, "log_amount", "orig_balance_diff", "dest_balance_diff"]
EDA = (
    "e AS MATERIALIZED (SELECT *, ln(1 + amount) AS log_amount, oldbalanceOrg - newbalanceOrig AS orig_balance_diff, "
    "newbalanceDest - oldbalanceDest AS dest_balance_diff FROM tx)"
)

# --- metrics -----------------------------------------------------------------------------


def prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    return (
        f"coalesce({tp} / nullif(CAST({tp} + {fp} AS DOUBLE), 0), 0) AS precision, "
        f"coalesce({tp} / nullif(CAST({tp} + {fn} AS DOUBLE), 0), 0) AS recall"
    )


F1 = "coalesce(precision * recall * 2 / nullif(precision + recall, 0), 0) AS f1"


def confusion(predicted: str) -> str:
    return ", ".join(
        f"count(*) FILTER ({p} AND isFraud = {y}) AS {n}"
        for n, p, y in (
            ("tp", predicted, 1), ("fp", predicted, 0), ("fn", f"NOT ({predicted})", 1), ("tn", f"NOT ({predicted})", 0)
        )
    )


def average_precision(source: str, groups: str) -> str:
    """Sub-select of average precision per group."""
    keys = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups} " if groups else ""
    by = f"GROUP BY {groups}" if groups else ""
    return (
        f"SELECT {keys}coalesce(sum(hits * top / seen) / nullif(sum(hits), 0), 0) AS ap FROM ("
        f"SELECT {keys}hits, CAST(sum(hits) OVER ({part}ORDER BY p DESC) AS DOUBLE) AS top, "
        f"CAST(sum(n) OVER ({part}ORDER BY p DESC) AS DOUBLE) AS seen FROM ("
        f"SELECT {keys}p, count(*) AS n, sum(isFraud) AS hits FROM {source} GROUP BY {keys}p)) {by}"
    )


SWEEP = [
    SCORED,
    "counts AS MATERIALIZED (SELECT p, count(*) FILTER (isFraud = 1) AS pos, count(*) FILTER (isFraud = 0) AS neg FROM scored GROUP BY p)",
    "points AS (SELECT range / 100.0e0 AS threshold FROM range(1, 100))",
    f"""sweep AS MATERIALIZED (SELECT *, {F1} FROM (SELECT threshold, {prf()} FROM (
  SELECT threshold, coalesce(sum(pos) FILTER (p > threshold), 0) AS tp, coalesce(sum(neg) FILTER (p > threshold), 0) AS fp,
    coalesce(sum(pos) FILTER (NOT p > threshold), 0) AS fn FROM points, counts GROUP BY threshold)))""",
]
FEED = """feed AS (SELECT txn_id, nameOrig, nameDest, CASE WHEN p > 0.5 THEN 'FRAUD' ELSE 'VALID' END AS prediction,
  CASE WHEN isFraud = 1 THEN 'FRAUD' ELSE 'VALID' END AS actual, row_number() OVER (ORDER BY step, txn_id) AS ordinal
  FROM scored WHERE type IN ('TRANSFER', 'CASH_OUT') AND step > 600)"""

# What is damaged in the sample requests, first field first.
REASON = (
    "CASE WHEN nameOrig = nameDest THEN 'step: invalid' WHEN isFlaggedFraud = 1 THEN 'amount: invalid' "
    "WHEN oldbalanceDest = 0 AND type = 'DEBIT' THEN 'nameDest: missing' END"
)
SOUND = "nameOrig <> nameDest AND isFlaggedFraud = 0 AND NOT (oldbalanceDest = 0 AND type = 'DEBIT')"

# --- reports ---------------------------------------------------------------------------------


def records(name: str, shift: float) -> list[str]:
    """Metric records per type and split, rounded, with the logit shifted."""
    return [
        f"{name}_s AS MATERIALIZED (SELECT type, {SPLIT} AS split, isFraud, 1 / (1 + exp(-(z + {shift}e0))) AS p FROM scored)",
        f"{name}_c AS (SELECT type, split, {confusion('p >= 0.5')} FROM {name}_s GROUP BY ALL)",
        f"{name}_p AS (SELECT *, {F1} FROM (SELECT *, {prf()} FROM {name}_c))",
        f"{name} AS MATERIALIZED (SELECT type || '_' || split AS run_name, type, split, round(ap, 6) AS auc_pr, "
        f"round(precision, 6) AS precision_at_0_5, round(recall, 6) AS recall_at_0_5, round(f1, 6) AS f1_at_0_5 "
        f"FROM {name}_p JOIN ({average_precision(f'{name}_s', 'type, split')}) USING (type, split))",
    ]


RUNS = [
    SCORED,
    *records("older", 0.0),
    *records("newer", 1.0),
    "runs AS MATERIALIZED (SELECT run_name, auc_pr, recall_at_0_5, f1_at_0_5, 'day2' AS source, "
    "CAST(NULL AS DOUBLE) AS precision_at_0_5 FROM older "
    "UNION ALL SELECT run_name, auc_pr, recall_at_0_5, f1_at_0_5, 'day3', precision_at_0_5 FROM newer WHERE split <> 'train')",
    "latest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run_name ORDER BY source DESC) = 1)",
]
METRICS = ("auc_pr", "recall_at_0_5", "f1_at_0_5")
BEST = (
    "best AS ("
    + union_all(
        [
            f"(SELECT '{m}' AS metric, run_name, {m} AS value FROM latest ORDER BY {m} DESC NULLS LAST, run_name LIMIT 1)"
            for m in METRICS
        ]
    )
    + ")"
)
SCALING = [
    "daily AS (SELECT (step - 1) // 24 AS day, count(*) AS n FROM tx GROUP BY 1)",
    """firsts AS (SELECT day, count(*) AS accounts FROM (SELECT id, min((step - 1) // 24) AS day FROM (
  SELECT nameOrig AS id, step FROM tx UNION ALL SELECT nameDest, step FROM tx) GROUP BY id) GROUP BY day)""",
    """sizes AS (SELECT (day + 1) * 24 AS step_max, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS edges,
  CAST(sum(coalesce(accounts, 0)) OVER (ORDER BY day) AS BIGINT) AS vertices FROM daily LEFT JOIN firsts USING (day))""",
    """scaling AS (SELECT 'exp_local' || cores || '_step' || step_max AS experiment_id, 'local[' || cores || ']' AS master,
  CAST(step_max AS INTEGER) AS step_max, edges AS subset_rows, vertices AS vertex_count, edges AS edge_count,
  round(edges / (cores * 100.0e0), 4) AS "graph_features_sec", round(edges / (cores * 50.0e0), 4) AS total_runtime_sec,
  'SUCCESS' AS status FROM sizes CROSS JOIN (VALUES (1), (2)) m(cores))""",
]
TYPES = ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"]
SUBSET_ROWS = f"sub AS (SELECT * FROM tx WHERE step BETWEEN {SUBSET[0]} AND {SUBSET[1]})"

ORACLES: dict[str, str] = {
    # ingest
    "ingest_clean": sql(
        "dirty AS (SELECT * REPLACE ('  ' || lower(type) || ' ' AS type, nullif(step, 744) AS step, "
        "nullif(nameDest, nameOrig) AS nameDest) FROM raw)",
        "SELECT * REPLACE (upper(trim(type)) AS type) FROM dirty WHERE step IS NOT NULL AND nameOrig IS NOT NULL AND nameDest IS NOT NULL",
    ),
    "ingest_txn_id": over_tx("SELECT * FROM tx"),
    "ingest_summary": sql(
        "SELECT count(*) AS total_rows, CAST(sum(isFraud) AS BIGINT) AS fraud_rows, min(step) AS min_step, max(step) AS max_step FROM raw"
    ),
    "ingest_summary_sketches": over_tx(
        union_all(
            [
                f"SELECT {low} AS low, {high} AS high, count(*) AS total_rows, CAST(sum(isFraud) AS BIGINT) AS fraud_rows, min(step) AS min_step, "
                f"max(step) AS max_step, true AS senders_near, true AS receivers_near FROM tx WHERE step BETWEEN {24 * low + 1} AND {24 * high + 24}"
                for low, high in ((2, 8), (0, 29), (0, 10_000))
            ]
        )
    ),
    "subset_step_range": over_tx(SUBSET_ROWS, "SELECT * FROM sub"),
    "subset_summary": over_tx(
        SUBSET_ROWS,
        f"SELECT {SUBSET[0]} AS requested_min_step, {SUBSET[1]} AS requested_max_step, min(step) AS actual_min_step, "
        "max(step) AS actual_max_step, count(*) AS total_rows, count(*) FILTER (isFraud = 1) AS fraud_rows FROM sub",
    ),
    "filter_high_risk": over_tx("SELECT * FROM tx WHERE type IN ('TRANSFER', 'CASH_OUT')"),
    # graph
    "graph_vertices": over_tx(
        "s AS (SELECT DISTINCT nameOrig AS id FROM tx)",
        "r AS (SELECT DISTINCT nameDest AS id FROM tx)",
        "SELECT coalesce(s.id, r.id) AS id, CAST(s.id IS NOT NULL AS INTEGER) AS is_sender, CAST(r.id IS NOT NULL AS INTEGER) AS is_receiver, "
        "CASE WHEN r.id IS NULL THEN 'sender_only' WHEN s.id IS NULL THEN 'receiver_only' ELSE 'both' END AS vertex_role "
        "FROM s FULL JOIN r ON s.id = r.id",
    ),
    "graph_edges": over_tx(EDGES, "SELECT * FROM edges"),
    "graph_weighted_edges": over_tx(EDGES, "SELECT src, dst, count(*) AS edge_weight FROM edges GROUP BY src, dst"),
    "graph_self_loops": over_tx(EDGES, "SELECT * FROM edges WHERE src = dst"),
    "graph_summary": over_tx(
        "SELECT (SELECT count(*) FROM (SELECT nameOrig FROM tx UNION SELECT nameDest FROM tx)) AS vertex_count, count(*) AS edge_count, "
        "count(*) FILTER (nameOrig = nameDest) AS self_loops, count(DISTINCT (nameOrig, nameDest)) AS distinct_pairs FROM tx"
    ),
    "graph_dangling": over_tx("SELECT DISTINCT nameDest AS id FROM tx WHERE nameDest NOT IN (SELECT nameOrig FROM tx)"),
    # features
    "tabular_features": over_tx(f"SELECT {TABULAR} FROM tx"),
    "degree_totals": over_tx(
        "SELECT nameOrig AS account, count(*) AS degree, 'out' AS side FROM tx GROUP BY 1 "
        "UNION ALL SELECT nameDest, count(*), 'in' FROM tx GROUP BY 1"
    ),
    "degree_step_counts": over_tx(union_all([step_counts("nameOrig", "out"), step_counts("nameDest", "in")])),
    "history_src": history("nameOrig", "src_prev_steps_out_count"),
    "history_dst": history("nameDest", "dst_prev_steps_in_count"),
    "degree_features": over_tx(f"SELECT txn_id, {DEGREES} FROM tx"),
    # ranks
    "pagerank_vertices": over_tx(TRAIN_LINKS, "SELECT src AS id FROM links UNION SELECT dst FROM links"),
    "pagerank_transition": over_tx(
        TRAIN_LINKS,
        "SELECT src, dst, count(*) / CAST(any_value(o) AS DOUBLE) AS transition_prob "
        "FROM links JOIN (SELECT src, count(*) AS o FROM links GROUP BY src) USING (src) GROUP BY src, dst",
    ),
    "pagerank_weighted": over_tx(*WEIGHTED, "SELECT id, round(rank, 10) AS pagerank FROM r10"),
    "pagerank_delta": over_tx(*WEIGHTED, *delta_steps(10), "SELECT round, round(l1_delta, 10) AS l1_delta FROM deltas"),
    "pagerank_unweighted": over_tx(RISK, RISK_LINKS, *UNWEIGHTED, "SELECT id, round(rank, 10) AS pagerank FROM ranks"),
    "pagerank_txn_features": over_tx(*WEIGHTED, f"SELECT txn_id, {RANK_CELLS} FROM tx {TX_RANKS}"),
    # training rows
    "training_dataset": TRAINING_ROWS,
    "training_dataset_joined": TRAINING_ROWS,
    "training_dataset_bucketed": TRAINING_ROWS,
    "dataset_summary": over_tx("SELECT count(*) AS total_rows, count(*) FILTER (isFraud = 1) AS fraud_rows FROM tx"),
    "split_assign": over_tx(f"SELECT txn_id, step, {SPLIT} AS split FROM tx"),
    "split_summary": over_tx(
        f"SELECT {SPLIT} AS split, count(*) AS rows, count(*) FILTER (isFraud = 1) AS fraud_rows FROM tx GROUP BY 1"
    ),
    "split_bounds": over_tx(
        "t AS (SELECT DISTINCT step AS m, greatest(1, CAST(floor(step * 0.67e0) AS INTEGER)) AS a FROM tx)",
        "v AS (SELECT m, a, greatest(a + 1, CAST(floor(m * 0.83e0) AS INTEGER)) AS b FROM t)",
        "SELECT m AS last_step, a AS train_max, CASE WHEN m > 2 THEN least(b, m - 1) ELSE m END AS val_max, m AS test_max FROM v",
    ),
    "class_weight": over_tx(
        "w AS (SELECT CAST(greatest(count(*) FILTER (isFraud = 0), 1) AS DOUBLE) / greatest(count(*) FILTER (isFraud = 1), 1) AS pw "
        "FROM tx WHERE step <= 480)",
        "SELECT txn_id, isFraud, CASE WHEN step <= 480 AND isFraud = 1 THEN round(pw, 9) ELSE 1.0e0 END AS class_weight FROM tx, w",
    ),
    "class_counts": over_tx("SELECT isFraud, count(*) AS n FROM tx GROUP BY 1"),
    # ids, nodes, edges
    "account_ids": over_tx(RISK, IDS, "SELECT account, node_id FROM ids"),
    "account_ids_mapped": over_tx(*ID_STEPS, "SELECT * FROM mapped"),
    "edge_features": over_tx(
        *ID_STEPS, EDGE_ATTRS, "SELECT * REPLACE (round(log_amount, 9) AS log_amount) FROM edge_attrs"
    ),
    "node_features_raw": over_tx(
        *NODE_STEPS,
        "SELECT node_id, out_degree, round(out_total_amt, 2) AS out_total_amt, in_degree, round(in_total_amt, 2) AS in_total_amt, "
        "round(pagerank, 10) AS pagerank FROM nodes_raw",
    ),
    "node_features_scaled": over_tx(
        *NODE_STEPS, "SELECT node_id, " + ", ".join(near(c, 6) for c in NODE_FEATURES) + " FROM nodes"
    ),
    "edge_attr_normalized": over_tx(
        *ID_STEPS, EDGE_ATTRS, EDGE_STATS, EDGE_NORM,
        "SELECT txn_id, " + ", ".join(near(c, 6) for c in ATTRS) + " FROM edge_norm",
    ),
    "graph_pack_nodes": over_tx(
        *NODE_STEPS,
        "SELECT node_id, " + ", ".join(near(f"CAST(CAST({c} AS FLOAT) AS DOUBLE)", 4, f"x_{i}") for i, c in enumerate(NODE_FEATURES)) + " FROM nodes",
    ),
    "graph_pack_edges": over_tx(
        *ID_STEPS, EDGE_ATTRS,
        "SELECT orig_id, dest_id, isFraud AS edge_label, CAST(step AS BIGINT) AS edge_time, step <= 480 AS is_train, "
        "step > 480 AND step <= 600 AS is_val, step > 600 AS is_test, "
        + ", ".join(near(f"CAST(CAST({c} AS FLOAT) AS DOUBLE)", 4, f"attr_{i}") for i, c in enumerate(ATTRS)) + " FROM edge_attrs",
    ),
    "graph_pack_report": over_tx(
        *ID_STEPS,
        "SELECT (SELECT count(*) FROM ids) AS num_nodes, count(*) AS num_edges, count(isFraud) AS num_labels, count(step) AS num_times, "
        "count(*) FILTER (step <= 480) AS train_rows, count(*) FILTER (step > 480 AND step <= 600) AS val_rows, "
        "count(*) FILTER (step > 600) AS test_rows FROM mapped",
    ),
    # neighbourhoods
    "neighbor_mean_1hop": over_tx(
        *NODE_STEPS, mean_step("m1", "nodes", NODE_FEATURES),
        "SELECT node_id AS id, " + ", ".join(near(c, 6, f"mean_{c}") for c in NODE_FEATURES) + " FROM m1",
    ),
    "neighbor_mean_2hop": over_tx(
        *NODE_STEPS, mean_step("m1", "nodes", NODE_FEATURES), mean_step("m2", "m1", NODE_FEATURES),
        "SELECT node_id AS id, " + ", ".join(near(c, 6, f"mean2_{c}") for c in NODE_FEATURES) + " FROM m2",
    ),
    "neighbor_mean_train_only": over_tx(
        *NODE_STEPS, mean_step("m1", "nodes", NODE_FEATURES, "WHERE step <= 480"),
        "SELECT node_id AS id, " + ", ".join(near(c, 6, f"mean_{c}") for c in NODE_FEATURES) + " FROM m1",
    ),
    "sage_score": over_tx(*NODE_STEPS, EDGE_ATTRS, EDGE_STATS, EDGE_NORM, *sage_steps()),
    "sage_score_pair": over_tx(
        *NODE_STEPS, EDGE_ATTRS, EDGE_STATS, EDGE_NORM, PAIR_ROWS, *pair_steps("pair_rows"),
        "SELECT txn_id, " + near("logit", 6) + " FROM logits",
    ),
    # exploration
    "eda_head": over_tx("SELECT * FROM tx ORDER BY step, txn_id LIMIT 5"),
    "eda_schema_profile": over_tx(
        union_all([f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS rows, count({c}) AS non_null FROM tx" for c, t in TYPED.items()])
    ),
    "eda_missing": over_tx(
        union_all([f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing FROM tx" for c in TYPED])
    ),
    "eda_describe": over_tx(union_all([describe_part(c, "tx", c, 3) for c in NUMERIC])),
    "eda_label_counts": over_tx("SELECT isFraud, count(*) AS n FROM tx GROUP BY 1"),
    "eda_type_counts": over_tx("SELECT type, count(*) AS n FROM tx GROUP BY 1"),
    "eda_distinct_types": over_tx("SELECT DISTINCT type FROM tx"),
    "eda_top_fraud_senders": over_tx(
        "SELECT nameOrig AS account, count(*) AS n FROM tx WHERE isFraud = 1 GROUP BY 1 ORDER BY n DESC, account LIMIT 20"
    ),
    "eda_top_fraud_receivers": over_tx(
        "SELECT nameDest AS account, count(*) AS n FROM tx WHERE isFraud = 1 GROUP BY 1 ORDER BY n DESC, account LIMIT 20"
    ),
    "eda_crosstab": over_tx(
        "SELECT type, count(*) FILTER (isFraud = 0) AS n0, count(*) FILTER (isFraud = 1) AS n1 FROM tx GROUP BY 1"
    ),
    "eda_crosstab_rate": over_tx(
        "SELECT type, round(count(*) FILTER (isFraud = 0) / CAST(count(*) AS DOUBLE), 9) AS r0, "
        "round(count(*) FILTER (isFraud = 1) / CAST(count(*) AS DOUBLE), 9) AS r1 FROM tx GROUP BY 1"
    ),
    "eda_hist_amount": histogram("SELECT amount AS x FROM tx"),
    "eda_hist_log_amount": histogram("SELECT ln(1 + amount) AS x FROM tx"),
    "eda_hist_sender_degree": histogram("SELECT ln(1 + CAST(count(*) AS DOUBLE)) AS x FROM tx GROUP BY nameOrig"),
    "eda_box_log_amount": box("ln(1 + amount)", 6),
    "eda_box_orig_diff": box("oldbalanceOrg - newbalanceOrig", 3),
    "eda_box_dest_diff": box("newbalanceDest - oldbalanceDest", 3),
    "eda_volume_by_step": over_tx("SELECT step, count(*) AS n FROM tx GROUP BY 1"),
    "eda_fraud_by_step": over_tx("SELECT step, CAST(sum(isFraud) AS BIGINT) AS n FROM tx GROUP BY 1"),
    "eda_correlation": over_tx(
        EDA,
        union_all(
            [f"SELECT '{a}' AS col_a, '{b}' AS col_b, {near(f'corr({a}, {b})', 6, 'r')} FROM e" for a in EDA_COLUMNS for b in EDA_COLUMNS]
        ),
    ),
    "eda_degree_describe": over_tx(
        "o AS (SELECT count(*) AS degree FROM tx GROUP BY nameOrig)",
        "i AS (SELECT count(*) AS degree FROM tx GROUP BY nameDest)",
        "SELECT * EXCLUDE (\"column\"), \"column\" AS side FROM ("
        + union_all([describe_part("degree", "o", "nameOrig", 6), describe_part("degree", "i", "nameDest", 6)]) + ")",
    ),
    "eda_summary": over_tx(
        "SELECT count(*) AS total_rows, round(avg(isFraud), 9) AS fraud_ratio, count(DISTINCT nameOrig) AS unique_senders, "
        "count(DISTINCT nameDest) AS unique_receivers, (SELECT string_agg(type, ',' ORDER BY type) FROM (SELECT DISTINCT type FROM tx)) AS types FROM tx"
    ),
    # metrics
    "metrics_confusion": over_tx(SCORED, f"SELECT {confusion('p >= 0.5')} FROM scored"),
    "metrics_prf": over_tx(
        SCORED, f"c AS (SELECT {prf()} FROM (SELECT {confusion('p >= 0.5')} FROM scored))",
        f"SELECT round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM (SELECT *, {F1} FROM c)",
    ),
    "metrics_average_precision": over_tx(
        SCORED, f"SELECT round(ap, 9) AS average_precision FROM ({average_precision('scored', '')})"
    ),
    "metrics_threshold_sweep": over_tx(
        *SWEEP, "SELECT threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM sweep"
    ),
    "metrics_best_threshold": over_tx(
        *SWEEP,
        "SELECT threshold, round(f1, 9) AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall FROM "
        "(SELECT * FROM sweep WHERE f1 > 0 UNION ALL SELECT 0.5, 0, 0, 0) ORDER BY f1 DESC, threshold LIMIT 1",
    ),
    "metrics_by_split": over_tx(
        SCORED, f"s AS MATERIALIZED (SELECT *, {SPLIT} AS split FROM scored)",
        f"c AS (SELECT split, {prf()} FROM (SELECT split, {confusion('p > 0.5')} FROM s GROUP BY split))",
        f"SELECT split, round(f1, 9) AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall, round(ap, 9) AS pr_auc "
        f"FROM (SELECT *, {F1} FROM c) JOIN ({average_precision('s', 'split')}) USING (split)",
    ),
    "metrics_focal_loss": over_tx(
        SCORED,
        "b AS (SELECT isFraud, CASE WHEN isFraud = 1 THEN -ln(p) ELSE -ln(1 - p) END AS bce FROM scored)",
        "SELECT round(avg((CASE WHEN isFraud = 1 THEN 0.75e0 ELSE 0.25e0 END) * pow(1 - exp(-bce), 2) * bce), 9) AS focal_loss FROM b",
    ),
    # scoring and streams
    "score_request_validate": over_tx(
        "SELECT txn_id AS tx_id, CASE WHEN nameOrig = nameDest THEN NULL ELSE CAST(step AS DOUBLE) END AS step, "
        "CASE WHEN isFlaggedFraud = 1 THEN NULL ELSE amount END AS amount, "
        "CASE WHEN oldbalanceDest = 0 AND type = 'DEBIT' THEN NULL ELSE nameDest END AS nameDest, "
        f"{REASON} AS reason FROM tx"
    ),
    "score_node_lookup": over_tx(
        *REQUEST_STEPS,
        "SELECT txn_id AS tx_id, nameOrig, nameDest, src_is_new, dst_is_new, "
        + ", ".join(near(f"{s}_{c}", 4) for s in ("src", "dst") for c in NODE_FEATURES) + " FROM request_rows",
    ),
    "score_account_profiles": over_tx(
        *NODE_STEPS, "everyone AS (SELECT nameOrig AS account FROM tx UNION SELECT nameDest FROM tx)",
        "SELECT account, " + ", ".join(near(f"coalesce({c}, 0)", 4, c) for c in NODE_FEATURES)
        + ", node_id IS NULL AS is_new_account FROM everyone LEFT JOIN nodes USING (account)",
    ),
    "score_batch": over_tx(*REQUEST_STEPS, *pair_steps("request_rows"), DECISIONS),
    "stream_score": over_tx(*REQUEST_STEPS, *pair_steps("request_rows"), f"{DECISIONS} WHERE txn_id IN (SELECT txn_id FROM tx WHERE {SOUND})"),
    "stream_rejects": over_tx(f"SELECT txn_id AS tx_id, {REASON} AS reason FROM tx WHERE NOT ({SOUND})"),
    "score_trained": over_tx("SELECT txn_id AS transaction_id, true AS consistent, 'success' AS status FROM tx"),
    "score_report": over_tx(SCORED, "SELECT count(*) AS processed, count(*) FILTER (p > 0.5) AS alerts FROM scored"),
    "alerts_sampled": over_tx(SCORED, FEED, "SELECT * FROM feed WHERE prediction = 'FRAUD' OR ordinal % 50 = 0"),
    "stream_alerts_sampled": over_tx(SCORED, FEED, "SELECT * FROM feed WHERE prediction = 'FRAUD' OR ordinal % 50 = 0"),
    "alerts_first_rows": over_tx(
        SCORED, FEED, "SELECT * FROM feed WHERE ordinal <= 2000 AND (prediction = 'FRAUD' OR ordinal % 50 = 0)"
    ),
    "stream_ingest": over_tx("SELECT * FROM tx"),
    "stream_replay": over_tx("SELECT * FROM tx"),
    "stream_history": over_tx(
        f"d AS (SELECT txn_id, {DEGREES} FROM tx)",
        "SELECT DISTINCT txn_id, src_prev_steps_out_count, dst_prev_steps_in_count FROM d",
    ),
    "stream_alerts": over_tx(SCORED, FEED, "SELECT * EXCLUDE (ordinal) FROM feed WHERE prediction = 'FRAUD'"),
    # reports
    "runs_union": over_tx(*RUNS, "SELECT * FROM runs"),
    "runs_dedup_latest": over_tx(*RUNS, "SELECT * FROM latest"),
    "runs_best_by_metric": over_tx(*RUNS, BEST, "SELECT * FROM best"),
    "runs_best_records": over_tx(
        *RUNS, BEST,
        "SELECT b.metric, l.run_name, l.auc_pr, l.recall_at_0_5, l.f1_at_0_5, l.precision_at_0_5, l.source "
        "FROM best AS b JOIN latest AS l USING (run_name)",
    ),
    "runs_comparison_summary": over_tx(
        *RUNS, BEST,
        "SELECT (SELECT count(*) FROM latest) AS num_models_compared, "
        + ", ".join(f"(SELECT run_name FROM best WHERE metric = '{m}') AS best_by_{m}" for m in METRICS),
    ),
    "runs_metrics_wide": over_tx(
        SCORED, *records("older", 0.0),
        "SELECT 'exp_' || split AS experiment_id, "
        + ", ".join(f"max({m}) FILTER (type = '{t}') AS \"{t}_{m}\"" for t in TYPES for m in ("auc_pr", "f1_at_0_5"))
        + " FROM older GROUP BY split",
    ),
    "runs_union_ragged": over_tx(
        *SCALING,
        "SELECT * EXCLUDE (total_runtime_sec) REPLACE (CASE WHEN step_max % 120 = 0 THEN 'FAILED' ELSE status END AS status), "
        "CASE WHEN step_max % 120 <> 0 THEN total_runtime_sec END AS total_runtime_sec, "
        "CASE WHEN step_max % 120 = 0 THEN 'graph_features' END AS failed_job FROM scaling",
    ),
    "report_runtime_summary": over_tx(*SCALING, "SELECT * FROM scaling ORDER BY master, step_max"),
    "report_runtime_series": over_tx(
        *SCALING, "SELECT master AS series, step_max AS x, total_runtime_sec AS y FROM scaling ORDER BY 1, 2"
    ),
    "report_metric_series": over_tx(
        SCORED, *records("older", 0.0), "SELECT 'auc_pr' AS series, run_name AS x, auc_pr AS y FROM older"
    ),
    "log_metrics_extract": over_tx(
        "SELECT nameOrig AS log, CAST(count(*) AS DOUBLE) AS total_rows, CAST(nullif(sum(isFraud), 0) AS DOUBLE) AS fraud_rows, "
        "CASE WHEN min(step) % 2 = 0 THEN CAST(min(step) AS DOUBLE) END AS vertex_count, CAST(count(*) AS DOUBLE) AS edge_count "
        "FROM tx GROUP BY nameOrig"
    ),
    # sources and sinks
    "source_csv": sql("SELECT * FROM raw"),
    "source_requests_json": over_tx("SELECT * EXCLUDE (txn_id, isFraud, isFlaggedFraud), txn_id AS tx_id FROM tx"),
    "source_metrics_json": over_tx(
        SCORED, *records("older", 0.0),
        "SELECT run_name, auc_pr, CAST(NULL AS DOUBLE) AS auc_roc, precision_at_0_5, recall_at_0_5, f1_at_0_5 FROM older",
    ),
    "split_frames": over_tx(f"SELECT txn_id, step, {SPLIT} AS frame FROM tx"),
    # learning: what a fit must satisfy, with the counts of its test part
    "ingest_summary_approx": sql(
        "SELECT count(*) AS total_rows, CAST(sum(isFraud) AS BIGINT) AS fraud_rows, min(step) AS min_step, max(step) AS max_step, "
        "true AS senders_near, true AS receivers_near FROM raw"
    ),
    **{
        f"ml_{key}": over_tx(
            "t AS (SELECT count(*) AS test_rows, CAST(sum(isFraud) AS BIGINT) AS test_fraud FROM tx WHERE step > 600)",
            union_all([f"SELECT '{name}' AS run_name, *, true AS in_range, true AS above_base_rate FROM t" for name in names]),
        )
        for key, names in (("baseline", list(FEATURE_SETS)[:1]), ("ablation", list(FEATURE_SETS)))
    },
    **dict.fromkeys(
        ("ml_graph_mlp", "ml_graph_sage"),
        over_tx(
            "SELECT 'test' AS split, count(*) AS test_rows, CAST(sum(isFraud) AS BIGINT) AS test_fraud, true AS in_range, "
            "true AS above_base_rate FROM tx WHERE step > 600 AND type IN ('TRANSFER', 'CASH_OUT')"
        ),
    ),
    "ml_type_index": over_tx(
        "c AS (SELECT type, count(*) AS n FROM tx GROUP BY type)",
        "SELECT type, CAST(row_number() OVER (ORDER BY n DESC, type) - 1 AS DOUBLE) AS type_index, n, "
        "CAST((SELECT count(*) FROM c) + 1 AS INTEGER) AS ohe_size FROM c",
    ),
}
