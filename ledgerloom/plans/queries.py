"""Named queries over the sample tables, one per operator."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import Split
from ledgerloom.functions.expressions import EDGE_ATTRIBUTES, row_digest
from ledgerloom.functions import splits
from ledgerloom.functions.splits import proportional_bounds, split_label
from ledgerloom.operators import (
    accounts,
    eda,
    features,
    graph,
    graph_learning,
    ingest,
    learning,
    metrics,
    neighbors,
    pagerank,
    reports,
    scoring,
    sketches,
    training,
)
from ledgerloom.operators.training import NODE_FEATURES
from ledgerloom.session import materialize, scratch_path
from ledgerloom.sources import sample
from ledgerloom.sources.readers import read_metrics, read_requests_text, read_transactions
from ledgerloom.sources.writers import write_csv, write_json
from ledgerloom.streaming import history, replay
from ledgerloom.streaming import jobs as streams
from ledgerloom.streaming.sources import table_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SPLIT = Split()
SUBSET = (25, 720)
DAY_RANGES = ((2, 8), (0, 29), (0, 10_000))
BUCKETS = 16
SCORER = neighbors.patterned_scorer()


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def over_silver(fn: Callable[[DataFrame], DataFrame]) -> Query:
    """Register a query that only needs the stored transactions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(sample.silver_transactions(spark, sf_dir))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# --- ingest -----------------------------------------------------------------


@query
def ingest_clean(spark, sf_dir):
    return ingest.clean(sample.untidy(sample.raw_transactions(spark, sf_dir)))


@query
def ingest_txn_id(spark, sf_dir):
    return ingest.ingest(sample.raw_transactions(spark, sf_dir), canonical="cents")


@query
def ingest_summary(spark, sf_dir):
    table = ingest.ingest_summary(sample.raw_transactions(spark, sf_dir))
    return table.drop("approx_distinct_senders", "approx_distinct_receivers")


@query
def ingest_summary_approx(spark, sf_dir):
    """The sketches of distinct accounts, held against exact counts."""
    raw = sample.raw_transactions(spark, sf_dir)
    near = []
    for side, account in (("senders", "nameOrig"), ("receivers", "nameDest")):
        exact = raw.agg(F.count_distinct(account)).scalar()
        near.append((F.abs(F.col(f"approx_distinct_{side}") / exact - 1) <= 0.15).alias(f"{side}_near"))
    return ingest.ingest_summary(raw).select("total_rows", "fraud_rows", "min_step", "max_step", *near)


def _sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored sketches, one row per day."""
    return sample.stored(spark, sf_dir, "day_sketches", lambda: sketches.daily_sketches(sample.silver_transactions(spark, sf_dir)))


@query
def ingest_summary_sketches(spark, sf_dir):
    """Summaries of a week, a month and the whole run from day sketches; the estimates lie within 4 % of exact counts."""
    tx, found = sample.silver_by_day(spark, sf_dir), []
    for low, high in DAY_RANGES:
        inside = tx.filter(F.col("day").between(low, high))
        near = [
            (F.abs(F.col(f"approx_distinct_{side}") / inside.agg(F.count_distinct(account)).scalar() - 1) <= 0.04).alias(f"{side}_near")
            for side, account in sketches.SIDES.items()
        ]
        summary = sketches.summary_of_days(_sketches(spark, sf_dir), low, high)
        found.append(summary.select(F.lit(low).alias("low"), F.lit(high).alias("high"), "total_rows", "fraud_rows", "min_step", "max_step", *near))
    return functools.reduce(DataFrame.unionByName, found)


@query
def subset_step_range(spark, sf_dir):
    return ingest.step_range(sample.silver_by_day(spark, sf_dir), *SUBSET)


@query
def subset_summary(spark, sf_dir):
    return ingest.subset_summary(ingest.step_range(sample.silver_by_day(spark, sf_dir), *SUBSET), *SUBSET)


@over_silver
def filter_high_risk(tx):
    return ingest.high_risk(tx)


# --- graph tables -------------------------------------------------------------


@over_silver
def graph_vertices(tx):
    return graph.vertices(tx)


@over_silver
def graph_edges(tx):
    return graph.edges(tx)


@over_silver
def graph_weighted_edges(tx):
    return graph.weighted_pairs(graph.edges(tx))


@over_silver
def graph_self_loops(tx):
    return graph.self_loops(graph.edges(tx))


@over_silver
def graph_summary(tx):
    return graph.graph_summary(graph.vertices(tx), graph.edges(tx))


@over_silver
def graph_dangling(tx):
    return graph.dangling(graph.edges(tx))


# --- features -----------------------------------------------------------------


@over_silver
def tabular_features(tx):
    return features.tabular_features(tx)


@over_silver
def degree_totals(tx):
    sides = [
        features.degree_totals(tx, account).withColumn("side", F.lit(side))
        for account, side in (("nameOrig", "out"), ("nameDest", "in"))
    ]
    return sides[0].unionByName(sides[1])


@over_silver
def degree_step_counts(tx):
    sides = [
        features.step_counts(tx, account).withColumn("side", F.lit(side))
        for account, side in (("nameOrig", "out"), ("nameDest", "in"))
    ]
    return sides[0].unionByName(sides[1])


@over_silver
def history_src(tx):
    return features.history(tx, "nameOrig", features.SENDER)


@over_silver
def history_dst(tx):
    return features.history(tx, "nameDest", features.RECEIVER)


@over_silver
def degree_features(tx):
    return features.degree_features(tx)


# --- ranks ----------------------------------------------------------------------


def _train_links(tx: DataFrame) -> DataFrame:
    return pagerank.training_edges(graph.edges(tx), SPLIT.train_max)


def _ranks(tx: DataFrame) -> DataFrame:
    return pagerank.weighted_rank(_train_links(tx))


@over_silver
def pagerank_vertices(tx):
    return graph.vertex_ids(_train_links(tx))


@over_silver
def pagerank_transition(tx):
    return graph.transition_probabilities(_train_links(tx))


@over_silver
def pagerank_weighted(tx):
    return rounded(_ranks(tx), 10, "pagerank")


@over_silver
def pagerank_delta(tx):
    links = _train_links(tx)
    return rounded(pagerank.convergence_trace(links, pagerank.rank_accounts(links)), 10, "l1_delta")


@over_silver
def pagerank_unweighted(tx):
    return rounded(pagerank.unweighted_rank(graph.edges(ingest.high_risk(tx))), 10, "pagerank")


def ranks_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored ranks of the training edges, the input of all that uses ranks."""
    return sample.stored(spark, sf_dir, "ranks", lambda: _ranks(sample.silver_transactions(spark, sf_dir)))


@query
def pagerank_txn_features(spark, sf_dir):
    tx = sample.silver_transactions(spark, sf_dir)
    return rounded(pagerank.ranks_on_transactions(tx, ranks_layer(spark, sf_dir)), 10, *features.RANK_FEATURES)


# --- training rows ---------------------------------------------------------------


@query
def training_dataset(spark, sf_dir):
    """Flagship: all 23 columns straight from the transactions."""
    tx = sample.silver_transactions(spark, sf_dir)
    rows = training.training_rows(tx, ranks_layer(spark, sf_dir), row_digest(canonical="cents"))
    return rounded(rows, 10, *features.RANK_FEATURES)


@query
def training_dataset_joined(spark, sf_dir):
    """The same table by joining the three feature tables on the row id."""
    tx = sample.silver_transactions(spark, sf_dir)
    # Stored one after the other, as the ``training-set-joined`` step finds them, so that the shuffles behind one
    # are gone before the next needs its own. The tabular table is a projection, with none behind it.
    tables = (
        features.tabular_features(tx),
        materialize(features.degree_features(tx), "degree", sample.CODEC),
        materialize(pagerank.ranks_on_transactions(tx, ranks_layer(spark, sf_dir)), "rank", sample.CODEC),
    )
    return rounded(training.join_feature_tables(*tables), 10, *features.RANK_FEATURES)


@query
def training_dataset_bucketed(spark, sf_dir):
    """The same table from stored tables with equal buckets, joined without a shuffle."""
    tx = sample.silver_transactions(spark, sf_dir)
    path = scratch_path(spark, "bucketed")
    parts = {
        "tabular": features.tabular_features(tx),
        "degree": features.degree_features(tx),
        "rank": pagerank.ranks_on_transactions(tx, ranks_layer(spark, sf_dir)),
    }
    # Stored with packed ids: they are shuffled once and written in each of the tables.
    buckets, run = training.bucket_count(tx.count(), BUCKETS), path.split("/")[-2]
    tables = [
        training.write_bucketed(training.with_packed_id(part), f"{name}_{run}", f"{path}/{name}", buckets) for name, part in parts.items()
    ]
    return rounded(training.with_text_id(training.join_bucketed(*tables)), 10, *features.RANK_FEATURES)


@over_silver
def dataset_summary(tx):
    return ingest.dataset_summary(features.tabular_features(tx))


@over_silver
def split_assign(tx):
    return training.assign_split(tx, SPLIT).select("txn_id", "step", "split")


@over_silver
def split_summary(tx):
    return training.split_summary(training.assign_split(tx, SPLIT))


@over_silver
def split_bounds(tx):
    """Bounds for data ending at each step that occurs."""
    ends = tx.select(F.col("step").alias("last_step")).distinct()
    return ends.withColumns(proportional_bounds(F.col("last_step")))


@over_silver
def class_weight(tx):
    weighted = training.with_class_weight(tx, SPLIT).select("txn_id", "isFraud", "class_weight")
    return rounded(weighted, 9, "class_weight")


@over_silver
def class_counts(tx):
    return training.class_counts(tx)


# --- ids, node and edge features ---------------------------------------------------


def _risk_ids(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    risky = ingest.high_risk(tx)
    # Row ids are digests here, so packed ones have the same order.
    return risky, accounts.account_ids(training.with_packed_id(risky))


MAPPED_IDS = ("orig_id", "dest_id")


def _mapped_cells(tx: DataFrame) -> DataFrame:
    """Mapped rows without their row id: a digest of the row's cells need not travel through the joins with them."""
    risky, ids = _risk_ids(tx)
    return accounts.map_accounts(risky.drop("txn_id"), ids)


def _with_mapped_id(cells: DataFrame) -> DataFrame:
    return ingest.with_row_id(cells, canonical="cents", carry=MAPPED_IDS)


def _mapped(tx: DataFrame) -> DataFrame:
    return _with_mapped_id(_mapped_cells(tx))


@over_silver
def account_ids(tx):
    return _risk_ids(tx)[1]


@over_silver
def account_ids_mapped(tx):
    return _mapped(tx)


@over_silver
def edge_features(tx):
    return rounded(accounts.edge_features(_mapped(tx), ["txn_id"]), 9, "log_amount")


@query
def node_features_raw(spark, sf_dir):
    raw = accounts.node_features(edges_layer(spark, sf_dir))
    return rounded(rounded(raw, 2, "out_total_amt", "in_total_amt"), 10, "pagerank")


@query
def node_features_scaled(spark, sf_dir):
    raw = accounts.node_features(edges_layer(spark, sf_dir))
    return rounded(accounts.scaled_node_features(raw), 6, *NODE_FEATURES)


def edges_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored high-risk transactions with account ids; row ids and raw edge attributes are worked out on reading."""
    cells = sample.stored(spark, sf_dir, "risk_edges", lambda: _mapped_cells(sample.silver_transactions(spark, sf_dir)))
    return accounts.edge_features(_with_mapped_id(cells), ["txn_id", "nameOrig", "nameDest", "amount"])


def nodes_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored scaled node features with their account names."""

    def build() -> DataFrame:
        edges = edges_layer(spark, sf_dir)
        names = edges.select(
            F.inline(
                F.array(
                    F.struct(F.col("orig_id").alias("node_id"), F.col("nameOrig").alias("account")),
                    F.struct(F.col("dest_id").alias("node_id"), F.col("nameDest").alias("account")),
                )
            )
        ).distinct()
        scaled = accounts.scaled_node_features(accounts.node_features(edges))
        return scaled.join(names, "node_id")

    return sample.stored(spark, sf_dir, "risk_nodes", build)


def training_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored training rows, the input of the learning queries, which do not read the row id."""
    tx = sample.silver_transactions(spark, sf_dir)
    return sample.stored(spark, sf_dir, "training_rows", lambda: training.training_rows(tx, ranks_layer(spark, sf_dir), row_digest(canonical="cents")).drop("txn_id"))


def _normalized(edges: DataFrame) -> DataFrame:
    train = F.col("step") <= SPLIT.train_max
    return accounts.normalize_edges(edges, accounts.edge_statistics(edges, train))


@query
def edge_attr_normalized(spark, sf_dir):
    edges = _normalized(edges_layer(spark, sf_dir)).select("txn_id", *EDGE_ATTRIBUTES)
    return rounded(edges, 6, *EDGE_ATTRIBUTES)


def _unpack(df: DataFrame, array: str, prefix: str, size: int) -> DataFrame:
    cells = [F.round(F.col(array)[i].cast("double"), 4).alias(f"{prefix}_{i}") for i in range(size)]
    return df.select(*[c for c in df.columns if c != array], *cells)


@query
def graph_pack_nodes(spark, sf_dir):
    return _unpack(training.pack_nodes(nodes_layer(spark, sf_dir)), "x", "x", len(NODE_FEATURES))


@query
def graph_pack_edges(spark, sf_dir):
    packed = training.pack_edges(edges_layer(spark, sf_dir), SPLIT)
    return _unpack(packed, "edge_attr", "attr", len(EDGE_ATTRIBUTES)).withColumn(
        "edge_label", F.col("edge_label").cast("int")
    )


@query
def graph_pack_report(spark, sf_dir):
    packed = training.pack_edges(edges_layer(spark, sf_dir), SPLIT)
    return training.pack_report(nodes_layer(spark, sf_dir), packed)


# --- neighbourhoods and edge scores --------------------------------------------------


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes keyed by ``id`` and edges with ``src``/``dst`` ids."""
    nodes = nodes_layer(spark, sf_dir).withColumnRenamed("node_id", "id")
    edges = edges_layer(spark, sf_dir).withColumnsRenamed({"orig_id": "src", "dest_id": "dst"})
    return nodes, edges


MEANS = [f"mean_{c}" for c in NODE_FEATURES]


@query
def neighbor_mean_1hop(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    means = neighbors.neighbor_mean(nodes, edges.select("src", "dst"), NODE_FEATURES)
    return rounded(means.select("id", *MEANS), 6, *MEANS)


@query
def neighbor_mean_2hop(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    means = neighbors.neighbor_mean_two_hops(nodes, edges.select("src", "dst"), NODE_FEATURES)
    return rounded(means, 6, *[c for c in means.columns if c != "id"])


@query
def neighbor_mean_train_only(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    heard = edges.filter(split_label(SPLIT) == "train").select("src", "dst")
    means = neighbors.neighbor_mean(nodes, heard, NODE_FEATURES)
    return rounded(means.select("id", *MEANS), 6, *MEANS)


@query
def sage_score(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    scored = neighbors.score_edges(_normalized(edges), nodes, NODE_FEATURES, EDGE_ATTRIBUTES, SCORER, ["txn_id"])
    return rounded(scored, 6, "logit")


@query
def sage_score_pair(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    joined = training.with_packed_id(_normalized(edges))
    for end in ("src", "dst"):
        side = nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in NODE_FEATURES])
        joined = joined.join(side, end)
    groups = [[f"{end}_{c}" for c in NODE_FEATURES] for end in ("src", "dst")]
    scored = neighbors.score_pairs(joined, *groups, EDGE_ATTRIBUTES, SCORER, ["txn_id"])
    return rounded(training.with_text_id(scored), 6, "logit")


# --- exploration -----------------------------------------------------------------------


@over_silver
def eda_head(tx):
    return eda.head(tx, ["step", "txn_id"])


@over_silver
def eda_schema_profile(tx):
    return eda.schema_profile(tx)


@over_silver
def eda_missing(tx):
    return eda.missing_values(tx)


@over_silver
def eda_describe(tx):
    return rounded(eda.describe(tx), 3, "mean", "std", "min", "q25", "q50", "q75", "max")


@over_silver
def eda_label_counts(tx):
    return eda.value_counts(tx, "isFraud")


@over_silver
def eda_type_counts(tx):
    return eda.value_counts(tx, "type")


@over_silver
def eda_distinct_types(tx):
    return eda.distinct_types(tx)


@over_silver
def eda_top_fraud_senders(tx):
    return eda.top_fraud(tx, "nameOrig")


@over_silver
def eda_top_fraud_receivers(tx):
    return eda.top_fraud(tx, "nameDest")


@over_silver
def eda_crosstab(tx):
    return eda.crosstab(tx)


@over_silver
def eda_crosstab_rate(tx):
    return rounded(eda.crosstab_rate(tx), 9, "r0", "r1")


@over_silver
def eda_hist_amount(tx):
    return rounded(eda.histogram(tx, F.col("amount")), 6, "lo", "hi")


@over_silver
def eda_hist_log_amount(tx):
    return rounded(eda.histogram(tx, F.log1p("amount")), 6, "lo", "hi")


BOX = ["q25", "q50", "q75", "whisker_low", "whisker_high"]


@over_silver
def eda_box_log_amount(tx):
    return rounded(eda.box_statistics(tx, F.log1p("amount")), 6, *BOX)


@over_silver
def eda_box_orig_diff(tx):
    return rounded(eda.box_statistics(eda.with_eda_columns(tx), F.col("orig_balance_diff")), 3, *BOX)


@over_silver
def eda_box_dest_diff(tx):
    return rounded(eda.box_statistics(eda.with_eda_columns(tx), F.col("dest_balance_diff")), 3, *BOX)


@over_silver
def eda_volume_by_step(tx):
    return eda.volume_by_step(tx)


@over_silver
def eda_fraud_by_step(tx):
    return eda.fraud_by_step(tx)


@over_silver
def eda_correlation(tx):
    return rounded(eda.correlation(eda.with_eda_columns(tx)), 6, "r")


@over_silver
def eda_degree_describe(tx):
    sides = [
        eda.degree_profile(tx, account).withColumn("side", F.lit(account)) for account in ("nameOrig", "nameDest")
    ]
    return rounded(sides[0].unionByName(sides[1]).drop("column"), 6, "mean", "std")


@over_silver
def eda_hist_sender_degree(tx):
    return rounded(eda.degree_histogram(tx, "nameOrig"), 6, "lo", "hi")


@over_silver
def eda_summary(tx):
    table = rounded(eda.summary(tx), 9, "fraud_ratio")
    return table.withColumn("types", F.array_join("types", ","))


# --- metrics ------------------------------------------------------------------------------


@over_silver
def metrics_confusion(tx):
    return metrics.confusion(sample.with_scores(tx), F.col("p") >= 0.5)


@over_silver
def metrics_prf(tx):
    counts = metrics.with_prf(metrics.confusion(sample.with_scores(tx), F.col("p") >= 0.5))
    return rounded(counts.select("precision", "recall", "f1"), 9, "precision", "recall", "f1")


@over_silver
def metrics_average_precision(tx):
    return rounded(metrics.average_precision(sample.with_scores(tx)), 9, "average_precision")


@over_silver
def metrics_threshold_sweep(tx):
    return rounded(metrics.threshold_sweep(sample.with_scores(tx)), 9, "precision", "recall", "f1")


@over_silver
def metrics_best_threshold(tx):
    best = metrics.best_threshold(metrics.threshold_sweep(sample.with_scores(tx)))
    return rounded(best, 9, "f1", "precision", "recall")


@over_silver
def metrics_by_split(tx):
    scored = training.assign_split(sample.with_scores(tx), SPLIT)
    return rounded(metrics.split_evaluation(scored, 0.5), 9, "f1", "precision", "recall", "pr_auc")


@over_silver
def metrics_focal_loss(tx):
    return rounded(metrics.mean_focal_loss(sample.with_scores(tx)), 9, "focal_loss")


# --- scoring and streams ---------------------------------------------------------------------


def _model(spark: SparkSession, sf_dir: str) -> scoring.ScoringModel:
    edges = edges_layer(spark, sf_dir)
    train = F.col("step") <= SPLIT.train_max
    statistics = sample.stored(spark, sf_dir, "edge_statistics", lambda: accounts.edge_statistics(edges, train))
    profiles = nodes_layer(spark, sf_dir).select("account", *NODE_FEATURES)
    return scoring.ScoringModel(profiles, statistics, SCORER)


@over_silver
def score_request_validate(tx):
    checked = scoring.validate_requests(sample.request_texts(tx)).select("tx_id", "step", "amount", "nameDest", "reason")
    return checked.withColumn("step", F.col("step").cast("double"))


@query
def score_node_lookup(spark, sf_dir):
    requests = scoring.requests_from(sample.silver_transactions(spark, sf_dir)).select("tx_id", "nameOrig", "nameDest")
    found = scoring.lookup_accounts(requests, _model(spark, sf_dir).profiles)
    return rounded(found, 4, *[f"{side}_{c}" for side in ("src", "dst") for c in NODE_FEATURES])


@query
def score_account_profiles(spark, sf_dir):
    everyone = graph.vertices(sample.silver_transactions(spark, sf_dir)).select(F.col("id").alias("account"))
    return scoring.account_profile_view(everyone, _model(spark, sf_dir).profiles)


@query
def score_batch(spark, sf_dir):
    requests = scoring.requests_from(sample.silver_transactions(spark, sf_dir))
    return scoring.decide(scoring.score_requests(requests, _model(spark, sf_dir)))


@query
def score_trained(spark, sf_dir):
    """Decisions of the stored, trained edge classifier: every request, each action as its probability says."""
    edges, path = _edge_rows(spark, sf_dir)
    learning.fit_edge_model(*edges).save(path)
    model = scoring.ScoringModel(_vectors(spark, sf_dir), _model(spark, sf_dir).statistics, learning.EdgeModel.load(spark, path))
    requests = scoring.requests_from(sample.silver_transactions(spark, sf_dir))
    decided = scoring.decide(scoring.score_requests(requests, model))
    blocked = F.col("fraud_probability") > scoring.BLOCK_THRESHOLD
    edge = F.abs(F.col("fraud_probability") - scoring.BLOCK_THRESHOLD) <= 0.0001  # rounded for the response
    known = F.col("fraud_probability").between(0.0, 1.0)
    consistent = known & (edge | (blocked == (F.col("action") == "BLOCK")))
    return decided.select("transaction_id", consistent.alias("consistent"), "status")


@over_silver
def score_report(tx):
    return scoring.run_report(sample.with_scores(tx))


FEED_COLUMNS = ["txn_id", "nameOrig", "nameDest", "prediction", "actual"]


def _feed(tx: DataFrame) -> DataFrame:
    """High-risk transactions of the test part, with the columns that the feed shows or orders by."""
    tested = ingest.high_risk(tx).filter(split_label(SPLIT) == "test")
    return sample.with_scores(tested).select("step", "txn_id", "nameOrig", "nameDest", "p", "isFraud")


@over_silver
def alerts_sampled(tx):
    return scoring.alert_feed(_feed(tx)).select(*FEED_COLUMNS, "ordinal")


@over_silver
def alerts_first_rows(tx):
    """The feed over the first 2,000 of them only: the cap is the feature."""
    return scoring.alert_feed(_feed(tx), max_rows=2000).select(*FEED_COLUMNS, "ordinal")


def _line_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sample.table(spark, sf_dir, "lineitem")
    # The braces make it a pattern, which may match one file or a folder of files.
    return table_stream(spark, f"{sf_dir.rstrip('/')}/{{lineitem}}.parquet", lines.schema)


def _raw_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.derive(_line_stream(spark, sf_dir), sf_dir)


def _request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as text cells, some of them damaged."""
    return sample.request_texts(streams.ingest_stream(_raw_stream(spark, sf_dir), canonical="cents"))


@query
def stream_ingest(spark, sf_dir):
    return streams.drain(streams.ingest_stream(_raw_stream(spark, sf_dir), canonical="cents"), "stream_ingest")


@query
def stream_score(spark, sf_dir):
    return streams.drain(streams.score_stream(_request_stream(spark, sf_dir), _model(spark, sf_dir)), "stream_score")


@query
def stream_rejects(spark, sf_dir):
    return streams.drain(streams.reject_stream(_request_stream(spark, sf_dir)), "stream_rejects")


@query
def stream_alerts(spark, sf_dir):
    arrived = ingest.high_risk(streams.ingest_stream(_raw_stream(spark, sf_dir), canonical="cents"))
    scored = sample.with_scores(arrived.filter(split_label(SPLIT) == "test"))
    return streams.drain(streams.alert_stream(scored).select(*FEED_COLUMNS), "stream_alerts")


@query
def stream_history(spark, sf_dir):
    """Prior counts of both accounts of every arriving transaction, from keyed state."""
    arrived = streams.ingest_stream(_raw_stream(spark, sf_dir), canonical="cents")
    return history.history_columns(streams.drain(history.history_stream(arrived), "stream_history"))


@query
def stream_alerts_sampled(spark, sf_dir):
    """The feed as a stream: alerts and every 50th row of the whole run."""
    arrived = ingest.high_risk(streams.ingest_stream(_raw_stream(spark, sf_dir), canonical="cents"))
    scored = sample.with_scores(arrived.filter(split_label(SPLIT) == "test")).select("step", "txn_id", "nameOrig", "nameDest", "p", "isFraud")
    path = scratch_path(spark, "feed")
    streams.run_batches(scored, streams.write_feed(f"{path}/feed"), f"{path}/timings", f"{path}/state")
    return spark.read.parquet(f"{path}/feed").select(*FEED_COLUMNS, "ordinal")


@query
def stream_replay(spark, sf_dir):
    """All transactions arrive, and arrive again in a second run: each is stored once."""
    arrived = streams.ingest_stream(_raw_stream(spark, sf_dir), canonical="cents")
    path = scratch_path(spark, "replay")
    for run in ("first", "again"):
        streams.run_batches(arrived, replay.write_new_rows(path, run), f"{path}/timings_{run}", f"{path}/state_{run}")
    return replay.stored_rows(spark, path, arrived)


# --- reports -----------------------------------------------------------------------------------


RECORD = ["run_name", "auc_pr", "recall_at_0_5", "f1_at_0_5"]


def _runs(tx: DataFrame) -> DataFrame:
    """Older records of all parts, newer ones (another score) of val and test only."""
    older = sample.metric_records(tx, SPLIT).select(*RECORD)
    newer = sample.metric_records(tx, SPLIT, shift=1.0).filter(F.col("split") != "train")
    return reports.union_runs(older, newer.select(*RECORD, "precision_at_0_5"))


@over_silver
def runs_union(tx):
    return _runs(tx)


@over_silver
def runs_dedup_latest(tx):
    return reports.latest_runs(_runs(tx))


@over_silver
def runs_best_by_metric(tx):
    return reports.best_runs(reports.latest_runs(_runs(tx)))


@over_silver
def runs_best_records(tx):
    return reports.best_records(reports.latest_runs(_runs(tx)))


@over_silver
def runs_comparison_summary(tx):
    return reports.comparison_summary(_runs(tx))


@over_silver
def runs_metrics_wide(tx):
    records = sample.metric_records(tx, SPLIT).select(
        F.concat(F.lit("exp_"), F.col("split")).alias("experiment_id"), F.col("type").alias("run_name"), "auc_pr", "f1_at_0_5"
    )
    return reports.widen_metrics(records, metrics=["auc_pr", "f1_at_0_5"])


@over_silver
def runs_union_ragged(tx):
    """Finished runs and failed ones, which lack the total and name the failed job."""
    runs = sample.scaling_records(tx)
    fails = F.col("step_max") % 120 == 0
    failed = runs.filter(fails).drop("total_runtime_sec").withColumns(
        {"status": F.lit("FAILED"), "failed_job": F.lit("graph_features")}
    )
    return reports.union_ragged(runs.filter(~fails), failed)


@over_silver
def report_runtime_summary(tx):
    return reports.runtime_summary(sample.scaling_records(tx))


@over_silver
def report_runtime_series(tx):
    return reports.runtime_series(sample.scaling_records(tx), "total_runtime_sec")


@over_silver
def report_metric_series(tx):
    return reports.metric_series(sample.metric_records(tx, SPLIT), "auc_pr")


@over_silver
def log_metrics_extract(tx):
    found = reports.log_figures(sample.run_logs(tx))
    return found.withColumns({name: F.col(name).cast("double") for name in reports.LOG_FIGURES})


# --- learning ------------------------------------------------------------------------------------


@over_silver
def ml_type_index(tx):
    return learning.type_indices(tx.select("type"))


def _evidence(records: DataFrame, tested: DataFrame, area: str, figures: list[str], *names: str) -> DataFrame:
    """What SQL can confirm of a fit: its test part's counts, and that its figures are sound."""
    if "test_rows" not in records.columns:
        rows, fraud = tested.agg(F.count(F.lit(1))).scalar(), tested.agg(F.sum("isFraud")).scalar()
        records = records.withColumns({"test_rows": rows, "test_fraud": fraud})
    sound = functools.reduce(Column.__and__, [F.col(c).between(0.0, 1.0) for c in figures])
    above = F.col(area) > F.col("test_fraud") / F.col("test_rows")
    return records.select(*names, "test_rows", "test_fraud", sound.alias("in_range"), above.alias("above_base_rate"))


def _ablation(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    rows = training_layer(spark, sf_dir)
    records = learning.ablation(rows, SPLIT, names or tuple(learning.FEATURE_SETS))
    tested = rows.filter(split_label(SPLIT) == "test")
    return _evidence(records, tested, "auc_pr", list(reports.RUN_METRICS), "run_name")


@query
def ml_baseline(spark, sf_dir):
    return _ablation(spark, sf_dir, "baseline_tabular")


@query
def ml_ablation(spark, sf_dir):
    return _ablation(spark, sf_dir)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account profiles for the trained classifier: node features and whole-graph neighbour means."""
    nodes, edges = _graph(spark, sf_dir)
    means = neighbors.neighbor_mean(nodes.select("id", *NODE_FEATURES), edges.select("src", "dst"), NODE_FEATURES)
    return nodes.select("id", "account").join(means, "id").drop("id")


def _edge_rows(spark: SparkSession, sf_dir: str) -> tuple[tuple[DataFrame, list[str]], str]:
    """Stored rows of the edge classifier with its input columns, and a path for the fitted model."""
    nodes, edges = _graph(spark, sf_dir)
    labelled = training.assign_split(_normalized(edges), SPLIT)
    rows, columns = neighbors.edge_rows(labelled, nodes, NODE_FEATURES)
    columns = [*EDGE_ATTRIBUTES, *columns]
    stored = sample.stored(spark, sf_dir, "edge_rows", lambda: rows.select("split", "isFraud", *columns))
    return (stored, columns), scratch_path(spark, "edge_model")


@query
def ml_graph_mlp(spark, sf_dir):
    """Edge classifier on both ends' features, their neighbour means and the normalized edge attributes."""
    (rows, columns), _ = _edge_rows(spark, sf_dir)
    report = learning.edge_report(learning.fit_edge_model(rows, columns), rows)
    return _evidence(report, rows, "pr_auc", ["f1", "precision", "recall", "pr_auc"], "split")


@query
def ml_graph_sage(spark, sf_dir):
    """Edge classifier whose two graph layers are learned: gradients sent back along the edges, focal loss."""
    nodes, edges = _graph(spark, sf_dir)
    labelled = training.assign_split(_normalized(edges), SPLIT)
    model = graph_learning.fit_sage(labelled, nodes, NODE_FEATURES, EDGE_ATTRIBUTES, hidden=16, epochs=16, every=8, rate=0.05)
    tested = materialize(graph_learning.sage_report(model, labelled, nodes, NODE_FEATURES, EDGE_ATTRIBUTES), "tested", sample.CODEC)
    counts = tested.groupBy("split").agg(F.count(F.lit(1)).alias("test_rows"), F.count_if(F.col("isFraud") == 1).alias("test_fraud"))
    report = metrics.split_evaluation(tested, model.threshold).join(counts, "split")
    return _evidence(report, tested, "pr_auc", ["f1", "precision", "recall", "pr_auc"], "split")


# --- sources and sinks: written to the shared folder and read back -----------------------------------


@query
def source_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    write_csv(sample.raw_transactions(spark, sf_dir), path)
    return read_transactions(spark, path)


@over_silver
def source_requests_json(tx):
    path = scratch_path(tx.sparkSession, "requests")
    # As text, names and digests take five times the space.
    write_json(scoring.requests_from(tx), path, codec="gzip")
    return scoring.accepted(scoring.validate_requests(read_requests_text(tx.sparkSession, path)))


@over_silver
def source_metrics_json(tx):
    path = scratch_path(tx.sparkSession, "metrics")
    write_json(sample.metric_records(tx, SPLIT), path)
    return read_metrics(tx.sparkSession, path)


@over_silver
def split_frames(tx):
    """The three frames of a split, put together again under their names."""
    parts = splits.split_frames(tx, SPLIT).items()
    named = [frame.select("txn_id", "step", F.lit(name).alias("frame")) for name, frame in parts]
    return functools.reduce(DataFrame.unionByName, named)
