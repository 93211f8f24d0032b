"""Splits, imputation, scaling, feature scores, neighbours, metrics and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import encode, knn, knn_approx, metrics, neighbor_info, report, select, split
from tabwright.queries.base import LINE_KEY, add, on, rounded, sql_of, table, view

KEY_HASH = f"md5(concat_ws('#', {', '.join(f'CAST({c} AS VARCHAR)' for c in LINE_KEY)}, 'split', '42'))"
FOLD_HASH = KEY_HASH.replace("'split'", "'fold'")
KEYS = ", ".join(LINE_KEY)
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

add("split_random", on("lineitem", lambda df: split.split_random(df, LINE_KEY).select(*LINE_KEY, "is_test")),
    f"SELECT {KEYS}, substr({KEY_HASH}, 1, 8) < '{int(0.2 * 2**32):08x}' AS is_test FROM lineitem")
add("split_stratified", on("lineitem", lambda df: split.split_stratified(df, "l_returnflag", LINE_KEY).select(*LINE_KEY, "l_returnflag", "is_test")), f"""
    SELECT {KEYS}, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY {KEY_HASH})
        <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY l_returnflag)) AS is_test FROM lineitem""")
add("folds_stratified", on("lineitem", lambda df: split.add_folds(df, 3, LINE_KEY, "l_returnflag").select(*LINE_KEY, "l_returnflag", "fold")), f"""
    SELECT {KEYS}, l_returnflag, CAST(rn > round(n / 3) AS INTEGER) + CAST(rn > round(n * 2 / 3) AS INTEGER) AS fold
    FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {FOLD_HASH}) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)""")
add("folds", on("lineitem", lambda df: split.add_folds(df, 5, LINE_KEY).select(*LINE_KEY, "fold")), f"""
    SELECT {KEYS}, {" + ".join(f"CAST(rn > round(n * {j} / 5) AS INTEGER)" for j in range(1, 5))} AS fold
    FROM (SELECT *, row_number() OVER (ORDER BY {FOLD_HASH}) AS rn, count(*) OVER () AS n FROM lineitem)""")

add("impute_median", on("orders_missing", lambda df: encode.impute_median(df, ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))), f"""
    SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM {sql_of("orders_missing")})), 4) AS o_totalprice FROM {sql_of("orders_missing")}""")
add("impute_mode", on("orders_missing", lambda df: encode.impute_mode(df, ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")), f"""
    SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM {sql_of("orders_missing")} WHERE o_orderpriority IS NOT NULL
        GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority FROM {sql_of("orders_missing")}""")
add("robust_scale", on("orders_missing", lambda df: rounded(encode.robust_scale(df, ["o_totalprice"]).select("o_orderkey", "o_totalprice"), 6, "o_totalprice")), f"""
    WITH t AS {sql_of("orders_missing")}, q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.75) AS b FROM t)
    SELECT o_orderkey, round((o_totalprice - m) / (b - a), 6) AS o_totalprice FROM t, q""")
add("label_encode", on("orders_missing", lambda df: select.label_encode(df, ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "o_orderstatus", "o_orderpriority")), f"""
    SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus, dense_rank() OVER (ORDER BY coalesce(o_orderpriority, 'nan')) - 1 AS o_orderpriority
    FROM {sql_of("orders_missing")}""")
add("label_codes", on("part", lambda df: select.label_codes(df, ["p_name", "p_type"])), """
    SELECT 'p_name' AS "column", p_name AS value, row_number() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part)
    UNION ALL SELECT 'p_type', p_type, row_number() OVER (ORDER BY p_type) - 1 FROM (SELECT DISTINCT p_type FROM part)""")
add("shift_nonneg", on("customer", lambda df: rounded(select.shift_nonneg(df, ["c_custkey", "c_acctbal"]).select("c_custkey", "c_acctbal"), 4, "c_acctbal")), """
    SELECT c_custkey, round(CASE WHEN (SELECT min(c_acctbal) FROM customer) < 0 THEN c_acctbal - (SELECT min(c_acctbal) FROM customer) ELSE c_acctbal END, 4) AS c_acctbal FROM customer""")
add("chi2_scores", on("lineitem", lambda df: rounded(select.chi2_scores(df, "l_returnflag", FEATURES), 4, "chi2")), " UNION ALL ".join(f"""
    SELECT '{c}' AS feature, round(sum((o - t * k / n) ** 2 / (t * k / n)), 4) AS chi2
    FROM (SELECT sum({c}) AS o, count(*) AS k FROM lineitem GROUP BY l_returnflag), (SELECT sum({c}) AS t, count(*) AS n FROM lineitem)""" for c in FEATURES))


def mi_sql(feature: str, target: str, source: str, numeric: bool) -> str:
    cuts = ", ".join(f"{i / 32}" for i in range(1, 32))
    place = f"CAST(len(list_filter((SELECT list_distinct(quantile_cont(CAST({feature} AS DOUBLE), [{cuts}])) FROM {source}), lambda e: {feature} > e)) AS VARCHAR)" if numeric else f"coalesce({feature}, 'nan')"
    return f"""SELECT '{feature}' AS feature, round(greatest(sum(nxy / n * ln(nxy * n / (nx * ny))), 0), 6) AS mutual_info FROM (
        SELECT CAST(nxy AS DOUBLE) AS nxy, CAST(sum(nxy) OVER (PARTITION BY b) AS DOUBLE) AS nx, CAST(sum(nxy) OVER (PARTITION BY y) AS DOUBLE) AS ny, CAST(sum(nxy) OVER () AS DOUBLE) AS n
        FROM (SELECT {place} AS b, {target} AS y, count(*) AS nxy FROM {source} GROUP BY 1, 2))"""


add("mutual_info", on("lineitem", lambda df: rounded(select.mutual_info(df, "l_returnflag", features=[*FEATURES, "l_linestatus"]), 6, "mutual_info")),
    " UNION ALL ".join([*(mi_sql(c, "l_returnflag", "lineitem", True) for c in FEATURES), mi_sql("l_linestatus", "l_returnflag", "lineitem", False)]))


def neighbor_mi_sql(feature: str, target: str, source: str) -> str:
    """Three neighbours by lags and leads of the rows themselves, digammas from harmonic numbers; every class has four rows or more."""
    reach = ", ".join(f"CASE WHEN lag(v, {a}) OVER w IS NOT NULL AND lead(v, {3 - a}) OVER w IS NOT NULL THEN greatest(v - lag(v, {a}) OVER w, lead(v, {3 - a}) OVER w - v) END" for a in range(4))
    psi = "(SELECT s FROM h WHERE h.i = {})"
    return f"""SELECT '{feature}' AS feature, (WITH t AS (SELECT CAST({feature} AS DOUBLE) AS v, {target} AS y FROM {source} WHERE {feature} IS NOT NULL),
        h AS (SELECT i, coalesce(sum(1.0::DOUBLE / (i - 1)) FILTER (WHERE i > 1) OVER (ORDER BY i), 0) AS s FROM (SELECT unnest(range(1, (SELECT count(*) FROM t) + 1)) AS i)),
        near AS (SELECT v, count(*) OVER (PARTITION BY y) AS c, list_min([{reach}]) AS r FROM t WINDOW w AS (PARTITION BY y ORDER BY v)),
        cum AS (SELECT v, count(*) AS n, sum(count(*)) OVER (ORDER BY v) AS upto FROM t GROUP BY v),
        m AS (SELECT c, CASE WHEN r > 0 THEN a.upto - coalesce(b.upto, 0) ELSE e.n END AS m FROM near
              ASOF LEFT JOIN cum a ON near.v + near.r > a.v ASOF LEFT JOIN cum b ON near.v - near.r >= b.v LEFT JOIN cum e ON e.v = near.v),
        g AS (SELECT c, m, count(*) AS k FROM m GROUP BY c, m)
        SELECT greatest({psi.format("(SELECT count(*) FROM t)")} + 1.5 - (SELECT sum(k * s) / sum(k) FROM g JOIN h ON h.i = g.c) - (SELECT sum(k * s) / sum(k) FROM g JOIN h ON h.i = g.m), 0)) AS mutual_info"""


for _name, _more in (("mutual_info_neighbors", {}), ("mutual_info_neighbors_blocks", {"rank_rows": 5000, "block": 700})):
    add(_name, on("lineitem", lambda df, o=_more: rounded(neighbor_info.neighbor_mutual_info(df, "l_returnflag", FEATURES, **o), 6, "mutual_info")),
        " UNION ALL ".join(f"SELECT feature, round(mutual_info, 6) AS mutual_info FROM ({neighbor_mi_sql(c, 'l_returnflag', 'lineitem')})" for c in FEATURES))
CODED = "(SELECT l_returnflag, l_quantity, l_discount - 0.05 AS shifted, dense_rank() OVER (ORDER BY l_linestatus) - 1 AS l_linestatus FROM lineitem)"
add("select_classification", on("lineitem", lambda df: rounded(select.select_classification(
    df.select("l_returnflag", "l_quantity", (F.col("l_discount") - 0.05).alias("shifted"), "l_linestatus"), "l_returnflag")["scores"], 4, "chi2", "mutual_info")), f"""
    WITH c AS (SELECT *, shifted - least((SELECT min(shifted) FROM {CODED}), 0) AS up FROM {CODED}),
    x AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, sum((o - t * k / n) ** 2 / (t * k / n)) AS chi2 FROM (SELECT sum({v}) AS o, count(*) AS k FROM c GROUP BY l_returnflag), (SELECT sum({v}) AS t, count(*) AS n FROM c)" for n, v in (("l_quantity", "l_quantity"), ("shifted", "up"), ("l_linestatus", "l_linestatus")))}),
    i AS ({" UNION ALL ".join(neighbor_mi_sql(c, "l_returnflag", CODED) for c in ("l_quantity", "shifted", "l_linestatus"))})
    SELECT feature, round(chi2, 4) AS chi2, round(mutual_info, 4) AS mutual_info, CAST(row_number() OVER (ORDER BY mutual_info DESC, feature) AS INTEGER) AS rank FROM x JOIN i USING (feature)""")
add("variance_filter", on("line_sample", lambda df: rounded(select.variance_filter(df), 3, "variance")), " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(var_pop({c}), 3) AS variance, var_pop({c}) > 0.01 AS keep FROM lineitem" for c in FEATURES))
CORRELATED = "SELECT l_extendedprice, l_quantity, l_tax, l_discount, l_extendedprice * (1 - l_discount) AS net, -l_extendedprice * (1 + l_tax) AS minus_gross FROM {lineitem}"


def _correlated(spark, folder):
    return spark.sql(CORRELATED, lineitem=table(spark, folder, "lineitem"))


NETS = ["l_quantity", "l_tax", "l_discount", "net", "minus_gross"]
CORRS = " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS corr FROM t" for c in NETS)
for _name, _abs, _order in (("rank_by_corr", False, "corr"), ("rank_by_abs_corr", True, "abs(corr)")):
    add(_name, lambda s, d, a=_abs: rounded(select.rank_by_corr(_correlated(s, d), "l_extendedprice", a), 6, "corr"), f"""
    WITH t AS ({CORRELATED.format(lineitem="lineitem")}), c AS ({CORRS})
    SELECT feature, round(corr, 6) AS corr, CAST(row_number() OVER (ORDER BY {_order} DESC, feature) AS INTEGER) AS rank FROM c""")
add("select_regression", lambda s, d: rounded(select.select_regression(_correlated(s, d), "l_extendedprice")["ranking"], 6, "corr"), f"""
    WITH t AS ({CORRELATED.format(lineitem="lineitem")}), c AS ({CORRS})
    SELECT feature, round(corr, 6) AS corr, CAST(row_number() OVER (ORDER BY corr DESC, feature) AS INTEGER) AS rank FROM c""")
RANKED = """SELECT l_extendedprice, l_quantity, l_discount, l_extendedprice * 2 + 1 AS doubled, l_extendedprice * (1 - l_discount) AS net,
                   CASE WHEN l_partkey % 3 > 0 THEN NULL ELSE l_tax END AS mostly_gone, 'x' AS same FROM {lineitem}"""
add("rank_features", lambda s, d: rounded(select.rank_features(s.sql(RANKED, lineitem=table(s, d, "lineitem")), "l_extendedprice", "regression"), 6, "score"), f"""
    WITH t AS ({RANKED.format(lineitem="lineitem")}), c AS (
        {" UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS raw FROM t" for c in ("l_quantity", "l_discount", "doubled", "net", "mostly_gone"))}
        UNION ALL SELECT 'same', 0)
    SELECT feature, round(raw / (SELECT max(raw) FROM c), 6) AS score, CAST(row_number() OVER (ORDER BY raw DESC, feature) AS INTEGER) AS rank,
           feature IN ('l_quantity', 'l_discount', 'net') AS selected,
           CASE feature WHEN 'doubled' THEN 'repeats_target' WHEN 'mostly_gone' THEN 'high_missing' WHEN 'same' THEN 'constant' ELSE 'informative' END AS reason FROM c""")
add("rank_features_classes", on("doc_quality", lambda df: select.rank_features(df, "quality", "classification")))


def _vectors(spark, folder):
    rows = table(spark, folder, "embeddings")
    return select.array_columns(rows, "embedding", select.array_size(rows, "embedding")).drop("vec_id", "label")


PAIR = ["l_quantity", "l_extendedprice"]
PAIR_PCA = """
    SELECT CAST(c AS INTEGER) AS component, round(0.5 + (3 - 2 * c) * sqrt(((a - b) / 2) ** 2 + k ** 2) / (a + b), 6) AS ratio
    FROM (SELECT var_samp(l_quantity) AS a, var_samp(l_extendedprice) AS b, covar_samp(l_quantity, l_extendedprice) AS k FROM lineitem), (SELECT unnest([1, 2]) AS c)"""
for _name, _square in (("pca_ratio_pair", 1000), ("pca_ratio_subspace", 1)):
    add(_name, on("lineitem", lambda df, q=_square: rounded(select.pca_ratio(df, 2, PAIR, q), 6, "ratio")), PAIR_PCA)


def _clustering_parts(spark, folder):
    """All four parts of the selection, one under the other."""
    rows = table(spark, folder, "lineitem").select(*PAIR, F.lit(1.0).alias("same"))
    parts = select.select_clustering(rows)
    shown = [
        parts["variance"].select(F.lit("variance").alias("part"), F.col("feature").alias("name"), F.col("keep").cast("string").alias("other"), F.round("variance", 2).alias("value")),
        parts["matrix"].select(F.lit("matrix").alias("part"), F.col("x").alias("name"), F.col("y").alias("other"), F.round("corr", 6).alias("value")),
        parts["pca"].select(F.lit("pca").alias("part"), F.col("component").cast("string").alias("name"), F.lit("").alias("other"), F.round("ratio", 6).alias("value")),
        parts["sample"].select(F.lit("sample").alias("part"), F.col("l_quantity").cast("string").alias("name"), F.lit("").alias("other"), F.col("l_extendedprice").cast("double").alias("value")),
    ]
    out = shown[0]
    for part in shown[1:]:
        out = out.unionByName(part)
    return out


add("select_clustering_parts", _clustering_parts, f"""
    WITH t AS (SELECT l_quantity, l_extendedprice, 1.0::DOUBLE AS same FROM lineitem), names AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'same']) AS n)
    {" ".join(f"SELECT 'variance' AS part, '{c}' AS name, CAST(var_pop({c}) > 0.01 AS VARCHAR) AS other, round(var_pop({c}), 2) AS value FROM t UNION ALL" for c in (*PAIR, "same"))}
    SELECT 'matrix', a.n, b.n, CASE WHEN 'same' IN (a.n, b.n) THEN NULL WHEN a.n = b.n THEN 1.0 ELSE (SELECT round(corr(l_quantity, l_extendedprice), 6) FROM t) END FROM names a, names b
    UNION ALL SELECT 'pca', CAST(component AS VARCHAR), '', ratio FROM ({PAIR_PCA})
    UNION ALL (SELECT 'sample', CAST(l_quantity AS VARCHAR), '', CAST(l_extendedprice AS DOUBLE) FROM t ORDER BY l_quantity, l_extendedprice LIMIT 5)""")


add("pca_ratio", lambda s, d: rounded(select.pca_ratio(_vectors(s, d), 5), 8, "ratio"))
add("select_clustering", lambda s, d: select.select_clustering(_vectors(s, d))["variance"])


def _knn(weights):
    def run(spark, folder):
        rows = table(spark, folder, "embeddings")
        return knn.knn_classify(rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0"), 5, weights, features="embedding", id_col="vec_id").select("id", "prediction")
    return run


KNN = """
    WITH d AS (SELECT q.vec_id AS id, t.vec_id AS tid, CAST(t.label AS VARCHAR) AS label,
               list_distance(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS dist
               FROM embeddings q, embeddings t WHERE q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, tid) AS r FROM d QUALIFY r <= 5),
    v AS (SELECT id, label, {weight} AS votes FROM n GROUP BY id, label)
    SELECT id, label AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(votes, 9) DESC, label) = 1"""
add("knn_uniform", _knn("uniform"), KNN.format(weight="count(*)"))
add("knn_distance", _knn("distance"), KNN.format(weight="sum(1 / dist)"))



def _knn_recall(spark, folder):
    """Approximate neighbours of a fifth of the rows, held against the exact ones."""
    rows = table(spark, folder, "embeddings")
    train, test = rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0")
    near, _ = knn_approx.approx_neighbors(train, test, 5, 0.95, features="embedding", id_col="vec_id")
    exact = knn.neighbors(train, test, 5, features="embedding", id_col="vec_id")
    found = [df.select("id", "rank", (F.col("distance") ** 2).alias("d2")) for df in (near, exact)]
    share = knn_approx.recall_of(found[0].withColumn("d2", F.col("d2") * (1 - 1e-9)), found[1])
    return near.agg(F.countDistinct("id").alias("queries"), F.count(F.lit(1)).alias("neighbors")).withColumn("enough", F.lit(share >= 0.9))


add("knn_approx_recall", _knn_recall, "SELECT count(*) AS queries, 5 * count(*) AS neighbors, true AS enough FROM embeddings WHERE vec_id % 5 = 0")

BINARY, MULTI = sql_of("pred_rows"), sql_of("pred_classes")


def metrics_sql(source: str, binary: bool) -> str:
    one = "max({m}) FILTER (WHERE c = 1)" if binary else "sum({m} * s) / sum(s)"
    return f"""
    WITH p AS (SELECT y, p FROM {source}), c AS (SELECT DISTINCT y AS c FROM p),
    k AS (SELECT c, CAST((SELECT count(*) FROM p WHERE y = c) AS DOUBLE) AS s, CAST((SELECT count(*) FROM p WHERE p = c) AS DOUBLE) AS g,
                 CAST((SELECT count(*) FROM p WHERE y = c AND p = c) AS DOUBLE) AS tp FROM c),
    m AS (SELECT *, CASE WHEN g > 0 THEN tp / g ELSE 0 END AS prec, tp / s AS rec, 2 * tp / (s + g) AS f FROM k)
    SELECT round(sum(tp) / sum(s), 4) AS accuracy, round(avg(rec), 4) AS balanced_accuracy, round(sum(f * s) / sum(s), 4) AS f1,
           round({one.format(m="prec")}, 4) AS precision, round({one.format(m="rec")}, 4) AS recall FROM m"""


add("classification_metrics", on("pred_rows", metrics.classification_metrics), metrics_sql(BINARY, True))
add("classification_metrics_multi", on("pred_classes", metrics.classification_metrics), metrics_sql(MULTI, False))
AUC = """(WITH g AS (SELECT {s} AS s, CAST(count(*) FILTER (WHERE y = {c}) AS DOUBLE) AS pos, CAST(count(*) FILTER (WHERE y <> {c}) AS DOUBLE) AS neg FROM {t} GROUP BY 1),
    b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
    SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) FROM b)"""
add("roc_auc", on("pred_rows", metrics.roc_auc), f"SELECT round({AUC.format(s='score', c=1, t=BINARY)}, 4) AS roc_auc")
add("roc_auc_multi", on("pred_classes", lambda df: metrics.roc_auc_ovr(df, "y", {str(i): F.col(f"s{i}") for i in range(3)})),
    f"SELECT round(({' + '.join(AUC.format(s=f's{i}', c=i, t=MULTI) for i in range(3))}) / 3, 4) AS roc_auc")
REGRESSED = "SELECT l_extendedprice AS y, 30000 + 900 * l_quantity + 100 * (l_partkey % 7) AS p FROM {lineitem}"
add("regression_metrics", lambda s, d: metrics.regression_metrics(s.sql(REGRESSED, lineitem=table(s, d, "lineitem"))), f"""
    WITH t AS ({REGRESSED.format(lineitem="lineitem")})
    SELECT round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 4) AS r2, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) ** 2)), 4) AS rmse FROM t""")
add("metrics_unrounded", on("pred_rows", lambda df: rounded(metrics.regression_metrics(df, "y", "score", digits=None), 9, "r2", "mae", "rmse")), f"""
    SELECT round(1 - sum((y - score) ** 2) / (var_pop(y) * count(*)), 9) AS r2, round(avg(abs(y - score)), 9) AS mae, round(sqrt(avg((y - score) ** 2)), 9) AS rmse FROM {BINARY}""")

BOARD, BOARD_REG = sql_of("board_class"), sql_of("board_reg")


def _board(name):
    return lambda s, d: view(s, d, name).select("Model", *[F.col(c).cast("double").alias(c) for c in view(s, d, name).columns[1:]])


add("leaderboard", lambda s, d: report.leaderboard(_board("board_class")(s, d), "classification"), f"""
    SELECT Model, CAST(Accuracy AS DOUBLE) AS Accuracy, CAST(Balanced_Accuracy AS DOUBLE) AS Balanced_Accuracy,
           CAST(row_number() OVER (ORDER BY Balanced_Accuracy DESC, Accuracy DESC, Model) AS INTEGER) AS rank FROM {BOARD}""")
add("best_model", lambda s, d: report.best_model(_board("board_class")(s, d), "classification"), f"""
    SELECT Model, CAST(Balanced_Accuracy AS DOUBLE) AS score FROM {BOARD} ORDER BY Balanced_Accuracy DESC, Model LIMIT 1""")
SUMMARY = """
    WITH b AS (SELECT Model, CAST({m} AS DOUBLE) AS v, row_number() OVER (ORDER BY {o}) AS r FROM {t})
    SELECT a.Model AS best_model, '{m}' AS best_metric, a.v AS best_score, c.Model AS runner_up_model, round(a.v - c.v, 6) AS score_gap,
           format('{{}} comes first: {m} {{:.4f}}; {{}} is behind by {{:.4f}}.', a.Model, a.v, c.Model, a.v - c.v) AS reason
    FROM b a, b c WHERE a.r = 1 AND c.r = 2"""
add("best_summary", lambda s, d: rounded(report.best_summary(_board("board_class")(s, d), "classification"), 6, "score_gap"),
    SUMMARY.format(m="Balanced_Accuracy", o="Balanced_Accuracy DESC, Accuracy DESC, Model", t=BOARD))
add("best_summary_regression", lambda s, d: rounded(report.best_summary(_board("board_reg")(s, d), "regression"), 6, "score_gap"),
    SUMMARY.format(m="R2_Score", o="R2_Score DESC, Model", t=BOARD_REG))
