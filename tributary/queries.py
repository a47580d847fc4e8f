"""Queries of the join laboratory over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.functions import comparing, hashing
from tributary.operators import joins, partitioning
from tributary.plans import costmodel, costsql, multijoin
from tributary.sources import generators
from tributary.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _orders_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")


def _nations_suppliers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "supplier")


def _joins() -> None:
    for name in joins.STRATEGIES:
        small = name == "nl"
        tables = _nations_suppliers if small else _orders_lines
        keys = ("n_nationkey", "s_nationkey") if small else ("o_orderkey", "l_orderkey")
        r_col, s_col = ("n_regionkey", "s_suppkey") if small else ("o_custkey", "l_linenumber")
        source = "nation JOIN supplier ON n_nationkey = s_nationkey" if small else "orders JOIN lineitem ON o_orderkey = l_orderkey"

        def counted(spark: SparkSession, sf_dir: str, name: str = name, tables=tables, keys=keys) -> DataFrame:  # noqa: ANN001
            return joins.count(name, *tables(spark, sf_dir), *keys)

        def rows(spark: SparkSession, sf_dir: str, name: str = name, tables=tables, keys=keys, cols=(r_col, s_col)) -> DataFrame:  # noqa: ANN001
            out = joins.join(name, *tables(spark, sf_dir), *keys, [cols[0]], [cols[1]])
            return out.select("key", F.col(f"r_{cols[0]}").alias("r_payload"), F.col(f"s_{cols[1]}").alias("s_payload"))

        _add(f"join_{name}_count", counted, f"SELECT count(*) AS matches FROM {source}")
        _add(f"join_{name}_rows", rows, f"SELECT CAST({keys[0]} AS BIGINT) AS key, {r_col} AS r_payload, {s_col} AS s_payload FROM {source}")


def _more_joins() -> None:
    lines = lambda s, d: read_table(s, d, "lineitem")
    _add("dupkey_inner_count", lambda s, d: joins.count("pro", lines(s, d), lines(s, d), "l_orderkey", "l_orderkey"), "SELECT count(*) AS matches FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey")
    _add("dupkey_semi_count", lambda s, d: joins.semi(lines(s, d), lines(s, d), "l_orderkey", "l_orderkey").agg(F.count(F.lit(1)).alias("matches")), "SELECT count(*) AS matches FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE a.l_orderkey = b.l_orderkey)")
    _add("semi_rows", lambda s, d: joins.semi(_orders_lines(s, d)[0].where("o_totalprice > 200000"), lines(s, d), "o_orderkey", "l_orderkey").select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_totalprice > 200000)")
    _add("match_histogram_512", lambda s, d: joins.histogram(joins.join("npo", *_orders_lines(s, d), "o_orderkey", "l_orderkey", [], [])), "SELECT o_orderkey & 511 AS slot, count(*) AS matches FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
    wide = (["o_custkey", "o_orderstatus", "o_orderpriority"], ["l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"])
    wide_sql = "SELECT o_orderkey AS key, " + ", ".join([f"{c} AS r_{c}" for c in wide[0]] + [f"{c} AS s_{c}" for c in wide[1]]) + " FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
    _add("wide_projection_join", lambda s, d: joins.join("pro", *_orders_lines(s, d), "o_orderkey", "l_orderkey", *wide), wide_sql)

    def late(s: SparkSession, d: str) -> DataFrame:
        # both keys are unique, so they are the row ids
        nations, suppliers = _nations_suppliers(s, d)
        return joins.late(nations, suppliers, "n_nationkey", "s_nationkey", ["n_nationkey"], ["s_suppkey"], ["n_name"], ["s_name"])

    _add("late_materialize_join", late, "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS r_n_name, s_name AS s_s_name FROM nation JOIN supplier ON n_nationkey = s_nationkey")
    salted_sql = "SELECT l_suppkey AS key, s_name AS r_s_name, l_orderkey AS s_l_orderkey, l_linenumber AS s_l_linenumber FROM supplier JOIN lineitem ON s_suppkey = l_suppkey"
    _add("salted_join", lambda s, d: joins.salted(read_table(s, d, "supplier"), lines(s, d), "s_suppkey", "l_suppkey", ["s_name"], ["l_orderkey", "l_linenumber"], 500), salted_sql)
    hot = lambda s, d: lines(s, d).withColumn("hot", F.when(F.col("l_suppkey") % 3 == 0, F.lit(0)).otherwise(F.col("l_suppkey")))
    _add("skewed_join", lambda s, d: joins.count("m_way", read_table(s, d, "supplier"), hot(s, d), "s_suppkey", "hot"), "SELECT count(*) AS matches FROM supplier JOIN (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey END AS hot FROM lineitem) ON s_suppkey = hot")
    for op, name in (("=", "eq"), ("<", "lt"), ("<=", "le"), (">", "gt"), (">=", "ge")):

        def compared(s: SparkSession, d: str, op: str = op) -> DataFrame:
            t = lines(s, d)
            return t.where(comparing.compare(t, "l_linenumber", op, "l_quantity")).select("l_orderkey", "l_linenumber", "l_quantity")

        _add(f"predicate_{name}", compared, f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber {op} l_quantity")


def _hashes() -> None:
    forms = {
        "hash_modulo": (lambda: hashing.modulo("o_orderkey", 64, 0, 3), "(o_orderkey & 504) >> 3"),
        "hash_magic": (lambda: hashing.magic("o_orderkey", 1024), "(((o_orderkey >> 2) & ~CAST(7 AS BIGINT)) | (o_orderkey & 7)) & 1023"),
        "radix_pid_hash": (lambda: hashing.radix("o_orderkey", 7, 2), "(o_orderkey & 508) >> 2"),
        "radix_pid_merge": (lambda: hashing.radix_from_one("o_orderkey", 7), "(o_orderkey - 1) & 127"),
        "hash_range": (lambda: hashing.in_range("o_orderkey", 64, 0, 1_999_999), "CAST(floor(((o_orderkey * 64) / 2000000.0)) AS BIGINT)"),
    }
    for name, (column, sql) in forms.items():
        _add(name, lambda s, d, c=column: read_table(s, d, "orders").select("o_orderkey", c().alias("pid")), f"SELECT o_orderkey, {sql} AS pid FROM orders")
    pid = lambda: hashing.radix("o_orderkey", 7)
    counts = "SELECT o_orderkey & 127 AS pid, count(*) AS n FROM orders GROUP BY 1"
    _add("partition_histogram", lambda s, d: partitioning.histogram(read_table(s, d, "orders"), pid()), counts)
    _add("partition_offsets", lambda s, d: partitioning.offsets(partitioning.histogram(read_table(s, d, "orders"), pid())), f"SELECT pid, n, CAST(sum(n) OVER (ORDER BY pid) - n AS BIGINT) AS begin FROM ({counts})")
    _add("two_pass_histogram", lambda s, d: partitioning.histogram(read_table(s, d, "orders"), *hashing.modulo_passes("o_orderkey", 256, 2)), "SELECT (o_orderkey & 240) >> 4 AS pid, o_orderkey & 15 AS pid2, count(*) AS n FROM orders GROUP BY 1, 2")
    _add("partition_rows", lambda s, d: partitioning.partition(read_table(s, d, "orders").select("o_orderkey"), pid(), 128), "SELECT o_orderkey, o_orderkey & 127 AS pid FROM orders")


def _sorts() -> None:
    order = lambda: Window.partitionBy("o_custkey").orderBy("o_orderkey")
    _add("sort_ranks", lambda s, d: read_table(s, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order()).cast("long").alias("place")), "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders")
    steps = "SELECT count(*) AS rows, count(*) FILTER (WHERE {0} < before) AS descents FROM (SELECT {0}, lag({0}) OVER (ORDER BY o_orderkey) AS before FROM orders)"
    for name, key in (("sort_check", "o_custkey"), ("sort_check_sorted", "o_orderkey")):
        _add(name, lambda s, d, k=key: partitioning.descents(read_table(s, d, "orders"), k, ["o_orderkey"]), steps.format(key))
    _add(
        "two_pass_rows",
        lambda s, d: partitioning.two_pass(read_table(s, d, "orders").select("o_orderkey"), "o_orderkey", 256, 2, 64),
        "SELECT o_orderkey, (o_orderkey & 240) >> 4 AS pid1, o_orderkey & 15 AS pid2, o_orderkey & 255 AS pid FROM orders",
    )

    def merged(s: SparkSession, d: str) -> DataFrame:
        t = read_table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("payload"))
        return partitioning.merge_runs(*[t.where(F.col("payload") % 4 == i) for i in range(4)])

    _add("merge_k_runs", merged, "SELECT o_custkey AS key, o_orderkey AS payload FROM orders")
    _add("concat_tables", lambda s, d: partitioning.concatenate(read_table(s, d, "nation").select("n_name"), read_table(s, d, "region").select(F.col("r_name").alias("n_name"))), "SELECT n_name FROM nation UNION ALL SELECT r_name FROM region")


def _orders() -> None:
    star_edges = {frozenset(("lineitem", t)): (k, f) for t, k, f in (("part", "p_partkey", "l_partkey"), ("supplier", "s_suppkey", "l_suppkey"), ("orders", "o_orderkey", "l_orderkey"))}
    chain_edges = {frozenset(("customer", "orders")): ("c_custkey", "o_custkey"), frozenset(("orders", "lineitem")): ("o_orderkey", "l_orderkey"), frozenset(("lineitem", "part")): ("l_partkey", "p_partkey")}
    kinds = {"star": (star_edges, ("lineitem", "part", "supplier", "orders"), "lineitem"), "chain": (chain_edges, ("customer", "orders", "lineitem", "part"), None)}
    where = {"part": "p_size <= 25", "orders": "o_totalprice > 100000", "supplier": "s_acctbal > 0", "customer": "c_acctbal > 0"}
    for kind, (edges, names, fact) in kinds.items():
        join_sql = "lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey " + ("JOIN supplier ON s_suppkey = l_suppkey" if kind == "star" else "JOIN customer ON c_custkey = o_custkey")
        shape = costmodel.Workload(kind, "", kind, "", "", {n: costmodel.Relation(1.0) for n in names}, {e: 1.0 for e in edges}, fact)
        select = "SELECT count(*) AS rows, CAST(sum(l_linenumber) AS BIGINT) AS lines, CAST(sum(p_size) AS BIGINT) AS sizes FROM "

        def run(s: SparkSession, d: str, order: tuple, edges=edges, only: dict | None = None) -> DataFrame:  # noqa: ANN001
            tables = {n: read_table(s, d, n).where((only or {}).get(n, "true")) for n in order}
            return multijoin.left_deep(tables, {e: F.col(a) == F.col(b) for e, (a, b) in edges.items()}, order).agg(F.count(F.lit(1)).alias("rows"), F.sum("l_linenumber").alias("lines"), F.sum("p_size").alias("sizes"))

        for i, order in enumerate(costmodel.orders(shape)):
            _add(f"{kind}_join_order{i + 1}", lambda s, d, o=order, r=run: r(s, d, o), select + join_sql)
        _add(f"filtered_{kind}", lambda s, d, o=names, r=run: r(s, d, o, only=where), select + join_sql + " WHERE " + " AND ".join(where[n] for n in names if n in where))
    _add("pass_rates", lambda s, d: joins.pass_rate(read_table(s, d, "part"), F.col("p_size") <= 25, "part").unionAll(joins.pass_rate(read_table(s, d, "orders"), F.col("o_totalprice") > 100000, "orders")), " UNION ALL ".join(f"SELECT '{t}' AS relation, count(*) AS rows, count(*) FILTER (WHERE {where[t]}) AS effective_rows, round(count(*) FILTER (WHERE {where[t]}) / CAST(count(*) AS DOUBLE), 6) AS pass_rate FROM {t}" for t in ("part", "orders")))
    _add(
        "edge_selectivity",
        lambda s, d: joins.edge_selectivity(*_orders_lines(s, d), "o_orderkey", "l_orderkey", "orders-lineitem"),
        "SELECT 'orders-lineitem' AS edge, count(*) AS matches, count(*) / (CAST((SELECT count(*) FROM orders) AS DOUBLE) * (SELECT count(*) FROM lineitem)) AS selectivity "
        "FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    )
    _add("cost_model_48", lambda s, d: costmodel.study(s), costsql.study())
    _add("cost_small_cache", lambda s, d: costmodel.study(s, 8.0), costsql.study(8.0))
    rounded = {"cost": F.round, "max_rows": F.round}

    def every(s: SparkSession, d: str) -> DataFrame:
        out = costmodel.evaluate(s).drop("description", "conflict")
        return out.withColumns({n: f(n, 2) for n, f in rounded.items()} | {"max_mib": F.round("max_mib", 4)})

    _add("cost_all_orders", every, costsql.all_orders())
    for name, chosen, sql in (("cost_best_order", costmodel.cheapest, costsql.best_order()), ("cost_heuristic", costmodel.heuristic, costsql.heuristic())):
        _add(name, lambda s, d, f=chosen: f(costmodel.evaluate(s)).select("workload_id", "algorithm", "join_order", F.round("cost", 2).alias("cost")), sql)


def _generators() -> None:
    """Counts of generated relations by what their definitions promise."""
    n = 100_000
    counted = lambda df: df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("key").alias("keys"), F.min("key").alias("low"), F.max("key").alias("high"))
    expected = "SELECT CAST({0} AS BIGINT) AS rows, CAST({1} AS BIGINT) AS keys, CAST(1 AS BIGINT) AS low, CAST({1} AS BIGINT) AS high"
    _add("generate_primary_key", lambda s, d: counted(generators.primary_key(s, n)), expected.format(n, n))
    _add("generate_foreign_key", lambda s, d: counted(generators.foreign_key(s, n, 1000)), expected.format(n, 1000))
    _add("generate_foreign_key_of", lambda s, d: counted(generators.foreign_key_of(generators.primary_key(s, 1000), n, 1000)), expected.format(n, 1000))
    _add("generate_zipf", lambda s, d: generators.zipf(s, n, 1 << 27, 1.0))
    _add("generate_non_unique", lambda s, d: generators.non_unique(s, n, 1000))


for _part in (_joins, _more_joins, _hashes, _sorts, _orders, _generators):
    _part()
