"""One query per operator, and SQL that gives the same rows from the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weirflow.operators.mutate import par_drain, update_where
from weirflow.operators.pipe import Maybe, Pipe
from weirflow.operators.recursive import linearize, par_rec_edges, par_rec_exact
from weirflow.sources import par, par_empty, par_iter, par_range

#: Unique order keys; of lineitem no shorter one is.
KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str, items: list[str] | None = None) -> Pipe:
    return par(spark.read.parquet(f"{d}/{name}.parquet"), KEYS[name], items)


def cents(c: Column) -> Column:
    """Exact sums of money do not depend on the order of addition."""
    return F.round(c * 100).cast("long")


# -- element-wise


@query("SELECT o_orderkey, round(o_totalprice * 100)::BIGINT * 11 AS price FROM orders")
def map_collect(spark, d):
    return table(spark, d, "orders").map(lambda x: {"o_orderkey": x.o_orderkey, "price": cents(x.o_totalprice) * 11}).collect()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def filter_collect(spark, d):
    return table(spark, d, "orders", ["o_orderkey", "o_totalprice"]).filter(lambda x: x.o_totalprice > 100000).collect()


@query("SELECT * FROM (SELECT l_orderkey, round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT) AS revenue FROM lineitem) WHERE revenue > 200000000")
def map_filter_collect(spark, d):
    pipe = table(spark, d, "lineitem").map(lambda x: {"l_orderkey": x.l_orderkey, "revenue": cents(x.l_extendedprice) * (100 - cents(x.l_discount))})
    return pipe.filter(lambda x: x.revenue > 200000000).collect()


@query("SELECT unnest([c_custkey, c_custkey + 1, c_custkey + 2]) AS value FROM customer")
def flat_map_collect(spark, d):
    return table(spark, d, "customer").flat_map(lambda x: F.array(x.c_custkey, x.c_custkey + 1, x.c_custkey + 2)).collect()


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS customer FROM orders WHERE o_orderkey % 3 <> 0")
def filter_map_collect(spark, d):
    return table(spark, d, "orders").filter_map(lambda x: Maybe(x.o_orderkey % 3 != 0, {"customer": F.when(x.o_orderkey % 2 == 0, x.o_custkey)})).collect()


@query("SELECT unnest(embedding)::DOUBLE AS value FROM embeddings")
def flatten_collect(spark, d):
    return table(spark, d, "embeddings").flatten("embedding").map(lambda x: x.embedding.cast("double")).collect()


@query("""SELECT c * 3 - 1 AS value FROM (SELECT b + 7 AS c FROM (SELECT l_partkey * 2 AS b, l_quantity FROM lineitem WHERE l_quantity > 10) WHERE b % 3 = 0) WHERE (c * 3 - 1) % 2 = 0""")
def long_chain_collect(spark, d):
    pipe = table(spark, d, "lineitem", ["l_partkey", "l_quantity"]).filter(lambda x: x.l_quantity > 10).map(lambda x: x.l_partkey * 2)
    pipe = pipe.filter(lambda x: x.value % 3 == 0).map(lambda x: x.value + 7).map(lambda x: x.value * 3).map(lambda x: x.value - 1)
    return pipe.filter(lambda x: x.value % 2 == 0).collect()


@query("""SELECT l_partkey * 2 + 7 AS value FROM lineitem WHERE l_quantity > 10 ORDER BY value DESC LIMIT 1""")
def long_chain_reduce(spark, d):
    pipe = table(spark, d, "lineitem", ["l_partkey", "l_quantity"]).filter(lambda x: x.l_quantity > 10)
    return pipe.map(lambda x: x.l_partkey * 2).map(lambda x: x.value + 7).reduce("max")


@query(r"""SELECT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM documents""")
def words_flat_map(spark, d):
    return table(spark, d, "documents").flat_map(lambda x: F.regexp_extract_all(x.text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), "word").to_df()


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def inspect_passthrough(spark, d):
    return table(spark, d, "orders", ["o_orderkey", "o_orderstatus"]).inspect("seen", rows=F.count(F.lit(1))).collect()


@query("SELECT o_orderkey, o_custkey FROM orders")
def copied_cloned(spark, d):
    return table(spark, d, "orders", ["o_orderkey", "o_custkey"]).copied().cloned().collect()


@query("SELECT p_partkey, upper(p_name) AS name FROM part WHERE p_size > 25")
def python_closures(spark, d):
    pipe = table(spark, d, "part", ["p_partkey", "p_name", "p_size"]).filter_py(lambda p_partkey, p_name, p_size: p_size > 25)
    return pipe.map_py(lambda p_partkey, p_name, p_size: (p_partkey, p_name.upper()), "p_partkey long, name string").collect()


# -- reductions


@query("SELECT sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS value FROM lineitem")
def reduce_add(spark, d):
    return table(spark, d, "lineitem").map(lambda x: cents(x.l_extendedprice)).reduce("add")


@query("SELECT bit_xor(o_custkey) AS value FROM orders")
def reduce_xor(spark, d):
    return table(spark, d, "orders").map(lambda x: x.o_custkey).reduce("bit_xor")


@query("SELECT string_agg(n_name, '|' ORDER BY n_nationkey) AS value FROM nation")
def reduce_concat_ordered(spark, d):
    return table(spark, d, "nation").map(lambda x: x.n_name).reduce(lambda a, b: F.concat(a, F.lit("|"), b))


@query("SELECT max(hash_) AS value FROM (SELECT (o_orderkey * 7919) % 100003 AS hash_ FROM orders)")
def reduce_closure_commutative(spark, d):
    return table(spark, d, "orders").map(lambda x: x.o_orderkey * 7919 % 100003).reduce(lambda a, b: F.greatest(a, b), commutative=True)


@query("SELECT max(o_custkey) AS value FROM orders WHERE false")
def reduce_empty(spark, d):
    return table(spark, d, "orders").filter(lambda x: F.lit(False)).map(lambda x: x.o_custkey).reduce("max")


@query("SELECT coalesce(sum(l_quantity::BIGINT), 0)::BIGINT AS value FROM lineitem WHERE l_returnflag = 'R'")
def sum_filtered(spark, d):
    return table(spark, d, "lineitem").filter(lambda x: x.l_returnflag == "R").map(lambda x: x.l_quantity.cast("long")).sum()


@query("SELECT 0::BIGINT AS value")
def sum_empty(spark, d):
    return table(spark, d, "orders").filter(lambda x: x.o_orderkey < 0).map(lambda x: x.o_custkey).sum()


@query("SELECT count(*) AS value FROM orders WHERE o_orderpriority LIKE '1%'")
def count_filter(spark, d):
    return table(spark, d, "orders").filter(lambda x: x.o_orderpriority.startswith("1")).count()


@query("SELECT count(*) AS value FROM (SELECT unnest(embedding) AS v FROM embeddings) WHERE v > 0")
def count_flat_map(spark, d):
    return table(spark, d, "embeddings").flatten("embedding").filter(lambda x: x.embedding > 0).count()


@query("SELECT min(o_totalprice) AS value FROM orders")
def min_value(spark, d):
    return table(spark, d, "orders").min("o_totalprice")


@query("SELECT max(o_totalprice) AS value FROM orders")
def max_value(spark, d):
    return table(spark, d, "orders").max("o_totalprice")


_LINE = "l_orderkey, l_linenumber, l_partkey, l_quantity"
_LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"


@query(f"SELECT {_LINE} FROM lineitem ORDER BY l_quantity, {_LINE_ORDER} LIMIT 1")
def min_by_key(spark, d):
    return table(spark, d, "lineitem", _LINE.split(", ")).min_by_key(lambda x: x.l_quantity)


@query(f"SELECT {_LINE} FROM lineitem ORDER BY l_quantity DESC, {_LINE_ORDER} LIMIT 1")
def max_by_key(spark, d):
    return table(spark, d, "lineitem", _LINE.split(", ")).max_by_key(lambda x: x.l_quantity)


@query("SELECT p_partkey, p_size, p_name FROM part ORDER BY p_size, p_partkey LIMIT 1")
def min_by(spark, d):
    return table(spark, d, "part", ["p_partkey", "p_size", "p_name"]).min_by(lambda a, b: a.p_size - b.p_size)


@query("SELECT p_partkey, p_size, p_name FROM part ORDER BY p_size DESC, p_partkey LIMIT 1")
def max_by(spark, d):
    return table(spark, d, "part", ["p_partkey", "p_size", "p_name"]).max_by(lambda a, b: a.p_size - b.p_size)


@query("SELECT coalesce(bool_and(coalesce(o_totalprice > 0, false)), true) AS value FROM orders")
def all_true(spark, d):
    return table(spark, d, "orders").all(lambda x: x.o_totalprice > 0)


@query("SELECT true AS value")
def all_empty(spark, d):
    return table(spark, d, "orders").filter(lambda x: F.lit(False)).all(lambda x: F.lit(False))


@query("SELECT coalesce(bool_or(coalesce(o_totalprice > 300000, false)), false) AS value FROM orders")
def any_true(spark, d):
    return table(spark, d, "orders").any(lambda x: x.o_totalprice > 300000)


@query("SELECT false AS value")
def any_empty(spark, d):
    return table(spark, d, "orders").filter(lambda x: F.lit(False)).any(lambda x: F.lit(True))


# -- early exit


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 1")
def first_ordered(spark, d):
    return table(spark, d, "events", ["event_id", "user_id", "event_type"]).first()


@query("SELECT event_id, user_id, event_type FROM events WHERE value > 50 ORDER BY event_id LIMIT 1")
def find_ordered(spark, d):
    return table(spark, d, "events", ["event_id", "user_id", "event_type", "value"]).filter(lambda x: x.value > 50).map(lambda x: {n: x[n] for n in ("event_id", "user_id", "event_type")}).find(lambda x: F.lit(True))


@query("SELECT CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS event_type")
def find_none(spark, d):
    return table(spark, d, "events", ["event_id", "event_type"]).find(lambda x: x.event_id < 0)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def arbitrary_find_unique(spark, d):
    pipe = table(spark, d, "orders", ["o_orderkey"])
    last = pipe.max("o_orderkey").first()[0]
    return pipe.iteration_order("arbitrary").find(lambda x: x.o_orderkey == last)


# -- ordered prefixes


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE NOT coalesce(o_totalprice < 400000, false)) OR NOT EXISTS (SELECT 1 FROM orders WHERE NOT coalesce(o_totalprice < 400000, false))")
def take_while_collect(spark, d):
    return table(spark, d, "orders", ["o_orderkey", "o_totalprice"]).take_while(lambda x: x.o_totalprice < 400000).collect()


@query("SELECT o_orderkey FROM orders")
def take_while_never_stops(spark, d):
    return table(spark, d, "orders", ["o_orderkey"]).take_while(lambda x: x.o_orderkey >= 0).collect()


@query("SELECT n_chars * 2 AS value FROM documents WHERE doc_id < coalesce((SELECT min(doc_id) FROM documents WHERE NOT coalesce(n_chars < 15000, false)), 9223372036854775807)")
def map_while_collect(spark, d):
    return table(spark, d, "documents").map_while(lambda x: Maybe(x.n_chars < 15000, x.n_chars * 2)).collect()


@query("SELECT coalesce(sum(o_custkey), 0)::BIGINT AS value FROM orders WHERE o_orderkey < coalesce((SELECT min(o_orderkey) FROM orders WHERE o_totalprice >= 400000), 9223372036854775807)")
def take_while_sum(spark, d):
    return table(spark, d, "orders").take_while(lambda x: x.o_totalprice < 400000).map(lambda x: x.o_custkey).sum()


@query("SELECT min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey < coalesce((SELECT min(o_orderkey) FROM orders WHERE o_totalprice >= 400000), 9223372036854775807)")
def take_while_find(spark, d):
    pipe = table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"]).take_while(lambda x: x.o_totalprice < 400000)
    return pipe.filter(lambda x: x.o_orderstatus == "P").map(lambda x: {"o_orderkey": x.o_orderkey}).first()


@query("""WITH e AS (SELECT c_custkey AS k, j, c_custkey + j * 10 AS v FROM customer, (VALUES (0), (1), (2)) t(j)),
s AS (SELECT k, j FROM e WHERE v >= 1000 ORDER BY k, j LIMIT 1)
SELECT v AS value FROM e WHERE NOT EXISTS (SELECT 1 FROM s) OR (k, j) < (SELECT (k, j) FROM s)""")
def flat_map_take_while(spark, d):
    pipe = table(spark, d, "customer").flat_map(lambda x: F.array(x.c_custkey, x.c_custkey + 10, x.c_custkey + 20))
    return pipe.take_while(lambda x: x.value < 1000).collect()


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey < coalesce((SELECT min(o_orderkey) FROM orders WHERE o_totalprice >= 400000), 9223372036854775807)
AND o_orderkey < coalesce((SELECT min(o_orderkey) FROM orders WHERE o_orderkey % 1000 = 999), 9223372036854775807)""")
def take_while_twice(spark, d):
    return table(spark, d, "orders", ["o_orderkey", "o_totalprice"]).take_while(lambda x: x.o_totalprice < 400000).take_while(lambda x: x.o_orderkey % 1000 != 999).map(lambda x: {"o_orderkey": x.o_orderkey}).collect()


# -- positions, containers, mutation


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS index, n_name FROM nation")
def enumerate_collect(spark, d):
    return table(spark, d, "nation", ["n_name"]).enumerate().collect()


@query("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS index, l_orderkey FROM lineitem")
def enumerate_large(spark, d):
    return table(spark, d, "lineitem", ["l_orderkey"]).enumerate().to_df()


@query("SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
def chain_collect(spark, d):
    return table(spark, d, "region").map(lambda x: {"name": x.r_name}).chain(table(spark, d, "nation").map(lambda x: {"name": x.n_name})).collect()


@query("SELECT min(i) AS index, name FROM (SELECT row_number() OVER (ORDER BY s, k) - 1 AS i, name FROM (SELECT 0 AS s, r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation)) GROUP BY name, i")
def collect_into_enumerated(spark, d):
    into = table(spark, d, "region").map(lambda x: {"name": x.r_name})
    return table(spark, d, "nation").map(lambda x: {"name": x.n_name}).collect_into(into).enumerate().collect()


@query("SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) WHERE i >= 100 AND i < 150")
def drain_taken(spark, d):
    return par_drain(table(spark, d, "part", ["p_partkey", "p_name"]), 100, 150)[0].collect()


@query("SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) WHERE i < 100 OR i >= 150")
def drain_rest(spark, d):
    return par_drain(table(spark, d, "part", ["p_partkey", "p_name"]), 100, 150)[1].collect()


@query("SELECT p_partkey, CASE WHEN p_brand LIKE '%1' THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part")
def mut_update(spark, d):
    pipe = table(spark, d, "part", ["p_partkey", "p_brand", "p_retailprice"])
    pipe = update_where(pipe, lambda x: x.p_brand.endswith("1"), lambda x: {"p_retailprice": x.p_retailprice * 2})
    return pipe.map(lambda x: {"p_partkey": x.p_partkey, "p_retailprice": x.p_retailprice}).collect()


# -- fallible pipelines


def _parsed(spark, d, broken: int):
    """Order keys as text, every ``broken``-th unreadable (0: none), read back."""
    text = lambda x: F.when((x.o_orderkey % broken == 650) if broken else F.lit(False), F.concat(x.o_orderkey.cast("string"), F.lit("!"))).otherwise(x.o_orderkey.cast("string"))
    pipe = table(spark, d, "orders", ["o_orderkey", "o_totalprice"]).map(lambda x: {"s": text(x), "o_totalprice": x.o_totalprice})
    number = lambda x: x.s.try_cast("bigint")
    return pipe.into_fallible_result(lambda x: {"n": number(x)}, lambda x: F.when(number(x).isNull(), x.s))


_BAD = "(SELECT min(o_orderkey) FROM orders WHERE o_orderkey % 700 = 650)"


@query("SELECT o_orderkey * 2 AS value FROM orders")
def result_collect_ok(spark, d):
    return _parsed(spark, d, 0).map(lambda x: x.n * 2).collect()


@query("SELECT o_orderkey AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 700 = 650)")
def result_collect_err(spark, d):
    return _parsed(spark, d, 700).collect()


@query(f"SELECT {_BAD} || '!' AS err")
def result_error(spark, d):
    return _parsed(spark, d, 700).error()


@query(f"SELECT CASE WHEN {_BAD} IS NULL THEN (SELECT sum(o_orderkey)::BIGINT FROM orders) END AS value, {_BAD} || '!' AS err")
def result_sum(spark, d):
    return _parsed(spark, d, 700).sum()


@query("SELECT count(*) AS value, CAST(NULL AS VARCHAR) AS err FROM orders")
def result_count(spark, d):
    return _parsed(spark, d, 0).count()


@query(f"SELECT CASE WHEN h < coalesce({_BAD}, 9223372036854775807) THEN h END AS n, CASE WHEN h > {_BAD} THEN {_BAD} || '!' END AS err FROM (SELECT min(o_orderkey) AS h FROM orders WHERE o_orderkey > 300 AND o_orderkey % 700 <> 650)")
def result_find(spark, d):
    return _parsed(spark, d, 700).find(lambda x: x.n > 300)


@query(f"SELECT CASE WHEN h < coalesce({_BAD}, 9223372036854775807) THEN false WHEN {_BAD} IS NULL THEN h IS NULL END AS value, CASE WHEN h IS NULL OR h > {_BAD} THEN {_BAD} || '!' END AS err FROM (SELECT min(o_orderkey) AS h FROM orders WHERE o_orderkey >= 900 AND o_orderkey % 700 <> 650)")
def result_all(spark, d):
    return _parsed(spark, d, 700).all(lambda x: x.n < 900)


@query("SELECT true AS value, CAST(NULL AS VARCHAR) AS err")
def result_any(spark, d):
    return _parsed(spark, d, 700).any(lambda x: x.n >= 0)


@query("SELECT max(o_orderkey) AS value, CAST(NULL AS VARCHAR) AS err FROM orders")
def result_max(spark, d):
    return _parsed(spark, d, 0).max("n")


@query("SELECT bit_xor(o_orderkey) AS value, CAST(NULL AS VARCHAR) AS err FROM orders")
def result_reduce(spark, d):
    return _parsed(spark, d, 0).reduce(lambda a, b: a.bitwiseXOR(b), "n", commutative=True)


@query("SELECT o_orderkey AS n, CAST(NULL AS VARCHAR) AS err FROM orders ORDER BY o_orderkey % 97 DESC, o_orderkey LIMIT 1")
def result_max_by_key(spark, d):
    return _parsed(spark, d, 0).max_by_key(lambda x: x.n % 97)


@query("SELECT sum(o_orderkey)::BIGINT AS value, CAST(NULL AS VARCHAR) AS err FROM orders WHERE o_orderkey % 700 <> 650")
def result_filter_removes_error(spark, d):
    pipe = table(spark, d, "orders", ["o_orderkey"]).filter(lambda x: x.o_orderkey % 700 != 650)
    return pipe.into_fallible_result(lambda x: x.o_orderkey, lambda x: F.when(x.o_orderkey % 700 == 650, F.lit("!"))).sum()


@query("SELECT unnest([o_orderkey, -o_orderkey]) AS value FROM orders WHERE o_orderkey % 2 = 1")
def result_flat_map(spark, d):
    return _parsed(spark, d, 0).filter(lambda x: x.n % 2 == 1).flat_map(lambda x: F.array(x.n, -x.n)).collect()


def _option(spark, d, gone: bool):
    return table(spark, d, "events", ["event_id", "props"]).into_fallible_option(lambda x: Maybe(F.get_json_object(x.props, "$.k").isNotNull() & ((x.event_id % 997 != 5) if gone else F.lit(True)), {"k": F.get_json_object(x.props, "$.k").cast("long")}))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def option_collect(spark, d):
    return _option(spark, d, False).collect()


@query("SELECT sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS value, false AS absent FROM events")
def option_sum(spark, d):
    return _option(spark, d, False).sum("k")


@query("SELECT CAST(NULL AS BIGINT) AS value, true AS absent")
def option_sum_absent(spark, d):
    return _option(spark, d, True).sum("k")


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, false AS absent FROM events ORDER BY event_id LIMIT 1")
def option_first(spark, d):
    return _option(spark, d, True).first()


# -- recursion

_EDGES = """edges AS (SELECT 'w' AS parent, 'r' || r_regionkey AS child FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


def _tree(spark, d, **kw) -> Pipe:
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    edge = lambda df, a, p, b, c: df.select(F.concat(F.lit(a), F.col(p)).alias("parent"), F.concat(F.lit(b), F.col(c)).alias("child"))
    edges = edge(t("nation"), "r", "n_regionkey", "n", "n_nationkey").unionByName(edge(t("customer"), "n", "c_nationkey", "c", "c_custkey")).unionByName(edge(t("orders"), "c", "o_custkey", "o", "o_orderkey"))
    roots = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return par_rec_edges(roots, edges, **kw)


_REC = "WITH RECURSIVE {e}, t AS (SELECT child AS node, 0 AS depth FROM edges WHERE parent = 'w' UNION ALL SELECT e.child, t.depth + 1 FROM t JOIN edges e ON e.parent = t.node {w})"


@query(_REC.format(e=_EDGES, w="") + " SELECT sum(length(node) * (depth + 1))::BIGINT AS value FROM t")
def rec_sum(spark, d):
    return _tree(spark, d).map(lambda x: (F.length(x.node) * (x.depth + 1)).cast("long")).sum()


@query(_REC.format(e=_EDGES, w="WHERE right(e.child, 1) <> '7'") + " SELECT count(*) AS value FROM t")
def rec_pruned(spark, d):
    return _tree(spark, d, prune=lambda parent, child: ~child.endswith("7")).count()


@query(_REC.format(e=_EDGES, w="") + " SELECT node, depth FROM t WHERE right(node, 2) = '42'")
def rec_filter_collect(spark, d):
    return _tree(spark, d).filter(lambda x: x.node.endswith("42")).collect()


@query(_REC.format(e=_EDGES, w="") + " SELECT sum(length(node) * (depth + 1))::BIGINT AS value FROM t")
def rec_linearized(spark, d):
    return linearize(_tree(spark, d)).map(lambda x: (F.length(x.node) * (x.depth + 1)).cast("long")).sum()


# -- state a partition


@query()
def using_rng(spark, d):
    import random

    def step(rng, c_custkey):
        return {"c_custkey": c_custkey, "noise": rng.random()}

    return table(spark, d, "customer", ["c_custkey"]).using(lambda k: random.Random(k)).map(step).into("c_custkey long, noise double").collect()


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0")
def using_clone(spark, d):
    def count(state, c_custkey):
        state["n"] += 1
        return {"c_custkey": c_custkey}

    return table(spark, d, "customer", ["c_custkey"]).using_clone({"n": 0}).filter(lambda s, c_custkey: c_custkey % 3 == 0).map(count).into("c_custkey long").collect()


@query("SELECT c_custkey, left(md5(c_custkey || '-7'), 8) AS draw FROM customer")
def using_hash_det(spark, d):
    import hashlib

    def draw(seed, c_custkey):
        return {"c_custkey": c_custkey, "draw": hashlib.md5(f"{c_custkey}-{seed}".encode()).hexdigest()[:8]}

    return table(spark, d, "customer", ["c_custkey"]).using_clone(7).map(draw).into("c_custkey long, draw string").collect()


# -- sources and knobs


@query("SELECT sum(i * 2)::BIGINT AS value FROM range(1, 100001) t(i)")
def range_sum(spark, d):
    return par_range(spark, 1, 100001).map(lambda x: x.value * 2).sum()


@query("SELECT count(*) AS value FROM region WHERE false")
def empty_count(spark, d):
    return par_empty(spark, "x long").count()


@query("SELECT i AS x, i * i AS y FROM range(0, 1000) t(i) WHERE (i * i) % 7 = 2")
def iterator_source(spark, d):
    return par_iter(spark, ((i, i * i) for i in range(1000)), "x long, y long").filter(lambda x: x.y % 7 == 2).collect()


@query("SELECT sum(o_custkey)::BIGINT AS value FROM orders")
def num_threads_one(spark, d):
    return table(spark, d, "orders").num_threads(1).chunk_size(64).map(lambda x: x.o_custkey).sum()


@query("SELECT sum(o_custkey)::BIGINT AS value FROM orders")
def num_threads_many(spark, d):
    return table(spark, d, "orders").num_threads(4).with_pool("bulk").map(lambda x: x.o_custkey).sum()


@query("SELECT count(*) AS rows FROM orders")
def diagnostics_rows(spark, d):
    return table(spark, d, "orders").diagnostics().agg(F.sum("rows").alias("rows"))


# -- terminals and transformations not met above


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 1")
def collect_arbitrary(spark, d):
    return table(spark, d, "orders", ["o_orderkey"]).iteration_order("arbitrary").filter(lambda x: x.o_orderkey % 5 == 1).collect()


def _told(spark, **values) -> DataFrame:
    """One row of whole numbers that a run left behind."""
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} long" for n in values))


@query("SELECT count(*) AS calls, sum(o_custkey)::BIGINT AS total FROM orders")
def for_each_seen(spark, d):
    calls, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def see(rows):
        for row in rows:
            calls.add(1)
            total.add(row["o_custkey"])

    table(spark, d, "orders", ["o_custkey"]).for_each(see)
    return _told(spark, calls=calls.value, total=total.value)


@query("SELECT count(*) AS rows, sum(o_custkey)::BIGINT AS total FROM orders WHERE o_orderkey % 2 = 0")
def inspect_metric(spark, d):
    seen = Observation()
    pipe = table(spark, d, "orders").filter(lambda x: x.o_orderkey % 2 == 0).inspect(seen, rows=F.count(F.lit(1)), total=F.sum("o_custkey"))
    pipe.to_df().write.format("noop").mode("overwrite").save()
    return _told(spark, **{n: seen.get[n] for n in ("rows", "total")})


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS value FROM orders WHERE o_orderkey % 3 = 0")
def result_filter_map(spark, d):
    return _parsed(spark, d, 0).filter_map(lambda x: Maybe(x.n % 3 == 0, F.when(x.n % 2 == 0, x.n))).collect()


@query("SELECT count(*) AS rows FROM orders")
def result_inspect(spark, d):
    seen = Observation()
    _parsed(spark, d, 0).inspect(seen, rows=F.count(F.lit(1))).collect().write.format("noop").mode("overwrite").save()
    return _told(spark, rows=seen.get["rows"])


@query("SELECT p_partkey AS n FROM part UNION ALL SELECT o_orderkey FROM orders")
def result_collect_into(spark, d):
    return _parsed(spark, d, 0).collect_into(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("n")))


@query("SELECT p_partkey AS n FROM part WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 700 = 650)")
def result_collect_into_err(spark, d):
    taken = _parsed(spark, d, 700).filter(lambda x: x.n < 0)
    return taken.collect_into(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("n")))


@query("SELECT count(*) AS calls FROM orders")
def result_for_each(spark, d):
    calls = spark.sparkContext.accumulator(0)
    _parsed(spark, d, 0).for_each(lambda rows: calls.add(sum(1 for _ in rows)))
    return _told(spark, calls=calls.value)


@query("SELECT min(o_orderkey) AS value, CAST(NULL AS VARCHAR) AS err FROM orders")
def result_min(spark, d):
    return _parsed(spark, d, 0).min("n")


@query("SELECT o_orderkey AS n, CAST(NULL AS VARCHAR) AS err FROM orders ORDER BY o_orderkey % 89, o_orderkey LIMIT 1")
def result_min_by_key(spark, d):
    return _parsed(spark, d, 0).min_by_key(lambda x: x.n % 89)


@query("SELECT o_orderkey AS n, CAST(NULL AS VARCHAR) AS err FROM orders ORDER BY o_orderkey % 83, o_orderkey LIMIT 1")
def result_min_by(spark, d):
    return _parsed(spark, d, 0).min_by(lambda a, b: a.n % 83 - b.n % 83)


@query("SELECT o_orderkey AS n, CAST(NULL AS VARCHAR) AS err FROM orders ORDER BY o_orderkey % 79 DESC, o_orderkey LIMIT 1")
def result_max_by(spark, d):
    return _parsed(spark, d, 0).max_by(lambda a, b: a.n % 79 - b.n % 79)


@query("SELECT min(o_orderkey) AS n, CAST(NULL AS VARCHAR) AS err FROM orders")
def result_first(spark, d):
    return _parsed(spark, d, 0).first()


@query("SELECT sum(o_orderkey)::BIGINT AS value, CAST(NULL AS VARCHAR) AS err FROM orders")
def result_knobs(spark, d):
    return _parsed(spark, d, 0).num_threads(2).chunk_size(16).iteration_order("arbitrary").with_pool("bulk").sum("n")


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(f"SELECT unnest([k + 1, -k]) AS value FROM (SELECT {_K} AS k FROM events) WHERE k % 2 = 0 AND k % 3 = 0")
def option_chain(spark, d):
    pipe = _option(spark, d, False).inspect("options", rows=F.count(F.lit(1))).filter(lambda x: x.k % 2 == 0)
    return pipe.filter_map(lambda x: Maybe(x.k % 3 == 0, x.k)).map(lambda x: {"k": x.value}).flat_map(lambda x: F.array(x.k + 1, -x.k)).collect()


@query("SELECT count(*) AS value, false AS absent FROM events")
def option_count(spark, d):
    return _option(spark, d, False).count()


@query(f"SELECT bit_xor({_K}) AS value, false AS absent FROM events")
def option_reduce(spark, d):
    return _option(spark, d, False).reduce(lambda a, b: a.bitwiseXOR(b), "k", commutative=True)


@query("SELECT true AS value, false AS absent")
def option_all(spark, d):
    return _option(spark, d, False).all(lambda x: x.k.isNotNull())


@query(f"SELECT count(*) > 0 AS value, false AS absent FROM events WHERE {_K} = 3")
def option_any(spark, d):
    return _option(spark, d, False).any(lambda x: x.k == 3)


@query(f"SELECT min({_K}) AS value, false AS absent FROM events")
def option_min(spark, d):
    return _option(spark, d, False).min("k")


@query(f"SELECT max({_K}) AS value, false AS absent FROM events")
def option_max(spark, d):
    return _option(spark, d, False).max("k")


@query(f"SELECT {_K} AS k, false AS absent FROM events ORDER BY {_K} % 7, event_id LIMIT 1")
def option_min_by_key(spark, d):
    return _option(spark, d, False).min_by_key(lambda x: x.k % 7)


@query(f"SELECT {_K} AS k, false AS absent FROM events ORDER BY {_K} % 7 DESC, event_id LIMIT 1")
def option_max_by_key(spark, d):
    return _option(spark, d, False).max_by_key(lambda x: x.k % 7)


@query(f"SELECT {_K} AS k, false AS absent FROM events ORDER BY {_K} % 11, event_id LIMIT 1")
def option_min_by(spark, d):
    return _option(spark, d, False).min_by(lambda a, b: a.k % 11 - b.k % 11)


@query(f"SELECT {_K} AS k, false AS absent FROM events ORDER BY {_K} % 11 DESC, event_id LIMIT 1")
def option_max_by(spark, d):
    return _option(spark, d, False).max_by(lambda a, b: a.k % 11 - b.k % 11)


@query(f"SELECT {_K} AS k, false AS absent FROM events WHERE {_K} % 5 = 4 ORDER BY event_id LIMIT 1")
def option_find(spark, d):
    return _option(spark, d, False).find(lambda x: x.k % 5 == 4)


@query("SELECT count(*) AS calls FROM events")
def option_for_each(spark, d):
    calls = spark.sparkContext.accumulator(0)
    _option(spark, d, False).for_each(lambda rows: calls.add(sum(1 for _ in rows)))
    return _told(spark, calls=calls.value)


# -- state a partition, read


@query("SELECT c_custkey, true AS drawn FROM customer")
def using_rng_rows(spark, d):
    import random

    def step(rng, c_custkey):
        return {"c_custkey": c_custkey, "drawn": 0 <= rng.random() < 1}

    return table(spark, d, "customer", ["c_custkey"]).using(lambda k: random.Random(k)).map(step).into("c_custkey long, drawn boolean").collect()


@query("SELECT i AS n FROM range(1, (SELECT count(*) FROM customer)::BIGINT + 1) t(i)")
def using_state_counts(spark, d):
    def count(state, c_custkey):
        state["n"] += 1
        return {"n": state["n"]}

    return table(spark, d, "customer", ["c_custkey"]).num_threads(1).using_clone({"n": 0}).map(count).into("n long").collect()


@query("SELECT unnest([c_custkey, c_custkey * 2]) AS v FROM customer WHERE c_custkey % 2 = 0")
def using_flat(spark, d):
    pipe = table(spark, d, "customer", ["c_custkey"]).using_clone([2]).copied().inspect(lambda s, c_custkey: s.append(0) if len(s) < 3 else None)
    pipe = pipe.filter_map(lambda s, c_custkey: {"v": [c_custkey, c_custkey * s[0]]} if c_custkey % s[0] == 0 else None).flatten("v")
    return pipe.flat_map(lambda s, v: [{"v": v}]).cloned().into("v long").collect()


@query("SELECT bit_xor(c_custkey * 3) AS v FROM customer")
def using_reduce(spark, d):
    return table(spark, d, "customer", ["c_custkey"]).using_clone(3).map(lambda s, c_custkey: {"v": c_custkey * s}).reduce(lambda s, a, b: {"v": a["v"] ^ b["v"]}, "v long")


@query("SELECT string_agg(n_name, '' ORDER BY n_nationkey) AS v FROM nation")
def using_reduce_ordered(spark, d):
    return table(spark, d, "nation", ["n_name"]).using_clone("").map(lambda s, n_name: {"v": n_name}).reduce(lambda s, a, b: {"v": a["v"] + s + b["v"]}, "v string")


@query("SELECT count(*) AS calls, sum(c_custkey)::BIGINT AS total FROM customer WHERE c_custkey % 4 = 0")
def using_for_each(spark, d):
    calls, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def see(state, c_custkey):
        calls.add(1)
        total.add(c_custkey)

    table(spark, d, "customer", ["c_custkey"]).using_clone(4).filter(lambda s, c_custkey: c_custkey % s == 0).for_each(see)
    return _told(spark, calls=calls.value, total=total.value)


@query("SELECT count(*) AS n, sum(v)::BIGINT AS s, min(v) AS lo, max(v) AS hi, bool_and(v > 0) AS every, bool_or(v % 10 = 7) AS some, (SELECT min(c_custkey * 2) FROM customer) AS first, (SELECT c_custkey * 2 FROM customer WHERE c_custkey > 20 ORDER BY c_custkey LIMIT 1) AS found, (SELECT c_custkey * 2 FROM customer ORDER BY c_custkey * 2 % 31, c_custkey LIMIT 1) AS least, (SELECT c_custkey * 2 FROM customer ORDER BY c_custkey * 2 % 29 DESC, c_custkey LIMIT 1) AS most FROM (SELECT c_custkey * 2 AS v FROM customer)")
def using_terminals(spark, d):
    pipe = table(spark, d, "customer", ["c_custkey"]).using_clone(2).map(lambda s, c_custkey: {"v": c_custkey * s}).into("v long")
    parts = [pipe.count("n"), pipe.sum(name="s"), pipe.min(name="lo"), pipe.max(name="hi"), pipe.all(lambda x: x.v > 0, "every"), pipe.any(lambda x: x.v % 10 == 7, "some")]
    named = [(pipe.first(), "first"), (pipe.find(lambda x: x.v > 40), "found"), (pipe.min_by_key(lambda x: x.v % 31), "least"), (pipe.max_by_key(lambda x: x.v % 29), "most")]
    parts += [df.withColumnRenamed("v", name) for df, name in named]
    out = parts[0]
    for part in parts[1:]:  # one row each
        out = out.select("*", *(part.select(c).scalar().alias(c) for c in part.columns))
    return out


@query("SELECT sum(c_custkey * 5)::BIGINT AS value, CAST(NULL AS VARCHAR) AS err FROM customer")
def using_result_sum(spark, d):
    return table(spark, d, "customer", ["c_custkey"]).using_clone(5).into_fallible_result(lambda s, c_custkey: ({"v": c_custkey * s}, None), "v long").sum("v")


@query("SELECT CASE WHEN b IS NULL THEN s END AS value, b || '?' AS err FROM (SELECT sum(c_custkey)::BIGINT AS s, min(CASE WHEN c_custkey % 50 = 49 THEN c_custkey END) AS b FROM customer)")
def using_result_err(spark, d):
    return table(spark, d, "customer", ["c_custkey"]).using_clone(49).into_fallible_result(lambda s, c_custkey: (None, f"{c_custkey}?") if c_custkey % 50 == s else ({"v": c_custkey}, None), "v long").sum("v")


@query("SELECT max(c_custkey) AS value, false AS absent FROM customer")
def using_option_max(spark, d):
    return table(spark, d, "customer", ["c_custkey"]).using_clone(-1).into_fallible_option(lambda s, c_custkey: {"v": c_custkey} if c_custkey > s else None, "v long").max("v")


# -- knobs, observed


@query("SELECT count(*) AS rows, true AS small, true AS several FROM orders")
def chunk_size_seen(spark, d):
    told = table(spark, d, "orders", ["o_orderkey"]).chunk_size(64).diagnostics()
    return told.agg(F.sum("rows").alias("rows"), (F.max("largest_batch") <= 64).alias("small"), (F.sum("calls") >= F.sum("rows") / 64).alias("several"))


@query("SELECT 1::BIGINT AS tasks, count(*) AS rows FROM orders")
def num_threads_seen(spark, d):
    return table(spark, d, "orders", ["o_orderkey"]).num_threads(1).diagnostics().agg(F.count("*").alias("tasks"), F.sum("rows").alias("rows"))


@query("SELECT sum(o_orderkey)::BIGINT AS value FROM orders")
def runner_chosen(spark, d):
    return table(spark, d, "orders", ["o_orderkey"]).with_runner(lambda df: df.repartition(3)).sum()


@query(_REC.format(e=_EDGES, w="") + " SELECT count(*) AS value FROM t")
def rec_exact(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    sizes = {n: t(n).count() for n in ("region", "nation", "customer", "orders")}
    roots = t("region").select(F.col("r_regionkey").cast("long").alias("key"), F.lit("region").alias("kind"))
    below = {"region": ("nation", "n_regionkey", "n_nationkey"), "nation": ("customer", "c_nationkey", "c_custkey"), "customer": ("orders", "o_custkey", "o_orderkey")}

    def extend(level: DataFrame) -> DataFrame:
        parts = [level.where(F.col("kind") == kind).join(t(name), F.col("key") == F.col(up)).select(F.col(own).cast("long").alias("key"), F.lit(name).alias("kind")) for kind, (name, up, own) in below.items()]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    return par_rec_exact(roots, extend, sum(sizes.values())).count()


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return map_filter_collect(spark, d)
