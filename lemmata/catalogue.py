"""A query for each operator over the star schema, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import accumulators as a
from .functions.expr import call, eq, f, lit, this, v
from .operators.rulebase import Rulebase
from .operators.session import Session
from .plans.model import FactType, acc, and_, cond, exists, insert, not_, or_, query, retract, rule, test
from .sources.tables import fact_type, session
from .tools.inspect import activations_fired, explanations, fact_graph, rule_matches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names.split()}


def entry(name: str, sql: str):
    def add(fn):
        QUERIES[name] = fn
        SQL[name] = sql
        return fn

    return add


def simple(name: str, names: str, when: list, sql: str, columns=None, rules: list = (), derived: list = (), params: dict | None = None, parents: dict | None = None) -> None:
    """A query (``when``) on tables and what ``rules`` derive; ``columns`` shapes
    the result of the query."""

    @entry(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = query("q", when, list(params or {}))
        s: Session = session(spark, tables(spark, sf_dir, names), [*rules, q], derived, parents).fire()
        out = s.query("q", **(params or {}))
        return columns(out) if columns else out


def _select(*exprs: str):
    return lambda df: df.selectExpr(*exprs)


# conditions on one fact

simple("alpha_filter", "orders", [cond("orders", f("o_totalprice") > 300000, eq(v("k"), f("o_orderkey")), eq(v("p"), f("o_totalprice")))], "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 300000")
simple("alpha_bind_compute", "lineitem", [cond("lineitem", eq(v("net"), f("l_extendedprice") * (1 - f("l_discount"))), v("net") > 90000, eq(v("k"), f("l_orderkey")))], "SELECT l_orderkey AS k, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 90000", _select("k", "round(net, 4) AS net"))
simple("multi_bind", "orders", [cond("orders", eq(v("x"), v("y"), f("o_custkey")), eq(v("k"), f("o_orderkey")), eq(v("s"), f("o_orderstatus"), lit("F")))], "SELECT o_custkey AS x, o_custkey AS y, o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus = 'F'")
simple("rebind_check", "customer", [cond("customer", eq(v("k"), f("c_custkey")), eq(v("m"), f("c_nationkey")), eq(v("m"), call(lambda x: (x % 25).cast("int"), f("c_custkey"))))], "SELECT c_custkey AS k, c_nationkey AS m FROM customer WHERE c_nationkey = c_custkey % 25")

# joins

simple("equi_join", "customer orders", [cond("customer", eq(v("c"), f("c_custkey")), eq(f("c_mktsegment"), lit("BUILDING"))), cond("orders", eq(v("c"), f("o_custkey")), eq(v("k"), f("o_orderkey")))], "SELECT c_custkey AS c, o_orderkey AS k FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
simple("three_way_join", "customer orders nation", [test(v("total") > 200000), cond("orders", eq(v("c"), f("o_custkey")), eq(v("total"), f("o_totalprice"))), cond("nation", eq(v("n"), f("n_nationkey")), eq(v("name"), f("n_name"))), cond("customer", eq(v("c"), f("c_custkey")), eq(v("n"), f("c_nationkey")))], "SELECT c_custkey AS c, n_nationkey AS n, n_name AS name, o_totalprice AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 200000")
simple("theta_join", "orders lineitem", [cond("orders", eq(v("k"), f("o_orderkey")), eq(v("d"), f("o_orderdate"))), cond("lineitem", eq(v("k"), f("l_orderkey")), f("l_shipdate") < v("d"), eq(v("line"), f("l_linenumber")))], "SELECT o_orderkey AS k, o_orderdate AS d, l_linenumber AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
simple("filter_created_binding", "orders lineitem", [cond("orders", eq(v("k"), f("o_orderkey")), eq(v("total"), f("o_totalprice")), v("total") > 250000), cond("lineitem", eq(v("k"), f("l_orderkey")), eq(v("share"), f("l_extendedprice") / v("total")))], "SELECT o_orderkey AS k, o_totalprice AS total, round(l_extendedprice / o_totalprice, 6) AS share FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 250000", _select("k", "total", "round(share, 6) AS share"))
simple("self_join", "supplier", [cond("supplier", eq(v("n"), f("s_nationkey")), eq(v("x"), f("s_suppkey")), eq(v("b"), f("s_acctbal"))), cond("supplier", eq(v("n"), f("s_nationkey")), eq(v("y"), f("s_suppkey")), f("s_acctbal") < v("b"))], "SELECT s.s_nationkey AS n, s.s_suppkey AS x, s.s_acctbal AS b, t.s_suppkey AS y FROM supplier s JOIN supplier t ON s.s_nationkey = t.s_nationkey AND t.s_acctbal < s.s_acctbal")
simple("cartesian", "region nation", [cond("region", eq(v("r"), f("r_name"))), cond("nation", eq(v("n"), f("n_name")))], "SELECT r_name AS r, n_name AS n FROM region CROSS JOIN nation")
simple("nested_eq_filter", "nation supplier", [cond("nation", eq(v("n"), f("n_nationkey")), eq(v("r"), f("n_regionkey"))), cond("supplier", eq(v("n"), f("s_nationkey")), eq(v("r"), lit(1)) | (f("s_acctbal") > 5000), eq(v("s"), f("s_suppkey")))], "SELECT n_nationkey AS n, n_regionkey AS r, s_suppkey AS s FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 1 OR s_acctbal > 5000")
simple("test_condition", "customer orders", [cond("customer", eq(v("c"), f("c_custkey")), eq(v("b"), f("c_acctbal"))), cond("orders", eq(v("c"), f("o_custkey")), eq(v("t"), f("o_totalprice"))), test(v("t") > v("b") * 40, v("b") > 0)], "SELECT c_custkey AS c, c_acctbal AS b, o_totalprice AS t FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > c_acctbal * 40 AND c_acctbal > 0")

# negation, existence, disjunction

simple("negation_equi", "orders lineitem", [cond("orders", eq(v("k"), f("o_orderkey"))), not_(cond("lineitem", eq(v("k"), f("l_orderkey"))))], "SELECT o_orderkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
simple("negation_theta", "customer orders", [cond("customer", eq(v("c"), f("c_custkey")), eq(v("b"), f("c_acctbal"))), not_(cond("orders", eq(v("c"), f("o_custkey")), f("o_totalprice") > v("b") * 40))], "SELECT c_custkey AS c, c_acctbal AS b FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)")
simple("negation_root", "orders", [not_(cond("orders", f("o_totalprice") > 1e9))], "SELECT 'none' AS answer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1e9)", lambda df: df.select(F.lit("none").alias("answer")))
simple("negation_compound", "customer orders lineitem", [cond("customer", eq(v("c"), f("c_custkey"))), not_(and_(cond("orders", eq(v("c"), f("o_custkey")), eq(v("k"), f("o_orderkey"))), cond("lineitem", eq(v("k"), f("l_orderkey")), f("l_quantity") >= 49)))], "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_quantity >= 49)")
simple("negation_nested", "customer orders lineitem", [cond("customer", eq(v("c"), f("c_custkey"))), not_(and_(cond("orders", eq(v("c"), f("o_custkey")), eq(v("k"), f("o_orderkey")), eq(f("o_orderpriority"), lit("1-URGENT"))), not_(cond("lineitem", eq(v("k"), f("l_orderkey"))))))], "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))")
simple("exists_semi", "customer orders", [cond("customer", eq(v("c"), f("c_custkey"))), exists(cond("orders", eq(v("c"), f("o_custkey")), eq(f("o_orderpriority"), lit("1-URGENT"))))], "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
simple("exists_new_binding", "supplier", [exists(cond("supplier", eq(v("n"), f("s_nationkey"))))], "SELECT DISTINCT s_nationkey AS n FROM supplier")
simple("disjunction", "customer supplier", [or_(cond("customer", eq(v("c"), f("c_custkey")), f("c_acctbal") < 0), cond("supplier", eq(v("s"), f("s_suppkey")), f("s_acctbal") < 0))], "SELECT c_custkey AS c, NULL::BIGINT AS s FROM customer WHERE c_acctbal < 0 UNION ALL SELECT NULL, s_suppkey FROM supplier WHERE s_acctbal < 0")

# accumulators

ORDERS = cond("orders", eq(v("c"), f("o_custkey")))
simple("acc_min", "orders", [acc("x", a.min_("o_totalprice"), ORDERS)], "SELECT o_custkey AS c, min(o_totalprice) AS x FROM orders GROUP BY o_custkey")
simple("acc_max_fact", "orders", [acc("x", a.max_(call(lambda p, k: F.struct(p, k), f("o_totalprice"), f("o_orderkey")), returns_fact=True), ORDERS)], "SELECT o_custkey AS c, o_orderkey AS k, o_totalprice AS p FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1", _select("c", "x.o_orderkey AS k", "x.o_totalprice AS p"))
simple("acc_average", "lineitem", [acc("x", a.average("l_quantity"), cond("lineitem", eq(v("c"), f("l_suppkey"))))], "SELECT l_suppkey AS c, round(avg(l_quantity), 4) AS x FROM lineitem GROUP BY l_suppkey", _select("c", "round(x, 4) AS x"))
simple("acc_sum", "lineitem", [acc("x", a.sum_("l_quantity"), cond("lineitem", eq(v("r"), f("l_returnflag"))))], "SELECT l_returnflag AS r, sum(l_quantity) AS x FROM lineitem GROUP BY l_returnflag")
simple("acc_sum_empty", "orders lineitem", [cond("orders", eq(v("k"), f("o_orderkey"))), acc("x", a.sum_("l_quantity"), cond("lineitem", eq(v("k"), f("l_orderkey"))))], "SELECT o_orderkey AS k, coalesce(sum(l_quantity), 0) AS x FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
simple("acc_count_empty", "orders lineitem", [cond("orders", eq(v("k"), f("o_orderkey"))), acc("n", a.count(), cond("lineitem", eq(v("k"), f("l_orderkey")), f("l_quantity") > 45))], "SELECT o_orderkey AS k, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 GROUP BY o_orderkey")
simple("acc_count_new_binding", "orders lineitem", [cond("orders", eq(v("k"), f("o_orderkey"))), acc("n", a.count(), cond("lineitem", eq(v("k"), f("l_orderkey")), eq(v("r"), f("l_returnflag"))))], "SELECT o_orderkey AS k, l_returnflag AS r, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, l_returnflag")
simple("acc_count_root", "orders", [acc("n", a.count(), cond("orders", f("o_totalprice") > 1e9))], "SELECT count(*) AS n FROM orders WHERE o_totalprice > 1e9")
simple("acc_exists", "customer orders", [cond("customer", eq(v("c"), f("c_custkey"))), acc("x", a.exists(), cond("orders", eq(v("c"), f("o_custkey")), f("o_totalprice") > 250000))], "SELECT c_custkey AS c, true AS x FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
simple("acc_distinct_field", "supplier", [acc("x", a.distinct("s_nationkey"), cond("supplier"))], "SELECT count(DISTINCT s_nationkey) AS n, string_agg(DISTINCT s_nationkey::VARCHAR, ',' ORDER BY s_nationkey::VARCHAR) AS x FROM supplier", _select("cast(size(x) AS bigint) AS n", "array_join(array_sort(cast(x AS array<string>)), ',') AS x"))
simple("acc_all", "nation", [acc("x", a.all_("n_name"), cond("nation", eq(v("r"), f("n_regionkey"))))], "SELECT n_regionkey AS r, string_agg(n_name, ',' ORDER BY n_name) AS x FROM nation GROUP BY n_regionkey", _select("r", "array_join(x, ',') AS x"))
simple("acc_grouping_by", "nation", [acc("x", a.grouping_by("n_regionkey"), cond("nation"))], "SELECT n_regionkey AS r, count(*) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey", lambda df: df.select(F.explode("x").alias("g")).selectExpr("g.key AS r", "cast(size(g.items) AS bigint) AS n", "array_join(transform(array_sort(transform(g.items, i -> struct(i.n_nationkey, i.n_name))), i -> i.n_name), ',') AS names"))
simple("acc_theta", "part", [cond("part", eq(v("p"), f("p_partkey")), eq(v("b"), f("p_brand")), eq(v("price"), f("p_retailprice"))), acc("n", a.count(), cond("part", eq(v("b"), f("p_brand")), f("p_retailprice") < v("price")))], "SELECT p_partkey AS p, p_brand AS b, p_retailprice AS price, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS n FROM part")
simple("acc_result_join", "orders", [acc("m", a.max_("o_totalprice"), cond("orders")), cond("orders", eq(v("m"), f("o_totalprice")), eq(v("k"), f("o_orderkey")))], "SELECT o_totalprice AS m, o_orderkey AS k FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
simple("acc_result_in_negation", "customer orders", [cond("customer", eq(v("c"), f("c_custkey"))), acc("m", a.max_("o_totalprice"), ORDERS), not_(cond("orders", eq(v("c"), f("o_custkey")), f("o_totalprice") < v("m") * 0.1))], "SELECT c_custkey AS c, m FROM customer JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) x ON x.o_custkey = c_custkey WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_totalprice < m * 0.1)")
simple("acc_result_unify", "orders", [cond("orders", eq(v("c"), f("o_custkey")), eq(v("m"), f("o_totalprice")), eq(v("k"), f("o_orderkey"))), acc("m", a.max_("o_totalprice"), ORDERS)], "SELECT o_custkey AS c, o_totalprice AS m, o_orderkey AS k FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders x WHERE x.o_custkey = o.o_custkey)")
simple("acc_custom", "lineitem", [acc("x", a.accum(0.0, lambda s, e: s + e * e, lambda s: F.round(s, 2), "l_quantity"), cond("lineitem", eq(v("r"), f("l_suppkey"))))], "SELECT l_suppkey AS r, round(sum(l_quantity * l_quantity), 2) AS x FROM lineitem GROUP BY l_suppkey")
simple("acc_reduce", "nation", [acc("x", a.accum(None, lambda s, e: F.greatest(s, e), field="n_name"), cond("nation", eq(v("r"), f("n_regionkey"))))], "SELECT n_regionkey AS r, max(n_name) AS x FROM nation GROUP BY n_regionkey")
simple("acc_with_finish", "nation", [acc("x", a.all_("n_name").with_finish(lambda x: F.size(x).cast("long")), cond("nation", eq(v("r"), f("n_regionkey"))))], "SELECT n_regionkey AS r, count(*) AS x FROM nation GROUP BY n_regionkey")

# rules

BIG = FactType("BigSpender", "custkey bigint, orderkey bigint")
BIG_RULE = rule("big-spender", [cond("customer", eq(v("c"), f("c_custkey")), eq(f("c_mktsegment"), lit("BUILDING"))), cond("orders", eq(v("c"), f("o_custkey")), eq(v("k"), f("o_orderkey")), f("o_totalprice") > 300000)], insert("BigSpender", custkey=v("c"), orderkey=v("k")))
BIG_QUERY = [cond("BigSpender", eq(v("c"), f("custkey")), eq(v("k"), f("orderkey")))]
simple("big_spender", "customer orders", BIG_QUERY, "SELECT c_custkey AS c, o_orderkey AS k FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 300000", rules=[BIG_RULE], derived=[BIG])
simple("rule_chain", "customer orders", [cond("Active", eq(v("c"), f("custkey")), eq(v("n"), f("n")))], "SELECT o_custkey AS c, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 150000 GROUP BY o_custkey HAVING count(*) > 3", rules=[rule("large", [cond("customer", eq(v("c"), f("c_custkey"))), cond("orders", eq(v("c"), f("o_custkey")), eq(v("k"), f("o_orderkey")), f("o_totalprice") > 150000)], insert("Large", custkey=v("c"), orderkey=v("k"))), rule("active", [acc("n", a.count(), cond("Large", eq(v("c"), f("custkey")))), test(v("n") > 3)], insert("Active", custkey=v("c"), n=v("n")))], derived=[FactType("Large", "custkey bigint, orderkey bigint"), FactType("Active", "custkey bigint, n bigint")])
simple("rule_multi_insert", "nation", [cond("Tag", eq(v("k"), f("k")), eq(v("t"), f("t")))], "SELECT n_nationkey AS k, n_name AS t FROM nation UNION ALL SELECT n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT n_nationkey, unnest(['x', 'y']) FROM nation", rules=[rule("tags", [cond("nation", eq(v("k"), f("n_nationkey")), eq(v("n"), f("n_name")), eq(v("r"), f("n_regionkey")))], [insert("Tag", k=v("k"), t=v("n")), insert("Tag", k=v("k"), t=call(lambda r: F.concat(F.lit("r"), r), v("r"))), insert("Tag", each=("e", call(lambda: F.array(F.lit("x"), F.lit("y")))), k=v("k"), t=v("e"))])], derived=[FactType("Tag", "k int, t string")])
simple("rule_conditional_insert", "supplier", [cond("Debt", eq(v("s"), f("s")))], "SELECT s_suppkey AS s FROM supplier WHERE s_acctbal < 0", rules=[rule("debt", [cond("supplier", eq(v("s"), f("s_suppkey")), eq(v("b"), f("s_acctbal")))], insert("Debt", when=v("b") < 0, s=v("s")))], derived=[FactType("Debt", "s bigint")])
simple("rule_duplicate_support", "supplier", [cond("Served", eq(v("n"), f("n")))], "SELECT s_nationkey AS n FROM supplier", rules=[rule("served", [cond("supplier", eq(v("n"), f("s_nationkey")))], insert("Served", n=v("n")))], derived=[FactType("Served", "n int")])
simple("type_ancestor", "customer supplier", [cond("party", eq(v("k"), f("key")), eq(v("n"), f("nation")), f("balance") < 0)], "SELECT c_custkey AS k, c_nationkey AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal < 0", parents={"customer": (("party",), {"party": {"key": "c_custkey", "nation": "c_nationkey", "balance": "c_acctbal"}}), "supplier": (("party",), {"party": {"key": "s_suppkey", "nation": "s_nationkey", "balance": "s_acctbal"}})})
simple("query_params", "customer", [cond("customer", eq(v("c"), f("c_custkey")), eq(v("segment"), f("c_mktsegment")))], "SELECT c_custkey AS c, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'MACHINERY'", params={"segment": "MACHINERY"})
simple("doc_exact_duplicates", "documents", [cond("documents", eq(v("t"), f("text")), eq(v("x"), f("doc_id"))), cond("documents", eq(v("t"), f("text")), eq(v("y"), f("doc_id")), f("doc_id") > v("x"))], "SELECT a.doc_id AS x, b.doc_id AS y FROM documents a JOIN documents b ON a.text = b.text AND b.doc_id > a.doc_id", _select("x", "y"))
simple("unlabelled_docs", "documents labels", [cond("documents", eq(v("d"), f("doc_id"))), not_(cond("labels", eq(v("d"), f("doc_id"))))], "SELECT doc_id AS d FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
simple("purchase_without_later_click", "events", [cond("events", eq(v("e"), f("event_id")), eq(v("u"), f("user_id")), eq(v("at"), f("ts")), eq(f("event_type"), lit("purchase"))), not_(cond("events", eq(v("u"), f("user_id")), eq(f("event_type"), lit("click")), f("ts") > v("at")))], "SELECT event_id AS e, user_id AS u, ts AS at FROM events p WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.user_id = p.user_id AND c.event_type = 'click' AND c.ts > p.ts)")
simple("fact_binding", "nation", [cond("nation", f("n_regionkey") > 2, bind="x"), cond("nation", eq(v("x"), this), eq(v("k"), f("n_nationkey")))], "SELECT n_nationkey AS k FROM nation WHERE n_regionkey > 2", _select("k"))
simple("destructured_argument", "nation", [cond("nation", eq(v("k"), f("id")), v("k") > 10, args={"id": f("n_nationkey")})], "SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 10")
simple("rule_recursive", "nation", [cond("Path", eq(v("x"), f("x")), eq(v("y"), f("y")))], "WITH RECURSIVE edge AS (SELECT n_nationkey AS x, n_nationkey + n_regionkey + 1 AS y FROM nation), path AS (SELECT x, y FROM edge UNION ALL SELECT e.x, p.y FROM edge e JOIN path p ON p.x = e.y) SELECT x, y FROM path", rules=[rule("edges", [cond("nation", eq(v("x"), f("n_nationkey")), eq(v("r"), f("n_regionkey")))], insert("Edge", x=v("x"), y=v("x") + v("r") + 1)), rule("base", [cond("Edge", eq(v("x"), f("x")), eq(v("y"), f("y")))], insert("Path", x=v("x"), y=v("y"))), rule("step", [cond("Edge", eq(v("x"), f("x")), eq(v("z"), f("y"))), cond("Path", eq(v("z"), f("x")), eq(v("y"), f("y")))], insert("Path", x=v("x"), y=v("y")))], derived=[FactType("Edge", "x int, y int"), FactType("Path", "x int, y int")])

# sessions

SUPPLIERS = query("q", [cond("supplier", eq(v("s"), f("s_suppkey")), eq(v("n"), f("s_nationkey")))])


@entry("session_retract", "SELECT s_suppkey AS s, s_nationkey AS n FROM supplier WHERE NOT s_acctbal < 0")
def session_retract(spark, sf_dir):
    t = tables(spark, sf_dir, "supplier")
    s = session(spark, t, [SUPPLIERS]).fire()
    return s.retract("supplier", t["supplier"].where("s_acctbal < 0")).fire().query("q")


@entry("session_cancelling", "SELECT s_suppkey AS s, s_nationkey AS n FROM supplier UNION ALL SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey >= 5")
def session_cancelling(spark, sf_dir):
    t = table(spark, sf_dir, "supplier")
    s = session(spark, {"supplier": t}, [SUPPLIERS])
    return s.retract("supplier", t.where("s_nationkey < 5")).insert("supplier", t).fire(cancelling=True).query("q")


@entry("unconditional_insert", "SELECT s_suppkey AS s FROM supplier WHERE s_acctbal < 0")
def unconditional_insert(spark, sf_dir):
    t = table(spark, sf_dir, "supplier")
    found = rule("seen", [cond("supplier", eq(v("s"), f("s_suppkey")), f("s_acctbal") < 0)], insert("Seen", unconditional=True, s=v("s")))
    s = session(spark, {"supplier": t}, [found, query("q", [cond("Seen", eq(v("s"), f("s")))])], [FactType("Seen", "s bigint")]).fire()
    return s.retract("supplier", t.where("s_acctbal < 0")).fire().query("q")


@entry("rhs_retract", "SELECT s_suppkey AS s, s_nationkey AS n FROM supplier WHERE NOT s_acctbal < 0")
def rhs_retract(spark, sf_dir):
    drop = rule("drop", [cond("supplier", f("s_acctbal") < 0, bind="x")], retract("supplier", fact="x"))
    return session(spark, tables(spark, sf_dir, "supplier"), [drop, SUPPLIERS]).fire().query("q")


@entry("salience_visible", "SELECT 'high' AS by, n_nationkey AS k FROM nation")
def salience_visible(spark, sf_dir):
    def claim(name, salience):
        free = not_(cond("Claim", eq(v("k"), f("k"))))
        return rule(name, [cond("nation", eq(v("k"), f("n_nationkey"))), free], insert("Claim", unconditional=True, by=lit(name), k=v("k")), salience=salience)

    q = query("q", [cond("Claim", eq(v("by"), f("by")), eq(v("k"), f("k")))])
    return session(spark, tables(spark, sf_dir, "nation"), [claim("low", 0), claim("high", 10), q], [FactType("Claim", "by string, k int")]).fire().query("q")


@entry("no_loop", "SELECT n_nationkey AS k, n_regionkey + 1 AS n FROM nation UNION ALL SELECT n_nationkey, n_regionkey FROM nation")
def no_loop(spark, sf_dir):
    bump = rule("bump", [cond("Level", eq(v("k"), f("k")), eq(v("n"), f("n")))], insert("Level", k=v("k"), n=v("n") + 1), no_loop=True)
    t = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS k", "n_regionkey AS n")
    return session(spark, {"Level": t}, [bump, query("q", [cond("Level", eq(v("k"), f("k")), eq(v("n"), f("n")))])]).fire().query("q")


@entry("truth_maintenance", "SELECT c_custkey AS c, o_orderkey AS k FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 300000 AND c_acctbal >= 0")
def truth_maintenance(spark, sf_dir):
    t = tables(spark, sf_dir, "customer orders")
    s = session(spark, t, [BIG_RULE, query("q", BIG_QUERY)], [BIG]).fire()
    return s.retract("customer", t["customer"].where("c_acctbal < 0")).fire().query("q")


@entry("fact_graph_edges", "WITH m AS (SELECT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 300000) SELECT 'match' AS kind, 'big-spender' AS rule, 2 * count(*) AS n FROM m HAVING count(*) > 0 UNION ALL SELECT 'insert', 'big-spender', count(*) FROM m HAVING count(*) > 0")
def fact_graph_edges(spark, sf_dir):
    s = session(spark, tables(spark, sf_dir, "customer orders"), [BIG_RULE], [BIG]).fire()
    return fact_graph(s).groupBy("kind", "rule").agg(F.count("*").alias("n"))


# further rows of the inventory

NATIONS = cond("nation", eq(v("k"), f("n_nationkey")), eq(v("r"), f("n_regionkey")))
simple("acc_min_fact", "orders", [acc("x", a.min_(call(lambda p, k: F.struct(p, k), f("o_totalprice"), f("o_orderkey")), returns_fact=True), ORDERS)], "SELECT o_custkey AS c, o_orderkey AS k, o_totalprice AS p FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1", _select("c", "x.o_orderkey AS k", "x.o_totalprice AS p"))
simple("acc_all_facts", "nation", [acc("x", a.all_(), cond("nation", eq(v("r"), f("n_regionkey"))))], "SELECT n_regionkey AS r, string_agg(n_nationkey || n_name, ',' ORDER BY n_nationkey || n_name) AS x FROM nation GROUP BY n_regionkey", _select("r", "array_join(array_sort(transform(x, i -> concat(i.n_nationkey, i.n_name))), ',') AS x"))
simple("acc_null_groups", "supplier", [acc("n", a.count(), cond("supplier", eq(v("g"), call(lambda x: F.when(x % 3 == 0, F.lit(None)).otherwise(x % 3), f("s_nationkey")))))], "SELECT CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE s_nationkey % 3 END AS g, count(*) AS n FROM supplier GROUP BY 1", _select("CAST(g AS INT) AS g", "n"))
simple("negated_test", "supplier", [cond("supplier", eq(v("s"), f("s_suppkey")), eq(v("b"), f("s_acctbal"))), not_(test(v("b") > 0))], "SELECT s_suppkey AS s, s_acctbal AS b FROM supplier WHERE NOT s_acctbal > 0")
simple("negation_double", "customer orders", [cond("customer", eq(v("c"), f("c_custkey"))), not_(not_(cond("orders", eq(v("c"), f("o_custkey")), f("o_totalprice") > 250000)))], "SELECT c_custkey AS c FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 250000")
simple("distribution", "nation supplier customer", [and_(NATIONS, or_(cond("supplier", eq(v("k"), f("s_nationkey")), f("s_acctbal") < 0, eq(v("x"), f("s_suppkey"))), cond("customer", eq(v("k"), f("c_nationkey")), f("c_acctbal") < -900, eq(v("x"), f("c_custkey")))))], "SELECT n_nationkey AS k, n_regionkey AS r, s_suppkey AS x FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal < 0 UNION ALL SELECT n_nationkey, n_regionkey, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal < -900")
simple("rule_without_conditions", "region", [cond("Start", eq(v("n"), f("n")))], "SELECT 1 AS n", rules=[rule("start", [], insert("Start", n=lit(1)))], derived=[FactType("Start", "n int")])


@entry("acc_distinct_facts", "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY n_regionkey")
def acc_distinct_facts(spark, sf_dir):
    t = table(spark, sf_dir, "nation")
    q = query("q", [acc("x", a.distinct(), cond("nation", eq(v("r"), f("n_regionkey"))))])
    return session(spark, {"nation": t.unionByName(t)}, [q]).fire().query("q").selectExpr("r", "CAST(size(x) AS BIGINT) AS n")


@entry("identity", "SELECT n_nationkey AS k FROM nation")
def identity(spark, sf_dir):
    """Each nation twice: one pair of each by rising identity."""
    t = table(spark, sf_dir, "nation")
    q = query("q", [cond("nation", eq(v("x"), f("__fid")), eq(v("k"), f("n_nationkey"))), cond("nation", f("__fid") > v("x"), eq(v("k"), f("n_nationkey")))])
    s = Session(Rulebase([fact_type("nation", t)], [q], identity=True), spark)
    return s.insert("nation", t).insert("nation", t).fire().query("q").select("k")


@entry("pending_order", "SELECT s_suppkey AS s, s_nationkey AS n FROM supplier WHERE s_nationkey >= 5")
def pending_order(spark, sf_dir):
    """Retracted before it is inserted, a fact stays; after it, it goes."""
    t = table(spark, sf_dir, "supplier")
    high, low = t.where("s_nationkey >= 5"), t.where("s_nationkey < 5")
    s = session(spark, {"supplier": t.limit(0)}, [SUPPLIERS])
    return s.retract("supplier", high).insert("supplier", t).retract("supplier", low).fire().query("q")


@entry("before_firing", "SELECT s_suppkey AS s, s_nationkey AS n FROM supplier WHERE s_acctbal < 0")
def before_firing(spark, sf_dir):
    """What is queued after a firing is not seen before the next."""
    t = table(spark, sf_dir, "supplier")
    s = session(spark, {"supplier": t.where("s_acctbal < 0")}, [SUPPLIERS]).fire()
    return s.insert("supplier", t.where("s_acctbal >= 0")).query("q")


@entry("insert_all_unconditional", "SELECT n_nationkey AS k, x FROM nation, (VALUES ('a'), ('b')) t(x) WHERE n_regionkey = 1")
def insert_all_unconditional(spark, sf_dir):
    t = table(spark, sf_dir, "nation")
    both = rule("both", [NATIONS, test(v("r") == 1)], insert("Mark", each=("x", call(lambda: F.array(F.lit("a"), F.lit("b")))), unconditional=True, k=v("k"), x=v("x")))
    s = session(spark, {"nation": t}, [both, query("q", [cond("Mark", eq(v("k"), f("k")), eq(v("x"), f("x")))])], [FactType("Mark", "k int, x string")]).fire()
    return s.retract("nation", t).fire().query("q")


@entry("order_within_actions", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey <> 2")
def order_within_actions(spark, sf_dir):
    """A retraction comes after the insertions beside it, wherever it is written."""
    swap = rule("swap", [NATIONS], [retract("Mark", k=v("k")), insert("Mark", k=v("k"), unconditional=True), insert("Mark", when=v("r") != 2, k=v("k"), unconditional=True)])
    return session(spark, tables(spark, sf_dir, "nation"), [swap, query("q", [cond("Mark", eq(v("k"), f("k")))])], [FactType("Mark", "k int")]).fire().query("q")


def _claims(name: str, **options):
    free = not_(cond("Claim", eq(v("k"), f("k"))))
    return rule(name, [cond("nation", eq(v("k"), f("n_nationkey"))), free], insert("Claim", unconditional=True, by=lit(name), k=v("k")), **options)


CLAIM = FactType("Claim", "by string, k int")
CLAIMED = query("q", [cond("Claim", eq(v("by"), f("by")), eq(v("k"), f("k")))])


@entry("group_functions", "SELECT 'longer' AS by, n_nationkey AS k FROM nation")
def group_functions(spark, sf_dir):
    """Rules grouped by the length of their names, longest first."""
    t = table(spark, sf_dir, "nation")
    base = Rulebase([fact_type("nation", t), CLAIM], [_claims("short"), _claims("longer"), CLAIMED], lambda r: len(r.name), lambda g: -g)
    return Session(base, spark).insert("nation", t).fire().query("q")


@entry("load_order", "SELECT 'first' AS by, n_nationkey AS k FROM nation")
def load_order(spark, sf_dir):
    return session(spark, tables(spark, sf_dir, "nation"), [_claims("first"), _claims("second"), CLAIMED], [CLAIM]).fire().query("q")


@entry("group_change", "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY n_regionkey")
def group_change(spark, sf_dir):
    """All that a group inserts is there before the next one counts it."""
    mark = rule("mark", [NATIONS], insert("Mark", unconditional=True, r=v("r")), salience=1)
    tally = rule("tally", [acc("n", a.count(), cond("Mark", eq(v("r"), f("r"))))], insert("Tally", unconditional=True, r=v("r"), n=v("n")))
    q = query("q", [cond("Tally", eq(v("r"), f("r")), eq(v("n"), f("n")))])
    return session(spark, tables(spark, sf_dir, "nation"), [tally, mark, q], [FactType("Mark", "r int"), FactType("Tally", "r int, n bigint")]).fire().query("q")


FIRED = query("q", [cond("Seen", eq(v("k"), f("k")))])


@entry("fired_once", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def fired_once(spark, sf_dir):
    """A second firing fires nothing; facts that went and came back fire again."""
    t = table(spark, sf_dir, "nation")
    some = t.where("n_regionkey = 1")
    seen = rule("seen", [NATIONS], insert("Seen", unconditional=True, k=v("k")))
    s = session(spark, {"nation": t}, [seen, FIRED], [FactType("Seen", "k int")]).fire().fire()
    return s.retract("nation", some).fire().insert("nation", some).fire().query("q")


@entry("pending_cancelled", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey <> 1")
def pending_cancelled(spark, sf_dir):
    """What a rule before it retracts never fires."""
    drop = rule("drop", [cond("nation", eq(f("n_regionkey"), lit(1)), bind="x")], retract("nation", fact="x"), salience=1)
    seen = rule("seen", [NATIONS], insert("Seen", unconditional=True, k=v("k")))
    return session(spark, tables(spark, sf_dir, "nation"), [seen, drop, FIRED], [FactType("Seen", "k int")]).fire().query("q")


@entry("unchanged_result", "SELECT n_regionkey AS r, max(n_nationkey) AS m FROM nation GROUP BY n_regionkey")
def unchanged_result(spark, sf_dir):
    """More facts that leave a group's maximum as it is do not fire again."""
    t = table(spark, sf_dir, "nation")
    top = rule("top", [acc("m", a.max_("n_nationkey"), cond("nation", eq(v("r"), f("n_regionkey"))))], insert("Top", unconditional=True, r=v("r"), m=v("m")))
    q = query("q", [cond("Top", eq(v("r"), f("r")), eq(v("m"), f("m")))])
    s = session(spark, {"nation": t}, [top, q], [FactType("Top", "r int, m int")]).fire()
    return s.insert("nation", t).fire().retract("nation", t).fire().query("q")


@entry("full_logging", "SELECT n_nationkey AS k FROM nation")
def full_logging(spark, sf_dir):
    """Activations that fired, those whose facts went since included."""
    t = table(spark, sf_dir, "nation")
    seen = rule("seen", [NATIONS], insert("Seen", k=v("k")))
    s = session(spark, {"nation": t}, [seen], [FactType("Seen", "k int")]).with_full_logging().fire()
    s = s.retract("nation", t.where("n_regionkey = 1")).fire()
    return activations_fired(s, "seen").select(F.get_json_object("bindings", "$.k").cast("int").alias("k"))


@entry("matches", "SELECT c_custkey AS c, o_orderkey AS k, 2 AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 300000")
def matches(spark, sf_dir):
    s = session(spark, tables(spark, sf_dir, "customer orders"), [BIG_RULE], [BIG]).fire()
    return rule_matches(s, "big-spender").select("c", "k", F.size("matched").alias("n"))


@entry("accumulated_facts", "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY n_regionkey")
def accumulated_facts(spark, sf_dir):
    tally = rule("tally", [acc("x", a.max_("n_name"), cond("nation", eq(v("r"), f("n_regionkey"))))], insert("Tally", r=v("r")))
    s = session(spark, tables(spark, sf_dir, "nation"), [tally], [FactType("Tally", "r int")]).fire()
    return rule_matches(s, "tally").select("r", F.size("accumulated").cast("long").alias("n"))


@entry("fact_explanations", "SELECT 'big-spender' AS rule, 2 AS matched, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 300000 HAVING count(*) > 0")
def fact_explanations(spark, sf_dir):
    s = session(spark, tables(spark, sf_dir, "customer orders"), [BIG_RULE], [BIG]).fire()
    return explanations(s).groupBy("rule", F.size("matched").alias("matched")).agg(F.count("*").alias("n"))
