"""SQL for DuckDB of each registered query, over the same tables."""

from __future__ import annotations

SQL: dict[str, str] = {
    "actor_info": "SELECT r.r_name, string_agg(DISTINCT x, ', ' ORDER BY x) AS info FROM (SELECT r.r_name, n.n_name || ': ' || (SELECT string_agg(s.s_name, ', ' ORDER BY s.s_name) FROM supplier s WHERE s.s_nationkey=n.n_nationkey) AS x FROM region r LEFT JOIN nation n ON n.n_regionkey=r.r_regionkey) r GROUP BY r.r_name",
    "anon_partial": "SELECT c_custkey, left(c_name,2)||'***'||right(c_name,2) AS c_name FROM customer",
    "anti_left_null": "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON o.o_custkey=c.c_custkey AND o.o_orderstatus='P' WHERE o.o_orderkey IS NULL",
    "arith_join": "SELECT n.n_nationkey, r.r_name FROM nation n JOIN region r ON n.n_nationkey=r.r_regionkey+10",
    "array_agg_rows": "SELECT n_regionkey, CAST(to_json(list({'n_nationkey': n_nationkey, 'n_name': n_name} ORDER BY n_nationkey)) AS VARCHAR) AS nations FROM nation GROUP BY n_regionkey",
    "audit_json": "SELECT o_orderkey, CAST(json_object('o_orderkey',o_orderkey,'o_orderstatus',o_orderstatus) AS VARCHAR) AS new_data FROM orders",
    "audit_log": "SELECT 'users' AS table_name, op AS operation, user_id, CASE WHEN op='INSERT' THEN NULL ELSE old_type END AS old_data, CASE WHEN op='DELETE' THEN NULL ELSE event_type END AS new_data, ts AS changed_at FROM (SELECT user_id, event_id, ts, event_type, CASE WHEN lag(event_type) OVER w IS NULL THEN 'INSERT' WHEN lead(event_type) OVER w IS NULL AND event_type='purchase' THEN 'DELETE' ELSE 'UPDATE' END AS op, lag(event_type) OVER w AS old_type, lead(ts) OVER w AS next_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) x",
    "audit_redact": "SELECT c_custkey, sha256(c_name) AS c_name FROM customer",
    "audit_shared_log": "SELECT 'nation' AS table_name, n_name AS new_data FROM nation UNION ALL SELECT 'region' AS table_name, r_name AS new_data FROM region",
    "case_notes": "SELECT c_custkey AS id, CASE WHEN c_acctbal>=0 THEN 'active' ELSE '' END AS notes FROM customer",
    "column_diff": "SELECT coalesce(a.c,b.c) AS c, CASE WHEN b.c IS NULL THEN 'drop_column' WHEN a.c IS NULL THEN 'add_column' ELSE 'modify_column' END AS change FROM (SELECT * FROM (VALUES ('o_orderkey','bigint'),('o_custkey','int'),('o_note','text')) v(c,t)) a FULL OUTER JOIN (SELECT * FROM (VALUES ('o_orderkey','bigint'),('o_custkey','bigint'),('o_comment','text')) w(c,t)) b ON a.c=b.c WHERE a.c IS NULL OR b.c IS NULL OR a.t<>b.t",
    "customer_balance": "SELECT c.c_custkey, coalesce(f.fees,0) - coalesce(p.paid,0) AS balance FROM customer c LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS fees FROM orders WHERE o_orderdate<=TIMESTAMP '2024-06-30 00:00:00' GROUP BY o_custkey) f ON f.o_custkey=c.c_custkey LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS paid FROM orders WHERE o_orderstatus='F' GROUP BY o_custkey) p ON p.o_custkey=c.c_custkey",
    "customer_list": "SELECT c.c_custkey AS id, concat(c.c_name,' ',c.c_mktsegment) AS name, n.n_name AS city, r.r_name AS country, CASE WHEN c.c_acctbal>=0 THEN 'active' ELSE '' END AS notes FROM customer c JOIN nation n ON c.c_nationkey=n.n_nationkey JOIN region r ON n.n_regionkey=r.r_regionkey",
    "distinct": "SELECT DISTINCT c_mktsegment FROM customer",
    "exclude_glob": "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_brand,'^Brand#1.*$')",
    "exists_semi": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey=c.c_custkey AND o.o_totalprice>400000)",
    "explode_array": "SELECT p_partkey, unnest(string_split(p_name,' ')) AS w FROM part",
    "film_list": "SELECT r.r_regionkey AS fid, r.r_name AS title, string_agg(concat(n.n_name,' ',s.s_name), ', ' ORDER BY concat(n.n_name,' ',s.s_name)) AS actors FROM region r LEFT JOIN nation n ON n.n_regionkey=r.r_regionkey JOIN supplier s ON s.s_nationkey=n.n_nationkey GROUP BY r.r_regionkey, r.r_name",
    "fk_orphans": "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey=o.o_custkey AND c.c_acctbal>0)",
    "friends_in_list": "SELECT a.n_nationkey, f.n_name FROM nation a JOIN nation f ON f.n_nationkey IN (a.n_nationkey+1, a.n_nationkey+2)",
    "generate_series": "SELECT unnest(generate_series(30894622507013190,30894622507013200)) AS v",
    "group_concat": "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "groupby_dedupe": "SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "has_many": "SELECT o.o_custkey, count(*) AS n_children FROM orders o GROUP BY o.o_custkey",
    "having_summary": "SELECT c.c_custkey, count(o.o_orderkey) AS post_count, max(o.o_orderdate) AS latest FROM customer c LEFT JOIN orders o ON o.o_custkey=c.c_custkey GROUP BY c.c_custkey HAVING count(o.o_orderkey)>=2",
    "history_delete": "SELECT user_id, old_type AS event_type, ts AS valid_from, ts AS valid_to, op AS history_operation FROM (SELECT user_id, event_id, ts, event_type, CASE WHEN lag(event_type) OVER w IS NULL THEN 'INSERT' WHEN lead(event_type) OVER w IS NULL AND event_type='purchase' THEN 'DELETE' ELSE 'UPDATE' END AS op, lag(event_type) OVER w AS old_type, lead(ts) OVER w AS next_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) x WHERE op IN ('UPDATE','DELETE')",
    "history_update": "SELECT user_id, old_type, ts AS valid_from, ts AS valid_to, 'UPDATE' AS history_operation FROM (SELECT user_id, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts,event_id) AS old_type FROM events) x WHERE old_type IS NOT NULL",
    "ilike_search": "SELECT p_partkey FROM part WHERE p_name ILIKE '%RED%'",
    "in_stock_anti": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey=c.c_custkey AND o.o_orderstatus='O')",
    "inherit_union": "SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS INTEGER) AS extra FROM supplier UNION ALL SELECT c_custkey AS id, c_name AS name, c_nationkey AS extra FROM customer",
    "join_derived_agg": "SELECT c.c_custkey, a.n FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) a ON a.o_custkey=c.c_custkey",
    "left_join_on_filter": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey=c.c_custkey AND o.o_orderstatus='F'",
    "modulo_filter": "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1",
    "name_clash": "SELECT lower(p_brand) AS nm, count(*) AS n FROM part GROUP BY lower(p_brand) HAVING count(*)>1",
    "nicer_name": "SELECT c_custkey, concat(upper(substring(c_mktsegment,1,1)), lower(substring(c_mktsegment,2))) AS nm FROM customer",
    "not_exists": "SELECT n_nationkey FROM nation n WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey=n.n_nationkey AND c.c_acctbal<-990)",
    "not_null_violations": "SELECT count(*) AS violations FROM (SELECT CASE WHEN c_acctbal<0 THEN NULL ELSE c_mktsegment END AS seg FROM customer) t WHERE seg IS NULL",
    "partial_unique_violations": "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus='P' GROUP BY o_custkey HAVING count(*)>1",
    "partition_month_sum": "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY year(o_orderdate), month(o_orderdate)",
    "pk_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*)>1",
    "proj_alias": "SELECT c_custkey AS x, c_name AS name, 2 AS constant FROM customer",
    "rewards_report": "SELECT c.c_custkey, c.c_name FROM customer c WHERE c.c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1996-12-31 00:00:00' GROUP BY o_custkey HAVING sum(o_totalprice)>500000 AND count(o_orderkey)>2)",
    "rls_default_deny": "SELECT c_custkey FROM customer WHERE 1=0",
    "rls_select_policy": "SELECT c_custkey, c_mktsegment FROM customer WHERE (c_nationkey=1) OR (c_mktsegment='BUILDING')",
    "sales_by_category": "SELECT r.r_name AS category, CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_sales FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN customer c ON o.o_custkey=c.c_custkey JOIN nation n ON c.c_nationkey=n.n_nationkey JOIN region r ON n.n_regionkey=r.r_regionkey GROUP BY r.r_name ORDER BY total_sales DESC",
    "sales_by_store": "SELECT concat(n.n_name,',',r.r_name) AS store, s.s_name AS manager, CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_sales FROM lineitem l JOIN supplier s ON l.l_suppkey=s.s_suppkey JOIN nation n ON s.s_nationkey=n.n_nationkey JOIN region r ON n.n_regionkey=r.r_regionkey GROUP BY n.n_name, r.r_name, s.s_name",
    "scd2_current": "SELECT user_id,event_id FROM (SELECT user_id,event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts,event_id) AS valid_to FROM events) v WHERE valid_to IS NULL",
    "scd2_versions": "SELECT user_id,event_id,event_type,ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts,event_id) AS valid_to FROM events",
    "scd2_with_delete": "SELECT user_id, event_type, ts AS valid_from, next_ts AS valid_to FROM (SELECT user_id, event_id, ts, event_type, CASE WHEN lag(event_type) OVER w IS NULL THEN 'INSERT' WHEN lead(event_type) OVER w IS NULL AND event_type='purchase' THEN 'DELETE' ELSE 'UPDATE' END AS op, lag(event_type) OVER w AS old_type, lead(ts) OVER w AS next_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) x WHERE op<>'DELETE'",
    "schema_diff": "SELECT coalesce(a.c,b.c) AS c, CASE WHEN b.c IS NULL THEN 'drop_column' WHEN a.c IS NULL THEN 'add_column' WHEN a.t<>b.t THEN 'modify_column' END AS change FROM (SELECT * FROM (VALUES ('id','int'),('nm','text'),('x','int')) v(c,t)) a FULL OUTER JOIN (SELECT * FROM (VALUES ('id','bigint'),('name','text'),('x','int')) v(c,t)) b ON a.c=b.c WHERE b.c IS NULL OR a.c IS NULL OR a.t<>b.t",
    "schema_evolve_copy": "SELECT c_custkey, coalesce(CASE WHEN c_acctbal<0 THEN NULL ELSE c_mktsegment END,'UNKNOWN') AS c_mktsegment FROM customer",
    "softdelete_active": "SELECT o_orderkey,o_custkey FROM (SELECT *, CASE WHEN o_orderstatus='F' THEN o_orderdate END AS deleted_at FROM orders) t WHERE deleted_at IS NULL",
    "softdelete_cascade": "SELECT l.l_orderkey,l.l_linenumber,p.deleted_at AS deleted_at FROM lineitem l LEFT JOIN (SELECT o_orderkey,o_orderdate AS deleted_at FROM orders WHERE o_orderstatus='F') p ON l.l_orderkey=p.o_orderkey",
    "softdelete_cascade_chain": "SELECT l.l_orderkey, l.l_linenumber, o.deleted_at FROM lineitem l LEFT JOIN (SELECT o.o_orderkey, c.deleted_at FROM orders o LEFT JOIN (SELECT c_custkey, CASE WHEN c_acctbal<0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS deleted_at FROM customer) c ON o.o_custkey=c.c_custkey) o ON l.l_orderkey=o.o_orderkey",
    "struct_access": "SELECT o_orderkey, struct_pack(a:=o_custkey,b:=o_orderstatus).a + 1 AS a1 FROM orders",
    "substr_zero": "SELECT DISTINCT substr(n_name,0,10) AS z FROM nation",
    "top1_lateral": "SELECT c.c_custkey, x.o_orderkey FROM customer c LEFT JOIN LATERAL (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey=c.c_custkey ORDER BY o.o_orderkey LIMIT 1) x ON true",
    "topo_levels": "WITH RECURSIVE deps(child,parent) AS (SELECT * FROM (VALUES ('lineitem','orders'),('orders','customer'),('customer','nation'),('nation','region')) v(child,parent)), lvl(obj,depth) AS (SELECT 'region' AS obj,0 AS depth UNION ALL SELECT d.child, l.depth+1 FROM deps d JOIN lvl l ON d.parent=l.obj) SELECT obj,max(depth) AS depth FROM lvl GROUP BY obj",
    "udtf_user_posts": "SELECT c.c_custkey, o.o_orderkey, o.o_orderstatus FROM customer c JOIN orders o ON o.o_custkey=c.c_custkey",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "unnest_zip": "SELECT p_partkey, unnest(generate_series(1, greatest(len(string_split(p_name,' ')), len(string_split(p_type,' '))))) AS ord, unnest(string_split(p_name,' ')) AS a, unnest(string_split(p_type,' ')) AS b FROM part",
    "validate_length": "SELECT p_partkey FROM part WHERE NOT (length(p_name)>=5 AND length(p_name)<=10)",
    "validate_not_empty": "SELECT p_partkey FROM part WHERE NOT (length(trim(CASE WHEN p_size<5 THEN '  ' ELSE p_name END))>0)",
    "validate_pattern": "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_brand,'^Brand#[1-3][0-9]?$')",
    "validate_range": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity>=1 AND l_quantity<=40)",
    "validate_report": "SELECT 'l_quantity_range' AS rule, count(*) AS violations FROM lineitem WHERE NOT (l_quantity>=1 AND l_quantity<=40) UNION ALL SELECT 'l_returnflag_not_empty' AS rule, count(*) AS violations FROM lineitem WHERE NOT (length(trim(l_returnflag))>0) UNION ALL SELECT 'l_discount_length' AS rule, count(*) AS violations FROM lineitem WHERE NOT (length(l_linestatus)>=2)",
    "values_srf": "SELECT x FROM (VALUES (1),(2),(3),(4)) v(x)",
}
