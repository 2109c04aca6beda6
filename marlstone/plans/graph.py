"""Queries over symbols: calls, contracts, sites and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import first_line
from marlstone.operators import graph, order, queue
from marlstone.plans.catalog import query
from marlstone.tables import table, written

#: The last definition of each (file, qualname), as the operators see it.
UNIQUE = """u AS (
  SELECT file, qualname, arg_max(kind, (start_line, loaded_at)) AS kind, max(start_line) AS start_line,
    arg_max(end_line, (start_line, loaded_at)) AS end_line, arg_max(depth, (start_line, loaded_at)) AS depth,
    arg_max({'v': parent_qualname}, (start_line, loaded_at)).v AS parent_qualname,
    arg_max({'v': existing_doc}, (start_line, loaded_at)).v AS existing_doc, arg_max({'v': calls}, (start_line, loaded_at)).v AS calls
  FROM symbols GROUP BY file, qualname)"""

RESOLVED = f"""WITH {UNIQUE}, c AS (
  SELECT file, qualname AS caller, parent_qualname AS parent, generate_subscripts(calls, 1) - 1 AS pos, unnest(calls) AS c FROM u
), calls AS (SELECT file, caller, parent, CAST(pos AS INTEGER) AS pos, c.name AS name, c.kind AS kind, c.line AS line FROM c
), defs AS (SELECT file, qualname, kind, parent_qualname AS parent FROM u WHERE kind <> 'declaration'
), free AS (SELECT file, qualname AS name FROM defs WHERE parent IS NULL
), loc AS (SELECT file, name, count(*) AS n FROM free GROUP BY ALL
), wide AS (SELECT name, count(*) AS n, min(file) AS file FROM free GROUP BY name
), methods AS (
  SELECT split_part(m.qualname, '.', -1) AS name, m.file, m.qualname FROM defs m
  WHERE EXISTS (SELECT 1 FROM defs k WHERE k.kind = 'class' AND k.file = m.file AND k.qualname = m.parent)
), one AS (SELECT name, min(file) AS file, min(qualname) AS qualname FROM methods GROUP BY name HAVING count(*) = 1
), r AS (
  SELECT a.file, a.caller, a.pos, a.name, a.kind, a.line, CASE WHEN l.n = 1 THEN a.file WHEN l.n IS NULL AND w.n = 1 THEN w.file END AS callee_file, a.name AS callee
  FROM calls a LEFT JOIN loc l ON l.file = a.file AND l.name = a.name LEFT JOIN wide w ON w.name = a.name WHERE a.kind = 'free'
  UNION ALL
  SELECT a.file, a.caller, a.pos, a.name, a.kind, a.line, a.file, a.parent || '.' || a.name FROM calls a
  WHERE a.kind = 'self' AND EXISTS (SELECT 1 FROM defs d WHERE d.file = a.file AND d.qualname = a.parent || '.' || a.name)
  UNION ALL
  SELECT a.file, a.caller, a.pos, a.name, a.kind, a.line, o.file, o.qualname FROM calls a JOIN one o ON o.name = a.name WHERE a.kind = 'method'
), resolved AS (SELECT * FROM r WHERE callee_file IS NOT NULL AND NOT (file = callee_file AND caller = callee)
), edges AS (SELECT file, caller, callee_file, callee, min(pos) AS first_pos FROM resolved GROUP BY ALL)
"""

CONTRACTS = """, contracts AS (
  SELECT file, qualname, coalesce(list_filter(list_transform(regexp_split_to_array(coalesce(existing_doc, ''), '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1], '') AS contract FROM u)
"""


#: What call resolution reads.
CALLS = ("kind", "parent_qualname", "calls")


def _symbols(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    return graph.unique_symbols(table(spark, sf_dir, "symbols"), *columns)


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols for call resolution, with their contracts: a table, as several branches of a plan read it."""
    return written(_symbols(spark, sf_dir, *CALLS, first_line(F.col("existing_doc")).alias("contract")), "symbols")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.call_edges(written(_symbols(spark, sf_dir, *CALLS), "symbols"))


def _contracts(symbols: DataFrame) -> DataFrame:
    return symbols.select("file", "qualname", "contract")


@query(RESOLVED + "SELECT file, caller, callee_file, callee, first_pos FROM edges")
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(RESOLVED + "SELECT DISTINCT file, caller, name, kind, callee_file, callee FROM resolved")
def call_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolved_calls(written(_symbols(spark, sf_dir, *CALLS), "symbols")).select("file", "caller", "name", "kind", "callee_file", "callee").distinct()


@query(RESOLVED + "SELECT DISTINCT file AS src, callee_file AS dst FROM edges WHERE file <> callee_file")
def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.file_edges(_edges(spark, sf_dir))


@query(
    RESOLVED
    + """SELECT DISTINCT a.file AS first_file, a.qualname AS first, a.file AS then_file, a.parent_qualname AS then
FROM u a WHERE EXISTS (SELECT 1 FROM u p WHERE p.file = a.file AND p.qualname = a.parent_qualname)
UNION SELECT callee_file, callee, file, caller FROM edges"""
)
def precedence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = written(_symbols(spark, sf_dir, *CALLS), "symbols")
    return graph.precedence(s, graph.call_edges(s))


@query(f"WITH {UNIQUE}{CONTRACTS} SELECT file, qualname, contract FROM contracts")
def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir, first_line(F.col("existing_doc")).alias("contract"))


@query(
    RESOLVED
    + CONTRACTS
    + """SELECT DISTINCT callee_file, callee FROM edges e
WHERE NOT EXISTS (SELECT 1 FROM contracts c WHERE c.file = e.callee_file AND c.qualname = e.callee AND c.contract <> '')"""
)
def missing_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _called(spark, sf_dir)
    return graph.missing_contracts(graph.call_edges(s), _contracts(s))


@query(
    RESOLVED
    + CONTRACTS
    + """, n AS (
  SELECT e.file, e.caller, e.callee || ': ' || c.contract AS note, row_number() OVER (PARTITION BY e.file, e.caller ORDER BY first_pos, callee_file, e.callee || ': ' || c.contract) AS k
  FROM edges e JOIN contracts c ON c.file = e.callee_file AND c.qualname = e.callee AND c.contract <> ''
) SELECT file, caller, CAST(count(*) AS INTEGER) AS n_notes, string_agg(note, chr(10) ORDER BY k) AS notes FROM n WHERE k <= 6 GROUP BY file, caller"""
)
def callee_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _called(spark, sf_dir)
    return graph.callee_notes(graph.call_edges(s), _contracts(s))


@query(
    RESOLVED
    + CONTRACTS
    + """, a AS (
  SELECT DISTINCT r.file, r.caller, r.line, r.callee || ': ' || c.contract AS note FROM resolved r
  JOIN contracts c ON c.file = r.callee_file AND c.qualname = r.callee AND c.contract <> '' WHERE r.line IS NOT NULL
) SELECT file, caller, line, string_agg(note, '; ' ORDER BY note) AS notes FROM a GROUP BY ALL"""
)
def call_line_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _called(spark, sf_dir)
    c = _contracts(s).filter("contract <> ''").select(F.col("file").alias("callee_file"), F.col("qualname").alias("callee"), "contract")
    r = graph.resolved_calls(s).filter("line is not null").join(c, ["callee_file", "callee"])
    note = F.concat("callee", F.lit(": "), "contract")
    return r.groupBy("file", "caller", "line").agg(F.array_join(F.array_sort(F.collect_set(note)), "; ").alias("notes"))


@query(
    f"""WITH {UNIQUE}, c AS (SELECT file, qualname, kind FROM u WHERE kind IN ('declaration', 'function') AND regexp_matches(file, '\\.[ch]$')
), decls AS (SELECT DISTINCT qualname AS name, file AS decl_file FROM c WHERE kind = 'declaration'
), defs AS (SELECT qualname AS name, count(*) AS n, min(file) AS def_file FROM c WHERE kind = 'function' GROUP BY 1)
SELECT d.name, d.decl_file, CASE WHEN f.n = 1 THEN f.def_file END AS def_file, coalesce(f.n = 1, false) AS redirected FROM decls d LEFT JOIN defs f ON f.name = d.name"""
)
def documentation_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.documentation_sites(written(_symbols(spark, sf_dir, "kind"), "symbols"))


@query(
    f"""WITH {UNIQUE} SELECT file, qualname, CAST(row_number() OVER (PARTITION BY file ORDER BY depth DESC, start_line DESC, end_line, qualname) AS INTEGER) AS position FROM u"""
)
def deepest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.deepest_first(_symbols(spark, sf_dir, "depth", "start_line", "end_line"))


#: Components by reach in both directions, levels by paths over components; e (src, dst) are the edges.
ORDERED = """, reach AS (SELECT DISTINCT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst
), node AS (SELECT src AS node FROM e UNION SELECT dst FROM e
), comp AS (SELECT node, least(node, coalesce((SELECT min(a.dst) FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src WHERE a.src = node), node)) AS component FROM node
), ce AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM e JOIN comp a ON a.node = e.src JOIN comp b ON b.node = e.dst WHERE a.component <> b.component
), up AS (SELECT DISTINCT component AS node, 0 AS level FROM comp UNION SELECT ce.src, level + 1 FROM up JOIN ce ON ce.dst = up.node
), lev AS (SELECT node AS component, max(level) AS level FROM up GROUP BY 1)
"""


@query(
    RESOLVED.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", e AS (SELECT DISTINCT file AS src, callee_file AS dst FROM edges WHERE file <> callee_file)"
    + ORDERED
    + "SELECT node AS file, component, CAST(level AS INTEGER) AS level, row_number() OVER (ORDER BY level, component, node) AS pos FROM comp JOIN lev USING (component)"
)
def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = order.dependency_order(graph.file_edges(_edges(spark, sf_dir)))
    ranked = queue.global_rank(o, "level", "component", "node")
    return ranked.select(F.col("node").alias("file"), "component", "level", F.col("rank").alias("pos"))


def _precedence_nodes(s: DataFrame) -> DataFrame:
    node = lambda f, q: F.concat(F.col(f), F.lit("\n"), F.col(q))
    return graph.precedence(s, graph.call_edges(s)).select(node("then_file", "then").alias("src"), node("first_file", "first").alias("dst"))


_PRECEDENCE = """, e AS (SELECT DISTINCT a.file || chr(10) || a.parent_qualname AS src, a.file || chr(10) || a.qualname AS dst FROM u a WHERE EXISTS (SELECT 1 FROM u p WHERE p.file = a.file AND p.qualname = a.parent_qualname) AND a.parent_qualname <> a.qualname
  UNION SELECT file || chr(10) || caller, callee_file || chr(10) || callee FROM edges)"""


@query(RESOLVED.replace("WITH ", "WITH RECURSIVE ", 1) + _PRECEDENCE + ORDERED + "SELECT node, component FROM comp")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.components(_precedence_nodes(written(_symbols(spark, sf_dir, *CALLS), "symbols")))


@query(
    RESOLVED.replace("WITH ", "WITH RECURSIVE ", 1)
    + _PRECEDENCE
    + ORDERED
    + """, n AS (SELECT split_part(node, chr(10), 1) AS file, split_part(node, chr(10), 2) AS qualname, component, level, u.start_line FROM comp JOIN lev USING (component)
  JOIN u ON u.file = split_part(node, chr(10), 1) AND u.qualname = split_part(node, chr(10), 2)
), k AS (SELECT component, min((start_line, qualname, file)) AS first FROM n GROUP BY 1)
SELECT file, qualname, CAST(level AS INTEGER) AS level, row_number() OVER (ORDER BY level, k.first, start_line, qualname, file) AS pos FROM n JOIN k USING (component)"""
)
def documentation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf first: by level, then by the first member of the component, members of a cycle together; ties by start, name
    and file, so that equal starts in two files have one order."""
    s = written(_symbols(spark, sf_dir, *CALLS, "start_line"), "symbols")
    o = order.dependency_order(_precedence_nodes(s)).select(F.split("node", "\n")[0].alias("file"), F.split("node", "\n")[1].alias("qualname"), "component", "level")
    n = written(o.join(s.select("file", "qualname", "start_line"), ["file", "qualname"]), "order")
    first = n.groupBy("component").agg(F.min(F.struct("start_line", "qualname", "file")).alias("first"))
    flat = n.join(first, "component").select("*", F.col("first.start_line").alias("k1"), F.col("first.qualname").alias("k2"), F.col("first.file").alias("k3"))
    return queue.global_rank(flat, "level", "k1", "k2", "k3", "start_line", "qualname", "file").select("file", "qualname", "level", F.col("rank").alias("pos"))


@query(
    RESOLVED.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, hc AS (SELECT file, qualname, kind FROM u WHERE kind IN ('declaration', 'function') AND regexp_matches(file, '\\.[ch]$')
), d AS (SELECT qualname AS name, count(*) AS n, min(file) AS def_file FROM hc WHERE kind = 'function' GROUP BY 1
), e AS (SELECT DISTINCT d.def_file AS src, c.file AS dst FROM hc c JOIN d ON d.name = c.qualname WHERE c.kind = 'declaration' AND d.n = 1 AND c.file <> d.def_file AND regexp_matches(c.file, '\\.h$'))"""
    + ORDERED
    + "SELECT node AS file, CAST(level AS INTEGER) AS level, row_number() OVER (ORDER BY level, component, node) AS pos FROM comp JOIN lev USING (component)"
)
def headers_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C files so that a header comes before the file that implements what it declares."""
    sites = graph.documentation_sites(written(_symbols(spark, sf_dir, "kind"), "symbols")).filter("redirected and decl_file <> def_file").filter(F.col("decl_file").endswith(".h"))
    o = order.dependency_order(sites.select(F.col("def_file").alias("src"), F.col("decl_file").alias("dst")))
    return queue.global_rank(o, "level", "component", "node").select(F.col("node").alias("file"), "level", F.col("rank").alias("pos"))


@query("SELECT kind, count(DISTINCT (file, qualname, start_line)) AS n_symbols, count(DISTINCT file) AS n_files FROM symbols GROUP BY kind")
def symbol_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "symbols")
    one = s.groupBy("kind", "file", "qualname", "start_line").agg(F.lit(1).alias("one"))
    files = one.groupBy("kind", "file").agg(F.count("*").alias("n"))
    return files.groupBy("kind").agg(F.sum("n").alias("n_symbols"), F.count("*").alias("n_files"))


@query(
    f"""WITH {UNIQUE} SELECT file, string_agg(repeat('    ', depth) || kind || ' ' || qualname, chr(10) ORDER BY start_line, qualname) AS skeleton, count(*) AS n_symbols
FROM u d WHERE NOT (kind = 'declaration' AND EXISTS (SELECT 1 FROM u f WHERE f.kind = 'function' AND f.file = d.file AND f.qualname = d.qualname)) GROUP BY file"""
)
def skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir)
    line = F.concat(F.repeat(F.lit("    "), F.col("depth")), "kind", F.lit(" "), "qualname")
    rows = F.array_sort(F.collect_list(F.struct("start_line", "qualname", line.alias("line"))))
    return s.groupBy("file").agg(F.array_join(rows["line"], "\n").alias("skeleton"), F.count("*").alias("n_symbols"))
