"""Call resolution, contracts and dependency order over symbol tables (file, qualname, kind, start_line, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Callee notes that a caller gets at most, in call order.
NOTES = 6
#: Parts of the calls of one name.
SALTS = 8


def unique_symbols(symbols: DataFrame, *columns: str) -> DataFrame:
    """(file, qualname, columns): one row for each (file, qualname), the last definition, of rows delivered twice the
    last delivery; without columns, all of them. Columns that are not named are neither read nor shuffled."""
    rows = symbols.select("file", "qualname", F.struct("start_line", "loaded_at").alias("order"), F.struct(*(columns or [c for c in symbols.columns if c not in ("file", "qualname")])).alias("r"))
    return rows.groupBy("file", "qualname").agg(F.max_by("r", "order").alias("r")).select("file", "qualname", "r.*")


def call_sites(symbols: DataFrame) -> DataFrame:
    """(file, caller, parent, pos, name, kind, line) of each call, in call order."""
    s = symbols.select("file", F.col("qualname").alias("caller"), F.col("parent_qualname").alias("parent"), F.posexplode("calls").alias("pos", "c"))
    return s.select("file", "caller", "parent", "pos", "c.name", "c.kind", "c.line")


def resolved_calls(symbols: DataFrame) -> DataFrame:
    """Calls with the one callee they can only mean: (file, caller, pos, name, kind, line, callee_file, callee).

    A free call means the only such routine of its own file; one that the file has twice means nothing; otherwise the
    only one of the run. A call on self means the parent's method. Any other method call means the only class's method
    of that name in the run. Declarations are never meant, and a routine's call of itself is left out.
    """
    calls = call_sites(symbols)
    defs = symbols.filter(F.col("kind") != "declaration").select("file", "qualname", "kind", F.col("parent_qualname").alias("parent"))
    free = defs.filter("parent is null").withColumn("name", F.col("qualname"))
    local = free.groupBy("file", "name").agg(F.count("*").alias("n_local"))
    wide = free.groupBy("name").agg(F.count("*").alias("n_wide"), F.min("file").alias("wide_file"))
    classes = defs.filter("kind = 'class'").select("file", F.col("qualname").alias("parent"))
    methods = defs.join(classes, ["file", "parent"], "left_semi").withColumn("name", F.substring_index("qualname", ".", -1))
    method = methods.groupBy("name").agg(F.count("*").alias("n_method"), F.min(F.struct("file", "qualname")).alias("m"))

    # one name may make a third of all calls, so what is known of a name comes once for each salt
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = F.pmod(F.xxhash64("file", "caller", "pos"), F.lit(SALTS)).cast("int")
    columns = ["file", "caller", "pos", "name", "kind", "line"]
    f = calls.filter("kind = 'free'").join(local, ["file", "name"], "left").withColumn("salt", salt)
    near = f.filter("n_local = 1").select(*columns, F.col("file").alias("callee_file"), F.col("name").alias("callee"))
    once = wide.filter("n_wide = 1").select("name", "wide_file", salts.alias("salt"))
    far = f.filter("n_local is null").join(once, ["name", "salt"]).select(*columns, F.col("wide_file").alias("callee_file"), F.col("name").alias("callee"))
    f = near.unionByName(far)
    own = calls.filter("kind = 'self' and parent is not null").withColumn("callee", F.concat("parent", F.lit("."), "name"))
    s = own.join(defs.select("file", F.col("qualname").alias("callee")), ["file", "callee"], "left_semi").select(*columns, F.col("file").alias("callee_file"), "callee")
    single = method.filter("n_method = 1").select("name", "m", salts.alias("salt"))
    m = calls.filter("kind = 'method'").withColumn("salt", salt).join(single, ["name", "salt"]).select(*columns, F.col("m.file").alias("callee_file"), F.col("m.qualname").alias("callee"))
    return f.unionByName(s).unionByName(m).filter("not (file = callee_file and caller = callee)")


def call_edges(symbols: DataFrame) -> DataFrame:
    """Distinct edges (file, caller, callee_file, callee, first_pos), ordered by the first call."""
    return resolved_calls(symbols).groupBy("file", "caller", "callee_file", "callee").agg(F.min("pos").alias("first_pos"))


def precedence(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """What has to be documented before what: children before parents, callees before callers."""
    s = symbols.select("file", "qualname", F.col("parent_qualname").alias("parent"))
    family = s.join(symbols.select("file", F.col("qualname").alias("parent")), ["file", "parent"], "left_semi")
    a = family.select(F.col("file").alias("first_file"), F.col("qualname").alias("first"), F.col("file").alias("then_file"), F.col("parent").alias("then"))
    b = edges.select(F.col("callee_file").alias("first_file"), F.col("callee").alias("first"), F.col("file").alias("then_file"), F.col("caller").alias("then"))
    return a.unionByName(b).distinct()


def missing_contracts(edges: DataFrame, contracts: DataFrame) -> DataFrame:
    """Callees that some caller needs a contract of and none is known: (callee_file, callee)."""
    known = contracts.filter("contract <> ''").select(F.col("file").alias("callee_file"), F.col("qualname").alias("callee"))
    return edges.select("callee_file", "callee").distinct().join(known, ["callee_file", "callee"], "left_anti")


def callee_notes(edges: DataFrame, contracts: DataFrame, most: int = NOTES) -> DataFrame:
    """(file, caller, n_notes, notes): contracts of a caller's callees in call order, at most so many, one a line."""
    c = contracts.filter("contract <> ''").select(F.col("file").alias("callee_file"), F.col("qualname").alias("callee"), "contract")
    note = F.struct("first_pos", "callee_file", F.concat("callee", F.lit(": "), "contract").alias("note"))
    g = edges.join(c, ["callee_file", "callee"]).groupBy("file", "caller").agg(F.slice(F.array_sort(F.collect_list(note)), 1, most).alias("notes"))
    return g.select("file", "caller", F.size("notes").alias("n_notes"), F.array_join("notes.note", "\n").alias("notes"))


def documentation_sites(symbols: DataFrame) -> DataFrame:
    """C routines and where their documentation goes: (name, decl_file, def_file, redirected).

    A declaration takes the documentation of the only definition of that name in the run; with several definitions, or
    none, it stands alone.
    """
    c = symbols.filter(F.col("kind").isin("declaration", "function") & F.col("file").rlike(r"\.[ch]$"))
    decls = c.filter("kind = 'declaration'").select(F.col("qualname").alias("name"), F.col("file").alias("decl_file")).distinct()
    defs = c.filter("kind = 'function'").groupBy(F.col("qualname").alias("name")).agg(F.count("*").alias("n"), F.min("file").alias("def_file"))
    j = decls.join(defs, "name", "left")
    once = F.coalesce(F.col("n") == 1, F.lit(False))
    return j.select("name", "decl_file", F.when(once, F.col("def_file")).alias("def_file"), once.alias("redirected"))


def file_edges(edges: DataFrame) -> DataFrame:
    """Distinct dependencies between files: (src, dst)."""
    return edges.filter("file <> callee_file").select(F.col("file").alias("src"), F.col("callee_file").alias("dst")).distinct()


def deepest_first(symbols: DataFrame) -> DataFrame:
    """(file, qualname, position): within a file by depth, then start, from the end; longer ones first."""
    w = Window.partitionBy("file").orderBy(F.desc("depth"), F.desc("start_line"), F.asc("end_line"), F.asc("qualname"))
    return symbols.select("file", "qualname", F.row_number().over(w).alias("position"))


def child_stubs(symbols: DataFrame) -> DataFrame:
    """(file, parent, n_children, stubs): of each symbol with others directly within it their signatures, one a line.

    A null signature is told by kind and name. Children whose parent is not among the symbols are left out.
    """
    parents = symbols.select("file", F.col("qualname").alias("parent_qualname"))
    stub = F.concat(F.coalesce("signature", F.concat("kind", F.lit(" "), "qualname")), F.lit(" ..."))
    k = symbols.join(parents, ["file", "parent_qualname"], "left_semi")
    rows = F.array_sort(F.collect_list(F.struct("start_line", "qualname", stub.alias("stub"))))
    return k.groupBy("file", F.col("parent_qualname").alias("parent")).agg(F.count("*").alias("n_children"), F.array_join(rows["stub"], "\n").alias("stubs"))


def top_of_each(rows: DataFrame, groups: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group in an order. Spark keeps the first of each partition before it shuffles."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col("place") <= most).drop("place")
