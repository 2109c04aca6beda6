"""Window-shaped operators over ordered lines: budgets, elision, packing, paragraphs.

A text's lines stay in one array, so the folds run within a row and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import estimated_tokens


def _prefix(costs: Column, budget: Column) -> Column:
    """How many leading costs fit a budget together."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(s: Column, c: Column) -> Column:
        fits = s["open"] & (s["used"] + c <= budget)
        return F.struct(F.when(fits, s["used"] + c).otherwise(s["used"]).alias("used"), (s["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

    return F.aggregate(costs, start, step, lambda s: s["n"])


def head_crop(lines: Column, budget: int, bytes_per_token: float = 2.0) -> Column:
    """The longest whole-line prefix whose joined text is within a budget of tokens; all lines if they fit."""
    joined_bytes = F.transform(lines, lambda x: (F.octet_length(x) + 1).cast("long"))
    n = _prefix(joined_bytes, F.floor(F.lit(budget * bytes_per_token)).cast("long") + 1)
    return F.slice(lines, 1, n)


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def elided(lines: Column, header: int, budget: int, marker: str = "... {n} lines omitted ...", ratio: float = 0.5) -> Column:
    """struct(n_head, n_tail, n_omitted): header lines are always kept, the body's middle is left out to fit a budget.

    n_omitted is 0 where all fits or nothing would be dropped. The header and the marker are charged first.
    """
    out = lambda a, b, c: F.struct(a.cast("int").alias("n_head"), b.cast("int").alias("n_tail"), c.cast("int").alias("n_omitted"))
    none = F.lit(0)

    def sized(s: Column) -> Column:
        head = F.when(s["n"] > 0, estimated_tokens(F.array_join(F.slice(lines, 1, header), "\n"))).otherwise(0)
        rest = F.lit(budget) - head - estimated_tokens(F.replace(F.lit(marker), F.lit("{n}"), s["n_body"].cast("string")))
        costs = F.transform(F.slice(lines, header + 1, s["n_body"]), lambda x: (estimated_tokens(x) + 1).cast("long"))
        return _let(F.struct(rest.alias("rest"), F.floor(rest * ratio).cast("long").alias("up"), costs.alias("costs"), s["n_body"].alias("n_body")), cut)

    def cut(s: Column) -> Column:
        head, tail = _prefix(s["costs"], s["up"]), _prefix(F.reverse(s["costs"]), s["rest"] - s["up"])
        return _let(F.struct(head.alias("head"), tail.alias("tail"), s["rest"].alias("rest"), s["n_body"].alias("n_body")), decided)

    def decided(s: Column) -> Column:
        tail = F.least(s["tail"], s["n_body"] - s["head"])
        dropped = s["n_body"] - s["head"] - tail
        return F.when(s["rest"] <= 0, out(none, none, s["n_body"])).when(dropped <= 0, out(s["n_body"], none, none)).otherwise(out(s["head"], tail, dropped))

    n_body = F.greatest(F.size(lines) - header, F.lit(0))
    fits = (estimated_tokens(F.array_join(lines, "\n")) <= budget) | (n_body == 0)
    return F.when(fits, out(n_body, none, none)).otherwise(_let(F.struct(F.size(lines).alias("n"), n_body.alias("n_body")), sized))


def chunks(lines: Column, budget: int, bytes_per_token: float = 2.0) -> Column:
    """Lines packed greedily into chunks of at most a budget of tokens; the chunks joined give the lines again.

    A line's cost is its tokens and one for the joining line end. A blank line closes a chunk three quarters full. A
    line beyond the budget is cut into pieces of nine tenths of it, which are chunks of their own.
    """
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("now"), F.lit(0).cast("long").alias("used"))
    flushed = lambda s: F.when(s["now"].isNotNull(), F.array_append(s["out"], s["now"])).otherwise(s["out"])

    def step(s: Column, line: Column) -> Column:
        tokens = estimated_tokens(line, bytes_per_token)
        cost = (tokens + 1).cast("long")
        per_token = F.greatest(F.lit(1), F.floor(F.length(line) / F.greatest(F.lit(1), tokens)).cast("int"))
        piece = F.greatest(F.lit(1), F.floor(F.lit(budget) * per_token * 0.9).cast("int"))
        starts = F.sequence(F.lit(0), F.greatest(F.length(line) - 1, F.lit(0)), piece)
        pieces = F.transform(starts, lambda k: F.substring(line, k + 1, piece))
        full = s["now"].isNotNull() & (s["used"] + cost > budget)
        out = F.when(full, flushed(s)).otherwise(s["out"])
        now = F.when(full | s["now"].isNull(), line).otherwise(F.concat(s["now"], F.lit("\n"), line))
        used = F.when(full, cost).otherwise(s["used"] + cost)
        closes = (F.trim(line) == "") & (used >= budget * 0.75)
        kept = F.struct(F.when(closes, F.array_append(out, now)).otherwise(out).alias("out"), F.when(~closes, now).alias("now"), F.when(closes, F.lit(0).cast("long")).otherwise(used).alias("used"))
        long = F.struct(F.concat(flushed(s), pieces).alias("out"), F.lit(None).cast("string").alias("now"), F.lit(0).cast("long").alias("used"))
        return F.when(cost > budget, long).otherwise(kept)

    return F.aggregate(lines, start, step, flushed)


def groups(costs: Column, budget: int, framing: int = 8) -> Column:
    """For each of the consecutive parts the number of its group (from 0): greedy, never fewer than two parts a group;
    a single group of several parts is cut in half, so that every round of merging shrinks the list."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("group"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"))

    def step(s: Column, c: Column) -> Column:
        cost = (c + framing).cast("long")
        full = (s["n"] >= 2) & (s["used"] + cost > budget)
        group = s["group"] + full.cast("int")
        return F.struct(F.array_append(s["out"], group).alias("out"), group.alias("group"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.when(full, cost).otherwise(s["used"] + cost).alias("used"))

    got = F.aggregate(costs, start, step, lambda s: s["out"])
    size = F.size(costs)
    halves = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: (i > F.floor(size / 2)).cast("int"))
    return F.when((size > 1) & (F.array_max(got) == 0), halves).otherwise(got)


def structural_breaks(stmts: DataFrame, routines: DataFrame, min_block_lines: int = 3) -> DataFrame:
    """Paragraph ranges (routine_id, first_line, last_line) of routine bodies.

    stmts: routine_id, start, depth, is_return, is_def, opens_block, first_in_scope, closed_block, merge_anchor,
    force_break. routines: routine_id, has_doc, boundary_lines, body_end. Only boundary lines start a paragraph, but a
    merge anchor is taken as it is. Statements that share a line come outermost first. Of the rules the first that matches a statement decides; a forced break adds to it.
    """
    w = Window.partitionBy("routine_id").orderBy("start", "depth")
    s = stmts.join(routines, "routine_id")
    s = s.withColumn("before", F.lag(F.struct("depth", "is_def")).over(w)).withColumn("number", F.row_number().over(w))
    legal = F.array_contains("boundary_lines", F.col("start"))
    rule = (
        F.when(F.col("first_in_scope"), F.when(F.col("has_doc"), F.col("start")))
        .when(F.col("before.is_def"), F.col("start"))
        .when(F.col("is_return") & F.col("merge_anchor").isNotNull(), F.col("merge_anchor"))
        .when(F.col("is_return") & (F.col("before.depth") == F.col("depth")), F.col("start"))
        .when(F.col("opens_block") >= min_block_lines, F.col("start"))
        .when((F.col("before.depth") > F.col("depth")) & ((F.col("closed_block") == 0) | (F.col("closed_block") >= min_block_lines)), F.col("start"))
    )
    starts = F.array_compact(F.array(rule, F.when(F.col("force_break") | (F.col("number") == 1), F.col("start"))))
    breaks = s.filter(legal).select("routine_id", "body_end", F.explode(starts).alias("first_line")).distinct()
    after = F.lead("first_line").over(Window.partitionBy("routine_id").orderBy("first_line"))
    return breaks.select("routine_id", "first_line", F.coalesce(after - 1, F.col("body_end")).alias("last_line"))


def best_probe(results: DataFrame, tolerance: float = 0.08) -> DataFrame:
    """Of each run's steps (run, step, n, metric, ok) the best n before the probe stops.

    It stops at the first step that failed or whose metric falls short of the best so far by the tolerance or more; of
    equal metrics the later wins.
    """
    so_far = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.when(F.col("ok"), F.col("metric"))).over(so_far)
    fails = ~F.col("ok") | ((best - F.col("metric")) / best >= tolerance)
    stopped = F.min(F.when(fails, F.col("step"))).over(Window.partitionBy("run"))
    kept = results.withColumn("stop", stopped).filter(F.col("ok") & (F.col("stop").isNull() | (F.col("step") <= F.col("stop"))))
    return kept.groupBy("run").agg(F.max_by("n", F.struct("metric", "step")).alias("best_n"), F.max("metric").alias("best_metric"))
