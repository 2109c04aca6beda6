"""Descriptions in the header zone of files: splicing with a licence veto, drafts located in a zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.replies import description_body, wrapped
from marlstone.functions.text import classified_range, looks_legal


def _collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"-\s+", "-"), r"\s+", " "))


def located_drafts(entries: DataFrame, drafts: DataFrame) -> DataFrame:
    """(file, first, last): the earliest run of a file's header entries whose text is its draft, white space aside.

    entries: (file, entry_no, text) with numbers from 1; drafts: (file, draft). Files without such a run are left out,
    also those with a blank draft. Runs are tried within the row of a file.
    """
    e = entries.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry_no", "text"))), lambda x: x["text"]).alias("t"))
    j = e.join(drafts.filter(_collapsed(F.col("draft")) != ""), "file")
    numbers = F.sequence(F.lit(1), F.size("t"))
    runs = F.flatten(F.transform(numbers, lambda i: F.transform(F.sequence(i, F.size("t")), lambda k: F.struct(i.alias("first"), k.alias("last")))))
    fits = F.filter(runs, lambda r: _collapsed(F.array_join(F.slice("t", r["first"], r["last"] - r["first"] + 1), " ")) == _collapsed(F.col("draft")))
    return j.select("file", F.array_min(fits).alias("r")).filter("r is not null").select("file", "r.first", "r.last")


_ZONE = "struct<entries:array<struct<line_no:int,prefix:string,inner:string>>,insert_at:int,prefix:string,fresh:boolean,stop:int>"


def header_zone(lines: Column, language: Column) -> Column:
    """Where a file's description stands or can stand: struct(entries, insert_at, prefix, fresh, stop); null for a blank file.

    Entries are the lines of leading comments (in Python of the module's docstring) that hold text, with what stands
    before it; a block comment of one line, and lines with delimiters, are none. New text goes before line insert_at + 1:
    with the prefix after the last entry's comment, or as a comment of its own (fresh) where there is none. A `#!` line
    is passed over; the first line of code ends the zone, which has `stop` lines.
    """
    python = language == "python"
    entry = F.array().cast("array<struct<line_no:int,prefix:string,inner:string>>")
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("closer"), F.lit(True).alias("zone"), entry.alias("entries"), F.lit(-1).alias("at"), F.lit("").alias("prefix"), F.lit(False).alias("found"), F.lit(-1).alias("stop"))

    def step(s: Column, x: Column) -> Column:
        t, lead, k = F.btrim(x, F.lit(" \t\f\r")), F.regexp_extract(x, r"^([ \t]*)", 1), s["k"] + 1
        quote = F.substring(t, 1, 3)
        rest = F.substring(t, F.lit(3), F.length(t))
        opens_c = ~python & t.startswith("/*")
        opens_py = python & quote.isin('"""', "'''") & ~s["found"]
        closed = F.when(python, F.instr(F.substring(t, F.lit(4), F.length(t)), '"""') + F.instr(F.substring(t, F.lit(4), F.length(t)), "'''") > 0).otherwise(F.instr(rest, "*/") > 0)
        line = ~python & t.startswith("//")
        inside = s["closer"] != ""
        ends = inside & F.contains(t, s["closer"])
        star = ~python & t.startswith("*")
        inner = F.when(star, F.btrim(F.regexp_replace(t, r"^\*+", ""), F.lit(" \t"))).otherwise(t)
        in_line = F.btrim(F.regexp_replace(t, r"^/+", ""), F.lit(" \t"))
        code = ~inside & (t != "") & ~(opens_c | opens_py | line) & ~(python & t.startswith("#")) & ~((k == 1) & t.startswith("#!"))
        live = s["zone"] & ~code
        add = lambda p, y: F.array_append(s["entries"], F.struct(k.cast("int").alias("line_no"), p.alias("prefix"), y.alias("inner")))
        entries = F.when(live & inside & ~ends & (inner != ""), add(F.when(star, F.concat(lead, F.lit("* "))).otherwise(lead), inner)).when(live & ~inside & line & (in_line != ""), add(F.concat(lead, F.lit("// ")), in_line)).otherwise(s["entries"])
        opened = ~inside & (opens_c | opens_py)
        closer = F.when(live & opened & ~closed, F.when(python, quote).otherwise("*/")).when(live & ends, "").otherwise(s["closer"])
        at = F.when(live & ends, k - 1).when(live & opened & closed & ~python, k).when(live & opened & closed, k - 1).when(live & ~inside & line, k).otherwise(s["at"])
        own = F.when(python, F.when(F.size(entries) > 0, F.element_at(entries, -1)["prefix"]).otherwise(lead)).otherwise(F.concat(lead, F.lit("* ")))
        prefix = F.when(live & ends, own).when(live & opened & closed & ~python, "// ").when(live & ~inside & line, F.concat(lead, F.lit("// "))).otherwise(s["prefix"])
        done = python & s["found"] & ~inside
        return F.when(done, F.struct(k.alias("k"), s["closer"].alias("closer"), F.lit(False).alias("zone"), s["entries"].alias("entries"), s["at"].alias("at"), s["prefix"].alias("prefix"), s["found"].alias("found"), F.when(s["stop"] < 0, k - 1).otherwise(s["stop"]).cast("int").alias("stop"))).otherwise(
            F.struct(k.alias("k"), closer.alias("closer"), live.alias("zone"), entries.alias("entries"), at.cast("int").alias("at"), prefix.alias("prefix"), (s["found"] | (live & (opened | (~inside & line)))).alias("found"), F.when(s["zone"] & ~live, k - 1).otherwise(s["stop"]).cast("int").alias("stop"))
        )

    blank = ~F.exists(lines, lambda x: F.btrim(x, F.lit(" \t\f\r")) != "")
    code_at = F.array_position(F.transform(lines, lambda x: (F.btrim(x, F.lit(" \t\f\r")) != "") & ~x.startswith("#")), True)
    top = F.when(python, F.when(code_at > 0, code_at - 1).otherwise(F.size(lines))).otherwise(F.when(F.element_at(lines, 1).startswith("#!"), 1).otherwise(0)).cast("int")
    stopped = lambda s: F.when(s["stop"] >= 0, s["stop"]).otherwise(F.size(lines)).cast("int")
    end = lambda s: F.when(s["found"], F.struct(s["entries"].alias("entries"), F.when(s["at"] >= 0, s["at"]).otherwise(F.size(lines)).alias("insert_at"), s["prefix"].alias("prefix"), F.lit(False).alias("fresh"), stopped(s).alias("stop"))).otherwise(F.struct(entry.alias("entries"), top.alias("insert_at"), F.lit("").alias("prefix"), F.lit(True).alias("fresh"), stopped(s).alias("stop")))
    return F.when(blank | F.size(lines).isNull() | (F.size(lines) <= 0), F.lit(None).cast(_ZONE)).otherwise(F.aggregate(lines, start, step, end).cast(_ZONE))


def _carried(c: Column) -> Column:
    """A text's UTF-8 bytes as characters of one byte each, as lines are carried."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def skeletons(heads: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, skeleton, n_symbols) of files with symbols: the header zone, C's macros by their first lines, and each symbol's
    documentation and signature by line, indented by its depth; texts as characters of one byte each.

    heads: (file, language, lines array<string>, zone by `header_zone`), a file without one has no zone; symbols: each
    (file, qualname) once. A prototype is hidden where its own file defines the routine. Documentation stands above a
    signature, in Python below it.
    """
    s = symbols.select("file", "qualname", "kind", "signature", "start_line", F.coalesce("depth", F.lit(0)).alias("depth"), "existing_doc")
    defined = s.filter("kind = 'function'").select("file", "qualname", F.lit("declaration").alias("kind"))
    s = s.join(defined, ["file", "qualname", "kind"], "left_anti")
    indent = F.repeat(F.lit("    "), F.greatest(F.col("depth"), F.lit(0)))
    strip = lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")
    doc = F.transform(F.split("existing_doc", "\n"), lambda x: F.rtrim(F.concat(indent, F.when(F.col("file").endswith(".py"), "    ").otherwise(""), strip(x))))
    docs = F.when(F.coalesce(F.trim("existing_doc"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(doc)
    head = F.array(F.concat(indent, F.coalesce("signature", F.concat("kind", F.lit(" "), "qualname"))))
    block = F.array_join(F.when(F.col("file").endswith(".py"), F.concat(head, docs)).otherwise(F.concat(docs, head)), "\n")
    rows = F.array_sort(F.collect_list(F.struct("start_line", "qualname", _carried(block).alias("block"))))
    body = s.groupBy("file").agg(F.array_join(rows["block"], "\n\n").alias("body"), F.count("*").alias("n_symbols"))
    zone = F.regexp_replace(F.array_join(F.slice("lines", 1, F.greatest(F.coalesce(F.col("zone.stop"), F.lit(0)), F.lit(0))), "\n"), r"\s+\z", "")
    cut = lambda x: F.when(F.rtrim(x).endswith("\\"), F.concat(F.regexp_replace(x, r"[ \t]*\\+[ \t]*$", ""), F.lit(" ..."))).otherwise(F.regexp_replace(x, r"[ \t]+$", ""))
    macros = F.when(F.col("language") == "c", F.array_join(F.transform(F.filter("lines", lambda x: x.rlike(r"^[ \t]*#[ \t]*define\b")), cut), "\n"))
    h = heads.select("file", zone.alias("head"), macros.alias("macros"))
    parts = F.filter(F.array("head", "macros", "body"), lambda x: F.coalesce(x, F.lit("")) != "")
    return body.join(h, "file", "left").select("file", F.array_join(parts, "\n\n").alias("skeleton"), "n_symbols")


def _within(old: Column, new: Column, start: Column, removed: Column, added: Column, language: Column) -> Column:
    """Whether lines are alike outside a window, and within it nothing but comments and blank lines."""
    plain = lambda x: (F.btrim(x, F.lit(" \t\f\r")) == "") | F.when(language == "python", F.lit(True)).otherwise(F.regexp_like(x, F.lit(r"^[ \t]*(//|/\*|\*)")))
    tail = lambda x, k: F.slice(x, F.greatest(k + 1, F.lit(1)), F.greatest(F.size(x) - k, F.lit(0)))
    same = (F.slice(old, 1, F.greatest(start, F.lit(0))) == F.slice(new, 1, F.greatest(start, F.lit(0)))) & (tail(old, start + removed) == tail(new, start + added))
    return same & F.forall(F.slice(old, F.greatest(start + 1, F.lit(1)), F.greatest(removed, F.lit(0))), plain) & F.forall(F.slice(new, F.greatest(start + 1, F.lit(1)), F.greatest(added, F.lit(0))), plain)


def described(zones: DataFrame, width: int = 118) -> DataFrame:
    """Files with a description put into their header: (file, lines, placed), placed as `replaced`, `fresh`, `appended` or null.

    zones: (file, language, lines array<string>, zone by `header_zone`, first, last, description): the range of entries
    (from 1) that the description replaces; null adds it. A range with a legal line is left alone, as is a file without a
    zone or with a blank description, and one where the guard finds anything but comments in the window. Words are
    wrapped to the width, at forty columns at least.
    """
    z = F.col("zone")
    python = F.col("language") == "python"
    inside = F.slice(z["entries"], F.greatest(F.col("first"), F.lit(1)), F.greatest(F.col("last") - F.col("first") + 1, F.lit(0)))
    valid = (F.col("first") >= 1) & (F.col("last") >= F.col("first")) & (F.col("last") <= F.size(z["entries"]))
    ranged = F.col("first").isNotNull()
    veto = ranged & F.exists(inside, lambda e: looks_legal(e["inner"]))
    head, tail = F.try_element_at(z["entries"], F.greatest(F.col("first"), F.lit(1)))["line_no"], F.try_element_at(z["entries"], F.greatest(F.col("last"), F.lit(1)))["line_no"]
    prefix = F.when(ranged, F.try_element_at(z["entries"], F.greatest(F.col("first"), F.lit(1)))["prefix"]).when(z["fresh"], F.when(python, "").otherwise(" * ")).otherwise(z["prefix"])
    text = description_body(F.col("description"))
    body = F.transform(wrapped(text, F.greatest(F.lit(40), F.lit(width) - F.length(prefix))), lambda x: F.rtrim(F.concat(prefix, x)))
    fresh = F.when(python, F.concat(F.array(F.lit('"""')), body, F.array(F.lit('"""'), F.lit("")))).otherwise(F.concat(F.array(F.lit("/*")), body, F.array(F.lit(" */"), F.lit(""))))
    new = F.when(ranged, body).when(z["fresh"], fresh).otherwise(F.concat(F.array(F.rtrim(prefix)), body))
    rows = zones.withColumn("new", new).withColumn("start", F.when(ranged, head - 1).otherwise(z["insert_at"])).withColumn("removed", F.when(ranged, tail - head + 1).otherwise(0))
    rest = F.slice("lines", F.greatest(F.col("start") + F.col("removed") + 1, F.lit(1)), F.greatest(F.size("lines") - F.col("start") - F.col("removed"), F.lit(0)))
    rows = rows.withColumn("out", F.concat(F.slice("lines", 1, F.greatest(F.col("start"), F.lit(0))), "new", rest))
    guard = _within(F.col("lines"), F.col("out"), F.col("start"), F.col("removed"), F.size("new"), F.col("language"))
    ok = F.coalesce(z.isNotNull() & (text != "") & (~ranged | valid) & ~veto & guard, F.lit(False))
    placed = F.when(ok, F.when(ranged, "replaced").when(z["fresh"], "fresh").otherwise("appended"))
    return rows.select("file", F.when(ok, F.col("out")).otherwise(F.col("lines")).alias("lines"), placed.alias("placed"))


def recorded_ranges(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """Recorded answers bound to live headers: (file, first, last, description, bound).

    recorded: (file, entries array<string>, range, description); live: (file, zone). Only where the live entries' texts
    are the recorded ones does an answer bind; the range is read as `classified_range` does, null where it names none.
    """
    j = recorded.join(live.select("file", "zone"), "file")
    now = F.transform("zone.entries", lambda e: e["inner"])
    r = classified_range(F.col("range"), F.size("entries"))
    return j.select("file", r["first"].alias("first"), r["last"].alias("last"), "description", F.coalesce(F.col("entries") == now, F.lit(False)).alias("bound"))


def spliced_descriptions(zones: DataFrame, width: int = 118) -> DataFrame:
    """Lines with a description put in place of a range of the header zone: (file, lines, replaced).

    zones: (file, lines array<string>, first, last, description, prefix). A range with a legal line is never touched:
    the file comes out unchanged and replaced is false; so it does for a null range or a blank description. Words are
    wrapped to the width, at forty columns at least.
    """
    inside = F.slice("lines", F.col("first"), F.col("last") - F.col("first") + 1)
    veto = F.exists(inside, looks_legal)
    room = F.greatest(F.lit(40), F.lit(width) - F.length("prefix"))
    new = F.transform(wrapped(F.col("description"), room), lambda x: F.rtrim(F.concat("prefix", x)))
    ok = F.col("first").isNotNull() & (F.col("first") >= 1) & (F.col("last") >= F.col("first")) & (F.col("last") <= F.size("lines")) & (F.size(new) > 0) & ~veto
    ok = F.coalesce(ok, F.lit(False))
    out = F.concat(F.slice("lines", 1, F.col("first") - 1), new, F.slice("lines", F.col("last") + 1, F.size("lines")))
    return zones.select("file", F.when(ok, out).otherwise(F.col("lines")).alias("lines"), ok.alias("replaced"))
