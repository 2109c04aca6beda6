"""What is asked of the model around a text, and how its answers are verified: priming, definition docs, notes, one-liners.

Every turn is one batch over all rows that still need it, and its result is a table, so a turn is never asked twice and
the gates before it are settled before it is asked. Verdicts fail open: only an explicit objection counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions.replies import summary_line, without_fence
from marlstone.operators.grounding import WORD
from marlstone.operators.model import Backend, generated, stub
from marlstone.tables import written

ACK = "Understood."
PLACEHOLDER = "(no documentation could be written)"
#: What is asked, by turn; {names} are filled in.
PROMPTS = {
    "doc": "Document this routine for its callers.\n\n{code}",
    "nudge": "Your reply could not be used. Document this routine for its callers.\n\n{code}",
    "gate": "These quoted names occur nowhere in the sources: {names}. Write the text again without them.\n\n{code}",
    "grounding": "Name a claim of this text that the code does not support, or reply NONE.\n\nText: {doc}\n\n{code}",
    "grounding_again": "A reader objected: {verdict}. Write the text again.\n\n{code}",
    "note": "Say in one line what this part of the routine is for, or reply NONE.\n\n{code}",
    "score": "How much does this line tell a reader, from 1 to 3?\n\nLine: {doc}\n\n{code}",
    "obvious": "Does this line add anything to the code? YES or NO.\n\nLine: {doc}\n\n{code}",
    "obvious_again": "The line only repeated the code. Say why the part is there, or reply NONE.\n\n{code}",
    "one_liner": "Say in one line what this routine does.\n\n{code}",
}


def _prompt(turn: str, **fields: Column) -> Column:
    return T.filled(F.lit(PROMPTS[turn]), **{k: F.coalesce(v, F.lit("")) for k, v in fields.items()})


def _asked(rows: DataFrame, turn: str, when: Column, reply: str, backend: Callable[[], Backend], **fields: Column) -> DataFrame:
    """Rows with the reply of one turn, asked only where the condition holds, null elsewhere; as a table."""
    ready = rows.withColumn("prompt", F.when(when, _prompt(turn, **fields)))
    return written(generated(ready, "prompt", reply, backend).drop("prompt"), f"turn-{turn}")


def ungrounded_names(text: Column, code: Column) -> Column:
    """The quoted words of a text that its own code holds nowhere, in order, joined by commas; empty where there are none."""
    spans = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("`([^`]*)`"), F.lit(1))
    words = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.regexp_extract_all(s, F.lit(f"({WORD})")))))
    return F.array_join(F.filter(words, lambda w: F.instr(F.coalesce(code, F.lit("")), w) == 0), ",")


def priming(rows: DataFrame, system: Column, summary: Column, task: Column, identity: Column, background: Column | None = None, guidelines: Column | None = None) -> DataFrame:
    """Rows with `messages`: the brief (and guidelines), then background, the file's identity, its overview and the task,
    each answered by a fixed acknowledgement. A null or blank background is passed over; other nulls are empty texts."""
    m = lambda role, c: F.struct(F.lit(role).alias("role"), F.coalesce(c, F.lit("")).alias("content"))
    turn = lambda c: F.array(m("user", c), m("assistant", F.lit(ACK)))
    brief = system if guidelines is None else F.concat_ws("\n\n", system, F.when(F.trim(guidelines) != "", guidelines))
    parts = [F.array(m("system", brief))]
    if background is not None:
        has = F.trim(F.coalesce(background, F.lit(""))) != ""
        parts.append(F.when(has, turn(F.concat(F.lit("Background on the project:\n\n"), background))).otherwise(F.array().cast("array<struct<role:string,content:string>>")))
    parts += [turn(identity), turn(F.concat(F.lit("An overview of what the program does:\n\n"), F.coalesce(summary, F.lit("")))), turn(task)]
    return rows.withColumn("messages", F.concat(*parts))


def definition_docs(rows: DataFrame, keys: list[str], code: str = "code", backend: Callable[[], Backend] = stub) -> DataFrame:
    """(keys, doc, status) of routines: a text, nudged once if unusable, checked by the gate and by a challenge.

    An unusable second reply gives the placeholder, status `failed`. Names that the code doesn't hold are named to the
    model once; an objection of the challenge likewise; a text that fails again is kept with status `unverified`, as a
    reader may still mend it; else `ok`. A null code has no text and status `failed`.
    """
    r = rows.select(*keys, F.col(code).alias("code"))
    r = _asked(r, "doc", F.col("code").isNotNull(), "doc", backend, code=F.col("code"))
    usable = lambda c: ~T.acknowledges(c) & (T.strip(F.coalesce(c, F.lit(""))) != "")
    r = _asked(r, "nudge", F.col("code").isNotNull() & ~usable(F.col("doc")), "again", backend, code=F.col("code"))
    r = r.withColumn("doc", without_fence(F.when(usable(F.col("doc")), F.col("doc")).when(usable(F.col("again")), F.col("again")))).drop("again")
    r = r.withColumn("names", F.when(F.col("doc").isNotNull(), ungrounded_names(F.col("doc"), F.col("code"))))
    r = _asked(r, "gate", F.col("names") != "", "again", backend, names=F.col("names"), code=F.col("code"))
    better = F.when((F.col("names") != "") & usable(F.col("again")), without_fence(F.col("again"))).otherwise(F.col("doc"))
    r = r.withColumn("doc", better).withColumn("names", ungrounded_names(F.col("doc"), F.col("code"))).drop("again")
    open_ = F.col("doc").isNotNull() & (F.col("names") == "")
    r = _asked(r, "grounding", open_, "verdict", backend, doc=F.col("doc"), code=F.col("code"))
    objects = lambda c: (T.strip(F.coalesce(c, F.lit(""))) != "") & T.verdict(c, "NONE").isNull()
    first = open_ & objects(F.col("verdict"))
    r = _asked(r.withColumn("objected", first), "grounding_again", F.col("objected"), "again", backend, verdict=F.col("verdict"), code=F.col("code"))
    r = r.withColumn("doc", F.when(F.col("objected") & usable(F.col("again")), without_fence(F.col("again"))).otherwise(F.col("doc"))).drop("again", "verdict")
    r = r.withColumn("names", ungrounded_names(F.col("doc"), F.col("code")))
    r = _asked(r, "grounding", F.col("objected") & (F.col("names") == ""), "verdict", backend, doc=F.col("doc"), code=F.col("code"))
    ok = (F.col("names") == "") & ~(F.col("objected") & objects(F.col("verdict")))
    status = F.when(F.col("doc").isNull(), "failed").when(ok, "ok").otherwise("unverified")
    return r.select(*keys, F.coalesce("doc", F.lit(PLACEHOLDER)).alias("doc"), status.alias("status"))


def block_notes(rows: DataFrame, keys: list[str], code: str = "code", threshold: int = 2, language: str = "python", backend: Callable[[], Backend] = stub) -> DataFrame:
    """(keys, note, status) of parts of routines: a line, gated, scored, and asked for again if it is obvious.

    status: `none` where the model declines or says nothing, `ungrounded` where it names what the code doesn't hold, `low`
    below the threshold (1 to 3; 4 leaves every part without a note), `obvious` where the second line is no better, else
    `note`; only then there is one.
    """
    r = rows.select(*keys, F.col(code).alias("code"))
    if threshold > 3:
        return r.select(*keys, F.lit(None).cast("string").alias("note"), F.lit("low").alias("status"))
    r = _asked(r, "note", F.col("code").isNotNull(), "reply", backend, code=F.col("code"))
    r = r.withColumn("note", F.when(~T.declines(F.col("reply")), summary_line(F.col("reply"), language))).withColumn("note", F.when(F.col("note") != "", F.col("note")))
    # the names are looked up in the reply as it came: cleaning may take a closing quote off
    grounded = F.col("note").isNotNull() & (ungrounded_names(T.first_line(without_fence(F.col("reply"))), F.col("code")) == "")
    r = _asked(r.withColumn("grounded", grounded).drop("reply"), "score", F.col("grounded"), "said", backend, doc=F.col("note"), code=F.col("code"))
    r = r.withColumn("high", F.col("grounded") & (T.score(F.col("said")) >= threshold)).drop("said")
    r = _asked(r, "obvious", F.col("high"), "said", backend, doc=F.col("note"), code=F.col("code"))
    no = lambda c: F.coalesce(T.verdict(c, "YES", "NO") == "NO", F.lit(False))
    r = r.withColumn("dull", F.col("high") & no(F.col("said"))).drop("said")
    r = _asked(r, "obvious_again", F.col("dull"), "again", backend, code=F.col("code"))
    second = F.when(~T.declines(F.col("again")), summary_line(F.col("again"), language))
    r = r.withColumn("second", F.when(F.col("dull") & (second != "") & (ungrounded_names(T.first_line(without_fence(F.col("again"))), F.col("code")) == ""), second)).drop("again")
    r = _asked(r, "obvious", F.col("second").isNotNull(), "said", backend, doc=F.col("second"), code=F.col("code"))
    kept = F.when(~F.col("dull"), F.col("note")).when(F.col("second").isNotNull() & ~no(F.col("said")), F.col("second"))
    status = F.when(F.col("note").isNull(), "none").when(~F.col("grounded"), "ungrounded").when(~F.col("high"), "low").when(kept.isNull(), "obvious").otherwise("note")
    return r.select(*keys, F.when(status == "note", kept).alias("note"), status.alias("status"))


def one_liners(missing: DataFrame, code: DataFrame, backend: Callable[[], Backend] = stub) -> DataFrame:
    """(file, qualname, contract) of the callees whose contract is missing, each asked once; failures stay empty.

    missing: (callee_file, callee); code: (file, qualname, code), of equal keys the least code counts. Callees without
    code are left out.
    """
    wanted = missing.select(F.col("callee_file").alias("file"), F.col("callee").alias("qualname")).distinct()
    c = code.groupBy("file", "qualname").agg(F.min("code").alias("code")).join(wanted, ["file", "qualname"])
    r = _asked(c, "one_liner", F.col("code").isNotNull(), "reply", backend, code=F.col("code"))
    return r.select("file", "qualname", T.first_line(F.col("reply")).alias("contract"))


def staged(rows: DataFrame, levels: DataFrame, step: Callable[[DataFrame, DataFrame | None], DataFrame], most_levels: int) -> DataFrame:
    """Rows worked on level by level, each level seeing what the ones before came to: step(rows of a level, results so far).

    levels: (file, qualname, level). Levels from most_levels on are worked on together as the last one.
    """
    known = written(rows.join(levels.select("file", "qualname", F.least("level", F.lit(most_levels - 1)).alias("level")), ["file", "qualname"], "left").fillna({"level": 0}), "staged")
    done = None
    for (level,) in known.select("level").distinct().orderBy("level").collect():  # at most most_levels rows
        got = written(step(known.filter(F.col("level") == level).drop("level"), done), "stage")
        done = got if done is None else done.unionByName(got)
    return done if done is not None else step(known.drop("level"), None)
