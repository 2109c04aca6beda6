"""Chat prompts from arrays of (role, content): one column expression for each format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import strip

#: Strings that end a reply, by format.
STOPS = {
    "chatml": ("<|im_end|>", "<|im_start|>", "<|endoftext|>"),
    "llama3": ("<|eot_id|>", "<|end_of_text|>", "<|start_header_id|>"),
    "llama2": ("</s>", "[INST]"),
    "mistral": ("</s>", "[INST]"),
    "phi3": ("<|end|>", "<|user|>", "<|system|>"),
}
#: Other names of formats.
ALIASES = {"qwen": "chatml", "llama-3": "llama3", "llama-2": "llama2", "mixtral": "mistral"}
_ROLES = ("system", "user", "agent", "assistant")


def cleaned(messages: Column) -> Column:
    """Stripped roles and contents; blank messages are left out."""
    rows = F.transform(messages, lambda m: F.struct(strip(F.coalesce(m["role"], F.lit(""))).alias("role"), strip(F.coalesce(m["content"], F.lit(""))).alias("content")))
    return F.filter(rows, lambda m: (m["role"] != "") & (m["content"] != ""))


def _tagged(messages: Column, before: str, between: str, after: str, end: str) -> Column:
    known = F.filter(cleaned(messages), lambda m: m["role"].isin(*_ROLES))
    turns = F.transform(known, lambda m: F.concat(F.lit(before), m["role"], F.lit(between), m["content"], F.lit(after)))
    return F.concat(F.array_join(turns, ""), F.lit(end))


def _instructed(messages: Column, system: bool) -> Column:
    """User turns wait for the reply that answers them; a waiting turn is closed by the next user turn or the end."""
    rows = cleaned(messages)
    first = F.try_element_at(rows, F.lit(1))
    has = F.coalesce(first["role"] == "system", F.lit(False)) if system else F.lit(False)
    sys_text = F.when(has, first["content"]).otherwise("")
    turns = F.when(has, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    block = lambda x: F.concat(F.lit("[INST] "), strip(x), F.lit(" [/INST]"))
    opened = lambda s, x: F.when(s != "", F.concat(F.lit("<<SYS>>\n"), s, F.lit("\n<</SYS>>\n\n"), x)).otherwise(x)
    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("string").alias("waits"), sys_text.alias("sys"))

    def step(s: Column, m: Column) -> Column:
        asks, answers = m["role"].isin("user", "agent"), m["role"] == "assistant"
        waits = F.coalesce(s["waits"], F.lit(""))
        out = F.when(asks & s["waits"].isNotNull(), F.concat(s["out"], block(s["waits"]))).when(answers, F.concat(s["out"], block(opened(s["sys"], waits)), m["content"])).otherwise(s["out"])
        return F.struct(out.alias("out"), F.when(asks, m["content"]).when(answers, F.lit(None).cast("string")).otherwise(s["waits"]).alias("waits"), F.when(answers, "").otherwise(s["sys"]).alias("sys"))

    return F.aggregate(turns, start, step, lambda s: F.concat(s["out"], block(opened(s["sys"], F.coalesce(s["waits"], F.lit(""))))))


def prompt(messages: Column, format: str) -> Column:
    """The prompt of a format, open for the assistant's reply. Unknown roles are left out; raises KeyError for a format
    that isn't known."""
    name = ALIASES.get(format, format)
    if name == "chatml":
        return _tagged(messages, "<|im_start|>", "\n", "<|im_end|>", "<|im_start|>assistant\n")
    if name == "llama3":
        return _tagged(messages, "<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>", "<|start_header_id|>assistant<|end_header_id|>\n\n")
    if name == "phi3":
        return _tagged(messages, "<|", "|>\n", "<|end|>\n", "<|assistant|>\n")
    if name in ("llama2", "mistral"):
        return _instructed(messages, name == "llama2")
    raise KeyError(format)


def format_of(model: Column) -> Column:
    """The format that a model file's name suggests; chatml where none is."""
    low = F.lower(model)
    out = F.lit("chatml")
    for pattern, name in (("llama", "llama2"), ("phi-?3", "phi3"), ("mi[sx]tral", "mistral"), ("llama-?_?3", "llama3"), ("qwen", "chatml")):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out
