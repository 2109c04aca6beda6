"""Broken prompt and response pairs (problem 5).

A suffix automaton of the prompt measures how much of a response is copied; a refusal automaton, a delimiter stack and
votes of stop words find the other defects. A response cut off within a word is told by the corpus: words that start
like its last one are seen there, or anywhere, far more often than that word can be expected to end a text there. All
such rules compare rates by their confidence bounds, so more of the same texts do not change what they say.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.automaton import SuffixAutomaton
from marlstone.tables import spread, written

#: A response copies if matches of at least MATCH words (or the whole response) cover this part of its words.
COPIED, MATCH = 0.9, 8
SALTS = 8

#: The words by which a refusal shows, by class; texts without any of TRIGGERS are not read further.
CLASSES = {
    "me": "i im ive id me my myself we us our",
    "cannot": "cannot cant couldnt wont unable decline declined refuse refused wouldnt",
    "explain": "describe explain comment document summarise summarize annotate answer help assist say tell judge review comply complete respond reply clarify discuss continue proceed interpret elaborate offer advise write generate give provide produce determine guess speculate",
    "give": "share provide send give show post paste attach supply upload specify clarify tell point include forward add",
    "more": "context information info details detail code file files snippet source definition callers rest background input material",
    "lacking": "enough insufficient little limited missing without more additional further full complete whole remaining surrounding",
    "limit": "guidelines policy policies instructions rules permissions capabilities ability scope training",
}
TRIGGERS = set("i im ive id me my sorry apologies apologise apologize regret afraid please could can would cannot cant unable unfortunately ai assistant help know enough insufficient instead beyond outside unknown".split())
_W = {k: f"(?:{'|'.join(v.split())})" for k, v in CLASSES.items()}
_NOT = r"(?:not|never|neither)"
#: The automaton: words in order, `.` the end of a sentence, x quoted text. Each line is one way to decline.
REFUSAL = re.compile(
    "|".join(
        (
            rf"\b(?:i|ive|im) (?:\w+ )?{_W['cannot']}\b", rf"\b(?:i|im) (?:\w+ )?(?:am |do |can |could |will |would |may |have )?{_NOT} (?:\w+ )?(?:able|allowed|permitted|comfortable|confident|certain|sure|position|qualified|going|feel|have|know|see|understand|explain|describe|comment|help|assist|say|tell|do|give|provide|want|wish)\b",
            rf"\bi (?:dont|didnt|havent|lack|am afraid|need to|would rather|only see|only have|can only see|see only|have no|have only)\b", rf"\b(?:im|i am) (?:afraid|sorry|stuck|unsure|not)\b", rf"\bi (?:must|have to|had to|had better) (?:\w+ )?(?:decline|refuse|leave|pass|stop|abstain)\b", rf"\b(?:we|they) {_W['cannot']} {_W['explain']}\b",
            rf"(?:^|\. )(?:unfortunately |regrettably |sadly |well |no )?(?:cannot|cant|unable to|not able to|impossible to|declined? to|refuse to|refusing to) (?:be )?{_W['explain']}\b", rf"(?:^|\. )(?:no answer|no comment|request declined|declined|refused|skipped on request)(?: \.|$)",
            rf"\b(?:sorry|apologies) (?:\.|but|i|im|we|no|about|for|this|that|it|there|cannot|cant|unable)\b", r"\bsorry \.", r"\b(?:my|our|sincere) apologies\b", r"\b(?:i|we) (?:\w+ )?(?:apologi[sz]e|regret)\b", r"\bas an? (?:ai|language model|assistant|large language model)\b", r"\b(?:im|i am) (?:just |only )?an (?:ai|assistant)\b",
            rf"\b(?:could|can|would|will|might|may) (?:you|someone|anyone|somebody) (?:please |kindly |perhaps |also )?{_W['give']}\b", rf"\bplease (?:do |kindly |first |also )?(?:{_W['give']}|ask|contact|consult|refer|try|rephrase|resubmit|let me)\b(?!\w)", r"\blet me know\b", rf"\bi (?:would |will |d |do )?(?:need|require|want)\b", rf"\bid (?:need|require|have to|rather|prefer not)\b", rf"\b(?:could|would|can) you mind \w+ing\b", r"\b(?:impossible|hard|difficult) for me to\b",
            rf"\b(?:is there|any) (?:any )?(?:chance|way) (?:to get|of getting|you)\b", rf"\b(?:(?:not|isnt|arent|wasnt|werent) enough|insufficient|too little|no) (?:\w+ )?{_W['more']} (?:\w+ )?(?:was|were|is|are|here|provided|given|available|to|for me)\b", rf"\b(?:beyond|outside|outside of|exceeds|above) (?:what i|my|the scope of what i|what an ai)\b", rf"\bmy (?:own )?{_W['limit']}\b",
            r"\b(?:unknown|unclear|not clear|not known|unfamiliar) to me\b", rf"\b(?:happy|glad) to help (?:\. )?(?:but|if|once|as soon|when)\b", rf"\bask (?:the|a|an|someone|somebody|your|its|another) \w+(?: \w+){{0,4}} instead\b", rf"\b(?:can|could|may) i (?:see|have|get)\b",
        )
    )
)

#: Function words by language, accents left out; words of content are none.
STOPWORDS = {
    "en": "the a an and or of to in is are was were be been it its this that these those with for on at by from as but not no if when while before after so than then only each every both neither nor any all some once per until unless into out up has have had does do did will would can could may must never since because there here which who what how why whatever other still used set skip keep fall back note without",
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war wird werden wurde wenn weil damit dass fur mit von vom zum zur auf aus bei nach vor uber unter noch nur auch sonst bis wie sich wir ihr sie er es ohne erst im am als hat haben sollte gibt durch wieder schon",
    "fr": "le la les un une des du de et ou mais ne pas est sont etait sera si parce que qui quoi pour avec dans sur sous par au aux ce cette ces il elle nous vous ils sans plus encore aussi apres avant depuis seulement son sa ses leur tout toutes quand lorsque deja chaque",
    "es": "el la los las un una unos unas de del y o pero no es son era fue si porque que quien para con en sobre por al este esta estos su sus se nos sin mas todavia tambien tras desde hasta solo cuando despues antes aun todo como lo ya cada hay",
    "pt": "o a os as um uma de do da dos das e ou mas nao sao era foi se porque que quem para com em no na nos nas por ao este esta seu sua sem mais ainda tambem apos desde ate so quando depois antes ja como cada pelo pela",
    "it": "il lo la i gli le un uno una di del della dei e o ma non sono era se perche che chi per con in nel nella su da al questo questa suo sua si senza piu ancora anche dopo fino solo quando prima altri altre tutte come ogni gia",
    "nl": "de het een en of maar niet is zijn was wordt worden als omdat dat die wie voor met in op van uit bij naar om te er dit deze zich we wij zonder meer nog ook na sinds tot alleen wanneer eerst daarna pas hebben heeft door alle",
    "pl": "i w z na do nie jest sa byl byla bylo sie ze ktory ktora ktore dla od po przy przez pod nad za oraz ale lub jesli gdy jak tak tez jeszcze juz tylko bez zanim wiec aby czy nadal dlaczego kiedy co",
    "sv": "och i att det som en pa ar av for med till den har de inte om ett men var sig sa fran vid nar kan utan eller bara efter innan annu aven sedan alla",
    "da": "og i at det som en pa er af for med til den har de ikke om et men var sig sa fra ved nar kan uden eller kun efter for endnu ogsa siden alle",
    "fi": "ja on ei se etta tai mutta kun jos niin myos vain ennen jalkeen ilman kuin ovat oli sen tama joka jotka viela ole",
    "cs": "a v na se je ze do z pro s o jako po ale neni jsou byl byla bylo ktery ktera ktere kdyz nebo jen jeste bez take od aby uz pri",
    "tr": "ve bir bu icin ile da de degil olarak daha cok ne ama ancak kadar sonra once gibi her veya ise yalnizca olan",
    "ro": "si in de la cu pe nu este sunt un o care din pentru ca mai dar sau daca dupa fara doar pana cand nici",
    "hu": "a az es nem hogy egy van volt csak meg ha de is mint vagy ezt azt el ki be fel le minden utan elott nelkul amely amikor mert",
    "id": "yang dan di ke dari untuk dengan ini itu tidak akan pada adalah atau jika karena oleh sebagai dalam sudah belum hanya juga telah saat setelah sebelum tanpa bila agar",
    "vi": "va la cua co khong cho duoc trong voi cac mot nay do khi neu de tu ra vao da se dang chi sau truoc nhung hoac boi",
    "ga": "an na agus is ni ta ar le do go sa ag air as nach mar ach no roimh tar eis gan chun seo sin bhi leis",
    "ca": "el la els les un una de del i o pero no es son per amb en que si com mes tambe sense fins quan despres abans nomes ja hi",
    "hr": "i u na se je da ne za od sa su koji koja koje ali ili ako kad kada jer samo bez nakon prije vec jos nije bio kao",
    "sw": "na ya wa kwa ni katika hii hiyo hiki si la za cha kama au lakini baada kabla bila tu pia",
    "et": "ja on ei see et voi aga kui siis ka ainult enne parast ilma mis kes oli ning veel selle",
    "lt": "ir yra ne tai kad ar bet jei kai tik prie po be kuris kuri buvo dar su is nuo iki kaip",
    "lv": "un ir ne tas ka vai bet ja kad tikai pirms pec bez kas bija vel ar no lidz ka",
    "tl": "ang ng sa na ay mga ito hindi at para kung may o pero lamang bago matapos walang kapag",
    "af": "die en nie is van n het in op te vir met dat wat sal word as maar of slegs voor na sonder nog ook",
}
_VOTES: dict[str, tuple[str, ...]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in set(_words.split()) if _lang == "en" else set(_words.split()) - set(STOPWORDS["en"].split()):
        _VOTES[_w] = (*_VOTES.get(_w, ()), _lang)

#: Words that an English sentence does not end with.
DANGLING = set("the a an and or but nor so that which who whose because since unless until while when where whereas although though if than as of to in on at by for from with without into onto over under between via per is are be been being has have had its their our your my this these those every each any no not only both either neither also such very".split()) - {"so", "this", "under", "over", "not", "only", "both", "either", "neither", "also", "any", "those", "these", "in", "on"}
_TOKEN = re.compile(r"\w+|[^\w\s#*/`\"']")
_PIECES = re.compile(r"`[^`]*`|[^\W\d_]+|\d+|[^\s]")
_LETTERS = re.compile(r"[^\W\d_]")
_PLACES = {"(": ")", "[": "]", "{": "}"}


_QUOTED = re.compile(r"```.*?```|`[^`]*`|\"[^\"\n]*\"|“[^”\n]*”|(?<!\w)'[^'\n]*'(?!\w)", re.S)
_HINT = re.compile(rf"\b(?:{'|'.join(sorted(TRIGGERS))})\b")
#: Where a way of declining can begin: at one of its first words, or at the end of the sentence before it.
_STARTS = re.compile(
    r"\.|(?<![^ ])(?:i|ive|im|id|we|they|sorry|apologies|my|our|sincere|as|could|can|would|will|might|may|please|let|is|any|not|isnt|arent|wasnt|werent|insufficient|too|no|beyond|outside|exceeds|above|unknown|unclear|unfamiliar|happy|glad|ask|impossible|hard|difficult)(?![^ ])"
)
_UNIT = re.compile(r"\w+|[.!?;:,—–](?=\s|$)|\s-\s")


def refuses(text: str) -> bool:
    """Whether the refusal automaton finds a way of declining in what is said, not in what is quoted.

    It reads words by class: who speaks and cannot, asks for more, apologises, or names a limit of their own.
    """
    if not _HINT.search(text.lower()):
        return False
    plain = _QUOTED.sub(" x ", text)
    first = _LETTERS.search(plain)
    if first and first.group().isupper():  # where sentences have capitals, a small i is a name
        plain = re.sub(r"\bi\b", "x", plain)
    plain = plain.lower().replace("'", "").replace("’", "").replace("/", "")
    units = _UNIT.findall(plain)
    if TRIGGERS.isdisjoint(units):
        return False
    said = " ".join("." if not x[0].isalnum() else x for x in units if x != ",")
    return REFUSAL.match(said) is not None or any(REFUSAL.match(said, m.start()) for m in _STARTS.finditer(said))


@lru_cache(maxsize=65536)
def folded(w: str) -> str:
    """A word without its accents."""
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)).replace("ł", "l").replace("ø", "o").replace("đ", "d")


_CODE_SPAN = re.compile(r"```.*?```|`[^`]*`", re.S)
_PLAIN_WORD, _ANY_WORD = re.compile("[a-z]+"), re.compile(r"[^\W\d_]+")


def foreign(text: str) -> bool:
    """Whether the votes of stop words, and of letters that English lacks, are for another language than English."""
    plain = _CODE_SPAN.sub(" ", text) if "`" in text else text
    votes: dict[str, float] = {}
    strange = 0
    if plain.isascii():
        words = _PLAIN_WORD.findall(plain.lower())
    else:
        letters = _LETTERS.findall(plain)
        if sum(ord(c) > 0x24F for c in letters) > 0.3 * len(letters):
            return True
        words = [w if w.isascii() else folded(w) for w in _ANY_WORD.findall(plain.lower())]
        strange = sum(not w.isascii() for w in _ANY_WORD.findall(plain.lower()))
    for w in words:
        for lang in _VOTES.get(w, ()):
            votes[lang] = votes.get(lang, 0) + 1
    english = votes.pop("en", 0)
    other = max(votes.values(), default=0) + strange
    return other > english and (other >= 2 or english == 0 and strange > 0)


def unclosed(text: str) -> bool:
    """Whether a delimiter stack is left open: fences, backticks, and brackets outside of quoted code."""
    if text.count("```") % 2:
        return True
    rest = re.sub(r"```.*?```", " ", text, flags=re.S)
    if rest.count("`") % 2:
        return True
    stack: list[str] = []
    for c in re.sub(r"`[^`]*`", " ", rest):
        if c in _PLACES:
            stack.append(_PLACES[c])
        elif stack and c == stack[-1]:
            stack.pop()
    return bool(stack)


def breaks_off(text: str) -> bool:
    """Whether a response ends within a delimiter, after a comma or the like, or with a word no sentence ends with."""
    t = text.rstrip()
    if unclosed(t) or t[-1:] in (",", ";", ":", "(", "–", "—", "-", "&", "="):
        return True
    m = re.search(r"(?:^|[\s(])([A-Za-z']+)$", t)
    return bool(m) and m[1].lower() in DANGLING


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Prompt:
    """The parts of a prompt; the automaton is built only once a response could be copied at all."""

    def __init__(self, parts: list[str]):
        self.parts = [tokens(p) for p in parts if p]
        self.words = {w for p in self.parts for w in p}
        self._automaton: SuffixAutomaton | None = None

    def copied(self, response: str) -> bool:
        words = tokens(response)
        n = len(words)
        if not n or sum(w in self.words for w in words) < COPIED * n:  # coverage can't be more than this
            return False
        if n < 3 and not any(words == p[i : i + n] for p in self.parts for i in range(len(p))):
            return False
        if self._automaton is None:
            self._automaton = SuffixAutomaton(self.parts)
        least, end, covered = min(MATCH, n), 0, 0
        for s, e, _ in self._automaton.matches(self._automaton.statistics(words), least):
            covered += e - max(s, end)
            end = e
        return covered >= COPIED * n


def last_pair(text: str) -> tuple[str, str] | None:
    """The last two pieces of a response that ends with a word and no mark."""
    pieces = _PIECES.findall(text)
    if not pieces or not pieces[-1].isalpha() or not pieces[-1].isascii():
        return None
    return _piece(pieces[-2]) if len(pieces) > 1 else "^", pieces[-1].lower()


def _piece(x: str) -> str:
    return "`" if x[0] == "`" else "9" if x[0].isdigit() else x.lower()


def seen_pairs(text: str, into: dict[tuple[str, str], list[int]]) -> None:
    """Counts neighbouring pieces whose second is a word, and how often a sentence ends after it; not a last word that
    no mark follows."""
    pieces, before = _PIECES.findall(text), "^"
    for x, after in zip(pieces, pieces[1:]):
        if x.isalpha():
            n = into.setdefault((before, x.lower()), [0, 0])
            n[0] += 1
            n[1] += after in ".!?"
        before = _piece(x)


def defect(response: str, prompt: Prompt) -> str | None:
    """The defect of one response; None for none, or one that only the corpus can tell."""
    if not _LETTERS.search(re.sub(r"```\w*", " ", response)):
        return "empty"
    if prompt.copied(response):
        return "copy"
    if refuses(response):
        return "refusal"
    if foreign(response):
        return "language"
    return "truncated" if breaks_off(response) else None


_ROWS = "file string, id string, slot string, defect string, before string, last string, n bigint, ended bigint"
#: One-sided bounds of confidence, in standard deviations.
SURE = 1.645
#: A word never ends a sentence if it surely does so in less than this part of its uses.
NEVER = 0.015
#: A word that surely ends this part of its uses without a mark is an ending. A fragment's own uses (or endings) are
#: less than this part of the uses of the words that start so.
ENDS = 0.02


def _share(x: Column, n: Column, side: int) -> Column:
    """The upper (side 1) or lower (-1) bound of a share of which x in n were seen: Wilson's."""
    z2 = SURE * SURE
    p = x / n
    bound = (p + z2 / (2 * n) + side * SURE * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return F.when(n > 0, bound).otherwise(F.lit(1.0 if side > 0 else 0.0))


def _count(n: Column) -> Column:
    """The upper bound of the mean of a count."""
    return n + SURE * SURE / 2 + SURE * F.sqrt(n + SURE * SURE / 4)


def broken_responses(requests: DataFrame) -> DataFrame:
    """(file, id, slot, defect) of the defective answers: one row for each defective slot.

    A null answer and the answer NONE are none. A chunk without a number goes by its place. A null snippet is looked up by snippet_ref; where that leads nowhere,
    the prompt has no snippet. Rows delivered twice give one row. Defects are tried in the order empty, copy, refusal,
    language, truncated.
    """
    columns = ["file", "id", "snippet", "qualname", F.col("def.answer").alias("answer"), "blocks"]
    requests = requests.select("file", "id", "snippet", "snippet_ref", "qualname", "def", "blocks")
    has = spread(requests.filter(F.col("snippet").isNotNull() | F.col("snippet_ref").isNull()).select(*columns))
    lacks = requests.filter(F.col("snippet").isNull() & F.col("snippet_ref").isNotNull())
    wanted = lacks.select(F.col("snippet_ref").alias("id")).distinct()
    carriers = requests.filter("snippet is not null").select("id", "snippet").join(wanted, "id", "left_semi").groupBy("id").agg(F.min("snippet").alias("found"))
    # one text may be referred to by very many requests: both sides are salted
    carriers = carriers.withColumnRenamed("id", "snippet_ref").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = lacks.withColumn("salt", F.pmod(F.xxhash64("file", "id"), F.lit(SALTS)).cast("int")).drop("snippet").join(carriers, ["snippet_ref", "salt"], "left")
    rows = has.unionByName(joined.withColumnRenamed("found", "snippet").select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _ROWS.split(", ")]
        for b in batches:
            out: list[tuple] = []
            pairs: dict[tuple[str, str], list[int]] = {}
            for file, id_, snippet, qualname, answer, blocks in zip(*(b.column(i).to_pylist() for i in range(6))):
                blocks = blocks or {}
                chunks = [c for c in blocks.get("chunks") or [] if c]
                slots = [("def", answer)] if answer is not None else []
                slots += [(f"b{k if c['bidx'] is None else c['bidx']}", c["answer"]) for k, c in enumerate(chunks) if c["answer"] is not None]
                if not slots:
                    continue
                parts = [snippet, blocks.get("doc_summary"), blocks.get("length_note"), (qualname or "").rpartition(".")[2]]
                parts += [x for c in chunks for x in (c["anchor"], c["existing"])]
                prompt = Prompt([x for x in parts if x])
                for slot, x in slots:
                    if x.strip() == "NONE":
                        continue
                    seen_pairs(x, pairs)
                    what = defect(x, prompt)
                    last = None if what else last_pair(x)
                    if what or last:
                        out.append((file, id_, slot, what, *(last or (None, None)), None, None))
            out += [(None, None, None, None, *p, *n) for p, n in pairs.items()]
            cols = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 6 else pa.int64()) for i, c in enumerate(cols)], names=names)

    all_ = written(rows.mapInArrow(run, _ROWS), "responses")
    told = all_.filter("defect is not null").select("file", "id", "slot", "defect")
    open_ = all_.filter("slot is not null and defect is null")
    pairs = all_.filter("slot is null").groupBy("before", "last").agg(F.sum("n").alias("n"), F.sum("ended").alias("ended"))
    words = pairs.groupBy("last").agg(F.sum("n").alias("n_last"), F.sum("ended").alias("n_ended"))
    firsts = pairs.groupBy("before").agg(F.sum("n").alias("n_before"))
    total = all_.filter("slot is null").agg(F.sum("n")).first()[0] or 0  # one number
    asked = open_.distinct().groupBy("before", "last").agg(F.count("*").alias("n_final"))
    finals = asked.groupBy("last").agg(F.sum("n_final").alias("n_finals"))
    starts = F.explode(F.expr("transform(sequence(1, greatest(1, length(last) - 1)), k -> substring(last, 1, k))"))
    longer = pairs.select("before", starts.alias("start"), "last", "n").filter("start <> last").groupBy("before", F.col("start").alias("last")).agg(F.sum("n").alias("n_longer"))
    anywhere = words.select(starts.alias("start"), "last", "n_last").filter("start <> last").groupBy(F.col("start").alias("last")).agg(F.sum("n_last").alias("n_wider"))
    known = asked.join(pairs.select("before", "last", F.col("n").alias("n_pair")), ["before", "last"], "left").join(longer, ["before", "last"], "left")
    known = known.join(words, "last", "left").join(anywhere, "last", "left").join(firsts, "before", "left").join(finals, "last").withColumn("total", F.lit(total))
    n = {x: F.coalesce(F.col(x), F.lit(0)).cast("double") for x in ("n_pair", "n_longer", "n_last", "n_ended", "n_wider", "n_before", "n_finals", "total")}
    others = n["n_finals"] - 1  # responses besides one of these
    ending = _share(others, others + n["n_last"] + n["n_wider"], -1) >= ENDS
    # the word is hardly ever seen whole, wherever
    unknown = (_share(n["n_last"], n["n_last"] + n["n_wider"], 1) < ENDS) & ~ending
    # to be expected of the word in that place, and how many of its uses end a text at most
    here = F.least(_count(n["n_pair"]), n["n_pair"] + F.when(n["total"] > 0, n["n_last"] * n["n_before"] / n["total"]).otherwise(0.0))
    ends = _share(n["n_ended"] + others, n["n_last"] + others, 1)
    fragment = (n["n_longer"] > 0) & (ends * here < ENDS * n["n_longer"]) & (ends * n["n_last"] < ENDS * n["n_wider"]) & ~ending
    never_last = (_share(n["n_ended"], n["n_last"], 1) < NEVER) & (_share(others, n["n_last"] + others, 1) < ENDS)
    cut = known.filter(unknown | fragment | never_last).select("before", "last")
    salted = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    off = open_.withColumn("salt", F.pmod(F.xxhash64("file", "id"), F.lit(SALTS)).cast("int")).join(salted, ["before", "last", "salt"], "left_semi")
    return told.unionByName(off.select("file", "id", "slot", F.lit("truncated").alias("defect"))).distinct()
