"""Broken prompt and response pairs, by ordered rules.

The rules, in the order in which they name a pair's one defect: nothing readable (``empty``);
only refusal phrases and courtesies in any of the languages (``refusal``); the prompt or its
question and no more (``copies_question``); cut off (``truncated``, by the operator in
``truncation``, which also sees unclosed delimiters and abrupt endings); another language or script than the prompt uses or asks for (``other_language``). ``defects`` keeps
every rule that fires; ``first_defect`` the first.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import kernels, truncation
from tallyforge.llm.language import LANGUAGES, Model, detect, learn
from tallyforge.session import prepare

ORDER = ("empty", "refusal", "copies_question", "truncated", "other_language")

#: What declines, and what only surrounds it.
_DECLINES = re.compile(
    r"\b(?:id|would) rather not|decline to|have to decline|must decline|cant help|cannot help|cant assist|cannot assist|unable to (?:help|answer|assist|comment|respond|discuss)"
    r"|not able to (?:take|answer|comment|help|discuss|give|offer)|wont be (?:answering|commenting)|will not (?:answer|comment|be answering)|pass on this|no comment|stay silent"
    r"|stay out of|inappropriate for me|against my (?:guidelines|policy|rules)|beyond what i can|outside what i|not allowed to|keep me from|dont discuss|do not discuss"
    r"|talk about something else|will weigh in|take a position here|my role does not|cant (?:answer|comment|discuss|give)|cannot (?:answer|comment|discuss|give)|prefer not to"
    r"|无法回答|不便|不能回答|无法提供|无可奉告|不予置评|拒绝回答|不会回答"
    r"|keine auskunft|nicht beantworten|keine stellung|nicht äußern|möchte (?:ich )?(?:mich )?(?:dazu )?nicht|keine meinung"
    r"|ne pas répondre|ne peux pas|ne souhaite pas|refuse de|pas me prononcer|pas en mesure"
    r"|no responder|no puedo (?:opinar|responder|ayudar|comentar)|no me es posible|no quiero (?:opinar|responder)"
    r"|não responder|não posso (?:opinar|responder|ajudar|comentar)|não quero (?:opinar|responder)|não me cabe"
)
_COURTESY = re.compile(
    r"^(?:hm+|thank you|thanks|i appreciate|i hope you|please consult|please ask|is there something else|feel free|sorry|im sorry|unfortunately|with respect|to be upfront|i understand"
    r"|抱歉|对不起|谢谢|很遗憾|请|es tut mir leid|danke|bitte|leider|entschuldigung|désolé|je regrette|merci|lo siento|gracias|por favor|desculpe|obrigad|sinto muito)"
)
_QUIET = re.compile(r"[’'`*_#>]")
_STOP = re.compile(r"[.!?。！？]|\n{2,}")
_ASKS = re.compile(
    r"\b(?:answer|reply|respond|write)\b[^.?!]{0,30}\bin (english|german|french|spanish|portuguese|chinese)\b|\bauf (englisch|deutsch|französisch|spanisch|portugiesisch|chinesisch)\b"
    r"|\ben (anglais|allemand|français|espagnol|portugais|chinois|inglés|alemán|francés|español|portugués|chino)\b|\bem (inglês|alemão|francês|espanhol|português|chinês)\b|用(英文|英语|德语|法语|西班牙语|葡萄牙语|中文)",
    re.I,
)
#: How the languages are called where a prompt asks for one.
_NAMES = {
    "en": "english englisch anglais inglés inglês 英文 英语", "de": "german deutsch allemand alemán alemão 德语", "fr": "french französisch français francés francês 法语",
    "es": "spanish spanisch espagnol español espanhol 西班牙语", "pt": "portuguese portugiesisch portugais portugués português 葡萄牙语", "zh": "chinese chinesisch chinois chino chinês 中文",
}
_NAMED = {w: LANGUAGES.index(k) for k, v in _NAMES.items() for w in v.split()}


def _sentence(text: str, at: int) -> tuple[str, int]:
    """The sentence that starts at ``at``, folded for matching, and where the next one starts."""
    m = _STOP.search(text, at)
    end = m.end() if m else len(text)
    return " ".join(_QUIET.sub("", text[at:end].lower()).strip(" \t\r\n -–—\"\u00a0\u200b").split()), end


def declines(text: str) -> bool:
    """Whether a text declines and says nothing else, however long: at least one refusal
    phrase, and every sentence is one or a courtesy. Reading stops at the first sentence that
    is neither, so a refusal that goes on to answer does not count."""
    found, at = False, 0
    while at < len(text):
        s, at = _sentence(text, at)
        if any(map(str.isalnum, s)):
            if _DECLINES.search(s):
                found = True
            elif not _COURTESY.match(s):
                return False
    return found


def _may_decline(texts: list[str]) -> np.ndarray:
    """Texts whose first sentence with letters is a refusal phrase or a courtesy, matched for
    all texts at once; no other text can be a refusal."""
    first = []
    for t in texts:
        s, at = _sentence(t, 0)
        while at < len(t) and not any(map(str.isalnum, s)):
            s, at = _sentence(t, at)
        first.append(s)
    col = pa.array(first, pa.string())
    return pc.or_(pc.match_substring_regex(col, _DECLINES.pattern), pc.match_substring_regex(col, _COURTESY.pattern)).to_numpy(zero_copy_only=False)


def _asked(prompt: str) -> int:
    """The language that a prompt asks for, as an index; -1 for none."""
    m = _ASKS.search(prompt)
    return _NAMED[next(g for g in m.groups() if g).lower()] if m else -1


def _fold(text: str) -> str:
    return "".join(filter(str.isalnum, text.casefold()))


@functools.lru_cache(maxsize=4096)
def _folded(text: str) -> str:
    return _fold(text)


def _end(text: str | None) -> str:
    """The last six letters and digits of a text, tags aside, however far from its end."""
    text = text or ""
    if "<" in text:
        text = truncation._TAG.sub("", text)
    reach = 64
    while True:
        got = _fold(text[-reach:])
        if len(got) >= 6 or reach >= len(text):
            return got[-6:]
        reach *= 16


@functools.lru_cache(maxsize=4096)
def _end_of_question(text: str | None) -> str:
    return _end(text)


def copies(prompt: str, question: str | None, response: str) -> bool:
    """Whether a response is the prompt or its question, once or more, under a short label
    at most; whatever follows the last copy is an answer."""
    r = _fold(truncation._TAG.sub("", response) if "<" in response else response)
    for asked in (prompt, question):
        p = _folded(asked or "")
        if len(p) < 8:
            continue
        at = r.rfind(p)
        if at >= 0 and at + len(p) == len(r):
            return len(r.replace(p, "")) <= 40
    return False


def _after(text: str, asked: str | None) -> str | None:
    """What follows a copy of ``asked`` at the start of a text; None without a copy."""
    want = _folded(asked or "")
    at = 0
    for i, ch in enumerate(text):
        if at == len(want):
            return text[i:] if at >= 8 else None
        if ch.isalnum():
            f = ch.casefold()
            if not want.startswith(f, at):
                return None
            at += len(f)
    return None


_OUT = "src string, id bigint, empty boolean, refusal boolean, copies_question boolean, other_language boolean"


def _judge(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(2).dictionary_encode()
            prompts = asked.dictionary.to_pylist()
            wants = detect(asked.dictionary, model)[0] if len(asked.dictionary) else np.zeros(0, np.int64)
            wants = [k if k >= 0 else w for k, w in zip(map(_asked, prompts), wants.tolist(), strict=True)]
            ends = [_end(p) for p in prompts]
            which, questions = asked.indices.to_pylist(), b.column(3).to_pylist()
            col = kernels.string_array(b.column(4))
            texts = col.to_pylist()
            lang, han, n = (x.tolist() for x in detect(col, model))
            empty = np.array(n) == 0
            for i in np.flatnonzero(pc.match_substring(col, "<").to_numpy(zero_copy_only=False)).tolist():
                empty[i] = truncation.closing(texts[i]) == truncation.BLANK
            refusal, repeats, other = np.zeros((3, b.num_rows), bool)
            for i in np.flatnonzero(_may_decline(texts) & ~empty).tolist():
                refusal[i] = declines(texts[i])
            for i in np.flatnonzero(~empty).tolist():
                if which[i] is None:
                    continue
                p, q, t, want = prompts[which[i]], questions[i], texts[i], wants[which[i]]
                if _end(t) in (ends[which[i]], _end_of_question(q)):
                    repeats[i] = copies(p, q, t)
                if want < 0 or lang[i] == want or (n[i] < 8 and han[i] < 0.3):
                    continue
                rest = _after(t, q) or _after(t, p)
                mine, chinese, size = (x[0] for x in detect(pa.array([rest]), model)) if rest else (lang[i], han[i], n[i])
                if mine >= 0:
                    other[i] = mine != want
                else:
                    other[i] = LANGUAGES[want] == "zh" and chinese < 0.1 and size > 12
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array(x) for x in (empty, refusal, repeats, other)]],
                names=["src", "id", "empty", "refusal", "copies_question", "other_language"],
            )

    return run


def defects(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """(src, id, defects): every defect type of each broken pair, in the rules' order.

    ``pairs`` has src, id, prompt, question and response; ``cut`` (src, id) the records cut
    off. A null response is empty. A null prompt triggers no copy or language rule, and a
    prompt or response whose language cannot be told no language rule. Rows with a null id
    are left out; an empty table gives no rows.
    """
    prepare(pairs.sparkSession)
    src = pairs.select("src", F.col("id").cast("bigint").alias("id"), "prompt", "question", "response").filter("id is not null")
    judged = src.mapInArrow(_judge(learn(src, F.col("id"), F.col("response"))), _OUT).filter("empty or refusal or copies_question or other_language")
    both = judged.join(cut.select("src", "id", F.lit(True).alias("truncated")), ["src", "id"], "full")
    flags = F.array(*[F.when(F.col(d), F.lit(d)) for d in ORDER])
    return both.select("src", "id", F.array_compact(flags).alias("defects"))


def first_defect(found: DataFrame) -> DataFrame:
    """(src, id, defect): the first defect of each pair in the rules' order."""
    return found.select("src", "id", F.col("defects")[0].alias("defect"))


def study_pairs(scored: DataFrame, sheets: DataFrame) -> DataFrame:
    """The prompt and response pairs of the study's two tables."""
    a = scored.select(F.lit("scored").alias("src"), F.col("record_id").alias("id"), F.col("user_prompt").alias("prompt"), F.col("question_text").alias("question"), F.col("response_text").alias("response"))
    b = sheets.select(F.lit("sheets").alias("src"), F.col("sheet_id").alias("id"), F.col("forcing_prompt").alias("prompt"), F.lit(None).cast("string").alias("question"), F.col("response_text").alias("response"))
    return a.unionByName(b)
