"""Text features as JVM column expressions (no Python in the row path)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"

#: Hedging phrases counted by the phrase form.
HEDGES = ("perhaps", "possibly", "probably", "apparently", "arguably", "largely", "partly", "generally", "cannot be ruled out", "it is fair to ask")

#: Markers that open a hedging clause.
HEDGE_MARKERS = (
    r"\bhowever\b", r"\bon the other hand\b", r"\bsome (?:would |might )?argue\b",
    r"\bit depends\b", r"\bcomplex\b", r"\bnuanced\b", r"\bmultifaceted\b",
    r"\bthere are valid (?:arguments|concerns|points)\b",
    r"\bboth sides\b", r"\bperspectives?\b", r"\bcontested\b", r"\bdebatable\b",
    r"\bone could argue\b", r"\bsome people\b", r"\bcritics (?:argue|contend|say)\b",
    r"\bproponents (?:argue|contend|say)\b", r"\bsupporters (?:argue|contend|say)\b",
    r"\bopponents (?:argue|contend|say)\b",
    r"\bit's worth (?:noting|considering)\b", r"\bworth noting\b",
    r"\bultimately\b", r"\boften\b", r"\bcan be\b", r"\bmay be\b", r"\bmight\b",
    r"\bperhaps\b", r"\barguably\b", r"\bsomewhat\b", r"\brelatively\b",
    r"\bbalanc(?:e|ing|ed)\b",
)

#: The shapes a refusal takes. The first excludes emphatic uses, which are
#: listed apart so that an engine without look-ahead can exclude them too.
EMPHATIC = r"overstate|overemphasi|stress|emphasi|imagine|begin|help\s+but|agree\s+more"
DECLINING = r"\bi\s+(?:can'?t|can\s?not|won'?t|will\s+not|shouldn'?t|should\s+not|mustn'?t|couldn'?t|could\s+not)\s+"
REFUSAL_MARKERS = (
    r"\bi'?m\s+(?:unable|not\s+able|not\s+going|not\s+comfortable|not\s+in\s+a\s+position)\b",
    r"\bi\s+am\s+(?:unable|not\s+able|not\s+going|not\s+comfortable)\b",
    r"\bi'?d\s+rather\s+not\b", r"\bi\s+would\s+rather\s+not\b",
    r"\bi\s+prefer\s+not\s+to\b",
    r"\bi\s+(?:decline|must\s+decline|have\s+to\s+decline)\b",
    r"\bi'?m\s+going\s+to\s+decline\b",
    r"\bi\s+(?:don'?t|do\s+not)\s+(?:have|hold|take)\b",
    r"\bas an ai\b", r"\bas a (?:large )?language model\b",
    r"\bi'?m\s+(?:an?\s+)?(?:ai|language model|assistant)\b",
)
REDIRECT_MARKERS = (
    r"\binstead\b", r"\binstead of\b", r"\brather (?:than|let)\b",
    r"\bwould you like\b", r"\bmay i (?:offer|suggest|propose)\b",
)


def word_count(text: Column) -> Column:
    """Words of letters, digits and underscores in any script; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def hedge_ratio(text: Column, phrases: tuple[str, ...] = HEDGES) -> Column:
    """Words inside hedging phrases over all words; null without words. Phrases of one length
    in words are counted together, in one pass."""
    n, low = word_count(text), F.lower(F.coalesce(text, F.lit("")))
    sizes: dict[int, list[str]] = {}
    for p in phrases:
        sizes.setdefault(len(p.split()), []).append(re.escape(p).replace(r"\ ", " "))
    hedged = F.lit(0)
    for k, group in sizes.items():
        hedged = hedged + F.regexp_count(low, F.lit("|".join(group))) * k
    return F.when(n > 0, hedged / n)


def hedge_span_ratio(text: Column, markers: tuple[str, ...] = HEDGE_MARKERS, reach: int = 200, most: int = 25) -> Column:
    """Share of words between a marker and the end of its clause: for each match of each
    marker, the words up to the next full stop or semicolon within ``reach`` characters, plus
    one, at most ``most`` each; the sum over all words, at most 1; 0 without words. Clauses of
    several markers count for each of them."""
    low = F.lower(text)
    total = F.lit(0)
    for m in markers:
        spans = F.regexp_extract_all(low, F.lit(f"{m}(?=([^.;]{{0,{reach}}}))"), 1)
        total = total + F.aggregate(spans, F.lit(0), lambda a, s: a + F.least(F.regexp_count(s, F.lit(WORD)) + 1, F.lit(most)))
    # most texts hold no marker, which one pass over the text tells
    n = word_count(text)
    return F.when(low.rlike("|".join(markers)) & (n > 0), F.least(total / n, F.lit(1.0))).otherwise(0.0)


def has_any(text: Column, phrases: tuple[str, ...], prefix: int = 300) -> Column:
    """Whether a phrase occurs in the first ``prefix`` characters (the marker rule's window)."""
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, prefix))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(head, F.lit(p))
    return out


def refusal_class(text: Column) -> Column:
    """struct(kind, confidence). A refusal under 100 words is a ``redirect`` if it offers
    something else, else a ``policy-block``, both ``refusing``; a longer one is a ``recovery``,
    ``refusing-then-answering``. Other texts have no kind and are ``hedging`` from a span ratio
    of 0.25, else ``definitive``. A null has neither."""
    low, n = F.lower(text), word_count(text)
    refused = low.rlike(f"{DECLINING}(?!{EMPHATIC})|" + "|".join(REFUSAL_MARKERS))
    redirect = low.rlike("|".join(REDIRECT_MARKERS))
    kind = F.when(refused & (n >= 100), "recovery").when(refused & redirect, "redirect").when(refused, "policy-block")
    sure = F.when(text.isNull(), None).when(refused & (n >= 100), "refusing-then-answering").when(refused, "refusing").when(hedge_span_ratio(text) >= 0.25, "hedging").otherwise("definitive")
    return F.struct(kind.alias("kind"), sure.alias("confidence"))


def blank(text: Column) -> Column:
    """Null, empty or only whitespace of any kind."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x{00A0}\x{200B}\x{3000}]", "")) == 0


def looks_truncated(text: Column) -> Column:
    """Ends without terminal punctuation. A closed code fence, a boxed answer and a closed
    link are complete, a severed enumerator is not; the order of the clauses decides."""
    t = F.rtrim(text, F.lit(" \t\n\r\f"))
    return F.when(t.isNull() | (t == ""), False).when(t.rlike(r"(^|\n)[ \t]*[0-9]+[.)]$"), True).when(t.rlike(r"```$"), False).when(t.rlike(r"\\boxed\{[^{}]*\}\$?$"), False).when(
        t.rlike(r"\]\([^()]*\)$"), False).otherwise(~t.rlike(r"[.!?。！？][\"'”’»)*_\]]*$"))


def truncated(text: Column, flag: Column, tokens: Column, cap: Column) -> Column:
    """The recorded flag; else tokens at the cap; else the text, if it has 50 words or has
    spent 80% of its cap (800 where none is recorded)."""
    n = word_count(text)
    spent = F.coalesce(tokens >= 0.8 * F.coalesce(cap, F.lit(800)), F.lit(False))
    return F.when(flag.isNotNull(), flag).when(F.coalesce(tokens >= cap, F.lit(False)), True).otherwise(((n >= 50) | spent) & looks_truncated(F.coalesce(text, F.lit(""))))


def sanitise(name: Column) -> Column:
    """A name with everything but letters, digits, dot and dash as underscores."""
    return F.regexp_replace(name, "[^A-Za-z0-9.-]", "_")


#: Named entities that folding reads as characters.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#039;": "'", "&rsquo;": "'", "&lsquo;": "'", "&ldquo;": '"', "&rdquo;": '"', "&ndash;": "-", "&mdash;": "-", "&hellip;": "...", "&amp;": "&"}


def fold_words(text: Column) -> Column:
    """Lower-case words; entities read as their characters, punctuation folded to spaces."""
    t = F.coalesce(text, F.lit(""))
    for k, v in ENTITIES.items():
        t = F.replace(t, F.lit(k), F.lit(v))
    # the strict ss form is how case folding reads a sharp s
    low = F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))
    return F.filter(F.split(F.regexp_replace(low, r"[^\p{L}\p{N}_]+", " "), " "), lambda x: x != "")


def strip_accents(text: Column) -> Column:
    """Common Latin letters without their marks (the folding variant that ignores accents)."""
    return F.translate(text, "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def windows(words: Column, size: int, both: bool = False) -> Column:
    """Every run of ``size`` words as text, with ``both`` also every run of one word less; the
    whole text if it is shorter, none if it is empty.

    The words are bound once; naming them in the lambda would split the text anew for each run.
    """

    def runs(w: Column) -> Column:
        n = F.size(w)
        out = None
        for k in (size, max(1, size - 1)) if both else (size,):
            part = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))  # noqa: B023
            out = part if out is None else F.concat(out, part)
        return F.when(n == 0, F.array().cast("array<string>")).when(n < size, F.array(F.array_join(w, " "))).otherwise(out)

    return F.flatten(F.transform(F.array(words), runs))


def fingerprint(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word arrays as sets; 1 if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / u)


def extract_score(reply: Column) -> Column:
    """A judge's score 1 to 5 from its reply: JSON, fenced JSON, a labelled or a bare digit."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    from_json = F.get_json_object(reply, "$.score").cast("int")
    from_fence = F.get_json_object(F.when(fenced != "", fenced), "$.score").cast("int")
    labelled = F.regexp_extract(F.lower(reply), r"(?:score|rating)\s*[:=is]*\s*([1-5])\b", 1)
    bare = F.regexp_extract(reply, r"^\s*([1-5])\s*(?:\n|$)", 1)
    got = F.coalesce(from_json, from_fence, F.when(labelled != "", labelled).cast("int"), F.when(bare != "", bare).cast("int"))
    return F.when(got.between(1, 5), got)


def _diffs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, old, new in zip(b["id"], b["old"], b["new"], strict=True):
            x, y = (old or "").split(), (new or "").split()
            for k, (op, a, z, c, e) in enumerate(o for o in SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if o[0] != "equal"):
                rows.append((i, k, op, " ".join(x[a:z]), " ".join(y[c:e])))
        yield pd.DataFrame(rows, columns=["id", "span", "kind", "gone", "come"])


def word_diffs(pairs: DataFrame) -> DataFrame:
    """(id, span, kind, gone, come): the spans of words that two texts (id, old, new) do not
    share; a null reads as empty."""
    return pairs.mapInPandas(_diffs, f"id {dict(pairs.dtypes)['id']}, span bigint, kind string, gone string, come string")
