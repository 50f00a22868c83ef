"""Cleaning of caption text, word functions and log messages.

Letters, word edges and white space are Unicode's, as in ``(?U)`` of Java's expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueflow.functions.times import let, strip

# Speaker names, fillers, openers and language codes that right results depend on.
SPEAKER = r"[A-Z][A-Za-z.'-]{1,24}(?:(?U:\s)[A-Z][A-Za-z.'-]{1,24}){0,2}(?U:\s)*:"
INTERJECTIONS = ("uh", "um", "erm", "hmm", "ah")
CONTEXTUAL_FILLERS = ("you know", "i mean", "well", "basically", "actually", "like")
OPENERS = {
    "obviously": "Tất nhiên",
    "of course": "Tất nhiên",
    "clearly": "Rõ ràng là",
    "honestly": "Thật ra",
    "frankly": "Thẳng thắn mà nói",
    "to be fair": "Công bằng mà nói",
    "in fact": "Thực ra",
    "look": "Này",
}
LANGUAGE_ALIASES = {"zh-Hans": "zh-CN", "zh-Hant": "zh-TW", "zh-CN": "zh-CN", "zh-TW": "zh-TW", "zh": "zh-CN"}

_LONGEST_FIRST = "|".join(sorted(CONTEXTUAL_FILLERS, key=len, reverse=True))
# A look at the first character spares most places the dearer tests behind it.
_FIRST = "".join(sorted({w[0] for w in INTERJECTIONS}))
_INTERJECTION = rf"(?iU)(?=[\s{_FIRST}])\s*(?=[{_FIRST}])\b(?:{'|'.join(INTERJECTIONS)})\b\s*,?\s*"
_STARTING = rf"(?iU)(?:^|(?=\s)(?<=[.!?])\s+)(?:{_LONGEST_FIRST})\s*,\s*"
_ENCLOSED = rf"(?iU),\s*(?:{_LONGEST_FIRST})\s*,"
_OPENER = rf"(?iU)^\s*({'|'.join(sorted(OPENERS, key=len, reverse=True))})\s*,\s*"


def words(text: Column) -> Column:
    """The words between white space; no empty ones."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def _stripped(text: Column) -> Column:
    """``strip``, but a text is only searched if white space stands at one of its ends."""
    ends = lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
    return let(text, lambda t: F.when(ends(t).rlike(r"(?U)\s"), strip(t)).otherwise(t))


def single_spaced(text: Column) -> Column:
    """White space is one blank each, none at the ends; single blanks are left as they are."""
    return _stripped(F.regexp_replace(text, r"(?U) \s++|[^\S ]\s*+", " "))


def strip_tags(text: Column) -> Column:
    """Without ``<...>`` and with single blanks."""
    return single_spaced(F.regexp_replace(text, r"<[^>]+>", ""))


def strip_speaker_markers(text: Column) -> Column:
    """Without ``>>`` and the speaker names behind it; a piece that is only a name goes."""

    def content(piece: Column) -> Column:
        bare = piece.rlike(rf"^{SPEAKER}(?U:\s)*$")
        return F.when(bare, "").otherwise(_stripped(F.regexp_replace(piece, rf"^{SPEAKER}(?U:\s)+", "")))

    pieces = F.transform(F.transform(F.split(text, ">>+"), _stripped), content)
    return F.array_join(F.filter(pieces, lambda p: p != ""), " ")


def capitalize_first(text: Column) -> Column:
    """The first letter in upper case, if only blanks stand before it."""

    def raised(t: Column) -> Column:
        at = F.length(F.regexp_extract(t, r"^[ \t]*", 0))
        opens = t.rlike(r"^[ \t]*\p{L}")
        return F.when(opens, F.concat(F.substring(t, F.lit(1), at), F.upper(F.substring(t, at + 1, F.lit(1))), F.substring(t, at + 2, F.length(t)))).otherwise(t)

    return let(text, raised)


def _counted(text: Column, removed: Column) -> Column:
    return F.struct(text.alias("text"), removed.cast("int").alias("removed"))


def _without(state: Column, pattern: str, replacement: str, opening: bool) -> Column:
    """A struct(text, removed) with the pattern replaced; ``opening``: a new start is capitalised."""

    def step(s: Column) -> Column:
        cleaned = F.regexp_replace(s["text"], pattern, replacement)
        if opening:
            cleaned = F.when(s["text"].rlike("^" + pattern), capitalize_first(cleaned)).otherwise(cleaned)
        # Most texts hold none: they are looked through once.
        return F.when(s["text"].rlike(pattern), _counted(cleaned, s["removed"] + F.regexp_count(s["text"], F.lit(pattern)))).otherwise(s)

    return let(state, step)


def remove_fillers(text: Column) -> Column:
    """struct(text, removed): interjections anywhere, filler phrases where commas set them off."""
    state = _without(_counted(text, F.lit(0)), _INTERJECTION, " ", True)
    state = _without(_without(state, _STARTING, "", True), _ENCLOSED, " ", False)

    def tidied(s: Column) -> Column:
        out = s["text"]
        for pattern, to in ((r"(?U)\s++,", ","), (r"(?U),\s*+,", ","), (r"(?U)^\s*+,\s*+", "")):
            out = F.regexp_replace(out, pattern, to)
        return _counted(single_spaced(F.when(F.contains(s["text"], F.lit(",")), out).otherwise(s["text"])), s["removed"])

    return let(state, tidied)


def repeat_pattern(n: int) -> str:
    """A phrase of n words that repeats at once, with or without commas between.

    Words and white space are taken as wholes: giving back a part of them never helps.
    """
    return rf"(?iU)\b(\w++(?:\s++\w++){{{n - 1}}})(?:,?\s++\1\b)++"


#: A word that comes again as one of the next three: in every repeat of phrases of up to three words the first one does.
_RECURRING = r"(?iU)\b(\w++)(?:,?\s++\w++){0,2}?,?\s++\1\b"


def _collapsed(state: Column, n: int) -> Column:
    """A struct(text, removed) with the repeats of n-word phrases collapsed.

    Every copy that goes takes its n words with it.
    """
    count = lambda t: F.regexp_count(t, F.lit(r"(?U)\w+"))
    pair = lambda s: F.struct(s["text"].alias("text"), s["removed"].alias("removed"), F.regexp_replace(s["text"], repeat_pattern(n), "$1").alias("new"))
    same = lambda s: _counted(s["new"], s["removed"] + F.when(s["new"] == s["text"], 0).otherwise(F.floor((count(s["text"]) - count(s["new"])) / n)))
    return let(state, lambda s: F.when(s["text"].rlike(repeat_pattern(n)), let(pair(s), same)).otherwise(s))


def dedupe_repeats(text: Column) -> Column:
    """struct(text, removed): immediate repeats of three-, two- and one-word phrases, in two passes.

    Most texts have no word that recurs so soon, which one search tells; what the first pass leaves as it is needs no second.
    """

    def passed(state: Column) -> Column:
        for n in (3, 2, 1):
            state = _collapsed(state, n)
        return state

    def again(s: Column) -> Column:
        return let(passed(s), lambda once: F.when(once["removed"] == s["removed"], once).otherwise(passed(once)))

    state = let(_counted(text, F.lit(0)), lambda s: F.when(s["text"].rlike(_RECURRING), again(s)).otherwise(s))
    return let(state, lambda s: _counted(single_spaced(s["text"]), s["removed"]))


def clean_cue(text: Column) -> Column:
    """struct(text, filler_removed, repetitions_removed, dropped)."""

    def cleaned(fillers: Column) -> Column:
        result = lambda r: F.struct(r["text"].alias("text"), fillers["removed"].alias("filler_removed"), r["removed"].alias("repetitions_removed"), (r["text"] == "").alias("dropped"))
        return let(dedupe_repeats(fillers["text"]), result)

    return let(remove_fillers(strip_speaker_markers(text)), cleaned)


def opener(text: Column) -> Column:
    """The set phrase for the opener that a text starts with; null if it starts with none."""
    table = F.create_map(*[F.lit(x) for pair in OPENERS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(text, _OPENER, 1)))


def without_opener(text: Column) -> Column:
    return F.when(opener(text).isNotNull(), F.regexp_replace(text, _OPENER, "")).otherwise(text)


def apply_opener(phrase: Column, rest: Column) -> Column:
    """``phrase, rest`` with the rest's first letter lowered; ``phrase.`` if there is no rest."""
    body = strip(rest)
    joined = F.concat(phrase, F.lit(", "), F.lower(F.substring(body, 1, 1)), F.substring(body, F.lit(2), F.length(body)))
    return F.when(phrase.isNull(), rest).when(body == "", F.concat(phrase, F.lit("."))).otherwise(joined)


def language_code(lang: Column) -> Column:
    """The code that translation expects: fixed aliases, Simplified Chinese for other ``zh`` codes."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_ALIASES.items() for x in pair])
    own = F.try_element_at(table, lang)
    script = F.try_element_at(table, F.element_at(F.split(lang, "-"), 1))
    return F.coalesce(own, F.when(lang.startswith("zh"), F.coalesce(script, F.lit("zh-CN"))), lang)


def clean_log_message(text: Column) -> Column:
    """Without colour codes, and with one ``ERROR:`` where there were several."""
    plain = strip(F.regexp_replace(text, r"\x1b\[[0-9;]*m", ""))
    return F.regexp_replace(plain, r"(?i)^(?:ERROR:\s*)+", "ERROR: ")
