"""Text normalization, counting and hashing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, written out because the regex dialects disagree about \s.
WS = r"[ \t\n\r\f\x0B]"
WS_CHARS = " \t\n\r\f\x0b"
WORD = r"[\p{L}\p{N}_]+"

# Lines that open a signature (matched whole, any case).
SIGNATURE_LINES = [
    r"--[ \t]*",
    "best regards,?",
    "sincerely,?",
    "thanks,?",
    "regards,?",
    "yours truly,?",
    "kind regards,?",
    "cheers,?",
    "get outlook for .*",
    "sent from .*",
]
# Beginnings of quoted lines (case matters).
QUOTE_STARTS = [">", "From:", "Sent:", "To:", "Subject:", "Date:"]

# Common words by language.
ENGLISH_WORDS = (
    "the and to of a in is it you that he was for on are as with his they at be this have from or one had by word but not what all were we when your can said "
    "there use an each which she do how their if up out many then them these so some her would make like into him time two more go no way could my than first "
    "been call who its now find long down day did get come made may part"
).split()
SPANISH_WORDS = (
    "el la de que y a en un es se no te lo le da su por son con para al del como más o pero sus me hasta hay donde han quien están estado desde todo nos durante "
    "todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco "
    "ella estar estas algunas algo nosotros"
).split()
FRENCH_WORDS = (
    "le de un à être et en avoir ne je son que se qui ce il pas sur faire plus dire me du tout pouvoir autre on devoir même prendre nous comme leur dans bien "
    "elle si par y encore grand peu mon meilleur donner bon monde regarder alors venir comprendre notre deux depuis parfait lire cela jamais aussi quand très "
    "toujours peut attendre partir joli bonheur semble surtout nouveau côté continuer début guère trop tôt vouloir demander trois"
).split()
# Words that carry no meaning for duplicate detection.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was will with this but they have had what said each which she do how their if up "
    "out many then them these so some her would make like into him time two more go no way could my than first been call who now find long down day did get come "
    "made may part over new sound take only little work know place year live me back give most very after thing our just name good sentence man think say great "
    "where help through much before line right too mean old any same tell boy follow came want show also around form three small set put end does another well "
    "large must big even such because turn here why ask went men read need land different home us move try kind hand picture again change off play spell air "
    "away animal house point page letter mother answer found study still learn should world"
).split()


def word_list(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def strip(c: Column) -> Column:
    """Without white space at either end.  No pattern: that would try every run of white space up to the end."""
    return F.btrim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return strip(F.regexp_replace(c, rf"{WS}+", " "))


def normalize_plain(c: Column) -> Column:
    """Line ends to \\n, blanks and tabs collapsed, blank lines to one empty line, stripped."""
    for old, new in (("\r\n", "\n"), ("\r", "\n"), ("\t", " ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.regexp_replace(c, " {2,}", " ")  # single blanks stay as they are
    c = F.regexp_replace(c, rf"\n{WS}*\n", "\n\n")
    return strip(c)


def strip_tags(c: Column) -> Column:
    """Markup removed, entities blanked, white space collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"&[a-zA-Z]+;", " "))


def visible_text(c: Column) -> Column:
    """Like ``strip_tags`` after scripts and styles are cut out whole; tags become blanks."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    return collapse(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"&[a-zA-Z]+;", " "))


def _cut_line() -> str:
    """A signature or quoted line and all that follows; only \\n ends a line, and white space at its ends does not count."""
    ws = WS.replace(r"\n", "")
    lines = "|".join(SIGNATURE_LINES).replace("k", "[k\u212a]").replace("s", "[s\u017f]")  # the letters with a third case, as in SQL
    signature = f"(?i:{lines})(?<!{ws}){ws}*$"
    return rf"(?dm)^{ws}*+(?:{signature}|{'|'.join(QUOTE_STARTS)})[\s\S]*"


def strip_signature_and_quotes(c: Column) -> Column:
    """The text before its first signature or quoted line; stripped."""
    return strip(F.regexp_replace(c, _cut_line(), ""))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))


def count_words(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def _count_parts(c: Column, pattern: str) -> Column:
    return F.size(F.filter(F.split(c, pattern), lambda x: F.length(strip(x)) > 0)).cast("long")


def count_sentences(c: Column) -> Column:
    return _count_parts(c, "[.!?]+")


def count_paragraphs(c: Column) -> Column:
    return _count_parts(c, rf"\n{WS}*\n")


def estimate_tokens(c: Column) -> Column:
    """One token for four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def count_blank_separated(c: Column) -> Column:
    inner = collapse(c)
    return F.when(F.length(inner) == 0, 0).otherwise(F.size(F.split(inner, " "))).cast("long")


def detect_language(c: Column) -> Column:
    """en, es or fr by hits in the common-word lists; English must beat both others, else Spanish must beat French."""
    let = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)  # noqa: E731  # computed once, though used often
    hits = lambda w: F.array(*[F.size(F.filter(w, lambda x: x.isin(known))) for known in (ENGLISH_WORDS, SPANISH_WORDS, FRENCH_WORDS)])  # noqa: E731,B023
    found = let(words(F.lower(c)), hits)
    return let(found, lambda n: F.when((n[0] > n[1]) & (n[0] > n[2]), "en").when(n[1] > n[2], "es").when(n[2] > 0, "fr").otherwise("en"))


def features(c: Column, limit: int | None = 1000) -> Column:
    """Lower-case words of more than two letters that are no stop words, in order: the first ``limit``, or all."""
    plain = F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), rf"[^\p{{L}}\p{{N}}_ \t\n\r\f\x0B]", " ")
    w = words(F.lower(plain))
    kept = F.filter(w, lambda x: (F.length(x) > 2) & ~x.isin(STOP_WORDS))
    return kept if limit is None else F.slice(kept, 1, limit)


def snippet(c: Column, size: int) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def normalize_subject(c: Column) -> Column:
    """Lower case, one leading reply or forward mark removed, white space collapsed, punctuation dropped."""
    c = F.regexp_replace(F.lower(c), rf"^(re|fw|fwd|fyi) ?:", "")
    c = strip(F.regexp_replace(collapse(c), r"[^\p{L}\p{N}_ ]", ""))
    return F.when(c.isNull() | (F.length(c) == 0), "no_subject").otherwise(c)


def address_list(c: Column) -> Column:
    """Addresses of a header: what stands in angle brackets, or the whole part."""
    parts = F.filter(F.transform(F.split(c, ","), strip), lambda x: F.length(x) > 0)
    inside = lambda x: F.regexp_extract(x, "<(.+?)>", 1)
    return F.transform(parts, lambda x: F.when(F.length(inside(x)) > 0, inside(x)).otherwise(x))
