"""Text expressions: cleaning, normal forms, titles, search addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of questions that are dropped, domains of the search
# addresses, and accented spellings.
NEGATIVE_PATTERNS = (
    " en wikipedia$", " la wikipedia$", " de wikipedia$", " letra$", " acordes$", " karaoke$", " meme$", r"\.com$",
    " traductor$", " traducir$", "^http", "^www", " em ", "^em ", " o que ", "^o que ", "ã", " é ", " com ",
    "(?<!bar)ç", " tem ", " nao ", " fazer ",
)
DOMAINS = {
    "mx": "com.mx", "us": "com", "co": "com.co", "es": "es", "ar": "com.ar", "pe": "com.pe", "ve": "co.ve", "cl": "cl",
    "gt": "com.gt", "ec": "com.ec", "cu": "com.cu", "bo": "com.bo", "do": "com.do", "hn": "hn", "sv": "com.sv",
    "py": "com.py", "ni": "com.ni", "cr": "co.cr", "pa": "com.pa", "pr": "com.pr", "uy": "com.uy", "general": "com",
}
ACCENTED = {
    "que": "qué", "cual": "cuál", "quien": "quién", "cuanto": "cuánto", "cuanta": "cuánta", "cuando": "cuándo",
    "donde": "dónde", "como": "cómo", "segun": "según",
}

#: Latin letters with marks and the plain ones; ``ñ`` last, for forms that keep it.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüýÿçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÝŸÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyycAAAAAAEEEEIIIIOOOOOUUUUYYC"
#: Letters, numbers and underscore of any script: what ``\w`` means to the rules.
WORD = r"\p{L}\p{N}_"


def unaccent(text: Column, keep_enie: bool = False) -> Column:
    """Latin letters without their marks. keep_enie: ``ñ`` stays."""
    marked, plain = (MARKED, PLAIN) if keep_enie else (MARKED + "ñÑ", PLAIN + "nN")
    return F.translate(text, marked, plain)


def words(text: Column) -> Column:
    """The words of a text, separated by white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Single spaces and one."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def without_opening_marks(question: Column) -> Column:
    return F.translate(question, "¿", "")


def has_three_words(question: Column) -> Column:
    return word_count(question) > 2


def is_unwanted(lowered: Column) -> Column:
    """Ends, starts or holds what marks a question of another site or language."""
    return lowered.rlike("|".join(NEGATIVE_PATTERNS)) | lowered.rlike(rf"^([{WORD}]+ ){{0,3}}wikipedia$")


def without_site(question: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(question, " wikipedia$", ""), " brainly$", "")


def search_url(question: Column, country: Column, suffix: str = "wikipedia", lang: str = "es") -> Column:
    """The address of a search in the country's domain; the suffix is added unless the question ends in it."""
    whole = F.when(F.endswith(question, F.lit(suffix)), question).otherwise(F.concat(question, F.lit(f" {suffix}")))
    domain = F.element_at(F.create_map(*[F.lit(x) for pair in DOMAINS.items() for x in pair]), country)
    return F.concat(
        F.lit("http://www.google."), domain, F.lit("/search?q="), F.url_encode(whole), F.lit("&gl="), country, F.lit(f"&hl={lang}")
    )


def suggest_url(prefix: Column, country: Column, lang: str = "es") -> Column:
    """The address that completes a prefix."""
    domain = F.element_at(F.create_map(*[F.lit(x) for pair in DOMAINS.items() for x in pair]), country)
    return F.concat(
        F.lit("http://www.google."), domain, F.lit("/complete/search?client=chrome&q="), F.url_encode(prefix), F.lit("&gl="), country,
        F.lit(f"&hl={lang}"),
    )


def clean_passage(text: Column) -> Column:
    """Redirect marks and white space to single spaces, trimmed."""
    plain = F.replace(text, F.lit("#REDIRECCIÓN"), F.lit(" "))
    return F.trim(F.regexp_replace(plain, r"[\s  -     　]+", " "))


def spaced_namespace(title: Column) -> Column:
    """A space after the colon of the namespaces Portal and Anexo."""
    return F.regexp_replace(title, "^(Portal|Anexo):", "$1: ")


def article_title(url: Column) -> Column:
    """The title of an article from its address."""
    raw = F.substring_index(F.substring_index(url, "wiki/", -1), "#", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    title = spaced_namespace(F.replace(decoded, F.lit("_"), F.lit(" ")))
    return F.when(F.startswith(title, F.lit("Portal:")), F.substring_index(title, "/", 1)).otherwise(title)


def portal_key(title: Column) -> Column:
    """What titles of a portal's pages have in common."""
    return F.when(F.startswith(title, F.lit("Portal:")), F.substring_index(title, "/", 1)).otherwise(title)


def article_id(docid: Column) -> Column:
    return F.substring_index(docid, "#", 1)


def first_words(text: Column, n: int) -> Column:
    """The first n words, by single spaces."""
    return F.trim(F.substring_index(text, " ", n))


def shortened(text: Column, most: int = 30) -> Column:
    """The first words, and a mark where more follow."""
    parts = F.split(text, r"\s+")
    return F.when(F.size(parts) > most, F.concat(F.concat_ws(" ", F.slice(parts, 1, most)), F.lit(" [...]"))).otherwise(text)


def joined_fields(*fields: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(f"{prefix} " if prefix else ""), F.concat_ws(". ", *fields))


def normal_keep_enie(text: Column) -> Column:
    """Lower case, no punctuation, no accents but ``ñ``."""
    return unaccent(F.regexp_replace(F.lower(text), rf"[^{WORD}\s]", ""), keep_enie=True)


def normal_ascii(text: Column) -> Column:
    """Lower case, no ASCII punctuation nor opening marks, no accents, single spaces, trimmed."""
    plain = unaccent(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~¿¡]", ""))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def normal_word(text: Column) -> Column:
    """Lower case, no punctuation, no accents."""
    return unaccent(F.regexp_replace(F.lower(text), rf"[^{WORD}\s]", ""))


def latex_safe(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"\\{c}")), "_&%", text)


def topic_label(name: Column, count: Column, percent: Column) -> Column:
    """The words of ``n_word_word`` with count and share."""
    return F.concat(
        F.replace(F.regexp_replace(name, "^-?[0-9]+_", ""), F.lit("_"), F.lit(", ")),
        F.lit(" n="), F.format_number(count, 0), F.lit(" ("), F.format_number(percent, 1), F.lit("%)"),
    )


def after_delimiter(text: Column, delimiter: str) -> Column:
    """What follows a delimiter that occurs once; null if nothing does."""
    parts = F.split(text, F.concat(F.lit("\\Q"), F.lit(delimiter), F.lit("\\E")))
    return F.when((F.size(parts) == 2) & (F.length(F.element_at(parts, -1)) > 0), F.element_at(parts, -1))


def modular_slice(values: Column, offset: Column, n: int) -> Column:
    """n elements from an offset on, around the end."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(values, ((offset + i) % F.size(values) + 1).cast("int")))


def chunks(values: Column, size: int) -> Column:
    """A flat array in parts of a size."""
    starts = F.sequence(F.lit(0), F.ceil(F.size(values) / size).cast("int") - 1)
    return F.when(F.size(values) == 0, F.array().cast("array<array<string>>")).otherwise(
        F.transform(starts, lambda i: F.slice(values, i * size + 1, F.lit(size)))
    )
