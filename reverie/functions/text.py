"""Column expressions over names, tags and contents."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words whose last s is no plural.
UNINFLECTED = ("alias", "atlas", "bias", "business", "canvas", "chaos", "gas", "mathematics", "news", "physics", "series", "species", "status")

# Words of a fact that say nothing about whom it is about.
CONTEXT_STOPWORDS = (
    "about", "after", "again", "also", "and", "are", "been", "before", "being", "but", "can", "does", "existing", "fact", "for", "from",
    "had", "has", "have", "into", "its", "new", "not", "person", "same", "that", "the", "their", "them", "then", "they", "this", "user",
    "was", "were", "with", "work", "works", "would",
)

# What a bare date, link, filler, greeting or amount looks like.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|januar|februar|märz|mai|juni|juli|oktober|dezember"
DATE = rf"^((19|20)\d{{2}}([-/.]\d{{1,2}}([-/.]\d{{1,2}})?)?|({MONTHS})\s+(19|20)\d{{2}}|(19|20)\d{{2}}\s*[-–—]\s*(19|20)\d{{2}})$"
LINK = r"://|^www\.|^[^@\s]+@[^@\s]+\.[^@\s]+$"
FILLER = r"^([\[\](){}<>._\-\s]*|\[.*\])$"
GREETINGS = r"^(sehr geehrte|dear sir|dear madam|mit freundlichen grüßen|best regards|kind regards)"
UNITS = "gb|tb|mb|kb|ram|gpu|cpu|ghz|mhz|cores|eur|usd|kg|km|mg|ml|kpa|kwh|kw|watt|%"

WORDS = r"[\p{L}\p{N}]+"
QUERY_WORDS = 32


def normal(c: Column) -> Column:
    """Names and tags compare trimmed and in lower case."""
    return F.lower(F.trim(c))


def words(c: Column) -> Column:
    """Words of the lower-cased text: letters and digits of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORDS), F.lit(0))


@lru_cache(maxsize=1)
def _plain_letters() -> tuple[str, str]:
    """Letters that are a base letter with marks, and these base letters, by Unicode's decomposition."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in range(0xC0, 0x2000)]
    marked = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:])]
    return "".join(c for c, _ in marked), "".join(d for _, d in marked)


def folded(c: Column) -> Column:
    """Lower case without diacritics; a text in plain letters is spared the look at each of them."""
    low = F.lower(c)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(low, *_plain_letters()), r"\p{Mn}", "")).otherwise(low)


def index_words(c: Column) -> Column:
    """The words under which a text is found: letters and digits of any script, without case and diacritics."""
    return F.regexp_extract_all(folded(c), F.lit(WORDS), F.lit(0))


@lru_cache(maxsize=1)
def _foldings() -> tuple[dict[str, str], str, str]:
    """Case folding beyond lower case, from Unicode's own: letters that become several, and those that become another one."""
    beyond = [(chr(i), chr(i).casefold()) for i in range(0x80, 0x10000) if chr(i).lower() == chr(i) != chr(i).casefold()]
    single = [(c, d) for c, d in beyond if len(d) == 1]
    return {c: d for c, d in beyond if len(d) > 1}, "".join(c for c, _ in single), "".join(d for _, d in single)


def casefolded(c: Column) -> Column:
    """Lower case in which also letters without a lower form of their own agree, as in "straße" and "STRASSE"."""
    several, one, other = _foldings()
    low = F.translate(F.lower(c), one, other)
    wide = low
    for letter, letters in several.items():
        wide = F.replace(wide, F.lit(letter), F.lit(letters))
    return F.when(low.rlike("[" + "".join(several) + "]"), wide).otherwise(low)


def restated(c: Column) -> Column:
    """Equal for texts that differ in case and marks alone."""
    return F.array_join(F.regexp_extract_all(casefolded(F.coalesce(c, F.lit(""))), F.lit(WORDS), F.lit(0)), " ")


def loosely(c: Column) -> Column:
    """As restated, but underscores count as letters: the form in which new facts are compared to old."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def query_words(query: Column) -> Column:
    """The words a search reads: the first of them, repeats kept."""
    return F.slice(words(query), 1, QUERY_WORDS)


def singular(word: Column) -> Column:
    short = (F.length(word) <= 3) | word.isin(*UNINFLECTED)
    return (
        F.when(short, word)
        .when(word.endswith("ies"), F.concat(word.substr(F.lit(1), F.length(word) - 3), F.lit("y")))
        .when(word.rlike("(ch|sh|ss|x|z)es$"), word.substr(F.lit(1), F.length(word) - 2))
        .when(word.rlike("s$") & ~word.rlike("(ss|us|is)$"), word.substr(F.lit(1), F.length(word) - 1))
        .otherwise(word)
    )


def tag_key(tag: Column) -> Column:
    """Equal for tags that differ in case, separators or a plural alone; empty for tags without words."""
    parts = F.filter(F.split(normal(tag), r"[-_\s]+"), lambda w: w != "")
    n = F.size(parts)
    ends = F.array_append(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), singular(F.element_at(parts, -1)))
    return F.when(n > 0, F.array_join(ends, " ")).otherwise("")


def stem(word: Column) -> Column:
    cut = lambda n: word.substr(F.lit(1), F.length(word) - n)
    doubled = (F.length(word) > 6) & (word.substr(F.length(word) - 3, F.lit(1)) == word.substr(F.length(word) - 4, F.lit(1)))
    return (
        F.when((F.length(word) > 6) & word.endswith("ing"), F.when(doubled, cut(4)).otherwise(cut(3)))
        .when((F.length(word) > 5) & word.endswith("ied"), F.concat(cut(3), F.lit("y")))
        .when((F.length(word) > 5) & word.endswith("ed"), cut(2))
        .when((F.length(word) > 5) & word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((F.length(word) > 4) & word.endswith("s") & ~word.endswith("ss") & ~word.endswith("us"), cut(1))
        .otherwise(word)
    )


def told_words(facts: Column) -> Column:
    """word, stem of the distinct telling words of facts."""
    stopped = lambda w: w.isin(*CONTEXT_STOPWORDS)
    telling = F.filter(F.array_distinct(words(F.coalesce(facts, F.lit("")))), lambda w: (F.length(w) >= 3) & ~stopped(w))
    stems = F.transform(telling, lambda w: F.struct(w.alias("word"), stem(w).alias("stem")))
    return F.filter(stems, lambda x: (F.length(x["stem"]) >= 3) & ~stopped(x["stem"]))


def beside_name(told: Column, name: Column) -> Column:
    """The distinct stems of told words without the name's own words."""
    own = words(F.coalesce(name, F.lit("")))
    return F.array_distinct(F.transform(F.filter(told, lambda x: ~F.array_contains(own, x["word"])), lambda x: x["stem"]))


def context_words(facts: Column, name: Column) -> Column:
    """Distinct stems of the telling words of facts, without the name's own words."""
    return beside_name(told_words(facts), name)


def no_referent(name: Column) -> Column:
    """Why a name cannot be an entity; null where it may be one."""
    text = F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")))
    parts = F.filter(F.split(F.translate(text, "/", " "), " +"), lambda w: w != "")
    amount = F.get(parts, F.lit(0)).rlike(r"^[^a-zäöüß]*\d") & F.forall(parts, lambda w: w.rlike(rf"^([\d\P{{L}}]+|{UNITS})$") & ~w.rlike("_"))
    return (
        F.when(text == "", "empty")
        .when(text.rlike(DATE), "date")
        .when(text.rlike(LINK), "link")
        .when(text.rlike(FILLER), "filler")
        .when(text.rlike(GREETINGS), "greeting")
        .when((F.size(parts) > 0) & amount, "amount")
    )


def mentions(text: Column, alias: Column) -> Column:
    """Whether text has alias as a whole word, whatever the case."""
    quoted = F.regexp_replace(F.lower(alias), r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    return F.regexp_like(F.lower(text), F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted, F.lit(r"(?![\p{L}\p{N}_])")))


def bounded_words(text: Column, most_words: int = 300, most_chars: int = 1200) -> Column:
    """The first words, cut at a word so that the text stays within most_chars."""
    parts = F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), 1, most_words)
    whole = F.array_join(parts, " ")
    return F.when(F.length(whole) <= most_chars, whole).otherwise(F.regexp_replace(F.substring(whole, 1, most_chars), r"\s*\S*$", ""))
