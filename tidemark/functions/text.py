"""Text normalisation, masking, tokens and lexicon counts as column expressions."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Contractions in the order in which they are replaced.
CONTRACTIONS = {"won't": "will not", "can't": "cannot", "n't": " not", "'re": " are", "'s": " is", "'d": " would", "'ll": " will", "'ve": " have", "'m": " am", "shan't": "shall not", "let's": "let us"}
# Words that negate or direct and are kept when stop words go.
KEEP_WORDS = ("not", "no", "nor", "never", "none", "cannot", "without", "against", "down", "up", "over", "under", "above", "below", "off", "out", "more", "less", "few", "most", "very", "too")
#: Common English function words.
STOP_WORDS = tuple(
    "a about after again all also am an and any are as at be because been before being between both but by can could did do does doing during each for from further had has have having he her here hers him his how i if in into is it its itself just me my of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your not no nor more most few above below down against".split()
)
# Names and their aliases.
ALIASES = {
    "UNITED_STATES": ("u.s.", "u.s", "us", "usa", "united states", "america", "washington", "white house", "biden administration", "trump administration"),
    "CHINA": ("china", "prc", "beijing", "chinese government"),
    "RUSSIA": ("russia", "moscow", "kremlin", "russian federation"),
    "EUROZONE": ("eu", "european union", "brussels", "eurozone", "euro area"),
    "FED": ("fed", "federal reserve", "fomc", "us central bank"),
    "ECB": ("ecb", "european central bank"),
}
# Suffix rules of the lemmatiser, the first that fits.
SUFFIXES = (("ies", "y"), ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("ing", ""), ("ed", ""), ("s", ""))
# Patterns of outlet suffixes, addresses, tags and numbers.
OUTLET = r"\s*[\-–—|·]\s*[A-Z][\w .&'’]{2,30}\s*$"
OUTLET_OR_COLON = r"\s*[\-–—|·:]\s*[A-Z][\w .&'’]{2,30}\s*$"
URL = r"https?://\S+|www\.\S+"
TAG = r"<[^>]+>"
PCT = r"(?i)\b\d+(?:[.,]\d+)?\s*(?:%|(?:percent|per cent|pct)\b)"
MONEY = r"(?i)[$€£¥₹]\s?\d[\d.,]*\s?(?:bn|billion|mn|million|trillion|tn|k)?"
NUM = r"\b\d[\d.,]*\b"
# Tracking parameters of addresses, the title in a page, and file endings of addresses.
TRACKING = "[?&](utm_[^=&]+|fbclid|gclid|ref|src|amp)=[^&]*"
PAGE_TITLE = r"(?is)<title>(.*?)</title>"
ENDINGS = (".html", ".htm", ".shtml", ".php", ".aspx", ".asp", ".cms")


@F.pandas_udf(T.StringType())
def unicode_repair(text: pd.Series) -> pd.Series:
    """HTML entities resolved, NFKC, typographic quotes and dashes to ASCII; null to empty. Spark has no such functions."""
    plain = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."})
    return text.map(lambda t: unicodedata.normalize("NFKC", html.unescape(t)).translate(plain) if isinstance(t, str) else "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_boilerplate(text: Column) -> Column:
    """Tags and addresses to spaces, outlet suffix off, white space collapsed."""
    out = F.regexp_replace(F.regexp_replace(text, TAG, " "), URL, " ")
    return collapse(F.regexp_replace(out, OUTLET, ""))


def normal_title(title: Column) -> Column:
    """Title as it is compared: outlet suffix off, lower case, letters and digits only; null to empty."""
    out = F.lower(F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), OUTLET_OR_COLON, ""))
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[^a-z0-9 ]+", " "), r"\s+", " "))


def canonical_url(url: Column) -> Column:
    """Address without fragment and tracking parameters, lower case; null to empty."""
    out = F.split_part(F.coalesce(url, F.lit("")), F.lit("#"), F.lit(1))
    out = F.regexp_replace(out, TRACKING, "")
    return F.lower(F.regexp_replace(out, "[?&/]+$", ""))


def terms_pattern(terms: Iterable[str]) -> str:
    """Case-insensitive alternation at word boundaries, longest first; without terms it never matches."""
    own = sorted({t.strip().lower() for t in terms if t.strip()}, key=lambda t: (-len(t), t))
    return r"(?i)\b(?:" + "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in own) + r")\b" if own else r"[^\s\S]"


def mentions(text: Column, terms: Iterable[str]) -> Column:
    return F.coalesce(text, F.lit("")).rlike(terms_pattern(terms))


def canonical_names(text: Column, aliases: dict[str, tuple[str, ...]] = ALIASES) -> Column:
    """Aliases to their names: all aliases, the longest pattern first, white space of any width between words."""
    pairs = [(re.sub(r"([^\w\s])", r"\\\1", a).replace(" ", r"\s+"), name) for name, own in aliases.items() for a in own]
    for pattern, name in sorted(pairs, key=lambda p: -len(p[0])):
        edge = r"(?!\w)" if pattern.endswith(r"\.") else r"\b"
        text = F.regexp_replace(text, rf"(?i)\b{pattern}{edge}", name)
    return text


def expand_contractions(text: Column) -> Column:
    for short, full in CONTRACTIONS.items():
        text = F.regexp_replace(text, f"(?i){short}", full)
    return text


def mask_numbers(text: Column) -> Column:
    for pattern, name in ((PCT, " <PCT> "), (MONEY, " <MONEY> "), (NUM, " <NUM> ")):
        text = F.regexp_replace(text, pattern, name)
    return text


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\w\s<>]", " ")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def drop_stop_words(words: Column, keep: Iterable[str] = KEEP_WORDS) -> Column:
    stop = sorted(set(STOP_WORDS) - set(keep))
    return F.filter(words, lambda w: ~w.isin(stop))


def lemma(word: Column) -> Column:
    """Suffix rules: the first that leaves more than two letters of stem; placeholders stay."""
    out = F.when(word.startswith("<"), word)
    for suffix, new in SUFFIXES:
        stem = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        out = out.when((F.length(word) > len(suffix) + 2) & word.endswith(suffix), F.concat(stem, F.lit(new)))
    return out.otherwise(word)


def track_a(text: Column, least: int = 3) -> Column:
    """Bag-of-words text: stripped, names canonical, contractions open, numbers masked, then lower case, stop words out, lemmas; short texts empty."""
    out = mask_numbers(expand_contractions(canonical_names(strip_boilerplate(text))))
    words = tokens(strip_punctuation(F.lower(out)))
    words = F.filter(F.transform(drop_stop_words(words), lemma), lambda w: F.length(w) > 1)
    return F.when(F.size(words) >= least, F.array_join(words, " ")).otherwise("")


def track_b(text: Column, most: int = 128) -> Column:
    """Text for encoders: stripped, case kept, at most ``most`` words."""
    return F.array_join(F.slice(tokens(strip_boilerplate(text)), 1, most), " ")


def n_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def lexicon_count(words: Column, lexicon: Iterable[str]) -> Column:
    """How many of the words, repeats included, are in a short lexicon."""
    own = sorted(lexicon)
    return F.size(F.filter(words, lambda w: w.isin(own)))


def ngrams(words: Column, n: int) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def page_title(page: Column) -> Column:
    """Text between the title tags, trimmed; null where there is none."""
    return F.nullif(F.trim(F.regexp_extract(page, PAGE_TITLE, 1)), F.lit(""))


def slug_title(url: Column, least: int = 4) -> Column:
    """Words of the path segment with most words of letters, of any script, the first of equals; null below ``least`` words."""
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    path = F.regexp_replace(path, ";[^/]*$", "")
    ending = "(" + "|".join(e.replace(".", r"\.") for e in ENDINGS) + ")$"
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, ending, ""))
    words = F.transform(segments, lambda s: F.filter(F.split(s, "[-_+]"), lambda w: w.rlike(r"^\p{L}+$")))
    best = F.aggregate(words, F.array().cast("array<string>"), lambda a, w: F.when(F.size(w) > F.size(a), w).otherwise(a))
    return F.when(F.size(best) >= least, F.array_join(best, " "))


def theme_tokens(v1: Column, v2: Column) -> Column:
    """Exact theme codes of both theme fields: ``A;B`` and ``A,offset;B,offset``."""
    own = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda t: t != "")
    return F.array_union(own(v1), F.transform(own(v2), lambda t: F.split_part(t, F.lit(","), F.lit(1))))


def first_double(field: Column) -> Column:
    return F.split_part(field, F.lit(","), F.lit(1)).try_cast("double")
