"""Text rules as column expressions (ASCII classes unless said otherwise)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words left out of indexes.
STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "by", "with", "as", "at", "is", "are", "be", "been", "being",
    "this", "that", "these", "those", "it", "its", "which", "such", "any", "all", "shall", "must", "may", "will", "not", "no",
    "if", "than", "then", "from", "into", "under", "over", "per", "each", "other", "including", "include", "includes", "e", "g",
    "i", "ii", "iii", "iv", "v", "who", "whom", "their", "they", "them", "we", "our", "you", "your", "he", "she", "his", "her",
]
# Suffixes taken off concept words, first that fits.
SUFFIXES = ["ations", "ization", "isation", "ments", "ment", "tions", "tion", "ings", "ing", "ies", "ers", "es", "s"]
# Characters that give away garbled text, and punctuation around words.
GARBLE = "~\\|^`�{}<>_=#*"
EDGES = ".,;:!?()[]{}'\"/-–—"
# Heading patterns.
HEADING_WORD = r"(?i)^(annex(ure)?|appendix|schedule|chapter|part|section)\b"
HEADING_NUMBER = r"^\d+(\.\d+)*\.?\s+\S"
HEADING_CAPS = r"^[A-Z][A-Z\s,&/()\-]{4,80}$"
TABLE = r"(?i)^table\s*(\d+|[ivxlcdm]+)?\s*[:\-]?\s*(.*)$"
ANNEX = r"(?i)^(?:annex(?:ure)?|appendix|schedule)\s*([ivxlcdm]+|\d+)?\s*[:\-]?\s*(.*)$"
PART = r"(?i)^(?:part|chapter)\s+([ivxlcdm]+|\d+)\s*[:\-]?\s*(.*)$"
SUBSECTION = r"^(\d+(?:\.\d+)+)\.?\s+(.*)$"
SECTION = r"^(\d+)\.?\s+(.*)$"
CLAUSE = r"^(\(?[a-zA-Z]{1,3}\)|\(?[ivxlcdm]{1,4}\)|\d+\))\s+(.*)$"
FOOTNOTE = r"(?i)^(?:note|n\.b\.)\s*[:.]?\s+(.*)$"
CITATION = r"\[([^\]\[]+?)\s+([0-9]+(?:\.[0-9]+)*)\]"
CLAUSE_NUMBER = r"^\d+(\.\d+)*$"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def present(*columns: Column | str) -> Column:
    """The first value that is neither null nor empty text."""
    return F.coalesce(*(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns))


def trim(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, longer than one, that are no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def folded(text: Column) -> Column:
    """Lower case, with the sharp s written out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def stem(token: Column) -> Column:
    """Without its first fitting suffix, if at least three letters stay; words of four letters or fewer stay whole."""
    out = F.when(F.length(token) <= 4, token)
    for suffix in SUFFIXES:
        cut = F.left(token, F.length(token) - F.lit(len(suffix)))
        out = out.when(token.endswith(suffix) & (F.length(token) >= len(suffix) + 3), F.concat(cut, F.lit("y" if suffix == "ies" else "")))
    return out.otherwise(token)


def concept_tokens(text: Column, stemmed: bool = True) -> Column:
    """Words of a concept: longer than one, stop words included, stemmed if asked for."""
    found = F.filter(F.regexp_extract_all(folded(text), F.lit("[a-z0-9]+"), 0), lambda t: F.length(t) > 1)
    return F.transform(found, stem) if stemmed else found


def tight(text: Column) -> Column:
    """Folded, trimmed, single spaces; null becomes empty."""
    return F.coalesce(F.regexp_replace(trim(folded(text)), r"(?U)\s+", " "), F.lit(""))


def loose(text: Column) -> Column:
    """As tight(), without punctuation at the end."""
    return trim(F.regexp_replace(tight(text), "[.,;:'\"]+$", ""))


def is_heading(line: Column) -> Column:
    text = trim(line)
    return F.coalesce((F.length(text) > 0) & (F.length(text) <= 100) & (text.rlike(HEADING_WORD) | text.rlike(HEADING_NUMBER) | text.rlike(HEADING_CAPS)), F.lit(False))


def classify_heading(heading: Column) -> Column:
    """struct(type, number, title, text) of a heading, or null; the first pattern that fits decides."""
    text, none = trim(heading), F.lit(None).cast("string")
    part = lambda pattern, k: F.nullif(trim(F.regexp_extract(text, pattern, k)), F.lit(""))
    make = lambda kind, number, title, own: F.struct(F.lit(kind).alias("type"), number.alias("number"), title.alias("title"), own.alias("text"))
    out = None
    for kind, pattern in (("table", TABLE), ("annex", ANNEX), ("part", PART), ("subsection", SUBSECTION), ("section", SECTION)):
        row = make(kind, part(pattern, 1), part(pattern, 2), none)
        out = F.when(text.rlike(pattern), row) if out is None else out.when(text.rlike(pattern), row)
    return out.when(text.rlike(CLAUSE), make("clause", part(CLAUSE, 1), none, trim(F.regexp_extract(text, CLAUSE, 2)))).when(text.rlike(FOOTNOTE), make("footnote", none, none, trim(F.regexp_extract(text, FOOTNOTE, 1))))


def is_clean_token(token: Column) -> Column:
    """Whether a token reads as a word or number, not as badly decoded text."""
    inside = "".join("\\" + c for c in EDGES)
    core = F.regexp_replace(token, f"^[{inside}]+|[{inside}]+$", "")
    letters = F.regexp_replace(core, r"[^\p{L}]", "")
    n_letters, n = F.length(letters), F.length(core)
    symbols = F.length(F.regexp_replace(core, r"[\p{L}\p{N}]", ""))
    garbled = (token == "") | (F.translate(token, GARBLE, "") != token) | F.contains(token, F.lit(".."))
    return (
        F.when(garbled | (n == 0), False)
        .when(n_letters == 0, core.rlike(r"\p{Nd}") & (symbols <= 2))
        .when((symbols >= 3) | (n_letters / n < 0.5), False)
        .when(n_letters == 1, core.isin("a", "A", "I", "i"))
        .when((n_letters >= 3) & ~letters.rlike("[aeiouyAEIOUY]"), (letters == F.upper(letters)) & (letters != F.lower(letters)) & (n_letters <= 5))
        .otherwise(True)
    )


_AROUND = r"[,;:!?()\[\]'\"/\-–—]*+"
#: A token that is clean beyond doubt: a number, or a word of two letters or more with a vowel, and punctuation around it.
PLAIN = rf"{_AROUND}(?:(?=\p{{L}}*?[aeiouyAEIOUY])\p{{L}}{{2,}}+|[0-9]++)\.?+{_AROUND}"


def has_plain_token(line: Column) -> Column:
    """Whether some token of a line is clean beyond doubt: one search instead of a judgement of each token."""
    return line.rlike(rf"(?U)(?:^|\s){PLAIN}(?:\s|$)")


def has_other_token(line: Column) -> Column:
    """Whether some token needs to be judged."""
    return line.rlike(rf"(?U)(?:^|\s)(?!{PLAIN}(?:\s|$))\S")


def latin1(text: Column) -> Column:
    """Typographic characters as ASCII, what is left outside Latin-1 as question marks; null as empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), "‘’“”–—•\xa0", "''\"\"--- ")
    plain = F.replace(F.replace(plain, F.lit("…"), F.lit("...")), F.lit("₹"), F.lit("Rs."))
    return F.regexp_replace(plain, r"[^\x00-\xff]", "?")


def is_clause_number(number: Column) -> Column:
    """Dotted numbers, and whole numbers below 100."""
    return F.coalesce(number.rlike(CLAUSE_NUMBER) & (F.contains(number, F.lit(".")) | (F.length(F.regexp_replace(number, "^0+", "")) <= 2)), F.lit(False))


def citations(text: Column) -> Column:
    """array<struct<document, clause_no>> of `[document clause]` marks."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(CITATION), 1).alias("document"), F.regexp_extract_all(text, F.lit(CITATION), 2).alias("clause_no"))


def json_tail(text: Column) -> Column:
    """From the first brace on, if that part ends in a brace and parses; else null."""
    tail = F.when(F.instr(text, "{") > 0, trim(F.regexp_extract(text, r"(?s)(\{.*)$", 1)))
    return F.when(tail.endswith("}") & F.try_parse_json(tail).isNotNull(), tail)


def json_array(text: Column) -> Column:
    """From the first square bracket to the last."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t\n\r\x0b\x0c]+"), lambda w: w != ""))
