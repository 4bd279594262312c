"""Scalar expressions on text, references and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Book names and their abbreviations.
BOOKS = {
    "Genesis": "GEN", "Exodus": "EXO", "Leviticus": "LEV", "Numbers": "NUM", "Deuteronomy": "DEU", "Joshua": "JOS", "Judges": "JDG", "Ruth": "RUT",
    "1 Samuel": "1SA", "2 Samuel": "2SA", "1 Kings": "1KI", "2 Kings": "2KI", "1 Chronicles": "1CH", "2 Chronicles": "2CH", "Ezra": "EZR", "Nehemiah": "NEH",
    "Esther": "EST", "Job": "JOB", "Psalms": "PSA", "Proverbs": "PRO", "Ecclesiastes": "ECC", "Song of Solomon": "SOS", "Isaiah": "ISA", "Jeremiah": "JER",
    "Lamentations": "LAM", "Ezekiel": "EZK", "Daniel": "DAN", "Hosea": "HOS", "Joel": "JOL", "Amos": "AMO", "Obadiah": "OBA", "Jonah": "JON",
    "Micah": "MIC", "Nahum": "NAH", "Habakkuk": "HAB", "Zephaniah": "ZEP", "Haggai": "HAG", "Zechariah": "ZEC", "Malachi": "MAL",
    "Matthew": "MAT", "Mark": "MRK", "Luke": "LUK", "John": "JHN", "Acts": "ACT", "Romans": "ROM", "1 Corinthians": "1CO", "2 Corinthians": "2CO",
    "Galatians": "GAL", "Ephesians": "EPH", "Philippians": "PHP", "Colossians": "COL", "1 Thessalonians": "1TH", "2 Thessalonians": "2TH",
    "1 Timothy": "1TI", "2 Timothy": "2TI", "Titus": "TIT", "Philemon": "PHM", "Hebrews": "HEB", "James": "JAS", "1 Peter": "1PE", "2 Peter": "2PE",
    "1 John": "1JN", "2 John": "2JN", "3 John": "3JN", "Jude": "JUD", "Revelation": "REV",
}


def letters_of(text: Column) -> Column:
    """Upper case first, so that one letter may become two (ß), then A-Z alone."""
    return F.regexp_replace(F.upper(text), "[^A-Z]", "")


def normalize_term(term: str) -> str:
    """A search term: upper case, A-Z alone; under three letters is an error."""
    letters = "".join(c for c in term.upper() if "A" <= c <= "Z")
    if len(letters) < 3:
        raise ValueError(f"a term needs three letters: {term!r}")
    return letters


def ascii_lower(column: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    return F.translate(column, _UPPER, _LOWER)


def contains_ascii(column: Column, part: str) -> Column:
    """Whether the text holds `part`; A-Z match a-z, nothing is a wildcard."""
    return F.contains(ascii_lower(column), F.lit(part.translate(str.maketrans(_UPPER, _LOWER))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; 0 for vectors of different lengths or without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def parse_reference(ref: Column) -> dict[str, Column]:
    """book_abbrev, chapter, verse_start, verse_end of `ABB.c.v[-v]`, `Name c:v[-v]` or `ABB.c`; nulls for anything else.

    Names are looked up as written; others give their first three characters in upper case.
    """
    # The three forms of a reference.
    dotted, named, chapter = r"(?i)^([A-Z0-9]{2,3})\.(\d+)\.(\d+)(?:-(\d+))?$", r"^(.+?)\s+(\d+):(\d+)(?:-(\d+))?$", r"(?i)^([A-Z0-9]{2,3})\.(\d+)$"

    def group(pattern: str, k: int) -> Column:
        found = F.regexp_extract(ref, pattern, k)
        return F.when(found != "", found)

    names = F.create_map(*(F.lit(x) for pair in BOOKS.items() for x in pair))
    name = F.trim(group(named, 1))
    first = F.coalesce(group(dotted, 3), group(named, 3)).cast("int")
    return {
        "book_abbrev": F.coalesce(F.upper(group(dotted, 1)), F.coalesce(F.try_element_at(names, name), F.upper(F.substring(name, 1, 3))), F.upper(group(chapter, 1))),
        "chapter": F.coalesce(group(dotted, 2), group(named, 2), group(chapter, 2)).cast("int"),
        "verse_start": first,
        "verse_end": F.coalesce(F.coalesce(group(dotted, 4), group(named, 4)).cast("int"), first),
    }
