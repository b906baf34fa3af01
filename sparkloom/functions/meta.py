"""Column expressions that find metadata in text: document type, dates, amounts, e-mails, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, file_name, let

# Keywords of file names, then phrases of texts, in the order they are tried.
NAME_KEYWORDS = [
    ("contract", "contract"), ("agreement", "contract"), ("invoice", "invoice"), ("report", "report"), ("memo", "memo"), ("proposal", "proposal"),
    ("resume", "resume"), ("cv", "resume"), ("nda", "nda"), ("lease", "lease"), ("receipt", "receipt"),
]
TEXT_PHRASES = [
    ("this agreement", "contract"), ("hereby agree", "contract"), ("terms and conditions", "contract"), ("invoice number", "invoice"), ("amount due", "invoice"), ("bill to", "invoice"),
    ("executive summary", "report"), ("table of contents", "report"), ("non-disclosure", "nda"), ("confidentiality agreement", "nda"), ("lease agreement", "lease"), ("rental agreement", "lease"),
]
# The months by their short and full names.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_MONTH = "(?:" + "|".join(MONTHS) + ")[a-z]*"
_S = WS[:-1]
# What counts as a date, an amount, an e-mail address and a name.
DATE = rf"\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}{_S}+{_MONTH}{_S}+\d{{4}}|{_MONTH}{_S}+\d{{1,2}},?{_S}+\d{{4}}"
AMOUNT = rf"(?i)\${_S}*(\d{{1,3}}(?:,\d{{3}})*(?:\.\d{{2}})?){_S}*(million|M|billion|B|thousand|K)?"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
ENTITY = rf"[A-Z][a-z]+(?:{_S}+[A-Z][a-z]+)+"
MAX_ENTITIES = 50


def doc_type(text: Column, path: Column) -> Column:
    """The first keyword that the file name holds, else the first phrase of the text, else null."""

    def first(known: Column) -> Column:
        out = F.lit(None).cast("string")
        for source, table in (("lower", reversed(TEXT_PHRASES)), ("name", reversed(NAME_KEYWORDS))):
            for words, label in table:
                out = F.when(F.contains(known[source], F.lit(words)), label).otherwise(out)
        return out

    return let(F.struct(F.lower(file_name(path)).alias("name"), F.lower(text).alias("lower")), first)


def parse_date(text: Column) -> Column:
    """ISO, then month/day/year; a month by name becomes its number, then day month year, then month day year."""
    numbered = text
    for full, n in zip(MONTH_NAMES, range(1, 13), strict=True):
        numbered = F.replace(numbered, F.lit(full), F.lit(f"{n:02d}"))
    for short, n in zip(MONTHS, range(1, 13), strict=True):
        numbered = F.replace(numbered, F.lit(short), F.lit(f"{n:02d}"))
    numbered = F.regexp_replace(F.replace(numbered, F.lit(","), F.lit("")), WS, " ")
    tries = [(text, "yyyy-M-d"), (text, "M/d/yyyy"), (numbered, "d M yyyy"), (numbered, "M d yyyy")]
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)).cast("date") for x, f in tries])


def dates(text: Column) -> Column:
    """Distinct dates in order; what fails every form is left out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(DATE), F.lit(0)), parse_date)
    return F.array_sort(F.array_distinct(F.filter(found, lambda d: d.isNotNull())))


def amounts(text: Column) -> Column:
    """Distinct dollar amounts in order, with their unit."""

    def value(number: Column, unit: Column) -> Column:
        unit = F.lower(unit)
        times = F.when(unit.isin("million", "m"), 1e6).when(unit.isin("billion", "b"), 1e9).when(unit.isin("thousand", "k"), 1e3).otherwise(1.0)
        return F.replace(number, F.lit(","), F.lit("")).cast("double") * times

    found = F.zip_with(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(1)), F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(2)), value)
    return F.array_sort(F.array_distinct(found))


def emails(text: Column) -> Column:
    """Distinct addresses in lower case, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), F.lower)))


def entities(text: Column) -> Column:
    """Distinct runs of capitalised words in byte order, the first 50."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))), 1, MAX_ENTITIES)
