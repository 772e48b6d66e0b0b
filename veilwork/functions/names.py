"""Person names by dictionary: candidates by pattern, then membership, never an alternation of all names.

The dictionary of first names is a parameter (``first_names``); ``DEFAULT_NAMES`` are the
861 common ones of ``first_names.txt``, read once, and ``load_names`` reads others from a
text file with one name a line.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import fold_emitting, let, prefix_sums
from .spans import EMPTY, SENTINEL, SPAN, either, safe

# ---- fixed values --------------------------------------------------------------------------------

DEFAULT_NAMES = tuple(Path(__file__).with_name("first_names.txt").read_text("ascii").split())
#: First names that are also common words; they don't count alone.
AMBIGUOUS = tuple(
    "april may june aurora autumn dawn summer amber crystal ruby jasmine rose lily iris hazel olive pearl grace hope faith "
    "joy sage robin wren brooke glen dale lee ray drew brad chad sue penny carol holly grant wade lance dean miles gene jean "
    "frank bob bill mark guy art al ed ted rob rod hunter chase parker sawyer mason blake jordan morgan austin madison "
    "troy".split()
)
#: Words before a comma and a first name that are no surnames.
NO_SURNAME = tuple(
    "Thank Thanks Best Warm Sincerely Regards Dear Hello Hi Hey Cheers From To Cc Bcc Sent Subject Attention Att Cordially "
    "Respectfully Yours Truly Fondly Gratefully Blessings Take See Talk Speak Miss Love".split()
)

# ---- end of the fixed values ---------------------------------------------------------------------

#: First name, [initial,] surname: all of it is looked at, only the first name is consumed, so a rejected candidate costs no other.
FIRST_LAST = r"(?U)\b(?=([A-Za-z]+\s+(?:[A-Z]\.\s+)?[A-Z][a-z]{1,20}\b))[A-Za-z]+"
#: Surname, comma, first name [initial]: all of it is looked at, one letter is consumed.
LAST_FIRST = r"(?U)\b(?=([A-Z][a-z]{1,20},\s*[A-Za-z]+(?:\s+[A-Z]\.?)?\b))[A-Z]"
ALONE = r"(?U)\b([A-Z](?:[a-z]+|[A-Z]*))\b"


def load_names(spark: SparkSession, path: str) -> list[str]:
    """A first-name dictionary from a text file; it becomes part of every plan, so it must be a dictionary, not a data set."""
    rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("n")).where("n <> ''").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError(f"{path}: more than 100,000 names")
    return sorted(r["n"] for r in rows)


def names_frame(spark: SparkSession, names) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "name string")


def _candidates(text: Column, safe_text: Column, pattern: Column, consumed: Callable[[Column], Column]) -> Column:
    """``struct<start, text>`` of what the pattern's group holds at each match, which consumes ``consumed`` characters.

    ``safe_text``: the text without sentinels, at which it is cut.
    """

    def of(held: Column) -> Column:
        size = F.transform(held, consumed)
        return let(
            F.split(F.regexp_replace(safe_text, pattern, F.lit(SENTINEL)), SENTINEL, -1),
            lambda gaps: F.zip_with(
                prefix_sums(F.zip_with(F.slice(gaps, 1, F.size(held)), size, lambda g, n: F.length(g) + n)),
                F.arrays_zip(F.slice(gaps, 1, F.size(held)).alias("gap"), held.alias("text")),
                lambda before, x: F.struct((before + F.length(x["gap"])).alias("start"), x["text"].alias("text")),
            ),
        )

    return let(F.regexp_extract_all(text, pattern, F.lit(1)), of)


def _leftmost(spans: Column) -> Column:
    """Of spans in order of their starts those that a scan from the left would take."""

    def step(end: Column, s: Column) -> tuple[Column, Column]:
        free = s["start"] >= end
        return F.when(free, s["end"]).otherwise(end), F.when(free, F.array(s)).otherwise(F.array().cast(EMPTY))

    return F.when(F.size(spans) < 2, spans).otherwise(fold_emitting(spans, F.lit(0), step, SPAN)["out"])


def _span(c: Column) -> Column:
    end = c["start"] + F.length(c["text"])
    return F.struct(c["start"].cast("int").alias("start"), end.cast("int").alias("end"), c["text"].alias("text"))


def name_spans(text: Column, first_names=DEFAULT_NAMES, safe_text: Column | None = None, ascii_: Column | None = None) -> list[Column]:
    """The three dictionary patterns of names, in order, each ``array<struct<start, end, text>>``.

    ``safe_text``, ``ascii_``: the text without sentinels, and whether it is ASCII, where they are known.
    """
    known = sorted({n.lower() for n in first_names})
    alone = sorted(set(known) - set(AMBIGUOUS))
    head = lambda t: F.regexp_extract(t, "^[A-Za-z]+", 0)
    given = lambda t: F.regexp_extract(t, r"(?U),\s*([A-Za-z]+)", 1)
    marked = safe(text) if safe_text is None else safe_text
    flag = F.octet_length(text) == F.length(text) if ascii_ is None else ascii_
    first = F.filter(
        _candidates(text, marked, either(flag, FIRST_LAST), lambda t: F.length(head(t))), lambda c: F.lower(head(c["text"])).isin(known)
    )
    last = F.filter(
        _candidates(text, marked, either(flag, LAST_FIRST), lambda t: F.lit(1)),
        lambda c: F.lower(given(c["text"])).isin(known) & ~F.substring_index(c["text"], ",", 1).isin(*NO_SURNAME),
    )
    single = F.filter(_candidates(text, marked, either(flag, ALONE), F.length), lambda c: F.lower(c["text"]).isin(alone))
    none = F.array().cast(EMPTY)
    return [
        let(F.transform(first, _span), _leftmost),
        # a comma is in each of these
        F.when(text.contains(","), let(F.transform(last, _span), _leftmost)).otherwise(none),
        F.transform(single, _span),
    ]
