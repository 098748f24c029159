"""Tokens, labelled items and lists as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that don't count as terms.
STOPWORDS = "a an and are as at be by for from has have in is it of on or that the to was were with".split()
WORD = r"([\p{L}\p{N}_]+)"


def tokenize(text: Column) -> Column:
    """Lower-cased words of two or more characters that aren't stop words, in order, repeats kept."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def split_items(value: Column) -> Column:
    """Items of a white-space separated list; null and blank give an empty array."""
    return F.filter(F.split(F.coalesce(value, F.lit("")), r"\s+"), lambda x: x != "")


def item_id(item: Column) -> Column:
    """What stands before the last dash; the whole item if there is none."""
    return F.regexp_replace(item, "-[^-]*$", "")


def item_label(item: Column) -> Column:
    """What stands after the last dash; the whole item if there is none."""
    return F.substring_index(item, "-", -1)


def labelled_items(value: Column) -> tuple[Column, Column]:
    """Candidates and clicked ids of a ``id-label`` list. A bare ``1`` counts as a click on an empty id."""
    items = split_items(value)
    candidates = F.transform(items, item_id)
    clicked = F.transform(
        F.filter(items, lambda x: item_label(x) == "1"), lambda x: F.when(F.contains(x, F.lit("-")), item_id(x)).otherwise(F.lit(""))
    )
    return candidates, clicked


def entity_ids(text: Column) -> Column:
    """``WikidataId`` of each object of a JSON array; malformed text and missing ids give nothing, repeats stay."""
    parsed = F.from_json(text, "array<struct<WikidataId:string>>", {"mode": "PERMISSIVE"})
    ids = F.transform(F.coalesce(parsed, F.array()), lambda x: x["WikidataId"])
    return F.filter(ids, lambda x: x.isNotNull() & (x != ""))


def newest(history: Column, n: int) -> Column:
    """The last ``n`` items of a list that runs from old to new, newest first."""
    return F.slice(F.reverse(history), 1, n)


def recency_weights(history: Column, decay: float = 0.8) -> Column:
    """``decay ** age`` to six digits; the last item has age 0 and weight 1."""
    n = F.size(history)
    return F.transform(history, lambda _, i: F.round(F.pow(F.lit(decay), (n - 1 - i).cast("double")), 6))
