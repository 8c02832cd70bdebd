"""Diacritics around a model that labels characters: marks stripped, characters encoded, labels inserted. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sonoglyph.functions.text import let

# Marks that are stripped; characters that a model takes; ids of padding and of unknown characters.
MARKS = "ٌٍَُِّْ"
MOST, PAD, UNKNOWN = 315, 0, 1
# Labels that insert nothing, and the marks of the others.
NO_MARK = [1, 8]
FORMS = {
    4: "ـ", 5: "َ", 6: "ُّ", 7: "َّ", 8: "ـ", 9: "ِّ", 10: "ّ", 11: "ّْ", 12: "ٍّ", 13: "ِّ", 14: "ٍّ", 15: "ٌّ",
    16: "َّ", 17: "ُ", 18: "ٌّ", 19: "ًّ", 20: "ْ", 21: "ٍ", 22: "ِ", 23: "ُّ", 24: "ًّ", 25: "ٌ", 26: "ً", 27: "ّّ",
}


def characters(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def without_marks(text: Column) -> Column:
    return F.translate(text, MARKS, "")


def kept_places(text: Column) -> Column:
    """Where each character of ``without_marks`` stood in the text."""
    places = F.transform(characters(text), lambda c, i: F.when(~F.contains(F.lit(MARKS), c), i))
    return F.filter(places, lambda i: i.isNotNull())


def encoded(text: Column, vocabulary: Column, most: int = MOST) -> Column:
    """``most`` ids of a text's characters by a map; what it does not know is UNKNOWN, short texts are padded, long ones cut."""
    ids = F.transform(F.slice(characters(text), 1, most), lambda c: F.coalesce(F.element_at(vocabulary, c), F.lit(UNKNOWN)))
    return F.concat(ids, F.array_repeat(F.lit(PAD), most - F.size(ids)))


def with_marks(text: Column, labels: Column) -> Column:
    """The text with the marks of each character's label behind it; labels without a mark, and characters beyond the labels, add nothing."""
    forms = F.array(*(F.lit("" if k in NO_MARK else FORMS.get(k, "")) for k in range(max(FORMS) + 1)))

    def marked(made: Column) -> Column:
        n = F.coalesce(F.size(made), F.lit(0))
        chosen = F.transform(F.slice(characters(text), 1, F.greatest(n, F.lit(0))), lambda c, i: F.concat(c, F.coalesce(F.get(forms, F.get(made, i).try_cast("int")), F.lit(""))))
        return F.concat(F.array_join(chosen, ""), F.substring(text, F.greatest(n, F.lit(0)) + 1, F.length(text)))

    # labels that are made from the text would else be made again for each of its characters
    return let(labels, marked)
