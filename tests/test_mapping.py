"""Words and phoneme groups over sentences, and markup as rows."""

from sonoglyph.functions.markup import ssml_rows
from sonoglyph.operators.mapping import map_words


def test_words_meet_groups_through_all_sentences(spark):
    sentences = spark.createDataFrame([(1, 0, list("ab  cd")), (1, 1, []), (1, 2, list(" e.f ")), (2, 0, list("x y")), (3, 0, None), (4, 0, list("q"))], "id int, sentence int, symbols array<string>")
    words = spark.createDataFrame([(1, w, 10 * w, 3) for w in range(4)] + [(2, 0, 0, 1)], "id int, word int, text_start int, text_length int")
    marks = spark.createDataFrame([(1, 5, 8, 7), (1, 2, 8, 2), (1, 9, 3, 9), (2, 1, 2, 4), (1, 0, 99, 1)], "id int, mark int, position int, n_symbols int")
    got = sorted(tuple(r) for r in map_words(sentences, words, marks, ["id"]).collect())
    # the second sentence is empty; in the third the group begins at place 1, which is the seventh symbol of all
    assert got == [(1, 0, 0, 0, 3, 0, 2, 0), (1, 0, 1, 10, 3, 4, 6, 0), (1, 2, 2, 20, 3, 1, 4, 2), (2, 0, 0, 0, 1, 0, 1, 0)]
    assert map_words(sentences, words.where("false"), marks, ["id"]).count() == 0


def test_markup_as_rows(spark):
    df = spark.createDataFrame([(1, '<speak>a<break/>b<voice name="v"> c </voice><voice>d</voice></speak>'), (2, "<speak> </speak>"), (3, "<speak>"), (4, None), (5, "plain")], "id int, m string")
    got = {}
    for r in ssml_rows(df, "m").orderBy("id", "seq").collect():
        got.setdefault(r["id"], []).append((r["seq"], r["type"], r["segment"], r["speaker"], r["duration_ms"], r["error"] is not None))
    assert got[1] == [(0, "text", "a", None, None, False), (1, "break", None, None, 250, False), (2, "text", "b", None, None, False), (3, "text", "c", "v", None, False), (4, "text", "d", None, None, False)]
    assert 2 not in got and all(got[i] == [(None, None, None, None, None, True)] for i in (3, 4, 5))
    assert ssml_rows(df.where("false"), "m").count() == 0
