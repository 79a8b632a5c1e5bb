"""Benchmark items in capitals of other alphabets, and items shorter than a q-gram."""

import unicodedata

from rowmend.llm import decontaminate

FRENCH = "L'été dernier, près du château, la forêt brûlée s'étendait où l'élève français répétait sa leçon préférée"
SPANISH = "El señor Núñez añadió azúcar y limón; después pasó la mañana en el balcón de la región más pequeña"
GERMAN = "Der große Fluß fließt außerhalb der Straße, während Füchse über schöne Büsche hüpfen und Gänse schlafen"
GREEK = "Ο γρήγορος ποταμός κυλάει προς τη θάλασσα και οι άνθρωποι κοιτάζουν τους λόφους"
RUSSIAN = "Быстрая река течёт к морю, и люди смотрят на далёкие холмы каждое утро"


def test_capitals_of_other_alphabets(spark):
    items = [FRENCH, SPANISH, GERMAN, GREEK, RUSSIAN]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [(k, f"ÀÉ before — {t.upper()} … after") for k, t in enumerate(items)]
    docs += [(10 + k, "x " + unicodedata.normalize("NFD", t) + " y") for k, t in enumerate(items)]
    docs += [(20 + k, "«" + t.replace(" ", " “—” ") + "»") for k, t in enumerate(items)]
    docs += [(30 + k, t[::-1]) for k, t in enumerate(items)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(10 * j + k, k, 0) for j in range(3) for k in range(5)}
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {30 + k for k in range(5)}


def test_items_shorter_than_a_gram(spark):
    short = spark.createDataFrame([(1, "Señor Paz!"), (2, "42"), (3, "..."), (4, ""), (5, None)], "item_id long, text string")
    long = spark.createDataFrame([(9, SPANISH)], short.schema)
    docs = [(1, "the SEÑOR, PAZ is"), (2, "señor pazos"), (3, "unseñor paz"), (4, "it is 42."), (5, "142 420 4 2"), (6, SPANISH + " 42 42"), (7, ""), (8, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {(1, 1, 0, 13), (4, 2, 0, 8)}
    n = len(decontaminate.normalise(SPANISH.encode()))
    for bench, more in ((short, set()), (short.unionByName(long), {(6, 9, 0, n)})):
        got = {(r.doc_id, r.item_id, r.edits, r.end) for r in decontaminate.contaminated(df, bench).collect()}
        ends = want | {(6, 2, 0, n + 3)} | more
        # item 1 has two bytes for the n with a tilde
        assert got == {(d, i, e, end + (i == 1 and d == 1)) for d, i, e, end in ends}
