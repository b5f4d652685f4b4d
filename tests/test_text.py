from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import scalar
from skein.functions.similarity import common_subsequence, indel_ratio, may_reach
from skein.operators import text


def test_indel_ratio_pinned():
    pairs = {("tansi ngr", "tansi nagar"): 90.0, ("road", "gandhi road"): 53.3, ("velacherry", "velachery"): 94.7, ("adyar river", "adyar"): 62.5, ("nandambakkam", "adambakkam"): 90.9}
    for (a, b), score in pairs.items():
        assert round(indel_ratio(a, b), 1) == score
    assert indel_ratio("", "") == 100.0


@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert common_subsequence(a, b) == table[-1][-1]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=8), st.text("abc", min_size=1, max_size=8)), min_size=1, max_size=40))
def test_prefilter_loses_nothing(spark, pairs):
    table = spark.createDataFrame(pairs, "a string, b string")
    for r in table.withColumn("may", may_reach(F.col("a"), F.col("b"), 85.0)).collect():
        assert r.may or indel_ratio(r.a, r.b) < 85


GAZETTEER = [("Adyar", 0), ("Adyar River", 1), ("Velachery", 2), ("Gandhi Road", 3), ("T Nagar", 4), ("ADYAR", 5)]


def names(spark):
    return spark.createDataFrame(GAZETTEER, "name string, place int")


def test_windows(spark):
    rows = text.windows(spark.createDataFrame([(1, "Near O'Hara's, the old Road!"), (2, ""), (3, None), (4, "யாழ் x")], "text_id int, text string")).collect()
    own = [r for r in rows if r.text_id == 1]
    assert len(own) == 5 + 4 + 3 + 2
    assert (own[0].n_words, own[0].span) == (4, "Near O'Hara's, the old")
    assert all(r.span == "Near O'Hara's, the old Road!"[r.start : r.end] for r in own)
    assert [r.span for r in rows if r.text_id == 4] == ["x"]


def test_geoparse(spark):
    table = [(1, "Water rose at velacherry and along the Adyar River today"), (2, "nothing here"), (3, None), (4, "Gandhi Road, Gandhi road; T nagar")]
    got = {r.text_id: [(m.name, m.span) for m in r.matches] for r in text.geoparse(spark.createDataFrame(table, "text_id int, text string"), names(spark)).collect()}
    assert got[1] == [("Velachery", "velacherry"), ("Adyar River", "Adyar River")]
    assert got[2] == got[3] == []
    assert got[4] == [("Gandhi Road", "Gandhi Road"), ("Gandhi Road", "Gandhi road"), ("T Nagar", "T nagar")]


def test_later_spelling_wins_and_ties_go_to_the_first(spark):
    keyed = {r.key: r.name for r in text.gazetteer_names(names(spark)).collect()}
    assert keyed["adyar"] == "ADYAR"
    spans = spark.createDataFrame([("abcdefghij",)], "span string")
    two = spark.createDataFrame([("abcdefghix", 7), ("abcdefghiy", 3)], "name string, place int")
    assert text.best_matches(spans, text.gazetteer_names(two)).first().name == "abcdefghiy"


def test_greedy_choice(spark):
    kind = "array<struct<start:int,end:int,n_words:int,name:string,score:double,span:string>>"
    rows = [
        ([(0, 10, 2, "long", 95.0, ""), (0, 5, 1, "short", 95.0, ""), (4, 12, 2, "over", 94.0, ""), (12, 15, 1, "apart", 86.0, "")],),
        ([(0, 5, 1, "worse", 90.0, ""), (3, 8, 1, "best", 99.0, "")],),
        ([],),
    ]
    got = [[m.name for m in r[0]] for r in spark.createDataFrame(rows, f"m {kind}").select(text.chosen_spans(F.col("m"))).collect()]
    assert got == [["long", "apart"], ["best"], []]


def test_exact_mentions(spark):
    table = [(1, "the ADYAR river's bank, adyars"), (2, "Adyarriver"), (3, "old Gandhi  Road"), (4, "gandhi road."), (5, None), (6, "éadyar adyaré")]
    got = {(r.text_id, r.name) for r in text.exact_mentions(spark.createDataFrame(table, "text_id int, text string"), names(spark).where("place < 5")).collect()}
    assert got == {(1, "Adyar"), (1, "Adyar River"), (4, "Gandhi Road")}
    odd = spark.createDataFrame([("A.B (x)",), ("...",)], "name string")
    table = spark.createDataFrame([(1, "see a.b (x) now"), (2, "see aXb (x)")], "text_id int, text string")
    assert [r.text_id for r in text.exact_mentions(table, odd).collect()] == [1]


def test_phrases(spark):
    table = [(1, "Near The Anna Nagar West, In Velachery. Then Mount Road"), (2, "The In At"), (3, None), (4, "Éla Anna Nagar")]
    rows = text.phrases(spark.createDataFrame(table, "text_id int, text string"), ["near", "the", "in", "then", "at"])
    got = sorted((r.text_id, r.phrase) for r in rows.collect())
    assert got == [(1, "Anna Nagar West"), (1, "Mount Road"), (4, "Anna Nagar")]
    novel, covered = text.novel_phrases(rows, spark.createDataFrame([("anna nagar",)], "name string"))
    assert sorted(r.phrase for r in novel.collect()) == ["Anna Nagar West", "Mount Road"]
    assert covered.first()[0] == 1


def test_passages_and_labels(spark):
    import hashlib

    table = spark.createDataFrame([(" \n text here\t",), ("text here",), ("Other",)], "paragraph string")
    got = [r.passage_id for r in text.with_passage_ids(table, "paragraph").collect()]
    assert got[0] == got[1] == hashlib.sha1(b"text here").hexdigest()[:10] != got[2]
    stored = spark.createDataFrame([("a", "yes", datetime(2024, 1, 1)), ("b", "no", datetime(2024, 1, 3))], "id string, label string, at timestamp_ntz")
    new = spark.createDataFrame([("a", "no", datetime(2024, 1, 1)), ("b", "yes", datetime(2024, 1, 2)), ("c", "uncertain", datetime(2024, 1, 2))], "id string, label string, at timestamp_ntz")
    assert {r.id: r.label for r in text.upsert(stored, new, "id", "at").collect()} == {"a": "no", "b": "no", "c": "uncertain"}
    corpus = spark.createDataFrame([("a",), ("b",), ("z",), ("a",)], "id string")
    assert tuple(text.labelling_progress(corpus, stored, "id", "label").first()) == (3, 2, 1, 66.67)
    mapped = stored.select(scalar.mapped_label("label", {"yes": 1, "no": 0}, ["uncertain"]).alias("y"))
    assert [r.y for r in mapped.collect()] == [1, 0]
    with pytest.raises(Exception, match="unknown label"):
        stored.select(scalar.mapped_label("label", {"yes": 1}, []).alias("y")).collect()


def test_fields(spark):
    table = spark.createDataFrame([(None,), ("",), ("one",), ("['a', 'b c']",), ('["x"]',), ("[unquoted]",), ("""["St Mary's Road", 'Mount Road', 'it\\'s']""",), ("[]",)], "f string")
    assert [r[0] for r in table.select(scalar.multi_values("f")).collect()] == [[], [], ["one"], ["a", "b c"], ["x"], ["[unquoted]"], ["St Mary's Road", "Mount Road", "it's"], []]
    table = spark.createDataFrame([("x", 3, ["a"], {"k": 1})], "s string, n int, a array<string>, m map<string,int>")
    assert tuple(scalar.attributes(table, ["n"], ["s", "n", "a", "m", "none"]).first()) == (3, "x", "3", '["a"]', '{"k":1}', None)
    kind = "array<struct<place:string,score:double>>"
    table = spark.createDataFrame([('[{"place": "x", "score": 1.5}]',), ("broken",), (None,), ("[]",)], "j string")
    assert [len(r[0]) for r in table.select(scalar.parsed_matches("j", kind)).collect()] == [1, 0, 0, 0]
    table = spark.createDataFrame([("Anna Nagar",), ("road",), ("abc",), ("Mylapore",), (" ",), (None,)], "n string")
    assert [r.n for r in table.where(scalar.has_name("n") & scalar.specific_name("n", ["road"])).collect()] == ["Anna Nagar", "Mylapore"]
    table = spark.createDataFrame([(1, 0), (1, 2)], "a int, b int")
    assert [tuple(r) for r in table.select(scalar.ratio_or_zero("a", "b"), scalar.ratio_or_null("a", "b")).collect()] == [(0.0, None), (0.5, 0.5)]


def test_recall_and_precision(spark):
    table = spark.createDataFrame([(["Adyar", "Guindy", "T Nagar"], ["adyar river", "t nagar", "Extra"])], "known array<string>, found array<string>")
    marked = text.recall_of_known(table, "known", "found")
    r = marked.first()
    assert (r.recovered, r.missed, r.absorbed, r.extra) == (["t nagar"], ["guindy"], ["adyar"], ["adyar river", "extra"])
    other = spark.createDataFrame([(["anna", "nagar", "ann"], ["Anna-Nagar"])], "known array<string>, found array<string>")
    assert text.recall_of_known(other, "known", "found").first().absorbed == ["anna", "nagar"]  # words end at hyphens too
    report = text.recall_report(marked).first()
    assert (report.recall, report.recall_without_absorbed) == (0.3333, 0.5)
    matches = spark.createDataFrame([("Road", "X"), ("lake", "Y"), ("lake", "Z")], "span string, name string")
    wrong = spark.createDataFrame([("ROAD", "X"), ("lake", "Q")], "span string, name string")
    assert tuple(text.precision_against(matches, wrong).first()) == (3, 1, 0.6667)
    assert text.precision_against(matches.limit(0), wrong).first().precision is None


def test_priority_and_lookup(spark):
    rows = spark.createDataFrame([("n", "road", 1), ("n", "locality", 5), ("n", "locality", 3), ("m", "odd", 2)], "name string, type string, id int")
    got = {r.name: (r.type, r.id) for r in text.top_by_priority(rows, "name", "type", {"locality": 0, "road": 3}, "id").collect()}
    assert got == {"n": ("locality", 3), "m": ("odd", 2)}
    wanted = spark.createDataFrame([(" Adyar ",), ("none",)], "name string")
    table = spark.createDataFrame([("ADYAR", 9)], "place string, ward int")
    assert {r.name: r.ward for r in text.lookup(wanted, table, "place").collect()} == {" Adyar ": 9, "none": None}


def test_signals_and_pooling(spark):
    rows = spark.createDataFrame([("help", ["a"]), ("help", []), ("fine", ["a"])], "t string, m array<string>")
    got = text.located_signals(rows, F.when(F.col("t") == "help", 1).otherwise(0), F.col("m")).collect()
    assert [r.deliverable for r in got] == [True, False, False]
    vectors = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1.0, 1.0, 0.0]), ([[1.0, 1.0]], [0.0])], "v array<array<double>>, w array<double>")
    assert [r[0] for r in vectors.select(text.weighted_mean_pool("v", "w")).collect()] == [[2.0, 3.0], None]


def test_best_matches_against_all_pairs(spark):
    import random

    from skein.functions.similarity import indel_ratio

    rng = random.Random(8)
    names = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 16))).strip() or "a" for _ in range(60)})
    spans = set()
    for name in names:
        for _ in range(8):
            own = list(name)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(own) + 1)
                if rng.random() < 0.5:
                    own.insert(at, rng.choice("abcde"))
                elif own:
                    own.pop(min(at, len(own) - 1))
            spans.add("".join(own))
    want = {}
    for span in spans - {""}:
        scores = [(-indel_ratio(span, name), place, name) for place, name in enumerate(names)]
        if -min(scores)[0] >= 85.0:
            want[span] = (min(scores)[2], -min(scores)[0])
    table = spark.createDataFrame([(n, n, k) for k, n in enumerate(names)], "name string, key string, place int")
    found = text.best_matches(spark.createDataFrame([(x,) for x in spans], "span string"), table)
    got = {r.key: (r.name, r.score) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(want) > 50
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_spans_leave_in_small_batches():
    import pandas as pd

    rows = pd.DataFrame({"text_id": range(300), "text": ["one two three four five " * 20] * 300})
    sizes = [len(batch) for batch in text._spans(iter([rows]), 4)]
    assert sum(sizes) == 300 * (100 + 99 + 98 + 97) and max(sizes) <= text.SPAN_ROWS


def test_near_names_against_all_pairs(spark, monkeypatch):
    import random

    from skein.functions.similarity import indel_ratio

    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(90)).strip()
    known = ["kelvin", "istan", "anna nagar", "anna nagas", "naga", "t'nagar", "é été", "x" * 30, long]
    near = text.NearNames(known, 85.0)
    runs = ["Kelvi", "İstan", "istanb", "Anna Nagar", "ANNA NAGAT", "É été", "È été", "x" * 26, "x" * 22, long[:30] + long[34:], long[:40], "q", "nagar"]
    for _ in range(300):
        own = list(rng.choice(known))
        for _ in range(rng.randrange(5)):
            own.insert(rng.randrange(len(own) + 1), rng.choice("an é"))
            own.pop(rng.randrange(len(own)))
        runs.append("".join(own))
    whole = "".join(runs)
    ends = np.cumsum([len(r) for r in runs])
    got = {run: (i, score) for run, i, score in near.best(whole, text.codes_of(whole), np.append(0, ends[:-1]), ends)}
    want = {}
    for run, own in enumerate(runs):
        score, i = min((-indel_ratio(own.lower(), key), i) for i, key in enumerate(known))
        if -score >= 85.0:
            want[run] = i, -score
    assert got == want and 100 < len(want) < len(runs)
    # names beyond one pass are found by others, and the first in order wins over all of them
    table = [(1, "Water at Velacherry, the Adyar river"), (2, "abcdefghij"), (3, None)]
    places = names(spark).union(spark.createDataFrame([("abcdefghix", 97), ("abcdefghiy", 93)], "name string, place int"))
    once = sorted(text.geoparse(spark.createDataFrame(table, "text_id int, text string"), places).collect())
    monkeypatch.setattr(text, "NAMES_AT_ONCE", 1)
    assert sorted(text.geoparse(spark.createDataFrame(table, "text_id int, text string"), places).collect()) == once
    assert [m.name for m in once[1].matches] == ["abcdefghiy"]
