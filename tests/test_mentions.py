from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodequery.operators.mentions import automaton, mentions


def rows_of(df):
    return sorted(((r.id, r.name, r.first) for r in df.collect()), key=repr)


def brute(texts, names):
    low = [(n, n.lower()) for n in set(names) if n]
    return sorted(((k, n, t.lower().index(x) + 1) for k, t in texts if t for n, x in low if x in t.lower()), key=repr)


def test_like_contains(spark):
    """Names within names, in other cases, repeated, empty and null; one automaton and many blocks give the same."""
    names = ["he", "she", "hers", "SHE", "his", "a", "aa", "aaa", "he", "", None, "é日本", "日", "not there", "x" * 5000]
    texts = [(1, "ushers"), (2, "Aaaa aaaa"), (3, None), (4, ""), (5, "É日本 and SHE"), (5, "his"), (None, "hers"), (6, "y" * 90_000 + "x" * 5000 + "日")]
    docs, listed = spark.createDataFrame([(*t, 0) for t in texts], "id int, text string, name int"), spark.createDataFrame([(n,) for n in names], "name string")
    want = brute(texts, names)
    assert rows_of(mentions(docs, listed, "id")) == want
    assert rows_of(mentions(docs, listed, "id", name_chars=1200, text_chars=20_000)) == want
    none = listed.limit(0)
    assert mentions(docs, none, "id").count() == mentions(docs.limit(0), listed, "id").count() == mentions(docs.limit(0), listed, "id", name_chars=100).count() == 0


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab日", min_size=1, max_size=4), min_size=1, max_size=8), st.text("ab日c", max_size=40))
def test_automaton(names, text):
    assert {n for n in names if n in text} == {text[end - size + 1 : end + 1] for end, size in automaton(names).iter(text)}
