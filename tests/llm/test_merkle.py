import random
import zlib
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodequery.llm import merkle

H = lambda *x: sha256("".join(x).encode()).hexdigest()


def plain_leaf(row, more=0):
    said = [None if v is None else str(v + more if i == 3 else v) for i, v in enumerate(row)]
    return H(*("-" if s is None else f"{len(s.encode())}:{s}" for s in said))


def plain_tree(leaves):
    """The root, and the siblings of each leaf as (on the left?, digest)."""
    at, ways, nodes = list(range(len(leaves))), [[] for _ in leaves], leaves
    while len(nodes) > 1:
        for k, i in enumerate(at):
            if i ^ 1 < len(nodes):
                ways[k].append((i % 2 == 1, nodes[i ^ 1]))
            else:
                ways[k].append(None)
        nodes, at = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [i // 2 for i in at]
    return nodes[0], ways


def plain(rows):
    """doc_id -> what the query returns, by the definition; doc_ids must differ."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([plain_leaf(r) for r in sorted(groups[g], key=lambda r: r[0])]) for g in names}
    root, ups = plain_tree([trees[g][0] for g in names])
    out = {}
    for g, up in zip(names, ups, strict=True):
        for r, way in zip(sorted(groups[g], key=lambda r: r[0]), trees[g][1], strict=True):
            tampered = zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            acc = plain_leaf(r, 1 if tampered else 0)
            for s in way + up:
                acc = H(acc) if s is None else H(s[1], acc) if s[0] else H(acc, s[1])
            out[r[0]] = (plain_leaf(r), trees[g][0], root, H(*(s[1] for s in way + up if s)), acc, acc == root)
    return out


def rows_of(n, seed):
    rng = random.Random(seed)
    langs = [None, "", "é", "en", "z", "en", "en"]
    return [(i * 3 - 5, rng.choice([None, "s"]), rng.choice(langs), rng.choice([None, 7, -1]), rng.choice([None, "", "text é𝄞", "y" * 500])) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("n,per", [(2, 1), (60, 50_000), (333, 7)])
def test_like_the_definition(spark, monkeypatch, n, per):
    monkeypatch.setattr(merkle, "LEAVES", per)
    monkeypatch.setattr(merkle, "LEVELS", 3)
    rows = rows_of(n, n)
    got = merkle.digest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == plain(rows) and len(got) == n


def test_registered_query_on_a_table(spark, tmp_path, monkeypatch):
    import duckdb

    from lodequery.llm import queries

    monkeypatch.setattr(merkle, "LEAVES", 64)
    rows = [(abs(r[0]), *r[1:]) for r in rows_of(400, 9)]
    rows = list({r[0]: r for r in rows}.values())
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.op12_merkle_manifest(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(merkle.SQL).fetchall()) == {(k, *v) for k, v in plain(rows).items()}


def test_repeated_null_and_missing_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", 4)
    kind = "doc_id long, source string, lang string, n_chars long, text string, leaf string, proof int, `a b` int"
    rows = [(1, "s", "en", 1, "t", "x", 1, 1)] * 30 + [(None, None, None, None, None, None, None, None)] * 9 + [(2, "s", "en", 2**63 - 1, "t", "x", 1, 1)]
    got = merkle.digest(spark.createDataFrame(rows, kind)).collect()
    same = plain_leaf((1, "s", "en", 1, "t"))
    leaves = [plain_leaf((None,) * 5)] * 9, [same] * 30 + [plain_leaf((2, "s", "en", 2**63 - 1, "t"))]
    root = plain_tree([plain_tree(x)[0] for x in leaves])[0]
    assert len(got) == 40 and {r.root for r in got} == {root} and sum(r.leaf == same for r in got) == 30
    assert all(r.verified == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in got)
    assert merkle.digest(spark.createDataFrame([], kind)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=6))
def test_partial_subtrees_cover_each_leaf_once(parts):
    total = sum(parts)
    leaves = [H(str(i)) for i in range(total)]
    covered, start = [], 0
    for n in parts:
        _, tops = merkle.climb(leaves[start : start + n], start, total)
        for (level, index), d in tops.items():
            span = range(index << level, min((index + 1) << level, total))
            covered += span
            under = leaves[span.start : span.stop]
            for _ in range(level):
                under = [H(*under[i : i + 2]) for i in range(0, len(under), 2)]
            assert [d] == under
        assert len(tops) <= 2 * total.bit_length() + 1
        start += n
    assert sorted(covered) == list(range(total))
