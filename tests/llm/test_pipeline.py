import random
import zlib

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from lodequery.llm import packing

LETTERS = {"en": "thernosaiwd", "de": "üßzchtgeunk"}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(2, 9))) for _ in range(n)) + "."


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, text(rng, lang := ("en", "de")[i % 2]), lang, "s", 0) for i in range(80)]
    near = rows[10][1] + " more"
    rows += [
        (200, rows[10][1], "en", "s", 0), (201, near, "en", "s", 0), (202, rows[12][1].upper(), None, None, None), (203, "word*** " * 3 + "b$$$ c&&& | | d### " * 12, "en", "s", 0),
        (204, "1234 5678 " * 30, "en", "s", 0), (205, None, None, None, None), (206, "", "en", "s", 0), (None, text(rng, "de"), None, "s", 0),
        (207, text(rng, "en") + " mail a@b.com or +1 (988) 555-2485", "en", "s", 0), (208, text(rng, "en", 4000), "en", "s", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("extra"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    read, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, read, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        read = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in read.collect()}
    assert set(seen["quality_rules"]) >= {*range(80), 200, 201, 207, 208, None} and not {203, 205, 206} & set(seen["quality_rules"])
    assert set(seen["language_id"]) == set(seen["quality_rules"]) - {204} and seen["language_id"][None].lang == "de"
    assert set(seen["near_dedup"]) == set(seen["language_id"]) - {200, 201, 202}
    assert seen["pii"][207].text.endswith(" mail <EMAIL> or <PHONE>") and seen["pii"][207].n_chars == len(seen["pii"][207].text)
    assert all(seen["pii"][i].text == seen["near_dedup"][i].text for i in seen["pii"] if i != 207)
    encode, pieces = packing.ids_of(), {}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(seen["pii"])
    for i, ps in pieces.items():
        ids = [*encode(seen["pii"][i].text), 2]
        for p in ps:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        assert sum(p.length for p in ps) == len(ids)




def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name_pass_through(spark, tmp_path):
    """Dots, quotes, and the names that the operators use themselves: columns, rows and values stay as they are."""
    rng = random.Random(2)
    odd = ["a.b", "c`d", "__quality", "__language", "__row", "__pii", "quality measures", "quality kept", "p_good", "kept", "language", "spans", "row", "id", "component", "rep", "code"]
    rows = [(i, text(rng, lang := ("en", "de")[i % 2]), lang, "s", 0, *(f"{name}{i}" for name in odd)) for i in range(40)]
    names = ["doc_id", "text", "lang", "source", "n_chars", *odd]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == names, name
        found = {r[0]: tuple(r)[5:] for r in got.collect()}
        assert found == {r[0]: r[5:] for r in rows}, name
    assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).where("piece = 0").count() == 40


def test_odd_rows_in_every_stage(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows."""
    rng = random.Random(3)
    long = text(rng, "en", 30_000)
    rows = [(i, text(rng, "en"), "en", "s", 1) for i in range(30)] + [(None,) * 5, (None,) * 5, (1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, long, "en", "s", 9), (3, long, "en", "s", 9), (4, " \n", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {name: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in stage(spark, docs, str(tmp_path)).collect()) for name, stage in corpus_pipeline.STAGES[:4]}
    words = sorted((False, i, t) for i, t, *_ in rows if t and t.strip())
    assert kept["quality_rules"] == words and kept["language_id"] == words
    assert kept["near_dedup"] == sorted([*{w for w in words}, *((i is None, i or 0, t or "") for i, t, *_ in rows if not (t or "").strip())])
    assert kept["pii"] == sorted((i is None, i or 0, t or "") for i, t, *_ in rows)
