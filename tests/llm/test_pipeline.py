"""The pipeline's stages on a small table: columns, effects and odd rows."""

import random

import pytest

import corpus_pipeline as P


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocab = [a + b + c for a in ("ba", "do", "ki", "lu") for b in ("na", "re", "si", "to") for c in ("m", "n", "st", "th", "")]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs, labels = [], []
    for i in range(240):
        poor, toxic = i % 6 == 0, i % 7 == 1
        text = "!!! ".join(w.upper() for w in prose(120).split()) if poor else prose(160) + (" idiot scum trash" if toxic else "")
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not poor), int(toxic)))
    copy = docs[2][1]
    docs += [(1000, copy, "en", "s", len(copy)), (2, copy, "en", "s", len(copy)), (1001, None, None, None, None), (None, prose(50), "en", None, 1), (1002, "", "en", "s", 0)]
    passage = prose(80)
    docs += [(1100 + k, prose(150) + " " + passage + " " + prose(150), "en", "s", 1) for k in range(3)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), passage


def test_stages(spark, folder):
    path, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, ids = docs.columns, []
    for k, (_, stage) in enumerate(P.STAGES):
        docs = P.materialise(stage(spark, docs, path))
        assert k == len(P.STAGES) - 1 or docs.columns == columns
        ids.append([r["doc_id"] for r in docs.select("doc_id").collect()])
    assert not {i for i in range(0, 240, 6)} & set(ids[0]) and len({i for i in range(240) if i % 6} - set(ids[0])) <= 4
    assert ids[1].count(2) == 1 and 1000 not in ids[1]
    assert len([r for r in docs.select("text").collect() if passage in (r["text"] or "")]) == 1  # the first copy stays
    toxic = {i for i in range(240) if i % 7 == 1 and i % 6}
    clean = {i for i in range(240) if i % 7 != 1 and i % 6} & set(ids[2])
    assert len(toxic & set(ids[3])) <= 2 and not clean - set(ids[3]) and len(ids[3]) == len(set(ids[3]))
    assert {"ids", "text", "n_tokens"} <= set(docs.columns)


def test_empty_table_and_clashing_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = docs.selectExpr("*", "1 as th", "2 as tn", "'x' as spans", "3 as ids", "4 as tokens", "5 as p", "6 as row", "7 as rate", "8 as chunks", "9 as _id")
    for table in (docs.where("false"), odd):
        for name, stage in P.STAGES:
            out = stage(spark, table, path)
            assert out.count() <= max(table.count(), 0) * 2, name
            if name != P.STAGES[-1][0]:
                assert out.columns == table.columns and {r["th"] for r in out.limit(5).collect()} <= {1} if "th" in table.columns else True
