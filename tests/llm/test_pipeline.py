"""Stages of the pipeline on small tables with nulls, repeated rows and hard texts."""

import pytest

import corpus_pipeline as pipeline
from lamina.llm import jaccard_join, membership
from lamina.llm.exact_dedup import exact_dedup, keep_distinct

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _digest string"
WORDS = " ".join(f"word{k}" for k in range(40))
ROWS = [
    (1, WORDS, "en", "a", 1, None), (2, WORDS + " ", None, None, None, "x"), (3, " " + WORDS, "en", "a", 1, None), (4, WORDS + " more", "en", "a", 1, None),
    (5, None, None, None, None, None), (6, "", "en", "b", 0, None), (7, "lone", "en", "b", 4, None), (7, "lone", "en", "b", 4, None), (None, "of no one", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda v: (v is None, v))


def test_exact_copies(spark, docs):
    kept = pipeline.drop_copies(spark, docs, "")
    assert kept.columns == pipeline.COLUMNS
    assert ids(kept) == [2, 4, 5, 7, None]
    rows = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(docs).collect()}
    assert {(1, 2, 3, False), (2, 2, 3, True), (5, 5, 2, True), (6, 5, 2, False), (7, 7, 2, True), (None, None, 1, True)} <= rows


def test_near_copies(spark, docs):
    assert ids(pipeline.drop_near_copies(spark, docs, "")) == [1, 5, 6, 7, 7, None]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pipeline.drop_copies(spark, none, "").collect() == []
    assert pipeline.drop_near_copies(spark, none, "").collect() == []
    assert pipeline.pack(spark, none, "").collect() == []


def test_packing_keeps_every_piece(spark, docs):
    rows = pipeline.pack(spark, docs, "").collect()
    assert len(rows) == len(ROWS)
    assert sum(r["length"] for r in rows) == max(r["offset"] + r["length"] for r in rows)


def test_crowded_filters_decide_alike(spark, docs, monkeypatch):
    for module in (jaccard_join, membership):
        monkeypatch.setattr(module, "FILTER_BITS", 8)
    many = spark.range(60).selectExpr("id AS doc_id", "concat('text ', id % 20, repeat(' ', CAST(id % 3 AS INT))) AS text", "'x' AS _digest", "id AS digest").repartition(4)
    kept = keep_distinct(many)
    assert kept.columns == many.columns
    wins = {}
    for k in range(60):
        wins[k % 20] = max(wins.get(k % 20, (-1, 0)), (k % 3, -k))
    assert ids(kept) == sorted(-k for _, k in wins.values())
    gone = spark.createDataFrame([(k,) for k in range(0, 60, 4)] + [(None,)], "doc_id bigint")
    assert ids(membership.drop_keys(many, "doc_id", gone)) == [k for k in range(60) if k % 4]
    assert ids(pipeline.drop_copies(spark, docs, "")) == [2, 4, 5, 7, None]
    assert ids(pipeline.drop_near_copies(spark, docs, "")) == [1, 5, 6, 7, 7, None]


ITEM = "Seven carpenters repaired the northern bridge because the winter flood had carried away both of its wooden arches"


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_near_copies_spare_other_texts_of_the_same_id(spark):
    own = lambda doc_id, text: (doc_id, text, "en", "s", 1, None)
    rows = [own(1, WORDS), own(5, WORDS + " end"), own(5, "an unrelated text of the same id with words of its own"), own(None, WORDS + " no id"), own(None, "no id either but alone")]
    kept = pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(2), "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted((r[0] or 0, r[1]) for r in (rows[0], rows[2], rows[4]))


def test_near_copies_of_one_id_leave_one(spark):
    rows = [(1, WORDS + end, "en", "s", 1, None) for end in ("", " x", " y")] + [(None, "many words of text " + WORDS[:60] + end, None, None, None, None) for end in (" a b c", " a b c ")]
    kept = pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "None"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with rude and kind texts, copies, near copies, a leak, null and repeated ids."""
    path = str(tmp_path_factory.mktemp("tables"))
    rude, kind = "vile awful filthy", "mild gentle pleasant"
    text = lambda k, words: " ".join([*(f"w{(k * 37 + j * j) % 997}" for j in range(25)), words])
    rows = [(k, text(k, rude if k % 4 == 0 else kind), "en", "s", 1) for k in range(200)]
    rows += [(1, rows[1][1] + "  ", "en", "s", 1), (300, rows[2][1] + " tail", "en", "s", 1), (3, f"unlike the others {ITEM} and more", None, None, None), (3, text(901, kind), "en", "s", 1),
             (None, f"{ITEM} with an end", None, None, None), (None, text(902, kind), None, None, None), (400, None, None, None, None), (401, "", None, None, None)]
    write(spark, path, "documents", rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    write(spark, path, "labels", [(k, 1 - int(k % 4 == 0), int(k % 4 == 0)) for k in range(150)] + [(None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    write(spark, path, "benchmark", [(1, ITEM), (2, None), (3, "")], "item_id bigint, text string")
    return path


def test_toxic_rows_go_by_their_text(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = pipeline.drop_toxic(spark, docs.withColumn("rejected", docs["doc_id"]).withColumn("expected_grade", docs["text"]), folder)
    assert kept.columns == pipeline.COLUMNS
    texts = [r["text"] or "" for r in kept.collect()]
    assert not any("vile" in t for t in texts) and sum("gentle" in t for t in texts) >= 150
    assert pipeline.drop_toxic(spark, docs.limit(0), folder).collect() == []


def test_leaks_go_row_by_row(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IS NULL OR doc_id IN (3, 400)")
    kept = pipeline.drop_leaks(spark, docs, folder)
    assert kept.columns == pipeline.COLUMNS
    assert sorted((r["doc_id"] or 0, "carpenters" in (r["text"] or "")) for r in kept.collect()) == [(0, False), (3, False), (3, False), (400, False)]
    assert pipeline.drop_leaks(spark, docs.limit(0), folder).collect() == []


def test_whole_run(spark, folder):
    pieces = pipeline.run(spark, folder).collect()
    per = sorted((str(r["doc_id"]) for r in pieces))
    assert len(pieces) == len({(r["sequence_id"], r["offset"]) for r in pieces})
    kept = [k for k in range(200) if k % 4]
    # one row of 400 and 401 (both empty), the texts of 3 and of null that leak nothing, no copy of 1 and 2
    assert per == sorted([*map(str, kept), "3", "None", "400"])


def test_run_on_empty_tables(spark, tmp_path):
    write(spark, tmp_path, "documents", [], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    write(spark, tmp_path, "labels", [], "doc_id bigint, quality int, toxic int")
    write(spark, tmp_path, "benchmark", [], "item_id bigint, text string")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
