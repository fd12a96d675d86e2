import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from lodestrata.llm import packing

BAD = ["blorgit", "snarkle", "vexomil"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A corpus with toxic documents, copies, a leak, personal data, odd rows, a repeated id, a long text and clashing columns."""
    rnd = random.Random(17)
    words = [f"{a}{b}" for a in ("riv", "ston", "gard", "mark", "lett", "silv") for b in ("er", "e", "en", "et", "ing", "ly")]

    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    clean = {i: prose(rnd.randint(40, 90)) for i in range(200)}
    rows = [(i, t) for i, t in clean.items()]
    toxic = {300 + i: f"{prose(30)} {rnd.choice(BAD)} {prose(10)} {rnd.choice(BAD)} {prose(5)}" for i in range(60)}
    rows += list(toxic.items())
    item = prose(40)
    rows += [(400, clean[3]), (401, clean[3] + " end"), (402, f"{prose(50)} {item} {prose(50)}"), (403, f"{prose(20)} write to a.b@c.de now"), (405, prose(120_000))]
    rows += [(5, prose(60)), (None, None), (None, prose(50)), (404, ""), (404, None)]
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 as uid", "'x' as label", "2 as __uid", "3 as row", "4 as __text", "5 as __row")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(200)] + [(i, 1, 1) for i in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, toxic


def test_each_stage_keeps_the_columns_and_decides(spark, tables):
    folder, rows, toxic = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = out.cache()
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
    ids = {n: [d for d, _ in k] for n, k in kept.items()}
    assert not set(ids["toxicity"]) & set(toxic) and len(ids["toxicity"]) == len(rows) - len(toxic)
    gone = {400, 401}
    assert not set(ids["near_duplicates"]) & gone and ids["near_duplicates"].count(5) == 2
    # Three rows without words are copies of each other; that with the smallest id stays.
    assert len(ids["near_duplicates"]) == len(ids["toxicity"]) - 2 - 2 and ids["near_duplicates"].count(None) == 1
    assert set(ids["near_duplicates"]) - set(ids["decontamination"]) == {402}
    assert dict(kept["personal_data"])[403].endswith("write to [EMAIL] now")
    assert sorted(ids["personal_data"], key=str) == sorted(ids["decontamination"], key=str)


def test_run_packs_what_the_stages_kept(spark, tables):
    folder, rows, toxic = tables
    found = corpus_pipeline.run(spark, folder).collect()
    encode = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)).encode
    texts = {i: t for i, t in rows if i is not None and i not in (5, 404) and i < 300}
    for i, text in texts.items():
        own = [r for r in found if r.doc_id == i]
        assert sum(r.length for r in own) == own[0].doc_tokens == len(encode(text, add_special_tokens=False).ids) + 1
    assert {r.doc_id for r in found} & ({400, 401, 402} | set(toxic)) == set()
    room = {}
    for r in found:
        room[r.sequence_id] = room.get(r.sequence_id, 0) + r.length
    assert sorted(room) == list(range(len(room))) and max(room.values()) <= packing.LENGTH


def test_empty_tables(spark, tables, tmp_path):
    folder, _, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
