"""The stages on the smallest driver tables, each against a plain version on its own input; registered queries on whole tables."""

import os
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from frostline.llm.queries import QUERIES, tokenizer_files
from tests.llm.test_near_duplicates import groups

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(stages):
    for name in ("quality_rules", "quality_classifier", "near_duplicates", "mixing"):
        assert stages[name].columns == stages["documents"].columns
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "quality_classifier", "near_duplicates", "mixing", "packing"]


def test_good_documents_pass_and_bad_ones_go(spark, stages):
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = rows(stages["quality_classifier"])
    good = [i for i, q in marks.items() if q == 1]
    bad = [i for i, q in marks.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i in kept for i in bad) <= 0.05 * len(bad)


def test_one_document_of_each_group_stays(stages):
    given = sorted(rows(stages["quality_classifier"]).items())
    want = {least for _, _, least in groups(given, 5, 80)}
    assert set(rows(stages["near_duplicates"])) == want


def test_mixture_keeps_every_document(stages):
    before, after = stages["near_duplicates"], stages["mixing"]
    times = Counter(r["doc_id"] for r in after.select("doc_id").collect())
    assert set(times) == set(rows(before)) and max(times.values()) <= 2


def test_packed_pieces_hold_all_tokens(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_files()[0])
    texts = Counter()
    for r in stages["mixing"].select("doc_id", "text").collect():
        texts[r["doc_id"]] += len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1
    got, sequences = Counter(), defaultdict(list)
    for r in stages["packing"].collect():
        got[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == texts
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(
        map(tuple, stages["packing"].select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_queries_are_named_by_number():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("number", [1, 5, 10])
def test_native_queries_read_whole_tables(spark, number):
    name = next(n for n in QUERIES if n.startswith(f"op{number}_"))
    got = QUERIES[name](spark, SF)
    table = "conversations" if number == 10 else "documents"
    given = spark.read.parquet(f"{SF}/{table}.parquet")
    want = given.select("conv_id").distinct().count() + 1 if number == 10 else given.count()
    assert got.count() == want
