import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frostline.llm import byte_pairs as bp
from tests.llm.samples import descriptions, events

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bp.read_ranks(RANKS_PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return bp.Encoder(ranks)


def by_merging(ranks, data):
    """Ids by merging the pair of lowest rank, leftmost first, until none is left."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        at = min(found)[1]
        parts[at:at + 2] = [parts[at] + parts[at + 1]]


def small_ranks():
    """Merges where borders matter: repeated letters, ties, and tokens that bridge others."""
    ranks = {bytes([b]): b for b in range(256)}
    for a, b in ["aa", "ab", ("aa", "a"), "ba", ("ab", "ab"), ("aa", "ba"), "bc", ("ab", "c"), ("aaa", "aa"), ("abab", "c"), ("c", "c")]:
        ranks.setdefault((a + b).encode(), len(ranks))
    return ranks


SMALL = small_ranks()


def test_small_merges_in_all_short_strings():
    machine = bp.Transducer(SMALL)
    for n in range(8):
        for k in range(3 ** n):
            data = bytes(b"abc"[k // 3 ** i % 3] for i in range(n))
            assert machine.encode(data) == by_merging(SMALL, data), data


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60) | st.text("abc", max_size=60).map(str.encode))
def test_small_merges_in_any_bytes(data):
    assert bp.Transducer(SMALL).encode(data) == by_merging(SMALL, data)


def test_every_token_is_its_own_encoding(ranks):
    machine = bp.Transducer(ranks)
    r = random.Random(5)
    for token in r.sample(sorted(ranks), 4000):
        assert machine.encode(token) == [ranks[token]]


def test_pieces_as_the_library_merges_them(ranks, library):
    r, machine = random.Random(6), bp.Transducer(ranks)
    for _ in range(3000):
        data = bytes(r.choice(b"aabbeeccttnn  00\xc3\xa9") for _ in range(r.randint(1, 80)))
        assert machine.encode(data) == library._encode_single_piece(data)


def test_output_lags_by_a_bounded_look_ahead(ranks):
    machine = bp.Transducer(ranks)
    machine.encode("snow emergency route on Liberty Avenue ".encode() * 50)
    longest = max(map(len, ranks))
    assert max(sum(len(machine.merges.tokens[t]) for t in p) for p in machine._pending) <= 2 * longest


def test_tables_start_again_without_a_change(ranks, library, monkeypatch):
    monkeypatch.setattr(bp, "STATE_LIMIT", 50)
    monkeypatch.setattr(bp, "PIECE_LIMIT", 20)
    monkeypatch.setattr(bp, "PAIR_LIMIT", 30)
    monkeypatch.setattr(bp, "LOOSE", 3)
    encoder, texts = bp.Encoder(ranks), [t or "" for _, t in descriptions()]
    for text in texts[:60]:
        ids, bounds = encoder.ids(pa.array([text]))
        assert ids.tolist() == library.encode_ordinary(text) and bounds.tolist() == [0, len(ids)]


def test_rank_table_must_be_one_of_merges():
    with pytest.raises(ValueError):
        bp.Transducer({**{bytes([b]): b for b in range(256)}, b"abc": 256}).encode(b"abcabc")
    with pytest.raises(ValueError):
        bp.Transducer({b"a": 0}).encode(b"ab")


AWKWARD = ["", " ", "  a", "a  b", "a \n b", "\n\n", "it's 'll we'LL", "漢字　 空", "x  y", "a\x1c b", "  b", "é" * 40,
           "<|endoftext|>", "1234567890", "🙂👍🏽", "tab\t tab", " \r\n ", "a" * 3000, "\u0085 x", "null\x00 byte"]


def test_texts_in_one_batch(encoder, library):
    texts = AWKWARD + [t or "" for _, t in descriptions()] + [""]
    ids, bounds = encoder.ids(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [library.encode_ordinary(t) for t in texts]
    part, edges = encoder.ids(pa.array(texts)[3:9])
    assert [part[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])] == got[3:9]
    assert encoder.ids(pa.array([], pa.string()))[1].tolist() == [0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t 　ab'sé1!漢"), max_size=12), max_size=6))
def test_blanks_in_any_place(encoder, library, texts):
    ids, bounds = encoder.ids(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=30) | st.text(max_size=20).map(lambda t: list(t.encode())))
def test_stream_decodes_as_replacing_does(ids):
    """Any bytes, in any portions, as the standard decoder reads them at once."""
    known = {bytes([b]): b for b in range(256)}
    decoder = bp.Decoder(known)
    want = b"".join(bytes([i]) if i < 256 else "�".encode() for i in ids).decode("utf-8", "replace")
    assert decoder.decode(ids).decode() == want
    stepwise = b"".join([*[decoder.feed([i]) for i in ids], decoder.close()])
    assert stepwise.decode() == want


def test_half_characters_wait(ranks):
    decoder, ids = bp.Decoder(ranks), [ranks[bytes([b])] for b in "é🙂".encode()]
    assert [decoder.feed([i]) for i in ids] == [b"", "é".encode(), b"", b"", b"", "🙂".encode()] and decoder.close() == b""


def test_descriptions_and_back(spark, library):
    rows = descriptions() + list(zip(range(900, 950), AWKWARD))
    df = events(spark, rows).withColumn("tokens", F.lit("given"))
    encoded = bp.encode_descriptions(df, RANKS_PATH)
    assert sorted(encoded.columns) == sorted(df.columns)
    got = {(r["event_id"], r["description"]): r["tokens"] for r in encoded.collect()}
    for (event_id, text) in rows:
        assert bytes(got[event_id, text]) == np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
    back = bp.decode_tokens(encoded.withColumnRenamed("description", "given.text"), RANKS_PATH, portion=7)
    assert back.where(~F.col("description").eqNullSafe(F.coalesce("`given.text`", F.lit("")))).count() == 0
    both = bp.encode_descriptions(df, RANKS_PATH, decoded="again")
    assert both.where(~F.col("again").eqNullSafe(F.coalesce("description", F.lit("")))).count() == 0
    assert back.count() == len(rows) and bp.encode_descriptions(df.where("false"), RANKS_PATH).count() == 0


def test_tokens_of_other_makers(spark, ranks):
    rows = [(1, None), (2, b""), (3, b"\x01\x00"), (4, np.array([ranks[b"\xc3"]], "<u4").tobytes()),
            (5, np.array([ranks[b"a"], 4_000_000_000], "<u4").tobytes())]
    df = spark.createDataFrame(rows, "event_id long, tokens binary")
    got = {r["event_id"]: r["description"] for r in bp.decode_tokens(df, RANKS_PATH).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "�", 5: "a�"}


def test_query_equals_the_library(spark, library):
    from frostline.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op12_byte_pairs"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_ranks_are_read(ranks, tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in SMALL.items()))
    assert bp.read_ranks(str(path)) == SMALL and len(ranks) == 50256
