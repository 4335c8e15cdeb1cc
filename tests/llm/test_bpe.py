import hashlib
import random
import zlib

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from offerloom.llm import bpe, token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"
WHOLE = Tokenizer.from_file(PATH)
WHOLE.no_truncation()
WHOLE.no_padding()
SPECIAL = [t.content for t in WHOLE.get_added_tokens_decoder().values()]
ODD = ["", " ", "\n\n  x", "don't I'LL it's 'tis ''s", "a b  c　", "…'s »'re", "é'é́ ñ", "日本語 テスト123", "🙂👍🏽 ok", "\x00\x01\x7f", "x" * 5000, "12345678901 ½²", "\t\t if\n\tfor ", *SPECIAL, "a".join(SPECIAL), SPECIAL[0][:-1] if SPECIAL else "<|"]


def whole(text):
    ids = WHOLE.encode(text or "", add_special_tokens=False).ids
    return ids, WHOLE.decode(ids, skip_special_tokens=False)


def fragments(texts):
    encoder = bpe.FragmentEncoder.of(PATH, digests=False)
    ids, ends = encoder.encode(pa.array(texts, pa.string()))[0]
    numbers = memoryview(ids).cast("I").tolist()
    return [numbers[s // 4 : e // 4] for s, e in zip(ends, ends[1:])]


PIECES = st.one_of(st.text(max_size=8), st.sampled_from(["'s", "'ll ", "  ", "\n", "\r\n", " ", "́", "Über", "naïve", "<|", "|>", "3.14", "::", "()", *SPECIAL]))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=5))
def test_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert fragments(texts) == [whole(t)[0] for t in texts]


def test_forced_pairs_are_in_no_token():
    encoder = bpe.FragmentEncoder.of(PATH, digests=False)
    free = bpe.forced_pairs(list(encoder.bytes_of.values()))
    assert free.any() and not any(free[a, b] for t in encoder.bytes_of.values() for a, b in zip(t, t[1:]))
    assert not (encoder.safe.reshape(256, 256) & ~bpe.forced_pairs([t for t in encoder.bytes_of.values() if t.decode("utf-8", "ignore") not in SPECIAL])).any()


@pytest.fixture(scope="module")
def rows(spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    return real + [(10_000 + i, t) for i, t in enumerate([None, *ODD])] + [(None, "no id"), (10_002, "again")]


def test_round_trip(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", n_tokens int")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(d, len(ids), sha(",".join(map(str, ids))), sha(text)) for d, t in rows for ids, text in [whole(t)]]
    assert sorted(map(tuple, bpe.round_trip(df, PATH).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(df.limit(0), PATH).collect() == []


def test_decode(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, bpe.decode(bpe.encode(df, PATH), PATH).collect()), key=repr)
    assert got == sorted([(d, whole(t)[1]) for d, t in rows], key=repr)
    nothing = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert [tuple(r) for r in bpe.decode(nothing, PATH).collect()] == [(1, "")]


def test_token_files(spark, rows, tmp_path):
    rows = [r for r in rows if r[0] is not None and r[1] != "again"]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", part int").repartition(5)
    token_store.write_tokens(df, str(tmp_path / "t"), PATH)
    want, start = [], 0
    for d, t in sorted(rows):
        ids = [*whole(t)[0], 0]
        want.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    tokens = token_store.read_tokens(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, token_store.checksums(tokens).collect())) == want
    assert sorted(map(tuple, token_store.read_metadata(spark, str(tmp_path / "t")).collect())) == [w[:3] for w in want]
    few = token_store.read_tokens(spark, str(tmp_path / "t"), F.col("doc_id") == 7)
    assert [(r.doc_id, r.start) for r in few.collect()] == [w[:2] for w in want if w[0] == 7]
    metadata = token_store.read_metadata(spark, str(tmp_path / "t"))._jdf.queryExecution().toString()
    assert "ids" not in metadata.split("== Physical Plan ==")[1]


def test_layout(spark, rows, tmp_path):
    token_store.write_tokens(spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA).coalesce(1), str(tmp_path / "t"), PATH)
    group = pq.ParquetFile(max((tmp_path / "t").glob("*.parquet"), key=lambda p: p.stat().st_size)).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert all(c.has_offset_index for c in columns.values())


def test_token_files_of_edges(spark, tmp_path):
    rows = [(2, "b"), (1, None), (2, "a"), (None, "n"), (2, "a")]
    token_store.write_tokens(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "t"), PATH, end_id=0)
    got = sorted([(r.doc_id, r.start, r.n_tokens) for r in token_store.read_tokens(spark, str(tmp_path / "t")).collect()], key=lambda r: r[1])
    assert got == [(None, 0, 2), (1, 2, 1), (2, 3, 2), (2, 5, 2), (2, 7, 2)]
    token_store.write_tokens(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), PATH)
    assert token_store.checksums(token_store.read_tokens(spark, str(tmp_path / "none"))).collect() == []


def test_scripts_of_three_and_four_bytes_are_cut():
    encoder = bpe.FragmentEncoder.of(PATH, digests=False)
    for text in ("統計学的機械翻訳" * 400, "ภาษาไทยง่ายนิดเดียว" * 400, "𠮷野家🙂👍🏽" * 400, "한국어 문장입니다" * 400):
        data, offsets = bpe.text_buffer(pa.array([text]))
        assert max(b - a for a, b in zip(encoder.cuts(data, offsets), encoder.cuts(data, offsets)[1:])) < 400
        assert fragments([text]) == [whole(text)[0]]
    wide = [f"漢{s}字 漢{s}{s} 字{s}" for s in "\u0085        　"]
    assert fragments(wide) == [whole(t)[0] for t in wide]


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 4000)
    encoder = bpe.FragmentEncoder(PATH)
    rng = random.Random(3)
    for _ in range(20):
        texts = ["".join(rng.choices("abcdeé漢 ,.", k=200)) for _ in range(5)]
        ids, ends = encoder.encode(pa.array(texts))[0]
        numbers = memoryview(ids).cast("I").tolist()
        assert [numbers[s // 4 : e // 4] for s, e in zip(ends, ends[1:])] == [whole(t)[0] for t in texts]
        assert sum(x.nbytes for x in (encoder.keys, *encoder.values)) <= 8000


def test_files_that_cannot_be_cut(tmp_path):
    """Another way of splitting would give other ids: an error, not those."""
    import json

    file = json.loads(open(PATH).read())
    bpe.check_cuttable(file)
    split = file["pre_tokenizer"]
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}, {"pre_tokenizer": split | {"add_prefix_space": True}}, {"pre_tokenizer": split | {"use_regex": False}}, {"model": file["model"] | {"dropout": 0.1}}):
        with pytest.raises(ValueError):
            bpe.check_cuttable(file | change)
    other = tmp_path / "other.json"
    other.write_text(json.dumps(file | {"normalizer": {"type": "Lowercase"}}))
    with pytest.raises(ValueError):
        bpe.FragmentEncoder(str(other))
