"""Byte-level BPE over whole documents by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be merged
over, so a text may be cut there. Where such a cut also is a sure boundary of
the pre-tokenizer, or lies inside one of its pieces, the fragments encode on
their own and their ids, put together, are those of the whole text. Fragments
are short and repeat, so each distinct one of a worker's texts is encoded once.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, text_buffer, text_pieces

#: Bytes of fragments, ids and digests that a worker remembers between batches.
REMEMBERED_BYTES = 16 << 20
#: A longer fragment (bytes) is not remembered.
LONGEST = 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def forced_pairs(tokens: list[bytes]) -> np.ndarray:
    """[left, right]: True where the two bytes are adjacent in no token."""
    free = np.ones((256, 256), bool)
    for t in tokens:
        for a, b in zip(t, t[1:]):
            free[a, b] = False
    return free


def safe_pairs(free: np.ndarray) -> np.ndarray:
    """Forced pairs at which the pre-tokenizer can be restarted as well.

    It never joins a non-space to a following space, and a run of letters,
    digits or marks may be cut where no merge crosses. Left out: a left side
    that is or may be white space (what follows then depends on it), a quote
    after a mark, where a contraction would begin anew, and a right side that
    goes on with a character. cuts() leaves out wider white space.
    """
    safe = free.copy()
    safe[:0x21] = False
    safe[:, 0x80:0xC0] = False
    mark = np.zeros(256, bool)
    mark[0x21:0x7F] = True
    mark[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
    mark[0x7F:] = True
    safe[mark, ord("'")] = False
    safe[0xC0:] = False
    return safe


#: [lead, second byte] of the characters of three bytes among which white space is.
BLANK = np.zeros((256, 256), bool)
BLANK[[0xE1, 0xE2, 0xE2, 0xE3], [0x9A, 0x80, 0x81, 0x80]] = True


def check_cuttable(file: dict) -> None:
    """An error unless cutting texts first gives the ids of the whole: the pairs
    that may be cut are known for plain byte-level BPE with its own pattern."""
    split, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    bare = all(not model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    loose = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in file.get("added_tokens", []))
    if file.get("normalizer") or not plain or model.get("type") != "BPE" or not bare or loose:
        raise ValueError("texts can be cut for byte-level BPE with its own pattern only, without normalizer, prefix space or added tokens that take in what is beside them")


class FragmentEncoder:
    """Encodes batches of texts through fragments; one for each worker and file.

    ``digests``: whether decimal ids and decoded bytes are wanted beside the ids;
    ``decimals``: False if decoded bytes alone are.
    """

    _made: dict[tuple[str, bool, bool], FragmentEncoder] = {}

    def __init__(self, path: str, digests: bool = True, decimals: bool = True):
        from tokenizers import Tokenizer

        # a task has one core, and each further thread keeps memory of its own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        check_cuttable(json.loads(self.tokenizer.to_str()))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters = byte_alphabet()
        added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = list(added.values())
        bytes_of = {i: bytes(letters[c] for c in t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.safe = safe_pairs(forced_pairs(list(bytes_of.values()))).ravel()
        bytes_of |= added
        self.digests = digests
        most = max(bytes_of)
        self.vocabulary = pa.array([bytes_of.get(i, b"") for i in range(most + 1)], pa.large_binary())
        self.tables = [self.vocabulary] if digests else []
        if digests and decimals:
            self.tables.insert(0, pa.array([b"%d," % i for i in range(most + 1)], pa.large_binary()))
        self.keys = pa.array([], pa.binary())
        self.values = [pa.array([], pa.large_binary())] * (1 + len(self.tables))

    @property
    def bytes_of(self) -> dict[int, bytes]:
        """The bytes of each token that the vocabulary holds, by id."""
        return {i: b for i, b in enumerate(self.vocabulary.to_pylist()) if b}

    @classmethod
    def of(cls, path: str, digests: bool = True, decimals: bool = True) -> FragmentEncoder:
        key = (path, digests, decimals)
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where fragments begin, and the end of the last."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            cut[1:-1] = self.safe[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        # white space of two and three bytes must not end a fragment
        if len(data) > 1:
            cut[np.minimum(np.flatnonzero(data == 0xC2) + 2, len(data))] = False
            blank = np.flatnonzero((data[:-1] >= 0xE1) & (data[:-1] <= 0xE3))
            blank = blank[BLANK[data[blank], data[blank + 1]]]
            cut[np.minimum(blank + 3, len(data))] = False
        raw = data.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                cut[at + 1 : at + len(s)] = False
                at = raw.find(s, at + 1)
        cut[offsets] = True
        return np.flatnonzero(cut)

    def _encoded(self, fragments: pa.Array) -> list[pa.Array]:
        """The values of each fragment: its ids as little-endian 32-bit integers
        and, with digests, "id," for each and the bytes that they decode to."""
        sizes, flat = np.zeros(len(fragments) + 1, np.int64), []
        for s in range(0, len(fragments), 2_000):
            texts = fragments.slice(s, 2_000).cast(pa.string()).to_pylist()
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes[s + 1 : s + 1 + len(ids)] = list(map(len, ids))
            flat.append(np.fromiter(chain.from_iterable(ids), "<i4"))
        ids, ends = np.concatenate(flat), np.cumsum(sizes)
        out = [_binary(ends * 4, ids)]
        for table in self.tables:
            whole = table.take(pa.array(ids))
            out.append(_binary(np.frombuffer(whole.buffers()[1], np.int64)[: len(ids) + 1][ends], whole.buffers()[2]))
        return out

    def learn(self, fragments: pa.Array) -> list[pa.Array]:
        """The values of each fragment, each distinct new one encoded once.

        What is remembered is bounded in bytes: beyond the bound only the
        fragments of these texts stay, or none if these alone are too many.
        """
        at = pc.index_in(fragments, value_set=self.keys)
        values = self.values
        if at.null_count:
            missing = pc.is_null(at)
            distinct = fragments.filter(missing).dictionary_encode()
            new = distinct.dictionary
            fresh = self._encoded(new)
            keys, values = pa.concat_arrays([self.keys, new]), [pa.concat_arrays([v, f]) for v, f in zip(values, fresh)]
            at = pc.replace_with_mask(at, missing, pc.add(distinct.indices, pa.scalar(len(self.keys), pa.int32())))
            short = pc.less_equal(pc.binary_length(keys), LONGEST)
            used = pa.array(np.bincount(at.to_numpy(), minlength=len(keys)) > 0)
            for kept in (short, pc.and_(short, used), pc.and_not(short, short)):
                some = [x.filter(kept) for x in (keys, *values)]
                if sum(x.nbytes for x in some) <= REMEMBERED_BYTES:
                    break
            self.keys, self.values = some[0], some[1:]
        return [v.take(at) for v in values]

    def encode(self, column: pa.Array) -> tuple[tuple[pa.Buffer | bytes, np.ndarray], ...]:
        """For ids and, with digests, decimals and decoded: (bytes, text offsets)."""
        data, offsets = text_buffer(column)
        if not len(data):
            return ((b"", np.zeros(len(offsets), np.int64)),) * len(self.values)
        cuts = self.cuts(data, offsets)
        count = len(cuts) - 1
        fragments = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
        first = np.searchsorted(cuts, offsets)
        out = []
        for whole in self.learn(fragments):
            ends = np.frombuffer(whole.buffers()[1], np.int64)[: count + 1]
            out.append((whole.buffers()[2] or b"", ends[first]))
        return tuple(out)


def _binary(ends: np.ndarray, body) -> pa.Array:
    body = pa.py_buffer(body) if isinstance(body, np.ndarray) else body
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends)), body])


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` put after the ids of each text, and the offsets that result."""
    ends = ends + np.arange(len(ends))
    out = np.full(int(ends[-1]), end_id, np.int32)
    own = np.ones(len(out), bool)
    own[ends[1:] - 1] = False
    out[own] = ids
    return out, ends


def share_tokenizer(df: DataFrame, path: str) -> str:
    """Send the tokenizer file to all executors; its name there."""
    sc = df.sparkSession.sparkContext
    sent = sc.__dict__.setdefault("_offerloom_files", set())
    if path not in sent:
        sc.addFile(path)
        sent.add(path)
    return path.rsplit("/", 1)[-1]


def _digests(name: str, id_column: str):
    schema = pa.schema([(id_column, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = FragmentEncoder.of(SparkFiles.get(name))
        for piece in text_pieces(batches, "text", 2 << 20):
            (_, ids), (decimals, d), (decoded, t) = encoder.encode(piece.column("text"))
            sha = lambda b: hashlib.sha256(b).hexdigest()
            decimals, decoded = memoryview(decimals), memoryview(decoded)
            decoded = [_as_text(decoded[s:e]) for s, e in zip(t.tolist(), t[1:].tolist())]
            yield pa.RecordBatch.from_arrays([piece.column(id_column), pa.array(np.diff(ids) // 4, pa.int64()), pa.array([sha(decimals[s : max(s, e - 1)]) for s, e in zip(d.tolist(), d[1:].tolist())]), pa.array([sha(b) for b in decoded])], schema=schema)

    return run


def _as_text(b: bytes | memoryview) -> bytes:
    """As the decoder does, what isn't UTF-8 becomes replacement characters."""
    return str(b, "utf-8", "replace").encode()


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode each text, decode the ids, and return sizes and digests.

    Takes (doc_id bigint, text string, ...) and the path of a byte-level BPE
    file of the tokenizers library. Returns (doc_id, n_tokens, ids_sha256,
    decoded_sha256), one row for each row. Ids are those of ``encode`` without
    special tokens, truncation or padding; text that spells an added token
    encodes to it. A null or empty text has no ids; both digests are then those
    of the empty string. Repeated ids and other columns are let be.
    """
    ship_package(docs.sparkSession)
    name = share_tokenizer(docs, tokenizer)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(_digests(name, "doc_id"), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _ids(name: str, end_id: int | None, digest: bool):
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))]
    schema = pa.schema(fields + ([("decoded_sha256", pa.string())] if digest else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = FragmentEncoder.of(SparkFiles.get(name), digest, decimals=False)
        for piece in text_pieces(batches, "text", 2 << 20):
            (ids, ends), *more = encoder.encode(piece.column("text"))
            ids, ends = np.frombuffer(ids, np.int32), ends // 4
            if end_id is not None:
                ids, ends = with_end(ids, ends, end_id)
            columns = [piece.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
            if digest:
                decoded, at = memoryview(more[0][0]), more[0][1].tolist()
                columns.append(pa.array([hashlib.sha256(_as_text(decoded[s:e])).hexdigest() for s, e in zip(at, at[1:])]))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def encode(docs: DataFrame, tokenizer: str, end_id: int | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>) of each row of (doc_id, text).

    ``end_id``, if given, is put after the ids of each document and counted. With
    ``digest``, the ids (but for ``end_id``) are decoded as well, and
    decoded_sha256 is the digest of that text. A null or empty text has no ids
    and decodes to the empty one.
    """
    ship_package(docs.sparkSession)
    name = share_tokenizer(docs, tokenizer)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(_ids(name, end_id, digest), "doc_id bigint, n_tokens bigint, ids array<int>" + (", decoded_sha256 string" if digest else ""))


def _texts(name: str):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = FragmentEncoder.of(SparkFiles.get(name), digests=False)
        vocabulary = encoder.vocabulary
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("ids").slice(row, 1).flatten()
                body = vocabulary.take(pc.fill_null(ids, 0)).buffers()[2]
                text = _as_text(body.to_pybytes() if body is not None and len(ids) else b"")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, 1), pa.array([text.decode()])], schema=schema)

    return run


def decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids array<int>); null ids give the empty text."""
    ship_package(tokens.sparkSession)
    name = share_tokenizer(tokens, tokenizer)
    tokens = tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return tokens.mapInArrow(_texts(name), "doc_id bigint, text string")
