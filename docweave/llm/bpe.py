"""BPE encoding and decoding through a table of distinct words.

Texts are split into words in Spark, each distinct word is encoded once whatever its number of occurrences, and its ids
go back to the places where it stands.  Decoding joins the ids of each distinct word with the table of their pieces, and
what comes out goes to the same places.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from docweave.llm.blocks import buckets, document_blocks, open_block, pack_arrays, squeeze, unpack_arrays, unsqueeze, with_answers


@cache
def _tokenizer(vocabulary: str) -> Tokenizer:
    t = Tokenizer.from_file(vocabulary)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def _added(vocabulary: str) -> re.Pattern | None:
    words = [re.escape(a.content) for a in _tokenizer(vocabulary).get_added_tokens_decoder().values()]
    return re.compile(f"({'|'.join(sorted(words, key=len, reverse=True))})") if words else None


def split_words(text: str, vocabulary: str) -> list[str]:
    """Words that make up the text and whose ids, one after the other, are the ids of the text.

    A word starts at a space or line end that no white space comes before; no pre-token of a byte-level vocabulary
    reaches over such a place.  Texts with longer runs of white space are split into the pre-tokens themselves.
    """
    pieces = text.replace("\n", " \n").split(" ")
    last = len(pieces) - 1
    if all(p and not p[-1].isspace() for p in set(pieces[1:last])) and not pieces[0][-1:].isspace() and (not last or pieces[last]):
        return [pieces[0], *[p if p[0] == "\n" else " " + p for p in pieces[1:]]]
    words, pre, added = [], _tokenizer(vocabulary).pre_tokenizer, _added(vocabulary)
    for part in added.split(text) if added else [text]:
        if added and added.fullmatch(part):
            words.append(part)
        elif part:
            words += [part[a:b] for _, (a, b) in pre.pre_tokenize_str(part)]
    return words


def _by_bucket(table: pa.Table, vocabulary: str, n: int) -> tuple[list[list[str]], dict[int, list[str]]]:
    """Words of each document of a block, and the block's distinct words, sorted, by the bucket of their hash."""
    texts = [split_words(t or "", vocabulary) for t in table["text"].to_pylist()]
    found: dict[int, list[str]] = {}
    for w in sorted(set().union(*texts)):
        found.setdefault(zlib.crc32(w.encode()) % n, []).append(w)
    return texts, found


def _join(words: list[str]) -> bytes:
    return pack_arrays(np.array([len(w) for w in words], "<u4"), np.frombuffer("".join(words).encode("utf-32-le"), "<u4")) if any("\0" in w for w in words) else b"\0" + squeeze("\0".join(words).encode())


def _cut(data: bytes) -> list[str]:
    if data[:1] == b"\0":
        return unsqueeze(data[1:]).decode().split("\0")
    lengths, chars = unpack_arrays(data, "<u4", "<u4")
    text, edges = chars.tobytes().decode("utf-32-le"), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return [text[a:b] for a, b in zip(edges[:-1], edges[1:])]


def word_requests(blocks: DataFrame, vocabulary: str) -> DataFrame:
    """bucket, block_id, words: each block's distinct words, dealt by a hash of the word."""
    n = buckets(blocks.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, payload in zip(batch.column("block_id").to_pylist(), batch.column("payload")):
                found = _by_bucket(open_block(payload.as_py()), vocabulary, n)[1]
                yield pa.RecordBatch.from_arrays([pa.array([*found], pa.int32()), pa.array([block_id] * len(found), pa.int64()), pa.array([_join(w) for w in found.values()], pa.binary())], names=["bucket", "block_id", "words"])

    return blocks.mapInArrow(work, "bucket int, block_id bigint, words binary")


@cache
def piece_table(vocabulary: str) -> pa.Table:
    """id and piece, the bytes that each id stands for; as many rows as the vocabulary has ids."""
    tokenizer = _tokenizer(vocabulary)
    letters = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    others = [b for b in range(256) if b not in set(letters)]
    byte = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(others)}
    added = {i: a.content for i, a in tokenizer.get_added_tokens_decoder().items()}
    vocab = {i: p for p, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    pieces = [added[i].encode() if i in added else bytes(byte[c] for c in vocab[i]) for i in sorted(vocab)]
    return pa.table({"id": pa.array(sorted(vocab), pa.uint32()), "piece": pa.array(pieces, pa.large_binary())})


def decode_words(ids: np.ndarray, lengths: np.ndarray, vocabulary: str) -> list[bytes]:
    """The bytes of words by a join of their ids with the table of pieces, put back in order by position."""
    placed = pa.table({"id": pa.array(ids.astype(np.uint32)), "place": pa.array(np.arange(len(ids)))})
    pieces = placed.join(piece_table(vocabulary), "id").sort_by("place")["piece"].combine_chunks()
    data = b"".join(pieces.to_pylist())
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(pieces), 0).to_numpy(zero_copy_only=False))]) if len(ids) else np.zeros(1, np.int64)
    edges = sizes[np.concatenate([[0], np.cumsum(lengths)])].tolist()
    return [data[a:b] for a, b in zip(edges[:-1], edges[1:])]


def encode_distinct(requests: DataFrame, vocabulary: str) -> DataFrame:
    """Encodes every distinct word of a bucket once, decodes it again, and answers each block in the order of its words.

    ``odd`` lists words of the answer, by place, whose ids decode to other bytes than their own, with these bytes.
    """

    def work(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        asked = [_cut(w) for w in rows["words"].to_pylist()]
        words, tokenizer, known, odd = list(set().union(*asked)), _tokenizer(vocabulary), {}, {}
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            found = [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            known.update((w, x.tobytes()) for w, x in zip(part, found))
            back = decode_words(np.concatenate(found), np.array([len(x) for x in found]), vocabulary)
            odd.update((w, x) for w, x in zip(part, back) if x != w.encode())
        ids = [pack_arrays(np.array([len(known[w]) // 4 for w in a], "<u4"), np.frombuffer(b"".join([known[w] for w in a]), "<u4")) for a in asked]
        crc = [zlib.crc32("".join(a).encode()) for a in asked]
        strange = [[{"at": i, "bytes": odd[w]} for i, w in enumerate(a) if w in odd] if odd else [] for a in asked]
        return pa.table({"bucket": pa.array([bucket] * len(ids), pa.int32()), "block_id": rows["block_id"], "ids": pa.array(ids, pa.binary()), "crc": pa.array(crc, pa.int64()), "odd": pa.array(strange, pa.list_(pa.struct([("at", pa.int32()), ("bytes", pa.binary())])))})

    return requests.groupBy("bucket").applyInArrow(work, "bucket int, block_id bigint, ids binary, crc bigint, odd array<struct<at:int,bytes:binary>>")


def encode_and_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the text decoded from them, of every whole text.

    A null text is empty: no ids and the digest of nothing.  Rows repeat as in the input, an empty table gives none, and
    further columns are ignored.  Strings of special tokens in a text count as these tokens, as the library does it.
    """
    blocks = document_blocks(docs)
    answers = encode_distinct(word_requests(blocks, vocabulary), vocabulary)
    n = buckets(docs.sparkSession)

    def finish(_: int, payload: bytes, given: dict[int, dict]) -> pa.Table:
        table, known, odd = open_block(payload), {}, {}
        texts, found = _by_bucket(table, vocabulary, n)
        for bucket, words in found.items():
            if given[bucket]["crc"] != zlib.crc32("".join(words).encode()):
                raise ValueError("ids of other words came back")
            lengths, ids = unpack_arrays(given[bucket]["ids"], "<u4", "<u4")
            raw, edges = ids.tobytes(), (4 * np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])).tolist()
            known.update((w, raw[a:b]) for w, a, b in zip(words, edges[:-1], edges[1:]))
            odd.update((words[o["at"]], o["bytes"]) for o in given[bucket]["odd"])
        joined = [b"".join(map(known.__getitem__, words)) for words in texts]
        decoded = [b"".join([odd[w] if w in odd else w.encode() for w in words]).decode("utf-8", "replace").encode() if odd else "".join(words).encode() for words in texts]
        digest = lambda x: hashlib.sha256(x).hexdigest()
        return pa.table({"doc_id": table["doc_id"], "n_tokens": pa.array([len(x) // 4 for x in joined], pa.int64()), "ids_sha256": pa.array(map(digest, joined), pa.string()), "decoded_sha256": pa.array(map(digest, decoded), pa.string())})

    return with_answers(blocks, answers, finish, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
