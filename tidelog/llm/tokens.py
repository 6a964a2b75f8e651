"""Encoding a corpus with a public tokenizer, and back (problem 6).

Texts go through the tokenizers library in Arrow batches. The vocabulary of a byte-level tokenizer is
written with one printable character per byte; decoding reverses that table and joins bytes first, so that a
character split over several tokens comes out whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

#: The vocabulary file; another path may be given everywhere.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"
#: Texts handed to the library at a time, and the characters of them at most (one text at least).
CHUNK, CHUNK_CHARS = 512, 1 << 20


@cache
def tokenizer(path: str):
    """One per worker process; strings of special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def byte_alphabet() -> dict[str, int]:
    """Printable character -> byte, by the rule of byte-level BPE: printable Latin-1 stands for itself, the
    other bytes take the characters from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {chr(b): b for b in own}
    rest = (b for b in range(256) if b not in set(own))
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    t, alphabet = tokenizer(path), byte_alphabet()
    out = []
    for i in range(t.get_vocab_size(True)):
        token = t.id_to_token(i)
        special = token is None or any(c not in alphabet for c in token)
        out.append((token or "").encode() if special else bytes(alphabet[c] for c in token))
    return out


def decode_ids(ids, path: str = BYTE_BPE_50K) -> str:
    """The text of a list of ids; bytes that are no UTF-8 (a list cut within a character) become U+FFFD."""
    vocabulary = token_bytes(path)
    return b"".join([vocabulary[i] for i in ids]).decode("utf-8", "replace")


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(start, texts) of parts small enough that the library's results stay small; nulls are empty."""
    start, part, chars = 0, [], 0
    for i, x in enumerate(texts):
        if part and (len(part) == CHUNK or chars + len(x or "") > CHUNK_CHARS):
            yield start, part
            start, part, chars = i, [], 0
        part.append(x or "")
        chars += len(x or "")
    if part:
        yield start, part


@cache
def token_sizes(path: str) -> np.ndarray:
    return np.array([len(b) for b in token_bytes(path)], dtype=np.int64)


def character_spans(texts: list[str], ids: np.ndarray, lengths: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First and end character, in its text, of each token of all texts: the tokens' bytes are counted on, then
    each byte is mapped to its character."""
    data = [t.encode() for t in texts]
    own = np.frombuffer(b"".join(data), dtype=np.uint8)
    character = np.cumsum((own & 0xC0) != 0x80) - 1
    end = np.cumsum(token_sizes(path)[ids])
    if len(ids) and end[-1] != len(own):
        raise ValueError("the tokens do not have the bytes of the texts")
    begin = np.cumsum([0, *map(len, texts)])[:-1].repeat(lengths)
    return character[end - token_sizes(path)[ids]] - begin, character[end - 1] + 1 - begin


def encode(documents: DataFrame, text: str = "text", path: str = BYTE_BPE_50K, offsets: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and `ids` (array<int>), without special tokens, of every row.

    An empty text and a null text have the empty list. A text is encoded whole, however long. With `offsets` also
    `starts` and `ends` in characters: tokens that share a split character have the same ones. Other
    columns of `documents` are dropped, whatever their names. No shuffle.
    """
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    extra = ", starts array<int>, ends array<int>" if offsets else ""

    def run(batches):
        import pyarrow as pa

        t = tokenizer(path)
        for b in batches:
            texts = b["_text"].to_pylist()
            for start, part in chunks(texts):
                found = [x.ids for x in t.encode_batch_fast(part, add_special_tokens=False)]
                lengths = np.array([len(x) for x in found], dtype=np.int64)
                at = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                ids = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(lengths.sum()))
                values = [ids, *(character_spans(part, ids, lengths, path) if offsets else ())]
                columns = [b[c].slice(start, len(part)) for c in keep] + [pa.ListArray.from_arrays(at, pa.array(v, pa.int32())) for v in values]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids", *(["starts", "ends"] if offsets else [])])

    return documents.select(*keep, documents[text].alias("_text")).mapInArrow(run, f"{kinds}, ids array<int>{extra}")


def count_tokens(documents: DataFrame, text: str = "text", path: str = BYTE_BPE_50K, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and `tokens` (bigint): how many ids each text has; 0 for an empty or null one."""
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        import pyarrow as pa

        t = tokenizer(path)
        for b in batches:
            texts, n = b["_text"].to_pylist(), []
            for _, part in chunks(texts):
                n += [len(x) for x in t.encode_batch_fast(part, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    return documents.select(*keep, documents[text].alias("_text")).mapInArrow(run, f"{kinds}, tokens bigint")


@cache
def _byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, and where each begins."""
    sizes = token_sizes(path)
    return np.frombuffer(b"".join(token_bytes(path)), dtype=np.uint8), np.cumsum(sizes) - sizes


def decode_lists(lists, path: str = BYTE_BPE_50K):
    """Arrow strings of an Arrow array of lists of ids; null for a null list. The bytes of all tokens are
    gathered at once; only if a list is cut within a character are texts decoded one by one."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ids = lists.flatten().to_numpy()
    rows = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
    data, begin = _byte_table(path)
    size = token_sizes(path)[ids]
    end = np.cumsum(size)
    gathered = data[np.arange(end[-1] if len(end) else 0) + np.repeat(begin[ids] - (end - size), size)]
    at = np.concatenate([[0], end])[rows].astype(np.int32)
    raw = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at), pa.py_buffer(gathered)])
    try:
        texts = raw.cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
    return pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string())) if lists.null_count else texts


#: Ids decoded at a time (one list at least).
CHUNK_IDS = 1 << 20


def decode(encoded: DataFrame, path: str = BYTE_BPE_50K, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and `text` of lists of ids; null for a null list. Exact for lists made by `encode`."""
    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            so_far = np.cumsum(pc.fill_null(pc.list_value_length(b["ids"]), 0).to_numpy())
            cuts = np.unique(np.concatenate([[0], np.nonzero(np.diff(so_far // CHUNK_IDS))[0] + 1, [b.num_rows]]))
            for start, stop in zip(cuts, cuts[1:]):
                part = b.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*[part[c] for c in keep], decode_lists(part["ids"], path)], names=[*keep, "text"])

    return encoded.select(*keep, "ids").mapInArrow(run, f"{kinds}, text string")
