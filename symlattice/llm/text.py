"""Words and tokens of Arrow text columns, vectorised."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the separators of words are U+0020 and U+0009 to U+000D.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Text bytes that a worker holds as arrays at once; a longer document is taken alone.
CHUNK_BYTES = 2_000_000
BATCH_BYTES = "8m"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_table = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_lower = np.arange(256)
_lower[65:91] += 32
_lower_table = _table[_lower]


def words(text: Column) -> Column:
    """Array of the words of a text (null: none), as a column."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def unused(names: list[str], *wanted: str) -> list[str]:
    """Each name, or what is left free by ``names`` (compared as Spark does, without case) if that is taken: for columns beside a caller's own."""
    taken = {n.lower() for n in names}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though it is used more than once."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = _BASE, _INVERSE
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash's base and of its inverse, modulo 2**64."""
    size = 1 << max(12, (n - 1).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray, lower: bool) -> np.ndarray:
    """Prefix sums of byte values times powers; differences give the hash of any span."""
    up, _ = powers(max(1, len(data)))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_lower_table if lower else _table)[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def bounded_batches(spark) -> None:
    """Let Arrow batches between the JVM and Python be a few MB, unless the session says how large they may be.

    Texts and blocks are long; without it a batch of ten thousand of them is held twice, on either side.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in {k for k, _ in spark.sparkContext.getConf().getAll()} and spark.conf.get(name, None) != BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` text bytes, a longer text alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the number of its first word (one more at the end)."""
    inside = ~_space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1 : len(data)]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1 : len(data)]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and for each document the number of its first word (one more at the end)."""
    data, offsets = text_bytes(column)
    starts, ends, bounds = word_spans(data, offsets)
    return span_hash(prefix_hash(data, lower), starts, ends), bounds


@functools.cache
def byte_values() -> dict[str, int]:
    """Characters of byte-level vocabularies to the bytes they stand for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


#: Fixed: the pattern by which byte-level BPE of this kind splits text before merging.
BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: White space in a row from which a text is left to the tokenizers library: the splitting pattern of the other one keeps a step for each character of it.
LONG_RUN = re.compile(r"\s{10000}")


@functools.cache
def encoder(path: str):
    """text -> list of ids, as the tokenizers library gives them with add_special_tokens=False, by the tokenizer file at ``path``.

    A special token that a text holds gets its own id, as there. A byte-level BPE file whose ids follow its merges is run by tiktoken, which gives the same ids
    several times faster, but for texts with very long runs of white space; any other file by the tokenizers library.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    slow = lambda text: own.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    parts, pre = model.get("model", {}), model.get("pre_tokenizer") or {}
    added = model.get("added_tokens", [])
    special = {x["content"]: x["id"] for x in added}
    simple = not any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(a != b and a.startswith(b) for a in special for b in special)
    vocab = {k: v for k, v in parts.get("vocab", {}).items() if k not in special} if parts.get("type") == "BPE" else {}
    letters = byte_values()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in parts.get("merges", [])]
    ordered = bool(merges) and [vocab.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges)))
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and not model.get("normalizer") and not parts.get("dropout") and not parts.get("ignore_merges")
    if simple and ordered and plain and all(c in letters for k in vocab for c in k):
        import tiktoken

        ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items()}
        fast = tiktoken.Encoding("own", pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: slow(text) if LONG_RUN.search(text) else fast.encode(text, allowed_special="all", disallowed_special=())
    return slow


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
