"""Token ids of whole texts under a public byte-level BPE, exact in its vocabulary file.

The rank file and the added token give the same ids as the tokenizer file of
the same name, and encode several times faster.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa

#: Texts of more characters than this are encoded in parts, cut where the split pattern always cuts.
PART_CHARS = 1 << 20
#: Strings of a text that are one id, as in the tokenizer file; the text is split at them first.
ADDED = {"<|endoftext|>": 50256}
#: Bytes that end no white space, whatever bytes precede them.
_SOLID = np.ones(256, bool)
_SOLID[[*range(33), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
_encoders: dict[str, object] = {}


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """The encoder of a rank file, one per process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
    return _encoders[path]


def _parts(text: str) -> Iterator[str]:
    """Cut before a single space between two letters: the pattern begins a new piece there whatever stands around."""
    lo = 0
    while len(text) - lo > PART_CHARS:
        at = lo + PART_CHARS
        while at > lo and not (text[at] == " " and text[at - 1].isalpha() and text[at + 1 : at + 2].isalpha()):
            at -= 1
        if at == lo:
            break
        yield text[lo:at]
        lo = at
    yield text[lo:]


def _ids(enc, text: str) -> np.ndarray:
    return enc.encode_to_numpy(text, allowed_special="all")


def encode(text: str, path: str) -> np.ndarray:
    """Token ids of a text, uint32."""
    enc = encoder(path)
    if len(text) <= PART_CHARS:
        return _ids(enc, text)
    return np.concatenate([_ids(enc, x) for x in _parts(text)])


@functools.cache
def _lengths(path: str) -> np.ndarray:
    """Each token's bytes."""
    enc = encoder(path)
    return np.array([len(enc.decode_single_token_bytes(k)) for k in range(enc.n_vocab)])


def encode_all(texts: list[bytes], path: str) -> list[np.ndarray]:
    """Token ids of each text (UTF-8), as ``encode`` gives them.

    The pattern always begins a new piece at a space behind something else than
    white space, so texts are cut there and each distinct stretch is encoded
    once.
    """
    raw = b"".join(texts)
    data = np.frombuffer(raw, np.uint8)
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    cut = np.zeros(len(data) + 1, bool)
    np.logical_and(data[1:] == 32, _SOLID[data[:-1]], out=cut[1 : len(data)])
    cut[bounds] = True
    start = np.flatnonzero(cut)
    if len(start) < 2:
        return [np.zeros(0, np.uint32) for _ in texts]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start) - 1, [None, pa.py_buffer(start), pa.py_buffer(raw)]).dictionary_encode()
    number, own = found.indices.to_numpy(), found.dictionary
    at, chars = (np.frombuffer(b, t) for b, t in zip(own.buffers()[1:], (np.int64, np.uint8), strict=True))
    at = at[: len(own) + 1]
    size = np.diff(at)
    # those that begin with such a space and end solid stay apart when joined; the others stand at a text's ends
    joins = (chars[at[:-1]] == 32) & _SOLID[chars[at[1:] - 1]]
    joined = chars[: at[-1]][np.repeat(joins, size)].tobytes().decode()
    ids = encode(joined, path)
    many = np.empty(len(own), np.int64)
    ends = np.cumsum(_lengths(path)[ids])
    many[joins] = np.diff(np.searchsorted(ends, np.cumsum(size[joins])) + 1, prepend=0)
    rest = [encode(own[k].as_py().decode(), path) for k in np.flatnonzero(~joins).tolist()]
    many[~joins] = [len(x) for x in rest]
    order = np.argsort(~joins, kind="stable")
    first = np.empty(len(own), np.int64)
    first[order] = np.cumsum(many[order]) - many[order]
    n = many.take(number)
    to = np.concatenate([[0], np.cumsum(n)])
    place = np.repeat(first.take(number) - to[:-1], n)
    place += np.arange(len(place))
    return np.split(np.concatenate([ids, *rest]).take(place), to[np.searchsorted(start, bounds[1:-1])])
