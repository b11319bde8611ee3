"""Byte-level BPE by forced-boundary splitting (operator 4).

A byte pair that stands in no token of the vocabulary can never be merged over, so the text may be cut
between the two bytes: the fragments are encoded alone (and remembered, since most are words) and their ids
concatenated. Two further conditions keep a cut from changing what the splitting pattern sees: the character
before the cut is no white space (white-space runs look ahead), and the one after it is no apostrophe (it
could begin a contraction). Texts holding white space beyond ASCII are cut after ASCII characters only.

The vocabulary must number its tokens in the order of its merges, as byte-level vocabularies do; this is checked when it
is loaded. Edge cases: null and empty texts have no tokens; the string of a special token becomes its id, as in the
tokenizers library; any length of text is taken, in memory proportional to that text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from melospark.llm.common import texts

#: Fixed values of the vocabulary's splitting pattern and special token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = "<|endoftext|>"

#: Fragments remembered by each Python worker; at some 200 bytes an entry this stays near 40 MB.
CACHE_ENTRIES = 200_000

_WIDE_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def default_vocabulary() -> str:
    """Path of the vocabulary file, which is never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in a byte-level vocabulary: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def _pair(merge: str | list[str]) -> list[str]:
    return merge.split(" ") if isinstance(merge, str) else merge


class FragmentEncoder:
    """Encodes and decodes with one vocabulary; ids are kept as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {
            bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special
        }
        made = [ranks.get(bytes(alphabet[c] for c in "".join(pair))) for pair in map(_pair, spec["model"]["merges"])]
        if None in made or any(a >= b for a, b in zip(made, made[1:], strict=False)):
            raise ValueError("token ids are not in the order of the merges")
        self.special = special
        self.token_bytes: list[bytes] = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for token, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.token_bytes[i] = token
        self.token_length = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._encode_pieces = encoding.encode_ordinary
        self._split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.cut = self._cut_table(ranks)
        self._flat_cut = self.cut.reshape(-1)
        self._known: dict[bytes, bytes] = {}

    @staticmethod
    def _cut_table(tokens) -> np.ndarray:
        """cut[a, b]: a certain boundary lies between bytes a and b."""
        cut = np.ones((256, 256), dtype=bool)
        for token in tokens:
            if len(token) > 1:
                b = np.frombuffer(token, dtype=np.uint8)
                cut[b[:-1], b[1:]] = False
        cut[list(b" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"), :] = False  # white space looks ahead
        cut[:, ord("'")] = False  # may begin a contraction
        cut[:, 0x80:0xC0] = False  # inside a character
        return cut

    def _fragments(self, data: bytes, narrow: bool) -> list[bytes]:
        b = np.frombuffer(data, dtype=np.uint8).astype(np.intp)
        hit = self._flat_cut.take((b[:-1] << 8) | b[1:])
        if narrow:
            hit &= b[:-1] < 0x80
        cuts = (np.flatnonzero(hit) + 1).tolist()
        return [data[i:j] for i, j in zip([0, *cuts], [*cuts, len(data)], strict=True)]

    def _encode_plain(self, text: str) -> bytes:
        if not text:
            return b""
        known = self._known
        fragments = self._fragments(text.encode("utf-8", "replace"), bool(_WIDE_SPACE.search(text)))
        ids = list(map(known.get, fragments))
        if len(known) >= CACHE_ENTRIES:
            known.clear()
        k = -1
        for _ in range(ids.count(None)):
            k = ids.index(None, k + 1)
            fragment = fragments[k]
            encoded = self._encode_pieces(fragment.decode())
            ids[k] = struct.pack(f"<{len(encoded)}I", *encoded)
            if len(fragment) <= 64:
                known[fragment] = ids[k]
        return b"".join(ids)

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._split is None or not self._split.search(text):
            return self._encode_plain(text)
        return b"".join(
            np.array([self.special[part]], dtype="<u4").tobytes() if part in self.special else self._encode_plain(part)
            for part in self._split.split(text)
        )

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        table = self.token_bytes
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


@functools.cache
def encoder(vocabulary: str) -> FragmentEncoder:
    """One encoder for each Python worker and vocabulary."""
    return FragmentEncoder(vocabulary)


def encode_decode(docs: DataFrame, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encode every text, decode the ids again: one row per row of ``docs``.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep_ids`` also ids (array) and decoded.
    Map-only: no shuffle, and memory is that of one Arrow batch.
    """
    vocabulary = vocabulary or default_vocabulary()
    more = ", ids array<long>, decoded string" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            n, ids_hash, decoded_hash, kept, back = [], [], [], [], []
            for text in batch["text"]:
                ids = bpe.encode(text.as_py())
                decoded = bpe.decode(ids)
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                decoded_hash.append(hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
                if keep_ids:
                    kept.append(np.frombuffer(ids, dtype="<u4").astype(np.int64))
                    back.append(decoded)
            columns = [batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(kept, pa.list_(pa.int64())), pa.array(back, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
