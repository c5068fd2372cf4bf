"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece's bytes the encoding is unique, so it is enough to store its last token:
token t ends prefix i if t spells the bytes before i, the prefix before t has a last token p, and
p next to t is what the merges would leave (fits()). Appending bytes goes on where the table ends; after
an edit, the table is computed anew only from the edit until it agrees with the old one again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pieces, pairs and prefixes a worker remembers before it forgets them all; bounds its memory only.
PIECES, PAIRS, PREFIXES = 300_000, 300_000, 600_000
#: Prefixes are remembered across pieces of up to this many bytes.
SHORT = 40
NONE = -1


class Vocabulary:
    """Ranks of a byte-level BPE. Merges join any two neighbours whose bytes together have a rank, lowest first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spelt = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: How far back a token that ends in these three bytes, or is as short may begin.
        self.reach: dict[bytes, int] = {}
        for b in ranks:
            self.reach[b[-3:]] = max(self.reach.get(b[-3:], 0), len(b))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._last: dict[bytes, int] = {b"": NONE}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte or a token no merge makes."""
        if token not in self._halves:
            spelt, found = self.spelt[token], None
            for at in range(1, len(spelt)):
                left, right = self.ranks.get(spelt[:at]), self.ranks.get(spelt[at:])
                if left is not None and right is not None and self.made(left) and self.made(right) and self._undo(left, right, token):
                    found = left, right
                    break
            self._halves[token] = found
        return self._halves[token]

    def made(self, token: int) -> bool:
        return len(self.spelt[token]) == 1 or self.halves(token) is not None

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves exactly these two tokens."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[left, right] = self.made(right) and self._undo(left, right, 1 << 60)
        return known

    def _undo(self, left: int, right: int, before: int) -> bool:
        """Take the merges back, last first: at no time may the tokens that meet have had a merge earlier than `before`."""
        ranks, spelt = self.ranks, self.spelt
        while True:
            if ranks.get(spelt[left] + spelt[right], 1 << 60) < before:
                return False
            lh, rh = self.halves(left), self.halves(right)
            if lh is None and rh is None:
                return True
            # of the two merges the one with the higher rank came later; of equal ones the right one
            if rh is None or (lh is not None and left > right):
                before, left = left, lh[1]
            else:
                before, right = right + 1, rh[0]

    def extend(self, piece: bytes, last: list[int], start: int) -> None:
        """Fill last[i] for prefixes of i bytes from start + 1 to the end; last[0..start] stand."""
        rank, known, fits, reach = self.ranks.get, self._fits.get, self.fits, self.reach.get
        del last[start + 1 :]
        for end in range(start + 1, len(piece) + 1):
            found = NONE
            far = reach(piece[end - 3 : end], 2) if end > 2 else end
            for at in range(end - far if end > far else 0, end):
                token = rank(piece[at:end])
                if token is None:
                    continue
                if at:
                    before = last[at]
                    if before == NONE:
                        continue
                    good = known((before, token))
                    if good is None:
                        good = fits(before, token)
                else:
                    good = self.made(token)
                if good:
                    found = token
                    break
            last.append(found)

    def tokens(self, piece: bytes, last: list[int]) -> list[int]:
        out, end = [], len(piece)
        while end:
            out.append(last[end])
            end -= len(self.spelt[last[end]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > SHORT:
            last = [NONE]
            self.extend(piece, last, 0)
            return self.tokens(piece, last)
        # a prefix's last token is the same in every piece: go on from the longest prefix known
        store = self._last
        if len(store) > PREFIXES:
            store.clear()
            store[b""] = NONE
        low, high = 0, len(piece)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if piece[:mid] in store else (low, mid - 1)
        last = [store[piece[:k]] for k in range(low + 1)]
        self.extend(piece, last, low)
        for k in range(low + 1, len(piece) + 1):
            store[piece[:k]] = last[k]
        return self.tokens(piece, last)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelt.__getitem__, ids))


class Editable:
    """A piece's bytes with their table: exact appends, and edits that encode anew only near by."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, piece, [NONE]
        vocabulary.extend(piece, self.last, 0)

    def append(self, more: bytes) -> None:
        start = len(self.piece)
        self.piece += more
        self.vocabulary.extend(self.piece, self.last, start)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Put new in the place of bytes start to end; gives the number of prefixes computed anew.

        Beyond the edit a prefix's last token depends on the last `longest` bytes and entries alone, so
        once that many entries in a row agree with the old ones, the rest of the old table stands.
        """
        old, shift, longest = self.last, len(new) - (end - start), self.vocabulary.longest
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last, agree, at = old[: start + 1], 0, start
        while at < len(self.piece) and agree < longest:
            self.vocabulary.extend(self.piece[: at + 1], self.last, at)
            at += 1
            same = at - shift > end and self.last[at] == old[at - shift]
            agree = agree + 1 if same else 0
        self.last += old[at - shift + 1 :] if at < len(self.piece) else []
        return at - start

    def ids(self) -> list[int]:
        return self.vocabulary.tokens(self.piece, self.last)


class Codec(dict):
    """Texts to ids and back. As a dict it maps a piece to its ids, as decimal text joined by commas."""

    def __init__(self, rank_bytes: bytes, pattern: str):
        super().__init__()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_bytes.splitlines())}
        self.vocabulary = Vocabulary(ranks)
        self.find = regex.compile(pattern).findall
        self.by_name = {str(i): b for i, b in self.vocabulary.spelt.items()}

    def __missing__(self, piece: str) -> str:
        if len(self) >= PIECES:
            self.clear()
        out = ",".join(map(str, self.vocabulary.encode_piece(piece.encode("utf-8", "surrogatepass"))))
        self[piece] = out
        return out

    def encode(self, text: str) -> str:
        return ",".join(map(self.__getitem__, self.find(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.by_name.__getitem__, ids.split(","))) if ids else b""


@lru_cache(2)
def codec(rank_path: str, pattern: str) -> Codec:
    """One for each worker; the file is part of a package that every worker has."""
    with open(rank_path, "rb") as f:
        return Codec(f.read(), pattern)


def encode(docs: DataFrame, rank_path: str, pattern: str, ids: bool = True, digests: bool = False) -> DataFrame:
    """docs (doc_id, text) encoded and decoded, one row for each row; a null text counts as empty.

    Columns: doc_id, n_tokens, with ids also token_ids (array of int), with digests also ids_sha256 and
    decoded_sha256. Each match of the pattern is encoded by itself, without special tokens; text that
    the pattern does not match is left out, as the pattern's own library does. Other columns of docs are left out, whatever their
    names; repeated rows and null ids are rows like others.
    """
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * ids
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_path, pattern)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(1):
                joined = own.encode(text.as_py() or "")
                out[0].append(joined.count(",") + 1 if joined else 0)
                if ids:
                    out[1].append([int(x) for x in joined.split(",")] if joined else [])
                if digests:
                    out[2].append(hashlib.sha256(joined.encode()).hexdigest())
                    out[3].append(hashlib.sha256(own.decode(joined)).hexdigest())
            columns = [batch.column(0), pa.array(out[0], pa.int64())]
            columns += [pa.array(out[1], pa.list_(pa.int32()))] * ids + [pa.array(x, pa.string()) for x in out[2:]] * digests
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text").mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of (doc_id, token_ids). Ids that are not in the ranks raise an error; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_path, pattern).vocabulary
        for batch in batches:
            texts = [None if x.as_py() is None else own.decode(x.as_py()).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as bigint) AS doc_id", "token_ids").mapInArrow(run, "doc_id bigint, text string")
