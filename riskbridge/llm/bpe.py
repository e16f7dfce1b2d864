"""Byte-pair encoding with a fixed vocabulary of merges, and decoding.

A word's longest tokens at each place come from one Aho-Corasick pass. The encoder takes the longest token at each place
that is compatible with the token before it, falls back to shorter tokens, and steps back where none fits. Two tokens
are compatible if no merge across their border would have happened before they were complete; a sequence of pairwise
compatible tokens is exactly what the merges give, and every place is given up once at most. Decoding copies token
strings from one block by a table of offsets.
"""

import json
import unicodedata
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from riskbridge.llm.arrow import kept, per_batch

WORD_END = "Ā"  # follows the last byte of a word; bytes themselves are written as U+0000 to U+00FF
# Unicode white space.
_BLANK = regex.compile("[\t-\r \x85\xa0  -     　]+")

_ODD_BLANK = regex.compile("[\x1c-\x1f]")  # Python splits at these, the vocabulary doesn't


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class Recent:
    """A bounded memory of what was asked for lately: when it is full, entries not asked for since it last was are dropped."""

    def __init__(self, size: int) -> None:
        self.size, self.recent, self.older = size, {}, {}

    def get(self, key: str) -> bytes | None:
        out = self.recent.get(key)
        return self.put(key, out) if out is None and (out := self.older.get(key)) is not None else out

    def put(self, key: str, value: bytes) -> bytes:
        if len(self.recent) >= self.size:
            self.older = dict(self.recent)
            self.recent.clear()
        self.recent[key] = value
        return value


class Vocabulary:
    """Tables for encoding and decoding, from the text of a tokenizer file with merges, a word pattern and word ends."""

    def __init__(self, source: str, words_kept: int = 250_000) -> None:
        spec = json.loads(source)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        letter_byte = {c: chr(b) for b, c in enumerate(byte_letters())}

        def inner(token: str) -> str:
            stem = token.removesuffix(end)
            return "".join(letter_byte[c] for c in stem) + (WORD_END if stem != token else "")

        ids = model["vocab"]
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}  # of the merge that makes a token; -1 for single letters
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            token = ids[a + b]
            if token not in self.parts:
                self.parts[token], self.rank[token] = (ids[a], ids[b]), rank
            self.merged[ids[a], ids[b]] = rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_text = {inner(t): i for t, i in ids.items() if t not in self.special}
        self.size = {i: len(t) for t, i in by_text.items()}
        self.matcher = ahocorasick.Automaton()
        for t, i in by_text.items():
            self.matcher.add_word(t, i)
        self.matcher.make_automaton()
        self.shorter: dict[int, int | None] = {}
        for t, i in by_text.items():
            self.shorter[i] = next((by_text[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in by_text), None)
        self.fits: dict[tuple[int, int], bool] = {}
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words_seen, self.chunks_seen = Recent(words_kept), Recent(words_kept)
        strings = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for t, i in [*ids.items(), *self.special.items()]:
            strings[i] = t.encode() + b" "
        self.block = np.frombuffer(b"".join(strings), np.uint8)
        self.length = np.array([len(s) for s in strings], np.int64)
        self.offset = np.cumsum(self.length) - self.length

    def _spine(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """Tokens that stand at one end while `token` is built: (token, rank that makes it, rank that ends it)."""
        out, ends = [], float("inf")
        while True:
            born = self.rank.get(token, -1)
            out.append((token, born, ends))
            if token not in self.parts:
                return out
            ends, token = born, self.parts[token][side]

    def compatible(self, a: int, b: int) -> bool:
        """No merge across the border of a and b comes before both are whole. Of equal merges the left one comes first."""
        if (a, b) not in self.fits:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            right = self._spine(b, 0)
            self.fits[a, b] = not any(
                (r := self.merged.get((x, y), -1)) > x_born and r > y_born and r < x_ends and r <= y_ends for x, x_born, x_ends in self._spine(a, 1) for y, y_born, y_ends in right
            )
        return self.fits[a, b]

    def encode_word(self, word: str) -> list[int]:
        text = word.encode().decode("latin-1") + WORD_END
        size, fits = self.size, self.fits
        longest: list[int | None] = [None] * (len(text) + 1)
        for last, token in self.matcher.iter(text):
            longest[last - size[token] + 1] = token  # later ends are longer
        tokens: list[int] = []
        open_at = [True] * (len(text) + 1)
        at, token = 0, longest[0]
        while at < len(text):
            before = tokens[-1] if tokens else None
            while token is not None:
                if open_at[at + size[token]]:
                    ok = before is None or fits.get((before, token))
                    if self.compatible(before, token) if ok is None else ok:
                        break
                token = self.shorter[token]
            if token is None:
                open_at[at] = False
                token = tokens.pop()
                at -= size[token]
                token = self.shorter[token]
            else:
                tokens.append(token)
                at += size[token]
                token = longest[at]
        return tokens

    def _word(self, word: str) -> bytes:
        ids = self.words_seen.get(word)
        if ids is None:
            ids = self.words_seen.put(word, np.array(self.encode_word(word), "<u4").tobytes())
        return ids

    def _chunk(self, chunk: str) -> bytes:
        """Ids of what stands between white space: no word, letter case or composed letter reaches across it."""
        ids = self.chunks_seen.get(chunk)
        if ids is None:
            text = chunk
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each capital by itself: no final sigma
            ids = self.chunks_seen.put(chunk, b"".join([self._word(w) for w in self.words.findall(text.lower())]))
        return ids

    def _plain(self, text: str) -> list[bytes]:
        chunks = text.split() if _ODD_BLANK.search(text) is None else _BLANK.split(text)
        recent, chunk = self.chunks_seen.recent, self._chunk
        out = [recent.get(c) for c in chunks]
        return [chunk(c) if ids is None else ids for c, ids in zip(chunks, out, strict=True)] if None in out else out

    def encode(self, text: str) -> np.ndarray:
        if self.specials is None or "<" not in text:
            return np.frombuffer(b"".join(self._plain(text)), "<u4")
        out: list[bytes] = []
        for i, piece in enumerate(self.specials.split(text)):
            out += [np.array([self.special[piece]], "<u4").tobytes()] if i % 2 else self._plain(piece)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """Token strings, parted by spaces."""
        size = self.length[ids]
        if not len(size):
            return b""
        before = np.cumsum(size) - size
        return self.block[np.repeat(self.offset[ids] - before, size) + np.arange(size.sum())].tobytes()[:-1]


def _vocabulary(source) -> Vocabulary:  # noqa: ANN001  a Spark broadcast of the file's text
    return kept(("bpe", id(source)), lambda: Vocabulary(source.value))


def _broadcast(docs: DataFrame, path: str):  # noqa: ANN202
    with open(path, encoding="utf-8") as f:  # one vocabulary file of fixed size, from the driver
        return docs.sparkSession.sparkContext.broadcast(f.read())


def tokenize(docs: DataFrame, path: str, ids: bool = True, decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, and on demand ids (array<int>) and decoded.

    A null text counts as empty: no tokens, an empty decoded text. Repeated documents get equal rows. Other columns are ignored.
    """
    source = _broadcast(docs, path)
    more = {"ids": "array<int>"} if ids else {}
    more |= {"decoded": "string"} if decoded else {}

    def run(column: pa.Array) -> dict[str, pa.Array]:
        v = _vocabulary(source)
        found, told, digest = [], [], []
        for t in column.to_pylist():
            found.append(v.encode(t or ""))
            text = v.decode(found[-1])
            digest.append((sha256(found[-1].tobytes()).hexdigest(), sha256(text).hexdigest()))
            if decoded:
                told.append(text.decode())
        n = np.array([len(i) for i in found], np.int64)
        out = {"n_tokens": pa.array(n), "ids_sha256": pa.array([a for a, _ in digest], pa.string()), "decoded_sha256": pa.array([b for _, b in digest], pa.string())}
        if ids:
            edges = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            out["ids"] = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.int32)))
        return out | ({"decoded": pa.array(told, pa.string())} if decoded else {})

    schema = ", ".join(["n_tokens bigint, ids_sha256 string, decoded_sha256 string", *(f"{k} {t}" for k, t in more.items())])
    return per_batch(docs.select("doc_id", "text"), "text", run, schema)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text."""
    return tokenize(docs, path, ids=False, decoded=False)
