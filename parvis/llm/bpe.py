"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton finds the longest vocabulary entry at each position of a
piece. The encoder walks from match to match; a match is taken only if it is
compatible with the token before it, else its longest proper prefix is tried, and
where no prefix fits, the token before is taken back and its end is marked dead.
Each position dies once, so the work is linear in the piece. Two tokens are
compatible if no merge across their border comes before the merges that close it.

Vocabularies with word ends are covered: the end of a word is one more symbol, and
its fusion with the last character comes before all merges.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "\x00"  # never a symbol of the byte alphabet
CACHED = 200_000  # words a Python worker remembers, also while other steps use it; only speed depends on it
TEXTS = 256  # texts of a batch encoded and decoded at once


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Encoder:
    """Encodes as the tokenizers library does with this file, without adding special tokens.

    Supported: a normaliser of NFC, white space runs to one space and lower case; a
    splitting pattern kept where it matches; byte-level symbols; a suffix at word ends.
    """

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        spelled = lambda token: token[: -len(suffix)] + END if token.endswith(suffix) else token
        self.ids = {spelled(token): i for token, i in model["vocab"].items()}
        self.names = {i: token for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: token for token, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern).findall
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.symbols = byte_symbols()

        # rank at which a token is made, and the two tokens that make it; -1 closes a word
        self.rank: dict[tuple[str, str], int] = {(s, END): -1 for s in self.symbols if s + END in self.ids}
        self.rank |= {(spelled(a), spelled(b)): r for r, (a, b) in enumerate(model["merges"])}
        self.parts: dict[str, tuple[str, str]] = {}
        for a, b in self.rank:
            self.parts.setdefault(a + b, (a, b))
        reached = [t for t in self.ids if len(t) == 1 or t in self.parts]
        self.automaton = ahocorasick.Automaton()
        known = set(reached)
        self.shorter: dict[str, str | None] = {}
        for token in reached:
            self.automaton.add_word(token, (len(token) - 1, token))
            self.shorter[token] = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in known), None)
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}

    def compatible(self, left: str, right: str) -> bool:
        """No merge joins a right end of ``left`` to a left end of ``right`` before both are used up."""
        found = True
        used_left, x = float("inf"), left
        while found and x is not None:
            used_right, y = float("inf"), right
            while y is not None:
                rank = self.rank.get((x, y))
                if rank is not None and rank < used_left and rank <= used_right:
                    found = False
                    break
                made = self.parts.get(y)
                used_right, y = (self.rank[made], made[0]) if made else (used_right, None)
            made = self.parts.get(x)
            used_left, x = (self.rank[made], made[1]) if made else (used_left, None)
        if len(self.fits) > CACHED:
            self.fits.clear()
        self.fits[left, right] = found
        return found

    def piece(self, text: str) -> list[int]:
        """The ids of one piece, ended by END."""
        size = len(text)
        longest: list[str | None] = [None] * (size + 1)
        for last, (before, token) in self.automaton.iter(text):
            longest[last - before] = token
        fits, tokens, dead, at, token = self.fits, [], set(), 0, longest[0]
        while at < size:
            end = at + len(token)
            if (end == size or longest[end]) and end not in dead and (
                not tokens or (fits[key] if (key := (tokens[-1], token)) in fits else self.compatible(*key))
            ):
                tokens.append(token)
                at, token = end, longest[end]
            elif self.shorter[token] is not None:
                token = self.shorter[token]
            else:
                dead.add(at)
                token = tokens.pop()
                at -= len(token)
        return [self.ids[t] for t in tokens]

    def word(self, word: str) -> bytes:
        """The ids of a word without white space, as native 32-bit integers."""
        out = array("i")
        for piece in self.pieces(word):
            if not piece.isascii() or END in piece or not piece.isprintable():
                piece = "".join([self.symbols[b] for b in piece.encode()])
            out.extend(self.piece(piece + END))
        return out.tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, as native 32-bit integers; none for a null text."""
        if not text:
            return b""
        known, parts = self.known, []
        for run in self.specials.split(text) if self.specials and "<|" in text else (text,):
            if run in self.special:
                parts.append(array("i", [self.special[run]]).tobytes())
                continue
            run = unicodedata.normalize("NFC", run)
            # lower case character by character: a final sigma gets no form of its own
            run = (run.replace("Σ", "σ") if "Σ" in run else run).lower()
            for word in SPACED(run):
                ids = known.get(word)
                if ids is None:
                    ids = self.word(word)
                    if len(known) >= CACHED:
                        known.clear()
                    if len(word) < 64:
                        known[word] = ids
                parts.append(ids)
        return b"".join(parts)


#: str.split would also cut at the separators U+001C to U+001F, which are no white space here
SPACED = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+").findall


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=4)
def offset_table(path: str):
    """All token strings end to end with their offsets, by id; an id without a token is null."""
    import pyarrow as pa

    names = encoder(path).names
    return pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ids(coder: Encoder, texts):
    """The token ids of an Arrow array of texts as a list array."""
    import numpy as np
    import pyarrow as pa

    found = [coder.encode(t.as_py()) for t in texts]
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(f) // 4 for f in found], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))


def _texts(path: str, lists):
    """The token strings of each list of ids, joined."""
    import pyarrow as pa
    import pyarrow.compute as pc

    tokens = offset_table(path).take(lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py()))
    moved = pc.subtract(lists.offsets, lists.offsets[0])
    joined = pc.binary_join(pa.ListArray.from_arrays(moved, tokens), " ")
    return pc.if_else(lists.is_valid(), joined, pa.scalar(None, pa.string())) if lists.null_count else joined


def encode(text: Column, path: str) -> Column:
    """Token ids of ``text`` as array<int>; a null or empty text has none, and nothing is cut."""
    import pyarrow as pa

    def ids(texts):
        return _ids(encoder(path), texts)

    ids.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(ids, "array<int>")(text)


def encoded_length(text: Column, path: str) -> Column:
    """The number of token ids of ``text``; 0 for a null text."""
    import pyarrow as pa

    def length(texts: pa.Array) -> pa.Array:
        coder = encoder(path)
        return pa.array([len(coder.encode(t.as_py())) // 4 for t in texts], pa.int64())

    length.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(length, "bigint")(text)


def decode(ids: Column, path: str) -> Column:
    """The token strings of ``ids`` joined by one space, as the library does for a file without a decoder.

    Null ids give null; an unknown id makes the text null.
    """
    import pyarrow as pa

    def texts(lists):
        return _texts(path, lists)

    texts.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(texts, "string")(ids)


def round_trip(text: Column, path: str) -> Column:
    """A struct of the token ids of ``text`` and what they decode to, in one call per batch."""
    import pyarrow as pa

    def part(texts):
        ids = _ids(encoder(path), texts)
        return pa.StructArray.from_arrays([ids, _texts(path, ids)], ["ids", "decoded"])

    def both(texts):
        # some texts at a time, so that the token strings of a whole batch are never held at once
        coded = pa.concat_arrays([part(texts.slice(i, TEXTS)) for i in range(0, max(len(texts), 1), TEXTS)])
        pa.default_memory_pool().release_unused()  # or the worker keeps it while other steps use it
        return coded

    both.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(both, "ids array<int>, decoded string")(text)


def encoded(docs: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the token ids of each whole text and what they decode to.

    Null and empty texts get an empty list and an empty string. Columns of ``docs``
    named like the new ones are replaced.
    """
    rows = docs.withColumn("_coded", round_trip(F.col(text), path or default_path()))
    return rows.withColumns({ids: F.col("_coded.ids"), decoded: F.col("_coded.decoded")}).drop("_coded")


def digests(rows: DataFrame, ids: str = "ids", decoded: str = "decoded") -> dict[str, Column]:
    """Columns that tell an encoding: its length and two hashes."""
    spaced = F.array_join(F.col(ids).cast("array<string>"), " ")
    return {
        "n_tokens": F.size(F.col(ids)).cast("long"),
        "ids_sha256": F.sha2(spaced.cast("binary"), 256),
        "decoded_sha256": F.sha2(F.col(decoded).cast("binary"), 256),
    }
