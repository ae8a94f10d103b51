"""BPE encoding and decoding by per-prefix dynamic programming.

For each prefix of a pre-token there is one last token with which its encoding ends. Candidates are the
vocabulary entries that are suffixes of the prefix, found with an automaton over the vocabulary
(states are suffix matches, each with a link to the next shorter one). A candidate is right iff it is
the whole prefix, or the token stored for the rest is compatible with it: the merges, applied to the
two tokens' symbols together, leave exactly these two. Following the stored tokens back from the end
gives the ids.

The same tokenizer file gives normaliser and pre-tokenizer. Texts in U+0000-U+00FF without rare
controls take a short cut through Python's own lower-casing and one regular expression; all others go
through the tokenizers library's normaliser and pre-tokenizer. Added tokens in a text are cut out
first. Null counts as empty and gives no ids and an empty string. Symbols outside the vocabulary are
left out, as the file names no unknown token. Repeated rows are encoded one by one; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ans import plain
from .common import remembered, text_slices

#: Pre-tokens that a worker remembers, in two generations; pairs of tokens whose compatibility it remembers.
CACHE = 120_000
PAIRS = 100_000


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class DynamicBPE:
    """Encodes pre-tokens, given as tuples of symbols."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.vocab, self.end = vocab, end
        self.ranks = {m: r for r, m in enumerate(merges)}
        self.made: dict[str, tuple[str, str]] = {}
        for a, b in merges:
            self.made.setdefault(a + b, (a, b))
        self.compatible: dict[int, bool] = {}
        self.symbols_of: dict[str, tuple[str, ...]] = {}
        # automaton: a trie over symbols, with links from each state to its longest proper suffix in the trie
        self.next: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        for t in vocab:
            symbols = self.split(t)
            if len(symbols) > 1 and self.merge(symbols) != [t]:
                continue  # merges never make it
            s = 0
            for x in symbols:
                if x not in self.next[s]:
                    self.next[s][x] = len(self.next)
                    self.next.append({})
                    self.token.append(None)
                s = self.next[s][x]
            self.token[s] = t
        self.link = [0] * len(self.next)
        self.shorter: list[int] = [0] * len(self.next)  # nearest suffix state that is a token
        queue = [(c, 0, x) for x, c in self.next[0].items()]
        for s, parent, x in queue:
            f = self.link[parent]
            while parent and f and x not in self.next[f]:
                f = self.link[f]
            self.link[s] = self.next[f].get(x, 0) if parent else 0
            k = self.link[s]
            self.shorter[s] = k if self.token[k] is not None else self.shorter[k]
            queue.extend((c, s, y) for y, c in self.next[s].items())
        self.n_states = len(self.next)
        self.longest = [s if self.token[s] is not None else self.shorter[s] for s in range(self.n_states)]
        self.width = [0 if t is None else len(self.split(t)) for t in self.token]
        self.id_of = [-1 if t is None else vocab[t] for t in self.token]
        self.symbols_of.clear()

    def split(self, token: str) -> tuple[str, ...]:
        found = self.symbols_of.get(token)
        if found is None:
            end = self.end
            if end and token.endswith(end) and token != end:
                body = token[: -len(end)]
                found = (*body[:-1], body[-1] + end)
            else:
                found = tuple(token)
            self.symbols_of[token] = found
        return found

    def merge(self, symbols) -> list[str]:
        """The plain rule, lowest rank first and leftmost among equals; used for single tokens and pairs only."""
        parts, ranks = list(symbols), self.ranks
        while len(parts) > 1:
            rank, i = min((ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether the tokens of two states may follow one another; the answer is remembered."""
        if len(self.compatible) > PAIRS:
            self.compatible.clear()
        x, y = self.token[a], self.token[b]
        ok = self.compatible[a * self.n_states + b] = self.merge(self.split(x) + self.split(y)) == [x, y]
        return ok

    def encode(self, symbols) -> list[int]:
        nxt, link, longest, shorter, width, known, n = self.next, self.link, self.longest, self.shorter, self.width, self.compatible, self.n_states
        last = [0]  # last[i]: the state of the last token of the first i symbols; 0: none
        s = i = 0
        for x in symbols:
            i += 1
            while s and x not in nxt[s]:
                s = link[s]
            s = nxt[s].get(x, 0)
            k = longest[s]
            while k:
                rest = i - width[k]
                if not rest:
                    break
                p = last[rest]
                if p:
                    ok = known.get(p * n + k)
                    if ok or (ok is None and self.fits(p, k)):
                        break
                k = shorter[k]
            last.append(k)
        out = []
        while i > 0:
            k = last[i]
            if not k:
                return self._with_gaps(symbols)
            out.append(self.id_of[k])
            i -= width[k]
        return out[::-1]

    def _with_gaps(self, symbols) -> list[int]:
        """Symbols outside the vocabulary: they are left out, and merges never cross them."""
        out, run = [], []
        for x in [*symbols, None]:
            if x is not None and x in self.vocab:
                run.append(x)
            elif run:
                out += [self.vocab[t] for t in self.merge(run)]
                run = []
        return out


# Pieces of the file's pattern, over lower-case U+0000-U+00FF.
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^ \t-\r{_LETTER}{_NUMBER}]+")


class WordTokenizer:
    """Encodes and decodes texts with a tokenizer file of a word-end BPE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.end = model.get("end_of_word_suffix") or ""
        self.bpe = DynamicBPE(model["vocab"], merges, self.end)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        self.alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in self.alphabet.items()}
        self.text_of = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.known_symbols: dict[str, tuple[bytes, str]] = {}

    def pieces(self, text: str) -> list[str] | None:
        """Pre-tokens of a text without added tokens; None if the library has to find them."""
        return _PIECES.findall(text.lower()) if plain(text) else None

    def _encode_symbols(self, chars: str) -> tuple[bytes, str]:
        symbols = [*chars[:-1], chars[-1] + self.end]
        ids = self.bpe.encode(symbols)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.text_of[i] for i in ids])

    def piece(self, piece: str) -> tuple[bytes, str]:
        """Ids as little-endian bytes and the decoded tokens, of a piece that the younger generation doesn't know."""
        if len(self.known) >= CACHE // 2:
            self.older = dict(self.known)
            self.known.clear()
        found = self.older.get(piece)
        if found is None:
            found = self._encode_symbols("".join(map(self.alphabet.__getitem__, piece.encode())))
        self.known[piece] = found
        return found

    def encode_text(self, text: str) -> tuple[bytes, str]:
        ids, decoded = [], []
        parts = self.cut.split(text) if "<|" in text else [text]
        for part in parts:
            if part in self.added:
                ids.append(struct.pack("<I", self.added[part]))
                decoded.append(part)
                continue
            pieces = self.pieces(part)
            if pieces is None:
                for chars, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    found = self.known_symbols.get(chars)
                    if found is None:
                        if len(self.known_symbols) >= CACHE // 4:
                            self.known_symbols.clear()
                        found = self.known_symbols[chars] = self._encode_symbols(chars)
                    ids.append(found[0])
                    if found[1]:
                        decoded.append(found[1])
            else:
                known = self.known
                for p in pieces:
                    found = known.get(p) or self.piece(p)
                    ids.append(found[0])
                    if found[1]:
                        decoded.append(found[1])
        return b"".join(ids), " ".join(decoded)

    def decode(self, ids) -> str:
        """The file has no decoder, so tokens are joined by spaces, as the library does."""
        return " ".join(self.text_of[i] for i in ids if i in self.text_of)


_tokenizers: dict[str, WordTokenizer] = remembered({})


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


SCHEMA = "doc_id long, ids binary, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _run(path: str, digest: bool):
    def run(batches):
        import pyarrow as pa

        t = tokenizer(path)
        for batch in batches:
            for part in text_slices(batch):
                rows = [t.encode_text(x or "") for x in part.column(1).to_pylist()]
                ids = part.column(0).cast(pa.int64())
                if digest:
                    cols = [
                        ids,
                        pa.array([len(a) // 4 for a, _ in rows], pa.int64()),
                        pa.array([hashlib.sha256(a).hexdigest() for a, _ in rows]),
                        pa.array([hashlib.sha256(b.encode()).hexdigest() for _, b in rows]),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, pa.array([a for a, _ in rows], pa.binary()), pa.array([b for _, b in rows], pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded text."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(_run(path, False), SCHEMA)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded text, without moving either."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(_run(path, True), DIGEST)
