"""BPE encoding and decoding by a prefix-sharing trie.

Every prefix of a word has one last token in its encoding, and that token depends only on the prefix: it is
the suffix token that may stand behind the last token of what lies before it. So distinct words go into a
trie, a depth-first walk gives each node its last token and the place where that token starts, and prefixes
that words share are encoded once. A word's ids are read off by walking these links back.

Runs where the text is: no shuffle. A Python worker walks a trie of the new words of each portion of text; ids of
units between white space are kept in two generations of bounded bytes, so that usual words stay known.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from hushtext.llm._common import Generations, map_arrow, only, portions, texts

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Pairs of tokens of which a worker knows whether they may stand together, and bytes of units whose ids it keeps in each
#: of two generations. Both bound memory only.
FIT_LIMIT = 200_000
MEMO_BYTES = 24 << 20
#: Characters of text whose new words are encoded by one walk of a trie.
PORTION = 2_000_000
ROOT = -1


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class BpeTrie:
    """Encodes words, given as strings with one character for each symbol.

    merges: pairs of token ids in order of rank, with the id that each makes. forms: symbols of each token.
    """

    def __init__(self, forms: dict[int, str], merges: list[tuple[int, int, int]], fit_limit: int = FIT_LIMIT):
        self.token = {form: t for t, form in forms.items()}
        self.longest = max(map(len, forms.values()))
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.parts = {t: (a, b) for a, b, t in merges}
        self.born = {t: r for r, (_, _, t) in enumerate(merges)}
        self.fit_limit = fit_limit
        self.spines: tuple[dict, dict] = {}, {}
        self.fits: dict[int, bool] = {}  # by first << 32 | second
        self.whole: dict[int, bool] = {}

    def _spine(self, t: int, side: int) -> list[tuple[int, float]]:
        """Tokens at one edge of t while it grows, first to last, each with the rank at which it is merged away."""
        if (out := self.spines[side].get(t)) is None:
            out, until, x = [], float("inf"), t
            while True:
                out.append((x, until))
                if x not in self.parts:
                    break
                until, x = self.born[x], self.parts[x][side]
            out.reverse()
            self.spines[side][t] = out
        return out

    def _apart(self, a: int, b: int, most: float = float("inf")) -> bool:
        """No merge of a rank below most crosses the border between a and b while they grow."""
        left, right, rank = iter(self._spine(a, 1)), iter(self._spine(b, 0)), self.rank
        x, x_until = next(left)
        y, y_until = next(right)
        while True:
            r = rank.get((x, y))
            # of equal pairs the leftmost merges first: in a it precedes the border, in b it follows
            if r is not None and r < most and r < x_until and r <= y_until:
                return False
            if x_until <= y_until:
                if (step := next(left, None)) is None:
                    return True
                x, x_until = step
            else:
                y, y_until = next(right)

    def _is_whole(self, t: int) -> bool:
        """The encoding of t's own symbols is t."""
        if t not in self.whole:
            a, b = self.parts.get(t, (ROOT, ROOT))
            self.whole[t] = a == ROOT or self._is_whole(a) and self._is_whole(b) and self._apart(a, b, self.born[t])
        return self.whole[t]

    def _may_follow(self, a: int, t: int) -> bool:
        if a == ROOT:
            return self._is_whole(t)
        if len(self.fits) >= self.fit_limit:
            self.fits.clear()
        fits = self.fits[a << 32 | t] = self._is_whole(t) and self._apart(a, t)
        return fits

    def encode(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of each distinct word, as unsigned 32-bit integers.

        Sorted words stand in the depth-first order of their trie: a word shares with the one before it just the
        nodes of their common prefix. So the nodes of the current path are all of the trie that is held, and each
        node is entered once: the state at its depth is the last token of the prefix and where that token starts.
        """
        token, fits, longest = self.token.get, self.fits.get, self.longest
        last, begin, out, done = [ROOT], [0], {}, ""
        for word in sorted(set(words)):
            shared = 0
            for x, y in zip(done, word):
                if x != y:
                    break
                shared += 1
            if len(word) >= len(last):
                last += [ROOT] * len(word)
                begin += [0] * len(word)
            for end in range(shared + 1, len(word) + 1):
                for start in range(end - 1, max(0, end - longest) - 1, -1):
                    if (t := token(word[start:end])) is None:
                        continue
                    a = last[start] if start else ROOT
                    if (ok := fits(a << 32 | t)) is None:
                        ok = self._may_follow(a, t)
                    if ok:
                        last[end], begin[end] = t, start
                        break
                else:
                    raise ValueError(f"the vocabulary has no symbol {word[end - 1]!r}")
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end = begin[end]
            ids.reverse()
            out[word], done = np.array(ids, "<u4").tobytes(), word
        return out


class WordBpe:
    """The encoder and decoder of a tokenizers file whose words never hold white space."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        if spec["decoder"] is not None or model["type"] != "BPE":
            raise ValueError(f"{path}: a BPE model without a decoder is asked for")
        self.suffixed = bool(suffix)
        # \s of the file's patterns is Unicode White_Space
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.space = regex.compile(r"\p{White_Space}+")
        forms = {}
        self.byte = {symbol: b for b, symbol in enumerate(byte_symbols())}
        for symbol, b in self.byte.items():
            forms[vocab[symbol]] = chr(b)
            if suffix:
                forms[vocab[symbol + suffix]] = chr(256 + b)
        merges = []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            t = vocab[a + b]
            merges.append((vocab[a], vocab[b], t))
            forms[t] = forms[vocab[a]] + forms[vocab[b]]
        self.trie = BpeTrie(forms, merges)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.memo = Generations(self._encode_units, MEMO_BYTES)

    def _encode_units(self, units: list) -> list[bytes]:
        """Ids of units of text, and of special tokens, which are wrapped in tuples."""
        words = [self._words(u) if isinstance(u, str) else () for u in units]
        symbols = {w: self._symbols(w) for w in {w for x in words for w in x}}
        ids = self.trie.encode(symbols.values())
        return [b"".join([ids[symbols[w]] for w in x]) if isinstance(u, str) else np.array(self.special[u[0]], "<u4").tobytes() for u, x in zip(units, words)]

    def _words(self, unit: str) -> list[str]:
        if unit.isascii() or all(unicodedata.category(c) != "Cn" for c in unit):
            return self.word.findall(unit)
        # Python may not know these characters yet: the library's own tables say what they are
        form = self.library.normalizer.normalize_str(unit)
        return [bytes(map(self.byte.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(form)]

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _symbols(self, word: str) -> str:
        s = word.encode().decode("latin-1")
        return s[:-1] + chr(256 + ord(s[-1])) if self.suffixed else s

    def _units(self, text: str) -> list[str]:
        if not text.isascii():
            # lower case is taken character by character, so a final sigma is not special
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # str.split also drops these separators, which are no white space here
        return [u for u in self.space.split(text) if u] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def _all_units(self, text: str) -> list:
        if not any(x in text for x in self.special):
            return self._units(text)
        return [u for p in self.specials.split(text) for u in ([(p,)] if p in self.special else self._units(p))]

    def encode_all(self, some: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers; one walk of a trie serves them all."""
        units = [self._all_units(t) for t in some]
        known = self.memo.learn(set().union(*units))
        for x in units:
            yield b"".join(map(known.__getitem__, x))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(next(self.encode_all([text])), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """Ids that have no token are passed over."""
        try:
            return " ".join(map(self.names.__getitem__, ids))
        except KeyError:
            return " ".join([self.names[i] for i in ids if i in self.names])


def codec(path: str) -> WordBpe:
    return only(f"bpe {path}", lambda: WordBpe(path))


def _vocabulary(path: str | None) -> str:
    return path or public_tokenizers.path(DEFAULT_VOCABULARY)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids of each row. Null and empty texts have no ids; repeated rows stay; an empty table gives
    no rows; other columns go. A text of any length is encoded whole, in one worker's memory."""
    path = _vocabulary(path)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for part in portions(texts(batch), PORTION) for x in c.encode_all(part)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast("int64"), pa.array([len(x) for x in ids], "int64"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return map_arrow(docs.select("doc_id", "text"), f, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows with ids. Null and empty ids give an empty text; repeated rows stay."""
    path = _vocabulary(path)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        out = [c.decode(x.as_py() or []) for x in batch.column("ids")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast("int64"), pa.array(out, "string")], ["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), f, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode, then decode the ids, in one pass: doc_id, n_tokens, and SHA-256 of the ids as little-endian
    unsigned 32-bit integers and of the decoded text.

    A row for each row of docs: null and empty texts have no tokens and the digests of no bytes; a null
    doc_id stays null; repeated rows stay; very long texts are encoded whole; an empty table gives no rows;
    columns other than doc_id and text go.
    """
    path = _vocabulary(path)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, n, a, b = codec(path), [], [], []
        for part in portions(texts(batch), PORTION):
            for ids in c.encode_all(part):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(c.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast("int64"), pa.array(n, "int64"), pa.array(a, "string"), pa.array(b, "string")], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select("doc_id", "text"), f, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
