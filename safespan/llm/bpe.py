"""Byte-pair encoding of word-end vocabularies: backtracking encoder, offset-table decoder.

The encoder takes, at each position of a word, the longest vocabulary entry that an Aho-Corasick automaton finds there,
and accepts it only if it is compatible with the entry before it; else it takes the next shorter one or steps back. Two
entries are compatible if the merge rules, run on the two side by side, never merge across their border. A sequence whose
neighbours are all compatible is the one the merge rules give, and each position is tried once, so the work is linear.

The automaton reads words from their ends, over reversed entries, so that what ends at a place in reading begins there in
the word. All new words of a batch are worked through at once, in arrays with one row a word.

Defined cases: null and empty texts have no ids; texts of any length are encoded whole; special strings inside texts
give their special ids; repeated rows are encoded alike; an empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from safespan.llm.arrays import Lookup, per_batch, text_bytes

#: Bytes that a worker's memory of chunks, and that of words, may take; beyond half of it the older half is forgotten,
#: which changes no result.
REMEMBERED = 32_000_000
#: Bytes of an entry besides its key and value, and the number of remembered pairs of tokens.
ENTRY, PAIRS = 250, 1_000_000
#: Code points of the texts worked through at once, and cells of the arrays for their words.
PART, CELLS = 1 << 20, 1 << 18
#: Bytes from which on a word is long: placed one by one, as arrays with a row for each word pay off for many words only.
LONG = 64
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the
    others take the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + n)
            n += 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """A tokenizer file (JSON, byte letters with a word-end mark) as tables. A word is a string of symbols: byte b is
    chr(b), and chr(256 + b) at the end of the word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(byte_letters())}

        def symbols(token: str) -> str:
            last = bool(self.end) and token.endswith(self.end)
            body = [byte_of[c] for c in (token[: -len(self.end)] if last else token)]
            return "".join(map(chr, body[:-1] + [body[-1] + 256 * last]))

        self.token_symbols = {i: symbols(t) for t, i in self.ids.items()}
        self.symbol_ids = {s: i for i, s in self.token_symbols.items() if len(s) == 1}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = self.ids[left + right]
            a, b = self.ids[left], self.ids[right]
            self.merges[a, b] = (rank, made)
            self.parts.setdefault(made, (a, b))
            self.rank.setdefault(made, rank)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern.replace(r"\s", WHITE))
        late = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in LATE.split())
        self.late = regex.compile(f"[{late}]")
        old = pattern.replace(r"\s", WHITE)
        for kind in (r"\p{L}", r"\p{N}"):
            old = old.replace(kind, f"[{kind}--[{late}]]")
        self.split_late = regex.compile(old, regex.V1)
        self.by_line = {x: regex.compile(f"(?:{x.pattern})|\n", x.flags & regex.V1) for x in (self.split, self.split_late)}
        self.space = regex.compile(f"[{WHITE}]+")
        self.mark = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def chunks(self, text: str) -> Iterator[tuple[str, list[str]]]:
        """The special string (or "") before each stretch of ordinary text, and the stretch cut at white space. Words
        never hold white space, nor does composition reach across it, so chunks can be split into words one by one."""
        parts = self.mark.split(text) if self.mark and any(s in text for s in self.special) else [text]
        for i in range(0, len(parts), 2):
            odd = any(c in parts[i] for c in "\x1c\x1d\x1e\x1f")  # space to str.split() alone
            yield parts[i - 1] if i else "", self.space.split(parts[i]) if odd else parts[i].split()

    def parts_of(self, text: str) -> Iterator[str]:
        """A very long text in parts that end at white space."""
        at = 0
        while at < len(text):
            cut = self.space.search(text, at + PART)
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def lines(self, chunks: list[str]) -> list[list[str]]:
        """The words of each chunk, all found in one pass."""
        joined = normal("\n".join(chunks))
        split = self.split if latin(joined) or not self.late.search(joined) else self.split_late
        out: list[list[str]] = [[]]
        for w in self.by_line[split].findall(joined):
            if w == "\n":
                out.append([])
            else:
                out[-1].append(w)
        return out

    def words(self, chunk: str) -> list[str]:
        chunk = normal(chunk)
        return (self.split if latin(chunk) or not self.late.search(chunk) else self.split_late).findall(chunk)

    def word_symbols(self, word: str) -> str:
        raw = word.encode("utf-8")
        return raw[:-1].decode("latin-1") + chr(raw[-1] + (256 if self.end else 0))


#: White space as the tokenizers' pattern engine has it, for use inside and outside of brackets.
WHITE = r"\t-\r\x20\x85\xa0  -     　"


# Code points of the newest Unicode versions on which the tables at hand differ from those of the library.
# Letters and digits to the pattern engine here that the library's pattern engine has as unassigned:
LATE = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CF A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A
11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20
18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE
1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
# Capital letters, first and last of a row, and the first one's small letter, that the library knows and Python doesn't:
CAPITALS = "1C89-1C89:1C8A A7CB-A7CB:264 A7CC-A7CC:A7CD A7CE-A7CE:A7CF A7D2-A7D2:A7D3 A7D4-A7D4:A7D5 A7DA-A7DA:A7DB A7DC-A7DC:19B 10D50-10D65:10D70 16EA0-16EB8:16EBB"

_SMALL = {ord("\u03a3"): "\u03c3"}
for _row in CAPITALS.split():
    _first, _last, _small = (int(x, 16) for x in _row.replace("-", ":").split(":"))
    _SMALL |= {c: chr(_small + c - _first) for c in range(_first, _last + 1) if chr(c).lower() == chr(c)}
_ODD = regex.compile("[" + "".join(map(chr, _SMALL)) + "]")


def normal(text: str) -> str:
    """Canonical composition, then each character in lower case by itself (no special final sigma)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return (text if latin(text) or not _ODD.search(text) else text.translate(_SMALL)).lower()


def latin(text: str) -> bool:
    """Whether all code points are below 256, found out quickly."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Memory(dict):
    """A dictionary that makes missing values and forgets the older ones when it has grown to half of `most` bytes."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most = make, most
        self.older: dict = {}
        self.bytes = 0

    def __missing__(self, key: str):
        made = self.older.get(key)
        if made is None:
            made = self.make(key)
        self.bytes += ENTRY + len(key) + (len(made) if isinstance(made, bytes) else 0)
        if 2 * self.bytes > self.most:
            self.older = dict(self)
            self.clear()
            self.bytes = ENTRY + len(key)
        self[key] = made
        return made


class Automaton:
    """Aho-Corasick over reversed entries: the longest entry that begins at each place."""

    def __init__(self, entries: dict[str, int]):
        goto: dict[int, int] = {}
        best, fail, parent = [-1], [0], [(0, 0)]
        for entry, token in entries.items():
            node = 0
            for c in reversed(entry):
                key = node << 9 | ord(c)
                if key not in goto:
                    goto[key] = len(best)
                    best.append(-1)
                    fail.append(0)
                    parent.append((node, ord(c)))
                node = goto[key]
            best[node] = token
        level = [n for n, (p, _) in enumerate(parent) if n and not p]
        below: dict[int, list[int]] = {}
        for n, (p, _) in enumerate(parent):
            if n:
                below.setdefault(p, []).append(n)
        while level:
            for n in level:
                p, c = parent[n]
                if p:
                    f = fail[p]
                    while f and f << 9 | c not in goto:
                        f = fail[f]
                    fail[n] = goto.get(f << 9 | c, 0)
                if best[n] < 0:
                    best[n] = best[fail[n]]
            level = [m for n in level for m in below.get(n, ())]
        self.goto = Lookup(np.array(list(goto), np.uint64), np.array(list(goto.values()), np.int32))
        self.fail, self.best = np.array(fail, np.int32), np.array(best, np.int32)

    def longest(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each row of symbols (size of them) the longest entry at each place, or -1."""
        out = np.full(symbols.shape, -1, np.int32)
        state = np.zeros(len(symbols), np.int64)
        for at in range(symbols.shape[1] - 1, -1, -1):
            on = np.flatnonzero(size > at)
            s, c = state[on], symbols[on, at]
            after = self.goto.find((s << 9 | c).astype(np.uint64))
            lost = np.flatnonzero(after < 0)
            while len(lost):
                ended = s[lost] == 0
                after[lost[ended]] = 0
                lost = lost[~ended]
                s[lost] = self.fail[s[lost]]
                after[lost] = self.goto.find((s[lost] << 9 | c[lost]).astype(np.uint64))
                lost = lost[after[lost] < 0]
            state[on] = after
            out[on, at] = self.best[after]
        return out


class Encoder:
    """Texts to ids, packed as little-endian 32-bit integers; chunks and words found before are remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.most, self.bytes, self.word_bytes = REMEMBERED, 0, 0
        self.compatible = Lookup(np.empty(0, np.uint64), np.empty(0, np.int8))
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.left_edge: dict[int, list[tuple[int, int, int]]] = {}
        self.right_edge: dict[int, list[tuple[int, int, int]]] = {}
        standing = {s: i for i, s in vocabulary.token_symbols.items() if self.stands(i)}  # others never occur
        most = max(vocabulary.token_symbols, default=-1) + 1
        self.size = np.zeros(most, np.int64)
        #: For each token the longest other one that it begins with, or -1.
        self.shorter = np.full(most, -1, np.int32)
        for s, i in standing.items():
            self.size[i] = len(s)
            self.shorter[i] = next((standing[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in standing), -1)
        self.automaton = Automaton(standing)
        self.longest_token = max(map(len, standing), default=1)

    def edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens that stand at that edge while the token is being merged: (token, rank made, rank ended)."""
        known = (self.left_edge, self.right_edge)[side]
        if token not in known:
            chain, x = [token], token
            while x in self.v.parts:
                x = self.v.parts[x][side]
                chain.append(x)
            chain.reverse()
            made = [self.v.rank.get(x, -1) for x in chain]
            known[token] = list(zip(chain, made, [*made[1:], NEVER], strict=True))
        return known[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether the merge rules leave the border between a and b alone."""
        xs, ys, i, j = self.edge(a, 1), self.edge(b, 0), 0, 0
        while i < len(xs) and j < len(ys):
            (x, x_made, x_ended), (y, y_made, y_ended) = xs[i], ys[j]
            merge = self.v.merges.get((x, y))
            if merge is not None:
                at = max(merge[0], x_made, y_made)
                if at < x_ended and at <= y_ended:
                    return False
            if x_ended <= y_ended:
                i += 1
            else:
                j += 1
        return True

    def stands(self, token: int) -> bool:
        """Whether the merge rules make this token out of its own symbols."""
        found = self.whole.get(token)
        if found is None:
            if token not in self.v.parts:
                found = True
            else:
                a, b = self.v.parts[token]
                found = self.stands(a) and self.stands(b) and self.border(a, b, token)
            self.whole[token] = found
        return found

    def border(self, a: int, b: int, token: int) -> bool:
        """Whether a and b, side by side, stay whole until they merge into the token."""
        xs, ys, i, j = self.edge(a, 1), self.edge(b, 0), 0, 0
        while True:
            (x, x_made, x_ended), (y, y_made, y_ended) = xs[i], ys[j]
            merge = self.v.merges.get((x, y))
            if merge is not None:
                at = max(merge[0], x_made, y_made)
                if at < x_ended and at <= y_ended:
                    return (x, y) == (a, b) and merge[1] == token
            if i == len(xs) - 1 and j == len(ys) - 1:
                return False
            if x_ended <= y_ended:
                i += 1
            else:
                j += 1

    def fitting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pairs (a, b) are compatible, from the table; new pairs are worked out and added."""
        keys = (a.astype(np.int64) << 20 | b).astype(np.uint64)
        out = self.compatible.find(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            pairs, which = np.unique(keys[new], return_inverse=True)
            made = np.array([self.fits(p >> 20, p & 0xFFFFF) for p in pairs.tolist()], np.int8)
            if self.compatible.count + len(pairs) > PAIRS:
                self.compatible = Lookup(np.empty(0, np.uint64), np.empty(0, np.int8))
            self.compatible.put(pairs, made)
            out[new] = made[which]
        return out > 0

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of words of bytes."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lengths, kind="stable")
        short = int((lengths <= LONG).sum())
        for j in order[short:].tolist():
            out[j] = self._encode_long(words[j])
        order, i = order[:short], 0
        while i < len(order):  # words of like length, as many as keep the arrays small
            rows = max(1, CELLS // max(1, int(lengths[order[min(i + 1000, len(order) - 1)]])))
            part = order[i : i + rows]
            for j, ids in zip(part.tolist(), self._encode([words[j] for j in part], lengths[part]), strict=True):
                out[j] = ids
            i += rows
        return out

    def _encode(self, words: list[bytes], n: np.ndarray) -> list[bytes]:
        rows, width = np.arange(len(words)), int(n.max())
        symbols = np.zeros((len(words), width), np.int64)
        symbols[np.arange(width) < n[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        if self.v.end:
            symbols[rows, n - 1] += 256
        longest = self.automaton.longest(symbols, n)
        tokens = np.zeros((len(words), width), np.int32)
        dead = np.zeros((len(words), width + 1), bool)
        at, placed, token = np.zeros_like(n), np.zeros_like(n), longest[:, 0].copy()
        while len(rows):
            stuck = token[rows] < 0
            if stuck.any():  # nothing fits here: step back
                b = rows[stuck]
                dead[b, at[b]] = True
                if not placed[b].all():
                    raise ValueError("a word has symbols outside the vocabulary")
                placed[b] -= 1
                x = tokens[b, placed[b]]
                at[b] -= self.size[x]
                token[b] = self.shorter[x]
            g = rows[~stuck]
            t, end = token[g], at[g] + self.size[token[g]]
            fits = ~dead[g, end]
            after = np.flatnonzero(fits & (placed[g] > 0))
            fits[after] = self.fitting(tokens[g[after], placed[g[after]] - 1], t[after])
            w, end = g[fits], end[fits]
            tokens[w, placed[w]] = t[fits]
            placed[w] += 1
            at[w] = end
            more = w[end < n[w]]
            token[more] = longest[more, at[more]]
            token[g[~fits]] = self.shorter[t[~fits]]
            if len(more) < len(w):
                rows = rows[at[rows] < n[rows]]
        flat = tokens[np.arange(width) < placed[:, None]].astype("<u4").tobytes()
        ends = (4 * np.cumsum(placed)).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _encode_long(self, word: bytes) -> bytes:
        """One long word. What stands at a place depends on the symbols of the longest token from there on, so the automaton
        runs over many parts of the word at once; the tokens are then placed one by one."""
        n, step = len(word), LONG
        symbols = np.frombuffer(word, np.uint8).astype(np.int16)
        if self.v.end:
            symbols[-1] += 256
        longest = np.empty(n, np.int32)
        for lo in range(0, n, CELLS):
            starts = np.arange(lo, min(lo + CELLS, n), step)
            size = np.minimum(step + self.longest_token - 1, n - starts)
            part = np.zeros((len(starts), int(size.max())), np.int64)
            inside = np.arange(part.shape[1]) < size[:, None]
            part[inside] = symbols[(starts[:, None] + np.arange(part.shape[1]))[inside]]
            found = self.automaton.longest(part, size)[:, :step].ravel()
            longest[lo : lo + CELLS] = found[: min(lo + CELLS, n) - lo]
        sizes, shorter, pairs, dead = self.size, self.shorter, self.pairs, bytearray(n + 1)
        tokens, at, token = array("i"), 0, int(longest[0])
        while at < n:
            if token < 0:  # nothing fits here: step back
                dead[at] = 1
                if not tokens:
                    raise ValueError("a word has symbols outside the vocabulary")
                token = tokens.pop()
                at -= int(sizes[token])
                token = int(shorter[token])
                continue
            end = at + int(sizes[token])
            fits = not dead[end]
            if fits and tokens:
                key = tokens[-1] << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) > PAIRS // 16:
                        pairs.clear()
                    fits = pairs[key] = self.fits(tokens[-1], token)
            if fits:
                tokens.append(token)
                at = end
                token = int(longest[at]) if at < n else -1
            else:
                token = int(shorter[token])
        return np.frombuffer(tokens, np.int32).astype("<u4").tobytes()

    def _remember(self, chunks: set[str]) -> None:
        """Makes sure that `known` has all the chunks."""
        if 2 * self.bytes > self.most:
            self.older, self.known, self.bytes = self.known, {}, 0
        if 2 * self.word_bytes > self.most:
            self.words, self.word_bytes = {}, 0
        known, older, words = self.known, self.older, self.words
        lacking = [c for c in chunks if c not in known]
        new = []
        for c in lacking:
            ids = older.get(c)
            if ids is None:
                new.append(c)
            else:
                known[c] = ids
        if new:
            lines = self.v.lines(new)
            unknown = list({w for line in lines for w in line if w not in words})
            words.update(zip(unknown, self.encode([w.encode() for w in unknown]), strict=True))
            self.word_bytes += sum(map(len, unknown)) + ENTRY * len(unknown)
            for c, line in zip(new, lines, strict=True):
                known[c] = words[line[0]] if len(line) == 1 else b"".join([words[w] for w in line])
        self.bytes += sum(map(len, lacking)) + ENTRY * len(lacking)

    def texts(self, texts: list[str]) -> list[bytes]:
        """The packed ids of whole texts."""
        out, i = [], 0
        while i < len(texts):
            if len(texts[i]) > PART:
                out.append(b"".join([self._texts([p])[0] for p in self.v.parts_of(texts[i])]))
                i += 1
                continue
            j, size = i, 0
            while j < len(texts) and len(texts[j]) <= PART and size <= PART:
                size += len(texts[j])
                j += 1
            out += self._texts(texts[i:j])
            i = j
        return out

    def _texts(self, texts: list[str]) -> list[bytes]:
        cut = [list(self.v.chunks(t)) for t in texts]
        chunks: set[str] = set()
        for parts in cut:
            for _, c in parts:
                chunks.update(c)
        chunks.discard("")
        self._remember(chunks)
        self.known[""] = b""
        known, special = self.known, self.v.special
        return [b"".join([x for s, c in parts for x in ((special[s].to_bytes(4, "little") if s else b""), *map(known.__getitem__, c))]) for parts in cut]

    def text(self, text: str) -> bytes:
        return self.texts([text])[0]


class Decoder:
    """Ids to text by an offset table: all token strings stand end to end, each with a space behind it."""

    def __init__(self, vocabulary: Vocabulary):
        names = {i: t for t, i in vocabulary.ids.items()} | {i: t for t, i in vocabulary.special.items()}
        tokens = [(names[i] + " ").encode() if i in names else b"" for i in range(max(names, default=-1) + 1)]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))

    def texts(self, ids: np.ndarray, offsets: np.ndarray, most: int = 1 << 17) -> list[str]:
        """The text of each list of ids; unknown ids give nothing."""
        out: list[str] = []
        for i in range(len(offsets) - 1):
            parts = []
            for lo in range(int(offsets[i]), int(offsets[i + 1]), most):
                part = ids[lo : min(lo + most, int(offsets[i + 1]))].astype(np.int64)
                part = part[(part >= 0) & (part < len(self.size))]
                size = self.size[part]
                ends = np.cumsum(size)
                if len(ends):
                    at = np.repeat(self.start[part] - (ends - size), size) + np.arange(int(ends[-1]))
                    parts.append(self.data[at].tobytes())
            out.append(b"".join(parts)[:-1].decode())
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(Vocabulary(path))


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(Vocabulary(path))


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", packed: bool = False) -> DataFrame:
    """df with a column of token ids: array<int>, or binary little-endian 32-bit integers if packed. The text column is
    kept; a column that has the name of the new one is replaced."""
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    schema = _with(df, ids, kind)

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        made = e.texts([x or "" for x in batch.column(text).to_pylist()])
        if packed:
            column = pa.array(made, pa.binary())
        else:
            at = np.concatenate(([0], np.cumsum([len(x) // 4 for x in made]))).astype(np.int32)
            column = pa.ListArray.from_arrays(at, pa.array(np.frombuffer(b"".join(made), "<i4"), pa.int32()))
        keep = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != ids}
        yield pa.RecordBatch.from_arrays([*keep.values(), column], [*keep, ids])

    # idle workers stay, and what they hold counts
    return df.mapInArrow(per_batch(make, 500, encoder.cache_clear), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of a column of ids (array<int> or packed). Null ids give an empty text."""
    schema = _with(df, text, T.StringType())

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column(ids)
        if pa.types.is_list(column.type):
            lengths = [len(x) if x is not None else 0 for x in column]
            flat = np.concatenate([np.empty(0, np.int64), *(np.asarray(x, np.int64) for x in column.to_pylist() if x)])
            at = np.concatenate(([0], np.cumsum(lengths)))
        else:
            raw, at = text_bytes(column)
            flat, at = np.frombuffer(raw.tobytes(), "<u4"), at // 4
        made = pa.array(decoder(path).texts(flat, at), pa.string())
        keep = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != text}
        yield pa.RecordBatch.from_arrays([*keep.values(), made], [*keep, text])

    return df.mapInArrow(per_batch(make, 500), schema)
