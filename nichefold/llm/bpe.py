"""BPE as a deterministic automaton over tokens, compiled merge by merge.

The automaton accepts exactly the token sequences that byte-pair merging can leave behind, so every
word has one accepting path and that path spells its encoding.  It starts as one state with an arc for each base
symbol.  A merge (u, v) -> w is a gadget on it: whatever could read u and then v now reads w and goes where v
went, and the state after u becomes a copy that can't read v any more.  All arcs of a token lead to one
state, so the gadget costs one destination and one state, and a state is a token (the one it copies for) and a rank:
it lacks the partners that token had merged with up to that rank, and whatever the state it was copied from lacks.
Whether a state has an arc is looked up from that (``arc``) and kept in a table.

Encoding walks the bytes of a word: at each position exactly one token ends whose arc leaves the state of the position
where it begins.  Decoding follows the arcs and emits their labels.

Defined cases: null text is empty and has no ids; special tokens written in a text are matched before
normalising; texts of any length are read whole, and a word of any length in time proportional to it; equal texts have equal ids, whether or
not their rows or ids repeat; an empty table gives an empty table; ``tokenise`` names its column with a number added where the table has
one of that name.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata

import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from nichefold.llm.common import free_name, give_back, ship

WORD_END = "</w>"
#: Words in each of a worker's two tables.
TABLE_SIZE = 150_000
#: Looked-up arcs that it keeps, and texts that it encodes before handing them on.
ARCS_KEPT, TEXTS_AT_ONCE = 400_000, 500
NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Automaton:
    """States, destinations and arcs; see the module's docstring."""

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]], size: int):
        self.dest = [0] * size
        self.origin = [0] * size  # where a token's arc first led
        self.left = [-1] * size
        self.made = [-1] * size
        self.dead = [True] * size
        self.rank: dict[tuple[int, int], int] = {}
        self.owner, self.since = [-1], [-1]
        self.table: dict[int, bool] = {}
        for t in base:
            self.dead[t] = False
        for r, (u, v, w) in enumerate(merges):
            if self.left[w] >= 0:
                raise ValueError("two merges make the same token; this construction needs one each")
            self._gadget(r, u, v, w)

    def _gadget(self, r: int, u: int, v: int, w: int) -> None:
        self.left[w], self.made[w] = u, r
        if self.dead[u] or not self.arc(self.dest[u], v):
            return
        self.dead[w] = False
        self.dest[w] = self.origin[w] = self.dest[v]
        self.rank[u, v] = r
        self.owner.append(u)
        self.since.append(r)
        self.dest[u] = len(self.owner) - 1

    def _cut(self, state: int, token: int, until: int) -> bool:
        """Whether the state, or one it was copied from, lost its arc for the token by that rank."""
        while state:
            u = self.owner[state]
            r = self.rank.get((u, token), NEVER)
            if r <= self.since[state] and r <= until:
                return True
            state = self.origin[u]
        return False

    def arc(self, state: int, token: int) -> bool:
        until = NEVER - 1
        while True:
            if self.dead[token] or self._cut(state, token, until):
                return False
            if self.left[token] < 0:
                return True
            token, until = self.left[token], self.made[token]

    def has_arc(self, state: int, token: int) -> bool:
        k = state << 24 | token
        found = self.table.get(k)
        if found is None:
            if len(self.table) > ARCS_KEPT:
                self.table.clear()
            found = self.table[k] = self.arc(state, token)
        return found


class Tokenizer:
    """A word-level BPE tokenizer read from its JSON description."""

    def __init__(self, description: str):
        spec = json.loads(description)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.labels = [""] * size
        for s, i in (vocab | self.special).items():
            self.labels[i] = s
        symbols = byte_symbols()
        to_byte = {s: b for b, s in enumerate(symbols)}
        base = [vocab[s + e] for s in symbols for e in ("", WORD_END)]
        merges = [(vocab[u], vocab[v], vocab[u + v]) for u, v in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        self.automaton = Automaton(base, merges, size)
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for s, i in vocab.items():
            if not self.automaton.dead[i]:
                ends = s.endswith(WORD_END) and s != WORD_END
                of = s.removesuffix(WORD_END) if ends else s
                (self.final if ends else self.inner)[bytes(to_byte[c] for c in of)] = i
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.find_words = _find_words()
        self.compose = _composer()
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = _Words(self)

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the one accepting path over the bytes of a word."""
        auto, n = self.automaton, len(word)
        dest, arcs, look_up = auto.dest, auto.table.get, auto.has_arc
        known, longest = self.inner.get, self.longest
        states, tokens, starts = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        states[0] = 0
        for i in range(1, n + 1):
            if i == n:
                known = self.final.get
            for j in range(i - longest if i > longest else 0, i):
                t = known(word[j:i])
                if t is not None:
                    state = states[j]
                    if state >= 0:
                        ok = arcs(state << 24 | t)
                        if ok or ok is None and look_up(state, t):
                            states[i], tokens[i], starts[i] = dest[t], t, j
                            break
        out = []
        while n:
            out.append(tokens[n])
            n = starts[n]
        return out[::-1]

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.find_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.find_special.split(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain(p) for p in parts)

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = self.compose(text)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # one character at a time: no final sigma
        return b"".join(map(self.words.__getitem__, self.find_words(text)))

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, one space between."""
        return " ".join(map(self.labels.__getitem__, memoryview(ids).cast("I") if sys.byteorder == "little" else [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]))


class _Words(dict):
    """Ids of words seen lately: when the table is full its words step back, and those met again return."""

    def __init__(self, of: Tokenizer):
        self.of = of
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= TABLE_SIZE:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(word)
        if ids is None:
            ids = b"".join(i.to_bytes(4, "little") for i in self.of.encode_word(word.encode("utf-8", "surrogatepass")))
        self[word] = ids
        return ids


#: White space, written out as libraries differ on it; contractions, runs of letters, single numbers, runs of anything else.
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = "[{L}]+|[{N}]|'s|'t|'re|'ve|'m|'ll|'d|[^{S}{L}{N}]+"


# Letters, numbers and capitals that Unicode 16 and 17 added to this Python's 15.1, as the tokenizers library knows them
# (it splits words by 16 and lowers by 17).  Ranges are first and last code points; of capitals, also how far off the small letter is.
NEW_LETTERS = (
    "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 "
    "113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0"
)
NEW_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
NEW_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
# Marks younger than Unicode 9, by which the library composes; to it they neither move nor combine.
NEW_MARKS = (
    "7fd-7fd 898-89f 8ca-8d3 9fe-9fe c3c-c3c d3b-d3c eba-eba 1715-1715 1abf-1ace 1df6-1dfa a82c-a82c 10d24-10d27 10eab-10eac 10efd-10eff "
    "10f46-10f50 10f82-10f85 11070-11070 1133b-1133b 1145e-1145e 11839-1183a 11930-11930 1193d-1193e 11943-11943 119e0-119e0 11a34-11a34 11a47-11a47 "
    "11a99-11a99 11d42-11d42 11d44-11d45 11d97-11d97 11f41-11f42 16ff0-16ff1 1e08f-1e08f 1e130-1e136 1e2ae-1e2ae 1e2ec-1e2ef 1e4ec-1e4ef"
)
LOWER_TOO = {c: chr(c + off) for first, last, off in NEW_CAPITALS for c in range(first, last + 1)}


def _points(ranges: str) -> set[int]:
    return {c for r in ranges.split() for c in range(int(r.split("-")[0], 16), int(r.split("-")[1], 16) + 1)}


def _composer():
    """Normal form C by the library's tables: text is composed between marks that those don't know."""
    marks = re.compile("([" + "".join(map(chr, sorted(_points(NEW_MARKS)))) + "])")
    nfc = lambda x: unicodedata.normalize("NFC", x)
    return lambda text: "".join(map(nfc, marks.split(text))) if marks.search(text) else nfc(text)


def _ranges(major: str, new: str) -> str:
    """The code points of a Unicode category, as the inside of a character class."""
    added = _points(new)
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and (unicodedata.category(chr(c))[0] == major or c in added)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def _find_words():
    """Finds a lowered text's words: by the faster library where its newer Unicode tables agree, below U+0530."""
    fast = regex.compile(WORD.format(L=r"\p{L}", N=r"\p{N}", S=SPACE)).findall
    exact = re.compile(WORD.format(L=_ranges("L", NEW_LETTERS), N=_ranges("N", NEW_NUMBERS), S=SPACE)).findall
    beyond = re.compile("[\u0530-\U0010ffff]").search
    capital = re.compile("[" + "".join(map(chr, LOWER_TOO)) + "]").search

    def find(text: str) -> list[str]:
        if not beyond(text):
            return fast(text)
        return exact(text.translate(LOWER_TOO) if capital(text) else text)

    return find


_loaded: dict[str, Tokenizer] = {}


def load(description: str, key: str) -> Tokenizer:
    """The tokenizer of a description, compiled once a process."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(description)
    return _loaded[key]


def encode_column(docs: DataFrame, tokenizer_path: str, text_col: str, carry: list[str], make, schema: str) -> DataFrame:
    """Runs make(tokenizer, text) on every text; its tuples follow the columns ``carry`` under ``schema``.

    The description is read on the driver and broadcast: a few megabytes, whatever the corpus.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        description = spark.sparkContext.broadcast(f.read())
    full = StructType([*docs.select(*carry).schema.fields, *StructType.fromDDL(schema).fields])
    n, names, key = len(carry), full.names, tokenizer_path

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        tok = load(description.value, key)
        want = to_arrow_schema(full)
        for b in batches:
            for at in range(0, b.num_rows, TEXTS_AT_ONCE):
                part = b.slice(at, TEXTS_AT_ONCE)
                rows = [make(tok, x.as_py()) for x in part.column(n)]
                made = [pa.array(c, want.field(n + i).type) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.record_batch([*part.columns[:n], *made], names=names)
            give_back()

    return docs.select(*carry, text_col).mapInArrow(run, full)


def as_array(ids: bytes):
    """Ids as an array of numbers."""
    import numpy as np

    return np.frombuffer(ids, dtype="<i4")


def tokenise(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_name: str = "ids") -> DataFrame:
    """docs with the ids of each text as an array of ints beside all its columns."""
    name = free_name(docs, ids_name)
    return encode_column(docs, tokenizer_path, text_col, docs.columns, lambda tok, x: (as_array(tok.encode(x)),), f"`{name}` array<int>")
