"""Byte-level BPE: a memo over the tokenizers library, and tree concatenation for long texts.

The library does every merge; the memo only keeps what it returned for a unit of text.  A unit is a run without blanks
and line feeds together with the one blank or line feed before it.  The library's pattern always ends a piece between a
character that is not white space and one that is, and what follows such a place does not depend on what precedes it, so
the ids of a text are the ids of its units in turn.  The first unit of a text, and white space other than one blank or line feed, are units
that keep their own white space.
"""

from __future__ import annotations

import hashlib
import os
import re
import string
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_one, ship

#: Units that a worker's memo holds; at twice that (about 240 MB) the half that was not asked for lately goes.
MEMO_UNITS = 440_000
#: Units that the library gets as one text.
JOINED = 48
#: Characters of a leaf.  Longer texts are halved until no part is longer.
LEAF_CHARS = 32_768
#: Tokens on either side of a join that the first window takes; it doubles until both sides agree.
WINDOW = 16
#: White space of the library's pattern, of which every version of Unicode says the same.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
BLANK = re.compile(f"[{WHITE}]")
OTHER = "\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: The byte-level alphabet: the character that stands for each byte.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LENT = [b for b in range(256) if b not in _OWN]
BYTE_CHARS = [chr(b) if b in _OWN else chr(256 + _LENT.index(b)) for b in range(256)]
#: Runs of marks whose ids are kept.
MAX_MARKS = 10_000
#: Begins the key of a unit that has its own white space.
LITERAL = "\0"
#: What a text must not have to be split at single blanks and line feeds.
_ODD = ["  ", "\n\n", "\n ", " \n", *OTHER]
#: Letters below this code point are letters in every version of Unicode that the libraries at hand know.
PLAIN = 0x250
LETTERS = "".join(c for c in map(chr, range(PLAIN)) if c.isalpha())
#: A word: letters, which are one piece together with a blank before them, and the marks after them, which are pieces of their own.
WORD = re.compile(f"(\n?)([{LETTERS}]+)([!-/:-@\\[-`{{-~]*)")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode(list of texts) gives for each its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = sorted((t.content for t in self.lib.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tail = {c: self.whole(c) for c in ("\n", *".,;:!?")}
        self._bytes: list[bytes] | None = None
        self.begins: dict[str, np.ndarray] = {}
        self.merge = self.lib.model.tokenize if self._pieces_by_class() else None
        self.letters = {ord(c): "".join(BYTE_CHARS[b] for b in c.encode()) for c in LETTERS}

    def ids(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return np.array(self.ids(text), dtype="<u4").tobytes()

    def _pieces_by_class(self) -> bool:
        """Does the library cut texts of this vocabulary by its byte-level pattern only, so that letters are one piece, which the
        model gets as it is?"""
        pre, model = self.lib.pre_tokenizer, self.lib.model
        if type(pre).__name__ != "ByteLevel" or not pre.use_regex or pre.add_prefix_space or self.lib.normalizer is not None:
            return False
        return type(model).__name__ == "BPE" and not model.dropout and not any(WORD.fullmatch(t.strip()) or not t.strip(string.punctuation) for t in self.special)

    def _word(self, mark: str, letters: str) -> bytes:
        """The ids of letters as the library's model merges them: the text around them needs no cutting."""
        ids = [t.id for t in self.merge(mark + (letters if letters.isascii() else letters.translate(self.letters)))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _marks(self, marks: str) -> bytes:
        if (ids := self.tail.get(marks)) is None:
            ids = self.whole(marks)
            if len(self.tail) < MAX_MARKS:
                self.tail[marks] = ids
        return ids

    def _first(self, unit: str) -> bytes:
        """A text's first unit, which has no blank before it."""
        if self.merge and (m := WORD.fullmatch(unit)) and not m[1]:
            return self._word("", m[2]) + (self._marks(m[3]) if m[3] else b"")
        return self.whole(unit)

    def _learn(self, missing: set[str]) -> None:
        """Ask the library for units that the memo lacks: words go to its model, others to the library many at a time, and those
        with characters that may be white space to it one by one."""
        memo, older, others = self.memo, self.older, missing
        if self.merge:
            others, word, fits, line, blank = [], self._word, WORD.fullmatch, self.tail["\n"], BYTE_CHARS[32]
            for u in missing:
                if not (m := fits(u)):
                    others.append(u)
                    continue
                new, letters, marks = m.groups()
                stem = new + letters
                if (ids := memo.get(stem)) is None and (ids := older.get(stem)) is None:
                    ids = line + word("", letters) if new else word(blank, letters)
                    memo[stem] = ids
                if marks:
                    memo[u] = ids + self._marks(marks)
        words, lines, marked = {}, {}, []
        for u in others:
            stem = u[:-1] if u[-1] in self.tail and len(u) > 1 and ord(u[-2]) < PLAIN and u[-2].isalpha() else u
            if stem[0] == "\n" and len(stem) > 1 and stem[1:].isprintable():
                lines[stem] = None
            elif stem.isprintable():  # neither LITERAL nor white space
                words[stem] = None
            else:
                memo[u] = self.whole(u[1:] if u[0] == LITERAL and BLANK.match(u, 1) else u if u[0] == "\n" else " " + u)
                continue
            if stem is not u:
                marked.append(u)
        self._together([w for w in words if w not in memo], " ")
        self._together([w for w in lines if w not in memo], "\n")
        for u in marked:  # a letter and a mark: a piece ends between them
            memo[u] = memo[u[:-1]] + self.tail[u[-1]]

    def _together(self, units: list[str], mark: str) -> None:
        """Units encoded JOINED in a text, as short texts cost the library less a unit than long ones and than single units.  Each
        begins with the mark, which none has elsewhere, and the library begins a piece there: so a token that begins
        with it is the first of a unit."""
        if mark not in self.begins:
            self.begins[mark] = np.array([t[:1] == mark.encode() for t in self.table()])
        begins = self.begins[mark]
        for at in range(0, len(units), 64 * JOINED):
            parts = [units[k : k + JOINED] for k in range(at, min(at + 64 * JOINED, len(units)), JOINED)]
            texts = ["".join(p) if mark == "\n" else mark + mark.join(p) for p in parts]
            for part, e in zip(parts, self.lib.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype="<u4")
                first, raw = np.flatnonzero(begins[ids]) * 4, ids.tobytes()
                if len(first) != len(part) or first[0]:  # a vocabulary of another kind
                    self.memo.update((w, self.whole(w if w[0] == mark else mark + w)) for w in part)
                    continue
                ends = [*first.tolist(), len(raw)]
                for k, w in enumerate(part):
                    self.memo[w] = raw[ends[k] : ends[k + 1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if any(x in t for x in _ODD) or t[-1] == " ":
                out[i] = self._by_units(t)
            else:
                plain.append(i)
        if plain:
            for i, ids in zip(plain, self._plain([texts[i] for i in plain]), strict=True):
                out[i] = ids
        return out

    def _values(self, units: list[str]) -> list[bytes]:
        """The ids of units, by the keys of the memo."""
        if len(self.memo) > MEMO_UNITS:
            self.older, self.memo = self.memo, {}
        found = list(map(self.memo.get, units))
        if None in found:
            memo, older, holes = self.memo, self.older, []
            for k in [k for k, v in enumerate(found) if v is None]:
                u = units[k]
                if (v := older.get(u)) is None:
                    holes.append(k)
                else:
                    found[k] = memo[u] = v
            if holes:
                self._learn({units[k] for k in holes})
                for k in holes:
                    found[k] = memo[units[k]]
        return found

    def _by_units(self, text: str) -> bytes:
        units = UNIT.findall(text)
        first = b"" if BLANK.match(units[0]) else self._first(units.pop(0))
        return first + b"".join(self._values([u[1:] if u[0] == " " and len(u) > 1 and not BLANK.match(u[1]) else LITERAL + u for u in units]))

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Texts whose white space is single blanks and line feeds: split and counted by Arrow, put together by numpy."""
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " \n"), " ")
        at = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        units, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()  # to_pylist() costs several times as much
        codes[at[:-1]] = np.arange(len(units), len(units) + len(texts))  # a text's first unit has no blank before it
        firsts = [self._first(units[c]) if units[c] else b"" for c in coded.indices.to_numpy()[at[:-1]].tolist()]
        used = [u or "\n" for u in units]  # the empty unit stands at a text's start only
        values = self._values(used) + firsts
        size = np.fromiter(map(len, values), np.int32, len(values)) // 4
        blob = np.frombuffer(b"".join(values), "<u4")
        start = np.cumsum(size, dtype=np.int32) - size
        n = size[codes]
        upto = np.cumsum(n, dtype=np.int32)
        ids = blob[np.repeat(start[codes] - (upto - n), n) + np.arange(upto[-1], dtype=np.int32)].tobytes()
        ends = (np.concatenate([[0], upto])[at].astype(np.int64) * 4).tolist()
        return [ids[ends[k] : ends[k + 1]] for k in range(len(texts))]

    def table(self) -> list[bytes]:
        """The bytes of every id, by the byte-level alphabet of the file."""
        if self._bytes is None:
            back = {c: b for b, c in enumerate(BYTE_CHARS)}
            added = {i: t.content for i, t in self.lib.get_added_tokens_decoder().items()}
            self._bytes = [b""] * self.lib.get_vocab_size(with_added_tokens=True)
            for token, i in self.lib.get_vocab(with_added_tokens=True).items():
                self._bytes[i] = added[i].encode() if i in added else bytes(back[c] for c in token)
        return self._bytes

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 of the library's decode(ids, skip_special_tokens=False)."""
        raw = b"".join(map(self.table().__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return self.lib.decode(np.frombuffer(ids, dtype="<u4").tolist(), skip_special_tokens=False).encode()

    # -- tree concatenation ------------------------------------------------------------------------------------------

    @staticmethod
    def kind(c: str) -> str:
        """The class of a character in the library's pattern; '?' where versions of Unicode may differ."""
        if ord(c) >= PLAIN or c in "\x1c\x1d\x1e\x1f\x85":
            return "?"
        return "S" if c.isspace() else "L" if c.isalpha() else "N" if c.isnumeric() else "P"

    @classmethod
    def cut(cls, a: str, b: str) -> bool:
        """Does a piece always end between a and b, with what follows encoded as if it stood alone?"""
        x, y = cls.kind(a), cls.kind(b)
        return x != y and "?" not in (x, y) and x != "S" and (x, y) != ("P", "L")

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of the joined text from the ids of two neighbouring parts of it.

        A window of tokens around the join is encoded anew and grows until both sides agree.  They agree at a place where
        a piece ends whatever surrounds it; or, inside one long piece (all of one class), at a token that both encodings
        share, since a row of tokens is the encoding of its piece if each neighbouring pair of it is one of some encoding.
        """
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        table, n = self.table(), WINDOW
        while True:
            a, b = left[-n:], right[:n]
            all_left, all_right = n >= len(left), n >= len(right)
            left_bytes, right_bytes = [table[i] for i in a.tolist()], [table[i] for i in b.tolist()]
            lb, rb = b"".join(left_bytes), b"".join(right_bytes)
            try:
                lt, rt = lb.decode(), rb.decode()
            except UnicodeDecodeError:  # the window's edge splits a character
                lt = rt = None
                if all_left and all_right:
                    raise
            if lt is not None:
                lo, hi = (0 if all_left else None), (len(rt) if all_right else None)
                if lo is None:
                    lo = next((i for i in range(1, len(lt)) if self.cut(lt[i - 1], lt[i])), None)
                if hi is None:
                    hi = next((i for i in range(len(rt) - 1, 0, -1) if self.cut(rt[i - 1], rt[i])), None)
                if lo is not None and hi is not None:
                    keep_left = self._tokens(left_bytes, len(lt[:lo].encode()))
                    keep_right = self._tokens(right_bytes, len(rt[:hi].encode()))
                    if keep_left is not None and keep_right is not None:
                        mid = np.array(self.ids(lt[lo:] + rt[:hi]), dtype="<u4")
                        return np.concatenate([left[: len(left) - len(a) + keep_left], mid, right[keep_right:]])
                kinds = {self.kind(c) for c in lt + rt}
                if len(kinds) == 1 and kinds <= {"L", "N", "P"} and not (all_left or all_right):
                    mid = np.array(self.ids(lt + rt), dtype="<u4")
                    if len(mid) > 1 and mid[0] == a[0] and mid[-1] == b[-1]:
                        return np.concatenate([left[:-n], mid, right[n:]])
            if all_left and all_right:
                return np.array(self.ids(lt + rt), dtype="<u4")
            n *= 2

    @staticmethod
    def _tokens(parts: list[bytes], at: int) -> int | None:
        """How many tokens make up the first *at* bytes; None where a token crosses that place."""
        done = 0
        for k, p in enumerate(parts):
            if done == at:
                return k
            done += len(p)
        return len(parts) if done == at else None

    def tree(self, leaves: list[np.ndarray]) -> np.ndarray:
        """Join neighbours, then neighbours of those, until one row of ids is left."""
        while len(leaves) > 1:
            leaves = [self.join(leaves[k], leaves[k + 1]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
        return leaves[0] if leaves else np.zeros(0, "<u4")


def encoder(path: str) -> Encoder:
    """One encoder a worker and file; workers live on, and so does what they have learnt."""
    return keep_one(("bpe", path), lambda: Encoder(path))


def halves(text: str, leaf: int) -> list[str]:
    """Halve until no part is longer than leaf."""
    if len(text) <= leaf:
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], leaf) + halves(text[mid:], leaf)


def segments(text: str, special: list[str]) -> list[tuple[bool, str]]:
    """The text between special strings, and these; the library encodes each on its own."""
    out = [(False, text)]
    for s in special:
        cut: list[tuple[bool, str]] = []
        for fixed, part in out:
            if fixed or s not in part:
                cut.append((fixed, part))
                continue
            for k, x in enumerate(part.split(s)):
                cut += ([(True, s)] if k else []) + ([(False, x)] if x else [])
        out = cut
    return out


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def batches(batch: pa.RecordBatch, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about that many bytes, so that very long texts don't meet in memory."""
    if batch.num_rows:
        n = max(1, int(batch.num_rows * chars / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def ids_column(enc: Encoder, ids: list[bytes]) -> dict[str, pa.Array]:
    return {"ids": pa.array(ids, pa.binary())}


def digest_columns(enc: Encoder, ids: list[bytes]) -> dict[str, pa.Array]:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": pa.array(list(map(sha, ids)), pa.string()), "decoded_sha256": pa.array([sha(enc.decode(x)) for x in ids], pa.string())}


def encoded(docs: DataFrame, path: str, leaf: int = LEAF_CHARS, text: str = "text", key: str = "doc_id", finish: Callable[[Encoder, list[bytes]], dict[str, pa.Array]] = ids_column, columns: str = "ids binary") -> DataFrame:
    """(doc_id, ids binary): the whole text's ids as little-endian unsigned 32-bit integers.  Null text: no ids.

    *finish* makes other columns of the ids where they come about, so that a task needs one Python worker, not two.

    Texts up to *leaf* characters are encoded where they are read.  Longer ones are halved to leaves, which are dealt to
    all tasks and encoded there; each text's leaves then meet in one group of its own and are joined pair by pair.  Rows
    with the same doc_id stay rows of their own: a long row is told apart by its place in the scan.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.dtypes)[key]
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def short(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in rows:
            for b in batches(whole):
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0)} | finish(enc, enc.encode(texts_of(b.column(1)))))

    def leaves(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = encoder(path).special
        for whole in rows:
            for b in batches(whole):
                for doc, row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), strict=True):
                    got = [(n, fixed, x) for n, (fixed, s) in enumerate(segments(t, special)) for x in ([s] if fixed else halves(s, leaf))]
                    for at in range(0, len(got), 64):
                        part = got[at : at + 64]
                        yield pa.RecordBatch.from_arrays([pa.array([doc] * len(part), b.schema.field(0).type), pa.array([row] * len(part), pa.int64()), pa.array(range(at, at + len(part)), pa.int32()), pa.array([x[0] for x in part], pa.int32()), pa.array([x[2] for x in part], pa.string())], ["doc_id", "row", "leaf", "segment", "text"])

    def leaf_ids(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in rows:
            for b in batches(whole):
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(enc.encode(texts_of(b.column(4))), pa.binary())], ["doc_id", "row", "leaf", "segment", "ids"])

    def joined(group: pa.Table) -> pa.Table:
        enc = encoder(path)
        group = group.sort_by("leaf")
        by: dict[int, list[np.ndarray]] = {}
        for s, ids in zip(group["segment"].to_pylist(), group["ids"].to_pylist(), strict=True):
            by.setdefault(s, []).append(np.frombuffer(ids, dtype="<u4"))
        ids = np.concatenate([enc.tree(by[s]) for s in sorted(by)]).astype("<u4").tobytes()
        return pa.table({"doc_id": group["doc_id"][:1]} | finish(enc, [ids]))

    few = own.where(F.coalesce(F.length("text"), F.lit(0)) <= leaf).mapInArrow(short, f"doc_id {kind}, {columns}")
    long = own.where(F.length("text") > leaf).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    parts = long.mapInArrow(leaves, f"doc_id {kind}, row long, leaf int, segment int, text string").repartition("row", "leaf")
    many = parts.mapInArrow(leaf_ids, f"doc_id {kind}, row long, leaf int, segment int, ids binary").groupBy("row").applyInArrow(joined, f"doc_id {kind}, {columns}")
    return few.unionByName(many)


def bpe_round_trip(docs: DataFrame, path: str | None = None, leaf: int = LEAF_CHARS) -> DataFrame:
    """Encode every whole text and decode it again: one row per input row (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Null and empty texts have no ids; repeated rows give repeated rows; other columns of docs are ignored.
    """
    return encoded(docs, path or vocabulary(), leaf, finish=digest_columns, columns="n_tokens long, ids_sha256 string, decoded_sha256 string")
