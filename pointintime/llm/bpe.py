"""Byte-level BPE: texts to token ids and back, with the vocabulary of a public tokenizer file.

A task splits its texts into words (pre-tokens) over arrays, takes the different words of a run of texts, and merges all of them at
once: an index has all places of each pair, pairs come up in the order of their rank, and a merge at all places of a pair
updates the lists of the pairs that it makes. Words that are met again are remembered up to a bound.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PIECE, pieces, slices, table
from .terms import distinct, gather

#: Different words, and bytes of them, that a task remembers; it starts anew beyond.
KNOWN_WORDS, KNOWN_BYTES = 1 << 17, 2 << 20
#: Bytes of texts whose words are looked up together, and bytes of new words that are merged together at most.
RUN_BYTES, NEW_BYTES = 4 << 20, 2 << 20
#: Rows that a task encodes or decodes before it passes them on.
ROWS = 1_024

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: What follows an apostrophe in a pre-token of its own (fixed values of the vocabulary's pattern).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """White space, letter, number or other, for every code point."""
    if not _KINDS:
        kinds = np.full(0x110000, _OTHER, np.uint8)
        for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
            every = "".join(map(chr, range(lo, hi)))
            for kind, pattern in ((_SPACE, r"\p{White_Space}+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
                for m in regex.finditer(pattern, every):
                    kinds[lo + m.start() : lo + m.end()] = kind
        _KINDS.append(kinds)
    return _KINDS[0]


class Vocabulary:
    """Tables of one tokenizer file: ids of bytes, ranks of pairs, what they make, bytes of tokens, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, before = told["model"], told["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if model["type"] != "BPE" or not plain or told["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("not a plain byte-level BPE tokenizer")
        vocab = model["vocab"]
        # A token file writes printable bytes as themselves and the others as the letters from U+0100 on, in order.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in told["added_tokens"]):
            raise ValueError("special tokens that take their surroundings along aren't supported")
        if any(c.isspace() for content in special for c in content):
            raise ValueError("special tokens with white space aren't supported")
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.left, self.right = left.tolist(), right.tolist()
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        since = np.full(max(vocab.values()) + 1, -1)
        since[self.made] = np.arange(len(pairs))
        if len(np.unique(self.made)) < len(pairs) or not ((since[left] < np.arange(len(pairs))) & (since[right] < np.arange(len(pairs)))).all():
            raise ValueError("merges must use what earlier merges made")
        key = left << 32 | right
        self.rank_of = np.argsort(key)
        self.keys = key[self.rank_of]
        size = max([*vocab.values(), *special.values()]) + 1
        content = [b""] * size
        for token, k in vocab.items():
            content[k] = bytes(letters[c] for c in token)
        for token, k in special.items():
            content[k] = token.encode()
        self.special = sorted(((s.encode(), k) for s, k in special.items()), key=lambda x: (-len(x[0]), x[0]))
        self.ends = np.cumsum([len(c) for c in content])
        self.bytes = np.frombuffer(b"".join(content), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1).astype(np.int32)


def split(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the words of UTF-8 bytes begin, in bytes; no word crosses one of ``begins`` (sorted, 0 among them).

    Words are a contraction after an apostrophe; or letters, numbers or other characters, with one blank before them; or white space,
    of which a last character before something else stands apart.
    """
    if data.max(initial=0) < 128:
        codes, at = data, None
    else:
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        begins = np.searchsorted(at, begins)
    n = len(codes)
    kind = _kinds()[codes]
    first = np.zeros(n + 1, bool)
    first[begins[begins < n]] = True
    first[n] = True
    space, blank = kind == _SPACE, codes == 32
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[first[:-1]] = 255
    last = space & ~first[1:]  # white space before something else of the text
    last[:-1] &= ~space[1:]
    glued = np.zeros(n, bool)
    glued[1:] = (blank & last)[:-1]
    start = first[:-1] | np.where(space, (before != _SPACE) | last, (before != kind) & ~glued)
    mark = np.flatnonzero((codes == 39) & (before != _OTHER) & ~glued)
    if len(mark):
        padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
        cut = np.concatenate([first, np.ones(2, bool)])
        size = np.zeros(len(mark), np.int64)
        for tail in CONTRACTIONS:
            fits = size == 0
            for k, letter in enumerate(tail, 1):
                fits &= (padded[mark + k] == ord(letter)) & ~cut[np.minimum(mark + k, n + 1)]
            size[fits] = len(tail)
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        stop = mark + 1 + size
        start[stop[stop < n]] = True
    found = np.flatnonzero(start)
    return found if at is None else at[found]


def merged(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words (their bytes one after another) and where each word's begin.

    ``places`` has, for each active rank, the lists of places where its pair stood when they were made; a heap gives the lowest.
    Places whose pair has changed since are dropped when their rank comes up; of places that overlap (a run of one symbol) every
    second is taken from the left.
    """
    n = len(data)
    symbol = np.append(vocabulary.byte_ids[data], -1).astype(np.int32)  # what stands after a word's last symbol
    after = np.arange(1, n + 1, dtype=np.int32)
    ahead = np.arange(-1, n - 1, dtype=np.int32)
    after[offsets[1:][offsets[1:] > 0] - 1] = n
    ahead[offsets[:-1][offsets[:-1] < n]] = -1
    places: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def listed(at: np.ndarray) -> None:
        """Adds the pairs that begin at these places."""
        rank = vocabulary.ranks(symbol[at], symbol[after[at]])
        some = rank >= 0
        at, rank = at[some], rank[some]
        if not len(at):
            return
        order = rank.argsort(kind="stable")
        at, rank = at[order], rank[order]
        bounds = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
        for r, lo, hi in zip(rank[bounds[:-1]].tolist(), bounds, bounds[1:]):  # noqa: B905
            if r in places:
                places[r].append(at[lo:hi])
            else:
                places[r] = [at[lo:hi]]
                heapq.heappush(active, r)

    for lo in range(0, n, PIECE):
        listed(lo + np.flatnonzero(after[lo : lo + PIECE] < n).astype(np.int32))
    lefts, rights = vocabulary.left, vocabulary.right
    while active:
        r = heapq.heappop(active)
        lists = places.pop(r)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        left, right = lefts[r], rights[r]
        at = at[(symbol[at] == left) & (symbol[after[at]] == right)]
        if len(at) > 1:
            at = np.unique(at)
        if left == right and len(at) > 1:
            run = np.concatenate([[True], after[at[:-1]] != at[1:]])
            begin = np.flatnonzero(run)
            at = at[(np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        symbol[at], symbol[gone] = vocabulary.made[r], -1
        after[at] = after[gone]
        more = at[after[at] < n]
        ahead[after[more]] = more
        earlier = ahead[at]
        listed(np.concatenate([earlier[earlier >= 0], more]))
    symbol = symbol[:-1]
    stays = symbol >= 0
    count = np.concatenate([[0], np.cumsum(stays)])
    return symbol[stays], count[offsets]


class _Known:
    """Words that a task has met, by number, and the ids of those that are merged already."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.new: list[bytes] = []
        self.ids, self.starts, self.size, self.waiting = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0, 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word."""
        out = np.empty(len(words), np.int32)
        for k, w in enumerate(words):
            at = self.number.get(w)
            if at is None:
                at = self.number[w] = len(self.number)
                self.new.append(w)
                self.waiting += len(w)
            out[k] = at
        if self.waiting > NEW_BYTES:
            self.merge()
        return out

    def merge(self) -> None:
        if self.new:
            data = np.frombuffer(b"".join(self.new), np.uint8)
            ids, starts = merged(self.vocabulary, data, np.concatenate([[0], np.cumsum([len(w) for w in self.new])]))
            self.starts.append(starts[1:] + self.starts[-1][-1])
            self.ids.append(ids.astype(np.int32))
            self.size, self.new, self.waiting = self.size + len(data), [], 0

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and where each word's begin."""
        self.merge()
        self.ids, self.starts = [np.concatenate(self.ids)], [np.concatenate(self.starts)]
        return self.ids[0], self.starts[0]


def _specials(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """Start, end and id of the special strings of each text, from the left, longer ones first."""
    if not vocabulary.special:
        return []
    pattern = regex.compile(b"|".join(regex.escape(s) for s, _ in vocabulary.special))
    ids = dict(vocabulary.special)
    whole = data.tobytes()
    found = [(m.start(), m.end(), ids[m.group()]) for m in pattern.finditer(whole)]
    inner = set(offsets[1:-1].tolist())
    if not found or not inner:
        return found
    out = []  # a string across two texts is none: look again in the texts themselves
    for k in sorted(set((np.searchsorted(offsets, [f[0] for f in found], "right") - 1).tolist()) | set((np.searchsorted(offsets, [f[1] - 1 for f in found], "right") - 1).tolist())):
        out += [(m.start(), m.end(), ids[m.group()]) for m in pattern.finditer(whole, int(offsets[k]), int(offsets[k + 1]))]
    return out


def _cuts(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of a long text, which end before white space that follows something else: words always do there."""
    at, n = 0, len(data)
    while at < n:
        stop = at + limit
        while stop < n:
            part = data[stop - 1 : stop + limit]
            ok = np.flatnonzero((part[1:] == 32) & (part[:-1] > 32) & (part[:-1] < 127))
            if len(ok):
                stop += int(ok[0])
                break
            stop += limit
        yield at, min(stop, n)
        at = min(stop, n)


def encode_texts(vocabulary: Vocabulary, column: pa.Array, known: _Known | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, their ids and where each row's begin; a long text comes as several stretches of one row. Words are numbered
    first, those of about ``RUN_BYTES`` of text are merged together, and then come the ids."""
    known = known or _Known(vocabulary)
    held, size = [], 0

    def ready():
        ids, starts = known.tables()
        for first, last, *piece in held:
            yield first, last, *_ids(ids, starts, *piece)
        held.clear()
        if len(known.number) > KNOWN_WORDS or known.size > KNOWN_BYTES:
            known.clear()

    for first, last, data, offsets in pieces(column):
        long = last - first == 1 and len(data) > 2 * PIECE
        for a, b in _cuts(data, PIECE) if long else [(0, len(data))]:
            held.append((first, last, *_numbered(vocabulary, known, data[a:b], np.array([0, b - a]) if long else offsets)))
            size += b - a
            if size >= RUN_BYTES:
                yield from ready()
                size = 0
    yield from ready()


def _numbered(vocabulary: Vocabulary, known: _Known, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The numbers of the words, the first word of each text, and the words that are special strings, with their ids."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), []
    special = _specials(vocabulary, data, offsets)
    edges = np.array([x for a, b, _ in special for x in (a, b)], np.int64)
    start = split(data, np.unique(np.concatenate([offsets[:-1], edges])))
    if special:
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, edges[0::2], 1)
        np.add.at(inside, edges[1::2], -1)
        start = start[(np.cumsum(inside)[start] == 0) | np.isin(start, edges[0::2])]
    end = np.append(start[1:], len(data))
    first, which = distinct(data, start, end)
    words = [data[a:b].tobytes() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    return known.numbers(words)[which], np.searchsorted(start, offsets), list(zip(np.searchsorted(start, edges[0::2]).tolist(), [k for _, _, k in special], strict=True))


def _ids(ids: np.ndarray, starts: np.ndarray, word: np.ndarray, begins: np.ndarray, special: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    at, token = gather(starts[word], starts[word + 1])
    out = ids[at]
    if special:
        # A special string is merged like a word above, and replaced here.
        keep = np.ones(len(out), bool)
        for k, number in special:
            out[token[k]] = number
            keep[token[k] + 1 : token[k + 1]] = False
        count = np.concatenate([[0], np.cumsum(keep)])
        out, token = out[keep], count[token]
    return out, token[begins]


_TABLES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The tables of a tokenizer file, read once by the driver; they are as large as the file, whatever the input."""
    key = f"{path}|{os.path.getmtime(path)}"
    if key not in _TABLES:
        _TABLES[key] = Vocabulary(path)
    return _TABLES[key]


def _packed(v: Vocabulary, known: _Known, column: pa.Array) -> pa.Array:
    """The ids of a column of texts, packed."""
    found: list[bytes] = [b""] * len(column)
    parts: dict[int, list[bytes]] = {}
    for first, last, ids, starts in encode_texts(v, column, known):
        raw = ids.astype("<i4").tobytes()
        for k in range(last - first):
            piece = raw[4 * starts[k] : 4 * starts[k + 1]]
            if last - first == 1:
                parts.setdefault(first, []).append(piece)
            else:
                found[first + k] = piece
    for k, pieces_ in parts.items():
        found[k] = b"".join(pieces_)
    return pa.array(found, pa.binary())


def _read(v: Vocabulary, column: pa.Array) -> pa.Array:
    """The texts of a column of packed ids."""
    starts, found = np.concatenate([[0], v.ends[:-1]]), []
    for packed in column:
        raw, parts = np.frombuffer(packed.as_py() or b"", "<i4"), []
        for a in range(0, len(raw), PIECE):
            ids = raw[a : a + PIECE]
            parts.append(v.bytes[gather(starts[ids], v.ends[ids])[0]].tobytes())
        found.append(b"".join(parts).decode("utf-8", "replace"))
    return pa.array(found, pa.string())


def encode(df: DataFrame, tokenizer: str, column: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """All columns and ``out``, the text's token ids as little-endian 32-bit integers (``unpacked`` makes an array of them);
    ``decoded`` names a column for the text that these ids decode to, made in the same pass.

    A null or empty text has no ids. White space alone, unknown characters, one word of any length and special strings of the vocabulary
    encode as the tokenizer's own library does without adding special tokens. Repeated rows are encoded each; columns named as the new ones
    are replaced; an empty table stays empty. A long text is taken in stretches that end where words do.
    """
    new = [T.StructField(out, T.BinaryType()), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    df = df.drop(*(f.name for f in new))
    place = df.columns.index(column)
    sent = df.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))

    def run(batches):
        known = _Known(sent.value)
        for batch in (part for batch in batches for part in slices(batch, ROWS)):
            ids = _packed(sent.value, known, batch.column(place))
            more = [ids, *([_read(sent.value, ids)] if decoded else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *(f.name for f in new)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new]))


def unpacked(ids) -> F.Column:
    """Packed ids as an array of integers."""
    digits = F.hex(ids)
    byte = lambda k, b: F.conv(F.substring(digits, k * 8 + 2 * b + 1, 2), 16, 10).cast("int")
    numbers = F.sequence(F.lit(0), (F.octet_length(ids) / 4).cast("int") - 1)
    value = lambda k: byte(k, 0) + byte(k, 1) * 256 + byte(k, 2) * 65536 + byte(k, 3) * 16777216
    return F.when(F.octet_length(ids) > 0, F.transform(numbers, value)).otherwise(F.array().cast("array<int>"))


def decode(df: DataFrame, tokenizer: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and ``out``, the text of packed ids; bytes that are no UTF-8 become replacement characters. Null or no ids: empty.
    An id that the vocabulary doesn't have is an error."""
    df = df.drop(out)
    place = df.columns.index(column)
    sent = df.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))

    def run(batches):
        for batch in (part for batch in batches for part in slices(batch, ROWS)):
            yield pa.RecordBatch.from_arrays([*batch.columns, _read(sent.value, batch.column(place))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Ids and decoded texts of all ``documents``, as digests."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    both = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, decoded="decoded")
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
