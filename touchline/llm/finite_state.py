"""Byte-pair tokenizers compiled to finite-state transducers that run over whole batches in numpy.

Two transducers in series give exactly the ids of the ``tokenizers`` library:

1. The *splitter* is a small deterministic transducer over character classes. It marks where each
   pretoken starts; where that is only known a character later, the transition says so ("starts one
   back"). A batch of texts, with an end mark after each, is cut into equal chunks that advance in
   step. For every chunk the map from each possible entry state to its exit state is computed first;
   a parallel prefix scan composes the maps, which gives each chunk its true entry state, and one
   more run emits the marks. A text cut into chunks is therefore split as if read in one go.
2. The *lexicon* is a memo: it holds the ids, and so the number, of the tokens of each pretoken met so far, as
   the library encodes it. Equal pretokens of a batch are found by a 64-bit hash and, beyond ``SURE``
   characters, compared character by character; the lexicon is keyed by the hash, beyond those by the text. It
   grows to ``MAX_WORDS``; words beyond those, and pretokens over ``MAX_WORD`` code points, are encoded without
   being kept.

Token counts and positions of texts follow from prefix sums over the counts of their pretokens.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata

import numpy as np

# Character classes. SUFFIX are letters that end a contraction at once; R, V and L may start one.
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE, SUFFIX, R, V, L, E, END = range(12)
N_CLASSES = 12
UNKNOWN = 12           # code points that Python's Unicode tables don't know; the library's may
LETTERS = (LETTER, SUFFIX, R, V, L, E)

# States: ready for a new pretoken; inside a run; after white space; inside a possible contraction.
READY, IN_LETTERS, IN_NUMBER, IN_OTHER, SPACE1, SPACES, BLANK1, BLANKS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(12)
N_STATES = 12

CHUNK, HEAD = 256, 8   # characters a chunk advances, and those it advances from all states; a batch is thousands of chunks
SEGMENT = 1_000_000    # characters handled at once; longer texts are cut where a word ends
MAX_WORDS = 1_000_000
MAX_WORD = 64
SURE = 16              # characters up to which sums of powers modulo 2**64 have no known clashes by pattern
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def splitter(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Transition and emission tables, indexed by state * N_CLASSES + class.

    Emission bits: 1, a pretoken starts at this character; 2, one started a character back. In kind
    "words" white space belongs to no pretoken, and each number character is one; in kind "bytes" a
    space joins the run after it and other white space forms runs of its own.
    """
    move = np.zeros((N_STATES, N_CLASSES), np.uint8)
    emit = np.zeros((N_STATES, N_CLASSES), np.uint8)

    def start(c: int) -> tuple[int, int]:
        if c in LETTERS:
            return IN_LETTERS, 1
        if c == END:
            return READY, 1
        if c in (SPACE, BLANK) and kind == "words":
            return READY, 1
        return {NUMBER: IN_NUMBER, OTHER: IN_OTHER, QUOTE: QUOTED, SPACE: SPACE1, BLANK: BLANK1}[c], 1

    def inside(c: int) -> int:
        """State after a character that continues or joins a run."""
        return IN_LETTERS if c in LETTERS else IN_NUMBER if c == NUMBER else IN_OTHER

    finish = {QUOTED_R: E, QUOTED_V: E, QUOTED_L: L}
    for s in range(N_STATES):
        for c in range(N_CLASSES):
            blank = c in (SPACE, BLANK)
            to, marks = start(c)
            if c == END:
                marks |= 2 if s in finish else 0
            elif s == IN_LETTERS and c in LETTERS or s == IN_OTHER and c in (OTHER, QUOTE):
                to, marks = s, 0
            elif s == IN_NUMBER and c == NUMBER and kind == "bytes":
                to, marks = s, 0
            elif s in (SPACE1, SPACES, BLANK1, BLANKS) and blank:
                to, marks = SPACES if c == SPACE else BLANKS, 0
            elif s == SPACE1:
                to, marks = inside(c), 0
            elif s == SPACES:
                to, marks = inside(c), 2
            elif s == BLANKS:
                marks |= 2
            elif s == QUOTED:
                if c == SUFFIX:
                    to, marks = READY, 0
                elif c in (R, V, L):
                    to, marks = {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[c], 0
                elif c in (OTHER, QUOTE):
                    to, marks = IN_OTHER, 0
            elif s in finish:
                if c == finish[s]:
                    to, marks = READY, 0
                elif c in LETTERS:
                    to, marks = IN_LETTERS, 2
                else:
                    marks |= 2
            move[s, c], emit[s, c] = to, marks
    return move.ravel(), emit.ravel()


@functools.cache
def character_classes() -> np.ndarray:
    """Class of every code point, from Unicode's general categories."""
    classes = np.zeros(sys.maxunicode + 1, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER, "Z": BLANK}
    for point in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(point))
        classes[point] = UNKNOWN if category == "Cn" else kinds.get(category[0], OTHER)
    classes[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85]] = BLANK
    classes[ord(" ")] = SPACE
    classes[ord("'")] = QUOTE
    for letter, c in {"s": SUFFIX, "t": SUFFIX, "m": SUFFIX, "d": SUFFIX, "r": R, "v": V, "l": L, "e": E}.items():
        classes[ord(letter)] = c
    return classes


@functools.cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    def run(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)
    return run(MULTIPLIER), run(pow(MULTIPLIER, -1, 1 << 64))


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (rows), by doubling steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


def same_runs(points: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, other: np.ndarray) -> bool:
    """Whether the runs of characters at ``a`` of each ``size`` equal those at ``b`` of sizes ``other``, where their hashes
    do. Runs of up to ``SURE`` characters are taken as equal by hash."""
    if not np.array_equal(size, other):
        return False
    moved = np.flatnonzero((a != b) & (size > SURE))
    a, b, size = a[moved], b[moved], size[moved]
    before = np.cumsum(size) - size
    at = np.arange(size.sum(), dtype=np.int32)
    return bool((points[at + np.repeat((a - before).astype(np.int32), size)]
                 == points[at + np.repeat((b - before).astype(np.int32), size)]).all())


class CompiledTokenizer:
    """Encodes lists of texts; use ``compiled(path)`` for one instance per worker and file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"]:
            self.kind = "bytes"
        elif pre["type"] == "Sequence" and [p["type"] for p in pre["pretokenizers"]] == ["Split", "ByteLevel"]:
            self.kind = "words"
        else:
            raise ValueError(f"no transducer for the pre-tokenizer {pre['type']}")
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.move, self.emit = splitter(self.kind)
        self.lexicon: dict[int | str, bytes] = {}
        self.id_type = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")

    # ---- first transducer -------------------------------------------------------------------

    def normal(self, text: str) -> str:
        """The library's normal form ("words" only): composed, lower case character by character."""
        if self.kind == "bytes":
            return text
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def foreign(self, text: str) -> bool:
        """Whether only the library can split the text: it holds a special token or an unknown character."""
        if self.special and self.special.search(text):
            return True
        if self.kind == "bytes" or text.isascii():
            return False
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return bool((character_classes()[points] == UNKNOWN).any())

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Whether a pretoken starts at each character."""
        lanes = -(-len(classes) // CHUNK)
        padded = np.full(lanes * CHUNK, END, np.uint8)
        padded[:len(classes)] = classes
        columns = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)

        maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (lanes, 1))
        for column in columns[:HEAD]:
            maps = self.move[maps * np.uint8(N_CLASSES) + column[:, None]]
        open_lanes = np.flatnonzero((maps != maps[:, :1]).any(axis=1))

        marks = np.empty((CHUNK, lanes), np.uint8)
        state = self.advance(columns[HEAD:], maps[:, 0], marks[HEAD:])
        exits = np.repeat(state[:, None], N_STATES, axis=1)
        if len(open_lanes):
            still = maps[open_lanes]
            for column in columns[HEAD:, open_lanes]:
                still = self.move[still * np.uint8(N_CLASSES) + column[:, None]]
            exits[open_lanes] = still

        entry = np.full(lanes, READY, np.uint8)
        entry[1:] = compose_scan(exits)[:-1, READY]
        state = self.advance(columns[:HEAD], entry, marks[:HEAD])
        if len(open_lanes):
            rest = np.empty((CHUNK - HEAD, len(open_lanes)), np.uint8)
            self.advance(columns[HEAD:, open_lanes], state[open_lanes], rest)
            marks[HEAD:, open_lanes] = rest
        marks = marks.T.ravel()[:len(classes)]
        begins = (marks & 1).astype(bool)
        begins[:-1] |= (marks[1:] & 2).astype(bool)
        return begins

    def advance(self, columns: np.ndarray, state: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """State after the columns; fills in the emissions on the way."""
        for i, column in enumerate(columns):
            index = state * np.uint8(N_CLASSES) + column
            marks[i] = self.emit[index]
            state = self.move[index]
        return state

    def pieces(self, text: str):
        """A text in segments, cut before white space that follows a word, so each splits alone."""
        while len(text) > SEGMENT:
            cut = re.search(r"(?<=[^\s])\s", text[SEGMENT:])
            if not cut:
                break
            yield text[:SEGMENT + cut.start()]
            text = text[SEGMENT + cut.start():]
        yield text

    # ---- second transducer ------------------------------------------------------------------

    def compile(self, words: list[str]) -> list[bytes]:
        # A word's characters have their normal form already and hold no special token.
        found = self.library.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, self.id_type).tobytes() for e in found]

    def words_of(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(index of a word per pretoken, ids of each word, first pretoken of each text and the end)."""
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = character_classes()[points]
        classes[classes == UNKNOWN] = OTHER
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        classes[ends] = END

        at = np.flatnonzero(self.starts(classes))
        at_class = classes[at]
        length = np.diff(at, append=len(classes))
        real = at_class != END
        if self.kind == "words":
            real &= (at_class != SPACE) & (at_class != BLANK)
        first = np.concatenate([[0], np.cumsum(real)[np.searchsorted(at, ends)]])
        at, length = at[real], length[real]

        up, down = powers(1 << max(12, int(len(points)).bit_length()))
        prefix = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:len(points)], out=prefix[1:])
        keys = (prefix[at + length] - prefix[at]) * down[at]
        keys ^= length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        keys, example, index = np.unique(keys, return_index=True, return_inverse=True)
        begin, size = at[example], length[example]
        lookup: list[int | str] = keys.tolist()
        if same_runs(points, at, begin[index], length, size[index]):
            for i in np.flatnonzero(size > SURE).tolist():
                lookup[i] = joined[begin[i]:begin[i] + size[i]]
        else:       # different pretokens of one hash: tell them apart by their text
            places: dict[str, int] = {}
            index = np.array([places.setdefault(joined[a:a + n], len(places))
                              for a, n in zip(at.tolist(), length.tolist(), strict=True)], np.int64)
            lookup = list(places)

        ids = list(map(self.lexicon.get, lookup))
        missing = [i for i, found in enumerate(ids) if found is None]
        words = [x if isinstance(x := lookup[i], str) else joined[begin[i]:begin[i] + size[i]] for i in missing]
        for i, word, found in zip(missing, words, self.compile(words), strict=True):
            ids[i] = found
            if len(word) <= MAX_WORD and len(self.lexicon) < MAX_WORDS:
                self.lexicon[lookup[i]] = found
        return index, ids, first

    # ---- texts ------------------------------------------------------------------------------

    def _groups(self, texts: list[str]):
        """Groups of bounded size: (positions of the texts, segments). None in place of segments: one
        text that the library handles itself."""
        places, parts, size = [], [], 0
        for i, text in enumerate(texts):
            if self.foreign(text):
                yield [i], None
                continue
            for piece in self.pieces(self.normal(text)):
                if size + len(piece) > SEGMENT and parts:
                    yield places, parts
                    places, parts, size = [], [], 0
                places.append(i)
                parts.append(piece)
                size += len(piece)
        if parts:
            yield places, parts

    def _encoded(self, texts: list[str]):
        """(place of a text, its next ids, how many) for every text, in order of its parts; the ids of a
        group of texts are made only when asked for."""
        for places, parts in self._groups(texts):
            if parts is None:
                whole = np.array(self.library.encode(texts[places[0]], add_special_tokens=False).ids, self.id_type)
                yield places[0], whole.__getitem__, 0, len(whole)
            else:
                yield from self._emitted(places, *self.words_of(parts))

    def _emitted(self, places: list[int], index: np.ndarray, ids: list[bytes], first: np.ndarray):
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.id_type.itemsize
        emitted = sizes[index]
        before = np.concatenate([[0], np.cumsum(emitted)])
        made: list[np.ndarray] = []

        def flat(part: slice) -> np.ndarray:
            if not made:
                words = np.frombuffer(b"".join(ids), self.id_type)
                offsets = np.cumsum(sizes) - sizes
                made.append(words[np.repeat(offsets[index] - before[:-1], emitted) + np.arange(before[-1])])
            return made[0][part]

        for k, place in enumerate(places):
            yield place, flat, int(before[first[k]]), int(before[first[k + 1]])

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text, without added special tokens."""
        out = np.zeros(len(texts), np.int64)
        for place, _, begin, end in self._encoded(texts):
            out[place] += end - begin
        return out

    def encode(self, texts: list[str], last: int | None = None) -> list[np.ndarray]:
        """Ids of each text, ``last`` appended, two bytes each if the vocabulary allows, else four."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for place, flat, begin, end in self._encoded(texts):
            out[place].append(flat(slice(begin, end)))
        tail = [] if last is None else [np.array([last])]
        return [np.concatenate([np.zeros(0, self.id_type), *parts, *tail]).astype(self.id_type) for parts in out]


@functools.cache
def compiled(path: str) -> CompiledTokenizer:
    return CompiledTokenizer(path)
