"""Byte-level BPE by a lazily determinised transducer, and its streaming decoder.

The merges of a rank file become a transducer over bytes. After each byte it knows the last
token of the encoding of every prefix that a later token can still start behind; a start stays
open only while the bytes from it on are the beginning of some vocabulary entry, which bounds the
lookahead by the longest entry. Last tokens link prefixes into chains, and the tokens that all
open chains share are emitted. A token may stand behind another exactly if the two are the
encoding of their joined bytes. A state is what later steps can depend on: the bytes not yet
emitted, the last tokens of the open prefixes, and the token before them. States and steps are
made when first met; past a bound the tables are dropped and grow anew. New words of a run of texts
go through the transducer together, byte by byte in numpy, and leave no states, as most are met
once; of the words kept, those met in the fewest runs go first.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm.text import pieces

#: Bounds of what one worker keeps: states of a transducer, pairs of tokens, words with output.
MAX_STATES = 200_000
MAX_PAIRS = 400_000
MAX_WORDS = 500_000
#: Characters of a word that is kept.
LONGEST = 64
#: Bytes of text of which the distinct words are looked up together.
RUN_BYTES = 1 << 21
#: Ids whose bytes and digits are put together at once.
BLOCK_IDS = 1 << 14
#: Places of what is not kept among the words.
NOT_A_WORD, LONG = -1, -2

#: The characters with Unicode's White_Space property.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


#: Cut out between single spaces and line feeds, these are not one word: white space is not single.
NOT_ONE_WORD = re.compile(r"\A\n?\Z|\A[^\S\n]|(?<=.)\s", re.DOTALL)


def split_words(text: str) -> list[str]:
    """The text cut before each space and line feed, each word without that space (the first one
    stands as if it had one). Where white space is single, no match of a pattern that takes it by
    itself or as one leading space runs over such a cut."""
    return text.replace("\n", " \n").split(" ")


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all entries of some runs, one run after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes)).astype(np.int64)


class State:
    """What later steps depend on: the chains of last tokens, and where a later token may start.

    ``size`` bytes are not emitted yet. ``chains`` has for each position that an open chain runs
    through beginning and id of the last token of the prefix up to it; ``open`` has, flat, the positions
    that a later token may start at, each with the token before it and the place in the vocabulary's trie
    that the bytes since lead to. ``steps``: by byte, the next state and the tokens certain by then.
    """

    __slots__ = ("size", "chains", "open", "steps", "end")

    def __init__(self, size: int, chains: dict[int, tuple[int, int]], opens: tuple[int, ...]):
        self.size, self.chains, self.open = size, chains, opens
        self.steps: dict[int, State | tuple[State, tuple[int, ...]]] | None = None
        self.end: tuple[int, ...] | None = None


#: Stands for the token before a piece's first.
NOTHING = -1
#: Stands for the token of a place in the trie where none ends.
NO_TOKEN = -1


class Transducer:
    """Bytes in, token ids out: the ids of greedy lowest-rank merging."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.trie: dict[int, int] = {}
        self.at_node = [NO_TOKEN]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                child = self.trie.get(node << 8 | byte)
                if child is None:
                    child = self.trie[node << 8 | byte] = len(self.at_node)
                    self.at_node.append(NO_TOKEN)
                node = child
            self.at_node[node] = rank
        self.inner = bytearray(len(self.at_node))
        for key in self.trie:
            self.inner[key >> 8] = 1
        keys = np.array(list(self.trie), np.int64)
        order = np.argsort(keys)
        self.trie_keys, self.trie_nodes = keys[order], np.array(list(self.trie.values()), np.int64)[order]
        self.tokens_at, self.goes_on = np.array(self.at_node), np.frombuffer(self.inner, np.uint8) > 0
        self.known_pairs, self.known_allowed = np.array([-1 << 40], np.int64), np.zeros(1, bool)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.start = State(0, {}, (0, NOTHING, 0))
        self.states: dict[tuple[int, ...], State] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of ``token`` joins; None for a single byte."""
        if token not in self.halves:
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                _, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether ``left right`` is the encoding of its own bytes.

        Merges at the border are undone from the last to the first; the two stay apart if never a
        merge over the border would have come before the one just undone.
        """
        if left == NOTHING:
            return True
        bound = 1 << 60
        while self.ranks.get(self.tokens[left] + self.tokens[right], bound) >= bound:
            if left > right:
                bound, halves = left, self.split(left)
                if halves is None:
                    return True
                left = halves[1]
            else:
                bound, halves = right + 1, self.split(right)
                if halves is None:
                    return True
                right = halves[0]
        return False

    def step(self, state: State, byte: int) -> State | tuple[State, tuple[int, ...]]:
        """Make the step of ``byte``: the next state, with the tokens certain by then if there are any."""
        n, trie, at_node, inner, pairs = state.size + 1, self.trie, self.at_node, self.inner, self.pairs
        opens, ends, chains = [], [], state.chains
        found = False
        flat = iter(state.open)
        for p, token, node in zip(flat, flat, flat):  # noqa: B905
            node = trie.get(node << 8 | byte)
            if node is None:
                continue
            if not found and (new := at_node[node]) != NO_TOKEN:
                pair = token << 32 | new
                allowed = pairs.get(pair)
                if allowed is None:
                    if len(pairs) >= MAX_PAIRS:
                        pairs.clear()
                    allowed = pairs[pair] = self.may_follow(token, new)
                if allowed:
                    found, chains = True, {**chains, n: (p, new)}
            if inner[node]:
                opens += (p, token, node)
                ends.append(p)
        if found:
            opens += (n, chains[n][1], 0)
            ends.append(n)
        if not ends:
            raise ValueError(f"byte {byte} is in no token")
        # what all open chains run through is certain; the chains' parts behind it are kept
        cut, kept = ends[-1], {}
        for p in ends:
            while p != cut:
                if p > cut:
                    p = chains[p][0]
                else:
                    cut = chains[cut][0]
        for p in ends:
            while p > cut and p not in kept:
                kept[p] = link = chains[p]
                p = link[0]
        out, p = [], cut
        while p > 0:
            p, token = chains[p]
            out.append(token)
        if cut:
            kept = {p - cut: (before - cut, token) for p, (before, token) in kept.items()}
            opens[::3] = [p - cut for p in opens[::3]]
        opens = tuple(opens)
        key = (n - cut, len(opens), *opens, *[x for p in sorted(kept) for x in (p, *kept[p])])
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = State(n - cut, kept, opens)
        if state.steps is None:
            state.steps = {}
        made = state.steps[byte] = (target, tuple(reversed(out))) if out else target
        return made

    def encode(self, data: bytes) -> list[int]:
        if len(self.states) >= MAX_STATES:
            self.reset()
        ids: list[int] = []
        state = self.start
        for byte in data:
            steps = state.steps
            state = (steps.get(byte) if steps else None) or self.step(state, byte)
            if state.__class__ is tuple:
                state, out = state
                ids += out
        if state.end is None:
            p, tail = state.size, []
            while p > 0:
                p, token = state.chains[p]
                tail.append(token)
            state.end = tuple(reversed(tail))
        ids += state.end
        return ids


    def _allowed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``may_follow`` of many pairs."""
        pairs = left << 32 | right
        at = np.minimum(np.searchsorted(self.known_pairs, pairs), len(self.known_pairs) - 1)
        fresh = np.unique(pairs[self.known_pairs[at] != pairs])
        if len(fresh):
            if len(self.known_pairs) >= MAX_PAIRS:
                self.known_pairs, self.known_allowed = np.array([-1 << 40], np.int64), np.zeros(1, bool)
                fresh = np.unique(pairs)
            found = np.array([self.may_follow(pair >> 32, pair & 0xFFFFFFFF) for pair in fresh.tolist()])
            at = np.searchsorted(self.known_pairs, fresh)
            self.known_pairs, self.known_allowed = np.insert(self.known_pairs, at, fresh), np.insert(self.known_allowed, at, found)
            at = np.searchsorted(self.known_pairs, pairs)
        return self.known_allowed[at]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short words one after another, and where each word's begin and the last one's end.

        The transducer goes over all words together, byte by byte, and holds what a state holds: the
        last token of each prefix, and where a later token may start. No states are kept, as words
        that are met once would leave states that are met once.
        """
        sizes = np.array([len(word) for word in words], np.int64)
        data, at = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), _bounds(sizes)[:-1]
        longest = int(sizes.max(initial=0))
        last, begins = np.full((longest + 1, len(words)), NOTHING, np.int64), np.zeros((longest + 1, len(words)), np.int64)
        of = np.flatnonzero(sizes > 0)
        start, node = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        for n in range(1, longest + 1):  # open places are in the order of their starts
            going = sizes[of] >= n
            of, start, node = of[going], start[going], node[going]
            keys = node << 8 | data[at[of] + n - 1]
            place = np.minimum(np.searchsorted(self.trie_keys, keys), len(self.trie_keys) - 1)
            in_trie = self.trie_keys[place] == keys
            of, start, node = of[in_trie], start[in_trie], self.trie_nodes[place[in_trie]]
            ends = np.flatnonzero(self.tokens_at[node] != NO_TOKEN)
            token = self.tokens_at[node[ends]]
            ends, token = (x[self._allowed(last[start[ends], of[ends]], token)] for x in (ends, token))
            last[n, of[ends]], begins[n, of[ends]] = token, start[ends]  # at most one is allowed
            on = self.goes_on[node]
            begun = of[ends]
            of, start, node = (np.concatenate(x) for x in ((of[on], begun), (start[on], np.full(len(begun), n)), (node[on], np.zeros(len(begun), np.int64))))
        ids, owners, own, n = [], [], np.flatnonzero(sizes > 0), sizes[sizes > 0]
        while len(own):  # from the last tokens back to the first
            ids.append(last[n, own])
            owners.append(own)
            n = begins[n, own]
            own, n = own[n > 0], n[n > 0]
        if not ids:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        ids, owners = np.concatenate(ids[::-1]), np.concatenate(owners[::-1])
        if (ids == NOTHING).any():
            raise ValueError("a byte is in no token")
        return ids[np.argsort(owners, kind="stable")], _bounds(np.bincount(owners, minlength=len(words)))


class Utf8:
    """Bytes in, characters out: an incremental state machine over UTF-8.

    Ill-formed parts become U+FFFD, one for each maximal beginning of a well-formed sequence.
    """

    #: First bytes, how many follow, and the range of the second byte.
    LEADS = (
        (0xC2, 0xDF, 1, 0x80, 0xBF),
        (0xE0, 0xE0, 2, 0xA0, 0xBF),
        (0xE1, 0xEC, 2, 0x80, 0xBF),
        (0xED, 0xED, 2, 0x80, 0x9F),
        (0xEE, 0xEF, 2, 0x80, 0xBF),
        (0xF0, 0xF0, 3, 0x90, 0xBF),
        (0xF1, 0xF3, 3, 0x80, 0xBF),
        (0xF4, 0xF4, 3, 0x80, 0x8F),
    )
    BY_LEAD = {b: (more, low, high) for first, last, more, low, high in LEADS for b in range(first, last + 1)}
    #: a state: bytes to come, range of the next one, bits so far
    START = (0, 0, 0, 0)

    @classmethod
    def run(cls, state: tuple[int, int, int, int], data: bytes) -> tuple[tuple[int, int, int, int], str]:
        more, low, high, bits = state
        out = []
        for b in data:
            if more:
                if low <= b <= high:
                    more, low, high, bits = more - 1, 0x80, 0xBF, bits << 6 | b & 0x3F
                    if not more:
                        out.append(chr(bits))
                    continue
                out.append("�")
                more = 0
            if b < 0x80:
                out.append(chr(b))
            elif b in cls.BY_LEAD:
                more, low, high = cls.BY_LEAD[b]
                bits = b & (0x3F >> more)
            else:
                out.append("�")
        return ((more, low, high, bits) if more else cls.START), "".join(out)

    @classmethod
    def end(cls, state: tuple[int, int, int, int]) -> str:
        return "�" if state[0] else ""


class Words:
    """Words met so far and their ids, all ids in one array, and in how many runs of texts each was met."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.at, self.ids = array("q", [0]), array("i")
        self.met = np.zeros(0, np.int64)

    def add(self, word: str, ids: Iterable[int]) -> int:
        place = self.places[word] = len(self.at) - 1
        self.ids.extend(ids)
        self.at.append(len(self.ids))
        return place

    def add_all(self, words: Iterable[str], ids: np.ndarray, at: np.ndarray) -> None:
        self.places.update(zip(words, range(len(self.places), len(self.places) + len(at) - 1), strict=True))
        self.at.frombytes((at[1:] + len(self.ids)).astype(np.int64).tobytes())
        self.ids.frombytes(ids.astype(np.int32).tobytes())

    def of(self, place: int) -> array:
        return self.ids[self.at[place] : self.at[place + 1]]

    def meet(self, places: np.ndarray) -> None:
        self.met = np.append(self.met, np.zeros(len(self.places) - len(self.met), np.int64))
        self.met[places] += 1

    def most_met(self, n: int) -> Words:
        """At most ``n`` of the words, those met most; none of those met once only."""
        kept = np.sort(np.argsort(-self.met, kind="stable")[:n])
        kept = kept[self.met[kept] > 1]
        words, at, chosen = Words(), np.array(self.at), np.zeros(len(self.places), bool)
        chosen[kept] = True
        sizes = np.diff(at)[kept]
        words.places = {word: i for i, word in enumerate(compress(self.places, chosen.tolist()))}
        words.at = array("q", _bounds(sizes).tobytes())
        words.ids = array("i", np.array(self.ids, np.int32)[_spread(at[kept], sizes)].tobytes())
        words.met = self.met[kept] // 2  # what was met long ago counts less
        return words


class Codec:
    """Encoder and decoder of one rank file; keeps bounded tables."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        inside = re.sub(r"\[([^\]]*?)\\s", lambda m: f"[{m[1]}{WHITE_SPACE}", pattern)
        inside = inside.replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")
        self.find = regex.compile(inside).findall
        #: the pattern takes letters with one leading space, other marks by themselves
        self.words_apart = self.find(" ab, c\nd 1") == [" ab", ",", " c", "\n", "d", " 1"]
        self.marks = set(".,;:!?")
        self.words = Words()
        self.steps: dict[tuple, dict] = {}
        tokens = self.transducer.tokens
        every = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        shown = np.array([f"{i} " for i in range(len(every))], "S")
        self.digits = shown.view(np.uint8).reshape(len(every), shown.dtype.itemsize)
        self.digit_counts = (self.digits != 0).sum(1)
        self.token_sizes = np.array([len(t) for t in every])
        self.token_at, self.token_bytes = _bounds(self.token_sizes), np.frombuffer(b"".join(every), np.uint8)
        #: whole characters: the decoder's step from its start ends there too, and gives the token's bytes
        self.whole = np.array([(step := Utf8.run(Utf8.START, t))[0] == Utf8.START and step[1].encode() == t for t in every])

    def encode(self, text: str) -> list[int]:
        return self.encode_texts(pa.array([text], pa.string()))[0].tolist()

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where those of each begin and the last one's end.

        Each distinct word of the texts is looked up once, and new ones go through the transducer
        together. The first word of a text, which has no space before it, long words and texts that
        can't be cut into words go through it one at a time.
        """
        if len(self.words.places) >= MAX_WORDS:
            self.words = self.words.most_met(3 * MAX_WORDS // 4)
        texts = pc.fill_null(texts, "")
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded, at = cut.flatten().dictionary_encode(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
        codes, first = coded.indices.to_numpy(), at[:-1]
        later = np.full(len(codes), self.words_apart)
        later[first] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[codes[later]] = True
        used, extra = np.flatnonzero(used), array("i")
        distinct = coded.dictionary.take(pa.array(used)).to_numpy(zero_copy_only=False).tolist()
        self._learn([word for word in distinct if word not in self.words.places])
        known = list(map(self.words.places.get, distinct))
        places = np.fromiter((self._place(word, extra) if place is None else place for word, place in zip(distinct, known, strict=True)), np.int64, len(known))
        known_at, known = np.array(self.words.at), np.array(self.words.ids, np.int32)
        start, size = np.zeros(len(coded.dictionary), np.int64), np.full(len(coded.dictionary), -1, np.int64)
        kept = places >= 0
        self.words.meet(places[kept])
        start[used[kept]], size[used[kept]] = known_at[places[kept]], np.diff(known_at)[places[kept]]
        for i in np.flatnonzero(places <= LONG).tolist():
            at_extra = LONG - int(places[i])  # of the number of ids, which stand behind it
            start[used[i]], size[used[i]] = len(known) + at_extra + 1, extra[at_extra]
        starts, sizes = start[codes], size[codes]
        whole = np.zeros(len(first), bool)
        whole[np.searchsorted(first, np.flatnonzero(later & (sizes < 0)), "right") - 1] = True
        for i, word in enumerate(pc.list_element(cut, 0).to_pylist()):
            if whole[i] or not self.words_apart or NOT_ONE_WORD.search(word):
                sizes[at[i] : at[i + 1]] = 0
                word = texts[i].as_py()
            starts[at[i]] = len(known) + len(extra)
            extra.extend(self.pieces(word))
            sizes[at[i]] = len(known) + len(extra) - starts[at[i]]
        ids = np.concatenate([known, np.array(extra, np.int32)])[_spread(starts, sizes)]
        return ids, _bounds(sizes)[at]

    def pieces(self, text: str) -> tuple[int, ...]:
        """Ids of a text, each match of the pattern by itself."""
        return tuple(chain.from_iterable(self.transducer.encode(piece.encode()) for piece in self.find(text)))

    def _learn(self, words: list[str]) -> None:
        """Keep the ids of new words, of which all pieces that are not known go through the transducer together."""
        stems: dict[str, None] = {}
        rest: dict[str, int] = {}
        others = []
        for word in words:
            if len(word) > LONGEST or NOT_ONE_WORD.search(word):
                continue
            if word.isalpha():
                stems[word] = None
                continue
            stem, last = word[:-1], word[-1]
            cut = (" " + stem, last) if last in self.marks and stem.isalpha() else self.find(word if word[0] == "\n" else " " + word)
            others.append((word, cut))
            for piece in cut:
                if piece[0] != " ":
                    rest.setdefault(piece, len(rest))
                elif piece[1:] not in self.words.places:
                    stems[piece[1:]] = None
        ids, at = self.transducer.encode_words([piece.encode() for piece in chain((" " + stem for stem in stems), rest)])
        n = len(stems)
        self.words.add_all(stems, ids[: at[n]], at[: n + 1])
        ids, at = array("i", ids[at[n] :].astype(np.int32).tobytes()), (at[n:] - at[n]).tolist()
        for word, cut in others:
            if word in self.words.places:
                continue
            found = array("i")
            for piece in cut:
                if piece[0] == " ":
                    found += self.words.of(self.words.places[piece[1:]])
                else:
                    place = rest[piece]
                    found += ids[at[place] : at[place + 1]]
            self.words.add(word, found)

    def _place(self, word: str, extra: array) -> int:
        """Of a word that is not kept: if long, LONG less the place of its ids in ``extra``; else NOT_A_WORD."""
        if NOT_ONE_WORD.search(word):
            return NOT_A_WORD
        ids = self.pieces(word if word[0] == "\n" else " " + word)
        extra.append(len(ids))
        extra.extend(ids)
        return LONG - (len(extra) - len(ids) - 1)

    def decimal(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids in decimal with a space behind each, and where those of each id begin and the last one's end."""
        blocks = [self.digits[ids[i : i + BLOCK_IDS]] for i in range(0, len(ids), BLOCK_IDS)]
        return b"".join([b[b != 0].tobytes() for b in blocks]), _bounds(self.digit_counts[ids])

    def decode(self, ids, state: tuple[int, int, int, int] = Utf8.START) -> tuple[str, tuple[int, int, int, int]]:
        """Characters completed by ``ids`` after ``state``, and the state after them."""
        tokens, out = self.transducer.tokens, []
        known = self.steps.setdefault(state, {})
        for i in ids:
            step = known.get(i)
            if step is None:
                after, text = Utf8.run(state, tokens[i])
                step = known[i] = (text, after, self.steps.setdefault(after, {}))
            text, state, known = step
            out.append(text)
        if len(self.steps) > 10_000:
            self.steps = {}
        return "".join(out), state

    def decode_texts(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 of the text that the ids of each range decode to.

        A token of whole characters takes the decoder from its start back to it, so ranges of only
        such tokens are their bytes; all other ranges go through the decoder from id to id.
        """
        starts, sizes = self.token_at[ids], self.token_sizes[ids]
        blocks = [slice(i, i + BLOCK_IDS) for i in range(0, len(ids), BLOCK_IDS)]
        data = b"".join([self.token_bytes[_spread(starts[b], sizes[b])].tobytes() for b in blocks])
        at, cut = _bounds(sizes)[bounds].tolist(), _bounds(~self.whole[ids])[bounds]
        texts = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            text, state = self.decode(ids[bounds[i] : bounds[i + 1]].tolist())
            texts[i] = (text + Utf8.end(state)).encode()
        return texts


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (token ids of the whole text).

    Null and empty texts have no ids; a text without spaces is one run of the transducer and
    needs memory in proportion to its length. Each match of ``pattern`` is encoded by itself.
    Repeated rows are encoded alike; null identifiers pass through; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for piece in pieces(batch, "text", RUN_BYTES):
                ids, bounds = own.encode_texts(piece.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), lists], ["doc_id", "ids"])

    return rows.mapInArrow(encode, f"doc_id {id_type}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the decoded text; ids are fed in blocks, a cut character waits for its rest."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                text, state = own.decode(ids or [])
                texts.append(text + Utf8.end(state))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {id_type}, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for piece in pieces(batch, "text", RUN_BYTES):
                ids, bounds = own.encode_texts(piece.column("text"))
                shown, at = own.decimal(ids)
                at, counts = at[bounds].tolist(), np.diff(bounds)
                of_ids = [digest(shown[a : max(a, b - 1)]) for a, b in zip(at[:-1], at[1:], strict=True)]
                of_texts = [digest(data) for data in own.decode_texts(ids, bounds)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return rows.mapInArrow(trip, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
