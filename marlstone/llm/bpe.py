"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The frequent pre-tokens of the corpus are compiled, with the token ids of each as its output, into a
minimal acyclic subsequential transducer (construction from sorted input: Mihov and Maurel 2001). Equal
suffixes share states. The automaton is one flat file that every executor maps into memory. A batch's distinct
pre-tokens run through it together, a byte at a time; those that it lacks are merged by rank together, exactly as
the vocabulary says. Which words are in the lexicon therefore changes the speed alone, never an id. Nothing is
remembered from batch to batch, and a batch is bounded by its bytes.

Defined cases: a null text is an empty one; an empty text has no ids and decodes to an empty text; special
tokens that stand in a text become their own ids; repeated rows give repeated results; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import struct
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import common

# White space as Unicode defines it; letters and numbers that the encoder's Unicode (16) doesn't
# have yet; the pattern that splits a text before the merges.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATER_LETTERS = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    r"\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e"
    r"\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
LATER_NUMBERS = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
LETTER, NUMBER = rf"[\p{{L}}--[{LATER_LETTERS}]]", rf"[\p{{N}}--[{LATER_NUMBERS}]]"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{LETTER}+| ?{NUMBER}+| ?[^{WHITE}{LETTER}{NUMBER}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

#: Most words of the lexicon; it bounds what the driver holds and the file that executors map.
LEXICON_WORDS = 150_000
#: Bytes of a pre-token beyond which it is not in the lexicon, and is merged with a heap, on its own.
LONG_WORD = 64
#: Most distinct words that a task holds before it emits their counts.
TASK_WORDS = 500_000
#: Rows and bytes of a batch that is encoded at a time; a longer text is a batch of its own.
BATCH_ROWS = 1 << 14
BATCH_BYTES = 4 << 20
#: Stands for the rank of a pair that is not merged.
_NONE = np.int32(1 << 30)
_TABLE_BITS = 19


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large binary array, and where its values begin and end in them."""
    _, offsets, data = array.buffers()
    data = np.frombuffer(data, np.uint8) if data and data.size else np.empty(0, np.uint8)
    return data, np.frombuffer(offsets, np.int64, len(array) + 1, 8 * array.offset) if len(array) else np.zeros(1, np.int64)


def regrouped(array: pa.Array, counts: np.ndarray) -> pa.Array:
    """Each `counts` consecutive values of a large binary array joined to one."""
    _, offsets = raw(array)
    ends = offsets[np.concatenate(([0], np.cumsum(counts)))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), array.buffers()[2] or pa.py_buffer(b"")])


def as_binary(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each `counts` consecutive ids as a value: little-endian unsigned 32-bit integers."""
    ends = 4 * np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])


def by_place(first: pa.Array, second: pa.Array, in_first: np.ndarray) -> pa.Array:
    """The values of two arrays in one order: in_first says from which array the next one comes."""
    place = np.where(in_first, np.cumsum(in_first) - 1, len(first) + np.cumsum(~in_first) - 1)
    return pa.concat_arrays([first, second]).take(pa.array(place, pa.int64()))


class Vocabulary:
    """Ids, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        #: The bytes of each id; the last entry stands for unknown ids.
        self.tokens = pa.array([bytes_of.get(i, b"") for i in range(max(bytes_of) + 2)], pa.large_binary())
        self.byte_ids = np.array([ids[letters[b]] for b in range(256)], np.int32)
        pairs = [tuple(p) if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs] or [0], np.int64)
        #: By rank: what a pair becomes.
        self.joined = np.array([ids[a + b] for a, b in pairs] or [0], np.int32)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order] if pairs else np.array([-1])
        # A hash table of places in the sorted keys; a slot that several keys want is searched for instead.
        slots, count = np.unique(self._slot(self.keys), return_counts=True)
        self.table, self.crowded = np.zeros(1 << _TABLE_BITS, np.int32), np.zeros(1 << _TABLE_BITS, bool)
        self.table[self._slot(self.keys)] = np.arange(len(self.keys))
        self.crowded[slots[count > 1]] = True

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids."""
        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        at = self.table[slot]
        crowd = np.flatnonzero(self.crowded[slot])
        at[crowd] = np.minimum(np.searchsorted(self.keys, key[crowd]), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], _NONE)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token of any length: the pair of lowest rank is joined first, the leftmost of equals."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        n = len(ids)
        rank = np.append(self.ranks(ids[:-1], ids[1:]), _NONE) if n else ids
        # Ranks and places in one number; what has changed since it was put there is passed over.
        heap = [r << 40 | i for i, r in enumerate(rank.tolist()) if r < _NONE]
        heapq.heapify(heap)
        none, ids, rank, after, before = int(_NONE), ids.tolist(), rank.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        joined, find = self.singly()
        while heap:
            top = heapq.heappop(heap)
            i = top & (1 << 40) - 1
            if rank[i] != top >> 40:
                continue
            ids[i], gone = joined[rank[i]], after[i]
            rank[gone], nxt = none, after[gone]
            after[i] = nxt
            if nxt < n:
                before[nxt] = i
            for left, right in ((before[i], i), (i, nxt)):
                if left >= 0:
                    rank[left] = r = find(ids[left] << 32 | ids[right], none) if right < n else none
                    if r < none:
                        heapq.heappush(heap, r << 40 | left)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    @cache
    def singly(self) -> tuple[list[int], Callable]:
        """`joined` as a list, and the rank of a key, or else a default: for single pairs."""
        return self.joined.tolist(), dict(zip(self.keys.tolist(), self.order.tolist())).get

    def merge_all(self, words: pa.Array) -> pa.Array:
        """The ids of many pre-tokens: each step joins in every word the pair that `merge` would join next."""
        data, offsets = raw(words)
        long = np.diff(offsets) > LONG_WORD
        if long.any():
            apart = [np.array(self.merge(w), np.int64) for w in words.filter(pa.array(long)).to_pylist()]
            apart = as_binary(np.concatenate(apart), np.array([len(x) for x in apart]))
            return by_place(apart, self.merge_all(pa.concat_arrays([words.filter(pa.array(~long))])), long)
        ids = self.byte_ids[data[offsets[0] : offsets[-1]]]
        word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(offsets))
        rank = np.append(self.ranks(ids[:-1], ids[1:]), _NONE)[: len(ids)]
        rank[:-1][word[:-1] != word[1:]] = _NONE
        done_ids, done_word = [], []
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            stay = best < _NONE
            if not stay.all():
                done_ids.append(ids[~stay])
                done_word.append(word[~stay])
                ids, word, rank, best = ids[stay], word[stay], rank[stay], best[stay]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == best)
            hit = hit[np.concatenate(([True], word[hit[1:]] != word[hit[:-1]]))]
            ids[hit] = self.joined[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, word, rank = ids[keep], word[keep], rank[keep]
            at = hit - np.arange(len(hit))
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(ids) - 1)
                inside = (left < right) & (word[left] == word[right])
                rank[left] = np.where(inside, self.ranks(ids[left], ids[right]), _NONE)
        ids, word = np.concatenate([*done_ids, np.empty(0, np.int32)]), np.concatenate([*done_word, np.empty(0, np.int32)])
        return as_binary(ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words)))


def compile_lexicon(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """The words' transducer as a flat file: arcs of a state lie together, sorted by byte."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []

    def freeze(state: list) -> int:
        key = (state[1], state[2], tuple((label, *arc) for label, arc in state[0].items()))
        at = register.get(key)
        if at is None:
            at = register[key] = len(states)
            states.append(key)
        return at

    # A state under construction: arcs {byte: [target, output]}, whether it is final, the output of ending there.
    path, before = [[{}, False, ()]], b""
    for word in sorted(words):
        out, same = tuple(words[word]), len(os.path.commonprefix((before, word)))
        while len(path) > same + 1:
            state = path.pop()
            path[-1][0][before[len(path) - 1]][0] = freeze(state)
        for i in range(same):
            arc, state = path[i][0][word[i]], path[i + 1]
            common_out = os.path.commonprefix((arc[1], out))
            if rest := arc[1][len(common_out) :]:
                arc[1] = common_out
                for later in state[0].values():
                    later[1] = rest + later[1]
                if state[1]:
                    state[2] = rest + state[2]
            out = out[len(common_out) :]
        for i in range(same, len(word)):
            path[i][0][word[i]] = [None, out]
            out = ()
            path.append([{}, False, ()])
        path[-1][1:], before = [True, out], word
    while len(path) > 1:
        state = path.pop()
        path[-1][0][before[len(path) - 1]][0] = freeze(state)
    root = freeze(path[0])

    pool: dict[tuple, int] = {(): 0}
    outputs: list[int] = [0]

    def pooled(out: tuple) -> int:
        if out not in pool:
            pool[out] = len(outputs)
            outputs.extend((len(out), *out))
        return pool[out]

    ends, keys, targets, arc_outs = [], [], [], []
    for at, (final, final_out, arcs) in enumerate(states):
        ends.append(pooled(final_out) + 1 if final else 0)
        for label, target, out in sorted(arcs):
            keys.append(at << 8 | label)
            targets.append(target)
            arc_outs.append(pooled(out))
    head = struct.pack("<4I", len(states), root, len(keys), len(outputs))
    return head + np.array([*keys, *targets, *arc_outs, *ends, *outputs], "<u4").tobytes()


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        states, self.root, arcs, outs = struct.unpack_from("<4I", self.map)
        cuts = np.cumsum([arcs, arcs, arcs, states])
        #: Of each arc: state << 8 | byte, in order; its target; its output's place in `outputs`, as of each state's end.
        self.keys, self.targets, self.arc_outs, self.ends, self.outputs = np.split(np.frombuffer(self.map, "<u4", offset=16), cuts)

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Which words it has, and the outputs of those."""
        data, offsets = raw(words)
        start, length = offsets[:-1], np.diff(offsets)
        state, found = np.full(len(words), self.root, np.int64), np.zeros(len(words), bool)
        alive, step = np.flatnonzero(length <= LONG_WORD), 0
        of, outs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(alive):
            ended = length[alive] == step
            final = alive[ended]
            end = self.ends[state[final]].astype(np.int64)
            found[final] = end > 0
            of.append(final[end > 1])
            outs.append(end[end > 1] - 1)
            alive = alive[~ended]
            if not len(alive) or not len(self.keys):
                break
            key = (state[alive] << 8 | data[start[alive] + step]).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            alive, at = alive[there], at[there]
            state[alive] = self.targets[at]
            out = self.arc_outs[at].astype(np.int64)
            of.append(alive[out > 0])
            outs.append(out[out > 0])
            step += 1
        of, outs = np.concatenate(of), np.concatenate(outs)
        outs, of = outs[found[of]], of[found[of]]
        order = np.argsort(of, kind="stable")
        of, outs = of[order], outs[order]
        # An output in the pool is its length and its ids.
        n = self.outputs[outs].astype(np.int64)
        at = np.repeat(outs + 1 - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
        counts = np.bincount(of, n, minlength=len(words)).astype(np.int64)
        return found, as_binary(self.outputs[at], counts[found])


_SPLIT = regex.compile(PRE_TOKEN, flags=regex.V1)
_CUT = regex.compile(rf"(?<=[^{WHITE}])(?=[ \n][^{WHITE}])", flags=regex.V1)
#: Begins a piece that stands in the text without a blank before it; texts with this character are one piece.
_BARE = "\x01"
# Patterns of Arrow's: texts that are cut with care; stops that don't follow a letter; pieces that are one pre-token.
_WITH_CARE = rf"\x01|[{WHITE}]{{2}}".replace(r"\u2000-\u200a", r"\x{2000}-\x{200a}")
for _code in ("1680", "2028", "2029", "202f", "205f", "3000"):
    _WITH_CARE = _WITH_CARE.replace(rf"\u{_code}", rf"\x{{{_code}}}")
_STOP_ALONE = "(?:^|[^0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])[.,]"
_ONE_WORD = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"


def with_care(text: str) -> list[str]:
    """The pieces of a text that has white space in a row or the mark of pieces."""
    if _BARE in text:
        return [_BARE + text]
    first, *rest = _CUT.split(text)
    return [_BARE + first, *(x[1:] if x[0] == " " else x for x in rest)]


def after(prefix: str, texts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(prefix, texts.type), texts, pa.scalar("", texts.type))


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts (large strings without nulls) cut where a pre-token surely ends, and each one's number of pieces.

    That is before a lone blank or line break between other characters, and before a full stop or comma that
    follows a letter or number. A piece that begins with _BARE or a line break stands in the text so (without
    _BARE); each other has a blank before it.
    """
    careful = pc.match_substring_regex(texts, _WITH_CARE)
    plain = texts.filter(pc.invert(careful))
    stops = pc.replace_substring(pc.replace_substring(plain, ".", " \x01."), ",", " \x01,")
    plain = pc.if_else(pc.match_substring_regex(plain, _STOP_ALONE), plain, stops)
    plain = after(_BARE, pc.replace_substring(plain, "\n", " \n"))
    cut = pc.split_pattern(plain, " ")
    values, counts = cut.flatten(), pc.list_value_length(cut).to_numpy(zero_copy_only=False)
    if len(plain) == len(texts):
        return values, counts
    # Rare: put in their places among the others.
    apart = [with_care(t) for t in texts.filter(careful).to_pylist()]
    careful = np.array(careful)
    lengths = np.empty(len(texts), np.int64)
    lengths[careful], lengths[~careful] = [len(x) for x in apart], counts
    both = pa.array([p for x in apart for p in x], pa.large_string())
    return by_place(both, values, np.repeat(careful, lengths)), lengths


def in_text(piece: str) -> str:
    """The characters of the text that a piece stands for."""
    return piece[1:] if piece[:1] == _BARE else piece if piece[:1] == "\n" else " " + piece


class Encoder:
    """Texts to ids, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        special = sorted(map(regex.escape, vocabulary.special), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(special) + ")") if special else None

    def of_tokens(self, tokens: pa.Array) -> pa.Array:
        """The ids of each pre-token: from the lexicon, or merged."""
        coded = tokens.dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary())
        if self.lexicon is None:
            return self.vocabulary.merge_all(words).take(coded.indices)
        found, known = self.lexicon.lookup(words)
        merged = self.vocabulary.merge_all(pa.concat_arrays([words.filter(pa.array(~found))]))
        return by_place(known, merged, found).take(coded.indices)

    def of_pieces(self, distinct: pa.Array) -> pa.Array:
        """The ids of each piece."""
        whole = pc.match_substring_regex(distinct, _ONE_WORD)
        single = after(" ", distinct.filter(whole))
        split = [_SPLIT.findall(in_text(p)) for p in distinct.filter(pc.invert(whole)).to_pylist()]
        whole = np.array(whole, bool)
        counts = np.ones(len(distinct), np.int64)
        counts[~whole] = [len(x) for x in split]
        tokens = by_place(single, pa.array([t for x in split for t in x], pa.large_string()), np.repeat(whole, counts))
        return regrouped(self.of_tokens(tokens), counts)

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text (strings; null: empty)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = np.zeros(len(texts), bool)
        for token in self.vocabulary.special:
            marked |= np.array(pc.match_substring(texts, token), bool)
        if not marked.any():
            return self.plain(texts)
        apart = [self.special.split(t) for t in texts.filter(pa.array(marked)).to_pylist()]
        between = self.plain(pa.array([p for x in apart for p in x[::2]], pa.large_string())).to_pylist()
        special = [struct.pack("<I", self.vocabulary.special[p]) for x in apart for p in x[1::2]]
        parts, between, special = [], iter(between), iter(special)
        for x in apart:
            parts.append(b"".join(next(special) if i % 2 else next(between) for i in range(len(x))))
        return by_place(pa.array(parts, pa.large_binary()), self.plain(texts.filter(pa.array(~marked))), marked)

    def plain(self, texts: pa.Array) -> pa.Array:
        values, counts = pieces(texts)
        coded = values.dictionary_encode()
        return regrouped(self.of_pieces(coded.dictionary).take(coded.indices), counts)


def decoded(tokens: pa.Array, ids: pa.Array) -> pa.Array:
    """The bytes that each value of ids stands for; unknown ids stand for none."""
    data, offsets = raw(ids)
    numbers = data[offsets[0] : offsets[-1]].view("<u4")
    return regrouped(tokens.take(pa.array(np.minimum(numbers, len(tokens) - 1))), np.diff(offsets) // 4)


def as_utf8(data: bytes) -> bytes:
    """The text of these bytes, wrong ones replaced."""
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace").encode()


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """word (a piece of text, see `pieces`, of at most LONG_WORD bytes), n (long): how often each stands in the texts, all of them counted."""

    def partial(batches):
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            whole = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            held[:] = [whole]
            return whole

        for batch in common.slices(batches, BATCH_ROWS, BATCH_BYTES):
            values, _ = pieces(pc.fill_null(batch.column(0).cast(pa.large_string()), ""))
            words, n = values.filter(pc.less_equal(pc.binary_length(values), LONG_WORD)).value_counts().flatten()
            held.append(pa.table({"word": words, "n": n}))
            if sum(map(len, held)) > 2 * TASK_WORDS and len(whole := summed()) > TASK_WORDS:
                held.clear()
                yield from whole.cast(kinds).to_batches(TASK_WORDS // 8)
        if held:
            yield from summed().cast(kinds).to_batches(TASK_WORDS // 8)

    kinds = pa.schema([("word", pa.string()), ("n", pa.int64())])
    return df.select(F.col(text_col).cast("string")).mapInArrow(partial, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(df: DataFrame, text_col: str = "text", most: int = LEXICON_WORDS) -> list[str]:
    """The words that occur at least so often that no more than `most` do; at least twice."""
    counts = common.written(word_counts(df, text_col).filter("n > 1"), "word-counts")
    # Counts in steps of a sixteenth of their power of two: a bounded histogram.
    step = F.expr("floor(16 * log2(n))")
    total, least = 0, None
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r[0]):
        total += row[1]
        if total > most:
            break
        least = row[0]
    return [] if least is None else [r[0] for r in counts.filter(step >= least).select("word").collect()]


def build_lexicon(spark: SparkSession, vocabulary: Vocabulary, words: list[str]) -> str:
    """Compile the words' pre-tokens and hand the file to all executors; the name of the file."""
    tokens = sorted({token.encode() for word in words for token in _SPLIT.findall(in_text(word))})
    ids = vocabulary.merge_all(pa.array(tokens, pa.large_binary())).to_pylist()
    compiled = compile_lexicon({t: tuple(memoryview(i).cast("I")) for t, i in zip(tokens, ids) if len(t) <= LONG_WORD})
    return common.shared_file(spark, "lexicon.fst", compiled)


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(lexicon: str, shared) -> Encoder:
    """The Python worker's encoder for a lexicon; its tasks share it."""
    if lexicon not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[lexicon] = Encoder(shared.value, Lexicon(SparkFiles.get(lexicon)))
    return _ENCODERS[lexicon]


def _prepared(df: DataFrame, vocabulary_path: str, text_col: str, most_words: int):
    spark, vocabulary = df.sparkSession, Vocabulary(vocabulary_path)
    return build_lexicon(spark, vocabulary, frequent_words(df, text_col, most_words)), spark.sparkContext.broadcast(vocabulary)


def encode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", most_words: int = LEXICON_WORDS) -> DataFrame:
    """id_col, ids (binary: unsigned 32-bit integers, little-endian) of every row."""
    lexicon, shared = _prepared(df, vocabulary_path, text_col, most_words)

    def run(batches):
        for batch in common.slices(batches, BATCH_ROWS, BATCH_BYTES):
            ids = worker_encoder(lexicon, shared).encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids.cast(pa.binary())], names=["id", "ids"])

    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, f"id {plain.schema['id'].dataType.simpleString()}, ids binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_tokens (long), ids, text: the ids' bytes as UTF-8, wrong bytes replaced; unknown ids are skipped."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path).tokens)

    def run(batches):
        for batch in common.slices(batches, BATCH_ROWS, BATCH_BYTES):
            ids = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            texts = pa.array([x.decode("utf-8", "replace") for x in decoded(shared.value, ids).to_pylist()], pa.string())
            counts = pa.array(np.diff(raw(ids)[1]) // 4, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, batch.column(1), texts], names=["id", "n_tokens", "ids", "text"])

    plain = df.select(F.col(id_col).alias("id"), "ids")
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, n_tokens long, ids binary, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, vocabulary_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, from one pass; with keep_ids, also ids."""
    lexicon, shared = _prepared(docs, vocabulary_path or default_vocabulary(), "text", LEXICON_WORDS)

    def sha256(values: list[bytes]) -> pa.Array:
        return pa.array([hashlib.sha256(x).hexdigest() for x in values], pa.string())

    def run(batches):
        for batch in common.slices(batches, BATCH_ROWS, BATCH_BYTES):
            encoder = worker_encoder(lexicon, shared)
            ids = encoder.encode(batch.column(1))
            texts = decoded(encoder.vocabulary.tokens, ids)
            columns = [batch.column(0), pa.array(np.diff(raw(ids)[1]) // 4, pa.int64()), sha256(ids.to_pylist()), sha256(map(as_utf8, texts.to_pylist()))]
            yield pa.RecordBatch.from_arrays([*columns, *([ids.cast(pa.binary())] if keep_ids else [])], names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)


def op2_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every text of documents, as digests."""
    return round_trip(common.table(spark, sf_dir, "documents"))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
