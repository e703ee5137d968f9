"""SentencePiece encoding and decoding (merge type) by backtracking over longest matches.

A merge-type encoding is the only sequence of pieces in which every two neighbours are compatible: merging the two
pieces' characters anew gives the two pieces back. An automaton (Aho and Corasick) finds the longest piece from each
position; the encoder takes it, or the next shorter piece that is its prefix, if it is compatible with the piece
before it. A position from which nothing goes on is marked as failed in a bitfield and never tried again, since the
pieces that lead to a position are the same whenever it is reached. So the work is linear in the text.

Texts are cut at blanks first, where no piece of the vocabulary reaches across; a batch's distinct words are encoded
once, and each worker remembers a bounded number of short ones, which changes the speed alone.

Defined cases: a null text is an empty one; an empty text has no pieces (with begin and end: those two); characters
that no piece has become their bytes; names of special pieces that stand in a text are plain text; repeated rows give
repeated results; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from marlstone.llm import common
from marlstone.llm.bpe import BATCH_BYTES, BATCH_ROWS, after, by_place, decoded, raw, regrouped

# The letter that stands for a blank, and what an unknown piece is decoded to.
BLANK, UNKNOWN = "▁", " ⁇ "

#: Words that a worker remembers, and the most bytes of one.
MEMO_WORDS = 200_000
MEMO_BYTES = 64
#: Pairs of pieces whose compatibility a worker remembers.
MEMO_PAIRS = 500_000

# Stops that don't follow a letter or number, as Arrow's and Python's pattern.
STOP_ALONE = "(?:^|[^0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])[.,]"
STOP_ALONE_RE = re.compile("[^0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff][.,]")
_WORD = re.compile(" +[^ ]*|[^ ]+")


class Pieces:
    """The vocabulary of a merge-type SentencePiece model: pieces, the order of merges, and bytes."""

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        if model.normalize(" ﬁ  x ") != f"{BLANK}{BLANK}ﬁ{BLANK}{BLANK}x{BLANK}":
            raise ValueError(f"{path}: only models that change no character and put a blank before the text are supported")
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_unknown(i) or model.is_control(i) for i in range(size)]
        in_bytes = [model.is_byte(i) for i in range(size)]
        if sum(in_bytes) != 256:
            raise ValueError(f"{path}: only models with a piece for each byte are supported")
        self.begin, self.end, self.unknown, self.size = model.bos_id(), model.eos_id(), model.unk_id(), size
        #: The id of each byte's piece.
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        scores: dict[str, float] = {}
        spelled = []
        for i, name in enumerate(names):
            if in_bytes[i]:
                self.byte_ids[int(name[3:5], 16)] = i
                spelled.append(bytes([int(name[3:5], 16)]))
            elif special[i]:
                spelled.append(UNKNOWN.encode() if i == self.unknown else b"")
            else:
                plain = name.replace(BLANK, " ")
                self.ids[plain], scores[plain] = i, model.get_score(i)
                spelled.append(plain.encode())
        #: The bytes of each id; the last entry stands for unknown ids.
        self.tokens = pa.array([*spelled, b""], pa.large_binary())
        #: Which ids stand for bytes at all, and which begin with a blank that may be the one before a text.
        self.spells = np.array([bool(x) for x in spelled] + [False])
        self.opens = np.array([x[:1] == b" " and not in_bytes[i] and i != self.unknown for i, x in enumerate(spelled)] + [False])
        places = {s: at for at, s in enumerate(sorted(set(scores.values()), reverse=True))}
        #: By piece: its place in the order of merges; pieces of one score have one place.
        self.order = {p: places[s] for p, s in scores.items()}
        #: Characters that stand next to each other in some piece.
        self.touching = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: Whether a text may be cut before a blank that follows another character.
        self.cut_at_blanks = not any(b == " " != a for a, b in self.touching)
        #: And before a stop that follows a letter or number, and before a line break.
        self.cut_at_stops = not any(b == "\n" or b in ".," and not STOP_ALONE_RE.match(a + b) for a, b in self.touching)

    def merged(self, text: str) -> list[str]:
        """The text's pieces by definition: the best pair of neighbours is joined first, the leftmost of equals."""
        parts, order = list(text), self.order
        worst = len(order)
        while len(parts) > 1:
            best, at = worst, -1
            for i in range(len(parts) - 1):
                place = order.get(parts[i] + parts[i + 1], worst)
                if place < best:
                    best, at = place, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    @cached_property
    def reachable(self) -> list[str]:
        """The pieces that merging their characters gives, and the single characters of pieces."""
        return sorted({p for p in self.ids if len(self.merged(p)) == 1} | {c for p in self.ids for c in p})


class PieceEncoder:
    """Texts to ids, as bytes of little-endian unsigned 32-bit integers, without begin and end."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        names = pieces.reachable
        place = {p: i for i, p in enumerate(names)}
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(names):
            if len(p) > 1:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.names = names
        self.lengths = [len(p) for p in names]
        self.single = {p: i for i, p in enumerate(names) if len(p) == 1}
        #: Of each piece, the longest other piece that it begins with; -1: none.
        self.shorter = [next((place[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in place), -1) for p in names]
        #: The ids of each piece: its own, or for a character without one those of its bytes.
        self.of_piece = [(pieces.ids[p],) if p in pieces.ids else tuple(pieces.byte_ids[b] for b in p.encode()) for p in names]
        #: Of each piece, those that were tried after it, and whether they are compatible.
        self.fits: list[dict[int, bool]] = [{} for _ in names]
        self.n_fits = 0
        self.memo: dict[bytes, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging both pieces' characters anew gives these two pieces."""
        found = self.fits[left].get(right)
        if found is None:
            a, b = self.names[left], self.names[right]
            found = a[-1] + b[0] not in self.pieces.touching or self.pieces.merged(a + b) == [a, b]
            if self.n_fits >= MEMO_PAIRS:
                self.n_fits = 0
                for tried in self.fits:
                    tried.clear()
            self.n_fits += 1
            self.fits[left][right] = found
        return found

    def word(self, text: str) -> list[int]:
        """The ids of a text by backtracking."""
        single, lengths = self.single, self.lengths
        longest = [single.get(c, -1) for c in text]
        for last, piece in self.automaton.iter(text):  # in order of their last characters: the longest comes last
            longest[last + 1 - lengths[piece]] = piece
        if -1 not in longest:
            return [i for piece in self._path(longest, 0, len(text)) for i in self.of_piece[piece]]
        out: list[int] = []
        at = 0
        while at < len(text):
            if longest[at] < 0:  # in no piece
                out.extend(self.pieces.byte_ids[b] for b in text[at].encode())
                at += 1
                continue
            stop = at + 1
            while stop < len(text) and longest[stop] >= 0:
                stop += 1
            for piece in self._path(longest, at, stop):
                out.extend(self.of_piece[piece])
            at = stop
        return out

    def _path(self, longest: list[int], start: int, stop: int) -> list[int]:
        """The pieces from start to stop, where every character is in some piece."""
        failed = bytearray((stop - start + 8) // 8)
        path: list[int] = []
        lengths, shorter, fits, compatible = self.lengths, self.shorter, self.fits, self.compatible
        at, piece = start, longest[start]
        while at < stop:
            while piece >= 0:
                end = at + lengths[piece]
                off = end - start
                if end <= stop and not failed[off >> 3] >> (off & 7) & 1:
                    if not path:
                        break
                    known = fits[path[-1]].get(piece)
                    if known or known is None and compatible(path[-1], piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                path.append(piece)
                at = end
                piece = longest[at] if at < stop else -1
            else:
                off = at - start
                failed[off >> 3] |= 1 << (off & 7)
                last = path.pop()
                at -= lengths[last]
                piece = shorter[last]
        return path

    def words(self, distinct: pa.Array) -> pa.Array:
        """The ids of each word (large strings)."""
        memo, out = self.memo, []
        for word in distinct.cast(pa.large_binary()).to_pylist():
            ids = memo.get(word)
            if ids is None:
                ids = array("I", self.word(word.decode())).tobytes()
                if len(word) <= MEMO_BYTES:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[word] = ids
            out.append(ids)
        return pa.array(out, pa.large_binary())

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text (strings; null: empty)."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), BLANK, " ")
        if not self.pieces.cut_at_blanks:
            return self.words(pa.array([" " + t if t else t for t in texts.to_pylist()], pa.large_string()))
        # Between single blanks a text is cut at each; a blank before another goes with what follows.
        careful = pc.or_(pc.match_substring_regex(after(" ", texts), "\x01|  "), pc.equal(texts, ""))
        plain = texts.filter(pc.invert(careful))
        # Where no piece reaches across, also before stops that follow a letter and before line breaks; marked, as no blank is there.
        if self.pieces.cut_at_stops:
            stops = pc.replace_substring(pc.replace_substring(plain, ".", " \x01."), ",", " \x01,")
            plain = pc.if_else(pc.match_substring_regex(plain, STOP_ALONE), plain, stops)
            plain = pc.replace_substring(plain, "\n", " \x01\n")
        cut = pc.split_pattern(plain, " ")
        counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
        values = cut.flatten().dictionary_encode()
        marked = pc.starts_with(values.dictionary, "\x01")
        words = pc.if_else(marked, pc.utf8_slice_codeunits(values.dictionary, 1), after(" ", values.dictionary))
        ids = self.words(words).take(values.indices)
        if len(plain) == len(texts):
            return regrouped(ids, counts)
        apart = [_WORD.findall(" " + t) if t else [] for t in texts.filter(careful).to_pylist()]
        coded = pa.array([w for x in apart for w in x], pa.large_string()).dictionary_encode()
        careful, lengths = np.array(careful), np.empty(len(texts), np.int64)
        lengths[careful], lengths[~careful] = [len(x) for x in apart], counts
        return regrouped(by_place(self.words(coded.dictionary).take(coded.indices), ids, np.repeat(careful, lengths)), lengths)


def framed(pieces: Pieces, ids: pa.Array) -> pa.Array:
    """With the ids of begin and end."""
    begin, end = (np.array([i], "<u4").tobytes() for i in (pieces.begin, pieces.end))
    kind = ids.type
    return pc.binary_join_element_wise(pa.scalar(begin, kind), ids, pa.scalar(end, kind), pa.scalar(b"", kind))


def texts_of(pieces: Pieces, ids: pa.Array) -> list[bytes]:
    """The text of each value of ids, in UTF-8: special pieces stand for nothing, a wrong byte for U+FFFD.

    The blank before the text goes if the first piece that is not a special one begins with it.
    """
    data, offsets = raw(ids)
    numbers = np.minimum(data[offsets[0] : offsets[-1]].view("<u4"), pieces.size)
    bounds = (offsets - offsets[0]) // 4
    places = np.append(np.flatnonzero(pieces.spells[numbers]), len(numbers))
    first = places[np.searchsorted(places, bounds[:-1])]
    cuts = np.zeros(len(ids), bool)
    inside = first < bounds[1:]
    cuts[inside] = pieces.opens[numbers[first[inside]]]
    out = []
    # A special piece inside parts the bytes before it from those after it.
    silent = np.append(~pieces.spells[numbers], False)
    total = np.concatenate(([0], np.cumsum(silent)))
    inside = np.diff(bounds) > 1
    parted = (total[bounds[1:]] - total[bounds[:-1]] - silent[bounds[:-1]] - silent[bounds[1:] - 1] > 0) & inside
    tokens = pieces.tokens
    for i, (value, cut) in enumerate(zip(decoded(tokens, ids).to_pylist(), cuts.tolist())):
        if parted[i]:
            own = numbers[bounds[i] : bounds[i + 1]]
            runs = np.split(own, np.flatnonzero(~pieces.spells[own]))
            value = b"".join(_valid(b"".join(tokens.take(pa.array(r)).to_pylist())) for r in runs)
        else:
            value = _valid(value)
        out.append(value[1:] if cut else value)
    return out


def _valid(value: bytes) -> bytes:
    """The value, each byte that is in no character as U+FFFD."""
    try:
        value.decode()
        return value
    except UnicodeDecodeError:
        return _each_wrong_byte(value)


def _each_wrong_byte(value: bytes) -> bytes:
    """Every byte that begins no character becomes U+FFFD, one by one."""
    out = []
    while value:
        try:
            out.append(value.decode())
            break
        except UnicodeDecodeError as e:
            out.append(value[: e.start].decode() + "�")
            value = value[e.start + 1 :]
    return "".join(out).encode()


_ENCODERS: dict[int, PieceEncoder] = {}


def worker_encoder(shared) -> PieceEncoder:
    """The Python worker's encoder for a broadcast vocabulary; its tasks share it."""
    pieces = shared.value
    if id(pieces) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(pieces)] = PieceEncoder(pieces)
    return _ENCODERS[id(pieces)]


def prepared(path: str) -> Pieces:
    """The vocabulary, with what is found out once for all workers."""
    pieces = Pieces(path)
    assert pieces.reachable
    return pieces


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (binary: unsigned 32-bit integers, little-endian; begin and end included) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(prepared(model_path))

    def run(batches):
        for batch in common.slices(batches, BATCH_ROWS, BATCH_BYTES):
            encoder = worker_encoder(shared)
            ids = framed(encoder.pieces, encoder.encode(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids.cast(pa.binary())], names=["id", "ids"])

    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, f"id {plain.schema['id'].dataType.simpleString()}, ids binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_tokens (long), ids, text of every row; unknown ids are skipped."""
    shared = df.sparkSession.sparkContext.broadcast(Pieces(model_path))

    def run(batches):
        for batch in common.slices(batches, BATCH_ROWS, BATCH_BYTES):
            ids = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            texts = pa.array([x.decode() for x in texts_of(shared.value, ids)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(raw(ids)[1]) // 4, pa.int64()), batch.column(1), texts], names=["id", "n_tokens", "ids", "text"])

    plain = df.select(F.col(id_col).alias("id"), "ids")
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, n_tokens long, ids binary, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, from one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(prepared(model_path or default_model()))

    def sha256(values: list[bytes]) -> pa.Array:
        return pa.array([hashlib.sha256(x).hexdigest() for x in values], pa.string())

    def run(batches):
        for batch in common.slices(batches, BATCH_ROWS, BATCH_BYTES):
            encoder = worker_encoder(shared)
            ids = framed(encoder.pieces, encoder.encode(batch.column(1)))
            columns = [batch.column(0), pa.array(np.diff(raw(ids)[1]) // 4, pa.int64()), sha256(ids.to_pylist()), sha256(texts_of(encoder.pieces, ids))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_piece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every text of documents, as digests."""
    return round_trip(common.table(spark, sf_dir, "documents"))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
