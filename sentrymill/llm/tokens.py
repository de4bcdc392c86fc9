"""SentencePiece encoding with the N best segmentations, and decoding.

The pieces of a text form a lattice; a segmentation's score is the sum of its pieces' scores.  A forward Viterbi pass
gives each place its best score from the start, which is the exact remaining cost of a search that goes back from the
end: A* then yields the segmentations in the order of their scores, as many as asked.

No piece crosses from another character into a word start, over a line break, or from a letter into a full stop or comma (all
read off the vocabulary; where pieces cross into word starts, a text is one lattice), so the lattice of a text is a chain of
those of its words, and a word before a full stop is solved as the word alone.  Words are solved once and kept
per worker; the N best of a text follow exactly from the words with the least gaps to their next best.  So the forward pass
keeps the two best scores of each place, which give a word's best way and the gap to its next, and A* runs only for the n - 1
words of a text with the least gaps.  The forward pass goes over tables of words side by side.

Characters without a piece become their bytes' pieces (or the unknown piece) and cost 10 less than the worst piece, as in the
public library's unigram model.  Pieces of control and unused types are never made from a text.

``encoded`` gives the ids of all N best; ``decoded`` turns ids into text, and round_trip compares what it makes of the ids that are
given out with the text.

Defined cases: null and empty text have no tokens and one segmentation of score 0; result columns replace columns of their name;
other columns pass through.  Null ids decode to null; an id outside the vocabulary decodes as the unknown piece.  A text that holds the word-start sign itself decodes with blanks in its place.
"""

from __future__ import annotations

import heapq
import itertools
import math
import operator
import re
import struct
import sys
import types
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrymill.llm.common import column, map_batches, others, raw, ready

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BEST = 3
SPACE = "▁"
#: Words kept per worker, words whose n best are kept, bytes of text taken together, and places of a table of the forward pass.
#: They change no result.
WORDS, DEEP, TOGETHER, PLACES = 250_000, 20_000, 2 << 20, 1 << 16
#: Characters up to which a search keeps all open ways.
SHORT = 64
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
LAST = operator.itemgetter(-1)


def _fields(data: bytes):
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at:at + size]
            at += size


@dataclass
class Pieces:
    """A vocabulary: pieces, scores and types by id, and whether texts get a word start in front.

    ``look`` has (id, score) of each piece, and None for what is only the start of one.
    """

    names: list[str]
    scores: list[float]
    kinds: list[int]
    prefix: bool = True
    look: dict = field(default_factory=dict, repr=False)

    @classmethod
    def read(cls, data: bytes) -> Pieces:
        names, scores, kinds, prefix = [], [], [], True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                names.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                kinds.append(piece.get(3, NORMAL))
            elif number == 3:
                prefix = bool(dict(_fields(value)).get(3, 1))
        return cls(names, scores, kinds, prefix)

    def __post_init__(self):
        used = [(n, i) for i, n in enumerate(self.names) if self.kinds[i] in (NORMAL, USER)]
        for name, i in used:
            for end in range(1, len(name)):
                self.look.setdefault(name[:end], None)
        self.trie: dict = {}  # character: (what follows, piece, score)
        for name, i in used:
            self.look[name] = (i, self.scores[i])
            below = self.trie
            for c in name[:-1]:
                below = below.setdefault(c, ({}, None, 0.0))[0]
            below[name[-1]] = (below[name[-1]][0] if name[-1] in below else {}, i, self.scores[i])
        self.levels = self._levels(used)
        self.worst = min((self.scores[i] for _, i in used), default=0.0) - 10
        self.bytes = {int(n[3:5], 16): i for i, n in enumerate(self.names) if self.kinds[i] == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        crossing = any(re.search(f"[^{SPACE}]{SPACE}|\n", n) for n, _ in used)
        self.cut = re.compile("(?s).+" if crossing else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        # full stops and commas that no piece holds behind a letter, and that are pieces: they part from a word before them
        self.ends = {c: self.look[c] for c in ".,;:" if self.look.get(c) and not any(
            n[i] == c and n[i - 1].isalpha() for n, _ in used for i in range(1, len(n)))}
        self.plain = [bytes([int(n[3:5], 16)]) if k == BYTE else n.replace(SPACE, " ").encode() if k in (NORMAL, USER)
                      else " ⁇ ".encode() if k == UNKNOWN else b"" for n, k in zip(self.names, self.kinds, strict=True)]
        self.plain_size = np.array([len(p) for p in self.plain], np.int64)
        self.plain_start = np.cumsum(self.plain_size) - self.plain_size
        self.plain_row = np.frombuffer(b"".join(self.plain), np.uint8)

    def _levels(self, used) -> list[tuple[np.ndarray, ...]]:
        """The trie by depth: sorted keys (node above, character), the node of each, its piece (-1: none) and score."""
        number = {"": 0} | {name: i for i, name in enumerate(self.look, 1)}
        deep: dict[int, list] = {}
        for name, hit in self.look.items():
            piece, score = hit or (-1, -np.inf)
            deep.setdefault(len(name), []).append((number[name[:-1]] << 21 | ord(name[-1]), number[name], piece, score))
        found = []
        for depth in range(1, max(deep, default=0) + 1):
            keys, nodes, ids, scores = zip(*sorted(deep[depth]), strict=True)
            found.append((np.array(keys), np.array(nodes), np.array(ids, np.int32), np.array(scores, np.float64)))
        return found

    def without_piece(self, char: str) -> tuple[int, ...]:
        raw_bytes = char.encode("utf-8", "surrogatepass")
        return tuple(self.bytes[b] for b in raw_bytes) if self.bytes else (self.unknown,)

    def best(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of one lattice, best first."""
        size, get = len(word), self.look.get
        score = [0.0] + [-1e300] * size  # forward Viterbi: best score of the text up to here
        into: list[list] = [[] for _ in range(size + 1)]
        for i in range(size):
            here, single = score[i], False
            for j in range(i + 1, size + 1):
                hit = get(word[i:j], 0)
                if hit is None:
                    continue
                if hit == 0:
                    break
                single |= j == i + 1
                into[j].append((i, hit[0], hit[1]))
                if here + hit[1] > score[j]:
                    score[j] = here + hit[1]
            if not single:
                into[i + 1].append((i, -1 - i, self.worst))
                if here + self.worst > score[i + 1]:
                    score[i + 1] = here + self.worst
        if not size:
            return [(0.0, ())]
        out: list = []
        heap, made, whole = [], 0, size <= SHORT

        def push(at: int, k: int, after: float, path):
            """Ways into a place: all of them, or in a long lattice the k-th best, the next one only when that is taken."""
            nonlocal made
            ways = into[at]
            if not whole and k == 0:
                ways.sort(key=lambda e: (-(score[e[0]] + e[2]), e[0]))
            for i, piece, value in ways if whole else ways[k:k + 1]:
                made += 1
                # of equal ones the one nearest to the start is finished first
                heapq.heappush(heap, (round(-(score[i] + value + after), 9), i, made, at, k, after, path, piece, value))

        push(size, 0, 0.0, None)
        while heap and len(out) < n:
            _, i, _, at, k, after, path, piece, value = heapq.heappop(heap)
            if not whole:
                push(at, k + 1, after, path)
            path, after = (piece, path), after + value
            if i:
                push(i, 0, after, path)
                continue
            ids: list[int] = []
            while path is not None:
                ids.extend((path[0],) if path[0] >= 0 else self.without_piece(word[-1 - path[0]]))
                path = path[1]
            out.append((after, tuple(ids)))
        return out

    def two_best(self, word: str) -> tuple[tuple[int, ...], float, float | None]:
        """Ids and score of the best segmentation, and what the second loses to it (None where there is no second)."""
        size, root, worst = len(word), self.trie, self.worst
        best, second = [0.0] + [-1e300] * size, [-1e300] * (size + 1)
        back: list = [None] * (size + 1)
        for i in range(size):
            here, single, below = best[i], None, root
            for j in range(i, size):
                node = below.get(word[j])
                if node is None:
                    break
                below, piece, value = node
                if piece is None:
                    continue
                if j == i:
                    single = piece
                j += 1
                score = here + value
                if score > best[j] + 1e-9:
                    second[j] = max(best[j], second[i] + value)
                    best[j], back[j] = score, (i, piece)
                elif score > second[j]:
                    second[j] = score
            if single is None:
                score, j = here + worst, i + 1
                if score > best[j] + 1e-9:
                    second[j] = max(best[j], second[i] + worst)
                    best[j], back[j] = score, (i, -1 - i)
                elif score > second[j]:
                    second[j] = score
        parts, at = [], size
        while at:
            at, piece = back[at]
            parts.append((piece,) if piece >= 0 else self.without_piece(word[-1 - piece]))
        return tuple([x for part in reversed(parts) for x in part]), best[size], best[size] - second[size] if second[size] > -1e299 else None

    def solved(self, words: list[str]) -> list[tuple[bytes, float, float]]:
        """two_best of many words, ids packed and inf for no second."""
        ids, scores, gaps = self.columns(words)
        return list(zip(ids, scores.tolist(), gaps.tolist(), strict=True))

    def columns(self, words: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """``solved`` as columns: one forward pass for a table of words."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable").tolist()  # the words that reach a place come first
        packed, scores, gaps = [], [], []
        at = 0
        while at < len(order):
            size = len(words[order[at]])
            take = [words[k] for k in order[at:at + max(1, PLACES // max(size, 1))]]
            at += len(take)
            if size > SHORT or not size:
                ids, score, gap, plain = [b""] * len(take), np.zeros(len(take)), np.zeros(len(take)), np.zeros(len(take), bool)
            else:
                ids, score, gap, plain = self._table(take)
            for k in np.flatnonzero(~plain).tolist():  # long words, and those with characters without a piece
                best, score[k], second = self.two_best(take[k])
                ids[k], gap[k] = struct.pack(f"{len(best)}i", *best), np.inf if second is None else second
            packed += ids
            scores.append(score)
            gaps.append(gap)
        turn = np.empty(len(order), np.int64)
        turn[order] = np.arange(len(order))
        return list(map(packed.__getitem__, turn.tolist())), np.concatenate([[], *scores])[turn], np.concatenate([[], *gaps])[turn]

    def _table(self, words: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Words, longest first, side by side: column w of each table belongs to word w, row t to its place t.

        Columns: ids, score, gap, and whether all characters have pieces, without which the others do not count.
        """
        width, size = len(words), len(words[0])
        codes = np.frombuffer("".join([w.ljust(size, "\0") for w in words]).encode("utf-32-le"), np.uint32)
        codes = codes.reshape(width, size).T.ravel().astype(np.int64)
        lengths = np.array([len(w) for w in words])
        pieces, values = [], []  # by depth: piece and score of each place as its start
        places, nodes = np.arange(size * width), np.zeros(size * width, np.int64)
        for depth, (keys, below, ids, scores) in enumerate(self.levels[:size], 1):
            inside = places < (size - depth + 1) * width
            places, nodes = places[inside], nodes[inside]
            wanted = nodes << 21 | codes[places + (depth - 1) * width]
            spot = np.searchsorted(keys, wanted)
            spot[spot == len(keys)] = 0
            hit = keys[spot] == wanted
            places, spot = places[hit], spot[hit]
            nodes = below[spot]
            piece, value = np.full(size * width, -1, np.int32), np.full(size * width, -np.inf)
            piece[places], value[places] = ids[spot], scores[spot]
            if depth == 1:
                value[piece < 0] = self.worst
            pieces.append(piece.reshape(size, width))
            values.append(value.reshape(size, width))
            if not len(places):
                break
        if not pieces:
            return [b""] * width, np.zeros(width), np.zeros(width), np.zeros(width, bool)
        best, second = np.full((size + 1, width), -1e300), np.full((size + 1, width), -1e300)
        best[0], back = 0.0, np.zeros((size + 1, width), np.int32)
        reach = [int((lengths >= t).sum()) for t in range(size + 1)]
        for t in range(1, size + 1):
            m = reach[t]
            first, other, taken = best[t, :m], second[t, :m], back[t, :m]
            for depth in range(min(t, len(pieces)), 0, -1):
                value = values[depth - 1][t - depth, :m]
                score = best[t - depth, :m] + value
                better = score > first + 1e-9
                np.copyto(other, np.where(better, np.maximum(first, second[t - depth, :m] + value), np.maximum(other, score)))
                np.copyto(first, score, where=better)
                taken[better] = depth
        column = np.arange(width)
        top, next_one = best[lengths, column], second[lengths, column]
        made, plain = np.full((width, size), -2, np.int32), np.ones(width, bool)
        where, turn, going = lengths.copy(), size, column
        while len(going):
            turn -= 1
            depth = back[where[going], going]
            where[going] -= depth
            found = np.empty(len(going), np.int32)
            for d in np.unique(depth):
                those = depth == d
                found[those] = pieces[d - 1][where[going[those]], going[those]]
            plain[going[found < 0]] = False
            made[going, turn] = found
            going = going[where[going] > 0]
        kept = made != -2
        ends = np.concatenate([[0], np.cumsum(kept.sum(1))]) * 4
        packed, ends = made[kept].tobytes(), ends.tolist()
        return [packed[a:b] for a, b in itertools.pairwise(ends)], top, np.where(next_one > -1e299, top - next_one, np.inf), plain

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", SPACE)
        return self.cut.findall(SPACE + text if self.prefix else text)

    def nbest(self, text: str, n: int = BEST) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text, best first."""
        found = [self.best(w, n) for w in self.words(text)]
        base = sum(f[0][0] for f in found)
        turns = chosen([[f[0][0] - s for s, _ in f] for f in found], n)
        return [(base - gap, [x for at, f in enumerate(found) for x in f[which.get(at, 0)][1]]) for gap, which in turns]

    def plain_bytes(self, ids) -> bytes:
        """What the ids stand for, side by side."""
        ids = np.asarray(ids, np.int64)
        size = self.plain_size[ids]
        ends = np.cumsum(size)
        # each byte's place in the row of all pieces: its piece's start, and how far it is behind that
        return self.plain_row[np.repeat(self.plain_start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def decode_bytes(self, ids) -> bytes:
        out = self.plain_bytes(ids)
        return out[1:] if self.prefix and out[:1] == b" " else out

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def chosen(gaps: list[list[float]], n: int) -> list[tuple[float, dict[int, int]]]:
    """The n best ways to choose one segmentation per word: (loss, {word: which, where not the first}).

    ``gaps`` has each word's losses, 0 first, ascending.  Of all words, only the n - 1 with the least second gap can differ
    from their best: to use another, these alone give n - 1 better ways besides the best.
    """
    few = heapq.nsmallest(n - 1, ((g[1], at) for at, g in enumerate(gaps) if len(g) > 1))
    ways: list[tuple[float, dict[int, int]]] = [(0.0, {})]
    for _, at in few:
        more = [(loss + g, way | {at: k} if k else way) for loss, way in ways for k, g in enumerate(gaps[at][:n])]
        ways = heapq.nsmallest(n, more, key=lambda x: x[0])
    return ways


def load(model: str = MODEL) -> Pieces:
    return Pieces.read(Path(model).read_bytes())


def _of_worker(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, which serves many tasks."""
    return sys.modules.setdefault(f"_kept_{name}", types.ModuleType(name)).__dict__


def _lists(parts: list[bytes]) -> pa.Array:
    """A column of id lists from their bytes."""
    ends = np.cumsum([0, *[len(p) >> 2 for p in parts]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _texts(pieces: Pieces, ids: pa.Array) -> list[bytes | None]:
    """What each id list of a column decodes to."""
    flat, size = ids.flatten(), len(pieces.plain)
    values = np.asarray(flat.fill_null(-1))
    values = np.where((values < 0) | (values >= size), pieces.unknown, values).tolist()
    ends = np.cumsum([0, *(n or 0 for n in ids.value_lengths().to_pylist())]).tolist()
    found = ids.is_valid().to_pylist()
    return [pieces.decode_bytes(values[ends[i]:ends[i + 1]]) if known else None for i, known in enumerate(found)]


def decoded(df: DataFrame, ids: str = "ids", model: str = MODEL, text_col: str = "decoded") -> DataFrame:
    """All rows and columns; ``text_col``, the text that the list ``ids`` stands for."""
    ready(df.sparkSession)
    data = Path(model).read_bytes()
    names = others(df, text_col)
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(text_col, T.StringType())])

    def run(batches):
        kept = _of_worker("decoder")
        if kept.get("model") != data:
            kept.update(model=data, pieces=Pieces.read(data))
        for batch in batches:
            texts = _texts(kept["pieces"], batch.column(len(names)).cast(pa.list_(pa.int32())))
            texts = [t if t is None else t.decode("utf-8", "replace") for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [f.name for f in schema])

    return map_batches(df.select(*[column(c) for c in names], column(ids).cast("array<int>").alias("_ids")), run, schema)


def _parted(pieces: Pieces, word: str) -> tuple[str, tuple[int, float] | None]:
    """A word, and the piece of a full stop or comma that parts from its end."""
    end = pieces.ends.get(word[-1])
    return (word[:-1], end) if end and word[-2:-1].isalpha() else (word, None)


def _ways(pieces: Pieces, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations of a word, its end included."""
    head, end = _parted(pieces, word)
    found = pieces.best(head, n)
    return [(score + end[1], (*ids, end[0])) for score, ids in found] if end else found


def _together(texts: list[bytes]):
    """The texts in runs of about TOGETHER bytes; a longer one is alone."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > TOGETHER:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


class Words:
    """The words that a worker has solved: a number each, and by number ids, score and gap to the next best."""

    def __init__(self, pieces: Pieces, n: int):
        self.pieces, self.n, self.deep = pieces, n, {}
        self.clear()

    def clear(self):
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.ids: list[bytes] = []
        self.scores, self.gaps = np.empty(0), np.empty(0)

    def add(self, words) -> None:
        new = list(set(words).difference(self.number))
        if not new:
            return
        # words with a full stop or comma that parts from them: their place, and its piece
        ended = [(k, _parted(self.pieces, new[k])) for k in np.flatnonzero(np.fromiter(
            map(self.pieces.ends.__contains__, map(LAST, new)), bool, len(new))).tolist()]
        heads = new.copy()
        for k, (head, _) in ended:
            heads[k] = head
        number = dict(zip(heads, itertools.repeat(0)))
        number.update(zip(number, range(len(number))))
        ids, scores, gaps = self.pieces.columns(list(number))
        spots = list(map(number.__getitem__, heads))
        ids, scores, gaps = list(map(ids.__getitem__, spots)), scores[spots], gaps[spots]
        for k, (_, end) in ended:
            if end:
                ids[k] += struct.pack("i", end[0])
                scores[k] += end[1]
        self.number.update(zip(new, range(len(self.names), len(self.names) + len(new)), strict=True))
        self.names += new
        self.ids += ids
        self.scores = np.append(self.scores, scores)
        self.gaps = np.append(self.gaps, gaps)

    def ways(self, word: str) -> list[tuple[float, bytes]]:
        """The n best of one word."""
        if word not in self.deep:
            if len(self.deep) > DEEP:
                self.deep.clear()
            self.deep[word] = [(score, struct.pack(f"{len(ids)}i", *ids)) for score, ids in _ways(self.pieces, word, self.n)]
        return self.deep[word]

    def least(self, found: np.ndarray) -> list[str]:
        """Of a text's distinct words the n - 1 with the least gaps, equal ones by word."""
        gaps = self.gaps[found]
        found, gaps = found[gaps < np.inf], gaps[gaps < np.inf]
        if self.n - 1 < len(found):
            near = gaps <= np.partition(gaps, self.n - 2)[self.n - 2] if self.n > 1 else gaps < -np.inf
            found, gaps = found[near], gaps[near]
        return [w for _, w in sorted(zip(gaps.tolist(), [self.names[k] for k in found.tolist()], strict=True))[:self.n - 1]]

    def encoded(self, texts: list[bytes]):
        """(packed ids of the n best, scores, whether they decode to the text) of each text."""
        pieces, n = self.pieces, self.n
        split = [pieces.words(text.decode("utf-8", "replace")) for text in texts]
        if len(self.names) > WORDS:
            self.clear()
        self.add(itertools.chain.from_iterable(split))
        for text, words in zip(texts, split, strict=True):
            nums = list(map(self.number.__getitem__, words))
            found, times = np.unique(np.array(nums, np.int64), return_counts=True)
            base = math.fsum((self.scores[found] * times).tolist())  # in whatever order the words got their numbers
            few = self.least(found)
            deep = {w: self.ways(w) for w in few}
            # a word can supply each of its places, but no more than n - 1 places are of use
            spots = [(w, nth) for w in few for nth in range(min(int(times[np.searchsorted(found, self.number[w])]), n - 1))]
            ways = chosen([[deep[w][0][0] - score for score, _ in deep[w]] for w, _ in spots], n)
            parts = list(map(self.ids.__getitem__, nums))
            for w, ((_, ids), *_) in deep.items():  # of ways that score alike the search's first
                if ids != self.ids[self.number[w]]:
                    parts = [ids if x == w else p for x, p in zip(words, parts, strict=True)]
            lists = [b"".join(parts)]
            sound = pieces.decode_bytes(np.frombuffer(lists[0], np.int32)) == text
            for _, way in ways[1:]:
                mine = list(parts)
                for spot, which in way.items():
                    w, nth = spots[spot]
                    at = -1
                    for _ in range(nth + 1):
                        at = words.index(w, at + 1)
                    mine[at] = deep[w][which][1]
                    # lists decode piece by piece, so they agree where the pieces that differ do
                    sound &= self.plain(mine[at]) == self.plain(deep[w][0][1])
                lists.append(b"".join(mine))
            yield lists, [base - loss for loss, _ in ways], sound

    def plain(self, ids: bytes) -> bytes:
        return self.pieces.plain_bytes(np.frombuffer(ids, np.int32))


def encoded(docs: DataFrame, model: str = MODEL, text_col: str = "text", n: int = BEST, packed: bool = False) -> DataFrame:
    """All rows and columns; ids (of the best segmentation), nbest_ids and scores (of the n best, best first), round_trip (each of
    nbest_ids decodes to the text).  ``packed``: ids as 4 bytes each, least byte first, instead of lists."""
    ready(docs.sparkSession)
    data = Path(model).read_bytes()  # half a megabyte, sent with the job
    names = others(docs, "ids", "nbest_ids", "scores", "round_trip")
    place = names.index(text_col)
    schema = T.StructType([docs.schema[c] for c in names] + [
        T.StructField("nbest_ids", T.ArrayType(T.BinaryType() if packed else T.ArrayType(T.IntegerType()))), T.StructField("scores", T.ArrayType(T.DoubleType())),
        T.StructField("round_trip", T.BooleanType())])

    def run(batches):
        kept = _of_worker("pieces")
        if kept.get("model") != (data, n):
            kept.update(model=(data, n), pieces=Pieces.read(data))
            kept["words"] = Words(kept["pieces"], n)
        known = kept["words"]
        for batch in batches:
            ids, scores, numbers, same = [], [], [], []
            for texts in _together(raw(batch.column(place))):
                for lists, values, sound in known.encoded(texts):
                    ids.extend(lists)
                    scores.append(values)
                    numbers.append(len(lists))
                    same.append(sound)
            lists = pa.array(ids, pa.binary()) if packed else _lists(ids)
            best = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *numbers]), pa.int32()), lists)
            yield pa.RecordBatch.from_arrays([*batch.columns, best, pa.array(scores, pa.list_(pa.float64())), pa.array(same, pa.bool_())],
                                             [f.name for f in schema])

    out = map_batches(docs.select(*[column(c) for c in names]), run, schema)
    return out.select(*[column(c) for c in names], F.get("nbest_ids", F.lit(0)).alias("ids"), "nbest_ids", "scores", "round_trip")
