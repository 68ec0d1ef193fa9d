"""N-best segmentation into the pieces of a SentencePiece model, and decoding.

All pieces that match somewhere in a text form a lattice; a path's score is the sum of its pieces'
scores.  No piece goes from the end of one word into the blanks of the next, so the lattice falls apart
there: forward Viterbi runs over the distinct words of many texts at once and keeps the two best scores
at each place.  The n best paths of a text change only its n - 1 words with the least loss; for these a
backward A* search, with the forward scores as exact heuristics, lists the n best paths, and the best
sums of their losses give the text's.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import filled, slices, strings, with_python
from wattline.llm.token_counts import pre_tokens

#: Words that one worker remembers; words longer than LONG characters are searched one by one.
REMEMBERED, LONG, CHUNK = 300_000, 64, 8_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = -1e18


class Pieces:
    """Scores and matches of a model's ordinary pieces; a character that is no piece is spelled in bytes."""

    def __init__(self, model: str):
        import sentencepiece

        encoder = sentencepiece.SentencePieceProcessor(model_file=model)
        size = encoder.get_piece_size()
        ordinary = [i for i in range(size) if not (encoder.is_byte(i) or encoder.is_control(i) or encoder.is_unknown(i) or encoder.is_unused(i))]
        self.names = {encoder.id_to_piece(i): i for i in ordinary}
        self.scores = np.array([encoder.get_score(i) for i in range(size)])
        known = self.scores[ordinary]
        self.unknown = float(known[known > -1e8].min()) - 10
        self.byte = [encoder.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.names))
        self.text = [b""] * size
        for name, i in self.names.items():
            self.text[i] = name.replace("▁", " ").encode()
        for b, i in enumerate(self.byte):
            self.text[i] = bytes([b])
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.bounds = np.cumsum([0, *map(len, self.text)])
        self.tables = []  # for each length: sorted hashes of the beginnings of pieces, and the piece it is (-1: none)
        found: list[dict[int, int]] = [{} for _ in range(self.longest)]
        mask = (1 << 64) - 1
        for name, i in self.names.items():
            h = 0
            for k, c in enumerate(name):
                h = (h * int(_BASE) + ord(c) + 1) & mask
                if k + 1 == len(name):
                    found[k][h] = i
                else:
                    found[k].setdefault(h, -1)
        for table in found:
            hashes = np.array(list(table), np.uint64)
            order = np.argsort(hashes)
            self.tables.append((hashes[order], np.array(list(table.values()), np.int32)[order]))

    def matches(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces (-1: none) and scores by length - 1 and start, for characters with `left` of them to the end of
        their word; a start is followed only while what it reads begins some piece."""
        piece = np.full((self.longest, len(codes)), -1, np.int32)
        score = np.full((self.longest, len(codes)), _LOW)
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for k, (hashes, ids) in enumerate(self.tables):
            inside = left[at] > k
            at, h = at[inside], h[inside]
            h = h * _BASE + codes[at + k] + np.uint64(1)
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            begun = hashes[place] == h
            at, h, place = at[begun], h[begun], place[begun]
            if not len(at):
                break
            whole = ids[place] >= 0
            piece[k, at[whole]] = ids[place[whole]]
            score[k, at[whole]] = self.scores[ids[place[whole]]]
        score[0, piece[0] < 0] = self.unknown
        return piece, score

    def join(self, ids: np.ndarray) -> str:
        """The text of pieces, without the blank before it."""
        length = self.bounds[ids + 1] - self.bounds[ids]
        place = np.cumsum(length) - length
        raw = self.flat[np.repeat(self.bounds[ids] - place, length) + np.arange(int(length.sum()))]
        text = raw.tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def edges(self, word: str, end: int) -> list[tuple[int, int, float]]:
        """(start, piece, score) of all pieces that end at a place; piece -1 is an unknown character."""
        out = []
        for start in range(max(0, end - self.longest), end):
            piece = self.names.get(word[start:end])
            if piece is not None:
                out.append((start, piece, float(self.scores[piece])))
            elif start == end - 1:
                out.append((start, -1, self.unknown))
        return out

    def spelled(self, word: str, path: list[tuple[int, int]]) -> list[int]:
        """Piece numbers of a path of (start, piece)."""
        out = []
        for start, piece in path:
            out += [piece] if piece >= 0 else [self.byte[b] for b in word[start].encode("utf-8", "replace")]
        return out

    def n_best(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a word, best first: forward Viterbi, then A* from the end, where the
        forward scores say exactly what the rest of a path will bring."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = len(codes)
        piece, score = self.matches(codes, size - np.arange(size))
        length, start = np.nonzero(score > _LOW)
        order = np.lexsort((start, start + length))  # by end, the longest piece first
        ends = (start + length + 1)[order]
        first = array("q", np.searchsorted(ends, np.arange(size + 2)).astype(np.int64).tobytes())
        starts = array("q", start[order].astype(np.int64).tobytes())
        pieces = array("i", piece[length, start][order].astype(np.int32).tobytes())
        scores = array("d", score[length, start][order].tobytes())
        del piece, score, length, start, order, ends
        forward = array("d", [0.0])
        for end in range(1, size + 1):
            forward.append(max([forward[starts[e]] + scores[e] for e in range(first[end], first[end + 1])]))
        # among paths of equal cost the one nearest to the start goes on, so ties do not fan out
        ticket = itertools.count()
        heap = [(-forward[-1], size, next(ticket), 0.0, None)]
        out = []
        while heap and len(out) < n:
            _, at, _, total, path = heapq.heappop(heap)
            if at == 0:
                steps = []
                while path is not None:
                    steps.append(path[:2])
                    path = path[2]
                out.append((total, self.spelled(word, steps)))
                continue
            for e in range(first[at], first[at + 1]):
                begin, more = starts[e], total + scores[e]
                heapq.heappush(heap, (-(more + forward[begin]), begin, next(ticket), more, (begin, pieces[e], path)))
        return out

    def best(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Best and second best scores (LOW if there is none) and the best segmentation of many words."""
        n = len(words)
        first, second = np.full(n, _LOW), np.full(n, _LOW)
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * n
        length = np.array([len(w) for w in words])
        for k in np.flatnonzero(length > LONG).tolist():
            found = self.n_best(words[k], 2)
            first[k], out[k] = found[0][0], np.array(found[0][1], np.int32)
            second[k] = found[1][0] if len(found) > 1 else _LOW
        order = np.flatnonzero(length <= LONG)
        order = order[np.argsort(-length[order], kind="stable")]
        if not len(order):
            return first, second, out
        size = length[order]
        codes = np.frombuffer("".join([words[k] for k in order]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        base = np.cumsum(size) - size
        left = np.repeat(size, size) - (np.arange(len(codes)) - np.repeat(base, size))  # characters to the word's end
        piece, score = self.matches(codes, left)
        one, two = np.full((len(size), int(size[0]) + 1), _LOW), np.full((len(size), int(size[0]) + 1), _LOW)
        back = np.zeros((len(size), int(size[0]) + 1), np.uint8)
        one[:, 0] = 0.0
        for end in range(1, int(size[0]) + 1):
            m = int(np.searchsorted(-size, -end, side="right"))
            for k in range(min(end, self.longest), 0, -1):
                s = score[k - 1, base[:m] + end - k]
                a, b = one[:m, end - k] + s, two[:m, end - k] + s
                better = a > one[:m, end]
                two[:m, end] = np.maximum(np.maximum(two[:m, end], b), np.where(better, one[:m, end], a))
                one[:m, end][better] = a[better]
                back[:m, end][better] = k
        rows = np.arange(len(size))
        first[order], second[order] = one[rows, size], np.maximum(two[rows, size], _LOW)
        end, steps = size.copy(), []
        live = rows
        while len(live):
            k = back[live, end[live]].astype(np.int64)
            end[live] -= k
            steps.append((live, piece[k - 1, base[live] + end[live]], end[live].copy()))
            live = live[end[live] > 0]
        row = np.concatenate([s[0] for s in steps])
        ids = np.concatenate([s[1] for s in steps])
        start = np.concatenate([s[2] for s in steps])
        turn = np.lexsort((start, row))
        row, ids, start = row[turn], ids[turn], start[turn]
        cuts = np.searchsorted(row, np.arange(len(size) + 1))
        unknown = np.zeros(len(size), bool)
        unknown[row[ids < 0]] = True
        for r, k in enumerate(order.tolist()):
            own = slice(cuts[r], cuts[r + 1])
            if unknown[r]:
                out[k] = np.array(self.spelled(words[k], list(zip(start[own].tolist(), ids[own].tolist()))), np.int32)
            else:
                out[k] = ids[own]
        second[second < _LOW / 2] = _LOW
        return first, second, out


class _Memory:
    """What a worker remembers of words: best score, loss of the second best, best pieces."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.lists: dict[tuple[str, int], list[tuple[float, list[int]]]] = {}
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.words = self.pieces_known = 0
        self.score, self.loss, self.start = np.zeros(0), np.zeros(0), np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)

    def learn(self, texts: list[list[str]]) -> None:
        new = list(set().union(*texts).difference(self.at)) if texts else []
        if len(self.at) + len(new) > REMEMBERED and self.at:
            self.clear()
            new = list(set().union(*texts))
        for k in range(0, len(new), CHUNK):
            part = new[k : k + CHUNK]
            first, second, ids = self.pieces.best(["▁" + w.replace(" ", "▁") for w in part])
            self.at.update(zip(part, range(len(self.at), len(self.at) + len(part))))
            sizes = np.array([len(x) for x in ids], np.int64)
            self.score, self.loss = self._more(self.score, first), self._more(self.loss, np.where(second > _LOW, first - second, np.inf))
            self.start = self._more(self.start, self.pieces_known + np.cumsum(sizes), 1)
            self.flat = self._more(self.flat, np.concatenate(ids), 0, self.pieces_known)
            self.pieces_known += int(sizes.sum())
            self.words += len(part)

    def _more(self, old: np.ndarray, new: np.ndarray, shift: int = 0, used: int | None = None) -> np.ndarray:
        """`new` put behind the used part of an array, which doubles when it is full."""
        used = self.words + shift if used is None else used
        if used + len(new) > len(old):
            old = np.concatenate((old[:used], np.zeros(max(used, len(new), 1024), old.dtype)))
        if used + len(new) > len(old):
            old = np.concatenate((old, np.zeros(len(new), old.dtype)))
        old[used : used + len(new)] = new
        return old

    def options(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        if (word, n) not in self.lists:
            if len(self.lists) > 20_000:
                self.lists.clear()
            self.lists[word, n] = self.pieces.n_best("▁" + word.replace(" ", "▁"), n)
        return self.lists[word, n]

    def encode(self, words: list[str], n: int) -> tuple[np.ndarray, list[tuple[float, list[dict]]]]:
        """Piece numbers of the best path, and the n best as scores with their edits of it."""
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        size = self.start[at + 1] - self.start[at]
        place = np.cumsum(size) - size
        ids = self.flat[np.repeat(self.start[at] - place, size) + np.arange(int(size.sum()))]
        total = float(self.score[at].sum())
        loss = self.loss[at]
        few = np.argsort(loss, kind="stable")[: n - 1] if len(loss) <= 64 else self._least(loss, n - 1)
        few = [int(k) for k in few if np.isfinite(loss[k])]
        lists = [self.options(words[k], n) for k in few]
        heap, seen, out = [(0.0, (0,) * len(few))], {(0,) * len(few)}, []
        while heap and len(out) < n:
            lost, choice = heapq.heappop(heap)
            edits = [{"at": int(place[few[i]]), "cut": int(size[few[i]]), "ids": lists[i][c][1]} for i, c in enumerate(choice) if c]
            out.append((total - lost, sorted(edits, key=lambda e: e["at"])))
            for i, c in enumerate(choice):
                if c + 1 < len(lists[i]):
                    nxt = (*choice[:i], c + 1, *choice[i + 1 :])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(heap, (sum(x[0][0] - x[d][0] for x, d in zip(lists, nxt)), nxt))
        return ids, out

    @staticmethod
    def _least(loss: np.ndarray, n: int) -> np.ndarray:
        """Places of the n least losses, the first ones among equals."""
        edge = np.partition(loss, n - 1)[n - 1] if n else 0.0
        under, equal = np.flatnonzero(loss < edge), np.flatnonzero(loss == edge)
        return np.sort(np.concatenate((under, equal[: n - len(under)])))


@functools.cache
def _memory(model: str) -> _Memory:
    return _Memory(Pieces(model))


_NBEST = pa.list_(pa.struct([
    ("score", pa.float64()), ("edits", pa.list_(pa.struct([("at", pa.int32()), ("cut", pa.int32()), ("ids", pa.list_(pa.int32()))]))),
]))
_SCHEMA = (
    "ids array<int>, ids_sha256 string, round_trip boolean, "
    "nbest array<struct<score:double,edits:array<struct<at:int,cut:int,ids:array<int>>>>>"
)


def encode(df: DataFrame, model: str, n: int = 4, text: str = "text") -> DataFrame:
    """`df` with ids (pieces of the best path), ids_sha256 (of them as 32-bit numbers), round_trip and nbest.

    nbest lists the `n` best paths (fewer if there are no more), best first: the score and the edits that
    make it of the best one (from piece `at` on, `cut` pieces give way to `ids`).  Scores are the model's;
    a character that is no piece costs 10 more than the worst ordinary piece and is spelled in bytes.
    round_trip says that decoding the pieces gives the text again.  Of equal paths the one with the longer last piece is the best; among words of equal loss the first is
    changed.  As in the library, a blank goes before the text.  Null and empty texts have no pieces and
    one path of score 0; long ones are read whole; repeated rows stay; columns with the new names are replaced.
    """

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        memory = _memory(model)
        _, bounds = strings(batch.column("_text"))
        values = batch.column("_text").to_pylist()
        offsets, parts, digests, same, lists = [0], [], [], [], []
        for a, b in slices(bounds):
            texts = [pre_tokens(t) if t else [] for t in values[a:b]]
            memory.learn(texts)
            for words, whole in zip(texts, values[a:b]):
                ids, best = memory.encode(words, n)
                same.append(memory.pieces.join(ids) == whole)
                parts.append(ids)
                offsets.append(offsets[-1] + len(ids))
                digests.append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                lists.append([{"score": s, "edits": e} for s, e in best])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32)))
        return [ids, pa.array(digests, pa.string()), pa.array(same, pa.bool_()), pa.array(lists, _NBEST)]

    return with_python(df, {"_text": filled(text)}, _SCHEMA, step)


def decode(df: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """`df` with decoded: the text of the pieces in `ids`, without the blank put before it.

    Bytes that make no UTF-8 become the replacement character; null ids give an empty text.
    """

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        pieces = _memory(model).pieces
        lists = batch.column("_ids")
        flat, sizes, at = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(), 0
        out = []
        for size in sizes.tolist():
            out.append(pieces.join(flat[at : at + size]))
            at += size
        return [pa.array(out, pa.string())]

    return with_python(df, {"_ids": F.coalesce(F.col(ids), F.array().cast("array<int>"))}, "decoded string", step)
