"""SentencePiece encoding and decoding over the piece lattice, with exact N-best segmentation.

A segmentation's score is the sum of its pieces' scores in the model file.  No piece of a model with
space prefixes holds a space mark behind another character, so a text falls into independent segments at
space marks (and at line feeds, where no piece holds one), and the lattice of a text is the chain of its
segments' lattices.  Forward Viterbi runs over all new segments of a slice at once and keeps the two best
scores of every node.  A text's N best segmentations differ from the best one only inside the N - 1
occurrences whose second-best score is closest to their best: each of those gives, by a single change, an
alternative at least as good as any change elsewhere.  Backward A* runs over the chain of just these
segments, with the forward scores as exact heuristic.

Ties: of equal scores the segmentation whose pieces, read from the end, are shorter comes first.
Characters without a piece (the space mark itself too, when it stands in a text) become byte pieces, so
that decoding gives back every text.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from reelscope.llm.common import Memo, map_texts, ragged

MARK = "▁"
#: Stand-ins that no text can hold: a literal mark, and a border between segments.
LITERAL, BORDER = "\udc81", "\udc00"
#: Fixed value: how far an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0
LONG = 64
PRIME = np.uint64(0x100000001B3)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
SIEVE_BITS = 20


def folded(h: np.ndarray) -> np.ndarray:
    """Well-spread slots of the sieve."""
    return (h * SPREAD) >> np.uint64(64 - SIEVE_BITS)


class Paths:
    """Lists of steps that share their beginnings, as a tree: four numbers for each list (0: the empty one).

    A node's jump leads far up; its depth depends on the node's depth alone, so two nodes are compared in logarithmic time.
    """

    def __init__(self) -> None:
        self.parent, self.step, self.depth, self.jump = (array("q", [0]) for _ in range(4))

    def add(self, path: int, step: int) -> int:
        """``path`` with another step."""
        near, depth = self.jump[path], self.depth
        far = self.jump[near]
        self.jump.append(far if path and depth[path] - depth[near] == depth[near] - depth[far] else path)
        self.parent.append(path)
        self.step.append(step)
        depth.append(depth[path] + 1)
        return len(depth) - 1

    def _up(self, path: int, depth: int) -> int:
        while self.depth[path] > depth:
            far = self.jump[path]
            path = far if self.depth[far] >= depth else self.parent[path]
        return path

    def before(self, a: int, b: int) -> bool:
        """Whether list a comes before list b in the order of their steps; a beginning comes before the whole."""
        level = min(self.depth[a], self.depth[b])
        x, y = self._up(a, level), self._up(b, level)
        if x == y:
            return self.depth[a] < self.depth[b]
        while self.parent[x] != self.parent[y]:
            x, y = (self.jump[x], self.jump[y]) if self.jump[x] != self.jump[y] else (self.parent[x], self.parent[y])
        return self.step[x] < self.step[y]

    def steps(self, path: int) -> list[int]:
        """The steps, last first."""
        out = []
        while path:
            out.append(self.step[path])
            path = self.parent[path]
        return out


class PieceModel:
    """Pieces, scores and ids of a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = []
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i):
                self.raw.append(b"")
            else:
                self.ids[piece] = i
                self.scores[piece] = lib.get_score(i)
                self.raw.append(piece.replace(MARK, " ").encode())
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark behind another character")
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = min((s for p, s in self.scores.items() if p.strip(MARK)), default=0.0) - UNKNOWN_PENALTY
        self.split_lines = not any("\n" in p for p in self.ids)
        names = sorted(self.ids)
        keys = np.array([self._hash(p) for p in names], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        self.key_ids = np.array([self.ids[names[i]] for i in order], np.int64)
        self.key_scores = np.array([self.scores[names[i]] for i in order])
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[folded(self.keys)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h ^ ord(c)) * int(PRIME) + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return h

    def segments(self, text: str | None) -> list[str]:
        if not text:
            return []
        s = (MARK + text.replace(MARK, LITERAL)).replace(" ", BORDER + MARK)
        if self.split_lines:
            s = s.replace("\n", f"{BORDER}\n{BORDER}")
        while MARK + BORDER + MARK in s:
            s = s.replace(MARK + BORDER + MARK, MARK + MARK)
        return s.split(BORDER)

    def char_ids(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in (MARK if c == LITERAL else c).encode("utf-8", "surrogatepass")]

    def ends(self, segment: str, j: int) -> list[tuple[int, float]]:
        """The (length, score) of the pieces that end at node j (above 0), shortest first."""
        out = []
        for n in range(1, min(j, self.longest) + 1):
            score = self.scores.get(segment[j - n : j])
            if score is not None:
                out.append((n, score))
            elif n == 1:
                out.append((1, self.unknown))
        return out

    def arcs(self, segment: str) -> list[list[tuple[int, float]]]:
        """For every node, the (length, score) of the pieces that end there, shortest first."""
        return [[], *(self.ends(segment, j) for j in range(1, len(segment) + 1))]

    def forward(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Best and second-best score of each segment (-inf if there is no second), and the ids of the best."""
        best, second = np.zeros(len(segments)), np.full(len(segments), -np.inf)
        ids: list = [np.zeros(0, np.int64)] * len(segments)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        for i in np.flatnonzero(sizes > LONG).tolist():
            best[i], second[i], ids[i] = self._forward_one(segments[i])
        short = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        for at in range(0, len(short), 32768):
            part = short[at : at + 32768]
            part = part[np.argsort(-sizes[part], kind="stable")]
            self._forward_many([segments[i] for i in part], sizes[part], part, best, second, ids)
        return best, second, ids

    def _forward_one(self, segment: str) -> tuple[float, float, np.ndarray]:
        one, two, back = [0.0], [float("-inf")], [0]
        for j in range(1, len(segment) + 1):
            into = self.ends(segment, j)
            a = b = float("-inf")
            step = 1
            for n, score in into:
                x, y = one[j - n] + score, two[j - n] + score
                if x > a:
                    a, b, step = x, max(a, b, y), n
                else:
                    b = max(b, x, y)
            one.append(a)
            two.append(b)
            back.append(step)
        lengths, j = [], len(segment)
        while j:
            lengths.append(back[j])
            j -= back[j]
        return one[-1], two[-1], np.array(self.path_ids(segment, lengths[::-1]), np.int64)

    def path_ids(self, segment: str, lengths: list[int]) -> list[int]:
        out, at = [], 0
        for n in lengths:
            piece = segment[at : at + n]
            out += [self.ids[piece]] if piece in self.ids else self.char_ids(piece)
            at += n
        return out

    def _forward_many(self, segments: list[str], sizes: np.ndarray, where: np.ndarray, best: np.ndarray, second: np.ndarray, ids: list) -> None:
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        total, longest = len(codes), min(self.longest, int(sizes[0]))
        starts = np.cumsum(sizes) - sizes
        room = np.repeat(starts + sizes, sizes) - np.arange(total)
        score = np.full((longest, total), -np.inf)
        piece = np.full((longest, total), -1, np.int64)
        h = np.zeros(total, np.uint64)
        for n in range(1, longest + 1):
            h = h[: total - n + 1]
            c = codes[n - 1 :]
            h = (h ^ c) * PRIME + c
            at = np.flatnonzero(self.sieve[folded(h)] & (room[: len(h)] >= n))
            found = np.searchsorted(self.keys, h[at])
            found[found == len(self.keys)] = 0
            hit = self.keys[found] == h[at]
            score[n - 1, at[hit]] = self.key_scores[found[hit]]
            piece[n - 1, at[hit]] = self.key_ids[found[hit]]
        unknown = piece[0] < 0
        score[0, unknown] = self.unknown
        width = int(sizes[0]) + 1
        one, two = np.full((width, len(segments)), -np.inf), np.full((width, len(segments)), -np.inf)
        back = np.zeros((width, len(segments)), np.int8)
        one[0] = 0.0
        for j in range(1, width):
            live = int(np.searchsorted(-sizes, -j, side="right"))
            a, b, step = np.full(live, -np.inf), np.full(live, -np.inf), np.zeros(live, np.int8)
            for n in range(1, min(j, longest) + 1):
                s = score[n - 1, starts[:live] + j - n]
                x, y = one[j - n, :live] + s, two[j - n, :live] + s
                b = np.maximum(np.maximum(b, y), np.minimum(a, x))
                better = x > a
                step[better] = n
                a = np.where(better, x, a)
            one[j, :live], two[j, :live], back[j, :live] = a, b, step
        columns = np.arange(len(segments))
        best[where], second[where] = one[sizes, columns], two[sizes, columns]
        at, live = sizes.copy(), columns
        owners, found = [], []
        while len(live):
            n = back[at[live], live].astype(np.int64)
            at[live] -= n
            place = starts[live] + at[live]
            owners.append(live)
            found.append(np.where(piece[n - 1, place] < 0, -1 - place, piece[n - 1, place]))
            live = live[at[live] > 0]
        owner = np.concatenate(owners[::-1])
        value = np.concatenate(found[::-1])
        order = np.argsort(owner, kind="stable")
        owner, value = owner[order], value[order]
        cuts = np.searchsorted(owner, np.arange(len(segments) + 1))
        odd = set(owner[value < 0].tolist())
        for k, i in enumerate(where.tolist()):
            own = value[cuts[k] : cuts[k + 1]]
            if k in odd:
                text = segments[k]
                own = np.array([v for x in own.tolist() for v in (self.char_ids(text[-1 - x - starts[k]]) if x < 0 else [x])], np.int64)
            ids[i] = own

    def n_best(self, segments: list[str], n: int, remembered: dict | None = None) -> list[tuple[float, list[list[int]]]]:
        """The n best segmentations of a chain of segments, best first: (score, piece lengths per segment).

        Backward A*: a state is a node with the path from it to the end; its priority adds the path's score
        to the forward score of the node, which is exact, so every open state stands for a whole path of its
        own with that score.  No more states than paths are wanted need to stay open, and what is kept grows
        with the length of the paths.  Arcs of long segments are found again where needed.
        """
        into: list = [[]]
        borders: list[tuple[str, int]] = []
        for s in segments:
            if len(s) > LONG:
                into += [len(borders)] * len(s)
                borders.append((s, len(into) - 1 - len(s)))
                continue
            arcs = self.arcs(s) if remembered is None else remembered.get(s)
            if arcs is None:
                if len(remembered) > 50_000:
                    remembered.clear()
                arcs = remembered[s] = self.arcs(s)
            into += arcs[1:]

        def arcs_at(j: int) -> list[tuple[int, float]]:
            found = into[j]
            if isinstance(found, int):
                segment, start = borders[found]
                return self.ends(segment, j - start)
            return found

        forward = [0.0]
        for j in range(1, len(into)):
            forward.append(max(forward[j - n_] + s for n_, s in arcs_at(j)))
        end = len(into) - 1
        paths = Paths()
        live = [(-forward[end], 0, end, 0.0)]
        out = []
        while live and len(out) < n:
            cost, path, at, behind = live.pop(0)
            if at == 0:
                out.append((-cost, self._per_segment(segments, paths.steps(path))))
                continue
            for step, s in arcs_at(at):
                g = behind + s
                c = -(g + forward[at - step])
                room = len(live) < n - len(out)
                if not room and c > live[-1][0]:
                    continue
                new = paths.add(path, step)
                i = len(live)
                while i and (c < live[i - 1][0] or (c == live[i - 1][0] and paths.before(new, live[i - 1][1]))):
                    i -= 1
                live.insert(i, (c, new, at - step, g))
                del live[n - len(out) :]
        return out

    @staticmethod
    def _per_segment(segments: list[str], lengths: list[int]) -> list[list[int]]:
        out, it = [], iter(lengths)
        for s in segments:
            own, left = [], len(s)
            while left:
                own.append(next(it))
                left -= own[-1]
            out.append(own)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of a list of ids; byte pieces are joined before they are read as UTF-8."""
        raw = self.raw
        joined = b"".join([raw[i] for i in ids])
        return joined[joined.startswith(b" ") :].decode("utf-8", "replace")


#: A worker process keeps its models, with what they remember, from task to task.
_MODELS: dict[str, tuple] = {}


def encoder(path: str, n: int, parts: tuple[str, ...], most_remembered: int = 200_000):
    """Task-side function for ``encode``."""

    def make():
        model, state, arcs = _MODELS.setdefault(path, (None, {}, {}))
        if model is None:
            model = PieceModel(path)
            _MODELS[path] = (model, state, arcs)

        def reset() -> None:
            state.update(memo=Memo(), pool=np.zeros(0, np.int32), starts=np.zeros(0, np.int64), sizes=np.zeros(0, np.int64), best=np.zeros(0), gap=np.zeros(0))

        def learn() -> None:
            new, state["memo"].new = state["memo"].new, []
            if not new:
                return
            best, second, ids = model.forward(new)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            state["starts"] = np.r_[state["starts"], len(state["pool"]) + np.cumsum(sizes) - sizes]
            state["sizes"] = np.r_[state["sizes"], sizes]
            state["pool"] = np.r_[state["pool"], np.concatenate(ids).astype(np.int32)]
            state["best"], state["gap"] = np.r_[state["best"], best], np.r_[state["gap"], best - second]

        def one(text: str | None, segments: list[str], at: np.ndarray) -> dict:
            ids = ragged(state["pool"], state["starts"][at], state["sizes"][at])
            total = float(state["best"][at].sum())
            row = {"n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()), "score": total}
            if "ids" in parts:
                row["ids"] = ids
            if "nbest_scores" in parts:
                gaps = state["gap"][at]
                near = np.argsort(gaps, kind="stable")[: n - 1] if len(gaps) < 64 else closest(gaps, n - 1)
                near = np.sort(near[np.isfinite(gaps[near])])
                chain = [segments[i] for i in near.tolist()]
                found = model.n_best(chain, n, arcs) if chain else [(0.0, [])]
                row["nbest_scores"] = [total + (s - found[0][0]) for s, _ in found]
                if "nbest_ids_crc32" in parts:
                    row["nbest_ids_crc32"] = []
                    cuts = np.r_[0, np.cumsum(state["sizes"][at])]
                    for _, lengths in found:
                        whole, last = [], 0
                        for i, own in zip(near.tolist(), lengths):
                            whole += [ids[last : cuts[i]], np.array(model.path_ids(segments[i], own), np.int32)]
                            last = cuts[i + 1]
                        whole.append(ids[last:])
                        row["nbest_ids_crc32"].append(zlib.crc32(np.concatenate(whole).astype("<u4").tobytes()))
            if "round_trip" in parts:
                row["round_trip"] = model.decode(ids.tolist()) == (text or "")
            return row

        def work(texts: list) -> dict[str, pa.Array]:
            if not state or len(state["memo"]) > most_remembered:
                reset()
            cut = [model.segments(t) for t in texts]
            at = [np.fromiter(map(state["memo"].__getitem__, s), np.int64, len(s)) for s in cut]
            learn()
            rows = [one(*x) for x in zip(texts, cut, at)]
            return {name: pa.array([r[name] for r in rows], KINDS[name]) for name in parts}

        return work

    return make


def closest(gaps: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest gaps, ties to the earlier position."""
    limit = np.partition(gaps, k - 1)[k - 1]
    below = np.flatnonzero(gaps < limit)
    return np.r_[below, np.flatnonzero(gaps == limit)[: k - len(below)]]


KINDS = {
    "ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_crc32": pa.int64(), "score": pa.float64(), "nbest_scores": pa.list_(pa.float64()),
    "nbest_ids_crc32": pa.list_(pa.int64()), "round_trip": pa.bool_(),
}
DDL = {
    "ids": "array<int>", "n_tokens": "bigint", "ids_crc32": "bigint", "score": "double", "nbest_scores": "array<double>",
    "nbest_ids_crc32": "array<bigint>", "round_trip": "boolean",
}


def encode(docs: DataFrame, path: str, text: str = "text", n: int = 4, parts: tuple[str, ...] = ("ids", "n_tokens", "score"), keep: list[str] | None = None) -> DataFrame:
    """Add the chosen ``parts`` for every whole text: ids of the best segmentation, their number, CRC-32 and score;
    the scores and CRC-32 of the n best whole-text segmentations; whether decoding gives the text back.

    Null and empty texts have no pieces, one (empty) segmentation of score 0 and decode to the empty text.
    """
    if n < 2:
        raise ValueError("n counts the best segmentation and at least one other")
    return map_texts(docs, text, encoder(path, n, parts), ", ".join(f"{p} {DDL[p]}" for p in parts), keep)


def decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of each list of ids (null: empty)."""
    kept = [c for c in tokens.columns if c != out]
    source = tokens.select(*[F.col(f"`{c}`") for c in kept])
    kind = StructType([*source.schema.fields, StructField(out, StringType())])
    where = kept.index(ids)

    def run(batches):
        model = (_MODELS.get(path) or (PieceModel(path),))[0]
        for b in batches:
            texts = [model.decode(i or []) for i in b.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*kept, out])

    return source.mapInArrow(run, kind)
