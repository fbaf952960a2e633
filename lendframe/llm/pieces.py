"""SentencePiece encoding with seeded merge-dropout, and decoding.

A byte-pair model merges the best-scored pair of neighbours first, leftmost on
ties. Here every candidate merge is skipped if a keyed hash of the seed, the
document's id, the chunk's position in the document and the candidate's place falls below the dropout rate, so every
occurrence of a word has its own draw. A candidate is fixed by the span of its two halves, so a skip when it leaves
the agenda is the same as a skip whenever it is looked at. That lets the agendas of all chunks of a batch be worked off together, one merge per chunk and
round, in numpy; long chunks use a heap of their own. Both give the same pieces.

Texts are cut into chunks wherever two characters meet that no piece of the model has side by side, so that no
merge crosses a cut. Across documents only the plain merges of a chunk are remembered, which no draw changes: an occurrence
that skips none of them has the plain pieces, any other is merged on its own. The memory is bounded and only saves time.
Characters outside the vocabulary become byte pieces. Decoding any segmentation gives back the text exactly.

Defined results: null and empty texts have no pieces and decode to the empty text. The mark
character itself (U+2581) is written as bytes. Repeated rows get equal pieces; without an
id the text takes its place in the draw. Columns of the input that have the name of
a result column are replaced. Bytes that are not valid UTF-8 become replacement characters. A very long text is worked off in
slices of its chunks. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import os

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T

from lendframe.llm.common import annotate

MODEL = os.path.join(os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")
MARK = "▁"
HELD_MARK = "\udc81"  # stands for a mark that is part of the text; no valid text has it
RATE, SEED = 0.1, 17
LONGEST = 48  # characters of a chunk that is merged in the common rounds
WIDTHS = (4, 6, 9, 13, 20, 32, LONGEST)
REMEMBERED = 300_000  # chunks
CHUNKS = 50_000  # chunks segmented together
SLICE = 1_000_000  # characters worked on together
GONE = np.int32(-1)


class Pieces:
    """Vocabulary of one byte-pair model."""

    def __init__(self, path: str = MODEL):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        scores = [sp.get_score(i) for i in range(self.size)]
        plain = {}
        self.byte = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = []
        for i, p in enumerate(names):
            if sp.is_byte(i):
                b = int(p[3:5], 16)
                self.byte[b] = i
                self.bytes_of.append(bytes([b]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                plain[p] = i
                self.bytes_of.append(p.replace(MARK, " ").encode())
        self.plain = plain
        pairs = sorted((plain[p[:k]] * self.size + plain[p[k:]], i) for p, i in plain.items()
                       for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain)
        self.pair = np.array([k for k, _ in pairs], np.int64)
        self.merged = np.array([i for _, i in pairs], np.int64)
        self.score = np.array(scores)
        _, self.rank = np.unique(self.score, return_inverse=True)  # equal scores stay equal
        self.rank = self.rank.astype(np.int32)
        self.id_of = np.full(0x110000, -2, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.id_of[ord(p)] = i
        joined = {(a, b) for p in plain for a, b in zip(p, p[1:])}
        letters = sorted({c for ab in joined for c in ab})
        self.letter = np.zeros(0x110000, np.uint16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.n_letters = len(letters) + 1
        self.joins = np.zeros(self.n_letters * self.n_letters, bool)
        at = {c: i for i, c in enumerate(letters, 1)}
        self.joins[[at[a] * self.n_letters + at[b] for a, b in joined]] = True

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """Where a chunk begins: no piece has this character and the one before side by side."""
        k = self.letter[codes].astype(np.int32)
        out = np.ones(len(codes), bool)
        out[1:] = ~self.joins[k[:-1] * self.n_letters + k[1:]]
        return out

    def as_bytes(self, code: int) -> list[int]:
        """Byte pieces of one character."""
        c = MARK if code == ord(HELD_MARK) else chr(code)
        return self.byte[list(c.encode("utf-8", "surrogatepass"))].tolist()

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged id and rank of its score for pairs; rank -1 where there is no such piece."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        ok = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        m = np.where(ok, self.merged[at], -1).astype(np.int32)
        return m, np.where(ok, self.rank[m], GONE)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunk_keys(codes: np.ndarray, starts: np.ndarray, salts: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit key of each chunk's characters, salt and seed; chunks lie end to end in ``codes``."""
    with np.errstate(over="ignore"):
        place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
        x = _mix((codes.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + np.uint64(seed % (1 << 31)))
        return _mix(np.add.reduceat(x, starts) + salts.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def spans(start, mid, stop) -> np.ndarray:
    """A number for the candidate that joins [start, mid) and [mid, stop)."""
    with np.errstate(over="ignore"):
        return (np.asarray(start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                ^ np.asarray(mid).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                ^ np.asarray(stop).astype(np.uint64) * np.uint64(0x165667B19E3779F9))


def dropped(key: np.ndarray, span: np.ndarray, rate: float) -> np.ndarray:
    """Whether the draw ``key`` drops the candidate of that number."""
    with np.errstate(over="ignore"):
        return (_mix(_mix(key + span)) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 < rate


def skipped(key: np.ndarray, start, mid, stop, rate: float) -> np.ndarray:
    """Whether the candidate that joins [start, mid) and [mid, stop) is dropped."""
    return dropped(key, spans(start, mid, stop), rate)


def document_draw(doc: object, text: str, seed: int) -> int:
    """A 64-bit key of a document's draws: by its id, or by its text where the id is null."""
    name = f"{seed}/{doc}" if doc is not None else f"{seed}//{text}"
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _places(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices of runs of ``n`` elements from ``at``, end to end."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Segmenter:
    """Segments texts; remembers the plain merges and pieces of a bounded number of chunks."""

    def __init__(self, pieces: Pieces, rate: float = RATE, seed: int = SEED):
        self.p, self.rate, self.seed = pieces, rate, seed
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.merge_at, self.merge_n, self.merges = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def by_heap(self, codes: np.ndarray, key: np.uint64 | None) -> list[int]:
        """The agenda of one chunk: best score first, then leftmost. Without a key nothing is skipped."""
        p = self.p
        ids = p.id_of[codes].tolist()
        n = len(ids)
        nxt, prv, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap: list[tuple] = []
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def offer(pairs: list[tuple[int, int]]) -> None:
            for a, b in pairs:
                if ids[a] < 0 or ids[b] < 0:
                    continue
                if (ids[a], ids[b]) not in known:
                    m, s = p.look_up(np.array([ids[a]]), np.array([ids[b]]))
                    known[ids[a], ids[b]] = int(m[0]), int(s[0])
                m, s = known[ids[a], ids[b]]
                if m >= 0:
                    heapq.heappush(heap, (-s, a, b, stop[b], m))
        offer([(i, i + 1) for i in range(n - 1)])
        while heap:
            _, a, b, end, m = heapq.heappop(heap)
            if not (alive[a] and alive[b]) or nxt[a] != b or stop[b] != end or stop[a] != b:
                continue
            if key is not None and self.rate > 0 and skipped(key, a, b, end, self.rate):
                continue
            ids[a], stop[a], alive[b], nxt[a] = m, end, False, nxt[b]
            if nxt[a] < n:
                prv[nxt[a]] = a
            offer(([(prv[a], a)] if prv[a] >= 0 else []) + ([(a, nxt[a])] if nxt[a] < n else []))
        out: list[int] = []
        for i in range(n):
            if alive[i]:
                out += [ids[i]] if ids[i] >= 0 else p.as_bytes(int(codes[i]))
        return out

    def in_rounds(self, codes: np.ndarray, starts: np.ndarray, size: np.ndarray, key: np.ndarray | None,
                  made: list[tuple[np.ndarray, np.ndarray]] | None = None):
        """The agendas of many short chunks together: each round does the next merge of every chunk.

        Without keys nothing is skipped. ``made`` gets the chunks and numbers of the merges of each round.
        Returns the pieces end to end and their number per chunk.
        """
        draws = key is not None and self.rate > 0
        key = key if draws else np.zeros(len(starts), np.uint64)
        n, width = len(starts), int(size.max())
        filled = np.arange(width) < size[:, None]
        chars = codes[np.minimum(starts[:, None] + np.arange(width), len(codes) - 1)]
        ids = np.where(filled, self.p.id_of[chars], -1).astype(np.int32)
        at = np.minimum(np.arange(width + 1, dtype=np.int32), size[:, None].astype(np.int32))
        done_ids, done_at, left = ids.copy(), at.copy(), size.copy()
        rows = np.arange(n)
        merged, rank = self._offers(ids[:, :-1], ids[:, 1:], key[:, None], at[:, :-2], at[:, 1:-1], at[:, 2:], draws)
        while rank.shape[1]:
            best = rank.argmax(axis=1)
            live = rank[np.arange(len(rows)), best] != GONE
            if not live.all():
                ended = rows[~live]
                done_ids[ended, :ids.shape[1]], done_at[ended, :at.shape[1]] = ids[~live], at[~live]
                ids, at, key, rows, best = ids[live], at[live], key[live], rows[live], best[live]
                merged, rank = merged[live], rank[live]
            if not len(rows):
                break
            i = np.arange(len(rows))
            if made is not None:
                made.append((rows, spans(at[i, best], at[i, best + 1], at[i, best + 2])))
            ids[i, best] = merged[i, best]
            left[rows] -= 1
            ids, at = _without(ids, best + 1), _without(at, best + 1)
            merged, rank = _without(merged, best), _without(rank, best)
            for shift in (-1, 0):  # the offers on either side of the new piece are new
                j = best + shift
                ok = np.flatnonzero((j >= 0) & (j < rank.shape[1]))
                c = j[ok]
                merged[ok, c], rank[ok, c] = self._offers(ids[ok, c], ids[ok, c + 1], key[ok], at[ok, c], at[ok, c + 1],
                                                          at[ok, c + 2], draws)
        if len(rows):
            done_ids[rows, :ids.shape[1]], done_at[rows, :at.shape[1]] = ids, at
        used = np.arange(width) < left[:, None]
        flat = done_ids[used]
        if (flat >= 0).all():
            return flat, left
        row = np.repeat(np.arange(n), left)
        unknown = np.flatnonzero(flat < 0)
        kinds, kind = np.unique(codes[starts[row[unknown]] + done_at[:, :width][used][unknown]], return_inverse=True)
        spelled = [self.p.as_bytes(int(c)) for c in kinds]
        long = np.array([len(b) for b in spelled])[kind]
        reps = np.ones(len(flat), np.int64)
        reps[unknown] = long
        out = np.repeat(flat, reps)
        place = (np.cumsum(reps) - reps)[unknown]
        table = np.array([b + [0] * (4 - len(b)) for b in spelled], np.int32)[kind]
        for j in range(4):
            ok = long > j
            out[place[ok] + j] = table[ok, j]
        return out, np.bincount(row, reps, n).astype(np.int64)

    def _offers(self, a, b, key, start, mid, stop, draws: bool):
        """Candidate merges: piece and rank, without those that the dropout skips."""
        m, s = self.p.look_up(a, b)
        if draws:
            s[skipped(key, start, mid, stop, self.rate)] = GONE
        return m, s

    def _segment(self, codes, starts, size, key, made=None):
        """Pieces of chunks, end to end in another order, and where those of each chunk begin and how many they are."""
        order = np.argsort(size, kind="stable")
        ranked, flat, ns, lo = size[order], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        for width in WIDTHS:
            hi = int(np.searchsorted(ranked, width, "right"))
            for i in range(lo, hi, CHUNKS):
                o = order[i:min(i + CHUNKS, hi)]
                rounds = None if made is None else []
                f, n = self.in_rounds(codes, starts[o], size[o], None if key is None else key[o], rounds)
                flat.append(f)
                ns.append(n)
                if made is not None:
                    made += [(o[rows], span) for rows, span in rounds]
            lo = max(lo, hi)
        for i in order[lo:].tolist():
            f = self.by_heap(codes[starts[i]:starts[i] + size[i]], None if key is None else key[i])
            flat.append(np.array(f, np.int32))
            ns.append(np.array([len(f)]))
        n, at = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        n[order] = np.concatenate(ns)
        at[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate(flat), at, n

    def _learn(self, codes, starts, size, key) -> None:
        """Segment chunks that memory lacks without dropout and add them with their merges."""
        made: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        flat, at, n = self._segment(codes, starts, size, None, made)
        chunk, span = (np.concatenate(x) for x in zip(*made, strict=True))
        merge_n = np.bincount(chunk, minlength=len(size)).astype(np.int64)
        merge_at = len(self.merges) + np.cumsum(merge_n) - merge_n
        o = np.argsort(keys := np.concatenate((self.keys, key)))
        self.keys = keys[o]
        self.at, self.n = np.concatenate((self.at, len(self.flat) + at))[o], np.concatenate((self.n, n))[o]
        self.merge_at, self.merge_n = np.concatenate((self.merge_at, merge_at))[o], np.concatenate((self.merge_n, merge_n))[o]
        self.flat = np.concatenate((self.flat, flat))
        self.merges = np.concatenate((self.merges, span[np.argsort(chunk, kind="stable")]))

    def _plain(self, codes, starts, size, key) -> np.ndarray:
        """Where memory has the chunks of these keys; those that it lacks are learnt."""
        key, first, at = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self._forget()
        i = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        new = self.keys[i] != key if len(self.keys) else np.ones(len(key), bool)
        if new.any():
            self._learn(codes, starts[first[new]], size[first[new]], key[new])
            i = np.searchsorted(self.keys, key)
        return i[at]

    def encode(self, texts: list[str], ids: list[int | None]) -> list[np.ndarray]:
        """Pieces of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        group: list[tuple[int, int, str]] = []
        held = 0
        draw = np.array([document_draw(i, t, self.seed) for i, t in zip(ids, texts, strict=True)], np.uint64)
        for d, t in enumerate(texts):
            for base, part in slices(marked(t)):
                group.append((d, base, part))
                held += len(part)
                if held >= SLICE:
                    self._encode_group(group, draw, out)
                    group, held = [], 0
        if group:
            self._encode_group(group, draw, out)
        empty = np.zeros(0, np.int32)
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else empty for p in out]

    def _encode_group(self, group, draw, out) -> None:
        codes = code_points("".join(p for _, _, p in group))
        edge = np.cumsum([0, *(len(p) for _, _, p in group)])
        cut = self.p.cuts(codes)
        cut[edge[:-1]] = True
        starts = np.flatnonzero(cut)
        size = np.diff(np.append(starts, len(codes)))
        part = np.searchsorted(edge, starts, "right") - 1
        with np.errstate(over="ignore"):
            base = np.array([b for _, b, _ in group], np.int64)
            place = (starts - edge[part] + base[part]).astype(np.uint64)
            key = _mix(draw[[d for d, _, _ in group]][part] + _mix(place + np.uint64(1)))
        own = np.ones(len(starts), bool)  # chunks that are merged for themselves
        at, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        short = np.flatnonzero((size <= LONGEST) | (self.rate <= 0))  # a longer one hardly ever skips nothing
        if len(short):
            characters = chunk_keys(codes, starts, np.zeros(len(starts), np.uint64), 0)
            i = self._plain(codes, starts[short], size[short], characters[short])
            own[short] = False
            if self.rate > 0:
                m = self.merge_n[i]
                drop = dropped(np.repeat(key[short], m), self.merges[_places(self.merge_at[i], m)], self.rate)
                own[np.repeat(short, m)[drop]] = True
            at[short], n[short] = self.at[i], self.n[i]
        o = np.flatnonzero(own)
        flat, own_at, n[o] = self._segment(codes, starts[o], size[o], key[o])
        at[o] = len(self.flat) + own_at
        flat = np.concatenate((self.flat, flat))[_places(at, n)]
        per = np.bincount(part, n, len(group)).astype(np.int64)
        for (d, _, _), p in zip(group, np.split(flat, np.cumsum(per)[:-1]), strict=True):
            out[d].append(p)

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 text of pieces; the mark that encoding puts in front goes again."""
        b = b"".join(map(self.p.bytes_of.__getitem__, ids))
        return b[1:] if b[:1] == b" " else b


def marked(text: str) -> str:
    """Marks for spaces and one mark in front; marks of the text itself are set apart. Empty stays empty."""
    if not text:
        return ""
    if MARK in text:
        text = text.replace(MARK, HELD_MARK)
    return MARK + text.replace(" ", MARK)


def slices(text: str) -> list[tuple[int, str]]:
    """Bounded parts of a marked text, cut before a mark that follows other text, where no piece crosses."""
    out, lo = [], 0
    while len(text) - lo > SLICE:
        hi = text.find(MARK, lo + SLICE)
        while hi > 0 and text[hi - 1] == MARK:
            hi = text.find(MARK, hi + 1)
        if hi < 0:
            break
        out.append((lo, text[lo:hi]))
        lo = hi
    if lo < len(text):
        out.append((lo, text[lo:]))
    return out


def _without(x: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Each row without the element in its column ``col``."""
    keep = np.arange(x.shape[1]) != col[:, None]
    return x[keep].reshape(len(x), x.shape[1] - 1)


FIELDS = [("n_pieces", T.LongType()), ("piece_ids", T.ArrayType(T.IntegerType())), ("lossless", T.BooleanType())]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
                     model: str = MODEL, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """Carried columns plus ``piece_ids``, their number, and whether decoding them gave the text back."""
    def start():
        seg = Segmenter(Pieces(model), rate, seed)

        def run(doc, text):
            texts = [x or "" for x in text.to_pylist()]
            raw = seg.encode(texts, doc.to_pylist())
            sizes = np.array([len(r) for r in raw], np.int64)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            same = [seg.decode(r.tolist()) == t.encode() for r, t in zip(raw, texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *raw])))
            return [pa.array(sizes), lists, pa.array(same, pa.bool_())]
        return run
    # the text is read under a name of its own, so that carried columns stay as they are
    carry = docs.columns if carry is None else carry
    name = "_" + "_".join(docs.columns)
    return annotate(docs.withColumn(name, F.make_valid_utf8(F.col(text_col))), [id_col, name], FIELDS, start, carry)


def decode_documents(encoded: DataFrame, carry: list[str], ids_col: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """Carried columns plus ``text``, decoded."""
    def start():
        seg = Segmenter(Pieces(model))
        return lambda ids: [[seg.decode(x or []).decode("utf-8", "replace") for x in ids.to_pylist()]]
    return annotate(encoded, [ids_col], [("text", T.StringType())], start, carry)
