"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch's distinct unseen words lie in one flat numpy array of symbols. Each round finds every word's smallest pair
rank by a segmented minimum, merges all leftmost occurrences of that pair at once and compacts; words without a pair
leave. Words are cut where no piece of the vocabulary can reach across, so their merges don't depend on each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakequill.llm.common import column, text_of

SPACE = "▁"
NEVER = np.int64(1) << 62
#: Words that a task remembers; it starts anew beyond that.
REMEMBERED = 400_000


class Vocabulary:
    """Pieces, ranks and the table of pairs that merge, read from a model file of the sentencepiece library."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != trainer.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with the identity normaliser and escaped white space as prefix are covered")
        kind = model.SentencePiece
        self.dummy_prefix = spec.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        if any(p.type == kind.USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined symbols are not covered")
        self.eos = next(i for i, p in enumerate(model.pieces) if p.piece == "</s>")
        self.unk = next(i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN)
        self.unk_surface = trainer.unk_surface or " ⁇ "
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kind.NORMAL, kind.UNUSED)}
        self.n = len(self.pieces)
        order = sorted(normal.values(), key=lambda i: (-model.pieces[i].score, i))
        self.rank = np.full(self.n, NEVER, np.int64)
        self.rank[order] = np.arange(len(order))
        pairs = {normal[p[:k]] * self.n + normal[p[k:]]: i for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        single = sorted((ord(p), i) for p, i in normal.items() if len(p) == 1)
        self.chars, self.char_ids = (np.array(x, np.int64) for x in zip(*single, strict=True))
        self.bigrams = np.array(sorted({ord(a) << 21 | ord(b) for p in normal for a, b in zip(p, p[1:])}), np.int64)
        inner = {c for p in normal for c in p[1:]} | {p[0] for p in normal if len(p) > 1}
        lone = "".join(c for c in "\n\t\r" if c not in inner)  # a character that no longer piece holds is a word by itself
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces reach across words")
        self.word = re.compile(f"{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+" + (f"|[{lone}]" if lone else ""))
        self.surface = [("" if p.type == kind.CONTROL else self.unk_surface if p.type == kind.UNKNOWN else p.piece.replace(SPACE, " ")) for p in model.pieces]
        self.known: dict[str, bytes] = {}

    def _find(self, keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def merge_words(self, words: Sequence[str]) -> list[bytes]:
        """The ids of each word as bytes of int32."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.zeros(len(code), bool)
        starts[np.cumsum(lengths)[:-1][lengths[1:] > 0]] = True
        starts[:1] = True
        starts[1:] |= ~self._find(code[:-1] << 21 | code[1:], self.bigrams)[1]  # no piece holds the two: nothing merges across
        at, hit = self._find(code, self.chars)
        sym, pos = np.where(hit, self.char_ids[at], -1), np.arange(len(code))
        done_sym, done_pos = [], []
        while len(sym):
            joint = ~starts[1:] & (sym[:-1] >= 0) & (sym[1:] >= 0)
            at, hit = self._find(np.where(joint, sym[:-1] * self.n + sym[1:], -1), self.pair_keys)
            merged = self.pair_ids[at]
            rank = np.full(len(sym), NEVER, np.int64)
            rank[:-1][hit] = self.rank[merged[hit]]
            first = np.flatnonzero(starts)
            least = np.minimum.reduceat(rank, first)
            seg = np.cumsum(starts) - 1
            live = least[seg] < NEVER
            if not live.all():
                done_sym.append(sym[~live])
                done_pos.append(pos[~live])
            pick = live & (rank == least[seg])
            run = pick.copy()
            run[1:] &= pick[:-1]
            where = np.arange(len(pick))
            begin = np.maximum.accumulate(np.where(pick & ~run, where, 0))
            pick &= (where - begin) % 2 == 0  # leftmost first where occurrences overlap
            sym = sym.copy()
            sym[:-1][pick[:-1]] = merged[pick[:-1]]
            keep = live.copy()
            keep[1:] &= ~pick[:-1]
            sym, pos, starts = sym[keep], pos[keep], starts[keep]
        sym, pos = np.concatenate(done_sym or [sym]), np.concatenate(done_pos or [pos])
        order = np.argsort(pos)
        sym, pos = sym[order], pos[order]
        cut = np.concatenate([[0], np.searchsorted(pos, np.cumsum(lengths))])
        flat = sym.astype(np.int32).tobytes()
        edges = (4 * cut).tolist()
        out = [flat[low:high] for low, high in zip(edges, edges[1:])]
        bare = np.flatnonzero(sym < 0)  # characters without a piece become byte pieces
        for w in np.unique(np.searchsorted(cut, bare, "right") - 1).tolist():
            low, high = cut[w], cut[w + 1]
            ids = [x for s, p in zip(sym[low:high].tolist(), pos[low:high].tolist()) for x in ([s] if s >= 0 else self._bytes(int(code[p])))]
            out[w] = np.array(ids, np.int32).tobytes()
        return out

    def _bytes(self, code: int) -> list[int]:
        if not self.byte_id:
            return [self.unk]
        return [self.byte_id[b] for b in chr(code).encode("utf-8")]

    def encode_batch(self, texts: Sequence[str | None]) -> list[bytes]:
        """Each text's ids as bytes of int32, the end id last."""
        split = []
        for text in texts:
            text = (text or "").replace(" ", SPACE)
            split.append(self.word.findall(SPACE + text if text and self.dummy_prefix else text))
        known, end = self.known, np.int32(self.eos).tobytes()
        if len(known) > REMEMBERED:
            known.clear()
        fresh = list({w for words in split for w in words if w not in known})
        for low in range(0, len(fresh), 50_000):
            part = fresh[low : low + 50_000]
            known.update(zip(part, self.merge_words(part), strict=True))
        return [b"".join([known[w] for w in words]) + end for words in split]

    def decode(self, ids: Sequence[int]) -> str:
        """As the library's decode: control ids vanish, runs of byte pieces are UTF-8, one blank of the dummy prefix goes."""
        surface, byte_of = self.surface, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            text = "".join([surface[i] for i in ids])
        else:
            parts, held = [], bytearray()
            for i in ids:
                if i in byte_of:
                    held.append(byte_of[i])
                    continue
                if held:
                    parts.append(_utf8(bytes(held)))
                    held.clear()
                parts.append(surface[i])
            text = "".join(parts) + _utf8(bytes(held))
        if self.dummy_prefix and text.startswith(" "):
            first = next((i for i in ids if surface[i]), None)
            if first is not None and first not in byte_of and first != self.unk:
                text = text[1:]
        return text


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode("utf-8"))
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker."""
    return Vocabulary(path)


def _slices(source: Iterator[pa.RecordBatch], texts_at: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds a bounded number of text bytes, or one text."""
    for got in source:
        sizes = np.fromiter((len(t) if t else 0 for t in got.column(texts_at).to_pylist()), np.int64, got.num_rows)
        low, size = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > low and size + n > most:
                yield got.slice(low, i - low)
                low, size = i, 0
            size += n
        if low < got.num_rows:
            yield got.slice(low)


def _tokens(path: str, decoded: bool) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for got in _slices(source, 1):
            raw = vocab.encode_batch(got.column(1).to_pylist())
            ids = [np.frombuffer(r, np.int32) for r in raw]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
            out = {"id": got.column(0), "ids": lists}
            if decoded:
                out["decoded"] = pa.array([vocab.decode(x.tolist()) for x in ids], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>[, decoded string]) for each row of docs, the end id last; decoded is decode(ids).

    A null text is empty and gives the end id alone; texts of any length are taken whole; repeated rows give repeated
    rows; an empty table an empty result. model_path must exist on every worker.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(column(docs, id_col).alias("id"), text_of(column(docs, text_col)).alias("text"))
    return narrow.mapInArrow(_tokens(model_path, decoded), f"id {kind}, ids array<int>" + ", decoded string" * decoded).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for each row of tokens; a null list gives an empty text."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)
        for got in source:
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array([vocab.decode(x or []) for x in got.column(1).to_pylist()], pa.string())], ["id", "text"])

    return tokens.select(column(tokens, id_col).alias("id"), column(tokens, ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
