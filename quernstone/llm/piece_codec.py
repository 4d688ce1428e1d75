"""Offset-preserving encoding with a SentencePiece BPE model, and its decoding.

Normalisation takes, at each place of a text, the longest prefix that the model's compiled character map (a double
array of byte transitions) holds, and else one character as it is. Each character of the result keeps the byte at
which its prefix began, so that every piece is projected back to a span of bytes of the original text. White space
is folded, escaped and given a prefix as the model says.

A piece can't reach over two neighbouring characters that stand side by side in no piece of the vocabulary, so that the
normalised text falls into stretches there that are merged each for itself: the pair of the best score first, of
equal ones the left one. Equal stretches are merged once, and the short ones of a batch side by side, a merge of each at a time. Characters without a piece become byte pieces, or
the unknown piece if the model has none; of byte pieces the last one has the span and those before it an empty one.

A null text counts as empty, and an empty one has no pieces. All texts are taken whole; a batch is cut by bytes inside
the tasks. Other columns stay as they are. The model's file is read by the driver and its bytes are broadcast (half a
megabyte for 32,000 pieces; ``MAX_MODEL`` at most). Models that are no BPE, or that have pieces defined by users or unused ones, are refused.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.bytewise import Texts, chunks
from quernstone.llm.store import small_batches

#: Bytes of a model file at most.
MAX_MODEL = 64 << 20
# Fixed values of the model format: how white space is written, and the kinds of models and pieces.
SPACE, MARK = 0x20, 0x2581
BPE = 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Places of the table of neighbouring characters. Two pairs may share one: then a stretch is longer than it need be.
PAIR_BITS = 20
#: Stretches up to these lengths are merged side by side, longer ones each for itself.
WIDTHS = (4, 8, 12, 18, 28, 48)
#: Stretches, and characters of them, that are remembered from batch to batch.
REMEMBERED, REMEMBERED_CHARS = 300_000, 6_000_000


#: The rank of what is no piece.
NEVER = (1 << 31) - 1


class CharMap:
    """The compiled character map: a double array over UTF-8 bytes whose values are places in a list of replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4) if size else np.zeros(0, np.uint32)
        self.replacements = blob[4 + size :]

    def __bool__(self) -> bool:
        return len(self.units) > 0

    def longest(self, data: np.ndarray, stop: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place in at: the bytes of the longest prefix that the map holds (0: none), and its value. All places
        go down the map at once; stop is the end of the text that a place lies in."""
        u, length, value = self.units, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        alive = np.arange(len(at))
        node = np.full(len(at), self._offset(u[:1])[0], np.int64)
        depth = 0
        while len(alive):
            inside = at[alive] + depth < stop[alive]
            alive, node = alive[inside], node[inside]
            byte = data[at[alive] + depth].astype(np.int64)
            node = node ^ byte
            unit = u[np.minimum(node, len(u) - 1)]
            ok = (node < len(u)) & ((unit & np.uint32(0x800000FF)) == byte)
            alive, node, unit = alive[ok], node[ok], unit[ok]
            node = node ^ self._offset(unit)
            depth += 1
            leaf = (unit >> np.uint32(8)) & np.uint32(1) == 1
            length[alive[leaf]] = depth
            value[alive[leaf]] = u[node[leaf]] & np.uint32(0x7FFFFFFF)
        return length, value

    @staticmethod
    def _offset(unit: np.ndarray) -> np.ndarray:
        wide = (unit >> np.uint32(9)) & np.uint32(1)
        return ((unit >> np.uint32(10)).astype(np.int64)) << (wide * np.uint32(8)).astype(np.int64)

    def replacement(self, value: int) -> np.ndarray:
        text = self.replacements[value : self.replacements.index(b"\0", value)]
        return np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)


class Model:
    """A BPE model: its pieces, normaliser and byte pieces."""

    def __init__(self, serialized: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(serialized)
        if proto.trainer_spec.model_type != BPE or any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in proto.pieces) or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models of normal, control, unknown and byte pieces, with white space before words, are handled")
        self.pieces = [(p.piece, p.type) for p in proto.pieces]
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.unknown = next(k for k, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.unknown_text = proto.trainer_spec.unk_surface
        self.bytes = [k for k, p in sorted(((k, p) for k, p in enumerate(proto.pieces) if p.type == BYTE), key=lambda x: int(x[1].piece[1:-1], 16))] if proto.trainer_spec.byte_fallback else []
        spec = proto.normalizer_spec
        self.map, self.prefix, self.fold, self.escape = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.joined = np.zeros(1 << PAIR_BITS, bool)
        for piece in self.ids:
            c = np.array([ord(x) for x in piece], np.uint32)
            self.joined[self._pair(c[:-1], c[1:])] = True
        # Every way to put a piece together from two symbols: their ids -> the piece. A rank is the place of its score.
        symbol = self.ids
        pairs = [(symbol[p[:k]], symbol[p[k:]], i) for p, i in symbol.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        left, right, both = np.array(pairs, np.int64).reshape(-1, 3).T
        order = np.argsort((left << 32) | right)
        self.pair_keys, self.pair_piece = ((left << 32) | right)[order], both[order]
        _, rank = np.unique([-p.score for p in proto.pieces], return_inverse=True)
        self.rank = np.append(rank, NEVER).astype(np.int32)
        chars = sorted((ord(p), i) for p, i in symbol.items() if len(p) == 1)
        self.chars, self.char_ids = (np.array([c[k] for c in chars], np.int64) for k in range(2))
        self._forget()

    def _forget(self) -> None:
        """Remembered stretches: the number of each, and its ids with the characters at which their spans begin and end, from start to start."""
        self.known: dict[str, int] = {}
        self.start = np.zeros(1, np.int64)
        self.flat = [np.zeros(0, np.int64) for _ in range(3)]
        self.known_chars = 0

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B))) >> np.uint32(32 - PAIR_BITS)

    def normalise(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All texts of t: characters, the byte (within t) at which each one's source begins, the first character of each text
        (one more entry than texts), and the byte at which the source of each text's characters ends."""
        stops = t.stop.copy()
        at = np.flatnonzero((t.data & 0xC0) != 0x80)
        chars = np.frombuffer(t.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        if self.map and len(at):
            chars, at = self._mapped(t, chars, at)
        first = np.searchsorted(at, np.append(t.start, len(t.data)))
        if self.fold and len(chars):
            chars, at, first, stops = self._folded(chars, at, first, stops, MARK if self.escape else SPACE)
        if self.prefix:
            some = np.flatnonzero(np.diff(first))
            places = first[some]
            chars, at = np.insert(chars, places, SPACE), np.insert(at, places, at[places] if len(places) else 0)
            first = first + np.concatenate([[0], np.cumsum(np.diff(first) > 0)])
        if self.escape:
            chars = np.where(chars == SPACE, np.uint32(MARK), chars)
        return chars, at, first, stops

    def _mapped(self, t: Texts, chars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end = t.stop[np.searchsorted(t.stop, at, "right")]
        length, value = self.map.longest(t.data, end, at)
        keep, new, where = np.ones(len(at), bool), [], []
        reached = -1
        found = np.flatnonzero(length)
        last = np.searchsorted(at, at[found] + length[found])
        for k, stop, v in zip(found.tolist(), last.tolist(), value[found].tolist(), strict=True):
            if k >= reached:  # else the place lies inside the prefix taken before
                reached = stop
                keep[k:stop] = False
                new.append(self.map.replacement(v))
                where.append(np.full(len(new[-1]), at[k]))
        every, places = np.concatenate([chars[keep], *new]), np.concatenate([at[keep], *where])
        order = np.argsort(places, kind="stable")
        return every[order], places[order]

    @staticmethod
    def _folded(chars: np.ndarray, at: np.ndarray, first: np.ndarray, stops: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One space of each run, none at the ends of a text."""
        space = chars == SPACE
        begins = np.zeros(len(chars) + 1, bool)
        begins[first] = True
        keep = ~(space & (begins[:-1] | np.concatenate([[True], space[:-1]])))
        count = np.concatenate([[0], np.cumsum(keep)])
        chars, at, first = chars[keep], at[keep], count[first]
        # At the end of a text a mark of the text itself counts as a space.
        stops, keep = stops.copy(), np.ones(len(chars), bool)
        for k in np.flatnonzero(np.diff(first)).tolist():
            last = int(first[k + 1])
            while last > first[k] and chars[last - 1] in (SPACE, mark):
                last -= 1
                keep[last], stops[k] = False, at[last]
        count = np.concatenate([[0], np.cumsum(keep)])
        return chars[keep], at[keep], count[first], stops

    def _merge(self, stretch: str) -> tuple[list[int], list[int], list[int]]:
        """Ids of a stretch, with the characters at which each one's span begins and ends."""
        score, part = self.score, list(stretch)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if left >= 0 and right < len(part):
                both = part[left] + part[right]
                s = score.get(both)
                if s is not None:
                    heapq.heappush(queue, (-s, left, both))

        for left in range(len(part) - 1):
            offer(left)
        while queue:
            _, left, both = heapq.heappop(queue)
            right = after[left]
            if right >= len(part) or not part[left] or part[left] + part[right] != both or not part[right]:
                continue
            part[left], part[right] = both, ""
            after[left] = after[right]
            if after[left] < len(part):
                before[after[left]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        ids, begin, end, place = [], [], [], 0
        k = 0
        while k < len(part):
            piece, stop = part[k], place + len(part[k])
            known = self.ids.get(piece)
            if known is None and self.bytes:
                raw = piece.encode()
                ids += [self.bytes[b] for b in raw]
                begin += [place] * len(raw)
                end += [place] * (len(raw) - 1) + [stop]
            else:
                ids.append(self.unknown if known is None else known)
                begin.append(place)
                end.append(stop)
            place, k = stop, after[k]
        return ids, begin, end

    def _piece_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of two symbols, -1 if there is none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == key), self.pair_piece[at], -1)

    def _merge_rows(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """sym: a stretch a row, filled up with -1. Ids, the ends of their spans, and how many there are of each row."""
        n, width = sym.shape
        out, ends, size = sym.copy(), np.tile(np.arange(1, width + 1), (n, 1)), size.copy()
        if width < 2 or not len(self.pair_keys):
            return out, ends, size
        both = self._piece_of(sym[:, :-1], sym[:, 1:])
        live, column = np.arange(n), np.arange(width)
        end = ends.copy()
        while len(live):
            rank = self.rank[both]
            best = rank.argmin(1)
            row = np.arange(len(live))
            go = rank[row, best] < NEVER
            done = ~go
            out[live[done]], ends[live[done]] = sym[done], end[done]
            live, sym, end, both, best = live[go], sym[go], end[go], both[go], best[go]
            row = np.arange(len(live))
            sym[row, best] = both[row, best]
            end[row, best] = end[row, best + 1]
            # What stands behind the right symbol moves up by one.
            source = np.minimum(column + (column > best[:, None]), width - 1)
            sym, end = np.take_along_axis(sym, source, 1), np.take_along_axis(end, source, 1)
            sym[:, -1] = -1
            both = np.take_along_axis(both, np.minimum(source[:, :-1], width - 2), 1)
            both[:, -1] = -1
            both[row, best] = self._piece_of(sym[row, best], sym[row, np.minimum(best + 1, width - 1)])
            before = np.maximum(best - 1, 0)
            both[row, before] = np.where(best > 0, self._piece_of(sym[row, before], sym[row, best]), both[row, before])
            size[live] -= 1
        return out, ends, size

    def _remember(self, new: list[str]) -> None:
        """Merges the stretches and puts them behind those that are known."""
        length = np.array([len(x) for x in new], np.int64)
        chars = np.frombuffer("".join(new).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.chars, chars), max(len(self.chars) - 1, 0))
        ids = np.where(self.chars[at] == chars, self.char_ids[at], -1) if len(self.chars) else np.full(len(chars), -1)
        first = np.concatenate([[0], np.cumsum(length)])
        plain = np.minimum.reduceat(ids, first[:-1]) >= 0
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # (stretch, id, begin, end) of each piece
        least = 0
        for width in WIDTHS:
            which = np.flatnonzero(plain & (length > least) & (length <= width))
            least = width
            if len(which):
                column = np.arange(width)
                inside = column < length[which, None]
                sym = np.where(inside, ids[np.minimum(first[which, None] + column, len(ids) - 1)], -1)
                out, end, size = self._merge_rows(sym, length[which])
                real = column < size[:, None]
                begin = np.concatenate([np.zeros((len(which), 1), np.int64), end[:, :-1]], 1)
                parts.append((np.repeat(which, size), out[real], begin[real], end[real]))
        for k in np.flatnonzero(~plain | (length > least)).tolist():
            columns = self._merge(new[k])
            parts.append((np.full(len(columns[0]), k), *(np.array(c, np.int64) for c in columns)))
        stretch, *columns = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(stretch, kind="stable")
        self.flat = [np.concatenate([old, c[order]]) for old, c in zip(self.flat, columns, strict=True)]
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.bincount(stretch, minlength=len(new)))])
        self.known_chars += len(chars)

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts of t: the offsets of each one's ids, the ids, and the bytes of its text at which each one's span begins and ends."""
        chars, at, first, stops = self.normalise(t)
        cut = np.ones(len(chars), bool)
        cut[1:] = ~self.joined[self._pair(chars[:-1], chars[1:])]
        cut[first[:-1][first[:-1] < len(chars)]] = True
        begin = np.flatnonzero(cut)
        whole = chars.tobytes().decode("utf-32-le")
        if len(self.known) > REMEMBERED or self.known_chars > REMEMBERED_CHARS:
            self._forget()
        known, old = self.known, len(self.known)
        edges = [*begin.tolist(), len(chars)]
        which = np.fromiter((known.setdefault(whole[a:b], len(known)) for a, b in zip(edges[:-1], edges[1:], strict=True)), np.int64, len(begin))
        if len(known) > old:
            self._remember(list(islice(known, old, None)))
        start, flat, size = self.start, self.flat, np.diff(self.start)
        # Each stretch's pieces, one after the other: the place in flat of each piece of the batch.
        n = size[which]
        ahead = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(ahead[-1]) + np.repeat(start[which] - ahead[:-1], n)
        offset = np.repeat(begin, n)
        counts = ahead[np.searchsorted(begin, first)]
        text = np.repeat(np.arange(len(t)), np.diff(counts))
        lead = t.start[text]
        ends = offset + flat[2][place]
        ended = ends >= first[text + 1] if len(text) else np.zeros(0, bool)
        source = np.append(at, 0)
        stop = np.where(ended, stops[text], source[ends])
        begins = np.minimum(offset + flat[1][place], max(len(at) - 1, 0))
        ids, begins, ends = flat[0][place], source[begins] - lead, stop - lead
        if not self.bytes and len(ids):  # unknown pieces side by side are one
            keep = np.ones(len(ids), bool)
            keep[1:] = ~((ids[1:] == self.unknown) & (ids[:-1] == self.unknown) & (text[1:] == text[:-1]))
            at = np.flatnonzero(keep)
            ids, begins, ends = ids[at], begins[at], ends[np.append(at[1:], len(keep)) - 1]
            counts = np.concatenate([[0], np.cumsum(keep)])[counts]
        return counts, ids, begins, ends

    def surfaces(self) -> tuple[list[bytes], np.ndarray]:
        """The bytes of each id, and which are byte pieces."""
        out = []
        for piece, kind in self.pieces:
            text = "" if kind == CONTROL else self.unknown_text if kind == UNKNOWN else piece.replace(chr(MARK), " ")
            out.append(bytes([int(piece[1:-1], 16)]) if kind == BYTE else text.encode())
        return out, np.array([kind == BYTE for _, kind in self.pieces])


class Decoder:
    """Texts of lists of ids."""

    def __init__(self, model: Model):
        self.surface, self.byte = model.surfaces()
        self.normal = [kind == NORMAL for _, kind in model.pieces]
        self.control = {k for k, (_, kind) in enumerate(model.pieces) if kind == CONTROL}
        self.strips, self.strips_all = model.prefix or model.fold, model.fold

    def decode(self, ids: list[int]) -> str:
        """Without the white space that stands for the beginning; bytes that are no UTF-8 become replacement characters."""
        surface, lead = self.surface, 0
        out = [surface[i] for i in ids]
        if self.strips:
            while lead < len(out):
                if self.normal[ids[lead]] and out[lead][:1] == b" ":
                    out[lead] = out[lead][1:]
                    if not self.strips_all:
                        break
                if out[lead]:
                    break
                lead += 1
        if self.control.isdisjoint(ids):  # these end a run of byte pieces, without a byte of their own
            try:
                return b"".join(out).decode()
            except UnicodeDecodeError:
                pass
        return self._mended(ids, out)

    def _mended(self, ids: list[int], out: list[bytes]) -> str:
        text, run = [], b""
        for i, s in zip([*ids, -1], [*out, b""], strict=True):
            if i >= 0 and self.byte[i]:
                run += s
                continue
            while run:  # a character at a time, a byte that begins none for itself
                size = next((n for n in (1, 2, 3, 4) if _is_char(run[:n])), 0)
                text.append(run[:size].decode() if size else "�")
                run = run[max(size, 1) :]
            text.append(s.decode())
        return "".join(text)


def _is_char(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=1)
def _model(serialized: bytes) -> Model:
    """A worker's model stands from task to task."""
    return Model(serialized)


def read_model(path: str) -> bytes:
    """The file's bytes, on the driver."""
    with open(path, "rb") as f:
        out = f.read(MAX_MODEL + 1)
    if len(out) > MAX_MODEL:
        raise ValueError(f"a model of more than {MAX_MODEL} bytes")
    return out


_ADDED = "ids array<int>, begins array<bigint>, ends array<bigint>"


def encode(df: DataFrame, model_file: str, *, text_col: str = "text", names: tuple[str, str, str] = ("ids", "begins", "ends")) -> DataFrame:
    """df without its text and with the ids of each text and the spans of bytes [begin, end) that they stand for; columns
    of these names that df has already are replaced."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(read_model(model_file))
    rest = [f for f in df.schema.fields if f.name not in (text_col, *names)]
    kinds = ("array<int>", "array<bigint>", "array<bigint>")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], *[f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(held.value)
        for batch in batches:
            for t in chunks(batch.column(len(rest))):
                counts, *columns = model.encode(t)
                offsets = pa.array(counts, pa.int32())
                part = batch.slice(t.first, len(t))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c, kind)) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *lists], names=[*part.schema.names[: len(rest)], *names])

    return df.select(*[df[f.name] for f in rest], df[text_col]).mapInArrow(run, schema)


def decode(df: DataFrame, model_file: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """df with the text of its ids (null ids count as none), in place of them; a column of the text's name is replaced."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(read_model(model_file))
    rest = [f for f in df.schema.fields if f.name not in (ids_col, text_col)]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], f"`{text_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(_model(held.value))
        for batch in batches:
            column = batch.column(len(rest))
            texts = pa.array((decoder.decode(column[k].as_py() or []) for k in range(batch.num_rows)), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], texts], names=[*batch.schema.names[: len(rest)], text_col])

    return df.select(*[df[f.name] for f in rest], df[ids_col]).mapInArrow(run, schema)


def digests(docs: DataFrame, model_file: str, *, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and span_bytes, the bytes of the text that the spans cover."""
    found = encode(docs.select(docs[doc_col].alias("doc_id"), docs[text_col].alias("text")), model_file)
    covered = F.aggregate(F.arrays_zip("begins", "ends"), F.lit(0).cast("bigint"), lambda acc, x: acc + x["ends"] - x["begins"])
    told = found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        covered.alias("span_bytes"), "ids",
    )
    out = decode(told, model_file, text_col="decoded")
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "span_bytes")
