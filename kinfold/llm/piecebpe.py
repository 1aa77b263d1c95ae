"""SentencePiece BPE encoding by backtracking over longest matches, and decoding.

The pieces of a model go into an Aho-Corasick automaton. A segment of text is covered from left to right with the
longest piece that fits; neighbours must be compatible, that is, merging their joined text again must give the same
two pieces. If no piece fits, the last one is taken back for the next shorter one. A byte for each position keeps those
from which no continuation was found, so none is tried again in vain.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import release_memory, sliced

MARK = "▁"  # stands for a space in pieces
#: Segments of up to CACHE_LETTERS letters kept with their ids in each Python worker, twice at most; speed alone
#: depends on it.
CACHE_WORDS, CACHE_LETTERS = 100_000, 64
#: Letters of a segment that the automaton looks at together.
SPAN = 4096


class PieceBPE:
    """Encoder and decoder of a SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [m.id_to_piece(i) for i in range(m.vocab_size())]
        self.control = {i for i in range(len(self.pieces)) if m.is_control(i)}
        self.unk = m.unk_id()
        plain = [i for i in range(len(self.pieces)) if not (i in self.control or m.is_byte(i) or i == self.unk or m.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: m.get_score(i) for i in plain}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if m.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        inside = {c for p in self.id_of for c in p[1:]}
        if MARK in {c for p in self.id_of if p.strip(MARK) for c in p.lstrip(MARK)[1:]}:
            raise ValueError("pieces with a space after a letter aren't supported")
        stop = "" if "\n" in inside or "\n" in self.id_of else "\n"  # no piece holds it: text can be cut around it
        self.segment = re.compile(f"{MARK}*[^{MARK}{stop}]+|{MARK}+" + f"|{stop}" * bool(stop))
        self.listed: dict[str, str] = {}
        self.old: dict[str, str] = {}
        # What an id decodes to wherever it stands. A byte below 128 is a character of its own in any run of bytes (a line
        # end is one); the others need their neighbours.
        self.text_of = {str(i): self.pieces[i].replace(MARK, " ") for i in plain} | {str(i): chr(b) for i, b in self.byte_of.items() if b < 128}
        self.texts = pa.array([self.text_of.get(str(i)) for i in range(len(self.pieces))], pa.large_string())
        self.name = [str(i) for i in range(len(self.pieces))]
        self.known: dict[int, bool] = {}
        # Only pieces that their own text encodes to can be in a result; the automaton holds these.
        self.auto = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if len(p) == 1 or self.merge(p) == [p]:
                self.auto.add_word(p, i)
        self.auto.make_automaton()
        self.length = [len(p) for p in self.pieces]
        self.longest = max(map(len, self.id_of))
        self.shorter = [-1] * len(self.pieces)  # the longest piece that is a proper beginning of a piece
        for p in self.auto.keys():
            for k in range(len(p) - 1, 0, -1):
                if p[:k] in self.auto:
                    self.shorter[self.id_of[p]] = self.id_of[p[:k]]
                    break

    def merge(self, text: str) -> list[str]:
        """Plain merging: the best-scoring adjacent pair that forms a piece, the leftmost among equals, until none does."""
        n = len(text)
        symbol, before, after = list(text), list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, str]] = []
        score = self.score

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (both := symbol[i] + symbol[j]) in score:
                heapq.heappush(heap, (-score[both], i, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not symbol[i] or j < 0 or len(symbol[i]) + len(symbol[j]) != len(both) or symbol[i] + symbol[j] != both:
                continue
            symbol[i], symbol[j] = both, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s in symbol if s]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether two neighbours stay as they are when their joined text is merged again; kept for the next time."""
        a, b = self.pieces[left], self.pieces[right]
        out = self.known[left << 16 | right] = self.merge(a + b) == [a, b]
        return out

    def _backtrack(self, text: str) -> list[int]:
        """Ids of the pieces of a segment; -1 for a character without a piece, which stands alone, as bytes, and merges
        with nothing."""
        n = len(text)
        known, compatible, shorter, length, auto = self.known, self._compatible, self.shorter, self.length, self.auto
        fitting = known.get
        failed = bytearray(n + 1)  # 1: no way on from here
        path: list[int] = []
        at, before = 0, -1
        matches = None  # longest matches from here on, as long as they are followed
        base, view, edge = 0, text[:SPAN], n if n <= SPAN else SPAN - self.longest
        while at < n:
            if at >= edge or at < base:  # a long segment is looked at part by part; a match ends inside its part
                base, view, matches = at, text[at : at + SPAN], None
                edge = n if at + SPAN >= n else at + SPAN - self.longest
            if matches is None:
                matches = auto.iter_long(view, at - base)
            last, piece = next(matches, (-1, -1))
            longest = piece
            if piece < 0 or base + last + 1 - length[piece] != at:
                matches = None
                if not failed[at + 1]:
                    path.append(-1)
                    at, before = at + 1, -1
                    continue
                piece = longest = -1
            while True:
                while piece >= 0:
                    end = at + length[piece]
                    if not failed[end]:
                        if before < 0:
                            break
                        fits = fitting(before << 16 | piece)
                        if fits or (fits is None and compatible(before, piece)):
                            break
                    piece = shorter[piece]
                if piece >= 0:
                    break
                # The failure depends on the piece before; the position is closed for good as an encoding of a
                # prefix is unique: no other path that can succeed leads here.
                failed[at] = 1
                if not path:
                    return [self.id_of.get(p, -1) for p in self.merge(text)]
                piece = path.pop()
                at -= length[piece] if piece >= 0 else 1
                before = path[-1] if path else -1
                piece = shorter[piece] if piece >= 0 else -1
                longest = -2  # whatever comes now, the matches ahead are others
            path.append(piece)
            at = end
            before = piece
            if piece != longest:
                matches = None
        return path

    def _encode_segment(self, segment: str) -> list[int]:
        """Ids of a segment without a space inside. Pieces of spaces alone share one score, so that the order of their
        merges isn't fixed by neighbours: segments led by several spaces are merged plainly."""
        if segment.startswith(MARK * 2):
            found = [self.id_of.get(p, -1) for p in self.merge(segment)]
        else:
            found = self._backtrack(segment)
        if -1 not in found:
            return found
        out: list[int] = []
        at = 0
        for i in found:
            if i >= 0:
                out.append(i)
                at += len(self.pieces[i])
            else:
                out += [self.byte_id[b] for b in segment[at].encode("utf-8", "surrogatepass")]
                at += 1
        return out

    def list_ids(self, segment: str) -> str:
        """Ids of a segment, joined by commas; short ones are kept for the next time."""
        out = self.listed.get(segment) or self.old.get(segment) or ",".join([self.name[i] for i in self._encode_segment(segment)])
        if len(segment) <= CACHE_LETTERS:
            if len(self.listed) >= CACHE_WORDS:
                self.turn()
            self.listed[segment] = out
        return out

    def tell(self, listed: str) -> str:
        """The text that the ids of a segment decode to, a leading space included."""
        try:
            return "".join(map(self.text_of.__getitem__, listed.split(",")))
        except KeyError:
            return self.decode([self.id_of[MARK], *map(int, listed.split(","))])  # a mark ahead is what decoding drops

    def decode_listed(self, listed: str) -> bytes | None:
        """The text that ids decode to, a leading space included, in UTF-8; none if an id needs its neighbours."""
        if not listed:
            return b""
        found = self.texts.take(pa.array(np.fromstring(listed, np.int32, sep=",")))
        if found.null_count:
            return None
        _, ends, text = found.buffers()
        return text[: np.frombuffer(ends, np.int64)[len(found)]].to_pybytes()

    def forget(self) -> None:
        """Drop the tables of words and neighbours."""
        self.old, self.listed, self.known = {}, {}, {}

    def turn(self) -> None:
        """A full table becomes the old one, from which words that come again are taken over."""
        if len(self.known) >= 2 * CACHE_WORDS:
            self.known.clear()
        if len(self.listed) >= CACHE_WORDS:
            self.old, self.listed = self.listed, {}

    def digests(self, text: str | None) -> tuple[int, str, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the text that these ids decode to, and the
        ids joined by commas. Segments begin and end between characters, so their ids decode one by one."""
        self.turn()
        known, add = self.listed.get, self.list_ids
        parts = [known(s) or add(s) for s in self.segments(text or "")]
        listed = ",".join(parts)
        decoded = self.decode_listed(listed)
        if decoded is None:
            decoded = "".join(map(self.tell, parts)).encode("utf-8", "surrogatepass")
        decoded = decoded[decoded.startswith(b" ") :]
        return listed.count(",") + 1 if listed else 0, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest(), listed

    def segments(self, text: str) -> list[str]:
        return self.segment.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for s in self.segments(text or ""):
            out += self._encode_segment(s)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: pieces joined, runs of byte pieces read as UTF-8 (a wrong byte gives U+FFFD), marks turned
        into spaces, the leading one dropped; control ids give nothing."""
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        first = True
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                first = False
                continue
            flush()
            if i in self.control:
                continue
            piece = " ⁇ " if i == self.unk else self.pieces[i]
            if first and piece.startswith(MARK):
                piece = piece[1:]
            first = False
            out.append(piece.replace(MARK, " "))
        flush()
        return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> PieceBPE:
    """One model for each worker process."""
    return PieceBPE(path)


def token_digests(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False, forget: bool = False) -> DataFrame:
    """Encode and decode every text of ``docs``: the columns ``keep`` plus n_tokens, ids_sha256, decoded_sha256 and,
    if ``with_ids``, ids (array of int). A null text is empty and has no ids. ``model`` is a path that every executor
    can open (the package of tokenizer files is installed there). With ``forget`` a task drops its word tables at its
    end: slower, for workers that go on to other stages. Rows stay in place: no shuffle, repeated rows and
    empty tables need nothing special, extra columns are left out unless kept."""
    source = docs.select(*[F.col(c) for c in keep], F.col("text").cast("string").alias("kf_text"))
    extra = "ids array<int>, " if with_ids else ""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(model)
        for part in sliced(parts):
            found = [bpe.digests(x.as_py()) for x in part.column(part.num_columns - 1)]
            n, digests, texts = ([f[k] for f in found] for k in range(3))
            all_ids = [np.fromstring(f[3], np.int32, sep=",") if f[3] else np.zeros(0, np.int32) for f in found] if with_ids else []
            columns = [part.column(k) for k in range(part.num_columns - 1)] + ([pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, all_ids)]), pa.int32()), pa.array(np.concatenate(all_ids)))] if with_ids else [])
            columns += [pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *["ids"] * with_ids, "n_tokens", "ids_sha256", "decoded_sha256"])

        if forget:
            bpe.forget()
            release_memory()

    return source.mapInArrow(run, f"{fields}, {extra}n_tokens long, ids_sha256 string, decoded_sha256 string")
