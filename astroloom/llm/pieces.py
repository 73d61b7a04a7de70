"""Operator 5, SentencePiece encoding and decoding for merge-type vocabularies.

A text's white space is escaped and a dummy prefix put before it. Characters
are symbols; an agenda (a heap) holds adjacent pairs whose concatenation is a
piece, by score and then position; the best is merged and its new neighbours
enter, until the agenda is empty. Symbols that are no piece become byte pieces.

No merge can cross a boundary whose two characters are adjacent in no piece.
The model is asked at load: where, as usual, no piece has the space sign after
another character, texts fall into segments before each run of space signs, and
between letters and characters that no piece links to them (punctuation, line
ends); each segment has its own agenda, and equal segments share one result in
a bounded memory. Where a vocabulary does have pieces with inner spaces, the
whole text is one agenda.

A model whose normaliser does more is refused at load.

Check: in every Arrow batch, each segment that is new to the worker is also
encoded and decoded by the sentencepiece library, and a difference stops the
job. Segments are encoded apart exactly because nothing crosses their bounds;
the tests hold whole texts against the library.

Results in unusual cases: null and empty texts have no ids and decode to the
empty string; any Unicode text is encoded (byte pieces); very long texts are
encoded whole; repeated rows stay; an empty table gives an empty result; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, raw_texts, table

SPACE = "\u2581"
MODEL = "piece_bpe_32k.model"
#: Segments in each of a worker's two generations, and the longest kept.
KEPT = 300_000
KEPT_CHARS = 48
_PLACE = (1 << 32) - 1
#: Compatibility forms, case and white space that a normaliser would change.
PROBE = "ﬁ Ａ１ ｶﾞ Ⅳ é E\u0301  X\tß \u3000y\u200b "


class Encoder:
    """One model in one Python worker."""

    def __init__(self, model_file: str, check: bool = True) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if self.library.normalize(PROBE) != SPACE + PROBE.replace(" ", SPACE):
            raise ValueError("the model changes texts before it encodes them; only white space escaping is known here")
        n = self.library.get_piece_size()
        self.bytes = {}
        self.special = set()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.surface: list[str | int | None] = []
        for i in range(n):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.surface.append(int(piece[1:-1], 16))
            elif self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i):
                self.surface.append(None)
            else:
                piece = piece.replace(SPACE, " ")
                self.ids[piece] = i
                self.scores[piece] = self.library.get_score(i)
                self.surface.append(piece)
        order = {score: k for k, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.rank = {p: order[score] << 32 for p, score in self.scores.items()}
        self.check = check
        long = [p for p in self.ids if len(p) > 1]
        self.segments = None if any(" " in p.lstrip(" ") for p in long) else _cutter(long)
        joined = {c for p in long for c in p}
        #: A character that never merges, put before a segment without a space to check it.
        self.mark = next((c for c in "\n\r\x00\x01\x02" if c not in joined), None)
        #: Segment -> its ids, joined by commas; and those that decode to another text.
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def agenda(self, text: str) -> list[int]:
        """The ids of one segment (or whole text): merges by score, leftmost
        first. An entry is rank * 2^32 + position, so that one comparison of
        integers orders the agenda; stale entries are seen by their rank."""
        ids, rank = self.ids, self.rank.get
        symbols = list(text)
        n = len(symbols)
        heap = [r + i for i, r in enumerate(map(rank, map(str.__add__, symbols, symbols[1:]))) if r is not None]
        heapq.heapify(heap)
        if heap:
            after = list(range(1, n + 1))
            prior = list(range(-1, n - 1))
            pop, push = heapq.heappop, heapq.heappush
            while heap:
                entry = pop(heap)
                i = entry & _PLACE
                left = symbols[i]
                if left is None:
                    continue
                j = after[i]
                if j >= n:
                    continue
                pair = left + symbols[j]
                if rank(pair) != entry - i:
                    continue  # one of the two has been merged meanwhile
                symbols[i], symbols[j] = pair, None
                k = after[i] = after[j]
                if k < n:
                    prior[k] = i
                    r = rank(pair + symbols[k])
                    if r is not None:
                        push(heap, r + i)
                h = prior[i]
                if h >= 0:
                    r = rank(symbols[h] + pair)
                    if r is not None:
                        push(heap, r + h)
        out = []
        for s in symbols:
            if s is None:
                continue
            if s in ids:
                out.append(ids[s])
            else:
                out += [self.bytes[b] for b in s.encode()] if self.bytes else [self.library.unk_id()]
        return out

    def surfaces(self, ids: list[int]) -> str:
        """The text of ids, before the dummy prefix is taken off."""
        out, run = [], bytearray()
        for i in ids:
            s = self.surface[i]
            if isinstance(s, int):
                run.append(s)
                continue
            if run:
                out.append(_utf8(run))
                run.clear()
            if s is not None:
                out.append(s)
            elif self.library.is_unknown(i):
                out.append(" \u2047 ")
        if run:
            out.append(_utf8(run))
        return "".join(out)

    def _learn(self, segments: list[str]) -> dict[str, str]:
        found = {s: self.agenda(s) for s in segments}
        if self.check:
            self.verify(found)
        for s, ids in found.items():
            if (surface := self.surfaces(ids)) != s:
                self.decoded[s] = surface
        return {s: ",".join(map(str, ids)) for s, ids in found.items()}

    def verify(self, found: dict[str, list[int]]) -> None:
        """Each segment's ids and their text against the library, which adds
        the dummy prefix itself; one that has no space is put after a mark."""
        lead = [s for s in found if s[0] == " "]
        rest = [s for s in found if s[0] != " "] if self.mark else []
        skip = len(self.agenda(" ")) + len(self.agenda(self.mark or ""))
        theirs = self.library.encode([s[1:] for s in lead] + [f"{self.mark}{s}" for s in rest], num_threads=1)
        for k, s in enumerate(lead + rest):
            if theirs[k][skip if k >= len(lead) else 0 :] != found[s] and s != " ":  # "" has no ids there
                raise RuntimeError(f"agenda and library differ on segment {s!r}")
        # The library takes the dummy prefix off.
        for (s, ids), text in zip(found.items(), self.library.decode(list(found.values()), num_threads=1), strict=True):
            if text != self.surfaces(ids)[s[0] == " " :]:
                raise RuntimeError(f"decoded text and library differ on segment {s!r}")

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each text."""
        escaped = [" " + t.replace(SPACE, " ") if t else "" for t in texts]
        cut = [(self.segments(t) if self.segments else [t]) if t else [] for t in escaped]
        known, older, decoded = self.known, self.older, self.decoded
        new = {s for segments in cut for s in segments if s not in known}
        known.update((s, older[s]) for s in new if s in older)
        known.update(self._learn([s for s in new if s not in older]))
        out = []
        for text, segments in zip(escaped, cut, strict=True):
            ids = ",".join([known[s] for s in segments])
            if decoded and not decoded.keys().isdisjoint(segments):
                text = "".join([decoded.get(s, s) for s in segments])
            out.append((ids.count(",") + 1 if ids else 0, ids, text[1:] if text[:1] == " " else text))
        for s in new:
            if len(s) > KEPT_CHARS:
                del known[s]
        if len(known) > KEPT:  # what is used again moves up from the older generation
            self.older, self.known, self.decoded = known, {}, {s: d for s, d in decoded.items() if s in known}
        return out


def _cutter(long: list[str]):
    """Splits a text where no merge can cross. Characters that stand next to
    each other in a piece belong together; those that are not together with the
    letters (with ``e``: punctuation, line ends) part from the others."""
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    for p in long:
        own = p.lstrip(" ")
        for a, b in zip(own, own[1:]):
            root[find(a)] = find(b)
    apart = {c for c in root if find(c) != find("e")} | set("\n\r\t") - {c for c in root if find(c) == find("e")}
    c = "".join(re.escape(x) for x in sorted(apart - {" "}))
    return re.compile(f" *[{c}]+| *[^ {c}]+| +").findall


def _utf8(raw: bytearray) -> str:
    return raw.decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(model_file: str) -> Encoder:
    """The worker's encoder; the model is loaded once in each process."""
    if model_file not in _ENCODERS:
        _ENCODERS[model_file] = Encoder(model_file)
    return _ENCODERS[model_file]


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ``ids`` decimal, joined by commas."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = encoder(model_file).encode([t.decode() for t in raw_texts(batch.column("text"))])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([x[1] for x in found], pa.string()),
                pa.array([x[2] for x in found], pa.string()),
            ],
            ["doc_id", "n_tokens", "ids", "decoded"],
        )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(docs, run, "doc_id long, n_tokens long, ids string, decoded string")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents"), model_path()))


QUERIES = {"op5_pieces": op5_pieces}
SQL: dict[str, str] = {}
