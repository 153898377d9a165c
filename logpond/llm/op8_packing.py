"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens (only longer ones are
cut). Packing needs lengths alone, so the plan is made on the histogram of
lengths, at most ``capacity`` rows however large the corpus: open a sequence
with the longest piece left and look up the gap in the index of lengths; a
single length, else a pair, else a triple that sums to the gap exactly
closes it, as far as the pieces available allow; otherwise the largest piece
that fits (best fit) goes in and the smaller gap is looked up. A pattern is
repeated as often as its lengths last, so the plan is bounded by the
capacity too.

Pieces then take their places by rank within their length: an exact,
distributed rank, looked up in the plan's intervals. Token ids are made
once; only lengths and checksums are written and shuffled.

Defined cases: a null or empty text is one piece, the end id alone; repeated
rows are documents of their own; an empty table gives an empty result; extra
columns are ignored; a text of any length is cut into pieces.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from string import ascii_letters

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logpond.llm.common import pick, ranked, saved

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 700_000     # words whose ids a Python worker remembers
CACHE_LENGTH = 64         # longer words are encoded each time
TAIL = ".,;:!?%&*#$|)"    # one run of these after letters is a piece of its own
LETTERS = range(0x1100)   # alphabets below the first letters that combine (Hangul)
ROWS = 256                # texts encoded together

_encoders: dict = {}


class Encoder(dict):
    """Ids of a text as little-endian 32-bit words.

    The tokenizer drops white space and never joins what a space or line
    feed separates, so a text's ids are those of its parts between them,
    which repeat: this is the dictionary of parts, filled as they are met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        super().__init__()
        self.model = Tokenizer.from_file(path)
        self.raw = {i: i.to_bytes(4, "little") for i in self.model.get_vocab().values()}
        letters = self._letters()
        self.letters = frozenset(letters)
        self.codes = str.maketrans(letters)
        self.rare: dict[str, bytes] = {}      # long parts of this batch

    def _letters(self) -> dict[str, str]:
        """Letters and what the model gets for them, of those that the
        normalizer and the pre-tokenizer turn each into something of its own:
        a run of them reaches the model whole, so the model alone gives its
        ids. No letters of ``LETTERS`` combine with each other."""
        m = self.model
        added = m.get_added_tokens_decoder().values()
        if m.normalizer is None or m.pre_tokenizer is None or m.truncation or m.padding or any(t.content.isalpha() for t in added):
            return {}
        found = {}
        for c in filter(str.isalpha, map(chr, LETTERS)):
            low = m.normalizer.normalize_str(c)
            cut = m.pre_tokenizer.pre_tokenize_str(low)
            twice = m.pre_tokenizer.pre_tokenize_str(m.normalizer.normalize_str(c + c))
            if len(low) == 1 and low.isalpha() and len(cut) == 1 and [x for x, _ in twice] == [2 * cut[0][0]]:
                found[c] = cut[0][0]
        return found

    def _encode(self, part: str) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in self.model.encode_batch_fast([part], add_special_tokens=False)[0].ids])

    def __missing__(self, part: str) -> bytes:
        """Ids of a new part. One that is ``letters`` and then a run of
        ``TAIL`` characters is the ids of both, cut where the tokenizer cuts
        too."""
        if len(part) > CACHE_LENGTH:
            if part not in self.rare:
                self.rare[part] = self._encode(part)
            return self.rare[part]
        if len(self) >= CACHE_WORDS:
            self.clear()
        stem = part.rstrip(TAIL)
        if not stem or not self.letters.issuperset(stem):
            ids = self._encode(part)
        elif len(stem) < len(part):
            ids = self[stem] + self[part[len(stem):]]
        else:
            raw = self.raw
            ids = b"".join([raw[t.id] for t in self.model.model.tokenize(part.translate(self.codes))])
        self[part] = ids
        return ids

    def ids(self, texts: list[str]) -> list[bytes]:
        self.rare = {}
        return [b"".join(map(self.__getitem__, t.replace("\n", " ").split(" "))) for t in texts]


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids, if asked): a row per
    piece. ``vocabulary``: a tokenizers file that every executor can open."""
    d = pick(docs, id=id_col, t=text_col)
    schema = d.select("id", F.lit(0).alias("piece"), *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32")],
                      *([F.array(F.lit(0).cast("long")).alias("ids")] if with_ids else [])).schema
    end = np.array([end_id], dtype="<u4").tobytes()

    def each(batches):
        enc = encoder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                out = []
                row = []
                for k, raw in enumerate(enc.ids([t or "" for t in b.column(1).to_pylist()])):
                    raw += end
                    for no, lo in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[lo:lo + 4 * capacity]
                        row.append(k)
                        out.append((no, lo // 4, len(part) // 4, zlib.crc32(part),
                                    np.frombuffer(part, "<u4").tolist() if with_ids else None))
                cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array([o[0] for o in out], pa.int32()),
                        *[pa.array([o[j] for o in out], pa.int64()) for j in (1, 2, 3)]]
                if with_ids:
                    cols.append(pa.array([o[4] for o in out], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return d.mapInArrow(each, schema)


def _exact(free: np.ndarray, lengths: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths that sum to ``gap``; the largest
    first. ``free``: pieces left by length; ``lengths``: those with any,
    ascending."""
    if gap < len(free) and free[gap] > 0:
        return [gap]
    if not len(lengths):
        return None
    low, high = int(lengths[0]), int(lengths[-1])

    def pair(rest: int) -> list[int] | None:
        if not 2 * low <= rest <= 2 * high:
            return None
        a = lengths[(lengths * 2 >= rest) & (lengths < rest)]
        b = rest - a
        ok = (free[b] > 0) & ((a != b) | (free[a] > 1))
        if not ok.any():
            return None
        i = int(np.flatnonzero(ok)[-1])
        return [int(a[i]), int(b[i])]

    if two := pair(gap):
        return two
    if not 3 * low <= gap <= 3 * high:
        return None
    for a in lengths[(lengths * 3 >= gap) & (lengths < gap)][::-1].tolist():
        free[a] -= 1
        two = pair(gap - a)
        free[a] += 1
        if two and (a not in two or free[a] > two.count(a)):
            return [a, *two]
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Sequences for ``counts`` (length -> pieces): [(pattern, times)], a
    pattern being (length, how many) in order of place."""
    free = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        free[length] = n
    out = []
    while True:
        lengths = np.flatnonzero(free)
        if not len(lengths):
            return out
        used: dict[int, int] = defaultdict(int)
        gap = capacity

        def put(length: int, n: int = 1) -> None:
            used[length] += n
            free[length] -= n

        put(int(lengths[-1]))
        gap -= int(lengths[-1])
        while gap:
            lengths = np.flatnonzero(free)
            if found := _exact(free, lengths, gap):
                for length in found:
                    put(length)
                break
            fit = lengths[lengths <= gap]
            if not len(fit):
                break
            length = int(fit[-1])
            n = max(1, min(int(free[length]), gap // length - 3))   # the last few by exact complement
            put(length, n)
            gap -= n * length
        times = 1 + min(int(free[length]) // n for length, n in used.items())
        for length, n in used.items():
            free[length] -= n * (times - 1)
        out.append((list(used.items()), times))


def _places(patterns) -> dict[str, np.ndarray]:
    """The plan as intervals of ranks by length, sorted by (length, rank)."""
    rows, taken, base = [], defaultdict(int), 0
    for pattern, times in patterns:
        at = 0
        for length, n in pattern:
            rows.append((length, taken[length], n, base, at))
            taken[length] += n * times
            at += n * length
        base += times
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 44) + a[:, 1], "from": a[:, 1], "n": a[:, 2], "base": a[:, 3], "at": a[:, 4]}


def pack(piece_table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns id, piece, length,
    ids_crc32, ...)."""
    counts = {r["length"]: r["n"] for r in
              piece_table.groupBy("length").agg(F.count("*").alias("n")).collect()}   # at most `capacity` rows
    place = _places(plan(counts, capacity))
    d = ranked(piece_table, ["length"], ["id", "piece", "start", "ids_crc32"], "rank")
    names = d.columns
    keep = [c for c in names if c != "rank"]
    schema = d.select(*keep, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def each(batches):
        for b in batches:
            length = b.column(names.index("length")).to_numpy()
            rank = b.column(names.index("rank")).to_numpy()
            i = np.searchsorted(place["key"], (length << 44) + rank, side="right") - 1
            inside = rank - place["from"][i]
            seq = place["base"][i] + inside // place["n"][i]
            off = place["at"][i] + inside % place["n"][i] * length
            yield pa.RecordBatch.from_arrays(
                [*[b.column(names.index(c)) for c in keep], pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                names=schema.names)

    return d.mapInArrow(each, schema)


def best_fit(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
             capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    table = saved(pieces(docs, vocabulary, id_col, text_col, capacity, end_id, with_ids), "pieces")
    return pack(table, capacity)
