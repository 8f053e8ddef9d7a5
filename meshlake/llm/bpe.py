"""Byte-level BPE encoding and decoding.

Texts are split by the vocabulary's pattern (Java's regex engine, white space spelt out, so that it means the same).
A word is encoded by a fold of Spark's higher-order functions over its array of byte tokens: each step looks up the
rank of every neighbouring pair in a literal rank map and merges the first pair of lowest rank, until none is left.
The map is a literal array: the pairs of each first token are displaced so that no two pairs share a cell.

Words are encoded once each where that pays: all words of the corpus are counted, those seen more than once are
folded from the most frequent down to a fixed number and size, and that bounded dictionary is broadcast. The other
words are folded once for each run of texts (an Arrow batch, bounded in rows and bytes): the run's distinct words ride on
its first row, the fold turns them into ids in place, and the next stage fills them in, so no text is joined or shuffled.
Pieces of over ``LONG`` bytes (runs without a space) are merged by a heap in the Arrow stage with the same ranks,
since a fold over n bytes takes n * n steps.

Decoding takes the binary pieces of the ids and concatenates them.

Edge cases: null and empty texts have no ids and decode to no bytes. Repeated rows each get their row. Ids outside
the vocabulary raise ``ValueError`` when decoded; null ids decode as none. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.llm.common import arrow_stage, bounded_batches, durable, let, release, settle

#: Unicode white space (fixed values), for a character class.
SPACES = r"\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LONG, HOT_WORDS, HOT_BYTES, HOT_PARTS = 128, 1_000_000, 16 << 20, 4
#: The session's bound on a plan's text, which ``encode`` lowers to this many characters where the user hasn't set it.
PLAN_TEXT, PLAN_BYTES, NO_BOUND = "spark.sql.maxPlanStringLength", 100_000, str((1 << 31) - 16)
#: Ids that are decoded at a time, but for those of one longer text.
GROUP = 1 << 18
#: A cell of the literal map is (first token + 1) * RANKS + rank, 0 if empty; with a position of 8 bits a rank still fits an int.
RANK_BITS = 23
RANKS = 1 << RANK_BITS


def java_pattern(pattern: str) -> str:
    """The pattern with ``\\s`` and ``\\S`` spelt out, within brackets and outside."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\S"):
            out.append(SPACES if inside and two == r"\s" else f"[{'^' * (two == r'\S')}{SPACES}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            inside = (inside or two[0] == "[") and two[0] != "]"
            out.append(two[0])
            i += 1
    return "".join(out)


class Vocabulary:
    """Byte strings and their ranks, which are the ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.size = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for b, r in ranks.items():
            self.bytes_of[r] = b
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        if self.size > RANKS:
            raise ValueError(f"more than {RANKS} ranks")

    @property
    def pieces(self) -> pa.Array:
        return pa.array(self.bytes_of, pa.large_binary())

    def rank_map(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offset of each first token, first tokens, ranks): the pair (a, b) has its cell at offset[a] + b, if a is there."""
        rows: dict[int, list[tuple[int, int]]] = {}
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    rows.setdefault(a, []).append((b, r))
        span = 4 * sum(map(len, rows.values())) + 64
        cells, rank = np.full((2, span + self.size), -1, np.int64)
        offset = np.full(self.size, 1 << 29, np.int64)
        rng = np.random.default_rng(0)
        for a in sorted(rows, key=lambda a: (-len(rows[a]), a)):
            cols, vals = np.array(sorted(rows[a])).T
            free = cols[:0]
            while not len(free):  # random offsets, of which those stay at which all cells are free
                free = rng.integers(0, span, 512 if len(cols) > 16 else 32)
                for k in range(0, len(cols), 8):
                    free = free[(cells[free[:, None] + cols[k : k + 8]] < 0).all(axis=1)]
            o = free[0]
            cells[o + cols], rank[o + cols] = a, vals
            offset[a] = o
        last = int(np.flatnonzero(cells >= 0).max(initial=0)) + 1
        return offset, cells[:last], rank[:last]

    def merge(self, word: bytes) -> list[int]:
        """By a heap of pairs: for long words."""
        ranks, n = self.ranks, len(word)
        ends = list(range(1, n + 1)) + [n]  # end of the part that starts at i; 0 once it is gone
        before = list(range(-1, n))
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            j = ends[i]
            if j < n and (r := ranks.get(word[i : ends[j]])) is not None:
                heapq.heappush(heap, (r, i, ends[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = ends[i]
            if not j or j >= n or ends[j] != end:
                continue
            ends[i], ends[j] = end, 0
            if end < n:
                before[end] = i
                push(i)
            if before[i] >= 0:
                push(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : ends[i]]])
            i = ends[i]
        return out


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Vocabulary:
    """A vocabulary from a file of base64 byte strings and ranks; read on the driver."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)


@lru_cache(maxsize=4)
def _literals(vocab: Vocabulary) -> tuple[str, ...]:
    """The byte tokens and the rank map as text, which Spark parses once into literals."""
    single = [vocab.ranks[bytes([i])] for i in range(256)]
    offset, first, ranks = vocab.rank_map()
    cells = np.where(first < 0, 0, (first + 1) * RANKS + ranks)
    return tuple(",".join(map(str, x)) for x in (single, offset.tolist(), cells.tolist()))


def pieces(text: Column, vocab: Vocabulary) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({java_pattern(vocab.pattern)})"), F.lit(1))


def fold(word: Column, vocab: Vocabulary) -> Column:
    """The ids of a word of 1 to 255 bytes: ranked merges folded over its bytes."""

    def merges(single: Column, offset: Column, cells: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            t = state["t"]

            def key(b: Column, i: Column) -> Column:
                """rank * 256 + i of the pair that ends at i; null where there is none."""
                a = F.get(t, i - 1)
                cell = F.get(cells, F.get(offset, a) + b)
                return F.when(F.shiftright(cell, RANK_BITS) == a + 1, cell.bitwiseAND(F.lit(RANKS - 1)).cast("int") * 256 + i)

            def merge(k: Column) -> Column:
                p, token = k.bitwiseAND(F.lit(255)), F.shiftright(k, 8)
                new = F.filter(F.transform(t, lambda x, i: F.when(i == p - 1, token).otherwise(x)), lambda _, i: i != p)
                return F.when(k.isNull(), F.struct(t.alias("t"), F.lit(False).alias("go"))).otherwise(F.struct(new.alias("t"), F.lit(True).alias("go")))

            return F.when(state["go"], let(F.array_min(F.transform(t, key)), merge)).otherwise(state)

        first = F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: F.get(single, F.ascii(c)))
        n = F.octet_length(word)
        return F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), F.struct(first.alias("t"), (n > 1).alias("go")), step, lambda s: s["t"])

    single, offset, cells = (F.split(F.lit(x), ",").cast(f"array<{t}>") for x, t in zip(_literals(vocab), ("int", "int", "bigint"), strict=True))
    return let(single, lambda a: let(offset, lambda b: let(cells, lambda c: merges(a, b, c))))


def _is_short(words: pa.Array) -> pa.Array:
    return pc.less_equal(pc.binary_length(words), LONG)


def hot_words(split: DataFrame, vocab: Vocabulary, most: int = HOT_WORDS, most_bytes: int = HOT_BYTES, parts: int = HOT_PARTS) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The most frequent words of the column ``pieces`` and their ids: at most ``most`` words of ``most_bytes`` in all, a part after the other."""

    def count(b: pa.RecordBatch) -> dict:
        words = b.column(0).flatten()
        got = pc.value_counts(words.filter(_is_short(words)))
        return {"word": got.field(0), "n": got.field(1), "size": pc.binary_length(got.field(0))}

    counts = durable(arrow_stage(split.select("pieces"), count, "word string, n bigint, size int").groupBy("word").agg(F.sum("n").alias("n"), F.first("size").alias("size")).where("n > 1"))
    level = F.floor(F.log2("n") * 4).cast("int")
    least, words, size = 1 << 30, 0, 0
    for r in sorted(counts.groupBy(level.alias("l")).agg(F.count("*").alias("c"), F.sum("size").alias("s")).collect(), key=lambda r: -r.l):
        words, size = words + r.c, size + r.s
        if words > most or size > most_bytes:
            break
        least = r.l
    # Folded by one plan, since the driver holds the rank map's text once for each.
    folded = durable(counts.where(level >= least).select("word", fold(F.col("word"), vocab).alias("ids")))
    for i in range(parts):
        got = folded.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == i).toArrow()
        both = [got.column(c).combine_chunks() for c in ("word", "ids")]
        got = None  # else two parts are held at once
        yield both.pop(0), both.pop(0)


def _flat(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list array without nulls."""
    if not len(x):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    o = x.offsets.to_numpy()
    return x.flatten().to_numpy(zero_copy_only=False), (o - o[0]).astype(np.int64)


def _behind(buffer: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``more`` after the first n values of a buffer, which is kept where it is long enough."""
    if n + len(more) > len(buffer):
        return np.concatenate([buffer[:n], more])
    buffer[n : n + len(more)] = more
    return buffer


def _on_first(values: pa.Array, n: int) -> pa.Array:
    """A column of n rows, of which the first holds all values as a list and the others are null."""
    offsets = pa.array([0] + [len(values)] * n, pa.int32(), mask=np.array([False] + [True] * (n - 1) + [False]) if n > 1 else None)
    return pa.ListArray.from_arrays(offsets, values)


def encode(df: DataFrame, key: str, text: str, vocab: Vocabulary, hot: bool = True, decoded: bool = False, staged: bool = False) -> DataFrame:
    """(key, ids): ids is a binary of little-endian unsigned 32-bit integers for each row; ``ids_of`` unpacks it.

    With ``decoded`` the stage that fills in the ids decodes them as well, into the column that ``decode`` adds. With ``staged`` the
    folded runs are checkpointed: a task then has one Python worker beside it, not two, for some four bytes of disk a word.
    """
    kind, conf = df.schema[key].dataType.simpleString(), df.sparkSession.conf
    if conf.get(PLAN_TEXT).rstrip("b") == NO_BOUND:  # else the driver keeps the map's text with the plan of each run
        conf.set(PLAN_TEXT, str(PLAN_BYTES))
    split = bounded_batches(df.select(F.col(key).alias("k"), pieces(F.col(text), vocab).alias("pieces")))
    # The dictionary goes through the driver a part after the other. The stage that looks words up needs no ids, the one that fills ids in needs no words.
    share, looked, filled, n_hot, state = df.sparkSession.sparkContext.broadcast, [], [], 0, {}
    for words, ids in hot_words(split, vocab) if hot else ():
        looked.append((n_hot, share(words)))
        filled.append(share(_flat(ids)))
        n_hot += len(words)
        words = ids = None
        release()
    shared, pieces_ = share(vocab), share(vocab.pieces)

    def pack(b: pa.RecordBatch) -> dict | None:
        """Each text's words as numbers: first of the dictionary, then of the run's other words, which stand on its first row, short ones first."""
        if not b.num_rows:
            return None
        vocab, lists = shared.value, b.column(1)
        offsets = lists.offsets.to_numpy().astype(np.int64) * 4
        named = pc.dictionary_encode(lists.flatten())
        words = named.dictionary
        number = np.full(len(words), -1, "<i4")
        for first, known in looked:  # a table of the run's few words, not of the dictionary's many
            at = pc.fill_null(pc.index_in(known.value.cast(words.type), value_set=words), -1).to_numpy()
            here = np.flatnonzero(at >= 0)
            number[at[here]] = here + first
        rare = np.flatnonzero(number < 0)
        short = _is_short(words.take(pa.array(rare))).to_numpy(zero_copy_only=False) if len(rare) else np.zeros(0, bool)
        rare = np.concatenate([rare[short], rare[~short]])
        number[rare] = n_hot + np.arange(len(rare))
        own, n_short = words.take(pa.array(rare)), int(short.sum())
        merged = [vocab.merge(w.encode()) for w in own[n_short:].to_pylist()]
        codes = number[named.indices.to_numpy(zero_copy_only=False)].tobytes()
        state["run"] = run = state.get("run", 0) + 1
        return {
            "k": b.column(0), "run": pa.array(np.full(b.num_rows, run, np.int32)), "codes": pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((offsets - offsets[0]).astype("<i4").tobytes()), pa.py_buffer(codes)]),
            "words": _on_first(own[:n_short], b.num_rows), "long_ids": _on_first(pa.array(merged, pa.list_(pa.int32())), b.num_rows),
        }

    def fill(b: pa.RecordBatch) -> dict:
        """The ids of each text's words. A run's rows follow its first one in the same task, over batches too."""
        if "n" not in state:
            hot = [x.value for x in filled]
            flat, size = [np.concatenate([*x, np.zeros(0, np.int32)]) for x in ([f for f, _ in hot], [np.diff(at) for _, at in hot])]
            state.update(n=len(flat), flat=flat, at=np.concatenate([[0], np.cumsum(size)]))
        runs, lists, packed = b.column(1).to_numpy(zero_copy_only=False), b.column(3), []
        for i, raw in enumerate(b.column(2)):
            if lists[i].is_valid:
                own, at = _flat(lists[i].values)
                state["flat"], state["at"] = _behind(state["flat"], state["n"], own), _behind(state["at"], n_hot, at + state["n"])
                state["of"] = runs[i]
            if state["of"] != runs[i]:
                raise RuntimeError("a run's words are missing")
            flat, at = state["flat"], state["at"]
            code = np.frombuffer(raw.as_buffer(), "<i4")
            begin, size = at[code], at[code + 1] - at[code]
            start = np.cumsum(size) - size
            packed.append(flat[np.repeat(begin - start, size) + np.arange(size.sum())].astype("<u4").tobytes())
        out = {"k": b.column(0), "ids": pa.array(packed, pa.binary())}
        return out | ({"decoded": concatenated(packed, pieces_.value)} if decoded else {})

    coded = arrow_stage(split, pack, f"k {kind}, run int, codes binary, words array<string>, long_ids array<array<int>>")
    folded = coded.select("k", "run", "codes", F.when(F.col("words").isNotNull(), F.concat(F.transform("words", lambda w: fold(w, vocab)), "long_ids")).alias("lists"))
    if staged:
        settle(df.sparkSession)
        folded = durable(folded)
        for _, known in looked:
            known.unpersist()
        settle(df.sparkSession)
    return arrow_stage(folded, fill, f"k {kind}, ids binary" + ", decoded binary" * decoded).withColumnRenamed("k", key)


def concatenated(packed: list[bytes], pieces: pa.Array) -> pa.Array:
    """The bytes of each row's packed ids."""
    ends = np.cumsum([len(x) // 4 for x in packed])
    group = np.concatenate([ends - np.diff(ends, prepend=0), [0]])[: len(packed)] // GROUP  # of rows that begin within as many ids
    cuts = np.flatnonzero(np.diff(group)) + 1
    return pa.concat_arrays([_joined(packed[a:e], pieces) for a, e in zip([0, *cuts], [*cuts, len(packed)], strict=True)])


def _joined(packed: list[bytes], pieces: pa.Array) -> pa.Array:
    i = np.frombuffer(b"".join(packed), "<u4")
    if len(i) and i.max() >= len(pieces):
        raise ValueError(f"no such id: {i.max()}")
    # The pieces of all rows lie one after another: a row's text runs from the start of its first piece to that of the next row's.
    got = pieces.take(pa.array(i))
    starts = np.frombuffer(got.buffers()[1], "<i8", len(i) + 1, got.offset * 8) if len(i) else np.zeros(1, np.int64)
    ends = starts[np.cumsum([0, *(len(x) // 4 for x in packed)])] - starts[0]
    data = got.buffers()[2].slice(int(starts[0]), int(ends[-1])) if len(i) else pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.large_binary(), len(packed), [None, pa.py_buffer(ends.tobytes()), data])


def decode(df: DataFrame, key: str, ids: str, vocab: Vocabulary) -> DataFrame:
    """(key, ids, decoded): ``decoded`` is the concatenation of the binary pieces of packed ids."""
    shared = df.sparkSession.sparkContext.broadcast(vocab.pieces)
    kind = df.schema[key].dataType.simpleString()

    def run(b: pa.RecordBatch) -> dict:
        return {key: b.column(0), ids: b.column(1), "decoded": concatenated([x or b"" for x in b.column(1).to_pylist()], shared.value)}

    return arrow_stage(df.select(key, ids), run, f"`{key}` {kind}, `{ids}` binary, decoded binary")


def ids_of(packed: Column) -> Column:
    """Packed ids, each below 2 ** 24, as an array of integers."""
    byte = lambda i, j: F.conv(F.hex(F.substring(packed, i * 4 + (j + 1), F.lit(1))), 16, 10).cast("int") * (256**j)
    n = (F.octet_length(packed) / 4).cast("int")
    one = lambda i: byte(i, 0) + byte(i, 1) + byte(i, 2)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<int>"))
