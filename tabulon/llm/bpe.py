"""Byte-level BPE with a transducer lexicon of the frequent words.

Words are cut by the vocabulary's pattern, over the code points of many texts at once. A
word of the lexicon gets its ids from a minimal acyclic transducer, compiled once from the
counts of all words of the corpus and mapped into memory by every Python worker; any other
word is merged exactly and remembered within the task. The lexicon changes the speed, never
the ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import uuid
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.texthash import blocks, span_hasher
from tabulon.llm.transducer import compile_words, ranks
from tabulon.llm.workers import prepare
from tabulon.session import shared_folder, stored

#: Words in the lexicon, and the most bytes of one.
LEXICON_WORDS = 1 << 16
LEXICON_BYTES = 32
#: Words remembered in a task, and counted before they are handed on.
MEMO_WORDS = 1 << 18
_NEVER = 1 << 40
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: The endings that the pattern cuts off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@dataclass(frozen=True)
class Vocabulary:
    """Bytes of each id, rank and result of each merge, ids of single bytes, added tokens."""

    tokens: list[bytes]
    merges: dict[int, tuple[int, int]] = field(repr=False)
    single: list[int] = field(repr=False)
    added: list[tuple[bytes, int]]
    keys: np.ndarray = field(repr=False)  # of the merges, sorted; then their ranks and results
    order: np.ndarray = field(repr=False)
    result: np.ndarray = field(repr=False)


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE file in the JSON format of the tokenizers library; read on the driver."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters, model = _byte_letters(), spec["model"]
    kind = spec["pre_tokenizer"]
    if model["type"] != "BPE" or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or spec["normalizer"]:
        raise ValueError("Only byte-level BPE without normalizer and prefix space is supported.")
    vocab = model["vocab"]
    added = [(t["content"].encode(), t["id"]) for t in spec["added_tokens"]]
    tokens = [b""] * (1 + max([*vocab.values(), *(i for _, i in added)]))
    for text, i in vocab.items():
        tokens[i] = bytes(letters[c] for c in text) if all(c in letters for c in text) else text.encode()
    for text, i in added:
        tokens[i] = text
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
    single = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
    table = np.array([(k, *merges[k]) for k in sorted(merges)], np.int64).reshape(-1, 3)
    return Vocabulary(tokens, merges, single, added, *(np.ascontiguousarray(table[:, k]) for k in range(3)))


def merge_word(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of one word: the earliest merge first, leftmost among equals, until none applies.

    Neighbours are linked and the possible merges lie in a heap, so a word of any length
    takes n log n steps.
    """
    ids, merges = [vocabulary.single[b] for b in word], vocabulary.merges
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(*found, k, ids[k], ids[k + 1]) for k in range(n - 1) if (found := merges.get(ids[k] << 20 | ids[k + 1]))]
    heap = [(rank, k, new, a, b) for rank, new, k, a, b in heap]
    heapq.heapify(heap)
    while heap:
        _, k, new, a, b = heapq.heappop(heap)
        right = after[k] if ids[k] == a else n
        if right >= n or ids[right] != b:
            continue  # one of the two has been merged since
        ids[k], ids[right] = new, -1
        after[k] = after[right]
        if after[k] < n:
            before[after[k]] = k
        for left, other in ((before[k], k), (k, after[k])):
            if left >= 0 and other < n and (found := merges.get(ids[left] << 20 | ids[other])):
                heapq.heappush(heap, (found[0], left, found[1], ids[left], ids[other]))
    return [i for i in ids if i >= 0]


def _rank_pairs(left: np.ndarray, right: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Rank of each pair's merge; _NEVER for pairs that do not merge."""
    keys = vocabulary.keys
    wanted = (left.astype(np.int64) << 20) | right
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    fits = (keys[at] == wanted) & (left >= 0) & (right >= 0)
    return np.where(fits, vocabulary.order[at], _NEVER)


def merge_words(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, ids per word); a round makes one merge in each word."""
    lengths = np.array([len(w) for w in words], np.int64)
    single = np.array(vocabulary.single, np.int64)
    result = np.zeros(int(vocabulary.order.max(initial=0)) + 1, np.int64)
    result[vocabulary.order] = vocabulary.result
    counts, parts = np.zeros(len(words), np.int64), []  # parts: (word numbers, their ids, padded by -1)
    for k in np.flatnonzero(lengths > LEXICON_BYTES).tolist():
        parts.append((np.array([k]), np.array([merge_word(words[k], vocabulary)])))
    for lowest, length in ((1, 4), (5, 8), (9, 12), (13, LEXICON_BYTES)):
        at = np.flatnonzero((lengths >= lowest) & (lengths <= length))
        if not len(at):
            continue
        column = np.arange(length)
        raw = np.frombuffer(b"".join([words[k].ljust(length, b"\0") for k in at.tolist()]), np.uint8)
        ids = np.where(column < lengths[at][:, None], single[raw.reshape(len(at), length)], -1)
        rank = _rank_pairs(ids[:, :-1], ids[:, 1:], vocabulary)
        while len(at):
            best = rank.argmin(1)
            least = rank[np.arange(len(at)), best]
            still = least < _NEVER
            if not still.all():
                parts.append((at[~still], ids[~still]))
                at, ids, rank, best, least = at[still], ids[still], rank[still], best[still], least[still]
                if not len(at):
                    break
            ids[np.arange(len(at)), best] = result[least]
            shift = np.minimum(column + (column > best[:, None]), length - 1)
            ids = np.take_along_axis(ids, shift, 1)
            ids[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(shift[:, :-1], length - 2), 1)
            rank[:, -1] = _NEVER
            for near in (best - 1, best):
                fit = np.flatnonzero((near >= 0) & (near < length - 1))
                rank[fit, near[fit]] = _rank_pairs(ids[fit, near[fit]], ids[fit, near[fit] + 1], vocabulary)
    for at, ids in parts:
        counts[at] = (ids >= 0).sum(1)
    starts = np.cumsum(counts) - counts
    flat = np.zeros(int(counts.sum()), np.int32)
    for at, ids in parts:
        row, column = np.nonzero(ids >= 0)
        flat[starts[at[row]] + column] = ids[row, column]
    return flat, counts


@cache
def _classes() -> np.ndarray:
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    points = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start() : m.end()]] = kind
    return out


def _segments(data: np.ndarray, offsets: np.ndarray, added) -> tuple[np.ndarray, dict[int, int]]:
    """Starts of segments (texts, and their parts around added tokens), and added tokens by start."""
    starts, special, raw = [offsets], {}, data.tobytes()
    for token, i in added:
        at = raw.find(token)
        while at >= 0:
            end = at + len(token)
            if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, end - 1, "right"):
                special[at] = i
                starts.append(np.array([at, end]))
                at = raw.find(token, end)
            else:
                at = raw.find(token, at + 1)
    return np.unique(np.concatenate(starts)), special


def cut_words(data: np.ndarray, offsets: np.ndarray, added) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Byte starts and ends of the pattern's words, and the ids of added tokens by start."""
    segments, special = _segments(data, offsets, added)
    first = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), special
    kind = _classes()[points]
    opens = np.zeros(n + 1, bool)  # a segment starts here
    opens[np.searchsorted(first, segments[segments < len(data)])] = True
    opens[n] = True
    run = opens[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # A run that follows a blank takes it along; the last white space before a run stands alone.
    flag = run.copy()
    joined = np.flatnonzero(run[1:] & ~opens[1:-1] & space[:-1]) + 1
    flag[joined] = points[joined - 1] != 32
    flag[joined - 1] = True
    # Endings after an apostrophe that starts a word.
    quote = np.flatnonzero((points == 39) & flag & run)
    if len(quote):
        padded = np.concatenate((points, np.zeros(2, np.uint32)))
        shut = np.concatenate((opens, [True, True]))
        one, two = padded[quote + 1], padded[quote + 2]
        inside, further = ~shut[quote + 1], ~shut[quote + 2]
        for ending in ENDINGS:
            fits = inside & (one == ord(ending[0]))
            if len(ending) == 2:
                fits &= further & (two == ord(ending[1]))
            at = quote[fits]
            flag[at + 1] = False
            after = at + 1 + len(ending)
            flag[after[after < n]] = True
    for at, i in special.items():
        a = int(np.searchsorted(first, at))
        b = int(np.searchsorted(first, at + len([t for t, k in added if k == i][0])))
        flag[a:b] = False
        flag[a] = True
    start = first[flag]
    return start, np.concatenate((start[1:], [len(data)])), special


class Encoder:
    """Ids of texts within one task; words that are not in the lexicon are merged once and remembered."""

    def __init__(self, vocabulary: Vocabulary, tables: dict[str, np.ndarray]):
        self.vocabulary, self.tables = vocabulary, tables
        self.known = len(tables["offsets"]) - 1
        self._forget()

    def _forget(self):
        self.memo: dict[bytes | int, int] = {}
        self.flat, self.offsets = [np.asarray(self.tables["ids"])], [np.asarray(self.tables["offsets"])]
        self.top, self._joined = int(self.tables["offsets"][-1]), None

    def encode(self, column: pa.Array):
        """The ids of each text of an Arrow column (null: none), as arrays."""
        for _, _, data, offsets in blocks(column):
            start, end, special = cut_words(data, offsets, self.vocabulary.added)
            rank = ranks(self.tables, data, start, end)
            self._fill(rank, data.tobytes(), start, end, special)
            if self._joined is None:
                self.flat, self.offsets = [np.concatenate(self.flat)], [np.concatenate(self.offsets)]
                self._joined = (self.flat[0], self.offsets[0])
            flat, places = self._joined
            counts = places[rank + 1] - places[rank]
            ends = np.concatenate(([0], np.cumsum(counts)))
            ids = flat[np.arange(ends[-1]) + np.repeat(places[rank] - ends[:-1], counts)]
            bounds = ends[np.searchsorted(start, offsets)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                yield ids[a:b]
            if len(self.memo) > MEMO_WORDS:
                self._forget()

    def _fill(self, rank, raw, start, end, special):
        """Ranks beyond the lexicon's for all other words, in order of their first place."""
        memo = self.memo
        places = np.flatnonzero(rank < 0)
        words = [raw[a:b] for a, b in zip(start[places].tolist(), end[places].tolist())]
        if special:  # an added token is no word, though its text may be one elsewhere
            words = [special.get(a, w) for a, w in zip(start[places].tolist(), words)]
        fresh = [w for w in dict.fromkeys(words) if w not in memo]
        if special:
            fresh.sort(key=lambda w: isinstance(w, int))
        if fresh:
            for w in fresh:
                memo[w] = self.known + len(memo)
            # Added tokens come last, one id each.
            flat, counts = merge_words([w for w in fresh if isinstance(w, bytes)], self.vocabulary)
            added = [w for w in fresh if not isinstance(w, bytes)]
            self.flat.append(np.concatenate((flat, np.array(added, np.int32))))
            self.offsets.append(self.top + np.cumsum(np.concatenate((counts, np.ones(len(added), np.int64)))))
            self.top += len(self.flat[-1])
            self._joined = None
        rank[places] = [memo[w] for w in words]


def _count_words(added):
    """(word, times) of a task's texts, counted by the hashes of their byte ranges."""
    def run(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                start, end, _ = cut_words(data, offsets, added)
                short = end - start <= LEXICON_BYTES
                start, end = start[short], end[short]
                h = span_hasher(data)(start, end)
                order = np.argsort(h)
                new = np.flatnonzero(np.diff(h[order], prepend=h[order[:1]] + np.uint64(1)))
                times = np.diff(np.append(new, len(h)))
                one, raw = order[new], data.tobytes()
                for a, b, n in zip(start[one].tolist(), end[one].tolist(), times.tolist()):
                    word = raw[a:b]
                    held[word] = held.get(word, 0) + n
                if len(held) > MEMO_WORDS:
                    yield _counted(held)
                    held = {}
        yield _counted(held)
    return run


def _counted(held: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "times"])


@dataclass(frozen=True)
class Codec:
    """A vocabulary and a compiled lexicon that every Python worker can map into memory."""

    vocabulary: object  # broadcast
    file: str
    layout: dict[str, tuple[int, int]]

    def tables(self) -> dict[str, np.ndarray]:
        whole = np.memmap(SparkFiles.get(self.file), np.int32, "r")
        return {name: whole[a:b] for name, (a, b) in self.layout.items()}

    def encoder(self) -> Encoder:
        return Encoder(self.vocabulary.value, self.tables())


def build_codec(docs: DataFrame, path: str, text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> Codec:
    """Count the words of all texts and compile the most frequent (at most ``lexicon_words``)."""
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = read_vocabulary(path)
    counted = docs.select(text_col).mapInArrow(_count_words(vocabulary.added), "word binary, times long")
    # Words are many, counts are few: the least count that still fits is found first, and only
    # words that reach it leave their tasks.
    with stored(counted.groupBy("word").agg(F.sum("times").alias("times"))) as totals:
        sizes = totals.groupBy("times").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("times")).limit(lexicon_words).collect()
        reached, least = 0, None
        for r in sizes:
            reached += r["words"]
            if reached > lexicon_words:
                break
            least = r["times"]
        top = totals.where(F.col("times") >= least if least else F.lit(False)).select("word").toArrow()
    words = sorted(bytes(w) for w in top.column("word").to_pylist())
    tables = compile_words(words)
    tables["ids"], counts = merge_words(words, vocabulary)
    tables["offsets"] = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    layout, top_at = {}, 0
    for name, values in tables.items():
        layout[name] = (top_at, top_at + len(values))
        top_at += len(values)
    content = np.concatenate([v.astype(np.int32) for v in tables.values()]).tobytes()
    return Codec(spark.sparkContext.broadcast(vocabulary), _send_file(spark, content), layout)


def _send_file(spark: SparkSession, content: bytes) -> str:
    """Put bytes into the shared folder and have Spark hand them to every executor."""
    context, name = spark.sparkContext, f"lexicon-{uuid.uuid4().hex}"
    target = f"{shared_folder(spark).rstrip('/')}/{name}"
    place = context._jvm.org.apache.hadoop.fs.Path(target)
    system = place.getFileSystem(context._jsc.hadoopConfiguration())
    stream = system.create(place)
    stream.write(content)
    stream.close()
    context.addFile(system.makeQualified(place).toString())
    return name


def _with(docs: DataFrame, **more: T.DataType) -> T.StructType:
    """The schema of ``docs`` with more columns, whatever its own ones are."""
    return T.StructType([*docs.schema.fields, *[T.StructField(name, kind) for name, kind in more.items()]])


def _id_lists(ids: list[np.ndarray]) -> pa.Array:
    ends = pa.array(np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)))


def encode_documents(docs: DataFrame, codec: Codec, text_col: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text; a null text has none. ``name`` must be a new column."""
    at = docs.columns.index(text_col)

    def run(batches):
        encoder = codec.encoder()
        for batch in batches:
            ids = list(encoder.encode(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, _id_lists(ids)], [*batch.schema.names, name])

    return docs.mapInArrow(run, _with(docs, **{name: T.ArrayType(T.IntegerType())}))


def round_trip(docs: DataFrame, codec: Codec, text_col: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of each text and what they decode to, by one task each; both names must be new."""
    at = docs.columns.index(text_col)

    def run(batches):
        encoder, tokens = codec.encoder(), codec.vocabulary.value.tokens
        for batch in batches:
            found = list(encoder.encode(batch.column(at)))
            texts = pa.array([decode_ids(i.tolist(), tokens) for i in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, _id_lists(found), texts], [*batch.schema.names, ids, decoded])

    return docs.mapInArrow(run, _with(docs, **{ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()}))


def decode_ids(ids, tokens: list[bytes]) -> str:
    """Text of ids; bytes that are not UTF-8 become replacement characters."""
    return b"".join([tokens[i] for i in ids]).decode("utf-8", "replace")


def decode_documents(docs: DataFrame, codec: Codec, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``docs`` with the text of its ids (null: empty). ``name`` must be a new column."""
    at, vocabulary = docs.columns.index(ids_col), codec.vocabulary

    def run(batches):
        for batch in batches:
            texts = [decode_ids(ids or [], vocabulary.value.tokens) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return docs.mapInArrow(run, _with(docs, **{name: T.StringType()}))


def round_trip_digests(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded again."""
    rows = docs.select(id_col, text_col)

    def run(batches):
        encoder = codec.encoder()
        tokens = codec.vocabulary.value.tokens
        names = [str(i) for i in range(len(tokens))]
        for batch in batches:
            n, written, decoded = [], [], []
            for ids in encoder.encode(batch.column(1)):
                ids = ids.tolist()
                n.append(len(ids))
                written.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(decode_ids(ids, tokens).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(written, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
